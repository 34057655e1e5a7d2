"""Screening-profile and sequence-feature analytics on Spark DataFrames."""
