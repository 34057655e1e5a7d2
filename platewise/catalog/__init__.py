"""Registered queries over the driver's tables, each with the SQL that must give the same rows.

Wells are lines of ``lineitem`` (source: line status, plate: supplier, treatment: part; features: quantity, price,
discount with 0 as missing, tax; controls: return flag N), vectors are ``embeddings``, sequences are the
amino-acid letters of ``documents``, request logs are ``events``.
"""

from __future__ import annotations

from platewise.catalog import joins, logs, profiles, selections, sequences, storage, vectors
from platewise.catalog.base import REGISTRY

MODULES = (profiles, joins, sequences, vectors, selections, logs, storage)


def queries() -> dict:
    return {name: run for name, (run, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}
