"""Joins of profiles, metadata, proteins and predictions.

Equality joins follow SQL: null keys do not match, unless ``null_safe`` asks for pandas' rule. A side is
left for Spark to broadcast by its measured size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platewise.operators.ranges import as_of  # noqa: F401


def first_per_key(df: DataFrame, keys, ordinal, keep: str = "first") -> DataFrame:
    """E5: the first (or last) row of each key by an explicit order; ties go by all other columns' order of ``ordinal``."""
    order = [ordinal] if isinstance(ordinal, str) else list(ordinal)
    order = [F.col(c).asc_nulls_last() if keep == "first" else F.col(c).desc_nulls_first() for c in order]
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def metadata_join(left: DataFrame, right: DataFrame, ladder, ordinal: str, null_safe: bool = False) -> DataFrame:
    """Left join on the first rung of key columns that both sides have; no rung means no change.

    Of the right side only columns that the left lacks come along, of the first row per key. A rung is a list of
    names, or of (left, right) pairs of names.
    """
    for rung in ladder:
        pairs = [(k, k) if isinstance(k, str) else k for k in rung]
        if not all(a in left.columns and b in right.columns for a, b in pairs):
            continue
        new = [c for c in right.columns if c not in left.columns and c not in [b for _, b in pairs] and c != ordinal]
        if not new:
            return left
        one = first_per_key(right.select(*{b: None for _, b in pairs}, *new, ordinal), [b for _, b in pairs], ordinal).drop(ordinal)
        one = one.withColumnsRenamed({b: f"_r_{b}" for _, b in pairs})
        same = [left[a].eqNullSafe(one[f"_r_{b}"]) if null_safe else left[a] == one[f"_r_{b}"] for a, b in pairs]
        return left.join(one, reduce(lambda x, y: x & y, same), "left").drop(*[f"_r_{b}" for _, b in pairs])
    return left


def enrich(profiles: DataFrame, steps) -> DataFrame:
    """Metadata joins one after another; later ones add only what is still missing."""
    for right, ladder, ordinal in steps:
        profiles = metadata_join(profiles, right, ladder, ordinal)
    return profiles


def with_replicates(df: DataFrame, keys, least: int) -> DataFrame:
    """Rows of groups with at least ``least`` rows."""
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least)
    return df.join(groups.select(*keys), list(keys), "left_semi")


def match_proteins(phenotypes: DataFrame, proteins: DataFrame, qc: str | None = None, count: str | None = None, least: int | None = None) -> DataFrame:
    """C4: phenotypes (``protein_id``) with the hash of the protein they name by hash or else by name.

    Of proteins with one name the last by ``ordinal`` counts. Unmatched phenotypes have a null ``hash``.
    """
    rows = phenotypes
    if qc:
        rows = rows.filter(F.col(qc))
    if count and least:
        rows = rows.filter((F.coalesce(F.col(count), F.lit(0)) == 0) | (F.col(count) >= least))
    by_hash = proteins.select(F.col("hash").alias("_h")).distinct()
    by_name = first_per_key(proteins, ["name"], "ordinal", keep="last").select(F.col("name").alias("_name"), F.col("hash").alias("_by_name"))
    out = rows.join(by_hash, rows["protein_id"] == F.col("_h"), "left").join(by_name, F.col("protein_id") == F.col("_name"), "left")
    return out.withColumn("hash", F.coalesce("_h", "_by_name")).drop("_h", "_name", "_by_name")


def join_embeddings(profiles: DataFrame, embeddings: DataFrame, gene: str, mapping: DataFrame | None = None) -> DataFrame:
    """Profiles with their gene's embedding, through a mapping (``gene, mapped``) where it has one."""
    if mapping is not None:
        known = mapping.select(F.col("gene").alias("_g"), F.col("mapped").alias("_m"))
        profiles = profiles.join(known, profiles[gene] == F.col("_g"), "left").withColumn("embedding_key", F.coalesce("_m", gene)).drop("_g", "_m")
    else:
        profiles = profiles.withColumn("embedding_key", F.col(gene))
    return profiles.join(embeddings, profiles["embedding_key"] == embeddings["id"]).drop(embeddings["id"])


def mean_per_gene(joined: DataFrame, gene: str, values, embedding: str) -> DataFrame:
    """One row a gene instead of a well: the mean of each value column, and the gene's embedding."""
    return joined.groupBy(gene).agg(*[F.avg(c).alias(c) for c in values], F.first(embedding).alias(embedding), F.count(F.lit(1)).alias("n_wells"))


def match_pool(pool: DataFrame, embeddings: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """Candidates with their embeddings, and one row with how many candidates matched and how many were dropped."""
    known = embeddings.select(on).distinct().withColumn("_known", F.lit(1))
    counts = pool.select(on).join(known, on, "left").agg(F.count("_known").alias("n_matched"), F.count_if(F.col("_known").isNull()).alias("n_dropped"))
    return pool.join(embeddings, on), counts


def unmatched(left: DataFrame, right: DataFrame, on) -> DataFrame:
    """Rows of ``left`` without a partner."""
    return left.join(right.select(*([on] if isinstance(on, str) else on)), on, "left_anti")


def add_task(samples: DataFrame, values: DataFrame, key: str, task: str) -> DataFrame:
    """A task column with its mask."""
    return samples.join(values.select(key, task), key, "left").withColumn(f"{task}_mask", F.col(task).isNotNull())


def restrict(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Rows whose key is listed."""
    return df.join(ids.select(on), on, "left_semi")


def overlap_counts(members: DataFrame, annotations: DataFrame, key: str, group: str, label: str) -> DataFrame:
    """How many members of each group carry each label."""
    return members.join(annotations, key).groupBy(group, label).agg(F.count(F.lit(1)).alias("n"))


def zip_rows(a: DataFrame, b: DataFrame, ordinal: str) -> DataFrame:
    """Rows paired by position; a position that only one side has is an error. Null values are values."""
    both = a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), ordinal, "full")
    alone = F.col("_a").isNull() | F.col("_b").isNull()
    checked = F.when(alone, F.raise_error(F.lit("unequal lengths")).cast(a.schema[ordinal].dataType)).otherwise(F.col(ordinal))
    return both.withColumn(ordinal, checked).drop("_a", "_b")


def compare_metrics(a: DataFrame, b: DataFrame) -> DataFrame:
    """Metrics of two versions (``metrics`` maps) side by side, with delta and relative change (null on zero)."""
    x = a.select(F.explode("metrics").alias("metric", "a"))
    y = b.select(F.explode("metrics").alias("metric", "b"))
    both = x.join(y, "metric", "full")
    return both.withColumn("delta", F.col("b") - F.col("a")).withColumn("relative", F.try_divide(F.col("b") - F.col("a"), F.abs("a")))
