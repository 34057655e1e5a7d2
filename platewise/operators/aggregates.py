"""Replicate aggregation, counts, summaries, top-k and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platewise.operators.joins import first_per_key, restrict, unmatched
from platewise.operators.order import exact_percentiles
from platewise.schema import from_long, pack, to_long, unpack

HOW = {"mean": F.avg, "median": F.median}


def exact_median_by_count(long: DataFrame, keys, value: str, out: str) -> DataFrame:
    """Median in two phases, (keys, value) counts and then a weighted percentile, for keys that hold a large share of rows."""
    counts = long.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    return counts.groupBy(*keys).agg(F.percentile(value, 0.5, F.col("_c")).alias(out))


def _by_feature(rows: DataFrame, keys: list[str], features, how: str, count: str) -> DataFrame:
    """``keys``, each feature's mean or median within them, and the number of rows: by the long form, so the plan has one aggregate and no group one task beyond its means."""
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(count))
    if not features:
        return sizes
    largest = sizes.agg(F.max(count)).first()[0] or 0
    long = to_long(pack(rows, features, keys), keys)
    per = exact_percentiles(long, [*keys, "f"], "v", {"v": 0.5}, largest=largest) if how == "median" else long.groupBy(*keys, "f").agg(HOW[how]("v").alias("v"))
    return unpack(from_long(per, keys), features).join(sizes, keys)


def cells_to_wells(cells: DataFrame, keys, features, how: str = "median") -> DataFrame:
    """A row per well with ``cell_count`` and an id of the keys joined by underscores; rows with null keys are left out."""
    there = [k for k in keys if k in cells.columns]
    out = _by_feature(cells.dropna(subset=there), there, list(features), how, "cell_count")
    return out.withColumn("sample_id", F.concat_ws("_", *[F.col(k).cast("string") for k in there]))


def wells_to_treatments(wells: DataFrame, key: str, features, how: str = "median", least: int = 1) -> DataFrame:
    """A row per treatment of at least ``least`` wells; wells count before nulls are skipped; null keys are left out."""
    out = _by_feature(wells.dropna(subset=[key]), [key], list(features), how, "n_replicates")
    return out.filter(F.col("n_replicates") >= least)


def replicate_counts(df: DataFrame, key: str) -> DataFrame:
    """D3."""
    return df.dropna(subset=[key]).groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """D4."""
    return df.select(column).dropna().distinct()


def plate_sources(wells: DataFrame, plate: str, *where: str) -> DataFrame:
    """Distinct plates with their source and batch."""
    return wells.select(plate, *where).distinct()


def replicate_distribution(df: DataFrame, key: str) -> DataFrame:
    """How many keys have n replicates and at least n. Rows of the result are distinct counts."""
    per = replicate_counts(df, key).groupBy("n").agg(F.count(F.lit(1)).alias("keys"))
    return per.withColumn("keys_at_least", F.sum("keys").over(Window.orderBy(F.col("n").desc())))


def spread(df: DataFrame, key: str, plate: str) -> DataFrame:
    """Wells and distinct plates per perturbation."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_wells"), F.count_distinct(plate).alias("n_plates"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """D31."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def distinct_counts(df: DataFrame, columns, approximate: bool = False) -> DataFrame:
    """One row of distinct counts."""
    f = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(*[f(c).alias(c) for c in columns])


def most_variable(long: DataFrame, key: str, k: int = 30) -> DataFrame:
    """The k features whose means vary most over keys."""
    means = long.groupBy(key, "f").agg(F.avg("v").alias("m"))
    return means.groupBy("f").agg(F.var_pop("m").alias("variance")).orderBy(F.col("variance").desc(), "f").limit(k)


def most_variable_packed(packed: DataFrame, key: str, k: int = 30, features: str = "features") -> DataFrame:
    """D34 on packed rows. They are dealt by key before they become a row a feature, so a task sums up only the keys dealt to it, and not all keys that occur in its input."""
    return most_variable(to_long(packed.select(key, F.col(features).alias("features")).repartition(key), [key]), key, k)


def phenotype_summary(packed: DataFrame, plate: str, protein: str, qc: str) -> DataFrame:
    """One row about a whole set of packed phenotypes."""
    v = packed.select(F.explode("features").alias("v"))
    values = v.agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.sum(F.col("v").isNull().cast("long")).alias("nulls"))
    rows = packed.agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.max(F.size("features")).alias("n_features"),
        F.count_distinct(plate).alias("n_plates"),
        F.count_distinct(protein).alias("n_proteins"),
        F.sum(F.col(qc).cast("long")).alias("n_passed"),
    )
    return rows.crossJoin(values)


def library_summary(proteins: DataFrame, seq: str) -> DataFrame:
    """Count and length statistics."""
    n = F.length(seq)
    return proteins.agg(F.count(F.lit(1)).alias("n"), F.min(n).alias("shortest"), F.avg(n).alias("mean"), F.median(n).alias("median"), F.max(n).alias("longest"))


def coverage(proteins: DataFrame, kinds: str) -> DataFrame:
    """Share of rows that have each kind of embedding (a map column)."""
    n = proteins.agg(F.count(F.lit(1)).alias("_n"))
    per = proteins.select(F.explode(F.map_keys(kinds)).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    return per.crossJoin(F.broadcast(n)).select("kind", (F.col("n") / F.col("_n")).alias("share"))


def table_counts(tables: dict[str, tuple[DataFrame | None, str]]) -> DataFrame:
    """Distinct keys of each table, null where a table is missing."""
    out = None
    for name, (df, key) in tables.items():
        if df is None:
            continue
        row = df.agg(F.lit(name).alias("table"), F.count_distinct(key).alias("n"))
        out = row if out is None else out.unionByName(row)
    missing = [n for n, (df, _) in tables.items() if df is None]
    if missing:
        row = out.sparkSession.createDataFrame([(n, None) for n in missing], "table string, n long")
        out = out.unionByName(row)
    return out


def top_groups(df: DataFrame, key: str, k: int) -> DataFrame:
    """rows of the k keys with most rows, ties to the smaller key."""
    return restrict(df, replicate_counts(df, key).orderBy(F.col("n").desc(), key).limit(k), key)


def widest_groups(df: DataFrame, key: str, plate: str, k: int) -> DataFrame:
    """rows of the k keys on most plates, ties to the smaller key."""
    return restrict(df, df.groupBy(key).agg(F.count_distinct(plate).alias("n")).orderBy(F.col("n").desc(), key).limit(k), key)


def top_k(df: DataFrame, score: str, k: int, tie: str) -> DataFrame:
    """The k best rows."""
    return df.orderBy(F.col(score).desc(), tie).limit(k)


def first_plates(plates: DataFrame, ordinal: str, most: int) -> DataFrame:
    """the first plates of a list, to be taken before anything is read from them."""
    return plates.orderBy(ordinal).limit(most)


def best_and_worst(df: DataFrame, score: str, k: int, tie: str) -> DataFrame:
    """F8: the k best and the k worst rows, marked by ``side``."""
    best, worst = (df.orderBy(order, tie).limit(k).withColumn("side", F.lit(side)) for order, side in ((F.col(score).desc(), "best"), (F.col(score).asc(), "worst")))
    return best.unionByName(worst)


def training_statistics(samples: DataFrame, label: str, plate: str) -> tuple[DataFrame, DataFrame]:
    """One row of counts about a training set (``features``, label, plate), and mean and spread of each feature."""
    whole = samples.agg(F.count(F.lit(1)).alias("n_samples"), F.count_distinct(label).alias("n_labels"), F.count_distinct(plate).alias("n_plates"), F.max(F.size("features")).alias("n_features"))
    per = samples.select(F.posexplode("features").alias("f", "v")).groupBy("f").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    return whole, per


def best_version(versions: DataFrame, metric: str, higher: bool = True, stage: str | None = None, tags=()) -> DataFrame:
    """the best version by a metric, of a stage and with all given tags."""
    value = F.try_element_at("metrics", F.lit(metric))
    rows = versions.filter(value.isNotNull())
    if stage:
        rows = rows.filter(F.col("stage") == stage)
    if tags:
        rows = rows.filter(F.size(F.array_except(F.array(*[F.lit(t) for t in tags]), "tags")) == 0)
    return rows.orderBy(value.desc() if higher else value.asc(), "version").limit(1)


def sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement, the same for every run and layout."""
    return df.orderBy(F.sha2(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")), 256), key).limit(n)


def union_tagged(tables: dict[str, DataFrame], tag: str) -> DataFrame:
    """Tables one after another, missing columns as nulls, with their name in ``tag``."""
    out = None
    for name, df in tables.items():
        df = df.withColumn(tag, F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def overlap(selections: DataFrame, name: str, key: str) -> DataFrame:
    """How many keys each pair of selections shares."""
    a = selections.select(F.col(name).alias("a"), key)
    b = selections.select(F.col(name).alias("b"), key)
    return a.join(b, key).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def merge_keep_last(old: DataFrame, new: DataFrame, keys) -> DataFrame:
    """Old and new rows, the new one where both have a key."""
    return unmatched(old, new, list(keys)).unionByName(new)


def add_new(old: DataFrame, more: DataFrame, key: str, ordinal: str) -> DataFrame:
    """The rows of ``more`` to append: unknown keys, each once."""
    return first_per_key(unmatched(more, old, key), [key], ordinal)


def observed(df: DataFrame, name: str, **aggregates):
    """``df`` with counts gathered while it is computed, without a job of their own; returns (df, observation)."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[v.alias(k) for k, v in aggregates.items()]), seen
