"""Scoring by user models, and importances from scores."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platewise.functions.vectors import hash_uniform
from platewise.operators.joins import unmatched


def score(df: DataFrame, key: str, value: str, factory, done: DataFrame | None = None) -> DataFrame:
    """``key, prediction, error`` for rows not in ``done``.

    ``factory()`` makes a scorer once a task; it maps a list of inputs to a list of vectors. Where a batch fails,
    its rows are scored one by one and a failing row gets its message in ``error``.
    """
    rows = unmatched(df, done, key) if done is not None else df
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        model = factory()
        for pdf in batches:
            out, errors = [], []
            try:
                out = [list(map(float, x)) for x in model(list(pdf[value]))]
                errors = [None] * len(out)
            except Exception:
                out = []
                for x in pdf[value]:
                    try:
                        out.append(list(map(float, model([x])[0])))
                        errors.append(None)
                    except Exception as e:
                        out.append(None)
                        errors.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({key: pdf[key], "prediction": out, "error": errors})

    return rows.select(key, value).mapInPandas(run, f"{key} {kind}, prediction array<double>, error string")


def where(df: DataFrame, predicate, column: str | None = None) -> DataFrame:
    """Rows that a Column, or a Python predicate on one column's values, accepts."""
    if not callable(predicate):
        return df.filter(predicate)

    @F.pandas_udf("boolean")
    def test(s: pd.Series) -> pd.Series:
        return s.map(predicate).astype(bool)

    return df.filter(test(column))


def transformed(df: DataFrame, *steps) -> DataFrame:
    """K2: a table through a user's functions of DataFrames, in order; each may change values but not the number of rows."""
    for step in steps:
        df = df.transform(step)
    return df


def ablation(df: DataFrame, key: str, vector: str, groups: dict[str, list[int]], factory, fill: str = "zero") -> DataFrame:
    """Per group of features the mean absolute change of the prediction when the group is set to zero or to its mean."""
    width = df.select(F.size(vector)).first()[0]
    if fill == "mean":
        means = [r.m for r in df.select(F.posexplode(vector).alias("f", "v")).groupBy("f").agg(F.avg("v").alias("m")).orderBy("f").collect()]
    else:
        means = [0.0] * width
    names = ["", *groups]
    masks = [[i in set(groups[g]) for i in range(width)] if g else [False] * width for g in names]
    variants = df.select(key, vector).crossJoin(F.broadcast(df.sparkSession.createDataFrame(list(zip(names, masks)), "grp string, mask array<boolean>")))
    fills = F.array(*[F.lit(float(m)) for m in means])
    changed = F.zip_with(F.zip_with(vector, "mask", lambda x, m: F.when(~m, x)), fills, lambda x, m: F.coalesce(x, m))
    rows = variants.select(F.struct(key, "grp").alias("id"), changed.alias("x"))
    got = score(rows, "id", "x", factory).select(F.col(f"id.{key}").alias(key), F.col("id.grp").alias("grp"), "prediction")
    base = got.filter("grp = ''").select(key, F.col("prediction").alias("base"))
    d = F.zip_with("prediction", "base", lambda a, b: F.abs(a - b))
    change = F.aggregate(d, F.lit(0.0), lambda s, x: s + x) / F.size(d)
    return got.filter("grp <> ''").join(base, key).groupBy("grp").agg(F.avg(change).alias("importance"))


def importance(long: DataFrame, how: str = "mean") -> DataFrame:
    """Per feature the mean, maximum or L2 norm of absolute attributions."""
    v = F.abs("v")
    agg = {"mean": F.avg(v), "max": F.max(v), "l2": F.sqrt(F.sum(v * v))}[how]
    return long.groupBy("f").agg(agg.alias("importance"))


def shapley(df: DataFrame, key: str, vector: str, baseline: list[float], factory, permutations: int = 8, seed: int = 0) -> DataFrame:
    """Sampled Shapley values: features enter in seeded random orders, and each change of the score is a contribution.

    The first feature of an order is measured against the baseline's own score (Q14). Scores are dealt once by key and compared with the one before in their order,
    without a join, as the size of what the steps are exploded to can't be estimated and a side of it might be broadcast.
    """
    width = len(baseline)
    base = F.array(*[F.lit(float(b)) for b in baseline])
    spark = df.sparkSession
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))  # few bytes here make many steps
    perms = df.select(key, vector).repartition(tasks, key).withColumn("_row", F.monotonically_increasing_id()).withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))))
    keyed = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.struct(hash_uniform(F.lit(seed), F.col("perm"), F.col(key), i).alias("u"), i.alias("i")))
    order = perms.withColumn("order", F.transform(F.array_sort(keyed), lambda s: s["i"]))
    steps = order.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(width))))
    mixed = F.zip_with(F.zip_with(vector, F.sequence(F.lit(0), F.lit(width - 1)), lambda x, i: F.when(F.array_position("order", i) <= F.col("step"), x)), base, lambda x, b: F.coalesce(x, b))
    rows = steps.select(F.struct(key, "_row", "perm", "step", F.when(F.col("step") > 0, F.element_at("order", F.greatest("step", F.lit(1)))).alias("f")).alias("id"), mixed.alias("x"))
    got = score(rows, "id", "x", factory).select("id.*", F.col("prediction")[0].alias("p")).repartition(key)
    before = F.lag("p").over(Window.partitionBy(key, "_row", "perm").orderBy("step"))
    return got.withColumn("before", before).filter("step > 0").groupBy(key, "f").agg(F.avg(F.col("p") - F.col("before")).alias("shapley"))
