"""Splits and weighted sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewise.functions.vectors import hash_uniform
from platewise.operators.selection import rank

SPLITS = ("train", "val", "test")


def _order(key: str, seed: int) -> Column:
    """The first 13 hex digits of a seeded SHA-256, as an exact double."""
    text = F.sha2(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")), 256)
    return F.conv(F.substring(text, 1, 13), 16, 10).cast("double")


def random_split(df: DataFrame, key: str, seed: int = 42, train: float = 0.8, val: float = 0.1, stratum: str | None = None) -> DataFrame:
    """Exact shares by rank of a seeded hash, over all rows or within a stratum (Q7)."""
    rows = df.withColumn("_h", _order(key, seed))
    if stratum:
        w = Window.partitionBy(stratum)
        rows = rows.withColumn("_r", F.row_number().over(w.orderBy(F.col("_h").desc(), key))).withColumn("_n", F.count(F.lit(1)).over(w))
    else:
        rows = rank(rows, "_h", key, "_r").crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("_n"))))
    a, b = F.floor(F.col("_n") * train), F.floor(F.col("_n") * train) + F.floor(F.col("_n") * val)
    return rows.withColumn("split", F.when(F.col("_r") <= a, "train").when(F.col("_r") <= b, "val").otherwise("test")).drop("_h", "_r", "_n")


def group_split(df: DataFrame, group: str, seed: int = 42, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """No group in two splits."""
    return df.join(random_split(df.select(group).distinct(), group, seed, train, val), group)


def plate_split(df: DataFrame, plate: str, train, val=(), test=()) -> DataFrame:
    """By lists of plates, the earlier list where a plate is in two; other plates go."""
    c = F.col(plate)
    split = F.when(c.isin(*train), "train").when(c.isin(*val) if val else F.lit(False), "val").when(c.isin(*test) if test else F.lit(False), "test")
    return df.withColumn("split", split).filter("split is not null")


def balance_weights(df: DataFrame, group: str) -> DataFrame:
    """Weight n / (groups x rows of the group); a null group is ``unknown``."""
    rows = df.withColumn(group, F.coalesce(F.col(group).cast("string"), F.lit("unknown")))
    per = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_g"))
    whole = per.agg(F.sum("_g").alias("_n"), F.count(F.lit(1)).alias("_k"))
    return rows.join(per, group).crossJoin(F.broadcast(whole)).withColumn("weight", F.col("_n") / (F.col("_k") * F.col("_g"))).drop("_g", "_n", "_k")


def balanced_draws(df: DataFrame, key: str, group: str, seed: int = 42) -> DataFrame:
    """As many draws as rows, with replacement, each row as likely as its weight.

    Row weights are equal within a group and each group has the same total, so a draw picks a group, then a place in it:
    draws and rows meet in an equality join on (group, place) instead of a range join.
    """
    rows = df.withColumn(group, F.coalesce(F.col(group).cast("string"), F.lit("unknown")))
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_size"))
    sizes = sizes.withColumn("_g", F.row_number().over(Window.orderBy(group)) - 1)  # one row a group
    whole = sizes.agg(F.count(F.lit(1)).alias("_k"))
    salted = rows.withColumn("_s", F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")), 256), 1, 2))
    blocks = salted.groupBy(group, "_s").agg(F.count(F.lit(1)).alias("_c"))
    blocks = blocks.withColumn("_b", F.sum("_c").over(Window.partitionBy(group).orderBy("_s")) - F.col("_c")).drop("_c")
    placed = salted.withColumn("_i", F.row_number().over(Window.partitionBy(group, "_s").orderBy(key))).join(blocks, [group, "_s"])
    placed = placed.withColumn("place", F.col("_b") + F.col("_i") - 1).drop("_s", "_b", "_i")
    draws = df.select(F.col(key).alias("draw")).crossJoin(F.broadcast(whole))  # one row
    draws = draws.withColumn("_g", F.floor(hash_uniform(F.col("draw"), F.lit(seed)) * F.col("_k"))).join(sizes, "_g")
    draws = draws.select("draw", group, F.floor(hash_uniform(F.col("draw"), F.lit(seed + 1)) * F.col("_size")).alias("place"))
    return draws.join(placed, [group, "place"]).drop("place")
