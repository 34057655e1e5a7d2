"""Exact order statistics and ranks of groups of any size.

Spark's exact percentile holds every distinct value of a group in one task. That is used while the largest group, which is counted first,
is small. Beyond that the distinct values are counted, sorted over all tasks by key and value, and written once in small parts; sums of the parts tell which of them
hold the wanted ranks, and only those are looked at again. That is one scan of the rows and a fixed number of jobs, whatever the values are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewise import scratch

#: Rows of a group that one task may hold, the share of them in a sorted part, and the accuracy of approximate quantiles.
MOST, PARTS, ACCURACY = 1_000_000, 64, 4096
#: Rows from which a value may count as frequent.
OFTEN = 10_000


def largest_group(rows: DataFrame, keys, value: str) -> int:
    """Values of the largest group."""
    return rows.groupBy(*keys).agg(F.count(value).alias("_n")).agg(F.max("_n")).first()[0] or 0


def exact_percentiles(rows: DataFrame, keys, value: str, shares: dict[str, float], most: int = MOST, largest: int | None = None) -> DataFrame:
    """``keys`` and one column for each share: the interpolated percentile of the values that are not null; null for a group without any.

    ``largest``: values of the largest group, if known.
    """
    keys = list(keys)
    if (largest_group(rows, keys, value) if largest is None else largest) <= most:
        return rows.groupBy(*keys).agg(*[F.percentile(value, F.lit(p)).alias(name) for name, p in shares.items()])
    rows = rows.select(*keys, F.col(value).cast("double").alias("_v"), F.lit(1).alias("_c"))
    return _select(_sorted(rows, keys, most), keys, shares).drop("_n")


def median_and_mad(rows: DataFrame, keys, value: str, largest: int | None = None, most: int = MOST) -> DataFrame:
    """``keys, _mid, _mad, _n``: the median, the median distance from it, and the number of values that are not null.

    While the largest group is small its values are gathered and sorted once, which takes one shuffle; beyond that the distances are taken from the counted values.
    """
    keys = list(keys)
    largest = largest_group(rows, keys, value) if largest is None else largest
    if largest > most:
        counts = _sorted(rows.select(*keys, F.col(value).cast("double").alias("_v"), F.lit(1).alias("_c")), keys, most)
        mid = scratch.written(_select(counts, keys, {"_mid": 0.5}), "medians")  # a row a group
        near = _same(counts, mid, keys).select(*keys, F.abs(F.col("_v") - F.col("_mid")).alias("_v"), "_c")
        far = _select(_sorted(near, keys, most), keys, {"_mad": 0.5}).drop("_n")
        return _same(mid, far, keys).select(*keys, "_mid", "_mad", "_n")
    middle = lambda a: (F.get(a, F.floor((F.size(a) - 1) / 2).cast("int")) + F.get(a, F.ceil((F.size(a) - 1) / 2).cast("int"))) / 2
    held = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.col(value).cast("double"))).alias("_a"))
    held = held.withColumn("_mid", F.when(F.size("_a") > 0, middle(F.col("_a"))))
    held = held.withColumn("_b", F.sort_array(F.transform("_a", lambda x: F.abs(x - F.col("_mid")))))
    return held.select(*keys, "_mid", F.when(F.size("_b") > 0, middle(F.col("_b"))).alias("_mad"), F.size("_a").cast("long").alias("_n"))


def median_and_count(rows: DataFrame, keys, value: str, out: str, count: str, largest: int | None = None, most: int = MOST) -> DataFrame:
    """``keys``, the median of the values that are not null as ``out``, and the number of rows as ``count``."""
    keys = list(keys)
    largest = largest_group(rows, keys, value) if largest is None else largest
    if largest <= most:
        return _sorted_median(rows, keys, value, out, {count: F.lit(1)})
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(count))
    return _same(exact_percentiles(rows, keys, value, {out: 0.5}, most, largest), sizes, keys)


def median_and_ends(rows: DataFrame, keys, value: str, largest: int, most: int = MOST) -> DataFrame:
    """``keys, _mid, _high, _low``: median, maximum and minimum of the values that are not null; ``largest``: rows of the largest group."""
    if largest > most:
        return exact_percentiles(rows, keys, value, {"_mid": 0.5, "_high": 1.0, "_low": 0.0}, most, largest)
    return rows.groupBy(*keys).agg(F.median(value).alias("_mid"), F.max(value).alias("_high"), F.min(value).alias("_low"))


def packed_ends(packed: DataFrame, keys, features: str = "features") -> DataFrame:
    """``keys, f, _mid, _high, _low`` of each feature of packed rows: a group's rows are gathered whole and each feature is sorted as one list, so there is no row a value. For small groups."""
    held = packed.groupBy(*keys).agg(F.collect_list(features).alias("_m"), F.max(F.size(features)).alias("_k")).filter("_k > 0")
    lists = F.transform(F.sequence(F.lit(0), F.col("_k") - 1), lambda f: F.transform("_m", lambda x: F.get(x, f)))
    lists = held.select(*keys, F.posexplode(lists).alias("f", "_a")).withColumn("_a", F.sort_array(F.array_compact("_a")))
    last = F.size("_a") - 1
    low, high = F.get("_a", F.shiftright(last, 1)), F.get("_a", F.shiftright(last + 1, 1))
    mid = F.when(low == high, low).otherwise(0.5 * low + 0.5 * high)
    return lists.select(*keys, "f", mid.alias("_mid"), F.get("_a", last).alias("_high"), F.get("_a", F.lit(0)).alias("_low"))


def _sorted_median(rows: DataFrame, keys, value: str, out: str, counts: dict[str, Column]) -> DataFrame:
    """``keys``, the median as ``out`` and counts of columns, by sorting each group in its task: one shuffle, none if ``rows`` lie together by some of the keys."""
    group = Window.partitionBy(*keys)
    placed = rows.select(*keys, F.col(value).cast("double").alias("_v"), *[c.alias(f"_c_{n}") for n, c in counts.items()])
    placed = placed.withColumn("_r", F.row_number().over(group.orderBy(F.col("_v").asc_nulls_last())) - 1)
    placed = placed.withColumns({"_n": F.count("_v").over(group)} | {n: F.count(f"_c_{n}").over(group) for n in counts})
    last = F.greatest(F.col("_n") - 1, F.lit(0))
    middle = placed.filter(F.col("_r").isin(F.shiftright(last, 1), F.shiftright(last + 1, 1)))
    low, high = F.min("_v"), F.max("_v")
    return middle.groupBy(*keys).agg(F.when(low == high, low).otherwise(0.5 * low + 0.5 * high).alias(out), *[F.first(n).alias(n) for n in counts])


def _same(a: DataFrame, b: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Join on keys that may be null; without keys ``b`` is one row."""
    if not keys:
        return a.crossJoin(F.broadcast(b))
    b = b.withColumnsRenamed({k: f"_b_{k}" for k in keys})
    on = [a[k].eqNullSafe(b[f"_b_{k}"]) for k in keys]
    return a.join(b, on, how).drop(*[f"_b_{k}" for k in keys])


def _sorted(rows: DataFrame, keys, most: int) -> DataFrame:
    """``keys, _v, _c, _part``: distinct values of the groups with the sum of ``_c``, written in order of keys and value, in numbered parts of at most ``most / PARTS`` of them."""
    counts = rows.groupBy(*keys, "_v").agg(F.sum("_c").alias("_c"))
    placed = counts.repartitionByRange(*keys, "_v").sortWithinPartitions(*keys, "_v").withColumn("_at", F.monotonically_increasing_id())
    run, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    part = F.shiftleft(run, 33) + F.floor(inside / max(1, most // PARTS))
    return scratch.written(placed.withColumn("_part", part).drop("_at"), "counts")


def _select(counts: DataFrame, keys, shares: dict[str, float]) -> DataFrame:
    """``keys, _n`` and one column for each share, from ``_sorted`` counts: the rows of a null value count in no rank."""
    held = F.when(F.col("_v").isNotNull(), F.col("_c")).otherwise(0)
    group = Window.partitionBy(*keys)
    parts = counts.groupBy(*keys, "_part").agg(F.sum(held).alias("_in"))
    parts = parts.withColumn("_below", F.sum("_in").over(group.orderBy("_part")) - F.col("_in")).withColumn("_n", F.sum("_in").over(group))
    at = {name: F.lit(p) * (F.col("_n") - 1) for name, p in shares.items()}
    ends = [f(x) for x in at.values() for f in (F.floor, F.ceil)]
    wanted = F.col("_n") == 0
    for k in ends:
        wanted = wanted | ((F.col("_below") <= k) & (k < F.col("_below") + F.col("_in")))
    wanted = scratch.written(parts.filter(wanted), "ranks")  # two or so a group and share
    near = _same(counts, wanted.drop("_in"), [*keys, "_part"])
    near = near.withColumn("_upto", F.col("_below") + F.sum(held).over(Window.partitionBy(*keys, "_part").orderBy("_v")))
    first = lambda k: F.min(F.when(F.col("_upto") > k, F.col("_v")))
    found = near.groupBy(*keys, "_n").agg(*[first(f(x)).alias(f"_{end}_{name}") for name, x in at.items() for f, end in ((F.floor, "a"), (F.ceil, "b"))])
    values = []
    for name, x in at.items():
        a, b, part = F.col(f"_a_{name}"), F.col(f"_b_{name}"), x - F.floor(x)
        values.append(F.when(a == b, a).otherwise((1 - part) * a + part * b).alias(name))
    return found.select(*keys, "_n", *values)


def average_rank(df: DataFrame, by, value: str, out: str, cuts: int = 0) -> DataFrame:
    """Ranks from 1, ties sharing their mean rank. Ranks are taken over distinct values and their counts,
    and joined back by value, so the values must not change when they are computed again.

    ``cuts`` divides each group's values at approximate quantiles, so that a group is ranked by as many tasks; for few large groups. There the values that ``OFTEN`` rows and
    more than 1 / (16 ``cuts``) of their group hold, which are few, are sent to all tasks, so that the rows of one value don't meet in one task.
    """
    by = list(by)
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    if cuts:
        marks = df.groupBy(*by).agg(F.percentile_approx(value, [k / cuts for k in range(1, cuts)], ACCURACY).alias("_q"))
        counts = counts.join(marks, by) if by else counts.crossJoin(F.broadcast(marks))  # without keys it is one row
        counts = counts.withColumn("_block", F.size(F.filter("_q", lambda q: q <= F.col(value)))).drop("_q")
        blocks = counts.groupBy(*by, "_block").agg(F.sum("_n").alias("_m"))
        blocks = blocks.withColumn("_before", F.sum("_m").over(Window.partitionBy(*by).orderBy("_block")) - F.col("_m")).drop("_m")
        counts = counts.join(blocks, [*by, "_block"])
    else:
        counts = counts.withColumn("_block", F.lit(0)).withColumn("_before", F.lit(0))
    order = Window.partitionBy(*by, "_block").orderBy(value)
    ranks = counts.withColumn("_rank", F.col("_before") + F.sum("_n").over(order) - (F.col("_n") - 1) / 2.0).drop("_block", "_before")
    on = [*by, value]
    if cuts:
        ranks = scratch.written(ranks, "ranks")
        sizes = ranks.groupBy(*by).agg(F.sum("_n").alias("_all"))
        ranks = ranks.join(F.broadcast(sizes), by) if by else ranks.crossJoin(F.broadcast(sizes))  # a row a group
        often = (F.col("_n") > OFTEN) & (F.col("_n") * 16 * cuts > F.col("_all"))
        hot, ranks = (ranks.filter(t).drop("_n", "_all") for t in (often, ~often))
        rows = df.join(F.broadcast(hot), on).unionByName(df.join(F.broadcast(hot), on, "left_anti").join(ranks, on))
    else:
        rows = df.join(ranks.drop("_n"), on)
    return rows.withColumn(out, F.col("_rank")).drop("_rank")


def rank(df: DataFrame, score: str, key: str, out: str = "rank") -> DataFrame:
    """Descending rank from 1 over all rows, nulls last, ties by key: a distributed sort whose parts are numbered, written, and shifted by
    the rows of the parts before them."""
    placed = df.orderBy(F.col(score).desc_nulls_last(), key).withColumn("_at", F.monotonically_increasing_id())
    placed = scratch.written(placed, "sorted").withColumn("_run", F.shiftright("_at", 33))
    runs = placed.groupBy("_run").agg(F.count(F.lit(1)).alias("_c"))  # one row a part
    runs = runs.select("_run", (F.sum("_c").over(Window.orderBy("_run")) - F.col("_c")).alias("_above"))
    return placed.join(runs, "_run").withColumn(out, F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1 + F.col("_above")).drop("_at", "_run", "_above")
