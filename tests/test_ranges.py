"""As-of joins and rolling percentiles by ranges against plain loops, with keys that lie in many parts and parts that are smaller than a frame."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from platewise.operators import ranges


def plain_as_of(left, right):
    out = []
    for i, k, t in left:
        seen = [(x, v) for kk, x, v in right if kk == k and k is not None and x <= t and v is not None]
        out.append((i, max(seen)[1] if seen else None))
    return sorted(out)


@pytest.mark.parametrize(("parts", "batch"), [(1, 10_000), (7, 10_000), (40, 10_000), (7, 5), (40, 3)])
def test_as_of(spark, parts, batch):
    r = random.Random(parts)
    keys = ["hot"] * 8 + ["a", "b", "none", None]
    left = [(i, r.choice(keys), r.randrange(500)) for i in range(300)]
    right = [(r.choice(keys[:10] + [None]), r.choice([r.randrange(500), r.randrange(20)]), r.choice([None, float(i)])) for i in range(200)]
    a = spark.createDataFrame(left, "id long, k string, t int")
    b = spark.createDataFrame(right, "k string, t int, v double")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = ranges.as_of(a, b, "k", "t", "v", "found", parts).select("id", "found").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert sorted((x.id, x.found) for x in got) == plain_as_of(left, right)


def test_a_key_without_values_over_many_parts_gets_the_value_before_them(spark):
    a = spark.range(2000).select("id", F.lit(1).alias("k"), F.col("id").alias("t"))
    b = spark.createDataFrame([(1, 3, "x"), (2, 0, "y")], "k int, t long, v string")
    got = ranges.as_of(a, b, "k", "t", "v", "v2", 30)
    assert got.columns == ["k", "t", "id", "v2"]
    assert {(r.v2 if r.t >= 3 else None) == r.v2 for r in got.collect()} == {True} and got.filter("v2 = 'x'").count() == 1997


def test_as_of_of_nothing(spark):
    a, b = spark.createDataFrame([], "k int, t int, id int"), spark.createDataFrame([], "k int, t int, v int")
    assert ranges.as_of(a, b, "k", "t", "v", "o").count() == 0
    one = spark.createDataFrame([(1, 1, 7)], "k int, t int, id int")
    assert [tuple(r) for r in ranges.as_of(one, b, "k", "t", "v", "o").collect()] == [(1, 1, 7, None)]


def plain_rolling(rows, n, p):
    by, out = defaultdict(list), {}
    for i, k, t, v in sorted(rows, key=lambda x: (x[2], x[0])):
        by[k].append(v)
        known = [x for x in by[k][-n:] if x is not None and x == x]
        out[i] = round(float(np.quantile(known, p)), 9) if known else None
    return out


@pytest.mark.parametrize(("n", "p", "parts"), [(20, 0.5, 5), (100, 0.99, 40), (1, 0.5, 9), (1000, 0.25, 12)])
def test_rolling_percentile(spark, n, p, parts):
    r = random.Random(n)
    rows = [(i, r.choice(["hot"] * 9 + ["b", None]), r.randrange(300), r.choice([None, r.random(), float(r.randrange(3)), float("nan")])) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, k string, t int, v double").repartition(6)
    got = ranges.rolling_percentile(df, ["k"], ["t", "id"], "v", n, p, parts)
    assert got.columns == ["id", "k", "t", "v", "rolling"]
    assert {x.id: None if x.rolling is None else round(x.rolling, 9) for x in got.collect()} == plain_rolling(rows, n, p)


def test_rolling_of_nothing(spark):
    assert ranges.rolling_percentile(spark.createDataFrame([], "k int, t int, v double"), ["k"], ["t"], "v", 5, 0.5).count() == 0
