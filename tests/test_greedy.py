"""Lazy greedy selection against plain loops, with lists that are far too short, so that many scans follow each other."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from platewise.operators import greedy
from platewise.operators import selection as L


def _dist(x, p):
    return np.sqrt(((x - p) ** 2).sum(axis=1))


def plain_farthest(x, first, n):
    picks, d = [first], np.full(len(x), np.inf)
    while len(picks) < n:
        d = np.minimum(d, _dist(x, x[picks[-1]]))
        d[picks] = -np.inf
        picks.append(int(d.argmax()))
    return picks


def plain_shrinking(x, s, n):
    s, picks = s.copy(), []
    while len(picks) < n:
        k = int(s.argmax())
        picks.append(k)
        s = s * (1 - 0.5 * np.exp(-_dist(x, x[k])))
        s[picks] = -np.inf
    return picks


def plain_hybrid(x, u, n, w=0.7):
    u = (u - u.min()) / (u.max() - u.min() + 1e-8)
    picks, d = [int(u.argmax())], np.full(len(x), np.inf)
    while len(picks) < n:
        d = np.minimum(d, _dist(x, x[picks[-1]]))
        left = np.setdiff1d(np.arange(len(x)), picks)
        v = w * u[left] + (1 - w) * (d[left] - d[left].min()) / (d[left].max() - d[left].min() + 1e-8)
        picks.append(int(left[v.argmax()]))
    return picks


def plain_dpp(x, n, gamma):
    kernel = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    picks = [0]
    while len(picks) < n:
        gains = [-np.inf if k in picks else np.linalg.slogdet(kernel[np.ix_([*picks, k], [*picks, k])])[1] for k in range(len(x))]
        picks.append(int(np.argmax(gains)))
    return picks


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4)) + rng.integers(0, 3, size=(300, 1)) * 3
    x[250:260] = x[10]  # repeated vectors: ties
    u = rng.normal(size=300)
    rows = [(i, [float(v) for v in x[i]], float(u[i])) for i in range(300)]
    return x, u, spark.createDataFrame(rows, "id long, x array<double>, u double").repartition(3)


def _start(x, k):
    return (k, x[k].tolist())


@pytest.mark.parametrize("kept", [5, 40, 4096])
def test_lists_of_any_length_choose_as_the_loop_does(points, kept):
    x, u, df = points
    rows = greedy.candidates(df, "id", "x", "u")
    assert greedy.lazy_greedy(rows, greedy.Farthest(), 25, _start(x, 7), kept) == plain_farthest(x, 7, 25)
    assert greedy.lazy_greedy(rows, greedy.Shrinking(), 25, _start(x, int(u.argmax())), kept) == plain_shrinking(x, u, 25)
    assert greedy.lazy_greedy(rows, greedy.Determinant(0.05), 15, _start(x, 0), kept) == plain_dpp(x, 15, 0.05)


@pytest.mark.parametrize("kept", [8, 64, 1024])
def test_hybrid_chooses_as_the_loop_does(points, kept):
    x, u, df = points
    scaled = (u - u.min()) / (u.max() - u.min() + 1e-8)
    rows = greedy.candidates(L.min_max(df, "u", "s"), "id", "x", "s")
    assert greedy.lazy_hybrid(rows, 25, _start(x, int(scaled.argmax())), 0.7, kept) == plain_hybrid(x, u, 25)


def test_scores_below_zero_rise(points, spark):
    x, u, df = points
    low = df.withColumn("u", -F.abs("u") - 0.1)
    rows = greedy.candidates(low, "id", "x", "u")
    s = -np.abs(u) - 0.1
    assert greedy.lazy_greedy(rows, greedy.Shrinking(), 20, _start(x, int(s.argmax())), 6) == plain_shrinking(x, s, 20)


def test_more_picks_than_rows_string_keys_and_nothing(spark):
    rows = spark.createDataFrame([("b", [0.0]), ("a", [0.0]), ("c", [5.0]), (None, [9.0]), ("d", None)], "id string, x array<double>")
    got = [r.id for r in L.max_min(rows, "id", "x", 10, 1).orderBy("rank").collect()]
    assert sorted(got) == ["a", "b", "c"]
    assert L.farthest_points(rows.filter("false"), "id", "x", 3).count() == 0
    assert [r.id for r in L.farthest_points(rows, "id", "x", 2).orderBy("rank").collect()] == ["a", "c"]


def test_five_hundred_picks_take_few_scans(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").selectExpr("vec_id", "cast(embedding as array<double>) as x")
    rows = greedy.candidates(df, "vec_id", "x")
    scans, plain = [], greedy._scan
    greedy._scan = lambda *a: scans.append(1) or plain(*a)
    try:
        first = rows.orderBy("key").select("key", "x").first()
        got = greedy.lazy_greedy(rows, greedy.Farthest(), 500, first)
    finally:
        greedy._scan = plain
    table = rows.orderBy("key").toArrow()
    x = greedy._matrix(table["x"])
    assert [table["key"].to_pylist().index(k) for k in got] == plain_farthest(x, 0, 500)
    assert len(scans) <= 18  # with the table and the start: at most 20 jobs
