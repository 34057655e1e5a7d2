"""Single linkage, silhouettes and k-means|| against plain versions."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from platewise.operators import clustering as C
from platewise.operators import linkage as K
from platewise.operators import selection as L


def frame(spark, x, extra=()):
    rows = [(i, [float(v) for v in r], *(e[i] for e in extra)) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, x array<double>" + ", c string" * len(extra)).repartition(3)


def plain_tree(x):
    """Prim."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    inside, near, edges = [0], {i: (d[0, i], 0) for i in range(1, len(x))}, []
    while near:
        i = min(near, key=near.get)
        w, j = near.pop(i)
        edges.append((min(i, j), max(i, j), w))
        inside.append(i)
        for k in near:
            near[k] = min(near[k], (d[i, k], i))
    return edges


def plain_clusters(n, edges):
    root = list(range(n))
    for a, b, _ in edges:
        ra, rb = root[a], root[b]
        root = [min(ra, rb) if r in (ra, rb) else r for r in root]
    return root


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(1)
    return np.concatenate([rng.normal(c, 1.0, size=(40, 3)) for c in (0, 6, 30)] + [[[100.0, 0, 0]]])


def test_tree_and_its_three_cuts(spark, points):
    df, want = frame(spark, points), plain_tree(points)
    tree = K.linkage_tree(df, "id", "x", 0.8)
    got = {(min(r.a, r.b), max(r.a, r.b)): r.d for r in tree.collect()}
    assert got == {(a, b): pytest.approx(d) for a, b, d in want}
    ordered = sorted(want, key=lambda e: e[2])
    cuts = {
        "distance": (dict(distance=2.0), [e for e in want if e[2] <= 2.0]),
        "k": (dict(k=5), ordered[:-4]),
        "one": (dict(k=1), ordered),
        "share": ({}, [e for e in want if e[2] <= 0.7 * ordered[-1][2]]),
    }
    for asked, kept in cuts.values():
        found = {r.id: r.cluster for r in K.cut_tree(df, "id", tree, **asked).collect()}
        assert [found[i] for i in range(len(points))] == plain_clusters(len(points), kept)
    found = {r.id: r.cluster for r in C.single_linkage(df, "id", "x", 2.0).collect()}
    assert [found[i] for i in range(len(points))] == plain_clusters(len(points), cuts["distance"][1])


def test_tree_of_equal_rows_and_of_nothing(spark):
    df = frame(spark, np.zeros((300, 2)))
    assert K.linkage_tree(df, "id", "x", 1.0).count() == 299
    assert {r.cluster for r in K.cut_tree(df, "id", K.linkage_tree(df, "id", "x", 1.0), distance=0.0).collect()} == {0}
    none = df.filter("false")
    assert K.linkage_tree(none, "id", "x", 1.0).count() == 0 and C.single_linkage(none, "id", "x", 1.0).count() == 0
    one = df.filter("id = 3")
    assert [tuple(r) for r in K.cut_tree(one, "id", K.linkage_tree(one, "id", "x", 1.0)).collect()] == [(3, 3)]


def test_edges_of_one_crowded_place_are_dealt_to_many_tasks(spark, monkeypatch):
    """Rows of one cell, which a join by cell compares in one task; a task hands on a forest of its edges."""
    monkeypatch.setattr(K, "BLOCK", 16)
    x = np.random.default_rng(4).uniform(0.0, 0.9, size=(300, 4))
    rows = frame(spark, x).select(F.col("id").alias("node"), "x", F.col("id").alias("root"))
    edges = K._edges(rows, 2.0, [0, 1], "bigint").withColumn("task", F.spark_partition_id()).collect()
    sizes = Counter(e.task for e in edges)
    assert len(sizes) > 8 and max(sizes.values()) < 300
    assert K.linkage_tree(frame(spark, x), "id", "x", 2.0).agg(F.sum("d")).first()[0] == pytest.approx(sum(d for _, _, d in plain_tree(x)))


def test_components_of_a_long_path(spark):
    edges = spark.range(500).selectExpr("id as a", "id + 1 as b").unionAll(spark.createDataFrame([(1000, 900), (900, 1000), (7, 7)], "a long, b long"))
    roots = {r.node: r.root for r in K.components(edges).collect()}
    assert roots == {**{i: 0 for i in range(501)}, 900: 900, 1000: 900}


def test_silhouettes(spark, points):
    names = ["a"] * 40 + ["b"] * 40 + ["c"] * 40 + ["alone"]
    df = frame(spark, points, [names])
    got = {r.id: r.silhouette for r in C.silhouettes(df, "id", "x", "c").collect()}
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    for i in range(len(points)):
        means = {c: np.mean([d[i, j] for j in range(len(points)) if names[j] == c and j != i]) for c in set(names) if c != "alone" or i < 120}
        a, b = means.get(names[i]), min(v for c, v in means.items() if c != names[i])
        assert got[i] == pytest.approx(0.0 if names[i] == "alone" else (b - a) / max(a, b))
    assert {r.silhouette for r in C.silhouettes(df.filter("c = 'a'"), "id", "x", "c").collect()} == {None}


def test_silhouettes_of_odd_rows_are_those_of_sql(spark, tmp_path):
    """Rows without a label or a vector, copies, rows of no distance at all, and near rows far from the origin."""
    import duckdb

    from platewise import catalog

    rng = np.random.default_rng(5)
    near = 1e5 + rng.normal(size=(40, 64)) * 1e-3
    plain = [(i, v.tolist(), i % 3) for i, v in enumerate(rng.normal(size=(60, 64)))]
    tables = {
        "unlabelled": [*plain, (60, plain[0][1], None), (61, plain[1][1], 3)],
        "no_vector": [*plain, (60, None, 0), (61, None, 3), (62, None, 4), (63, None, 4), (64, plain[0][1], 5), (65, None, 5)],
        "copies": [(i, plain[i % 7][1], i % 4) for i in range(60)],
        "same": [(i, [1.0] * 64, i % 2) for i in range(6)],
        "near": [(i, v.tolist(), i % 2) for i, v in enumerate(near)],
        "one_label": [(i, v, 7) for i, v, _ in plain],
        "one_row": plain[:1],
        "none": [],
    }
    for name, rows in tables.items():
        spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        con = duckdb.connect()
        con.sql(f"create view embeddings as select * from '{tmp_path}/{name}/embeddings.parquet/*.parquet'")
        want = sorted(con.execute(catalog.oracle_sql()["i06_silhouettes"]).fetchall())
        got = sorted(tuple(r) for r in catalog.queries()["i06_silhouettes"](spark, f"{tmp_path}/{name}").select("vec_id", "label", "silhouette").collect())
        assert len(got) == len(rows), name
        assert [tuple(map(repr, r)) for r in got] == [tuple(map(repr, r)) for r in want], name


def test_silhouettes_compare_two_blocks_once(spark):
    """Of 15,000 rows in 10 clusters and 667 of one or two rows; a block may hold many clusters, and a cluster many blocks."""
    rng = np.random.default_rng(6)
    x, c = rng.normal(size=(15_000, 4)), np.concatenate([rng.integers(0, 10, 14_000), 10 + np.arange(1_000) * 2 // 3])
    x[14_990] = 1e9  # an outlier takes no digits of others
    df = spark.createDataFrame([(i, v.tolist(), f"c{k}") for i, (v, k) in enumerate(zip(x, c))], "id long, x array<double>, c string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = C.silhouettes(df, "id", "x", "c")
        got = {r.id: r.silhouette for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")

    def met(node):
        if node.nodeName() == "CartesianProduct":
            return node.metrics().apply("numOutputRows").value()
        return sum(met(node.children().apply(i)) for i in range(node.children().size()))

    pairs = met(out._jdf.queryExecution().executedPlan())
    blocks = round(((8 * pairs + 1) ** 0.5 - 1) / 2)
    assert pairs == blocks * (blocks + 1) // 2 and 8 <= blocks <= 16
    assert len(got) == len(x)
    n = np.bincount(c)
    for i in [*range(0, 15_000, 750), *range(14_000, 15_000, 50), 14_990]:
        total = np.bincount(c, np.sqrt(np.square(x - x[i]).sum(axis=1)))
        a, b = total[c[i]] / max(1, n[c[i]] - 1), np.delete(total / n, c[i]).min()
        assert got[i] == pytest.approx((b - a) / max(a, b) if n[c[i]] > 1 else 0.0, abs=1e-9)


def test_kmeans_parallel_is_nearly_as_good_as_the_loop(spark, points):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(rng.uniform(-20, 20, size=3), 1.0, size=(60, 3)) for _ in range(8)])
    df = frame(spark, x)

    def cost(picks):
        chosen = x[[r.id for r in picks.collect()]]
        return (((x[:, None] - chosen[None]) ** 2).sum(axis=2)).min(axis=1).sum()

    loop = np.mean([cost(L.kmeans_pp(df, "id", "x", 8, s)) for s in (1, 2, 3)])
    fast = np.mean([cost(L.kmeans_parallel(df, "id", "x", 8, s)) for s in (1, 2, 3)])
    assert fast <= 1.5 * loop
    assert [r.id for r in L.kmeans_parallel(df, "id", "x", 8, 1).collect()] == [r.id for r in L.kmeans_parallel(df.repartition(7), "id", "x", 8, 1).collect()]
    assert L.kmeans_parallel(df.filter("false"), "id", "x", 8, 1).count() == 0
    assert L.kmeans_parallel(df.filter("id < 3"), "id", "x", 8, 1).count() <= 3
