"""Null rules, ties and small hand-computed cases."""

import pytest
from pyspark.sql import functions as F

from platewise import schema
from platewise.functions import sequence as S
from platewise.functions import vectors as V
from platewise.operators import aggregates as A
from platewise.operators import clustering as C
from platewise.operators import joins as J
from platewise.operators import normalise as N
from platewise.operators import order as O
from platewise.operators import quality as Q
from platewise.operators import scoring as X
from platewise.operators import selection as L
from platewise.streaming import monitor


def values(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_column_roles():
    cols = ["Metadata_Plate", "Nuclei_Texture_B", "Cells_AreaShape_A", "Cells_Location_Center_X", "other"]
    assert schema.feature_columns(cols) == ["Cells_AreaShape_A", "Nuclei_Texture_B"]
    assert schema.cell_feature_columns(cols, categories=["Texture"]) == ["Nuclei_Texture_B"]
    assert schema.find_key(cols, "plate") == "Metadata_Plate"
    assert schema.find_count(["Metadata_Number_of_nuclei_x"]) == "Metadata_Number_of_nuclei_x"
    with pytest.raises(KeyError):
        schema.find_key(cols, "batch")


def test_null_share_and_norm_flags(spark):
    rows = [(i, [float("nan") if j < i else 1.0 for j in range(3)]) for i in (0, 2, 3)]
    df = spark.createDataFrame(rows, "i int, features array<double>")
    assert values(df.select("i", Q.null_share_ok(F.col("features"), 0.5).alias("ok")), "i", "ok") == [(0, True), (2, False), (3, False)]
    many = spark.createDataFrame([(i, [1.0 + i / 1000] * 4) for i in range(98)] + [(98, [100.0] * 4)], "i int, features array<double>")
    bad = Q.flag_wells(many).filter("not qc_passed").select("i").collect()
    assert [r.i for r in bad if r.i == 98] == [98]


def test_metadata_join_ladder(spark):
    left = spark.createDataFrame([(1, "a"), (2, None)], "plate int, well string")
    right = spark.createDataFrame([("a", "x", 2), ("a", "y", 1), (None, "z", 1)], "well string, gene string, o int")
    assert values(J.metadata_join(left, right, [["plate", "well"], ["well"]], "o"), "plate", "gene") == [(1, "y"), (2, None)]
    assert values(J.metadata_join(left, right, [["well"]], "o", null_safe=True), "plate", "gene") == [(1, "y"), (2, "z")]
    assert J.metadata_join(left, right, [["missing"]], "o") is left


def test_replicates_count_before_nulls(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), (None, 3.0)], "t string, x double")
    assert values(A.wells_to_treatments(df, "t", ["x"], least=2), "t", "x", "n_replicates") == [("a", 1.0, 2)]


def test_correlation_filters_disagree():
    pairs = [(0, 1, 0.99), (1, 2, 0.99), (0, 2, 0.1)]
    assert N.correlation_filter({0: 1.0, 1: 2.0, 2: 3.0}, pairs, 0.9, 1) == [0, 1]
    assert N.correlation_filter({0: 1.0, 1: 2.0, 2: 3.0}, pairs, 0.9, 2) == [0, 1]
    assert N.correlation_filter({0: 5.0, 1: 2.0, 2: 3.0}, pairs, 0.9, 1) == [1]
    assert N.correlation_filter({0: 5.0}, [], 0.9) == []


def test_unseen_batch_takes_overall_statistics(spark):
    long = spark.createDataFrame([("a", 0, 1.0), ("a", 0, 3.0), (None, 0, 8.0)], "b string, f int, v double")
    got = values(N.correct_batches(long, "b", "center").filter("b is null"), "v")
    assert got == [(8.0,)]


def test_average_ranks(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 5.0), (1, 7.0)], "g int, v double")
    assert values(N.average_rank(df, ["g"], "v", "r"), "r") == [(1.5,), (1.5,), (3.0,)]


def test_sequence_values(spark):
    df = spark.createDataFrame([("ACDE",), ("AAAA",), ("",), ("FWYAAA",)], "s string")
    rows = {r.s: r for r in df.select("s", S.composition(F.col("s")).alias("c"), S.entropy(F.col("s")).alias("e"), S.aromaticity(F.col("s")).alias("a")).collect()}
    assert rows["ACDE"].c[:4] == [0.25] * 4 and rows["AAAA"].c[0] == 1.0
    assert rows["AAAA"].e == 0.0 and rows["ACDE"].e == 2.0 and rows[""].e == 0.0
    assert rows["FWYAAA"].a == 0.5 and rows[""].a == 0.0
    assert len(S.feature_names()) == 436
    d = S.descriptors(df, "s", "s").filter("s = 'AAAA'").first()
    assert len(d.features) == 436 and d.features[20] == 1.0


def test_fasta_names_and_pdb(spark):
    df = spark.createDataFrame([("p", "ATOM      1  CA  ALA A   1      11.104   6.134  -6.504  1.00 90.50\nATOM      2  CB  ALA A   1      11.104   6.134  -6.504  1.00 10.00\nTER")], "k string, pdb string")
    assert values(S.plddt_from_pdb(df, "k", "pdb"), "residue", "plddt") == [(1, 90.5)]


def test_gene_selection_prefers_smaller_key_on_ties(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [-1.0, 0.0])], "k int, x array<double>")
    assert values(L.farthest_points(df, "k", "x", 3), "rank", "k") == [(1, 1), (2, 2), (3, 3)]
    assert L.dpp(df, "k", "x", 2).count() == 2
    assert L.kmeans_pp(df, "k", "x", 5, 1).count() == 3


def test_single_linkage(spark):
    df = spark.createDataFrame([(i, [float(x), 0.0]) for i, x in enumerate([0, 1, 2, 10, 11])], "k int, x array<double>")
    assert values(C.single_linkage(df, "k", "x", 1.5), "k", "cluster") == [(0, 0), (1, 0), (2, 0), (3, 3), (4, 3)]


def test_scoring_keeps_failed_rows(spark):
    def factory():
        def model(xs):
            if any(x is None for x in xs):
                raise ValueError("no input")
            return [[2 * x] for x in xs]

        return model

    df = spark.createDataFrame([(1, 1.0), (2, None)], "k int, v double").coalesce(1).na.fill(-1.0, []).select("k", "v")
    got = {r.k: (r.prediction, r.error) for r in X.score(df.withColumn("v", F.col("v").cast("string")), "k", "v", lambda: lambda xs: [[float(x)] for x in xs]).collect()}
    assert got[1] == ([1.0], None) and got[2][0] is None and "TypeError" in got[2][1]
    assert factory()([1.0]) == [[2.0]]


def test_missing_embedding_is_an_error(spark):
    df = spark.createDataFrame([({"a": [1.0]},)], "m map<string,array<double>>")
    with pytest.raises(Exception, match="missing"):
        df.select(V.fuse_concat(F.col("m"), ["a", "b"])).collect()


def test_ks_statistic():
    assert monitor.ks_statistic([0.0] * 5, [1.0] * 5) == 1.0
    assert monitor.ks_p(0.0, 5, 5) == 1.0 and monitor.ks_p(1.0, 500, 500) < 1e-6


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "t string, x double")
    assert A.wells_to_treatments(empty, "t", ["x"]).count() == 0
    assert L.rank(spark.createDataFrame([], "k int, s double"), "s", "k").count() == 0


@pytest.mark.parametrize("shape", ["even", "ties", "outliers", "one value"])
def test_percentiles_by_narrowing_equal_exact_ones(spark, shape):
    import random

    r = random.Random(40)
    draw = {"even": r.random, "ties": lambda: float(r.randrange(4)), "outliers": lambda: r.random() if r.random() < 0.99 else 1e30 * r.random(), "one value": lambda: 2.5}[shape]
    rows = [(r.choice(["a", "b", None]), draw() if r.random() < 0.95 else None) for _ in range(4000)] + [("empty", None), ("single", 7.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    shares = {"low": 0.1, "mid": 0.5, "high": 0.99}
    plain = O.exact_percentiles(df, ["g"], "v", shares)
    narrowed = O.exact_percentiles(df, ["g"], "v", shares, most=20)
    key = lambda x: str(x[0])
    assert sorted(map(tuple, narrowed.select("g", *shares).collect()), key=key) == [pytest.approx(x) if x[1] is not None else x for x in sorted(map(tuple, plain.select("g", *shares).collect()), key=key)]
    whole = O.exact_percentiles(df, [], "v", {"mid": 0.5}, most=50).first().mid
    assert whole == pytest.approx(df.agg(F.median("v")).first()[0])


def test_ranks_in_pieces_equal_ranks(spark):
    import random

    r = random.Random(41)
    df = spark.createDataFrame([(i, r.randrange(2), float(r.randrange(300))) for i in range(3000)], "k int, g int, v double")
    one, many = (values(O.average_rank(df, ["g"], "v", "r", cuts), "k", "r") for cuts in (0, 16))
    assert one == many
    whole = values(O.average_rank(df, [], "v", "r", 8), "v", "r")
    assert whole[0][0] == 0.0 and max(x[1] for x in whole) <= 3000
    ranked = O.rank(df.withColumn("v", F.when(F.col("k") > 5, F.col("v"))).repartition(5), "v", "k")
    rows = sorted(ranked.collect(), key=lambda x: x["rank"])
    assert [x["rank"] for x in rows] == list(range(1, 3001)) and [x.k for x in rows[-6:]] == list(range(6))
    assert [(-x.v, x.k) for x in rows[:-6]] == sorted((-x.v, x.k) for x in rows[:-6])


def test_gram_correlations_skip_missing_values(spark):
    import random

    import numpy as np

    r = random.Random(42)
    rows = [(i, [x := r.random(), x * 2 + r.random(), None if r.random() < 0.2 else -x, 5.0]) for i in range(500)]
    got = {(x.a, x.b): x.r for x in N.packed_correlations(spark.createDataFrame(rows, "k int, features array<double>").repartition(4)).collect()}
    m = np.array([[np.nan if v is None else v for v in x] for _, x in rows])
    ok = ~np.isnan(m[:, 2])
    assert got[(0, 1)] == pytest.approx(np.corrcoef(m[:, 0], m[:, 1])[0, 1]) and got[(1, 2)] == pytest.approx(np.corrcoef(m[ok, 1], m[ok, 2])[0, 1])
    assert got[(0, 2)] == pytest.approx(-1.0) and got[(0, 3)] is None and len(got) == 6
    same = {(x.a, x.b): x.r for x in N.correlations(schema.to_long(spark.createDataFrame(rows, "k int, features array<double>"), ["k"]), "k").collect()}
    assert {k: v for k, v in same.items() if v is not None} == {k: pytest.approx(v) for k, v in got.items() if v is not None}


def test_rows_zip_by_position(spark):
    a = spark.createDataFrame([(0, None), (1, "x")], "i int, a string")
    assert values(J.zip_rows(a, spark.createDataFrame([(0, "p"), (1, None)], "i int, b string"), "i"), "i", "a", "b") == [(0, None, "p"), (1, "x", None)]
    with pytest.raises(Exception, match="unequal"):
        J.zip_rows(a, spark.createDataFrame([(0, "p")], "i int, b string"), "i").collect()


def test_mean_distance_of_blocks(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(L, "BLOCK", 7)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 3))
    df = spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(x)] + [(99, 5, [0.0, 0.0, 0.0])], "k int, g int, x array<double>")
    got = {r.g: r.distance for r in L.mean_distance(df, "k", "x", "g").collect()}
    for g in (0, 1):
        part = x[g::2]
        d = [np.linalg.norm(part[i] - part[j]) for i in range(len(part)) for j in range(i)]
        assert got[g] == pytest.approx(np.mean(d))
    assert set(got) == {0, 1}
    pairs = L.pairwise(df, "k", "x", queries=F.col("k") == 3).collect()
    assert {p.b for p in pairs} == {*range(50), 99} - {3}


def test_numbered_rows_of_many_blocks(spark, tmp_path):
    from platewise.sources import readers as R

    for name, n in (("a", 400), ("b", 250)):
        (tmp_path / f"{name}.csv").write_text("sequence,name\n" + "".join(f"ACD{'A' * (i % 50)},{name}{i}\n" for i in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000b")
    try:
        rows = R.numbered(spark.read.option("header", True).csv(str(tmp_path)), "i").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r.name for r in sorted(rows, key=lambda r: r.i)] == [f"a{i}" for i in range(400)] + [f"b{i}" for i in range(250)]


def test_late_rows_survive_a_repeated_batch(spark, tmp_path):
    import datetime

    at = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    step = monitor.split_late("ts", 600, str(tmp_path))
    make = lambda rows: spark.createDataFrame(rows, "k int, ts timestamp")
    first, second = make([(1, at(0)), (2, at(60))]), make([(3, at(5)), (4, at(55)), (5, at(90))])
    for number, batch in ((0, first), (1, second), (1, second)):  # the second one is tried again, by a new run
        step = monitor.split_late("ts", 600, str(tmp_path))
        step(batch, number)
    assert values(spark.read.parquet(f"{tmp_path}/late"), "k") == [(3,)] and values(spark.read.parquet(f"{tmp_path}/good"), "k") == [(1,), (2,), (4,), (5,)]


def test_gram_tiles_of_two_thousand_features(spark):
    import numpy as np

    from platewise.operators import gram

    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 2000))
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 7] = np.nan  # a feature that no row has
    rows = spark.createDataFrame([(i, [None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)], "id long, features array<double>").repartition(12)
    sums = gram.pair_sums(gram.listed_packed(rows), groups=3)
    got = gram.correlation(sums).filter("a in (0, 255, 256, 1999) or b in (256, 1999)").collect()
    seen = {(r.a, r.b): r.r for r in got}
    assert len(seen) == len(got) and all(a < b for a, b in seen) and not any(7 in k for k in seen)
    for (a, b), r in list(seen.items())[::211] + [((255, 256), seen[255, 256]), ((0, 1999), seen[0, 1999])]:
        both = ~np.isnan(x[:, a]) & ~np.isnan(x[:, b])
        assert r == pytest.approx(np.corrcoef(x[both, a], x[both, b])[0, 1], abs=1e-9)
    assert sums.count() == 1999 * 1998 // 2
    plan = sums._jdf.queryExecution().toString()
    assert "Coalesce 3" in plan  # the shuffle has three sets of tiles, not twelve


def test_narrowing_goes_on_beside_a_group_of_ties(spark):
    """A group of equal values can't shrink; another one still does."""
    import random

    from platewise.operators import order

    r = random.Random(3)
    rows = [("ties", 5.0)] * 4000 + [("wide", r.random()) for _ in range(5001)] + [("small", 1.0), ("small", 2.0), ("none", None), (None, 3.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    wide = sorted(v for k, v in rows if k == "wide")
    got = {x.k: x.p for x in order.exact_percentiles(df, ["k"], "v", {"p": 0.5}, most=50).collect()}
    assert got == {"ties": 5.0, "wide": wide[2500], "small": 1.5, "none": None, None: 3.0}
    seen = []
    plain = order.scratch.written
    order.scratch.written = lambda d, name: seen.append(plain(d, name)) or seen[-1]
    try:
        order.exact_percentiles(df, ["k"], "v", {"p": 0.5}, most=50).collect()
    finally:
        order.scratch.written = plain
    assert {x.k: x._in for x in seen[-1].collect()}["wide"] <= 400  # narrowed although the ties stayed


def test_median_and_mad_either_way(spark):
    import random
    import statistics

    from platewise.operators import order

    r = random.Random(4)
    rows = [(k, r.choice([None, r.random(), 0.5])) for k in ("a", "b", None) for _ in range(301)] + [("none", None), ("one", 2.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    want = {}
    for k in ("a", "b", None, "one"):
        v = [x for kk, x in rows if kk == k and x is not None]
        mid = statistics.median(v)
        want[k] = (pytest.approx(mid), pytest.approx(statistics.median([abs(x - mid) for x in v])), len(v))
    want["none"] = (None, None, 0)
    for most in (10**6, 40):
        assert {x.k: (x._mid, x._mad, x._n) for x in order.median_and_mad(df, ["k"], "v", most=most).collect()} == want
        whole = order.median_and_mad(df, [], "v", most=most).first()
        assert whole._n == sum(x is not None for _, x in rows)
        got = {x.k: (x.m, x.n) for x in order.median_and_count(df, ["k"], "v", "m", "n", most=most).collect()}
        assert got == {k: (want[k][0], sum(kk == k for kk, _ in rows)) for k in want}


def test_batches_and_the_whole_come_from_one_scan(spark):
    from platewise.operators import normalise as N

    df = spark.createDataFrame([("x", 0, 1.0), ("x", 0, 3.0), (None, 0, 8.0), ("y", 1, 5.0), ("y", 1, None)], "b string, f int, v double")
    for method in ("center", "zscore", "robust"):
        per, whole = N.fit_batches(df, "b", method)
        assert sorted((r.b or "", r.f, r.centre) for r in per.collect()) == [("", 0, 8.0), ("x", 0, 2.0), ("y", 1, 5.0)]
        assert sorted((r.f, r.centre) for r in whole.collect()) == [(0, 3.0 if method == "robust" else 4.0), (1, 5.0)]


def test_footers_are_read_by_tasks(spark, tmp_path, monkeypatch):
    from platewise.sources import readers as R

    for p in range(6):
        own = "1.5D as Cells_B" if p % 2 else "'x' as Metadata_Note"
        spark.range(10 * p, 10 * p + 3).selectExpr("id as Metadata_Well", "cast(id as double) as Cells_A", own).coalesce(1).write.parquet(str(tmp_path / f"p{p}"))
    (tmp_path / "junk").write_text("no parquet")
    paths = [str(tmp_path / x) for x in ("p0", "p1", "none", "p2", "p3", "junk", "p4")] + [f"file:{tmp_path}/p5"]
    wide, skipped = R.load_plates(spark, paths)
    assert skipped == [paths[2], paths[5]]
    assert sorted(wide.columns) == ["Cells_A", "Metadata_Note", "Metadata_Well"]
    assert sorted(r.Metadata_Well for r in wide.collect()) == sorted(10 * p + i for p in range(6) for i in range(3))
    kinds, _ = R.schemas(spark, paths)
    assert [group for _, group in kinds] == [[paths[0], paths[3], paths[6]], [paths[1], paths[4], paths[7]]]
    monkeypatch.setattr(R, "_footer", lambda path: (None, False))  # a store that tasks can't open
    assert [(k.names, g) for k, g in R.schemas(spark, paths)[0]] == [(k.names, g) for k, g in kinds] and R.schemas(spark, paths)[1] == skipped
    assert R.load_plates(spark, paths, most=2)[1] == []


def test_large_groups_are_read_once(spark):
    """Medians and spreads of groups beyond a task take one scan and as many tables as any other data, also where values lie far apart."""
    import random

    import numpy as np

    from platewise.operators import order

    r = random.Random(6)
    rows = [(i % 3, r.choice([r.random(), 1e30 * r.random(), 1e-30 * r.random()])) for i in range(3000)]
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(v):
        seen.add(1)
        return v

    df = spark.createDataFrame(rows, "k int, v double").repartition(4).withColumn("v", counted("v"))
    tables = []
    plain = order.scratch.written
    order.scratch.written = lambda d, name: tables.append(name) or plain(d, name)
    try:
        got = {x.k: (x._mid, x._mad) for x in order.median_and_mad(df, ["k"], "v", largest=1000, most=10).collect()}
    finally:
        order.scratch.written = plain
    assert seen.value == len(rows)
    assert len(tables) == 5
    for k in range(3):
        v = np.array([x for kk, x in rows if kk == k])
        assert got[k] == (pytest.approx(np.median(v)), pytest.approx(np.median(np.abs(v - np.median(v)))))


def test_ridge_on_tasks_without_rows(spark):
    """Empty tasks add nothing, rows without a vector are left out, and a table without rows is an error of its own."""
    rows = [(i, [float(i), float(i * i % 7)], [2.0 * i + 1]) for i in range(5)]
    kind = "k long, x array<double>, y array<double>"
    df = spark.createDataFrame([*rows, (7, None, [1.0]), (8, [1.0, 2.0], None)], kind).repartition(20)
    members = C.ridge(df, "x", "y", penalty=1e-9, members=2, key="k")
    assert len(members) == 3
    assert members[0].ravel() == pytest.approx([1.0, 2.0, 0.0], abs=1e-5)
    got = {r.k: r.value for r in C.ridge_predict(df, "k", "x", members[:1]).collect()}
    assert got == {k: pytest.approx(2.0 * x[0] + 1, abs=1e-4) for k, x, _ in [*rows, (8, [1.0, 2.0], None)]}
    with pytest.raises(ValueError, match="no rows"):
        C.ridge(spark.createDataFrame([], kind), "x", "y")


def test_shapley_joins_nothing(spark):
    """Each score is made once and no side of steps can be broadcast; rows of one key are averaged, and failing scores are left out."""
    rows = [(1, [3.0, 4.0]), (1, [5.0, 4.0]), (2, [0.0, 2.0]), (3, [1.0, None])]
    df = spark.createDataFrame(rows, "k int, x array<double>")
    seen = spark.sparkContext.accumulator(0)

    def factory():
        def run(xs):
            seen.add(len(xs))
            return [[x[0] * 2 + x[1] * x[0]] for x in xs]

        return run

    out = X.shapley(df, "k", "x", [1.0, 0.0], factory, 40)
    got = {(r.k, r.f): r.shapley for r in out.collect()}
    assert seen.value == len(rows) * 40 * 3
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    assert [got[k, 0] + got[k, 1] for k in (1, 2, 3)] == pytest.approx([(18 + 30) / 2 - 2, -2, 0])  # they add up to the change of the score
    assert set(got) == {(k, f) for k in (1, 2, 3) for f in (0, 1)}


def test_silhouettes_shuffle_no_pairs_of_blocks(spark):
    """Blocks meet in a product of their files; what is shuffled afterwards has no vectors."""
    import numpy as np

    r = np.random.default_rng(2)
    x, label = r.random((700, 3)), r.integers(0, 3, 700)
    df = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, label))], "k int, x array<double>, c int")
    out = C.silhouettes(df, "k", "x", "c")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" not in plan  # pairs were dealt out with both their vectors
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    got = {row.k: row.silhouette for row in out.collect()}
    for i in range(0, 700, 50):
        mean = {c: d[i, label == c].sum() / ((label == c).sum() - (c == label[i])) for c in range(3)}
        a, b = mean[label[i]], min(v for c, v in mean.items() if c != label[i])
        assert got[i] == pytest.approx((b - a) / max(a, b), abs=1e-9)
