"""Forms of the same results that must hold at size: what they return, and what their plans don't do."""

import numpy as np
from pyspark.sql import functions as F

from platewise import schema
from platewise.operators import normalise as N
from platewise.operators import order
from platewise.operators import selection as L


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairwise_by_matrices_with_odd_vectors(spark):
    x = np.random.default_rng(3).normal(size=(40, 5))
    rows = [(f"k{i}", v.tolist()) for i, v in enumerate(x)]
    odd = [("null", None), ("hole", [1.0, None, 0.0, 0.0, 0.0]), ("short", [1.0, 2.0]), ("none", []), (None, x[0].tolist())]
    df = spark.createDataFrame(rows + odd, "k string, x array<double>")
    out = L.pairwise(df, "k", "x", queries=F.col("k").isin("k0", "k7", "short"))
    assert "Generate" not in plan(out)  # pairs are not made one by one
    got = {(r.a, r.b): r.distance for r in out.collect()}
    assert len(got) == 3 * 43
    for a in (0, 7):
        for b in range(40):
            if a != b:
                total = 0.0
                for u, v in zip(x[a], x[b]):
                    total += (u - v) * (u - v)
                assert got[f"k{a}", f"k{b}"] == np.sqrt(total)
        assert all(got[f"k{a}", k] is None for k in ("null", "hole", "short", "none"))
    assert got["short", "none"] is None


def test_packed_correction_is_the_long_one_and_medians_take_one_shuffle(spark):
    rng = np.random.default_rng(5)
    rows = [(i, None if i % 11 == 0 else f"b{i % 3}", f"t{i % 7}", [float(v) if v > -1.5 else None for v in rng.normal(size=3)]) for i in range(120)]
    packed = spark.createDataFrame(rows, "k int, batch string, t string, features array<double>")
    for method, reference in (("center", None), ("zscore", None), ("robust", None), ("reference", "b1")):
        long = N.correct_batches(schema.to_long(packed, ["k", "batch"]), "batch", method, reference)
        want = {(r.k, r.f): r.v for r in long.collect()}
        got = {(r.k, r.f): r.v for r in schema.to_long(N.correct_packed(packed, "batch", method, reference), ["k"]).collect()}
        assert got == want and len(got) == 360
    placed = schema.to_long(packed.repartition("t"), ["t"])
    out = order.median_and_count(placed, ["t", "f"], "v", "m", "n", 20)
    assert plan(out).count("Exchange hashpartitioning") == 1
    for r in out.collect():
        own = [x[3][r.f] for x in rows if x[2] == r.t]
        assert r.n == len(own) and r.m == np.median([v for v in own if v is not None])
    empty = spark.createDataFrame([("a", None), ("a", None), (None, 2.0)], "t string, v double")
    assert sorted((str(r.t), r.m, r.n) for r in order.median_and_count(empty, ["t"], "v", "m", "n", 2).collect()) == [("None", 2.0, 1), ("a", None, 2)]


def test_ranks_of_frequent_values_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(order, "OFTEN", 20)
    v = [float(i % 3) if i % 2 else float(i) for i in range(300)] + [float("nan")] * 30
    df = spark.createDataFrame([(i, i % 2, x) for i, x in enumerate(v)] + [(400, None, 1.0), (401, 1, None)], "k int, g int, v double")
    for by in ([], ["g"]):
        want = {r.k: r.r for r in order.average_rank(df.filter("g is not null and v is not null"), by, "v", "r").collect()}
        out = order.average_rank(df.filter("g is not null and v is not null"), by, "v", "r", cuts=4)
        assert "BroadcastHashJoin" in plan(out)
        assert {r.k: r.r for r in out.collect()} == want and len(want) == 330


def test_pair_sums_read_their_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def counted(k):
        seen.add(1)
        return [float(k), float(k * k), None if k % 3 else float(-k)]

    rows = spark.range(60).select(counted("id").alias("features"))
    got = {(r.a, r.b): r.r for r in N.packed_correlations(rows).collect()}
    assert seen.value == 60
    k = np.arange(60)
    assert abs(got[0, 1] - np.corrcoef(k, k * k)[0, 1]) < 1e-12 and abs(got[0, 2] + 1) < 1e-12


def test_descriptor_sums_are_not_in_the_descriptors_generated_code(spark):
    from platewise import catalog

    text = plan(catalog.queries()["h19_descriptors"](spark, "/root/testdata/sf0.001"))
    assert text.index("Generate posexplode") < text.index("MapInArrow") < text.index("ArrowEvalPython")  # printed from the last step to the first


def test_many_plates_are_listed_by_few_tasks(spark, tmp_path):
    from platewise.sources import readers as R

    spark.range(80).selectExpr("id as plate", "id as Metadata_K", "cast(id as double) as Cells_A").repartition("plate").write.partitionBy("plate").parquet(f"{tmp_path}/p")
    spark.sparkContext.setJobGroup("listing", "")
    try:
        rows, skipped = R.load_plates(spark, [f"{tmp_path}/p/plate={i}" for i in range(80)])
        tracker = spark.sparkContext.statusTracker()
        stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert stages and max(s.numTasks for s in stages if s) <= 4 * spark.sparkContext.defaultParallelism
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == "10000"
    assert skipped == [] and rows.agg(F.sum("Cells_A")).first()[0] == 3160.0


def _own_shuffles(df) -> list[str]:
    """Shuffles that joins and aggregates asked for."""
    return [x for x in plan(df).splitlines() if "Exchange hashpartitioning" in x and "REPARTITION" not in x]


def test_variance_of_means_is_summed_up_by_keys_dealt_to_a_task(spark):
    from platewise import catalog
    from platewise.operators import aggregates as A

    text = plan(catalog.queries()["d34_most_variable"](spark, "/root/testdata/sf0.001"))
    assert text.index("Generate posexplode") < text.index("REPARTITION_BY_COL")  # printed from the last step to the first
    rows = [(i % 5, [float(i * i % 17), None if i % 5 == 2 else float(-i), None]) for i in range(60)] + [(None, [3.0, 4.0, 5.0])]
    packed = spark.createDataFrame(rows, "k int, features array<double>")
    out = A.most_variable_packed(packed, "k", 3)
    assert len(_own_shuffles(out)) == 1  # by feature
    want = A.most_variable(schema.to_long(packed, ["k"]), "k", 3).collect()
    got = out.collect()
    assert [r.f for r in got] == [r.f for r in want]
    assert all(abs(a.variance - b.variance) < 1e-9 for a, b in zip(got, want))


def test_well_deviation_shuffles_packed_rows_once(spark):
    from platewise import catalog
    from platewise.operators import quality as Q

    assert _own_shuffles(catalog.queries()["d32_well_deviation"](spark, "/root/testdata/sf0.001")) == []
    rng = np.random.default_rng(8)
    rows = [(i % 3, i // 9, [float(v) if v > -1 else None for v in rng.normal(size=3)] if i % 9 else [None] * 3) for i in range(90)]
    rows += [(7, 1, [None, None, None]), (7, 2, None), (7, 3, []), (None, 1, [1.0, 2.0, 3.0])]
    packed = spark.createDataFrame(rows, "p int, w int, features array<double>")
    want = {(r.p, r.w): r.deviation for r in Q.well_deviation(schema.to_long(packed, ["p", "w"]), "p", "w").collect()}
    assert {(r.p, r.w): r.deviation for r in Q.well_deviation_packed(packed, "p", "w").collect()} == want and len(want) == 31


def test_corrected_ends_shuffle_packed_rows_once(spark):
    from platewise import catalog

    text = plan(catalog.queries()["d13_correct_reference"](spark, "/root/testdata/sf0.001"))
    assert "SortMergeJoin" not in text and text.count("Exchange hashpartitioning(plate") <= 2  # packed rows, and a row a batch
    assert text.index("Generate posexplode") < text.index("Exchange hashpartitioning(plate")  # printed from the last step to the first
    rng = np.random.default_rng(9)
    rows = [(None if i % 11 == 0 else f"b{i % 3}", [float(v) if v > -1.5 else None for v in rng.normal(size=3)]) for i in range(121)]
    rows += [("short", [1.0]), ("short", [4.0, 2.0]), ("gap", [None, 2.0, None]), ("none", None), ("none", []), (None, [7.0]), (None, None), ("b0", [float("nan"), 1.0, 2.0])]
    packed = spark.createDataFrame(rows, "batch string, features array<double>")
    found = lambda df: sorted((str(r.batch), r.f, repr(r._mid), repr(r._high), repr(r._low)) for r in df.collect())
    for method, reference in (("center", None), ("zscore", None), ("robust", None), ("reference", "b1"), ("reference", "short"), ("reference", "gap"), ("reference", "absent")):
        long = N.correct_batches(schema.to_long(packed, ["batch"]), "batch", method, reference)
        want = found(long.groupBy("batch", "f").agg(F.median("v").alias("_mid"), F.max("v").alias("_high"), F.min("v").alias("_low")))
        assert len(want) == {"short": 12, "absent": 0}.get(reference, 17)
        for most in (10**6, 60, 20) if reference == "b1" else (10**6,):  # packed rows, long ones, and long ones by counted values
            assert found(N.corrected_ends(packed, "batch", method, reference, most)) == want


def test_overall_statistics_come_from_those_of_batches(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(k):
        seen.add(1)
        return None if k % 5 == 0 else float(k * k % 23)

    long = spark.range(60).select((F.col("id") % 7).alias("b"), (F.col("id") % 2).cast("int").alias("f"), counted("id").alias("v"))
    per, whole = N.fit_batches(long, "b", "zscore")
    got = {r.f: (r.centre, r.scale) for r in whole.collect()}
    assert seen.value == 60 and "Expand" not in plan(whole) and sum(r._rows for r in per.collect()) == 60
    for f in (0, 1):
        v = [k * k % 23 for k in range(f, 60, 2) if k % 5]
        assert abs(got[f][0] - np.mean(v)) < 1e-9 and abs(got[f][1] - np.std(v)) < 1e-9


def test_mean_distance_shuffles_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 8)
    x = np.random.default_rng(6).normal(size=(60, 4))
    df = spark.createDataFrame([(i, None if i % 3 == 2 else i % 3, v.tolist()) for i, v in enumerate(x)] + [(99, 5, x[0].tolist())], "k int, g int, x array<double>")
    out = L.mean_distance(df, "k", "x", "g")
    text = plan(out)
    assert "CartesianProduct" in text and "Exchange" not in text[text.index("MapInPandas") :]
    got = {r.g: r.distance for r in out.collect()}
    assert set(got) == {0, 1}  # as before, a null group and one row have no mean
    for g in (0, 1):
        y = x[g::3]
        d = np.sqrt(((y[:, None] - y[None]) ** 2).sum(axis=2))
        assert abs(got[g] - d[np.triu_indices(20, 1)].mean()) < 1e-9
