"""Profile tables: resolution, quality, statistics, normalisation, batches, aggregation."""

from __future__ import annotations

from pyspark.sql import functions as F

from platewise import schema
from platewise.catalog.base import FEATURES, LONG, WELLS, long_wells, picks_sql, query, rounded, table, wells
from platewise.operators import aggregates as A
from platewise.operators import normalise as N
from platewise.operators import quality as Q
from platewise.operators.order import largest_group, median_and_count
from platewise.plans import pipelines
from platewise.scratch import folder

NORM = "sqrt(list_sum(list_transform(features, lambda x: coalesce(x * x, 0.0))))"
ROBUST = """mid AS (SELECT f, median(v) AS c FROM long GROUP BY f),
stats AS (SELECT f, any_value(c) AS c, greatest(median(abs(v - c)) * 1.4826, 1e-8) AS s FROM long JOIN mid USING (f) GROUP BY f)"""


@query(f"""WITH {LONG}, {ROBUST}, scaled AS (SELECT treatment, f, greatest(-5.0, least(5.0, (v - c) / s)) AS z FROM long JOIN stats USING (f) WHERE v IS NOT NULL)
SELECT treatment, f, round(median(z), 6) AS z, count(*) AS n FROM scaled GROUP BY treatment, f HAVING count(*) >= 5""")
def flagship_treatment_profiles(spark, sf):
    """Robust normalisation over all wells, then replicate medians."""
    rows = wells(spark, sf).select("treatment", "features")
    scaled = schema.to_long(N.normalise(rows, "robust"), ["treatment"]).filter("v is not null")
    out = median_and_count(scaled, ["treatment", "f"], "v", "z", "n", largest_group(rows, ["treatment"], "treatment")).filter("n >= 5")
    return rounded(out, "z")


NAMES = {0: "Cells_AreaShape_", 1: "Nuclei_Texture_", 2: "Cells_Parent_", 3: "Cytoplasm_Intensity_", 4: "Cells_Location_Center_X_", 5: "Nuclei_Correlation_", 6: "Image_", 7: "Cells_Number_Object_Number_", 8: "Nuclei_AreaShape_BoundingBox", 9: "Nuclei_Granularity_"}
_NAME = "CASE p_partkey % 11 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in NAMES.items()) + " ELSE '' END || p_name"


@query(f"""WITH n AS (SELECT p_partkey AS part, {_NAME} AS name FROM part) SELECT part, name, regexp_matches(name, '{"|".join(schema.BLOCKED)}') AS is_blocked, split_part(name, '_', 1) AS head,
 CASE {" ".join(f"WHEN contains(name, '{c}') THEN '{c}'" for c in schema.CATEGORIES)} ELSE 'other' END AS category FROM n""")
def b03_b06_feature_names(spark, sf):
    """Names of features of many kinds, some of them blocked."""
    kind = F.col("p_partkey") % 11
    head = F.lit("")
    for k, v in NAMES.items():
        head = F.when(kind == k, v).otherwise(head)
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("part"), F.concat(head, "p_name").alias("name"))
    return rows.withColumns({"is_blocked": schema.blocked_column(F.col("name")), "head": schema.compartment(F.col("name")), "category": schema.category(F.col("name"))})


@query("""SELECT s_suppkey, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE contains(lower(trim(r_name)), 'america')
 AND NOT EXISTS (SELECT 1 FROM region WHERE lower(trim(r_name)) = 'america') OR lower(trim(r_name)) = 'america'""")
def b07_plates_of_type(spark, sf):
    nation = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    plates = table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "r_name")
    return Q.plates_of_type(plates, "r_name", "AMERICA")


@query(f"WITH {WELLS} SELECT ord, line, plate, treatment FROM wells WHERE plate = 7")
def b08_wells_of_plate(spark, sf):
    return Q.wells_of_plate(wells(spark, sf), "plate", 7).select("ord", "line", "plate", "treatment")


QC = f"""b AS (SELECT median({NORM}) AS m FROM wells), d AS (SELECT median(abs({NORM} - m)) * 1.4826 AS mad FROM wells, b),
q AS (SELECT *, {NORM} AS n, list_count(list_filter(features, lambda x: x IS NULL)) AS k,
 len(list_filter(features, lambda x: x IS NULL)) / 4.0 AS nulls FROM wells, b, d)"""


@query(f"""WITH {WELLS}, {QC} SELECT ord, line, plate, treatment, nulls <= 0.1 AS few_nulls, coalesce(cells::INT, 0) >= 5 AS enough, round(n, 4) AS norm,
 nulls <= 0.1 AND coalesce(cells::INT, 0) >= 5 AND NOT (n < m - 2 * mad OR n > m + 2 * mad) AS passed FROM q""")
def b09_b12_flag_wells(spark, sf):
    out = Q.flag_wells(wells(spark, sf), "cells", 0.1, 5, 2.0)
    return out.select(
        "ord",
        "line",
        "plate",
        "treatment",
        Q.null_share_ok(F.col("features"), 0.1).alias("few_nulls"),
        Q.count_ok(F.col("cells"), 5).alias("enough"),
        F.round(Q.norm(F.col("features")), 4).alias("norm"),
        F.col("qc_passed").alias("passed"),
    )


@query(f"""WITH {WELLS} SELECT ord, line, coalesce(cells >= 10, true) AS passed, list_transform(features, lambda x: coalesce(x, 0.0))[3] AS discount,
 (CASE WHEN cells >= 10 THEN 1 ELSE 0 END) + (CASE WHEN cells >= 20 THEN 1 ELSE 0 END) + (CASE WHEN cells >= 30 THEN 1 ELSE 0 END) AS size_class FROM wells""")
def b13_b17_b20_row_rules(spark, sf):
    return wells(spark, sf).select(
        "ord", "line", Q.cell_count_passed(F.col("cells"), 10).alias("passed"), Q.fill_missing(F.col("features"))[2].alias("discount"), Q.length_class(F.col("cells"), (10, 20, 30)).alias("size_class")
    )


@query("SELECT l_orderkey, l_linenumber, l_suppkey::VARCHAR AS plate_id, 'well_' || l_orderkey AS sample_id, coalesce(l_quantity, 0.0) AS a, coalesce(l_tax, 0.0) AS b FROM lineitem")
def b18_pack_profiles(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("plate"), "l_quantity", "l_tax")
    out = Q.pack_profiles(rows, ["l_quantity", "l_tax"], ordinal="l_orderkey")
    return out.select("l_orderkey", "l_linenumber", "plate_id", "sample_id", F.col("features")[0].alias("a"), F.col("features")[1].alias("b"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 2 = 0 THEN 'A' ELSE '' END || chr((65 + l_linenumber)::INT) AS row, l_quantity::INT AS col, (1 + (l_suppkey % 2 = 0)::INT)::INT AS row_length FROM lineitem""")
def b19_well_position(spark, sf):
    head = F.when(F.col("l_suppkey") % 2 == 0, "A").otherwise("")  # rows past Z have two letters
    well = F.concat(head, F.chr(F.col("l_linenumber") + 65), F.lpad(F.col("l_quantity").cast("int").cast("string"), 2, "0"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", Q.well_position(well).alias("p")).select("l_orderkey", "l_linenumber", "p.*")


@query("""WITH grid AS (SELECT DISTINCT l_suppkey, r, c FROM lineitem, range(1, 8) a(r), range(1, 51) b(c))
SELECT l_suppkey, r::INT AS line, c::INT AS quantity FROM grid WHERE NOT EXISTS (SELECT 1 FROM lineitem x WHERE x.l_suppkey = grid.l_suppkey AND x.l_linenumber = r AND x.l_quantity = c)""")
def c17_missing_positions(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_suppkey", F.col("l_linenumber").cast("int").alias("line"), F.col("l_quantity").cast("int").alias("quantity"))
    return Q.missing_positions(rows, "l_suppkey", "line", "quantity", range(1, 8), range(1, 51))


@query(f"""WITH {LONG}, m AS (SELECT plate, f, median(v) AS mid FROM long GROUP BY ALL), w AS (SELECT plate, ord, median(abs(v - mid)) AS deviation FROM long JOIN m USING (plate, f) GROUP BY ALL)
SELECT plate, ord, round(deviation, 6) AS deviation FROM w""")
def d32_well_deviation(spark, sf):
    return rounded(Q.well_deviation_packed(wells(spark, sf), "plate", "ord"), "deviation")


@query("""SELECT l_suppkey, sum(CASE WHEN l_linenumber = 1 THEN l_quantity END) AS "1", sum(CASE WHEN l_linenumber = 2 THEN l_quantity END) AS "2", sum(CASE WHEN l_linenumber = 3 THEN l_quantity END) AS "3"
 FROM lineitem GROUP BY l_suppkey""")
def d33_plate_map(spark, sf):
    sums = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.sum("l_quantity").alias("q"))
    return Q.plate_map(sums, "l_suppkey", "l_linenumber", "q", [1, 2, 3])


@query("""SELECT l_suppkey, l_linenumber, median(l_quantity) AS l_quantity, median(l_extendedprice) AS l_extendedprice, count(*) AS cell_count, l_suppkey || '_' || l_linenumber AS sample_id
 FROM lineitem GROUP BY l_suppkey, l_linenumber""")
def d01_cells_to_wells(spark, sf):
    return A.cells_to_wells(table(spark, sf, "lineitem"), ["l_suppkey", "l_linenumber"], ["l_quantity", "l_extendedprice"])


@query("""SELECT l_partkey, round(avg(l_quantity), 6) AS l_quantity, round(avg(l_tax), 6) AS l_tax, count(*) AS n_replicates FROM lineitem GROUP BY l_partkey HAVING count(*) >= 20""")
def d02_wells_to_treatments(spark, sf):
    return rounded(A.wells_to_treatments(table(spark, sf, "lineitem"), "l_partkey", ["l_quantity", "l_tax"], "mean", 20), "l_quantity", "l_tax")


@query("SELECT l_returnflag, f, median(v) AS m FROM (SELECT l_returnflag, unnest([0, 1]) AS f, unnest([l_quantity, l_tax]) AS v FROM lineitem) GROUP BY ALL")
def d02_median_of_hot_keys(spark, sf):
    """Medians of a few keys that hold most rows, by value counts first."""
    long = schema.to_long(table(spark, sf, "lineitem").select("l_returnflag", F.array("l_quantity", "l_tax").alias("features")), ["l_returnflag"])
    return A.exact_median_by_count(long, ["l_returnflag", "f"], "v", "m")


@query(f"WITH {LONG}, {ROBUST} SELECT f, round(c, 6) AS centre, round(s, 6) AS scale FROM stats")
def d06_robust_statistics(spark, sf):
    return rounded(N.statistics(long_wells(spark, sf), "robust"), "centre", "scale")


@query(f"WITH {LONG} SELECT f, round(avg(v), 6) AS centre, round(greatest(stddev_pop(v), 1e-8), 6) AS scale FROM long GROUP BY f")
def d07_zscore_statistics(spark, sf):
    return rounded(N.statistics(long_wells(spark, sf), "zscore"), "centre", "scale")


@query(f"WITH {LONG} SELECT f, min(v) AS centre, round(greatest(max(v) - min(v), 1e-8), 6) AS scale FROM long GROUP BY f")
def d08_minmax_statistics(spark, sf):
    return rounded(N.statistics(long_wells(spark, sf), "minmax"), "scale")


@query(f"""WITH {LONG}, {ROBUST}, z AS (SELECT plate, f, greatest(-5.0, least(5.0, (v - c) / s)) AS z FROM long JOIN stats USING (f) WHERE v IS NOT NULL) SELECT plate, f, round(sum(z), 4) AS total, round(max(z), 6) AS top FROM z GROUP BY plate, f""")
def d09_normalised(spark, sf):
    out = schema.to_long(N.normalise(wells(spark, sf).select("plate", "features"), "robust"), ["plate"])
    return out.groupBy("plate", "f").agg(F.round(F.sum("v"), 4).alias("total"), F.round(F.max("v"), 6).alias("top"))


@query(f"""WITH {LONG}, m AS (SELECT plate, f, median(v) FILTER (flag = 'N') AS c, median(v) AS c0 FROM long GROUP BY ALL),
s AS (SELECT plate, f, any_value(c) AS c, any_value(c0) AS c0, median(abs(v - c)) FILTER (flag = 'N') * 1.4826 AS s, median(abs(v - c0)) * 1.4826 AS s0 FROM long JOIN m USING (plate, f) GROUP BY ALL)
SELECT plate, f, round(coalesce(c, c0), 6) AS centre, round(greatest(CASE WHEN c IS NOT NULL THEN s ELSE s0 END, 1e-8), 6) AS scale FROM s""")
def d10_control_statistics(spark, sf):
    return rounded(N.control_statistics(long_wells(spark, sf), "plate", F.col("flag") == "N"), "centre", "scale")


@query(f"""WITH {LONG}, m AS (SELECT plate, f, avg(v) FILTER (flag = 'N') AS m FROM long GROUP BY ALL)
SELECT plate, f, round(sum(100 * v / CASE WHEN abs(m) < 1e-10 THEN 1e-10 ELSE m END), 2) AS percent FROM long JOIN m USING (plate, f) GROUP BY ALL""")
def d11_percent_of_control(spark, sf):
    out = N.percent_of_control(long_wells(spark, sf), "plate", F.col("flag") == "N")
    return out.groupBy("plate", "f").agg(F.round(F.sum("percent"), 2).alias("percent"))


def _corrected(method):
    if method == "robust":
        stat = "median(v) AS c", "greatest(median(abs(v - c)) * 1.4826, 1e-8) AS s"
    else:
        stat = "avg(v) AS c", "1.0 AS s" if method == "center" else "greatest(stddev_pop(v), 1e-8) AS s"
    goal = "SELECT f, c, s FROM b WHERE plate = 1" if method == "reference" else "SELECT f, c, s FROM g"
    return f"""WITH {LONG}, b0 AS (SELECT plate, f, {stat[0]} FROM long GROUP BY ALL), b AS (SELECT plate, f, any_value(c) AS c, {stat[1]} FROM long JOIN b0 USING (plate, f) GROUP BY ALL),
g0 AS (SELECT f, {stat[0]} FROM long GROUP BY ALL), g AS (SELECT f, any_value(c) AS c, {stat[1]} FROM long JOIN g0 USING (f) GROUP BY ALL), t AS ({goal})
SELECT plate, f, round(1000 + median((v - b.c) / b.s * t.s + t.c), 3) AS middle, round(1000 + max((v - b.c) / b.s * t.s + t.c), 3) AS high, round(1000 + min((v - b.c) / b.s * t.s + t.c), 3) AS low FROM long JOIN b USING (plate, f) JOIN t USING (f) GROUP BY ALL"""


def _correction(method):
    @query(_corrected(method))
    def run(spark, sf):
        out = N.corrected_ends(wells(spark, sf), "plate", method, 1 if method == "reference" else None)
        return out.select("plate", "f", *[F.round(1000 + F.col(c), 3).alias(name) for c, name in (("_mid", "middle"), ("_high", "high"), ("_low", "low"))])

    return run


def _register_corrections():
    from platewise.catalog.base import REGISTRY

    for method in ("center", "zscore", "robust", "reference"):
        _correction(method)
        REGISTRY[f"d13_correct_{method}"] = REGISTRY.pop("run")


_register_corrections()


@query(f"""WITH {LONG}, b AS (SELECT plate, f, avg(v) AS c, greatest(stddev_pop(v), 1e-8) AS s FROM long GROUP BY ALL), n AS (SELECT plate, count(*) AS n FROM wells GROUP BY plate)
SELECT plate, any_value(n) AS n, round(avg(c), 4) AS centre_mean, round(stddev_pop(c), 4) AS centre_std, round(avg(s), 4) AS scale_mean, round(stddev_pop(s), 4) AS scale_std FROM b JOIN n USING (plate) GROUP BY plate""")
def d12_d14_batch_summary(spark, sf):
    out = N.batch_summary(long_wells(spark, sf), "plate", "zscore")
    return rounded(out, "centre_mean", "centre_std", "scale_mean", "scale_std", digits=4)


@query(f"""WITH {LONG} SELECT f, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, min(v) AS min, max(v) AS max, median(v) AS median, round(avg((v IS NULL)::INT), 6) AS null_share,
 round(var_pop(v), 4) AS var_pop, round(var_samp(v), 4) AS var_samp, round(stddev_pop(v) / (abs(avg(v)) + 1e-8), 6) AS cv FROM long GROUP BY f""")
def d15_d22_feature_statistics(spark, sf):
    rows = long_wells(spark, sf)
    out = rounded(N.feature_statistics(rows).join(N.feature_medians(rows), "f"), "mean", "std", "null_share", "cv")
    return rounded(out, "var_pop", "var_samp", digits=4)


@query(f"""WITH {LONG}, s AS (SELECT f, avg((v IS NULL)::INT) AS k, var_samp(v) AS var FROM long GROUP BY f), r AS (SELECT f, CASE WHEN k > 0.05 THEN 'nulls' WHEN NOT var > 0.001 THEN 'variance' END AS kind FROM s)
SELECT kind, count(*) AS n FROM r WHERE kind IS NOT NULL GROUP BY kind""")
def d18_d21_removals(spark, sf):
    return N.removal_summary(N.removals(N.feature_statistics(long_wells(spark, sf)), 2, 0.05, 0.001))


@query(f"""WITH {LONG} SELECT f, var_pop(v) < 0.001 AS low_variance, avg((v IS NULL)::INT) > 0.05 AS many_nulls,
 max(v) > avg(v) + 2 * stddev_pop(v) OR min(v) < avg(v) - 2 * stddev_pop(v) AS outliers, stddev_pop(v) = 0 AS constant FROM long GROUP BY f""")
def d23_problem_features(spark, sf):
    return N.problem_features(N.feature_statistics(long_wells(spark, sf)), 0.001, 0.05, 2.0)


def _unique_wells(spark, sf, how):
    """A packed row a position: repeated ones are joined feature by feature."""
    values = [how(F.col("features")[i]) for i in range(len(FEATURES))]
    return wells(spark, sf).groupBy((F.col("ord") * 10 + F.col("line")).alias("k")).agg(F.array(*values).alias("features"))


@query(f"""WITH {LONG}, u AS (SELECT ord * 10 + line AS k, f, avg(v) AS v FROM long GROUP BY ALL), p AS (SELECT a.f AS a, b.f AS b, corr(a.v, b.v) AS r FROM u a JOIN u b USING (k)
 WHERE a.f < b.f AND a.v IS NOT NULL AND b.v IS NOT NULL GROUP BY ALL) SELECT a, b, round(r, 6) AS r FROM p""")
def d19_pearson_matrix(spark, sf):
    return rounded(N.packed_correlations(_unique_wells(spark, sf, F.avg)), "r")


@query(f"""WITH {LONG}, u AS (SELECT ord * 10 + line AS k, f, min(v) AS v FROM long GROUP BY ALL), r AS (SELECT k, f, rank() OVER w + (count(*) OVER (PARTITION BY f, v) - 1) / 2.0 AS v FROM u WHERE v IS NOT NULL WINDOW w AS (PARTITION BY f ORDER BY v))
SELECT a.f AS a, b.f AS b, round(corr(a.v, b.v), 6) AS r FROM r a JOIN r b USING (k) WHERE a.f < b.f GROUP BY ALL""")
def d20_spearman_matrix(spark, sf):
    return rounded(N.correlations(schema.to_long(_unique_wells(spark, sf, F.min), ["k"]), "k", "spearman"), "r")


@query("""SELECT l_orderkey AS ord, l_quantity AS v, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2.0 AS r, l_suppkey FROM lineitem""")
def e08_average_ranks(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("ord"), F.col("l_quantity").alias("v"), "l_suppkey")
    return N.average_rank(rows, ["l_suppkey"], "v", "r")


GREEDY = """WITH RECURSIVE u AS (SELECT l_orderkey * 10 + l_linenumber AS k, avg(l_quantity) AS q, avg(l_tax) AS t, avg(l_extendedprice) AS p FROM lineitem GROUP BY 1),
long AS (SELECT k, unnest(range(6))::INT AS f, unnest([q, t, q + 300 * t, p, q + p / 1000, -p]) AS v FROM u), var AS (SELECT f, var_pop(v) AS s FROM long GROUP BY f),
high AS (SELECT a.f AS a, b.f AS b FROM long a JOIN long b USING (k) WHERE a.f < b.f GROUP BY ALL HAVING abs(corr(a.v, b.v)) > 0.5),
pairs AS (SELECT row_number() OVER (ORDER BY x.f, y.f) AS i, x.f AS a, y.f AS b, h.a IS NOT NULL AS high, CASE WHEN x.s < y.s THEN x.f ELSE y.f END AS loser
 FROM var x JOIN var y ON x.f < y.f LEFT JOIN high h ON h.a = x.f AND h.b = y.f),
one AS (SELECT 0::BIGINT AS i, -1 AS a, []::INT[] AS gone, []::INT[] AS before UNION ALL
 SELECT p.i, p.a, CASE WHEN p.high AND NOT list_contains(CASE WHEN p.a = one.a THEN one.before ELSE one.gone END, p.a) AND NOT list_contains(one.gone, p.b) THEN list_append(one.gone, p.loser) ELSE one.gone END,
 CASE WHEN p.a = one.a THEN one.before ELSE one.gone END FROM one JOIN pairs p ON p.i = one.i + 1),
earlier AS (SELECT v.f, coalesce(list(h.a) FILTER (h.a IS NOT NULL), []::INT[]) AS l FROM var v LEFT JOIN high h ON h.b = v.f GROUP BY v.f),
two AS (SELECT -1 AS j, []::INT[] AS gone UNION ALL
 SELECT e.f, CASE WHEN list_contains(two.gone, e.f) THEN two.gone ELSE list_concat(two.gone, list_filter(e.l, lambda x: NOT list_contains(two.gone, x))) END FROM two JOIN earlier e ON e.f = two.j + 1)
SELECT 1 AS version, unnest(list_distinct(gone)) AS f FROM one WHERE i = (SELECT max(i) FROM one) UNION ALL SELECT 2, unnest(list_distinct(gone)) FROM two WHERE j = (SELECT max(j) FROM two)"""


@query(GREEDY)
def d16_d17_correlation_filter(spark, sf):
    """Both greedy filters on the correlation matrix of features some of which are made of others."""
    u = table(spark, sf, "lineitem").groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"))
    u = u.agg(F.avg("l_quantity").alias("q"), F.avg("l_tax").alias("t"), F.avg("l_extendedprice").alias("p"))
    q, t, p = (F.col(c) for c in "qtp")
    packed = u.select("k", F.array(q, t, q + 300 * t, p, q + p / 1000, -p).alias("features"))
    stats = {r.f: r.var_pop for r in N.feature_statistics(schema.to_long(packed, ["k"])).collect()}
    pairs = [(r.a, r.b, r.r) for r in N.packed_correlations(packed).collect()]
    out = [(v, f) for v in (1, 2) for f in N.correlation_filter(stats, pairs, 0.5, v)]
    return spark.createDataFrame(out, "version int, f int")


@query("SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey")
def d03_replicate_counts(spark, sf):
    return A.replicate_counts(table(spark, sf, "lineitem"), "l_partkey")


@query("SELECT DISTINCT p_brand FROM part WHERE p_brand IS NOT NULL")
def d04_distinct_values(spark, sf):
    return A.distinct_values(table(spark, sf, "part"), "p_brand")


@query("SELECT DISTINCT l_suppkey, l_linestatus FROM lineitem")
def d05_plate_sources(spark, sf):
    return A.plate_sources(table(spark, sf, "lineitem"), "l_suppkey", "l_linestatus")


@query("""WITH p AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1), d AS (SELECT n, count(*) AS keys FROM p GROUP BY n)
SELECT n, keys, (sum(keys) OVER (ORDER BY n DESC))::BIGINT AS keys_at_least FROM d""")
def d29_replicate_distribution(spark, sf):
    return A.replicate_distribution(table(spark, sf, "lineitem"), "l_partkey")


@query("SELECT l_partkey, count(*) AS n_wells, count(DISTINCT l_suppkey) AS n_plates FROM lineitem GROUP BY l_partkey")
def d30_spread(spark, sf):
    return A.spread(table(spark, sf, "lineitem"), "l_partkey", "l_suppkey")


@query("SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def d31_value_counts(spark, sf):
    return A.value_counts(table(spark, sf, "lineitem"), "l_returnflag")


@query("SELECT count(DISTINCT l_suppkey) AS l_suppkey, count(DISTINCT l_partkey) AS l_partkey, count(DISTINCT l_returnflag) AS l_returnflag FROM lineitem")
def d31_distinct_counts(spark, sf):
    return A.distinct_counts(table(spark, sf, "lineitem"), ["l_suppkey", "l_partkey", "l_returnflag"])


@query(f"""WITH {LONG}, m AS (SELECT treatment, f, avg(v) AS m FROM long GROUP BY ALL) SELECT f, round(var_pop(m), 4) AS variance FROM m GROUP BY f ORDER BY var_pop(m) DESC LIMIT 3""")
def d34_most_variable(spark, sf):
    return rounded(A.most_variable_packed(wells(spark, sf), "treatment", 3), "variance", digits=4)


@query(f"""WITH {WELLS}, v AS (SELECT unnest(features) AS v FROM wells), s AS (SELECT avg(v) AS mean, stddev_pop(v) AS std, sum((v IS NULL)::INT)::BIGINT AS nulls FROM v),
r AS (SELECT count(*) AS n_samples, 4 AS n_features, count(DISTINCT plate) AS n_plates, count(DISTINCT treatment) AS n_proteins, sum((cells >= 10)::INT)::BIGINT AS n_passed FROM wells)
SELECT n_samples, n_features, n_plates, n_proteins, n_passed, round(mean, 4) AS mean, round(std, 4) AS std, nulls FROM r, s""")
def d24_phenotype_summary(spark, sf):
    rows = wells(spark, sf).withColumn("qc", F.col("cells") >= 10)
    return rounded(A.phenotype_summary(rows, "plate", "treatment", "qc"), "mean", "std", digits=4)


@query("SELECT 'orders' AS tbl, count(DISTINCT o_orderkey) AS n FROM orders UNION ALL SELECT 'part', count(DISTINCT p_partkey) FROM part UNION ALL SELECT 'none', NULL")
def d26_table_counts(spark, sf):
    out = A.table_counts({"orders": (table(spark, sf, "orders"), "o_orderkey"), "part": (table(spark, sf, "part"), "p_partkey"), "none": (None, "")})
    return out.withColumnRenamed("table", "tbl")


@query("""WITH k AS (SELECT l_partkey FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 20) SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM k)""")
def f03_top_groups(spark, sf):
    return A.top_groups(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_partkey", 20)


@query("""WITH k AS (SELECT l_partkey FROM lineitem GROUP BY 1 ORDER BY count(DISTINCT l_suppkey) DESC, 1 LIMIT 20) SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM k)""")
def f04_widest_groups(spark, sf):
    return A.widest_groups(table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey"), "l_partkey", "l_suppkey", 20)


@query("SELECT s_suppkey, s_name FROM supplier ORDER BY s_name, s_suppkey LIMIT 10")
def f05_first_plates(spark, sf):
    return A.first_plates(table(spark, sf, "supplier").select("s_suppkey", "s_name"), "s_name", 10)


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
def f06_top_k(spark, sf):
    return A.top_k(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", 10, "c_custkey")


@query("SELECT p_partkey FROM part ORDER BY sha256('7|' || p_partkey), p_partkey LIMIT 50")
def f09_seeded_sample(spark, sf):
    return A.sample(table(spark, sf, "part").select("p_partkey"), "p_partkey", 50, 7)


@query("""SELECT c_custkey AS id, c_name AS name, NULL::VARCHAR AS s_name, 'c' AS kind FROM customer UNION ALL SELECT s_suppkey, NULL, s_name, 's' FROM supplier""")
def g01_g02_union(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return A.union_tagged({"c": a, "s": table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), "s_name")}, "kind")


@query("SELECT n_nationkey AS k FROM nation INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal > 9000")
def g03_intersection(spark, sf):
    b = table(spark, sf, "customer").filter("c_acctbal > 9000").select("c_nationkey")
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("k")).intersect(b)


@query("""SELECT a.l_returnflag AS a, b.l_returnflag AS b, count(*) AS n FROM (SELECT DISTINCT l_returnflag, l_partkey FROM lineitem) a JOIN (SELECT DISTINCT l_returnflag, l_partkey FROM lineitem) b USING (l_partkey) GROUP BY 1, 2""")
def g05_overlap(spark, sf):
    return A.overlap(table(spark, sf, "lineitem").select("l_returnflag", "l_partkey").distinct(), "l_returnflag", "l_partkey")


@query("""SELECT p_partkey AS k, 'old' AS v FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 25) UNION ALL SELECT p_partkey, 'new' FROM part WHERE p_size > 25""")
def g07_merge_keep_last(spark, sf):
    part = table(spark, sf, "part")
    old, new = part.select(F.col("p_partkey").alias("k"), F.lit("old").alias("v")), part.filter("p_size > 25").select(F.col("p_partkey").alias("k"), F.lit("new").alias("v"))
    return A.merge_keep_last(old, new, ["k"])


@query("""SELECT text, min(doc_id) AS doc_id FROM documents WHERE lang <> 'en' AND text NOT IN (SELECT text FROM documents WHERE lang = 'en' AND text IS NOT NULL) GROUP BY text""")
def g08_add_new(spark, sf):
    docs = table(spark, sf, "documents")
    return A.add_new(docs.filter("lang = 'en'").select("text"), docs.filter("lang <> 'en'").select("text", "doc_id"), "text", "doc_id")


CURATED = f"""WITH u AS (SELECT l_orderkey * 10 + l_linenumber AS k, min(l_suppkey) AS plate, min(l_partkey) AS treatment, min(l_quantity) AS cells,
 [avg(l_quantity), avg(l_extendedprice), avg(l_tax), avg(l_quantity) / 2 + avg(l_tax)] AS features FROM lineitem GROUP BY 1), b AS (SELECT median({NORM}) AS m FROM u),
d AS (SELECT median(abs({NORM} - m)) * 1.4826 AS mad FROM u, b), good AS (SELECT u.* FROM u, b, d WHERE cells >= 5 AND NOT ({NORM} < m - 3 * mad OR {NORM} > m + 3 * mad)),
long AS (SELECT k, plate, treatment, unnest([0, 1, 2]) AS f, unnest(features[1:3]) AS v FROM good), mid AS (SELECT f, median(v) AS c FROM long GROUP BY f),
stats AS (SELECT f, any_value(c) AS c, greatest(median(abs(v - c)) * 1.4826, 1e-8) AS s FROM long JOIN mid USING (f) GROUP BY f),
z AS (SELECT k, plate, treatment, f, greatest(-5.0, least(5.0, (v - c) / s)) AS v FROM long JOIN stats USING (f)), pb AS (SELECT plate, f, avg(v) AS c FROM z GROUP BY ALL), pg AS (SELECT f, avg(v) AS c FROM z GROUP BY ALL),
x AS (SELECT treatment, f, v - pb.c + pg.c AS v FROM z JOIN pb USING (plate, f) JOIN pg USING (f)), t AS (SELECT treatment, f, median(v) AS v, count(*) AS n FROM x GROUP BY ALL)
SELECT treatment, n AS n_replicates, round(max(v) FILTER (f = 0), 5) AS a, round(max(v) FILTER (f = 1), 5) AS b, round(max(v) FILTER (f = 2), 5) AS c FROM t GROUP BY treatment, n"""


@query(CURATED)
def i32_curation(spark, sf):
    """The whole curation on unique wells (repeated positions averaged); the correlation filter drops the feature made of two others."""
    li = table(spark, sf, "lineitem")
    unique = li.groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k")).agg(
        F.min("l_suppkey").alias("plate"), F.min("l_partkey").alias("treatment"), F.min("l_quantity").alias("cells"), *[F.avg(c).alias(c) for c in FEATURES if c != "l_discount"]
    )
    unique = unique.withColumn("mixed", F.col("l_quantity") / 2 + F.col("l_tax"))
    # the wells' norms allow few cells here, so the least count is lowered with a scaled column
    out, _ = pipelines.curate(unique.withColumn("cells", F.col("cells") * 10), "k", "plate", "treatment", ["l_quantity", "l_extendedprice", "l_tax", "mixed"], "cells", correlation=0.9)
    return out.select("treatment", "n_replicates", *[F.round(F.col("features")[i], 5).alias(n) for i, n in enumerate("abc")])


_WELLS = CURATED.replace("min(l_suppkey) AS plate, min(l_partkey) AS treatment", "min(l_suppkey) % 16 AS plate, min(p_brand || CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END) AS treatment").replace(
    "FROM lineitem GROUP BY 1)", "FROM (SELECT *, min(l_partkey) OVER (PARTITION BY l_orderkey, l_linenumber) AS k FROM lineitem) JOIN part ON k = p_partkey GROUP BY 1)"
)
_HEAD = _WELLS.rsplit("SELECT treatment, n AS", 1)[0]
COVERED = (
    f"{_HEAD}, vec AS (SELECT treatment AS vec_id, any_value(n) AS n, list(v ORDER BY f) AS x FROM t GROUP BY treatment), "
    + picks_sql("SELECT vec_id, x, -list_distance(x, (SELECT list_transform(range(1, 4), lambda i: list_avg(list_transform(list(x), lambda y: y[i]))) FROM vec)) AS u FROM vec", "u", "d", 8)
)
_AT = COVERED.rindex(" SELECT 1 AS rank")
COVERED = COVERED[:_AT] + ", picks AS (" + COVERED[_AT:] + ") SELECT rank, treatment, n_replicates, a, b, c FROM picks JOIN (SELECT vec_id AS treatment, vec_id, n AS n_replicates, round(x[1], 5) AS a, round(x[2], 5) AS b, round(x[3], 5) AS c FROM vec) USING (vec_id)"


def _training_set(spark, sf):
    """Plates in files, of wells whose repeated positions are averaged; symbols come from a metadata table."""
    root = folder(spark, "plates")
    wells = table(spark, sf, "lineitem").groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("Metadata_Well")).agg(
        (F.min("l_suppkey") % 16).alias("Metadata_Plate"), F.min("l_partkey").alias("Metadata_JCP2022"), (F.min("l_quantity") * 10).alias("Metadata_Count_Cells"),
        F.avg("l_quantity").alias("Cells_AreaShape_Q"), F.avg("l_extendedprice").alias("Cells_Intensity_P"), F.avg("l_tax").alias("Nuclei_Texture_T"),
    )
    wells = wells.withColumn("Nuclei_Granularity_M", F.col("Cells_AreaShape_Q") / 2 + F.col("Nuclei_Texture_T"))
    wells.withColumn("plate", F.col("Metadata_Plate")).repartition("plate").write.partitionBy("plate").parquet(root)
    symbol = F.concat("p_brand", F.when(F.col("p_size") % 2 == 0, "+").otherwise("-"))
    symbols = table(spark, sf, "part").select(F.col("p_partkey").alias("Metadata_JCP2022"), symbol.alias("Metadata_Symbol"), F.col("p_partkey").alias("ordinal"))
    plates = [f"{root}/plate={p}" for p in range(16)] + [f"{root}/plate=99"]
    return pipelines.training_set(
        spark, plates, [(symbols, [["Metadata_JCP2022"]], "ordinal")], "Metadata_Well", "Metadata_Plate", "Metadata_Symbol", "Metadata_Count_Cells", sample=8, correlation=0.9
    )


@query(COVERED)
def i32_training_set(spark, sf):
    """From plate files to sampled treatments: load, enrich, QC, features, normalisation, correction, aggregation, coverage."""
    out, kept, skipped, _ = _training_set(spark, sf)
    assert len(skipped) <= 16 and kept == ["Cells_AreaShape_Q", "Cells_Intensity_P", "Nuclei_Texture_T"]
    return out.select("rank", F.col("Metadata_Symbol").alias("treatment"), "n_replicates", *[F.round(F.col("features")[i], 5).alias(n) for i, n in enumerate("abc")])


@query(f"""{_HEAD}, c AS (SELECT (SELECT count(*) FROM u) AS n, (SELECT count(*) FROM good) AS g, (SELECT count(DISTINCT treatment) FROM t) AS t)
SELECT unnest([1, 2, 3, 4, 5, 6]) AS step, unnest(['loaded', 'merged', 'quality', 'features', 'treatments', 'sampled']) AS name, unnest([n, n, g, g, t, least(t, 8)]) AS rows, unnest([4, 4, 4, 3, 3, 3]) AS features FROM c""")
def d28_curation_report(spark, sf):
    """Rows and features after each step of the same job."""
    return _training_set(spark, sf)[3]


@query("""SELECT l_suppkey, l_linenumber, median(l_quantity) AS "Cells_AreaShape_Q", median(l_extendedprice) AS "Nuclei_Intensity_P", count(*) AS cell_count, l_suppkey || '_' || l_linenumber AS sample_id, count(*) >= 80 AS qc_passed
 FROM lineitem GROUP BY 1, 2""")
def i33_cell_pipeline(spark, sf):
    copy = (F.col("l_quantity") * 3 + F.col("l_tax")).alias("Cells_AreaShape_Copy")  # goes by the correlation filter
    cells = table(spark, sf, "lineitem").select("l_suppkey", "l_linenumber", copy, F.col("l_quantity").alias("Cells_AreaShape_Q"), F.col("l_extendedprice").alias("Nuclei_Intensity_P"), F.lit(1.0).alias("Cells_Texture_Constant"))
    return pipelines.process_cells(cells, ["l_suppkey", "l_linenumber"], correlation=0.9, least=80)
