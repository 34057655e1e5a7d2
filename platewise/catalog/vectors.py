"""Vectors, predictions, metrics, clustering."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from platewise.catalog.base import PRED, VEC, predictions, query, rounded, table, uniform_sql, vectors
from platewise.functions import sequence as S
from platewise.functions import vectors as V
from platewise.operators import aggregates as A
from platewise.operators import clustering as C
from platewise.operators import linkage as K
from platewise.operators import metrics as M
from platewise.operators import selection as L
from platewise.schema import to_long

N2 = "sqrt(list_sum(list_transform(x, lambda a: a * a)))"


@query(f"WITH {VEC} SELECT vec_id, round(x[1] / ({N2} + 1e-8), 6) AS a, round({N2}, 6) AS n FROM vec")
def h30_l2_normalise(spark, sf):
    return vectors(spark, sf).select("vec_id", F.round(V.l2_normalise(F.col("x"))[0], 6).alias("a"), F.round(V.norm(F.col("x")), 6).alias("n"))


@query(f"WITH {VEC} SELECT vec_id, 128 AS n, round(x[1] / ({N2} + 1e-8) / sqrt(2), 6) AS first, round(x[2] / ({N2} + 1e-8) / sqrt(2), 6) AS second FROM vec")
def h31_fuse_concat(spark, sf):
    kinds = F.create_map(F.lit("a"), F.col("x"), F.lit("b"), F.reverse("x"))
    out = vectors(spark, sf).select("vec_id", V.fuse_concat(kinds, ["b", "a"]).alias("v"))
    return out.select("vec_id", F.size("v").alias("n"), F.round(F.col("v")[0], 6).alias("first"), F.round(F.col("v")[1], 6).alias("second"))


@query(f"WITH {VEC} SELECT vec_id, 64 AS n, round(0.3 * x[1] + 0.7 * x[1], 6) AS first, round(0.3 * x[64], 6) AS last FROM vec")
def h32_h33_fuse_weighted(spark, sf):
    out = vectors(spark, sf).select("vec_id", V.fuse_weighted([F.col("x"), F.slice("x", 1, 10)], [0.3, 0.7]).alias("v"))
    return out.select("vec_id", F.size("v").alias("n"), F.round(F.col("v")[0], 6).alias("first"), F.round(F.col("v")[63], 6).alias("last"))


@query(f"WITH {VEC} SELECT vec_id, round(list_avg(x), 6) AS mean, round(list_sum(x), 6) AS sum, round(list_max(x), 6) AS max FROM vec")
def h34_reduce(spark, sf):
    out = vectors(spark, sf).select("vec_id", *[V.reduce_vector(F.col("x"), h).alias(h) for h in ("mean", "sum", "max")])
    return rounded(out, "mean", "sum", "max")


def _cdf(z):
    x, t = f"(abs({z}) / sqrt(2))", f"(1.0 / (1.0 + 0.3275911 * (abs({z}) / sqrt(2))))"
    erf = f"(1.0 - {t} * (0.254829592 + {t} * (-0.284496736 + {t} * (1.421413741 + {t} * (-1.453152027 + {t} * 1.061405429)))) * exp(-{x} * {x}))"
    return f"(CASE WHEN {z} >= 0 THEN 0.5 * (1 + {erf}) ELSE 0.5 * (1 - {erf}) END)"


SAMPLES = f"{VEC}, sm AS (SELECT vec_id AS sample, list_avg(x) AS mean, list_max(x) AS std FROM vec)"


@query(f"""WITH {SAMPLES}, z AS (SELECT sample, mean - 0.51 AS gain, std, (mean - 0.51) / (std + 1e-8) AS z FROM sm)
SELECT sample, round(gain * {_cdf('z')} + std * exp(-z * z / 2) / sqrt(2 * pi()), 6) AS ei, round({_cdf('z')}, 6) AS pi FROM z""")
def h35_h36_acquisition(spark, sf):
    v = vectors(spark, sf).select(F.col("vec_id").alias("sample"), V.reduce_vector(F.col("x")).alias("mean"), F.array_max("x").alias("std"))
    ei = V.expected_improvement(F.col("mean"), F.col("std"), F.lit(0.5))
    return rounded(v.select("sample", ei.alias("ei"), V.probability_of_improvement(F.col("mean"), F.col("std"), F.lit(0.5)).alias("pi")), "ei", "pi")


@query("SELECT c_custkey, round(exp(c_acctbal / 5000 - (SELECT max(c_acctbal) / 5000 FROM customer)) / (SELECT sum(exp(c_acctbal / 5000 - (SELECT max(c_acctbal) / 5000 FROM customer))) FROM customer), 10) AS weight FROM customer")
def h37_softmax(spark, sf):
    return rounded(V.softmax(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", 5000.0), "weight", digits=10).drop("c_acctbal")


@query(f"WITH {VEC} SELECT vec_id, round((x[1] - 0.1) / (0.5 + 1e-8), 6) AS a FROM vec")
def h38_standardise(spark, sf):
    fill = lambda y: F.transform("x", lambda _: F.lit(y))
    return vectors(spark, sf).select("vec_id", F.round(V.standardise(F.col("x"), fill(0.1), fill(0.5))[0], 6).alias("a"))


@query(f"""WITH {VEC} SELECT vec_id, round(x[1] + 0.1 * sqrt(-2 * ln(1.0 - {uniform_sql("vec_id", "0", "3")})) * cos(2 * pi() * {uniform_sql("vec_id", "0", "4")}), 6) AS noisy,
 len(list_filter(range(64), lambda i: {uniform_sql("vec_id", "i", "3")} < 0.2 OR x[i + 1] = 0))::INT AS zeros FROM vec""")
def h39_augmentation(spark, sf):
    out = vectors(spark, sf).select("vec_id", V.add_noise(F.col("x"), "vec_id", 0.1, 3).alias("noisy"), V.drop_features(F.col("x"), "vec_id", 0.2, 3).alias("dropped"))
    return out.select("vec_id", F.round(F.col("noisy")[0], 6).alias("noisy"), F.size(F.filter("dropped", lambda x: x == 0)).alias("zeros"))


@query("SELECT event_id, coalesce(json_extract_string(props, '$.k'), 'none') AS k FROM events")
def h40_metadata_value(spark, sf):
    m = F.from_json("props", "map<string,string>")
    return table(spark, sf, "events").select("event_id", V.metadata_value(m, "k", "none").alias("k"))


@query(f"WITH {VEC} SELECT vec_id, round(sqrt(exp(list_avg(x))), 6) AS a, round(sqrt(exp(list_avg(x)) + 0.25), 6) AS t FROM vec")
def h42_total_uncertainty(spark, sf):
    a = V.aleatoric(F.col("x"))
    return rounded(vectors(spark, sf).select("vec_id", a.alias("a"), V.total_uncertainty(F.lit(0.5), a).alias("t")), "a", "t")


@query(f"WITH {PRED} SELECT round(avg((pred - target) ** 2), 8) AS mse, round(avg(abs(pred - target)), 8) AS mae, round(sqrt(avg((pred - target) ** 2)), 8) AS rmse, round(1 - sum((pred - target) ** 2) / (var_pop(target) * count(*)), 6) AS r2 FROM pred")
def d35_regression(spark, sf):
    return rounded(rounded(M.regression(predictions(spark, sf)), "mse", "mae", "rmse", digits=8), "r2")


def _corr_sql(keys, by=""):
    return f"SELECT {by + ',' if by else ''} {keys}, CASE WHEN stddev_pop(pred) > 1e-12 AND stddev_pop(target) > 1e-12 THEN corr(pred, target) ELSE 0.0 END AS r FROM pred GROUP BY ALL"


@query(f"WITH {PRED}, s AS ({_corr_sql('sample')}), f AS ({_corr_sql('f')}) SELECT 'sample' AS mode, round(avg(r), 6) AS r FROM s UNION ALL SELECT 'feature', round(avg(r), 6) FROM f UNION ALL SELECT 'global', round(corr(pred, target), 6) FROM pred")
def d36_pearson(spark, sf):
    p, out = predictions(spark, sf), None
    for mode in ("sample", "feature", "global"):
        row = M.pearson(p, mode).select(F.lit(mode).alias("mode"), F.round("pearson", 6).alias("r"))
        out = row if out is None else out.unionByName(row)
    return out


@query(f"""WITH {PRED}, k AS (SELECT sample, rank() OVER (PARTITION BY sample ORDER BY pred) + (count(*) OVER (PARTITION BY sample, pred) - 1) / 2.0 AS pred,
 rank() OVER (PARTITION BY sample ORDER BY target) + (count(*) OVER (PARTITION BY sample, target) - 1) / 2.0 AS target FROM pred), s AS (SELECT sample, corr(pred, target) AS r FROM k GROUP BY sample) SELECT round(avg(r), 6) AS spearman FROM s""")
def d37_spearman(spark, sf):
    return rounded(M.spearman(predictions(spark, sf), "sample"), "spearman")


@query(f"WITH {PRED}, s AS (SELECT sample, sum(pred * target) / greatest(sqrt(sum(pred * pred)) * sqrt(sum(target * target)), 1e-8) AS c FROM pred GROUP BY sample) SELECT round(avg(c), 6) AS cosine FROM s")
def d38_cosine(spark, sf):
    return rounded(M.cosine(predictions(spark, sf)), "cosine")


@query(f"""WITH {PRED} SELECT f::INT AS f, round(avg((pred - target) ** 2), 8) AS mse, round(1 - sum((pred - target) ** 2) / (var_pop(target) * count(*) + 1e-8), 6) AS r2, round(corr(pred, target), 6) AS pearson FROM pred GROUP BY f""")
def d39_per_feature(spark, sf):
    return rounded(rounded(M.per_feature(predictions(spark, sf)), "mse", digits=8), "r2", "pearson")


@query(f"""WITH {PRED}, p AS (SELECT f, avg((pred - target) ** 2) AS mse, 1 - sum((pred - target) ** 2) / (var_pop(target) * count(*) + 1e-8) AS r2, corr(pred, target) AS pearson FROM pred GROUP BY f),
l AS (SELECT 'mse' AS metric, mse AS v FROM p UNION ALL SELECT 'r2', r2 FROM p UNION ALL SELECT 'pearson', pearson FROM p)
SELECT metric, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max, count(*) FILTER (v > 0) AS over_0, count(*) FILTER (v > 0.5) AS over_half FROM l GROUP BY metric""")
def d39_summary(spark, sf):
    return rounded(M.summarise_per_feature(M.per_feature(predictions(spark, sf))), "mean", "median", "std", "min", "max")


@query(f"""WITH {PRED}, t AS (SELECT task, avg((pred - target) ** 2) AS mse, avg(abs(pred - target)) AS mae, sqrt(avg((pred - target) ** 2)) AS rmse, 1 - sum((pred - target) ** 2) / (var_pop(target) * count(*)) AS r2 FROM pred WHERE pred > 0 GROUP BY task)
SELECT task || '_' || m AS metric, round(v, 6) AS value FROM (SELECT task, 'mse' AS m, mse AS v FROM t UNION ALL SELECT task, 'mae', mae FROM t UNION ALL SELECT task, 'rmse', rmse FROM t UNION ALL SELECT task, 'r2', r2 FROM t)""")
def d40_by_task(spark, sf):
    return rounded(M.by_task(predictions(spark, sf).withColumn("mask", F.col("pred") > 0)), "value")


@query(f"""WITH {PRED}, s AS (SELECT sample, corr(pred, target) AS r, sum(pred * target) / greatest(sqrt(sum(pred * pred)) * sqrt(sum(target * target)), 1e-8) AS c FROM pred GROUP BY sample)
SELECT (SELECT round(avg(CASE WHEN abs(pred - target) <= 0.1 THEN 0.5 * (pred - target) ** 2 ELSE 0.1 * (abs(pred - target) - 0.05) END), 8) FROM pred) AS huber, round(1 - avg(r), 6) AS correlation_loss, round(1 - avg(c), 6) AS cosine_loss FROM s""")
def d41_losses(spark, sf):
    return rounded(rounded(M.losses(predictions(spark, sf), 0.1), "huber", digits=8), "correlation_loss", "cosine_loss")


@query(f"WITH {PRED} SELECT round(avg(0.5 * (greatest(-10.0, least(10.0, pred)) + (pred - target) ** 2 / exp(greatest(-10.0, least(10.0, pred))))), 8) AS nll FROM pred")
def d41_gaussian_nll(spark, sf):
    return rounded(M.gaussian_nll(predictions(spark, sf), "pred"), "nll", digits=8)


@query("SELECT round(sum(CASE event_type WHEN 'click' THEN 2.0 ELSE 1.0 END * l), 6) AS loss FROM (SELECT event_type, avg(value) AS l FROM events GROUP BY event_type)")
def d41_multi_task(spark, sf):
    per = table(spark, sf, "events").groupBy(F.col("event_type").alias("task")).agg(F.avg("value").alias("loss"))
    return rounded(M.multi_task(per, {"click": 2.0}), "loss")


@query(f"""WITH {VEC}, l AS (SELECT vec_id, unnest(range(64)) AS f, unnest(x) AS v FROM vec), s AS (SELECT f, greatest(0.0, 1 - sqrt(var_samp(v) + 1e-4)) AS h FROM l GROUP BY f),
c AS (SELECT covar_samp(a.v, b.v) AS c FROM l a JOIN l b USING (vec_id) WHERE a.f < b.f GROUP BY a.f, b.f)
SELECT round(avg(abs(v)), 6) AS l1, round(avg(v * v), 6) AS l2, (SELECT round(avg(h), 6) FROM s) AS variance, (SELECT round(2 * sum(c * c) / 64, 8) FROM c) AS covariance FROM l""")
def d42_latent_regularity(spark, sf):
    out = M.latent_regularity(to_long(vectors(spark, sf).select("vec_id", F.col("x").alias("features")), ["vec_id"]), "vec_id")
    return rounded(rounded(out, "l1", "l2", "variance"), "covariance", digits=8)


@query(f"WITH {PRED} SELECT round(sum((f + 1) * (pred - target) ** 2) / count(*), 6) AS loss FROM pred")
def d48_weighted_reconstruction(spark, sf):
    p = predictions(spark, sf)
    return rounded(M.weighted_reconstruction(p, p.select("f", (F.col("f") + 1.0).alias("weight")).distinct()), "loss")


@query("""WITH h AS (SELECT event_type, event_id, value FROM events), s AS (SELECT event_type, (event_id - lag(event_id) OVER w) * (value + lag(value) OVER w) / 2 AS a FROM h WINDOW w AS (PARTITION BY event_type ORDER BY event_id))
SELECT event_type, round(sum(a), 2) AS area FROM s GROUP BY event_type""")
def d46_learning_area(spark, sf):
    return rounded(M.learning_area(table(spark, sf, "events"), "event_id", "value", ["event_type"]), "area", digits=2)


@query("""SELECT event_id, coalesce(value - lag(value, 2) OVER w < 0.02, false) AS plateau, coalesce(value - lag(value) OVER w < 0.005, false) AS small_step, user_id >= 200 AS large_enough FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id)""")
def e06_stopping(spark, sf):
    return M.stopping(table(spark, sf, "events"), ["event_type"], "event_id", "value", "user_id").select("event_id", "plateau", "small_step", "large_enough")


@query("""WITH p AS (SELECT p_size AS k, count(*) / (SELECT count(*) FROM part) AS s FROM part GROUP BY p_size), c AS (SELECT k, sum(s) OVER (ORDER BY k) AS c FROM p) SELECT min(k) FILTER (c >= 0.9004) AS k_90, min(k) FILTER (c >= 0.9504) AS k_95 FROM c""")
def e07_components_needed(spark, sf):
    n = table(spark, sf, "part")
    per = n.groupBy(F.col("p_size").alias("k")).agg(F.count(F.lit(1)).alias("c")).crossJoin(n.agg(F.count(F.lit(1)).alias("n"))).select("k", (F.col("c") / F.col("n")).alias("s"))
    return M.components_needed(per, "k", "s", (0.9004, 0.9504))


@query(f"WITH {VEC}, l AS (SELECT label AS id, vec_id AS pos, unnest(range(64)) AS f, unnest(x) AS v FROM vec) SELECT id, f::INT AS f, round(avg(v), 6) AS mean, round(max(v), 6) AS max, round(arg_min(v, pos), 6) AS first FROM l GROUP BY id, f")
def d47_pool_tokens(spark, sf):
    out = S.pool_tokens(vectors(spark, sf).select(F.col("label").alias("id"), F.col("vec_id").alias("pos"), F.col("x").alias("vector")))
    long = out.select("id", F.posexplode(F.arrays_zip("mean", "max", "first")).alias("f", "p")).select("id", "f", "p.*")
    return rounded(long, "mean", "max", "first")


@query(f"WITH {VEC}, l AS (SELECT label, unnest(range(64)) AS f, unnest(x) AS v FROM vec) SELECT label, f::INT AS f, count(*) AS n, round(avg(v), 6) AS mean FROM l GROUP BY label, f")
def d43_cluster_profiles(spark, sf):
    return rounded(C.cluster_profiles(vectors(spark, sf), "x", "label"), "mean")


@query(f"""WITH {VEC}, l AS (SELECT vec_id, label, unnest(range(64)) AS f, unnest(x) AS v FROM vec), c AS (SELECT label, f, avg(v) AS c, count(*) AS n FROM l GROUP BY ALL), m AS (SELECT f, avg(v) AS m FROM l GROUP BY f),
b AS (SELECT sum(n * (c - m) ** 2) AS b FROM c JOIN m USING (f)), d AS (SELECT vec_id, label, sqrt(sum((v - c) ** 2)) AS d FROM l JOIN c USING (label, f) GROUP BY ALL), w AS (SELECT sum(d * d) AS w, count(*) AS n, count(DISTINCT label) AS k FROM d),
s AS (SELECT label, avg(d) AS s FROM d GROUP BY label), g AS (SELECT a.label AS i, b.label AS j, sqrt(sum((a.c - b.c) ** 2)) AS d FROM c a JOIN c b ON a.f = b.f AND a.label <> b.label GROUP BY ALL),
r AS (SELECT i, max((x.s + y.s) / d) AS r FROM g JOIN s x ON x.label = i JOIN s y ON y.label = j GROUP BY i) SELECT round((b / (k - 1)) / (w / (n - k)), 6) AS calinski_harabasz, (SELECT round(avg(r), 6) FROM r) AS davies_bouldin FROM b, w""")
def i06_cluster_quality(spark, sf):
    return rounded(C.quality(vectors(spark, sf), "x", "label"), "calinski_harabasz", "davies_bouldin")


@query("""WITH m AS (SELECT doc_id, lang FROM documents), a AS (SELECT lang, toxic, count(*) AS n FROM m JOIN labels USING (doc_id) GROUP BY ALL), s AS (SELECT lang, count(*) AS size FROM m GROUP BY lang), t AS (SELECT toxic, count(*) AS annotated FROM m JOIN labels USING (doc_id) GROUP BY toxic),
x AS (SELECT *, (SELECT count(*) FROM m) AS bg FROM a JOIN s USING (lang) JOIN t USING (toxic)), k AS (SELECT *, unnest(range(greatest(0, size + annotated - bg), least(size, annotated) + 1)) AS k FROM x),
p AS (SELECT *, lgamma(annotated + 1) - lgamma(k + 1) - lgamma(annotated - k + 1) + lgamma(bg - annotated + 1) - lgamma(size - k + 1) - lgamma(bg - annotated - size + k + 1) - lgamma(bg + 1) + lgamma(size + 1) + lgamma(bg - size + 1) AS lp FROM k),
o AS (SELECT lang, toxic, lp AS o FROM p WHERE k = n)
SELECT lang, toxic, any_value(n) AS n, any_value(size) AS size, any_value(annotated) AS annotated, round(any_value(size * annotated / bg), 6) AS expected, round(any_value(n * (bg - size - annotated + n) / ((size - n) * (annotated - n))), 6) AS odds,
 round(least(1.0, sum(exp(lp)) FILTER (lp <= o + 1e-7)), 6) AS p FROM p JOIN o USING (lang, toxic) GROUP BY lang, toxic""")
def i08_enrichment(spark, sf):
    out = C.enrichment(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", "lang", "toxic")
    return rounded(out, "expected", "odds", "p")


@query(f"WITH {VEC} SELECT label, count(*) AS n, round((list_sum(list_transform(range(1, 65), lambda i: list_sum(list_transform(list(x), lambda y: y[i] / sqrt(list_sum(list_transform(y, lambda a: a * a))))) ** 2)) - count(*)) / (count(*) * (count(*) - 1)), 6) AS similarity FROM vec GROUP BY label")
def c15_replicate_similarity(spark, sf):
    return rounded(L.replicate_similarity(vectors(spark, sf), "vec_id", "label", "x"), "similarity")


@query(f"WITH {VEC} SELECT a.vec_id AS a, b.vec_id AS b, round(list_distance(a.x, b.x), 6) AS distance FROM vec a JOIN vec b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0")
def c14_pairwise(spark, sf):
    """Distances of the rows whose id is divisible by 50 to all others."""
    return rounded(L.pairwise(vectors(spark, sf), "vec_id", "x", queries=F.pmod("vec_id", F.lit(50)) == 0), "distance")


@query(f"""WITH {VEC}, l AS (SELECT vec_id, unnest(range(64)) AS f, unnest(x) AS v FROM vec), s AS (SELECT f, avg(v) AS m, stddev_pop(v) AS s FROM l GROUP BY f)
SELECT vec_id, round(sum(((v - m) / s) ** 2), 4) AS length FROM l JOIN s USING (f) GROUP BY vec_id""")
def i01_pca(spark, sf):
    """All components together keep the length of each standardised vector."""
    rows, _, _ = C.pca(vectors(spark, sf), "x", 64)
    return rows.select("vec_id", F.round(F.aggregate("pca", F.lit(0.0), lambda a, x: a + x * x), 4).alias("length"))


@query("SELECT vec_id, 0.0::DOUBLE AS error FROM embeddings")
def i02_pca_inverse(spark, sf):
    """Scores of all components restore the vectors."""
    v = vectors(spark, sf)
    rows, load, _ = C.pca(v, "x", 64)
    stats = v.select(F.posexplode("x").alias("f", "v")).groupBy("f").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("f").toPandas()
    back = C.pca_inverse(rows, "pca", load, stats.m.to_numpy(), stats.s.to_numpy())
    return back.select("vec_id", F.round(L.distance(F.col("x"), F.col("restored")), 6).alias("error"))


#: Prim's order from the first row: cutting it where the next edge is longer than a limit gives the clusters of single linkage.
LINKAGE = f"""WITH RECURSIVE {VEC}, v AS (SELECT vec_id, x, row_number() OVER (ORDER BY vec_id) AS r FROM vec), dist AS (SELECT a.r, list(list_distance(a.x, b.x) ORDER BY b.r) AS ds FROM v a, v b GROUP BY a.r),
prim AS (SELECT 1::BIGINT AS step, 1::BIGINT AS r, 0.0::DOUBLE AS d, list_transform(ds, lambda y, i: CASE WHEN i = 1 THEN NULL ELSE y END) AS near FROM dist WHERE r = 1 UNION ALL
 SELECT step + 1, j, m, list_transform(near, lambda y, i: CASE WHEN y IS NULL OR i = j THEN NULL ELSE least(y, ds[i]) END) FROM (SELECT step, near, list_min(near) AS m, list_position(near, list_min(near)) AS j FROM prim WHERE list_min(near) IS NOT NULL) p JOIN dist ON dist.r = p.j),
limits AS (SELECT 0.95 * max(d) AS share, (SELECT d FROM prim ORDER BY d DESC LIMIT 1 OFFSET 4) AS k FROM prim),
cut AS (SELECT vec_id, count(*) FILTER (d > 1.14) OVER w AS c1, count(*) FILTER (d > k) OVER w AS c2, count(*) FILTER (d > share) OVER w AS c3 FROM prim JOIN v USING (r), limits WINDOW w AS (ORDER BY step))
SELECT vec_id, min(vec_id) OVER (PARTITION BY c1) AS by_distance, min(vec_id) OVER (PARTITION BY c2) AS by_number, min(vec_id) OVER (PARTITION BY c3) AS by_share FROM cut"""


@query(LINKAGE)
def i04_linkage_cuts(spark, sf):
    """One tree of single linkage, cut at a distance, into five clusters, and at 95 % of the largest merge."""
    v = vectors(spark, sf)
    tree = K.linkage_tree(v, "vec_id", "x", 1.1)
    cuts = {"by_distance": {"distance": 1.14}, "by_number": {"k": 5}, "by_share": {"share": 0.95}}
    out = v.select("vec_id")
    for name, cut in cuts.items():
        out = out.join(K.cut_tree(v, "vec_id", tree, **cut).withColumnRenamed("cluster", name), "vec_id")
    return out


@query(f"""WITH {VEC}, s AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum(list_distance(a.x, b.x)) AS t, count(*) AS n FROM vec a, vec b GROUP BY ALL),
m AS (SELECT vec_id, own AS label, max(CASE WHEN own = other AND n > 1 THEN t / (n - 1) END) AS a, min(CASE WHEN own <> other THEN t / n END) AS b, max(CASE WHEN own = other THEN n END) AS n FROM s GROUP BY vec_id, own)
SELECT vec_id, label, round(CASE WHEN n = 1 THEN 0.0 ELSE (b - a) / greatest(a, b) END, 6) AS silhouette FROM m""")
def i06_silhouettes(spark, sf):
    """The plain Euclidean silhouette of every row."""
    return rounded(C.silhouettes(vectors(spark, sf), "vec_id", "x", "label"), "silhouette")


@query("SELECT range::INT AS f, 0.0::DOUBLE AS gap, 0.0::DOUBLE AS mixed FROM range(64)")
def i01_pca_shares(spark, sf):
    """A component's explained share is its scores' share of the variance, and its scores don't go with the next component's."""
    rows, _, share = C.pca(vectors(spark, sf), "x", 64)
    shares = spark.createDataFrame([(i, float(s)) for i, s in enumerate(share)], "f int, share double")
    turned = F.concat(F.slice("pca", 2, 63), F.slice("pca", 1, 1))
    long = rows.select(F.posexplode(F.arrays_zip(F.col("pca").alias("a"), turned.alias("b"))).alias("f", "p")).groupBy("f").agg(F.var_pop("p.a").alias("v"), F.covar_pop("p.a", "p.b").alias("c"))
    out = long.join(shares, "f").select("f", F.abs(F.round(F.col("v") / 64 - F.col("share"), 6)).alias("gap"), F.abs(F.round("c", 6)).alias("mixed"))
    return out


@query("SELECT vec_id, true AS nearest, true AS adds_up FROM embeddings")
def i03_kmeans_nearest(spark, sf):
    """Each row's centre is the nearest one, and the inertia is the sum of the squared distances to them."""
    v, _ = C.standardised(vectors(spark, sf), "x")
    rows, centres, inertia = C.kmeans(vectors(spark, sf), "x", 4)
    table_ = spark.createDataFrame([([[float(y) for y in c] for c in centres],)], "centres array<array<double>>")
    near = rows.join(v.select("vec_id", vector_to_array("scaled").alias("z")), "vec_id").crossJoin(F.broadcast(table_))  # one row
    near = near.withColumn("ds", F.transform("centres", lambda c: L.distance(F.col("z"), c)))
    total = near.agg(F.sum(F.pow(F.get("ds", F.col("cluster")), F.lit(2))).alias("total"))
    out = near.crossJoin(F.broadcast(total))  # one row
    return out.select("vec_id", (F.get("ds", F.col("cluster")) <= F.array_min("ds") + 1e-9).alias("nearest"), (F.abs(F.col("total") / inertia - 1) < 1e-6).alias("adds_up"))


@query("SELECT f::INT AS f, true AS orthogonal FROM range(64) t(f)")
def i31_ridge_residuals(spark, sf):
    """The residuals of the ridge map times each input are the penalty times its coefficient."""
    v = vectors(spark, sf)
    pairs = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")
    beta = C.ridge(pairs, "x", "y")[0]
    got = C.ridge_predict(pairs, "vec_id", "x", [beta]).join(pairs.select("vec_id", F.posexplode("y").alias("f", "y")), ["vec_id", "f"]).join(pairs.select("vec_id", "x"), "vec_id")
    dots = got.select("f", (F.col("y") - F.col("value")).alias("e"), F.posexplode("x").alias("i", "xi")).groupBy("f", "i").agg(F.sum(F.col("e") * F.col("xi")).alias("dot"))
    known = spark.createDataFrame([(f, i, float(beta[i + 1, f])) for f in range(64) for i in range(64)], "f int, i int, b double")
    return dots.join(known, ["f", "i"]).groupBy("f").agg((F.max(F.abs(F.col("dot") - F.col("b"))) < 1e-6).alias("orthogonal"))


@query()
def i03_kmeans(spark, sf):
    return C.kmeans(vectors(spark, sf), "x", 4)[0].select("vec_id", "cluster")


@query()
def i04_bisecting(spark, sf):
    return C.bisecting(vectors(spark, sf), "x", 4).select("vec_id", "cluster")


@query()
def i05_choose_k(spark, sf):
    return spark.createDataFrame([(C.choose_k(vectors(spark, sf), "x", [2, 3, 4]),)], "k int")


@query(f"""WITH {VEC}, u AS (SELECT vec_id, label, list_transform(x, lambda a: a / {N2}) AS u FROM vec), c AS (SELECT label, count(*) AS n, list_transform(range(1, 65), lambda i: list_avg(list_transform(list(u), lambda y: y[i]))) AS m FROM u GROUP BY label),
d AS (SELECT vec_id, u.label AS own, c.label AS other, n, 1 - list_inner_product(u, m) AS d FROM u, c),
s AS (SELECT vec_id, any_value(n) FILTER (own = other) AS n, max(d * n / greatest(n - 1, 1)) FILTER (own = other) AS a, min(d) FILTER (own <> other) AS b FROM d GROUP BY vec_id)
SELECT round(avg(CASE WHEN n = 1 THEN 0.0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM s""")
def i07_latent_silhouette(spark, sf):
    """Cosine silhouette of the labels over all rows."""
    return spark.createDataFrame([(round(C.silhouette(vectors(spark, sf), "x", "label", True), 6),)], "silhouette double")


@query()
def i31_ridge_and_members(spark, sf):
    """A linear map from each vector to the next one, with bootstrap members, and its uncertainty."""
    v = vectors(spark, sf)
    pairs = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")
    members = C.ridge(pairs, "x", "y", members=3, key="vec_id")
    long = C.ridge_predict(v, "vec_id", "x", members).withColumnRenamed("vec_id", "sample")
    return rounded(L.reduce_uncertainty(L.aggregate_members(long)), "uncertainty")


class Worst(M.Metric):
    """The largest absolute error, as a metric of a user's own."""

    def __init__(self):
        self.most = 0.0

    def update(self, pred, target):
        self.most = max(self.most, float(abs(pred - target).max()) if len(pred) else 0.0)

    def merge(self, other):
        self.most = max(self.most, other.most)

    def compute(self):
        return self.most


@query(f"WITH {PRED} SELECT task, 'worst' AS metric, round(max(abs(pred - target)), 6) AS value FROM pred GROUP BY task UNION ALL SELECT task, 'bias', round(avg(pred - target), 6) FROM pred GROUP BY task")
def k03_user_metrics(spark, sf):
    """Two metrics per task: one with states that are merged, one an aggregate."""
    return rounded(M.user_metrics(predictions(spark, sf), {"worst": Worst, "bias": F.avg(F.col("pred") - F.col("target"))}, "task"), "value")


@query(f"""WITH {PRED}, r AS (SELECT f, 1 - sum((pred - target) ** 2) / (var_pop(target) * count(target) + 1e-8) AS r2 FROM pred GROUP BY f)
(SELECT f::INT AS f, 'best' AS side, round(r2, 6) AS r2 FROM r ORDER BY r.r2 DESC, f LIMIT 9) UNION ALL (SELECT f::INT, 'worst', round(r2, 6) FROM r ORDER BY r.r2, f LIMIT 9)""")
def f08_best_and_worst(spark, sf):
    return rounded(A.best_and_worst(M.per_feature(predictions(spark, sf)), "r2", 9, "f").select("f", "side", "r2"), "r2")


@query(f"WITH {VEC}, l AS (SELECT unnest(range(64))::INT AS f, unnest(x) AS v FROM vec) SELECT f, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, (SELECT count(*) FROM vec) AS n_samples, (SELECT count(DISTINCT label) FROM vec) AS n_labels, (SELECT count(DISTINCT vec_id % 7) FROM vec) AS n_plates, 64 AS n_features FROM l GROUP BY f")
def d27_training_statistics(spark, sf):
    rows = vectors(spark, sf).select(F.col("x").alias("features"), "label", F.pmod("vec_id", F.lit(7)).alias("plate"))
    whole, per = A.training_statistics(rows, "label", "plate")
    return rounded(per.crossJoin(F.broadcast(whole)), "mean", "std")
