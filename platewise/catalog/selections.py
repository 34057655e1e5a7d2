"""Selection, uncertainty, splits, scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from platewise.catalog.base import VEC, picks_sql, query, rounded, table, uniform_sql, vectors
from platewise.functions import vectors as V
from platewise.operators import joins as J
from platewise.operators import scoring as X
from platewise.operators import selection as L
from platewise.operators import splits as P

MEMBERS = VEC + """, mem AS (SELECT a.vec_id AS sample, k AS member, unnest(range(64)) AS f, unnest(b.x) AS value FROM vec a, range(3) r(k) JOIN vec b ON b.vec_id = a.vec_id + k)"""


def members(spark, sf):
    """Three members: each vector and the two after it."""
    v = vectors(spark, sf)
    out = None
    for k in range(3):
        row = v.select((F.col("vec_id") - k).alias("sample"), F.lit(k).alias("member"), F.posexplode("x").alias("f", "value"))
        out = row if out is None else out.unionByName(row)
    known = v.select(F.col("vec_id").alias("sample"))
    return J.restrict(out, known, "sample")


def _complete(long):
    """Samples with all members."""
    full = long.filter("f = 0").groupBy("sample").agg(F.count(F.lit(1)).alias("n")).filter("n = 3")
    return J.restrict(long, full, "sample")


@query(f"""WITH {VEC}, mem AS (SELECT a.vec_id AS sample, unnest(range(64)) AS f, unnest(a.x) AS x0, unnest(b.x) AS x1, unnest(c.x) AS x2 FROM vec a JOIN vec b ON b.vec_id = a.vec_id + 1 JOIN vec c ON c.vec_id = a.vec_id + 2),
s AS (SELECT sample, f, (x0 + x1 + x2) / 3 AS m, list_stddev_pop([x0, x1, x2]) AS s FROM mem) SELECT sample, round(avg(m), 6) AS mean, round(avg(s), 6) AS std FROM s GROUP BY sample""")
def i19_member_uncertainty(spark, sf):
    per = L.aggregate_members(_complete(members(spark, sf)))
    return per.groupBy("sample").agg(F.round(F.avg("mean"), 6).alias("mean"), F.round(F.avg("std"), 6).alias("std"))


@query(f"""WITH {VEC}, mem AS (SELECT a.vec_id AS sample, unnest(range(64)) AS f, unnest(a.x) AS x0, unnest(b.x) AS x1, unnest(c.x) AS x2 FROM vec a JOIN vec b ON b.vec_id = a.vec_id + 1 JOIN vec c ON c.vec_id = a.vec_id + 2),
s AS (SELECT sample, sqrt(list_var_pop([x0, x1, x2]) + exp((x0 + x1 + x2) / 3)) AS t FROM mem) SELECT sample, round(avg(t), 6) AS total FROM s GROUP BY sample""")
def i20_heteroscedastic(spark, sf):
    per = L.heteroscedastic(_complete(members(spark, sf)).withColumn("log_variance", F.col("value")))
    return per.groupBy("sample").agg(F.round(F.avg("total"), 6).alias("total"))


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer")
def e04_rank(spark, sf):
    return L.rank(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey").select("c_custkey", "rank")


@query("SELECT c_custkey, round((c_acctbal - (SELECT min(c_acctbal) FROM customer)) / ((SELECT max(c_acctbal) - min(c_acctbal) FROM customer) + 1e-8), 8) AS scaled FROM customer")
def e09_min_max(spark, sf):
    return rounded(L.min_max(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "scaled"), "scaled", digits=8).drop("c_acctbal")


@query("SELECT p_partkey, p_retailprice, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part WHERE p_brand <> 'Brand#13' ORDER BY rank LIMIT 25")
def f01_f02_i21_select_next(spark, sf):
    part = table(spark, sf, "part")
    out = L.select_next(part.select("p_partkey", "p_retailprice"), "p_partkey", "p_retailprice", 25, part.filter("p_brand = 'Brand#13'"))
    return out.select("p_partkey", "p_retailprice", "rank")


@query("""SELECT (ntile)::INT AS round, count(*) AS n, round(avg(p_retailprice), 4) AS mean, min(p_retailprice) AS lowest, max(p_retailprice) AS highest FROM (SELECT p_size // 10 AS ntile, p_retailprice FROM part) GROUP BY 1""")
def i22_selection_summary(spark, sf):
    rows = table(spark, sf, "part").select(F.floor(F.col("p_size") / 10).cast("int").alias("round"), "p_retailprice")
    return rounded(L.selection_summary(rows, "p_retailprice"), "mean", digits=4)


@query("""WITH s AS (SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 40), k AS (SELECT p_partkey FROM part WHERE p_size <= 10) SELECT p_partkey, 'labelled' AS side FROM k
UNION ALL SELECT p_partkey, 'labelled' FROM part WHERE p_size > 10 AND p_partkey IN (SELECT * FROM s) UNION ALL SELECT p_partkey, 'pool' FROM part WHERE p_size > 10 AND p_partkey NOT IN (SELECT * FROM s)""")
def i23_next_round(spark, sf):
    part = table(spark, sf, "part")
    best = part.orderBy(F.col("p_retailprice").desc(), "p_partkey").limit(40)
    a, b = L.next_round(part.filter("p_size <= 10").select("p_partkey"), part.filter("p_size > 10").select("p_partkey"), best, "p_partkey")
    return a.withColumn("side", F.lit("labelled")).unionByName(b.withColumn("side", F.lit("pool")))


CENTRE = "(SELECT list_transform(range(1, 65), lambda i: list_avg(list_transform(list(x), lambda y: y[i]))) FROM vec)"
U = "(x[1] - (SELECT min(x[1]) FROM vec)) / ((SELECT max(x[1]) - min(x[1]) FROM vec) + 1e-8)"


@query(f"WITH {VEC}, " + picks_sql(f"SELECT vec_id, x, -list_distance(x, {CENTRE}) AS u FROM vec", "u", "d", 6))
def i09_farthest_points(spark, sf):
    return L.farthest_points(vectors(spark, sf), "vec_id", "x", 6)


@query(f"WITH {VEC}, " + picks_sql(f"SELECT vec_id, x, {U} AS u FROM vec", "u", "0.7 * u + 0.3 * (d - lo) / (hi - lo + 1e-8)", 6))
def i14_hybrid(spark, sf):
    return L.hybrid(vectors(spark, sf).withColumn("u", F.col("x")[0]), "vec_id", "x", "u", 6)


@query(f"WITH {VEC}, " + picks_sql("SELECT vec_id, x, x[1] AS u FROM vec", "d", "d", 6, "d * (1 - 0.5 * exp(-dist))", "u"))
def i15_batch_greedy(spark, sf):
    return L.batch_greedy(vectors(spark, sf).withColumn("s", F.col("x")[0]), "vec_id", "x", "s", 6)


@query(f"WITH {VEC}, " + picks_sql("SELECT vec_id, x, 0.0 AS u FROM vec", "-" + uniform_sql("vec_id", "5"), "ln(1.0 - " + uniform_sql("vec_id", "5", "{k}") + ") / (d * d + 1e-300)", 6))
def i10_kmeans_pp(spark, sf):
    return L.kmeans_pp(vectors(spark, sf), "vec_id", "x", 6, 5)


def _parallel_sql(k: int, rounds: int, times: float) -> str:
    """Rounds of draws by the distance to those drawn before, counts to the nearest, and weighted picks."""
    parts = [f"g0 AS MATERIALIZED (SELECT vec_id, x, 0 AS r FROM vec ORDER BY {uniform_sql('vec_id', '5')}, vec_id LIMIT 1)"]
    for r in range(1, rounds + 1):
        parts.append(f"d{r} AS MATERIALIZED (SELECT v.vec_id, v.x, min(list_distance(v.x, c.x)) AS d FROM vec v, g{r - 1} c GROUP BY v.vec_id, v.x)")
        parts.append(f"g{r} AS MATERIALIZED (SELECT * FROM g{r - 1} UNION ALL SELECT vec_id, x, {r} FROM d{r} WHERE {uniform_sql('vec_id', '5', str(r))} < {times * k} / (SELECT sum(d * d) FROM d{r}) * d * d)")
    parts.append(f"near AS (SELECT v.vec_id, arg_min(c.vec_id, list_distance(v.x, c.x)) AS c FROM vec v, g{rounds} c GROUP BY v.vec_id)")
    parts.append(f"pool AS (SELECT vec_id, x, (SELECT count(*) FROM near WHERE c = p.vec_id)::DOUBLE AS u FROM g{rounds} p)")
    race = "ln(1.0 - " + uniform_sql("vec_id", "5", "{k}", "'pick'") + ") / (u * least(d * d, 1e300) + 1e-300)"
    return ", ".join(parts) + ", " + picks_sql("SELECT vec_id, x, u FROM pool", "ln(1.0 - " + uniform_sql("vec_id", "5", "0", "'pick'") + ") / (u + 1e-300)", race, k)


@query(f"WITH {VEC}, {_parallel_sql(6, 3, 2.0)}")
def i10_kmeans_parallel(spark, sf):
    """k-means|| from the same seeded hashes."""
    return L.kmeans_parallel(vectors(spark, sf), "vec_id", "x", 6, 5, rounds=3)


@query(f"WITH {VEC}, " + picks_sql("SELECT vec_id, x, 0.0 AS u FROM vec", "-" + uniform_sql("vec_id", "5"), "d", 6))
def i11_i18_max_min(spark, sf):
    return L.max_min(vectors(spark, sf), "vec_id", "x", 6, 5)


def _dpp_sql(n: int, gamma: float) -> str:
    """Each round adds e = (kernel - c.c') / sqrt(v') to every candidate's column c and takes e^2 from its v."""
    parts = ["s0 AS MATERIALIZED (SELECT vec_id, x, [0.0::DOUBLE] AS c, 1.0::DOUBLE AS v FROM vec)"]
    for k in range(n):
        parts.append(f"p{k + 1} AS MATERIALIZED (SELECT * FROM s{k} ORDER BY v DESC, vec_id LIMIT 1)")
        e = f"(exp(-{gamma} * list_distance(s.x, p.x) ** 2) - list_inner_product(s.c, p.c)) / sqrt(p.v)"
        parts.append(f"s{k + 1} AS MATERIALIZED (SELECT vec_id, x, list_append(c, e) AS c, v - e * e AS v FROM (SELECT s.*, {e} AS e FROM s{k} s, p{k + 1} p WHERE s.vec_id <> p.vec_id))")
    return ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT {k} AS rank, vec_id FROM p{k}" for k in range(1, n + 1))


@query(f"WITH {VEC}, {_dpp_sql(6, 0.05)}")
def i12_dpp(spark, sf):
    return L.dpp(vectors(spark, sf), "vec_id", "x", 6, 0.05)


@query(f"SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice / 100.0 - ln(-ln(greatest({uniform_sql('p_partkey', '3')}, 1e-12))) DESC, p_partkey LIMIT 20")
def i16_stochastic(spark, sf):
    return L.stochastic(table(spark, sf, "part").select("p_partkey", "p_retailprice"), "p_partkey", "p_retailprice", 20, 3, 100.0)


SCORES = f"""WITH {VEC}, m AS (SELECT vec_id AS sample, list_avg(x) AS mean, list_max(x) AS std FROM vec), g AS (SELECT *, mean - ((SELECT max(mean) FROM m) + 0.01) AS gain FROM m), z AS (SELECT *, gain / (std + 1e-8) AS z FROM g),
t AS (SELECT *, 1.0 / (1.0 + 0.3275911 * abs(z) / sqrt(2)) AS t FROM z), e AS (SELECT *, 1.0 - t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-z * z / 2) AS erf FROM t),
c AS (SELECT *, CASE WHEN z >= 0 THEN 0.5 * (1 + erf) ELSE 0.5 * (1 - erf) END AS cdf FROM e)
SELECT sample, round(std, 6) AS uncertainty, round(gain * cdf + std * exp(-z * z / 2) / sqrt(2 * pi()), 6) AS ei, round(cdf, 6) AS pi, round({uniform_sql("sample", "0")}, 6) AS random, round(mean + 2 * std, 6) AS upper FROM c"""


@query(SCORES)
def i17_scores(spark, sf):
    """Every kind of score of all rows, and one of a user's own (K4)."""
    rows = vectors(spark, sf).select(F.col("vec_id").alias("sample"), V.reduce_vector(F.col("x")).alias("mean"), F.array_max("x").alias("std"))
    kinds = {"uncertainty": "uncertainty", "ei": "ei", "pi": "pi", "random": "random", "upper": lambda mean, std, key: mean + 2 * std}
    for name, kind in kinds.items():
        rows = L.scores(rows, kind).withColumn(name, F.round("score", 6)).drop("score")
    return rows.select("sample", *kinds)


@query("""WITH s AS (SELECT p_partkey FROM part WHERE p_size > 10 ORDER BY p_retailprice DESC, p_partkey LIMIT 40) SELECT p_partkey, 'labelled' AS side, p_size AS label FROM part WHERE p_size <= 10 OR p_partkey IN (SELECT * FROM s)
UNION ALL SELECT p_partkey, 'pool', NULL FROM part WHERE p_size > 10 AND p_partkey NOT IN (SELECT * FROM s)""")
def k05_label_oracle(spark, sf):
    """A round in which a table of measurements plays the oracle."""
    part = table(spark, sf, "part")
    oracle = lambda ids: part.select("p_partkey", F.col("p_size").alias("label"))
    labelled = part.filter("p_size <= 10").select("p_partkey", F.col("p_size").alias("label"))
    a, b = L.active_round(labelled, part.filter("p_size > 10").select("p_partkey", "p_retailprice"), "p_partkey", "p_retailprice", 40, oracle)
    return a.withColumn("side", F.lit("labelled")).unionByName(b.select("p_partkey", F.lit(None).cast(labelled.schema["label"].dataType).alias("label"), F.lit("pool").alias("side")))


@query("SELECT doc_id, upper(lang) AS lang, n_chars * 2 AS n_chars FROM documents")
def k02_transforms(spark, sf):
    """A table through two functions of a user's."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return X.transformed(docs, lambda d: d.withColumn("lang", F.upper("lang")), lambda d: d.withColumn("n_chars", F.col("n_chars") * 2))


@query(f"""WITH {VEC}, d AS (SELECT a.label, avg(list_distance(a.x, b.x)) AS d FROM vec a JOIN vec b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY a.label)
SELECT label, round(avg(x[1]), 6) AS mean, round(stddev_pop(x[1]), 6) AS std, count(DISTINCT vec_id % 5) AS clusters, round(any_value(d), 6) AS distance FROM vec LEFT JOIN d USING (label) GROUP BY label""")
def d45_strategy_report(spark, sf):
    rows = vectors(spark, sf).withColumn("u", F.col("x")[0]).withColumn("cluster", F.pmod("vec_id", F.lit(5)))
    return rounded(L.strategy_report(rows, "label", "vec_id", "x", "u", "cluster"), "mean", "std", "distance")


_HASH = "('0x' || substr(sha256('42|' || {k}), 1, 13))::BIGINT"


@query(f"""WITH r AS (SELECT p_partkey, row_number() OVER (ORDER BY {_HASH.format(k='p_partkey')} DESC, p_partkey) AS r, count(*) OVER () AS n FROM part)
SELECT p_partkey, CASE WHEN r <= floor(n * 0.8) THEN 'train' WHEN r <= floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split FROM r""")
def i24_random_split(spark, sf):
    return P.random_split(table(spark, sf, "part").select("p_partkey"), "p_partkey")


@query(f"""WITH r AS (SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY {_HASH.format(k='p_partkey')} DESC, p_partkey) AS r, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
SELECT p_partkey, CASE WHEN r <= floor(n * 0.8) THEN 'train' WHEN r <= floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split FROM r""")
def i24_stratified_split(spark, sf):
    return P.random_split(table(spark, sf, "part").select("p_partkey", "p_brand"), "p_partkey", stratum="p_brand").drop("p_brand")


@query(f"""WITH g AS (SELECT DISTINCT l_partkey FROM lineitem), r AS (SELECT l_partkey, row_number() OVER (ORDER BY {_HASH.format(k='l_partkey')} DESC, l_partkey) AS r, count(*) OVER () AS n FROM g)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN r <= floor(n * 0.8) THEN 'train' WHEN r <= floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split FROM lineitem JOIN r USING (l_partkey)""")
def i25_group_split(spark, sf):
    return P.group_split(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_partkey")


@query("SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN l_suppkey IN (1, 2, 3) THEN 'train' WHEN l_suppkey IN (3, 4) THEN 'val' ELSE 'test' END AS split FROM lineitem WHERE l_suppkey IN (1, 2, 3, 4, 5)")
def i26_plate_split(spark, sf):
    return P.plate_split(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"), "l_suppkey", [1, 2, 3], [3, 4], [5])


@query("SELECT c_custkey, round((SELECT count(*) FROM customer) / (count(*) OVER (PARTITION BY c_mktsegment) * (SELECT count(DISTINCT c_mktsegment) FROM customer)), 6) AS weight FROM customer")
def i13_balance_weights(spark, sf):
    return rounded(P.balance_weights(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment"), "weight").select("c_custkey", "weight")


@query(f"""WITH s AS (SELECT c_mktsegment, count(*) AS size, row_number() OVER (ORDER BY c_mktsegment) - 1 AS g FROM customer GROUP BY c_mktsegment),
p AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY substr(sha256('42|' || c_custkey), 1, 2), c_custkey) - 1 AS place FROM customer),
d AS (SELECT c_custkey AS draw, floor({uniform_sql("c_custkey", "42")} * (SELECT count(*) FROM s)) AS g, {uniform_sql("c_custkey", "43")} AS u FROM customer)
SELECT draw, s.c_mktsegment, c_custkey FROM d JOIN s USING (g) JOIN p ON p.c_mktsegment = s.c_mktsegment AND p.place = floor(u * size)""")
def i13_balanced_draws(spark, sf):
    return P.balanced_draws(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", "c_mktsegment")


def _mean_model():
    return lambda xs: [[sum(x) / len(x), max(x)] for x in xs]


@query(f"WITH {VEC} SELECT vec_id, round(list_avg(x), 6) AS a, round(list_max(x), 6) AS b, NULL::VARCHAR AS error FROM vec WHERE label <> 1")
def i27_batch_scoring(spark, sf):
    v = vectors(spark, sf)
    out = X.score(v, "vec_id", "x", _mean_model, v.filter("label = 1"))
    return out.select("vec_id", F.round(F.col("prediction")[0], 6).alias("a"), F.round(F.col("prediction")[1], 6).alias("b"), "error")


@query(f"WITH {VEC} SELECT 'head' AS grp, round(avg((abs(list_sum(x[1:4]) / 64) + (list_max(x) - greatest(0.0, list_max(x[5:64])))) / 2), 6) AS importance FROM vec")
def i28_ablation(spark, sf):
    return rounded(X.ablation(vectors(spark, sf), "vec_id", "x", {"head": [0, 1, 2, 3]}, _mean_model), "importance")


@query(f"WITH {VEC}, l AS (SELECT unnest(range(64)) AS f, unnest(x) AS v FROM vec) SELECT f::INT AS f, round(sqrt(sum(v * v)), 6) AS importance FROM l GROUP BY f")
def i29_importance(spark, sf):
    return rounded(X.importance(vectors(spark, sf).select(F.posexplode("x").alias("f", "v")), "l2"), "importance")


@query("SELECT p_partkey, f::INT AS f, round(CASE f WHEN 0 THEN p_size / 2.0 ELSE p_retailprice / 2.0 END, 4) AS shapley FROM part, range(2) r(f)")
def i30_shapley(spark, sf):
    """A linear score, whose Shapley values are its terms."""
    rows = table(spark, sf, "part").select("p_partkey", F.array(F.col("p_size").cast("double"), F.col("p_retailprice")).alias("x"))
    return rounded(X.shapley(rows, "p_partkey", "x", [0.0, 0.0], lambda: lambda xs: [[sum(x) / 2] for x in xs], 4), "shapley", digits=4)


@query("SELECT doc_id FROM documents WHERE n_chars > 1000")
def b14_k1_predicates(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    return X.where(docs, lambda n: n > 1000, "n_chars").select("doc_id")


@query(f"WITH {VEC} SELECT vec_id, round(x[1], 6) AS a, round(x[2], 6) AS b FROM vec WHERE label = 2")
def b15_b22_lookup(spark, sf):
    """Rows by key, with the chosen embedding kind (C5), and with a kind that every row must have."""
    v = vectors(spark, sf).filter("label = 2").withColumn("kinds", F.create_map(F.lit("esm2"), F.col("x")))
    return v.select("vec_id", F.round(V.choose_embedding(F.col("kinds"), ["fused", "esm2"])[0], 6).alias("a"), F.round(V.required_embedding(F.col("kinds"), "esm2")[1], 6).alias("b"))


@query("SELECT doc_id, n_chars FROM documents WHERE n_chars BETWEEN 200 AND 2000")
def b16_length_bounds(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "n_chars").filter(F.col("n_chars").between(200, 2000))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def b21_row_slice(spark, sf):
    ids = table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return J.restrict(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), ids, "l_orderkey")
