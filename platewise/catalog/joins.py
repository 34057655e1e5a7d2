"""Joins, sets by key, matching, as-of."""

from __future__ import annotations

from pyspark.sql import functions as F

from platewise.catalog.base import VEC, query, rounded, table, vectors
from platewise.functions import vectors as V
from platewise.operators import aggregates as A
from platewise.operators import joins as J


@query("""WITH p AS (SELECT p_partkey, p_brand, p_size, row_number() OVER (PARTITION BY p_partkey ORDER BY p_name) AS rn FROM part)
SELECT l_orderkey, l_linenumber, l_partkey, p_brand, p_size FROM lineitem LEFT JOIN (SELECT * FROM p WHERE rn = 1) ON l_partkey = p_partkey""")
def c01_metadata_join(spark, sf):
    left = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    right = table(spark, sf, "part").select("p_partkey", "p_brand", "p_size", "p_name")
    return J.metadata_join(left, right, [["source", "plate", "well"], [("l_partkey", "p_partkey")]], "p_name")


@query("""SELECT l_orderkey, l_linenumber, s_name, n_name, r_name FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def c02_enrich(spark, sf):
    left = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    steps = [
        (table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey", F.lit(0).alias("o")), [[("l_suppkey", "s_suppkey")]], "o"),
        (table(spark, sf, "nation").withColumn("o", F.lit(0)), [[("s_nationkey", "n_nationkey")]], "o"),
        (table(spark, sf, "region").withColumn("o", F.lit(0)), [[("n_regionkey", "r_regionkey")]], "o"),
    ]
    return J.enrich(left, steps).select("l_orderkey", "l_linenumber", "s_name", "n_name", "r_name")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(*) >= 35)")
def c03_with_replicates(spark, sf):
    return J.with_replicates(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_partkey"], 35)


@query("""WITH pr AS (SELECT substr(sha256(text), 1, 16) AS hash, lang || '-' || (n_chars // 100) AS name, doc_id AS ordinal FROM documents),
ph AS (SELECT event_id, CASE WHEN event_type = 'click' THEN 'en-' || user_id ELSE substr(sha256(user_id::VARCHAR), 1, 16) END AS protein_id FROM events WHERE coalesce(value, 0) = 0 OR value >= 20),
h AS (SELECT DISTINCT hash FROM pr), n AS (SELECT name, arg_max(hash, ordinal) AS hash FROM pr GROUP BY name)
SELECT event_id, protein_id, coalesce(h.hash, n.hash) AS hash FROM ph LEFT JOIN h ON h.hash = protein_id LEFT JOIN n ON n.name = protein_id""")
def c04_match_proteins(spark, sf):
    docs = table(spark, sf, "documents")
    name = F.concat("lang", F.lit("-"), F.floor(F.col("n_chars") / 100).cast("string"))
    proteins = docs.select(F.substring(F.sha2("text", 256), 1, 16).alias("hash"), name.alias("name"), F.col("doc_id").alias("ordinal"))
    pid = F.when(F.col("event_type") == "click", F.concat(F.lit("en-"), F.col("user_id").cast("string"))).otherwise(F.substring(F.sha2(F.col("user_id").cast("string"), 256), 1, 16))
    rows = table(spark, sf, "events").select("event_id", pid.alias("protein_id"), "value")
    return J.match_proteins(rows, proteins, count="value", least=20).select("event_id", "protein_id", "hash")


@query(f"""WITH {VEC}, m AS (SELECT p_partkey AS gene, p_size::BIGINT AS mapped FROM part WHERE p_size > 10) SELECT l_orderkey, l_linenumber, coalesce(mapped, l_partkey) AS embedding_key, label FROM lineitem LEFT JOIN m ON l_partkey = gene
JOIN vec ON vec_id = coalesce(mapped, l_partkey)""")
def c06_c07_join_embeddings(spark, sf):
    left = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    mapping = table(spark, sf, "part").filter("p_size > 10").select(F.col("p_partkey").alias("gene"), F.col("p_size").cast("long").alias("mapped"))
    return J.join_embeddings(left, vectors(spark, sf).select(F.col("vec_id").alias("id"), "label"), "l_partkey", mapping).drop("l_partkey")


@query(f"""WITH {VEC}, g AS (SELECT l_partkey, round(avg(l_tax), 8) AS tax, count(*) AS n_wells FROM lineitem GROUP BY l_partkey) SELECT l_partkey, round(tax, 6) AS tax, n_wells, round(x[1], 6) AS first FROM g JOIN vec ON vec_id = l_partkey""")
def c06_mean_per_gene(spark, sf):
    """One row a gene: mean of its wells, and its embedding."""
    joined = J.join_embeddings(table(spark, sf, "lineitem").select("l_partkey", "l_tax"), vectors(spark, sf).select(F.col("vec_id").alias("id"), "x"), "l_partkey")
    out = J.mean_per_gene(joined, "l_partkey", ["l_tax"], "x")
    return out.select("l_partkey", F.round(F.round("l_tax", 8), 6).alias("tax"), "n_wells", F.round(F.col("x")[0], 6).alias("first"))


@query("SELECT count(*) FILTER (vec_id IS NOT NULL) AS n_matched, count(*) FILTER (vec_id IS NULL) AS n_dropped, count(vec_id) AS n_rows FROM documents LEFT JOIN embeddings ON vec_id = doc_id")
def c08_match_pool(spark, sf):
    """How many candidates have an embedding and how many are dropped."""
    rows, counts = J.match_pool(table(spark, sf, "documents").select("doc_id"), vectors(spark, sf).select(F.col("vec_id").alias("doc_id"), "x"), "doc_id")
    return counts.crossJoin(rows.agg(F.count(F.lit(1)).alias("n_rows")))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey IS NOT NULL)")
def c08_c10_c11_unmatched(spark, sf):
    done = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return J.unmatched(table(spark, sf, "customer").select("c_custkey", "c_name"), done, "c_custkey")


@query("SELECT d.doc_id, toxic, toxic IS NOT NULL AS toxic_mask FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def c09_add_task(spark, sf):
    return J.add_task(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id", "toxic")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#13')")
def c12_restrict(spark, sf):
    ids = table(spark, sf, "part").filter("p_brand = 'Brand#13'").select(F.col("p_partkey").alias("l_partkey"))
    return J.restrict(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ids, "l_partkey")


@query("""WITH f AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), p AS (SELECT user_id, ts, value FROM events WHERE event_type = 'click' AND value IS NOT NULL),
j AS (SELECT f.event_id, p.value, row_number() OVER (PARTITION BY f.event_id ORDER BY p.ts DESC, p.value DESC) AS rn FROM f JOIN p ON p.user_id = f.user_id AND p.ts <= f.ts)
SELECT f.event_id, f.user_id, j.value AS prediction FROM f LEFT JOIN j ON f.event_id = j.event_id AND rn = 1""")
def c13_as_of(spark, sf):
    e = table(spark, sf, "events")
    left = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.filter("event_type = 'click'").select("user_id", "ts", "value")
    return J.as_of(left, right, "user_id", "ts", "value", "prediction").select("event_id", "user_id", "prediction")


@query("SELECT lang, toxic, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL")
def c16_overlap_counts(spark, sf):
    return J.overlap_counts(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", "lang", "toxic")


@query("""WITH m AS (SELECT l_linestatus AS version, l_returnflag AS metric, round(avg(l_tax), 8) AS v FROM lineitem GROUP BY ALL), a AS (SELECT metric, v AS a FROM m WHERE version = 'F'), b AS (SELECT metric, v AS b FROM m WHERE version = 'O')
SELECT metric, round(a, 6) AS a, round(b, 6) AS b, round(b - a, 6) AS delta, round(CASE WHEN a = 0 THEN NULL ELSE (b - a) / abs(a) END, 6) AS relative FROM a FULL JOIN b USING (metric)""")
def c18_compare_metrics(spark, sf):
    per = table(spark, sf, "lineitem").groupBy("l_linestatus", "l_returnflag").agg(F.round(F.avg("l_tax"), 8).alias("v"))
    maps = per.groupBy("l_linestatus").agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", "v"))).alias("metrics"))
    return rounded(J.compare_metrics(maps.filter("l_linestatus = 'F'"), maps.filter("l_linestatus = 'O'")), "a", "b", "delta", "relative")


@query("SELECT doc_id AS i, CASE WHEN n_chars % 3 > 0 THEN lang END AS a, source AS b FROM documents")
def c19_zip_rows(spark, sf):
    """Rows by position; a third of the left values are null."""
    docs = table(spark, sf, "documents")
    left = F.when(F.col("n_chars") % 3 > 0, F.col("lang"))
    return J.zip_rows(docs.select(F.col("doc_id").alias("i"), left.alias("a")), docs.select(F.col("doc_id").alias("i"), F.col("source").alias("b")), "i")


@query("SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text")
def e05_first_per_key(spark, sf):
    return J.first_per_key(table(spark, sf, "documents").select("text", "doc_id"), ["text"], "doc_id")


@query("SELECT text, max(doc_id) AS doc_id FROM documents GROUP BY text")
def e05_last_per_key(spark, sf):
    return J.first_per_key(table(spark, sf, "documents").select("text", "doc_id"), ["text"], "doc_id", "last")


@query("SELECT DISTINCT lang, source FROM documents")
def g04_distinct(spark, sf):
    return table(spark, sf, "documents").select("lang", "source").distinct()


@query("SELECT c_nationkey FROM customer EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey > 2")
def g06_difference(spark, sf):
    left = table(spark, sf, "customer").select("c_nationkey").distinct()
    right = table(spark, sf, "nation").filter("n_regionkey > 2").select(F.col("n_nationkey").alias("c_nationkey"))
    return J.unmatched(left, right, "c_nationkey")


@query("SELECT c_custkey, 'k' || (dense_rank() OVER (ORDER BY f, c_mktsegment) - 1) AS code FROM (SELECT c_custkey, c_mktsegment, min(c_custkey) OVER (PARTITION BY c_mktsegment) AS f FROM customer)")
def h41_label_codes(spark, sf):
    out = V.label_codes(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey")
    return out.select("c_custkey", F.concat(F.lit("k"), F.col("code").cast("string")).alias("code"))


@query("""SELECT version, stage FROM (SELECT p_brand AS version, max(p_size) AS best, min(p_type) AS stage FROM part GROUP BY p_brand) ORDER BY best DESC, version LIMIT 1""")
def f07_best_version(spark, sf):
    per = table(spark, sf, "part").groupBy(F.col("p_brand").alias("version")).agg(F.max("p_size").cast("double").alias("m"), F.min("p_type").alias("stage"))
    versions = per.select("version", "stage", F.create_map(F.lit("size"), F.col("m")).alias("metrics"), F.array(F.lit("x")).alias("tags"))
    return A.best_version(versions, "size", tags=["x"]).select("version", "stage")
