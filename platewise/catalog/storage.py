"""Round trips through readers and writers."""

from __future__ import annotations

from pyspark.sql import functions as F

from platewise.catalog.base import FEATURES, SEQ, VEC, query, rounded, sequences, table, vectors
from platewise.functions.sequence import is_valid
from platewise.operators import aggregates as A
from platewise.scratch import folder
from platewise.sources import readers as R
from platewise.sources import writers as W


@query("SELECT l_linestatus AS source, l_returnflag AS plate, count(*) AS n, round(sum(l_tax), 4) AS tax FROM lineitem GROUP BY ALL")
def a01_plate_profiles(spark, sf):
    """Plates in the published path layout, with source and plate read from the path."""
    root, li = folder(spark, "plates"), table(spark, sf, "lineitem")
    for s in ("F", "O"):
        for p in ("A", "N", "R"):
            li.filter((F.col("l_linestatus") == s) & (F.col("l_returnflag") == p)).select("l_tax").write.parquet(f"{root}/{s}/workspace/profiles/b1/{p}")
    out = R.plate_profiles(spark, root, ["l_tax"])
    return rounded(out.groupBy("source", "plate").agg(F.count(F.lit(1)).alias("n"), F.sum("l_tax").alias("tax")), "tax", digits=4)


@query("SELECT DISTINCT l_linestatus AS source, 'b1' AS batch, l_returnflag AS plate FROM lineitem")
def a14_inventory(spark, sf):
    root, li = folder(spark, "plates"), table(spark, sf, "lineitem")
    for r in li.select("l_linestatus", "l_returnflag").distinct().collect():
        li.filter((F.col("l_linestatus") == r[0]) & (F.col("l_returnflag") == r[1])).select("l_tax").write.parquet(f"{root}/{r[0]}/workspace/profiles/b1/{r[1]}")
    return R.inventory(spark, root)


@query("SELECT p_partkey::VARCHAR AS \"Metadata_JCP2022\", p_brand AS \"Metadata_Symbol\" FROM part")
def a02_metadata_table(spark, sf):
    root = folder(spark, "metadata")
    rows = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("Metadata_JCP2022"), F.col("p_brand").alias("Metadata_Symbol"))
    rows.write.option("header", True).option("compression", "gzip").csv(f"{root}/orf.csv")
    return R.metadata_table(spark, root, "orf")


@query("""SELECT l_suppkey AS "Metadata_Plate", CASE WHEN l_suppkey % 2 = 1 THEN l_returnflag END AS "Metadata_Flag", l_tax AS "Cells_Intensity_Tax" FROM lineitem""")
def a03_load_plates(spark, sf):
    """All plates, of two schemas, and one that is missing."""
    root, li = folder(spark, "plates"), table(spark, sf, "lineitem").withColumn("plate", F.col("l_suppkey"))
    key, tax = F.col("l_suppkey").alias("Metadata_Plate"), F.col("l_tax").alias("Cells_Intensity_Tax")
    li.filter("l_suppkey % 2 = 1").select("plate", key, F.col("l_returnflag").alias("Metadata_Flag"), tax, F.col("l_quantity").alias("Cells_AreaShape_Q")).repartition("plate").write.partitionBy("plate").parquet(root)
    li.filter("l_suppkey % 2 = 0").select("plate", key, tax).repartition("plate").write.mode("append").partitionBy("plate").parquet(root)
    plates = [r[0] for r in li.select("plate").distinct().collect()]
    out, skipped = R.load_plates(spark, [f"{root}/plate={p}" for p in sorted(plates)] + [f"{root}/missing"])
    assert skipped == [f"{root}/missing"]
    return out


@query("SELECT l_orderkey || '-' || l_linenumber AS sample_id, l_tax AS a, l_quantity AS b FROM lineitem")
def a04_phenotype_csv(spark, sf):
    path = folder(spark, "csv")
    li = table(spark, sf, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("well"), F.col("l_tax").alias("Cells_T"), F.col("l_quantity").alias("Cells_Q"))
    li.write.option("header", True).csv(path)
    out = R.phenotype_csv(spark, path, "well string, Cells_T double, Cells_Q double", id_column="well")
    return out.select("sample_id", F.col("features")[0].alias("a"), F.col("features")[1].alias("b"))


@query(f"WITH {SEQ} SELECT doc_id::VARCHAR AS id, s AS sequence FROM seq WHERE s <> ''")
def a05_a13_fasta(spark, sf):
    """All valid sequences through FASTA and back."""
    path = folder(spark, "fasta")
    rows = sequences(spark, sf).filter(is_valid(F.col("s")))
    W.save_fasta(rows.select(F.col("doc_id").cast("string").alias("name"), "source", F.col("s").alias("sequence")), path)
    good, _ = R.fasta(spark, path)
    return good.select("id", "sequence")


@query(f"WITH {SEQ} SELECT s AS sequence, CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'protein_' || (row_number() OVER (ORDER BY doc_id) - 1) END AS name FROM seq WHERE s <> ''")
def a06_sequence_csv(spark, sf):
    """Every other name is missing and comes from the row's number, over as many files as the sort writes."""
    path = folder(spark, "csv")
    rows = sequences(spark, sf).filter("s <> ''")
    rows.orderBy("doc_id").select(F.col("s").alias("sequence"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("name")).write.option("header", True).csv(path)
    return R.sequence_csv(spark, path).select("sequence", "name")


@query(f"WITH {SEQ} SELECT s AS sequence, lang AS name, doc_id::VARCHAR AS id FROM seq UNION ALL SELECT s, lang, 'whole' FROM seq")
def a07_library_json(spark, sf):
    """All sequences through JSON lines and back, and through library documents of 64 numbers each that are read whole."""
    path, document = folder(spark, "library"), folder(spark, "document")
    rows = sequences(spark, sf).select(F.col("s").alias("sequence"), F.col("lang").alias("name"), F.lit("x").alias("source"), F.create_map(F.lit("id"), F.col("doc_id").cast("string")).alias("metadata"))
    W.save_library(rows, path)
    of = F.floor(F.col("metadata")["id"].cast("long") / 64).alias("part")
    whole = rows.select(of, F.struct("sequence", "name", "source", F.create_map(F.lit("id"), F.lit("whole")).alias("metadata")).alias("p")).groupBy("part")
    whole = whole.agg(F.lit("some").alias("name"), F.count(F.lit(1)).alias("count"), F.collect_list("p").alias("proteins"))
    whole.repartition("part").write.partitionBy("part").json(document)
    return R.library_json(spark, path, lines=True).unionByName(R.library_json(spark, document)).select("sequence", "name", F.col("metadata")["id"].alias("id"))


@query(f"WITH {VEC} SELECT vec_id::VARCHAR AS id, round(x[1], 6) AS a FROM vec")
def a08_embedding_store(spark, sf):
    path = folder(spark, "embeddings")
    W.save_embeddings(vectors(spark, sf).select(F.col("vec_id").cast("string").alias("id"), F.lit("esm2").alias("kind"), F.col("x").alias("vector")), path)
    return R.embeddings(spark, path, "esm2").select("id", F.round(F.col("vector")[0].cast("double"), 6).alias("a"))


@query("SELECT p_brand AS gene, min(p_type) AS mapped FROM part GROUP BY p_brand")
def a09_gene_mapping_json(spark, sf):
    """A JSON object of brands."""
    path = folder(spark, "mapping")
    rows = table(spark, sf, "part").groupBy("p_brand").agg(F.min("p_type").alias("mapped"))
    rows.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("p_brand", "mapped")))).alias("value")).coalesce(1).write.text(f"{path}.json")
    return R.gene_mapping(spark, f"{path}.json")


@query("SELECT p_partkey::VARCHAR AS gene, p_brand AS mapped FROM part")
def a09_gene_mapping(spark, sf):
    path = folder(spark, "mapping")
    table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("gene"), F.col("p_brand").alias("mapped")).write.option("header", True).csv(path)
    return R.gene_mapping(spark, path)


@query("SELECT l_suppkey, round(avg(l_tax), 6) AS tax, count(*) AS n FROM lineitem GROUP BY l_suppkey")
def a10_d28_curated_set(spark, sf):
    """Saved with a report that was observed while the rows were written, and read again."""
    path = folder(spark, "curated")
    rows, seen = A.observed(table(spark, sf, "lineitem"), "load", nulls=F.sum(F.col("l_tax").isNull().cast("long")))
    W.save_curated(rows.groupBy("l_suppkey").agg(F.round(F.avg("l_tax"), 6).alias("tax"), F.count(F.lit(1)).alias("n")), ["tax"], {"format": "1"}, path)
    n, nulls = table(spark, sf, "lineitem").agg(F.count(F.lit(1)), F.count_if(F.col("l_tax").isNull())).first()
    assert seen.get["rows"] == n and seen.get["nulls"] == nulls
    return W.load_curated(spark, path)[0]


@query(f"WITH {VEC} SELECT vec_id, round(x[1], 6) AS task_0, round(x[2], 6) AS task_1 FROM vec")
def a11_a12_flatten(spark, sf):
    path = folder(spark, "predictions")
    out = W.flatten(vectors(spark, sf).select("vec_id", F.slice("x", 1, 2).alias("p")), "p", size=2)
    W.save_table(rounded(out, "task_0", "task_1"), path, "csv")
    return spark.read.option("header", True).schema("vec_id long, task_0 double, task_1 double").csv(path)


@query("SELECT p_partkey AS id, p_retailprice AS score FROM part")
def a16_selection_export(spark, sf):
    path = folder(spark, "selection")
    W.save_selection(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("score")), "id", path)
    return spark.read.schema("id long, score double").json(f"{path}/ranking_json")


@query("SELECT l_partkey AS label, l_suppkey AS plate, round(sum(coalesce(l_quantity, 0) + coalesce(l_tax, 0)), 4) AS total FROM lineitem GROUP BY ALL")
def a17_training_set(spark, sf):
    path = folder(spark, "training")
    table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", *[c for c in FEATURES if c in ("l_quantity", "l_tax")], F.lit("x").alias("Metadata_Note")).write.parquet(path)
    out = R.training_set(spark, path, "l_partkey", "l_suppkey")
    return rounded(out.groupBy("label", "plate").agg(F.sum(F.col("features")[0] + F.col("features")[1]).alias("total")), "total", digits=4)


@query("SELECT p_name AS gene, min(p_partkey) AS hit FROM part WHERE p_size > 25 GROUP BY p_name UNION ALL SELECT p_name, p_partkey FROM part p WHERE p_size <= 25 AND p_name NOT IN (SELECT p_name FROM part WHERE p_size > 25)")
def a18_merge_genes(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_name").alias("gene"), F.col("p_partkey").alias("hit"), "p_size")
    found = part.filter("p_size > 25").withColumn("o", F.col("hit")).drop("p_size")
    return R.merge_genes(part.filter("p_size <= 25").drop("p_size"), found, "o")
