"""Readers (A1-A9, A14, A17, A18). Paths may be on any file system that Spark reads; schemas are declared, not inferred."""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platewise import scratch
from platewise.functions.sequence import is_valid, normalise_sequence
from platewise.operators.joins import first_per_key, unmatched
from platewise.schema import feature_columns, metadata_columns, nan_to_null

METADATA = {
    "well": ("Metadata_Source", "Metadata_Plate", "Metadata_Well", "Metadata_JCP2022"),
    "plate": ("Metadata_Source", "Metadata_Batch", "Metadata_Plate", "Metadata_PlateType"),
    "orf": ("Metadata_JCP2022", "Metadata_Symbol"),
    "crispr": ("Metadata_JCP2022", "Metadata_Symbol"),
    "compound": ("Metadata_JCP2022", "Metadata_InChIKey"),
}
PLATE_PATH = r"/([^/]+)/workspace/profiles/([^/]+)/([^/]+)/[^/]+\.parquet$"


def plate_profiles(spark: SparkSession, root: str, columns=None, source="*", batch="*", plate="*") -> DataFrame:
    """A1: profiles under ``root/source/workspace/profiles/batch/plate/plate.parquet``, with source, batch and plate from the path."""
    df = spark.read.option("ignoreMissingFiles", True).parquet(f"{root}/{source}/workspace/profiles/{batch}/{plate}/*.parquet")
    path = F.col("_metadata.file_path")
    names = [c for c in (columns or df.columns)]
    return df.select(
        *names, F.regexp_extract(path, PLATE_PATH, 1).alias("source"), F.regexp_extract(path, PLATE_PATH, 2).alias("batch"), F.regexp_extract(path, PLATE_PATH, 3).alias("plate")
    )


def metadata_table(spark: SparkSession, root: str, name: str, columns=None) -> DataFrame:
    """A2: one of the five metadata tables, ``name.csv`` or ``name.csv.gz``."""
    if name not in METADATA:
        raise KeyError(f"unknown metadata table {name!r}; known: {sorted(METADATA)}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in (columns or METADATA[name])])
    return spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(f"{root}/{name}.csv*")


def _footer(path: str) -> tuple[str | None, bool]:
    """The schema of a Parquet file, or of the first one in a folder, as Spark's JSON, from its footer alone; and whether the path could be looked at from here."""
    import pyarrow.fs as pfs
    import pyarrow.parquet as pq
    from pyspark.sql.pandas.types import from_arrow_schema

    try:
        fs, at = pfs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (pfs.LocalFileSystem(), path)
        info = fs.get_file_info(at)
    except (ValueError, OSError, ImportError):  # a store that only Spark opens
        return None, False
    try:
        if info.type == pfs.FileType.Directory:
            files = sorted(f.path for f in fs.get_file_info(pfs.FileSelector(at)) if f.type == pfs.FileType.File and not f.base_name.startswith(("_", ".")))
            at = files[0] if files else at
        schema = pq.read_schema(at, filesystem=fs)
    except (OSError, ValueError):  # missing, empty or no Parquet; pyarrow's errors are of these kinds
        return None, True
    own = (schema.metadata or {}).get(b"org.apache.spark.sql.parquet.row.metadata")
    return own.decode() if own else from_arrow_schema(schema).json(), True


def schemas(spark: SparkSession, paths: list[str]) -> tuple[list[tuple[T.StructType, list[str]]], list[str]]:
    """The schemas of Parquet paths with the paths of each, and the paths that can't be read, both in the order of ``paths``.

    Tasks read the footers and Spark groups the paths by schema, so the driver receives a row a schema. Paths in a store that tasks can't open by themselves are left to
    the driver, one after another.
    """
    wide = min(len(paths), 4 * spark.sparkContext.defaultParallelism) or 1
    rows = spark.createDataFrame(list(enumerate(paths)), "i long, path string").repartition(wide)

    def run(batches):
        for pdf in batches:
            found = [_footer(x) for x in pdf["path"]]
            yield pdf.assign(schema=[s for s, _ in found], seen=[seen for _, seen in found])

    read = rows.mapInPandas(run, "i long, path string, schema string, seen boolean")
    got = read.groupBy("schema", "seen").agg(F.array_sort(F.collect_list(F.struct("i", "path"))).alias("p")).collect()
    of: dict[str, list[tuple[int, str]]] = {}
    skipped: list[tuple[int, str]] = []
    for r in got:
        mine = [(x.i, x.path) for x in r.p]
        if r.schema is not None:
            of[T.StructType.fromJson(json.loads(r.schema)).json()] = mine
        elif r.seen:
            skipped += mine
        else:
            for i, x in mine:
                try:
                    of.setdefault(spark.read.parquet(x).schema.json(), []).append((i, x))
                except AnalysisException:  # missing
                    skipped.append((i, x))
                except Py4JJavaError as e:  # no footer that can be read
                    if "CANNOT_READ_FILE_FOOTER" not in str(e):
                        raise
                    skipped.append((i, x))
    ordered = sorted((sorted(mine), kind) for kind, mine in of.items())
    return [(T.StructType.fromJson(json.loads(kind)), [x for _, x in mine]) for mine, kind in ordered], [x for _, x in sorted(skipped)]


def _scan(spark: SparkSession, schema: T.StructType, paths: list[str]) -> DataFrame:
    """One scan of many folders. Spark lists them in a task a folder up to 10,000 tasks; here a few tasks a core list many folders each."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, min(int(before), 4 * spark.sparkContext.defaultParallelism))
    try:
        return spark.read.schema(schema).parquet(*paths)  # lists the files at once
    finally:
        spark.conf.set(name, before)


def load_plates(spark: SparkSession, paths, compartments=None, most: int | None = None) -> tuple[DataFrame, list[str]]:
    """Many plates together: features that all have, metadata that any has; and the paths that could not be read.

    Footers are read by tasks, and plates of one schema become one scan, so neither the driver nor the plan grows with the plates.
    """
    of, skipped = schemas(spark, list(paths)[:most])
    if not of:
        raise FileNotFoundError("no plate could be read")
    kinds = {"compartments": compartments} if compartments else {}
    shared = sorted(set.intersection(*[set(feature_columns(schema.names, **kinds)) for schema, _ in of]))
    out = None
    for schema, group in of:
        part = _scan(spark, schema, group).select(*metadata_columns(schema.names), *[F.col(c).cast("double") for c in shared])
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return nan_to_null(out, shared), skipped


def numbered(df: DataFrame, out: str) -> DataFrame:
    """A table read from text files with the number of each row from 0, in the order of files and of rows in them.

    Each block of a file is read by one task from front to back, so a row's number is its place in its block and the rows of the blocks before.
    """
    rows = df.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start")).withColumn("_id", F.monotonically_increasing_id())
    rows = scratch.written(rows, "rows")
    blocks = rows.groupBy("_path", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))  # one row a block
    blocks = blocks.withColumn("_before", F.sum("_n").over(Window.orderBy("_path", "_start")) - F.col("_n")).drop("_n")
    return rows.join(blocks, ["_path", "_start"]).withColumn(out, F.col("_before") + F.col("_id") - F.col("_first")).drop("_path", "_start", "_id", "_first", "_before")


def phenotype_csv(spark: SparkSession, path: str, schema: str, features=None, prefix: str | None = None, id_column: str | None = None) -> DataFrame:
    """A4: CSV to packed rows; features by name or by prefix; without an id column ids are ``sample_`` and the row's number."""
    df = spark.read.option("header", True).schema(schema).csv(path)
    if features is None:
        heads = (prefix,) if prefix else ("Cells_", "Cytoplasm_", "Nuclei_", "Image_")
        features = [c for c in df.columns if c.startswith(heads)]
    if id_column is None:
        df = numbered(df, "_i").withColumn("sample_id", F.concat(F.lit("sample_"), F.col("_i").cast("string"))).drop("_i")
    else:
        df = df.withColumn("sample_id", F.col(id_column).cast("string"))
    keep = [c for c in df.columns if c not in features]
    return df.select(*keep, F.array(*[F.when(~F.isnan(c), F.col(c).cast("double")) for c in features]).alias("features"))


def fasta(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A5: (valid, rejected) records ``id, description, sequence``."""
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", r"^>|\s+$", "").alias("record"))
    head = F.trim(F.substring_index("record", "\n", 1))
    body = F.when(F.locate("\n", F.col("record")) > 0, F.expr("substring(record, locate('\n', record) + 1)")).otherwise("")
    rows = raw.filter(F.trim("record") != "").select(F.substring_index(head, " ", 1).alias("id"), head.alias("description"), normalise_sequence(body).alias("sequence"))
    return rows.filter(is_valid(F.col("sequence"))), rows.filter(~is_valid(F.col("sequence")))


def sequence_csv(spark: SparkSession, path: str) -> DataFrame:
    """``sequence`` and ``name`` (``protein_`` and the row's number where it is missing)."""
    df = spark.read.option("header", True).csv(path)
    if "sequence" not in df.columns:
        raise KeyError("a sequence column is needed")
    name = F.col("name") if "name" in df.columns else F.lit(None).cast("string")
    return numbered(df, "_i").withColumn("name", F.coalesce(name, F.concat(F.lit("protein_"), F.col("_i").cast("string")))).drop("_i")


LIBRARY = "name string, count long, proteins array<struct<sequence:string,name:string,source:string,metadata:map<string,string>,embeddings:map<string,array<double>>>>"


def library_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row a protein, from whole documents, or from ``lines`` of one document each as ``save_library`` writes them."""
    return spark.read.schema(LIBRARY).option("multiLine", not lines).json(path).select(F.col("name").alias("library"), F.explode("proteins").alias("p")).select("library", "p.*")


def embeddings(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """``id, kind, vector``."""
    df = spark.read.schema("id string, kind string, vector array<float>").parquet(path)
    return df.filter(F.col("kind") == kind) if kind else df


def gene_mapping(spark: SparkSession, path: str) -> DataFrame:
    """``gene, mapped`` from a JSON object or a two-column CSV."""
    if path.endswith(".json"):
        whole = spark.read.text(path, wholetext=True)
        return whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("gene", "mapped"))
    return spark.read.option("header", True).schema("gene string, mapped string").csv(path)


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """Sources, batches and plates below a root, from the file listing alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(root).select("path")
    parts = [F.regexp_extract("path", PLATE_PATH, i).alias(n) for i, n in ((1, "source"), (2, "batch"), (3, "plate"))]
    return files.select(*parts).filter("plate <> ''").distinct()


def training_set(spark: SparkSession, path: str, label: str, plate: str, weight: str | None = None) -> DataFrame:
    """``features, label, plate, weight`` with every column that is neither a key nor metadata as a feature."""
    df = spark.read.parquet(path)
    features = [c for c in df.columns if c not in (label, plate, weight) and not c.startswith("Metadata_")]
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return df.select(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features]).alias("features"), F.col(label).alias("label"), F.col(plate).alias("plate"), w.alias("weight"))


def missing_genes(requested: DataFrame, known: DataFrame) -> DataFrame:
    """Genes still to be looked up."""
    return unmatched(requested.select("gene").dropna().distinct(), known, "gene")


def merge_genes(known: DataFrame, found: DataFrame, ordinal: str) -> DataFrame:
    """First hit per gene, new over old."""
    first = first_per_key(found, ["gene"], ordinal).drop(ordinal)
    return unmatched(known, first, "gene").unionByName(first)
