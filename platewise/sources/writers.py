"""Writers (A7, A8, A10-A13, A16)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def save_curated(df: DataFrame, features, report: dict, path: str) -> None:
    """A10: profiles, report and feature list side by side."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}/profiles")
    spark.createDataFrame([(k, str(v)) for k, v in report.items()], "step string, value string").coalesce(1).write.mode("overwrite").json(f"{path}/report")
    spark.createDataFrame(list(enumerate(features)), "f int, name string").coalesce(1).write.mode("overwrite").json(f"{path}/features")


def load_curated(spark, path: str) -> tuple[DataFrame, dict, list[str]]:
    """A10's reader."""
    report = {r.step: r.value for r in spark.read.schema("step string, value string").json(f"{path}/report").collect()}
    names = [r.name for r in spark.read.schema("f int, name string").json(f"{path}/features").orderBy("f").collect()]
    return spark.read.parquet(f"{path}/profiles"), report, names


def flatten(df: DataFrame, vector: str, names=None, prefix: str = "task", size: int | None = None) -> DataFrame:
    """A vector as one column per component; ``names`` or ``prefix_0`` and on."""
    names = names or [f"{prefix}_{i}" for i in range(size)]
    return df.select(*[c for c in df.columns if c != vector], *[F.col(vector)[i].alias(n) for i, n in enumerate(names)])


def save_table(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Parquet, CSV with a header, or JSON lines."""
    w = df.write.mode("overwrite")
    {"parquet": w.parquet, "json": w.json, "csv": lambda p: w.option("header", True).csv(p)}[form](path)


def fasta_record(name: Column, source: Column, seq: Column, width: int = 80) -> Column:
    """Header and sequence in lines of ``width``."""
    head = F.concat(F.lit(">"), name, F.when(source.isNotNull(), F.concat(F.lit(" source="), source)).otherwise(""))
    body = F.regexp_replace(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), r"\n$", "")
    return F.concat(head, F.lit("\n"), body)


def save_fasta(df: DataFrame, path: str, width: int = 80) -> None:
    df.select(fasta_record(F.col("name"), F.col("source"), F.col("sequence"), width).alias("value")).write.mode("overwrite").text(path)


def save_library(df: DataFrame, path: str) -> None:
    """JSON lines, one a protein, each a library document of one protein, so that no library has to fit one task and the reader reads both forms."""
    protein = F.struct(*[F.col(c) for c in ("sequence", "name", "source", "metadata", "embeddings") if c in df.columns])
    library = F.col("library") if "library" in df.columns else F.lit(None).cast("string")
    df.select(library.alias("name"), F.lit(1).alias("count"), F.array(protein).alias("proteins")).write.mode("overwrite").json(path)


def save_embeddings(df: DataFrame, path: str) -> None:
    """``id, kind, vector`` with vectors as float, partitioned by kind for pruning."""
    df.select("id", "kind", F.col("vector").cast("array<float>").alias("vector")).write.mode("overwrite").partitionBy("kind").parquet(path)


def save_selection(ranked: DataFrame, key: str, path: str) -> None:
    """The ranking as JSON lines and CSV, and the ids alone as text."""
    save_table(ranked, f"{path}/ranking_json", "json")
    save_table(ranked, f"{path}/ranking_csv", "csv")
    ranked.select(F.col(key).cast("string").alias("value")).write.mode("overwrite").text(f"{path}/ids")
