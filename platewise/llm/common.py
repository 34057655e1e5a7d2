"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables, shared by all executors.

    It is the folder named by ``spark.checkpoint.dir``; where that setting is absent a temporary folder is made in
    local mode (tests), and a cluster raises.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not spark.conf.get("spark.master", "local").startswith("local") or spark.conf.get("spark.master").startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        known = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


def materialise(df: DataFrame, name: str, made: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back, which cuts its lineage. The path is added to ``made``."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if made is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, made: list[str]) -> None:
    """Delete scratch tables that nothing will read any more."""
    conf = spark._jsc.hadoopConfiguration()
    for x in made:
        path = spark._jvm.org.apache.hadoop.fs.Path(x)
        path.getFileSystem(conf).delete(path, True)
    made.clear()


def word_count(text: Column) -> Column:
    """Number of words of ``text`` (0 for null)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def in_slices(batches, rows: int):
    """The batches of a task, cut to ``rows`` rows, which bounds what is held as Python objects at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def leading_digits(n: Column, digits: int = 6) -> Column:
    """Number of binary digits of ``n`` and its leading ones, as one number that grows with ``n``; below ``2 ** digits`` no two are equal."""
    bits = F.length(F.bin(n))
    return (bits * (1 << digits) + F.call_function("shiftright", n, F.greatest(bits - digits, F.lit(0)))).cast("int")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or ``name_1``, ``name_2``... if ``df`` has a column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    return next(x for k in range(len(taken) + 1) if (x := f"{name}_{k}" if k else name).lower() not in taken)


def source_partitions(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
