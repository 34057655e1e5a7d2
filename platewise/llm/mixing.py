"""Mixing sources to target weights by systematic sampling (native Spark only).

Every document of a source has the same expected number of copies, ``target / source size``.
The documents of a source are laid out in one order, the expected copies are prefix-summed
along it, one random offset is added, and a document is emitted once for every integer
boundary that its interval crosses. The order goes by size (in bins three per cent wide), so
the words taken differ from the target by about the size of one document.

The prefix sums are hierarchical: rows are numbered inside blocks (source, size bin, salt),
blocks inside bins and bins inside sources, so that no task ever holds a whole source. Sources, of which there may be
as many as hosts, are numbered by a distributed sort, and the level up to which they fill is found by rounds of one aggregation each.

Defined results: a null text has size 0; a null source is a source of its own, sorted last;
documents of size 0 may be emitted but take 0 words; rows that share a doc_id are independent, and rows equal in doc_id and text
may be exchanged for each other; an empty table gives an empty result. ``mix`` ignores further columns. ``emit`` keeps
them all, whatever their names; its number of the copy is called ``copy``, or ``copy_1``, ``copy_2``... if that name is taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, leading_digits, materialise, word_count

WEIGHTS = (5.0, 2.0, 1.0)
#: Hex digits of a row's hash that deal the rows of one source and size bin among blocks.
SALT_DIGITS = 2


def numbered(sources: DataFrame) -> DataFrame:
    """``sources`` with ``i``, each row's place in the order of ``skey`` by code point, the empty one last."""
    placed = sources.orderBy(F.col("skey") == "", "skey").withColumn("at", F.monotonically_increasing_id())
    placed = materialise(placed, "mix-sources").withColumn("run", F.shiftright("at", 33))
    runs = placed.groupBy("run").agg(F.count(F.lit(1)).alias("n"))  # one row a sorted part
    runs = runs.select("run", (F.sum("n").over(Window.orderBy("run")) - F.col("n")).alias("before"))
    return placed.join(runs, "run").withColumn("i", F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("at", "run", "before")


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Words each source should give: ``share`` of all words, split by weight, none above ``cap`` times its size.

    ``sized`` has ``skey`` and ``size``. The excess of capped sources goes to the others by
    weight until none is above its cap. Each round is one sum over the sources; the level only rises, and only
    a round that caps more sources is followed by another.
    """
    per = numbered(sized.groupBy("skey").agg(F.sum("size").alias("source_size")))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("i") % len(weights) + 1).cast("int"))
    per = materialise(per.select("skey", "source_size", (F.col("source_size") * F.lit(float(cap))).alias("ceiling"), w.alias("w")), "mix-weights")
    level, before = 0.0, None
    while level != before:
        full = F.col("ceiling") < F.col("w") * F.lit(level)
        total, capped, free = per.agg(F.sum("source_size"), F.sum(F.when(full, F.col("ceiling"))), F.sum(F.when(~full, F.col("w")))).first()
        before, level = level, ((total or 0) * share - (capped or 0.0)) / free if free else float("inf")
    return per.select("skey", "source_size", F.least("ceiling", F.col("w") * F.lit(level)).alias("target"))


def _mixed(docs: DataFrame, row: str | None, weights, share: float, cap: float, seed: int) -> DataFrame:
    """``doc_id, size, source_size, target, copies`` and the column named ``row`` as ``row``."""
    skey = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    content = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    sized = docs.select("doc_id", (F.col(row) if row else F.lit(None).cast("long")).alias("row"), skey.alias("skey"), word_count(F.col("text")).alias("size"), content.alias("content"))
    tie = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size"), F.col("content")), 256)
    sized = materialise(sized.select("doc_id", "row", "skey", "size", F.substring(tie, 1, 16).alias("tie")), "mix-sizes")
    sized = sized.withColumn("bin", leading_digits(F.col("size"))).withColumn("salt", F.substring("tie", 1, SALT_DIGITS))

    blocks = sized.groupBy("skey", "bin", "salt").agg(F.count(F.lit(1)).alias("n"))
    bins = blocks.groupBy("skey", "bin").agg(F.sum("n").alias("n"))
    before_bin = F.sum("n").over(Window.partitionBy("skey").orderBy("bin")) - F.col("n")
    bins = bins.select("skey", "bin", before_bin.alias("before_bin"))
    before = F.sum("n").over(Window.partitionBy("skey", "bin").orderBy("salt")) - F.col("n")
    blocks = blocks.select("skey", "bin", "salt", before.alias("in_bin")).join(bins, ["skey", "bin"])
    blocks = blocks.select("skey", "bin", "salt", (F.col("before_bin") + F.col("in_bin")).alias("before"))

    inside = F.row_number().over(Window.partitionBy("skey", "bin", "salt").orderBy("tie"))
    rows = sized.withColumn("rn", inside).join(blocks, ["skey", "bin", "salt"])
    rows = rows.join(source_targets(sized, weights, share, cap), "skey")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    drawn = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.lit("offset"), F.col("skey")), 256)
    offset = F.conv(F.substring(drawn, 1, 5), 16, 10).cast("double") / F.lit(float(1 << 20))
    at = lambda k: F.floor(offset + (F.col("before") + F.col("rn") - 1 + k) * rate)
    copies = F.least(at(1) - at(0), F.ceil(rate)).cast("long")
    return rows.select("doc_id", "row", "size", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: int = 20) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, copies, taken``.

    ``copies`` is how often the mix holds the document and ``taken`` the words that makes.
    """
    rows = _mixed(docs, None, weights, share, cap, seed)
    return rows.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def emit(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: int = 20) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as the mix holds it, numbered from 1 by a last column ``copy``."""
    row, times = free_name(docs, "mix_row"), free_name(docs, "mix_times")
    held = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "mix-rows")  # written, so the numbers stay
    chosen = _mixed(held, row, weights, share, cap, seed).filter("copies > 0")
    out = held.join(chosen.select(F.col("row").alias(row), F.col("copies").alias(times)), row)
    number = F.explode(F.sequence(F.lit(1), F.col(times).cast("int"))).alias(free_name(docs, "copy"))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], number)


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
