"""Token counts: an exact length histogram and its suffix sums.

Documents are counted by encoded length, and every question about a context limit is then a
look-up in the histogram's suffix sums: documents and tokens at or above any length, the tokens
left when all documents are cut at that length, and exact quantiles.

Defined results: null and empty texts have length 0 and are counted; special-token strings in a
text are ordinary text; an empty table gives an empty histogram; further columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import leading_digits, materialise

#: Leading binary digits of a length that tell blocks apart: a block spans at most 1/32 of its octave.
DIGITS = 6


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def load_encoding(vocabulary: str, pattern: str | None = None):
    """A byte-level BPE encoding from a file of ``base64 rank`` lines."""
    import base64

    import tiktoken

    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_lengths(docs: DataFrame, vocabulary: str, pattern: str | None = None) -> DataFrame:
    """``doc_id, n_tokens`` of every whole text. ``vocabulary`` is a file that every executor has."""

    def run(batches):
        encode = load_encoding(vocabulary, pattern).encode_ordinary
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    return lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(hist: DataFrame, digits: int = DIGITS) -> DataFrame:
    """One row per occurring length L, read as context limit L.

    ``docs_ge``/``tokens_ge``: documents of at least L tokens and their tokens; ``kept_tokens``: all
    tokens left when every document is cut to L; ``full_docs``: documents that fit; ``quantile``:
    share of documents of at most L tokens. Sums run in two levels (blocks of near lengths, then
    inside a block), so no task sees the whole histogram; there are at most 64 * ``2 ** digits`` blocks. ``hist`` is
    read twice: pass a written table.
    """
    h = hist.withColumn("tokens", F.col("n_tokens") * F.col("n_docs")).withColumn("block", leading_digits(F.col("n_tokens"), digits))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
    after = Window.orderBy(F.col("block").desc())
    total = Window.partitionBy()
    blocks = blocks.select(
        "block",
        (F.sum("bd").over(after) - F.col("bd")).alias("after_docs"),
        (F.sum("bt").over(after) - F.col("bt")).alias("after_tokens"),
        F.sum("bd").over(total).alias("all_docs"),
        F.sum("bt").over(total).alias("all_tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.col("n_tokens").desc())
    h = h.withColumn("d", F.sum("n_docs").over(inside)).withColumn("t", F.sum("tokens").over(inside)).join(blocks, "block")
    docs_ge, tokens_ge = F.col("d") + F.col("after_docs"), F.col("t") + F.col("after_tokens")
    fit = F.col("all_docs") - docs_ge + F.col("n_docs")
    return h.select(
        "n_tokens",
        "n_docs",
        "tokens",
        docs_ge.alias("docs_ge"),
        tokens_ge.alias("tokens_ge"),
        (F.col("all_tokens") - tokens_ge + F.col("n_tokens") * docs_ge).alias("kept_tokens"),
        fit.alias("full_docs"),
        (fit / F.col("all_docs")).alias("quantile"),
    )


def at_limits(table: DataFrame, limits: list[int]) -> DataFrame:
    """For any context limits, the tokens kept, documents cut and total tokens, from the suffix sums alone, in one pass."""
    each = []
    for x in map(int, limits):
        above = F.col("n_tokens") > x
        cut, over = (F.coalesce(F.max(F.when(above, F.col(c))), F.lit(0)) for c in ("docs_ge", "tokens_ge"))
        each.append(F.struct(F.lit(x).cast("long").alias("context_limit"), cut.alias("docs_cut"), over.alias("above")))
    found = table.agg(F.max("tokens_ge").alias("total_tokens"), F.array(*each).alias("at")).select("total_tokens", F.explode("at").alias("x"))
    kept = F.col("total_tokens") - F.col("x.above") + F.col("x.context_limit") * F.col("x.docs_cut")
    return found.select("x.context_limit", "x.docs_cut", "total_tokens", kept.alias("kept_tokens"))


def quantiles(table: DataFrame, shares: list[float]) -> DataFrame:
    """Smallest length L such that at least the given share of documents has at most L tokens."""
    each = [F.struct(F.lit(x).alias("share"), F.min(F.when(F.col("quantile") >= x, F.col("n_tokens"))).alias("n_tokens")) for x in map(float, shares)]
    return table.agg(F.array(*each).alias("at")).select(F.explode("at").alias("x")).select("x.share", "x.n_tokens")


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return suffix_sums(materialise(length_histogram(token_lengths(docs, default_vocabulary())), "lengths"))
