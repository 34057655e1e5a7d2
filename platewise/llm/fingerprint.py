"""Document fingerprints from prefix polynomial hashes.

For a text c of code points, S[k] = sum of c[j] * base^j for j < k, modulo 2^31 - 1. One such prefix array answers
the hash of any span in constant time, (S[e] - S[s]) / base^s, so any two spans can be compared, and
the longest common extension of two positions is found by binary search.

A fingerprint is made of span hashes alone: the whole text under two bases, and the ``SKETCH`` smallest
scrambled hashes of all its spans of ``WIDTH`` code points. Two fingerprints give a likeness, the Dice
coefficient of the two span sets as estimated by the smallest hashes of their union.

Defined results: null text is empty text; two empty texts have likeness 1, an empty and another one 0; texts
shorter than ``WIDTH`` are one span; a document that stands alone is its own next document; rows with one doc_id are
ordered by a hash of the text, null doc_ids come first; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .neighbours import bounds, part_of

MODULUS = np.uint64(2**31 - 1)
BASES = (1_000_003, 69_069_069)
WIDTH, SKETCH = 24, 128
_SHIFT, _MIX = np.uint64(31), np.uint64(0x9E3779B97F4A7C15)


def reduce(x: np.ndarray) -> np.ndarray:
    """x modulo 2^31 - 1 for x below 2^62, by folding the high bits onto the low ones."""
    x = (x & MODULUS) + (x >> _SHIFT)
    x = (x & MODULUS) + (x >> _SHIFT)
    return np.where(x >= MODULUS, x - MODULUS, x)


class Powers:
    """Powers of a base and of its inverse, grown on demand."""

    def __init__(self, base: int):
        m = int(MODULUS)
        self.base = (base % m, pow(base, -1, m))
        self.up = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up[0]) < n:
            k = len(self.up[0])
            for i in (0, 1):
                self.up[i] = np.concatenate([self.up[i], reduce(self.up[i] * np.uint64(pow(self.base[i], k, int(MODULUS))))])
        return self.up[0][:n], self.up[1][:n]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) + np.uint64(1)


class PrefixHash:
    """The prefix array of one text."""

    def __init__(self, codes: np.ndarray, powers: Powers):
        self.n = len(codes)
        up, self.down = powers.upto(self.n + 1)
        self.sums = np.concatenate([np.zeros(1, dtype=np.uint64), reduce(np.cumsum(reduce(codes * up[: self.n])))])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the spans [start, end)."""
        return reduce(reduce(self.sums[end] + MODULUS - self.sums[start]) * self.down[start])

    def windows(self, width: int) -> np.ndarray:
        """Hashes of all spans of ``width``, or of the whole text if it is shorter."""
        if self.n <= width:
            return self.spans(np.array([0]), np.array([self.n]))
        return reduce(reduce(self.sums[width:] + MODULUS - self.sums[:-width]) * self.down[: self.n - width + 1])

    def extension(self, at: int, other: PrefixHash, there: int) -> int:
        """Length of the longest common extension of two positions, by binary search on span equality."""
        low, high = 0, min(self.n - at, other.n - there)
        while low < high:
            mid = (low + high + 1) // 2
            same = self.spans(np.array([at]), np.array([at + mid])) == other.spans(np.array([there]), np.array([there + mid]))
            low, high = (mid, high) if same[0] else (low, mid - 1)
        return low


def sketch(p: PrefixHash, width: int = WIDTH, size: int = SKETCH) -> np.ndarray:
    """The smallest ``size`` scrambled span hashes, 32 bits each, ascending and distinct."""
    if not p.n:
        return np.zeros(0, dtype=np.uint64)
    h = (p.windows(width) + np.uint64(1)) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _MIX >> np.uint64(32)
    few = size
    while True:  # repeated spans: take more until enough are distinct
        if few >= len(h):
            return np.unique(h)[:size]
        low = np.unique(np.partition(h, few)[: few + 1])
        if len(low) > size:
            return low[:size]
        few *= 4


def likeness(a: np.ndarray, b: np.ndarray, size: int = SKETCH) -> float:
    """Estimated Dice coefficient of the span sets behind two sketches."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)
    if max(len(a), len(b)) >= size:
        union = union[:size]
    both = len(np.intersect1d(np.intersect1d(a, b, True), union, True))
    j = both / len(union)
    return 2 * j / (1 + j)


def render(codes: np.ndarray, p: PrefixHash, low: np.ndarray, second: Powers) -> str:
    whole = int(p.sums[-1])
    again = int(reduce(reduce(codes * second.upto(p.n)[0]).sum(keepdims=True))[0]) if p.n else 0
    return f"{p.n:x}.{whole:08x}{again:08x}." + low.astype(">u4").tobytes().hex()


def parse(fingerprint: str) -> np.ndarray:
    """The sketch of a rendered fingerprint."""
    return np.frombuffer(bytes.fromhex(fingerprint.rsplit(".", 1)[1]), dtype=">u4").astype(np.uint64)


class Fingerprinter:
    def __init__(self):
        self.powers, self.second = Powers(BASES[0]), Powers(BASES[1])

    def __call__(self, codes: np.ndarray):
        """(fingerprint, sketch, prefix hash) of a text's code points."""
        p = PrefixHash(codes, self.powers)
        low = sketch(p)
        return render(codes, p, low, self.second), low, p


def in_order(docs: DataFrame, least: int | None = None) -> tuple[DataFrame, int]:
    """Rows ``part, last, doc_id, tie, text``: sorted by these, each part is a run of the doc_id order ending in the
    first row of what follows (``last`` = 1), which for the end is the very first row. ``least``: least number of parts."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    keys = materialise(rows.select(F.col("doc_id").alias("key"), "tie", F.octet_length("text").cast("long").alias("size")), "keys")
    limits = bounds(keys, least)
    firsts = keys.groupBy(part_of(F.col("key"), limits).alias("part")).agg(F.min(F.struct("key", "tie")).alias("f")).collect()
    firsts = sorted((r["part"], r["f"]["key"], r["f"]["tie"]) for r in firsts)
    rows = rows.withColumn("part", part_of(F.col("doc_id"), limits))
    edges = [(doc, tie, before[0]) for (_, doc, tie), before in zip(firsts, firsts[-1:] + firsts[:-1])]
    edges = docs.sparkSession.createDataFrame(edges, f"edge_id {docs.schema['doc_id'].dataType.simpleString()}, edge_tie long, to int")
    first = F.col("doc_id").eqNullSafe(F.col("edge_id")) & (F.col("tie") == F.col("edge_tie"))
    rows = rows.join(F.broadcast(edges), first, "left")  # one row a part
    places = F.array(F.struct("part", F.lit(0).alias("last")), F.struct(F.col("to").alias("part"), F.lit(1).alias("last")))
    rows = rows.withColumn("at", F.explode(F.when(F.col("to").isNull(), F.slice(places, 1, 1)).otherwise(places)))
    return rows.select("at.part", "at.last", "doc_id", "tie", "text"), len(limits) + 1


def fingerprint_documents(docs: DataFrame, least: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses (columns as in ``op4``)."""
    rows, parts = in_order(docs, least)
    rows = rows.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "last", "doc_id", "tie")
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "lce_next"]
    types = [None, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]

    def run(batches):
        make, held = Fingerprinter(), None
        for b in batches:
            out = []
            for part, last, doc, text in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 4))):
                codes = code_points(text)
                now = (part, last, doc, text, codes, *make(codes))
                if held and held[0] == part and not held[1]:
                    out.append(compare(held, now, make))
                held = now
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c, t or b.column(2).type) for c, t in zip(cols, types)], names)

    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, lce_next long"
    return rows.mapInArrow(run, schema)


def compare(held, now, make: Fingerprinter) -> tuple:
    _, _, doc, text, codes, mark, low, prefix = held
    half = len(text) // 2
    edited = text[: len(text) - half] + now[3][:half]
    edited_mark, edited_low, _ = make(np.concatenate([codes[: len(codes) - half], now[4][:half]]))
    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return doc, len(text), digest, mark, edited_mark, likeness(low, edited_low), likeness(low, now[6]), prefix.extension(0, now[7], 0)


def op4_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprint_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
