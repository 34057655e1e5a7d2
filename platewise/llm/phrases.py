"""Phrase collocations by marginalising the longest windows.

Every word stands in one row with its three followers in the piece (``w1`` to ``w4``, padded with nulls): the lead columns. Only these
longest windows are counted; ``ROLLUP`` sums them over ever shorter prefixes, which gives the occurrences of every phrase of four, three,
two and one words and the words of each language, so no shorter n-gram is ever listed for itself.

A phrase counts only from ``LEAST`` occurrences on, and then all its words, pairs and triples of neighbours occur as often. So a first pass counts words
and pairs by 64-bit hashes in parts of the hash space and marks those that occur often enough in a filter of fixed size, a second one does so with the triples of such pairs, and the
windows end before the first pair or triple that the filters don't know. A filter only admits too much (hash collisions, or when it fills up), never too little, so it
changes the cost and no result.

Defined results: null texts are empty, a null language is ``und``; texts without words say nothing; copies count as often as they are there; one text may be of
any length (it is worked on alone); an empty table gives no rows; ties are broken by occurrences, then by the phrase's bytes; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise, source_partitions
from .words import byte_kinds, hashes, in_byte_slices, mixed, split

LONGEST, LEAST, TOP = 4, 30, 2000
#: A longer phrase stands for its parts if it has at least SHARE percent of their occurrences.
SHARE = 80
#: Fewest and most binary digits of a filter's places (0.5 and 32 MB). Between them it has 65,536 places a part of the hash space, and the parts follow the
#: number of shuffle partitions.
FILTER_BITS = (22, 28)
#: Lists that a language's candidates are ranked in before the last ranking.
SALTS = 32
_KINDS = byte_kinds(b" \t", b".,;:!?\n\x0b\x0c\r")
_NAMES = [f"w{k}" for k in range(1, LONGEST + 1)]
_STEP = np.uint64(0x165667B19E3779F9)


class Filter:
    """Marks of hashes by their leading digits."""

    def __init__(self, table: np.ndarray):
        self.table, self.shift = table, np.uint64(65 - (len(table) * 8).bit_length())

    def known(self, h: np.ndarray) -> np.ndarray:
        place = (h >> self.shift).astype(np.int64)
        return (self.table[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1


class _Slice:
    """The words of some texts with hashes of (language, word) and (language, word, next word)."""

    def __init__(self, b: pa.RecordBatch):
        words = split(b.column(1), _KINDS)
        langs = b.column(0).fill_null("und").dictionary_encode()
        self.lang, self.langs = langs.indices.to_numpy()[words.text], langs.dictionary
        self.words, self.distinct, self.code = words, words.distinct, words.code
        h = hashes(words.distinct)[words.code] if len(words.code) else np.zeros(0, dtype=np.uint64)
        own = hashes(self.langs)[self.lang] if len(words.code) else h
        self.word = mixed(h * _STEP + own)
        self.near = words.next_to()
        self.pair = mixed(self.word[:-1] + mixed(h[1:] ^ _STEP))
        self.triple = mixed(self.pair[:-1] + mixed(h[2:] + _STEP))

    def goes(self, pairs: Filter) -> np.ndarray:
        """Whether a word and the next one are a frequent pair."""
        known = pairs.known(self.word)
        return self.near & pairs.known(self.pair) & known[:-1] & known[1:]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))


def frequent(docs: DataFrame, keys, least: int = LEAST, bits: int | None = None) -> Filter:
    """One bit for each value of a hash's leading ``bits``, set where one of the ``keys`` (hashes of a slice) comes at least ``least`` times.

    A task sends each part of the hash space the distinct hashes of a slice that fall there, as differences, and their counts; a part adds them up and
    returns its piece of the filter.
    """
    parts = max(4, (4 * source_partitions(docs.sparkSession) - 1).bit_length())
    bits = bits or min(FILTER_BITS[1], max(FILTER_BITS[0], parts + 16))
    parts = min(bits - 10, parts)
    enough = min(least, 255)

    def run(batches):
        for b in in_byte_slices(batches, 1):
            key = np.sort(keys(_Slice(b)))
            if not len(key):
                continue
            at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            n = np.minimum(np.diff(np.append(at, len(key))), enough).astype(np.uint8)  # what is frequent in one slice needs no more
            key = key[at]
            part = (key >> np.uint64(64 - parts)).astype(np.int32)
            code = (key << np.uint64(parts)) >> np.uint64(32)  # the next 32 digits
            at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            codes, counts = [], []
            for lo, hi in zip(at, [*at[1:], len(key)]):
                step = np.diff(code[lo:hi], prepend=np.uint64(0)).astype(np.uint32)
                codes.append(step.view(np.uint8).reshape(-1, 4).T.tobytes())  # equal bytes side by side compress
                counts.append(n[lo:hi].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(part[at]), pa.array(codes, pa.binary()), pa.array(counts, pa.binary())], ["part", "codes", "counts"])

    def piece(t: pa.Table) -> pa.Table:
        codes = []
        for x in t.column("codes").to_pylist():
            steps = np.ascontiguousarray(np.frombuffer(x, dtype=np.uint8).reshape(4, -1).T).view(np.uint32).reshape(-1)
            codes.append(np.cumsum(steps, dtype=np.uint32))
        code = np.concatenate(codes)
        n = np.frombuffer(b"".join(t.column("counts").to_pylist()), dtype=np.uint8)
        order = np.argsort(code, kind="stable")
        code, n = code[order], n[order].astype(np.int64)
        at = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        kept = code[at][np.add.reduceat(n, at) >= enough]
        marks = np.zeros(1 << (bits - parts), dtype=bool)
        marks[kept >> np.uint32(32 - (bits - parts))] = True
        return pa.table({"part": t.column("part")[:1], "bits": pa.array([np.packbits(marks).tobytes()], pa.binary())})

    found = _texts(docs).mapInArrow(run, "part int, codes binary, counts binary").groupBy("part").applyInArrow(piece, "part int, bits binary")
    table = np.zeros(1 << (bits - 3), dtype=np.uint8)
    size = len(table) >> parts
    got = found.toArrow()
    for part, raw in zip(got.column("part").to_pylist(), got.column("bits")):
        table[part * size : (part + 1) * size] = np.frombuffer(raw.as_buffer(), dtype=np.uint8)
    return Filter(table)


def filters(docs: DataFrame, least: int = LEAST, bits: int | None = None) -> tuple[Broadcast, Broadcast]:
    """The filters of words and pairs, and of triples."""
    send = docs.sparkSession.sparkContext.broadcast
    pairs = send(frequent(docs, lambda s: np.concatenate([s.word, s.pair[s.near]]), least, bits))

    def triples(s: _Slice) -> np.ndarray:
        goes = s.goes(pairs.value)
        return s.triple[goes[:-1] & goes[1:]]

    return pairs, send(frequent(docs, triples, least, bits))


def windows(docs: DataFrame, known_pairs: Broadcast, known_triples: Broadcast) -> DataFrame:
    """``lang, w1..w4, n``: the distinct longest windows of each slice, ended before the first pair or triple that is not frequent, and their number.

    Words that are not frequent are told apart no longer: ``w1`` is null.
    """

    def run(batches):
        for b in in_byte_slices(batches, 1):
            s = _Slice(b)
            n = len(s.code)
            if not n:
                continue
            size = len(s.distinct) + 1
            pairs, triples = known_pairs.value, known_triples.value
            two, three, four = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
            two[:-1] = s.goes(pairs)
            three[:-2] = two[:-2] & two[1:-1] & triples.known(s.triple)
            four[:-1] = three[:-1] & three[1:]
            lead = [np.where(pairs.known(s.word), s.code + 1, 0).astype(np.int64)]  # 0: none
            for k, held in enumerate((two, three, four), 1):
                column = np.zeros(n, dtype=np.int64)
                column[: n - k] = np.where(held[: n - k], s.code[k:] + 1, 0)
                lead.append(column)
            head = (s.lang.astype(np.int64) * size + lead[0]) * size + lead[1]
            tail = lead[2] * size + lead[3]
            order = np.lexsort((tail, head))
            head, tail = head[order], tail[order]
            at = np.flatnonzero(np.concatenate([[True], (head[1:] != head[:-1]) | (tail[1:] != tail[:-1])]))
            counts = np.diff(np.append(at, n))
            first = order[at]
            cols = [s.langs.take(pa.array(s.lang[first]))]
            for column in lead:
                code = column[first]
                cols.append(s.distinct.take(pa.array(code - 1, mask=code == 0)))
            cols.append(pa.array(counts, pa.int64()))
            for lo in range(0, len(at), 1 << 16):
                yield pa.RecordBatch.from_arrays([c.slice(lo, 1 << 16) for c in cols], ["lang", *_NAMES, "n"])

    return _texts(docs).mapInArrow(run, "lang string, " + ", ".join(f"{w} string" for w in _NAMES) + ", n long")


def phrase_counts(longest: DataFrame, least: int = LEAST) -> DataFrame:
    """``lang, words, phrase, size, f``: every phrase of up to four words with at least ``least`` occurrences, and under size 0 the words of each language."""
    distinct = longest.groupBy("lang", *_NAMES).agg(F.sum("n").alias("n"))  # else each task would roll up its own
    rolled = distinct.rollup("lang", *_NAMES).agg(F.sum("n").alias("f"), F.grouping_id().alias("g"))
    words = F.array(*_NAMES)
    size = F.lit(LONGEST) - F.bit_count("g")  # each bit is a column summed over
    rows = rolled.filter(F.col("g") < (1 << LONGEST)).withColumn("size", size.cast("int"))
    last = F.when(F.col("size") > 0, F.element_at(words, F.greatest("size", F.lit(1))))
    rows = rows.filter((F.col("size") == 0) | (last.isNotNull() & (F.col("f") >= least)))
    kept = F.slice(words, F.lit(1), F.col("size"))
    return rows.select("lang", kept.alias("words"), F.array_join(kept, " ").alias("phrase"), "size", "f")


def _part(words: Column, start, length) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def scored(counts: DataFrame) -> DataFrame:
    """``lang, phrase, a, l, r, score`` of every candidate by its lowest-scoring cut. ``counts`` is read several times: pass a written table."""
    candidates = counts.filter("size > 1").select("lang", "phrase", "words", "size", F.col("f").alias("a"))
    cuts = candidates.select("lang", "phrase", "words", "size", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(F.col("words"), F.lit(1), F.col("k")).alias("left"), _part(F.col("words"), F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    known = counts.filter((F.col("size") > 0) & (F.col("size") < LONGEST))
    lefts = known.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    rights = known.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    cuts = cuts.join(lefts, ["lang", "left"]).join(rights, ["lang", "right"])
    score = F.expr("cast(cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(20,0)) + r) as long)")
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def covered(counts: DataFrame, share: int = SHARE) -> DataFrame:
    """``lang, phrase``: candidates inside a longer one that has at least ``share`` percent of their occurrences."""
    longer = counts.filter("size > 2")
    inner = [(at, n) for n in range(2, LONGEST) for at in range(1, LONGEST)]
    parts = F.array(*[F.when(F.col("size") >= F.lit(max(at + n - 1, n + 1)), _part(F.col("words"), at, n)) for at, n in inner if at + n - 1 <= LONGEST])
    most = longer.select("lang", F.explode(F.array_distinct(parts)).alias("phrase"), "f").filter("phrase is not null")
    most = most.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    own = counts.filter("size > 1").select("lang", "phrase", "f")
    decimal = lambda x: F.col(x).cast("decimal(19,0)")
    return own.join(most, ["lang", "phrase"]).filter(100 * decimal("most") >= share * decimal("f")).select("lang", "phrase")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, share: int = SHARE, bits: int | None = None) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of each language."""
    made: list[str] = []
    known = filters(docs, least, bits)
    counts = materialise(phrase_counts(windows(docs, *known), least), "phrases", made)
    for x in known:
        x.unpersist()
    rows = scored(counts).join(covered(counts, share), ["lang", "phrase"], "left_anti")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    totals = counts.filter("size = 0").select("lang", F.col("f").alias("n"))
    found = rows.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    found = materialise(found, "collocations")
    discard(docs.sparkSession, made)
    return found


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))
