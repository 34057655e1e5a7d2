"""Substring dedup: fixed-block anchors, extended to exact repeats of fifty words.

A window of fifty words contains, wherever it starts, a whole block of the 25-word grid of its
document. So the reference blocks (non-overlapping, 25 words) are indexed, every rolling 25-word
window of every document probes the index, and a window of fifty words can only repeat elsewhere if such a
hit lies in it. Around the hits the words are extended to whole fifty-word windows: each document
sends the hashes of those windows, the smallest doc_id of each hash is found, and a word is removed if it
lies in a window that a smaller doc_id also has.

Documents are dealt into groups by a hash of doc_id, large enough that a group's probes to one of the
index's parts are worth a row. A group sends each of its distinct probes once, so a passage that a third of all
documents share reaches its part once a group, not once a document. Whole copies of an earlier document are
settled beforehand by a hash of their words and send no probes.

Windows are compared by two hashes of their words, of 64 and 32 bits and of different bases, probes by about 40 bits of theirs (a false hit only adds
windows to the exact step). Group and part sizes grow with the square root of the input.

Defined results: doc_id is an integer; null and empty texts have no words; texts under fifty words keep all; rows that share
a doc_id do not remove each other's words, and each gives one row by its own text; a null doc_id neither removes
nor loses words; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

WINDOW, ANCHOR = 50, 25
#: Least words of a group of documents, and least probes of a part of the index.
GROUP_WORDS = 400_000

_U = np.uint64
_BYTE_BASE, _WORD_BASE, _AGAIN_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


class _Powers:
    """Powers of an odd base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self, base: int):
        self.base = (base, pow(base, -1, 2**64))
        self.up = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]

    def upto(self, n: int):
        while len(self.up[0]) < n:
            k = len(self.up[0])
            for i in (0, 1):
                self.up[i] = np.concatenate([self.up[i], self.up[i] * _U(pow(self.base[i], k, 2**64))])
        return self.up[0][:n], self.up[1][:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(29))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(32))


class WordHasher:
    """Hashes of a text's words and of its runs of words, from prefix sums."""

    def __init__(self):
        self.bytes, self.words, self.again = _Powers(_BYTE_BASE), _Powers(_WORD_BASE), _Powers(_AGAIN_BASE)

    def of(self, raw: bytes) -> np.ndarray:
        a = np.frombuffer(raw, dtype=np.uint8)
        word = np.zeros(len(a) + 2, dtype=np.int8)
        word[1:-1] = ~_SPACE[a]
        edge = np.diff(word)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        up, down = self.bytes.upto(len(a) + 1)
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((a.astype(np.uint64) + _U(1)) * up[: len(a)])])
        return _mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))

    def runs(self, words: np.ndarray, width: int, powers: _Powers | None = None) -> np.ndarray:
        """Hashes of all runs of ``width`` words."""
        n = len(words)
        if n < width:
            return np.zeros(0, dtype=np.uint64)
        up, down = (powers or self.words).upto(n + 1)
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(words * up[:n])])
        return _mix((sums[width:] - sums[:-width]) * down[: n - width + 1])

    def checks(self, words: np.ndarray, width: int) -> np.ndarray:
        """Second hashes of all runs, 32 bits each."""
        return (self.runs(words, width, self.again) >> _U(32)).astype(np.uint32).view(np.int32)


def _texts(docs: pa.Table, live: set):
    for doc, raw in zip(docs.column("doc_id").to_pylist(), docs.column("raw").to_pylist()):
        if raw and doc in live:
            yield doc, raw


def _slices(codes: np.ndarray):
    """Start and end positions of the runs of equal values in a sorted array."""
    at = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, dtype=np.int64)
    return at, np.concatenate([at[1:], [len(codes)]]) if len(at) else at


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, group_words: int = GROUP_WORDS) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every row. ``window`` must be at least twice ``anchor`` less one."""
    if window < 2 * anchor - 1:
        raise ValueError("a window must hold a whole block wherever it starts")
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))
    base = docs.select("doc_id", plain.alias("plain")).select(
        "doc_id",
        F.when(F.col("plain") == "", 0).otherwise(F.length("plain") - F.length(F.replace("plain", F.lit(" "), F.lit(""))) + 1).cast("long").alias("n_words"),
        F.sha2("plain", 256).alias("sha"),
    )
    base = materialise(base, "words")
    long = base.filter((F.col("n_words") >= window) & F.col("doc_id").isNotNull())
    first = materialise(long.groupBy("sha").agg(F.min("doc_id").alias("first"), F.max("n_words").alias("n")), "first")
    total = first.agg(F.sum("n")).first()[0] or 0

    size = max(group_words, math.isqrt(total * 256))
    groups = -(-max(total, 1) // size)
    bits = max(0, groups - 1).bit_length()  # of the number of index parts
    grp = F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("int")
    texts = docs.select(grp.alias("grp"), "doc_id", F.encode("text", "UTF-8").alias("raw"))
    live = first.select(F.col("first").alias("doc_id")).withColumn("grp", grp)
    none = F.lit(None)
    marks = live.select("grp", F.col("doc_id").alias("x"), none.cast("int").alias("part"), none.cast("binary").alias("keys"))
    id_kind = docs.schema["doc_id"].dataType.simpleString()
    shift, low = _U(64 - bits - 30), _U((1 << 30) - 1)

    def by_group(right: DataFrame):
        return texts.groupBy("grp").cogroup(right.groupBy("grp"))

    def probes(left: pa.Table, right: pa.Table) -> pa.Table:
        hasher, live = WordHasher(), set(right.column("x").to_pylist())
        found = []
        for _, raw in _texts(left, live):
            h = hasher.runs(hasher.of(raw), anchor) & ~_U(1)
            h[::anchor] |= _U(1)  # a block of the grid
            found.append(h)
        h = np.sort(np.concatenate(found)) if found else np.zeros(0, dtype=np.uint64)
        key = h >> shift  # part and 30 bits
        at, end = _slices(key)
        key = key[at]
        grid = (np.bitwise_or.reduceat(h, at) if len(at) else h) & _U(1)
        many = (end - at > 1).astype(np.uint64)
        coded = ((key & low) << _U(2) | grid << _U(1) | many).astype(np.uint32)
        part = (key >> _U(30)).astype(np.int32)
        at, end = _slices(part)
        me = left.column("grp")[0].as_py() if left.num_rows else 0
        return pa.table(
            {"part": pa.array(part[at], pa.int32()), "grp": pa.array([me] * len(at), pa.int32()), "keys": pa.array([coded[s:e].tobytes() for s, e in zip(at, end)], pa.binary())}
        )

    def lookup(rows: pa.Table) -> pa.Table:
        part = rows.column("part")[0].as_py()
        coded = [np.frombuffer(x, dtype=np.uint32).astype(np.uint64) for x in rows.column("keys").to_pylist()]
        names = rows.column("grp").to_pylist()
        at = np.repeat(np.arange(len(coded)), [len(x) for x in coded]).astype(np.uint64)
        every = np.sort(np.concatenate(coded) << _U(32) | at)
        start, end = _slices(every >> _U(34))
        grid = np.bitwise_or.reduceat(every, start) >> _U(33) & _U(1)
        many = (np.bitwise_or.reduceat(every, start) >> _U(32) & _U(1)).astype(bool) | (end - start > 1)
        hit = np.repeat(grid.astype(bool) & many, end - start)
        every = every[hit]
        of = (every & _U(0xFFFFFFFF)).astype(np.int64)
        order = np.argsort(of, kind="stable")
        of, key = of[order], (every >> _U(34)).astype(np.uint32)[order]
        at, end = _slices(of)
        return pa.table(
            {"grp": pa.array([names[i] for i in of[at]], pa.int32()), "part": pa.array([part] * len(at), pa.int32()), "keys": pa.array([key[s:e].tobytes() for s, e in zip(at, end)], pa.binary())}
        )

    def windows(left: pa.Table, right: pa.Table) -> pa.Table:
        hasher = WordHasher()
        live = {x for x in right.column("x").to_pylist() if x is not None}
        hits = [_U(p << 30) | np.frombuffer(k, dtype=np.uint32) for p, k in zip(right.column("part").to_pylist(), right.column("keys").to_pylist()) if k is not None]
        hits = np.sort(np.concatenate(hits)) if hits else np.zeros(0, dtype=np.uint64)
        found, owner, second = [], [], []
        for doc, raw in _texts(left, live) if len(hits) else ():
            words = hasher.of(raw)
            key = (hasher.runs(words, anchor) & ~_U(1)) >> shift
            at = np.searchsorted(hits, key)
            at[at == len(hits)] = 0
            run = np.concatenate([[0], np.cumsum(hits[at] == key)])
            n = len(words) - window + 1
            if n > 0 and run[-1]:
                near = run[window - anchor + 1 :][:n] > run[:n]
                h = hasher.runs(words, window)[near]
                found.append(h)
                second.append(hasher.checks(words, window)[near])
                owner.append(np.full(len(h), doc, dtype=np.int64))
        if not found:
            return pa.table({k: pa.array([], t) for k, t in (("h", pa.int64()), ("g", pa.int32()), ("grp", pa.int32()), ("low", pa.int64()), ("high", pa.int64()))})
        h, g, owner = np.concatenate(found), np.concatenate(second), np.concatenate(owner)
        order = np.lexsort((owner, g, h))
        h, g, owner = h[order], g[order], owner[order]
        at = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])]))
        end = np.concatenate([at[1:], [len(h)]])
        me = left.column("grp")[0].as_py()
        return pa.table({"h": pa.array(h[at].view(np.int64)), "g": pa.array(g[at]), "grp": pa.array(np.full(len(at), me, dtype=np.int32)), "low": pa.array(owner[at]), "high": pa.array(owner[end - 1])})

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        hasher = WordHasher()
        x, h, g, m = (right.column(c) for c in ("x", "h", "g", "m"))
        live = {v for v in x.to_pylist() if v is not None}
        known = h.is_valid()
        h, g, m = h.filter(known).to_numpy().view(np.uint64), g.filter(known).to_numpy(), m.filter(known).to_numpy()
        order = np.argsort(h)
        h, g, m = h[order], g[order], m[order]
        at, end = _slices(h)
        most = int((end - at).max()) if len(at) else 0  # windows that only the second hash tells apart
        out = set()  # rows that repeat a doc_id and its words give one
        for doc, raw in _texts(left, live) if len(h) else ():
            words = hasher.of(raw)
            mine, also = hasher.runs(words, window), hasher.checks(words, window)
            at, lost = np.searchsorted(h, mine), np.zeros(len(mine), dtype=bool)
            for k in range(most):
                there = np.minimum(at + k, len(h) - 1)
                lost |= (h[there] == mine) & (g[there] == also) & (m[there] < doc)
            starts = np.flatnonzero(lost)
            if len(starts):
                cover = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(cover, starts, 1)
                np.add.at(cover, starts + window, -1)
                keep = np.cumsum(cover)[:-1] == 0
                plain = raw.split()
                kept = b" ".join(w for w, k in zip(plain, keep.tolist()) if k)
                out.add((doc, hashlib.sha256(b" ".join(plain)).hexdigest(), int(len(words) - keep.sum()), hashlib.sha256(kept).hexdigest()))
        cols = list(zip(*out)) or [()] * 4
        kinds = {"id": left.schema.field("doc_id").type, "of": pa.string(), "removed": pa.int64(), "kept": pa.string()}
        return pa.table({k: pa.array(c, t) for (k, t), c in zip(kinds.items(), cols)})

    sent = by_group(marks).applyInArrow(probes, "part int, grp int, keys binary")
    hits = sent.groupBy("part").applyInArrow(lookup, "grp int, part int, keys binary")
    known = marks.unionByName(hits.withColumn("x", none.cast(id_kind)))
    met = by_group(known).applyInArrow(windows, "h long, g int, grp int, low long, high long")
    met = met.withColumn("m", F.min("low").over(Window.partitionBy("h", "g"))).filter("m < high")
    said = live.select("grp", F.col("doc_id").alias("x"), none.cast("long").alias("h"), none.cast("int").alias("g"), none.cast("long").alias("m"))
    said = said.unionByName(met.select("grp", "h", "g", "m").withColumn("x", none.cast(id_kind)))
    removed = by_group(said).applyInArrow(cut, f"id {id_kind}, of string, removed long, kept string")

    empty = F.lit(hashlib.sha256(b"").hexdigest())
    whole = base.join(first.select("sha", "first"), "sha", "left").join(removed, (F.col("doc_id") == F.col("id")) & (F.col("sha") == F.col("of")), "left")
    copy = F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False))
    return whole.select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, empty).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
