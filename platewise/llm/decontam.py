"""Benchmark decontamination: BM25 retrieval with block-max WAND, then overlap checks.

The test items form an inverted index: BM25 weights, items in blocks, and for each term and
block the largest weight (the block maximum). Every document is cut into overlapping passages, each at
least as long as the longest item of its class on both sides of any position, and each passage queries the index for all
items whose score reaches ``threshold`` times the score that the item gives itself. Items are dealt into classes of length (up to
``LENGTH`` words, eight times that, and so on), each with an index and passages of its own, so that one long item doesn't lengthen the passages of the others.

Because those thresholds are fixed, WAND's pivot of an item is fixed too: what its light terms (the share ``LIGHT`` of its
threshold) cannot give must come from the others. Only the lists of those, the essential terms of some item of a block, bring up the block, and
only if the sum of its maxima over them reaches what its items need beside their light terms. A block so found is skipped if the sum of its block
maxima over the passage's terms stays below the threshold; only blocks that survive are scored.

A retrieved item is then verified on the passage: five-word shingles of its question must be found to
``overlap`` or more, and those of its answer (its last sentence) to half or more.

The index is built for at most ``ITEMS`` items at a time; more items mean more passes over the documents.
Weights, thresholds and passages come from statistics of the whole benchmark, so passes don't change the result.

Defined results: null and empty texts match nothing, items without words are ignored; repeated
items or documents each give their rows; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
import string
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_slices

SHINGLE, OVERLAP, ANSWER_OVERLAP, THRESHOLD = 5, 0.8, 0.5, 0.5
K1, B, BLOCK, ITEMS, LIGHT = 1.2, 0.75, 8, 20_000, 0.5
#: Most words of the first class of items, and how much longer each next class may be.
LENGTH, LONGER = 64, 8
_PLAIN = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))
_SENTENCE = re.compile(r"[.?!\n]+\s*")


def words_of(text: str) -> list[bytes]:
    """Lower-cased words without ASCII punctuation, as UTF-8."""
    return text.lower().encode().translate(_PLAIN).split()


def split_item(text: str) -> tuple[list[bytes], list[bytes]]:
    """(question, answer): the answer is the last sentence that has words; one sentence is all question."""
    parts = [words_of(p) for p in _SENTENCE.split(text)]
    parts = [p for p in parts if p]
    if len(parts) < 2:
        return (parts[0] if parts else []), []
    return [w for p in parts[:-1] for w in p], parts[-1]


def length_class(words: int) -> int:
    """Most words of the class that an item of so many words is in."""
    bound = LENGTH
    while bound < words:
        bound *= LONGER
    return bound


def shingles(ids: list[int]) -> set:
    n = max(1, len(ids) - SHINGLE + 1)
    return {tuple(ids[i : i + SHINGLE]) for i in range(n)} if ids else set()


@dataclass
class Csr:
    """Rows of (column, value), one row a term."""

    start: np.ndarray
    col: np.ndarray
    val: np.ndarray

    @staticmethod
    def of(rows: list[list[tuple[int, float]]]) -> Csr:
        start = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        flat = [x for r in rows for x in r]
        return Csr(start, np.array([c for c, _ in flat], dtype=np.int64), np.array([v for _, v in flat], dtype=np.float64))

    def expand(self, terms: np.ndarray):
        """Positions into ``terms`` and into col/val of all entries of the given terms."""
        n = self.start[terms + 1] - self.start[terms]
        owner = np.repeat(np.arange(len(terms)), n)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.start[terms], n)
        return owner, at


@dataclass
class Statistics:
    """What weights depend on, over the whole benchmark: items, their mean number of words, and in how many of them each word occurs."""

    n: int
    mean: float
    df: dict[bytes, int]


class Index:
    def __init__(self, items: list[tuple[int, str]], threshold: float = THRESHOLD, block: int = BLOCK, whole: Statistics | None = None):
        """``items`` are of one class; ``whole``: the statistics of the benchmark that they are a part of; without it they are all of it."""
        items = [(i, q, a) for i, t in items for q, a in [split_item(t or "")] if q]
        self.step = length_class(max((len(q) + len(a) for _, q, a in items), default=1))
        self.items = [i for i, _, _ in items]
        self.vocab: dict[bytes, int] = {}
        docs = []
        for _, q, a in items:
            docs.append([self.vocab.setdefault(w, len(self.vocab)) for w in q + a])
        self.question = [shingles(d[: len(q)]) for d, (_, q, _) in zip(docs, items)]
        self.answer = [shingles(d[len(q) :]) for d, (_, q, _) in zip(docs, items)]
        n = len(docs)
        if whole:
            mean, total = whole.mean, whole.n
            df = np.array([whole.df[w] for w in self.vocab], dtype=float)
        else:
            mean, total = sum(map(len, docs)) / max(1, n), n
            df = np.zeros(len(self.vocab))
            for d in docs:
                df[list(set(d))] += 1
        idf = np.log1p((total - df + 0.5) / (df + 0.5))
        postings: list[list] = [[] for _ in self.vocab]
        tops: list[dict] = [{} for _ in self.vocab]
        self.least, by_item = np.zeros(n), []
        for i, d in enumerate(docs):
            terms, tf = np.unique(d, return_counts=True)
            w = idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(d) / mean))
            self.least[i] = threshold * w.sum() - 1e-9
            by_item.append(list(zip(w.tolist(), terms.tolist())))
            for t, x in zip(terms.tolist(), w.tolist()):
                postings[t].append((i, x))
                tops[t][i // block] = max(tops[t].get(i // block, 0.0), x)
        self.block, self.n_blocks = block, -(-n // block)
        self.block_least = np.array([self.least[b * block : (b + 1) * block].min() for b in range(self.n_blocks)])
        essential: list[set] = [set() for _ in self.vocab]
        self.block_need = np.full(self.n_blocks, np.inf)
        for i, x in enumerate(by_item):
            light = 0.0
            for w, t in sorted(x):
                if light + w < LIGHT * self.least[i]:
                    light += w
                else:
                    essential[t].add((i // block, tops[t][i // block]))
            self.block_need[i // block] = min(self.block_need[i // block], self.least[i] - light - 1e-9)
        self.postings, self.tops, self.essential = Csr.of(postings), Csr.of([sorted(x.items()) for x in tops]), Csr.of([sorted(x) for x in essential])

    def search(self, terms: np.ndarray, passage: np.ndarray, n: int):
        """All (passage, item, score / least score) at or above threshold. ``terms``/``passage``: distinct pairs, sorted by passage."""
        none = np.zeros(0, dtype=np.int64)
        owner, at = self.essential.expand(terms)
        pivots, inverse = np.unique(passage[owner] * self.n_blocks + self.essential.col[at], return_inverse=True)
        gained = np.bincount(inverse, weights=self.essential.val[at], minlength=len(pivots))
        pivots = pivots[gained >= self.block_need[pivots % max(1, self.n_blocks)]]
        if not len(pivots):
            return none, none, np.zeros(0)
        # block maxima over all terms of the passages that have a pivot
        has = np.zeros(n, dtype=bool)
        has[pivots // self.n_blocks] = True
        mine = has[passage]
        terms, passage = terms[mine], passage[mine]
        owner, at = self.tops.expand(terms)
        key = passage[owner] * self.n_blocks + self.tops.col[at]
        slot = np.searchsorted(pivots, key)
        slot[slot == len(pivots)] = 0
        good = pivots[slot] == key
        bound = np.bincount(slot[good], weights=self.tops.val[at][good], minlength=len(pivots))
        alive = pivots[bound >= self.block_least[pivots % self.n_blocks]]
        if not len(alive):
            return none, none, np.zeros(0)
        has[:] = False
        has[alive // self.n_blocks] = True
        mine = has[passage]
        terms, passage = terms[mine], passage[mine]
        owner, at = self.postings.expand(terms)
        item = self.postings.col[at]
        key = passage[owner] * self.n_blocks + item // self.block
        slot = np.searchsorted(alive, key)
        slot[slot == len(alive)] = 0
        good = alive[slot] == key
        pair, inverse = np.unique(passage[owner][good] * len(self.items) + item[good], return_inverse=True)
        score = np.bincount(inverse, weights=self.postings.val[at][good], minlength=len(pair))
        found = score >= self.least[pair % len(self.items)]
        pair, score = pair[found], score[found]
        p, i = pair // len(self.items), pair % len(self.items)
        return p, i, score / np.maximum(self.least[i], 1e-12)

    def match(self, texts: list[str | None], threshold: float = THRESHOLD, overlap: float = OVERLAP):
        """(text number, item_id, score, question overlap, answer overlap) of verified items; the best passage counts."""
        step = self.step
        get = self.vocab.get
        ids, offsets = [], [0]
        for t in texts:
            w = words_of(t) if t else []
            ids.append(np.array(list(map(get, w, repeat(-1))), dtype=np.int32))
            offsets.append(offsets[-1] + len(w) // step + 2)
        if not texts:
            return
        # word at position k lies in the passages k // step and k // step + 1 (each two steps long)
        place = np.concatenate([o + np.arange(len(x)) // step for o, x in zip(offsets, ids)])
        flat = np.concatenate(ids).astype(np.int64)
        known = flat >= 0
        place, flat = place[known], flat[known]
        size = max(1, len(self.vocab))
        keys = np.unique(np.concatenate([place * size + flat, (place + 1) * size + flat]))
        p, i, score = self.search(keys % size, keys // size, offsets[-1])
        best: dict[tuple[int, int], tuple] = {}
        starts = np.array(offsets[:-1])
        for q, item, s in zip(p.tolist(), i.tolist(), score.tolist()):
            doc = int(np.searchsorted(starts, q, side="right")) - 1
            k = q - offsets[doc]
            words = ids[doc][max(0, (k - 1) * step) : (k + 1) * step].tolist()
            have = shingles(words)
            ask = sum(x in have if len(x) == SHINGLE else _inside(x, words) for x in self.question[item]) / len(self.question[item])
            reply = self.answer[item]
            tell = sum(x in have if len(x) == SHINGLE else _inside(x, words) for x in reply) / len(reply) if reply else 1.0
            if ask >= overlap and tell >= ANSWER_OVERLAP:
                best[doc, item] = max(best.get((doc, item), (0.0,)), (s * threshold, ask, tell))
        for (doc, item), (s, ask, tell) in sorted(best.items()):
            yield doc, self.items[item], s, ask, tell


def _inside(part: tuple, words: list[int]) -> bool:
    return any(tuple(words[k : k + len(part)]) == part for k in range(len(words) - len(part) + 1))


def statistics(benchmark: DataFrame) -> Statistics:
    """Statistics of all items that have words; the driver receives one row a distinct word."""

    def count(batches):
        for b in batches:
            df: dict[bytes, int] = {}
            n = total = 0
            for t in b.column(0).to_pylist():
                q, a = split_item(t or "")
                if q:
                    n, total = n + 1, total + len(q) + len(a)
                    for w in {*q, *a}:
                        df[w] = df.get(w, 0) + 1
            # the empty word carries the items and their words
            yield pa.RecordBatch.from_arrays(
                [pa.array([*df, b""], pa.binary()), pa.array([*df.values(), n], pa.int64()), pa.array([0] * len(df) + [total], pa.int64())], ["word", "n", "total"]
            )

    rows = benchmark.select("text").mapInArrow(count, "word binary, n long, total long")
    df = {bytes(r.word): r for r in rows.groupBy("word").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()}
    all_ = df.pop(b"", None)
    n, total = (all_.n, all_.total) if all_ else (0, 0)
    return Statistics(n, total / max(1, n), {w: r.n for w, r in df.items()})


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, items: int = ITEMS) -> DataFrame:
    """``doc_id, item_id, score, question_overlap, answer_overlap``: one row per document and item it holds.

    ``score`` is the best passage's BM25 score as a share of the item's own.
    """
    spark = docs.sparkSession
    passes = -(-benchmark.count() // items)
    di, ti = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {di}, item_id {ti}, score double, question_overlap double, answer_overlap double"
    out = spark.createDataFrame([], schema)
    whole = statistics(benchmark) if passes else None
    for k in range(passes):
        rows = benchmark.filter(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k).select("item_id", "text").collect()
        classes: dict[int, list] = {}
        for r in sorted(rows, key=str):
            q, a = split_item(r[1] or "")
            classes.setdefault(length_class(len(q) + len(a)), []).append((r[0], r[1]))
        shared = spark.sparkContext.broadcast([Index(part, threshold, whole=whole) for _, part in sorted(classes.items())])

        def run(batches, shared=shared):
            for b in in_slices(batches, 256):
                ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
                found = [(ids[d], *rest) for index in shared.value for d, *rest in index.match(texts, threshold, overlap)]
                if found:
                    yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*found)))), schema=arrow)

        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out.schema)
        names = out.columns
        out = out.unionAll(docs.select("doc_id", "text").mapInArrow(run, schema))
    return out


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """``docs`` without the documents that hold a test item."""
    bad = contaminated(docs, benchmark, threshold, overlap).select(F.col("doc_id").alias("bad_id")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["bad_id"]), "left_anti")


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
