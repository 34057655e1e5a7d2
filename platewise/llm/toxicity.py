"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Texts are folded first: case, full-width and other compatibility forms (of any length), look-alike letters of other scripts and digits or
signs standing for letters map to one plain form (l, i and 1 share one form), and everything else becomes a
space. Lexicon entries are word beginnings or whole words of any length. They and their weights (log odds) are learned from
labelled rows. A phrase of an entry and the word beside it in which the entry is harmless is learned too, from texts labelled clean; an
entry inside such an exception does not count. The score is a logistic function of the summed weights, as they are and per thousand words.

Learning uses a bounded sample of the distinct labelled texts (``SAMPLE`` per class, chosen by a hash of the text), so
copies count once; scoring covers every row and the whole text.

Defined results: null text is empty text; an empty text gets the score of a text without
matches; texts of any length are folded and matched whole, in linear time; without positive labels the small ``FALLBACK`` lexicon is used;
repeated rows get equal scores; further columns are ignored, and labels, lang, source and doc_id never enter a score.
"""

from __future__ import annotations

import bisect
import itertools
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_slices

#: Most distinct labelled texts of each class that learning reads.
SAMPLE = 10_000
#: Shortest entry, and the longest word beginning that the first count looks at; later counts lengthen those that are frequent.
SHORTEST, FIRST = 3, 9
#: An entry needs so many distinct positive texts, this precision, this log likelihood ratio against the classes' own shares, and so many
#: different preceding words, which near copies of one text do not have. Words of at least ``DOUBTFUL`` precision are entries if exceptions
#: account for the rest.
LEAST_DOCS, PRECISION, EVIDENCE, DOUBTFUL = 4, 0.97, 12.0, 0.5
LEAST_CONTEXTS = 4
#: Entries used when there are no positive labels.
FALLBACK = ("idiot", "moron", "stupid", "pathetic", "worthless", "disgusting", "scum")

# Cyrillic, Greek and other letters that look like Latin ones, and signs and digits used for letters.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h",
    "п": "n", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "ц": "u", "ѵ": "v", "ѡ": "w", "ԝ": "w", "х": "x", "у": "y",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ω": "w",
    "ı": "i", "ɑ": "a", "ƅ": "b", "ɗ": "d", "đ": "d", "ə": "e", "ɡ": "g", "ħ": "h", "ɩ": "i", "ł": "l", "ŋ": "n", "ø": "o", "œ": "oe", "æ": "ae",
    "ß": "ss", "ʀ": "r", "ŧ": "t", "ʋ": "v", "օ": "o", "ս": "u", "հ": "h", "ց": "g", "ո": "n",
}
DIGITS = {"0": "o", "1": "l", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g"}
_SIGN_IN_WORD = re.compile(r"(?<=[^\W_])[$@!|](?=[^\W_])")
_SIGNS = {"$": "s", "@": "a", "!": "l", "|": "l"}


class _Fold(dict):
    """Translation table that works out each character once."""

    def __missing__(self, code: int):
        out = []
        for c in unicodedata.normalize("NFKC", chr(code).lower()):
            for x in "" if unicodedata.combining(c) else LOOK_ALIKES.get(c.lower(), c.lower()):
                x = DIGITS.get(x, x)
                out.append("l" if x == "i" else x if x.isalnum() else " ")
        self[code] = "".join(out)
        return self[code]


def fold(text: str, table=_Fold()) -> str:
    if "$" in text or "@" in text or "!" in text or "|" in text:
        text = _SIGN_IN_WORD.sub(lambda m: _SIGNS[m[0]], text)
    return unicodedata.normalize("NFC", text).translate(table)


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: tuple[str, ...]
    coefficients: tuple[float, float, float]

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for k, w in self.weights.items():
            a.add_word(" " + k, (len(k) + 1, w, k))
        for p in self.exceptions:
            folded = " " + " ".join(fold(p).split()) + " "
            a.add_word(folded, (len(folded), 0.0, ""))
        a.make_automaton()
        return a

    def matches(self, automaton, folded: str) -> list[tuple[int, int, float, str]]:
        """(start, end, weight, entry) of the entries that no exception covers; of entries at one place the heaviest."""
        best, safe = {}, {}
        for end, (n, w, k) in automaton.iter(" " + folded + " "):
            start = end - n + 1
            if not k:
                safe[start] = max(end, safe.get(start, 0))
            elif w > best.get(start, (0, 0.0))[1]:
                best[start] = (end, w, k)
        if safe:
            at = sorted(safe)
            reach = list(itertools.accumulate((safe[a] for a in at), max))  # how far the exceptions up to each start go
            best = {s: x for s, x in best.items() if not (i := bisect.bisect_right(at, s)) or reach[i - 1] < x[0]}
        return [(s, *x) for s, x in best.items()]

    def features(self, automaton, text: str) -> tuple[float, float]:
        folded = " ".join(fold(text).split())
        total = sum(w for _, _, w, _ in self.matches(automaton, folded))
        return np.log1p(total), np.log1p(1000.0 * total / max(50, folded.count(" ") + 1)) if total else 0.0

    def score(self, automaton, text: str) -> float:
        x, y = self.features(automaton, text)
        b = self.coefficients
        return float(1.0 / (1.0 + np.exp(-(b[0] + b[1] * x + b[2] * y))))


def _prefixes(word: str, shortest: int, longest: int, stems: set[str] | None):
    """Beginnings of a word with ``shortest`` to ``longest`` letters, if it starts with a stem, and the whole word with its end marked by a space."""
    n = len(word)
    if n + 1 < shortest or n < SHORTEST or (stems is not None and word[: shortest - 1] not in stems):
        return []
    return [word[:k] for k in range(shortest, min(longest, n) + 1)] + ([word + " "] if n <= longest else [])


def _evidence(p: int, n: int, n_pos: int, n_neg: int) -> float:
    """Log likelihood ratio of an entry's share of positive texts against the share of positive texts in all."""
    part = lambda x, y: x * np.log(x * (n_pos + n_neg) / ((p + n) * y)) if x and y else 0.0
    return float(part(p, n_pos) + part(n, n_neg))


def _precise(p: int, n: int, n_pos: int, n_neg: int, least: float = PRECISION) -> bool:
    return p >= LEAST_DOCS and p >= least * (p + n * n_pos / max(n_neg, 1)) and _evidence(p, n, n_pos, n_neg) >= EVIDENCE


def _weight(p: int, n: int, n_pos: int, n_neg: int) -> float:
    return float(np.log((p + 0.5) / (n_pos + 1)) - np.log((n + 0.5) / (n_neg + 1)))


def _choose(counts: dict[str, tuple[int, int]], n_pos: int, n_neg: int) -> dict[str, float]:
    """Shortest precise prefixes, each lengthened as far as it keeps its positive documents, but not past a whole word; and doubtful whole words."""
    precise = {k for k, (p, n) in counts.items() if not k.endswith(" ") and _precise(p, n, n_pos, n_neg)}
    longer: dict[str, str] = {}  # of each prefix, the extension by one letter that keeps most positive documents
    for k in sorted(counts):
        best = longer.get(k[:-1])
        if best is None or counts[k][0] > counts[best][0]:
            longer[k[:-1]] = k
    chosen, covered = {}, set()
    for k in sorted(precise, key=lambda k: (len(k), k)):
        if any(k[:j] in covered for j in range(SHORTEST, len(k))):
            continue
        covered.add(k)
        while k in longer and not longer[k].endswith(" ") and counts[longer[k]][0] >= 0.97 * counts[k][0]:
            k = longer[k]
        chosen[k] = _weight(*counts[k], n_pos, n_neg)
    for k, (p, n) in counts.items():
        if k.endswith(" ") and not any(k[:j] in covered for j in range(SHORTEST, len(k))) and _precise(p, n, n_pos, n_neg, DOUBTFUL):
            chosen[k] = _weight(p, n, n_pos, n_neg)
    return {k: w for k, w in chosen.items() if w > 0}


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, float, float]:
    """Ridge logistic regression on the two match features, by Newton steps."""
    a = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(3)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        g = a.T @ (weight * (p - y)) + ridge * b
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + ridge * np.eye(3)
        b = b - np.linalg.solve(h, g)
    return float(b[0]), float(b[1]), float(b[2])


def learn(docs: DataFrame, labels: DataFrame, train: Column | None = None, sample: int = SAMPLE, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """Learn lexicon, exceptions, weights and coefficients from ``labels`` (doc_id, toxic) joined with ``docs``; ``exceptions`` are added.

    The driver receives the counts of prefixes and phrases that pass ``LEAST_DOCS`` in the sample, and three numbers per sampled
    row; both are bounded by ``sample``.
    """
    known = labels.filter(F.col("toxic").isNotNull()).filter(train if train is not None else F.lit(True)).select("doc_id", "toxic")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64(F.lit(6), "text"))
    known = texts.select("doc_id", "h").join(known, "doc_id").groupBy("toxic", "h").agg(F.min("doc_id").alias("doc_id"))
    ids = known.filter("toxic = 1").orderBy("h").limit(sample).unionAll(known.filter("toxic = 0").orderBy("h").limit(sample))
    # the broadcast side holds at most two samples of ids
    rows = texts.join(F.broadcast(ids), ["doc_id", "h"]).dropDuplicates(["toxic", "h"]).select("toxic", "text")
    rows = rows.persist()

    def counted(keys_of):
        """Per key of a text (``keys_of`` gives it a task's own function), the positive and the other texts that have it."""

        def count(batches):
            find = keys_of()
            for b in in_slices(batches, 1024):
                seen = Counter(), Counter()
                for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    seen[y].update(set(find(" ".join(fold(t).split()))))
                keys = [*(seen[0].keys() | seen[1].keys())]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([seen[y][k] for k in keys], pa.int64()) for y in (1, 0))], ["k", "p", "n"])

        return rows.mapInArrow(count, "k string, p long, n long").groupBy("k").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))

    try:
        size = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
        n_pos, n_neg = size.get(1, 0), size.get(0, 0)
        counts: dict[str, tuple[int, int]] = {}
        shortest, longest, stems = SHORTEST, FIRST, None
        while n_pos and (stems is None or stems):  # beginnings of any length, but only of words whose shorter ones are frequent

            def beginnings(shortest=shortest, longest=longest, stems=stems):
                return lambda folded: (p for w in set(folded.split()) for p in _prefixes(w, shortest, longest, stems))

            kept = counted(beginnings).filter((F.col("p") >= LEAST_DOCS) & (F.col("p") * 4 >= F.col("n"))).collect()
            counts |= {r.k: (r.p, r.n) for r in kept}
            stems = {r.k for r in kept if len(r.k) == longest and not r.k.endswith(" ")}
            shortest, longest = longest + 1, 2 * longest
        weights = _choose(counts, n_pos, n_neg)
        if weights:
            plain = Lexicon(weights, (), (0.0, 0.0, 0.0))

            def phrases():
                """Entry, side and the phrase of the matched word and the word on that side."""
                automaton = plain.automaton()

                def find(folded):
                    for s, e, _, k in plain.matches(automaton, folded):
                        end = folded.find(" ", e - 1) if not k.endswith(" ") else e - 1
                        word = folded[s : end if end >= 0 else len(folded)]
                        before = folded[folded.rfind(" ", 0, s - 1) + 1 : s - 1] if s else ""
                        yield f"{k}\t<\t{before} {word}"
                        if end >= 0 and end < len(folded):
                            stop = folded.find(" ", end + 1)
                            yield f"{k}\t>\t{word} {folded[end + 1 : stop if stop >= 0 else len(folded)]}"

                return find

            met = counted(phrases).withColumn("part", F.split("k", "\t"))
            wide = met.filter((F.col("part")[1] == "<") & (F.col("p") > 0)).groupBy(F.col("part")[0].alias("k")).agg(F.count(F.lit(1)).alias("c"))
            wide = {r.k for r in wide.filter(F.col("c") >= LEAST_CONTEXTS).collect()}
            harmless = F.col("p") <= (1 - PRECISION) * (F.col("p") + F.col("n") * F.lit(n_pos / max(n_neg, 1)))
            learned = [r.k.split("\t") for r in met.filter((F.col("n") >= LEAST_DOCS) & harmless).collect()]
            learned = [(k, phrase) for k, _, phrase in learned if k in wide and not phrase.startswith(" ")]
            weights = {k: w for k, w in weights.items() if k in wide}
        if weights:
            apart = Lexicon(weights, (*exceptions, *{phrase for _, phrase in learned}), (0.0, 0.0, 0.0))

            def entries():
                automaton = apart.automaton()
                return lambda folded: (k for *_, k in apart.matches(automaton, folded))

            final = [r for r in counted(entries).collect() if r.k in weights and _precise(r.p, r.n, n_pos, n_neg)]
            weights = {r.k: _weight(r.p, r.n, n_pos, n_neg) for r in final}
            exceptions = (*exceptions, *sorted({phrase for k, phrase in learned if k in weights}))
        weights = weights or {fold(k): 4.0 for k in FALLBACK}
        lexicon = Lexicon(weights, exceptions, (-3.0, 3.0, 1.0))
        if n_pos and n_neg:

            def measure(batches):
                automaton = lexicon.automaton()
                for b in in_slices(batches, 1024):
                    f = [lexicon.features(automaton, t) for t in b.column(1).to_pylist()]
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in f], pa.float64()), pa.array([y for _, y in f], pa.float64())], ["y", "a", "b"])

            kind = rows.schema["toxic"].dataType.simpleString()
            got = rows.mapInArrow(measure, f"y {kind}, a double, b double").groupBy("y", "a", "b").agg(F.count(F.lit(1)).alias("c")).collect()
            got = sorted((r.y, r.a, r.b, r.c) for r in got)
            y = np.array([r[0] for r in got for _ in range(r[3])])
            x = np.array([r[1:3] for r in got for _ in range(r[3])])
            lexicon.coefficients = _fit(x, y)
    finally:
        rows.unpersist()
    return lexicon


def score_documents(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``doc_id, score`` of every whole text."""

    def run(batches):
        automaton = lexicon.automaton()
        for b in in_slices(batches, 1024):
            scores = [lexicon.score(automaton, t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def keep_clean(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, all columns unchanged."""
    names, at = docs.columns, docs.columns.index("text")

    def run(batches):
        automaton = lexicon.automaton()
        for b in in_slices(batches, 1024):
            mask = [lexicon.score(automaton, t or "") < threshold for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(mask)) for c in b.columns], names)

    return docs.mapInArrow(run, docs.schema)


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_documents(docs, learn(docs, labels, ~held_out()))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
