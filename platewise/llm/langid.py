"""Language identification by prediction with partial matching.

Per language, a byte context tree of orders 0 to 3 holds how often each byte followed each context.
A byte's code comes from the longest context that the language knows. A byte seen there n times costs -log2 n / (N + D), where N is
how often the context occurred and D how many different bytes followed it; any other byte costs an escape, -log2 D / (N + D), and is
looked up one order lower (estimator C, without exclusions), down to eight bits. The statistics are frozen, so a text's code length
under a language is an exact sum over its bytes, and the language with the shortest code wins.

Spark counts the byte strings of all labelled rows, over their whole texts, and every string counts. The trees of all languages
are laid out together: for each context a bit map of the bytes that followed it, and for each such string its code under every
language, worked out once. A model is broadcast only up to ``BLOCK`` strings; beyond that, languages, and the strings of one language by the
byte before the last, are dealt among blocks that are broadcast one after another, each in a pass of its own that adds its share of every
text's code lengths. Sums don't depend on the blocks. Prediction covers every row and whole texts.

Defined results: null texts and texts without a letter give ``und`` with score 0; with no
learned language all rows give ``und``; ties go to the language first by code point; repeated rows get equal results;
further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: The longest context in bytes, and most strings (of all languages together) that one broadcast holds. A single language's strings with
#: one byte before the last are never divided; there are at most 2 ** 24 of them.
ORDER, BLOCK = 3, 4_000_000
#: Most strings times languages of a block of several languages: its tables have a number for each.
CELLS = 16_000_000
#: Byte positions that are counted at a time, and distinct strings that a task holds before it sums them up.
CHUNK, HELD = 1 << 22, 1 << 21
#: Code lengths (bytes times languages) that a task works out at a time.
CODES = 1 << 21


class ContextTrees:
    """Frozen statistics of some languages, for bytes whose byte before lies in ``low`` to ``high``; a text's first byte counts as ``low`` 0."""

    def __init__(self, langs: list[str], lang: np.ndarray, size: np.ndarray, g: np.ndarray, n: np.ndarray, low: int = 0, high: int = 255):
        """One entry per string: the number of its language, its length, its bytes as one number, and how often it occurred."""
        self.langs, self.low, self.high = langs, low, high
        strings, parents, escapes, bits, starts, maps = [], [], [], [], [], []
        rows = done = 0
        below: tuple = ()
        for k in range(1, ORDER + 2):
            mine = size == k
            every = np.unique(g[mine])
            contexts = np.unique(every >> 8) if k > 1 else np.zeros(1, dtype=np.int64)
            owner = np.searchsorted(contexts, every >> 8)
            shorter = (1 << 8 * (k - 1)) - 1
            code = np.full((len(every), len(langs)), 8.0) if k == 1 else below[1][np.searchsorted(below[0], every & shorter)]
            escape = np.zeros((len(contexts), len(langs)))
            for j in range(len(langs)):
                own = mine & (lang == j)
                at = np.searchsorted(every, g[own])
                total = np.bincount(owner[at], weights=n[own], minlength=len(contexts))
                kinds = np.bincount(owner[at], minlength=len(contexts))
                known = kinds > 0
                escape[known, j] = np.log2((total[known] + kinds[known]) / kinds[known])
                code[:, j] += escape[owner, j]
                code[at, j] = np.log2((total + kinds)[owner[at]] / n[own])
            # bit maps of the bytes that followed, and where the codes of each quarter of them start
            seen = np.zeros((len(contexts), 256), dtype=bool)
            seen[owner, every & 255] = True
            quarters = np.packbits(seen.reshape(-1, 64), axis=1, bitorder="little").view("<u8").reshape(-1)
            counts = np.bitwise_count(quarters).astype(np.int64)
            maps.append(quarters)
            starts.append(done + np.cumsum(counts) - counts)
            parents.append(np.full(1, -1) if k == 1 else below[2] + np.searchsorted(below[3], contexts & (shorter >> 8)))
            strings.append(contexts)
            escapes.append(escape)
            bits.append(code)
            below = (every, code, rows, contexts)
            rows, done = rows + len(contexts), done + len(every)
        self.maps, self.starts, self.parents = np.concatenate(maps), np.concatenate(starts), np.concatenate(parents).astype(np.int64)
        self.escapes, self.bits = np.concatenate(escapes).astype(np.float32), np.concatenate(bits).astype(np.float32)
        # for each three classes of bytes, nearest last, the longest known context; bytes that never occurred share a class
        met = np.unique(g[size == 1])
        self.classes = np.full(256, len(met), dtype=np.int64)
        self.classes[met] = np.arange(len(met))
        a = len(met) + 2  # the last class stands for the text's beginning
        table, c = np.zeros((a, a, a), dtype=np.int32), self.classes
        first = np.cumsum([0, *map(len, strings)])
        one, two, three = strings[1:]
        table[:, :, c[one]] = first[1] + np.arange(len(one))
        table[:, c[two >> 8], c[two & 255]] = first[2] + np.arange(len(two))
        table[c[three >> 16], c[three >> 8 & 255], c[three & 255]] = first[3] + np.arange(len(three))
        self.width, self.context = a, table.reshape(-1)

    def code_lengths(self, blob: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Bits of each text under each language. ``blob`` holds the texts' bytes on end, ``starts`` where each begins (none is empty)."""
        total, step = np.zeros((len(starts), len(self.langs))), max(1, CODES // len(self.langs))
        for at in range(0, len(blob), step):  # a long text is summed piece by piece
            low, high = max(0, at - ORDER), min(at + step, len(blob))
            a, b = np.searchsorted(starts, (low, high))
            codes = self._codes(blob[low:high], starts[a:b] - low)[at - low :]
            first = np.searchsorted(starts, at, side="right") - 1
            cuts = np.concatenate([[at], starts[first + 1 : b]]) - at
            total[first:b] += np.add.reduceat(codes, cuts, axis=0, dtype=np.float64)
        return total

    def _codes(self, blob: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Bits of each byte under each language."""
        a, c = self.width, self.classes[blob]
        before = [np.concatenate([np.full(min(k, len(c)), a - 1), c[:-k]]) for k in (1, 2, 3)]
        for k, b in enumerate(before):  # no context reaches into the text in front
            for j in range(k + 1):
                at = starts + j
                b[at[at < len(b)]] = a - 1
        # a start mark written for a text shorter than three bytes may fall into the next text; that text's own marks cover it
        row = self.context[(before[2] * a + before[1]) * a + before[0]].astype(np.int64)
        symbol = blob.astype(np.int64)
        out = np.zeros((len(blob), len(self.langs)), dtype=np.float32)
        if self.low or self.high < 255:
            last = np.concatenate([[0], symbol[:-1]])
            last[starts] = 0
            todo = np.flatnonzero((last >= self.low) & (last <= self.high))
        else:
            todo = np.arange(len(blob))
        while len(todo):
            at, s = row[todo], symbol[todo]
            quarter = at * 4 + (s >> 6)
            seen, bit = self.maps[quarter], np.left_shift(np.uint64(1), (s & 63).astype(np.uint64))
            hit = (seen & bit) != 0
            place = self.starts[quarter[hit]] + np.bitwise_count(seen[hit] & (bit[hit] - np.uint64(1)))
            out[todo[hit]] += self.bits[place]
            todo, at = todo[~hit], at[~hit]
            out[todo] += self.escapes[at]
            row[todo] = self.parents[at]
            lost = row[todo] < 0
            out[todo[lost]] += 8
            todo = todo[~lost]
        return out


def _sum_up(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and the sums of their counts."""
    c, n = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(c, kind="stable")
    c, n = c[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
    return c[at], np.add.reduceat(n, at)


def count_strings(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """How often each byte stands behind the three bytes in front of it, or as many as there are: their number (shifted by 32 bits) and all of them
    as one number."""
    a = np.frombuffer(b"".join(raws), dtype=np.uint8)
    sizes = np.array([len(r) for r in raws])
    starts = np.cumsum(sizes) - sizes
    inner = np.ones(len(a), dtype=bool)
    codes, counts, head = [], [], np.zeros(len(raws), dtype=np.int64)
    for k in range(ORDER):  # bytes near a text's beginning have shorter contexts
        long = sizes > k
        starts, sizes, head = starts[long], sizes[long], head[long]
        inner[starts + k] = False
        head = head << 8 | a[starts + k]
        c, n = np.unique(head, return_counts=True)
        codes.append(c | (k + 1) << 32)
        counts.append(n)
    for at in range(0, len(a) - ORDER, CHUNK):
        x = a[at : at + CHUNK + ORDER].astype(np.uint32)
        code = x[:-3] << 24 | x[1:-2] << 16 | x[2:-1] << 8 | x[3:]
        c, n = np.unique(code[inner[at + ORDER : at + ORDER + CHUNK]], return_counts=True)
        codes.append(c.astype(np.int64) | 4 << 32)
        counts.append(n)
    return _sum_up(codes, counts)


@dataclass
class Model:
    """All counted strings (``lang, size, g, n``; a written table), the languages by code point, and how the strings are dealt among blocks: the
    numbers of each block's languages and the bounds of the byte before the last."""

    strings: DataFrame
    langs: list[str]
    blocks: list[tuple[list[int], int, int]]

    def trees(self, block: int) -> ContextTrees:
        numbers, low, high = self.blocks[block]
        here = F.col("lang").isin([self.langs[j] for j in numbers]) & ((F.col("size") == 1) | _before().between(low, high))
        got = self.strings.filter(here).select("lang", "size", "g", "n").toArrow()
        names = [self.langs[j] for j in numbers]
        lang = got.column("lang").combine_chunks().dictionary_encode()
        number = np.array([names.index(x) for x in lang.dictionary.to_pylist()], dtype=np.int64)[lang.indices.to_numpy()]
        return ContextTrees(names, number, *(got.column(c).to_numpy() for c in ("size", "g", "n")), low, high)


def _before() -> Column:
    """The byte before a string's last one."""
    return F.shiftright("g", 8).bitwiseAND(F.lit(255))


def divide(sizes: dict[tuple[int, int], int], n_langs: int, block: int) -> list[tuple[list[int], int, int]]:
    """Blocks of at most ``block`` strings, and ``CELLS`` strings times languages: several whole languages, or one language and a run of bytes.
    ``sizes[language, byte]``."""
    out: list[tuple[list[int], int, int]] = []
    group, held = [], 0
    for j in range(n_langs):
        mine = [sizes.get((j, b), 0) for b in range(256)]
        if group and (held + sum(mine) > block or (held + sum(mine)) * (len(group) + 1) > CELLS):
            out, group, held = [*out, (group, 0, 255)], [], 0
        if sum(mine) <= block:
            group, held = [*group, j], held + sum(mine)
            continue
        low = run = 0
        for b in range(256):
            if run and run + mine[b] > block:
                out, low, run = [*out, ([j], low, b - 1)], b, 0
            run += mine[b]
        out.append(([j], low, 255))
    return [*out, (group, 0, 255)] if group else out


def learn(docs: DataFrame, train: Column | None = None, block: int = BLOCK) -> Model | None:
    """Count the byte strings of all labelled rows by Spark; None if nothing is labelled."""
    known = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).filter(train if train is not None else F.lit(True))

    def count(batches):
        held: dict[str, tuple[list, list]] = {}

        def rows(lang):
            c, n = _sum_up(*held.pop(lang))
            for at in range(0, len(c), 1 << 17):
                part = slice(at, at + (1 << 17))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c[part]), pa.string()), pa.array(c[part]), pa.array(n[part], pa.int64())], ["lang", "code", "n"])

        for b in batches:
            of: dict[str, list[int]] = {}
            raw = b.column(1).to_pylist()
            for i, lang in enumerate(b.column(0).to_pylist()):
                if raw[i]:
                    of.setdefault(lang, []).append(i)
            for lang, have in of.items():
                for part in _parts(have, raw, CHUNK):
                    c, n = count_strings([raw[i] for i in part])
                    codes, counts = held.setdefault(lang, ([], []))
                    codes.append(c)
                    counts.append(n)
                    if len(codes) > 1 and sum(map(len, codes)) > HELD:
                        summed = _sum_up(codes, counts)
                        held[lang] = ([summed[0]], [summed[1]])
                        if len(summed[0]) > HELD:
                            yield from rows(lang)
        for lang in sorted(held):
            yield from rows(lang)

    grams = known.select("lang", F.encode("text", "UTF-8").alias("raw")).mapInArrow(count, "lang string, code long, n long")
    grams = grams.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    each = [F.struct(F.lit(k).alias("size"), F.expr(f"code & {(1 << 8 * k) - 1}L").alias("g")) for k in range(1, ORDER + 2)]
    ends = F.filter(F.array(*each), lambda s: s["size"] <= F.shiftright("code", 32))
    strings = grams.select("lang", "n", F.explode(ends).alias("s")).groupBy("lang", "s.size", "s.g").agg(F.sum("n").alias("n"))
    strings = materialise(strings, "strings")
    counted = strings.groupBy("lang", _before().alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 256 rows a language
    langs = sorted({r.lang for r in counted})
    return Model(strings, langs, divide({(langs.index(r.lang), r.b): r.n for r in counted}, len(langs), block)) if langs else None


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, lang_pred, score, bits_per_byte`` for every whole text; ``score`` is the share of the winner in 2^-bits."""
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select("doc_id", F.when(letter, F.encode(F.col("text"), "UTF-8")).alias("raw"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    if model is None:
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits_per_byte"))
    names, context = model.langs, docs.sparkSession.sparkContext

    def passed(rows: DataFrame, block: int) -> DataFrame:
        """``rows`` with the code lengths of one block added to those of the blocks before."""
        shared, numbers, final, first = context.broadcast(model.trees(block)), model.blocks[block][0], block == len(model.blocks) - 1, block == 0

        def run(batches):
            trees = shared.value
            for b in batches:
                raw = b.column(1).to_pylist()
                bits = np.zeros((len(raw), len(names)))
                if not first:
                    bits = b.column(2).flatten().to_numpy().reshape(bits.shape).copy()
                have = [i for i, r in enumerate(raw) if r]
                for part in _parts(have, raw, CODES):
                    sizes = np.array([len(raw[i]) for i in part])
                    blob = np.frombuffer(b"".join(raw[i] for i in part), dtype=np.uint8)
                    bits[np.ix_(part, numbers)] += trees.code_lengths(blob, np.cumsum(sizes) - sizes)
                if not final:
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(bits), pa.list_(pa.float64()))], ["doc_id", "raw", "bits"])
                    continue
                pred, score, rate = ["und"] * len(raw), np.zeros(len(raw)), [None] * len(raw)
                best = bits.argmin(axis=1)
                least = bits.min(axis=1)
                share = 1.0 / np.exp2(np.clip(least[:, None] - bits, -1000, 0)).sum(axis=1)
                for i in have:
                    pred[i], score[i], rate[i] = names[best[i]], share[i], least[i] / len(raw[i])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(pred, pa.string()), pa.array(score), pa.array(rate, pa.float64())], ["doc_id", "lang_pred", "score", "bits_per_byte"]
                )

        schema = f"doc_id {kind}, lang_pred string, score double, bits_per_byte double" if final else f"doc_id {kind}, raw binary, bits array<double>"
        return rows.mapInArrow(run, schema)

    for block in range(len(model.blocks) - 1):
        rows = materialise(passed(rows, block), "code-lengths")
    return passed(rows, len(model.blocks) - 1)


def _parts(have, raw, most: int):
    """Runs of texts of about ``most`` bytes."""
    part, size = [], 0
    for i in have:
        part.append(i)
        size += len(raw[i])
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = predict(docs, learn(docs, ~held_out()))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
