"""Near-duplicate groups by SimHash fingerprints and deletion-variant signatures.

A fingerprint has 64 bits; two documents link if theirs differ in at most two. Each fingerprint is
cut into two segments of 32 bits. If two differ in at most two bits, the lower segment differs by at most
one bit, or the upper ones are equal. So every fingerprint is indexed under 32 one-wildcard
variants of its lower segment and under its upper segment, an equality join brings candidates
together, and the bit count of the difference verifies them. Every pair is reported by one bucket only.

Buckets hold distinct fingerprints, so copies never meet there. A bucket larger than ``bucket`` is not
paired off: its members are keyed by every pattern with at most two wildcards that such a pair can
share, and all members of a key, which differ in at most two bits by construction, link to the smallest.

Components are found by alternating large-star and small-star steps on the links.

``keep_similar`` asks for more than bits can tell: it links texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or
more. At that similarity two fingerprints differ in about ten of 64 bits, and signatures for ten bits (six segments of ten bits) would
put every text into buckets that hold a five-hundredth of all texts. So the signatures for two bits bring the first candidates, an
equality join on prefixes of ordered shingle sets brings the rest (two such sets share one of the first ``n - ceil(0.8 n) + 1`` shingles in any
order), and the whole sets verify every pair. The order decides only the cost: shingles are counted over all documents, by parts of their hashes, and frequent ones come
last, so that passages repeated over many documents bring no candidates. Of each shared prefix shingle all texts are first verified against the one
with the fewest rarer shingles and against the largest one, then against the first text of another group that is still apart, twice; last come all pairs of texts that share one and are not yet in one component. Texts that are equal word for word are one node;
shingles are compared by 64-bit hashes, texts shorter than a shingle are one shingle, texts without words are one node.

Defined results: null text is empty text; texts without words have fingerprint zero and link like
others; equal texts are one node; rows that share a doc_id are one document, so ``keep_one`` and ``keep_similar`` keep or drop
them together; null doc_ids are kept and are nobody's representative; an empty table gives an empty result; further columns are ignored,
or pass through where documents are kept.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, in_slices, materialise, scratch_dir
from .words import byte_kinds, hashes, in_byte_slices, mixed, split

SHINGLE, BUCKET = 3, 256
#: Shingles of ``keep_similar``; its similarity is NUMERATOR / (NUMERATOR + 1) = 0.8, in whole numbers.
WIDTH, NUMERATOR = 5, 4
#: Documents that a shingle of the order is in at least (copies count as often as tasks meet them), most shingles that the order
#: knows (the most frequent ones), and words of a part of the counting.
LEAST, FREQUENT, PART_WORDS = 8, 4_000_000, 4_000_000
#: Texts and pairs that a task works on at a time.
ROWS = 256
#: Further centres that the texts of a shingle are tried with before its pairs.
ROUNDS = 2
_KINDS = byte_kinds(b" \t\n\x0b\x0c\r")
_ODD = np.uint64(0xD6E8FEB86659FD93)
_LOW = (1 << 32) - 1


def fingerprint(raw: bytes, width: int = SHINGLE) -> int:
    """SimHash of the ``width``-word shingles of UTF-8 text, A-Z lower-cased, repeats included."""
    from xxhash import xxh64_intdigest

    words = raw.lower().split()  # of bytes: ASCII letters and the six ASCII white-space characters
    if not words:
        return 0
    if len(words) < width:
        return xxh64_intdigest(b" ".join(words), 42)
    ones, n = np.zeros(64, dtype=np.int64), len(words) - width + 1
    for at in range(0, n, 1 << 16):
        part = words[at : at + (1 << 16) + width - 1]
        hashes = [xxh64_intdigest(b" ".join(s), 42) for s in zip(*(part[k:] for k in range(width)))]
        bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` (fp: the fingerprint's 64 bits as a signed long)."""

    def run(batches):
        for b in in_slices(batches, ROWS):
            fps = np.array([fingerprint(r, width) if r else 0 for r in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.encode(F.col("text"), "UTF-8").alias("raw")).mapInArrow(run, f"doc_id {kind}, fp long")


def _low(x):
    return x.bitwiseAND(F.lit(_LOW))


def _high(x):
    return F.shiftrightunsigned(x, 32)


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links ``(a, b)`` between the distinct fingerprints ``fp``: each pair in small buckets, stars in large ones."""
    low = F.transform(
        F.sequence(F.lit(0), F.lit(31)),
        lambda p: F.struct(p.alias("p"), F.call_function("shiftleft", F.lit(1).cast("long"), p).alias("bit")),
    )
    signed = fps.select("fp", F.explode(low).alias("w")).select(
        "fp", F.col("w.p").alias("p"), _low(F.col("fp")).bitwiseAND(F.bitwise_not(F.col("w.bit"))).alias("v")
    )
    signed = signed.unionAll(fps.select("fp", F.lit(32).alias("p"), _high(F.col("fp")).alias("v")))
    met = signed.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("p", "v"))).filter("n > 1")
    small = met.filter(F.col("n") <= bucket).groupBy("p", "v").agg(F.collect_list("fp").alias("m"))

    def verified(x, y, p):
        d = x.bitwiseXOR(y)
        here = F.when(p == 32, F.bit_count(_low(d)) == 2).otherwise(
            ((_low(d) == 0) & (p == 0)) | (_low(d) == F.call_function("shiftleft", F.lit(1).cast("long"), p))
        )
        return (y > x) & (F.bit_count(d) <= 2) & here

    pairs = F.flatten(
        F.transform("m", lambda x: F.transform(F.filter("m", lambda y: verified(x, y, F.col("p"))), lambda y: F.struct(x.alias("a"), y.alias("b"))))
    )
    paired = small.select(F.explode(pairs).alias("l")).select("l.a", "l.b")

    large = met.filter(F.col("n") > bucket).select("fp", "p", "v")
    ones = [1 << j for j in range(32)]
    twos = [(1 << i) | (1 << j) for i in range(32) for j in range(i)]
    arr = lambda xs: F.expr("array(" + ",".join(f"{x}L" for x in xs) + ")")
    # lower wildcard p (or none), upper segment with one wildcard, and from p = 0 also upper with two and lower exact
    star1 = large.filter("p < 32").withColumn("mask", F.explode(arr(ones))).select("fp", "p", "v", "mask", _high(F.col("fp")).bitwiseAND(F.bitwise_not(F.col("mask"))).alias("rest"))
    star2 = large.filter("p = 0").withColumn("mask", F.explode(arr(twos))).select("fp", F.lit(33).alias("p"), _low(F.col("fp")).alias("v"), "mask", _high(F.col("fp")).bitwiseAND(F.bitwise_not(F.col("mask"))).alias("rest"))
    star3 = large.filter("p = 32").withColumn("mask", F.explode(arr(twos))).select("fp", "p", "v", "mask", _low(F.col("fp")).bitwiseAND(F.bitwise_not(F.col("mask"))).alias("rest"))
    stars = star1.unionAll(star2).unionAll(star3)
    centre = stars.groupBy("p", "v", "mask", "rest").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).filter("a < z")
    starred = stars.join(centre, ["p", "v", "mask", "rest"]).filter("fp > a").select("a", F.col("fp").alias("b")).distinct()
    return paired.unionAll(starred)


def components(edges: DataFrame, rounds: int = 60, made: list[str] | None = None) -> DataFrame:
    """``node, root`` for the nodes of undirected ``edges`` (a, b); root is the smallest node reachable. Paths of its tables are added to ``made``."""
    e = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "links", made)
    mark, paths = None, [f"{scratch_dir(edges.sparkSession)}/stars-{uuid.uuid4().hex}-{k}" for k in (0, 1)]
    if made is not None:
        made += paths
    for k in range(rounds):
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.filter("v > u").join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        e.write.mode("overwrite").parquet(paths[k % 2])  # over the table of the round before the last, which nothing reads any more
        e = edges.sparkSession.read.schema(e.schema).parquet(paths[k % 2])
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now
    raise RuntimeError("components: not converged")


def near_duplicates(docs: DataFrame, width: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """``doc_id, fp, component_id`` of every row; component_id is the smallest doc_id reachable by links."""
    found = materialise(fingerprints(docs, width), "fingerprints")
    nodes = materialise(found.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    pairs = links(nodes.select("fp"), bucket)
    a, b = nodes.select(F.col("fp").alias("a"), F.col("first").alias("fa")), nodes.select(F.col("fp").alias("b"), F.col("first").alias("fb"))
    edges = pairs.join(a, "a").join(b, "b").select(F.col("fa").alias("a"), F.col("fb").alias("b"))
    roots = components(edges)
    named = nodes.join(roots, nodes["first"] == roots["node"], "left").select("fp", F.coalesce("root", "first").alias("component_id"))
    return found.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, width: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest doc_id."""
    return _kept(docs, near_duplicates(docs, width, bucket).select("component_id"))


def _kept(docs: DataFrame, first: DataFrame) -> DataFrame:
    first = first.unionAll(first.sparkSession.createDataFrame([(None,)], first.schema)).distinct()  # null doc_ids stay
    return docs.join(first, docs["doc_id"].eqNullSafe(first["component_id"]), "left_semi")


class Shingled:
    """Some texts: the number of words, a number for the sequence of words, and the hashes of the ``WIDTH``-word shingles, repeats included, of each."""

    def __init__(self, texts: pa.Array):
        w = split(texts, _KINDS)
        self.words = np.bincount(w.text, minlength=len(texts)).astype(np.int64)
        start = np.concatenate([[0], np.cumsum(self.words)])
        own = hashes(w.distinct)[w.code] if len(w.code) else np.zeros(0, dtype=np.uint64)
        place = np.arange(len(own)) - start[w.text]
        node = np.zeros(len(texts), dtype=np.uint64)
        some = self.words > 0
        if some.any():
            node[some] = np.add.reduceat(mixed(own ^ mixed(place.astype(np.uint64))), start[:-1][some])
        self.node = mixed(node + self.words.astype(np.uint64)).view(np.int64)
        shingle = own
        for k in range(1, WIDTH):  # a text of fewer words is one shingle, with zeros at its end
            after = np.zeros(len(own), dtype=np.uint64)
            after[: len(own) - k] = np.where(w.text[k:] == w.text[: len(own) - k], own[k:], np.uint64(0))
            shingle = mixed(shingle * _ODD + after)
        self.shingles = shingle[(place == 0) | (place <= self.words[w.text] - WIDTH)].view(np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(np.where(some, np.maximum(1, self.words - WIDTH + 1), 0))])

    def all_of(self, t: int) -> np.ndarray:
        return self.shingles[self.bounds[t] : self.bounds[t + 1]]

    def set_of(self, t: int) -> np.ndarray:
        """Hashes of the distinct shingles, ascending."""
        return np.unique(self.all_of(t))

    def fingerprint(self, t: int) -> np.int64:
        h = self.all_of(t)
        ones = sum(np.unpackbits(h[at : at + (1 << 16)].byteswap().view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64) for at in range(0, len(h), 1 << 16))
        return np.packbits(2 * ones > len(h)).view(">i8")[0] if len(h) else np.int64(0)


def prefix_size(n: int) -> int:
    """How many of ``n`` shingles two similar sets share one of."""
    return n - -(-NUMERATOR * n // (NUMERATOR + 1)) + 1


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("text").cast("string").alias("text"))


def nodes_of(docs: DataFrame) -> DataFrame:
    """``doc_id, node, fp, words``: one number for texts of equal words, the fingerprint and the number of words."""

    def run(batches):
        for b in in_byte_slices(batches, 1):
            s = Shingled(b.column(1))
            fps = np.array([s.fingerprint(t) for t in range(b.num_rows)], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s.node), pa.array(fps), pa.array(s.words)], ["doc_id", "node", "fp", "words"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, node long, fp long, words long")


def _once(batches):
    """Slices of a task's texts as (node, set), without those whose words it has met (as far as it remembers) or that have none."""
    seen: set[int] = set()
    for b in in_byte_slices(batches, 0):
        s, out = Shingled(b.column(0)), []
        for t, node in enumerate(s.node.tolist()):
            if s.words[t] and node not in seen:
                if len(seen) < 1_000_000:
                    seen.add(node)
                out.append((node, s.set_of(t)))
        if out:
            yield out


def frequent(docs: DataFrame, words: int, most: int = FREQUENT) -> tuple[np.ndarray, int]:
    """The leading bits of frequent shingles, the most frequent last, and how many bits those are. ``words``: of all documents.

    A task sends each part of the hash space the sorted hashes that fall there as differences, whose high bytes are nearly all zero and compress;
    a part counts them. The driver receives at most ``most`` of them.
    """
    bits = max(4, (words // PART_WORDS).bit_length())
    shift = np.uint64(32 - bits)

    def rows(hashes):
        key = np.sort(np.concatenate(hashes).view(np.uint64) >> shift)  # of a part and 32 bits
        part = (key >> np.uint64(32)).astype(np.int32)
        at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        blobs = []
        for s, e in zip(at, [*at[1:], len(key)]):
            code = (key[s:e] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            blobs.append(np.diff(code, prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.tobytes())
        return pa.RecordBatch.from_arrays([pa.array(part[at]), pa.array(blobs, pa.binary())], ["part", "codes"])

    def run(batches):
        held, n = [], 0
        for texts in _once(batches):
            held += [h for _, h in texts]
            n += sum(map(len, held[-len(texts) :]))
            if n > 1 << 21:
                yield rows(held)
                held, n = [], 0
        if held:
            yield rows(held)

    def count(t: pa.Table) -> pa.Table:
        codes = []
        for x in t.column("codes").to_pylist():
            steps = np.ascontiguousarray(np.frombuffer(x, dtype=np.uint8).reshape(4, -1).T).view(np.uint32).reshape(-1)
            codes.append(np.cumsum(steps, dtype=np.uint32))
        code = np.sort(np.concatenate(codes))
        at = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        n = np.diff(np.append(at, len(code)))
        many = n >= LEAST
        key = np.int64(t.column("part")[0].as_py()) << 32 | code[at][many].astype(np.int64)
        return pa.table({"key": pa.array(key), "n": pa.array(n[many], pa.int64())})

    made: list[str] = []
    counted = _texts(docs).mapInArrow(run, "part int, codes binary").groupBy("part").applyInArrow(count, "key long, n long")
    counted = materialise(counted, "frequent", made)
    sizes = sorted(((r.n, r["count"]) for r in counted.groupBy("n").count().collect()), reverse=True)  # a row a number of documents
    least, held = None, 0
    for n, size in sizes:
        held += size
        if held > most:
            break
        least = n
    got = counted.filter(F.col("n") >= least).toArrow() if least else None
    discard(docs.sparkSession, made)
    if got is None:
        return np.zeros(0, dtype=np.uint64), bits
    key, n = got.column("key").to_numpy(), got.column("n").to_numpy()
    return key[np.lexsort((key, n))].view(np.uint64), bits


def prefixes(docs: DataFrame, last: np.ndarray, bits: int) -> DataFrame:
    """``h, node, n, pos``: the prefix shingles of each node, its number of shingles and their places in the order."""
    order = np.argsort(last, kind="stable")
    shared = docs.sparkSession.sparkContext.broadcast((last[order], (order + 1).astype(np.int32)))
    shift = np.uint64(32 - bits)

    def run(batches):
        codes, rank = shared.value
        for texts in _once(batches):
            hs, ns, sizes, places = [], [], [], []
            for node, h in texts:
                late = np.zeros(len(h), dtype=np.int32)
                if len(codes):
                    key = h.view(np.uint64) >> shift
                    at = np.minimum(np.searchsorted(codes, key), len(codes) - 1)
                    late = np.where(codes[at] == key, rank[at], 0)
                k = prefix_size(len(h))
                hs.append(h[np.lexsort((h, late))][:k])
                ns.append(np.full(k, node, dtype=np.int64))
                sizes.append(np.full(k, len(h), dtype=np.int32))
                places.append(np.arange(k, dtype=np.int32))
            cols = [pa.array(np.concatenate(x)) for x in (hs, ns, sizes, places)]
            for at in range(0, len(cols[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([c.slice(at, 1 << 16) for c in cols], ["h", "node", "n", "pos"])

    return _texts(docs).mapInArrow(run, "h long, node long, n int, pos int")


def _possible(a: str, b: str) -> Column:
    """Whether two sets whose first common shingle has these places can be similar."""
    least = F.least(F.col(f"{a}n") - F.col(f"{a}pos"), F.col(f"{b}n") - F.col(f"{b}pos"))
    return (2 * NUMERATOR + 1) * least >= NUMERATOR * (F.col(f"{a}n") + F.col(f"{b}n"))


def verified(docs: DataFrame, pairs: DataFrame, made: list[str]) -> DataFrame:
    """The ``pairs`` (a, b) of nodes whose whole sets are similar."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()

    def sets(batches):
        for texts in _once(batches):
            for at in range(0, len(texts), ROWS):
                part = texts[at : at + ROWS]
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in part], pa.int64()), pa.array([h.tobytes() for _, h in part], pa.binary())], ["node", "packed"])

    def check(batches):
        for b in in_slices(batches, ROWS):
            mask = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_buffer(), dtype=np.int64), np.frombuffer(y.as_buffer(), dtype=np.int64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                mask.append((2 * NUMERATOR + 1) * both >= NUMERATOR * (len(x) + len(y)))
            yield pa.RecordBatch.from_arrays([b.column(k).filter(pa.array(mask, pa.bool_())) for k in (0, 1)], ["a", "b"])

    packed = _texts(docs).mapInArrow(sets, "node long, packed binary").join(wanted, "node", "left_semi").dropDuplicates(["node"])
    packed = materialise(packed, "shingles", made)
    left, right = packed.select(F.col("node").alias("a"), F.col("packed").alias("x")), packed.select(F.col("node").alias("b"), F.col("packed").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def near_bits(nodes: DataFrame, made: list[str], bucket: int = BUCKET) -> DataFrame:
    """Pairs ``(a, b)`` of nodes whose fingerprints differ in at most two bits: each fingerprint's nodes with its smallest one, and the smallest of
    linked fingerprints."""
    first = materialise(nodes.groupBy("fp").agg(F.min("node").alias("node")), "fingerprints", made)
    equal = nodes.join(first.withColumnRenamed("node", "a"), "fp").filter("node > a").select("a", F.col("node").alias("b"))
    x, y = (first.select(F.col("fp").alias(f), F.col("node").alias(n)) for f, n in (("x", "u"), ("y", "v")))
    linked = links(first.select("fp"), bucket).select(F.col("a").alias("x"), F.col("b").alias("y")).join(x, "x").join(y, "y")
    return equal.unionAll(linked.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")))


def _ordered(x: Column | str, y: Column | str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def similar_links(docs: DataFrame, nodes: DataFrame, words: int, made: list[str]) -> DataFrame:
    """Links ``(a, b)`` of similar nodes that connect each group of near copies. ``nodes`` has ``node, fp``.

    What is known of all texts of a shingle (its centres, whether they are linked already) is aggregated and joined back, so that no task holds the texts
    of a shingle. Both go by the same shuffle.
    """
    rows = prefixes(docs, *frequent(docs, words)).repartition("h").distinct()
    end = F.struct("pos", "node", "n")
    # the text with the fewest rarer shingles is the likeliest to be what the others were made from
    of = rows.groupBy("h").agg(F.min(end).alias("first"), F.max(F.struct("node", "n", "pos")).alias("last"), F.count(F.lit(1)).alias("size")).filter("size > 1").drop("size")
    met = materialise(rows.join(of, "h"), "prefixes", made)
    ends = [met.select("node", "n", "pos", *[F.col(f"{end}.{c}").alias(f"f{c}") for c in ("node", "n", "pos")]) for end in ("first", "last")]
    star = ends[0].unionAll(ends[1]).filter("node <> fnode").filter(_possible("", "f")).select(*_ordered("node", "fnode"))
    tried = materialise(star.unionAll(near_bits(nodes, made)).distinct(), "candidates", made)
    found = materialise(verified(docs, tried, made), "verified", made)
    now = met.select("h", "node", "n", "pos")
    for k in range(ROUNDS + 1):
        roots = components(found, made=made).select("node", "root")
        now = now.join(roots, "node", "left").select("h", "node", "n", "pos", F.coalesce("root", "node").alias("root")).repartition("h")
        apart = now.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").drop("low", "high")
        now = materialise(now.join(apart, "h", "left_semi"), f"open-{k}", made)
        if now.isEmpty():
            return found
        if k == ROUNDS:
            break
        # of each shingle's groups but the one of its first text, the first text is tried with the texts of the others
        one = F.min(F.struct("pos", "node", "n", "root"))
        first = now.groupBy("h").agg(one.alias("f")).select("h", F.col("f.root").alias("froot"))
        other = now.join(first, "h").filter("root <> froot").groupBy("h").agg(one.alias("c")).select("h", *[F.col(f"c.{c}").alias(f"f{c}") for c in ("pos", "node", "n", "root")])
        each = now.join(other, "h").filter("root <> froot").filter(_possible("", "f")).select(*_ordered("node", "fnode")).distinct()
        new = materialise(each.join(tried, ["a", "b"], "left_anti"), "candidates", made)
        now = now.drop("root")
        if not new.isEmpty():
            tried, found = tried.unionAll(new), found.unionAll(materialise(verified(docs, new, made), "verified", made))
    x, y = (now.select("h", *[F.col(c).alias(f"{s}{c}") for c in ("node", "n", "pos", "root")]) for s in "xy")
    rest = x.join(y, "h").filter("xnode < ynode and xroot <> yroot").filter(_possible("x", "y")).select(F.col("xnode").alias("a"), F.col("ynode").alias("b")).distinct()
    rest = materialise(rest.join(tried, ["a", "b"], "left_anti"), "candidates", made)
    return found.unionAll(verified(docs, rest, made))


def keep_similar(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of near copies: the one with the smallest doc_id."""
    made: list[str] = []
    found = materialise(nodes_of(docs), "nodes", made)
    nodes = materialise(found.groupBy("node").agg(F.min("doc_id").alias("first"), F.first("fp").alias("fp")), "firsts")
    pairs = similar_links(docs, nodes.select("node", "fp"), found.agg(F.sum("words")).first()[0] or 0, made)
    a, b = nodes.select(F.col("node").alias("a"), F.col("first").alias("fa")), nodes.select(F.col("node").alias("b"), F.col("first").alias("fb"))
    roots = components(pairs.join(a, "a").join(b, "b").select(F.col("fa").alias("a"), F.col("fb").alias("b")))
    first = nodes.join(roots, nodes["first"] == roots["node"], "left").select(F.coalesce("root", "first").alias("component_id"))
    discard(docs.sparkSession, made)  # what is returned reads the nodes and their roots only
    return _kept(docs, first)


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
