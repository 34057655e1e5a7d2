"""Single linkage as a tree, and components of graphs (I4).

The tree is the minimum spanning tree of the rows' distances, grown by Borůvka rounds: each component takes its shortest edge to another one, and components joined that way
become one. Edges come from blocks of rows that lie together in the two most spread directions: blocks within ``reach`` of each other are compared as matrices, and a task
hands on only the minimum spanning forest of the edges it found. If several components are left, the reach doubles; only edges between them are then
looked for. All edges up to the reach are used before longer ones, so the tree is exact, and one tree answers cuts by distance, by number of clusters, and by a
share of the largest merge.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.scratch import written

#: Rows of a block, rows of it that are compared at once, and edges that a task gathers before it takes their forest.
BLOCK, STRIPE, MOST = 1024, 64, 1_000_000


def _jumped(parents: DataFrame) -> DataFrame:
    """``node, parent`` with every node's last ancestor, by pointer jumping: paths halve each round."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("_top"))
        new = written(parents.join(up, "parent").select("node", "parent", "_top"), "parents")
        if new.filter("parent <> _top").isEmpty():
            return new.select("node", "parent")
        parents = new.select("node", F.col("_top").alias("parent"))


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of the nodes of undirected ``edges`` (a, b): root is the smallest node of the component."""
    left = written(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    known = None
    while not left.isEmpty():
        both = left.unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = _jumped(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_m")).select("node", F.least("node", "_m").alias("parent")))
        if known is None:
            known = parents.withColumnRenamed("parent", "root")
        else:
            step = parents.select(F.col("node").alias("root"), F.col("parent").alias("_new"))
            known = known.join(step, "root", "left").select("node", F.coalesce("_new", "root").alias("root"))
        known = written(known, "roots")
        x, y = (parents.select(F.col("node").alias(c), F.col("parent").alias(f"_{c}")) for c in "ab")
        left = written(left.join(x, "a").join(y, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).filter("a <> b").distinct(), "edges")
    return known if known is not None else edges.select(F.col("a").alias("node"), F.col("a").alias("root")).filter("false")


def _forest(edges: pa.Table) -> pa.Table:
    """The minimum spanning forest of edges between components (Kruskal), equal distances in the order of keys. An edge that closes a cycle of shorter ones is in no larger tree."""
    edges = edges.combine_chunks().sort_by([("d", "ascending"), ("a", "ascending"), ("b", "ascending")])
    codes = pa.concat_arrays(edges["ca"].chunks + edges["cb"].chunks).dictionary_encode().indices.to_numpy().tolist()
    up, kept = list(range(max(codes, default=-1) + 1)), []
    for i in range(edges.num_rows):
        u, v = codes[i], codes[edges.num_rows + i]
        while up[u] != u:
            up[u] = u = up[up[u]]
        while up[v] != v:
            up[v] = v = up[up[v]]
        if u != v:
            up[u] = v
            kept.append(i)
    return edges.take(pa.array(kept, pa.int64()))


def _blocks(rows: DataFrame, reach: float, axes: list[int], kind: str, largest) -> DataFrame:
    """``id, open, low, high, n, r, x``: rows packed in the order of strips of width ``reach`` and of the place in a strip, with their bounds on the axes. ``open``: some are
    outside the component ``largest``."""
    ends = [F.col("x")[a] for a in axes]
    strip, place = F.floor(ends[0] / reach) if ends else F.lit(0), ends[-1] if ends else F.lit(0.0)
    placed = rows.select("node", "root", "x", (F.lit(True) if largest is None else F.col("root") != largest).alias("out"), strip.alias("strip"), place.alias("place"))
    placed = placed.repartitionByRange("out", "strip", "place").sortWithinPartitions("out", "strip", "place").select("node", "root", "x", "out")

    def pack(batches):
        at = TaskContext.get().partitionId() << 33
        for whole in batches:
            for i in range(0, whole.num_rows, BLOCK):
                b = whole.slice(i, BLOCK)
                x = np.array(b.column(2).flatten(), dtype=np.float64).reshape(b.num_rows, -1)
                ends = x[:, axes]
                lists = [pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(k)) for k in (0, 1)]
                bounds = [pa.array([e.tolist()], pa.list_(pa.float64())) for e in (ends.min(axis=0), ends.max(axis=0))]
                columns = [pa.array([at], pa.int64()), pa.array([any(b.column(3).to_pylist())]), *bounds, *lists, pa.array([x.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "open", "low", "high", "n", "r", "x"])
                at += 1

    blocks = placed.mapInArrow(pack, f"id long, open boolean, low array<double>, high array<double>, n array<{kind}>, r array<{kind}>, x binary")
    return written(blocks.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism), "blocks")


def _edges(rows: DataFrame, reach: float, axes: list[int], kind: str, largest=None) -> DataFrame:
    """``ca, cb, d, a, b``: edges within ``reach`` between components that hold all of the tree's, of each task a forest. ``rows``: ``node, x, root``.

    Blocks meet blocks whose bounds are within ``reach`` in the tasks of a Cartesian product, so a crowded place is dealt like any other. Of two rows of different components one
    is outside the ``largest``.
    """
    blocks = _blocks(rows, reach, axes, kind, largest)
    other = blocks.withColumnsRenamed({c: f"{c}2" for c in blocks.columns}).hint("shuffle_replicate_nl")
    near = (F.col("id") <= F.col("id2")) & (F.col("open") | F.col("open2"))
    for k in range(len(axes)):
        near = near & (F.col("low")[k] <= F.col("high2")[k] + reach) & (F.col("low2")[k] <= F.col("high")[k] + reach)
    pairs = blocks.join(other, near).select("n", "r", "x", "n2", "r2", "x2")

    def shortest(batches):
        found, pending = [], 0
        for b in batches:
            for i in range(b.num_rows):
                n, r, m, q = (b.column(k)[i].values for k in (0, 1, 3, 4))
                x, y = (np.frombuffer(b.column(k)[i].as_buffer()).reshape(len(v), -1) for k, v in ((2, n), (5, m)))
                xx, yy = (np.square(v).sum(axis=1) for v in (x, y))
                limit = reach * reach * (1 + 1e-9) + 1e-12 * (xx.max() + yy.max())
                left = np.hstack([x, -xx[:, None] / 2, np.ones((len(x), 1))])
                right = np.ascontiguousarray(np.hstack([y, np.ones((len(y), 1)), -yy[:, None] / 2]).T)
                codes = pa.concat_arrays([r, q]).dictionary_encode().indices.to_numpy()
                near = []
                for at in range(0, len(x), STRIPE):
                    # the product is minus half the squared distance
                    s, t = np.divmod(np.flatnonzero(left[at : at + STRIPE] @ right >= -limit / 2), len(y))
                    s += at
                    apart = codes[s] != codes[len(x) + t]
                    s, t = s[apart], t[apart]
                    d = np.sqrt(np.square(x[s] - y[t]).sum(axis=1))  # exact, unlike the product
                    inside = d <= reach
                    near.append((s[inside], t[inside], d[inside]))
                s, t, d = (pa.array(np.concatenate(c)) for c in zip(*near))
                if not len(d):
                    continue
                a, b_ = n.take(s), m.take(t)
                first = pc.less(a, b_)
                ends = [pc.if_else(first, a, b_), pc.if_else(first, b_, a)]
                found.append(pa.Table.from_arrays([r.take(s), q.take(t), d, *ends], ["ca", "cb", "d", "a", "b"]))
                pending += len(d)
                if pending > MOST:
                    found, pending = [_forest(pa.concat_tables(found))], 0
        if found:
            yield from _forest(pa.concat_tables(found)).to_batches(max_chunksize=10_000)

    return pairs.mapInArrow(shortest, f"ca {kind}, cb {kind}, d double, a {kind}, b {kind}")


def _hooked(picked: DataFrame) -> DataFrame:
    """``node, root`` of components that each go to the one at the other end of their shortest edge (``ca, to``). In a strict order of edges only two can point at each other."""
    back = picked.select(F.col("ca").alias("to"), F.col("to").alias("_back"))
    up = F.when((F.col("_back") == F.col("ca")) & (F.col("ca") < F.col("to")), F.col("ca")).otherwise(F.col("to"))
    return _jumped(picked.join(back, "to").select(F.col("ca").alias("node"), up.alias("parent"))).withColumnRenamed("parent", "root")


def linkage_tree(df: DataFrame, key: str, vector: str, reach: float, grow: bool = True) -> DataFrame:
    """``a, b, d``: the edges of the minimum spanning tree of Euclidean distances; with ``grow`` false of the forest within ``reach``.

    Rows without key or vector are left out. Each doubling of the reach compares rows of wider cells, so begin near the usual distance of neighbours; distances
    much beyond the spread of the data make one cell of everything.
    """
    rows = df.select(F.col(key).alias("node"), F.col(vector).cast("array<double>").alias("x")).filter("node is not null and x is not null")
    rows = written(rows, "nodes")
    kind = rows.schema["node"].dataType.simpleString()
    spread = rows.select(F.posexplode("x").alias("f", "v")).groupBy("f").agg(F.var_pop("v").alias("s")).orderBy(F.col("s").desc(), "f").limit(2)
    axes = [r.f for r in spread.collect()]
    roots, tree, largest = rows.select("node", F.col("node").alias("root")), None, None
    n, found = rows.count(), 0
    while found < n - 1:
        left = written(_edges(rows.join(roots, "node"), reach, axes, kind, largest), "candidates")
        while not left.isEmpty():
            both = left.unionAll(left.select(F.col("cb").alias("ca"), F.col("ca").alias("cb"), "d", "a", "b"))
            edge = F.struct("d", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("cb").alias("to"))
            picked = written(both.groupBy("ca").agg(F.min(edge).alias("e")).select("ca", "e.*"), "picked")
            new = picked.select("a", "b", "d").distinct()
            tree = new if tree is None else tree.unionAll(new)
            merged = _hooked(picked)
            step = merged.select(F.col("node").alias("root"), F.col("root").alias("_new"))
            roots = written(roots.join(step, "root", "left").select("node", F.coalesce("_new", "root").alias("root")), "roots")
            x, y = (merged.select(F.col("node").alias(c), F.col("root").alias(f"_{c}")) for c in ("ca", "cb"))
            left = left.join(x, "ca", "left").join(y, "cb", "left").select(F.coalesce("_ca", "ca").alias("ca"), F.coalesce("_cb", "cb").alias("cb"), "d", "a", "b")
            left = written(left.filter("ca <> cb"), "candidates")
        sizes = written(roots.groupBy("root").agg(F.count(F.lit(1)).alias("n")), "sizes")
        found = n - sizes.count()
        largest = sizes.orderBy(F.col("n").desc(), "root").first()[0]
        if not grow:
            break
        reach *= 2
    return written(tree, "tree") if tree is not None else rows.select(F.col("node").alias("a"), F.col("node").alias("b"), F.lit(0.0).alias("d")).filter("false")


def cut_tree(df: DataFrame, key: str, tree: DataFrame, distance: float | None = None, k: int | None = None, share: float = 0.7) -> DataFrame:
    """``key, cluster`` from a ``linkage_tree``: cut at a distance, into ``k`` clusters, or else at a share of the largest merge. A cluster is named by its smallest key.

    A cut into ``k`` breaks the ``k - 1`` longest edges (of equal ones those of the larger keys first).
    """
    if distance is not None:
        kept = tree.filter(F.col("d") <= distance)
    elif k is not None:
        longest = tree.orderBy(F.col("d").desc(), F.col("a").desc(), F.col("b").desc()).limit(k - 1)
        kept = tree.join(longest.select("a", "b"), ["a", "b"], "left_anti") if k > 1 else tree
    else:
        kept = tree.crossJoin(F.broadcast(tree.agg((F.max("d") * share).alias("_cut")))).filter("d <= _cut")  # one row
    roots = components(kept)
    return df.select(key).join(roots, df[key] == roots["node"], "left").select(key, F.coalesce("root", key).alias("cluster"))
