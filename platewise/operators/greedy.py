"""Many picks per scan for greedy selection.

After a pick every other candidate's value falls (distance to what is chosen, conditional variance, shrunk score). So one scan over all candidates,
with the picks so far broadcast, brings back the best few thousand and the best value left outside. Picks go on among those few by the plain greedy rule for as long as the
winner is above the outside value, which only falls; then the next scan follows. The choice is the same as that of a loop with a scan per pick.

A scan keeps no state: values are worked out from all picks, in float64 by differences, so a lost executor costs its own part only. It reads
``rows x picks`` vectors; a partition sends its share of the list and its own outside value, and a second level merges what partitions sent.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.scratch import written

#: Candidates of a list, and tasks of the second level.
KEPT, MERGERS = 4096, 8
#: Pairs of vectors that are subtracted at a time.
_PAIRS = 1 << 16


def distances(x: np.ndarray, picks: np.ndarray) -> np.ndarray:
    """Euclidean distances, rows of ``x`` by rows of ``picks``."""
    out = np.empty((len(x), len(picks)))
    step = max(1, _PAIRS // max(1, len(picks)))
    for at in range(0, len(x), step):
        d = x[at : at + step, None, :] - picks[None, :, :]
        out[at : at + step] = np.sqrt(np.einsum("ijk,ijk->ij", d, d))
    return out


class Farthest:
    """Distance to the nearest pick."""

    def values(self, x: np.ndarray, score: np.ndarray, picks: np.ndarray) -> np.ndarray:
        return np.minimum.reduce([distances(x, picks[k : k + 64]).min(axis=1) for k in range(0, len(picks), 64)])

    def start(self, x, score, picks):
        """What the list holds besides values."""

    def update(self, values, x, score, pick: int):
        return np.minimum(values, distances(x, x[pick : pick + 1])[:, 0])

    def outside(self, value: float, picks: int) -> float:
        """Most that a value outside the list can be after so many picks more."""
        return value

    def enough(self, value: float) -> bool:
        return False


class Shrinking(Farthest):
    """A score that each pick shrinks by ``1 - exp(-distance) / 2``. Scores below zero rise, at most by half a pick."""

    def values(self, x, score, picks):
        v = score.copy()
        for k in range(0, len(picks), 64):
            v *= np.prod(1 - 0.5 * np.exp(-distances(x, picks[k : k + 64])), axis=1)
        return v

    def update(self, values, x, score, pick):
        return values * (1 - 0.5 * np.exp(-distances(x, x[pick : pick + 1])[:, 0]))

    def outside(self, value, picks):
        return value if value >= 0 else value * 0.5**picks


class Determinant(Farthest):
    """Conditional variance under an RBF kernel, by Cholesky columns."""

    def __init__(self, gamma: float):
        self.gamma = gamma

    def _kernel(self, x, y):
        d = distances(x, y)
        return np.exp(-self.gamma * d * d)

    def _columns(self, x, picks):
        if not len(picks):
            return np.zeros((len(x), 0))
        lower = np.linalg.cholesky(self._kernel(picks, picks))
        return np.linalg.solve(lower, self._kernel(x, picks).T).T

    def values(self, x, score, picks):
        return 1.0 - np.square(self._columns(x, picks)).sum(axis=1)

    def start(self, x, score, picks):
        self.columns = self._columns(x, picks)

    def update(self, values, x, score, pick):
        c = self.columns
        e = (self._kernel(x, x[pick : pick + 1])[:, 0] - c @ c[pick]) / np.sqrt(values[pick])
        self.columns = np.hstack([c, e[:, None]])
        return values - e * e

    def enough(self, value):
        return value <= 1e-12


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(flat), -1) if len(flat) else np.zeros((0, 0))


@dataclass
class _Best:
    """The best ``most`` rows of those added, and the best of the others."""

    most: int
    table: pa.Table | None = None
    out: pa.Table | None = None
    order: list = field(default_factory=lambda: [("value", "descending"), ("key", "ascending")])

    def add(self, t: pa.Table) -> None:
        t = t if self.table is None else pa.concat_tables([self.table, t])
        t = t.take(pc.sort_indices(t, sort_keys=self.order)) if t.num_rows else t
        self.table, rest = t.slice(0, self.most).combine_chunks(), t.slice(self.most, 1)
        self.leave(rest)

    def leave(self, t: pa.Table) -> None:
        t = t.select(["key", "value"])
        t = t if self.out is None else pa.concat_tables([self.out, t])
        self.out = t.take(pc.sort_indices(t, sort_keys=self.order)).slice(0, 1).combine_chunks()

    def batches(self):
        """Rows of the list, then the best one outside, without its vector."""
        if self.table is None:
            return
        outside = self.out.append_column("x", pa.nulls(self.out.num_rows, pa.list_(pa.float64()))).append_column("score", pa.nulls(self.out.num_rows, pa.float64()))
        for t, kept in ((self.table, True), (outside.select(self.table.column_names), False)):
            if t.num_rows:
                yield from t.append_column("kept", pa.array([kept] * t.num_rows)).combine_chunks().to_batches()


def candidates(df: DataFrame, key: str, vector: str, score: str | None = None) -> DataFrame:
    """``key, x, score`` in a table of its own, which every scan reads."""
    value = F.col(score).cast("double") if score else F.lit(0.0)
    rows = df.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("x"), value.alias("score"))
    return written(rows.filter(F.col("key").isNotNull() & F.col("x").isNotNull()), "candidates")


def _share(rows: DataFrame, kept: int) -> int:
    """Candidates that a part of the table sends: its share of the list, four times over."""
    return max(4, -(-4 * kept // max(1, len(rows.inputFiles()))))


def _without(t: pa.Table, gone: pa.Array) -> pa.Table:
    return t.filter(pc.invert(pc.is_in(t["key"], value_set=gone.cast(t["key"].type)))) if len(gone) else t


def _scan(rows: DataFrame, rule, picks: np.ndarray, chosen: list, kept: int) -> tuple[pa.Table, pa.Table]:
    """The best ``kept`` candidates but those ``chosen``, with values, and the best one outside (a row or none). One job."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((rule, picks, pa.array(chosen)))
    share = _share(rows, kept)
    kind = rows.schema["key"].dataType.simpleString()

    def partial(batches):
        rule, picks, gone = shared.value
        best = _Best(min(kept, share))
        for b in batches:
            t = pa.Table.from_batches([b])
            t = _without(t, gone)
            for at in range(0, t.num_rows, 4096):
                part = t.slice(at, 4096)
                v = rule.values(_matrix(part["x"]), part["score"].to_numpy(), picks)
                best.add(part.append_column("value", pa.array(np.where(np.isnan(v), -np.inf, v))))
        yield from best.batches()

    def merge(batches):
        best = _Best(kept)
        for b in batches:
            t = pa.Table.from_batches([b])
            best.add(t.filter(t["kept"]).drop_columns(["kept"]))
            best.leave(t.filter(pc.invert(t["kept"])))
        yield from best.batches()

    schema = f"key {kind}, x array<double>, score double, value double, kept boolean"
    found = rows.mapInArrow(partial, schema).repartition(MERGERS).mapInArrow(merge, schema).toArrow()
    shared.unpersist()
    best = _Best(kept)
    best.add(found.filter(found["kept"]).drop_columns(["kept"]))
    best.leave(found.filter(pc.invert(found["kept"])))
    return best.table, best.out


def _first_of(values: np.ndarray, ties: np.ndarray) -> int:
    """Place of the largest value, the smallest ``ties`` among equals."""
    at = np.flatnonzero(values == values.max())
    return int(at[np.argmin(ties[at])])


def lazy_greedy(rows: DataFrame, rule, n: int, first: tuple | None = None, kept: int = KEPT) -> list:
    """Up to ``n`` keys of ``candidates`` rows in order of choice. ``first``: key and vector of a pick that is made already."""
    chosen = [first[0]] if first else []
    vectors = [np.asarray(first[1], dtype=np.float64)] if first else []
    while len(chosen) < n:
        t, out = _scan(rows, rule, np.array(vectors), chosen, kept)
        if not t.num_rows:
            break
        x, score, value = _matrix(t["x"]), t["score"].to_numpy(), t["value"].to_numpy().copy()
        keys = t["key"].to_pylist()
        ties = np.empty(len(keys), dtype=np.int64)
        ties[sorted(range(len(keys)), key=keys.__getitem__)] = np.arange(len(keys))
        limit = (out["value"][0].as_py(), out["key"][0].as_py()) if out.num_rows else None
        rule.start(x, score, np.array(vectors).reshape(len(vectors), x.shape[1]))
        since = 0
        while len(chosen) < n:
            k = _first_of(value, ties)
            if value[k] == -np.inf:
                break  # the list is used up
            if since and limit is not None:
                most = rule.outside(limit[0], since)
                if value[k] < most or (value[k] == most and keys[k] > limit[1]):
                    break
            if rule.enough(value[k]):
                return chosen
            chosen.append(keys[k])
            vectors.append(x[k])
            value = rule.update(value, x, score, k)
            value[k] = -np.inf
            since += 1
        if not since:  # what is left has no value
            break
    return chosen


def _extent(rows: DataFrame, picks: np.ndarray, chosen: list) -> tuple | None:
    """Smallest and largest distance to the picks over the candidates left, and who has the smallest."""
    shared = rows.sparkSession.sparkContext.broadcast((picks, pa.array(chosen)))

    def run(batches):
        rule = Farthest()
        for b in batches:
            t = _without(pa.Table.from_batches([b]), shared.value[1])
            for at in range(0, t.num_rows, 4096):
                part = t.slice(at, 4096)
                d = rule.values(_matrix(part["x"]), None, shared.value[0])
                k = int(d.argmin())
                yield pa.RecordBatch.from_arrays([part["key"].slice(k, 1).combine_chunks(), pa.array(d[k : k + 1]), pa.array([d.max()])], ["key", "lo", "hi"])

    kind = rows.schema["key"].dataType.simpleString()
    got = rows.select("key", "x").mapInArrow(run, f"key {kind}, lo double, hi double").agg(F.min(F.struct("lo", "key")).alias("least"), F.max("hi").alias("hi")).first()
    shared.unpersist()
    return (got.least.lo, got.hi, got.least.key) if got.least else None


def _neighbours(rows: DataFrame, x: np.ndarray, keys: list, chosen: list) -> dict:
    """For each place of the list its distance to the nearest candidate left but itself, and that one's key."""
    shared = rows.sparkSession.sparkContext.broadcast((x, pa.array(keys), pa.array(chosen)))

    def run(batches):
        mine, keys, gone = shared.value
        square, best, who = (mine * mine).sum(axis=1), np.full(len(mine), np.inf), [None] * len(mine)
        for b in batches:
            t = _without(pa.Table.from_batches([b]), gone)
            for at in range(0, t.num_rows, 2048):
                part = t.slice(at, 2048)
                y = _matrix(part["x"])
                d = np.maximum(square[:, None] + (y * y).sum(axis=1)[None, :] - 2 * mine @ y.T, 0)
                own = pc.index_in(part["key"], value_set=keys.cast(part["key"].type)).combine_chunks()
                here = np.flatnonzero(own.is_valid().to_numpy(zero_copy_only=False))
                d[own.take(pa.array(here)).to_numpy(), here] = np.inf
                k = d.argmin(axis=1)
                exact = np.where(np.isinf(d[np.arange(len(k)), k]), np.inf, np.sqrt(np.square(mine - y[k]).sum(axis=1)))
                for i in np.flatnonzero(exact < best):
                    best[i], who[i] = exact[i], part["key"][int(k[i])]
        found = [i for i, w in enumerate(who) if w is not None]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(best[found]), pa.array([who[i].as_py() for i in found], who[found[0]].type)], ["i", "d", "key"])

    kind = rows.schema["key"].dataType.simpleString()
    got = rows.select("key", "x").mapInArrow(run, f"i int, d double, key {kind}").groupBy("i").agg(F.min(F.struct("d", "key")).alias("n")).collect()  # a row a place
    shared.unpersist()
    return {r.i: (r.n.d, r.n.key) for r in got}


class _Sloped(Farthest):
    """``weight * score + slope * distance``."""

    def __init__(self, weight: float, slope: float):
        self.weight, self.slope = weight, slope

    def values(self, x, score, picks):
        return self.weight * score + self.slope * super().values(x, score, picks)


def lazy_hybrid(rows: DataFrame, n: int, first: tuple, weight: float, kept: int = 1024) -> list:
    """As ``lazy_greedy`` for ``weight * score + (1 - weight) * (d - lo) / (hi - lo + 1e-8)``, where lo and hi are the extremes of the distance ``d`` over the candidates left.

    Only the slope ``(1 - weight) / (hi - lo + 1e-8)`` decides who wins. A scan gives exact extremes and a list for the slope ``a`` that follows; later picks move the
    slope inside an interval that is known from the list and from the nearest neighbours of its members. A pick is made if the same candidate wins at both ends of the interval, and
    there beats what any candidate outside can have (at slope ``s`` at most ``(s - a) * hi`` more than at ``a``): values are linear in the slope, so it wins in between as well.
    """
    chosen, vectors = [first[0]], [np.asarray(first[1], dtype=np.float64)]
    while len(chosen) < n:
        picks = np.array(vectors)
        extent = _extent(rows, picks, chosen)
        if extent is None:
            break
        lo, hi, holder = extent
        a = (1 - weight) / (hi - lo + 1e-8)
        t, out = _scan(rows, _Sloped(weight, a), picks, chosen, kept)
        x, score, keys = _matrix(t["x"]), t["score"].to_numpy(), t["key"].to_pylist()
        ties = np.empty(len(keys), dtype=np.int64)
        ties[sorted(range(len(keys)), key=keys.__getitem__)] = np.arange(len(keys))
        d, left = Farthest().values(x, score, picks), np.ones(len(keys), dtype=bool)
        beyond = out["value"][0].as_py() if out.num_rows else -np.inf  # at slope a; at slope s at most (s - a) * hi more
        near = _neighbours(rows, x, keys, chosen) if out.num_rows else {}
        floor, holders, since = lo, {holder: lo}, 0
        while len(chosen) < n and left.any():
            lower, upper = float(d[left].max()), hi if out.num_rows else float(d[left].max())
            least = float(d[left].min()) if not out.num_rows else floor
            most = min([float(d[left].min()), *holders.values()]) if out.num_rows else least
            slopes = [a] if not since else [(1 - weight) / (max(upper, lower) - least + 1e-8), (1 - weight) / (max(lower - most, 0.0) + 1e-8)]
            wins = []
            for s in slopes:
                v = np.where(left, weight * score + s * d, -np.inf)
                k = _first_of(v, ties)
                reach = beyond + (s - a) * hi if s >= a else beyond
                wins.append(k if not since or v[k] > reach else None)
            if wins[0] is None or any(w != wins[0] for w in wins):
                break
            k = wins[0]
            chosen.append(keys[k])
            vectors.append(x[k])
            left[k] = False
            d = np.minimum(d, distances(x, x[k : k + 1])[:, 0])
            holders.pop(keys[k], None)
            if k in near:
                floor = min(floor, near[k][0] * (1 - 1e-12))
                if near[k][1] not in chosen:
                    holders[near[k][1]] = min(near[k][0], holders.get(near[k][1], np.inf))
            since += 1
    return chosen
