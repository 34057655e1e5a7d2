"""Products of features over rows, added up block by block.

A task multiplies its batches of rows as matrices. Its sums leave it as square tiles of ``TILE`` features by ``TILE``, one row a tile with the numbers
packed. Input splits are first joined to ``groups`` tasks (twice the cluster's cores if not given), so what is shuffled is tiles times groups, however many splits there
are; each tile is then added up in one stream. Missing values are masked, so every pair is summed over the rows that have both.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise import scratch

_SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")
#: Features of a tile's side.
TILE = 256


def _matrix(batch: pa.RecordBatch, place: dict[int, int], centre: np.ndarray) -> np.ndarray:
    """Rows by features, centred, with NaN where a value is missing. The batch has lists of feature numbers and of values."""
    f, v = batch.column(0), batch.column(1)
    owner = np.repeat(np.arange(batch.num_rows), np.diff(f.offsets.to_numpy()))
    number = f.flatten().to_numpy()
    out = np.full((batch.num_rows, len(centre)), np.nan)
    known = np.isin(number, list(place))
    at = np.array([place.get(k, 0) for k in range(int(number.max()) + 1)], dtype=np.int64)[number[known]] if known.any() else np.zeros(0, dtype=np.int64)
    out[owner[known], at] = v.flatten().to_numpy(zero_copy_only=False)[known]
    return out - centre


def _means(rows: DataFrame, f: str, v: str) -> dict[int, float]:
    """The mean of each feature's values that are neither null nor NaN: a row a feature."""
    long = rows.select(F.explode(F.arrays_zip(F.col(f).alias("f"), F.col(v).alias("v"))).alias("x")).select("x.f", "x.v").filter(F.col("v").isNotNull() & ~F.isnan("v"))
    return {r.f: r.m for r in long.groupBy("f").agg(F.avg("v").alias("m")).collect()}


def pair_sums(rows: DataFrame, f: str = "fs", v: str = "vs", groups: int | None = None, means: dict[int, float] | None = None) -> DataFrame:
    """``a < b`` and, over rows that have both features, their number, sums, squares and products, after subtracting each feature's mean ``ca``, ``cb``.

    ``rows`` has a list of feature numbers and a list of as many values. A task holds four matrices of all features by all features.
    ``means``: of the features that have any value, if known; they only centre the sums.
    """
    if means is None:
        rows = scratch.written(rows.select(f, v), "lists")  # two scans
        means = _means(rows, f, v)
    means = sorted(means.items())
    names, centre = np.array([k for k, _ in means], dtype=np.int32), np.array([m for _, m in means])
    place = {int(k): i for i, k in enumerate(names)}

    def run(batches):
        d = len(names)
        n, sx, sxx, sxy = (np.zeros((d, d)) for _ in range(4))
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                x = _matrix(b.slice(at, 4096), place, centre)
                m = (~np.isnan(x)).astype(float)
                x = np.nan_to_num(x)
                n += m.T @ m
                sx += x.T @ m  # of the first feature where the second is known
                sxx += (x * x).T @ m
                sxy += x.T @ x
        for i in range(0, d, TILE):
            for j in range(i, d, TILE):
                x, y = slice(i, i + TILE), slice(j, j + TILE)
                sums = np.stack([n[x, y], sx[x, y], sx[y, x].T, sxx[x, y], sxx[y, x].T, sxy[x, y]])
                yield pa.RecordBatch.from_arrays([pa.array([i // TILE], pa.int32()), pa.array([j // TILE], pa.int32()), pa.array([sums.tobytes()], pa.binary())], ["i", "j", "sums"])

    def add(batches):
        tiles: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for i, j, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                sums = np.frombuffer(raw.as_buffer(), dtype=np.float64)
                if (i, j) in tiles:
                    tiles[i, j] += sums
                else:
                    tiles[i, j] = sums.copy()
        for (i, j), sums in tiles.items():
            x, y = names[i * TILE : (i + 1) * TILE], names[j * TILE : (j + 1) * TILE]
            sums = sums.reshape(len(_SUMS), len(x), len(y))
            a, b = np.triu_indices(len(x), 1) if i == j else (k.ravel() for k in np.indices((len(x), len(y))))
            known = sums[0, a, b] > 0
            a, b = a[known], b[known]
            yield pa.RecordBatch.from_arrays([pa.array(x[a]), pa.array(y[b]), *(pa.array(s[a, b]) for s in sums)], ["a", "b", *_SUMS])

    spark = rows.sparkSession
    sides = -(-len(names) // TILE)
    packed = rows.select(F.col(f).cast("array<int>"), F.col(v).cast("array<double>")).coalesce(groups or 2 * spark.sparkContext.defaultParallelism)
    tiles = packed.mapInArrow(run, "i int, j int, sums binary").repartition(max(1, sides * (sides + 1) // 2), "i", "j")
    return tiles.mapInArrow(add, "a int, b int, " + ", ".join(f"{s} double" for s in _SUMS))


def listed(long: DataFrame, key: str) -> DataFrame:
    """Long rows gathered by key: lists of feature numbers and values."""
    return long.groupBy(key).agg(F.collect_list("f").alias("fs"), F.collect_list("v").alias("vs"))


def listed_packed(packed: DataFrame, features: str = "features") -> DataFrame:
    """Packed rows with their feature numbers."""
    return packed.select(F.sequence(F.lit(0), F.size(features) - 1).alias("fs"), F.col(features).alias("vs"))


def correlation(sums: DataFrame) -> DataFrame:
    """``a, b, r``; null where a feature does not vary over the pair's rows."""
    vx, vy = (F.col(f"s{c}{c}") - F.col(f"s{c}") * F.col(f"s{c}") / F.col("n") for c in "xy")
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    varies = (vx > 1e-12 * F.col("sxx")) & (vy > 1e-12 * F.col("syy"))
    return sums.select("a", "b", F.when(varies, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cov / F.sqrt(vx * vy)))).alias("r"))


def covariance(sums: DataFrame) -> DataFrame:
    """``a, b, c``: sample covariance."""
    return sums.select("a", "b", ((F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / (F.col("n") - 1)).alias("c"))
