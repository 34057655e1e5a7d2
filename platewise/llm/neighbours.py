"""Distributed "next row in order": range parts that also hold the first row of the part after them.

A row's neighbour in a global order is needed where a window without a partition key would put
everything in one task. Rows go to range parts by boundaries from a sample of keys, chosen by a hash below a
threshold that depends on the number of keys, so that the driver receives about ``PER_PART`` keys a part; the boundaries decide
only how evenly rows spread. The number of parts grows with the bytes. The first row of each part is
copied to the end of the part before it, and the driver sees one row a part.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import source_partitions

#: Sampled keys for each part, and bytes of a part.
PER_PART, PART_BYTES = 64, 64 << 20


def bounds(keys: DataFrame, least: int | None = None, part_bytes: int = PART_BYTES) -> list:
    """Ascending boundaries that cut the rows of ``keys`` (key, size in bytes; a written table) into parts of about ``part_bytes``."""
    known = keys.filter(F.col("key").isNotNull())
    n, total = known.agg(F.approx_count_distinct("key"), F.sum("size")).first()
    parts = max(least or source_partitions(keys.sparkSession), -(-(total or 0) // part_bytes))
    threshold = min(1 << 30, (PER_PART * parts << 30) // max(n, 1) + 1)
    picked = known.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < threshold).groupBy("key").agg(F.sum("size").alias("size")).collect()
    out, filled, whole = [], 0, sum(r["size"] for r in picked)
    for r in sorted(picked, key=lambda r: r["key"]):
        if filled * parts > (len(out) + 1) * whole:
            out.append(r["key"])
        filled += r["size"]
    return out


def part_of(key: Column, limits: list) -> Column:
    """Number of boundaries at or below the key; null keys come first."""
    import bisect

    @F.arrow_udf("int")
    def place(keys: pa.Array) -> pa.Array:
        return pa.array([0 if k is None else bisect.bisect_right(limits, k) for k in keys.to_pylist()], pa.int32())

    return place(key)
