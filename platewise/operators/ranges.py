"""Scans along an order inside keys, by ranges of (key, order) instead of a task per key.

Rows are dealt to tasks by ranges of key and order and sorted there, so a key with very many rows lies in several parts, one after another. What a part
needs of the parts before it is small: the last value of a key that goes on (as-of), or its last rows (rolling frames). Parts hand that on, and every task goes
over its part once.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platewise.scratch import written


def _parts(df: DataFrame, order: list[str], parts: int | None) -> DataFrame:
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *order).sortWithinPartitions(*order)


def _changes(codes: np.ndarray) -> np.ndarray:
    return np.concatenate([[True], codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, dtype=bool)


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, value: str, out: str, parts: int | None = None) -> DataFrame:
    """For each left row the value of the latest right row of its key at or before its time.

    At equal times right rows come first, and of right rows with one time the greatest value counts. Null keys match nothing; null values are passed over. A part
    fills its left rows and says which ones, at its beginning, wait for an earlier part; parts' first and last keys, two rows a part, give them what they wait for.
    """
    extra = [c for c in left.columns if c not in (key, time)]
    kind = right.schema[value].dataType.simpleString()
    a = left.select(key, time, F.lit(1).alias("_side"), F.lit(None).cast(kind).alias("_v"), *extra)
    b = right.filter(F.col(key).isNotNull()).select(key, time, F.lit(0).alias("_side"), F.col(value).alias("_v"), *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in extra])
    rows = _parts(a.unionByName(b), [key, time, "_side", "_v"], parts)
    rows = rows.select(key, "_side", "_v", time, *extra)
    names = rows.columns

    def fill(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        last_key, last_value, waiting = None, None, True  # of the key that the part is in; waiting: it is the part's first and no value came yet

        def told(kind, k, v, like):
            cols = {"_side": pa.array([kind], like.column("_side").type), names[0]: pa.array([k], like.column(0).type), "_v": pa.array([v], like.column("_v").type)}
            arrays = [cols.get(n, pa.nulls(1, like.column(n).type)) for n in names]
            return pa.RecordBatch.from_arrays([*arrays, pa.array([part], pa.int32()), pa.array([False])], [*names, "_part", "_open"])

        like, started = None, False
        for b in batches:
            if not b.num_rows:
                continue
            like, keys = b, b.column(0)
            if not started:
                started, last_key = True, keys[0]
                yield told(2, keys[0].as_py(), None, b)
            codes = keys.dictionary_encode().indices.fill_null(-1).to_numpy()
            new = _changes(codes)
            new[0] = not keys[0].equals(last_key)
            begin = np.maximum.accumulate(np.where(new, np.arange(len(codes)), -1))  # -1: the key that the batch before ended in
            given = b.column("_v").is_valid().to_numpy(zero_copy_only=False)
            at = np.maximum.accumulate(np.where(given, np.arange(len(codes)), -1))
            at = np.where(at >= np.maximum(begin, 0), at, -1)
            found = b.column("_v").take(pa.array(at, mask=at < 0))
            early = (at < 0) & (begin < 0)  # no value yet of a key from before
            if early.any() and last_value is not None:
                found = pc.if_else(pa.array(early), last_value, found)
            open_ = early & waiting & (last_value is None) & keys.is_valid().to_numpy(zero_copy_only=False)
            mine = pa.array(b.column("_side").to_numpy() == 1)
            cols = [found if n == "_v" else b.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*(c.filter(mine) for c in cols), pa.array([part] * mine.true_count, pa.int32()), pa.array(open_).filter(mine)], [*names, "_part", "_open"])
            if begin[-1] >= 0:
                last_value, waiting = None, False
            last_key = keys[len(keys) - 1]
            if at[-1] >= 0:
                last_value = b.column("_v")[int(at[-1])]
        if started:
            yield told(3, last_key.as_py(), None if last_value is None else last_value.as_py(), like)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", _part int, _open boolean"
    done = written(rows.mapInArrow(fill, schema), "as-of")
    ends = done.filter("_side > 1").select(F.col(key).alias("_key"), "_part", "_side", F.col("_v"))
    seen = Window.partitionBy("_key").orderBy("_part", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carry = ends.withColumn("_carry", F.last("_v", ignorenulls=True).over(seen)).filter("_side = 2 and _key is not null").select("_part", "_carry")
    found = done.filter("_side = 1").join(carry, "_part", "left")
    return found.select(key, time, *extra, F.when(F.col("_open"), F.col("_carry")).otherwise(F.col("_v")).alias(out))


def _interpolated(window: list[float], p: float) -> float | None:
    if not window:
        return None
    at = p * (len(window) - 1)
    k = int(at)
    return window[k] if k == at else (k + 1 - at) * window[k] + (at - k) * window[k + 1]


def rolling_percentile(log: DataFrame, by: list[str], order: list[str], value: str, n: int, p: float, parts: int | None = None) -> DataFrame:
    """``log`` with ``rolling``: the percentile of the last ``n`` rows of its key up to each row, null and NaN values not counted. ``order`` should tell all rows of a key apart.

    A part also holds the ``n - 1`` rows of its first key before it (its halo), from as many earlier parts as they lie in. Which ones those are is worked out from
    one row a part. A sorted list of the frame's values goes along with the rows.
    """
    by, order = list(by), list(order)
    columns = log.columns
    placed = written(_parts(log.withColumn("_key", F.struct(*by)), [*by, *order], parts).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    placed = placed.withColumn("_part", F.shiftright("_at", 33).cast("int"))
    key_of = lambda name: F.to_json(F.struct(*[F.struct(F.col(f"{name}._key.{c}").alias("v"), F.col(f"{name}._key.{c}").isNull().alias("n")).alias(c) for c in by]))
    ends = placed.groupBy("_part").agg(F.min(F.struct("_at", "_key")).alias("a"), F.max(F.struct("_at", "_key")).alias("z"))
    last = placed.join(ends.select("_part", F.col("z._key").alias("_last")), "_part").filter(F.col("_key").eqNullSafe(F.col("_last")))
    sizes = last.groupBy("_part").agg(F.count(F.lit(1)).alias("m"))
    ends = ends.join(sizes, "_part").select("_part", key_of("a").alias("first"), key_of("z").alias("last"), "m")
    ends = ends.orderBy("_part").collect()  # a row a part
    wanted = []
    for i, e in enumerate(ends):
        missing, j = n - 1, i - 1
        while missing > 0 and j >= 0 and ends[j]["last"] == e["first"]:
            take = min(missing, ends[j].m)
            wanted.append((ends[j]._part, e._part, take, ends[j].m))
            missing -= take
            if ends[j].first != e["first"]:
                break
            j -= 1
    asked = log.sparkSession.createDataFrame(wanted, "_part int, _for int, _take long, _m long")
    # a part's rows of its last key are its last ones, so their places are known without counting
    tops = placed.groupBy("_part").agg(F.max("_at").alias("_top"))
    halo = placed.join(asked.join(tops, "_part"), "_part").filter(F.col("_at") > F.col("_top") - F.col("_take"))
    value_of = F.col(value).cast("double").alias("_value")
    both = placed.select(F.col("_part").alias("_for"), "_at", "_key", F.lit(False).alias("_halo"), value_of, *columns)
    both = both.unionByName(halo.select("_for", "_at", "_key", F.lit(True).alias("_halo"), value_of, *columns))
    both = both.repartition("_for").sortWithinPartitions("_for", "_at")

    def roll(batches):
        state, frame, window, before = None, [], [], 0  # frame: values in order of rows, from ``before`` on; window: those that are known, sorted
        for b in batches:
            now = list(zip(b.column("_for").to_pylist(), b.column("_key").to_pylist()))
            rolled = []
            for at, v in zip(now, b.column("_value").to_pylist()):
                if at != state:
                    state, frame, window, before = at, [], [], 0
                v = None if v != v else v
                frame.append(v)
                if v is not None:
                    insort(window, v)
                if len(frame) - before > n:
                    old, before = frame[before], before + 1
                    if old is not None:
                        del window[bisect_left(window, old)]
                    if before > n:
                        frame, before = frame[before:], 0
                rolled.append(_interpolated(window, p))
            mine = pc.invert(b.column("_halo"))
            cols = [b.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([c.filter(mine) for c in [*cols, pa.array(rolled, pa.float64())]], [*columns, "rolling"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in log.schema.fields) + ", rolling double"
    return both.mapInArrow(roll, schema)
