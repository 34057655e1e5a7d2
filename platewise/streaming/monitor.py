"""Structured Streaming jobs over request, prediction and feedback logs.

All jobs use event time. State is bounded by watermarks or by the window's size; late rows are
written to a rejects table by a stage in front, since stateful operators drop them silently.
"""

from __future__ import annotations

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LATE = "10 minutes"


def request_windows(log: DataFrame, ts: str, latency: str, error: Column, by=(), width: str = "5 minutes", slide: str | None = None, late: str = LATE) -> DataFrame:
    """Counts, error rate, throughput and approximate latency percentiles per event-time window."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    ok = F.when(~error, F.col(latency))
    out = log.withWatermark(ts, late).groupBy(w.alias("window"), *by).agg(
        F.sum((~error).cast("long")).alias("requests"),
        F.sum(error.cast("long")).alias("errors"),
        F.avg(ok).alias("mean"),
        F.percentile_approx(ok, 0.5).alias("p50"),
        F.percentile_approx(ok, 0.99).alias("p99"),
    )
    seconds = F.unix_timestamp("window.end") - F.unix_timestamp("window.start")
    return out.withColumn("error_rate", F.col("errors") / F.greatest("requests", F.lit(1))).withColumn("per_second", F.col("requests") / seconds)


def ks_statistic(a, b) -> float:
    """Exact two-sample Kolmogorov-Smirnov statistic of two lists."""
    import numpy as np

    a, b = np.sort(a), np.sort(b)
    x = np.concatenate([a, b])
    return float(np.abs(np.searchsorted(a, x, side="right") / len(a) - np.searchsorted(b, x, side="right") / len(b)).max())


def ks_p(d: float, n: int, m: int) -> float:
    """Asymptotic p value."""
    import math

    e = math.sqrt(n * m / (n + m))
    x = (e + 0.12 + 0.11 / e) * d
    if x < 0.2:
        return 1.0
    return max(0.0, min(1.0, sum(2 * (-1) ** (k - 1) * math.exp(-2.0 * k * k * x * x) for k in range(1, 41))))


def _in_rocksdb(log: DataFrame) -> None:
    """State of arbitrary shape is kept in RocksDB, so it need not fit an executor's memory."""
    log.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _PerKey(StatefulProcessor):
    """State of a key that ends when the key has been silent for ``idle`` milliseconds of event time (0: never)."""

    def __init__(self, ts: str, value: str, idle: int):
        self.ts, self.value, self.idle = ts, value, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lists = {name: handle.getListState(name, "ts long, value double") for name in self.names}

    def values(self, rows):
        """Each batch as a list of (microseconds, value), in order of time; only one batch is held at a time."""
        for batch in rows:
            batch = batch[[self.ts, self.value]].dropna().sort_values(self.ts, kind="stable")
            yield list(zip(batch[self.ts].astype("datetime64[us]").astype("int64").tolist(), batch[self.value].astype(float).tolist()))

    def kept(self, name: str) -> list:
        state = self.lists[name]
        return list(state.get()) if state.exists() else []

    def wait(self, last: int) -> None:
        """Sets the key's end to ``idle`` after its last row (in microseconds)."""
        if self.idle:
            old = [t for t in self.handle.listTimers()]
            end = max([last // 1000 + self.idle, *old])
            for t in old:
                if t != end:
                    self.handle.deleteTimer(t)
            if end not in old:
                self.handle.registerTimer(end)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        for state in self.lists.values():
            state.clear()
        yield from ()

    def close(self) -> None:
        pass


def _latest(kept: list, new: list, n: int) -> list:
    """The last ``n`` of two lists in order of time, which of equal times keep the order of arrival."""
    return sorted([*kept, *new], key=lambda x: x[0])[-n:]


class _LastN(_PerKey):
    names = ("last",)

    def __init__(self, ts, value, idle, n):
        super().__init__(ts, value, idle)
        self.n = n

    def handleInputRows(self, key, rows, timerValues):
        kept = self.kept("last")
        for new in self.values(rows):
            kept = _latest(kept, new[-self.n :], self.n)
        if kept:
            self.lists["last"].put(kept)
            self.wait(kept[-1][0])
        s = pd.Series([v for _, v in kept], dtype=float)
        yield pd.DataFrame({"key": [key[0]], "n": [len(s)], "p50": [s.quantile(0.5)], "p99": [s.quantile(0.99)]})


class _Drift(_PerKey):
    names = ("reference", "current")

    def __init__(self, ts, value, idle, window, alpha):
        super().__init__(ts, value, idle)
        self.window, self.alpha = window, alpha

    def handleInputRows(self, key, rows, timerValues):
        fixed, first, current = self.kept("reference"), [], self.kept("current")
        free = self.window - len(fixed)
        for new in self.values(rows):
            if free:  # the earliest rows of the trigger fill the reference, in whatever batch they come
                first = sorted([*first, *new], key=lambda x: x[0])
                first, new = first[:free], first[free:]
            current = _latest(current, new[-self.window :], self.window)
        if first:
            fixed = [*fixed, *first]
            self.lists["reference"].put(fixed)
        if current:
            self.lists["current"].put(current)
        if fixed:
            self.wait(max(x[-1][0] for x in (fixed, current) if x))
        d = ks_statistic([v for _, v in fixed], [v for _, v in current]) if len(current) >= self.window else None
        p = ks_p(d, len(fixed), len(current)) if d is not None else None
        out = {"key": [key[0]], "n_reference": [len(fixed)], "n_current": [len(current)], "statistic": [d], "p": [p], "drifted": [p is not None and p < self.alpha]}
        yield pd.DataFrame(out).astype({"statistic": "float64", "p": "float64"})


def _per_key(log: DataFrame, key: str, ts: str, processor: _PerKey, schema: str) -> DataFrame:
    _in_rocksdb(log)
    kind = log.schema[key].dataType.simpleString()
    mode = "eventTime" if processor.idle else "none"
    return log.groupBy(key).transformWithStateInPandas(processor, f"key {kind}, {schema}", "Update", mode)


def drift_stream(log: DataFrame, key: str, ts: str, value: str, window: int = 500, alpha: float = 0.01, idle: int = 0) -> DataFrame:
    """Per key the first ``window`` values become the reference; later ones fill a buffer of the last
    ``window``, and once it is full each trigger tests it. State per key is two lists of at most ``window`` rows, and a trigger's rows are read batch by batch.

    With ``idle`` (milliseconds; ``log`` needs a watermark on ``ts``) a key that is silent for so long is forgotten and starts anew. Nulls don't count.
    """
    schema = "n_reference long, n_current long, statistic double, p double, drifted boolean"
    return _per_key(log, key, ts, _Drift(ts, value, idle, window, alpha), schema)


def last_n_stream(log: DataFrame, key: str, ts: str, value: str, n: int = 1000, idle: int = 0) -> DataFrame:
    """Per key the percentiles of its last n values, updated each trigger; state is one list of at most n rows. ``idle`` as in ``drift_stream``."""
    return _per_key(log, key, ts, _LastN(ts, value, idle, n), "n long, p50 double, p99 double")


def match_feedback(predictions: DataFrame, feedback: DataFrame, key: str, ts: str, within: str = "1 hour", late: str = LATE) -> DataFrame:
    """Each feedback row with the predictions of its key in the time before it (stream-stream join in bounded state)."""
    p = predictions.withWatermark(ts, late).withColumnsRenamed({key: "_pk", ts: "predicted_at"})
    f = feedback.withWatermark(ts, late)
    limit = (F.col(ts) >= F.col("predicted_at")) & (F.col("predicted_at") >= F.col(ts) - F.expr(f"interval {within}"))
    return f.join(p, (f[key] == p["_pk"]) & limit, "leftOuter").drop("_pk")


def quality_of_batch(sink):
    """A ``foreachBatch`` function that scores matched pairs (``sample, f, pred, target``) and hands the metrics, their number of pairs ``n`` and the
    batch's number to ``sink``, which should replace what it has of that batch."""
    from platewise.operators.metrics import regression

    def run(batch: DataFrame, number: int) -> None:
        known = batch.filter("pred is not null and target is not null")
        sink(regression(known).crossJoin(known.agg(F.count(F.lit(1)).alias("n"))), number)  # two rows of sums

    return run


def split_late(ts: str, late_seconds: int, path: str):
    """A ``foreachBatch`` function that sends rows behind the largest event time seen in earlier batches by more than the
    allowed lateness to ``path/late``, and the others to ``path/good``.

    Every batch writes its own folder and its largest event time beside it, and reads only those of smaller numbers. So a batch that is
    tried again replaces what it wrote and decides as before, and a restart goes on from what is written.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark, horizon = batch.sparkSession, None
        try:  # the first batch finds nothing
            horizon = None if number == 0 else spark.read.schema("top timestamp, batch long").parquet(f"{path}/horizon").filter(F.col("batch") < number).agg(F.max("top")).first()[0]
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
        late = F.lit(False) if horizon is None else F.coalesce(F.col(ts).cast("timestamp") < F.lit(horizon) - F.expr(f"interval {late_seconds} seconds"), F.lit(False))
        for name, rows in (("late", batch.filter(late)), ("good", batch.filter(~late)), ("horizon", batch.agg(F.max(F.col(ts).cast("timestamp")).alias("top")))):
            rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")

    return run


def append_log(stream: DataFrame, path: str, checkpoint: str):
    """Append a stream to Parquet."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
