"""The streams over the events table against the batch form over all rows."""

import datetime
import random

import pytest

from platewise.catalog import logs
from platewise.streaming import monitor
from platewise.streaming.monitor import ks_statistic

T0 = datetime.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    r = random.Random(30)
    seconds = r.sample(range(6 * 86400), 1600)
    rows = [(i, T0 + datetime.timedelta(seconds=s), r.randrange(8), r.choice(["click", "purchase", "view", "error"]), r.random()) for i, s in enumerate(seconds)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").repartition(3).write.parquet(f"{path}/events.parquet")
    return path, sorted(rows, key=lambda x: x[1])


def test_windows(spark, events):
    path, rows = events
    want = {}
    for _, ts, _, kind, _ in rows:
        n = want.setdefault(ts.date(), [0, 0])
        n[kind == "error"] += 1
    got = {datetime.date.fromisoformat(r.day): [r.requests, r.errors] for r in logs.j01_stream_windows(spark, path).collect()}
    assert got == want


def test_last_n_and_drift(spark, events):
    path, rows = events
    got = {r.key: (r.n, r.p50) for r in logs.j02_stream_last_n(spark, path).collect()}
    drift = {r.key: (r.n_current, r.statistic) for r in logs.j03_stream_drift(spark, path).collect()}
    for key in ("click", "purchase", "view", "error"):
        values = [x[4] for x in rows if x[3] == key]
        last = sorted(values[-200:])
        assert got[key] == (200, pytest.approx((last[99] + last[100]) / 2, abs=1e-6))
        current = values[300:][-300:]
        assert drift[key] == (len(current), pytest.approx(ks_statistic(values[:300], current), abs=1e-6) if len(current) >= 300 else None)


def test_feedback(spark, events):
    path, rows = events
    want = []
    for i, ts, user, kind, _ in rows:
        if kind == "purchase":
            hits = [v for _, t, u, k, v in rows if k == "click" and u == user and ts - datetime.timedelta(hours=1) <= t <= ts]
            want += [(i, v) for v in hits] or [(i, None)]
    got = [(r.event_id, r.prediction) for r in logs.j04_stream_feedback(spark, path).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def _arriving(spark, path, files):
    """A stream of files of (key, seconds, value), one file a trigger, written one after another."""
    for rows in files:
        rows = [(k, T0 + datetime.timedelta(seconds=s), v) for k, s, v in rows]
        spark.createDataFrame(rows, "key string, ts timestamp, value double").repartition(1).write.mode("append").parquet(path)
    return spark.readStream.schema("key string, ts timestamp, value double").option("maxFilesPerTrigger", 1).parquet(path)


def _collected(spark, stream, out, mark):
    sink = lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", mark).outputMode("update").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def test_state_goes_on_after_a_restart(spark, tmp_path):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    parts = [[("a", 10 * k + i, float(10 * k + i)) for i in range(10)] for k in range(4)]
    for k in (1, 3):  # two files, then the same query anew over two more
        stream = _arriving(spark, source, parts[k - 1 : k + 1])
        got = _collected(spark, monitor.drift_stream(stream, "key", "ts", "value", 10), out, mark)
    last = got.orderBy(got.batch.desc()).first()
    assert (last.n_reference, last.n_current, last.statistic, last.drifted) == (10, 10, 1.0, True)
    assert got.filter("batch = 1").first().statistic == 1.0 and got.filter("batch = 0").first().statistic is None


def test_a_trigger_of_one_key_comes_in_batches(spark, tmp_path):
    from platewise.streaming.monitor import _LastN, _PerKey

    class Counting(_LastN):
        def values(self, rows):
            for i, new in enumerate(_PerKey.values(self, rows)):
                assert len(new) <= 50
                yield new[-1:] if i else new

    rows = [("a", s, float(s)) for s in random.Random(1).sample(range(1000), 600)]
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    stream = _arriving(spark, source, [rows])
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        one = _collected(spark, monitor.last_n_stream(stream, "key", "ts", "value", 20), out, mark).first()
        several = _collected(spark, monitor._per_key(stream, "key", "ts", Counting("ts", "value", 0, 1000), "n long, p50 double, p99 double"), out + "2", mark + "2").first()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    last = sorted(v for _, _, v in sorted(rows, key=lambda x: x[1])[-20:])
    assert (one.n, one.p50) == (20, (last[9] + last[10]) / 2)
    assert several.n == 50 + 11  # all of the first batch and a row of each of the eleven others


def test_silent_keys_are_forgotten(spark, tmp_path):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    files = [[("a", s, 1.0) for s in range(5)] + [("b", 0, 1.0)], [("b", 500, 1.0)], [("b", 501, 1.0)], [("a", 502, 9.0), ("b", 502, 1.0)]]
    stream = _arriving(spark, source, files).withWatermark("ts", "1 second")
    got = _collected(spark, monitor.last_n_stream(stream, "key", "ts", "value", 100, idle=60_000), out, mark)
    rows = {(r.key, r.batch): (r.n, r.p50) for r in got.collect()}
    assert rows["a", 0] == (5, 1.0)
    again = [v for (k, n), v in rows.items() if k == "a" and n > 0 and v[0]]
    assert again == [(1, 9.0)]  # a starts anew
    assert max(v[0] for (k, _), v in rows.items() if k == "b") == 4  # b spoke again before its end came
