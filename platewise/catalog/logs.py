"""Request logs: summaries, last-N, drift, and streams over the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from platewise.catalog.base import VEC, query, rounded, table, vectors
from platewise.operators import metrics as M
from platewise.operators import monitoring as O
from platewise.scratch import folder
from platewise.streaming import monitor


@query("""SELECT count(*) FILTER (event_type <> 'error') AS requests, count(*) FILTER (event_type = 'error') AS errors, round(avg(value) FILTER (event_type <> 'error'), 6) AS mean,
 round(quantile_cont(value, 0.5) FILTER (event_type <> 'error'), 6) AS p50, round(quantile_cont(value, 0.95) FILTER (event_type <> 'error'), 6) AS p95, round(quantile_cont(value, 0.99) FILTER (event_type <> 'error'), 6) AS p99,
 max(value) FILTER (event_type <> 'error') AS max, round(count(*) FILTER (event_type = 'error') / greatest(count(*) FILTER (event_type <> 'error'), 1), 8) AS error_rate FROM events""")
def d44_j1_request_summary(spark, sf):
    out = O.request_summary(table(spark, sf, "events"), "value", F.col("event_type") == "error")
    return rounded(rounded(out, "mean", "p50", "p95", "p99"), "error_rate", digits=8)


@query("""WITH k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.99), 6) AS p99 FROM k WHERE rn <= 1000 GROUP BY event_type""")
def e01_last_n(spark, sf):
    rows = O.last_n(table(spark, sf, "events"), ["event_type"], ["ts", "event_id"], 1000)
    return rounded(rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.percentile("value", F.lit(0.5)).alias("p50"), F.percentile("value", F.lit(0.99)).alias("p99")), "p50", "p99")


@query("SELECT event_id, round(quantile_cont(value, 0.5) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS rolling FROM events")
def e01_rolling_percentile(spark, sf):
    return rounded(O.rolling_percentile(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "value", 20, 0.5), "rolling").select("event_id", "rolling")


@query("""WITH k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE value IS NOT NULL), l AS (SELECT event_type, value AS pred, user_id AS target FROM k WHERE rn <= 500)
SELECT event_type, round(avg((pred - target) ** 2), 4) AS mse, round(avg(abs(pred - target)), 4) AS mae FROM l GROUP BY event_type""")
def e02_j7_quality(spark, sf):
    rows = O.last_n(table(spark, sf, "events").filter("value is not null"), ["event_type"], ["ts", "event_id"], 500)
    long = rows.select("event_type", F.col("event_id").alias("sample"), F.lit(0).alias("f"), F.col("value").alias("pred"), F.col("user_id").cast("double").alias("target"))
    return rounded(M.regression(long, ["event_type"]), "mse", "mae", digits=4).select("event_type", "mse", "mae")


PARTS = """k AS (SELECT event_type AS task, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS a, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS z FROM events WHERE value IS NOT NULL),
parts AS (SELECT task, event_id, value, CASE WHEN a <= 300 THEN 'reference' WHEN z <= 300 THEN 'current' END AS part FROM k WHERE a <= 300 OR z <= 300)"""


def _parts(spark, sf):
    log = table(spark, sf, "events").filter("value is not null").select(F.col("event_type").alias("task"), "event_id", "value", "ts")
    return O.reference_and_current(log, ["task"], ["ts", "event_id"], 300)


@query(f"WITH {PARTS} SELECT task, event_id, part FROM parts")
def e03_reference_and_current(spark, sf):
    return _parts(spark, sf).select("task", "event_id", "part")


@query(f"""WITH {PARTS}, s AS (SELECT task, value, count(*) FILTER (part = 'reference') AS r, count(*) FILTER (part = 'current') AS c FROM parts GROUP BY ALL),
u AS (SELECT task, sum(r) OVER w AS fr, sum(c) OVER w AS fc, sum(r) OVER (PARTITION BY task) AS nr, sum(c) OVER (PARTITION BY task) AS nc FROM s WINDOW w AS (PARTITION BY task ORDER BY value)),
d AS (SELECT task, any_value(nr)::BIGINT AS n_reference, any_value(nc)::BIGINT AS n_current, max(abs(fr / nr - fc / nc)) AS d FROM u GROUP BY task), x AS (SELECT *, sqrt(n_reference * n_current / (n_reference + n_current)) AS e FROM d),
p AS (SELECT *, (e + 0.12 + 0.11 / e) * d AS x FROM x)
SELECT task, n_reference, n_current, round(d, 6) AS statistic, round(CASE WHEN x < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0, list_sum(list_transform(range(1, 41), lambda k: 2 * (-1) ** (k - 1) * exp(-2.0 * k * k * x * x))))) END, 6) AS p,
 (CASE WHEN x < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0, list_sum(list_transform(range(1, 41), lambda k: 2 * (-1) ** (k - 1) * exp(-2.0 * k * k * x * x))))) END) < 0.01 AS drifted FROM p WHERE n_current >= 300""")
def j03_j06_drift(spark, sf):
    return O.drift_report(O.drift(_parts(spark, sf), ["task"], "value", 300)).filter("n_current >= 300")


@query(f"WITH {VEC} SELECT 'cells' AS task, false AS latent, round(list_avg(x), 6) AS value FROM vec UNION ALL SELECT 'latent', true, round(list_max(x), 6) FROM vec")
def j05_drift_reference(spark, sf):
    rows = vectors(spark, sf).select(F.col("x").alias("cells_predictions"), F.array(F.array_max("x")).alias("latent_predictions"))
    return rounded(O.drift_reference(rows), "value")


def _stream(spark, sf, *columns, close=False):
    """The events table as a stream of files in the order of ts: ranges of ts, one file each, written one after another, since
    the file source goes by the time of writing. With ``close`` three more files follow that hold one row of each event
    type, without event_id and value, far behind the last event, so that the watermark passes all events."""
    events = table(spark, sf, "events")
    kind = events.schema
    path = folder(spark, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    ends = events.select(F.percentile_approx(at, F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias("q")).first().q
    ends = [None, *sorted(set(ends or ())), None]
    for low, high in zip(ends, ends[1:]):
        part = events if low is None else events.filter(at >= low)
        part = part if high is None else part.filter(at < high) if low is not None else part.filter(at.isNull() | (at < high))
        part.repartition(1).write.mode("append").parquet(path)
    for days in (1000, 2000, 3000) if close else ():
        last = events.crossJoin(events.agg(F.max("ts").alias("_end"))).groupBy("event_type").agg(F.first("_end").alias("_end"))
        last = last.select(*[
            F.col(c) if c == "event_type" else F.lit(-1).cast(kind[c].dataType).alias(c) if c == "user_id" else (F.col("_end") + F.expr(f"interval {days} days")).cast(kind[c].dataType).alias(c) if c == "ts" else F.lit(None).cast(kind[c].dataType).alias(c)
            for c in kind.names
        ])
        last.repartition(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).select(*columns)


def _run(spark, stream, mode):
    """Run a stream over all that is there; the rows that it wrote."""
    out, mark = folder(spark, "stream"), folder(spark, "marks")
    if mode == "append":
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    else:
        sink = lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")  # noqa: E731  # a batch that is tried again replaces itself
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", mark).outputMode("update").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


@query("""SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (event_type <> 'error') AS requests, count(*) FILTER (event_type = 'error') AS errors,
 round(count(*) FILTER (event_type = 'error') / greatest(count(*) FILTER (event_type <> 'error'), 1), 6) AS error_rate FROM events GROUP BY 1""")
def j01_stream_windows(spark, sf):
    """Tumbling windows of a day over the stream, all of them closed by the watermark."""
    log = _stream(spark, sf, "ts", "event_type", "value", close=True)
    out = monitor.request_windows(log, "ts", "value", F.col("event_type") == "error", width="1 day")
    out = _run(spark, out.select(F.col("window.start").alias("start"), "requests", "errors", F.round("error_rate", 6).alias("error_rate")), "append")
    end = table(spark, sf, "events").agg(F.max(F.col("ts").cast("timestamp")).alias("end"))
    out = out.join(F.broadcast(end), F.col("start") <= F.col("end"))  # one row; without the rows that close
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "requests", "errors", "error_rate")


@query("""WITH k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC) AS rn FROM events WHERE value IS NOT NULL)
SELECT event_type AS key, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50 FROM k WHERE rn <= 200 GROUP BY event_type""")
def j02_stream_last_n(spark, sf):
    """Per event type the state after the last trigger."""
    out = _run(spark, monitor.last_n_stream(_stream(spark, sf, "ts", "event_type", "value"), "event_type", "ts", "value", 200), "update")
    return rounded(out.groupBy("key").agg(F.max_by("n", "batch").alias("n"), F.max_by("p50", "batch").alias("p50")), "p50")


@query("""WITH k AS (SELECT event_type AS key, value, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS a, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC) AS z FROM events WHERE value IS NOT NULL),
parts AS (SELECT key, value, CASE WHEN a <= 300 THEN 'r' WHEN z <= 300 THEN 'c' END AS part FROM k WHERE a <= 300 OR z <= 300), s AS (SELECT key, value, count(*) FILTER (part = 'r') AS r, count(*) FILTER (part = 'c') AS c FROM parts GROUP BY ALL),
u AS (SELECT key, sum(r) OVER w AS fr, sum(c) OVER w AS fc, sum(r) OVER (PARTITION BY key) AS nr, sum(c) OVER (PARTITION BY key) AS nc FROM s WINDOW w AS (PARTITION BY key ORDER BY value))
SELECT key, any_value(nc)::BIGINT AS n_current, round(max(CASE WHEN nc >= 300 THEN abs(fr / nr - fc / nc) END), 6) AS statistic FROM u GROUP BY key""")
def j03_stream_drift(spark, sf):
    """Per event type the test after the last trigger."""
    out = _run(spark, monitor.drift_stream(_stream(spark, sf, "ts", "event_type", "value"), "event_type", "ts", "value", 300), "update")
    last = out.groupBy("key").agg(F.max(F.struct("batch", "n_current", "statistic")).alias("x"))
    return rounded(last.select("key", "x.n_current", "x.statistic"), "statistic")


@query("""WITH b AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase'), c AS (SELECT user_id, ts, value FROM events WHERE event_type = 'click')
SELECT event_id, value AS prediction FROM b LEFT JOIN c ON b.user_id = c.user_id AND b.ts >= c.ts AND c.ts >= b.ts - INTERVAL 1 HOUR""")
def j04_stream_feedback(spark, sf):
    """Each purchase with the clicks of its user in the hour before."""
    clicks = _stream(spark, sf, "user_id", "ts", "value", "event_type", close=True).filter("event_type = 'click'").select("user_id", "ts", F.col("value").alias("prediction"))
    bought = _stream(spark, sf, "user_id", "ts", "event_id", "event_type", close=True).filter("event_type = 'purchase'").select("user_id", "ts", "event_id")
    return _run(spark, monitor.match_feedback(clicks, bought, "user_id", "ts").select("event_id", "prediction"), "append").filter("event_id is not null")


@query("SELECT count(*) AS n, round(sum((value - user_id) ** 2), 1) AS square, round(sum(abs(value - user_id)), 2) AS error FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL")
def j07_stream_quality(spark, sf):
    """Quality of matched pairs batch by batch; errors times rows add up over the batches."""
    pairs = _stream(spark, sf, "event_id", "value", "user_id").select(F.col("event_id").alias("sample"), F.lit(0).alias("f"), F.col("value").alias("pred"), F.col("user_id").cast("double").alias("target"))
    out, mark = folder(spark, "quality"), folder(spark, "marks")
    step = monitor.quality_of_batch(lambda metrics, n: metrics.write.mode("overwrite").parquet(f"{out}/batch={n}"))
    pairs.writeStream.foreachBatch(step).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(out)
    return got.agg(F.sum("n").alias("n"), F.round(F.sum(F.col("mse") * F.col("n")), 1).alias("square"), F.round(F.sum(F.col("mae") * F.col("n")), 2).alias("error"))


@query("""WITH t AS (SELECT max(ts) AS top FROM events WHERE event_id % 2 = 0)
SELECT event_id, event_type, CASE WHEN event_id % 2 = 1 AND ts < top - INTERVAL 600 SECOND THEN 'late' ELSE 'good' END AS side FROM events, t""")
def a15_j08_append_and_late(spark, sf):
    """Rows with odd numbers come second, so all of them but the last ten minutes are late."""
    source, log, out, marks = (folder(spark, n) for n in ("events", "log", "sides", "marks"))
    events = table(spark, sf, "events").select("event_id", "event_type", "ts")
    for odd in (0, 1):
        events.filter(F.col("event_id") % 2 == odd).repartition(1).write.mode("append").parquet(source)
    arriving = lambda path: spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
    monitor.append_log(arriving(source), log, f"{marks}/log").awaitTermination()
    arriving(log).writeStream.foreachBatch(monitor.split_late("ts", 600, out)).option("checkpointLocation", f"{marks}/late").trigger(availableNow=True).start().awaitTermination()
    sides = [spark.read.schema(events.schema).parquet(f"{out}/{s}").select("event_id", "event_type", F.lit(s).alias("side")) for s in ("good", "late")]
    return sides[0].unionByName(sides[1])
