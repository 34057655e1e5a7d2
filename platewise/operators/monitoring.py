"""Batch views of request and feedback logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewise.operators.order import exact_percentiles
from platewise.operators.ranges import rolling_percentile  # noqa: F401

PERCENTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def request_summary(log: DataFrame, latency: str, error: Column, by=(), approximate: bool = False) -> DataFrame:
    """Totals, error rate (errors / max(successes, 1)) and latency figures of the successful requests."""
    ok = F.when(~error, F.col(latency))
    by = list(by)
    rough = [F.percentile_approx(ok, p).alias(k) for k, p in PERCENTILES.items()] if approximate else []
    out = log.groupBy(*by).agg(F.sum((~error).cast("long")).alias("requests"), F.sum(error.cast("long")).alias("errors"), F.avg(ok).alias("mean"), *rough, F.max(ok).alias("max"))
    if not approximate:
        exact = exact_percentiles(log.withColumn("_ok", ok), by, "_ok", PERCENTILES)
        out = out.join(exact, by) if by else out.crossJoin(F.broadcast(exact))  # without keys it is one row
    return out.withColumn("error_rate", F.col("errors") / F.greatest("requests", F.lit(1)))


def last_n(log: DataFrame, by, order, n: int) -> DataFrame:
    """The last n rows of each key. A key's rows are ranked by a window, which keeps the first n of a group only."""
    desc = [F.col(c).desc() for c in order]
    return log.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*desc))).filter(F.col("_rn") <= n).drop("_rn")


def reference_and_current(log: DataFrame, by, order, window: int) -> DataFrame:
    """The first ``window`` rows of each key as ``reference`` and the last ones after them as ``current``.

    Both are ranks with a limit, of which tasks keep the first rows before the shuffle; a key's count says how many of its last rows are
    not among the first.
    """
    by = list(by)
    first = log.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_n") <= window)
    last = log.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*[F.col(c).desc() for c in order]))).filter(F.col("_n") <= window)
    sizes = log.groupBy(*by).agg(F.count(F.lit(1)).alias("_size")).withColumnsRenamed({c: f"_b_{c}" for c in by})
    same = reduce(lambda x, y: x & y, [last[c].eqNullSafe(F.col(f"_b_{c}")) for c in by])
    last = last.join(sizes, same).filter(F.col("_n") <= F.col("_size") - window).drop("_size", *[f"_b_{c}" for c in by])
    return first.withColumn("part", F.lit("reference")).unionByName(last.withColumn("part", F.lit("current"))).drop("_n")


def kolmogorov(d: Column, n: Column, m: Column, terms: int = 40) -> Column:
    """Asymptotic p value of a two-sample Kolmogorov-Smirnov statistic."""
    e = F.sqrt(n * m / (n + m))
    x = (e + 0.12 + 0.11 / e) * d
    out = F.lit(0.0)
    for k in range(1, terms + 1):
        out = out + 2 * (-1) ** (k - 1) * F.exp(-2.0 * k * k * x * x)
    return F.when(x < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), out)))


def drift(parts: DataFrame, by, value: str, window: int, alpha: float = 0.01) -> DataFrame:
    """Per key the KS statistic (exact) and p value (asymptotic) between reference and current rows, and the flag.

    Nothing is tested until ``window`` current rows are in.
    """
    ref, cur = (F.col("part") == "reference").cast("long"), (F.col("part") == "current").cast("long")
    steps = parts.groupBy(*by, value).agg(F.sum(ref).alias("_r"), F.sum(cur).alias("_c"))
    upto = Window.partitionBy(*by).orderBy(value)
    steps = steps.withColumn("_fr", F.sum("_r").over(upto)).withColumn("_fc", F.sum("_c").over(upto))
    sizes = steps.groupBy(*by).agg(F.sum("_r").alias("n_reference"), F.sum("_c").alias("n_current"))
    d = steps.join(sizes, list(by)).groupBy(*by, "n_reference", "n_current").agg(F.max(F.abs(F.col("_fr") / F.col("n_reference") - F.col("_fc") / F.col("n_current"))).alias("_d"))
    ready = (F.col("n_reference") >= window) & (F.col("n_current") >= window)
    p = kolmogorov(F.col("_d"), F.col("n_reference").cast("double"), F.col("n_current").cast("double"))
    out = d.select(*by, "n_reference", "n_current", F.when(ready, F.col("_d")).alias("statistic"), F.when(ready, p).alias("p"))
    return out.withColumn("drifted", F.coalesce(F.col("p") < alpha, F.lit(False)))


def drift_reference(predictions: DataFrame, suffix: str = "_predictions") -> DataFrame:
    """Per task column ending in ``suffix`` the mean of each row's vector, long: ``task, latent, value``."""
    out = None
    for c in [c for c in predictions.columns if c.endswith(suffix)]:
        mean = F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / F.size(c)
        task = c.removesuffix(suffix)
        row = predictions.select(F.lit(task).alias("task"), F.lit("latent" in task).alias("latent"), mean.alias("value"))
        out = row if out is None else out.unionByName(row)
    return out


def drift_report(result: DataFrame, digits: int = 6) -> DataFrame:
    """Rounded for reports."""
    return result.withColumn("p", F.round("p", digits)).withColumn("statistic", F.round("statistic", digits))
