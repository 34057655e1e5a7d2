"""Evaluation of predictions in long form ``(sample, f, pred, target)``.

Every metric is one or two aggregations; further group keys (such as ``task``) pass through.
"""

from __future__ import annotations

import pickle

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewise.operators import gram
from platewise.operators.order import average_rank


def regression(long: DataFrame, by=()) -> DataFrame:
    """Mse, mae, rmse over elements and a global r2 (0 where the targets do not vary)."""
    d = F.col("pred") - F.col("target")
    out = long.groupBy(*by).agg(
        F.avg(d * d).alias("mse"), F.avg(F.abs(d)).alias("mae"), F.sum(d * d).alias("_res"), (F.var_pop("target") * F.count("target")).alias("_tot")
    )
    r2 = F.when(F.col("_tot") < 1e-8, 0.0).otherwise(1 - F.col("_res") / F.col("_tot"))
    return out.select(*by, "mse", "mae", F.sqrt("mse").alias("rmse"), r2.alias("r2"))


def _guarded_corr(long: DataFrame, keys) -> DataFrame:
    out = long.groupBy(*keys).agg(F.corr("pred", "target").alias("r"), F.stddev_pop("pred").alias("sp"), F.stddev_pop("target").alias("st"))
    return out.select(*keys, F.when((F.col("sp") > 1e-12) & (F.col("st") > 1e-12), F.col("r")).otherwise(0.0).alias("r"))


def pearson(long: DataFrame, mode: str = "sample", by=()) -> DataFrame:
    """Mean over samples or features, or one global value; constant vectors count as 0."""
    inner = {"sample": ["sample"], "feature": ["f"], "global": []}[mode]
    return _guarded_corr(long, [*by, *inner]).groupBy(*by).agg(F.avg("r").alias("pearson"))


def spearman(long: DataFrame, mode: str = "sample", by=()) -> DataFrame:
    """As ``pearson`` on average ranks."""
    inner = {"sample": ["sample"], "feature": ["f"], "global": []}[mode]
    keys = [*by, *inner]
    cuts = 0 if mode == "sample" else 64  # a feature or the whole table is a large group
    ranked = average_rank(average_rank(long, keys, "pred", "_p", cuts), keys, "target", "_t", cuts)
    ranked = ranked.withColumn("pred", F.col("_p")).withColumn("target", F.col("_t")).drop("_p", "_t")
    return _guarded_corr(ranked, keys).groupBy(*by).agg(F.avg("r").alias("spearman"))


def cosine(long: DataFrame, mode: str = "sample", by=()) -> DataFrame:
    """D38."""
    inner = {"sample": ["sample"], "global": []}[mode]
    sums = long.groupBy(*by, *inner).agg(
        F.sum(F.col("pred") * F.col("target")).alias("_d"), F.sum(F.col("pred") * F.col("pred")).alias("_p"), F.sum(F.col("target") * F.col("target")).alias("_t")
    )
    value = F.col("_d") / F.greatest(F.sqrt(F.col("_p")) * F.sqrt(F.col("_t")), F.lit(1e-8))
    return sums.groupBy(*by).agg(F.avg(value).alias("cosine"))


def per_feature(long: DataFrame, by=()) -> DataFrame:
    """Mse, r2 and pearson of every feature."""
    d = F.col("pred") - F.col("target")
    out = long.groupBy(*by, "f").agg(
        F.avg(d * d).alias("mse"),
        (1 - F.sum(d * d) / (F.var_pop("target") * F.count("target") + 1e-8)).alias("r2"),
        F.corr("pred", "target").alias("_r"),
        F.stddev_pop("pred").alias("_sp"),
        F.stddev_pop("target").alias("_st"),
    )
    return out.withColumn("pearson", F.when((F.col("_sp") > 1e-12) & (F.col("_st") > 1e-12), F.col("_r")).otherwise(0.0)).drop("_r", "_sp", "_st")


def summarise_per_feature(per: DataFrame) -> DataFrame:
    """Mean, median, std, min and max of each metric, and how many features have r2 over 0 and over 0.5."""
    long = per.select("f", F.expr("stack(3, 'mse', mse, 'r2', r2, 'pearson', pearson) as (metric, value)"))
    return long.groupBy("metric").agg(
        F.avg("value").alias("mean"),
        F.median("value").alias("median"),
        F.stddev_pop("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.sum((F.col("value") > 0).cast("long")).alias("over_0"),
        F.sum((F.col("value") > 0.5).cast("long")).alias("over_half"),
    )


def by_task(long: DataFrame, mask: str = "mask") -> DataFrame:
    """The regression metrics of each task over its unmasked rows, named ``task_metric``."""
    per = regression(long.filter(F.col(mask)), ["task"])
    rows = per.select("task", F.expr("stack(4, 'mse', mse, 'mae', mae, 'rmse', rmse, 'r2', r2) as (metric, value)"))
    return rows.select(F.concat_ws("_", "task", "metric").alias("metric"), "value")


def losses(long: DataFrame, delta: float = 1.0, by=()) -> DataFrame:
    """Huber loss, 1 - correlation and 1 - cosine as evaluation scores."""
    d = F.abs(F.col("pred") - F.col("target"))
    huber = long.groupBy(*by).agg(F.avg(F.when(d <= delta, 0.5 * d * d).otherwise(delta * (d - 0.5 * delta))).alias("huber"))
    both = pearson(long, "sample", by).select(*by, (1 - F.col("pearson")).alias("correlation_loss"))
    angle = cosine(long, "sample", by).select(*by, (1 - F.col("cosine")).alias("cosine_loss"))
    for other in (both, angle):
        huber = huber.join(other, list(by)) if by else huber.crossJoin(other)
    return huber


def gaussian_nll(long: DataFrame, log_variance: str, low: float = -10.0, high: float = 10.0) -> DataFrame:
    """Mean negative log-likelihood under predicted variances."""
    lv = F.greatest(F.lit(low), F.least(F.lit(high), F.col(log_variance)))
    d = F.col("pred") - F.col("target")
    return long.agg(F.avg(0.5 * (lv + d * d / F.exp(lv))).alias("nll"))


def multi_task(losses_: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted sum of task losses (``task, loss``); an unlisted task weighs 1."""
    w = F.coalesce(F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))])[F.col("task")], F.lit(1.0))
    return losses_.agg(F.sum(w * F.col("loss")).alias("loss"))


def latent_regularity(long: DataFrame, key: str) -> DataFrame:
    """Mean absolute and squared value, hinge on unit spread per dimension, and mean squared off-diagonal covariance."""
    v = long.agg(F.avg(F.abs("v")).alias("l1"), F.avg(F.col("v") * F.col("v")).alias("l2"), F.count_distinct("f").alias("_d"))
    spread = long.groupBy("f").agg(F.greatest(F.lit(0.0), 1 - F.sqrt(F.var_samp("v") + 1e-4)).alias("h")).agg(F.avg("h").alias("variance"))
    cov = gram.covariance(gram.pair_sums(gram.listed(long.select(key, "f", "v"), key))).agg((2 * F.sum(F.col("c") * F.col("c"))).alias("_cov"))
    return v.crossJoin(spread).crossJoin(cov).select("l1", "l2", "variance", (F.col("_cov") / F.col("_d")).alias("covariance"))


def weighted_reconstruction(long: DataFrame, weights: DataFrame) -> DataFrame:
    """Squared error weighted by feature (``f, weight``)."""
    d = F.col("pred") - F.col("target")
    return long.join(weights, "f").agg((F.sum(F.col("weight") * d * d) / F.count(F.lit(1))).alias("loss"))


def learning_area(history: DataFrame, x: str, y: str, by=()) -> DataFrame:
    """Area under a learning curve by the trapezoid rule."""
    w = Window.partitionBy(*by).orderBy(x)
    step = (F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2
    return history.withColumn("_a", step).groupBy(*by).agg(F.sum("_a").alias("area"))


def stopping(history: DataFrame, by, order: str, score: str, size: str, plateau: float = 0.02, step: float = 0.005, enough: int = 200) -> DataFrame:
    """Flags of a learning history: little gain over two rounds, little over one, large enough."""
    w = Window.partitionBy(*by).orderBy(order)
    gain1, gain2 = F.col(score) - F.lag(score, 1).over(w), F.col(score) - F.lag(score, 2).over(w)
    return (
        history.withColumn("plateau", F.coalesce(gain2 < plateau, F.lit(False)))
        .withColumn("small_step", F.coalesce(gain1 < step, F.lit(False)))
        .withColumn("large_enough", F.col(size) >= enough)
    )


def components_needed(explained: DataFrame, k: str, share: str, goals=(0.9, 0.95)) -> DataFrame:
    """Cumulative explained variance and the first component that reaches each goal. Rows are components."""
    total = explained.withColumn("cumulative", F.sum(share).over(Window.orderBy(k)))
    return total.agg(*[F.min(F.when(F.col("cumulative") >= g, F.col(k))).alias(f"k_{int(g * 100)}") for g in goals])


class Metric:
    """K3: a metric of one's own. A task makes one for each group, feeds it batches, and hands on its state; states are merged, then computed.

    ``update`` gets arrays of predictions and targets; ``merge`` gets another object of the class.
    """

    def update(self, pred, target) -> None:
        raise NotImplementedError

    def merge(self, other) -> None:
        raise NotImplementedError

    def compute(self) -> float:
        raise NotImplementedError


def user_metrics(long: DataFrame, metrics: dict, by: str) -> DataFrame:
    """K3: ``by, metric, value`` for metrics given as aggregate Columns over ``pred`` and ``target``, or as functions that make a ``Metric``.

    No group is gathered in one place: each task merges into one state a group, and only states are shuffled.
    """
    out = None
    for name, m in metrics.items():
        if isinstance(m, Column):
            rows = long.groupBy(by).agg(m.cast("double").alias("value"))
        else:
            rows = _merged(long, m, by)
        rows = rows.select(F.col(by), F.lit(name).alias("metric"), "value")
        out = rows if out is None else out.unionByName(rows)
    return out


def _merged(long: DataFrame, factory, by: str) -> DataFrame:
    kind = long.schema[by].dataType.simpleString()

    def states(batches):
        held: dict = {}
        for pdf in batches:
            for key, part in pdf.groupby(by, dropna=False):
                held.setdefault(key, factory()).update(part["pred"].to_numpy(), part["target"].to_numpy())
        yield pd.DataFrame({by: list(held), "state": [pickle.dumps(x) for x in held.values()]})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = factory()
        for x in pdf["state"]:
            whole.merge(pickle.loads(x))
        return pd.DataFrame({by: pdf[by].iloc[:1], "value": [float(whole.compute())]})

    packed = long.select(by, "pred", "target").mapInPandas(states, f"`{by}` {kind}, state binary")
    return packed.groupBy(by).applyInPandas(merge, f"`{by}` {kind}, value double")
