"""Normalisation, batch correction and feature statistics.

Statistics come from the long form, one row a feature (or batch and feature), and go back to the
packed rows as arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.operators import gram
from platewise.operators.order import MOST, average_rank, exact_percentiles, largest_group, median_and_ends, median_and_mad, packed_ends
from platewise.scratch import written
from platewise.schema import to_long

FLOOR, MAD_SCALE = 1e-8, 1.4826


def statistics(long: DataFrame, method: str, keys=(), only: Column | None = None, largest: int | None = None) -> DataFrame:
    """``centre`` and ``scale`` per feature (and keys): robust, zscore, minmax, center or none. ``only`` limits the rows used; ``largest``: values of the
    largest group at most, which the robust form counts if it is not known."""
    keys = [*keys, "f"]
    v = F.when(only, F.col("v")) if only is not None else F.col("v")
    rows = long.withColumn("v", v)
    if method == "robust":
        out = median_and_mad(rows, keys, "v", largest).select(*keys, F.col("_mid").alias("centre"), (F.col("_mad") * MAD_SCALE).alias("scale"))
    elif method == "zscore":
        out = rows.groupBy(*keys).agg(F.avg("v").alias("centre"), F.stddev_pop("v").alias("scale"))
    elif method == "minmax":
        out = rows.groupBy(*keys).agg(F.min("v").alias("centre"), (F.max("v") - F.min("v")).alias("scale"))
    elif method == "center":
        out = rows.groupBy(*keys).agg(F.avg("v").alias("centre"), F.lit(1.0).alias("scale"))
    else:
        out = rows.groupBy(*keys).agg(F.lit(0.0).alias("centre"), F.lit(1.0).alias("scale"))
    return out.withColumn("scale", F.greatest("scale", F.lit(FLOOR)))


def packed_statistics(stats: DataFrame, keys=()) -> DataFrame:
    """Arrays ``centre`` and ``scale`` in feature order, a row per key."""
    cells = F.array_sort(F.collect_list(F.struct("f", "centre", "scale")))
    return stats.groupBy(*keys).agg(F.transform(cells, lambda x: x["centre"]).alias("centre"), F.transform(cells, lambda x: x["scale"]).alias("scale"))


def scale(v: Column, centre: Column, spread: Column, clip: float | None = None) -> Column:
    """(x - centre) / scale, clipped."""
    out = F.zip_with(F.zip_with(v, centre, lambda x, c: x - c), spread, lambda x, s: x / s)
    return F.transform(out, lambda x: F.when(x.isNotNull(), F.greatest(F.lit(-clip), F.least(F.lit(clip), x)))) if clip else out


def unscale(v: Column, centre: Column, spread: Column) -> Column:
    """D9's inverse."""
    return F.zip_with(F.zip_with(v, spread, lambda x, s: x * s), centre, lambda x, c: x + c)


def normalise(packed: DataFrame, method: str = "robust", by=(), clip: float | None = 5.0, only: Column | None = None, largest: int | None = None) -> DataFrame:
    """D6-D9 on packed rows, over all rows or within ``by``; ``largest``: rows of the largest group, if known."""
    by = list(by)
    if method == "robust" and largest is None:
        largest = largest_group(packed, by, "features")  # rows: a feature has no more values
    stats = packed_statistics(statistics(to_long(packed, [c for c in packed.columns if c != "features"]), method, by, only, largest), by)
    rows = packed.join(stats, by) if by else packed.crossJoin(F.broadcast(stats))
    return rows.withColumn("features", scale(F.col("features"), F.col("centre"), F.col("scale"), clip)).drop("centre", "scale")


def control_statistics(long: DataFrame, plate: str, control: Column, method: str = "robust") -> DataFrame:
    """Per plate and feature from control wells; from all wells where a plate has no controls."""
    rows = long.withColumn("_c", control)
    largest = largest_group(rows, [plate, "f"], "v") if method == "robust" else None
    own = statistics(rows, method, [plate], F.col("_c"), largest)
    every = statistics(rows, method, [plate], largest=largest).withColumnsRenamed({"centre": "_centre", "scale": "_scale"})
    both = every.join(own, [plate, "f"], "left")
    has = F.col("centre").isNotNull()
    return both.select(plate, "f", F.when(has, F.col("centre")).otherwise(F.col("_centre")).alias("centre"), F.when(has, F.col("scale")).otherwise(F.col("_scale")).alias("scale"))


def percent_of_control(long: DataFrame, plate: str, control: Column) -> DataFrame:
    """100 x / mean of controls; a mean within 1e-10 of zero counts as 1e-10."""
    means = long.groupBy(plate, "f").agg(F.avg(F.when(control, F.col("v"))).alias("_m"))
    floor = F.when(F.abs("_m") < 1e-10, 1e-10).otherwise(F.col("_m"))
    return long.join(means, [plate, "f"]).withColumn("percent", 100 * F.col("v") / floor).drop("_m")


def fit_batches(long: DataFrame, batch: str, method: str) -> tuple[DataFrame, DataFrame]:
    """Statistics per batch and overall. ``method``: center, zscore, robust or reference (whose spreads are like zscore's).

    Means and spreads come from one scan, written as a row a batch and feature, with ``_rows`` of them; the overall ones are put together from those of the batches.
    """
    if method == "robust":
        return statistics(long, "robust", [batch]), statistics(long, "robust")
    spread = F.lit(1.0) if method == "center" else F.stddev_pop("v")
    per = long.groupBy(batch, "f").agg(F.avg("v").alias("centre"), spread.alias("scale"), F.sum("v").alias("_sum"), F.count("v").alias("_n"), F.count(F.lit(1)).alias("_rows"))
    per = written(per, "batches")
    means = per.groupBy("f").agg(F.try_divide(F.sum("_sum"), F.sum("_n")).alias("_mean"))  # a row a feature
    squares = F.sum(F.col("_n") * (F.col("scale") * F.col("scale") + (F.col("centre") - F.col("_mean")) * (F.col("centre") - F.col("_mean"))))
    spread = F.lit(1.0) if method == "center" else F.sqrt(F.try_divide(squares, F.sum("_n")))
    whole = per.join(F.broadcast(means), "f").groupBy("f").agg(F.first("_mean").alias("centre"), spread.alias("scale"))
    floored = F.greatest("scale", F.lit(FLOOR))
    return per.withColumn("scale", floored).drop("_sum", "_n"), written(whole.withColumn("scale", floored), "whole")


def correct_batches(long: DataFrame, batch: str, method: str, reference=None, fitted: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(x - c_b) / s_b * s + c with c and s of all rows, or of the reference batch. Null batches take the overall statistics. ``fitted``: ``fit_batches``, if known."""
    per, whole = fitted or fit_batches(long, batch, method)
    if method == "reference":
        if reference is None:
            return long
        goal = per.filter(F.col(batch).cast("string") == str(reference)).select("f", F.col("centre").alias("_c"), F.col("scale").alias("_s"))
    else:
        goal = whole.select("f", F.col("centre").alias("_c"), F.col("scale").alias("_s"))
    overall = whole.select("f", F.col("centre").alias("_c0"), F.col("scale").alias("_s0"))
    rows = long.join(per.select(batch, "f", "centre", "scale"), [batch, "f"], "left").join(F.broadcast(goal), "f").join(F.broadcast(overall), "f")
    centre, spread = F.coalesce("centre", "_c0"), F.coalesce("scale", "_s0")
    return rows.withColumn("v", (F.col("v") - centre) / spread * F.col("_s") + F.col("_c")).drop("centre", "scale", "_c", "_s", "_c0", "_s0")


def correct_packed(packed: DataFrame, batch: str, method: str, reference=None, fitted: tuple[DataFrame, DataFrame] | None = None, dealt: bool = False) -> DataFrame:
    """``correct_batches`` on packed rows: a batch's statistics come as one array, so a row meets them once and not once a feature.

    ``dealt``: rows are dealt by batch and not sorted, for what goes on to take them by batch.
    """
    per, whole = fitted or fit_batches(to_long(packed.select(batch, "features"), [batch]), batch, method)
    if method == "reference" and reference is None:
        return packed
    goal = per.filter(F.col(batch).cast("string") == str(reference)) if method == "reference" else whole
    goal = goal.select("f", F.col("centre").alias("_c"), F.col("scale").alias("_s"))
    overall = whole.select("f", F.col("centre").alias("_c0"), F.col("scale").alias("_s0")).join(F.broadcast(goal), "f")  # a row a feature
    cells = lambda c, s: F.transform(F.array_sort(F.collect_list(F.struct("f", c.alias("c"), s.alias("s"), "_c", "_s"))), lambda x: x.dropFields("f"))
    per = per.filter(F.col(batch).isNotNull()).join(F.broadcast(overall), "f")
    per = per.groupBy(batch).agg(cells(F.coalesce("centre", "_c0"), F.coalesce("scale", "_s0")).alias("_own"))
    every = overall.agg(cells(F.col("_c0"), F.col("_s0")).alias("_every"))
    rows = packed.join(per.hint("shuffle_hash") if dealt else per, batch, "left").crossJoin(F.broadcast(every))  # one row
    moved = lambda v, t: F.zip_with(v, t, lambda x, t: (x - t["c"]) / t["s"] * t["_s"] + t["_c"])
    x, t = F.col("features"), F.coalesce("_own", "_every")
    n = F.least(F.size(x), F.size(t))
    cut = F.when(n >= 0, moved(F.slice(x, 1, n), F.slice(t, 1, n)))  # a short row stays short, and features that the reference lacks fall away
    return rows.withColumn("features", F.when(F.size(x) == F.size(t), moved(x, t)).otherwise(cut)).drop("_own", "_every")


def corrected_ends(packed: DataFrame, batch: str, method: str, reference=None, most: int = MOST) -> DataFrame:
    """D13, then ``batch, f, _mid, _high, _low``: median, maximum and minimum of the corrected values of each batch and feature.

    Packed rows are shuffled once while the values of the largest batch are few; beyond that the long form is corrected.
    """
    packed = packed.select(batch, "features")
    long = to_long(packed, [batch])
    fitted = fit_batches(long, batch, method)
    sizes = fitted[0] if "_rows" in fitted[0].columns else long.groupBy(batch, "f").agg(F.count(F.lit(1)).alias("_rows"))
    rows, values = sizes.groupBy(batch).agg(F.max("_rows").alias("_r"), F.sum("_rows").alias("_v")).agg(F.max("_r"), F.max("_v")).first()
    if (values or 0) <= most:
        return packed_ends(correct_packed(packed, batch, method, reference, fitted, dealt=True), [batch])
    return median_and_ends(correct_batches(long, batch, method, reference, fitted), [batch, "f"], "v", rows, most)


def batch_summary(long: DataFrame, batch: str, method: str) -> DataFrame:
    """Rows of each batch, and mean and spread of its centres and scales over features."""
    per, _ = fit_batches(long, batch, method)
    sizes = long.filter("f = 0").groupBy(batch).agg(F.count(F.lit(1)).alias("n"))
    out = per.groupBy(batch).agg(
        F.avg("centre").alias("centre_mean"), F.stddev_pop("centre").alias("centre_std"), F.avg("scale").alias("scale_mean"), F.stddev_pop("scale").alias("scale_std")
    )
    return sizes.join(out, batch)


def feature_statistics(long: DataFrame) -> DataFrame:
    """Per feature moments, range and null share."""
    return long.groupBy("f").agg(
        F.avg("v").alias("mean"),
        F.stddev_pop("v").alias("std"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
        F.avg(F.col("v").isNull().cast("double")).alias("null_share"),
        F.var_pop("v").alias("var_pop"),
        F.var_samp("v").alias("var_samp"),
    ).withColumn("cv", F.col("std") / (F.abs("mean") + 1e-8))


def feature_medians(long: DataFrame) -> DataFrame:
    """The exact median of each feature."""
    return exact_percentiles(long, ["f"], "v", {"median": 0.5})


def removals(stats: DataFrame, version: int = 1, nulls: float = 0.05, variance: float = 1e-6) -> DataFrame:
    """D15 (version 1) and D18 (version 2): features to remove, with the reason."""
    low = F.col("var_pop") < variance if version == 1 else ~(F.col("var_samp") > variance)
    reason = F.when(F.col("null_share") > nulls, F.concat(F.lit("nulls="), F.round("null_share", 4).cast("string"))).when(
        F.coalesce(low, F.lit(True)), F.concat(F.lit("variance="), F.round("var_pop" if version == 1 else "var_samp", 8).cast("string"))
    )
    return stats.select("f", reason.alias("reason")).filter("reason is not null")


def removal_summary(removed: DataFrame) -> DataFrame:
    """Removed features by kind of reason."""
    return removed.groupBy(F.split("reason", "=")[0].alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def problem_features(stats: DataFrame, low: float = 1e-6, nulls: float = 0.05, times: float = 10.0) -> DataFrame:
    """Flags for low variance, many nulls, far outliers and constants."""
    far = (F.col("max") > F.col("mean") + times * F.col("std")) | (F.col("min") < F.col("mean") - times * F.col("std"))
    return stats.select(
        "f", (F.col("var_pop") < low).alias("low_variance"), (F.col("null_share") > nulls).alias("many_nulls"), far.alias("outliers"), (F.col("std") == 0).alias("constant")
    )


def correlations(long: DataFrame, key: str, method: str = "pearson") -> DataFrame:
    """``a < b, r`` over pairwise complete rows; constant features have no r."""
    rows = long.filter(F.col("v").isNotNull())
    if method == "spearman":
        rows = average_rank(written(rows.select(key, "f", "v"), "values"), ["f"], "v", "v", cuts=64)  # four scans
    return gram.correlation(gram.pair_sums(gram.listed(rows.select(key, "f", "v"), key)))


def packed_correlations(packed: DataFrame, features: str = "features", means: dict[int, float] | None = None) -> DataFrame:
    """D19 on packed rows, without gathering them by a key; ``means`` of the features, if known, save a scan."""
    return gram.correlation(gram.pair_sums(gram.listed_packed(packed, features), means=means))


def correlation_filter(variances: dict[int, float], pairs: list[tuple[int, int, float]], limit: float, version: int = 1) -> list[int]:
    """Features to drop, from the f x f matrix on the driver (a few thousand features at most).

    Version 1 goes over pairs i < j in order and drops the one of lower variance (j on a tie); a dropped feature
    still removes later ones within its own pass. Version 2 goes over columns and for each one not yet dropped drops all
    earlier columns that correlate with it.
    """
    if limit >= 1 or len(variances) < 2:
        return []
    high: dict[tuple[int, int], bool] = {(a, b): abs(r) > limit for a, b, r in pairs if r is not None}
    names, gone = sorted(variances), set()
    if version == 1:
        for i in names:
            if i in gone:
                continue
            for j in names:
                if j > i and j not in gone and high.get((i, j)):
                    gone.add(i if variances[i] < variances[j] else j)
    else:
        for j in names:
            if j not in gone:
                gone |= {i for i in names if i < j and i not in gone and high.get((i, j))}
    return sorted(gone)
