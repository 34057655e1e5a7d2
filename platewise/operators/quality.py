"""Well quality: null share, cell counts, profile norms, plate layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise import scratch
from platewise.functions.vectors import norm
from platewise.operators.order import exact_percentiles, largest_group, median_and_mad
from platewise.schema import to_long

# Plate types that belong to a perturbation type.
PLATE_TYPES = {"orf": ("orf",), "crispr": ("crispr",), "compound": ("compound", "compound_empty", "compound_full"), "target2": ("target2",)}
MAD_SCALE = 1.4826


def plates_of_type(plates: DataFrame, column: str, kind: str) -> DataFrame:
    """Plates whose type is one of the accepted ones; only if there are none, those whose type contains ``kind``."""
    kind = kind.lower()
    name = F.lower(F.trim(F.col(column)))
    exact = F.coalesce(name.isin(*PLATE_TYPES.get(kind, (kind,))), F.lit(False))
    part = F.coalesce(name.contains(kind), F.lit(False))
    flags = plates.withColumn("_exact", exact).withColumn("_part", part)
    some = flags.agg(F.coalesce(F.bool_or("_exact"), F.lit(False)).alias("_some"))
    return flags.crossJoin(F.broadcast(some)).filter(F.when(F.col("_some"), F.col("_exact")).otherwise(F.col("_part"))).drop("_exact", "_part", "_some")


def wells_of_plate(wells: DataFrame, plate: str, value) -> DataFrame:
    """B8."""
    return wells.filter(F.col(plate) == value)


def null_share_ok(features: Column, most: float = 0.5) -> Column:
    """B9."""
    return F.size(F.filter(features, lambda x: x.isNull() | F.isnan(x))) / F.size(features) <= most


def count_ok(count: Column | None, least: int = 50) -> Column:
    """A null count is 0; without a count column every well passes."""
    return F.lit(True) if count is None else F.coalesce(count.cast("double").cast("int"), F.lit(0)) >= least


def norm_bounds(packed: DataFrame, times: float = 3.0, by: list[str] | None = None) -> DataFrame:
    """Lower and upper norm, median plus or minus ``times`` MAD; nulls where the check does not apply."""
    by = by or []
    rows = scratch.written(packed.select(*by, norm(F.col("features")).alias("_norm")), "norms")  # several scans
    mad = median_and_mad(rows, by, "_norm").withColumn("_mad", F.col("_mad") * MAD_SCALE)
    applies = (F.col("_n") > 2) & (F.col("_mad") > 1e-8)
    return mad.select(
        *by, F.when(applies, F.col("_mid") - times * F.col("_mad")).alias("norm_low"), F.when(applies, F.col("_mid") + times * F.col("_mad")).alias("norm_high")
    )


def flag_wells(packed: DataFrame, count: str | None = None, null_share: float = 0.5, least: int = 50, times: float = 3.0, by: list[str] | None = None) -> DataFrame:
    """``qc_passed`` and ``qc_reasons`` from the three checks together."""
    bounds = norm_bounds(packed, times, by)
    rows = packed.join(bounds, by) if by else packed.crossJoin(F.broadcast(bounds))  # without keys it is one row
    n = norm(F.col("features"))
    tests = {
        "nulls": ~null_share_ok(F.col("features"), null_share),
        "count": ~count_ok(F.col(count) if count else None, least),
        "norm": F.coalesce((n < F.col("norm_low")) | (n > F.col("norm_high")), F.lit(False)),
    }
    reasons = F.array_compact(F.array(*[F.when(t, k) for k, t in tests.items()]))
    return rows.withColumn("qc_reasons", reasons).withColumn("qc_passed", F.size("qc_reasons") == 0).drop("norm_low", "norm_high")


def cell_count_passed(count: Column, least: int = 50) -> Column:
    """A missing count passes."""
    return F.coalesce(count >= least, F.lit(True))


def fill_missing(features: Column) -> Column:
    """B17."""
    return F.transform(features, lambda x: F.coalesce(F.when(~F.isnan(x), x), F.lit(0.0)))


def pack_profiles(df: DataFrame, features, plate=("plate", "source", "batch"), ordinal: str | None = None, prefix: str = "well_") -> DataFrame:
    """Identity columns and a feature vector; the plate is the first of the given columns that is there and not null."""
    there = [F.col(c).cast("string") for c in plate if c in df.columns]
    out = df.withColumn("plate_id", F.coalesce(*there) if there else F.lit(None).cast("string"))
    if ordinal:
        out = out.withColumn("sample_id", F.concat(F.lit(prefix), F.col(ordinal).cast("string")))
    return out.withColumn("features", fill_missing(F.array(*[F.col(c).cast("double") for c in features]))).drop(*features)


def well_position(well: Column) -> Column:
    """Row letters, column number and a sort key that puts AA after Z."""
    letters = F.regexp_extract(well, r"^([A-Z]+)(\d+)$", 1)
    return F.struct(letters.alias("row"), F.regexp_extract(well, r"^([A-Z]+)(\d+)$", 2).try_cast("int").alias("col"), F.length(letters).alias("row_length"))


def length_class(length: Column, edges=(100, 200, 300)) -> Column:
    """Class number, left-closed."""
    out = F.lit(0)
    for e in edges:
        out = out + F.when(length >= e, 1).otherwise(0)
    return out


def missing_positions(wells: DataFrame, plate: str, row: str, col: str, rows, cols) -> DataFrame:
    """C17: positions of the layout that a plate does not have. The layout's size is fixed by its arguments."""
    grid = wells.select(plate).distinct().select(plate, F.explode(F.array(*[F.lit(r) for r in rows])).alias(row))
    grid = grid.withColumn(col, F.explode(F.array(*[F.lit(c) for c in cols])))
    return grid.join(wells.select(plate, row, col), [plate, row, col], "left_anti")


def well_deviation(long: DataFrame, plate: str, well: str) -> DataFrame:
    """Per well the median over features of the distance from the plate's feature median."""
    near = long.join(exact_percentiles(long, [plate, "f"], "v", {"_mid": 0.5}), [plate, "f"])
    return near.groupBy(plate, well).agg(F.median(F.abs(F.col("v") - F.col("_mid"))).alias("deviation"))  # over a well's features


def well_deviation_packed(packed: DataFrame, plate: str, well: str, features: str = "features") -> DataFrame:
    """D32 on packed rows: they are dealt by plate once, meet their plate's medians as one array, and a well's distances are sorted as one list."""
    largest = largest_group(packed, [plate], plate)
    rows = packed.select(plate, well, F.col(features).alias("features")).filter(F.size("features") > 0).repartition(plate)
    mids = exact_percentiles(to_long(rows, [plate]), [plate, "f"], "v", {"_mid": 0.5}, largest=largest)
    mids = mids.groupBy(plate).agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "_mid"))), lambda x: x["_mid"]).alias("_mids"))
    near = rows.join(mids, plate).select(plate, well, F.zip_with("features", "_mids", lambda v, m: F.abs(v - m)).alias("_d"))
    own = near.groupBy(plate, well).agg(F.sort_array(F.filter(F.flatten(F.collect_list("_d")), lambda d: d.isNotNull())).alias("_d"))
    n = F.size("_d")
    low, high = (F.get("_d", i) for i in (F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")))
    return own.select(plate, well, F.when(low == high, low).otherwise(0.5 * low + 0.5 * high).alias("deviation"))


def plate_map(wells: DataFrame, row: str, col: str, value: str, cols) -> DataFrame:
    """One row per plate row, one column per plate column."""
    return wells.groupBy(row).pivot(col, list(cols)).agg(F.first(value))
