"""Whole jobs: curation, cell-level processing, embedding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise import scratch
from platewise.functions.sequence import GROUPS, descriptors
from platewise.functions.vectors import l2_normalise
from platewise.operators import aggregates, joins, normalise, quality, selection
from platewise.operators.order import MOST, largest_group, median_and_count
from platewise.schema import cell_feature_columns, feature_columns, from_long, pack, to_long
from platewise.sources import readers


def curate(
    wells: DataFrame,
    key: str,
    batch: str,
    treatment: str,
    features,
    count: str | None = None,
    method: str = "robust",
    clip: float | None = 5.0,
    correction: str = "center",
    variance: float = 1e-6,
    least: int = 1,
    how: str = "median",
    correlation: float = 1.0,
    most: int | None = None,
    report: list[tuple[str, int, int]] | None = None,
    stored: bool = False,
) -> tuple[DataFrame, list[str]]:
    """I32: QC, fill, feature selection, normalisation, batch correction, replicate aggregation, choice of treatments.

    ``wells`` is wide, with unique ``key``. Returns treatments (``features``, ``n_replicates``) and the features kept. Steps are added to ``report`` (D28) as name,
    rows and features, counted while their rows are written. Unless ``wells`` are a ``stored`` table, they are written first, as quality reads them twice.
    """
    report = [] if report is None else report
    keep = [key, batch, treatment, *([count] if count else [])]
    packed = pack(wells, features, keep)
    packed = packed if stored else scratch.written(packed, "packed")
    good = quality.flag_wells(packed, count).filter("qc_passed").select(key, batch, treatment, quality.fill_missing(F.col("features")).alias("features"))
    good, seen = aggregates.observed(good, "good")
    good = scratch.written(good, "good")  # five steps read it
    rows = seen.get["rows"]
    report.append(("quality", rows, len(features)))
    stats = scratch.written(normalise.feature_statistics(to_long(good, [key])), "features")
    removed = {r.f for r in normalise.removals(stats, 1, variance=variance).collect()}
    if correlation < 1:
        kept = [i for i in range(len(features)) if i not in removed]
        known = stats.collect()  # a row a feature
        variances = {r.f: r.var_pop for r in known if r.f in kept}
        means = {r.f: r.mean for r in known if r.mean is not None}
        pairs = [(r.a, r.b, r.r) for r in normalise.packed_correlations(good, means=means).collect() if r.a in variances and r.b in variances]
        removed |= set(normalise.correlation_filter(variances, pairs, correlation))
    kept = [i for i in range(len(features)) if i not in removed]
    report.append(("features", rows, len(kept)))
    chosen = good.withColumn("features", F.array(*[F.col("features")[i] for i in kept]))
    scaled = scratch.written(normalise.normalise(chosen, method, clip=clip, largest=rows), "scaled")
    fixed = normalise.correct_packed(scaled, batch, correction).dropna(subset=[treatment]).select(treatment, "features")
    if how == "median":
        largest = largest_group(good, [treatment], treatment)
        # small groups meet as packed rows, before they become a row a feature; large ones are scanned twice
        fixed = fixed.repartition(treatment) if largest <= MOST else scratch.written(fixed, "corrected")
        per = median_and_count(to_long(fixed, [treatment]), [treatment, "f"], "v", "v", "n_replicates", largest)
    else:
        long = to_long(fixed, [treatment])
        per = long.groupBy(treatment, "f").agg(aggregates.HOW[how]("v").alias("v"), F.count(F.lit(1)).alias("n_replicates"))
    out = from_long(per.filter(F.col("n_replicates") >= least), [treatment, "n_replicates"])
    if most:
        out = out.orderBy(F.col("n_replicates").desc(), treatment).limit(most)
    out, seen = aggregates.observed(out, "treatments")
    out = scratch.written(out, "treatments")
    report.append(("treatments", seen.get["rows"], len(kept)))
    return out, [features[i] for i in kept]


def training_set(spark: SparkSession, plates, metadata, key: str, batch: str, treatment: str, count: str | None = None, sample: int | None = None, most_plates: int | None = None, **options):
    """I32, D28 from files: loads plates (A3, F5), adds metadata (C1, C2; ``metadata`` as for ``joins.enrich``), curates, and samples ``sample`` treatments that cover the
    profiles (I9). ``options`` go to ``curate``.

    Returns the treatments (with ``rank`` of choice if sampled), the features kept, the plates that could not be read, and the report: ``step, name, rows, features``.
    Rows that are loaded and joined are written once, and counted by that.
    """
    raw, skipped = readers.load_plates(spark, plates, most=most_plates)
    names = feature_columns(raw.columns)
    raw, loaded = aggregates.observed(raw, "loaded")
    merged, seen = aggregates.observed(joins.enrich(raw, metadata), "merged")
    merged = scratch.written(merged, "wells")
    report = [("loaded", loaded.get["rows"], len(names)), ("merged", seen.get["rows"], len(names))]
    out, kept = curate(merged, key, batch, treatment, names, count, report=report, stored=True, **options)
    if sample:
        picks = selection.farthest_points(out, treatment, "features", sample)
        out = scratch.written(out.join(picks, treatment), "sampled")
        report.append(("sampled", out.count(), len(kept)))
    steps = spark.createDataFrame([(i, *r) for i, r in enumerate(report, 1)], "step int, name string, rows long, features int")
    return out, kept, skipped, steps


def process_cells(cells: DataFrame, keys, nulls: float = 0.05, variance: float = 1e-6, correlation: float = 1.0, how: str = "median", least: int = 0, ordinal: str | None = None) -> DataFrame:
    """Resolve features, filter them, aggregate cells to wells, flag by cell count."""
    names = cell_feature_columns(cells.columns)
    ordinal = ordinal or keys[0]
    long = to_long(pack(cells, names, [ordinal]), [ordinal])
    stats = normalise.feature_statistics(long)
    gone = {r.f for r in normalise.removals(stats, 2, nulls, variance).collect()}
    if correlation < 1:
        left = [i for i in range(len(names)) if i not in gone]
        pairs = [(r.a, r.b, r.r) for r in normalise.packed_correlations(pack(cells, names, [])).collect() if r.a in left and r.b in left]
        gone |= set(normalise.correlation_filter({i: 0.0 for i in left}, pairs, correlation, 2))
    kept = [n for i, n in enumerate(names) if i not in gone]
    wells = aggregates.cells_to_wells(cells, keys, kept, how)
    return wells.withColumn("qc_passed", quality.cell_count_passed(F.col("cell_count"), least))


def embed(proteins: DataFrame, key: str, seq: str, vectors: DataFrame | None = None, groups=GROUPS) -> DataFrame:
    """Descriptors of each sequence, fused with precomputed vectors (``key, vector``) where given."""
    own = descriptors(proteins, key, seq, groups)
    if vectors is None:
        return own.select(key, l2_normalise(F.col("features")).alias("fused"))
    both = own.join(vectors, key)
    return both.select(key, l2_normalise(F.concat(l2_normalise(F.col("vector")), l2_normalise(F.col("features")))).alias("fused"))
