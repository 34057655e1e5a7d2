"""Choosing what to measure next.

Greedy selectors make many picks a scan (``greedy``); only ``kmeans_pp``, whose draws don't fall, takes a job a pick.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewise import scratch
from platewise.functions import vectors as V
from platewise.operators import greedy
from platewise.operators.joins import unmatched
from platewise.operators.order import rank  # noqa: F401


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two vectors."""
    return F.sqrt(V.total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


BLOCK = 256


def _blocks(df: DataFrame, key: str, vector: str, by=()) -> DataFrame:
    """Rows packed ``BLOCK`` or so to a row (``_block``, ``rows``), dealt by a hash of the key; within ``by``."""
    sizes = df.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("_m"))
    rows = df.join(sizes, list(by)) if by else df.crossJoin(F.broadcast(sizes))  # without keys it is one row
    rows = rows.withColumn("_block", F.pmod(F.xxhash64(key), F.col("_m")))
    return rows.groupBy(*by, "_block").agg(F.collect_list(F.struct(F.col(key).alias("k"), F.col(vector).alias("x"))).alias("rows"))


def _rectangles(x: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Vectors by length: their places and a matrix of them. Vectors that are null or hold a null are left out."""
    width = np.asarray(x.value_lengths().fill_null(-1))
    start = np.cumsum(np.maximum(width, 0)) - np.maximum(width, 0)
    flat = x.flatten()
    if flat.null_count:
        width = width.copy()
        width[np.unique(np.repeat(np.arange(len(x)), np.maximum(width, 0))[np.asarray(flat.is_null())])] = -1
    values = flat.to_numpy(zero_copy_only=False)
    places = {int(w): np.flatnonzero(width == w) for w in np.unique(width) if w >= 0}
    return {w: (at, values[start[at][:, None] + np.arange(w)]) for w, at in places.items()}


def _pair_matrix(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Distances of the rows of ``x`` to those of ``y``, added up feature by feature as ``distance`` does, so near rows lose no digits."""
    out = np.zeros((len(x), len(y)))
    columns = np.ascontiguousarray(y.T)
    for at in range(0, len(x), 64):  # a stripe that stays in the cache
        part = out[at : at + 64]
        step = np.empty_like(part)
        for f in range(x.shape[1]):
            if metric == "euclidean":
                np.subtract(x[at : at + 64, f, None], columns[f], out=step)
                np.multiply(step, step, out=step)
            else:
                np.multiply(x[at : at + 64, f, None], columns[f], out=step)
            part += step
    if metric == "euclidean":
        return np.sqrt(out, out=out)
    norms = [np.sqrt(np.square(z).sum(axis=1)) for z in (x, y)]
    return 1 - out / (norms[0][:, None] * norms[1])


def pairwise(df: DataFrame, key: str, vector: str, metric: str = "euclidean", queries: Column | None = None) -> DataFrame:
    """C14: ``a, b, distance`` of each row ``a`` that ``queries`` accepts (all by default) to every other row ``b``; null where a vector is missing or the lengths differ.

    Rows and queries are packed into blocks, written once, and blocks meet blocks as matrices in the tasks of a Cartesian product, so no pair is shuffled. The result
    has as many rows as queries times rows.
    """
    files = 4 * df.sparkSession.sparkContext.defaultParallelism
    df = df.withColumn(vector, F.col(vector).cast("array<double>")).filter(F.col(key).isNotNull())
    asked = scratch.written(_blocks(df.filter(queries) if queries is not None else df, key, vector).select("rows"), "queries")
    rows = scratch.written(_blocks(df, key, vector).select("rows").repartition(files), "blocks")
    kind = df.schema[key].dataType.simpleString()

    def pairs(batches):
        for batch in batches:
            for mine, others in zip(batch.column(0), batch.column(1)):
                (k, x), (m, y) = ((part.values.field("k"), part.values.field("x")) for part in (mine, others))
                d, known = np.zeros((len(k), len(m))), np.zeros((len(k), len(m)), dtype=bool)
                x, y = _rectangles(x), _rectangles(y)
                with np.errstate(divide="ignore", invalid="ignore"):
                    for w in x.keys() & y.keys():
                        at = np.ix_(x[w][0], y[w][0])
                        d[at], known[at] = _pair_matrix(x[w][1], y[w][1], metric), True
                codes = pa.concat_arrays([k, m]).dictionary_encode().indices.to_numpy()
                s, t = np.nonzero(codes[: len(k), None] != codes[None, len(k) :])
                values = pa.array(d[s, t]) if known.all() else pa.array(d[s, t], mask=~known[s, t])
                yield pa.RecordBatch.from_arrays([k.take(pa.array(s)), m.take(pa.array(t)), values], ["a", "b", "distance"])

    both = asked.select(F.col("rows").alias("q")).crossJoin(rows)
    return both.mapInArrow(pairs, f"a {kind}, b {kind}, distance double")


def mean_distance(df: DataFrame, key: str, vector: str, by: str) -> DataFrame:
    """``by, distance``: mean Euclidean distance over all pairs of rows of a group. Blocks are written once and meet as matrices in the tasks of a
    Cartesian product, so no pair is shuffled, and only their sums go on; the work is quadratic in a group by definition."""
    files = 4 * df.sparkSession.sparkContext.defaultParallelism
    blocks = _blocks(df, key, vector, [by]).select(by, "_block", F.transform("rows", lambda r: r["x"]).alias("x"))
    blocks = scratch.written(blocks.repartition(files), "blocks")
    a, b = (blocks.select(F.col(by).alias(f"_by_{n}"), F.col("_block").alias(f"_{n}"), F.col("x").alias(n)) for n in "ab")
    both = a.join(b.hint("shuffle_replicate_nl"), F.col("_by_a").eqNullSafe(F.col("_by_b")) & (F.col("_a") <= F.col("_b")))
    both = both.select(F.col("_by_a").alias(by), (F.col("_a") == F.col("_b")).alias("same"), "a", "b")
    kind = df.schema[by].dataType.simpleString()

    def sums(batches):
        for pdf in batches:
            total, n = [], []
            for same, a, b in zip(pdf["same"], pdf["a"], pdf["b"]):
                a, b = np.stack(a), np.stack(b)
                square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T
                d = np.sqrt(np.maximum(square, 0.0))
                total.append(d[np.triu_indices(len(a), 1)].sum() if same else d.sum())
                n.append(len(a) * (len(a) - 1) // 2 if same else len(a) * len(b))
            yield pd.DataFrame({by: pdf[by], "total": total, "n": n})

    per = both.mapInPandas(sums, f"`{by}` {kind}, total double, n long").groupBy(by).agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    return per.filter("n > 0").select(by, (F.col("total") / F.col("n")).alias("distance"))


def replicate_similarity(df: DataFrame, key: str, label: str, vector: str) -> DataFrame:
    """Mean cosine over pairs of one label, from sums alone: (|sum of z|^2 - n) / (n (n - 1))."""
    unit = df.select(label, F.posexplode(V.l2_normalise(F.col(vector), 0.0)).alias("f", "z"))
    sums = unit.groupBy(label, "f").agg(F.sum("z").alias("s"), F.count(F.lit(1)).alias("n"))
    per = sums.groupBy(label).agg(F.sum(F.col("s") * F.col("s")).alias("q"), F.first("n").alias("n")).filter("n > 1")
    return per.select(label, "n", ((F.col("q") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("similarity"))


def aggregate_members(long: DataFrame, keys=("sample", "f")) -> DataFrame:
    """Mean and population spread over members or passes; fewer than two members are an error."""
    out = long.groupBy(*keys).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count(F.lit(1)).alias("_n"))
    return out.withColumn("std", F.when(F.col("_n") < 2, F.raise_error(F.lit("fewer than two members")).cast("double")).otherwise(F.col("std"))).drop("_n")


def heteroscedastic(long: DataFrame, keys=("sample", "f")) -> DataFrame:
    """Epistemic spread of means, aleatoric from mean log-variance, and both together."""
    out = long.groupBy(*keys).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("epistemic"), F.sqrt(F.exp(F.avg("log_variance"))).alias("aleatoric"))
    return out.withColumn("total", V.total_uncertainty(F.col("epistemic"), F.col("aleatoric")))


def reduce_uncertainty(per: DataFrame, how: str = "mean", value: str = "std") -> DataFrame:
    """H34 over the long form: one number per sample."""
    f = {"mean": F.avg, "sum": F.sum, "max": F.max}[how]
    return per.groupBy("sample").agg(f(value).alias("uncertainty"))


def scores(df: DataFrame, kind, mean: str = "mean", std: str = "std", best: float | None = None, seed: int = 0, key: str = "sample") -> DataFrame:
    """Acquisition score: uncertainty, ei, pi or random, or a user's function of the mean, spread and key columns."""
    if callable(kind):
        s = kind(F.col(mean), F.col(std), F.col(key))
    elif kind == "uncertainty":
        s = F.col(std)
    elif kind == "random":
        s = V.hash_uniform(F.col(key), F.lit(seed))
    else:
        if best is None:
            top = df.agg(F.max(mean).alias("_best"))
            df, goal = df.crossJoin(F.broadcast(top)), F.col("_best")
        else:
            goal = F.lit(float(best))
        f = V.expected_improvement if kind == "ei" else V.probability_of_improvement
        s = f(F.col(mean), F.col(std), goal)
    return df.withColumn("score", s).drop("_best")


def min_max(df: DataFrame, column: str, out: str) -> DataFrame:
    """Scaled to [0, 1] over all rows."""
    span = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    return df.crossJoin(F.broadcast(span)).withColumn(out, (F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-8)).drop("_lo", "_hi")


def _literal(v) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def _pick(state: DataFrame, key: str, by: Column, vector: str):
    """The candidate with the largest value, the smaller key on a tie."""
    return state.orderBy(by.desc_nulls_last(), key).select(key, vector).first()


def _loop(df: DataFrame, key: str, vector: str, n: int, first, next_score, every: int = 20, update=None):
    """Shared greedy loop: returns keys in order of choice."""
    state = df.select(key, vector, *[c for c in df.columns if c not in (key, vector)]).withColumn("_d", F.lit(float("inf")))
    chosen = []
    pick = first(state)
    while pick is not None:
        chosen.append(pick[0])
        if len(chosen) >= n:
            break
        d = distance(F.col(vector), _literal(pick[1]))
        state = state.filter(F.col(key) != F.lit(pick[0])).withColumn("_d", F.least("_d", d) if update is None else update(F.col("_d"), d))
        if len(chosen) % every == 0:
            state = state.checkpoint()
        pick = _pick(state, key, next_score(state), vector)
    return df.sparkSession.createDataFrame([(i + 1, k) for i, k in enumerate(chosen)], f"rank int, {key} {df.schema[key].dataType.simpleString()}")


def _ranked(df: DataFrame, key: str, chosen: list) -> DataFrame:
    return df.sparkSession.createDataFrame([(i + 1, k) for i, k in enumerate(chosen)], f"rank int, {key} {df.schema[key].dataType.simpleString()}")


def _start(rows: DataFrame, by: Column):
    """Key and vector of the candidate with the largest value, the smaller key on a tie."""
    return rows.orderBy(by.desc_nulls_last(), "key").select("key", "x").first()


def farthest_points(df: DataFrame, key: str, vector: str, n: int) -> DataFrame:
    """Start nearest to the centroid, then always the point farthest from those chosen. Rows without key or vector are left out."""
    rows = greedy.candidates(df, key, vector)
    long = rows.select(F.posexplode("x").alias("f", "v")).groupBy("f").agg(F.avg("v").alias("m"))
    centre = [r.m for r in long.orderBy("f").collect()]  # a row a feature
    first = _start(rows, -distance(F.col("x"), _literal(centre))) if centre else None
    return _ranked(df, key, greedy.lazy_greedy(rows, greedy.Farthest(), n, first) if first else [])


def max_min(df: DataFrame, key: str, vector: str, n: int, seed: int) -> DataFrame:
    """As I9 from a seeded random start."""
    rows = greedy.candidates(df, key, vector)
    first = _start(rows, -V.hash_uniform(F.col("key"), F.lit(seed)))
    return _ranked(df, key, greedy.lazy_greedy(rows, greedy.Farthest(), n, first) if first else [])


def kmeans_pp(df: DataFrame, key: str, vector: str, n: int, seed: int) -> DataFrame:
    """Each pick with probability proportional to the squared distance, by exponential races on seeded hashes."""
    step = iter(range(1, n + 1))

    def race(_):
        u = 1.0 - V.hash_uniform(F.col(key), F.lit(seed), F.lit(next(step)))
        return F.log(u) / (F.col("_d") * F.col("_d") + 1e-300)

    return _loop(df, key, vector, n, lambda s: _pick(s, key, -V.hash_uniform(F.col(key), F.lit(seed)), vector), race)


def _nearest(rows: DataFrame, chosen: list) -> DataFrame:
    """``key, x, d, near``: the distance of each candidate to the nearest of ``chosen`` (key, vector), and that one's place."""
    shared = rows.sparkSession.sparkContext.broadcast(np.array([v for _, v in chosen], dtype=np.float64))

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                d = greedy.distances(greedy._matrix(part.column(1)), shared.value)
                near = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(d[np.arange(len(d)), near]), pa.array(near, pa.int32())], ["key", "x", "d", "near"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.select("key", "x").mapInArrow(run, f"key {kind}, x array<double>, d double, near int")


def kmeans_parallel(df: DataFrame, key: str, vector: str, k: int, seed: int, rounds: int = 5, times: float = 2.0) -> DataFrame:
    """I10 for many rows: k-means|| (Bahmani et al., 2012). From a seeded start each round draws every row with probability ``times * k * d^2 / sum of d^2``; rows
    are then counted to the nearest drawn one, and ``k`` of the drawn are picked like ``kmeans_pp`` with their counts as weights.

    About ``rounds * times * k`` rows come to the driver. Draws are hashes of the key, so runs agree. Rows without key or vector are left out.
    """
    rows = greedy.candidates(df, key, vector)
    first = _start(rows, -V.hash_uniform(F.col("key"), F.lit(seed)))
    chosen = [tuple(first)] if first else []
    for r in range(1, rounds + 1) if chosen else ():
        near = _nearest(rows, chosen)
        cost = near.agg(F.sum(F.col("d") * F.col("d"))).first()[0]
        if not cost:
            break
        drawn = near.filter(V.hash_uniform(F.col("key"), F.lit(seed), F.lit(r)) < F.lit(times * k / cost) * F.col("d") * F.col("d"))
        chosen += sorted(map(tuple, drawn.select("key", "x").collect()))
    if not chosen:
        return _ranked(df, key, [])
    weight = {r.near: r["count"] for r in _nearest(rows, chosen).groupBy("near").count().collect()}  # a row a drawn one
    drawn = [(c, [float(v) for v in x], float(weight.get(i, 0))) for i, (c, x) in enumerate(chosen)]
    pool = df.sparkSession.createDataFrame(drawn, f"{key} {df.schema[key].dataType.simpleString()}, x array<double>, w double")
    step = iter(range(k))

    def race(_):
        u = 1.0 - V.hash_uniform(F.col(key), F.lit(seed), F.lit(next(step)), F.lit("pick"))
        return F.log(u) / (F.col("w") * F.least(F.col("_d") * F.col("_d"), F.lit(1e300)) + 1e-300)

    return _loop(pool, key, "x", min(k, len(drawn)), lambda s: _pick(s.withColumn("_d", F.lit(1.0)), key, race(s), "x"), race)


def hybrid(df: DataFrame, key: str, vector: str, uncertainty: str, n: int, weight: float = 0.7) -> DataFrame:
    """Weighted sum of scaled uncertainty and scaled distance to what is chosen; the first is the most uncertain. Rows without key or vector are left out."""
    rows = greedy.candidates(min_max(df, uncertainty, "_u"), key, vector, "_u")
    first = _start(rows, F.col("score"))
    return _ranked(df, key, greedy.lazy_hybrid(rows, n, first, weight) if first else [])


def batch_greedy(df: DataFrame, key: str, vector: str, score: str, n: int) -> DataFrame:
    """After each pick the scores of its surroundings shrink by 1 - exp(-d) / 2. Rows without key, vector or score are left out."""
    rows = greedy.candidates(df.filter(F.col(score).isNotNull()), key, vector, score)
    first = _start(rows, F.col("score"))
    return _ranked(df, key, greedy.lazy_greedy(rows, greedy.Shrinking(), n, first) if first else [])


def dpp(df: DataFrame, key: str, vector: str, n: int, gamma: float = 1.0) -> DataFrame:
    """Greedy maximum of the log-determinant of an RBF kernel by Cholesky columns (Chen et al., 2018), from the smallest key. Rows without key or vector are left out."""
    rows = greedy.candidates(df, key, vector)
    first = _start(rows, F.lit(0.0))
    return _ranked(df, key, greedy.lazy_greedy(rows, greedy.Determinant(gamma), n, first) if first else [])


def stochastic(df: DataFrame, key: str, score: str, n: int, seed: int, temperature: float = 1.0) -> DataFrame:
    """I16: without replacement, proportional to softmax, in one pass by Gumbel-perturbed scores."""
    gumbel = -F.log(-F.log(F.greatest(V.hash_uniform(F.col(key), F.lit(seed)), F.lit(1e-12))))
    return df.withColumn("_g", F.col(score) / temperature + gumbel).orderBy(F.col("_g").desc(), key).limit(n).drop("_g")


def select_next(pool: DataFrame, key: str, score: str, n: int, tested: DataFrame | None = None, round_: int = 1) -> DataFrame:
    """Exclude what is tested, then the n best, ranked and marked with the round."""
    rows = unmatched(pool, tested, key) if tested is not None else pool
    best = rows.orderBy(F.col(score).desc(), key).limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col(score).desc(), key))).withColumn("round", F.lit(round_))


def selection_summary(selections: DataFrame, score: str) -> DataFrame:
    """Rounds, picks and score statistics over the selections table."""
    return selections.groupBy("round").agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean"), F.min(score).alias("lowest"), F.max(score).alias("highest"))


def next_round(labelled: DataFrame, pool: DataFrame, selected: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Labelled and selected together, and the pool without the selected."""
    chosen = selected.select(key)
    return labelled.unionByName(pool.join(chosen, key, "left_semi")), unmatched(pool, chosen, key)


def strategy_report(selected: DataFrame, strategy: str, key: str, vector: str, uncertainty: str, cluster: str) -> DataFrame:
    """Per strategy mean and spread of uncertainty, clusters covered and mean pairwise distance of its picks."""
    per = selected.groupBy(strategy).agg(F.avg(uncertainty).alias("mean"), F.stddev_pop(uncertainty).alias("std"), F.count_distinct(cluster).alias("clusters"))
    return per.join(mean_distance(selected, key, vector, strategy), strategy, "left")


def label_with(ids: DataFrame, oracle, key: str) -> DataFrame:
    """K5: labels for a table of ids from a user's function of DataFrames; ids that it leaves out are dropped, and extra ones too."""
    return oracle(ids.select(key)).join(ids.select(key), key, "left_semi")


def active_round(labelled: DataFrame, pool: DataFrame, key: str, score: str, n: int, oracle, round_: int = 1) -> tuple[DataFrame, DataFrame]:
    """The n best of the pool are labelled by the oracle and move over; ``labelled`` has the key and the oracle's columns."""
    chosen = select_next(pool, key, score, n, round_=round_)
    found = label_with(chosen, oracle, key)
    return labelled.unionByName(found.select(*labelled.columns)), unmatched(pool, found, key)
