"""Embedding, clustering and enrichment."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise import scratch
from platewise.functions.vectors import hash_uniform
from platewise.operators.joins import overlap_counts
from platewise.operators.linkage import cut_tree, linkage_tree
from platewise.operators.greedy import distances
from platewise.operators.selection import distance

#: Silhouettes: rows and values of a block at most, values that a task holds a side, rows that are compared at once, and pairs that are subtracted at once.
BLOCK, VALUES, HELD, STRIPE, AGAIN = 2048, 1 << 20, 1 << 22, 256, 1 << 14
#: Pairs whose squared distance is below this share of their squared lengths lose digits in a matrix product.
NEAR = 1e-4


def standardised(df: DataFrame, vector: str, out: str = "scaled") -> tuple[DataFrame, object]:
    """Vectors with mean 0 and population spread 1 (Spark's scaler uses the sample spread, so it is rescaled)."""
    n = df.count()
    rows = df.withColumn("_raw", array_to_vector(vector))
    model = StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True, withStd=True).fit(rows)
    fix = math.sqrt(n / (n - 1)) if n > 1 else 1.0
    scaled = F.transform(vector_to_array("_scaled"), lambda x: x * fix)
    return model.transform(rows).withColumn(out, array_to_vector(scaled)).drop("_raw", "_scaled"), model


def pca(df: DataFrame, vector: str, k: int, whiten: bool = False) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Rows with ``pca``, the loadings (features x k) and explained shares; the largest loading of each component is positive."""
    rows, _ = standardised(df, vector)
    model = PCA(k=k, inputCol="scaled", outputCol="_pca").fit(rows)
    load, share = model.pc.toArray(), model.explainedVariance.toArray()
    sign = np.sign(load[np.abs(load).argmax(axis=0), np.arange(k)])
    load = load * sign
    factor = sign.copy()
    if whiten:
        spread = [r[0] for r in model.transform(rows).select(F.posexplode(vector_to_array("_pca")).alias("f", "v")).groupBy("f").agg(F.stddev_samp("v").alias("s"), F.first("f").alias("i")).orderBy("i").select("s").collect()]
        factor = sign / np.array(spread)
    scores = F.zip_with(vector_to_array("_pca"), F.array(*[F.lit(float(x)) for x in factor]), lambda x, s: x * s)
    return model.transform(rows).withColumn("pca", scores).drop("_pca", "scaled"), load, share


def pca_inverse(df: DataFrame, scores: str, load: np.ndarray, mean: np.ndarray, std: np.ndarray) -> DataFrame:
    """Back to feature space by one matrix product a batch."""
    shared = df.sparkSession.sparkContext.broadcast((load, mean, std))

    @F.pandas_udf("array<double>")
    def back(s: pd.Series) -> pd.Series:
        load, mean, std = shared.value
        return pd.Series(list(np.stack(s.to_numpy()) @ load.T * std + mean)) if len(s) else s

    return df.withColumn("restored", back(scores))


def kmeans(df: DataFrame, vector: str, k: int, seeds=(1, 2, 3)) -> tuple[DataFrame, list, float]:
    """The best of several starts on standardised vectors: rows with ``cluster``, centres, inertia."""
    rows, _ = standardised(df, vector)
    rows = rows.persist()
    try:
        models = [KMeans(k=k, seed=s, featuresCol="scaled", predictionCol="cluster").fit(rows) for s in seeds]
    finally:
        rows.unpersist()
    best = min(models, key=lambda m: m.summary.trainingCost)
    found, centres = best.transform(rows), best.clusterCenters()
    # the summary's cost is that of the centres before the last step
    one = df.sparkSession.createDataFrame([([[float(v) for v in c] for c in centres],)], "_c array<array<double>>")
    d = distance(vector_to_array("scaled"), F.get("_c", F.col("cluster")))
    inertia = found.crossJoin(F.broadcast(one)).agg(F.sum(d * d)).first()[0]  # one row
    return found.drop("scaled"), centres, inertia


def bisecting(df: DataFrame, vector: str, k: int, seed: int = 1) -> DataFrame:
    """I4: hierarchical clusters by repeated bisection."""
    rows, _ = standardised(df, vector)
    return BisectingKMeans(k=k, seed=seed, featuresCol="scaled", predictionCol="cluster").fit(rows).transform(rows).drop("scaled")


def single_linkage(df: DataFrame, key: str, vector: str, cut: float) -> DataFrame:
    """I4: clusters of single linkage cut at a distance, from the forest of edges within it; ``linkage`` has the whole tree and its other cuts."""
    return cut_tree(df, key, linkage_tree(df, key, vector, cut, grow=False), distance=cut)


def quality(df: DataFrame, vector: str, cluster: str = "cluster") -> DataFrame:
    """Exact Calinski-Harabasz and Davies-Bouldin indices from cluster sums."""
    long = df.select(cluster, F.posexplode(vector).alias("f", "v"))
    centres = long.groupBy(cluster, "f").agg(F.avg("v").alias("c"), F.count(F.lit(1)).alias("n"))
    whole = long.groupBy("f").agg(F.avg("v").alias("m"))
    between = centres.join(whole, "f").agg(F.sum(F.col("n") * (F.col("c") - F.col("m")) ** 2).alias("between"))
    packed = centres.groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "c"))), lambda x: x["c"]).alias("centre"), F.first("n").alias("n"))
    near = df.join(packed, cluster).withColumn("d", distance(F.col(vector), F.col("centre")))
    within = near.agg(F.sum(F.col("d") * F.col("d")).alias("within"), F.count(F.lit(1)).alias("rows"), F.count_distinct(cluster).alias("k"))
    s = near.groupBy(cluster).agg(F.avg("d").alias("s"), F.first("centre").alias("centre"))
    a, b = s.select(F.col(cluster).alias("i"), F.col("s").alias("si"), F.col("centre").alias("ci")), s.select(F.col(cluster).alias("j"), F.col("s").alias("sj"), F.col("centre").alias("cj"))
    db = a.join(b, F.col("i") != F.col("j")).groupBy("i").agg(F.max((F.col("si") + F.col("sj")) / distance(F.col("ci"), F.col("cj"))).alias("r")).agg(F.avg("r").alias("davies_bouldin"))
    ch = (F.col("between") / (F.col("k") - 1)) / (F.col("within") / (F.col("rows") - F.col("k")))
    return between.crossJoin(within).crossJoin(db).select(ch.alias("calinski_harabasz"), "davies_bouldin")


def silhouette(df: DataFrame, vector: str, cluster: str = "cluster", cosine: bool = False) -> float:
    """Spark's silhouette (squared Euclidean or cosine); ``silhouettes`` has the plain Euclidean one."""
    rows = df.withColumn("_v", array_to_vector(vector))
    return ClusteringEvaluator(featuresCol="_v", predictionCol=cluster, distanceMeasure="cosine" if cosine else "squaredEuclidean").evaluate(rows)


def _runs(codes: pa.Array, size: pa.Array, n: int):
    """Where the clusters of a block's first ``n`` rows begin, their codes and sizes, and whether the block holds a cluster's every row."""
    codes, size = codes.slice(0, n).to_numpy(), size.slice(0, n).to_numpy()
    starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return starts, codes[starts], size[starts], np.diff(np.append(starts, n)) == size[starts]


def _left(x: np.ndarray):
    """What ``_stripes`` takes of the rows ``x``: themselves, a place amid them, and from there a matrix and squared lengths."""
    middle = np.median(x, axis=0)
    z = x - middle
    zz = np.square(z).sum(axis=1)
    return x, middle, np.hstack([-2 * z, zz[:, None], np.ones((len(z), 1))]), zz


def _stripes(left, y: np.ndarray):
    """``at, distances`` of ``STRIPE`` rows to all of ``y``, as one matrix product. A pair that is near by its distance from the middle is subtracted, as the product loses its digits; so are all if values are not finite."""
    x, middle, left, xx = left
    z = y - middle
    yy = np.square(z).sum(axis=1)
    right = np.ascontiguousarray(np.hstack([z, np.ones((len(z), 1)), yy[:, None]]).T)
    limit = NEAR * (xx.max() + yy.max())
    held = np.empty((STRIPE, len(y)))  # new memory for each stripe would cost as much as the product
    for at in range(0, len(x), STRIPE):
        if not np.isfinite(limit):
            yield at, distances(x[at : at + STRIPE], y)
            continue
        part = left[at : at + STRIPE]
        d = np.matmul(part, right, out=held[: len(part)])
        if d.min() < limit:
            s, t = np.divmod(np.flatnonzero(d.reshape(-1) < limit), len(y))
            near = d[s, t] < NEAR * (xx[at + s] + yy[t])
            s, t = s[near], t[near]
            for i in range(0, len(s), AGAIN):
                u, v = s[i : i + AGAIN], t[i : i + AGAIN]
                d[u, v] = np.square(x[at + u] - y[v]).sum(axis=1)
        yield at, np.sqrt(d, out=d)


def _run_sums(left, starts: np.ndarray, y: np.ndarray, others: np.ndarray, back: bool):
    """Sums of distances of each row to each run of ``y``, and with ``back`` of each row of ``y`` to each run of rows."""
    n = len(left[0])
    rows, columns = np.empty((n, len(others))), np.zeros((len(starts), len(y)))
    for at, d in _stripes(left, y):
        rows[at : at + len(d)] = np.add.reduceat(d, others, axis=1) if len(others) > 1 else d.sum(axis=1, keepdims=True)
        if back:
            first, last = np.searchsorted(starts, [at, at + len(d) - 1], side="right")
            ends = [0, *(starts[first:last] - at), len(d)]
            for j in range(first - 1, last):
                columns[j] += d[ends[j - first + 1] : ends[j - first + 2]].sum(axis=0)
    return rows, columns.T


class _Sums:
    """What a task knows of a block's rows: the least mean distance to a cluster that one block holds, the total to the own one if the block holds it, and totals to clusters of many blocks."""

    def __init__(self, n: int):
        self.near, self.own, self.totals = np.full(n, np.nan), np.zeros(n), {}

    def add(self, sums: np.ndarray, codes: np.ndarray, sizes: np.ndarray, whole: np.ndarray, mine=None) -> None:
        """``mine``: each row's own run, if the block meets itself."""
        for j in np.flatnonzero(~whole):
            total = self.totals.setdefault(int(codes[j]), [int(sizes[j]), 0.0])
            total[1] = total[1] + sums[:, j]
        means = np.where(whole, sums, np.nan) / sizes
        if mine is not None:
            at = np.arange(len(sums))
            self.own += np.where(whole[mine], sums[at, mine], 0.0)
            means[at, mine] = np.nan
        self.near = np.fmin(self.near, np.fmin.reduce(means, axis=1))

    def batch(self, block: int) -> pa.RecordBatch:
        others = [(code, size, total.tobytes(), None) for code, (size, total) in self.totals.items()]
        codes, sizes, totals, near = zip((None, None, self.own.tobytes(), self.near.tobytes()), *others)
        columns = [pa.array([block] * len(codes), pa.int64()), pa.array(codes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(totals, pa.binary()), pa.array(near, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["id", "other", "size", "total", "near"])


def silhouettes(df: DataFrame, key: str, vector: str, cluster: str = "cluster") -> DataFrame:
    """``key, cluster, silhouette`` of every row by plain Euclidean distances; 0 for a row alone in its cluster, null if there is one cluster or no vector.

    Rows are packed in the order of clusters, ``BLOCK`` or so to a row, and written once. Each two blocks meet once, as matrices, in a task of a Cartesian product of files, so no
    pair is shuffled or written: of each row a task hands on the least mean over clusters that lie in one block, and a sum for each of the others. A task holds at
    most ``HELD`` values a side or so. The work is quadratic in the rows by definition, what is on disk is not.
    """
    rows = df.select(F.col(key).alias("k"), F.col(cluster).alias("own"), F.col(vector).cast("array<double>").alias("x"))
    sizes = rows.filter("own is not null").groupBy("own").agg(F.count(F.lit(1)).alias("size"), F.count("x").alias("known"), F.sum(F.greatest(F.size("x"), F.lit(64))).alias("values"))
    sizes = scratch.written(sizes.withColumn("code", F.monotonically_increasing_id()), "sizes")
    values, clusters = sizes.agg(F.sum("values"), F.count_if(F.col("known") > 0)).first()
    files = max(df.sparkSession.sparkContext.defaultParallelism, -(-(values or 0) // HELD))
    rows = rows.join(sizes.select("own", "size", "code"), "own", "left").select("k", "own", "size", "code", "x")
    rows = rows.repartitionByRange("code", F.xxhash64("k")).sortWithinPartitions("code")
    kinds = [df.schema[c].dataType.simpleString() for c in (key, cluster)]

    def pack(batches):
        at = TaskContext.get().partitionId() << 33
        for whole in batches:
            widest = pc.max(whole.column(4).value_lengths()).as_py() or 1
            step = max(1, min(BLOCK, VALUES // widest))
            for i in range(0, whole.num_rows, step):
                b = whole.slice(i, step)
                known = np.asarray(pc.and_(b.column(3).is_valid(), b.column(4).is_valid()))
                b = b.take(pa.array(np.argsort(~known, kind="stable")))
                x = b.column(4).slice(0, known.sum())
                if len(x.value_lengths().unique()) > 1:
                    raise ValueError("vectors differ in length")
                lists = [pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(c)) for c in range(4)]
                values = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([len(x)]), *lists, pa.array([values], pa.binary())], ["id", "n", "k", "own", "size", "code", "x"])
                at += 1

    blocks = rows.mapInArrow(pack, f"id long, n long, k array<{kinds[0]}>, own array<{kinds[1]}>, size array<long>, code array<long>, x binary")
    blocks = scratch.written(blocks.repartition(files), "blocks")
    one = blocks.filter("n > 0").select("id", "n", "code", "size", "x")
    two = one.withColumnsRenamed({c: f"{c}2" for c in one.columns}).hint("shuffle_replicate_nl")
    # of two blocks each comes first about as often, so that no task has all of its pairs
    turn = (F.col("id") < F.col("id2")) == (F.pmod(F.col("id") + F.col("id2"), F.lit(2)) == 0)
    pairs = one.join(two, (F.col("id") == F.col("id2")) | turn)

    def sums(batches):
        at, mine, theirs = None, None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                block, m, other, n = (batch.column(c)[i].as_py() for c in (0, 1, 5, 6))
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer()).reshape(rows, -1) for c, rows in ((4, m), (9, n)))
                codes, size, codes2, size2 = (batch.column(c)[i].values for c in (2, 3, 7, 8))
                if block != at and mine is not None:  # pairs of a block follow one another
                    yield mine.batch(at)
                with np.errstate(all="ignore"):
                    if block != at:
                        at, mine, left, runs = block, _Sums(m), _left(x), _runs(codes, size, m)
                    runs2 = runs if other == block else _runs(codes2, size2, n)
                    to, back = _run_sums(left, runs[0], y, runs2[0], other != block)
                    if other == block:
                        mine.add(to, *runs[1:], np.repeat(np.arange(len(runs[0])), np.diff(np.append(runs[0], m))))
                    else:
                        mine.add(to, *runs2[1:])
                        theirs.setdefault(other, _Sums(n)).add(back, *runs[1:])
        if mine is not None:
            yield mine.batch(at)
        for other, found in theirs.items():
            yield found.batch(other)

    def finish(sums, block):
        k, own, size, codes = (block[c].combine_chunks()[0].values for c in ("k", "own", "size", "code"))
        n = block["n"][0].as_py()
        found, codes = _Sums(n), codes.slice(0, n).to_numpy()
        for other, count, total, near in zip(*(sums[c].to_pylist() for c in ("other", "size", "total", "near"))):
            total = np.frombuffer(total)
            if near is not None:
                found.own += total
                found.near = np.fmin(found.near, np.frombuffer(near))
            else:
                whole = found.totals.setdefault(other, [count, 0.0])
                whole[1] = whole[1] + total
        for other, (count, total) in found.totals.items():
            mine = codes == other
            found.own += np.where(mine, total, 0.0)
            found.near = np.fmin(found.near, np.where(mine, np.nan, total / count))
        count = size.fill_null(0).to_numpy()
        value, known = np.zeros(len(k)), count == 1
        with np.errstate(all="ignore"):
            a = found.own / (count[:n] - 1)
            value[:n] = np.where(known[:n], 0.0, (found.near - a) / np.maximum(a, found.near))
        known[:n] |= clusters > 1
        return pa.table([k, own, pa.array(value, mask=~known)], names=[key, cluster, "silhouette"])

    parts = pairs.mapInArrow(sums, "id long, other long, size long, total binary, near binary")
    return parts.groupBy("id").cogroup(blocks.drop("x").groupBy("id")).applyInArrow(finish, f"`{key}` {kinds[0]}, `{cluster}` {kinds[1]}, silhouette double")


def choose_k(df: DataFrame, vector: str, ks, criterion: str = "calinski") -> int:
    """The best number of clusters by Calinski-Harabasz, silhouette or the elbow of the inertia."""
    scored = []
    for k in ks:
        rows, _, inertia = kmeans(df, vector, k)
        if criterion == "calinski":
            scored.append(quality(rows, vector).first()[0])
        elif criterion == "silhouette":
            scored.append(silhouette(rows, vector))
        else:
            scored.append(inertia)
    if criterion == "elbow":  # the largest second difference
        bend = np.diff(scored, 2)
        return list(ks)[int(bend.argmax()) + 1] if len(bend) else list(ks)[0]
    return list(ks)[int(np.nanargmax(scored))]


def cluster_profiles(df: DataFrame, vector: str, cluster: str = "cluster") -> DataFrame:
    """Size and mean profile of each cluster, long."""
    return df.select(cluster, F.posexplode(vector).alias("f", "v")).groupBy(cluster, "f").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"))


def fisher(a, b, c, d):
    """Two-sided Fisher exact test of 2x2 tables as a vectorised function; an invalid table has p = 1 and odds 1."""

    @F.pandas_udf("odds double, p double")
    def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
        lg = np.vectorize(math.lgamma)

        def one(a, b, c, d):
            if min(a, b, c, d) < 0:
                return 1.0, 1.0
            row, col, n = a + b, a + c, a + b + c + d
            k = np.arange(max(0, row + col - n), min(row, col) + 1)
            choose = lambda n, k: lg(n + 1.0) - lg(k + 1.0) - lg(n - k + 1.0)
            logp = choose(float(col), k) + choose(float(n - col), row - k) - choose(float(n), float(row))
            mine = logp[int(a) - k[0]]
            odds = math.inf if b * c == 0 and a * d > 0 else (a * d / (b * c) if b * c else math.nan)
            return odds, float(min(1.0, np.exp(logp[logp <= mine + 1e-7]).sum()))

        return pd.DataFrame([one(*map(int, t)) for t in zip(a, b, c, d)], columns=["odds", "p"])

    return run(a, b, c, d)


def enrichment(members: DataFrame, annotations: DataFrame, key: str, cluster: str, label: str) -> DataFrame:
    """I8: per cluster and label the table, odds ratio, p value and expected count."""
    n = members.agg(F.count(F.lit(1)).alias("background"))
    sizes = members.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"))
    known = members.select(key).join(annotations, key)
    labels = known.groupBy(label).agg(F.count(F.lit(1)).alias("annotated"))
    rows = overlap_counts(members, annotations, key, cluster, label).join(sizes, cluster).join(labels, label).crossJoin(F.broadcast(n))
    a, size, ann, bg = (F.col(c) for c in ("n", "size", "annotated", "background"))
    test = fisher(a, size - a, ann - a, bg - size - (ann - a))
    return rows.withColumn("expected", size * ann / bg).withColumn("test", test).select(cluster, label, "n", "size", "annotated", "expected", "test.odds", "test.p")


def ridge(df: DataFrame, x: str, y: str, penalty: float = 1.0, members: int = 0, key: str | None = None, seed: int = 0):
    """Linear map from embedding to phenotype by normal equations, and bootstrap members by Poisson weights.

    Each batch adds its products; the driver solves one system of the embedding's width for each member. Rows without either vector are left out.
    """

    def products(batches):
        sums: dict[int, list] = {}
        for pdf in batches:
            if not len(pdf):
                continue
            a = np.column_stack([np.ones(len(pdf)), np.stack(pdf["x"].to_numpy())])
            b = np.stack(pdf["y"].to_numpy())
            for m in range(members + 1):
                w = np.ones(len(pdf)) if m == 0 else np.stack(pdf["w"].to_numpy())[:, m - 1]
                s = sums.setdefault(m, [0.0, 0.0])
                s[0], s[1] = s[0] + (a * w[:, None]).T @ a, s[1] + (a * w[:, None]).T @ b
        if sums:  # a task may have no rows
            yield pd.DataFrame({"m": list(sums), "xx": [s[0].ravel().tolist() for s in sums.values()], "xy": [s[1].ravel().tolist() for s in sums.values()]})

    def poisson(m):  # of mean 1, by inverting its distribution on a seeded hash
        u, steps, p = hash_uniform(F.col(key), F.lit(seed), F.lit(m)), F.lit(0), 0.0
        for k in range(8):
            p += math.exp(-1) / math.factorial(k)
            steps = steps + (u >= p).cast("int")
        return steps.cast("double")

    w = F.array(*[poisson(m) for m in range(members)]) if members else F.array().cast("array<double>")
    known = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    rows = known.select(F.col(x).alias("x"), F.col(y).alias("y"), w.alias("w")).mapInPandas(products, "m int, xx array<double>, xy array<double>")
    long = rows.select("m", F.posexplode("xx").alias("i", "v"), F.lit(0).alias("which")).unionByName(rows.select("m", F.posexplode("xy").alias("i", "v"), F.lit(1).alias("which")))
    got = long.groupBy("m", "which", "i").agg(F.sum("v").alias("v")).toPandas()
    if not len(got):
        raise ValueError("no rows to fit")
    out = []
    for m in range(members + 1):
        part = got[got.m == m].sort_values("i")
        xx = part[part.which == 0].v.to_numpy()
        p = math.isqrt(len(xx))
        xy = part[part.which == 1].v.to_numpy().reshape(p, -1)
        reg = penalty * np.eye(p)
        reg[0, 0] = 0.0
        out.append(np.linalg.solve(xx.reshape(p, p) + reg, xy))
    return out


def ridge_predict(df: DataFrame, key: str, x: str, coefficients) -> DataFrame:
    """Predictions of all members, long: ``key, member, f, value``. Rows without a vector are left out."""
    shared = df.sparkSession.sparkContext.broadcast(coefficients)

    def run(batches):
        for pdf in batches:
            a = np.column_stack([np.ones(len(pdf)), np.stack(pdf["x"].to_numpy())]) if len(pdf) else np.zeros((0, 1))
            for m, c in enumerate(shared.value):
                if len(pdf):
                    yield pd.DataFrame({key: pdf[key], "member": m, "p": list(a @ c)})

    kind = df.schema[key].dataType.simpleString()
    return df.filter(F.col(x).isNotNull()).select(key, F.col(x).alias("x")).mapInPandas(run, f"{key} {kind}, member int, p array<double>").select(key, "member", F.posexplode("p").alias("f", "value"))
