"""Array functions: norms, fusion, padding, uncertainty reduction, acquisition scores, codes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def norm(v: Column) -> Column:
    """L2 norm, nulls as 0."""
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + F.coalesce(x * x, F.lit(0.0))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once; inside a lambda it would be worked out for every element."""
    return F.transform(F.array(value), body)[0]


def l2_normalise(v: Column, eps: float = 1e-8) -> Column:
    """H30."""
    return let(v, lambda u: let(norm(u) + eps, lambda n: F.transform(u, lambda x: x / n)))


def fuse_concat(kinds: Column, names, normalise_inputs: bool = True, normalise_output: bool = True) -> Column:
    """Vectors of a map one after another in key order; a missing kind is an error."""
    parts = []
    for n in sorted(names):
        v = F.coalesce(kinds[n], F.raise_error(F.lit(f"embedding {n} is missing")).cast("array<double>"))
        parts.append(l2_normalise(v) if normalise_inputs else v)
    whole = F.concat(*parts)
    return l2_normalise(whole) if normalise_output else whole


def pad(v: Column, size: Column | int) -> Column:
    """Zeros up to a length."""
    size = size if isinstance(size, Column) else F.lit(size)
    return F.concat(v, F.array_repeat(F.lit(0.0), F.greatest(size - F.size(v), F.lit(0))))


def _times(v: Column, w: float) -> Column:
    return F.transform(v, lambda x: x * F.lit(w))


def fuse_weighted(vectors: list[Column], weights: list[float] | None = None) -> Column:
    """Weighted sum of vectors, shorter ones padded with zeros."""
    weights = weights or [1.0 / len(vectors)] * len(vectors)
    longest = F.greatest(*[F.size(v) for v in vectors]) if len(vectors) > 1 else F.size(vectors[0])
    out = None
    for v, w in zip(vectors, weights):
        part = _times(pad(v, longest), float(w))
        out = part if out is None else F.zip_with(out, part, lambda x, y: x + y)
    return out


def choose_embedding(kinds: Column, names) -> Column:
    """The first kind that is present."""
    return F.coalesce(*[kinds[n] for n in names])


def required_embedding(kinds: Column, name: str) -> Column:
    """The embedding of a kind; a row without it is an error."""
    return F.coalesce(F.try_element_at(kinds, F.lit(name)), F.raise_error(F.lit(f"no embedding of kind {name}")).cast("array<double>"))


def reduce_vector(v: Column, how: str = "mean") -> Column:
    """H34."""
    return {"mean": lambda: total(v) / F.size(v), "sum": lambda: total(v), "max": lambda: F.array_max(v), "none": lambda: v}[how]()


def normal_density(z: Column) -> Column:
    return F.exp(-z * z / 2) / math.sqrt(2 * math.pi)


def normal_cdf(z: Column) -> Column:
    """Cumulative normal by the rational approximation of erf with five terms (error under 1.5e-7)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1.0 / (1.0 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1.0 - poly * F.exp(-x * x)
    return F.when(z >= 0, 0.5 * (1 + erf)).otherwise(0.5 * (1 - erf))


def expected_improvement(mean: Column, std: Column, best: Column, xi: float = 0.01, maximise: bool = True) -> Column:
    """NaN and infinite scores count as 0."""
    gain = mean - (best + xi) if maximise else (best - xi) - mean
    z = gain / (std + 1e-8)
    score = gain * normal_cdf(z) + std * normal_density(z)
    return F.when(F.isnan(score) | F.abs(score).isin(float("inf")), 0.0).otherwise(score)


def probability_of_improvement(mean: Column, std: Column, best: Column, xi: float = 0.01, maximise: bool = True) -> Column:
    """H36."""
    gain = mean - (best + xi) if maximise else (best - xi) - mean
    return normal_cdf(gain / (std + 1e-8))


def softmax(df: DataFrame, score: str, temperature: float = 1.0, out: str = "weight") -> DataFrame:
    """Weights over all rows; the two totals are one-row aggregates joined back."""
    top = df.agg((F.max(score) / temperature).alias("_top"))
    shifted = df.crossJoin(F.broadcast(top)).withColumn("_e", F.exp(F.col(score) / temperature - F.col("_top")))
    whole = shifted.agg(F.sum("_e").alias("_all"))
    return shifted.crossJoin(F.broadcast(whole)).withColumn(out, F.col("_e") / F.col("_all")).drop("_top", "_e", "_all")


def standardise(v: Column, mean: Column, std: Column) -> Column:
    """H38."""
    centred = F.zip_with(v, mean, lambda x, m: x - m)
    return F.zip_with(centred, std, lambda x, s: x / (s + 1e-8))


def hash_uniform(*cols) -> Column:
    """A number in [0, 1) that depends only on the values given: the first 13 hex digits of the SHA-256 of the values joined by bars."""
    text = F.concat_ws("|", *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("double") / float(1 << 52)


def add_noise(v: Column, key: str, scale: float, seed: int) -> Column:
    """Gaussian noise by Box-Muller on hashes of key, position and seed, so reruns agree."""

    def noisy(x, i):
        u = 1.0 - hash_uniform(F.col(key), i, F.lit(seed))
        return x + scale * F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * hash_uniform(F.col(key), i, F.lit(seed + 1)))

    return F.transform(v, noisy)


def drop_features(v: Column, key: str, rate: float, seed: int) -> Column:
    """Each value set to 0 with probability ``rate``."""
    return F.transform(v, lambda x, i: F.when(hash_uniform(F.col(key), i, F.lit(seed)) < rate, 0.0).otherwise(x))


def metadata_value(m: Column, key: str, default: str) -> Column:
    """H40."""
    return F.coalesce(F.try_element_at(m, F.lit(key)), F.lit(default))


def label_codes(df: DataFrame, label: str, ordinal: str, out: str = "code") -> DataFrame:
    """Codes from 0 in the order in which labels first appear; labels are few, rows are not ranked."""
    seen = df.groupBy(label).agg(F.min(ordinal).alias("_first"))
    codes = seen.withColumn(out, F.row_number().over(Window.orderBy("_first", label)) - 1).drop("_first")
    return df.join(codes, df[label].eqNullSafe(codes[label])).drop(codes[label])


def aleatoric(log_variances: Column) -> Column:
    """Standard deviation from mean log-variance."""
    return F.sqrt(F.exp(total(log_variances) / F.size(log_variances)))


def total_uncertainty(epistemic: Column, aleatoric_: Column) -> Column:
    """H42."""
    return F.hypot(epistemic, aleatoric_)
