"""Descriptors of amino-acid sequences as column expressions.

Every function takes a column of validated sequences and returns a column. Residue counts are taken
once per letter by length differences and combined arithmetically, inside generated code. What looks at neighbouring residues
(pairs, complexity, hydrophobic moment) is Arrow-batched, where a pair is one number and a window a cumulative sum.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.functions.vectors import let

# The alphabet and published residue scales.
RESIDUES = "ACDEFGHIKLMNPQRSTVWY"
EXTENDED = RESIDUES + "BXZJUO"
WATER = 18.015
COARSE_WEIGHT = dict(A=89.1, R=174.2, N=132.1, D=133.1, C=121.2, E=147.1, Q=146.2, G=75.1, H=155.2, I=131.2, L=131.2, K=146.2, M=149.2, F=165.2, P=115.1, S=105.1, T=119.1, W=204.2, Y=181.2, V=117.1)
FINE_WEIGHT = dict(A=89.09, R=174.20, N=132.12, D=133.10, C=121.15, E=147.13, Q=146.15, G=75.07, H=155.16, I=131.17, L=131.17, K=146.19, M=149.21, F=165.19, P=115.13, S=105.09, T=119.12, W=204.23, Y=181.19, V=117.15)
KYTE_DOOLITTLE = dict(A=1.8, R=-4.5, N=-3.5, D=-3.5, C=2.5, E=-3.5, Q=-3.5, G=-0.4, H=-3.2, I=4.5, L=3.8, K=-3.9, M=1.9, F=2.8, P=-1.6, S=-0.8, T=-0.7, W=-0.9, Y=-1.3, V=4.2)
EISENBERG = dict(A=0.62, R=-2.53, N=-0.78, D=-0.90, C=0.29, E=-0.74, Q=-0.85, G=0.48, H=-0.40, I=1.38, L=1.06, K=-1.50, M=0.64, F=1.19, P=0.12, S=-0.18, T=-0.05, W=0.81, Y=0.26, V=1.08)
HELIX = dict(A=1.42, R=0.98, N=0.67, D=1.01, C=0.70, E=1.51, Q=1.11, G=0.57, H=1.00, I=1.08, L=1.21, K=1.16, M=1.45, F=1.13, P=0.57, S=0.77, T=0.83, W=1.08, Y=0.69, V=1.06)
SHEET = dict(A=0.83, R=0.93, N=0.89, D=0.54, C=1.19, E=0.37, Q=1.10, G=0.75, H=0.87, I=1.60, L=1.30, K=0.74, M=1.05, F=1.38, P=0.55, S=0.75, T=1.19, W=1.37, Y=1.47, V=1.70)
TURN = dict(A=0.66, R=0.95, N=1.56, D=1.46, C=1.19, E=0.74, Q=0.98, G=1.56, H=0.95, I=0.47, L=0.59, K=1.01, M=0.60, F=0.60, P=1.52, S=1.43, T=0.96, W=0.96, Y=1.14, V=0.50)
N_TERMINUS, C_TERMINUS = 9.69, 2.34
ACIDIC = dict(D=3.86, E=4.25, C=8.33, Y=10.07)
BASIC = dict(H=6.00, K=10.53, R=12.48)
# Dipeptide instability weights (Guruprasad et al., 1990); a pair that is not listed weighs 1.
INSTABILITY = {
    "A": dict(C=44.94, D=-7.49, H=-7.49, P=20.26),
    "C": dict(D=20.26, H=33.60, M=33.60, L=20.26, Q=-6.54, P=20.26, T=33.60, W=24.68, V=-6.54),
    "E": dict(C=44.94, E=33.60, D=20.26, I=20.26, H=-6.54, Q=20.26, P=20.26, S=20.26, W=-14.03),
    "D": dict(F=-6.54, K=-7.49, S=20.26, R=-6.54, T=-14.03),
    "G": dict(A=-7.49, E=-6.54, G=13.34, I=-7.49, K=-7.49, N=-7.49, T=-7.49, W=13.34, Y=-7.49),
    "F": dict(D=13.34, K=-14.03, P=20.26, Y=33.60),
    "I": dict(E=44.94, H=13.34, K=-7.49, L=20.26, P=-1.88, V=-7.49),
    "H": dict(G=-9.37, F=-9.37, I=44.94, K=24.68, N=24.68, P=-1.88, T=-6.54, W=-1.88, Y=44.94),
    "K": dict(G=-7.49, I=-7.49, M=33.60, L=-7.49, Q=24.68, P=-6.54, R=33.60, V=-7.49),
    "M": dict(A=13.34, H=58.28, M=-1.88, Q=-6.54, P=44.94, S=44.94, R=-6.54, T=-1.88, Y=24.68),
    "L": dict(K=-7.49, Q=33.60, P=20.26, R=20.26, W=24.68),
    "N": dict(C=-1.88, G=-14.03, F=-14.03, I=44.94, K=24.68, Q=-6.54, P=-1.88, T=-7.49, W=-9.37),
    "Q": dict(C=-6.54, E=20.26, D=20.26, F=-6.54, Q=20.26, P=20.26, S=44.94, V=-6.54, Y=-6.54),
    "P": dict(A=20.26, C=-6.54, E=18.38, D=-6.54, F=20.26, M=-6.54, Q=20.26, P=20.26, S=20.26, R=-6.54, W=-1.88, V=20.26),
    "S": dict(C=33.60, E=20.26, Q=20.26, P=44.94, S=20.26, R=20.26),
    "R": dict(G=-7.49, H=20.26, N=13.34, Q=20.26, P=20.26, S=44.94, R=58.28, W=58.28, Y=-6.54),
    "T": dict(E=20.26, G=-7.49, F=13.34, N=-14.03, Q=-6.54, W=-14.03),
    "W": dict(A=-14.03, G=-9.37, H=24.68, M=24.68, L=13.34, N=13.34, T=-14.03, V=-7.49),
    "V": dict(D=-14.03, G=-7.49, K=-1.88, P=20.26, T=-7.49, Y=-6.54),
    "Y": dict(A=24.68, E=-6.54, D=24.68, G=-7.49, H=13.34, M=44.94, P=13.34, R=-15.91, T=-7.49, W=-9.37, Y=13.34),
}


def normalise_sequence(raw: Column) -> Column:
    """H1: upper case, without white space, dashes, dots and stop marks."""
    return F.regexp_replace(F.upper(F.trim(raw)), r"[\s\-.*]", "")


def is_valid(seq: Column, extended: bool = False) -> Column:
    """H1: non-empty and of known residues only."""
    return F.coalesce(seq.rlike(f"^[{EXTENDED if extended else RESIDUES}]+$"), F.lit(False))


def sequence_hash(seq: Column) -> Column:
    """H2: first 16 hex digits of SHA-256."""
    return F.substring(F.sha2(seq, 256), 1, 16)


def clean_name(name: Column, seq: Column) -> Column:
    """H3: trimmed, unsafe characters as underscores; without a name, ``protein_`` and the hash."""
    safe = F.regexp_replace(F.trim(name), r'[<>:"/\\|?*]', "_")
    return F.coalesce(F.when(safe != "", safe), F.concat(F.lit("protein_"), sequence_hash(seq)))


def clean_source(source: Column) -> Column:
    """H3: lower case, trimmed."""
    return F.lower(F.trim(source))


def truncate(seq: Column, most: int = 1022) -> Column:
    """The language model's longest input."""
    return F.substring(seq, 1, most)


def count(seq: Column, letter: str) -> Column:
    return F.length(seq) - F.length(F.replace(seq, F.lit(letter), F.lit("")))


def weighted(seq: Column, scale: dict[str, float], unknown: float = 0.0) -> Column:
    """Sum of a residue scale over the sequence."""
    known = reduce(add, [count(seq, a) * F.lit(float(w) - unknown) for a, w in scale.items()])
    return known + F.length(seq) * F.lit(float(unknown))


def _share(seq: Column, total: Column) -> Column:
    return F.when(F.length(seq) > 0, total / F.length(seq)).otherwise(0.0)


def molecular_weight(seq: Column, scale: dict[str, float] | None = None) -> Column:
    """H5, or H4 with ``COARSE_WEIGHT``."""
    return weighted(seq, scale or FINE_WEIGHT, 110.0) - (F.length(seq) - 1) * F.lit(WATER)


def composition(seq: Column) -> Column:
    """H6: shares of the 20 residues in alphabetical order."""
    return F.array(*[_share(seq, count(seq, a).cast("double")) for a in RESIDUES])


def _charge(counts: dict[str, Column], ph: Column) -> Column:
    up = lambda pka: 1.0 / (1.0 + F.pow(F.lit(10.0), ph - F.lit(pka)))
    down = lambda pka: 1.0 / (1.0 + F.pow(F.lit(10.0), F.lit(pka) - ph))
    terms = [up(N_TERMINUS), -down(C_TERMINUS)]
    terms += [-counts[a] * down(p) for a, p in ACIDIC.items()] + [counts[a] * up(p) for a, p in BASIC.items()]
    return reduce(add, terms)


def charge(seq: Column, ph: float | Column = 7.0) -> Column:
    """H8: net charge by Henderson-Hasselbalch."""
    return _charge({a: count(seq, a) for a in (*ACIDIC, *BASIC)}, ph if isinstance(ph, Column) else F.lit(float(ph)))


def isoelectric_point(seq: Column, steps: int = 11) -> Column:
    """H9: bisection of [0, 14] on the sign of the charge, eleven halvings, then the middle. The residues are counted once."""
    letters = [*ACIDIC, *BASIC]

    def bisect(counts):
        def halve(state, _):
            mid = (state["low"] + state["high"]) / 2
            positive = _charge({a: counts[i] for i, a in enumerate(letters)}, mid) > 0
            return F.struct(F.when(positive, mid).otherwise(state["low"]).alias("low"), F.when(positive, state["high"]).otherwise(mid).alias("high"))

        start = F.struct(F.lit(0.0).alias("low"), F.lit(14.0).alias("high"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda s: (s["low"] + s["high"]) / 2)

    return let(F.array(*[count(seq, a) for a in letters]), bisect)


def gravy(seq: Column) -> Column:
    """H11."""
    return _share(seq, weighted(seq, KYTE_DOOLITTLE))


def aromaticity(seq: Column) -> Column:
    """H12."""
    return _share(seq, count(seq, "F") + count(seq, "W") + count(seq, "Y"))


def aliphatic_index(seq: Column) -> Column:
    """H13."""
    return 100 * _share(seq, count(seq, "A") + 2.9 * count(seq, "V") + 3.9 * (count(seq, "I") + count(seq, "L")))


def structure_fractions(seq: Column) -> Column:
    """Helix, sheet and turn shares as an array."""
    sums = [weighted(seq, s, 1.0) for s in (HELIX, SHEET, TURN)]
    total = reduce(add, sums)
    return F.array(*[F.when(total > 0, s / total).otherwise(0.0) for s in sums])


def entropy(seq: Column) -> Column:
    """Shannon entropy in bits."""

    def term(a):
        p = count(seq, a) / F.length(seq)
        return F.when(p > 0, -p * F.log2(p)).otherwise(0.0)

    return F.when(F.length(seq) > 0, reduce(add, [term(a) for a in RESIDUES])).otherwise(0.0)


def charged_fractions(seq: Column) -> Column:
    """Positive and negative residue shares as an array."""
    return F.array(_share(seq, count(seq, "K") + count(seq, "R") + count(seq, "H")), _share(seq, count(seq, "D") + count(seq, "E")))


def complexity(window: int = 12):
    """H16 as a vectorised function of a sequence column."""

    @F.pandas_udf("double")
    def run(seqs: pd.Series) -> pd.Series:
        slot = np.full(256, 20)
        slot[[ord(a) for a in RESIDUES]] = np.arange(20)
        table = np.array([0.0] + [k / window * math.log2(k / window) for k in range(1, window + 1)])

        def one(s):
            if s is None:
                return None
            codes = slot[np.frombuffer(s.encode("latin-1", "replace"), dtype=np.uint8)]
            if len(s) < window:
                n = np.bincount(codes, minlength=21)
                p = n[n > 0] / max(1, len(s))
                return float(-(p * np.log2(p)).sum() / math.log2(20)) if len(s) else 0.0
            hot = np.zeros((len(codes) + 1, 21), dtype=np.int32)
            hot[np.arange(1, len(codes) + 1), codes] = 1
            sums = hot.cumsum(axis=0)
            return float(-table[sums[window:] - sums[:-window]].sum(axis=1).mean() / math.log2(min(window, 20)))

        return seqs.map(one, na_action=None)

    return run


def hydrophobic_moment(angle: float = 100.0, window: int = 11):
    """H17 as a vectorised function of a sequence column."""

    @F.pandas_udf("double")
    def run(seqs: pd.Series) -> pd.Series:
        scale = np.zeros(256)
        scale[[ord(a) for a in EISENBERG]] = list(EISENBERG.values())
        turn = np.radians(angle) * np.arange(window)

        def one(s):
            if s is None:
                return None
            if len(s) < window:
                return 0.0
            w = np.lib.stride_tricks.sliding_window_view(scale[np.frombuffer(s.encode("latin-1", "replace"), dtype=np.uint8)], window)
            return float(np.hypot(w @ np.cos(turn), w @ np.sin(turn)).max() / window)

        return seqs.map(one, na_action=None)

    return run


def _pair_counts(text: str) -> np.ndarray:
    """How often each of the 400 pairs of residues occurs, overlapping; pairs with other letters are left out."""
    slot = np.full(256, len(RESIDUES))
    slot[[ord(a) for a in RESIDUES]] = np.arange(len(RESIDUES))
    codes = slot[np.frombuffer(text.encode("latin-1", "replace"), dtype=np.uint8)]
    return np.bincount(codes[:-1] * 21 + codes[1:], minlength=441)[:441].reshape(21, 21)[:20, :20].reshape(-1)


def dipeptides(df: DataFrame, key: str, seq: str) -> DataFrame:
    """H7 in long form: ``key, pair, n, freq, len`` of the pairs that occur (overlapping), in one pass without a shuffle."""
    names = np.array([a + b for a in RESIDUES for b in RESIDUES])

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                texts = [s or "" for s in part.column(1).to_pylist()]
                counts = [_pair_counts(s) for s in texts]
                met = [np.flatnonzero(c) for c in counts]
                owner = np.repeat(np.arange(len(texts)), [len(m) for m in met])
                pair, n = np.concatenate([*met, np.zeros(0, dtype=np.int64)]).astype(np.int64), np.concatenate([*(c[m] for c, m in zip(counts, met)), np.zeros(0, dtype=np.int64)]).astype(np.int64)
                length = np.array([len(s) for s in texts], dtype=np.int64)[owner]
                cols = [part.column(0).take(pa.array(owner)), pa.array(names[pair]), pa.array(n), pa.array(n / np.maximum(length - 1, 1)), pa.array(length)]
                yield pa.RecordBatch.from_arrays(cols, [key, "pair", "n", "freq", "len"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(seq).alias("_s")).mapInArrow(run, f"`{key}` {kind}, pair string, n long, freq double, len long")


def pair_descriptors(weights=None, frequencies: bool = True):
    """H7 and H10 as one vectorised function of a sequence column: the instability index, after the 400 pair frequencies if wanted."""
    scale = np.array([(weights or INSTABILITY).get(a, {}).get(b, 1.0) for a in RESIDUES for b in RESIDUES])

    @F.pandas_udf("array<double>")
    def run(seqs: pd.Series) -> pd.Series:
        def one(s):
            if s is None:
                return None
            if len(s) < 2:
                return np.zeros(401 if frequencies else 1)
            n = _pair_counts(s)
            index = 10.0 / len(s) * (n @ scale)
            return np.append(n / (len(s) - 1), index) if frequencies else np.array([index])

        return seqs.map(one, na_action=None)

    return run


def instability(df: DataFrame, key: str, seq: str, weights=None) -> DataFrame:
    """``key, instability``; sequences under two residues have 0."""
    return df.select(key, F.coalesce(pair_descriptors(weights, False)(F.col(seq))[0], F.lit(0.0)).alias("instability"))


GROUPS = ("composition", "dipeptides", "global", "hydrophobicity", "structure", "charge", "complexity")


def feature_names(groups=GROUPS) -> list[str]:
    """Names in vector order."""
    per = {
        "composition": [f"aa_comp_{a}" for a in RESIDUES],
        "dipeptides": [f"dipep_{a}{b}" for a in RESIDUES for b in RESIDUES],
        "global": ["molecular_weight", "length", "instability_index", "aliphatic_index", "aromaticity"],
        "hydrophobicity": ["gravy", "hydrophobic_moment"],
        "structure": ["helix_fraction", "sheet_fraction", "turn_fraction"],
        "charge": ["isoelectric_point", "charge_at_ph7", "positive_residue_fraction", "negative_residue_fraction"],
        "complexity": ["sequence_entropy", "sequence_complexity"],
    }
    return [n for g in GROUPS if g in groups for n in per[g]]


def descriptors(df: DataFrame, key: str, seq: str, groups=GROUPS) -> DataFrame:
    """``key, features`` with the chosen groups in fixed order (436 values for all seven), row by row without a shuffle."""
    s = F.col(seq)
    out = df.select(key, seq)
    if "dipeptides" in groups or "global" in groups:
        out = out.withColumn("_pairs", pair_descriptors(frequencies="dipeptides" in groups)(s))
    parts = {
        "composition": composition(s),
        "dipeptides": F.slice("_pairs", 1, 400),
        "global": F.array(molecular_weight(s), F.length(s).cast("double"), F.element_at("_pairs", -1), aliphatic_index(s), aromaticity(s)),
        "hydrophobicity": F.array(gravy(s), hydrophobic_moment()(s)),
        "structure": structure_fractions(s),
        "charge": F.concat(F.array(isoelectric_point(s), charge(s)), charged_fractions(s)),
        "complexity": F.array(entropy(s), complexity()(s)),
    }
    return out.select(key, F.concat(*[parts[g] for g in GROUPS if g in groups]).alias("features"))


def plddt_from_pdb(df: DataFrame, key: str, pdb: str) -> DataFrame:
    """``key, residue, plddt`` from the CA atoms of PDB text, the first line of a residue."""
    lines = df.select(key, F.posexplode(F.split(pdb, "\n")).alias("pos", "line")).filter(F.col("line").startswith("ATOM") & (F.trim(F.substring("line", 13, 4)) == "CA"))
    atoms = lines.select(key, "pos", F.trim(F.substring("line", 23, 4)).cast("int").alias("residue"), F.trim(F.substring("line", 61, 6)).try_cast("double").alias("plddt"))
    return atoms.groupBy(key, "residue").agg(F.min_by("plddt", "pos").alias("plddt"))


def plddt_summary(values: Column) -> Column:
    """Mean, population std and the shares over 70, over 90 and under 50; zeros for no residues."""
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / n
    spread = let(mean, lambda m: F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / n))
    share = lambda test: F.size(F.filter(values, test)) / n
    whole = F.struct(
        mean.alias("mean"), spread.alias("std"), share(lambda x: x > 70).alias("over_70"), share(lambda x: x > 90).alias("over_90"), share(lambda x: x < 50).alias("under_50")
    )
    zero = F.struct(*[F.lit(0.0).alias(k) for k in ("mean", "std", "over_70", "over_90", "under_50")])
    return F.when(F.coalesce(n, F.lit(0)) > 0, whole).otherwise(zero)


def pool_tokens(tokens: DataFrame, key: str = "id", special: Column | None = None) -> DataFrame:
    """Per sequence the mean, maximum and first of its residues' vectors (``key, pos, vector``), special tokens left out."""
    rows = tokens.filter(~special) if special is not None else tokens
    long = rows.select(key, "pos", F.posexplode("vector").alias("f", "v"))
    per = long.groupBy(key, "f").agg(F.avg("v").alias("mean"), F.max("v").alias("max"), F.min_by("v", "pos").alias("first"))
    out = per.groupBy(key).agg(*[F.expr(f"transform(array_sort(collect_list(struct(f, mean, max, first))), x -> x.{n})").alias(n) for n in ("mean", "max", "first")])
    return out.withColumn("first_mean", F.concat("first", "mean"))
