"""Sequence descriptors over the amino-acid letters of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from platewise.catalog.base import SEQ, query, rounded, sequences, table, vectors
from platewise.functions import sequence as S
from platewise.operators import aggregates as A
from platewise.plans import pipelines


def _count(a: str) -> str:
    return f"(length(s) - length(replace(s, '{a}', '')))"


def _weighted(scale: dict, unknown: float = 0.0) -> str:
    return "(" + " + ".join(f"{_count(a)} * ({w} - {unknown})" for a, w in scale.items()) + f" + length(s) * {unknown})"


def _charge(ph: str, counts=None) -> str:
    n = counts or _count
    up = lambda p: f"1.0 / (1.0 + pow(10.0, {ph} - {p}))"
    down = lambda p: f"1.0 / (1.0 + pow(10.0, {p} - {ph}))"
    return " ".join(
        [f"{up(S.N_TERMINUS)} - {down(S.C_TERMINUS)}", *[f"- {n(a)} * {down(p)}" for a, p in S.ACIDIC.items()], *[f"+ {n(a)} * {up(p)}" for a, p in S.BASIC.items()]]
    )


def _share(x: str) -> str:
    return f"CASE WHEN length(s) > 0 THEN ({x})::DOUBLE / length(s) ELSE 0.0 END"


RAW = r"""raw AS (SELECT doc_id, source, text, CASE WHEN doc_id % 2 = 0 THEN ' ' || regexp_replace(coalesce(text, ''), '[^A-Ya-y\\-\\s.]', '', 'g') || '*' ELSE regexp_replace(coalesce(text, ''), '[^ACDEFGHIKLMNPQRSTVWYacdefghiklmnpqrstvwy\\s]', '', 'g') END AS s FROM documents)"""


def raw_sequences(spark, sf):
    """Texts with white space, dashes, dots and stop marks left in; odd rows hold plain residues only."""
    text = F.coalesce("text", F.lit(""))
    loose, plain = F.regexp_replace(text, r"[^A-Ya-y\-\s.]", ""), F.regexp_replace(text, r"[^ACDEFGHIKLMNPQRSTVWYacdefghiklmnpqrstvwy\s]", "")
    return table(spark, sf, "documents").select("doc_id", "source", "text", F.when(F.pmod("doc_id", F.lit(2)) == 0, F.concat(F.lit(" "), loose, F.lit("*"))).otherwise(plain).alias("s"))


@query(rf"""WITH {RAW}, n AS (SELECT doc_id, upper(regexp_replace(s, '[\s\-.*]', '', 'g')) AS s FROM raw)
SELECT doc_id, sha256(s) AS sequence, regexp_full_match(s, '[ACDEFGHIKLMNPQRSTVWY]+') AS valid, regexp_full_match(s, '[ACDEFGHIKLMNPQRSTVWYBXZJUO]+') AS extended FROM n""")
def h01_validate(spark, sf):
    rows = raw_sequences(spark, sf).select("doc_id", S.normalise_sequence(F.col("s")).alias("s"))
    return rows.select("doc_id", F.sha2("s", 256).alias("sequence"), S.is_valid(F.col("s")).alias("valid"), S.is_valid(F.col("s"), True).alias("extended"))


@query(rf"""WITH {SEQ}, n AS (SELECT seq.*, CASE WHEN doc_id % 3 = 0 THEN ' ' || lang || ':' || source || '/' || doc_id || '? ' WHEN doc_id % 3 = 1 THEN '  ' END AS name FROM seq),
c AS (SELECT *, regexp_replace(trim(name), '[<>:"/\|?*]', '_', 'g') AS safe FROM n)
SELECT doc_id, substr(sha256(s), 1, 16) AS hash, coalesce(nullif(safe, ''), 'protein_' || substr(sha256(s), 1, 16)) AS name, lower(trim(' ' || upper(source) || ' ')) AS source, substr(s, 1, 1022) AS short FROM c""")
def h02_h03_h20_identity(spark, sf):
    s, kind = F.col("s"), F.pmod("doc_id", F.lit(3))
    name = F.when(kind == 0, F.concat(F.lit(" "), "lang", F.lit(":"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("? "))).when(kind == 1, F.lit("  "))
    source = F.concat(F.lit(" "), F.upper("source"), F.lit(" "))
    return sequences(spark, sf).select("doc_id", S.sequence_hash(s).alias("hash"), S.clean_name(name, s).alias("name"), S.clean_source(source).alias("source"), S.truncate(s).alias("short"))


@query(
    f"""WITH {SEQ} SELECT doc_id, round(({_weighted(S.COARSE_WEIGHT, 110.0)} - (length(s) - 1) * 18.015)::DOUBLE, 3) AS coarse, round(({_weighted(S.FINE_WEIGHT, 110.0)} - (length(s) - 1) * 18.015)::DOUBLE, 3) AS fine,
 round({_share(_weighted(S.KYTE_DOOLITTLE))}, 6) AS gravy, round({_share(_count("F") + "+" + _count("W") + "+" + _count("Y"))}, 6) AS aromaticity,
 round(100 * {_share(f"{_count('A')} + 2.9 * {_count('V')} + 3.9 * ({_count('I')} + {_count('L')})")}, 4) AS aliphatic,
 round({_share(_count("K") + "+" + _count("R") + "+" + _count("H"))}, 6) AS positive, round({_share(_count("D") + "+" + _count("E"))}, 6) AS negative FROM seq"""
)
def h04_h05_h11_h13_h18_scales(spark, sf):
    s = F.col("s")
    out = sequences(spark, sf).select(
        "doc_id",
        F.round(S.molecular_weight(s, S.COARSE_WEIGHT), 3).alias("coarse"),
        F.round(S.molecular_weight(s), 3).alias("fine"),
        S.gravy(s).alias("gravy"),
        S.aromaticity(s).alias("aromaticity"),
        F.round(S.aliphatic_index(s), 4).alias("aliphatic"),
        S.charged_fractions(s)[0].alias("positive"),
        S.charged_fractions(s)[1].alias("negative"),
    )
    return rounded(out, "gravy", "aromaticity", "positive", "negative")


@query(f"WITH {SEQ}, l AS (SELECT doc_id, length(s) AS n, unnest(string_split(s, '')) AS residue FROM seq WHERE length(s) > 0) SELECT doc_id, residue, round(count(*) / any_value(n), 6) AS share FROM l GROUP BY doc_id, residue")
def h06_composition(spark, sf):
    long = sequences(spark, sf).select("doc_id", F.posexplode(S.composition(F.col("s"))).alias("i", "share")).filter("share > 0")
    return long.select("doc_id", F.substr(F.lit(S.RESIDUES), F.col("i") + 1, F.lit(1)).alias("residue"), F.round("share", 6).alias("share"))


@query(f"""WITH {SEQ}, p AS (SELECT doc_id, length(s) AS n, unnest(list_transform(range(1, length(s)), lambda i: substr(s, i, 2))) AS pair FROM seq WHERE length(s) > 1)
SELECT doc_id, pair, count(*) AS n, round(count(*) / (any_value(n) - 1), 6) AS freq FROM p GROUP BY doc_id, pair""")
def h07_dipeptides(spark, sf):
    return rounded(S.dipeptides(sequences(spark, sf), "doc_id", "s").drop("len"), "freq")


@query(f"WITH {SEQ} SELECT doc_id, round({_charge('7.0')}, 4) AS charge FROM seq")
def h08_charge(spark, sf):
    return sequences(spark, sf).select("doc_id", F.round(S.charge(F.col("s")), 4).alias("charge"))


_NUMBERS = ", ".join(f"{_count(a)} AS n{a}" for a in (*S.ACIDIC, *S.BASIC))


@query(f"""WITH {SEQ}, m AS (SELECT doc_id, {_NUMBERS} FROM seq), c AS (SELECT m.*, unnest(range(1, 2048)) AS k FROM m), p AS (SELECT doc_id, sum(({_charge('(k * 14.0 / 2048)', 'n{}'.format)} > 0)::INT) AS n FROM c GROUP BY doc_id)
SELECT doc_id, round((n + 0.5) * 14.0 / 2048, 6) AS pi FROM p""")
def h09_isoelectric_point(spark, sf):
    return sequences(spark, sf).select("doc_id", F.round(S.isoelectric_point(F.col("s")), 6).alias("pi"))


_PAIRS = ", ".join(f"('{a}{b}', {w})" for a, row in S.INSTABILITY.items() for b, w in row.items())


@query(f"""WITH {SEQ}, w(pair, w) AS (VALUES {_PAIRS}), p AS (SELECT doc_id, unnest(list_transform(range(1, length(s)), lambda i: substr(s, i, 2))) AS pair FROM seq WHERE length(s) > 1),
t AS (SELECT doc_id, sum(coalesce(w.w, 1.0)::DOUBLE) AS t FROM p LEFT JOIN w USING (pair) GROUP BY doc_id) SELECT doc_id, round(coalesce(10.0 / length(s) * t, 0.0) + 1e-9, 6) AS instability FROM seq LEFT JOIN t USING (doc_id)""")
def h10_instability(spark, sf):
    return S.instability(sequences(spark, sf), "doc_id", "s").withColumn("instability", F.round(F.col("instability") + 1e-9, 6))  # off the exact ties


_H, _E, _T = (_weighted(x, 1.0) for x in (S.HELIX, S.SHEET, S.TURN))


@query(f"WITH {SEQ}, w AS (SELECT doc_id, {_H} AS h, {_E} AS e, {_T} AS t FROM seq) SELECT doc_id, round(CASE WHEN h + e + t > 0 THEN h / (h + e + t) ELSE 0 END, 6) AS helix, round(CASE WHEN h + e + t > 0 THEN e / (h + e + t) ELSE 0 END, 6) AS sheet FROM w")
def h14_structure(spark, sf):
    f = S.structure_fractions(F.col("s"))
    return rounded(sequences(spark, sf).select("doc_id", f[0].alias("helix"), f[1].alias("sheet")), "helix", "sheet")


@query(f"WITH {SEQ} SELECT doc_id, round(coalesce(list_entropy(string_split(s, '')), 0.0), 6) AS entropy FROM seq")
def h15_entropy(spark, sf):
    return sequences(spark, sf).select("doc_id", F.round(S.entropy(F.col("s")), 6).alias("entropy"))


@query(f"""WITH {SEQ} SELECT doc_id, round(CASE WHEN length(s) = 0 THEN 0.0 WHEN length(s) < 12 THEN list_entropy(string_split(s, '')) / log2(20)
 ELSE list_avg(list_transform(range(1, length(s) - 10), lambda i: list_entropy(string_split(substr(s, i, 12), '')))) / log2(12) END, 6) AS complexity FROM seq""")
def h16_complexity(spark, sf):
    return sequences(spark, sf).select("doc_id", F.round(S.complexity()(F.col("s")), 6).alias("complexity"))


_CASE = "CASE c " + " ".join(f"WHEN '{a}' THEN {w}" for a, w in S.EISENBERG.items()) + " ELSE 0.0 END"


@query(f"""WITH {SEQ}, r AS (SELECT doc_id, length(s) AS n, unnest(string_split(s, '')) AS c, unnest(range(1, length(s) + 1)) AS i FROM seq WHERE length(s) > 0), h AS (SELECT doc_id, n, i, ({_CASE})::DOUBLE AS h FROM r),
w AS (SELECT doc_id, i, n, list(h) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 10 FOLLOWING) AS w FROM h),
m AS (SELECT doc_id, max(sqrt(pow(list_sum(list_transform(w, lambda x, j: x * cos((j - 1) * radians(100.0)))), 2) + pow(list_sum(list_transform(w, lambda x, j: x * sin((j - 1) * radians(100.0)))), 2)) / 11) AS moment FROM w WHERE i <= n - 10 GROUP BY doc_id)
SELECT doc_id, round(coalesce(moment, 0.0), 6) AS moment FROM seq LEFT JOIN m USING (doc_id)""")
def h17_hydrophobic_moment(spark, sf):
    return sequences(spark, sf).select("doc_id", F.round(S.hydrophobic_moment()(F.col("s")), 6).alias("moment"))


_COUNTS = ", ".join(f"{_count(a)} AS n{a}" for a in S.RESIDUES)


def _scale(scale: dict, unknown: float = 0.0) -> str:
    return "(" + " + ".join(f"n{a} * ({w} - {unknown})" for a, w in scale.items()) + f" + n * {unknown})::DOUBLE"


_ENTROPY = "CASE WHEN n > 0 THEN " + " + ".join(f"CASE WHEN n{a} > 0 THEN -(n{a} / n) * log2(n{a} / n) ELSE 0.0 END" for a in S.RESIDUES) + " ELSE 0.0 END"
_NAMES = ", ".join(f"'{n}'" for n in S.feature_names())
DESCRIPTORS = f"""WITH {SEQ}, w(pair, w) AS (VALUES {_PAIRS}), names AS (SELECT unnest([{_NAMES}]) AS name), c AS (SELECT doc_id, s, length(s) AS n, {_COUNTS} FROM seq),
p AS (SELECT doc_id, length(s) AS n, unnest(list_transform(range(1, length(s)), lambda i: substr(s, i, 2))) AS pair FROM seq WHERE length(s) > 1),
d AS (SELECT doc_id, pair, count(*) AS k, any_value(n) AS n FROM p GROUP BY doc_id, pair), ins AS (SELECT doc_id, 10.0 / any_value(n) * sum(k * coalesce(w.w, 1.0)::DOUBLE) AS x FROM d LEFT JOIN w USING (pair) GROUP BY doc_id),
g AS (SELECT doc_id, unnest(range(1, 2048)) AS k, {", ".join(f"n{a}" for a in (*S.ACIDIC, *S.BASIC))} FROM c), pi AS (SELECT doc_id, (sum(({_charge('(k * 14.0 / 2048)', 'n{}'.format)} > 0)::INT) + 0.5) * 14.0 / 2048 AS x FROM g GROUP BY doc_id),
r AS (SELECT doc_id, length(s) AS n, unnest(string_split(s, '')) AS c, unnest(range(1, length(s) + 1)) AS i FROM seq WHERE length(s) > 0), h AS (SELECT doc_id, n, i, ({_CASE})::DOUBLE AS h FROM r),
win AS (SELECT doc_id, i, n, list(h) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 10 FOLLOWING) AS w FROM h),
mom AS (SELECT doc_id, max(sqrt(pow(list_sum(list_transform(w, lambda x, j: x * cos((j - 1) * radians(100.0)))), 2) + pow(list_sum(list_transform(w, lambda x, j: x * sin((j - 1) * radians(100.0)))), 2)) / 11) AS x FROM win WHERE i <= n - 10 GROUP BY doc_id),
fold AS (SELECT doc_id, {_scale(S.HELIX, 1.0)} AS h, {_scale(S.SHEET, 1.0)} AS e, {_scale(S.TURN, 1.0)} AS t FROM c),
one AS (SELECT doc_id, unnest([{_NAMES.split(", 'dipep_")[0]}, 'molecular_weight', 'length', 'instability_index', 'aliphatic_index', 'aromaticity', 'gravy', 'hydrophobic_moment', 'helix_fraction', 'sheet_fraction', 'turn_fraction',
 'isoelectric_point', 'charge_at_ph7', 'positive_residue_fraction', 'negative_residue_fraction', 'sequence_entropy', 'sequence_complexity']) AS name,
 unnest([{", ".join(f"CASE WHEN n > 0 THEN n{a} / n ELSE 0.0 END" for a in S.RESIDUES)}, {_scale(S.FINE_WEIGHT, 110.0)} - (n - 1) * 18.015, n::DOUBLE, coalesce(ins.x, 0.0), CASE WHEN n > 0 THEN 100 * (nA + 2.9 * nV + 3.9 * (nI + nL)) / n ELSE 0.0 END,
 CASE WHEN n > 0 THEN (nF + nW + nY) / n ELSE 0.0 END, CASE WHEN n > 0 THEN {_scale(S.KYTE_DOOLITTLE)} / n ELSE 0.0 END, coalesce(mom.x, 0.0), CASE WHEN h + e + t > 0 THEN h / (h + e + t) ELSE 0.0 END, CASE WHEN h + e + t > 0 THEN e / (h + e + t) ELSE 0.0 END,
 CASE WHEN h + e + t > 0 THEN t / (h + e + t) ELSE 0.0 END, pi.x, {_charge('7.0', 'n{}'.format)}, CASE WHEN n > 0 THEN (nK + nR + nH) / n ELSE 0.0 END, CASE WHEN n > 0 THEN (nD + nE) / n ELSE 0.0 END, {_ENTROPY},
 CASE WHEN n = 0 THEN 0.0 WHEN n < 12 THEN list_entropy(string_split(s, '')) / log2(20) ELSE list_avg(list_transform(range(1, n - 10), lambda i: list_entropy(string_split(substr(s, i, 12), '')))) / log2(12) END]) AS value
 FROM c LEFT JOIN ins USING (doc_id) LEFT JOIN mom USING (doc_id) JOIN pi USING (doc_id) JOIN fold USING (doc_id)),
long AS (SELECT doc_id, name, value FROM one UNION ALL SELECT doc_id, 'dipep_' || pair, k / (n - 1) FROM d)
SELECT name, count(*) FILTER (value <> 0) AS n_used, round(sum(value), 2) AS total, round(max(value), 4) AS highest, round(sum(value * (doc_id % 7 + 1)), 2) AS weighted FROM long GROUP BY name HAVING count(*) FILTER (value <> 0) > 0"""


@query(DESCRIPTORS)
def h19_descriptors(spark, sf):
    """All 436 values of every text, summed up by name in three ways."""
    packed = S.descriptors(sequences(spark, sf), "doc_id", "s").mapInArrow(lambda batches: batches, "doc_id long, features array<double>")  # or the sums join the descriptors' generated code, too long to be compiled
    out = packed.select("doc_id", F.posexplode("features").alias("i", "value"))
    sums = out.groupBy("i").agg(
        F.count_if(F.col("value") != 0).alias("n_used"), F.sum("value").alias("total"), F.max("value").alias("highest"), F.sum(F.col("value") * (F.pmod("doc_id", F.lit(7)) + 1)).alias("weighted")
    )
    sums = sums.select(F.element_at(F.array(*[F.lit(n) for n in S.feature_names()]), F.col("i") + 1).alias("name"), "n_used", "total", "highest", "weighted")
    return rounded(rounded(sums.filter("n_used > 0"), "total", "weighted", digits=2), "highest", digits=4)


@query(f"WITH {SEQ} SELECT count(*) AS n, min(length(s)) AS shortest, round(avg(length(s)), 6) AS mean, median(length(s)) AS median, max(length(s)) AS longest FROM seq")
def d25_library_summary(spark, sf):
    return rounded(A.library_summary(sequences(spark, sf), "s"), "mean")


@query("SELECT source, count(*) AS n FROM documents GROUP BY source")
def d25_sources(spark, sf):
    return A.value_counts(table(spark, sf, "documents"), "source")


@query("SELECT lang AS kind, round(count(*) / (SELECT count(*) FROM documents), 8) AS share FROM documents GROUP BY lang")
def d25_coverage(spark, sf):
    rows = table(spark, sf, "documents").select(F.create_map("lang", F.array(F.lit(0.0))).alias("kinds"))
    return rounded(A.coverage(rows, "kinds"), "share", digits=8)


@query("""WITH a AS (SELECT o_orderkey, o_totalprice, 1 + o_custkey % 7 AS res, o_custkey FROM orders), r AS (SELECT o_custkey, res, arg_min(round(o_totalprice / 10000, 2), o_orderkey) AS plddt FROM a GROUP BY ALL) SELECT o_custkey, res::INT AS residue, plddt FROM r""")
def h21_plddt(spark, sf):
    """Structure lines made of orders: one atom line an order, residues by customer."""
    line = F.format_string("ATOM  %5d  CA  ALA A%4d    %8.3f%8.3f%8.3f  1.00%6.2f", F.pmod("o_orderkey", F.lit(99999)), 1 + F.pmod("o_custkey", F.lit(7)), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.col("o_totalprice") / 10000)
    lines = table(spark, sf, "orders").select("o_custkey", "o_orderkey", line.alias("line"))
    text = lines.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "line"))), lambda x: x["line"]), "\n").alias("pdb"))
    return S.plddt_from_pdb(text, "o_custkey", "pdb")


@query("""SELECT o_custkey, round(avg(o_totalprice / 7000), 6) AS mean, round(stddev_pop(o_totalprice / 7000), 6) AS std, round(avg((o_totalprice / 7000 > 70)::INT), 6) AS over_70, round(avg((o_totalprice / 7000 > 90)::INT), 6) AS over_90,
 round(avg((o_totalprice / 7000 < 50)::INT), 6) AS under_50 FROM orders GROUP BY o_custkey""")
def h22_plddt_summary(spark, sf):
    rows = table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_list(F.col("o_totalprice") / 7000).alias("v"))
    return rounded(rows.select("o_custkey", S.plddt_summary(F.col("v")).alias("s")).select("o_custkey", "s.*"), "mean", "std", "over_70", "over_90", "under_50")


@query(f"""WITH {SEQ}, c AS (SELECT doc_id, length(s) AS n, {_COUNTS} FROM seq), d AS (SELECT doc_id, [{", ".join(f"CASE WHEN n > 0 THEN n{a} / n ELSE 0.0 END" for a in S.RESIDUES)}] AS c FROM c),
vec AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), u AS (SELECT doc_id, list_transform(x, lambda a: a / (sqrt(list_sum(list_transform(x, lambda b: b * b))) + 1e-8)) AS x, list_transform(c, lambda a: a / (sqrt(list_sum(list_transform(c, lambda b: b * b))) + 1e-8)) AS c FROM d JOIN vec ON vec_id = doc_id),
f AS (SELECT doc_id, list_concat(x, c) AS v FROM u), g AS (SELECT doc_id, list_transform(v, lambda a: a / (sqrt(list_sum(list_transform(v, lambda b: b * b))) + 1e-8)) AS v FROM f)
SELECT doc_id, len(v)::INT AS n, round(v[1], 6) AS first, round(v[65], 6) AS second, round(list_sum(v), 5) AS total FROM g""")
def i34_embed(spark, sf):
    """Descriptors of each text fused with the precomputed vector of its number."""
    known = vectors(spark, sf).select(F.col("vec_id").alias("doc_id"), F.col("x").alias("vector"))
    out = pipelines.embed(sequences(spark, sf), "doc_id", "s", known, ("composition",))
    total = F.round(F.aggregate("fused", F.lit(0.0), lambda a, x: a + x), 5)
    return out.select("doc_id", F.size("fused").alias("n"), F.round(F.col("fused")[0], 6).alias("first"), F.round(F.col("fused")[64], 6).alias("second"), total.alias("total"))
