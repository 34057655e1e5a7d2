"""The registry, and the domain tables as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.schema import to_long

REGISTRY: dict[str, tuple] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        REGISTRY[f.__name__] = (f, sql)
        return f

    return add


def table(spark, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
WELLS = """wells AS (SELECT l_orderkey AS ord, l_linenumber AS line, l_linestatus AS source, l_suppkey AS plate, l_partkey AS treatment,
 l_returnflag AS flag, l_quantity AS cells, l_shipdate AS at, [l_quantity, l_extendedprice, nullif(l_discount, 0.0), l_tax] AS features FROM lineitem)"""
LONG = WELLS + """, long AS (SELECT ord, line, source, plate, treatment, flag, unnest([0, 1, 2, 3]) AS f, unnest(features) AS v FROM wells)"""


def wells(spark, sf: str) -> DataFrame:
    discount = F.when(F.col("l_discount") != 0, F.col("l_discount"))
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("ord"),
        F.col("l_linenumber").alias("line"),
        F.col("l_linestatus").alias("source"),
        F.col("l_suppkey").alias("plate"),
        F.col("l_partkey").alias("treatment"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_quantity").alias("cells"),
        F.col("l_shipdate").alias("at"),
        F.array("l_quantity", "l_extendedprice", discount, "l_tax").alias("features"),
    )


def long_wells(spark, sf: str) -> DataFrame:
    return to_long(wells(spark, sf), ["ord", "line", "source", "plate", "treatment", "flag"])


SEQ = "seq AS (SELECT doc_id, lang, source, upper(regexp_replace(text, '[^ACDEFGHIKLMNPQRSTVWYacdefghiklmnpqrstvwy]', '', 'g')) AS s FROM documents)"


def sequences(spark, sf: str) -> DataFrame:
    letters = F.regexp_replace("text", "[^ACDEFGHIKLMNPQRSTVWYacdefghiklmnpqrstvwy]", "")
    return table(spark, sf, "documents").select("doc_id", "lang", "source", F.upper(letters).alias("s"))


VEC = "vec AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings)"


def vectors(spark, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


PRED = VEC + """, pred AS (SELECT a.vec_id AS sample, a.label AS task, unnest(range(64)) AS f, unnest(a.x) AS pred, unnest(b.x) AS target
 FROM vec a JOIN vec b ON b.vec_id = a.vec_id + 1)"""


def predictions(spark, sf: str) -> DataFrame:
    """Each vector as the prediction of the next one."""
    v = vectors(spark, sf)
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y"))
    pairs = v.join(nxt, "vec_id").select("vec_id", "label", F.posexplode(F.arrays_zip("x", "y")).alias("f", "p"))
    return pairs.select(F.col("vec_id").alias("sample"), F.col("label").alias("task"), "f", F.col("p.x").alias("pred"), F.col("p.y").alias("target"))


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def uniform_sql(*parts: str) -> str:
    """``hash_uniform`` in SQL, of expressions."""
    text = " || '|' || ".join(f"({p})::VARCHAR" for p in parts)
    return f"(('0x' || substr(sha256({text}), 1, 13))::BIGINT / 4503599627370496.0)"


def picks_sql(source: str, first: str, following: str, n: int, update: str = "least(d, dist)", start: str = "'infinity'::DOUBLE") -> str:
    """Greedy picks of ``n`` rows from the table expression ``source`` (vec_id, x, u): the first by ``first``, later ones by ``following`` (``{k}``:
    the number of picks so far), after ``d`` of every candidate is updated by its distance ``dist`` to the last pick; ties to the smaller vec_id."""
    parts = [f"c0 AS MATERIALIZED (SELECT vec_id, x, u, {start} AS d FROM ({source}))", f"p1 AS MATERIALIZED (SELECT vec_id, x, u, d FROM c0 ORDER BY {first} DESC, vec_id LIMIT 1)"]
    for k in range(1, n):
        parts.append(f"c{k} AS MATERIALIZED (SELECT vec_id, x, u, {update} AS d FROM (SELECT c.*, list_distance(c.x, p.x) AS dist FROM c{k - 1} c, p{k} p WHERE c.vec_id <> p.vec_id))")
        parts.append(f"p{k + 1} AS MATERIALIZED (SELECT vec_id, x, u, d FROM c{k}, (SELECT min(d) AS lo, max(d) AS hi FROM c{k}) ORDER BY {following.format(k=k)} DESC, vec_id LIMIT 1)")
    return ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT {k} AS rank, vec_id FROM p{k}" for k in range(1, n + 1))
