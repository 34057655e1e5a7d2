"""The pipeline's stages on a small corpus with planted cases."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    text = lambda n=80: " ".join(r.choice(words) for _ in range(n))
    rows = [(i, text(), "en", "ab"[i % 2], 0) for i in range(120)]
    labels = []
    for i in range(0, 60, 4):
        t = rows[i][1].split()
        for w in ("grumbold", "snarkel"):
            t.insert(r.randrange(len(t)), w)
        rows[i] = (i, " ".join(t), "en", "a", 0)
    labels = [(i, 1, int(i % 4 == 0)) for i in range(60)]
    item = text(20) + ". " + text(5) + "."
    rows += [(200, rows[61][1], "en", "a", 0), (201, text() + " " + item, "en", "b", 0), (202, text() + " me@x.org", "en", "b", 0), (203, None, "en", "b", 0), (204, "", "en", None, 0)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_take_effect(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    toxic = {i for i in range(0, 60, 4)}
    want = set(range(120)) - toxic | {200, 201, 202, 203, 204}
    for (name, stage), gone in zip(corpus_pipeline.STAGES, [set(), {200, 204}, {201}, set()]):
        docs = stage(spark, docs, corpus)
        want -= gone
        assert docs.columns == [c.split()[0] for c in DOCS.split(", ")], name
        assert {r.doc_id for r in docs.collect()} == want, name
    redacted = docs.filter("doc_id = 202").first()
    assert redacted.text.endswith("<EMAIL>") and redacted.n_chars == len(redacted.text)
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, corpus)
    assert "copy" in mixed.columns and {r.doc_id for r in mixed.collect()} <= want


def test_run_agrees_with_itself(spark, corpus):
    one, two = (sorted((r.doc_id, r.copy) for r in corpus_pipeline.run(spark, corpus).select("doc_id", "copy").collect()) for _ in range(2))
    assert one == two and len(one) > 100


def test_empty_corpus(spark, corpus, tmp_path):
    docs = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, corpus)
    assert docs.count() == 0 and F is not None
