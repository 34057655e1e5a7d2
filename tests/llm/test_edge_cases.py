"""Nulls, empty and very long texts, ties and repeated rows, empty tables and clashing columns, for every operator and stage; and results against
plain versions of the same rule."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from platewise.llm import common, decontam, fingerprint, html, langid, mixing, pii, simhash, substring, tokens, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for columns of their own, or that their results have.
CLASHES = "part last tie key size row skey bin salt n m h fp node root raw bits score toxic copies copy mix_row grp words first sha word total passage k p y a b x f v at to edge_id bad_id component_id n_tokens block".split()


def docs_of(spark, texts, **columns):
    rows = [(i, t, "en" if i % 2 else "de", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).withColumns({k: F.lit(v) for k, v in columns.items()})


@pytest.fixture(scope="module")
def texts():
    r = random.Random(50)
    word = lambda: "w" + str(r.randrange(80))
    out = [" ".join(word() for _ in range(r.randrange(5, 120))) for _ in range(40)]
    out += [None, "", " \t\n", out[0], out[0], out[1] + " tail", "long " * 60_000 + out[2], "a" * 300_000, "\0 nul \0", "é ñ 漢字 😀"]
    return out


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(40)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark, texts):
    return spark.createDataFrame([(1, texts[3]), (2, None), (3, ""), (4, texts[3])], "item_id long, text string").withColumns({k: F.lit(0) for k in ("part", "n", "word", "doc_id")})


def results(spark, docs, labels, bench):
    """One row-wise result of every operator, as sets of tuples."""
    model = langid.learn(docs)
    lengths = tokens.token_lengths(docs, tokens.default_vocabulary())
    return {
        2: decontam.contaminated(docs, bench),
        3: mixing.mix(docs),
        4: fingerprint.fingerprint_documents(docs),
        5: simhash.near_duplicates(docs),
        6: toxicity.score_documents(docs, toxicity.learn(docs, labels)),
        7: substring.remove_repeats(docs),
        8: lengths,
        9: langid.predict(docs, model),
        10: pii.find_pii(docs),
    }


def test_clashing_columns_change_nothing(spark, texts, labels, bench):
    plain, clashing = docs_of(spark, texts), docs_of(spark, texts, **{c: 1 for c in CLASHES})
    one, two = results(spark, plain, labels, bench), results(spark, clashing, labels, bench)
    for n in one:
        assert one[n].columns == two[n].columns
        rows = [sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in x[n].collect()), key=str) for x in (one, two)]
        assert rows[0] == rows[1] and (n == 2 or len(rows[0]) == len(texts)), n


def test_rows_that_repeat_and_null_ids(spark, texts, labels, bench):
    docs = docs_of(spark, texts)
    twice = docs.unionAll(docs).unionAll(docs.filter("doc_id < 3").withColumn("doc_id", F.lit(None).cast("long")))
    n = 2 * len(texts) + 3
    got = results(spark, twice, labels, bench)
    for k in (3, 4, 5, 6, 7, 8, 9, 10):
        rows = got[k].collect()
        assert len(rows) == n and sum(r.doc_id is None for r in rows) == 3, k
    for k in (6, 9, 10):  # equal rows, equal results
        seen: dict = {}
        for r in got[k].filter("doc_id is not null").collect():
            assert seen.setdefault(r.doc_id, tuple(r)) == tuple(r)
    found = sorted((r.doc_id, r.item_id) for r in got[2].filter("doc_id is not null").collect())
    assert found == sorted([(3, 1), (3, 4)] * 2)


def test_every_stage_keeps_columns_and_clean_rows(spark, texts, labels, bench, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    bench.select("item_id", "text").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = docs_of(spark, texts, **{c: 1 for c in CLASHES if c not in ("toxic",)})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        empty = stage(spark, docs.limit(0), str(tmp_path))
        assert empty.count() == 0 and empty.columns == docs.columns, name
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert mixed.columns == [*docs.columns, "copy_1"]
    nulls = spark.createDataFrame([(None, None, None, None, None), (1, "plain words of one text", None, None, None)], DOCS)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, nulls, str(tmp_path)).count() == 2, name
    assert corpus_pipeline.STAGES[-1][1](spark, nulls, str(tmp_path)).filter("text is not null").count() >= 1


def test_operators_take_pages_of_any_kind(spark):
    page = "<p>one</p><article>" + "<p>a &amp; b</p>" * 3 + "</article>"
    rows = [(1, "http://h/a", page), (1, "http://h/a", page), (None, None, None), (2, "http://h/b", ""), (3, "not a url", "<" * 5000), (4, "http://h/c", "<p>" + "x " * 200_000)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("lines", F.lit(1))).collect()
    assert len(got) == len(rows) and [r.text for r in got if r.page_id == 1] == ["a & b\n\na & b\n\na & b"] * 2
    assert [r.n_chars for r in got if r.page_id == 4] == [len(("x " * 200_000).strip())]


# 4
def test_likeness_is_the_dice_coefficient_of_short_texts(spark):
    r = random.Random(51)
    make = fingerprint.Fingerprinter()
    spans = lambda t: {t[i : i + 24] for i in range(max(1, len(t) - 23))}
    for _ in range(200):
        a = "".join(r.choice("ab c") for _ in range(r.randrange(1, 70)))
        b = "".join(c if r.random() < 0.97 else "x" for c in a) + "".join(r.choice("abc") for _ in range(r.randrange(9)))
        x, y = spans(a), spans(b)
        got = fingerprint.likeness(make(fingerprint.code_points(a))[1], make(fingerprint.code_points(b))[1])
        assert got == pytest.approx(2 * len(x & y) / (len(x) + len(y)))


def test_likeness_of_long_texts_is_near_the_dice_coefficient():
    r = random.Random(52)
    make = fingerprint.Fingerprinter()
    for share in (0.1, 0.5, 0.9):
        a = "".join(r.choice("abcdefgh ") for _ in range(6000))
        b = a[: int(6000 * share)] + "".join(r.choice("abcdefgh ") for _ in range(6000 - int(6000 * share)))
        x, y = ({t[i : i + 24] for i in range(len(t) - 23)} for t in (a, b))
        got = fingerprint.likeness(*(make(fingerprint.code_points(t))[1] for t in (a, b)))
        assert got == pytest.approx(2 * len(x & y) / (len(x) + len(y)), abs=0.12)


# 6
def test_scores_equal_a_plain_count_of_the_lexicon():
    r = random.Random(53)
    lexicon = toxicity.Lexicon({"ab": 2.0, "abc": 3.0, "xyz ": 1.5}, ("good abc", "abx y"), (-1.0, 0.5, 0.25))
    automaton = lexicon.automaton()
    for _ in range(500):
        words = [r.choice(["ab", "abc", "abcd", "abx", "y", "xyz", "xyzz", "good", "q"]) for _ in range(r.randrange(12))]
        total = 0.0
        for k, w in enumerate(words):
            before, after = (words[k - 1] if k else ""), (words[k + 1] if k + 1 < len(words) else "")
            if (w == "abc" and before == "good") or (w == "abx" and after == "y"):
                continue
            total += 3.0 if w.startswith("abc") else 2.0 if w.startswith("ab") else 1.5 if w == "xyz" else 0.0
        a, b = (np.log1p(total), np.log1p(1000 * total / max(50, len(words)))) if total else (0.0, 0.0)
        assert lexicon.score(automaton, " ".join(words)) == pytest.approx(1 / (1 + np.exp(1.0 - 0.5 * a - 0.25 * b)))


# 9
def test_ties_go_to_the_first_language(spark):
    rows = [(0, "abc abc", "zz", "s", 0), (1, "abc abc", "aa", "s", 0), (2, "abc", None, "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    got = langid.predict(docs, langid.learn(docs)).filter("doc_id = 2").first()
    assert got.lang_pred == "aa" and got.score == pytest.approx(0.5)


# 2
def test_a_long_item_has_passages_of_its_own(spark):
    r = random.Random(54)
    words = [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(i, text(20) + ". " + text(5) + ".") for i in range(10)] + [(50, text(900) + ". " + text(9) + ".")]
    texts = [text(400) for _ in range(12)]
    texts[4] += " " + items[3][1]
    texts[7] = text(100) + " " + items[10][1] + " " + text(700)
    found = {(x.doc_id, x.item_id) for x in decontam.contaminated(docs_of(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found == {(4, 3), (7, 50)} and decontam.length_class(25) == 64 and decontam.length_class(909) == 4096


def test_leading_digits_grow_with_the_number(spark):
    rows = spark.range(3000).select("id", common.leading_digits(F.col("id"), 3).alias("d")).orderBy("id").collect()
    d = [x.d for x in rows]
    assert d == sorted(d) and len(set(d[:8])) == 8
