"""Cases in which an earlier version did less than the whole job."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from platewise.llm import decontam, pii, simhash, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


# pipeline, near copies
def brute_kept(texts):
    """Smallest number of each group of texts whose five-word shingles have a similarity of 0.8 or more."""

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if 9 * len(a & b) >= 4 * (len(a) + len(b)):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {find(i) for i in range(len(texts))}


def test_pipeline_drops_near_copies(spark):
    r = random.Random(20)
    words = [f"w{i}" for i in range(500)]
    base = [[r.choice(words) for _ in range(r.randrange(30, 200))] for _ in range(40)]
    notice = [r.choice(words) for _ in range(15)]
    texts = [" ".join(b + notice) for b in base]
    for k, b in enumerate(base):
        for step in range(1, 6):  # up to five changed words, so similarities on both sides of 0.8
            w = list(b + notice)
            for at in r.sample(range(len(w)), min(step, len(w) // 12 + 1) if k % 2 else step):
                w[at] = "new"
            texts.append(" ".join(w))
    texts += [None, "", "one two", "ONE  two", "one three"]
    docs = docs_of(spark, texts)
    want = brute_kept(texts)
    got = {x.doc_id for x in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert got == want and len(want) < len(texts) - 60
    assert simhash.keep_one(docs).count() > len(want) + 60  # op5's contract: at most two bits
    same = docs.withColumn("doc_id", F.when(F.col("doc_id") == 1, None).otherwise(F.col("doc_id")))
    assert corpus_pipeline.drop_near_duplicates(spark, same, "").filter("doc_id is null").count() == 1


# 6
def test_copies_of_a_toxic_text_do_not_empty_the_lexicon(spark):
    r = random.Random(21)
    texts = []
    for i in range(300):
        words = [f"w{r.randrange(60)}" for _ in range(40)]
        for w in ("grumbold", "snarkel") if i % 5 == 0 else ():
            words.insert(r.randrange(40), w)
        texts.append(" ".join(words))
    labels = [(i, 1, int(i % 5 == 0 or i >= 300)) for i in range(900)]
    texts += [texts[0]] * 600
    docs = docs_of(spark, texts)
    lexicon = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert all(k[:3] in ("gru", "sna") for k in lexicon.weights)
    assert {x.doc_id for x in toxicity.keep_clean(docs, lexicon).collect()} == {i for i, _, y in labels if not y}

# 2
def test_passes_do_not_change_scores(spark):
    r = random.Random(22)
    word = lambda k: f"w{int(r.random() ** 2 * k)}"
    items = [(i, " ".join(word(80) for _ in range(10 + i)) + ". " + " ".join(word(80) for _ in range(4)) + ".") for i in range(24)]
    bench = spark.createDataFrame([*items, (90, None), (91, " ... ")], "item_id long, text string")
    texts = [" ".join(word(80) for _ in range(60)) for _ in range(30)]
    for d in range(0, 30, 2):
        texts[d] += " " + items[d % 24][1] + " " + texts[1]
        texts[d + 1] += " other " + " ".join(items[(d + 5) % 24][1].split()[1:])  # one word missing, so the score depends on weights
    docs = docs_of(spark, texts)
    one, many = (sorted(tuple(x) for x in decontam.contaminated(docs, bench, items=k).collect()) for k in (100, 5))
    assert len(one) > 15 and [x[:2] for x in one] == [x[:2] for x in many]
    for x, y in zip(one, many):
        assert x[2:] == pytest.approx(y[2:])


# 10
def test_letters_only_key_is_found_alone(spark):
    key = "AKIA" + "QWERTYUIOPASDFGH"
    got = {x.doc_id: x.spans for x in pii.find_pii(docs_of(spark, [f"the {key} stands alone", f"{key} and a@b.org"])).collect()}
    assert got == {0: "secret:4:24", 1: "secret:0:20,email:25:32"}
    assert pii.redact_documents(docs_of(spark, [f"the {key} stands alone"])).first().text == "the <SECRET> stands alone"


def test_long_secrets_go_whole(spark):
    t = "a password=" + "x" * 300 + " b secret=short7 c"
    assert pii.redact_documents(docs_of(spark, [t])).first().text == "a <SECRET> b <SECRET> c"


def test_iban_lengths(spark):
    right, short = "DE89370400440532013000", "NO9386011117947"
    assert pii.mod97(right) and pii.mod97(short) and not pii.mod97(right[:-1]) and not pii.mod97("ZZ" + right[2:])
    got = pii.find_pii(docs_of(spark, [f"iban {right}", f"iban {right}0", None, "x" * 300_000 + " " + short])).collect()
    assert [x.spans for x in sorted(got)] == ["iban:5:27", "", "", "iban:300001:300016"]


def test_repeated_and_null_rows(spark):
    docs = spark.createDataFrame([(1, "a@b.de", "en", "s", 0), (1, "a@b.de", "en", "s", 0), (None, None, None, None, None)], DOCS).withColumn("spans", F.lit(1)).withColumn("n_ip", F.lit(2))
    assert sorted((str(x.doc_id), x.n_email, x.spans) for x in pii.find_pii(docs).collect()) == [("1", 1, "email:0:6"), ("1", 1, "email:0:6"), ("None", 0, "")]
    assert pii.redact_documents(docs).columns == docs.columns
