"""Phrases, conversation repair and license scans against plain versions, and added personal-data spans against every start and length."""

import hashlib
import random
import zlib
from collections import Counter
from itertools import product

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from platewise.llm import licenses, phrases, pii, queries, repair
from platewise.llm.words import byte_kinds, in_byte_slices, split


def docs_of(spark, rows, schema="doc_id long, text string, lang string"):
    return spark.createDataFrame(rows, schema)


# words


def test_words_are_cut_by_bytes_and_texts():
    kinds = byte_kinds(b" \t", b".\n")
    texts = pa.array(["Ab c", None, "", "d.É f", "g", "\n h"])
    w = split(texts, kinds)
    assert w.distinct.take(pa.array(w.code)).to_pylist() == ["ab", "c", "d", "É", "f", "g", "h"]
    assert w.text.tolist() == [0, 0, 3, 3, 3, 4, 5]
    assert w.next_to().tolist() == [True, False, False, True, False, False]
    part = split(texts.slice(3, 2), kinds)
    assert part.distinct.to_pylist() == ["d", "É", "f", "g"]
    assert len(split(pa.array([], pa.string()), kinds).code) == 0 and len(split(pa.array([None, ""], pa.string()), kinds).code) == 0


def test_slices_hold_whole_texts():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * k for k in (5, 50, 1, 1, 1, 9)])], ["text"])
    assert [s.num_rows for s in in_byte_slices([batch], 0, 10)] == [1, 1, 3, 1]


# op11


def plain_collocations(rows, least, top, share):
    import re

    counts, totals = {}, Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for n in (1, 2, 3, 4):
                for i in range(len(words) - n + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + n])] += 1
    out = []
    for lang, f in counts.items():
        found = []
        cand = [p for p in f if len(p) > 1 and f[p] >= least]
        for p in cand:
            longer = [q for q in cand if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * f[q] >= share * f[p] for q in longer):
                continue
            score, k = min((2_000_000 * f[p] // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -f[p], " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for r, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, r, p.decode(), -a, left, right, totals[lang], -s))
    return sorted(out)


def listed(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("bits", [14, 27])  # 14: a filter with many wrong marks
def test_collocations_equal_plain_counts(spark, bits):
    r = random.Random(5)
    vocabulary = ["the", "of", "New", "new", "york", "york", "city", "é", "Éa", "x" * 40, "a"]
    rows = [(i, "".join(r.choice(vocabulary) + r.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "!? "]) for _ in range(r.randrange(80))), r.choice(["en", "fr", None])) for i in range(600)]
    rows += [(0, None, "en"), (None, "", None), (7, "new york city hall " * 40, "en"), (7, "new york city hall " * 40, "en"), (8, "a " * 5000, "de"), (9, ". , ;", "zz")]
    got = listed(phrases.collocations(docs_of(spark, rows), 30, 12, 80, bits))
    assert got == plain_collocations(rows, 30, 12, 80) and len(got) > 20 and sum(len(x[2].split()) > 2 for x in got) > 2


def test_collocations_of_nothing_and_of_clashing_names(spark):
    empty = docs_of(spark, [])
    assert phrases.collocations(empty).count() == 0
    rows = docs_of(spark, [(1, "big deal. " * 40, None)]).withColumns({c: F.lit("x") for c in ("w1", "n", "f", "g", "size", "phrase", "rank", "l", "r", "score", "salt", "words")})
    assert listed(phrases.collocations(rows)) == [("und", 1, "big deal", 40, 40, 40, 80, 1_000_000)]
    assert phrases.collocations(docs_of(spark, [(1, "big deal. " * 29, None)])).count() == 0


def test_counts_beyond_64_bits(spark):
    """2,000,000 times a count passes 64 bits."""
    big = 10**17
    rows = [("en", ["a", "b"], "a b", 2, big), ("en", ["a"], "a", 1, big + 1), ("en", ["b"], "b", 1, 3 * big)]
    counts = spark.createDataFrame(rows, "lang string, words array<string>, phrase string, size int, f long")
    assert [(r.score, r.l, r.r) for r in phrases.scored(counts).collect()] == [(2_000_000 * big // (4 * big + 1), big + 1, 3 * big)]


# op12


def plain_repair(turns):
    """Counts, cost, audit and digest of ordered (turn, role, text) by dynamic programming over (turns read, structure)."""
    seen, marks = set(), []
    for _, role, text in turns:
        body = text.strip(" \t\n\x0b\x0c\r")
        marks.append("b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "-")
        seen.add((role, text))
    initials = [r[:1] or " " for _, r, _ in turns]
    best = {0: (0, "", ())}
    writes, keeps, role_of = (2, 2, 3, 2), ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}), ("user", "user", "assistant", "user")

    def inserted(states):
        for _ in range(3):
            new = dict(states)
            for q, (c, a, lines) in states.items():
                z = writes[q]
                way = (c + 5, a + "I", (*lines, f"{role_of[q]}:"))
                if z not in new or way < new[z]:
                    new[z] = way
            states = new
        return states

    for (_, role, text), g, mark in zip(turns, initials, marks):
        new = {}
        for q, (c, a, lines) in inserted(best).items():
            steps = [(q, c + 2, "D", lines)]
            if mark not in "bd":
                more = 5 if mark == "t" else 0
                if g in keeps[q]:
                    steps.append((keeps[q][g], c + more, "K", (*lines, f"{role}:{text}")))
                steps.append((writes[q], c + 1 + more, "R", (*lines, f"{role_of[q]}:{text}")))
            for z, cost, x, lines_ in steps:
                way = (cost, a + x, lines_)
                if z not in new or way < new[z]:
                    new[z] = way
        best = new
    cost, audit, lines = min(v for q, v in inserted(best).items() if q in (0, 3))
    known = [t for t, _, _ in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:]))
    return gaps, marks.count("b"), marks.count("d"), marks.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def plain_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        harm = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if harm == 1 else text.replace(".", "").replace("!", "").replace("?", "") if harm == 2 else text
        out[conv] += [(turn, "user" if harm == 4 else role, text)] * (0 if harm == 0 else 2 if harm == 3 else 1)
    key = lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.md5(f"{len(x[1])}:{x[1]}{x[2]}".encode()).digest())
    return {c: plain_repair(sorted(t, key=key)) for c, t in out.items()}


def conversations(seed, n):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(r.choice([1, 2, 3, 5, 9, 30])):
            role = r.choice(["user", "assistant"] * 4 + ["system", None, "tool", ""])
            text = r.choice(["Hello there.", "What? ", "no end", "", "  ", None, "Ok!\n", "long " * 50 + ".", f"turn {t}."])
            rows.append((c if c else None, r.choice([t] * 9 + [None, t + 3, 0]), role, text))
    return rows


@pytest.mark.parametrize("most", [2, 5, 1024])  # turns of a segment
def test_repair_equals_dynamic_programming(spark, most):
    rows = conversations(11, 60)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair(df, most).collect()}
    assert got == plain_damage(rows)


def test_repair_of_every_short_conversation():
    """Both directions of the search, on all sequences of up to five of eight kinds of turns."""
    kinds = [("user", "a."), ("assistant", "b."), ("system", "c."), ("user", "d"), ("assistant", ""), ("tool", "e.")]
    for n in range(1, 5):
        for turns in product(kinds, repeat=n):
            rows = [(i, role, text + ("" if text in ("", "d") else str(i) + ".") if text != "d" else f"d{i}") for i, (role, text) in enumerate(turns)]
            marks = "".join("b" if not t else "t" if t[-1] not in ".!?" else "-" for _, _, t in rows)
            want = plain_repair(rows)
            assert repair.Lattice("".join(r[:1] for _, r, _ in rows), marks, True).way(0, 4) == want[5:7]


def test_repair_of_one_conversation_in_many_tasks(spark):
    rows = [("hot", t, ("user", "assistant")[t % 2], f"text {t}." if t % 7 else "text") for t in range(3000)] + [("cold", 0, "user", "x.")]
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("key", "kept", "part", "digest", "harm", "first", "entry")})
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair(df, 100).collect()}
    assert got == plain_damage(rows)


def test_repair_of_nothing(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert repair.repair(spark.createDataFrame([], schema)).count() == 0
    dropped = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    only = repair.repair(spark.createDataFrame([(5, dropped, "user", "gone.")], schema)).collect()
    assert [tuple(r) for r in only] == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


# op13


def on_duckdb(name, **tables):
    db = duckdb.connect()
    for t, rows in tables.items():
        db.register(t, rows)
    return db.sql(queries.oracle_sql()[name]).fetchall()


def test_licenses_equal_sql(spark):
    r = random.Random(2)
    words = ["the", "of", "license", "licensed", "under", "a", "mit", "MIT", "apache", "general", "public", "version", "2", "0", "é", "x-y", "file"]
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(60))) for _ in range(120)]
    for k, (_, notice) in enumerate(licenses.TEMPLATES):
        own = notice.split()
        texts.append(" ".join(r.choice(words) for _ in range(k)) + " " + "\n".join(own))  # a word a line
        texts.append("pre " * 40 + " ".join(own[: len(own) // 2] + own[len(own) // 2 + 1 :]))  # one word missing
        texts.append(" ".join([*own[:3], "inserted", *own[3:]]).upper())
    texts += [None, "", "---", "mit license mit license", "a " * 30_000 + "Licensed under the Apache License, Version 2.0"]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(3, texts[-2], "en"), (None, texts[-2], None)]
    df = docs_of(spark, rows)
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    got = sorted((tuple(x) for x in licenses.scan_licenses(df).select(names).collect()), key=str)
    want = on_duckdb("op13_licenses", documents=df.toArrow())
    assert got == sorted(want, key=str)
    by_text = {x[0]: x for x in got if x[0] is not None}
    for k, (label, _) in enumerate(licenses.TEMPLATES):
        assert label in by_text[120 + 3 * k][6].split(","), label
    assert by_text[len(texts) - 2][2:7] == (2, 0, 2, "mit", "mit")
    assert by_text[len(texts) - 1][3:7] == (30_003, 30_003, "apache", "apache")


def test_licenses_the_closer_template_stays(spark):
    t = ["Licensed under CC BY 4.0.", "Licensed under CC BY-NC 4.0.", licenses.TEMPLATES[9][1], "nothing here"]
    got = {r.doc_id: (r.base_labels, r.labels, r.score) for r in licenses.scan_licenses(docs_of(spark, [(i, x, None) for i, x in enumerate(t)])).collect()}
    assert got == {0: ("", "cc-by", 1.0), 1: ("", "cc-by-nc", 1.0), 2: ("gpl", "gpl", 1.0), 3: ("", "", 0.0)}


def test_licenses_of_nothing_and_clashing_names(spark):
    empty = docs_of(spark, [])
    assert licenses.scan_licenses(empty).count() == 0
    rows = docs_of(spark, [(1, "the mit license", None)]).withColumns({c: F.lit(1) for c in ("row", "block", "base", "blocks", "word", "more", "most", "labels", "score")})
    assert [(r.n_words, r.labels) for r in licenses.scan_licenses(rows).collect()] == [(3, "mit")]
    assert [(r.n_base, r.labels, r.score) for r in licenses.scan_licenses(rows, []).collect()] == [(1, "mit", 1.0)]


# op10


def every_iban(text):
    """Spans of IBANs by trying every start and every end; leftmost ones count."""
    ok = lambda c: c.isascii() and (c.isdigit() or c.isupper())
    found = []
    for s in range(len(text)):
        if s and text[s - 1].isascii() and text[s - 1].isalnum():
            continue
        for e in range(s + 15, min(len(text), s + 70) + 1):
            t = text[s:e]
            if not (all(ok(c) or c == " " for c in t) and "  " not in t and ok(t[-1]) and ok(t[0]) and " " not in t[:4]):
                continue
            if e < len(text) and text[e].isascii() and text[e].isalnum():
                continue
            if t[:2].isalpha() and t[2:4].isdigit() and pii.mod97(t) and (not found or s >= found[-1][1]):
                found.append((s, e))
                break
    return found


def test_ibans_by_every_start_and_length():
    r = random.Random(4)
    right = ["AT611904300234573201", "ES9121000418450200051332", "GB82WEST12345698765432", "DE89370400440532013000", "NO9386011117947"]
    spaced = [" ".join(x[i : i + 4] for i in range(0, len(x), 4)) for x in right]
    for x in right + spaced:
        for after in (" BANK", " TEST", " 2024", " A1B2 C3D4", ".", "x", "", " x", "\n", "-1"):
            for before in ("", "IBAN ", "DE12 ", "x", "AB12 3456 ", "é"):
                t = before + x + after
                assert list(pii.ibans(t)) == every_iban(t), t
    for _ in range(300):
        t = "".join(r.choice([*right, *spaced, " ", " ", "A", "7", "DE12", "x"]) for _ in range(r.randrange(1, 8)))
        assert list(pii.ibans(t)) == every_iban(t), t


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("AT611904300234573201 BANK", "<IBAN> BANK"),
        ("password: hunter2x and more", "<SECRET> and more"),
        ('{"api_key": "abc123def", "b": 1}', '{"<SECRET>, "b": 1}'),
        ("password: please", "password: please"),
        ("client_secret => 'a1b2c3d4'", "<SECRET>"),
        ("a ghp_" + "a1" * 18 + " b", "a <SECRET> b"),
        ("tel 030 12345678.", "tel <LOCAL_PHONE>."),
        ("year 030 12345678", "year 030 12345678"),
        ("Téléphone: 01 23 45 67 89", "Téléphone: <LOCAL_PHONE>"),
        ("secret=abcdef", "<SECRET>"),
    ],
)
def test_added_spans(text, want):
    assert pii.redact(text, pii.all_spans(text)[1]) == want


def test_two_added_spans_at_one_place():
    t = "login password=078-05-1120 now"
    spans = pii.all_spans(t)[1]
    assert pii.render(spans) == "secret:6:26,ssn:15:26"
    assert pii.redact(t, spans) == "login <SECRET> now"
    assert np.all(np.diff([s for s, _, _ in pii.all_spans("a1@b.org " * 50 + "password=abcdef1 " * 50)[1]]) > 0)


def test_language_blocks_are_bounded_by_strings_times_languages():
    from platewise.llm import langid

    sizes = {(j, b): 50_000 + 1000 * j for j in range(100) for b in (0, 101)}
    blocks = langid.divide(sizes, 100, langid.BLOCK)
    assert [j for names, _, _ in blocks for j in names] == list(range(100)) and len(blocks) > 4
    for names, low, high in blocks:
        assert (low, high) == (0, 255)
        assert sum(sizes[j, b] for j in names for b in (0, 101)) * len(names) <= langid.CELLS
    assert langid.divide({(j, 0): 900_000 for j in range(4)}, 4, langid.BLOCK) == [([0, 1, 2, 3], 0, 255)]
