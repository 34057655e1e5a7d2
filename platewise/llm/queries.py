"""The registered queries of this subpackage."""

from __future__ import annotations

from .decontam import op2_decontamination
from .fingerprint import op4_fingerprints
from .html import op1_html_extraction
from .langid import op9_language_id
from .licenses import PHRASES, TEMPLATES, class_of, need_of, op13_licenses, words_of
from .mixing import op3_mixing
from .phrases import op11_collocations
from .pii import op10_pii
from .repair import op12_conversation_repair
from .simhash import op5_simhash
from .substring import op7_substring_dedup
from .tokens import op8_token_counts
from .toxicity import op6_toxicity


#: Windows of fifty words by their hash, the smallest doc_id of each, and the words that no window of a smaller one covers.
SUBSTRING_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), starts AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(ws, i, i + 49), ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM words WHERE len(ws) >= 50)
), firsts AS (
  SELECT h, min(doc_id) AS m FROM starts GROUP BY h
), gone AS (
  SELECT doc_id, list(DISTINCT p) AS ps
  FROM (SELECT s.doc_id, unnest(range(s.i, s.i + 50)) AS p FROM starts s JOIN firsts f ON s.h = f.h WHERE f.m < s.doc_id)
  GROUP BY doc_id
), kept AS (
  SELECT w.doc_id, coalesce(string_agg(w.word, ' ' ORDER BY w.p), '') AS k
  FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM words) w
  LEFT JOIN (SELECT doc_id, unnest(ps) AS p FROM gone) g ON g.doc_id = w.doc_id AND g.p = w.p
  WHERE g.p IS NULL GROUP BY w.doc_id
)
SELECT words.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM words LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


#: Words, the level that fills the targets, and copies by the running number of each document in its source.
MIXING_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, sha256(coalesce(text, '')) AS content FROM documents
), placed AS (
  SELECT doc_id, source, size, substr(sha256(concat('20|', coalesce(doc_id::VARCHAR, ''), '|', size::VARCHAR, '|', content)), 1, 16) AS tie,
    length(bin(size)) * 64 + (size >> greatest(length(bin(size)) - 6, 0)) AS bin
  FROM sized
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT source, source_size, source_size * 2.0::DOUBLE AS ceiling, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w FROM per
), levels AS (
  SELECT *, ceiling / w AS ratio,
    (sum(source_size) OVER () * 1.5::DOUBLE - (sum(ceiling) OVER o - ceiling)) / (sum(w) OVER () - (sum(w) OVER o - w)) AS level
  FROM weighed WINDOW o AS (ORDER BY ceiling / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)
), filled AS (
  SELECT source, source_size, least(ceiling, w * (SELECT max(level) FROM levels WHERE level <= ratio)) AS target FROM levels
), drawn AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
    list_sum(list_transform(range(1, 6), lambda k: (instr('0123456789abcdef', substr(h, k::INT, 1)) - 1) * (16 ** (5 - k)))) / 1048576.0::DOUBLE AS o
  FROM (SELECT *, sha256(concat('20|offset|', coalesce('=' || source, ''))) AS h FROM filled)
), counted AS (
  SELECT p.doc_id, p.size, d.source_size, d.target, d.rate, d.o, row_number() OVER (PARTITION BY p.source ORDER BY p.bin, p.tie) AS k
  FROM placed p JOIN drawn d ON p.source IS NOT DISTINCT FROM d.source
)
SELECT doc_id, size, source_size, target, (least(floor(o + k * rate) - floor(o + (k - 1) * rate), ceil(rate)) * size)::BIGINT AS taken FROM counted
"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Every phrase listed by itself, counted, cut at each place, and compared with each longer candidate that holds it.
COLLOCATIONS_SQL = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS piece, * FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(LOWERED, '[.,;:!?\x0A-\x0D]')) AS text FROM documents)
), words AS (
  SELECT piece, lang, unnest(ws) AS w1, unnest(range(len(ws))) AS i FROM (SELECT piece, lang, regexp_extract_all(text, '[^\x20\x09]+') AS ws FROM pieces)
), leads AS (
  SELECT lang, w1, lead(w1, 1) OVER o AS w2, lead(w1, 2) OVER o AS w3, lead(w1, 3) OVER o AS w4 FROM words WINDOW o AS (PARTITION BY piece ORDER BY i)
), totals AS (
  SELECT lang, count(*) AS n FROM words GROUP BY lang
), listed AS (
  SELECT lang, 1 AS k, w1 AS p FROM leads UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM leads WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM leads WHERE w3 IS NOT NULL UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM leads WHERE w4 IS NOT NULL
), counted AS (
  SELECT lang, k, p, string_split(p, ' ') AS ws, f FROM (SELECT lang, k, p, count(*) AS f FROM listed GROUP BY ALL HAVING count(*) >= 30)
), cut_ AS (
  SELECT lang, k, p, f, x.cut, array_to_string(list_slice(ws, 1, x.cut), ' ') AS p1, array_to_string(list_slice(ws, x.cut + 1, k), ' ') AS p2 FROM counted JOIN (VALUES (1), (2), (3)) x(cut) ON x.cut < k
), cuts AS (
  SELECT c.lang, c.p, c.f AS a, cut, l.f AS l, r.f AS r, (2000000 * c.f::HUGEINT // (l.f + r.f))::BIGINT AS score
  FROM cut_ c JOIN counted l ON l.lang = c.lang AND l.p = p1 JOIN counted r ON r.lang = c.lang AND r.p = p2
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1
), inner_ AS (
  SELECT lang, f, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS p
  FROM counted, (VALUES (1, 2), (2, 2), (3, 2), (1, 3), (2, 3)) t(i, n) WHERE n < k AND i + n - 1 <= k
), gone AS (
  SELECT DISTINCT c.lang, c.p FROM counted c JOIN inner_ i ON c.lang = i.lang AND c.p = i.p WHERE 100 * i.f::HUGEINT >= 80 * c.f::HUGEINT
), ranked AS (
  SELECT lang, p AS phrase, a, l, r, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank FROM best ANTI JOIN gone USING (lang, p)
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
""".replace("LOWERED", _LOWER)


def _license_sql() -> str:
    """Places of the phrases, and templates counted in every block that holds any of their words."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = []
    for k, (label, text) in enumerate(TEMPLATES):
        words = words_of(text)
        own = sorted(set(words))
        rows.append(f"({k}, {quoted(label)}, {class_of(len(words))}, {need_of(len(own))}, [{', '.join(map(quoted, own))}])")
    hits = []
    for phrase, label in PHRASES.items():
        same = " AND ".join(f"ws[i + {k}] = {quoted(w)}" for k, w in enumerate(phrase.split()))
        hits.append(f"SELECT r, {quoted(label)} AS label, i - 1 AS place FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM words) WHERE {same}")
    return f"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents
), base AS (
  SELECT r, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list_sort(list(DISTINCT label)) AS labels
  FROM ({' UNION ALL '.join(hits)}) GROUP BY r
), templates(k, label, c, need, own) AS (VALUES {', '.join(rows)}),
placed AS (
  SELECT r, unnest(ws) AS word, unnest(range(0, len(ws))) AS p FROM words
), held AS (
  SELECT r, k, label, c, need, len(own) AS n, own, word, unnest([p // c, p // c - 1]) AS b
  FROM placed JOIN (SELECT *, unnest(own) AS word FROM templates) USING (word)
), met AS (
  SELECT r, c, b, k, label, own, count(DISTINCT word) / n::DOUBLE AS share FROM held WHERE b >= 0
  GROUP BY r, c, b, k, label, own, need, n HAVING count(DISTINCT word) >= need
), kept AS (
  SELECT * FROM met x WHERE NOT EXISTS (
    SELECT 1 FROM met y WHERE y.r = x.r AND y.c = x.c AND y.b = x.b
    AND ((list_has_all(y.own, x.own) AND len(y.own) > len(x.own) AND y.share >= x.share) OR (list_has_all(x.own, y.own) AND len(x.own) > len(y.own) AND y.share > x.share)))
), noticed AS (
  SELECT r, list(DISTINCT label) AS labels, max(share) AS score FROM kept GROUP BY r
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(array_to_string(base.labels, ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(noticed.labels, [])))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(noticed.score, 0.0) END::DOUBLE AS score
FROM words LEFT JOIN base USING (r) LEFT JOIN noticed USING (r)
"""


def _repair_sql() -> str:
    """The cheapest edits by going through each conversation turn by turn, with the best cost and audit of the four role structures."""
    step = lambda x, cost, label: f"(lpad((left({x}, 9)::INT + {cost})::VARCHAR, 9, '0') || substr({x}, 10) || '{label}')"
    more = "CASE WHEN mark = 't' THEN 5 ELSE 0 END"
    free = "mark NOT IN ('b', 'd')"
    kept = lambda x, initial: f"CASE WHEN {free} AND initial = '{initial}' THEN {step(x, more, 'K')} END"
    wrote = lambda x: f"CASE WHEN {free} THEN {step(x, '1 + ' + more, 'R')} END"
    inserted = f"least(s2, {step('s0', 5, 'I')}, {step('s1', 5, 'I')}, {step('s3', 5, 'I')})"
    third = f"least(s3, {step(inserted, 5, 'I')})"
    to_user = ", ".join([kept(x, "u") for x in ("s0", "s1", "t3")] + [wrote(x) for x in ("s0", "s1", "t3")])
    return f"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' ')) AS s FROM conversations
), crc AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(s, ''), lambda c: ord(c)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS harm FROM raw
), damaged AS (
  SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
    CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(0, CASE WHEN harm = 3 THEN 2 ELSE 1 END)) AS time
  FROM crc WHERE harm <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(concat(length(role), ':', role, text))) AS i FROM damaged
), marked AS (
  SELECT *, left(role, 1) AS initial, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE '-' END AS mark FROM placed
), counts AS (
  SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) AS n, count(*) FILTER (mark = 'b') AS blank, count(*) FILTER (mark = 'd') AS duplicate, count(*) FILTER (mark = 't') AS truncated
  FROM marked GROUP BY conv_id
), near AS (
  SELECT conv_id, count(*) FILTER (i > 1 AND concat(before, initial) NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT conv_id, i, initial, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM marked) GROUP BY conv_id
), walk AS (
  SELECT conv_id, 0::BIGINT AS i, '000000000' AS s0, NULL::VARCHAR AS s1, NULL::VARCHAR AS s2, NULL::VARCHAR AS s3 FROM counts
  UNION ALL
  SELECT conv_id, i, {step('s0', 2, 'D')}, least({step('s1', 2, 'D')}, {kept('s0', 's')}), least({step('t2', 2, 'D')}, {to_user}), least({step('t3', 2, 'D')}, {kept('t2', 'a')}, {wrote('t2')})
  FROM (SELECT m.conv_id, m.i, m.initial, m.mark, s0, s1, {inserted} AS t2, {third} AS t3 FROM walk w JOIN marked m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.i = w.i + 1)
), ended AS (
  SELECT w.conv_id, least(s0, {third}) AS best FROM walk w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.i
), steps AS (
  SELECT conv_id, unnest(string_split(substr(best, 10), '')) AS step, unnest(range(1, length(best) - 8)) AS j FROM ended WHERE length(best) > 9
), numbered AS (
  SELECT *, count(*) FILTER (step <> 'I') OVER w AS i, count(*) FILTER (step <> 'D') OVER w AS o FROM steps WINDOW w AS (PARTITION BY conv_id ORDER BY j)
), written AS (
  SELECT n.conv_id, j, step, o, role, text, max(CASE WHEN o = 1 AND step = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY n.conv_id) AS first_
  FROM numbered n LEFT JOIN marked m ON m.conv_id IS NOT DISTINCT FROM n.conv_id AND m.i = n.i AND step <> 'I' WHERE step <> 'D'
), lines AS (
  SELECT conv_id, string_agg(concat(CASE WHEN step = 'K' THEN role WHEN (o - first_) % 2 = 1 THEN 'user' ELSE 'assistant' END, ':', CASE WHEN step = 'I' THEN '' ELSE text END), chr(10) ORDER BY j) AS repaired
  FROM written GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(left(best, 9)::BIGINT, 0) AS cost, coalesce(substr(best, 10), '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN near n ON n.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN lines l ON l.conv_id IS NOT DISTINCT FROM o.conv_id
"""


def queries() -> dict:
    found = (
        op1_html_extraction, op2_decontamination, op3_mixing, op4_fingerprints, op5_simhash, op6_toxicity, op7_substring_dedup, op8_token_counts, op9_language_id, op10_pii,
        op11_collocations, op12_conversation_repair, op13_licenses,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_mixing": MIXING_SQL,
        "op7_substring_dedup": SUBSTRING_SQL,
        "op11_collocations": COLLOCATIONS_SQL,
        "op12_conversation_repair": _repair_sql(),
        "op13_licenses": _license_sql(),
    }
