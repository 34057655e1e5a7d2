"""Personal data: regular expressions propose, checksums confirm, context adjusts.

Regular expressions propose spans; validators confirm them (Luhn for cards, mod-97 for IBANs,
octet and length ranges, area rules for social-security numbers); words near a span move its
score. The four base kinds (email, ip, card, phone) are reported whenever their validator
passes. Further kinds (IBAN, national phone numbers, social-security numbers, access keys and
passwords) are reported when the score, raised or lowered by context, reaches the threshold. An IBAN is tried at every place where a country and two
digits stand, with the country's length; national numbers without a fixed shape count only beside a word such as "phone".

Defined results: null text is empty text; empty texts have no spans; matching is linear in the
text's length, and a task holds a slice of texts with their spans; spans of different kinds may lie at one place and are all listed; equal rows give equal rows; further columns
of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import in_slices

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "local_phone", "secret")
THRESHOLD = 0.5

_LOCAL_PART = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Possessive and anchored at the start of a digit run: same matches as the plain form, in linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}")
_IBAN_REST = re.compile(r"(?:\x20?[A-Z0-9])*")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9-])")
#: Numbers of other national shapes: a trunk zero and groups of digits.
_TRUNK_PHONE = re.compile(r"(?<![0-9A-Za-z+.,/-])\(?0[0-9]{1,4}\)?(?:[\x20./-]{1,2}[0-9]{2,8}){1,5}(?![0-9A-Za-z]|[.,/-][0-9])")
_NAME = r"(?:password|passwd|passphrase|pwd|api[_-]?key|secret(?:[_-]?key)?|client[_-]?secret|access[_-]?(?:key|token)|auth[_-]?token|private[_-]?key)"
_SECRET = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}(?![A-Za-z0-9])|(?:password|api_key|secret)=[^\s]{6,})")
#: Written-out pairs of name and value, and keys that tell what they are.
_PAIR = re.compile(r"(?<![A-Za-z0-9])" + _NAME + r"[\"']?\x20?(?:=>|:=|=|:)\x20?(?:\"([^\"\s]{6,})\"|'([^'\s]{6,})'|([^\s\"',;]{6,}))", re.IGNORECASE)
_TOKEN = re.compile(r"(?<![A-Za-z0-9])(?:ASIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[0-9A-Za-z-]{20,}|AIza[0-9A-Za-z_-]{35}|eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})(?![A-Za-z0-9])")
_HINT = re.compile(r"[0-9=]|AKIA|ASIA|gh[pousr]_|eyJ")
_DIGIT = re.compile(r"[0-9]")

# Length of an IBAN by country, from the public IBAN registry.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24,
    "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28,
    "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20,
    "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26,
    "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
#: Texts that a task works on at a time.
ROWS = 256

#: Words that raise or lower the score of a span when they stand within 40 characters of it.
CONTEXT = {
    "iban": (("iban", "account", "bank", "payment", "transfer", "konto", "bankverbindung", "cuenta", "compte", "virement"), ("example", "sample", "beispiel", "exemple", "ejemplo")),
    "ssn": (("ssn", "social", "security", "insurance", "taxpayer", "sozialversicherung", "seguridad"), ("part", "serial", "order", "item", "invoice", "model")),
    "local_phone": (
        ("phone", "telephone", "tel", "call", "mobile", "cell", "fax", "contact", "hotline", "telefon", "mobil", "anruf", "téléphone", "teléfono", "móvil", "portable"),
        ("isbn", "serial", "order", "version", "invoice", "page", "pages", "doi"),
    ),
    "secret": (("key", "password", "token", "secret", "login", "credentials", "passwort", "contraseña"), ("example", "placeholder", "changeme", "dummy")),
}
_CONTEXT_RE = {k: tuple(re.compile(r"\b(?:" + "|".join(w) + r")\b", re.IGNORECASE) for w in v) for k, v in CONTEXT.items()}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Whether an IBAN has its country's length and its check digits."""
    s = iban.replace(" ", "")
    return len(s) == IBAN_LENGTHS.get(s[:2]) and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def emails(text: str):
    """Spans of the email expression. Each @ is extended to the left, so long runs cost no retries."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL_PART.match(text, start - 1):
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the four base kinds."""
    found = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(q := p.lstrip("0")) <= 3 and int(q or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "") if m.end() - m.start() < 64 else ""
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((m.start(), 3, m.end()))
    return found


def context_score(text: str, kind: str, start: int, end: int, prior: float, width: int = 40) -> float:
    near = text[max(0, start - width) : start] + " " + text[end : end + width]
    good, bad = _CONTEXT_RE[kind]
    return prior + 0.3 * bool(good.search(near)) - 0.4 * bool(bad.search(near))


def ibans(text: str):
    """Spans of IBANs: at every country and two digits as many letters and digits as the country's have, with single blanks between."""
    end = 0
    for m in _IBAN.finditer(text):
        size = IBAN_LENGTHS.get(m[0][:2])
        if size is None or m.start() < end:
            continue
        rest = _IBAN_REST.match(text, m.end(), m.end() + 2 * size)[0]
        held = at = 0
        while at < len(rest) and held < size - 4:
            held += rest[at] != " "
            at += 1
        stop = m.end() + at
        if held == size - 4 and not (stop < len(text) and text[stop].isascii() and text[stop].isalnum()) and mod97(text[m.start() : stop]):
            end = stop
            yield m.start(), stop


def _matched(pattern):
    return lambda text: ((m.start(), m.end()) for m in pattern.finditer(text))


def pairs(text: str):
    """Spans of names with values that look like secrets: no plain word or plain number."""
    for m in _PAIR.finditer(text):
        value = m[1] or m[2] or m[3]
        if any(c.isdigit() for c in value) and any(not c.isdigit() for c in value):
            yield m.start(), m.end()


def trunk_phones(text: str):
    for m in _TRUNK_PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 12:
            yield m.start(), m.end()


def ssns(text: str):
    for m in _SSN.finditer(text):
        area, group, serial = m[0].split("-")
        if area not in ("000", "666") and area[0] != "9" and group != "00" and serial != "0000":
            yield m.start(), m.end()


#: What proposes spans of a kind, and the score that it starts from.
PROPOSALS = (
    ("iban", ibans, 0.8), ("ssn", ssns, 0.6), ("local_phone", _matched(_LOCAL_PHONE), 0.45), ("local_phone", trunk_phones, 0.25),
    ("secret", _matched(_SECRET), 0.8), ("secret", pairs, 0.6), ("secret", _matched(_TOKEN), 0.8),
)


def extra_spans(text: str, threshold: float = THRESHOLD) -> list[tuple[int, int, int]]:
    """Spans of the kinds beyond the base. Of two of one kind that overlap the first proposal counts."""
    found: dict[str, list[tuple[int, int]]] = {}
    for kind, propose, prior in PROPOSALS:
        mine = found.setdefault(kind, [])
        new = []
        for s, e in propose(text):
            k = bisect_left(mine, (s, e))
            clear = (k == 0 or mine[k - 1][1] <= s) and (k == len(mine) or mine[k][0] >= e)
            if clear and context_score(text, kind, s, e, prior) >= threshold:
                new.append((s, e))
        found[kind] = sorted(mine + new)
    return [(s, KINDS.index(kind), e) for kind, spans in found.items() for s, e in spans]


def all_spans(text: str, threshold: float = THRESHOLD):
    base = sorted(base_spans(text))
    more = extra_spans(text, threshold) if base or _HINT.search(text) else []
    return base, sorted(base + more)


def render(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redact(text: str, spans) -> str:
    """``text`` with every span replaced by its kind in angle brackets; overlapping spans merge into the first."""
    out, end = [], 0
    for s, k, e in spans:
        if s >= end:
            out += [text[end:s], f"<{KINDS[k].upper()}>"]
        end = max(end, e)
    return "".join([*out, text[end:]])


def find_pii(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: counts of the base kinds, digest of the base spans, all spans, and their number."""

    def run(batches):
        for b in in_slices(batches, ROWS):
            rows = []
            for t in b.column(1).to_pylist():
                base, spans = all_spans(t or "", threshold)
                n = [0, 0, 0, 0]
                for _, k, _ in base:
                    n[k] += 1
                rows.append((*n, hashlib.sha256(render(base).encode()).hexdigest(), render(spans), len(spans)))
            cols = list(zip(*rows)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(c, pa.int64()) for c in cols[:4]], pa.array(cols[4], pa.string()), pa.array(cols[5], pa.string()), pa.array(cols[6], pa.int64())],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def redact_documents(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by tags; all other columns pass through."""
    names, at = docs.columns, docs.columns.index("text")

    def run(batches):
        for b in in_slices(batches, ROWS):
            texts = [t and redact(t, all_spans(t, threshold)[1]) for t in b.column(at).to_pylist()]
            cols = [*b.columns[:at], pa.array(texts, pa.string()), *b.columns[at + 1 :]]
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.mapInArrow(run, docs.schema)


def op10_pii(spark, sf_dir: str) -> DataFrame:
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
