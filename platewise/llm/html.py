"""Main text of web pages by nearest-URL page differencing.

Pages are ordered by host and URL path. Each page is paired with the neighbour in that order, on
the same host, whose path shares more with its own; the two pages' text lines are aligned by
longest common subsequence, and lines that both have are deleted, since a site repeats its menus,
notices and footers while articles differ. A neighbour that has nearly all of a page's unmarked text (``COPY``) is a copy of it and
says nothing; then the neighbour on the other side is taken, and if that is one too, nothing is deleted.

A page's own markup adds two things. Lines of menus, sidebars, forms, adverts, reader comments and the like go even where no
neighbour shares them. And unless ``trust_article`` is off, a page that has an article element is cut to it: the article's lines
stay even where a neighbour has them too, and unmarked lines outside go; differencing then decides only pages without one.

Defined results: null html gives an empty text; null URLs form a host of their own; a page without a
neighbour on its host has nothing to share; pages with one URL are ordered by page_id; unclosed
tags, comments and cut-off pages are read as far as they go; further columns are ignored.
"""

from __future__ import annotations

import bisect
import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .neighbours import bounds, part_of

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']+|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.DOTALL)
_CLASS = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
_TOKEN = re.compile(r"[a-z]+")
HIDDEN = frozenset("script style noscript template svg iframe head title object canvas math select option textarea button".split())
_RAW = frozenset("script style textarea title noscript iframe".split())
MENUS = frozenset("nav footer aside form dialog menu header".split())
CORE = frozenset(("article", "main"))
CONTAINERS = frozenset("div section ul ol dl table figure fieldset details header nav footer aside form dialog menu article main blockquote".split()) | HIDDEN
BREAKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr caption figcaption pre hr address center body html summary legend".split())
VOID = frozenset("br hr img input meta link area base col embed source track wbr param".split())
#: Words in class, id or role that mark what is not main text.
CHROME = frozenset(
    "ad ads advert adverts advertisement adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header masthead menu modal "
    "nav navbar navigation newsletter notice pager pagination popup promo recommended related respond share sharing sidebar social sponsor sponsored subscribe "
    "toolbar widget".split()
)
#: Share of a page's characters, outside marked menus and the like, that a copy of it has.
COPY = 0.9
_ARTICLE_WORDS = frozenset("article post entry story content title".split())


def _chrome(name: str, attributes: str, inside: bool) -> bool:
    if name in MENUS and not (name == "header" and inside):
        return True
    if "=" not in attributes:
        return False
    words = {w for m in _CLASS.finditer(attributes) for w in _TOKEN.findall(m[1].lower())}
    met = words & CHROME
    return bool(met) and not (words & _ARTICLE_WORDS and met <= {"header", "comment"})


def parse(html: str) -> tuple[list[str], list[int]]:
    """Text lines of a page in order, and for each 2 if it is in the article, 1 if in menus and the like, else 0."""
    lines: list[str] = []
    kinds: list[int] = []
    pieces: list[str] = []
    stack: list[tuple[str, int, int, int]] = []  # name, and hidden, chrome and core depth before it
    hidden = chrome = core = 0

    def flush():
        if pieces:
            text = "".join(pieces)
            pieces.clear()
            text = " ".join((unescape(text) if "&" in text else text).split())
            if text:
                lines.append(text)
                kinds.append(1 if chrome else 2 if core else 0)

    at, size = 0, len(html)
    while at < size:
        m = _TAG.search(html, at)
        if not m:
            break
        if m.start() > at and not hidden:
            pieces.append(html[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name, closing, attributes = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if name in BREAKS:
            flush()
        elif name == "br" or name in ("td", "th", "img"):
            pieces.append(" ")
        if closing:
            if name in CONTAINERS:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        _, hidden, chrome, core = stack[k]
                        del stack[k:]
                        break
        elif name in CONTAINERS and not attributes.endswith("/"):
            if name in CORE and not core:
                chrome = hidden = 0  # an article ends menus that were never closed
            stack.append((name, hidden, chrome, core))
            if name in _RAW:  # runs to its own end tag, whatever is inside
                end = re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE).search(html, at)
                at = end.start() if end else size
                hidden += 1
            elif name in HIDDEN:
                hidden += 1
            elif chrome or _chrome(name, attributes, core > 0):
                chrome += 1
            if name in CORE:
                core += 1
        elif name in ("p", "span", "h1", "h2", "h3", "h4", "h5", "h6") and "=" in attributes and not chrome and _chrome(name, attributes, core > 0):
            end = re.compile(rf"</{name}\s*>", re.IGNORECASE).search(html, at)
            at = end.start() if end else at
    if at < size and not hidden:
        pieces.append(html[at:])
    flush()
    return lines, kinds


def common_lines(a: list[str], b: list[str]) -> list[bool]:
    """For each line of ``a``, whether it lies on a longest common subsequence with ``b``."""
    shared = set(a) & set(b)
    mark = [False] * len(a)
    ia = [i for i, x in enumerate(a) if x in shared]
    code = {x: k for k, x in enumerate(shared)}
    for i in _lcs([code[a[i]] for i in ia], [code[x] for x in b if x in shared]):
        mark[ia[i]] = True
    return mark


def _row(a: list[int], b: list[int]) -> np.ndarray:
    """LCS length of all of ``a`` with each prefix of ``b``, bit-parallel over ``b``."""
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & places.get(x, 0)
        v = ((v + u) | (v - u)) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), dtype=np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _lcs(a: list[int], b: list[int]) -> list[int]:
    """Positions in ``a`` of a longest common subsequence (Hirschberg's division, in linear memory)."""
    out: list[int] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, n, j, m = todo.pop()
        while i < n and j < m and a[i] == b[j]:
            out.append(i)
            i, j = i + 1, j + 1
        while i < n and j < m and a[n - 1] == b[m - 1]:
            n, m = n - 1, m - 1
            out.append(n)
        if i >= n or j >= m:
            continue
        if n - i == 1:
            if a[i] in b[j:m]:
                out.append(i)
            continue
        mid = (i + n) // 2
        split = j + int((_row(a[i:mid], b[j:m]) + _row(a[mid:n][::-1], b[j:m][::-1])[::-1]).argmax())
        todo += [(i, mid, j, split), (mid, n, split, m)]
    return sorted(out)


def main_text(lines: list[str], kinds: list[int], others: list[list[str]] = (), trust_article: bool = True) -> tuple[str, int, int]:
    """(main text, number of lines that the nearest page shares, which of ``others`` that is or -1).

    ``others``: the lines of the pages on both sides, the nearer one first.
    """
    shared, which = [False] * len(lines), -1
    for k, other in enumerate(others):
        mark = common_lines(lines, other)
        theirs, ours = (sum(len(x) for x, k, m in zip(lines, kinds, mark) if k != 1 and (m or whole)) for whole in (False, True))
        if theirs < COPY * ours or not ours:
            shared, which = mark, k
            break
    if trust_article and 2 in kinds:
        keep = [k == 2 for k in kinds]
    else:
        keep = [k != 1 and not s for k, s in zip(kinds, shared)]
    return "\n\n".join(x for x, k in zip(lines, keep) if k), sum(shared), which


_URL = re.compile(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)([^?#]*)")


def url_key(url: str | None, page) -> str:
    """Sort key: host, path and page, so that neighbours in this order are near in URL."""
    m = _URL.match(url or "")
    host, path = (m[1].lower(), m[2]) if m else ("", (url or "").split("?")[0])
    number = "" if page is None else f"{page:+021d}" if isinstance(page, int) else str(page)
    return f"{host}\x00{path.rstrip('/').removesuffix('.html')}\x00{number}"


def near(a: str, b: str) -> int:
    """How many characters two keys of one host share at the front; -1 for different hosts."""
    if a.split("\x00", 1)[0] != b.split("\x00", 1)[0]:
        return -1
    n = min(len(a), len(b))
    return next((k for k in range(n) if a[k] != b[k]), n)


def extract(pages: DataFrame, trust_article: bool = True, least: int | None = None) -> DataFrame:
    """``page_id, url, text, n_chars, n_shared, nearest_page`` of every page. ``least``: least number of parts."""
    id_kind, names = pages.schema["page_id"].dataType.simpleString(), ["part", "copy", "key", "page_id", "url", "lines", "kinds"]

    def keys(batches):
        for b in batches:
            made = [url_key(u, p) for p, u in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.string()), b.column(2)], ["key", "size"])

    size = F.coalesce(F.octet_length("html"), F.lit(0)).cast("long")
    keyed = materialise(pages.select("page_id", "url", size.alias("size")).mapInArrow(keys, "key string, size long"), "keys")
    limits = bounds(keyed, least)

    edges = keyed.groupBy(part_of(F.col("key"), limits).alias("part")).agg(F.min("key").alias("low"), F.max("key").alias("high")).collect()
    edges = sorted(tuple(r) for r in edges)
    copies: dict[str, list[int]] = {}
    for (p, _, high), (q, low, _) in zip(edges, edges[1:]):
        copies.setdefault(high, []).append(q)
        copies.setdefault(low, []).append(p)

    def read(batches):
        for b in batches:
            rows, n = [], b.num_rows
            for at in range(0, n, 64):
                c = b.slice(at, 64)
                for page, url, html in zip(*(x.to_pylist() for x in c.columns)):
                    key = url_key(url, page)
                    lines, kinds = parse(html) if html else ([], [])
                    for p, copy in [(bisect.bisect_right(limits, key), 0), *((p, 1) for p in copies.get(key, ()))]:
                        rows.append((p, copy, key, page, url, lines, bytes(kinds)))
                if len(rows) >= 512 or at + 64 >= n:
                    cols = list(zip(*rows)) or [()] * 7
                    types = [pa.int32(), pa.int32(), pa.string(), b.column(0).type, pa.string(), pa.list_(pa.string()), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types)], names)
                    rows = []

    read_rows = pages.select("page_id", "url", "html").mapInArrow(read, f"part int, copy int, key string, page_id {id_kind}, url string, lines array<string>, kinds binary")
    rows = read_rows.repartitionById(len(limits) + 1, F.col("part")).sortWithinPartitions("part", "key")

    def difference(batches):
        last, kind = [], None  # up to two rows: the one before and the one waiting for its successor
        for b in batches:
            out = []
            for row in zip(*(x.to_pylist() for x in b.columns)):
                if last and last[-1][0] == row[0]:
                    out += _settle(last, row, trust_article)
                    last = [last[-1], row]
                else:
                    out += _settle(last, None, trust_article)
                    last = [row]
            kind = b.column(3).type
            yield _batch(out, kind)
        out = _settle(last, None, trust_article)
        if out:
            yield _batch(out, kind)

    schema = f"page_id {id_kind}, url string, text string, n_chars long, n_shared long, nearest_page {id_kind}"
    return rows.mapInArrow(difference, schema)


def _settle(last: list, after, trust_article: bool) -> list[tuple]:
    """The result row of the waiting page, now that both its neighbours are known."""
    if not last or last[-1][1]:
        return []
    me = last[-1]
    around = [(near(me[2], x[2]), x) for x in ([last[0]] if len(last) == 2 else []) + ([after] if after else [])]
    around = [x for n, x in sorted(around, key=lambda x: -x[0]) if n >= 0]
    text, shared, which = main_text(me[5], list(me[6]), [x[5] for x in around], trust_article)
    return [(me[3], me[4], text, len(text), shared, around[which][3] if which >= 0 else None)]


def _batch(out: list[tuple], kind) -> pa.RecordBatch:
    cols = list(zip(*out)) or [()] * 6
    types = [kind, pa.string(), pa.string(), pa.int64(), pa.int64(), kind]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types)], ["page_id", "url", "text", "n_chars", "n_shared", "nearest_page"])


def op1_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
