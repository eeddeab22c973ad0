"""Main text of web pages by nearest-URL page differencing.

The paths of each host are sorted, whole tables at a time; a path is represented by its page of least id. A page is
paired with the representative of the path before or after its own that shares the longer beginning. The lines of both
are aligned by longest common subsequence, and shared lines are deleted: menus, footers and notices of the site. Only
digests of lines travel to the partner.

Differencing alone can't give exact articles: a menu or advert made for one page is not shared, and two copies
of an article share all of it. So the page's own marking settles these: lines inside an article stay, and lines inside
elements marked as menu, advert, form, comment and the like go. n_shared and n_marked tell what each has deleted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import BROADCAST_BYTES, written

# Element names of the HTML standard by what they mean here.
BLOCKS = frozenset("address article aside blockquote body br canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu nav ol option optgroup p pre section summary table tbody td tfoot th thead title tr ul video audio".split())
SILENT = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "object", "noframes", "xmp")
OUTSIDE = frozenset("nav header footer aside form menu dialog button select label fieldset head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in class, id or role that mark an element as no part of the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "footer masthead cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "related recommended recommendations comment comments commentlist disqus reply replies respond widget toolbar pagination pager search complementary contentinfo".split()
)
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(" + "|".join(SILENT) + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/a-zA-Z][^>]*>",
    re.S | re.I,
)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[a-z0-9]+")


def _marked(attributes: str) -> bool:
    return any(w in MARKS for m in _NAMED.finditer(attributes) for w in _WORDS.findall((m[1] or m[2] or m[3] or "").lower()))


def lines_of(html: str) -> list[tuple[str, bool, str]]:
    """Lines of a page in order: (text, whether outside by marking, "article", "main" or "" for where it stands)."""
    out: list[tuple[str, bool, str]] = []
    text: list[str] = []
    shut: list = ["", 0]  # the outermost element that is outside, and how many of its name are open in it
    inside = {"article": 0, "main": 0}

    def end() -> None:
        if text:
            line = " ".join(unescape("".join(text)).split())
            if line:
                out.append((line, bool(shut[0]), "article" if inside["article"] else "main" if inside["main"] else ""))
            text.clear()

    at = 0
    for m in _TAG.finditer(html):
        if m.start() > at:
            text.append(html[at : m.start()])
        at = m.end()
        name = m[3]
        if name is None:
            continue
        name = name.lower()
        if name in BLOCKS:
            end()
        closes = bool(m[2])
        if name in VOID:
            continue
        if shut[0]:
            if name == shut[0]:
                shut[1] += -1 if closes else 1
                if not shut[1]:
                    end()
                    shut[0] = ""
            continue
        if closes:
            if name in inside:
                inside[name] = max(0, inside[name] - 1)
            continue
        plain = name in ("html", "body", "article", "main")
        if (name in OUTSIDE and not (name == "header" and inside["article"])) or (name != "html" and name != "body" and m[4] and _marked(m[4]) and not (plain and name != "article")):
            end()
            shut[:] = [name, 1]
        elif name in inside:
            inside[name] += 1
    if at < len(html):
        text.append(html[at:])
    end()
    return out


def _lengths(x: list, y: list) -> np.ndarray:
    """Length of the longest common subsequence of x and each beginning of y: a row of bits, all of y at once."""
    at: dict = {}
    for k, t in enumerate(y):
        at[t] = at.get(t, 0) | 1 << k
    full = (1 << len(y)) - 1
    row = full
    for t in x:
        u = row & at.get(t, 0)
        row = (row + u | row - u) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(y) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(y)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def shared_lines(a: list, b: list) -> set[int]:
    """Places in a of a longest common subsequence of a and b; halves a again and again, so it needs little memory."""
    both = set(a) & set(b)
    out: set[int] = set()
    todo = [([k for k, t in enumerate(a) if t in both], [t for t in b if t in both])]
    while todo:
        x, y = todo.pop()
        n, lo = min(len(x), len(y)), 0
        while lo < n and a[x[lo]] == y[lo]:
            lo += 1
        hi = 0
        while hi < n - lo and a[x[-1 - hi]] == y[-1 - hi]:
            hi += 1
        out.update(x[:lo], x[len(x) - hi :])
        x, y = x[lo : len(x) - hi], y[lo : len(y) - hi]
        if not x or not y:
            continue
        if len(x) == 1:
            out.update(x if a[x[0]] in y else ())
            continue
        half = len(x) // 2
        front = _lengths([a[k] for k in x[:half]], y)
        back = _lengths([a[k] for k in reversed(x[half:])], y[::-1])[::-1]
        cut = int(np.argmax(front + back))
        todo += [(x[:half], y[:cut]), (x[half:], y[cut:])]
    return out


def main_text(lines: list[tuple[str, bool, str]], partner: list[int] | None) -> tuple[str, int, int]:
    """Text of the lines that stay, how many lines the partner's lines delete, and how many more the marking does."""
    shared = shared_lines([_digest(x[0]) for x in lines], partner) if partner else set()
    where = {x[2] for x in lines if not x[1]}
    zone = "article" if "article" in where else "main" if "main" in where else None
    kept, n_shared = [], 0
    for k, (t, outside, at) in enumerate(lines):
        if zone and at == zone and not outside:  # copies of an article share its lines
            kept.append(t)
        elif k in shared:
            n_shared += 1
        elif not zone and not outside:
            kept.append(t)
    return " ".join(kept), n_shared, len(lines) - len(kept) - n_shared


def _digest(line: str) -> int:
    return xxhash.xxh64_intdigest(line.encode()) - (1 << 63)


def _alike(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((k for k in range(n) if a[k] != b[k]), n)


def _line_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (host, path, id, html) to (host, path, id, lines)."""
    for b in batches:
        lines = [[_digest(x[0]) for x in lines_of(html or "")] for html in b.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(lines, pa.list_(pa.int64()))], ["host", "path", "id", "lines"])


def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (host, path, before, after) to (host, path, lines of the one whose path is more alike; of two, before)."""
    for b in batches:
        host, path = b.column(0).to_pylist(), b.column(1).to_pylist()
        lines = []
        for h, p, *sides in zip(host, path, b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            near = [x for x in sides if x is not None and x["host"] == h]
            lines.append(max(near, key=lambda x: _alike(p, x["path"]))["lines"] if near else None)  # noqa: B023
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lines, pa.list_(pa.int64()))], ["__phost", "__ppath", "__lines"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, url, html, lines of the partner) to (id, url, text, n_shared, n_marked)."""
    for b in batches:
        for k in range(0, b.num_rows, 512):
            part = b.slice(k, 512)
            done = [main_text(lines_of(html or ""), lines) for html, lines in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
            text, shared, marked = zip(*done, strict=True)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array(shared, pa.int64()), pa.array(marked, pa.int64())], ["__id", "__url", "text", "n_shared", "n_marked"])


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    """The path without fragment, a closing slash or a page suffix, with the query."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)
    return F.concat(F.regexp_replace(path, r"(?:/|\.html?)$", ""), query)


def partners(pages: DataFrame) -> DataFrame:
    """(__phost, __ppath, __lines) from pages (__host, __path, __id, __html): for each path the lines of its nearest neighbour on the host.

    Paths are sorted by range, so a large host spreads over many tasks; the first and last path of each range, two rows
    a range, tell its neighbours. The result doesn't depend on the ranges.
    """
    kind = pages.schema["__id"].dataType.simpleString()
    known = pages.filter("__host is not null").select("__host", "__path", "__id", "__html").mapInArrow(_line_digests, f"host string, path string, id {kind}, lines array<long>")
    one = known.groupBy("host", "path").agg(F.min_by("lines", F.struct(F.col("id").isNull(), "id", F.xxhash64("lines"))).alias("lines"))
    placed = written(one.repartitionByRange("host", "path").withColumn("range", F.spark_partition_id()))
    me, own, every = F.struct("host", "path", "lines"), W.partitionBy("range").orderBy("host", "path"), W.orderBy("range")
    near = placed.select("range", "host", "path", F.lag(me).over(own).alias("before"), F.lead(me).over(own).alias("after"))
    ends = placed.groupBy("range").agg(F.min_by(me, F.struct("host", "path")).alias("first"), F.max_by(me, F.struct("host", "path")).alias("last"))
    ends = ends.select("range", F.lag("last").over(every).alias("left"), F.lead("first").over(every).alias("right"))
    size = ends.agg(F.sum(200 + 8 * (F.coalesce(F.size("left.lines"), F.lit(0)) + F.coalesce(F.size("right.lines"), F.lit(0)))).alias("n")).head().n or 0
    near = near.join(F.broadcast(ends) if size <= BROADCAST_BYTES else ends, "range").select("host", "path", F.coalesce("before", "left").alias("before"), F.coalesce("after", "right").alias("after"))
    return near.mapInArrow(_nearest, "__phost string, __ppath string, __lines array<long>")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text (empty if none), n_chars, n_shared, n_marked (lines that differencing, then marking deletes).

    A null html is an empty page; a page with a null or odd url has no partner and is judged by its marking alone.
    Repeated rows, and other pages of one path, are never each other's partner; ties go to the path before, and to the
    least id. Other columns aren't read; an empty table gives no rows. A very long page is aligned in memory that grows
    with its lines, not with their square.
    """
    host = url_host(F.col(url_col))
    plain = pages.select(F.when(host != "", host).alias("__host"), url_path(F.col(url_col)).alias("__path"), F.col(id_col).alias("__id"), F.col(url_col).alias("__url"), F.col(html_col).alias("__html"))
    both = plain.join(partners(plain), (F.col("__host") == F.col("__phost")) & (F.col("__path") == F.col("__ppath")), "left")
    kind = plain.schema["__id"].dataType.simpleString()
    done = both.select("__id", "__url", "__html", "__lines").mapInArrow(_extract, f"__id {kind}, __url string, text string, n_shared long, n_marked long")
    return done.select(F.col("__id").alias(id_col), F.col("__url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"), "n_shared", "n_marked")
