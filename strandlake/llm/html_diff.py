"""Main text of web pages by differencing against the page of nearest URL, guided by structure.

Every page is cut into lines, one a block. Its lines are aligned with those of the page whose URL path is nearest on the same
host, by their longest common subsequence: what the two share is the site's, not the page's, and is deleted.

Differencing alone can't give the article: pages of one host carry different menus, and articles share sentences. So structure
marks lines first. Paragraphs, headings, lists, quotations and tables of an article are content, which differencing does not
delete; what stands in menus, notices, adverts, forms, comments and the like, or outside a page's article, is not, shared or not; all
other lines are open, and differencing decides.

At scale: one map parses the pages to narrow rows (host, path, line hashes); neighbours come from a range sort of those, with
the ends of each range passed on, so that one host may have any share of the pages. Alignment is by bits, in memory linear in the
lines of two pages, whatever they repeat. Whole pages are shuffled only if the lists of deleted lines are too long to broadcast.
"""

from __future__ import annotations

import os.path
import re
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, settle, slices

#: Up to so many bytes the lists of deleted lines are broadcast.
BROADCAST_BYTES = 4 << 20
PAGES_PER_RANGE = 200_000
#: Up to so many bits an alignment is kept whole; longer ones are halved.
ALIGN_BITS = 1 << 25

# elements by role, fixed
_HIDDEN = frozenset("head script style noscript template svg math iframe object canvas audio video select option textarea button datalist".split())
_BOILERPLATE = frozenset("nav footer aside form menu dialog".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html "
    "legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
_HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget footer comment comments reply replies respond discussion disqus share sharing social "
    "related recommended newsletter subscribe subscription signup login search pagination pager toolbar skip copyright".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
_REMARKS = frozenset({"comment", "comments", "reply", "replies"})
#: A start tag that closes an open one of the same group.
_CLOSES = {t: g for g in (frozenset({"p"}), frozenset({"li"}), frozenset({"dt", "dd"}), frozenset({"tr"}), frozenset({"td", "th"}), frozenset({"option"})) for t in g}
_CLOSES_P = _BLOCKS - {"br", "button", "option", "optgroup", "select", "legend", "caption", "body", "html", "title", "td", "th", "tr", "tbody", "thead", "tfoot", "dd", "dt", "li"}
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")

#: A reference to no character; Python does not convert so many digits.
_LONG_REFERENCE = re.compile(r"&#[0-9]{4000,};?")


CONTENT, OPEN, OTHER = "c", "o", "b"
_SHOWN, _ASIDE, _UNSEEN = 0, 1, 2
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figcaption".split())


class _Page(HTMLParser):
    """Lines of a page as (text, article, prose): the number of the article they stand in, 0 for none, -1 for boilerplate."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, int, bool]] = []  # tag, hidden from here, article, prose
        self.lines: list[tuple[str, int, bool]] = []
        self.parts: list[str] = []
        self.articles: list[str] = [""]

    @property
    def state(self) -> tuple[int, int, bool]:
        return self.open[-1][1:] if self.open else (_SHOWN, 0, False)

    def end_line(self) -> None:
        if text := " ".join("".join(self.parts).split()):
            hidden, article, prose = self.state
            self.lines.append((text, -1 if hidden else article, prose))
        self.parts = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _BLOCKS:
            self.end_line()
        if (group := _CLOSES.get(tag)) or tag in _CLOSES_P:
            self._close(group or frozenset({"p"}))
        if tag in _VOID:
            return
        hidden, article, prose = self.state
        hidden = _UNSEEN if tag in _HIDDEN else max(hidden, int(tag in _BOILERPLATE or (tag == "header" and not article)))
        if not hidden and tag not in ("html", "body"):
            values = {k: v or "" for k, v in attrs}
            words = {w.lower() for k in ("class", "id") for w in _PART.findall(values.get(k, ""))}
            landmark = tag in ("article", "main")
            hidden = int("hidden" in values or values.get("aria-hidden") == "true" or values.get("role", "").lower() in _ROLES or bool(words & (_REMARKS if landmark else _HINTS)))
            if not hidden and (landmark or values.get("role") in ("main", "article")):
                # articles in an article are parts of it; an article in a main element is the narrower one
                if not article or (tag == "article" and self.articles[article] == "main"):
                    self.articles.append("article" if tag == "article" or values.get("role") == "article" else "main")
                    article, prose = len(self.articles) - 1, False
        self.open.append((tag, hidden, article, prose or tag in _PROSE))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash at the end means nothing in HTML

    def _close(self, tags: frozenset[str]) -> None:
        """Close the nearest of these, unless a sectioning element stands between."""
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] in tags:
                del self.open[k:]
                return
            if self.open[k][0] in ("article", "main", "section", "div", "body", "table", "ul", "ol", "td", "th", "li", "blockquote"):
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in _BLOCKS:
            self.end_line()
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                return
            if self.open[k][0] in ("article", "main") and tag not in ("body", "html", "main", "article"):
                return  # a stray end tag does not close an article

    def handle_data(self, data: str) -> None:
        if self.state[0] != _UNSEEN:
            self.parts.append(data)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        if self.rawdata.startswith("<![CDATA[", i):
            return super().parse_marked_section(i, report)
        return self.parse_bogus_comment(i)  # up to the next >, as browsers read it; the parser raises, or looks for a later ]>


def page_lines(html: str) -> list[tuple[str, str]]:
    """(text, mark) of every line, in page order. The article with the most text is the page's; a main element stands in for one."""
    page = _Page()
    page.feed(_LONG_REFERENCE.sub("\ufffd", html))
    page.close()
    page.end_line()
    sizes: dict[int, int] = {}
    for text, article, _ in page.lines:
        if article > 0:
            sizes[article] = sizes.get(article, 0) + len(text)
    if not sizes:
        return [(t, OTHER if a < 0 else OPEN) for t, a, _ in page.lines]
    chosen = max(sizes, key=lambda a: (page.articles[a] == "article", sizes[a], -a))
    return [(t, OTHER if a != chosen else CONTENT if prose else OPEN) for t, a, prose in page.lines]


def _rows(mine: Sequence[int], other: Sequence[int]) -> Iterator[int]:
    """After each line of `mine`, a number whose bit j is 0 where a longest common subsequence with other[: j + 1] is one longer than with other[:j].

    All of a row is one addition: work is lines times lines by 64, and equal lines cost nothing more.
    """
    where: dict[int, int] = {}
    for j, line in enumerate(other):
        where[line] = where.get(line, 0) | 1 << j
    full = (1 << len(other)) - 1
    row = full
    for line in mine:
        both = row & where.get(line, 0)
        row = (row + both | row - both) & full
        yield row


def _lengths(mine: Sequence[int], other: Sequence[int]) -> np.ndarray:
    """The length of a longest common subsequence of all of `mine` with each beginning of `other`."""
    row = (1 << len(other)) - 1
    for row in _rows(mine, other):  # noqa: B007
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(other) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(other)]
    return np.concatenate([[0], np.cumsum(bits == 0)])


def common_lines(mine: Sequence[int], other: Sequence[int]) -> list[int]:
    """Places in `mine` of a longest common subsequence with `other`. Equal ends are cut off; long pages are halved where the halves' lengths add up to most."""
    n, m, k = len(mine), len(other), 0
    while k < min(n, m) and mine[k] == other[k]:
        k += 1
    z = 0
    while z < min(n, m) - k and mine[n - 1 - z] == other[m - 1 - z]:
        z += 1
    a, b = mine[k : n - z], other[k : m - z]
    if not a or not b:
        middle = []
    elif len(a) * len(b) > ALIGN_BITS and len(a) > 1:
        half = len(a) // 2
        left, right = a[:half], a[half:]
        at = int(np.argmax(_lengths(left, b) + _lengths(right[::-1], b[::-1])[::-1]))
        middle = [*common_lines(left, b[:at]), *(half + x for x in common_lines(right, b[at:]))]
    else:
        rows, middle = list(_rows(a, b)), []
        i, j = len(a), len(b)
        while i and j:
            if rows[i - 1] >> (j - 1) & 1:
                j -= 1
            else:
                i -= 1
                if not i or rows[i - 1] >> (j - 1) & 1:
                    j -= 1
                    middle.append(i)
        middle.reverse()
    return [*range(k), *(k + x for x in middle), *range(n - z, n)]


def _place(url: str | None) -> tuple[str, str]:
    try:
        parts = urlsplit(url or "")
        return (parts.hostname or "").lower(), parts.path or "/"
    except ValueError:
        return "", url or ""


def _digest(url: str | None, html: str) -> int:
    return xxhash.xxh64_intdigest(f"{url}\0{html}".encode("utf-8", "surrogatepass")) - (1 << 63)


def line_table(pages: DataFrame) -> DataFrame:
    """(page_id, digest, host, path, lines, marks): hashes and marks of the lines of every page that has any."""
    names = ["page_id", "digest", "host", "path", "lines", "marks"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(2)):
                rows = []
                for i, url, value in zip(batch.column(0)[a:b].to_pylist(), batch.column(1)[a:b].to_pylist(), batch.column(2)[a:b], strict=True):
                    html = value.as_py() or ""
                    if lines := page_lines(html):
                        rows.append((i, _digest(url, html), *_place(url), [xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) - (1 << 63) for t, _ in lines], "".join(m for _, m in lines)))
                columns = list(zip(*rows, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    source = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return map_batches(source, run, "page_id long, digest long, host string, path string, lines array<long>, marks string")


def neighbours(rows: DataFrame) -> DataFrame:
    """(page_id, digest, near_digest, near_id): the page before or after in URL order on the host, whichever shares more of the path."""
    key = ["host", "path", "page_id", "digest"]
    n = max(1, -(-rows.count() // PAGES_PER_RANGE))
    placed = settle(rows.select(*key).distinct().repartitionByRange(n, *key).withColumn("range", F.spark_partition_id()))
    whole = F.struct(*key)
    in_range = Window.partitionBy("range").orderBy(*key)
    ends = placed.groupBy("range").agg(F.min(whole).alias("first"), F.max(whole).alias("last"))
    in_order = Window.orderBy("range")  # one row a range
    ends = ends.select(F.col("range").alias("r"), F.lag("last").over(in_order).alias("left"), F.lead("first").over(in_order).alias("right"))
    both = placed.withColumns({"before": F.lag(whole).over(in_range), "after": F.lead(whole).over(in_range)}).join(F.broadcast(ends), F.col("range") == F.col("r"))
    near = both.select("page_id", "digest", "host", "path", F.coalesce("before", "left").alias("x"), F.coalesce("after", "right").alias("y"))
    sides = [F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in "xy" for c in ("host", "path", "digest", "page_id")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen = []
            for host, path, *others in zip(*(batch.column(k).to_pylist() for k in range(2, 12)), strict=True):
                found = [(len(os.path.commonprefix([path, p])), -k, d, i) for k, (h, p, d, i) in enumerate((others[:4], others[4:])) if h == host and i is not None]
                chosen.append(max(found)[2:] if found else (None, None))
            columns = [pa.array(c, pa.int64()) for c in zip(*chosen, strict=True)] if chosen else [pa.array([], pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["page_id", "digest", "near_digest", "near_id"])

    found = map_batches(near.select("page_id", "digest", "host", "path", *sides), run, "page_id long, digest long, near_digest long, near_id long")
    return found.where(F.col("near_id").isNotNull())


def deletions(rows: DataFrame) -> DataFrame:
    """(page_id, digest, gone, n_shared): the places of the open lines that a page shares with its neighbour, and how many lines that are not content it shares."""
    mine = rows.dropDuplicates(["page_id", "digest"]).select("page_id", "digest", "lines", "marks")
    other = mine.select(F.col("page_id").alias("near_id"), F.col("digest").alias("near_digest"), F.col("lines").alias("near_lines"))
    pairs = neighbours(rows).join(mine, ["page_id", "digest"]).join(other, ["near_id", "near_digest"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone, shared = [], []
            for a, marks, b in zip(batch.column(2), batch.column(3), batch.column(4), strict=True):
                marks, same = marks.as_py(), common_lines(a.as_py(), b.as_py())
                gone.append([k for k in same if marks[k] == OPEN])
                shared.append(sum(marks[k] != CONTENT for k in same))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(gone, pa.list_(pa.int32())), pa.array(shared, pa.int32())], names=["page_id", "digest", "gone", "n_shared"])

    return map_batches(pairs.select("page_id", "digest", "lines", "marks", "near_lines"), run, "page_id long, digest long, gone array<int>, n_shared int")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Null and empty pages have empty texts. A page with no other page on its host keeps its open lines. Pages that repeat an id
    are read one by one; equal rows count once as neighbours. Of two neighbours with equally near paths the one before, by URL,
    counts. A null id has no neighbour. Empty table: empty result. Other columns, whatever their names, are not read. A long page
    takes a worker some 50 bytes of memory a byte.
    """
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    gone = settle(deletions(settle(line_table(source).where(F.col("page_id").isNotNull()))).where(F.size("gone") > 0).drop("n_shared"))
    size = gone.agg(F.sum(4 * F.size("gone") + 40)).first()[0]
    if size:
        lost = gone.groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("digest").cast("string"), "gone"))).alias("gone"))
        lost = F.broadcast(lost) if size <= BROADCAST_BYTES else lost
        source = source.join(lost, "page_id", "left")
    else:
        source = source.withColumn("gone", F.lit(None).cast("map<string,array<int>>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(2)):
                texts = []
                for url, value, lost in zip(batch.column(1)[a:b].to_pylist(), batch.column(2)[a:b], batch.column(3)[a:b], strict=True):
                    html = value.as_py() or ""
                    found = lost.as_py()
                    out = frozenset(dict(found).get(str(_digest(url, html)), ())) if found else ()
                    texts.append(" ".join(t for k, (t, mark) in enumerate(page_lines(html)) if mark != OTHER and k not in out))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return map_batches(source.select("page_id", "url", "html", "gone"), run, "page_id long, url string, text string, n_chars long")
