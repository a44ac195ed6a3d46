"""Main text of web pages: markup to text lines, then nearest-URL page differencing.

Pages are sorted by host, path and id over ranges (so that a host of any size is dealt out) and each
page is paired with the nearer of its neighbours of the same host, by the common prefix of their paths.
Pages at the edge of a range are also sent to the range beyond it, as neighbours only, so a pair
doesn't depend on where the edges lie. Text lines of a pair are aligned by longest common subsequence
and shared lines are deleted.

Two exact checks follow, since pages that repeat an article passage share lines that are no
boilerplate: shared lines inside the page's own article element are restored, unless links make up the
whole line (menus and teasers), and a pair that shares nearly all its text and differs in nothing of
weight (copies under two URLs) deletes nothing. A pair that shares
nearly all its text, but differs in what is left, is short texts in one large frame, or copies with adverts
of their own: there only what the page's other neighbour shares too is deleted, if the host has one.
On all other lines the alignment decides. Lines of navigation, advert, footer and similar
elements go whether or not the neighbour shares them.
"""

from __future__ import annotations

import bisect
import html as _html
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrel.llm.common import extended, slices

_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_END_TAG = re.compile(r"</([a-zA-Z][^\s/>]*)")
_VALUE_OR_END = re.compile(r">|=\s*+([\"'])")
# a name starts where no name goes on, so that a long run without = is read once
_ATTRIBUTE = re.compile(r"(?<![^\s=\"'/])([^\s=\"'/]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]++))")
#: Elements whose text is no part of a page's text.
_RAW = frozenset("script style title textarea noscript template iframe noframes xmp".split())
_ASIDE = frozenset("nav header footer aside form button select menu dialog svg canvas object audio video head".split())
#: Elements that begin and end a block of text.
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_MAIN = frozenset(("article", "main"))
#: Words of class, id or role that mark what is no article text.
_MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert"
    " newsletter subscribe subscription signup paywall sidebar menu navbar navigation nav breadcrumb breadcrumbs pagination footer masthead topbar toolbar"
    " comment comments disqus respond replies share sharing social related recommended widget popup modal overlay complementary contentinfo search login".split()
)
#: Open elements that a new one closes; any other block closes an open paragraph.
_CLOSES = {"li": ("li", "p"), "dd": ("dd", "dt", "p"), "dt": ("dd", "dt", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",)}
_WORD = re.compile(r"[a-z]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _marked(name: str, attributes: str) -> bool:
    if not attributes.strip():
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        if m[1].lower() in ("class", "id", "role", "aria-label"):
            value = (m[2] or m[3] or m[4] or "").lower()
            parts = value.split()
            if any(p in _MARKS or (w := _WORD.findall(p)) and (w[0] in _MARKS or w[-1] in _MARKS) for p in parts):
                return name not in ("body", "html", "main", "article") or m[1].lower() == "class" and bool({"comment", "advert", "ad"} & set(parts))
    return bool(re.search(r"(?:^|\s)hidden(?:\s|=|$)", attributes))


class _Tags:
    """Where tags end. Quotes count after = only; a quoted value that never ends, or beyond which the tag
    never ends, is no value, and the tag ends at its first >. Every place is scanned once: the places of values
    beyond which no tag ends are remembered."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.last = {c: page.rfind(c) for c in "\"'>"}
        self.dead: set[int] = set()

    def end(self, at: int) -> int:
        """The place of the > of the tag whose attributes start at `at`; -1 if there is none."""
        page, passed, now = self.page, [], at
        if at > self.last[">"]:
            return -1
        while m := _VALUE_OR_END.search(page, now):
            if m[1] is None:
                return m.start()
            if m.start() in self.dead or m.end() > self.last[m[1]]:
                break
            passed.append(m.start())
            now = page.index(m[1], m.end()) + 1
        self.dead.update(passed)
        return page.find(">", at)


class _Open:
    """The open elements. Ends of elements are found without a walk through those that stay open."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, bool, bool]] = []  # name, in main, aside
        self.blocks: list[int] = []
        self.places: dict[str, list[int]] = {}
        self.links = 0

    def top(self) -> tuple[str, bool, bool]:
        return self.stack[-1] if self.stack else ("", False, False)

    def push(self, name: str, inside: bool, aside: bool) -> None:
        self.places.setdefault(name, []).append(len(self.stack))
        if name in _BLOCK:
            self.blocks.append(len(self.stack))
        self.links += name == "a"
        self.stack.append((name, inside, aside))

    def cut(self, size: int) -> None:
        while len(self.stack) > size:
            name = self.stack.pop()[0]
            self.places[name].pop()
            if name in _BLOCK:
                self.blocks.pop()
            self.links -= name == "a"

    def place(self, name: str) -> int:
        """Where the element is that an end tag closes, -1 if nowhere; that of an inline element closes no block."""
        at = self.places.get(name)
        return at[-1] if at and (name in _BLOCK or not self.blocks or at[-1] > self.blocks[-1]) else -1


def lines_of(page: str | None) -> list[tuple[str, bool, bool]]:
    """The text blocks of a page in order: text with its white space made single spaces, whether it
    stands in an article or main element and isn't made of links alone, whether in an element of
    menus, adverts and the like. The time is in proportion to the page's length, whatever its markup."""
    page = page or ""
    out: list[tuple[str, bool, bool]] = []
    text: list[str] = []
    free = False  # text outside of links
    open_, tags = _Open(), _Tags(page)
    lower = page.lower()
    if len(lower) != len(page):  # U+0130 becomes two characters, and places in lower are used on page
        lower = page.translate(_LOWER)
    last_end = {m[1]: m.start() for m in _END_TAG.finditer(lower)}

    def flush() -> None:
        nonlocal free
        joined = " ".join(_html.unescape("".join(text)).split())
        if joined:
            _, inside, aside = open_.top()
            out.append((joined, inside and free, aside))
        text.clear()
        free = False

    at = 0
    while at < len(page):
        start = page.find("<", at)
        if start < 0:
            start = len(page)
        if start > at:
            text.append(page[at:start])
            free = free or not open_.links and not page[at:start].isspace()
        at = start + 1
        if at >= len(page):
            text.append(page[start:])
            break
        if page[at] in "!?":
            ends = "-->" if page.startswith("!--", at) else "]]>" if page.startswith("![CDATA[", at) else ">"
            end = page.find(ends, at + (3 if len(ends) > 1 else 0))
            at = end + len(ends) if end >= 0 else len(page)
        else:
            m = _NAME.match(page, at) if at <= tags.last[">"] else None
            end = tags.end(m.end()) if m else -1
            if end < 0:
                text.append("<")
                free = free or not open_.links
                continue
            attributes, at = page[m.end() : end], end + 1
            name = m[0].lower()
            if name[0] == "/":
                name = name[1:]
                if name in _BLOCK or name in _ASIDE:
                    flush()
                if (i := open_.place(name)) >= 0:
                    if open_.blocks and open_.blocks[-1] >= i:
                        flush()
                    open_.cut(i)
                continue
            closed = attributes.rstrip().endswith("/")
            if name in _RAW:
                if not closed:
                    gone = re.compile(rf"</{re.escape(name)}[\s/>]").search(lower, at) if last_end.get(name, -1) >= at else None
                    at = page.find(">", gone.start()) + 1 or len(page) if gone else len(page)
                continue
            if name in _BLOCK or name in _ASIDE:
                flush()
                closes = _CLOSES.get(name, ("p",))
                while open_.blocks and open_.stack[open_.blocks[-1]][0] in closes:
                    open_.cut(open_.blocks[-1])
            elif name == "br":
                text.append("\n")
            if name in _VOID or closed:
                continue
            _, inside, aside = open_.top()
            off = name in _ASIDE or _marked(name, attributes)
            if off and last_end.get(name, -1) < at:
                off = False  # never closed: it holds nothing for certain
            if name == "header" and inside:
                off = _marked(name, attributes)  # the heading of the article itself
            open_.push(name, inside or name in _MAIN, aside or off)
    flush()
    return out


def shared_lines(a: list[str], b: list[str]) -> set[int]:
    """Places in a of one longest common subsequence of a and b, by bits of whole integers. Of the rows of
    bits every k-th is kept, k the root of their number, and those between are made again on the way back."""
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    e = 0
    while e < min(len(a), len(b)) - n and a[-1 - e] == b[-1 - e]:
        e += 1
    found = {*range(n), *range(len(a) - e, len(a))}
    both = {*a[n : len(a) - e]} & {*b[n : len(b) - e]}
    at = [i for i in range(n, len(a) - e) if a[i] in both]
    x, y = [a[i] for i in at], [line for line in b[n : len(b) - e] if line in both]
    where: dict[str, int] = {}
    for j, line in enumerate(y):
        where[line] = where.get(line, 0) | 1 << j
    full = (1 << len(y)) - 1

    def rows(first: int, lo: int, hi: int) -> Iterator[int]:
        for line in x[lo:hi]:
            m = where[line]
            first = (first + (first & m) | first & ~m) & full
            yield first

    k = math.isqrt(len(x)) + 1
    kept = [full]
    for lo in range(0, len(x), k):
        for row in rows(kept[-1], lo, lo + k):
            last = row
        kept.append(last)
    i, j = len(x), len(y)
    part: list[int] = []
    base = -1
    while i and j:  # a clear bit j - 1 in row i: the subsequence grows there
        if base < 0 or i - 1 < base:
            base = (i - 1) // k * k
            part = [kept[base // k], *rows(kept[base // k], base, min(base + k, len(x)))]
        if part[i - base] >> j - 1 & 1:
            j -= 1
        elif not part[i - 1 - base] >> j - 1 & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            found.add(at[i])
    return found


def _alike(a: list[str], b: list[str], least: int = 16) -> bool:
    """Whether what is left of two pages is nearly nothing (fewer than `least` characters of either) or
    mostly the same words, digits apart, as in edited copies."""
    if min(sum(map(len, a)), sum(map(len, b))) < least:
        return True
    x, y = (Counter(re.sub(r"\d", "0", " ".join(lines)).lower().split()) for lines in (a, b))
    return 2 * (x & y).total() >= (x.total() + y.total()) / 2


def main_lines(page: list[tuple[str, bool, bool]], other: list[tuple[str, bool, bool]] | None, further: list[tuple[str, bool, bool]] | None = None, *, copies: float = 0.8) -> list[str]:
    """The lines of a page that are left without those its neighbour shares and those of menus and
    the like. `copies`: the share of its text from which on a pair may be copies. They are if what is
    left of both is alike; else, if the host has a further neighbour, only what that shares too goes."""
    shared: set[int] = set()
    if other:
        mine, theirs = [x[0] for x in page], [x[0] for x in other]
        shared = shared_lines(mine, theirs)
        weight = [len(x[0]) for x in page]
        if sum(weight[i] for i in shared) >= copies * max(1, sum(weight)):
            back = shared_lines(theirs, mine)
            if _alike(*([text for i, (text, _, aside) in enumerate(lines) if not aside and i not in gone] for lines, gone in ((page, shared), (other, back)))):
                shared = set()
            elif further:
                shared &= shared_lines(mine, [x[0] for x in further])
    return [text for i, (text, inside, aside) in enumerate(page) if not aside and (inside or i not in shared)]


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty for null or without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _key(host: str, path: str, page_id: object = None) -> tuple:
    """Orders as Spark does: by code points, null ids first."""
    return host, path, page_id is not None, 0 if page_id is None else page_id


def _ranges(keys: DataFrame, n: int) -> list[tuple[tuple, tuple]]:
    """First and last key of at most n ranges of about equal size, in order. Equal keys share a range.
    The driver gets two keys a range, whatever the number of pages."""
    key = F.struct(*keys.columns)
    ends = keys.repartitionByRange(n, *keys.columns).groupBy(F.spark_partition_id()).agg(F.min(key).alias("first"), F.max(key).alias("last"))
    return sorted((_key(*r["first"]), _key(*r["last"])) for r in ends.collect())


def extract(pages: DataFrame, *, html: str = "html", out: str = "text") -> DataFrame:
    """Replace column `html` of pages (page_id, url, ...) by `out`, the main text of each page: blocks
    in page order joined by an empty line, empty if there are none, and `n_chars`, its code points.
    Null html counts as empty; null urls and urls without host are one host's. Repeated rows and
    ids are pages of their own, ordered by a hash of their html; columns that have the name of a new
    one are replaced."""
    keep = [c for c in pages.columns if c not in (html, out, "n_chars")]
    work = {"_host": "string", "_path": "string", "_html": "string"}
    rows = pages.select(*keep, host_of(F.col("url")).alias("_host"), path_of(F.col("url")).alias("_path"), F.col(html).alias("_html"))
    order = ["_host", "_path", *(c for c in ("page_id",) if c in keep)]
    ranges = _ranges(rows.select(order), max(1, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    firsts, first_at, last_at = [a for a, _ in ranges], {a: i for i, (a, _) in enumerate(ranges)}, {b: i for i, (_, b) in enumerate(ranges)}

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_html", 16 << 20):
            at: list[tuple[int, int, bool]] = []  # row, range, there as a neighbour only
            for i, values in enumerate(zip(*(batch.column(c).to_pylist() for c in order), strict=True)):
                key = _key(*values)
                at.append((i, bisect.bisect_right(firsts, key) - 1, False))
                for there, step, end in ((first_at, -1, 1), (last_at, 1, 0)):
                    j = there.get(key, -1) + step if key in there else -1
                    if 0 <= j < len(ranges) and ranges[j][end][0] == values[0]:
                        at.append((i, j, True))
            i, j, extra = zip(*at, strict=True)
            taken = batch.take(pa.array(i))
            yield pa.record_batch([*taken.columns, pa.array(j, pa.int32()), pa.array(extra)], names=[*batch.schema.names, "_range", "_extra"])

    rows = rows.mapInArrow(placed, extended(rows, {"_range": "int", "_extra": "boolean"}))
    rows = rows.repartitionById(max(1, len(ranges)), F.col("_range")).sortWithinPartitions(*order, F.xxhash64("_html"))

    def near(a: str, b: str) -> int:
        n = 0
        for x, y in zip(a, b, strict=False):
            if x != y:
                break
            n += 1
        return n

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for batch in slices(batches, "_html"):
                for i, (h, p, t, extra) in enumerate(zip(*(batch.column(c).to_pylist() for c in (*work, "_extra")), strict=True)):
                    yield batch, i, h, p, lines_of(t), extra

        before = here = None
        done: list[tuple] = []  # a run of results within one slice

        def result(prev: tuple | None, now: tuple, after: tuple | None) -> str:
            p = prev if prev and prev[2] == now[2] else None
            q = after if after and after[2] == now[2] else None
            other = q if p is None or q and near(q[3], now[3]) > near(p[3], now[3]) else p
            further = None if p is None or q is None else p if other is q else q
            return "\n\n".join(main_lines(now[4], other[4] if other else None, further[4] if further else None))

        def put() -> pa.RecordBatch:
            batch, first = done[0][0], done[0][1]
            texts = [t for _, _, t in done]
            part = batch.slice(first, len(done))
            return pa.record_batch([*(part.column(c) for c in keep), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*keep, out, "n_chars"])

        for after in itertools.chain(each(), [None]):
            if here is not None:
                if not here[5]:  # neighbours from other ranges come before and after all pages of this one
                    done.append((here[0], here[1], result(before, here, after)))
                if done and (after is None or after[0] is not here[0]):
                    yield put()
                    done.clear()
            before, here = here, after

    return rows.mapInArrow(made, extended(pages.select(*keep), {out: "string", "n_chars": "long"}))
