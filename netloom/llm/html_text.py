"""HTML extraction by nearest-URL page differencing.

Pages stand in the order of host, path and id. Each is paired with one of two pages of its host, the last before and the
first after it that have a body and not the same one, whose path shares the longer beginning; the text lines of both are
aligned by a longest common subsequence and shared lines are deleted. A body is the lines that markup doesn't drop. Pages of
one body in a row (copies, http and https, query strings that change nothing) and pages without a body are looked past.

The order is cut into ranges, a task each. A first pass reads what body each page has; from the ends of the ranges follows
which page beyond a cut a range needs (one on either side at most), and the second pass carries that page over. So the
result is that of one range, whatever their number.

Differencing alone would also delete what two articles have in common (quoted passages, copies of an article), and it keeps
menus that differ between pages, so markup decides first: lines in menus, headers, footers, asides, forms, adverts,
notices, comments and the like go in any case, and lines inside an article or main element stay although a neighbour has
them. Lines of pages without such an element are kept or deleted by the alignment. Class names and ids count by their whole
name, first or last part; they drop neither an article or main element itself, nor the main element or the page's only
articles inside.

Defined results: null html and null urls are empty; an empty page has an empty text; a page alone on its host has
nothing to share, nor has one whose host has copies of it only; copies are differenced with the next other page, and their
articles stay; unclosed tags and quotes end with the page; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import pickle
import re
import tempfile
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from hashlib import blake2b
from html import unescape
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import Scratch, tidy

NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
QUOTE = re.compile(r"[\"'>]")
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

# Element names of HTML by their role, and words in class and id that name what isn't the article.
RAW = frozenset("script style".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details dialog div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
LIKE = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
DROPPED = frozenset(
    "head title nav footer aside form script style noscript template iframe object embed svg math canvas audio video button select textarea input datalist dialog menu map applet frameset".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split())
NAMED = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar sidenav footer cookie cookies consent gdpr notice notices "
    "alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments commentlist reply replies respond disqus widget widgets masthead toolbar "
    "pagination pager skip".split()
)
HEADERS = frozenset("header banner topbar".split())
#: Words beside such a name that make it the state of something else (no-sidebar, comments-open), and names that say so only at a name's beginning (elementor-widget).
STATES = frozenset("has no not non with without is open opened closed on off none enabled disabled active collapsed accepted".split())
BEGINS = frozenset("widget widgets".split())
MAIN = frozenset(("article", "main"))
# Elements that end tags don't reach beyond.
WALLS = {"p": frozenset("article main section div td th li blockquote body".split()), "like": frozenset("ul ol dl table menu select article main".split()), "inner": MAIN, "none": frozenset()}
INNER = frozenset("p li div span".split())

#: Of one line, as many places are listed as bits are set one by one; of other lines the bits are kept.
OFTEN = 64
#: Pairs of equal lines that an alignment lists; with more of them, rows of bits are compared.
MATCHES = 1 << 21

#: Bytes of a row of copies that are held in memory while the page after them is looked for; more go to a file of the task.
HELD = 1 << 24


def _attributes(s: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(s)} if s.strip(" \t\r\n\f/") else {}


def _names(attributes: dict[str, str]) -> set[str]:
    """What class names and ids call an element: the whole name, or its first or last part."""
    out: set[str] = set()
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split():
        parts = [x for x in re.split(r"[^a-z0-9]+", name) if x]
        if parts and STATES.isdisjoint(parts):
            out.add(parts[0])
            if parts[-1] not in BEGINS:
                out.add(parts[-1])
    return out


KEPT, BY_NAME, OUT, HELD_ARTICLE = range(4)


def _main(tag: str, attributes: dict[str, str]) -> str:
    """article, main or nothing."""
    role = attributes.get("role", "").lower()
    return tag if tag in MAIN else role if role in MAIN else ""


def _dropped(tag: str, attributes: dict[str, str], in_main: bool) -> int:
    if tag in DROPPED or (tag == "header" and not in_main):
        return OUT
    if not attributes or tag in ("html", "body"):
        return KEPT
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attributes.get("style", "")):
        return OUT
    if attributes.get("role", "").lower() in ROLES:
        return OUT
    if _main(tag, attributes):
        return KEPT
    named = _names(attributes)
    return BY_NAME if named & NAMED or (not in_main and named & HEADERS) else KEPT


def _inside(outer: int, here: int, main: str, in_article: bool) -> int:
    """How an element in one of state outer is kept. A name doesn't decide over a main element inside, and over an article
    only when the page has others."""
    if OUT in (outer, here) or (here == BY_NAME and (in_article or outer == HELD_ARTICLE)):
        return OUT
    if outer == BY_NAME and main:
        return KEPT if main == "main" else HELD_ARTICLE
    return here if outer == KEPT else outer


Line = tuple[str, str]


class _Tokens:
    """Tags and comments of a page, in a number of steps in proportion to its length whatever stands in it."""

    def __init__(self, html: str):
        self.html = html
        self.last = html.rfind(">")
        self.vain: list[tuple[list[int], list[int]]] = []  # where quotes began and ended in searches that found no end

    def _end(self, at: int) -> int:
        """The end of a tag whose attributes start here: the first > outside quotes; if there is none, the first one. Searches
        that come to nothing run to the end of the page; one that starts outside the quotes of an earlier one would run as it did."""
        for begins, ends in self.vain:
            k = bisect_right(begins, at) - 1
            if k < 0 or ends[k] <= at:
                return self.html.find(">", at)
        begins, ends, i = [], [], at
        while m := QUOTE.search(self.html, i):
            if m[0] == ">":
                return m.start()
            i = self.html.find(m[0], m.end()) + 1
            begins.append(m.start())
            ends.append(i or len(self.html) + 1)
            if not i:
                break
        self.vain.append((begins, ends))
        return self.html.find(">", at)

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """Start, end, whether it closes, name and attributes of the next tag; without a name, what isn't a tag, with its text."""
        html = self.html
        while (at := html.find("<", at)) >= 0:
            if html.startswith("<!--", at):
                end = html.find("-->", at + 4)
                return at, end + 3 if end >= 0 else len(html), False, "", ""
            if html.startswith("<![CDATA[", at):
                end = html.find("]]>", at + 9)
                return at, end + 3 if end >= 0 else len(html), False, "", html[at + 9 : end if end >= 0 else len(html)]
            if self.last > at:
                if html.startswith(("<!", "<?"), at):
                    return at, html.find(">", at) + 1, False, "", ""
                if m := NAME.match(html, at + 1):
                    end = self._end(m.end())
                    if end >= 0:
                        return at, end + 1, bool(m[1]), m[2].lower(), html[m.end() : end]
            at += 1
        return None


def lines_of(html: str) -> list[Line]:
    """Text lines of a page in order, each with its region: out (never the article), main (inside article or main), other."""
    out: list[Line] = []
    stack: list[tuple[str, int, bool, bool]] = []  # name, state, in main or article, in article; they hold for all inside
    places: dict[str, list[int]] = {}  # of the elements of a name in the stack
    held: list[str] = []

    def flush() -> None:
        if held:
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                _, state, main, _ = stack[-1] if stack else ("", KEPT, False, False)
                out.append((text, "held" if state == HELD_ARTICLE else "out" if state else "main" if main else "other"))

    def innermost(names: frozenset[str] | tuple[str, ...]) -> int:
        return max((places[x][-1] for x in names if places.get(x)), default=-1)

    def close(names: tuple[str, ...], walls: frozenset[str]) -> None:
        i = innermost(names)
        if i < 0 or i < innermost(walls):
            return
        flush()
        while len(stack) > i:
            places[stack.pop()[0]].pop()

    tokens = _Tokens(html)
    at, end = 0, len(html)
    while at < end:
        token = tokens.next(at)
        text = html[at : token[0] if token else end]
        if text:
            held.append(unescape(text))
        if not token:
            break
        _, at, closes, tag, own_text = token
        if not tag:
            if own_text:
                held.append(own_text)
            continue
        if closes:
            if tag not in INLINE:
                flush()
            close((tag,), WALLS["inner" if tag in INLINE or tag in INNER else "none"])
            continue
        attributes = _attributes(own_text)
        if tag not in INLINE:
            flush()
        if tag in CLOSES_P:
            close(("p",), WALLS["p"])
        if tag in LIKE:
            close(tuple(LIKE[tag].split()), WALLS["like"])
        if tag in RAW:
            close_at = re.compile(rf"</{tag}[\s/>]", re.I).search(html, at)
            stop = html.find(">", close_at.end() - 1) if close_at else -1
            at = stop + 1 if stop >= 0 else end
            continue
        if tag in VOID:
            continue
        if own_text.endswith("/") and tag in ("svg", "path", "use"):
            continue
        _, state, main, article = stack[-1] if stack else ("", KEPT, False, False)
        here = _dropped(tag, attributes, main)
        if tag in INLINE and not here:
            continue  # unclosed inline elements would only pile up
        if here and tag in INLINE:
            flush()
        own = _main(tag, attributes)
        places.setdefault(tag, []).append(len(stack))
        stack.append((tag, _inside(state, here, own, article), main or bool(own), article or own == "article"))
    flush()
    held_is = "out" if any(region == "main" for _, region in out) else "main"
    return [(x, held_is if region == "held" else region) for x, region in out]


def _few(a: list[str], b: list[str], places: dict[str, list[int]]) -> list[int]:
    """Places in a of a longest common subsequence, by a longest increasing one over all matches: r log n steps for r matches."""
    tails: list[int] = []
    last: list[tuple] = []  # chains of (place in a, chain before it)
    for i, x in enumerate(a):
        for at in reversed(places.get(x, ())):
            j = bisect_left(tails, at)
            node = (i, last[j - 1] if j else None)
            if j == len(tails):
                tails.append(at)
                last.append(node)
            else:
                tails[j], last[j] = at, node
    out, node = [], last[-1] if last else None
    while node:
        out.append(node[0])
        node = node[1]
    return out[::-1]


class _Rows:
    """Rows of the table of common lengths of lines with b, a bit for each line of b: a bit is 0 where the length grows."""

    def __init__(self, b: list[str]):
        self.size = len(b)
        self.places: dict[str, list[int]] = {}
        for j, x in enumerate(b):
            self.places.setdefault(x, []).append(j)
        self.masks: dict[str, int] = {}

    def mask(self, x: str) -> int:
        if x in self.masks:
            return self.masks[x]
        bits = bytearray(self.size // 8 + 1)
        for j in self.places[x]:
            bits[j >> 3] |= 1 << (j & 7)
        found = int.from_bytes(bits, "little")
        if len(self.places[x]) > OFTEN:
            self.masks[x] = found
        return found

    def lengths(self, a: list[str]) -> np.ndarray:
        """Length of a longest common subsequence of a with each beginning of b."""
        full = (1 << self.size) - 1
        row = full
        for x in a:
            if x in self.places:
                both = row & self.mask(x)
                row = ((row + both) | (row - both)) & full
        bits = np.unpackbits(np.frombuffer(row.to_bytes(self.size // 8 + 1, "little"), np.uint8), bitorder="little")[: self.size]
        return np.concatenate([np.zeros(1, np.int64), np.cumsum(1 - bits.astype(np.int64))])


def _many(a: list[str], b: list[str], start: int) -> list[int]:
    """The same by halving a: the rows of either half show where b is to be cut. Memory in proportion to the lines."""
    if not a or not b:
        return []
    if len(a) == 1:
        return [start] if a[0] in b else []
    half = len(a) // 2
    ahead, back = _Rows(b).lengths(a[:half]), _Rows(b[::-1]).lengths(a[half:][::-1])
    cut = int(np.argmax(ahead + back[::-1]))
    return _many(a[:half], b[:cut], start) + _many(a[half:], b[cut:], start + half)


def shared(a: list[str], b: list[str]) -> set[int]:
    """Places in a of a longest common subsequence with b. Lines that stand in one of them only can't be in it; where few pairs
    of places match, it is an increasing sequence of them, else rows of bits are compared."""
    low, most = 0, min(len(a), len(b))
    while low < most and a[low] == b[low]:
        low += 1
    high = 0
    while high < most - low and a[-1 - high] == b[-1 - high]:
        high += 1
    out = {*range(low), *range(len(a) - high, len(a))}
    mine, theirs = a[low : len(a) - high], b[low : len(b) - high]
    both = set(mine) & set(theirs)
    at = [i for i, x in enumerate(mine) if x in both]
    x, y = [mine[i] for i in at], [t for t in theirs if t in both]
    places: dict[str, list[int]] = {}
    for j, t in enumerate(y):
        places.setdefault(t, []).append(j)
    found = _few(x, y, places) if sum(len(places[t]) for t in x) <= MATCHES else _many(x, y, 0)
    return out | {low + at[i] for i in found}


def main_text(page: list[Line], neighbour: list[Line] | None) -> str:
    """The lines that differencing and markup leave, joined by one space."""
    gone = shared([x for x, _ in page], [x for x, _ in neighbour]) if neighbour else set()
    has_main = any(region == "main" for _, region in page)
    return " ".join(x for i, (x, region) in enumerate(page) if region == "main" or (region == "other" and not has_main and i not in gone))


def _common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def body_of(page: list[Line]) -> list[str]:
    return [x for x, region in page if region != "out"]


def _paired(pages: Iterator[tuple]) -> Iterator[tuple]:
    """page_id, url and text of sorted pages (page_id, url, host, path, lines, carried). Pages of one body in a row are held
    until the next other page of the host is there, in a file when they are many; else three pages are held. Pages carried
    over from another range are only differenced with."""
    host = body = before = last = None  # before, last: path and lines of the last page of the run before, of this run
    n = 0
    with tempfile.SpooledTemporaryFile(HELD) as run:

        def ended(after: tuple | None) -> Iterator[tuple]:
            run.seek(0)
            lines, done = None, {}
            for _ in range(n):
                page_id, url, path, own, carried = pickle.load(run)
                if own is not None:
                    lines, done = own, {}
                if carried:
                    continue
                best = max((x for x in (before, after) if x is not None), key=lambda x: _common(x[0], path), default=None)
                if id(best) not in done:
                    done[id(best)] = main_text(lines, best[1] if best else None)
                yield page_id, url, done[id(best)]
            run.seek(0)
            run.truncate()

        for page_id, url, at, path, lines, carried in pages:
            words = body_of(lines)
            if not words:
                yield page_id, url, ""
                continue
            if at != host or words != body:
                yield from ended((path, lines) if at == host else None)
                before = last if at == host else None
                host, body, last, n = at, words, None, 0
            pickle.dump((page_id, url, path, None if last and last[1] == lines else lines, carried), run)
            last, n = (path, lines), n + 1
        yield from ended(None)


Key = tuple[str, str, bool, int, int]
Page = tuple[Key, bytes]  # its place in the order and its body's digest
ORDER = ("host", "path", "page_id", "tie")
KEYS = [("host", pa.string()), ("path", pa.string()), ("page_id", pa.int64()), ("tie", pa.int64())]
BODIES = pa.schema([*KEYS, ("body", pa.binary())])
ENDS = pa.schema([("range", pa.int32()), *BODIES])
LAID = pa.schema([("range", pa.int32()), *KEYS, ("url", pa.string()), ("carried", pa.bool_()), ("lines", pa.string())])
MARK = {"other": "o", "main": "m", "out": "-"}
REGIONS = {v: k for k, v in MARK.items()}
TEXTS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for b in batches:
        for part in (b.slice(i, 512) for i in range(0, b.num_rows, 512)):
            yield from zip(*(part.column(part.schema.get_field_index(n)).to_pylist() for n in names), strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for part in batched(rows, 512):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)


def _key(host: str, path: str, page_id: int | None, tie: int) -> Key:
    """Orders as Spark does: null ids first."""
    return host, path, page_id is not None, page_id or 0, tie


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each page's body, null where it has none."""
    rows = ((*key, body_of(lines_of(html))) for *key, html in _rows(batches, *ORDER, "html"))
    return _batches(((*key, blake2b("\n".join(b).encode(), digest_size=16).digest() if b else None) for *key, b in rows), BODIES)


def _seen(state: tuple[Page | None, Page | None], page: Page) -> tuple[Page, Page | None]:
    """The last page and the last one of its host with another body, after one page more."""
    last, other = state
    if last is None or last[0][0] != page[0][0]:
        return page, None
    return page, last if last[1] != page[1] else other


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted range: its first page; the first one with a body and the first other body of that host; and the same
    from its end."""
    first, head, tail = None, [], (None, None)
    for *key, body in _rows(batches, *ORDER, "body"):
        page = (_key(*key), body)
        first = first or page
        if body is not None:
            if not head or (len(head) == 1 and head[0][0][0] == page[0][0] and head[0][1] != body):
                head.append(page)
            tail = _seen(tail, page)
    kept = {x[0]: x for x in (first, *head, *tail) if x}
    at = TaskContext.get().partitionId()
    yield from _batches(((at, h, p, i if some else None, t, body) for (h, p, some, i, t), body in kept.values()), ENDS)


def _cuts(ends: list[tuple]) -> tuple[list[Key], dict[Key, list[int]]]:
    """The first place of each range, and for the pages that are needed beyond their range, the ranges that need them."""
    found: dict[int, list[Page]] = {}
    for at, *key, body in ends:
        found.setdefault(at, []).append((_key(*key), body))
    ranges = sorted((sorted(x, key=lambda p: p[0]) for x in found.values()), key=lambda x: x[0][0])
    carried: dict[Key, list[int]] = {}
    for step in (1, -1):
        state = (None, None)
        for i in range(len(ranges))[::step]:
            pages = [p for p in ranges[i][::step] if p[1] is not None]
            if pages and (near := _seen(state, pages[0])[1]):
                carried.setdefault(near[0], []).append(i)
            for p in pages:
                state = _seen(state, p)
    return [x[0][0] for x in ranges], carried


def _lay(first: list[Key], carried: dict[Key, list[int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Parses pages and gives each its range; a page that others need goes to them, too."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        sent = set()
        for *key, url, html in _rows(batches, *ORDER, "url", "html"):
            place = _key(*key)
            lines = "\n".join(MARK[region] + x for x, region in lines_of(html))
            yield max(bisect_right(first, place) - 1, 0), *key, url, False, lines
            if place in carried and place not in sent:
                sent.add(place)
                yield from ((at, *key, url, True, lines) for at in carried[place])

    return lambda batches: _batches(rows(batches), LAID)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams sorted pages of one or more ranges."""

    def pages() -> Iterator[tuple]:
        for at, host, path, page_id, url, carried, lines in _rows(batches, "range", "host", "path", "page_id", "url", "carried", "lines"):
            yield page_id, url, (at, host), path, [(x[1:], REGIONS[x[0]]) for x in lines.split("\n")] if lines else [], carried

    return _batches(((page_id, url, text, len(text)) for page_id, url, text in _paired(pages())), TEXTS)


def extracted(pages: DataFrame, partitions: int | None = None) -> DataFrame:
    """page_id, url, text, n_chars for every page. One shuffle of the pages' lines, by ranges of (host, path, id): a hot host
    is spread over as many ranges as it fills, and each range is streamed. Pages are parsed twice; at most five places of
    each range reach the driver."""
    n = partitions or int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    x = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)).alias("host"),
        F.regexp_extract(url, r"^(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*)?([^?#]*)", 1).alias("path"), html.alias("html"), F.xxhash64(html).alias("tie"),
    )
    keys = "host string, path string, page_id long, tie long"
    with Scratch(pages.sparkSession) as scratch:
        bodies = scratch.written(x.select(*ORDER, "html").mapInArrow(tidy(_bodies), f"{keys}, body binary"), "bodies")
        ends = bodies.repartitionByRange(n, *ORDER).sortWithinPartitions(*ORDER).mapInArrow(_ends, f"range int, {keys}, body binary").collect()
    first, carried = _cuts([(r["range"], r["host"], r["path"], r["page_id"], r["tie"], r["body"] and bytes(r["body"])) for r in ends])
    laid = x.mapInArrow(tidy(_lay(first, carried)), f"range int, {keys}, url string, carried boolean, lines string")
    laid = laid.repartitionById(max(n, len(first)), "range").sortWithinPartitions("range", *ORDER)
    return laid.mapInArrow(tidy(_extract), "page_id long, url string, text string, n_chars long")
