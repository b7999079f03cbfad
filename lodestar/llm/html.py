"""HTML extraction by nearest-URL page differencing.

Pages are sorted by host and path, so that the nearest URL of a page stands beside it; a hot host spreads over
many range partitions. Each page is cut into text lines (one per block) with the region they stand in. All
lines of a page and of its nearest neighbour on the host are aligned by longest common subsequence, and shared
lines are deleted; of a marked article only the lines with which those of the pages on both sides end too, and lines
under names like `share` or `alert` that a neighbour has as well, unless it is a copy of theirs.
Menus, adverts and the like that differ from page to page are told by the elements they stand in.
"""

from __future__ import annotations

import html as _html
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import pieces

# Fixed lists of element names and of words in class, id and role attributes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp noframes".split())
SKIPPED = frozenset("head nav footer aside form button select dialog menu svg object canvas audio video fieldset".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert sidebar sidebars menu menus nav navbar navigation "
    "breadcrumb breadcrumbs footer comment comments reply replies respond disqus discussion share sharing social related newsletter subscribe subscription popup modal overlay widget widgets masthead toolbar pagination "
    "contentinfo complementary search login signup".split()
)
#: Of these an article may speak itself: inside one they count only where a neighbour has the same line.
WEAK = frozenset("alert notice notices banner promo promotion discussion share sharing social related search login signup reply replies respond subscription widget widgets section".split())
PLACES = frozenset("box list wrapper wrap container section area block left right top bottom inner outer main primary secondary site page global bar unit slot form link links row col column panel group body content header text".split())
PAGE_TOP = frozenset(("header", "topbar"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An opening tag closes an open element of the same group.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "option": ("option",)}
LIST_ROOTS = frozenset("ul ol dl table select menu".split())
#: Bits of the alignment's table that are kept at once.
LCS_BITS = 1 << 27
#: An article is a copy of the neighbour's when so many hundredths of its characters stand in shared lines.
COPY_PERCENT = 50

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z", re.S)
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_COMMENT = re.compile(r"comment|reply|replies", re.I)
_PART = re.compile(r"[^a-z0-9]+")
_SENTENCE = re.compile(r"[.!?…。！？][\"'”’»)\]]*$")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _is_noise(attributes: str) -> bool:
    """Whether a class, id or role name says so as a whole: a word of NOISE, alone or with words that only place it."""
    return _noise(attributes) > 0


def _noise(attributes: str) -> int:
    """2 where some name of an element says that it is noise, 1 where only words of WEAK say so, else 0."""
    found = 0
    for m in _NAMES.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").split():
            parts = set(_PART.split(_CAMEL.sub(" ", name).lower())) - {""}
            if parts & NOISE and all(p in NOISE or p in PLACES or p.isdigit() for p in parts):
                found = max(found, 2 if parts & NOISE - WEAK else 1)
    return found


def _is_top(attributes: str) -> bool:
    return any(n.lower() in PAGE_TOP for m in _NAMES.finditer(attributes) for n in (m[1] or m[2] or m[3] or "").split())


def lines_of(page: str | None) -> list[tuple[str, int]]:
    """(line, region) per block with text: region 2 in an article, 1 in main, 0 elsewhere, -1 in menus, forms and the like.

    Region 3 is what stands in an article under a name that may be the article's or the site's, or beside the headings
    in the article's own header.

    Character references are decoded in each piece of text by itself, never across a tag. Null and empty pages have
    no lines; an unclosed tag or comment at the end is dropped, and so are scripts, styles and other raw elements.
    """
    out: list[tuple[str, int]] = []
    if not page:
        return out
    # tag, skipped, region, whether what stands here may be the site's: 2 by its name, 1 in an article's header but for headings
    stack: list[tuple[str, bool, int, int]] = []
    text: list[str] = []
    weak_text: list[str] = []
    noise_text: list[str] = []
    skipped, region, top = False, 0, 0

    def flush() -> None:
        for pieces, of in ((text, region), (weak_text, 3), (noise_text, -1)):
            line = " ".join("".join(pieces).split())
            pieces.clear()
            if line:
                out.append((line, of))

    def now() -> tuple[bool, int, int]:
        return (stack[-1][1], stack[-1][2], stack[-1][3]) if stack else (False, 0, 0)

    at, size = 0, len(page)
    while at < size:
        m = _TAG.search(page, at)
        end = m.start() if m else size
        if end > at:
            weak = top == 2 or top == 1 and not any(s[0] in HEADINGS for s in stack[-2:])
            (noise_text if skipped else weak_text if weak else text).append(_html.unescape(page[at:end]))
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        block = tag in BLOCKS
        if tag == "br":
            (noise_text if skipped else weak_text if top else text).append(" ")
            continue
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if block:
                        flush()
                    del stack[k:]
                    break
            else:
                if block:
                    flush()
            skipped, region, top = now()
            continue
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = stop.end() if stop else size
            continue
        if block:
            flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in LIST_ROOTS and tag in CLOSES:
                    break
                if stack[k][0] == "p" or stack[k][0] in CLOSES.get(tag, ()):
                    del stack[k:]
                    break
                if stack[k][0] not in HEADINGS and stack[k][0] not in CLOSES.get(tag, ()) and tag not in CLOSES:
                    break
            skipped, region, top = now()
        if tag in VOID or attributes.endswith("/"):
            continue
        named = "=" in attributes
        level = _noise(attributes) if named and tag not in ("html", "body", "main") and not (tag == "article" and region == 0 and not _COMMENT.search(attributes)) else 0
        weak = level == 1 and region == 2 and tag not in SKIPPED
        noise = tag in SKIPPED or level > 0 and not weak
        if (tag == "header" or named and tag not in ("html", "body", "article", "main") and _is_top(attributes)) and region < 2:
            noise = True
        if block or noise or weak:
            inner = 2 if tag == "article" else max(region, 1) if tag == "main" else region
            stack.append((tag, skipped or noise, inner, 2 if weak else top or int(tag == "header" and region == 2)))
            skipped, region, top = now()
    flush()
    return out


def _marks(b: list[str]) -> dict[str, int]:
    """The places of each line of b as bits."""
    marks: dict[str, int] = {}
    for j, x in enumerate(b):
        marks[x] = marks.get(x, 0) | 1 << j
    return marks


def _lengths(a: list[str], b: list[str]) -> np.ndarray:
    """LCS lengths of a with b[:0] .. b[:len(b)]."""
    marks, full = _marks(b), (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & marks.get(x, 0)
        v = ((v + u) | (v - u)) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes(-(-len(b) // 8), "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def common(a: list[str], b: list[str]) -> list[bool]:
    """Which lines of a stand in a longest common subsequence with b (bit-parallel, one big integer per line).

    Long pages are halved where the alignment passes (Hirschberg), so memory stays within LCS_BITS bits.
    """
    if len(a) * len(b) > LCS_BITS and len(a) > 1:
        mid = len(a) // 2
        j = int((_lengths(a[:mid], b) + _lengths(a[mid:][::-1], b[::-1])[::-1]).argmax())
        return common(a[:mid], b[:j]) + common(a[mid:], b[j:])
    marks, full = _marks(b), (1 << len(b)) - 1
    v, rows = full, []
    for x in a:
        rows.append(v)
        u = v & marks.get(x, 0)
        v = ((v + u) | (v - u)) & full
    out, j = [False] * len(a), len(b) - 1
    after = v
    for i in range(len(a) - 1, -1, -1):
        # a zero bit j means that the LCS with b[:j+1] is one longer than with b[:j]
        while j >= 0 and after >> j & 1:
            j -= 1
        if j < 0:
            break
        before = rows[i]
        if before >> j & 1:
            out[i] = True
            j -= 1
        after = before
    return out


def decided(lines: list[tuple[str, int]], near: list[tuple[str, int]] | None, other: list[tuple[str, int]] | None = None) -> list[str]:
    """What becomes of each line: "shared" (a neighbour has it), "structure" (a menu, form or the like, or outside the article) or "kept".

    near and other are the pages beside this one in URL order, the nearest first. All lines are aligned, menus and
    the like too, and those shared with the nearest page go. Of the article itself only its last lines go, as far as
    the articles on both sides end with the same ones and these are no sentences, as a notice of the site is and a
    passage quoted from another article is not; lines of region 3 go where one of the pages shares them. An article that shares COPY_PERCENT of
    its characters with the nearest page is a copy and stays whole. Where a page has an article, else main, the lines
    outside it go; an article with less text than the unshared lines of main (else of the rest) outside it is a teaser,
    and those lines stay too.
    """
    best = min(max((r for _, r in lines), default=0), 2)
    own = [x for x, _ in lines]
    none = [False] * len(lines)
    shared = common(own, [x for x, _ in near]) if near else none
    if best == 2:
        size = lambda region, gone: sum(len(x) for (x, r), g in zip(lines, shared, strict=True) if min(r, 2) == region and g == gone)
        copied = 100 * size(2, True) >= COPY_PERCENT * (size(2, True) + size(2, False))
        if copied:
            shared = [g and r < 2 for (_, r), g in zip(lines, shared, strict=True)]
        else:
            last = _last_lines(lines, near, other)
            also = common(own, [x for x, _ in other]) if other and any(r == 3 for _, r in lines) else none
            shared = [k in last or (r == 3 and (g or b)) or (r < 2 and g) for k, ((_, r), g, b) in enumerate(zip(lines, shared, also, strict=True))]
        rest = 1 if size(1, False) else 0
        if size(rest, False) > size(2, False):
            best = rest
    best = max(best, 0)
    return ["shared" if g else "kept" if r >= best else "structure" for (_, r), g in zip(lines, shared, strict=True)]


def _last_lines(lines: list[tuple[str, int]], *pages: list[tuple[str, int]] | None) -> set[int]:
    """Places of the lines with which the article ends and those of both other pages end too, up to a full sentence."""
    if not all(pages):
        return set()
    own = [k for k, (_, r) in enumerate(lines) if r == 2]
    others = [[x for x, r in p if r == 2] for p in pages]
    n = 0
    while n < min(map(len, (own, *others))) and all(o[-1 - n] == lines[own[-1 - n]][0] for o in others) and not _SENTENCE.search(others[0][-1 - n]):
        n += 1
    return set(own[len(own) - n :])


def main_text(lines: list[tuple[str, int]], near: list[tuple[str, int]] | None = None, other: list[tuple[str, int]] | None = None) -> str:
    return "\n".join(x for (x, _), what in zip(lines, decided(lines, near, other), strict=True) if what == "kept")


def _nearness(a: str, b: str) -> tuple[int, int]:
    """Path segments that two paths begin with alike, then characters."""

    def alike(x, y):
        return next((n for n, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))

    return alike(a.split("/"), b.split("/")), alike(a, b)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pages; each is finished when the next one of its part is there. Guests are neighbours only."""

    def rows():
        nonlocal kind
        for b in pieces(batches, 4):
            kind = b.column(0).type
            for k in range(b.num_rows):
                i, u, h, p, x, part, guest = (b.column(c)[k].as_py() for c in range(7))
                yield i, u, h, p, lines_of(x), part, guest

    def done(before, row, after):
        i, u, h, p, lines, part, _ = row
        near = [r for r in (before, after) if r is not None and r[2] == h and r[5] == part]
        near.sort(key=lambda r: _nearness(r[3], p), reverse=True)
        return i, u, main_text(lines, *[r[4] for r in near])

    kind = None

    def batch(part):
        ids, urls, texts = zip(*part, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(urls, pa.string()), pa.array(texts, pa.string())], ["__id", "__url", "text"])

    before, row, part = None, None, []
    for after in rows():
        if row is not None and not row[6]:
            part.append(done(before, row, after))
            if len(part) >= 256:
                yield batch(part)
                part = []
        before, row = row, after
    if row is not None and not row[6]:
        part.append(done(before, row, None))
    if part:
        yield batch(part)


KEY = ("__host", "__path", "__id")
#: Keys sampled for each part to find the bounds between the parts.
SAMPLED = 40


def _bounds(keys: DataFrame, n: int) -> list[tuple]:
    """At most n - 1 keys that cut the table into parts of about equal size."""
    total = keys.count() if n > 1 else 0
    if not total:
        return []
    sample = sorted((tuple(r) for r in keys.sample(min(1.0, SAMPLED * n / total), seed=1).collect()), key=lambda k: (k[0], k[1], k[2] is not None, k[2]))
    return list(dict.fromkeys(sample[len(sample) * k // n] for k in range(1, n))) if sample else []


def _part(bounds: list[tuple], kind: str) -> Column:
    """How many bounds are at or below a row's key (binary search)."""
    if not bounds:
        return F.lit(0)
    # one constant of the plan, however many parts there are
    table = F.from_json(F.lit(json.dumps([{"h": h, "p": p, "i": i} for h, p, i in bounds])), f"array<struct<h: string, p: string, i: {kind}>>")
    key = F.struct(F.col("__host").alias("h"), F.col("__path").alias("p"), F.col("__id").alias("i"))
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.coalesce(F.get(table, at + step - 1) <= key, F.lit(False)), at + step).otherwise(at))


def _ties() -> list[Column]:
    """Order of pages with one key."""
    return [F.xxhash64("__html"), F.xxhash64("__url")]


def _guests(rows: DataFrame) -> DataFrame | None:
    """The last page of each part for the next part with pages, and the first for the one before, if of one host."""
    key = F.struct(*KEY)
    ends = sorted(rows.groupBy("__part").agg(F.min(key).alias("low"), F.max(key).alias("high")).collect())
    sent = [x for a, b in zip(ends, ends[1:]) if a["high"]["__host"] == b["low"]["__host"] for x in ((*a["high"], b["__part"], True), (*b["low"], a["__part"], False))]
    if not sent:
        return None
    to = rows.sparkSession.createDataFrame(sent, f"h string, p string, i {rows.schema['__id'].dataType.simpleString()}, to int, last boolean")
    met = rows.join(F.broadcast(to), (F.col("__host") == F.col("h")) & (F.col("__path") == F.col("p")) & F.col("__id").eqNullSafe(F.col("i")))
    page, ties = F.struct("__url", "__html"), F.struct(*_ties())
    # of pages with one key, the one that stands at the border
    one = met.groupBy("to", "last", *KEY).agg(F.when(F.col("last"), F.max_by(page, ties)).otherwise(F.min_by(page, ties)).alias("x"))
    return one.select("__id", "x.__url", "__host", "__path", "x.__html", F.col("to").alias("__part"), F.lit(True).alias("__guest"))


def extract_pages(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page, url, text, n_chars) for each row. Null html gives an empty text, null URLs sort as empty ones.

    The neighbour is the one beside the page in host and path order with the longer common path, the earlier of
    two equal ones. The order is cut into parts by sampled keys, and the pages at both sides of a cut visit the
    other part, so the cuts change no result. A page alone on its host has no neighbour. Repeated rows are
    neighbours like any others and each gives a row. Ids may be null and of any type that can be ordered.
    """
    from lodestar.llm.urls import host_of, path_of

    rows = pages.select(F.col(f"`{page}`").alias("__id"), F.col(f"`{url}`").alias("__url"), host_of(F.col(f"`{url}`")).alias("__host"), path_of(F.col(f"`{url}`")).alias("__path"), F.col(f"`{html}`").alias("__html"))
    kind = rows.schema["__id"].dataType.simpleString()
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = _bounds(rows.select(*KEY), n)
    rows = rows.withColumn("__part", _part(bounds, kind))
    guests = _guests(rows) if bounds else None
    dealt = rows.withColumn("__guest", F.lit(False))
    dealt = (dealt.unionByName(guests) if guests else dealt).repartitionById(n, F.col("__part"))
    sorted_ = dealt.sortWithinPartitions("__part", *KEY, *_ties())
    out = sorted_.mapInArrow(_extract, f"__id {kind}, __url string, text string")
    return out.select(F.col("__id").alias(page), F.col("__url").alias(url), "text", F.length("text").cast("long").alias("n_chars"))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
