r"""HTML extraction by page differencing, with what a page declares as the check of its verdict.

A page is cut into text blocks. Menus, headers, footers, asides, forms, scripts and what
class, id or role call an advert, notice, comment and so on go at once. Where the page has
``article`` elements (else ``main``) with text, their blocks are left; a page that declares none
is *open* and all blocks are. Every page with text is then compared with its nearest URLs: pages
of a host are ordered by path (open ones and others apart), each is aligned line by line with the
page before and after it (longest common subsequence), and shared lines are the site's frame.
An open page loses these lines. In a page that declares articles lines that it shares (a licence,
a quoted passage) belong to them and stay, but an article element all of whose lines are shared
(a teaser, a list of what else there is) is frame and goes, where another one has lines of its
own. Two pages that share over ``COPY`` of either one's characters are copies of each other rather
than of a frame, so that pair deletes nothing.

Lines are compared by 128 bits, and only these are shuffled; a text meets the places of its lines
that go, if any do.
Equal texts of a host are one representative with members, so a page is never compared with
its own copy. Order comes from a range-partitioned sort, pairs from an equi-join on places:
a host, of any size, is split over tasks; a pair is two pages.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored, table
from .url_filter import host_of, path_of

#: Share of a page's characters from which a neighbour counts as a copy.
COPY = 0.9
#: Bits of alignment state held at once (32 MB); longer pairs are split first.
STATE_BITS = 1 << 28
SALTS = 16

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe object svg math canvas textarea xmp noembed noframes title".split())
_DROPPED = frozenset("head nav footer aside form menu dialog button select datalist audio video map".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html "
    "legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An element that starts closes an open one of these.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Words of class, id and role that mark what is no part of an article.
_MARKS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices notification "
    "alert newsletter subscribe subscription signup popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar aside header masthead footer colophon "
    "share sharing social related recommended comment comments commentlist respond disqus reply replies widget widgets pagination pager toolbar topbar skip login search "
    "complementary contentinfo".split()
)
_COMMENTS = frozenset("comment comments commentlist reply replies disqus".split())
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"<]*"|'[^'<]*'|["'])*?)>|<[!?][^>]*>""", re.S)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


# --------------------------------------------------------------------------------------
# one page


@lru_cache(maxsize=4096)
def _marks(attributes: str) -> tuple[frozenset[str], bool]:
    """(words of class, id and role that are marks, whether the element is hidden)."""
    words = {w.lower() for _, v in _NAMES.findall(attributes) for w in _PARTS.findall(v)}
    return frozenset(words & _MARKS), bool(_HIDDEN.search(attributes))


def blocks(page: str):
    """(zone, element, text) of the page's blocks that no markup rules out, in order; zones are
    ``article``, ``main`` and ``open``, elements the outermost ones of a zone, numbered."""
    out, held = [], []
    stack = [("", 0, "open", 0)]  # tag, 0 kept / 1 article header / 2 left out, zone, element
    elements = 0
    opened: dict[str, int] = {}

    def flush():
        text = " ".join(entities.unescape("".join(held)).split())
        if text:
            out.append((*stack[-1][2:], text))
        held.clear()

    def close(tag):
        while True:
            name = stack.pop()[0]
            opened[name] -= 1
            if name == tag:
                return

    at = 0
    while True:
        found = _TAG.search(page, at)
        upto = found.start() if found else len(page)
        if not stack[-1][1] and upto > at:
            held.append(page[at:upto])
        if not found:
            flush()
            return out
        at = found.end()
        ends, tag, attributes = found.group(1), found.group(2), found.group(3)
        if tag is None:
            continue
        tag = tag.lower()
        if tag in _BLOCK:
            flush()
        elif tag == "br":
            held.append(" ")
        if ends:
            if opened.get(tag):
                close(tag)
            continue
        if tag in _RAW:
            if not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag in _VOID:
            continue
        if tag in _BLOCK and opened.get("p"):
            close("p")
        for other in _CLOSES.get(tag, ()):
            if stack[-1][0] == other:
                close(other)
        _, left, zone, element = stack[-1]
        marks, hidden = _marks(attributes) if attributes.strip() else (frozenset(), False)
        if tag in ("html", "body"):
            marks, hidden = frozenset(), False
        elif tag in ("article", "main"):
            marks = marks & _COMMENTS
        if left == 1 and tag in _HEADINGS:
            left = 0
        if tag in _DROPPED or hidden or (marks and tag not in _HEADINGS):
            left = 2
        elif tag == "header":
            left = max(left, 1 if zone == "article" else 2)
        if not left and (tag == "article" and zone != "article" or tag == "main" and zone == "open"):
            elements += 1
            zone, element = tag, elements
        stack.append((tag, left, zone, element))
        opened[tag] = opened.get(tag, 0) + 1


def page_parts(page: str | None) -> tuple[bool, list[str], list[int]]:
    """(open, lines, elements): the declared articles' blocks and the element that each is in, or
    all blocks of a page that declares none."""
    found = blocks(page or "")
    for zone in ("article", "main"):
        inside = [(text, element) for where, element, text in found if where == zone]
        if inside:
            return False, [text for text, _ in inside], [element for _, element in inside]
    return bool(found), [text for *_, text in found], [0] * len(found)


def page_text(page: str | None) -> tuple[bool, str]:
    """(open, text) of a page by itself, as it goes to differencing."""
    open_, lines, _ = page_parts(page)
    return open_, "\n".join(lines)


# --------------------------------------------------------------------------------------
# two pages


def _lengths(a: list, b: list) -> list[int]:
    """Length of the longest common subsequence of ``a`` with every prefix of ``b``."""
    row = _rows(a, b, False)
    out, n = [0], 0
    for bit in reversed(bin(row | (1 << len(b)))[3:]):
        n += bit == "0"
        out.append(n)
    return out


def _rows(a: list, b: list, keep: bool):
    """Bit-parallel LCS: a 0 in bit j of row i says that b[j] lengthens what a[:i + 1] shares with b[:j]."""
    full, where = (1 << len(b)) - 1, {}
    for j, y in enumerate(b):
        where[y] = where.get(y, 0) | (1 << j)
    row, rows = full, []
    for x in a:
        match = row & where.get(x, 0)
        row = ((row + match) | (row - match)) & full
        if keep:
            rows.append(row)
    return rows if keep else row


def common(a: list, b: list, at: int = 0, to: int = 0) -> list[tuple[int, int]]:
    """Places (in a, in b) of a longest common subsequence."""
    out = []
    while a and b and a[0] == b[0]:
        out.append((at, to))
        a, b, at, to = a[1:], b[1:], at + 1, to + 1
        if len(out) >= 64:  # long equal heads are cut at once
            n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            out += [(at + i, to + i) for i in range(n)]
            a, b, at, to = a[n:], b[n:], at + n, to + n
    if not a or not b:
        return out
    if len(a) * len(b) > STATE_BITS and len(a) > 1:
        half = len(a) // 2
        left, right = _lengths(a[:half], b), _lengths(a[half:][::-1], b[::-1])[::-1]
        cut = max(range(len(b) + 1), key=lambda j: left[j] + right[j])
        return out + common(a[:half], b[:cut], at, to) + common(a[half:], b[cut:], at + half, to + cut)
    rows, i, j, tail = _rows(a, b, True), len(a) - 1, len(b) - 1, []
    while i >= 0 and j >= 0:
        if rows[i] >> j & 1:
            j -= 1
        elif i and not rows[i - 1] >> j & 1:
            i -= 1
        else:
            tail.append((at + i, to + j))
            i, j = i - 1, j - 1
    return out + tail[::-1]


def shared_lines(one: list, two: list, sizes: list[int], others: list[int], copy: float = COPY) -> tuple[list[int], list[int]]:
    """Places of the lines, whose characters are ``sizes`` and ``others``, that two pages share in
    order; none where one is a copy of the other."""
    both = set(one) & set(two)
    here, there = [i for i, x in enumerate(one) if x in both], [j for j, y in enumerate(two) if y in both]
    pairs = common([one[i] for i in here], [two[j] for j in there])
    size = sum(sizes[here[i]] for i, _ in pairs)
    if size > copy * min(sum(sizes), sum(others)):
        return [], []
    return [here[i] for i, _ in pairs], [there[j] for _, j in pairs]


# --------------------------------------------------------------------------------------
# all pages


_PARSED = "page_id long, url string, open boolean, text string, elements array<int>, lines binary, sizes array<int>"
#: Bytes by which a line is told from others.
LINE = 16


def _parse(batches):
    for batch in batches:
        read = [page_parts(h) for h in batch.pop("html")]
        yield batch.assign(
            open=[r[0] for r in read],
            text=["\n".join(r[1]) for r in read],
            elements=[r[2] for r in read],
            lines=[b"".join(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=LINE).digest() for x in r[1]) for r in read],
            sizes=[[len(x) for x in r[1]] for r in read],
        )


def _align(batches):
    cut = lambda held: [held[i : i + LINE] for i in range(0, len(held), LINE)]
    for batch in batches:
        out = []
        for r in batch.itertuples():
            mine, other = shared_lines(cut(r.lines), cut(r.other), list(r.sizes), list(r.other_sizes))
            out += [(r.host, r.digest, mine), (r.host, r.other_digest, other)]
        yield pd.DataFrame([o for o in out if o[2]], columns=["host", "digest", "shared"])


def frame_lines(pages: DataFrame) -> DataFrame:
    """(host, digest, shared): for each text of a host the places of lines that it shares with a nearest URL's.

    ``pages`` has host, path, page_id, the text's digest, its lines (``LINE`` bytes each) and their sizes.
    """
    kept = pages.groupBy("host", "digest").agg(F.min(F.struct("path", "page_id")).alias("at"), F.min(F.struct("lines", "sizes")).alias("text"))
    order = ["host", "path", "page_id", "digest"]
    kept = kept.select("host", "at.path", "at.page_id", "digest", "text.lines", "text.sizes").repartitionByRange(*order).sortWithinPartitions(*order)
    kept = stored(kept.withColumn("place", F.monotonically_increasing_id()), "pages-order")
    part, within = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = kept.groupBy(part.alias("part")).count().orderBy("part").collect()  # a row a partition
    base, starts = 0, []
    for s in sizes:
        starts.append((s["part"], base))
        base += s["count"]
    first = kept.sparkSession.createDataFrame(starts, "part long, base long")
    ranked = kept.withColumn("part", part).join(F.broadcast(first), "part").withColumn("n", F.col("base") + within)
    after = ranked.select((F.col("n") - 1).alias("n"), "host", F.col("lines").alias("other"), F.col("sizes").alias("other_sizes"), F.col("digest").alias("other_digest"))
    found = ranked.select("n", "host", "digest", "lines", "sizes").join(after, ["n", "host"]).mapInPandas(_align, "host string, digest binary, shared array<int>")
    found = stored(found.groupBy("host", "digest").agg(F.array_distinct(F.flatten(F.collect_list("shared"))).alias("shared")), "pages-frames")
    drop_stored(kept)
    return found


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages``.

    Null or empty html has an empty text; a null url is one of an empty host and path;
    repeated rows get the same text each; pages of equal path go by id (null first), then by
    their text; a page alone on its host keeps what its markup leaves; other columns are
    ignored; an empty table gives no rows.
    """
    read = stored(pages.select("page_id", "url", "html").mapInPandas(_parse, _PARSED), "pages-text")
    # open pages and others of a host are no neighbours: one's lines are the whole page's, the other's an article's
    host = F.concat(host_of(F.col("url")), F.when(F.col("open"), " open").otherwise(" article"))
    digest = F.unhex(F.sha2("lines", 256))
    compared = read.where("text <> ''").select("page_id", host.alias("host"), path_of(F.col("url")).alias("path"), digest.alias("digest"), "lines", "sizes", "open", "elements")
    frames = frame_lines(compared)
    here = lambda i: F.array_contains("shared", i)
    own = F.array_distinct(F.filter("elements", lambda _, i: ~here(i)))  # elements with a line of their own
    frame = F.filter("shared", lambda i: (F.size("own") > 0) & ~F.array_contains("own", F.element_at("elements", i + 1)))
    texts = compared.select("host", "digest", "open", "elements").distinct()
    judged = texts.join(frames, ["host", "digest"]).withColumn("own", own)
    gone = judged.select("host", "digest", "elements", F.when(F.col("open"), F.col("shared")).otherwise(frame).alias("gone"))
    gone = stored(gone.where(F.size("gone") > 0), "pages-gone")
    drop_stored(frames)
    gone = gone.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS))
    lines = read.select("page_id", "url", "text", "elements", host.alias("host"), digest.alias("digest"), salt.alias("salt"))
    cut = lines.join(gone, ["host", "digest", "elements", "salt"], "left")
    rest = F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains("gone", i))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(rest, "\n"))
    return cut.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def query(spark, sf_dir):
    return main_text(table(spark, sf_dir, "pages"))
