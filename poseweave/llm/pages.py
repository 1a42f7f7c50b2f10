"""Main text of web pages: blocks of text, with lines that a page shares with its nearest page deleted.

Pages of a host are ordered by URL path, pages of equal lines as one; a page is compared with whichever neighbour shares more of its path.
Their lines are aligned by longest common subsequence, and shared lines go: they belong to the site.  What the markup itself
says is then applied to the rest: lines in navigation, footers, adverts, forms, comments of readers and the like go even if no
neighbour has them, and lines of a page's article stay even if a neighbour quotes them.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poseweave.llm.common import ordered
from poseweave.session import pin

# Fixed values of HTML: elements that start a new block, have no content, hold raw text, or are no part of the text.
BLOCKS = set("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2
 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul""".split())
EMPTY = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
ASIDE = set("""aside button canvas datalist dialog embed footer form head iframe map menu nav noembed noframes noscript object
 optgroup option script select style svg template textarea title video audio""".split())
CLOSED_BY_BLOCK = {"p"}
#: Words in class, id or role that mark a part as no article text, and words that may stand beside them in a hyphenated name.
LABEL = re.compile(r"(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookie\w*|consent|notice|alert|nav\w*|menu\w*|breadcrumbs?|header|masthead|"
                   r"footer|sidebar|side|widget\w*|comments?|respond|disqus|replies|share|sharing|social|related|recommend\w*|subscribe|newsletter|"
                   r"signup|login|popup|modal|toolbar|pagination|pager|tags|contentinfo|complementary|navigation|search|skip\w*)", re.I)
BESIDE = set("""site page main top bottom left right upper lower primary secondary global local mobile sticky fixed user reader post article
 content body box bar block list section region area container wrapper wrap inner outer holder panel row column col slot unit item items link links
 posts articles stories form input button buttons icon icons title text group card cards tray rail strip zone module component message js""".split())
MAIN = re.compile(r"(?:^|\s)(?:main|article)(?:$|\s)", re.I)
# A quote counts only where an attribute's value starts; a value whose quote is never closed ends like one without quotes.
VALUE = r"""(?:"[^"]*"|'[^']*'|[^\s>]*)"""
TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*{VALUE})*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(rf"([^\s/=][^\s/=]*)(?:\s*=\s*({VALUE}))?")
TELLING = re.compile(r"class|id|role|hidden|itemprop", re.I)

ARTICLE, PLAIN, OUT = 2, 1, 0
#: A neighbour is a copy if both pages share this part of their lines, and no more than the rest of the page's text would stay.
COPY_SHARE = 0.9


def text_blocks(page: str) -> list[tuple[str, int]]:
    """``(text, zone)`` of all blocks in page order: in the article, in no marked part, or in a part that is not article text."""
    out: list[tuple[str, int]] = []
    open_tags: list[tuple[str, int]] = []
    parts: list[str] = []
    zone, at = PLAIN, 0

    def close_block() -> None:
        text = " ".join("".join(parts).split())
        if text:
            out.append((text, zone))
        parts.clear()

    while True:
        tag = TAG.search(page, at)
        if tag is None:
            parts.append(entities.unescape(page[at:]))
            break
        if tag.start() > at:
            parts.append(entities.unescape(page[at: tag.start()]))
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue
        if name == "br":
            parts.append(" ")
        if name in BLOCKS:
            close_block()
        if tag[1]:
            for k in range(len(open_tags) - 1, -1, -1):
                if open_tags[k][0] == name:
                    close_block() if open_tags[k][1] != zone else None
                    del open_tags[k:]
                    break
        elif name in RAW:
            end = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, at)
            at = end.start() if end else len(page)
        elif name not in EMPTY and not (tag[3] or "").endswith("/"):
            if name in BLOCKS and open_tags and open_tags[-1][0] in CLOSED_BY_BLOCK:
                open_tags.pop()
            outer = open_tags[-1][1] if open_tags else PLAIN
            inner = _zone(name, tag[3] or "", outer)
            if inner != outer:
                close_block()
            open_tags.append((name, inner))
        zone = open_tags[-1][1] if open_tags else PLAIN
    close_block()
    return out


def _marks(label: str) -> bool:
    """Whether a name says that its part is no article text: by its label words alone or beside words of layout, so not ``side-by-side``."""
    words = [w for w in re.split(r"[-_]+", label.lower()) if w]
    marked = [bool(LABEL.fullmatch(w)) for w in words]
    return any(marked) and all(m or w in BESIDE or w.isdigit() for m, w in zip(marked, words, strict=True))


def _zone(name: str, attributes: str, outer: int) -> int:
    if outer == OUT or name in ASIDE or (name == "header" and outer != ARTICLE):
        return OUT
    said: dict[str, str] = {}
    if TELLING.search(attributes):
        for key, value in ATTRIBUTE.findall(attributes):
            said.setdefault(key.lower(), entities.unescape(value[1:-1] if len(value) > 1 and value[0] in "\"'" and value[-1] == value[0] else value))
    label = " ".join(said.get(k, "") for k in ("class", "id", "role"))
    if "hidden" in said or (name not in ("html", "body", "article", "main") and any(map(_marks, label.split()))):
        return OUT
    if name in ("article", "main") or MAIN.search(said.get("role", "")) or "articlebody" in said.get("itemprop", "").lower():
        return ARTICLE
    return outer


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b``, by bit-parallel rows of the usual table."""
    masks: dict[int, int] = {}
    for j, line in enumerate(b):
        masks[line] = masks.get(line, 0) | 1 << j
    full = (1 << len(b)) - 1
    row, rows = full, []
    for line in a:
        u = row & masks.get(line, 0)
        row = ((row + u) | (row - u)) & full
        rows.append(row)
    places, i, j = [], len(a), len(b)
    # A zero bit at j of row i says that the j-th line of b lengthens the common subsequence there.
    while i and j:
        above = rows[i - 2] if i > 1 else full
        if not rows[i - 1] >> (j - 1) & 1:
            if not above >> (j - 1) & 1:
                i -= 1
            else:
                places.append(i - 1)
                i, j = i - 1, j - 1
        else:
            j -= 1
    return places[::-1]


def line_hash(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text) - (1 << 63)


def page_lines(pages: DataFrame) -> DataFrame:
    """``(page_id, url, html_hash, host, path, lines)``; ``lines`` are hashes of all blocks."""
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [[line_hash(t) for t, _ in text_blocks(h or "")] for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "url", "html_hash")), pa.array(lines, pa.list_(pa.int64()))],
                                             ["page_id", "url", "html_hash", "lines"])

    rows = pages.select("page_id", "url", "html", F.xxhash64("html").alias("html_hash"))
    rows = rows.mapInArrow(parse, "page_id long, url string, html_hash long, lines array<long>")
    plain = F.coalesce("url", F.lit(""))
    return rows.withColumns({"host": F.lower(F.regexp_extract(plain, r"^(?:[a-zA-Z][\w+.-]*:)?//([^/?#]*)", 1)),
                             "path": F.regexp_extract(plain, r"^(?:[a-zA-Z][\w+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)})


def shared_places(pages: DataFrame) -> DataFrame:
    """``(page_id, url, html_hash, shared, most)``: places of each page's lines that the nearest page on its host, by URL path, has
    as well, and how many lines the longer of both has.  Pages without a nearest page are left out.

    Pages are ordered and paired without their lines, which are read again for the pairs alone: once for each of equal pages.
    Numbers over the whole order stand in for pages, so a host with a third of all pages is spread like the others.
    """
    lines = page_lines(pages).withColumns({"copy": F.xxhash64("lines"), "row": F.monotonically_increasing_id()})
    lines = pin(lines, "page-lines")
    rows = ordered(lines.drop("lines"), ["host", "path", "url", "page_id", "html_hash"], "page-order").withColumnRenamed("_row", "at")
    # Copies stand in the order once, where the first of them is, so that none is the other's neighbour.
    firsts = rows.groupBy("host", "copy").agg(F.min(F.struct("at", "row", "path")).alias("first")).select("host", "copy", "first.*")
    firsts = ordered(firsts, ["at"], "copy-order")

    def shared(a: str, b: str):
        same = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x.eqNullSafe(y)), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
                           lambda s, eq: F.struct((s["n"] + F.when(s["on"] & eq, 1).otherwise(0)).alias("n"), (s["on"] & eq).alias("on")))
        return same["n"]

    # Each page offers itself to the pages before and after it.
    offers = firsts.select(F.explode(F.array(F.col("_row") - 1, F.col("_row") + 1)).alias("to"), F.col("host").alias("h"), F.col("path").alias("p"),
                           F.col("row").alias("near"), (F.col("_row")).alias("from_row"))
    met = firsts.join(offers, (F.col("_row") == F.col("to")) & (F.col("host") == F.col("h")))
    nearest = met.groupBy("host", "copy", "row").agg(F.min_by("near", F.struct(-shared("path", "p"), "from_row")).alias("near"))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, other = (batch.column(c).to_pylist() for c in ("own", "other"))
            places = pa.array([common_lines(a, b) for a, b in zip(own, other, strict=True)], pa.list_(pa.int32()))
            most = pa.array([max(len(a), len(b)) for a, b in zip(own, other, strict=True)], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("copy"), places, most], ["host", "copy", "shared", "most"])

    own, other = (lines.select(F.col("row").alias(k), F.col("lines").alias(name)) for k, name in (("row", "own"), ("near", "other")))
    aligned = nearest.join(own, "row").join(other, "near").select("host", "copy", "own", "other")
    aligned = pin(aligned.mapInArrow(align, "host string, copy long, shared array<int>, most int"), "shared-lines")
    # Equal rows (id, URL and text) are one page.
    return rows.select("page_id", "url", "html_hash", "host", "copy").distinct().join(aligned, ["host", "copy"]).select(
        "page_id", "url", "html_hash", "shared", "most")


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars, n_shared)``, one row for each row of ``pages(page_id, url, html)``.

    Null html is empty; a page without text gives an empty string.  Character references are decoded, white space within a
    block becomes one space, blocks are joined by line feeds in page order.  Where a page marks its article, the article
    is the text; otherwise all lines outside marked parts that the nearest page does not share.  Copies of a page are not its
    nearest page, and a nearest page that is nearly the same deletes nothing.  ``n_shared`` counts the lines
    found on both pages.  Null URLs belong to the empty host.
    """
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, places, article = [], [], []
            for page in batch.column("html").to_pylist():
                found = text_blocks(page or "")
                top = ARTICLE if any(z == ARTICLE for _, z in found) else PLAIN
                places.append([k for k, (_, z) in enumerate(found) if z == top])
                texts.append([found[k][0] for k in places[-1]])
                article.append(top == ARTICLE)
                if article[-1]:  # all of it stays: one text
                    texts[-1], places[-1] = ["\n".join(texts[-1])], [0]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("page_id", "url", "html_hash")), pa.array(texts, pa.list_(pa.string())),
                 pa.array(places, pa.list_(pa.int32())), pa.array(article, pa.bool_())], ["page_id", "url", "html_hash", "texts", "places", "article"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            joined, n_shared = [], []
            for shared, most, texts, places, article in zip(*(batch.column(c).to_pylist() for c in ("shared", "most", "texts", "places", "article")), strict=True):
                shared = set(shared or [])
                kept = [t for k, t in zip(places, texts, strict=True) if article or k not in shared]
                # Nearly the same page says nothing about the site: no line goes for it.
                if most and len(shared) >= COPY_SHARE * most and sum(map(len, kept)) <= (1 - COPY_SHARE) * sum(map(len, texts)):
                    kept = texts
                joined.append("\n".join(kept))
                n_shared.append(len(shared))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(joined, pa.string()), pa.array(n_shared, pa.int64())],
                                             ["page_id", "url", "text", "n_shared"])

    near = shared_places(pages)
    # Only text that may stay and places of lines travel, not the markup.
    parsed = pages.select("page_id", "url", "html", F.xxhash64("html").alias("html_hash")).mapInArrow(
        parse, "page_id long, url string, html_hash long, texts array<string>, places array<int>, article boolean")
    rows = parsed.alias("p").join(near.alias("n"), (
        F.col("p.page_id").eqNullSafe(F.col("n.page_id")) & F.col("p.url").eqNullSafe(F.col("n.url")) & (F.col("p.html_hash") == F.col("n.html_hash"))), "left")
    out = rows.select("p.page_id", "p.url", "shared", "most", "texts", "places", "article").mapInArrow(cut, "page_id long, url string, text string, n_shared long")
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_shared")
