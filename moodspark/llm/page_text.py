"""Main text of web pages by nearest-URL differencing.

1. Every page is cut into lines, the text of one block each. Markup, scripts,
   styles and elements that say what they are (menus, headers, footers, asides,
   forms, notices, adverts, comments) give no lines. Lines inside an explicit
   article body are marked as such.
2. The paths of a host are put in order. Each page is paired with the
   neighbouring path that has the longer part in common with its own; variants
   of one address (scheme, query, fragment, trailing slash) are one path.
3. The lines of both that no article body encloses are aligned by longest
   common subsequence, and the lines they share are deleted: they belong to the
   site and not to the page. Lines in an article body are not up for this,
   since articles quote each other. Where nothing would be left of a page, the
   pair are copies and not two pages of one template, and nothing is deleted.

Only line hashes of undecided lines are shuffled, and the order of paths is cut
into blocks, so a host with a third of all pages is spread over many tasks.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import materialize

BLOCK = 512
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp "
                    "small span strike strong sub sup time tt u var wbr".split())
_SILENT = frozenset("head script style noscript template iframe object svg math canvas audio video".split())
_CHROME = frozenset("nav footer aside form button select menu dialog".split())
_BODY = frozenset(["article", "main"])
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog form menu menubar".split())
_NAMES = frozenset("ad ads advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent "
                   "gdpr notice notices popup modal overlay menu nav navbar navigation breadcrumb breadcrumbs sidebar "
                   "share sharing social related recommended comment comments reply replies disqus footer masthead "
                   "newsletter subscribe signup login pagination pager copyright toolbar widget".split())
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class _Lines(HTMLParser):
    """Collects (text, in an article body) for each block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines, self.text, self.stack, self.open = [], [], [], {}
        self.silent = self.chrome = self.body = 0

    def _end_line(self) -> None:
        if self.text:
            line = " ".join("".join(self.text).split())
            self.text = []
            if line:
                self.lines.append((line, self.body > 0))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in _INLINE and tag != "br":
            self._end_line()
        if tag == "br":
            self.text.append(" ")
        if tag in _VOID:
            return
        if tag in ("p", "li") and self.stack and self.stack[-1][0] == tag:
            self._close()
        kind = ""
        if tag in _SILENT:
            kind = "silent"
        elif tag in _BODY:
            kind = "body"
        if kind != "silent" and (tag in _CHROME or (tag == "header" and not self.body) or self._says_chrome(tag, dict(attrs))):
            kind = "chrome"
        self.stack.append((tag, kind))
        self.open[tag] = self.open.get(tag, 0) + 1
        if kind:
            setattr(self, kind, getattr(self, kind) + 1)

    @staticmethod
    def _says_chrome(tag: str, attrs: dict) -> bool:
        if not attrs or tag in ("html", "body"):
            return False
        if (attrs.get("role") or "").lower() in _ROLES or "hidden" in attrs or "display:none" in (
                attrs.get("style") or "").replace(" ", "").lower():
            return True
        named = f"{attrs.get('class') or ''} {attrs.get('id') or ''}"
        return any(w.lower() in _NAMES for w in _WORDS.findall(named))

    def _close(self) -> str:
        tag, kind = self.stack.pop()
        self.open[tag] -= 1
        if kind:
            setattr(self, kind, getattr(self, kind) - 1)
        return tag

    def handle_endtag(self, tag: str) -> None:
        if tag not in _INLINE and tag not in _VOID:
            self._end_line()
        if self.open.get(tag):
            while self._close() != tag:
                pass

    def handle_data(self, data: str) -> None:
        if not self.silent and not self.chrome:
            self.text.append(data)


def page_lines(html: str | None) -> list[tuple[str, bool]]:
    """(line, in an article body) in page order; none for null or empty pages."""
    parser = _Lines()
    parser.feed(html or "")
    parser.close()
    parser._end_line()
    return parser.lines


def address(url: str | None) -> tuple[str, str]:
    """Host and path of a URL, without scheme, query, fragment, trailing slash and page suffix; empty if there is none."""
    try:
        parts = urlsplit(url or "")
    except ValueError:
        return "", url or ""
    return (parts.hostname or "") if parts.netloc else "", re.sub(r"\.(html?|php|aspx?)$", "", parts.path.rstrip("/"))


def common_lines(mine: list, other: list) -> list[int]:
    """Places in ``mine`` of a longest common subsequence with ``other``.

    The rows of the table are bit sets: bit j of row i says whether the length
    grows at ``other[j]``. Lines that the other page has not are left out first.
    """
    here, there = set(mine), set(other)
    at = [i for i, x in enumerate(mine) if x in there]
    a, b = [mine[i] for i in at], [x for x in other if x in here]
    places: dict = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    rows, row = [], full
    for x in a:
        hit = row & places[x]
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    found, j = [], len(b)
    for i in reversed(range(len(a))):
        grown = ~rows[i] & full & ((1 << j) - 1)      # where the length grows up to here
        before = ~rows[i - 1] & full & ((1 << j) - 1) if i else 0
        if grown.bit_count() > before.bit_count():
            found.append(at[i])
            j = grown.bit_length() - 1
    return found[::-1]


def _shared(mine: list[int], path: str, sides: list[tuple]) -> list[int]:
    """Places of lines shared with the neighbour whose path is nearer (the one before, if both are as near)."""
    def near(p: str) -> int:
        return next((i for i, (x, y) in enumerate(zip(p, path)) if x != y), min(len(p), len(path)))

    sides = [(p, h) for p, h in sides if p is not None]
    if not sides or not len(mine):
        return []
    return common_lines(list(mine), list(max(sides, key=lambda s: near(s[0]))[1]))


def _neighbours(paths: DataFrame) -> DataFrame:
    """``host, path, before, after`` for stored ``paths(host, path, hashes)``: the next paths of the host, or null.

    A global sort deals the paths out by range; rows are then numbered without
    gaps (the driver sees a count per partition) and cut into blocks, each with
    the rows next to it.
    """
    spark = paths.sparkSession
    ordered = materialize(paths.orderBy("host", "path").withColumn("_id", F.monotonically_increasing_id()), "paths")
    part = F.shiftright("_id", 33)
    starts, n = [], 0
    for r in ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():
        starts.append((r["part"], n))
        n += r["n"]
    offsets = spark.createDataFrame(starts, "part bigint, start bigint")
    row = F.col("start") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = (ordered.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("n", row))
    block = F.floor(F.col("n") / BLOCK)
    place = F.col("n") % BLOCK
    ends = F.array_compact(F.array(F.lit(0), F.when(place == 0, F.lit(-1)), F.when(place == BLOCK - 1, F.lit(1))))
    dealt = numbered.withColumn("_to", F.explode(ends)).withColumn("_block", block + F.col("_to"))
    w = W.partitionBy("_block").orderBy("n")
    this = F.struct("host", "path", "hashes")
    out = dealt.withColumns({"before": F.lag(this).over(w), "after": F.lead(this).over(w)}).where("_to = 0")
    same = {k: F.when(F.col(f"{k}.host") == F.col("host"), F.col(k)) for k in ("before", "after")}
    return out.withColumns(same).select("host", "path", "before", "after")


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``.

    Null and empty pages have an empty text. Pages without a host are
    neighbours of each other. Pages that repeat (rows or addresses) are not
    compared with each other. Further columns are not read; an empty table gives no rows.
    """
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths, lines, hashes, places = [], [], [], [], []
            for url, html in zip(batch["url"], batch["html"]):
                host, path = address(url.as_py())
                found = page_lines(html.as_py())
                loose = [i for i, (_, body) in enumerate(found) if not body]
                hosts.append(host)
                paths.append(path)
                lines.append([x for x, _ in found])
                places.append(loose)
                hashes.append([zlib.crc32(found[i][0].encode("utf-8", "surrogatepass")) << 20
                               | len(found[i][0]) & 0xFFFFF for i in loose])
            yield pa.RecordBatch.from_arrays(
                [batch["page_id"], batch["url"], pa.array(hosts, pa.string()), pa.array(paths, pa.string()),
                 pa.array(lines, pa.list_(pa.string())), pa.array(places, pa.list_(pa.int32())),
                 pa.array(hashes, pa.list_(pa.int64()))], names)

    names = ["page_id", "url", "host", "path", "lines", "loose", "hashes"]
    parsed = materialize(
        pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                     F.col(html_col).cast("string").alias("html"))
        .mapInArrow(parse, "page_id bigint, url string, host string, path string, lines array<string>, "
                           "loose array<int>, hashes array<bigint>")
        .withColumn("_row", F.monotonically_increasing_id()), "pages")
    paths = parsed.groupBy("host", "path").agg(F.min_by("hashes", "_row").alias("hashes"))
    beside = _neighbours(paths)
    open_pages = parsed.where(F.size("loose") > 0).select("_row", "host", "path", "loose", "hashes")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cut = []
            for path, loose, mine, p, ph, q, qh in zip(*[batch[c] for c in compared]):
                cut.append([int(loose[i]) for i in _shared(mine, path, [(p, ph), (q, qh)])])
            yield pd.DataFrame({"_row": batch["_row"], "cut": cut})

    compared = ["path", "loose", "hashes", "path_before", "hashes_before", "path_after", "hashes_after"]
    cuts = (open_pages.join(beside, ["host", "path"])
            .select("_row", "path", "loose", "hashes", F.col("before.path").alias("path_before"),
                    F.col("before.hashes").alias("hashes_before"), F.col("after.path").alias("path_after"),
                    F.col("after.hashes").alias("hashes_after"))
            .mapInPandas(compare, "_row bigint, cut array<int>"))
    closed = parsed.where(F.size("loose") == 0).select("page_id", "url", "lines")
    left = F.filter(F.col("lines"), lambda x, i: ~F.array_contains(F.col("cut"), i))
    opened = (parsed.where(F.size("loose") > 0).join(cuts, "_row").withColumn("left", left)
              .select("page_id", "url", F.when(F.size("left") > 0, F.col("left")).otherwise(F.col("lines")).alias("lines")))
    return closed.union(opened).select("page_id", "url", F.array_join("lines", "\n").alias("text")).withColumn(
        "n_chars", F.length("text").cast("bigint"))
