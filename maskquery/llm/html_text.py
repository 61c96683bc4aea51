"""HTML extraction: the article of a page without the site's boilerplate.

1. Blocks. A page is cut into blocks at block-level tags; character references are decoded and white space becomes one space.
   Each block lies in the article (``article`` or ``main``), in page furniture (``nav``, ``header``, ``footer``, ``aside``, forms,
   or an element whose class, id or role names one of ``FURNITURE``), or in open ground.
2. Host suffix array. The token streams of all blocks outside the article, host by host, are sorted by their first ``DEPTH`` tokens:
   a suffix array to the depth that matters, as a position belongs to a repeated substring of ``DEPTH`` tokens or more exactly if
   some ``DEPTH`` suffixes over it share their beginning with another page. Suffixes are grouped by the hash of that beginning,
   with the least and the largest page as partial aggregates, so a host of any size is spread over all tasks.
   Pages of a host with the same blocks are copies and count as one page. A block of fewer tokens than ``DEPTH`` counts as
   repeated on ``SHORT_SHARE`` of the host's distinct pages, and ``SHORT_PAGES`` of them, at least.
3. Text. Furniture goes. Of open ground of which half or more is covered by substrings that repeat across distinct pages of the
   host, the covered runs go and the unique ones stay; other open ground and the article stay whole, in page order.

Defined cases: a null or empty page has no text; markup that is never closed ends where its parent or the page ends; a tag that
is cut off by the end of the page is markup; pages of any length; rows with the same id and html are one page; a url without a
host is a host of its own name; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskquery.llm.slots import maybe_in
from maskquery.llm.store import keep
from maskquery.llm.text import NOT_SPACE, bounds, flat, gram_hashes, mix, ragged, run_hashes, signed

#: Tokens of the shortest repeated substring; a block of fewer is one substring.
DEPTH = 6
COVERED = 0.5
SHORT_SHARE, SHORT_PAGES = 0.5, 3
ARTICLE, OPEN, CHROME = 0, 1, 2

_DROPPED = frozenset("script style noscript template svg iframe object canvas math head title select textarea button video audio".split())
_CHROME = frozenset("nav header footer aside form menu dialog".split())
_MAIN = frozenset(("article", "main"))
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter output q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split())
#: Words of class, id and role values that name page furniture.
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies disclaimer "
    "dialog disqus footer gdpr header menu modal nav navbar navigation newsletter notice notices overlay popup promo promoted related "
    "replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
_ABOUT_OTHERS = ("has-", "with-", "no-", "is-", "without-", "hide-", "show-")
#: Elements that hold a page or its article; their names say how they look.
_FRAMES = frozenset(("html", "body", "article", "main"))
_TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I | re.S)
_HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true)", re.I)
_SPACE = re.compile(r"\s+")


def _furniture(attributes: str) -> bool:
    for m in _NAMES.finditer(attributes):
        value = m[1] or m[2] or m[3] or ""
        value = re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower()
        for name in value.split():  # has-sidebar and the like speak of other elements
            if not name.startswith(_ABOUT_OTHERS) and not FURNITURE.isdisjoint(re.split(r"[^a-z]+", name)):
                return True
    return bool(attributes and _HIDDEN.search(attributes))


def blocks(page: str) -> list[tuple[int, str]]:
    """``(region, text)`` of the non-empty blocks of a page, in page order."""
    out: list[tuple[int, str]] = []
    text: list[str] = []
    stack: list[tuple[str, int]] = []  # open elements with the region inside them
    region, at = OPEN, 0

    def close() -> None:
        got = _SPACE.sub(" ", html.unescape("".join(text))).strip()
        if got:
            out.append((region, got))
        text.clear()

    while True:
        m = _TAG.search(page, at)
        if m is None:
            text.append(page[at:])
            break
        text.append(page[at : m.start()])
        at = m.end()
        name = m[2].lower() if m[2] else ""
        if not name:
            continue
        if m[1]:
            if name in _INLINE and not any(n == name for n, _ in stack):
                continue
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if name not in _INLINE:
                close()
            if depth is not None:
                outer = stack[depth - 1][1] if depth else OPEN
                if outer != region:
                    close()
                del stack[depth:]
                region = outer
            continue
        if name in _DROPPED:
            if name not in _INLINE:
                close()
            if not m[0].endswith("/>"):
                end = re.compile(rf"</{re.escape(name)}\s*(?:>|$)", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in _VOID:
            if name not in _INLINE:
                close()
            continue
        inline = name in _INLINE
        if not inline:
            close()
            if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack:  # ends the one before it, which need not be closed
                depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in (name, *_MAIN, *_CHROME, "div", "section", "ul", "ol", "table", "body")), None)
                if depth is not None and stack[depth][0] == name:
                    del stack[depth:]
                    region = stack[-1][1] if stack else OPEN
        inner = region
        if region != CHROME and ((name in _CHROME and not (name == "header" and region == ARTICLE)) or (name not in _FRAMES and _furniture(m[3]))):
            inner = CHROME
        elif name in _MAIN and region != CHROME:
            inner = ARTICLE
        if inner != region:
            close()
        region = inner
        if not m[0].endswith("/>") or name not in _VOID:
            stack.append((name, inner))
    close()
    return out


def _host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#]*)", 1)), F.lit(""))


def page_blocks(pages: DataFrame) -> DataFrame:
    """``page_id, url, page, regions, texts`` for every row; ``page`` is 0, to be numbered."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                got = [blocks(h) if h else [] for h in part.column(3).to_pylist()]
                ends = pa.array(np.r_[0, np.cumsum([len(b) for b in got])].astype(np.int32))
                regions = pa.ListArray.from_arrays(ends, pa.array([r for b in got for r, _ in b], pa.int8()))
                texts = pa.ListArray.from_arrays(ends, pa.array([t for b in got for _, t in b], pa.string()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), regions, texts], ["page_id", "url", "page", "regions", "texts"])

    kind = pages.schema["page_id"].dataType.simpleString()
    narrow = pages.select("page_id", "url", F.lit(0).cast("long").alias("page"), "html")
    return narrow.mapInArrow(read, f"page_id {kind}, url string, page long, regions array<tinyint>, texts array<string>")


def suffixes(parsed: DataFrame) -> DataFrame:
    """``host, page, block, region, at, n, head``: every suffix of the blocks outside the article, by the hash of its beginning.

    A block of fewer tokens than DEPTH has one suffix, which is whole.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            hosts = batch.column(0).to_numpy()
            data, off = flat(batch.column(4))
            s, e, row = bounds(NOT_SPACE[data], off)
            h, first, n = run_hashes(data, s, e), row[:-1], np.diff(row)
            h = np.r_[h, np.zeros(DEPTH, np.uint64)]
            heads = np.where(n >= DEPTH, n - DEPTH + 1, np.minimum(n, 1))
            at, of = ragged(first, heads), np.repeat(np.arange(len(n)), heads)
            grams = gram_hashes(h, DEPTH)[at]
            for size in range(1, DEPTH):
                own = n[of] == size
                if own.any():
                    grams[own] = gram_hashes(h, size)[at[own]] + np.uint64(size)
            grams = mix(grams + mix(hosts.view(np.uint64))[of])
            take = pa.array(of)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), batch.column(2).take(take), batch.column(3).take(take), pa.array((at - first[of]).astype(np.int32)), pa.array(n[of].astype(np.int32)), pa.array(signed(grams))],
                ["host", "page", "block", "region", "at", "n", "head"],
            )

    spread = parsed.select(_host(F.col("url")).alias("host"), "page", F.posexplode(F.arrays_zip("regions", "texts")).alias("block", "b"))
    spread = spread.filter(F.col("b.regions") != ARTICLE).select(F.xxhash64("host").alias("host"), "page", "block", F.col("b.regions").alias("region"), F.col("b.texts").alias("text"))
    return spread.mapInArrow(read, "host long, page long, block int, region tinyint, at int, n int, head long")


def extracted(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages`` (``page_id, url, html``)."""
    same = F.xxhash64(_host(F.col("url")), "regions", "texts")  # copies of a page are one page
    parsed = keep(page_blocks(pages).withColumn("page", same), "html-blocks")
    array = suffixes(parsed)
    long_ = array.filter(F.col("n") >= DEPTH).groupBy("head").agg(F.min("page").alias("lo"), F.max("page").alias("hi")).filter("lo < hi").select("head")
    short = array.filter(F.col("n") < DEPTH).select("host", "head", "page").distinct().groupBy("host", "head").agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") >= SHORT_PAGES)
    sizes = parsed.select(F.xxhash64(_host(F.col("url"))).alias("host"), "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("size"))
    short = short.join(sizes, "host").filter(F.col("pages") >= SHORT_SHARE * F.col("size")).select("head")
    repeated = keep(long_.unionByName(short), "html-repeated")
    ground = array.filter((F.col("region") == OPEN) & maybe_in(repeated)("head"))
    covered = ground.join(repeated, "head", "left_semi").select("page", "block", "n", "at").distinct().groupBy("page", "block", "n").agg(F.array_sort(F.collect_set("at")).alias("ats"))
    wide = F.least(F.lit(DEPTH), F.col("n"))
    share = F.aggregate("ats", F.struct(F.lit(0).alias("c"), F.lit(0).alias("to")), lambda s, a: F.struct((s["c"] + a + wide - F.greatest(a, s["to"])).alias("c"), (a + wide).alias("to")))["c"]
    unique = F.array_except(F.sequence(F.lit(0), F.col("n") - 1), F.flatten(F.transform("ats", lambda a: F.sequence(a, a + wide - 1))))
    cut = covered.filter(share >= COVERED * F.col("n")).select("page", F.struct("block", unique.alias("unique")).alias("cut"))
    cut = keep(cut.groupBy("page").agg(F.map_from_entries(F.collect_list("cut")).alias("cuts")), "html-cuts")
    out = parsed.join(cut, "page", "left")

    def left(b: Column, i: Column) -> Column:
        words = F.split(b["texts"], " ")
        kept = F.try_element_at("cuts", i)
        return F.struct(b["regions"].alias("regions"), F.when(kept.isNull(), b["texts"]).otherwise(F.array_join(F.transform(kept, lambda k: F.get(words, k)), " ")).alias("texts"))

    blocks_left = F.filter(F.transform(F.arrays_zip("regions", "texts"), left), lambda b: (b["regions"] != CHROME) & (b["texts"] != ""))
    text = F.array_join(F.transform(blocks_left, lambda b: b["texts"]), "\n")
    return out.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op4_html_extraction": op4_html_extraction}
ORACLES: dict[str, str] = {}
