"""Main text of web pages by a site style tree.

The pages of a host are merged into one style tree: a style node is a path of tags and classes.
For each node two entropies over the host's pages say how much it varies: that of its presentation
(the sequence of its children) and that of its content (the text below it). A branch whose nodes
look and read alike all over the site has low importance and is removed from every page. What
markup itself names as no article (navigation, forms, adverts, comments and so on) is removed
without counting.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from quillgauge.llm.dom import BLOCK, RAW, Element, Page
from quillgauge.llm.distinct import one_of_each
from quillgauge.llm.names import fresh, quoted
from quillgauge.session import materialize

#: Elements that are never part of an article.
OUTSIDE_TAGS = frozenset("nav footer aside form button select input dialog menu head object embed canvas svg math audio video datalist".split()) | RAW
#: Words in classes, ids and roles of such elements.
OUTSIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation "
    "navigation= breadcrumb breadcrumbs footer contentinfo= banner= complementary= search= form= comment comments disqus replies "
    "respond cookie cookies consent notice notices notification alert alert= popup modal overlay newsletter subscribe subscription "
    "share sharing social related recommended pagination pager toolbar widget skip login signup paywall".split()
)
HEADER_WORDS = frozenset("header masthead topbar".split())
#: Inside an article these carry its text and are not judged by how they vary.
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figcaption caption table ul ol dl tr tbody b i em strong span a code q u sub sup".split())
NEVER_LOW = frozenset(["", "html", "body", "main", "article"])
#: An article or main with less than this share of what a wider choice gives is not the page's text.
MINOR = 0.1
#: A branch with more than this share of an unmarked page's text is its main content.
MAIN_SHARE = 0.5


def host_of(url) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(url.cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def domain_of(host) -> F.Column:
    """``*.`` and the domain that a host shares with its neighbours; null for '', single names and addresses."""
    rest = F.when(F.size(F.split(host, r"\.")) > 2, F.regexp_replace(host, r"^[^.]*\.", "")).otherwise(host)
    return F.when(host.contains(".") & ~host.rlike(r"^[0-9.]*$"), F.concat(F.lit("*."), rest))


def _is_article(e: Element) -> bool:
    return e.tag == "article" or "articlebody=" in e.words


def _is_main(e: Element) -> bool:
    return e.tag == "main" or "main=" in e.words


def _names_itself(e: Element, articles: bool) -> bool:
    """Whether an element's tag or words say that it is no text of the page.

    What holds the page's text is not judged by its words; an article only by whole class names
    and roles, such as ``comment``, and not at all if ``articles``.
    """
    if e.tag in OUTSIDE_TAGS:
        return True
    if e.tag in ("html", "body") or _is_main(e) or "articlebody=" in e.words:
        return False
    if e.tag == "article":
        return not articles and not OUTSIDE_WORDS.isdisjoint([*e.key.split(".")[1:], *(w for w in e.words if w.endswith("="))])
    return bool(e.words & OUTSIDE_WORDS)


def _outside(page: Page, articles: bool = False) -> list[bool]:
    out: list[bool] = []
    for e in page.elements:
        out.append(e.parent >= 0 and out[e.parent] or _names_itself(e, articles))
    return out


def _within(page: Page, wanted, outside: list[bool]) -> list[bool]:
    inside: list[bool] = []
    for e, gone in zip(page.elements, outside):
        inside.append(e.parent >= 0 and inside[e.parent] or not gone and wanted(e))
    return inside


def _landmarks(page: Page) -> tuple[list[bool], list[bool]]:
    """For each element whether it lies in the page's text, and whether it names itself as no text.

    That text is in the articles that are not themselves removed, or else in main, or else anywhere;
    the wider choice is taken where the narrower has hardly any text. Articles of words such as
    ``sponsored`` are chosen where the page has hardly anything else.
    """
    outside = _outside(page)
    whole = [True] * len(page.elements)

    def size(inside: list[bool], gone: list[bool]) -> int:
        return sum(len("".join(text.split())) for owner, text in page.texts if inside[owner] and not gone[owner])

    best, most = whole, size(whole, _removed(page, whole, outside, frozenset()))
    for wanted in (_is_main, _is_article):
        inside = _within(page, wanted, outside)
        here = size(inside, outside)
        if here and here >= MINOR * most:
            best, most = inside, here
    if any(e.tag == "article" and gone for e, gone in zip(page.elements, outside)):
        named = _outside(page, articles=True)
        inside = _within(page, _is_article, named)
        if most < MINOR * size(inside, named):
            return inside, named
    return best, outside


def _removed(page: Page, marked: list[bool], outside: list[bool], low: frozenset[int]) -> list[bool]:
    """For each element whether markup or the style tree takes it from the page."""
    whole = marked[0]
    named: list[bool] = []
    for e, inside, gone in zip(page.elements, marked, outside):
        gone = gone or e.parent >= 0 and named[e.parent]
        if not gone and not (inside and not whole) and e.tag not in NEVER_LOW:
            gone = e.tag == "header" or bool(e.words & HEADER_WORDS)
        named.append(gone)
    if not low:
        return named
    at = [0]
    for owner, text in page.texts:
        at.append(at[-1] + (0 if named[owner] else len("".join(text.split()))))
    out: list[bool] = []
    main: list[bool] = []
    for e, inside, gone in zip(page.elements, marked, named):
        gone = gone or e.parent >= 0 and out[e.parent]
        here = e.parent >= 0 and main[e.parent]
        if not gone and not here and e.path in low and e.tag not in NEVER_LOW:
            here = whole and at[e.end] - at[e.start] > MAIN_SHARE * at[-1]
            gone = not here and not (inside and not whole and e.tag in TEXT_BLOCKS)
        out.append(gone)
        main.append(here)
    return out


def page_text(source: str, low: frozenset[int]) -> str:
    """The page's article: blocks in page order, one to a line."""
    page = Page(source)
    marked, outside = _landmarks(page)
    out = _removed(page, marked, outside, low)
    # the block of a text run is its nearest block element; leaving or entering a block starts a new one
    blocks: list[list[str]] = []
    block_of: list[int] = []
    for i, e in enumerate(page.elements):
        block_of.append(i if e.parent < 0 or e.tag in BLOCK else block_of[e.parent])
    starts = sorted((e.start, i) for i, e in enumerate(page.elements) if e.tag in BLOCK)
    ends = sorted(e.end for e in page.elements if e.tag in BLOCK)
    s = t = 0
    fresh = True
    for number, (owner, text) in enumerate(page.texts):
        while s < len(starts) and starts[s][0] <= number:
            s, fresh = s + 1, True
        while t < len(ends) and ends[t] <= number:
            t, fresh = t + 1, True
        if out[owner] or not marked[owner]:
            continue
        if fresh:
            blocks.append([])
            fresh = False
        blocks[-1].append(text)
    lines = (" ".join("".join(b).split()) for b in blocks)
    return "\n".join(line for line in lines if line)


def style_tree(pages: DataFrame, host_col: str, html_col: str) -> DataFrame:
    """Importance of each style node of each host: (host, path, n_pages, presentation, content).

    Both are entropies over the distinct pages that have the node, between 0 and 1: copies of a
    page's source on a host are one page. A task adds up the pages it sees; counts combine again
    before the shuffle, so a large host is no large group. Domains (``domain_of``) have trees of
    all pages of their hosts, in rows of their own.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter[tuple[str, int, bool, int]] = Counter()
            hosts, sources = batch.column(0).to_pylist(), batch.column(1)
            for i, host in enumerate(hosts):
                for path, (shape, content) in Page(sources[i].as_py() or "").style_nodes().items():
                    found[host, path, False, shape] += 1
                    found[host, path, True, content] += 1
            rows = list(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), _signed([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.bool_()),
                 _signed([r[3] for r in rows]), pa.array(list(found.values()), pa.int64())],
                names=["host", "path", "is_content", "form", "n"],
            )

    once = one_of_each(pages.select(host_col, html_col, F.xxhash64(html_col).alias("_page_")), [host_col, "_page_"])
    rows = once.select(host_col, html_col).mapInArrow(count, "host string, path long, is_content boolean, form long, n long")
    rows = rows.withColumn("host", F.explode(F.array_compact(F.array("host", domain_of(F.col("host"))))))
    forms = rows.groupBy("host", "path", "is_content", "form").agg(F.sum("n").alias("n"))
    sums = forms.groupBy("host", "path", "is_content").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("t"))
    entropy = F.when(F.col("m") > 1, F.log("m") - F.col("t") / F.col("m")).otherwise(F.lit(1.0)) / F.when(F.col("m") > 1, F.log("m")).otherwise(F.lit(1.0))
    sums = sums.select("host", "path", "is_content", "m", F.greatest(entropy, F.lit(0.0)).alias("entropy"))
    return sums.groupBy("host", "path").agg(
        F.max("m").alias("n_pages"), F.max(F.when(~F.col("is_content"), F.col("entropy"))).alias("presentation"),
        F.max(F.when(F.col("is_content"), F.col("entropy"))).alias("content"),
    )


def _signed(values: list[int]) -> pa.Array:
    return pa.array([v - (1 << 64) if v >= 1 << 63 else v for v in values], pa.int64())


def main_text(
    pages: DataFrame, url_col: str = "url", html_col: str = "html", into: str = "main_text", threshold: float = 0.2, min_pages: int = 8
) -> DataFrame:
    """The columns of ``pages`` but the html, and the main text in column ``into`` (replacing one of that name).

    A style node of a host is removed if at least ``min_pages`` distinct pages have it and both of
    its entropies are below ``threshold``; a host of fewer pages takes the nodes of its domain. On
    a page without marked article a branch with most of the text stays. Text blocks inside a marked article stay in any case, so
    pages that share an article keep it. Null pages are empty; a page without url or host belongs
    to the host ''; pages with no article give the empty text; an empty table gives no rows.
    """
    keep = [c for c in pages.columns if c not in (html_col, into)]
    host, html, gone = (fresh(c, pages.columns) for c in ("_host_", "_html_", "_low_"))
    rows = pages.select(*quoted(keep), host_of(F.col(url_col)).alias(host), F.col(html_col).cast("string").alias(html))
    tree = style_tree(rows, host, html)
    is_low = (F.col("n_pages") >= min_pages) & (F.col("presentation") < threshold) & (F.col("content") < threshold)
    tree = materialize(tree.groupBy("host").agg(F.max("n_pages").alias("n"), F.collect_list(F.when(is_low, F.col("path"))).alias("_low_")))
    hosts = tree.filter(~F.col("host").startswith("*."))
    of_domain = tree.filter(F.col("host").startswith("*.")).select(F.col("host").alias("_domain_"), F.col("_low_").alias("_above_"))
    small = hosts.filter(F.col("n") < min_pages).select(F.col("host").alias("_host_"), domain_of(F.col("host")).alias("_domain_"))
    taken = small.join(of_domain, "_domain_").select("_host_", F.col("_above_").alias("_low_"))
    own = hosts.filter(F.col("n") >= min_pages).select(F.col("host").alias("_host_"), "_low_")
    low = materialize(own.union(taken).filter(F.size("_low_") > 0))
    few = low.limit(10_001).count() <= 10_000 and (low.agg(F.sum(F.size("_low_"))).first()[0] or 0) <= 1_000_000
    low = low.select(F.col("_host_").alias(host), F.col("_low_").alias(gone))
    joined = rows.join(F.broadcast(low) if few else low, host, "left").select(*quoted(keep), html, gone)
    schema = StructType([pages.schema[c] for c in keep]).add(into, "string")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources, lows = batch.column(len(keep)), batch.column(len(keep) + 1)
            texts = []
            for i in range(batch.num_rows):
                gone = frozenset(v & (2**64 - 1) for v in lows[i].as_py() or ())
                texts.append(page_text(sources[i].as_py() or "", gone))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string())], names=[*keep, into])

    return joined.mapInArrow(extract, schema)
