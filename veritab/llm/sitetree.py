"""Main text of pages by site style trees.

The pages of a host are merged into one tree: a node is known by its place, a style of it is the labels of its branches, or its text where it has none. The
entropy of a node's styles over the pages that have it, as a part of the most there could be, is its own importance; weighted with that of what it holds,
its composite importance. Branches that are of low importance with all they hold, as they look alike and read alike everywhere, are removed from each page. What markup itself settles
is never in doubt: an article stays, landmarks and what names of classes call menus, notices, adverts, forms or comments go (``pagetree``).

A composite importance is a sum over all nodes below, each with its share of pages and of the page, so that no recursion is needed: nodes are counted, joined
with their ancestors once, and added up. Pages of one host that bear one title and have the same text in all that markup doesn't set aside are copies and
count as one, so that copies of an article don't look like a menu; pages that differ in any of that text each count, whatever their titles. Pages without a title are copies only if
they are the same tree. Only what two pages share is kept of the tree; what one page has alone is as important as can be, and is counted where it hangs.

Layouts of a few pages of a large host are judged like any others. What much of a host shares is looked up by host, the rest by page, so that no list grows with its host.

Defined results: a null or empty html has an empty text; a page without a host is judged by its markup alone, as is a host's only page; branches deeper than
``pagetree.DEPTH`` are one node; repeated rows stay repeated; null page_ids and urls stay null; a page of any length is taken whole; columns beside
page_id, url and html aren't read, so they may have any name; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.llm import pagetree
from veritab.llm.shared import stored
from veritab.llm.urlfilter import host

#: Branches of less composite importance are removed.
LEAST = 0.3
#: How many pages' evidence the markup weighs; below five or six pages the tree removes nothing.
PRIOR_PAGES = 2
#: What a node's own importance leaves to its branches, by style.
FADING = 0.9
#: More styles than this count as this many; their branches then weigh next to nothing.
STYLES_MOST = 50
#: Nodes on a smaller part of their host's pages are looked up by page, not by host; results are the same. This bounds a host's list: at most 1 / SHARE times the nodes of an average page.
SHARE = 0.002
BRANCHES = "array<struct<path:array<bigint>,style:bigint,size:int,spread:double>>"
_TYPE = pa.list_(pa.struct([("path", pa.list_(pa.int64())), ("style", pa.int64()), ("size", pa.int32()), ("spread", pa.float64())]))
TEXT = "page_id long, url string, text string, n_chars long, by_tree int, by_markup int"


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        copies, pages, every = [], [], []
        for html in batch.column(2).to_pylist():
            root, title = pagetree.parse(html)
            found = [{"path": b.path, "style": b.style, "size": b.size, "spread": b.spread} for b in pagetree.site_branches(root)]
            own = pagetree.digest(*((b["path"][-1], b["style"]) for b in found))
            copies.append(pagetree.digest("title", title, *pagetree.blocks(root)) if title else own)
            pages.append(own)
            every.append(found)
        columns = [pa.array(copies, pa.int64()), pa.array(pages, pa.int64()), pa.array(every, _TYPE)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["host", "html_hash", "copy", "page", "branches"])


def page_trees(pages: DataFrame) -> DataFrame:
    """pages (url, html) -> host, html_hash, copy, page and branches of each that has a host."""
    named = pages.select(host(F.col("url")).alias("host"), F.xxhash64("html").alias("html_hash"), "html").where("host != ''")
    return named.mapInArrow(_trees, f"host string, html_hash long, copy long, page long, branches {BRANCHES}")


def site_trees(pages: DataFrame) -> DataFrame:
    """pages (url, html) -> what ``shared_nodes`` gives."""
    return shared_nodes(page_trees(pages))


def shared_nodes(trees: DataFrame) -> DataFrame:
    """The nodes that two pages of a host share: host, node, path, spread, pages (that have it), styles, own (importance)."""
    one = trees.groupBy("host", "copy").agg(F.min_by("branches", "page").alias("branches"))
    nodes = one.select("host", F.explode("branches").alias("b")).select("host", F.element_at("b.path", -1).alias("node"), "b.*")
    styles = nodes.groupBy("host", "node", "style", "size").agg(F.count("*").alias("n"), F.min("path").alias("path"), F.min("spread").alias("spread"))
    by_node = styles.groupBy("host", "node").agg(
        F.sum("n").alias("pages"), F.count("*").alias("styles"), F.sum(F.col("n") * F.log("n")).alias("spoken"), F.max("size").alias("size"),
        F.count_if((F.col("n") == 1) & (F.col("size") > 0)).alias("alone"), F.min("path").alias("path"), F.min("spread").alias("spread"),
    ).where("pages > 1")
    most = F.log("pages")
    entropy = (most - F.col("spoken") / F.col("pages")) / most
    fading = F.pow(F.lit(FADING), F.least("styles", F.lit(STYLES_MOST)))
    own = F.when(F.col("size") == 0, entropy).otherwise((1 - fading) * entropy + fading * F.col("alone") / F.col("pages"))
    return by_node.select("host", "node", "path", "spread", "pages", F.least("styles", F.lit(STYLES_MOST)).cast("long").alias("styles"), own.alias("own"))


def composite(nodes: DataFrame) -> DataFrame:
    """Nodes of ``site_trees`` plus composite importance. ``nodes`` must be a written table."""
    up = nodes.select("host", "node", F.explode(F.slice("path", 1, F.size("path") - 1)).alias("above"))
    styles = nodes.select("host", F.col("node").alias("above"), F.col("styles").alias("s"))
    above = up.join(styles, ["host", "above"]).groupBy("host", "node").agg(F.sum("s").alias("s"))
    # how much of the root's importance a node's own makes up, but for the pages
    weighed = nodes.join(above, ["host", "node"], "left").withColumn("weight", F.col("spread") * F.pow(F.lit(FADING), F.coalesce("s", F.lit(0))))
    parts = weighed.select("host", F.explode("path").alias("node"), (F.col("pages") * F.col("weight") * F.col("own")).alias("part"))
    sums = parts.groupBy("host", "node").agg(F.sum("part").alias("sum"))
    return weighed.join(sums, ["host", "node"]).withColumn("importance", F.col("sum") / (F.col("pages") * F.col("weight"))).drop("s", "weight", "sum")


def judged(pages: Column, importance: Column, prior: Column) -> Column:
    """Importance after ``PRIOR_PAGES`` pages of what the markup lets expect."""
    return ((pages - 1) * importance + PRIOR_PAGES * prior) / (pages - 1 + PRIOR_PAGES)


def site_rules(pages: DataFrame, least: float = LEAST) -> tuple[DataFrame, DataFrame]:
    """low and high: nodes that go from their pages, and such that stay though their page has an article elsewhere. Two written tables: by host what much of it shares, and by host and
    html_hash the others, each beside the pages that have it. A page's list is no longer than its branches; pages of one hash share a list, which changes nothing, as nodes of other pages aren't in theirs."""
    trees = stored(page_trees(pages), "pages")
    nodes = stored(composite(stored(shared_nodes(trees), "tree")), "importance")
    marked = F.element_at("path", 1) == F.lit(pagetree.digest("root", True))
    value = judged(F.col("pages"), F.col("importance"), F.when(marked, 0.0).otherwise(1.0))
    roots = nodes.where(F.size("path") == 1).groupBy("host").agg(F.sum("pages").alias("all"))
    low = value < least
    common = F.col("pages") >= SHARE * F.col("all")
    named = nodes.join(roots, "host").where(low | marked).select("host", "node", low.alias("is_low"), common.alias("common"))
    lists = [F.collect_set(F.when(F.col("is_low") == is_low, F.col("node"))).alias(name) for is_low, name in ((True, "low"), (False, "high"))]
    held = trees.select("host", "html_hash", F.explode("branches.path").alias("path")).select("host", "html_hash", F.element_at("path", -1).alias("node"))
    by_page = held.join(named.where(~F.col("common")), ["host", "node"]).groupBy("host", "html_hash").agg(*lists)
    return stored(named.where("common").groupBy("host").agg(*lists), "rules"), stored(by_page, "page_rules")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in TEXT.split(", ")]
    for batch in batches:
        rules = zip(*(batch.column(k).to_pylist() for k in range(2, 7)))
        found = [pagetree.main_text(pagetree.parse(html)[0], {*(low or ()), *(low_here or ())}, {*(high or ()), *(high_here or ())}) for html, low, high, low_here, high_here in rules]
        texts, by_tree, by_markup = ([f[k] for f in found] for k in range(3))
        columns = [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(by_tree, pa.int32()), pa.array(by_markup, pa.int32())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names)


def main_texts(pages: DataFrame, least: float = LEAST) -> DataFrame:
    """pages (page_id, url, html) -> rows of TEXT. Spark broadcasts the rules if their size allows, else it joins by host, or by host and hash, and may split a frequent one."""
    by_host, by_page = site_rules(pages, least)
    by_host = by_host.withColumnRenamed("host", "_h")
    by_page = by_page.toDF("_p", "_x", "low_here", "high_here")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    named = host(F.col("url"))
    # by page first, as a shuffle for that carries no host's lists
    met = rows.join(by_page, (named == F.col("_p")) & (F.xxhash64("html") == F.col("_x")), "left").join(by_host, named == F.col("_h"), "left")
    return met.select("page_id", "url", "html", "low", "high", "low_here", "high_here").mapInArrow(_extract, TEXT)


def op11_site_style_tree(spark, sf_dir):
    return main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
