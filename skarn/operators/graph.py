"""Links between documents: cleaning, anchors, degrees, PageRank, breadth-first levels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skarn.functions.runtime import cut
from skarn.operators.ingest import partial_update


def clean_links(links: DataFrame) -> DataFrame:
    """Links (src, dst, anchor) without blank ends, self loops and repeats; a null anchor is empty, anchors are trimmed."""
    ok = F.coalesce((F.trim("src") != "") & (F.trim("dst") != "") & (F.col("src") != F.col("dst")), F.lit(False))
    return links.where(ok).select("src", "dst", F.trim(F.coalesce("anchor", F.lit(""))).alias("anchor")).distinct()


def corpus_links(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links with both ends among nodes(id)."""
    return links.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")


def anchor_text(links: DataFrame, size: int = 2000) -> DataFrame:
    """(dst, anchor_text): inbound anchors by (src, anchor), joined by spaces, cut. Of each end no more anchors are gathered than the cut can show."""
    said = links.where("trim(anchor) <> ''").select("dst", "src", "anchor")
    order = Window.partitionBy("dst").orderBy("src", "anchor")
    few = said.withColumn("n", F.row_number().over(order)).where(F.col("n") <= size)
    return few.groupBy("dst").agg(F.array_sort(F.collect_list(F.struct("n", "anchor"))).alias("a")).select("dst", F.substring(F.trim(F.array_join(F.transform("a", lambda x: x["anchor"]), " ")), 1, size).alias("anchor_text"))


def degrees(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, out_degree, in_degree) over distinct links."""
    e = links.select("src", "dst").distinct()
    out = e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"))
    into = e.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"))
    return nodes.select("id").join(out, "id", "left").join(into, "id", "left").na.fill(0)


@dataclass(frozen=True)
class PageRank:
    ranks: DataFrame
    iterations: int
    converged: bool


def pagerank(nodes: DataFrame, links: DataFrame, damping: float = 0.85, tolerance: float = 1e-8, most: int = 100, cut_every: int = 5) -> PageRank:
    """ranks(id, pagerank) by power iteration; dangling mass is spread evenly.

    Links are kept partitioned by their source with the share each carries; a round is a join and a pre-aggregated
    sum. Convergence (L1 distance) is looked at in every round, each round then cut; a tolerance of 0 or less runs ``most`` rounds.
    """
    e = corpus_links(links.where("src <> dst").select("src", "dst").distinct(), nodes)
    out = e.groupBy("src").agg(F.count("*").alias("deg"))
    shares = cut(e.join(out, "src").select("src", "dst", (1.0 / F.col("deg")).alias("share")))
    base = cut(nodes.select("id").distinct().join(out.withColumnRenamed("src", "id"), "id", "left").select("id", F.col("deg").isNull().alias("dangling")))
    n = base.count()
    if n == 0:
        return PageRank(nodes.select("id", F.lit(0.0).alias("pagerank")).limit(0), 0, True)
    r = base.select("id", "dangling", F.lit(1.0 / n).alias("pagerank"))
    for i in range(1, most + 1):
        given = r.join(shares, r.id == shares.src).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("pagerank") * F.col("share")).alias("given"))
        mass = r.where("dangling").agg(F.coalesce(F.sum("pagerank"), F.lit(0.0)).alias("mass"))
        nxt = r.join(given, "id", "left").join(F.broadcast(mass)).select(
            "id", "dangling", F.col("pagerank").alias("before"), ((1 - damping) / n + damping * (F.coalesce("given", F.lit(0.0)) + F.col("mass") / n)).alias("pagerank")
        )
        if tolerance > 0 or i % cut_every == 0 or i == most:
            nxt = cut(nxt)
            if tolerance > 0 and nxt.agg(F.sum(F.abs(F.col("pagerank") - F.col("before")))).first()[0] < tolerance:
                return PageRank(nxt.select("id", "pagerank"), i, True)
        r = nxt.select("id", "dangling", "pagerank")
    return PageRank(r.select("id", "pagerank"), most, tolerance <= 0)


def link_fields(index: DataFrame, ranks: DataFrame, anchors: DataFrame, segment=lambda c: c, key: str = "doc_id") -> DataFrame:
    """index with pagerank (0 where there is none) and, only where they aren't blank, anchor_text and anchor_text_seg written back.
    ranks has (key, pagerank), anchors (key, anchor_text)."""
    text = F.when(F.trim("anchor_text") != "", F.col("anchor_text"))
    told = anchors.select(key, text.alias("anchor_text"), F.when(text.isNotNull(), segment(text)).alias("anchor_text_seg"))
    news = index.select(key).join(ranks.select(key, "pagerank"), key, "left").join(told, key, "left").withColumn("pagerank", F.coalesce("pagerank", F.lit(0.0)))
    return partial_update(index, news, key)


def crawl(seeds: DataFrame, links: DataFrame, depth: int, most_pages: int) -> tuple[DataFrame, DataFrame]:
    """(pages, edges) of a breadth-first crawl over stored links(src, dst) from seeds(id): pages(id, level) within ``depth`` links and at most
    ``most_pages``, the smaller ids of a level first; edges are all links of the pages, also those to pages seen before or too deep."""
    front = cut(seeds.select("id").distinct().orderBy("id").limit(max(0, most_pages)).withColumn("level", F.lit(0)))
    pages, held = front, front.count()
    for level in range(1, depth + 1):
        if held >= most_pages:
            break
        found = front.join(links, front.id == links.src).select(F.col("dst").alias("id")).distinct().join(pages.select("id"), "id", "left_anti")
        front = cut(found.orderBy("id").limit(most_pages - held).withColumn("level", F.lit(level)))
        new = front.count()
        if not new:
            break
        pages, held = cut(pages.union(front)), held + new
    return pages, links.join(pages.select(F.col("id").alias("src")), "src", "left_semi")


def bfs_levels(seeds: DataFrame, links: DataFrame, depth: int) -> DataFrame:
    """(id, level): nodes reached from seeds(id) within ``depth`` links; each level is joined with the links and cleared of what was seen."""
    seen = cut(seeds.select("id").distinct().withColumn("level", F.lit(0)))
    front, parts = seen, [seen]
    for level in range(1, depth + 1):
        found = front.join(links, front.id == links.src).select(F.col("dst").alias("id")).distinct()
        for p in parts:
            found = found.join(p.select("id"), "id", "left_anti")
        front = cut(found.withColumn("level", F.lit(level)))
        if front.isEmpty():
            break
        parts.append(front)
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
