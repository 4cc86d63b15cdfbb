"""Main-text extraction from HTML, with suffix arrays over the pages of a host against boilerplate.

A page is read into blocks of text; elements that hold menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles and reader comments are left out, and where a page has an article or main element
only what lies inside it counts. What no name or element marks is found by its repeats: the pages of a host are laid end to end as
streams of words and their suffixes are sorted to the ``depth`` at which a repeat counts as long. Neighbours in that order with so
long a common prefix are one substring; on how many distinct pages it stands is summed over the host. A
substring on at least ``least_share`` of the host's pages and on ``least_pages`` is boilerplate; inside articles, which may quote and
copy each other, it takes ``article_share`` and ``article_pages``. Covered words go, the unique runs are kept, and the
blocks are joined in page order.

Pages with equal words are one page. A host's pages are dealt by their words' hash into shards of about ``shard_pages``, each with a suffix array of
its own, and the shards' counts are added up, so a large host is treated as a small one is and no task holds a host whole. A shard leaves out counts
of less than a quarter of the share that matters. Only word hashes are shuffled; the texts are cut where they are read.

Defined results: a null or empty html gives an empty text; character references are decoded; tags that are not
closed end with what holds them; a null or odd url counts as a host of its own kind; repeated rows are extracted each; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.functions.runtime import cut, map_arrow, ship

ATTRS = r"""(?:[^>"']|"[^"]*"|'[^']*')*"""
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|title|svg|iframe|textarea|select|object|canvas|audio|video)\b" + ATTRS + r">.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)(" + ATTRS + r")>|<[!?][^>]*>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Fixed values of HTML: elements without content, elements within a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements and roles that mark what isn't the article, words of class and id that do, and words that say nothing beside them.
LEFT_OUT = frozenset("nav header footer aside form menu dialog button fieldset input".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
MARKS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promotion promotions banner banners sidebar nav navbar navigation menu"
    " breadcrumb breadcrumbs header masthead footer cookie cookies consent gdpr notice notices popup newsletter subscribe signup"
    " login sharing comment comments commentlist disqus pagination toolbar".split()
)
BESIDE = frozenset(
    "a the box boxes section list item items container wrapper wrap area block unit slot bar buttons links posts inner outer top bottom left right main site page global primary"
    " secondary user users reader readers thread form text content js id div social related".split()
)
#: Those that inside an article can be the article's own.
MARKS_INSIDE = MARKS - frozenset("header masthead banner banners".split())
MAIN = frozenset(("article", "main"))
WORDS = re.compile(r"[a-z]+")


def _marked(names: str, marks: frozenset[str]) -> bool:
    """Whether one of the names (of a class or id attribute) is made of marks, and of words that say nothing."""
    return any(not marks.isdisjoint(w) and (marks | BESIDE).issuperset(w) for w in map(WORDS.findall, names.split()))


def _left_out(tag: str, attrs: str, inside: bool) -> bool:
    if tag in LEFT_OUT:
        return not (inside and tag == "header")  # an article's own header has its title
    if "=" not in attrs:
        return bool(re.search(r"\bhidden\b", attrs))
    for m in ATTRIBUTE.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and HIDDEN.search(value):
            return True
        if name in ("class", "id") and tag not in ("body", "html", *MAIN) and _marked(value, MARKS_INSIDE if inside else MARKS):
            return True
    return False


def blocks(page: str) -> list[tuple[str, bool]]:
    """(text, whether inside an article or main element) of the page's blocks, without what is marked as left out."""
    out: list[tuple[str, bool]] = []
    held: list[str] = []
    stack: list[tuple[str, bool]] = []  # open elements, and whether each is left out
    skipped = inside = 0
    at = 0

    def close() -> None:
        text = " ".join(html.unescape("".join(held)).split())
        if text:
            out.append((text, inside > 0))
        held.clear()

    def pop() -> None:
        nonlocal skipped, inside
        tag, gone = stack.pop()
        skipped, inside = skipped - gone, inside - (tag in MAIN)

    def say(text: str) -> None:
        if text and not skipped:
            held.append(text)

    for m in MARKUP.finditer(page):
        say(page[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            if m[1] and m[1].lower() not in ("script", "style"):
                held.append(" ")
            continue
        if tag not in INLINE:
            close()
        if m[2]:
            if any(t == tag for t, _ in stack):
                while stack[-1][0] != tag:
                    pop()
                pop()
        elif tag not in VOID and not m[4].endswith("/"):
            if tag in MAIN:  # an article isn't inside what was never closed
                while skipped and stack:
                    pop()
            gone = not skipped and _left_out(tag, m[4], inside > 0)
            stack.append((tag, gone))
            skipped, inside = skipped + gone, inside + (tag in MAIN)
    say(page[at:])
    close()
    return [x for x in out if x[1]] if any(x[1] for x in out) else out


def word_hashes(said: list[str]) -> np.ndarray:
    known = {w: xxhash.xxh32_intdigest(w.encode("utf-8", "replace")) for w in set(said)}
    return np.fromiter((known[w] for w in said), np.uint32, len(said))


def gram_hashes(words: np.ndarray, depth: int) -> np.ndarray:
    """A 64-bit hash of every run of ``depth`` words, by its first word."""
    n = words.size - depth + 1
    out = np.zeros(max(0, n), np.uint64)
    for k in range(depth if n > 0 else 0):
        out = (out ^ words[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def suffix_array(words: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in the order of their first words (a power of two, at least depth), and the rank of each suffix: equal where these
    words are."""
    rank, k = np.unique(words, return_inverse=True)[1].astype(np.int64), 1
    while k < depth:
        after = np.zeros_like(rank)
        after[:-k] = rank[k:] + 1
        rank, k = np.unique(rank * (rank.size + 2) + after, return_inverse=True)[1].astype(np.int64), 2 * k
    return np.argsort(rank, kind="stable"), rank


def repeats(pages: list[np.ndarray], depth: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(hash, pages): the runs of ``depth`` words that stand on at least ``least`` of these distinct pages, and on how many."""
    depth = 1 << (depth - 1).bit_length()
    long = [p for p in pages if p.size >= depth]
    if not long:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    # a mark after each page that is unlike all else, so that no substring runs over its end
    sizes = np.array([p.size + 1 for p in long])
    stream = np.concatenate([np.append(p.astype(np.int64), -1 - i) for i, p in enumerate(long)])
    owner = np.repeat(np.arange(len(long)), sizes)
    order, rank = suffix_array(stream, depth)
    first = np.flatnonzero(np.diff(rank[order], prepend=-1))  # where a new substring begins in the order
    on = np.bincount(np.unique(rank * len(long) + owner) // len(long), minlength=first.size)
    within = np.concatenate([np.arange(p.size + 1) <= p.size - depth for p in long])
    some = np.flatnonzero((on >= least) & within[order[first]])
    grams = np.concatenate([np.append(gram_hashes(p, depth), np.zeros(depth, np.uint64)) for p in long])
    return grams[order[first[some]]], on[some]


def unique_runs(page: list[str], boilerplate: np.ndarray, depth: int) -> str:
    """The blocks' text without the words that runs with these hashes (sorted) cover."""
    if boilerplate.size:
        depth = 1 << (depth - 1).bit_length()
        said = [text.split(" ") for text in page]
        flat = [w for words in said for w in words]
        grams = gram_hashes(word_hashes(flat), depth)
        at = np.minimum(np.searchsorted(boilerplate, grams), boilerplate.size - 1)
        hit = np.flatnonzero(boilerplate[at] == grams)
        if hit.size:
            change = np.bincount(hit, minlength=len(flat) + 1) - np.bincount(hit + depth, minlength=len(flat) + 1)
            keep = np.cumsum(change)[: len(flat)] == 0
            page, k = [], 0
            for words in said:
                page.append(" ".join(w for w, ok in zip(words, keep[k : k + len(words)].tolist()) if ok))
                k += len(words)
            page = [text for text in page if text]
    return " ".join(page)


BROADCAST_RUNS, BROADCAST_HOSTS = 500_000, 100_000


def boilerplate(pages: DataFrame, depth: int, least_share: float, least_pages: int, article_share: float, article_pages: int, shard_pages: int) -> DataFrame:
    """(host, inside, runs): of hosts with boilerplate, the sorted hashes of its runs; inside tells what stands in articles. pages has (host, html)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [blocks(t) for t in b.column(1).to_pylist()]
            words = [word_hashes([w for text, _ in x for w in text.split(" ")]) for x in found]
            ends = np.cumsum([0, *map(len, words)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint32), *words]).view(np.int32)))
            whole = [xxhash.xxh3_64_intdigest(w.tobytes()) >> 1 for w in words]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bool(x) and x[0][1] for x in found]), pa.array(whole, pa.int64()), lists], names=["host", "inside", "whole", "words"])

    read_pages = map_arrow(pages, read, "host string, inside boolean, whole long, words array<int>").where("size(words) > 0")
    large = cut(pages.groupBy("host").agg(F.ceil(F.count("*") / shard_pages).cast("int").alias("shards")).where("shards > 1"))
    if large.count() <= BROADCAST_HOSTS:
        large = F.broadcast(large)
    dealt = read_pages.join(large, "host", "left").withColumn("shard", F.pmod("whole", F.coalesce("shards", F.lit(1))).cast("int")).drop("shards")

    def one(t: pa.Table) -> pa.Table:
        _, first = np.unique(t["whole"].to_numpy(), return_index=True)
        t = t.take(pa.array(first))
        lists = t["words"].combine_chunks()
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        flat, edge = lists.values.to_numpy().view(np.uint32), lists.offsets.to_numpy()
        inside = t["inside"][0].as_py()
        share = article_share if inside else least_share
        runs, on = repeats([flat[i:j] for i, j in zip(edge[:-1], edge[1:])], depth, max(2, share / 4 * len(first)))
        # the shard's number of pages goes under a null run
        return pa.table({
            "host": pa.array([t["host"][0].as_py()] * (runs.size + 1), pa.string()), "inside": pa.array([inside] * (runs.size + 1)),
            "run": pa.concat_arrays([pa.nulls(1, pa.int64()), pa.array(runs.view(np.int64))]), "pages": pa.array(np.concatenate(([len(first)], on)).astype(np.int64)),
        })

    counted = dealt.groupBy("host", "inside", "shard").applyInArrow(one, "host string, inside boolean, run long, pages long").groupBy("host", "inside", "run").agg(F.sum("pages").alias("pages"))
    counted = cut(counted)
    of = counted.where("run IS NULL").select("host", "inside", F.col("pages").alias("of"))
    least = F.when(F.col("inside"), F.greatest(F.lit(article_pages), article_share * F.col("of"))).otherwise(F.greatest(F.lit(least_pages), least_share * F.col("of")))
    common = counted.where("run IS NOT NULL").join(of, ["host", "inside"]).where(F.col("pages") >= least)
    return common.groupBy("host", "inside").agg(F.sort_array(F.collect_list("run")).alias("runs"), F.count("*").alias("n"))


def extract(
    pages: DataFrame, depth: int = 8, least_share: float = 0.5, least_pages: int = 3, article_share: float = 0.9, article_pages: int = 8, shard_pages: int = 256,
) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages (page_id, url, html)."""
    ship(pages.sparkSession)
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[^:/?#]+://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    given = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))
    runs = cut(boilerplate(given.select("host", "html"), depth, least_share, least_pages, article_share, article_pages, shard_pages))
    n = runs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    of_host = runs.groupBy("host").agg(*(F.first(F.when(F.col("inside") == kind, F.col("runs")), ignorenulls=True).alias(name) for kind, name in ((True, "in_article"), (False, "elsewhere"))))
    known = given.join(F.broadcast(of_host) if n <= BROADCAST_RUNS else of_host, "host", "left").select("page_id", "url", "html", "in_article", "elsewhere")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.uint64)
        for b in batches:
            texts = []
            for k, t in enumerate(b.column(2).to_pylist()):
                found = blocks(t)
                own = b.column(3 if found and found[0][1] else 4)[k].values
                common = none if own is None else np.sort(own.to_numpy().view(np.uint64))
                texts.append(unique_runs([x for x, _ in found], common, depth))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    ids = pages.schema["page_id"].dataType.simpleString()
    return map_arrow(known, read, f"page_id {ids}, url string, text string, n_chars long")
