"""HTML pages as rows: title, text, links with anchors, publication date. Regular expressions of the JVM, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.functions.urls import resolve

LINK = r"""(?is)<a\b[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))[^>]*>(.*?)</a>"""
#: The named character references that are decoded, besides numbers.
NAMED = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&#x27;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&"))


def title(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<title\b[^>]*>(.*?)</title>", 1), r"\s+", " "))


def body_text(html: Column) -> Column:
    """Text of the body without scripts, styles and markup, white space collapsed; character references stay."""
    whole = F.coalesce(html, F.lit(""))
    bare = F.regexp_replace(whole, r"(?is)<(script|style|title)\b[^>]*>.*?</\1>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"\s+", " "))


def decoded(text: Column) -> Column:
    """Text with the usual named references decoded, ampersands last."""
    for a, b in NAMED:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def published(html: Column) -> Column:
    """The publication time of a meta element, whatever the order and quotes of its attributes."""
    whole, out = F.coalesce(html, F.lit("")), []
    name, value = r"""property\s*=\s*["']article:published_time["']""", r"""content\s*=\s*(?:"([^"]*)"|'([^']*)')"""
    for pattern in (rf"(?is)<meta\b[^>]*{name}[^>]*{value}", rf"(?is)<meta\b[^>]*{value}[^>]*{name}"):
        out.append(F.nullif(F.concat(F.regexp_extract(whole, pattern, 1), F.regexp_extract(whole, pattern, 2)), F.lit("")))
    return F.coalesce(*out)


def links(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, place, href, link, anchor) of every link with a non-empty target."""
    found = F.posexplode(F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(LINK), F.lit(0))).alias("place", "tag")
    rows = pages.select(F.col(id_col), F.col(url_col).alias("url"), found)
    href = F.trim(decoded(F.concat(*(F.regexp_extract("tag", LINK, k) for k in (1, 2, 3)))))
    anchor = F.trim(F.regexp_replace(decoded(F.regexp_replace(F.regexp_extract("tag", LINK, 4), r"(?s)<[^>]*>", "")), r"\s+", " "))
    return rows.select(id_col, "url", "place", href.alias("href"), anchor.alias("anchor")).where("href <> ''").withColumn("link", resolve(F.col("url"), F.col("href")))
