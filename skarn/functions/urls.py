"""URL functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File extensions that count as documents to download, first match first.
FILE_TYPES = ("pdf", "docx", "doc", "xlsx", "xls", "pptx", "ppt")


def host(url: Column) -> Column:
    """Lower-cased host; empty for what has none."""
    return F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))


def in_scope(url: Column, suffix: str) -> Column:
    h = host(url)
    return F.coalesce(url.startswith("http") & ((h == suffix) | h.endswith("." + suffix)), F.lit(False))


def strip_fragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def file_type(url: Column) -> Column:
    """The extension of a file link, else null; what follows a question mark doesn't count."""
    path = F.lower(F.substring_index(url, "?", 1))
    return F.coalesce(*(F.when(path.endswith("." + x), F.lit(x)) for x in FILE_TYPES))


def resolve(base: Column, href: Column) -> Column:
    """href as an absolute URL for the common forms: absolute, protocol-relative, rooted, query, fragment, and relative to the folder."""
    origin = F.regexp_extract(base, r"^([^:/?#]+://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    folder = F.regexp_replace(path, "[^/]*$", "")
    whole = F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(F.substring_index(base, ":", 1), F.lit(":"), href))
    whole = whole.when(href.startswith("/"), F.concat(origin, href)).when(href.startswith("#"), F.concat(F.substring_index(base, "#", 1), href))
    whole = whole.when(href.startswith("?"), F.concat(origin, path, href))
    whole = whole.otherwise(F.concat(origin, F.when(folder == "", "/").otherwise(folder), href))
    return without_dots(whole)


def without_dots(url: Column) -> Column:
    """An absolute URL whose path has its ``.`` and ``..`` steps taken."""
    pattern = r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)(/[^?#]*)([\s\S]*)$"
    path = F.regexp_extract(url, pattern, 2)
    steps = F.slice(F.split(path, "/"), 2, 1 << 20)
    none = F.array().cast("array<string>")
    taken = F.aggregate(steps, none, lambda got, s: F.when(s == "..", F.when(F.size(got) > 0, F.slice(got, F.lit(1), F.size(got) - 1)).otherwise(got)).when(s == ".", got).otherwise(F.array_append(got, s)))
    tail = F.when(F.element_at(steps, -1).isin(".", "..") & (F.size(taken) > 0), "/").otherwise("")
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.concat(F.regexp_extract(url, pattern, 1), F.lit("/"), F.array_join(taken, "/"), tail, F.regexp_extract(url, pattern, 3))).otherwise(url)
