"""Ingest: change detection and upserts, partial updates, search documents, fetch choice, politeness schedule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skarn.functions.text import document_id

CONTENT_COLUMNS = ("title", "content", "content_hash", "updated_at")


def change_status(incoming: DataFrame, stored: DataFrame, key: str = "url", content_hash: str = "content_hash") -> DataFrame:
    """incoming with status: new, updated (another hash) or unchanged."""
    old = stored.select(key, F.col(content_hash).alias("_old"), F.lit(True).alias("_known"))
    status = F.when(F.col("_known").isNull(), "new").when(F.col("_old").eqNullSafe(F.col(content_hash)), "unchanged").otherwise("updated")
    return incoming.join(old, key, "left").withColumn("status", status).drop("_old", "_known")


def upsert(incoming: DataFrame, stored: DataFrame, key: str = "url", content_hash: str = "content_hash", changes: tuple[str, ...] = CONTENT_COLUMNS) -> DataFrame:
    """The table after incoming rows: new keys come in whole; of a stored key whose hash differs only ``changes`` are
    replaced; all else stays."""
    a, b = incoming.alias("a"), stored.alias("b")
    new = F.col(f"b.{key}").isNull()
    differs = ~F.col(f"a.{content_hash}").eqNullSafe(F.col(f"b.{content_hash}"))
    take = lambda c: F.when(F.col(f"a.{key}").isNull(), F.col(f"b.{c}")).when(new | (differs & F.lit(c in changes)), F.col(f"a.{c}")).otherwise(F.col(f"b.{c}"))
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").select(*(take(c).alias(c) for c in stored.columns))


def insert_or_ignore(incoming: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """stored and the incoming rows with new keys; of rows with equal keys the smallest."""
    whole = F.struct(*(F.col(c) for c in stored.columns))
    fresh = incoming.groupBy(*keys).agg(F.min(whole).alias("_row")).select("_row.*").join(stored.select(*keys), keys, "left_anti")
    return stored.unionByName(fresh.select(*stored.columns))


def partial_update(index: DataFrame, updates: DataFrame, key: str = "id") -> DataFrame:
    """index with the non-null fields of updates merged in; ids that the index doesn't have are never inserted."""
    fields = [c for c in updates.columns if c != key]
    u = updates.select(key, *(F.col(c).alias(f"_{c}") for c in fields))
    joined = index.join(u, key, "left")
    kept = [F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in index.columns]
    return joined.select(*kept, *(F.col(f"_{c}").alias(c) for c in fields if c not in index.columns))


def update_report(index: DataFrame, updates: DataFrame, key: str = "id") -> DataFrame:
    """(ok, failed, first_failed)"""
    known = updates.select(key).join(index.select(key, F.lit(1).alias("_k")), key, "left")
    return known.agg(F.count("_k").alias("ok"), F.count_if(F.col("_k").isNull()).alias("failed"), F.min(F.when(F.col("_k").isNull(), F.col(key))).alias("first_failed"))


def overwrite(index: DataFrame, rows: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """index after a bulk write of whole rows by key: a row replaces the one with its key or is added; of rows with one key the last
    by ``order`` counts; rows with a null or blank key aren't written."""
    ok = rows.where(F.trim(F.coalesce(F.col(key).cast("string"), F.lit(""))) != "")
    whole = F.struct(*(F.col(c) for c in index.columns))
    last = ok.groupBy(key).agg((F.max_by(whole, order) if order else F.max(whole)).alias("_row")).select("_row.*")
    return index.join(last.select(key), key, "left_anti").unionByName(last)


def overwrite_report(rows: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """(ok, failed, first_error) of a bulk write: every row with a key counts as written, first_error names the first that isn't."""
    bad = F.trim(F.coalesce(F.col(key).cast("string"), F.lit(""))) == ""
    at = F.col(order).cast("string") if order else F.lit("?")
    error = F.concat(F.lit("row "), at, F.lit(": no "), F.lit(key))
    first = F.min_by(F.when(bad, error), F.when(bad, F.col(order) if order else F.lit(0)))
    return rows.agg(F.count_if(~bad).alias("ok"), F.count_if(bad).alias("failed"), first.alias("first_error"))


def crawl_counters(status: DataFrame, files: DataFrame, edges: DataFrame) -> DataFrame:
    """(counter, n): pages by status, then files and edges stored."""
    each = status.groupBy(F.col("status").alias("counter")).agg(F.count("*").alias("n"))
    for name, df in (("files", files), ("edges", edges)):
        each = each.unionByName(df.agg(F.count("*").alias("n")).select(F.lit(name).alias("counter"), "n"))
    return each


def search_documents(pages: DataFrame, segment=lambda c: c, lang: str = "vi") -> DataFrame:
    """Search documents of pages(url, title, content, doc_type, subdomain, published_at, crawled_at) with a url that isn't blank."""
    given = lambda c: F.coalesce(F.col(c), F.lit(""))
    ok = pages.where(F.trim(F.coalesce("url", F.lit(""))) != "")
    return ok.select(
        document_id(F.col("url")).alias("id"), "url", given("title").alias("title"), given("content").alias("content"),
        segment(given("title")).alias("title_seg"), segment(given("content")).alias("content_seg"),
        F.coalesce(F.when(F.trim("doc_type") != "", F.col("doc_type")), F.lit("html")).alias("doc_type"),
        "subdomain", F.lit(lang).alias("lang"), F.col("url").alias("dup_group"), F.sha2(given("content"), 256).alias("content_hash"), "published_at", "crawled_at",
    )


def better_fetch(static: Column, rendered: Column, least: int = 200) -> Column:
    """The rendered text where the static one is short and the rendered one longer."""
    return F.when((F.length(F.coalesce(static, F.lit(""))) < least) & (F.length(F.coalesce(rendered, F.lit(""))) > F.length(F.coalesce(static, F.lit("")))), rendered).otherwise(static)


def politeness_schedule(queue: DataFrame, delay_ms: int, host: str = "host", order: list[str] | None = None) -> DataFrame:
    """queue with turn and start_ms: first in, first out within a host, at least delay_ms between two starts."""
    turn = F.row_number().over(Window.partitionBy(host).orderBy(*(order or ["enqueued"])))
    return queue.withColumn("turn", turn).withColumn("start_ms", ((F.col("turn") - 1) * F.lit(delay_ms)).cast("long"))


def allowed_by_robots(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls(url, host, path) that no rule (host, prefix) forbids; hosts without rules allow all."""
    r = rules.where(F.coalesce("prefix", F.lit("")) != "").select(F.col("host").alias("_h"), "prefix")
    return urls.join(r, (F.col("host") == F.col("_h")) & F.col("path").startswith(F.col("prefix")), "left_anti")
