"""Inverted index tables: tokens, postings, lengths and statistics per field."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.functions import text as X
from skarn.functions.runtime import cut, map_arrow, shuffle_partitions, stage
from skarn.operators import matches

Field = tuple[str, Callable[[Column], Column], Callable[[Column], Column]]
#: Fields of a search document: name, what of the text, and its tokens.
SEGMENTED: tuple[Field, ...] = (("title", X.title_of, X.word_tokens), ("content", lambda t: t, X.word_tokens))
FOLDED: tuple[Field, ...] = (("title_folded", X.title_of, X.folded_tokens), ("content_folded", lambda t: t, X.folded_tokens))


@dataclass(frozen=True)
class Index:
    """fields(doc_id, field, dl, tokens): one row for each document and non-empty field, never shuffled.

    Without a stored table postings are counted for the terms that are asked for, in the scan of the documents and row by row, so nothing is shuffled. ``store``
    writes all postings once, dealt into folders by term, and a search then reads the folders and row groups of its
    terms only. Statistics come from all documents, whatever filters a search has.
    """

    fields: DataFrame
    #: (bucket, field, term, doc_id, dl, tf, positions), where the index is stored.
    stored: DataFrame | None = None

    def _stored(self, terms: DataFrame) -> DataFrame:
        wanted = terms.select("term").distinct().withColumn("bucket", bucket_of(F.col("term")))
        return self.stored.join(wanted, ["bucket", "term"], "left_semi")

    def _scan(self, fn, terms: DataFrame | None, schema: str, **more: bool) -> DataFrame:
        """fn over all rows for these terms or for all; more terms than TERMS are joined with what is counted of all."""
        few = None if terms is None else terms.select("term").where("term is not null").distinct().limit(TERMS + 1).collect()
        joined = few is not None and len(few) > TERMS
        asked = None if few is None or joined else pa.array([r[0] for r in few], pa.string())
        key = self.fields.schema["doc_id"].dataType.simpleString()
        out = map_arrow(self.fields.select("doc_id", "field", "dl", "tokens"), fn(asked, **more), schema.format(key))
        if not joined:
            return out
        kept = out.join(terms.select("term").distinct(), "term", "left_semi").select(out.columns)
        return kept.union(out.where("term is null")) if more.get("lengths") else kept

    def tokens(self, terms: DataFrame | None = None) -> DataFrame:
        """(doc_id, field, dl, pos, term), of these terms or of all."""
        if self.stored is not None and terms is not None:
            return self._stored(terms).select("doc_id", "field", "dl", F.explode("positions").alias("pos"), "term")
        t = self.fields.select("doc_id", "field", "dl", F.posexplode("tokens").alias("pos", "term"))
        return t if terms is None else t.join(terms.select("term").distinct(), "term", "left_semi")

    def postings(self, terms: DataFrame | None = None) -> DataFrame:
        """(field, term, doc_id, dl, tf), of these terms or of all."""
        if self.stored is not None:
            return (self.stored if terms is None else self._stored(terms)).select("field", "term", "doc_id", "dl", "tf")
        return self._scan(matches.count_terms, terms, POSTING)

    def search(self, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The postings of these terms and the field_stats, both of one scan, to be read several times."""
        if self.stored is not None:
            return self.postings(terms), self.field_stats()
        rows = stage(self._scan(matches.count_terms, terms, POSTING, lengths=True))
        return rows.where("term is not null"), _field_stats(rows.where("term is null"))

    def term_stats(self, terms: DataFrame | None = None) -> DataFrame:
        """(field, term, df, cf), of these terms or of all."""
        if self.stored is not None:
            return term_stats(self.postings(terms))
        return _added(self._scan(matches.count_statistics, terms, STATISTIC))

    def statistics(self, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The term_stats of these terms and the field_stats, both of one scan, to be read several times."""
        if self.stored is not None:
            return term_stats(self.postings(terms)), self.field_stats()
        rows = cut(_added(self._scan(matches.count_statistics, terms, STATISTIC, lengths=True)))
        fields = rows.where("term is null").select("field", F.col("df").alias("n_docs"), F.col("cf").alias("total_tokens"), (F.col("cf") / F.col("df")).alias("avgdl"))
        return rows.where("term is not null"), fields

    def field_stats(self) -> DataFrame:
        """(field, n_docs, total_tokens, avgdl) over all documents that have the field."""
        return _field_stats(self.fields)


POSTING = "field string, term string, doc_id {}, dl long, tf long"
STATISTIC = "field string, term string, df long, cf long"
#: So many terms at most go to the workers of a scan.
TERMS = 200_000


def _added(statistics: DataFrame) -> DataFrame:
    return statistics.groupBy("field", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def _field_stats(rows: DataFrame) -> DataFrame:
    return rows.groupBy("field").agg(F.count("*").alias("n_docs"), F.sum("dl").alias("total_tokens"), F.avg("dl").alias("avgdl"))


BUCKETS = 32


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def store(index: Index, path: str) -> Index:
    """The index written to a folder of the shared file system, once: the forward rows, and the postings with positions by bucket of the term. A bucket is
    dealt over several tasks by document, so that a very frequent term isn't written by one."""
    spark = index.fields.sparkSession
    index.fields.write.mode("overwrite").parquet(f"{path}/fields")
    forward = spark.read.parquet(f"{path}/fields")
    posted = forward.select("doc_id", "field", "dl", F.posexplode("tokens").alias("pos", "term")).groupBy("field", "term", "doc_id", "dl")
    posted = posted.agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions")).withColumn("bucket", bucket_of(F.col("term")))
    tasks = shuffle_partitions(spark)
    dealt = posted.repartition(tasks, "bucket", F.pmod(F.xxhash64("doc_id"), F.lit(max(1, tasks // BUCKETS))))
    dealt.sortWithinPartitions("bucket", "field", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    return Index(forward, spark.read.parquet(f"{path}/postings"))


def build(docs: DataFrame, fields: tuple[Field, ...] = SEGMENTED, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Documents without a token in a field have no row for it."""
    per_field = F.array(*(F.struct(F.lit(name).alias("field"), tokens(part(F.col(text_col))).alias("tokens")) for name, part, tokens in fields))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.explode(per_field).alias("f"))
    return _of_fields(rows)


def segmented_fields(segment: Callable[[Column], Column]) -> tuple[Field, ...]:
    """Title and content as the words that a segmenter leaves, compounds joined."""
    words = lambda text: F.filter(F.split(segment(text), " "), lambda x: x != "")
    return (("title", X.title_of, words), ("content", lambda t: t, words))


def with_anchors(index: Index, anchors: DataFrame, tokens: Callable[[Column], Column] = X.word_tokens) -> Index:
    """The index with the field ``anchor`` from anchors(doc_id, anchor_text): what links say of a document."""
    rows = anchors.select("doc_id", F.struct(F.lit("anchor").alias("field"), tokens(F.col("anchor_text")).alias("tokens")).alias("f"))
    return Index(index.fields.unionByName(_of_fields(rows).fields))


def _of_fields(rows: DataFrame) -> Index:
    return Index(rows.select("doc_id", "f.field", F.size("f.tokens").cast("long").alias("dl"), "f.tokens").where("dl > 0"))


def term_stats(postings: DataFrame) -> DataFrame:
    """(field, term, df, cf)"""
    return postings.groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
