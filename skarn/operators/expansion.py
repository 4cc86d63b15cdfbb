"""Query expansion and spelling: synonym groups, pseudo-relevance feedback, corrections from a vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skarn.functions.runtime import cut
from skarn.functions.text import char_kgrams, jaccard
from skarn.operators.index import Index

SPELL_K, LEAST_JACCARD = 2, 0.25


def synonyms(queries: DataFrame, groups: DataFrame, most: int = 4) -> DataFrame:
    """(qid, place, phrase): for queries(qid, text) the absent phrases of groups(group_id, place, phrase) that have a phrase in
    the query, in order of group and place, at most ``most``. The groups are a word list: Spark broadcasts them if small."""
    inside = F.instr(F.concat(F.lit(" "), F.lower("text"), F.lit(" ")), F.concat(F.lit(" "), F.col("phrase"), F.lit(" "))) > 0
    lists = groups.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("place", "phrase"))).alias("phrases"))
    pairs = queries.join(lists).select("qid", "text", "group_id", F.explode("phrases").alias("p")).select("qid", "text", "group_id", "p.place", "p.phrase").withColumn("inside", inside)
    of_group = Window.partitionBy("qid", "group_id")
    absent = pairs.withColumn("hit", F.max("inside").over(of_group)).where("hit and not inside")
    first = absent.groupBy("qid", "phrase").agg(F.min(F.struct("group_id", "place")).alias("at"))
    order = Window.partitionBy("qid").orderBy("at")
    return first.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("qid", "place", "phrase")


#: Feedback of at most so many documents is broadcast.
FEEDBACK_ROWS = 1_000_000


def rocchio_terms(index: Index, feedback: DataFrame, query_terms: DataFrame, stopwords: DataFrame, n_terms: int = 8, field: str = "content", letters: bool = True) -> DataFrame:
    """(qid, place, term, freq): most frequent terms of feedback(qid, doc_id), at least two characters and (unless ``letters`` is off) one letter, neither
    in the query nor a stopword (of a compound its first part is looked up); ties by term."""
    feedback = cut(feedback.select("qid", "doc_id"))
    rows = index.fields.where(F.col("field") == field).join(F.broadcast(feedback) if feedback.count() <= FEEDBACK_ROWS else feedback, "doc_id")
    t = rows.select("qid", F.explode("tokens").alias("term")).where(F.length("term") >= 2)
    t = t.where(F.col("term").rlike(r"\p{L}")) if letters else t
    t = t.groupBy("qid", "term").agg(F.count("*").alias("freq")).join(query_terms.select("qid", "term"), ["qid", "term"], "left_anti")
    t = t.join(stopwords.select(F.col("word").alias("_w")), F.substring_index("term", "_", 1) == F.col("_w"), "left_anti")
    order = Window.partitionBy("qid").orderBy(F.desc("freq"), "term")
    return t.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n_terms).select("qid", "place", "term", "freq")


def most_edits(length):
    return F.when(length <= 2, 0).when(length <= 4, 1).otherwise(2)


def corrections(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, suggestion, distance, jaccard) for words(word) that have at least two characters and aren't in vocabulary(pos, entry).

    A correction within d edits shares a deletion neighbourhood with the word, so the two sides meet by equal strings
    left after deleting up to two characters; pairs are then compared exactly.
    """
    unknown = words.select("word").distinct().where(F.length("word") >= 2).join(vocabulary.select(F.col("entry").alias("word")), "word", "left_anti")

    def deletions(df: DataFrame, col: str) -> DataFrame:
        drop = lambda s: F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))
        one = F.when(F.length(col) > 0, drop(F.col(col))).otherwise(F.array().cast("array<string>"))
        two = F.flatten(F.transform(one, lambda s: F.when(F.length(s) > 0, drop(s)).otherwise(F.array().cast("array<string>"))))
        return df.withColumn("key", F.explode(F.array_distinct(F.concat(F.array(F.col(col)), one, two))))

    pairs = deletions(unknown, "word").join(deletions(vocabulary.select("pos", "entry"), "entry"), "key").select("word", "pos", "entry").distinct()
    grams = jaccard(char_kgrams(F.col("word"), SPELL_K), char_kgrams(F.col("entry"), SPELL_K))
    scored = pairs.withColumns({"distance": F.levenshtein("word", "entry"), "jaccard": F.round(grams, 6)}).where((F.col("distance") <= most_edits(F.length("word"))) & (F.col("jaccard") >= LEAST_JACCARD))
    order = Window.partitionBy("word").orderBy("distance", F.desc("jaccard"), "pos")
    return scored.withColumn("n", F.row_number().over(order)).where("n = 1").select("word", F.col("entry").alias("suggestion"), "distance", "jaccard")


def correct_queries(queries: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(qid, corrected) of queries(qid, text) in which something changed; operators and quoted words stay."""
    tokens = queries.select("qid", F.posexplode(F.split(F.trim("text"), r"\s+")).alias("pos", "token"))
    keep = F.col("token").isin("AND", "OR", "NOT") | F.col("token").startswith('"')
    tokens = tokens.withColumn("word", F.when(~keep, F.lower("token")))
    fixed = tokens.join(corrections(tokens.where("word is not null").select("word"), vocabulary), "word", "left")
    said = F.struct("pos", F.coalesce("suggestion", "word", "token").alias("w"))
    out = fixed.groupBy("qid").agg(F.array_sort(F.collect_list(said)).alias("ws"), F.max(F.col("suggestion").isNotNull()).alias("changed"))
    return out.where("changed").select("qid", F.array_join(F.transform("ws", lambda x: x["w"]), " ").alias("corrected"))


def dictionary_vocabulary(entries: DataFrame, tokens=None) -> DataFrame:
    """(pos, entry): the distinct syllables of a dictionary's entries(line, entry), in order of first appearance; pos grows with it."""
    parts = tokens(F.col("entry")) if tokens else F.filter(F.split(F.lower(F.trim("entry")), r"[\s_]+"), lambda x: x != "")
    seen = entries.select("line", F.posexplode(parts).alias("place", "entry")).groupBy("entry").agg(F.min(F.struct("line", "place")).alias("pos"))
    return seen.select("pos", "entry")
