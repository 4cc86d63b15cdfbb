"""Multinomial naive Bayes as plain aggregates, leave-one-out by subtraction, classification metrics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skarn.functions.runtime import cut, map_arrow, stage
from skarn.operators import matches
from skarn.operators.index import POSTING

#: So many words at most meet the texts where they are.
OFTEN = 100_000


@dataclass(frozen=True)
class NaiveBayes:
    """classes(label, class_pos, docs, tokens, n_docs, vocab) and words(label, term, n). Labels are few: tens."""

    classes: DataFrame
    words: DataFrame


def train(docs: DataFrame, tokens: Column, id_col: str = "doc_id", label: str = "label") -> NaiveBayes:
    """Blank labels are skipped; class_pos is the order in which classes first appear by id."""
    rows = docs.where(F.trim(F.col(label).cast("string")) != "").select(F.col(id_col).alias("id"), F.col(label).alias("label"), tokens.alias("t"))
    words = stage(rows.select("label", F.explode("t").alias("term")).groupBy("label", "term").agg(F.count("*").alias("n")))
    vocab = words.agg(F.count_distinct("term").alias("vocab"))
    sizes = words.groupBy("label").agg(F.sum("n").alias("tokens"))
    counts = rows.groupBy("label").agg(F.count("*").alias("docs"), F.min("id").alias("first"))
    classes = counts.join(sizes, "label", "left").join(vocab).na.fill(0, ["tokens"])
    every = Window.partitionBy(F.lit(0))
    classes = classes.withColumns({"n_docs": F.sum("docs").over(every), "class_pos": F.row_number().over(every.orderBy("first"))})
    return NaiveBayes(classes.drop("first"), words)


def predict(docs: DataFrame, tokens: Column, model: NaiveBayes, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, predicted, score): unseen words count too; ties go to the class seen first; documents without words get null.

    Per document and class the score is prior + sum of log(n + 1) - words * log(tokens + vocab), so only words that a class
    knows are joined.
    """
    rows = docs.select(F.col(id_col).alias("id"), tokens.alias("t"))
    # one scan counts each document's words; a word of its own, null, stands for the document
    per_row = rows.select(F.col("id").alias("doc_id"), F.lit("").alias("field"), F.size("t").cast("long").alias("dl"), F.col("t").alias("tokens"))
    counted = stage(map_arrow(per_row, matches.count_terms(None, lengths=True), POSTING.format(rows.schema["id"].dataType.simpleString())))
    bags = counted.where("term is not null").select(F.col("doc_id").alias("id"), "term", "tf")
    # the most frequent words, which are most of a text, are met where the text is; only the others are shuffled
    often = cut(model.words.groupBy("term").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "term").limit(OFTEN).select("term"))
    hot = cut(model.words.join(F.broadcast(often), "term"))
    met = bags.join(F.broadcast(hot), "term").select("id", "label", "tf", "n")
    rest = bags.join(F.broadcast(often), "term", "left_anti").join(model.words, "term").select("id", "label", "tf", "n")
    hit = F.sum(F.col("tf") * F.log(F.col("n") + 1.0)).alias("hit")
    known = met.groupBy("id", "label").agg(hit).union(rest.groupBy("id", "label").agg(hit)).groupBy("id", "label").agg(F.sum("hit").alias("hit"))
    every = counted.where("term is null").select(F.col("doc_id").alias("id"), F.col("dl").cast("int").alias("size")).join(F.broadcast(model.classes))
    scored = every.join(known, ["id", "label"], "left").select(
        "id", "label", "class_pos", "size",
        F.round(F.log(F.col("docs") / F.col("n_docs")) + F.coalesce("hit", F.lit(0.0)) - F.col("size") * F.log((F.col("tokens") + F.col("vocab")).cast("double")), 6).alias("score"),
    )
    best = scored.groupBy("id").agg(F.max(F.struct("score", (-F.col("class_pos")).alias("p"), "label", "size")).alias("b"))
    some = F.col("b.size") > 0
    return best.select(F.col("id").alias(id_col), F.when(some, F.col("b.label")).alias("predicted"), F.when(some, F.col("b.score")).alias("score"))


def leave_one_out(docs: DataFrame, tokens: Column, id_col: str = "doc_id", label: str = "label") -> DataFrame:
    """(doc_id, actual, predicted): each document predicted by a model of all others, in one job. A document's own counts are
    subtracted from its class; words that only it has leave the vocabulary."""
    rows = docs.where(F.trim(F.col(label).cast("string")) != "").select(F.col(id_col).alias("id"), F.col(label).alias("actual"), tokens.alias("t"))
    m = train(docs, tokens, id_col, label)
    bags = rows.select("id", "actual", F.explode("t").alias("term")).groupBy("id", "actual", "term").agg(F.count("*").alias("tf"))
    totals = m.words.groupBy("term").agg(F.sum("n").alias("all_n"))
    own = bags.join(totals, "term").groupBy("id").agg(F.count_if(F.col("all_n") == F.col("tf")).alias("only"))
    less = F.when(F.col("label") == F.col("actual"), F.col("tf")).otherwise(0)
    hit = bags.join(m.words, "term").groupBy("id", "label").agg(F.sum(F.col("tf") * F.log(F.col("n") - less + 1.0)).alias("hit"))
    is_own = F.col("label") == F.col("actual")
    every = rows.select("id", "actual", F.size("t").alias("size")).join(F.broadcast(m.classes)).join(own, "id", "left").join(hit, ["id", "label"], "left")
    n = F.col("docs") - is_own.cast("int")
    size = F.col("tokens") - F.when(is_own, F.col("size")).otherwise(0) + F.col("vocab") - F.coalesce("only", F.lit(0))
    score = F.log(n / (F.col("n_docs") - 1)) + F.coalesce("hit", F.lit(0.0)) - F.col("size") * F.log(size.cast("double"))
    scored = every.where(n > 0).select("id", "actual", "label", "class_pos", "size", F.round(score, 6).alias("score"))
    best = scored.groupBy("id", "actual").agg(F.max(F.struct("score", (-F.col("class_pos")).alias("p"), "label", "size")).alias("b"))
    return best.select(F.col("id").alias(id_col), "actual", F.when(F.col("b.size") > 0, F.col("b.label")).alias("predicted"))


def confusion(pairs: DataFrame) -> DataFrame:
    """(label, tp, fp, fn) of pairs(actual, predicted); a null prediction is only a miss."""
    each = F.when(F.col("actual").eqNullSafe(F.col("predicted")), F.array(F.struct(F.col("actual").alias("label"), F.lit("tp").alias("kind"))))
    each = each.otherwise(F.array(F.struct(F.col("actual").alias("label"), F.lit("fn").alias("kind")), F.struct(F.col("predicted").alias("label"), F.lit("fp").alias("kind"))))
    rows = pairs.select(F.explode(each).alias("e")).select("e.label", "e.kind").where("label is not null")
    return rows.groupBy("label").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("tp", "fp", "fn")))


def class_metrics(pairs: DataFrame) -> DataFrame:
    """(label, tp, fp, fn, precision, recall, f1)"""
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return confusion(pairs).withColumns({"precision": F.round(p, 6), "recall": F.round(r, 6), "f1": F.round(ratio(2 * p * r, p + r), 6)})


def summary(pairs: DataFrame) -> DataFrame:
    """(n, accuracy, macro_f1): macro over all labels seen in either column."""
    overall = pairs.agg(F.count("*").alias("n"), F.round(F.avg(F.col("actual").eqNullSafe(F.col("predicted")).cast("double")), 6).alias("accuracy"))
    return overall.join(class_metrics(pairs).agg(F.round(F.avg("f1"), 6).alias("macro_f1")))
