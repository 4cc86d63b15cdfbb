"""The query language: text -> tree -> a DataFrame of scores.

or := and (OR and)*;  and := (terms | unary) ((AND | next to each other) ...)*;  unary := NOT one word or atom | atom;
atom := ( or ) | "phrase"~slop. Neighbouring words form one run, segmented together. NOT binds to a single word.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.operators import ranking as R
from skarn.operators.index import Index

TITLE, CONTENT, ANCHOR = 2.0, 1.0, 1.5
FOLDED_BOOST, PHRASE_TITLE, PHRASE_CONTENT = 0.8, 4.0, 2.0
INT_MAX = 2**31 - 1


class QueryError(ValueError):
    """The query can't be read."""


@dataclass(frozen=True)
class Terms:
    words: tuple[str, ...]


@dataclass(frozen=True)
class Phrase:
    words: tuple[str, ...]
    slop: int = 0


@dataclass(frozen=True)
class Not:
    part: object


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


def is_structured(raw: str) -> bool:
    return bool(re.search(r'["()]', raw)) or any(w in ("and", "or", "not") for w in raw.lower().split())


_TOKEN = re.compile(r'\s*(?:(?P<paren>[()])|"(?P<phrase>[^"]*)"(?P<tilde>~(?P<slop>\d*))?|(?P<open>")|(?P<word>[^\s()"]+))')


def tokenize(raw: str) -> list[tuple[str, object]]:
    out, at, raw = [], 0, raw.rstrip()
    while at < len(raw):
        m = _TOKEN.match(raw, at)
        at = m.end()
        if m["open"]:
            raise QueryError("a quotation mark isn't closed")
        if m["paren"]:
            out.append((m["paren"], None))
        elif m["phrase"] is not None:
            if not m["phrase"].strip():
                raise QueryError("a phrase is blank")
            if m["tilde"] and not m["slop"]:
                raise QueryError("~ needs digits")
            slop = int(m["slop"] or 0)
            if slop > INT_MAX:
                raise QueryError("the slop is too large")
            out.append(("phrase", (m["phrase"], slop)))
        elif m["word"].upper() in ("AND", "OR", "NOT"):
            out.append((m["word"].upper(), None))
        else:
            out.append(("word", m["word"]))
    return out


@dataclass
class _Parser:
    tokens: list[tuple[str, object]]
    segment: Callable[[str], list[str]]
    at: int = field(default=0)

    def kind(self) -> str | None:
        return self.tokens[self.at][0] if self.at < len(self.tokens) else None

    def take(self):
        self.at += 1
        return self.tokens[self.at - 1][1]

    def any_of(self):
        parts = [self.all_of()]
        while self.kind() == "OR":
            self.take()
            parts.append(self.all_of())
        return parts[0] if len(parts) == 1 else Or(tuple(parts))

    def all_of(self):
        parts = []
        while True:
            if self.kind() == "word":
                run = []
                while self.kind() == "word":
                    run.append(self.take())
                parts.append(self.terms(" ".join(run)))
            elif self.kind() in ("NOT", "(", "phrase"):
                parts.append(self.unary())
            else:
                raise QueryError("a term is missing")
            if self.kind() == "AND":
                self.take()
            elif self.kind() not in ("word", "NOT", "(", "phrase"):
                return parts[0] if len(parts) == 1 else And(tuple(parts))

    def unary(self):
        if self.kind() == "NOT":
            self.take()
            if self.kind() == "word":
                return Not(self.terms(self.take()))
            return Not(self.unary())
        if self.kind() == "(":
            self.take()
            inner = self.any_of()
            if self.kind() != ")":
                raise QueryError("a bracket isn't closed")
            self.take()
            return inner
        if self.kind() == "phrase":
            text, slop = self.take()
            return Phrase(self.terms(text).words, slop)
        raise QueryError("a term is missing")

    def terms(self, text: str) -> Terms:
        return Terms(tuple(self.segment(text)) or tuple(text.lower().split()))


def parse(raw: str, segment: Callable[[str], list[str]] = lambda s: re.findall(r"[^\W_]+", s.lower())):
    """The tree of a structured query, or the terms of a simple one."""
    if not raw or not raw.strip():
        raise QueryError("the query is blank")
    if not is_structured(raw):
        return Terms(tuple(segment(raw)) or tuple(raw.lower().split()))
    p = _Parser(tokenize(raw), segment)
    tree = p.any_of()
    if p.kind() is not None:
        raise QueryError("a bracket isn't opened")
    return tree


def _rows(spark: SparkSession, words: tuple[str, ...]) -> DataFrame:
    return spark.createDataFrame([(0, i, w) for i, w in enumerate(words)], "qid long, off int, term string")


def compile_tree(tree, index: Index, by: str = "bm25") -> DataFrame:
    """(doc_id, score) of the documents that match the tree.

    And adds the scores of its parts, Or those that match, Not removes documents; a Not that stands alone matches
    all other documents with score 0.
    """
    spark = index.fields.sparkSession
    boosts = {"title": TITLE, "content": CONTENT, "anchor": ANCHOR}
    if isinstance(tree, Terms):
        scores = R.best_field(R.field_scores(index, _rows(spark, tree.words), boosts, by, require_all=True))
        return scores.select("doc_id", "score")
    if isinstance(tree, Phrase):
        return R.phrase_scores(index, _rows(spark, tree.words), {"title": 1.0, "content": 1.0}, tree.slop).select("doc_id", "score")
    if isinstance(tree, Not):
        every = index.fields.select("doc_id").distinct()
        return every.join(compile_tree(tree.part, index, by), "doc_id", "left_anti").withColumn("score", F.lit(0.0))
    if isinstance(tree, Or):
        out = compile_tree(tree.parts[0], index, by)
        for p in tree.parts[1:]:
            out = out.unionByName(compile_tree(p, index, by))
        return out.groupBy("doc_id").agg(F.sum("score").alias("score"))
    if isinstance(tree, And):
        wanted = [p for p in tree.parts if not isinstance(p, Not)]
        out = compile_tree(wanted[0], index, by) if wanted else compile_tree(Not(tree.parts[0].part), index, by)
        for p in wanted[1:]:
            right = compile_tree(p, index, by).withColumnRenamed("score", "more")
            out = out.join(right, "doc_id").select("doc_id", (F.col("score") + F.col("more")).alias("score"))
        for p in tree.parts:
            if isinstance(p, Not) and (wanted or p is not tree.parts[0]):
                out = out.join(compile_tree(p.part, index, by), "doc_id", "left_anti")
        return out
    raise TypeError(f"no such node: {tree!r}")


def simple_search(segmented: Index, folded: Index, terms: DataFrame, folded_terms: DataFrame, by: str = "bm25") -> DataFrame:
    """(qid, doc_id, score) of simple queries: the sum of the segmented and folded best fields and the folded phrase
    (slop 1); one must match. terms and folded_terms have (qid, off, term)."""
    words, plain = R.search(segmented, terms, {"title": TITLE, "content": CONTENT, "anchor": ANCHOR}), R.search(folded, folded_terms, {"title_folded": 1.5, "content_folded": 1.0})
    tasks = max(words.tasks, plain.tasks)  # all three lists are dealt alike, so adding them moves nothing
    a, b = R.best_field(words.scores(by, tasks=tasks)), R.best_field(plain.scores(by, tasks=tasks)).withColumn("score", F.col("score") * FOLDED_BOOST)
    c = R.phrase_scores(folded, folded_terms, {"title_folded": PHRASE_TITLE, "content_folded": PHRASE_CONTENT}, 1, tasks)
    return R.add_scores(a, b, c)
