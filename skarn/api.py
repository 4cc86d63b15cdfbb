"""One search over a corpus: configuration, request, response."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.functions import text as X
from skarn.operators import expansion, index
from skarn.operators import ranking as R
from skarn.plans import query as Q

TRUE = frozenset(("1", "true", "yes", "on"))


def as_bool(value: str | None) -> bool:
    return (value or "").strip().lower() in TRUE


@dataclass(frozen=True)
class EngineConfig:
    rrf_k: int = 60
    candidate_pool: int = 100
    rerank_top_k: int = 30
    pagerank_weight: float = 0.0
    dedup_collapse: bool = False
    expand_synonyms: bool = False
    synonyms_max: int = 4
    expand_prf: bool = False
    prf_docs: int = 5
    prf_terms: int = 8
    expansion_weight: float = 0.5
    filters_on_candidates: bool = False
    pagerank_damping: float = 0.85
    dedup_k: int = 5
    dedup_hashes: int = 128
    dedup_bands: int = 32
    dedup_threshold: float = 0.8
    embed_dims: int = 768
    facet_fields: tuple[str, ...] = ("category", "doc_type", "subdomain")
    facet_size: int = 20


@dataclass(frozen=True)
class Response:
    """results(rank, doc_id, score, score_type, url, doc_type, subdomain where known, title, snippet); facets(field, place, key, count); total counts all matches."""

    results: DataFrame
    facets: DataFrame | None
    total: int
    page: int
    size: int
    ranker: str
    score_type: str
    suggestion: str | None = None
    applied_filters: dict[str, str] = field(default_factory=dict)

    @property
    def total_pages(self) -> int:
        return max(1, -(-self.total // self.size))


@dataclass(frozen=True)
class SearchEngine:
    """docs has doc_id, text and any of url, doc_type, subdomain, facet columns, pagerank, anchor_text and dup_group; vectors has doc_id and v.

    segment (Column -> Column of words with compounds joined) is applied to titles, contents, anchors, queries, synonyms and what is
    embedded alike; without it, words are runs of letters and digits. ``stored`` writes the indexes to a folder of the shared file system once, for
    every search to read; without it, each search scans the documents.
    """

    docs: DataFrame
    config: EngineConfig = EngineConfig()
    vectors: DataFrame | None = None
    embed_query: Callable[[str], list[float]] | None = None
    synonym_groups: DataFrame | None = None
    stopwords: DataFrame | None = None
    vocabulary: DataFrame | None = None
    segment: Callable[[Column], Column] | None = None
    indexes: tuple[index.Index, index.Index] | None = None

    def stored(self, path: str) -> SearchEngine:
        """The engine with its indexes written below path, once."""
        made = self._indexes()
        return replace(self, indexes=(index.store(made[0], f"{path}/words"), index.store(made[1], f"{path}/folded")))

    def _indexes(self) -> tuple[index.Index, index.Index]:
        if self.indexes is not None:
            return self.indexes
        words = index.build(self.docs, index.segmented_fields(self.segment) if self.segment else index.SEGMENTED)
        if "anchor_text" in self.docs.columns:
            words = index.with_anchors(words, self.docs.select("doc_id", "anchor_text"), self._tokens)
        return words, index.build(self.docs, index.FOLDED)

    def _tokens(self, text: Column) -> Column:
        return F.filter(F.split(self.segment(text), " "), lambda x: x != "") if self.segment else X.word_tokens(text)

    def _terms(self, words: list[str]) -> DataFrame:
        return self.docs.sparkSession.createDataFrame([(0, i, w) for i, w in enumerate(words)], "qid long, off int, term string")

    def _words(self, text: str, tokens=None) -> list[str]:
        return self.docs.sparkSession.createDataFrame([(text,)], "t string").select((tokens or self._tokens)(F.col("t"))).first()[0]

    def keyword_scores(self, q: str, by: str, prf: bool = True) -> DataFrame:
        """(qid, doc_id, score) of a simple or structured query with what the configuration adds."""
        c, (seg, plain) = self.config, self._indexes()
        boosts = {"title": Q.TITLE, "content": Q.CONTENT, "anchor": Q.ANCHOR}
        structured = Q.is_structured(q)
        if structured:
            scores = Q.compile_tree(Q.parse(q, self._words), seg, by).select(F.lit(0).cast("long").alias("qid"), "doc_id", "score")
        else:
            if not q.strip():
                raise Q.QueryError("the query is blank")
            words, folded = self._words(q), self._words(q, X.folded_tokens)
            scores = Q.simple_search(seg, plain, self._terms(words), self._terms(folded), by)
        extra: list[str] = []
        if c.expand_synonyms and self.synonym_groups is not None and not structured:
            asked = self.docs.sparkSession.createDataFrame([(0, q)], "qid long, text string")
            for r in expansion.synonyms(asked, self.synonym_groups, c.synonyms_max).orderBy("place").collect():
                extra += self._words(r.phrase)
        if c.expand_prf and prf:
            stop = self.stopwords if self.stopwords is not None else self.docs.sparkSession.createDataFrame([], "word string")
            first = R.top_k(scores, c.prf_docs).select("qid", "doc_id")
            found = expansion.rocchio_terms(seg, first, self._terms(self._words(q)), stop, c.prf_terms)
            extra += [r.term for r in found.orderBy("place").collect() if r.term not in extra]
        if extra:
            scores = R.add_bonus(scores, R.best_field(R.field_scores(seg, self._terms(list(dict.fromkeys(extra))), boosts, by)), c.expansion_weight)
        if c.pagerank_weight > 0 and "pagerank" in self.docs.columns:
            scores = R.pagerank_boost(scores, self.docs, c.pagerank_weight)
        return scores

    def suggestion(self, q: str) -> str | None:
        if self.vocabulary is None:
            return None
        asked = self.docs.sparkSession.createDataFrame([(0, q)], "qid long, text string")
        got = expansion.correct_queries(asked, self.vocabulary).first()
        return got.corrected if got else None

    def search(self, q: str | None, page: int = 1, size: int = 10, ranker: str | None = None, rerank: bool = False, filters: dict[str, str | None] | None = None) -> Response:
        """Keyword rankers (bm25, vsm, lm) page over all matches; vector, hybrid and reranked searches over a candidate pool, on which
        filters act only if the configuration says so. A blank query gives an empty first page."""
        c, page, size = self.config, max(1, page), max(1, size)
        name = (ranker or "bm25").strip().lower() or "bm25"
        by = "bm25" if name in ("vector", "hybrid") else R.ranker(name)
        wanted = {k: v for k, v in (filters or {}).items() if k in c.facet_fields and k in self.docs.columns and v and v.strip()}
        pool = max(10, c.candidate_pool)
        if not q or not q.strip():
            return Response(self._shown(self.docs.sparkSession.createDataFrame([], "qid long, rank int, doc_id long, score double"), "", by), None, 0, 1, 10, name, by)
        if name not in ("vector", "hybrid") and not rerank:
            scores = R.facet_filter(self.keyword_scores(q, by), self.docs, wanted)
            fields = [f for f in c.facet_fields if f in self.docs.columns]
            found = R.facets(scores, self.docs, fields, c.facet_size).drop("qid") if fields else None
            total = scores.count()
            if c.dedup_collapse and "dup_group" in self.docs.columns:
                scores = R.collapse(scores, self.docs.select("doc_id", "dup_group"))
            ranked = R.page(R.top_k(scores, page * size), page, size)
            return Response(self._shown(ranked, q, name), found, total, page, size, name, name, self.suggestion(q), wanted)
        kind = {"vector": "cosine", "hybrid": "rrf"}.get(name, name)
        ranked = self._candidates(q, name, by, pool)
        if c.filters_on_candidates:
            ranked = R.facet_filter(ranked, self.docs, wanted)
        if rerank:
            texts = ranked.join(self.docs.select("doc_id", X.rerank_text(X.title_of(F.col("text")), F.col("text")).alias("passage")), "doc_id")
            ranked = R.rerank(ranked, texts.select("qid", "doc_id", R.overlap_score(F.lit(q), F.col("passage")).alias("new_score")), c.rerank_top_k)
            name, kind = f"{name}+rerank", "cross-encoder"
        total = ranked.count()
        return Response(self._shown(R.page(ranked, page, size), q, kind), None, total, page, size, name, kind, self.suggestion(q), wanted if c.filters_on_candidates else {})

    def _candidates(self, q: str, name: str, by: str, pool: int) -> DataFrame:
        keyword = R.top_k(self.keyword_scores(q, by, prf=False), pool) if name != "vector" else None
        if name not in ("vector", "hybrid"):
            return keyword
        if self.vectors is None or self.embed_query is None:
            raise ValueError("vector search needs vectors and embed_query")
        # as the documents were before they were embedded: segmented, or else as they are
        said = (" ".join(self._words(q)) or " ".join(q.lower().split())) if self.segment else q
        asked = self.docs.sparkSession.createDataFrame([(None, [float(x) for x in self.embed_query(said)])], "qid long, q array<double>")
        near = R.knn(self.vectors.select("doc_id", "v"), asked.withColumn("qid", F.lit(-1).cast("long")), pool).select(F.lit(0).cast("long").alias("qid"), "rank", "doc_id", F.col("cosine").alias("score"))
        return near if name == "vector" else R.reciprocal_rank_fusion([keyword, near], self.config.rrf_k)

    def _shown(self, ranked: DataFrame, q: str, kind: str) -> DataFrame:
        word = (self._words(q, X.word_tokens) or [""])[0]
        more = [c for c in ("url", "doc_type", "subdomain") if c in self.docs.columns]
        shown = self.docs.select("doc_id", *more, X.title_of(F.col("text")).alias("title"), X.highlight(F.coalesce("text", F.lit("")), F.lit(word)).alias("snippet"))
        return ranked.join(shown, "doc_id").select("rank", "doc_id", "score", F.lit(kind).alias("score_type"), *more, "title", "snippet").orderBy("rank")
