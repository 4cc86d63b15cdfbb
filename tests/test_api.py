import numpy as np
import pytest
from pyspark.sql import functions as F

from skarn.functions import text as X
from skarn.api import EngineConfig, SearchEngine, as_bool
from skarn.operators.models import embedder, hashed_vector
from skarn.plans.query import QueryError

ROWS = [(1, "red fox\nthe red fox runs", "a", 0.5, "g"), (2, "blue fox\nthe fox is blue", "b", 0.1, "g"), (3, "dog\nno such animal red", "a", 0.0, None)]


@pytest.fixture(scope="module")
def engine(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, category string, pagerank double, g string")
    docs = docs.withColumn("dup_group", F.when(F.col("g") == "g", F.lit(1).cast("long"))).drop("g")
    vectors = docs.select("doc_id", embedder(dims=16)(F.col("text")).alias("v"))
    vocabulary = spark.createDataFrame([(0, "red"), (1, "fox")], "pos int, entry string")
    return SearchEngine(docs, vectors=vectors, embed_query=lambda q: hashed_vector(q, 16).tolist(), vocabulary=vocabulary)


def test_keyword(engine):
    r = engine.search("red fox")
    assert r.total == 3 and [x.doc_id for x in r.results.collect()][0] == 1 and r.score_type == "bm25" and r.suggestion is None
    assert {(x.key, x["count"]) for x in r.facets.collect()} == {("a", 2), ("b", 1)}
    assert engine.search("red fox", filters={"category": "b", "nope": "x"}).total == 1
    assert engine.search("red foxx").suggestion == "red fox"
    assert engine.search("  ").results.count() == 0
    with pytest.raises(QueryError):
        engine.search('"open')
    with pytest.raises(ValueError):
        engine.search("red", ranker="nope")


def test_configured(engine):
    def with_config(**k):
        return SearchEngine(engine.docs, EngineConfig(**k), engine.vectors, engine.embed_query)

    assert with_config(dedup_collapse=True).search("fox").results.count() == 1
    plain, boosted = (with_config(pagerank_weight=w).search("fox").results.collect() for w in (0.0, 100.0))
    assert max(x.score for x in boosted) > max(x.score for x in plain)
    assert with_config(expand_prf=True).search("blue").total == 1


def test_candidates(engine):
    r = engine.search("red fox", ranker="hybrid", rerank=True)
    assert r.ranker == "hybrid+rerank" and r.score_type == "cross-encoder" and r.results.count() == 3
    top = engine.search(ROWS[1][1], ranker="vector").results.first()
    assert top.doc_id == 2 and top.score == pytest.approx(1.0, abs=1e-5)


def test_queries_are_embedded_as_documents_were(engine):
    said = []
    embed = lambda q: said.append(q) or hashed_vector(q, 16).tolist()
    for segment, q in ((None, "Red\n fox"), (X.segmenter(["red fox"]), "Red\n fox !"), (X.segmenter(["red fox"]), "!!  !")):
        asked = SearchEngine(engine.docs, vectors=engine.vectors, embed_query=embed, segment=segment)
        assert asked._candidates(q, "vector", "bm25", 10).count() == 3
    assert said == ["Red\n fox", "red_fox", "!! !"]


def test_models(spark):
    v = hashed_vector("x")
    assert v.shape == (768,) and np.linalg.norm(v) == pytest.approx(1) and (v == hashed_vector("x")).all()
    df = spark.createDataFrame([("a",), (None,)], "t string")
    assert df.select(embedder(lambda texts: 1 / 0)(F.col("t")).alias("v")).where("v is not null").count() == 0
    assert as_bool("Yes") and not as_bool(None)


def test_segmented_vietnamese_with_anchors_and_a_stored_index(spark, tmp_path):
    rows = [
        (1, "Đại học Bách khoa\nTrường đại học ở Hà Nội tuyển sinh", "https://a.vn/1", "html", "tuyển sinh"),
        (2, "Thư viện\nsinh viên học đại số ở thư viện", "https://a.vn/2", "html", " "),
        (3, "Tin tức\nlịch học của sinh viên", "https://b.vn/3", "pdf", "đại học"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, url string, doc_type string, anchor_text string")
    segment = X.segmenter(["đại học", "sinh viên", "thư viện", "tuyển sinh", "Hà Nội"], ["của", "ở"])
    engine = SearchEngine(docs, segment=segment)
    for e in (engine, engine.stored(str(tmp_path))):
        found = e.search("đại học").results.collect()
        # the compound is one word: 2 has "học đại" but no "đại học"; 1 and 3 are found by it, 2 only by its folded words
        assert [r.doc_id for r in found][:2] == [1, 3] and found[0].url == "https://a.vn/1"
        assert {r.doc_id for r in e.search('"đại học"').results.collect()} == {1}
        assert {r.doc_id for r in e.search('"sinh viên" AND NOT lịch').results.collect()} == {2}
        assert e.search("SINH  VIÊN").total >= 2
    assert engine.docs.select(segment(F.lit("Trường Đại học của Hà Nội, 2024!"))).first()[0] == "trường đại_học hà_nội 2024"
    assert docs.select(X.cleaned_segments(F.lit("Trường Đại_học , của !"), ["của"])).first()[0] == "trường đại_học"
