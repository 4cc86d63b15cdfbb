"""Operators on small known inputs; the registered queries against their SQL at sf0.001."""

import datetime as dt
import math
import unicodedata

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skarn.functions import text as X
from skarn.functions import urls as U
from skarn.functions.runtime import join_counted
from skarn.operators import classify, evaluation, expansion, graph, index, ingest, neardup, telemetry
from skarn.operators import ranking as R
from skarn.operators.components import connected_components
from skarn.plans import catalog, oracles
from skarn.plans import query as Q
from skarn.sources import files, html
from skarn.streaming import ingest as stream

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()[0]


def shown(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return repr(round(v, 9)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name not in oracles.ORACLES:
        assert len(got.columns) > 0
        return
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(oracles.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: sorted(tuple(map(shown, r)) for r in df[columns].itertuples(index=False))
    assert rows(got) == rows(want)


def test_text(spark):
    seg = X.segmenter(["đại học", "bách khoa", "thông tin", "tuyển sinh", "đào tạo"], ["của", "và"])
    assert one(spark, seg, "Trường Đại  học Bách khoa!") == "trường đại_học bách_khoa"
    assert one(spark, seg, "thông tin của tuyển sinh và đào tạo") == "thông_tin tuyển_sinh đào_tạo"
    assert one(spark, seg, None) == ""
    assert one(spark, lambda c: X.normalize(c, compose=True), unicodedata.normalize("NFD", "  Đại    Học ")) == "đại học"
    assert one(spark, X.fold, "Đại học Straße Øre Œuvre") == "dai hoc strasse ore oeuvre"
    assert one(spark, lambda c: X.shingles(X.whitespace_tokens(c), 3), "a b c d") == ["a b c", "b c d"]
    assert one(spark, lambda c: X.shingles(X.whitespace_tokens(c), 0), "a b") == ["a b"] and one(spark, lambda c: X.shingles(X.whitespace_tokens(c), 3), "") == []
    assert one(spark, lambda c: X.char_kgrams(c), "abca") == ["ab", "bc", "ca"] and one(spark, lambda c: X.char_kgrams(c), "a") == ["a"]
    assert one(spark, lambda c: X.jaccard(X.char_kgrams(c), X.char_kgrams(F.lit("abd"))), "abc") == pytest.approx(1 / 3)
    for raw, want in (("2026-03-01", dt.datetime(2026, 3, 1)), (" ", None), ("junk", None), (None, None), ("2026-03-01T10:00:00.123456Z", dt.datetime(2026, 3, 1, 10, 0, 0, 123456))):
        assert one(spark, X.lenient_timestamp, raw) == want
    assert one(spark, lambda c: X.snippet_around(c, F.lit("zebra")), "x " * 60 + "Zebra" + " y" * 100).startswith("...")


def test_urls(spark):
    assert one(spark, U.host, "https://A.Example.com:80/x") == "a.example.com" and one(spark, U.host, "no url") == ""
    assert one(spark, lambda c: U.in_scope(c, "example.com"), "http://www.example.com/") and not one(spark, lambda c: U.in_scope(c, "example.com"), "http://badexample.com/")
    assert one(spark, U.file_type, "http://x/a.DOCX?b=1") == "docx" and one(spark, U.file_type, "http://x/a.pdf#p") is None
    base = F.lit("http://h.example/a/b?q=1#f")
    for href, want in (("c", "http://h.example/a/c"), ("/c", "http://h.example/c"), ("?z", "http://h.example/a/b?z"), ("#z", "http://h.example/a/b?q=1#z"), ("//o/x", "http://o/x"), ("mailto:a", "mailto:a")):
        assert one(spark, lambda c: U.resolve(base, c), href) == want


@pytest.mark.parametrize("raw", ["", "  ", '"open', "a AND", "(a OR b", "a )", '"x"~abc', '""', "AND a", '"a"~99999999999'])
def test_query_errors(raw):
    with pytest.raises(Q.QueryError):
        Q.parse(raw)


def test_query_trees():
    seg = lambda s: s.lower().replace("thạc sĩ", "thạc_sĩ").split()
    assert Q.parse("tuyển sinh", seg) == Q.Terms(("tuyển", "sinh"))
    assert Q.parse('"tuyển sinh" AND thạc sĩ', seg) == Q.And((Q.Phrase(("tuyển", "sinh")), Q.Terms(("thạc_sĩ",))))
    assert Q.parse("(a or b) AND c", seg) == Q.And((Q.Or((Q.Terms(("a",)), Q.Terms(("b",)))), Q.Terms(("c",))))
    assert Q.parse("NOT thạc sĩ", seg) == Q.And((Q.Not(Q.Terms(("thạc",))), Q.Terms(("sĩ",))))
    assert Q.parse('"a b"~2', seg) == Q.Phrase(("a", "b"), 2)


def small_index(spark):
    return index.build(spark.createDataFrame([(1, "red fox\nthe red fox runs"), (2, "blue fox\nthe fox is blue"), (3, "dog\nno such animal red")], "doc_id long, text string"))


def test_boolean_search(spark):
    idx = small_index(spark)
    ids = lambda raw: sorted(r.doc_id for r in Q.compile_tree(Q.parse(raw), idx).collect())
    assert ids("red AND fox") == [1] and ids("red OR blue") == [1, 2, 3] and ids("fox AND NOT blue") == [1]
    assert ids("NOT fox AND NOT cat") == [3] and ids('"red fox"') == [1] and ids('"the fox"') == [2] and ids('"the fox"~1') == [1, 2]
    alone = Q.compile_tree(Q.parse("NOT fox"), idx).collect()
    assert [(r.doc_id, r.score) for r in alone] == [(3, 0.0)]


def test_ranker_names():
    assert R.ranker(" ") == "bm25" and R.ranker("LM") == "lm"
    with pytest.raises(ValueError):
        R.ranker("nope")


def ranked(spark, ids, qid=1):
    return spark.createDataFrame([(qid, d, i + 1, 1.0 / (i + 1)) for i, d in enumerate(ids)], "qid int, doc_id string, rank int, score double")


def test_fusion_and_rerank(spark):
    fused = R.reciprocal_rank_fusion([ranked(spark, "ABC"), ranked(spark, "ACD")]).orderBy("rank").collect()
    assert fused[0].doc_id == "A" and [r.doc_id for r in fused][1] == "C"
    assert R.reciprocal_rank_fusion([ranked(spark, "XY")], 1).where("doc_id = 'X'").first().score == 0.5
    new = spark.createDataFrame([(1, "A", 0.1), (1, "B", 0.9), (1, "C", 0.9)], "qid int, doc_id string, new_score double")
    assert [r.doc_id for r in R.rerank(ranked(spark, "ABCD"), new, 3).orderBy("rank").collect()] == list("BCAD")
    assert [r.doc_id for r in R.page(ranked(spark, "ABCD"), 0, 2).orderBy("rank").collect()] == ["A", "B"]


def test_metrics(spark):
    lists = ranked(spark, ["d1", "d2", "d3", "d4", "d5"]).withColumn("config", F.lit("x"))
    qrels = spark.createDataFrame([(1, "d1", 1), (1, "d3", 1), (1, "d5", 1), (2, "d1", 0)], "qid int, doc_id string, rel int")
    m = evaluation.per_query(lists, qrels, 3).first()
    assert m.p == pytest.approx(2 / 3, abs=1e-6) and m.r == pytest.approx(2 / 3, abs=1e-6) and m.rr == 1
    m = evaluation.per_query(lists, qrels, 5).first()
    assert m.p == 0.6 and m.ap == pytest.approx((1 + 2 / 3 + 3 / 5) / 3, abs=1e-6)
    values = spark.createDataFrame([("a", float(v)) for v in range(1, 21)], "path string, seconds double")
    assert evaluation.nearest_rank(values, ["path"], "seconds", 0.95).first().percentile == 19.0


def test_graph(spark):
    raw = spark.createDataFrame([("A", "B", "x"), ("A", "B", "x"), ("A", "B", " y "), ("A", "A", "z"), ("", "B", "q"), (None, "B", "q"), ("B", "C", None)], "src string, dst string, anchor string")
    clean = graph.clean_links(raw)
    assert sorted((r.src, r.dst, r.anchor) for r in clean.collect()) == [("A", "B", "x"), ("A", "B", "y"), ("B", "C", "")]
    assert graph.anchor_text(clean).collect()[0].anchor_text == "x y"
    nodes = spark.createDataFrame([("A",), ("B",), ("C",)], "id string")
    r = graph.pagerank(nodes, spark.createDataFrame([("A", "B"), ("A", "C"), ("B", "C")], "src string, dst string"))
    ranks = {x.id: x.pagerank for x in r.ranks.collect()}
    assert r.converged and sum(ranks.values()) == pytest.approx(1) and max(ranks, key=ranks.get) == "C"
    assert graph.pagerank(nodes.limit(0), clean.select("src", "dst")).converged
    assert {x.id: x.level for x in graph.bfs_levels(nodes.where("id = 'A'"), clean, 1).collect()} == {"A": 0, "B": 1}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (300, 200), (7, 7), (None, 5)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 200: 100, 300: 100}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_join_counted_takes_hot_keys_apart(spark):
    left = spark.createDataFrame([(i, i if i % 3 else -1) for i in range(4000)], "row long, k long")
    right = left.groupBy("k").agg(F.count("*").alias("n"), F.max("row").alias("top"))
    got, want = (sorted(df.select("row", "k", "top").collect()) for df in (join_counted(left, right, "k", "n", 4000), left.join(right, "k")))
    assert got == want and len(got) == 4000


def test_minhash(spark):
    a, b = neardup.coefficients(256, 7)
    x, y = [f"t{i}" for i in range(1, 101)], [f"t{i}" for i in range(50, 151)]
    same = (neardup.signature(x, a, b) == neardup.signature(y, a, b)).mean()
    assert abs(same - 51 / 150) < 0.1
    h = 0xCBF29CE484222325
    for c in "đa":
        h = (h ^ ord(c)) * 0x100000001B3 % 2**64
    assert neardup.fnv1a(["đa", ""]).tolist() == [h & (2**63 - 1), 0xCBF29CE484222325 & (2**63 - 1)]
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    docs = spark.createDataFrame([("doc_b", base), ("doc_a", base + " more"), ("doc_c", "nothing in common with the others at all really"), ("doc_d", "")], "doc_id string, text string")
    got = neardup.lsh_clusters(docs, X.whitespace_tokens(F.col("text")), k=3, threshold=0.6).collect()
    assert {(r.doc_id, r.canonical) for r in got} == {("doc_a", "doc_a"), ("doc_b", "doc_a")}


def test_naive_bayes(spark):
    rows = [(0, "con mèo con chó", "động vật"), (1, "con chim", "động vật"), (2, "ngôn ngữ java", "công nghệ"), (3, "ngôn ngữ lập trình", "công nghệ"), (4, "x", " ")]
    m = classify.train(spark.createDataFrame(rows, "doc_id int, text string, label string"), X.whitespace_tokens(F.col("text")))
    asked = spark.createDataFrame([(0, "con mèo"), (1, "ngôn ngữ python"), (2, "")], "doc_id int, text string")
    got = {r.doc_id: r.predicted for r in classify.predict(asked, X.whitespace_tokens(F.col("text")), m).collect()}
    assert got == {0: "động vật", 1: "công nghệ", 2: None}
    pairs = spark.createDataFrame(list(zip("aabb", "abbb")), "actual string, predicted string")
    b = classify.class_metrics(pairs).where("label = 'b'").first()
    assert (b.tp, b.fp, b.recall) == (2, 1, 1.0) and classify.summary(pairs).first().accuracy == 0.75


def test_spelling_and_synonyms(spark):
    vocab = spark.createDataFrame(list(enumerate(["tuyển", "sinh", "học", "tin"])), "pos int, entry string")
    fixed = expansion.correct_queries(spark.createDataFrame([(1, 'tuyen AND sih "x'), (2, "học tin")], "qid int, text string"), vocab)
    assert [(r.qid, r.corrected) for r in fixed.collect()] == [(1, 'tuyển AND sinh "x')]
    groups = spark.createDataFrame([(0, 0, "cntt"), (0, 1, "công nghệ thông tin"), (1, 0, "khác")], "group_id int, place int, phrase string")
    got = expansion.synonyms(spark.createDataFrame([(1, "điểm chuẩn CNTT")], "qid int, text string"), groups).collect()
    assert [(r.place, r.phrase) for r in got] == [(1, "công nghệ thông tin")]


def test_ingest(spark):
    stored = spark.createDataFrame([("a", "t", "1"), ("b", "t", "2")], "url string, title string, content_hash string")
    new = spark.createDataFrame([("a", "n", "1"), ("b", "n", "3"), ("c", "n", "4")], "url string, title string, content_hash string")
    assert {r.url: r.status for r in ingest.change_status(new, stored).collect()} == {"a": "unchanged", "b": "updated", "c": "new"}
    assert {r.url: r.title for r in ingest.upsert(new, stored).collect()} == {"a": "t", "b": "n", "c": "n"}
    urls = spark.createDataFrame([("h", "/x/1"), ("h", "/y"), ("o", "/x")], "host string, path string")
    rules = spark.createDataFrame([("h", "/x")], "host string, prefix string")
    assert ingest.allowed_by_robots(urls, rules).count() == 2
    assert one(spark, lambda c: ingest.better_fetch(c, F.lit("longer text")), "short") == "longer text"


def test_histogram(spark):
    req = spark.createDataFrame([("/s", 200, 0.25), ("/s", 200, 0.5)], "path string, status int, seconds double")
    h = {r.le: r.cumulative for r in telemetry.latency_histogram(req).collect()}
    assert (h[0.1], h[0.25], h[0.5], h[float("inf")]) == (0, 1, 2, 2)


def test_sources(spark, tmp_path):
    (tmp_path / "q").write_text("# c\n\n1 0 d1 2\n1 0 d1 1\n1 0 d2 x\n1 0\n")
    assert [(r.qid, r.doc_id, r.rel) for r in files.qrels(spark, str(tmp_path / "q")).collect()] == [("1", "d1", 1)]
    (tmp_path / "t").write_text("a\tb c\n#x\nbad\n")
    assert [tuple(r) for r in files.tsv(spark, str(tmp_path / "t"), ["label", "text"]).collect()] == [("a", "b c")]
    page = '<html><head><title> A  b </title><meta property="article:published_time" content="2026-01-02"></head><body><a href="x">go <b>on</b></a><a href="">no</a></body></html>'
    p = spark.createDataFrame([(1, "http://h/d/p", page)], "page_id int, url string, html string")
    assert [(r.link, r.anchor) for r in html.links(p).collect()] == [("http://h/d/x", "go on")]
    assert one(spark, html.title, page) == "A b" and one(spark, html.published, page) == "2026-01-02"


def test_streaming_upsert_equals_batch(spark, tmp_path):
    schema = "url string, title string, content string, content_hash string, crawled_at string, updated_at string"
    sink = stream.UpsertSink(f"file://{tmp_path}/table", schema)
    for day, rows in enumerate(([("a", "1"), ("b", "1")], [("a", "2"), ("c", "1"), ("c", "2")])):
        spark.createDataFrame([(u, f"t{h}", "c", h, f"{day}{h}", str(day)) for u, h in rows], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream.run_upserts(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), sink, f"{tmp_path}/cp")
    assert {r.url: r.content_hash for r in sink.current(spark).collect()} == {"a": "2", "b": "1", "c": "2"}


def test_streaming_rate_equals_batch(spark, tmp_path):
    rows = [(dt.datetime(2026, 1, 1, 0, m, s), "/s") for m in range(3) for s in (1, 20)] + [(dt.datetime(2026, 1, 1, 1, 0, 0), "/s")]
    df = spark.createDataFrame(rows, "ts timestamp, path string")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    q = stream.request_rate_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("rates").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {tuple(r) for r in spark.table("rates").collect()}
    want = {tuple(r) for r in telemetry.request_rate(df).collect()}
    assert got <= want and len(got) == 3
