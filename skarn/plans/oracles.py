"""The registered queries in DuckDB SQL, written apart from the DataFrame code, for comparison."""

from __future__ import annotations

from skarn.operators.telemetry import BOUNDS
from skarn.plans.catalog import SYNONYMS

TITLE = "split_part(text, chr(10), 1)"
WORDS = "regexp_extract_all(lower({}), '[\\pL\\pM\\pN]+')"
FOLD = "strip_accents(replace(replace(replace(replace(replace(lower({}), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'), 'đ', 'd'), 'ø', 'o'))"
FOLDED = f"regexp_extract_all({FOLD}, '[a-z0-9]+')"


def fields_sql(a: str, b: str, tokens: str, p: str = "") -> str:
    """Common tables of an inverted index over two fields; names get the suffix p."""
    return f"""
{p}fields AS (SELECT doc_id, '{b}' AS field, {tokens.format("text")} AS toks FROM documents
  UNION ALL SELECT doc_id, '{a}', {tokens.format(TITLE)} FROM documents),
{p}fl AS (SELECT *, CAST(len(toks) AS BIGINT) AS dl FROM {p}fields WHERE len(toks) > 0),
{p}tok AS (SELECT doc_id, field, dl, unnest(toks) AS term, generate_subscripts(toks, 1) - 1 AS pos FROM {p}fl),
{p}post AS (SELECT field, term, doc_id, dl, count(*) AS tf FROM {p}tok GROUP BY ALL),
{p}fs AS (SELECT field, count(*) AS n_docs, CAST(sum(dl) AS BIGINT) AS total_tokens, avg(dl) AS avgdl FROM {p}fl GROUP BY field),
{p}ts AS (SELECT field, term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM {p}post GROUP BY ALL)"""


#: Compounds of two words and stopwords of the segmenter, on text in which every blank is doubled, so that neighbours share none.
SEGMENTED = (
    "trim(regexp_replace(regexp_replace(regexp_replace(' ' || replace(trim(regexp_replace(regexp_replace(lower({}), '[^\\pL\\d\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' ', '  ') || ' ',"
    " ' (in|of|to|on|for)  (the) ', ' \\1_\\2 ', 'g'), ' (a|and|et|und|y) ', ' ', 'g'), ' +', ' ', 'g'))"
)
ANCHORS = "SELECT doc_id, CASE WHEN quality = 1 THEN 'a good page ' || doc_id ELSE ' ' END AS anchor_text FROM labels"
BULK = "SELECT doc_id * 2 AS doc_id, 'new ' || doc_id AS lang, doc_id AS line, row_number() OVER (PARTITION BY doc_id ORDER BY doc_id DESC) AS n FROM labels WHERE doc_id % 7 <> 3"
SEG = fields_sql("title", "content", WORDS)
FOL = fields_sql("title_folded", "content_folded", FOLDED, "f")


def q_sql(n: int = 4, tokens: str = WORDS, p: str = "") -> str:
    return f""",
{p}q AS (SELECT item_id AS qid, unnest(list_slice({tokens.format("text")}, 1, {n})) AS term, generate_subscripts(list_slice({tokens.format("text")}, 1, {n}), 1) - 1 AS off FROM benchmark),
{p}qt AS (SELECT DISTINCT qid, term FROM {p}q)"""


BM25 = "ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))"
VSM = "sqrt(tf) * pow(ln((n_docs + 1) / (df + 1)) + 1, 2) / sqrt(dl)"
LM = "greatest(0, ln(1 + tf / (2000 * (cf + 1) / (total_tokens + 1))) + ln(2000 / (dl + 2000)))"


def scores_sql(expr: str = BM25, boosts: dict[str, float] | None = None, p: str = "", name: str = "fsc") -> str:
    boosts = boosts or {"title": 2.0, "content": 1.0}
    case = "CASE field " + " ".join(f"WHEN '{f}' THEN {b}" for f, b in boosts.items()) + " END"
    among = ", ".join(f"'{f}'" for f in boosts)
    return f""",
{name} AS (SELECT qid, doc_id, field, sum(({expr}) * {case}) AS score, count(*) AS matched
  FROM {p}qt JOIN {p}ts USING (term) JOIN {p}fs USING (field) JOIN {p}post USING (field, term) WHERE field IN ({among}) GROUP BY ALL)"""


def top_sql(source: str, k: int, extra: str = "") -> str:
    return f"""
SELECT qid, rank, doc_id, score FROM (
  SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM (SELECT qid, doc_id, round(score, 6) AS score FROM {source})) WHERE rank <= {k} {extra}"""


BEST = ", best AS (SELECT qid, doc_id, max(score) AS score FROM fsc GROUP BY ALL)"
KEYWORD = "WITH" + SEG + q_sql() + scores_sql() + BEST


def phrase_sql(boosts: dict[str, float], slop: int, p: str = "", name: str = "ph", q: str = "q") -> str:
    case = "CASE field " + " ".join(f"WHEN '{f}' THEN {b}" for f, b in boosts.items()) + " END"
    return f""",
{name}_at AS (SELECT qid, field, doc_id, dl, off, pos - off AS ap FROM {p}tok JOIN {q} USING (term)),
{name}_w AS (SELECT qid, field, doc_id, dl, off, ap, unnest(range(ap - {slop}, ap + 1)) AS start FROM {name}_at),
{name}_m AS (SELECT qid, field, doc_id, dl, start, off, min(ap) AS ap FROM {name}_w GROUP BY ALL),
{name}_f AS (SELECT qid, field, doc_id, dl, sum(1.0 / (1 + high - low)) AS freq FROM (
    SELECT qid, field, doc_id, dl, start, count(*) AS found, min(ap) AS low, max(ap) AS high FROM {name}_m GROUP BY ALL)
  JOIN (SELECT qid, count(*) AS needed FROM {q} GROUP BY qid) USING (qid) WHERE found = needed AND low = start GROUP BY ALL),
{name}_i AS (SELECT qid, field, sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5))) AS idf FROM {q} JOIN {p}ts USING (term) JOIN {p}fs USING (field) GROUP BY ALL),
{name} AS (SELECT qid, doc_id, sum(idf * freq * 2.2 / (freq + 1.2 * (0.25 + 0.75 * dl / avgdl)) * {case}) AS score
  FROM {name}_f JOIN {name}_i USING (qid, field) JOIN {p}fs USING (field) GROUP BY ALL)"""


def run_sql(word: str) -> str:
    """(doc_id, score) of one word: best field."""
    return f"(SELECT doc_id, max(({BM25}) * CASE field WHEN 'title' THEN 2.0 ELSE 1.0 END) AS score FROM post JOIN ts USING (field, term) JOIN fs USING (field) WHERE term = '{word}' GROUP BY doc_id)"


OVERLAP = "CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END"
SPLIT = "list_distinct(list_filter(regexp_split_to_array(lower({}), '\\s+'), lambda x: x <> ''))"
TEXTS = f"SELECT item_id AS qid, array_to_string(list_slice({WORDS.format('text')}, 1, 4), ' ') AS qtext FROM benchmark"

VEC = """
v AS (SELECT vec_id AS doc_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, label FROM embeddings),
pair AS (SELECT a.doc_id AS qid, b.doc_id, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6) AS cosine
  FROM v a JOIN v b ON a.doc_id % 50 = 0 AND a.doc_id <> b.doc_id),
knn AS (SELECT * FROM (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY cosine DESC, doc_id) AS INTEGER) AS rank, doc_id, cosine FROM pair) WHERE rank <= 10),
near AS (SELECT q.doc_id AS qid, CAST(row_number() OVER (PARTITION BY q.doc_id ORDER BY d.doc_id) AS INTEGER) AS rank, d.doc_id FROM v q JOIN v d ON q.doc_id % 50 = 0 AND d.doc_id BETWEEN q.doc_id + 1 AND q.doc_id + 10)"""


def rrf_sql(first: str, second: str) -> str:
    return f"""
SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, l, p, doc_id) AS INTEGER) AS rank, doc_id, score FROM (
  SELECT qid, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score, min(l) AS l, arg_min(rank, l) AS p FROM (
    SELECT qid, doc_id, rank, 0 AS l FROM {first} UNION ALL SELECT qid, doc_id, rank, 1 FROM {second}) GROUP BY qid, doc_id)"""


JUDGED = f"""WITH {VEC},
qrels AS (SELECT q.doc_id AS qid, d.doc_id, CASE WHEN d.doc_id % 3 = 0 THEN 2 ELSE 1 END AS rel FROM v q JOIN v d ON q.doc_id % 50 = 0 AND q.label = d.label AND q.doc_id <> d.doc_id),
lists AS (SELECT 'vector' AS config, qid, rank, doc_id FROM knn UNION ALL SELECT 'near_id', qid, rank, doc_id FROM near),
ideal AS (SELECT qid, count(*) AS relevant, sum(CASE WHEN n <= 10 THEN (pow(2, rel) - 1) / log2(n + 1) ELSE 0 END) AS idcg
  FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rel DESC) AS n FROM qrels) GROUP BY qid),
hits AS (SELECT config, qid, rank, coalesce(rel, 0) AS rel, sum(CASE WHEN rel > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY config, qid ORDER BY rank) AS found
  FROM lists LEFT JOIN qrels USING (qid, doc_id) WHERE rank <= 10),
raw AS (SELECT config, qid, count(*) FILTER (rel > 0) / 10 AS p, count(*) FILTER (rel > 0) / any_value(relevant) AS r,
    sum(CASE WHEN rel > 0 THEN found / rank ELSE 0 END) / any_value(relevant) AS ap, coalesce(1 / min(rank) FILTER (rel > 0), 0) AS rr,
    sum((pow(2, rel) - 1) / log2(rank + 1)) / any_value(idcg) AS ndcg FROM hits JOIN ideal USING (qid) GROUP BY config, qid),
per AS (SELECT config, qid, round(p, 6) AS p, round(r, 6) AS r, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1, round(ap, 6) AS ap, round(rr, 6) AS rr, round(ndcg, 6) AS ndcg FROM raw)
"""

LINKS = """WITH raw AS (SELECT CAST(l_partkey AS VARCHAR) AS src,
    CAST(lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS VARCHAR) AS dst, 'part ' || l_linenumber AS anchor
  FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 40),
links AS (SELECT DISTINCT src, dst, anchor FROM raw WHERE dst IS NOT NULL AND src <> dst),
nodes AS (SELECT CAST(p_partkey AS VARCHAR) AS id FROM part),
e AS (SELECT DISTINCT src, dst FROM links WHERE src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes))"""


def pagerank_sql(rounds: int) -> str:
    steps = [", deg AS (SELECT src, count(*) AS deg FROM e GROUP BY src), n AS (SELECT count(*) AS n FROM nodes), r0 AS (SELECT id, 1.0::DOUBLE / n AS pr FROM nodes, n)"]
    for i in range(rounds):
        steps.append(f"""
, m{i} AS (SELECT coalesce(sum(pr), 0) AS mass FROM r{i} WHERE id NOT IN (SELECT src FROM deg))
, r{i + 1} AS (SELECT id, 0.15::DOUBLE / n + 0.85::DOUBLE * (coalesce(given, 0) + mass / n) AS pr FROM nodes CROSS JOIN n CROSS JOIN m{i}
  LEFT JOIN (SELECT dst, sum(pr / deg) AS given FROM e JOIN deg USING (src) JOIN r{i} ON e.src = r{i}.id GROUP BY dst) g ON g.dst = nodes.id)""")
    return LINKS + "".join(steps) + f" SELECT id, round(pr, 9) AS pagerank FROM r{rounds}"


LABELLED = f"""WITH d AS (SELECT doc_id, {WORDS.format('text')} AS toks, CAST(quality AS VARCHAR) AS label FROM documents JOIN labels USING (doc_id)),
w AS (SELECT label, term, count(*) AS n FROM (SELECT label, unnest(toks) AS term FROM d) GROUP BY ALL),
c AS (SELECT label, count(*) AS docs, min(doc_id) AS first, CAST(sum(len(toks)) AS BIGINT) AS tokens FROM d GROUP BY label),
v AS (SELECT count(DISTINCT term) AS vocab FROM w), t AS (SELECT sum(docs) AS n_docs FROM c)"""

PAIRS = """WITH p AS (SELECT CAST(quality AS VARCHAR) AS actual, CASE WHEN doc_id % 7 <> 0 THEN CAST(CAST(doc_id % 5 > 0 AS INTEGER) AS VARCHAR) END AS predicted FROM labels),
l AS (SELECT actual AS label FROM p UNION SELECT predicted FROM p WHERE predicted IS NOT NULL),
k AS (SELECT label, count(*) FILTER (actual = label AND predicted = label) AS tp, count(*) FILTER (actual <> label AND predicted = label) AS fp,
  count(*) FILTER (actual = label AND predicted IS DISTINCT FROM label) AS fn FROM l, p GROUP BY label),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM k),
m AS (SELECT label, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM r)"""

GRAMS = "(CASE WHEN length({0}) < 2 THEN [{0}] ELSE list_distinct(list_transform(range(1, length({0})), lambda i: substring({0}, i, 2))) END)"
JAC = "len(list_intersect({0}, {1})) / len(list_distinct(list_concat({0}, {1})))".format(GRAMS.format("{0}"), GRAMS.format("{1}"))
HOST = r"lower(regexp_extract(url, '^[^:/?#]+://([^/?#:]*)', 1))"
PAGE_TITLE = r"trim(regexp_replace(regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g'))"
PAGE_BODY = r"trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<title\b[^>]*>.*?</title>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"
SNAPSHOTS = f"""WITH stored AS (SELECT 'doc:' || doc_id AS url, {TITLE} AS title, sha256(text) AS content_hash, n_chars AS updated_at FROM documents WHERE doc_id % 3 <> 0),
body AS (SELECT doc_id, n_chars, CASE WHEN doc_id % 5 = 0 THEN text || ' more' ELSE text END AS text FROM documents WHERE doc_id % 4 <> 0),
new AS (SELECT 'doc:' || doc_id AS url, {TITLE} AS title, sha256(text) AS content_hash, n_chars AS updated_at FROM body),
st AS (SELECT n.url, CASE WHEN s.url IS NULL THEN 'new' WHEN s.content_hash = n.content_hash THEN 'unchanged' ELSE 'updated' END AS status FROM new n LEFT JOIN stored s USING (url))"""
REQ = """WITH req AS (SELECT event_type AS path, CASE WHEN event_id % 20 = 0 THEN 500 WHEN event_id % 10 = 0 THEN 404 ELSE 200 END AS status, value / 100 AS seconds, ts FROM events)"""
HIST = REQ + ", bounds(le) AS (VALUES " + ", ".join(f"({b}::DOUBLE)" for b in BOUNDS) + """, ('inf'::DOUBLE)),
h AS (SELECT path, le, count(*) FILTER (seconds <= le) AS cumulative, round(sum(seconds), 6) AS sum_seconds, count(seconds) AS n FROM req, bounds GROUP BY path, le)"""


def facets_sql(source: str, fields: list[str]) -> str:
    union = " UNION ALL ".join(f"SELECT qid, '{f}' AS field, {f} AS key FROM {source} JOIN documents USING (doc_id)" for f in fields)
    return f""" SELECT qid, field, place, key, count FROM (SELECT qid, field, key, count, CAST(row_number() OVER (PARTITION BY qid, field ORDER BY count DESC, key) AS INTEGER) AS place FROM (
  SELECT qid, field, key, count(*) AS count FROM ({union}) WHERE trim(key) <> '' GROUP BY ALL)) WHERE place <= 20"""


ROCCHIO = KEYWORD + f""", top5 AS ({top_sql("best", 5)}),
rt AS (SELECT qid, place, term, freq FROM (SELECT qid, term, freq, CAST(row_number() OVER (PARTITION BY qid ORDER BY freq DESC, term) AS INTEGER) AS place FROM (
  SELECT qid, term, count(*) AS freq FROM top5 JOIN tok USING (doc_id) WHERE field = 'content' AND length(term) >= 2 AND term NOT IN ('the', 'of', 'and', 'de')
    AND NOT EXISTS (SELECT 1 FROM q WHERE q.qid = top5.qid AND q.term = tok.term) GROUP BY ALL)) WHERE place <= 8)"""

ORACLES = {
    "postings_tf": "WITH" + SEG + " SELECT field, term, doc_id, tf, dl FROM post",
    "term_stats": "WITH" + SEG + " SELECT field, term, df, cf FROM ts",
    "field_stats": "WITH" + SEG + " SELECT field, n_docs, total_tokens, round(avgdl, 6) AS avgdl FROM fs",
    "bm25_topk": "WITH" + SEG + q_sql() + scores_sql(BM25, {"content": 1.0}) + BEST + top_sql("best", 10),
    "vsm_topk": "WITH" + SEG + q_sql() + scores_sql(VSM, {"content": 1.0}) + BEST + top_sql("best", 10),
    "lm_topk": "WITH" + SEG + q_sql() + scores_sql(LM, {"content": 1.0}) + BEST + top_sql("best", 10),
    "multifield_dismax": KEYWORD + top_sql("best", 10),
    "legacy_bm25_sum": KEYWORD + ", total AS (SELECT qid, doc_id, sum(score) AS score FROM fsc GROUP BY ALL)" + top_sql("total", 10),
    "boolean_and": "WITH" + SEG + f" SELECT doc_id, round(a.score + b.score, 6) AS score FROM {run_sql('ering')} a JOIN {run_sql('thtion')} b USING (doc_id)",
    "boolean_or": "WITH" + SEG + f" SELECT doc_id, round(sum(score), 6) AS score FROM (SELECT * FROM {run_sql('worthless')} UNION ALL SELECT * FROM {run_sql('thtion')}"
    + " UNION ALL SELECT doc_id, max(score) FROM (SELECT doc_id, field, sum((" + BM25 + ") * CASE field WHEN 'title' THEN 2.0 ELSE 1.0 END) AS score FROM post JOIN ts USING (field, term) JOIN fs USING (field) WHERE term = 'ciónrr' GROUP BY ALL) GROUP BY doc_id) GROUP BY doc_id",
    "boolean_not": "WITH" + SEG + f" SELECT doc_id, round(score, 6) AS score FROM {run_sql('the')} WHERE doc_id NOT IN (SELECT doc_id FROM post WHERE term = 'ering')",
    "boolean_group": "WITH" + SEG + ", q AS (SELECT 0 AS qid, 'the' AS term, 0 AS off)" + phrase_sql({"title": 1.0, "content": 1.0}, 0)
    + f" SELECT doc_id, round(a.score + ph.score, 6) AS score FROM (SELECT doc_id, sum(score) AS score FROM (SELECT * FROM {run_sql('idiot')} UNION ALL SELECT * FROM {run_sql('clown')}) GROUP BY doc_id) a JOIN ph USING (doc_id)",
    "phrase_match": "WITH" + SEG + q_sql(3) + phrase_sql({"title": 1.0, "content": 1.0}, 0) + top_sql("ph", 10),
    "proximity_match": "WITH" + SEG + q_sql(2) + phrase_sql({"title": 1.0, "content": 1.0}, 3) + " SELECT qid, field, doc_id, round(freq, 6) AS freq FROM ph_f",
    "simple_three_branch": "WITH" + SEG + "," + FOL + q_sql() + q_sql(4, FOLDED, "f") + scores_sql() + scores_sql(BM25, {"title_folded": 1.5, "content_folded": 1.0}, "f", "ffsc") + BEST
    + phrase_sql({"title_folded": 4.0, "content_folded": 2.0}, 1, "f", "ph", "fq")
    + ", every AS (SELECT qid, doc_id, sum(score) AS score FROM (SELECT qid, doc_id, score FROM best UNION ALL SELECT qid, doc_id, 0.8 * max(score) FROM ffsc GROUP BY ALL UNION ALL SELECT qid, doc_id, score FROM ph) GROUP BY ALL)"
    + top_sql("every", 10),
    "facet_counts": KEYWORD + facets_sql("best", ["lang", "source"]),
    "filtered_search": KEYWORD + top_sql("best JOIN documents USING (doc_id) WHERE lang = 'de'", 10),
    "filtered_facets": KEYWORD + ", fr AS (SELECT qid, doc_id FROM best JOIN documents USING (doc_id) WHERE lang = 'fr')" + facets_sql("fr", ["source"]),
    "paged_results": KEYWORD + top_sql("best", 20, "AND rank > 10"),
    "collapse_dup_group": KEYWORD + """, g AS (SELECT qid, doc_id, round(score, 6) AS score, min(doc_id) OVER (PARTITION BY text, qid) AS x, text FROM best JOIN documents USING (doc_id)),
one AS (SELECT qid, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid, text ORDER BY score DESC, doc_id) AS n FROM g) WHERE n = 1)""" + top_sql("one", 10),
    "pagerank_boost": KEYWORD + ", b AS (SELECT qid, doc_id, score + ln(1 + 100.0 * (1.0 / (1 + n_chars))) AS score FROM best JOIN documents USING (doc_id))" + top_sql("b", 10),
    "snippet_legacy": """WITH p AS (SELECT doc_id, text, instr(lower(text), 'worthless') AS ap FROM documents), r AS (SELECT *, greatest(ap - 60, 1) AS f, least(ap + 140, length(text)) AS l FROM p)
SELECT doc_id, CASE WHEN ap > 0 THEN CASE WHEN f > 1 THEN '...' ELSE '' END || substring(text, f, l - f + 1) || CASE WHEN l < length(text) THEN '...' ELSE '' END ELSE substring(text, 1, 200) END AS snippet FROM r""",
    "snippet_highlight": """WITH p AS (SELECT doc_id, text, instr(lower(text), 'worthless') AS ap FROM documents), r AS (SELECT *, substring(text, ap, 180) AS f FROM p)
SELECT doc_id, replace(CASE WHEN ap > 0 THEN '<em>' || substring(f, 1, 9) || '</em>' || substring(f, 10, 180) ELSE substring(text, 1, 180) || '…' END, '_', ' ') AS snippet FROM r""",
    "knn_exact": f"WITH {VEC} SELECT qid, rank, doc_id, cosine, round((1 + cosine) / 2, 7) AS score FROM knn",
    "rrf_fusion": f"WITH {VEC}" + rrf_sql("near", "knn"),
    "hybrid_search": KEYWORD + f""", tk AS ({top_sql("best", 100)}),
v AS (SELECT vec_id AS doc_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
vs AS (SELECT * FROM (SELECT a.doc_id AS qid, CAST(row_number() OVER (PARTITION BY a.doc_id ORDER BY round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6) DESC, b.doc_id) AS INTEGER) AS rank, b.doc_id
  FROM v a JOIN v b ON a.doc_id <> b.doc_id WHERE a.doc_id IN (SELECT item_id FROM benchmark)) WHERE rank <= 100)
SELECT * FROM ({rrf_sql("tk", "vs")}) WHERE rank <= 10""",
    "rerank_fake": KEYWORD + f""", tx AS ({TEXTS}), l1 AS ({top_sql("best", 100)}),
nw AS (SELECT qid, doc_id, rank AS old, l1.score, CASE WHEN rank <= 30 THEN round({OVERLAP}, 6) END AS new FROM l1
  JOIN (SELECT doc_id, {SPLIT.format(f"substring({TITLE} || '. ' || text, 1, 2000)")} AS b FROM documents) USING (doc_id) JOIN (SELECT qid, {SPLIT.format('qtext')} AS a FROM tx) USING (qid))
SELECT qid, rank, doc_id, score FROM (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY new IS NULL, new DESC, old) AS INTEGER) AS rank, doc_id, coalesce(new, score) AS score FROM nw) WHERE rank <= 40""",
    "ir_metrics_per_query": JUDGED + "SELECT config, qid, p, r, f1, ap, rr, ndcg FROM per",
    "ir_metrics_mean": JUDGED + "SELECT config, count(*) AS queries, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in ("p", "r", "f1", "ap", "rr", "ndcg")) + " FROM per GROUP BY config",
    "pooling": JUDGED + "SELECT qid, doc_id, min(config) AS first_config FROM lists WHERE rank <= 5 GROUP BY ALL",
    "latency_p95": REQ + " SELECT path, min(seconds) FILTER (i >= ceil(0.95 * n)) AS percentile, any_value(n) AS n FROM (SELECT path, seconds, row_number() OVER (PARTITION BY path ORDER BY seconds) AS i, count(*) OVER (PARTITION BY path) AS n FROM req WHERE seconds IS NOT NULL) GROUP BY path",
    "link_clean": LINKS + " SELECT src, dst, anchor FROM links",
    "anchor_text": LINKS + " SELECT dst, substring(trim(string_agg(anchor, ' ' ORDER BY src, anchor)), 1, 2000) AS anchor_text FROM links WHERE anchor <> '' GROUP BY dst",
    "graph_degrees": LINKS + ", a AS (SELECT DISTINCT src, dst FROM links) SELECT id, coalesce(o, 0) AS out_degree, coalesce(i, 0) AS in_degree FROM nodes LEFT JOIN (SELECT src AS id, count(*) AS o FROM a GROUP BY src) USING (id) LEFT JOIN (SELECT dst AS id, count(*) AS i FROM a GROUP BY dst) USING (id)",
    "pagerank_k10": pagerank_sql(10),
    "bfs_levels": LINKS.replace("WITH raw", "WITH RECURSIVE raw") + """, a AS (SELECT DISTINCT src, dst FROM links),
walk AS (SELECT id, 0 AS level FROM nodes WHERE CAST(id AS BIGINT) % 10 = 0 UNION SELECT a.dst, level + 1 FROM walk JOIN a ON a.src = walk.id WHERE level < 3)
SELECT id, min(level) AS level FROM walk GROUP BY id""",
    "exact_duplicates": "SELECT doc_id, canonical, copies FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS canonical, count(*) OVER (PARTITION BY text) AS copies FROM documents) WHERE copies > 1",
    "shingle_jaccard_pairs": f"""WITH t AS (SELECT doc_id, {WORDS.format('text')} AS w FROM documents),
s AS (SELECT doc_id, list_sort(CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) ELSE [array_to_string(w, ' ')] END) AS s FROM t WHERE len(w) > 0),
d AS (SELECT min(doc_id) AS id, s, len(s) AS n FROM s GROUP BY s), x AS (SELECT id, n, unnest(s) AS g FROM d),
c AS (SELECT a.id AS a, b.id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM x a JOIN x b ON a.g = b.g AND a.id < b.id GROUP BY a.id, b.id)
SELECT a, b, round(k / (na + nb - k), 6) AS jaccard FROM c WHERE round(k / (na + nb - k), 6) >= 0.8""",
    "nb_train_counts": LABELLED + " SELECT label, term, n, docs, tokens, vocab FROM w JOIN c USING (label), v",
    "nb_predict": LABELLED + f""", x AS (SELECT doc_id, {WORDS.format('text')} AS toks FROM documents), b AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS term FROM x) GROUP BY ALL),
k AS (SELECT doc_id, label, sum(tf * ln(n + 1.0)) AS hit FROM b JOIN w USING (term) GROUP BY ALL),
s AS (SELECT doc_id, label, first, len(toks) AS size, round(ln(docs / n_docs) + coalesce(hit, 0) - len(toks) * ln(tokens + vocab), 6) AS score FROM x CROSS JOIN c CROSS JOIN v CROSS JOIN t LEFT JOIN k USING (doc_id, label))
SELECT doc_id, CASE WHEN size > 0 THEN label END AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, first) AS i FROM s) WHERE i = 1""",
    "nb_leave_one_out": LABELLED + """, b AS (SELECT doc_id, label AS actual, term, count(*) AS tf FROM (SELECT doc_id, label, unnest(toks) AS term FROM d) GROUP BY ALL),
tot AS (SELECT term, sum(n) AS all_n FROM w GROUP BY term), own AS (SELECT doc_id, count(*) FILTER (all_n = tf) AS own_only FROM b JOIN tot USING (term) GROUP BY doc_id),
k AS (SELECT doc_id, w.label, sum(tf * ln(n - CASE WHEN w.label = actual THEN tf ELSE 0 END + 1.0)) AS hit FROM b JOIN w USING (term) GROUP BY ALL),
s AS (SELECT d.doc_id, d.label AS actual, c.label, first, len(toks) AS size, docs - CASE WHEN c.label = d.label THEN 1 ELSE 0 END AS nd,
  round(ln((docs - CASE WHEN c.label = d.label THEN 1 ELSE 0 END) / (n_docs - 1)) + coalesce(hit, 0) - len(toks) * ln(tokens - CASE WHEN c.label = d.label THEN len(toks) ELSE 0 END + vocab - coalesce(own_only, 0)), 6) AS score
  FROM d CROSS JOIN c CROSS JOIN v CROSS JOIN t LEFT JOIN own USING (doc_id) LEFT JOIN k ON k.doc_id = d.doc_id AND k.label = c.label WHERE docs - CASE WHEN c.label = d.label THEN 1 ELSE 0 END > 0)
SELECT doc_id, actual, CASE WHEN size > 0 THEN label END AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, first) AS i FROM s) WHERE i = 1""",
    "classifier_metrics": PAIRS + " SELECT label, tp, fp, fn, precision, recall, f1 FROM m",
    "classifier_summary": PAIRS + " SELECT (SELECT count(*) FROM p) AS n, (SELECT round(avg(CASE WHEN actual IS NOT DISTINCT FROM predicted THEN 1.0 ELSE 0 END), 6) FROM p) AS accuracy, round(avg(f1), 6) AS macro_f1 FROM m",
    "category_distribution": "SELECT quality, count(*) AS documents FROM labels GROUP BY quality",
    "rocchio_terms": ROCCHIO + " SELECT qid, place, term, freq FROM rt",
    "expanded_search": ROCCHIO + scores_sql(name="unused") .replace("FROM qt JOIN", "FROM (SELECT DISTINCT qid, term FROM rt) JOIN")
    + ", bonus AS (SELECT qid, doc_id, max(score) AS more FROM unused GROUP BY ALL), s AS (SELECT qid, doc_id, score + 0.5 * coalesce(more, 0) AS score FROM best LEFT JOIN bonus USING (qid, doc_id))" + top_sql("s", 10),
    "synonym_expand": f"""WITH tx AS ({TEXTS}), g(group_id, place, phrase) AS (VALUES {", ".join(map(str, SYNONYMS))}),
h AS (SELECT qid, group_id, place, phrase, contains(' ' || lower(qtext) || ' ', ' ' || phrase || ' ') AS inside FROM tx, g),
f AS (SELECT qid, phrase, min(group_id * 1000 + place) AS ap FROM h WHERE NOT inside AND EXISTS (SELECT 1 FROM h o WHERE o.qid = h.qid AND o.group_id = h.group_id AND o.inside) GROUP BY ALL)
SELECT qid, place, phrase FROM (SELECT qid, phrase, CAST(row_number() OVER (PARTITION BY qid ORDER BY ap) AS INTEGER) AS place FROM f) WHERE place <= 4""",
    "normalize_text": f"SELECT doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS normalized, {FOLD.format('text')} AS folded FROM documents",
    "shingle_counts": f"WITH t AS (SELECT doc_id, {WORDS.format('text')} AS w FROM documents) SELECT doc_id, CAST(CASE WHEN len(w) >= 5 THEN len(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')))) WHEN len(w) > 0 THEN 1 ELSE 0 END AS BIGINT) AS shingles FROM t",
    "kgram_similarity": f"WITH w AS (SELECT {FOLDED.format('text')} AS w FROM documents), t AS (SELECT DISTINCT a, b FROM (SELECT unnest(list_slice(w, 1, len(w) - 1)) AS a, unnest(list_slice(w, 2, len(w))) AS b FROM w WHERE len(w) > 1)) SELECT a, b, round({JAC.format('a', 'b')}, 6) AS similarity, CAST(levenshtein(a, b) AS INTEGER) AS distance FROM t",
    "url_parts": f"SELECT page_id, {HOST} AS host, split_part(url, '#', 1) AS bare, coalesce(starts_with(url, 'http') AND ({HOST} = 'example.com' OR ends_with({HOST}, '.example.com')), false) AS in_scope, CASE WHEN contains(split_part(url, '#', 1), '?') THEN NULL ELSE 'pdf' END AS file_type, sha256(url) AS id FROM pages",
    "page_titles": f"SELECT page_id, {PAGE_TITLE} AS title, {PAGE_BODY} AS body, CAST(NULL AS VARCHAR) AS published FROM pages",
    "page_links": r"""WITH l AS (SELECT page_id, url, unnest(tags) AS tag, generate_subscripts(tags, 1) - 1 AS place FROM (SELECT page_id, url, regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref\s*=\s*"[^"]*"[^>]*>.*?</a>') AS tags FROM pages)),
h AS (SELECT page_id, url, place, trim(regexp_extract(tag, '(?is)href\s*=\s*"([^"]*)"', 1)) AS href, trim(regexp_replace(regexp_replace(regexp_extract(tag, '(?is)^<a[^>]*>(.*)</a>$', 1), '(?s)<[^>]*>', '', 'g'), '\s+', ' ', 'g')) AS anchor FROM l)
SELECT page_id, CAST(place AS BIGINT) AS place, href, CASE WHEN starts_with(href, '/') THEN regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1) || href ELSE href END AS link, anchor FROM h WHERE href <> ''""",
    "change_status": SNAPSHOTS + " SELECT url, status FROM st",
    "change_counts": SNAPSHOTS + " SELECT status, count(*) AS pages FROM st GROUP BY status",
    "upsert_result": SNAPSHOTS + """ SELECT url, CASE WHEN s.url IS NULL OR (n.url IS NOT NULL AND n.content_hash <> s.content_hash) THEN n.title ELSE s.title END AS title,
CASE WHEN n.url IS NULL THEN s.content_hash ELSE n.content_hash END AS content_hash, CASE WHEN s.url IS NULL OR (n.url IS NOT NULL AND n.content_hash <> s.content_hash) THEN n.updated_at ELSE s.updated_at END AS updated_at FROM new n FULL JOIN stored s USING (url)""",
    "insert_or_ignore": SNAPSHOTS + " SELECT url, title FROM stored UNION ALL SELECT url, title FROM new WHERE url NOT IN (SELECT url FROM stored)",
    "partial_update": "SELECT doc_id, CASE WHEN quality = 1 THEN 'good' ELSE lang END AS lang, source FROM documents LEFT JOIN labels USING (doc_id)",
    "update_report": "WITH u AS (SELECT doc_id * 2 AS doc_id FROM labels) SELECT count(*) FILTER (doc_id IN (SELECT doc_id FROM documents)) AS ok, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM documents)) AS failed, min(doc_id) FILTER (doc_id NOT IN (SELECT doc_id FROM documents)) AS first_failed FROM u",
    "search_documents": f"SELECT sha256(url) AS id, url, {PAGE_TITLE} AS title, trim(regexp_replace(lower({PAGE_TITLE}), '\\s+', ' ', 'g')) AS title_seg, 'html' AS doc_type, 'vi' AS lang, {HOST} AS subdomain, url AS dup_group, sha256({PAGE_BODY}) AS content_hash FROM pages",
    "politeness_schedule": f"SELECT page_id, host, CAST(row_number() OVER (PARTITION BY host ORDER BY page_id) AS INTEGER) AS turn, 1000 * (row_number() OVER (PARTITION BY host ORDER BY page_id) - 1) AS start_ms FROM (SELECT page_id, {HOST} AS host FROM pages)",
    "requests_total": REQ + " SELECT path, status, count(*) AS requests FROM req GROUP BY ALL",
    "latency_histogram": HIST + " SELECT path, le, cumulative, sum_seconds, n FROM h",
    "request_rate_1m": REQ + " SELECT time_bucket(INTERVAL 1 minute, ts) AS window_start, path, count(*) AS requests, round(count(*) / 60, 6) AS rate FROM req GROUP BY ALL",
    "error_rate_5m": REQ + " SELECT time_bucket(INTERVAL 5 minutes, ts) AS window_start, status, count(*) AS requests, round(count(*) / 300, 6) AS rate FROM req WHERE status >= 400 GROUP BY ALL",
    "quantile_from_buckets": HIST + """, o AS (SELECT *, coalesce(lag(cumulative) OVER (PARTITION BY path ORDER BY le), 0) AS below, coalesce(lag(le) OVER (PARTITION BY path ORDER BY le), 0) AS low FROM h)
SELECT path, round(CASE WHEN isinf(le) THEN low ELSE low + (le - low) * (0.95 * n - below) / (cumulative - below) END, 6) AS quantile FROM o WHERE cumulative >= 0.95 * n AND below < 0.95 * n""",
    "in_flight": REQ + """, s AS (SELECT ts AS ap, 1 AS d FROM req UNION ALL SELECT ts + to_microseconds(CAST(round(seconds * 1000000) AS BIGINT)), -1 FROM req),
a AS (SELECT ap, sum(d) AS d, count(*) FILTER (d > 0) AS started, count(*) FILTER (d < 0) AS ended FROM s GROUP BY ap), r AS (SELECT *, date_trunc('hour', ap) AS bucket_start, sum(d) OVER (ORDER BY ap) AS run FROM a)
SELECT bucket_start, CAST(sum(started) AS BIGINT) AS started, CAST(sum(ended) AS BIGINT) AS ended, CAST(arg_max(run, ap) AS BIGINT) AS in_flight, CAST(max(run) AS BIGINT) AS highest FROM r GROUP BY bucket_start""",
    "uptime": REQ + " SELECT min(ts) AS first, max(ts) AS last, epoch_us(max(ts)) - epoch_us(min(ts)) AS micros FROM req",
    "segment_text": f"SELECT doc_id, {SEGMENTED.format('text')} AS segmented FROM documents",
    "segmented_multifield": "WITH" + fields_sql("title", "content", f"list_filter(string_split({SEGMENTED}, ' '), lambda x: x <> '')")
    + f", q AS (SELECT item_id AS qid, unnest(list_filter(string_split({SEGMENTED.format('text')}, ' '), lambda x: x <> '')) AS term FROM benchmark), qt AS (SELECT DISTINCT qid, term FROM q)" + scores_sql() + BEST + top_sql("best", 10),
    "anchor_search": "WITH" + SEG.replace("fields AS (", f"fields AS (SELECT doc_id, 'anchor' AS field, {WORDS.format('anchor_text')} AS toks FROM ({ANCHORS}) UNION ALL ", 1)
    + ", qt(qid, term) AS (VALUES (0::BIGINT, 'good'), (0, 'the'), (1, 'page'), (1, 'worthless'))" + scores_sql(boosts={"title": 2.0, "content": 1.0, "anchor": 1.5}) + BEST + top_sql("best", 50),
    "link_fields": f"SELECT doc_id, lang, CASE WHEN n_chars > 500 THEN 1.0::DOUBLE / (1 + n_chars) ELSE 0 END AS pagerank, CASE WHEN trim(anchor_text) <> '' THEN anchor_text END AS anchor_text, CASE WHEN trim(anchor_text) <> '' THEN trim(lower(anchor_text)) END AS anchor_text_seg FROM documents LEFT JOIN ({ANCHORS}) USING (doc_id)",
    "dup_group_update": "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS dup_group FROM documents",
    "overwrite_result": f"SELECT doc_id, lang, line FROM ({BULK}) WHERE n = 1 UNION ALL SELECT doc_id, lang, 0::BIGINT FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ({BULK}))",
    "overwrite_report": "SELECT count(*) FILTER (doc_id % 7 <> 3) AS ok, count(*) FILTER (doc_id % 7 = 3) AS failed, 'row ' || min(doc_id) FILTER (doc_id % 7 = 3) || ': no doc_id' AS first_error FROM labels",
    "limited_files": "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 25",
    "model_texts": f"SELECT doc_id, substring({TITLE} || '. ' || text, 1, 2000) AS rerank, substring({TITLE} || ' ' || lower(text), 1, 2000) AS embed, CAST(least(length(text), 4000) AS INTEGER) AS service_chars FROM documents",
    "dictionary_vocabulary": f"SELECT item_id AS line, place, entry FROM (SELECT entry, item_id, CAST(place AS INTEGER) AS place, row_number() OVER (PARTITION BY entry ORDER BY item_id, place) AS n FROM (SELECT item_id, unnest({WORDS.format('text')}) AS entry, generate_subscripts({WORDS.format('text')}, 1) - 1 AS place FROM benchmark)) WHERE n = 1",
}

ORACLES["category_update"] = f"SELECT doc_id, predicted AS category FROM documents LEFT JOIN ({ORACLES['nb_predict']}) USING (doc_id)"
ORACLES["crawl_counters"] = f"""SELECT status AS counter, pages AS n FROM ({ORACLES['change_counts']}) UNION ALL SELECT 'edges', count(*) FROM ({ORACLES['page_links']})
UNION ALL SELECT 'files', count(*) FROM ({ORACLES['page_links']}) WHERE regexp_matches(lower(split_part(link, '?', 1)), '\\.(pdf|docx?|xlsx?|pptx?)$')"""
ORACLES["highlight_safe"] = f"""SELECT doc_id, replace(replace(replace(replace(replace(replace(replace(snippet, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#39;'), '&lt;em&gt;', '<em>'), '&lt;/em&gt;', '</em>') AS snippet
FROM ({ORACLES['snippet_highlight']})"""
