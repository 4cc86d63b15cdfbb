"""Approximate nearest neighbours (largest cosine) with a permutation index.

Pivots are drawn from the vectors (the smallest hashes: a sample of ``pivots`` vectors, whatever the table's size).
A vector is represented by its ``posted`` nearest pivots in order, and posted with its place in the order in the inverted file of
each. A query reads the files of its own ``posted`` nearest pivots and adds up, for every vector met, what Spearman's footrule
between the two orders falls by for each pivot they share. The ``share`` of vectors with the smallest footrule (at least ``least``, and
all that tie with the last) is reranked by exact cosine in double precision, once for each vector.

The index is cut by vector: a shard holds the inverted files of about ``shard_rows`` vectors, and queries come in blocks
of about ``query_rows``, so no task holds more, however large one file is. Every vector is posted; the best of
all shards are merged. Equal vectors are posted once, with the smallest ids that any answer can need.

Defined results: null, empty and zero vectors and those with null or non-finite components take no part;
vectors of different lengths are indexed apart; of rows with one id the smallest vector counts; rows with a null id
take no part; a query's own id is never among its results; scores that agree to 12 digits are ties and go to the smaller id; fewer
candidates than k are all returned; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skarn.functions.runtime import cut, ship

RESULT = "query_id long, vec_id long, score double"
#: Scores that agree to so many digits are ties; rough scores are off by less than the margin.
DIGITS, MARGIN = 12, 1e-11


def valid(vector: str) -> Column:
    """Non-null, finite in every component, and not zero."""
    x = F.col(vector)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(finite & F.exists(x, lambda v: v != 0), F.lit(False))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, n: int) -> np.ndarray:
    """Rounded, so that vectors of one direction have one order."""
    return np.argsort(-np.round(_unit(x) @ _unit(pivots).T, 9), axis=1, kind="stable")[:, :n].astype(np.int32)


class Files:
    """The inverted files of a shard: of each pivot, the vectors that have it in their order, and at what place."""

    def __init__(self, order: np.ndarray, n_pivots: int):
        self.size, self.depth = order.shape
        by_pivot = np.argsort(order.reshape(-1), kind="stable")
        self.rows, self.places = (by_pivot // self.depth).astype(np.int32), (by_pivot % self.depth).astype(np.int32)
        self.ends = np.searchsorted(order.reshape(-1)[by_pivot], np.arange(n_pivots + 1))
        self.met = self.depth - np.arange(self.depth, dtype=np.int32)

    def nearness(self, query_order: np.ndarray) -> np.ndarray:
        """How far each vector's footrule to the query is below that of orders without a common pivot (an absent pivot is at ``depth``)."""
        out, place = np.zeros(self.size, np.int32), np.arange(self.depth, dtype=np.int32)
        for at, pivot in enumerate(query_order.tolist()):
            own = slice(self.ends[pivot], self.ends[pivot + 1])
            fall = self.met + (self.depth - at) - np.abs(place - at)
            out[self.rows[own]] += fall[self.places[own]]  # a vector stands once in a file
        return out


def exact_cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = a.astype(np.float64), b.astype(np.float64)
    return (a * b).sum(-1) / (np.sqrt((a * a).sum(-1)) * np.sqrt((b * b).sum(-1)))


def search_shard(vectors: pa.Table, queries: pa.Table, pivots: np.ndarray, k: int, depth: int, share: float, least: int) -> pa.Table:
    """The k best of one shard for each of a block of queries."""
    out = ([], [], [])
    if not vectors.num_rows or not queries.num_rows:
        return _result(out)
    x, q = _matrix(vectors["v"]), _matrix(queries["q"])
    ids = vectors["ids"].combine_chunks()
    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    flat, edge = ids.values.to_numpy(), ids.offsets.to_numpy()
    first, unit, n = flat[edge[:-1]], _unit(x), len(x)
    files = Files(nearest_pivots(x, pivots, depth), len(pivots))
    m = min(n, max(least, int(np.ceil(share * n))))
    for q_id, own, asked, order in zip(queries["query_id"].to_pylist(), q, _unit(q), nearest_pivots(q, pivots, depth)):
        near = np.arange(n)
        if m < n:
            met = files.nearness(order)
            near = np.flatnonzero(met >= np.partition(met, n - m)[n - m])
        rough = unit[near] @ asked
        if near.size > k + 1:  # one more, as the query's own row may be among them; whatever may tie stays
            near = near[rough >= np.partition(rough, near.size - k - 1)[near.size - k - 1] - MARGIN]
        scores = exact_cosine(x[near], own)
        best = np.lexsort((first[near], -np.round(scores, DIGITS)))[: k + 1]
        found = sorted((-round(s, DIGITS), v, s) for s, t in zip(scores[best].tolist(), near[best].tolist()) for v in flat[edge[t] : edge[t + 1]].tolist() if v != q_id)[:k]
        out[0].extend([q_id] * len(found))
        out[1].extend(v for _, v, _ in found)
        out[2].extend(s for _, _, s in found)
    return _result(out)


def _result(out: tuple[list, list, list]) -> pa.Table:
    return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})


def search(
    vectors: DataFrame, is_query: Column, k: int = 5, pivots: int = 256, posted: int = 64, share: float = 0.1, least: int = 256,
    shard_rows: int = 8192, query_rows: int = 2048, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows that is_query marks, against all rows."""
    spark = vectors.sparkSession
    ship(spark)
    given = vectors.where(F.col(id_col).isNotNull() & valid(vector_col)).withColumn("_query", F.coalesce(is_query, F.lit(False)))
    given = given.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(vector_col).alias("v"), F.max("_query").alias("is_query"))
    given = cut(given.withColumn("dims", F.size("v")))
    found = [_search_equal_length(given.where(F.col("dims") == d), k, pivots, posted, share, least, shard_rows, query_rows) for d in sorted(r[0] for r in given.select("dims").distinct().collect())]
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    hits = found[0]
    for more in found[1:]:
        hits = hits.union(more)
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", DIGITS)), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def draw_pivots(distinct: DataFrame, most: int) -> np.ndarray:
    """The vectors (column v) with the smallest hashes, one of each direction. A hash bound near the wanted share comes first, so
    that tasks send few rows."""
    hashed, n = distinct.select("v", F.pmod(F.xxhash64("v"), F.lit(1 << 40)).alias("h")), distinct.count()
    bound = min(1.0, 4.0 * most / max(1, n)) * (1 << 40)
    few = hashed.where(F.col("h") <= int(bound)).orderBy("h", "v").limit(2 * most).collect()
    x = _matrix(pa.array([r[0] for r in few]))
    first = np.unique(np.round(_unit(x), 9), axis=0, return_index=True)[1]
    return x[np.sort(first)[:most]]


def _search_equal_length(given: DataFrame, k: int, pivots: int, posted: int, share: float, least: int, shard_rows: int, query_rows: int) -> DataFrame:
    same = Window.partitionBy("v").orderBy("id")
    few = given.select("id", "v").withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= k + 1)
    distinct = cut(few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    p = draw_pivots(distinct, pivots)
    depth = min(posted, len(p))
    asked = given.where("is_query").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    shards, blocks = (F.lit(max(1, -(-df.count() // size))) for df, size in ((distinct, shard_rows), (asked, query_rows)))
    every = lambda count: F.explode(F.sequence(F.lit(0), count - 1))
    left = distinct.select(F.pmod(F.xxhash64("v"), shards).cast("int").alias("shard"), every(blocks).alias("block"), "ids", "v")
    right = asked.select(every(shards).alias("shard"), F.pmod(F.xxhash64("query_id"), blocks).cast("int").alias("block"), "query_id", "q")

    def one(a: pa.Table, b: pa.Table) -> pa.Table:
        return search_shard(a, b, p, k, depth, share, least)

    key = ["shard", "block"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(one, RESULT)
