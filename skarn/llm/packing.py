"""Best-fit packing of tokenised documents into fixed-length sequences, in bulk-synchronous rounds.

Every document is tokenised whole and closed by an end id. Only documents over the capacity are
cut: the first piece takes the remainder, the others are full. Pieces are then packed by best fit,
longest first, one round for each length: the round's pieces are ranked, swept against the
open gaps from the smallest that holds them, matched rank by rank to the gaps' sequences, and the gaps are
updated before the next round. Pieces of one length are interchangeable, and so are sequences with one gap,
so a round sweeps runs (a length and how many; a gap and a range of sequences) in place of single rows:
the sweep's state is bounded by the capacity, whatever the corpus, and only lengths with counts reach the driver
(at most ``capacity`` rows). Ranking the pieces and placing them are distributed: each length is
dealt into buckets by hash, ranked within the bucket, and shifted by the counts of the buckets before.

Defined results: a null text counts as empty and gives the end id alone; repeated rows are packed
one by one; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skarn.functions.runtime import cut, map_arrow, shuffle_partitions

_ENCODERS: dict = {}
_RANKS: dict = {}
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
PLAN_SCHEMA = "length long, lo long, hi long, sequence long, per_sequence long, at long"


def encoder(name: str = "byte_bpe_50k"):
    """text -> uint32 ids, equal to those of the ``tokenizers`` file of that name, special strings included."""
    if name not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        core = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: SPECIAL_ID})
        _ENCODERS[name] = lambda text: core.encode_to_numpy(text, allowed_special="all")
        _RANKS[name] = ranks
    return _ENCODERS[name]


def token_bytes(name: str = "byte_bpe_50k") -> dict[bytes, int]:
    """The vocabulary's ids by their bytes."""
    encoder(name)
    return _RANKS[name]


def cut_points(total: int, capacity: int) -> list[int]:
    """Starts of a document's pieces: the first may be shorter than the capacity."""
    first = total % capacity or capacity
    return [0, *range(first, total, capacity)]


def pieces(docs: DataFrame, capacity: int, tokenizer: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for b in batches:
            rows, number, start, length, crc = [], [], [], [], []
            for i in range(b.num_rows):
                ids = np.append(encode(b.column(1)[i].as_py() or ""), end_id).astype("<u4")
                for k, at in enumerate(starts := cut_points(ids.size, capacity)):
                    to = starts[k + 1] if k + 1 < len(starts) else ids.size
                    rows.append(i)
                    number.append(k)
                    start.append(at)
                    length.append(to - at)
                    crc.append(zlib.crc32(ids[at:to].tobytes()))
            columns = [b.column(0).take(pa.array(rows, pa.int64())), pa.array(number, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "piece", "start", "length", "ids_crc32"])

    ids = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(id_col, text_col), run, f"{id_col} {ids}, piece int, start long, length long, ids_crc32 long")


def plan_rounds(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit-decreasing over runs. Of each run placed: (length, lo, hi, sequence, per_sequence, at): the pieces of
    this length with ranks lo to hi - 1 go to sequences from ``sequence`` on, per_sequence to each, the first at ``at``."""
    gaps: list[tuple[int, int, int]] = []  # open gaps as sorted (gap, first sequence, sequences)
    out, fresh = [], 0
    for length in sorted((n for n in counts if n > 0), reverse=True):
        rank, left = 0, counts[length]
        while left:
            k = bisect_left(gaps, (length, -1, -1))
            if k < len(gaps):
                gap, first, n = gaps.pop(k)
            else:
                gap, first, n = capacity, fresh, -(-left // (capacity // length))
                fresh += n
            per = gap // length
            placed = min(left, n * per)
            out.append((length, rank, rank + placed, first, per, capacity - gap))
            rank, left = rank + placed, left - placed
            full, rest = divmod(placed, per)
            used = full + (rest > 0)
            for g, at, m in ((gap - per * length, first, full), (gap - rest * length, first + full, int(rest > 0)), (gap, first + used, n - used)):
                if m and g:
                    insort(gaps, (g, at, m))
    return out


def pack(docs: DataFrame, capacity: int = 1024, tokenizer: str = "byte_bpe_50k", end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row for each piece."""
    spark = docs.sparkSession
    made = cut(pieces(docs, capacity, tokenizer, end_id, id_col, text_col).withColumn("bucket", F.pmod(F.xxhash64(id_col, "piece"), F.lit(shuffle_partitions(spark)))))
    per_bucket = cut(made.groupBy("length", "bucket").count())
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = per_bucket.select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("shift"))
    counts = {r[0]: r[1] for r in per_bucket.groupBy("length").agg(F.sum("count")).collect()}
    plan = spark.createDataFrame(plan_rounds(counts, capacity), PLAN_SCHEMA)
    within = Window.partitionBy("length", "bucket").orderBy(id_col, "piece", "start", "ids_crc32")
    ranked = made.withColumn("own", F.row_number().over(within) - 1).join(shifts, ["length", "bucket"]).withColumn("rank", F.col("own") + F.col("shift"))
    placed = ranked.join(plan, (ranked.length == plan.length) & (ranked["rank"] >= plan.lo) & (ranked["rank"] < plan.hi))
    nth = F.col("rank") - F.col("lo")
    return placed.select(
        id_col, "piece", "start", ranked["length"], "ids_crc32",
        (F.col("sequence") + F.floor(nth / F.col("per_sequence"))).cast("long").alias("sequence_id"),
        (F.col("at") + (nth % F.col("per_sequence")) * ranked["length"]).cast("long").alias("offset"),
    )
