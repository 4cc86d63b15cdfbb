"""SimHash near-duplicate grouping with multi-index hashing.

Fingerprints: ASCII-lower-cased words, word shingles with repeats, XXH64; a bit is set when it is
set in over half of the shingle hashes. Linking: the 64 bits are cut into segments; by the
pigeonhole principle two fingerprints within ``max_distance`` bits agree in some segment up to
that segment's radius. Every distinct fingerprint is posted in the segment tables under the values of
its small Hamming ball, those that meet under one value are compared over all 64 bits, and
what remains are links. Copies share one fingerprint and are linked once, whatever their number.

Defined results: a null or empty text, or one without words, has fingerprint zero and is linked like
any other; fewer words than a shingle make one shingle of the whole; repeated doc_ids with
equal fingerprints are kept as they are; an empty table gives an empty result; other columns of the
input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.functions.runtime import cut, join_counted, map_arrow, shuffle_partitions
from skarn.operators.components import connected_components

SEED = 42
#: More members than this under one segment value are compared in cells of two chunks each.
CHUNK = 2048


def fingerprint(text: bytes | None, width: int = 4, seed: int = SEED) -> int:
    """The unsigned 64-bit fingerprint of a UTF-8 text."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return hashed(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - width + 1
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 16384):
        a, b = first[at : min(n, at + 16384)], ends[at + width - 1 : at + width - 1 + 16384]
        h = np.fromiter((hashed(joined[i:j], seed) for i, j in zip(a.tolist(), b.tolist())), "<u8", len(a))
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint of every whole text, as a signed long with the same bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t, width) for t in b.column(1).cast(pa.binary()).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=[id_col, "fp"])

    ids = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(id_col, text_col), run, f"{id_col} {ids}, fp long")


def segments(max_distance: int, n_segments: int) -> list[tuple[int, int, int]]:
    """(shift, width, radius) of each segment; the radii plus one add up to max_distance + 1."""
    n = min(n_segments, max_distance + 1)
    out, shift = [], 0
    for i in range(n):
        width = 64 // n + (i >= n - 64 % n)
        out.append((shift, width, (max_distance + 1) // n - 1 + (i < (max_distance + 1) % n)))
        shift += width
    return out


def _posted(fp: np.ndarray, plan: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys (segment and value) under which fingerprints are posted, and the fingerprints."""
    keys, members = [], []
    for k, (shift, width, radius) in enumerate(plan):
        own, tag = (fp >> np.uint64(shift)) & np.uint64((1 << width) - 1), np.uint64(k << 40)
        keys.append(own | tag)
        members.append(fp)
        for r in range(1, radius + 1):
            for bits in combinations(range(width), r):
                mask = np.uint64(sum(1 << b for b in bits))
                # of two values one bit apart, the one that has it comes to the one that lacks it
                met = (own & mask) != 0 if radius == 1 else np.ones(len(fp), bool)
                keys.append((own[met] ^ mask) | tag)
                members.append(fp[met])
    return np.concatenate(keys), np.concatenate(members)


def spanning_links(fp: np.ndarray, max_distance: int) -> tuple[list[int], list[int]]:
    """Links that join what links within max_distance join, at most one for each fingerprint."""
    left, src, dst = np.unique(fp), [], []
    while left.size > 1:
        front, root, left = left[:1], int(left[0]), left[1:]
        while front.size and left.size:
            now, front = front[:256], front[256:]
            hit = np.zeros(left.size, bool)
            for x in now:
                hit |= np.bitwise_count(left ^ x) <= max_distance
            new, left = left[hit], left[~hit]
            src += new.tolist()
            dst += [root] * new.size
            front = np.concatenate((front, new))
    return src, dst


def _verify(batches: Iterator[pa.RecordBatch], max_distance: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, cell, fp) in key order; emits links between fingerprints of one key and cell."""
    r = np.uint8(max_distance)

    def links(key: np.ndarray, cell: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        start = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (cell[1:] != cell[:-1]))))
        size = np.diff(np.append(start, key.size))
        src, dst = [], []
        run = np.repeat(np.arange(start.size), size)
        small = np.repeat(size <= 8, size)
        for lag in range(1, 8):
            if key.size > lag:
                i = np.flatnonzero((run[lag:] == run[:-lag]) & small[lag:])
                i = i[(np.bitwise_count(fp[i] ^ fp[i + lag]) <= r) & (fp[i] != fp[i + lag])]
                src.append(fp[i])
                dst.append(fp[i + lag])
        for k in np.flatnonzero(size > 8):
            a, b = spanning_links(fp[start[k] : start[k] + size[k]], max_distance)
            src.append(np.array(a, np.uint64))
            dst.append(np.array(b, np.uint64))
        src, dst = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (src, dst))
        return pa.RecordBatch.from_arrays([pa.array(src.view(np.int64)), pa.array(dst.view(np.int64))], names=["src", "dst"])

    held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)]
    for b in batches:
        new = [b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False).view(np.uint64)]
        key, cell, fp = (np.concatenate(x) for x in zip(held, new))
        if not key.size:
            continue
        open_run = np.flatnonzero((key != key[-1]) | (cell != cell[-1]))
        done = int(open_run[-1]) + 1 if open_run.size else 0
        held = [key[done:], cell[done:], fp[done:]]
        if done:
            yield links(key[:done], cell[:done], fp[:done])
    if held[0].size:
        yield links(*held)


def fingerprint_links(distinct: DataFrame, max_distance: int = 4, n_segments: int = 3, chunk: int = CHUNK) -> DataFrame:
    """(src, dst) links among distinct fingerprints (column fp) that join exactly what all pairs within
    max_distance bits join. Values with more than ``chunk`` members are dealt out as cells of two
    chunks each, so no task holds more than two chunks of a value; every pair meets in some cell."""
    plan = segments(max_distance, n_segments)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                key, fp = _posted(b.column(0).slice(at, 2000).to_numpy(zero_copy_only=False).view(np.uint64), plan)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fp.view(np.int64))], names=["key", "fp"])

    posted = map_arrow(distinct.select("fp"), post, "key long, fp long")
    heavy = posted.groupBy("key").count().where(F.col("count") > chunk).select("key", F.ceil(F.col("count") / chunk).alias("chunks"))
    mine = F.pmod(F.xxhash64("fp"), F.col("chunks"))
    cells = F.when(F.col("chunks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda j: F.greatest(mine, j) * F.col("chunks") + F.least(mine, j))
    )
    dealt = posted.join(heavy, "key", "left").select("key", F.explode(cells).alias("cell"), "fp")
    n = shuffle_partitions(distinct.sparkSession)
    ordered = dealt.repartition(n, "key", "cell").sortWithinPartitions("key", "cell")
    return map_arrow(ordered, lambda batches: _verify(batches, max_distance), "src long, dst long").distinct()


def near_duplicate_groups(docs: DataFrame, width: int = 4, max_distance: int = 4, n_segments: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document; component_id is the smallest doc_id reachable."""
    marked = cut(fingerprints(docs, width, id_col, text_col))
    # of each fingerprint only its smallest doc_id goes on
    distinct = cut(marked.groupBy("fp").agg(F.min(id_col).alias("first"), F.count("*").alias("n")))
    labels = connected_components(fingerprint_links(distinct, max_distance, n_segments)).withColumnRenamed("node", "fp")
    # only fingerprints with a link need a look at their component
    linked = cut(distinct.join(labels, "fp").select("fp", "first", "component"))
    least = linked.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("members"))
    of = join_counted(linked, least, "component", "members", linked.count()).select("fp", "component_id")
    named = cut(distinct.join(of, "fp", "left").select("fp", "n", F.coalesce("component_id", "first").alias("component_id")))
    return join_counted(marked, named, "fp", "n", marked.count()).select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
