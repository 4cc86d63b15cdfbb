"""Near copies by true Jaccard similarity of word-shingle sets.

Sets: ASCII-lower-cased words, distinct word shingles as XXH64 values; fewer words than a shingle make one shingle of
the whole. Equal sets are one from the start. Candidates come first from SimHash fingerprints of the shingles, by op5's multi-index
hashing (``simhash.fingerprint_links``): those within ``DISTANCE`` bits. At similarity 0.8 fingerprints differ in about 10 of 64 bits, more
than segments reach, so candidates are besides those that share a band of MinHash values: with 32 bands of 4, a pair of similarity 0.8
is missed with probability (1 - 0.8^4)^32 = 5e-8. Every candidate pair is compared by its whole sets unless links already join it,
first with those its fingerprint links to and with a leader of its buckets, so that a large group becomes one component, then what
of a bucket is still in several components.

Defined results: null, empty and blank texts have the empty set and are copies of each other; ids are unique longs; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.functions.runtime import cut, join_counted, map_arrow, shuffle_partitions
from skarn.llm.simhash import fingerprint_links
from skarn.operators.components import connected_components

SEED = 42
BANDS, ROWS = 32, 4
#: A cell holds at most two chunks of documents, about.
CHUNK = 256
BROADCAST_ROWS = 100_000
#: Up to so many links are joined in one task; rounds over all partitions would cost the driver and the disk more than the links weigh.
FEW_LINKS = 200_000
#: Bits in which the fingerprints of candidates differ at most.
DISTANCE = 4
_R = np.random.default_rng(SEED)
MASKS, FACTORS = _R.integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64)
FACTORS |= np.uint64(1)


def shingle_set(text: bytes | None, width: int = 5) -> np.ndarray:
    """The distinct shingle hashes of a UTF-8 text, sorted."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first = np.concatenate(([0], ends[:-1] + 1))
    last = ends[width - 1 :] if len(words) > width else ends[-1:]
    return np.unique(np.fromiter((hashed(joined[i:j], SEED) for i, j in zip(first.tolist(), last.tolist())), np.uint64, len(last)))


def band_keys(s: np.ndarray) -> np.ndarray:
    """One key for each band of MinHash values of a set; none for the empty set."""
    if not s.size:
        return s
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, s.size, 1024):
        low = np.minimum(low, ((s[at : at + 1024, None] ^ MASKS) * FACTORS).min(0))
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = key * np.uint64(0x9E3779B97F4A7C15) + low.reshape(BANDS, ROWS)[:, k]
        key ^= key >> np.uint64(29)
    return key


def set_fingerprint(s: np.ndarray) -> int:
    """The SimHash fingerprint of a set of shingle hashes: a bit is set when it is in over half of them."""
    counts = np.zeros(64, np.int64)
    for at in range(0, s.size, 16384):
        counts += np.unpackbits(s[at : at + 16384].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > s.size, bitorder="little").view("<u8")[0])


def fingerprint_candidates(distinct: DataFrame) -> DataFrame:
    """(id, bucket) of sets (id, fp): the sets that a set's fingerprint links it to, of equal fingerprints the one with the smallest id."""
    first = cut(distinct.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")))
    links = fingerprint_links(first.select("fp"), DISTANCE)
    roots = first.select(F.col("fp").alias("dst"), F.col("first").alias("bucket"))
    near = first.select("fp", "first").join(links, F.col("fp") == F.col("src")).join(roots, "dst").select(F.col("first").alias("id"), "bucket")
    equal = join_counted(distinct.select("id", "fp"), first.where("n > 1"), "fp", "n", distinct.count()).where("id <> first").select("id", F.col("first").alias("bucket"))
    return near.union(equal)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint64), *arrays]).view(np.int64)))


def _mark(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys, whole, fp = [], [], []
        for t in b.column(1).cast(pa.binary()).to_pylist():
            s = shingle_set(t, width)
            keys.append(band_keys(s))
            whole.append(xxhash.xxh3_128_digest(s.tobytes()))
            fp.append(set_fingerprint(s))
        fps = pa.array(np.array(fp, np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(whole, pa.binary()), _lists(keys), fps], names=["id", "whole", "keys", "fp"])


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 500):
            part = b.slice(at, 500)
            sets = [shingle_set(t, width) for t in part.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), _lists(sets)], names=["id", "s"])


def cell_links(ids: list[int], comp: list[int], sets: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Links between similar sets that join what is in different components."""
    size = np.array([len(s) for s in sets])
    start = np.cumsum(size) - size
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    label, mark, out = np.unique(comp, return_inverse=True)[1], np.zeros(code.max() + 1, bool), []
    for i in range(len(ids) - 1):
        apart = label[i + 1 :] != label[i]
        if not apart.any():
            continue
        own = code[start[i] : start[i] + size[i]]
        mark[own] = True
        common = np.add.reduceat(mark[code[start[i + 1] :]], start[i + 1 :] - start[i + 1], dtype=np.int64)
        mark[own] = False
        for j in np.flatnonzero(apart & (common >= threshold * (size[i] + size[i + 1 :] - common) - 1e-9)) + i + 1:
            if label[j] != label[i]:
                out.append((ids[i], ids[j]))
                label[label == label[j]] = label[i]
    return out


def _verify(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, cell, id, comp, s) in order of bucket and cell; emits the links of each cell."""
    now, ids, comp, sets = None, [], [], []

    def links() -> list[tuple[int, int]]:
        return cell_links(ids, comp, sets, threshold) if len(ids) > 1 else []

    def batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["src", "dst"])

    for b in batches:
        found = []
        s = b.column(4)
        values, ends = s.values.to_numpy(zero_copy_only=False), s.offsets.to_numpy()
        for k, (*at, i, c) in enumerate(zip(*(b.column(x).to_pylist() for x in range(4)))):
            if at != now:
                found += links()
                now, ids, comp, sets = at, [], [], []
            ids.append(i)
            comp.append(c)
            sets.append(values[ends[k] : ends[k + 1]].copy())
        yield batch(found)
    yield batch(links())


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (src, dst) of one task; emits (node, component), the smallest node that links reach."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := root.setdefault(top, top)) != top:
            top = up
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x, y = find(x), find(y)
            root[max(x, y)] = min(x, y)
    yield pa.RecordBatch.from_arrays([pa.array(list(root), pa.int64()), pa.array([find(x) for x in root], pa.int64())], names=["node", "component"])


def linked(links: DataFrame, few: int = FEW_LINKS) -> DataFrame:
    """(node, component) of computed links (src, dst) without nulls."""
    return map_arrow(links.coalesce(1), _join, "node long, component long") if links.count() <= few else connected_components(links)


def near_copy_links(docs: DataFrame, distinct: DataFrame, width: int, threshold: float, chunk: int) -> DataFrame:
    """(src, dst) links among distinct sets (id, keys, fp) that join what all similar candidate pairs join."""
    n = shuffle_partitions(docs.sparkSession)
    posted = distinct.select("id", F.explode("keys").alias("key"))
    buckets = posted.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("leader")).where("n > 1")
    shared = cut(posted.join(buckets.drop("n"), "key"))
    marked = cut(fingerprint_candidates(distinct))
    need = cut(shared.select("id").union(marked.select("id")).union(marked.select("bucket")).distinct())
    few = F.broadcast(need) if need.count() <= BROADCAST_ROWS else need
    sets = cut(map_arrow(docs.join(few, "id", "left_semi").select("id", "text"), lambda batches: _sets(batches, width), "id long, s array<long>"))

    def verified(cells: DataFrame) -> DataFrame:
        """Of cells (bucket, cell, id, comp)."""
        whole = cells.join(sets, "id").select("bucket", "cell", "id", "comp", "s")
        return cut(map_arrow(whole.repartition(n, "bucket", "cell").sortWithinPartitions("bucket", "cell"), lambda batches: _verify(batches, threshold), "src long, dst long"))

    zero = F.lit(0).cast("long")
    up_to = lambda c: F.sequence(zero, c - 1)
    led = shared.where("id <> leader").groupBy("id").agg(F.min("leader").alias("bucket"))
    led = cut(led.union(marked.select("id", "bucket")).distinct())
    stars = led.groupBy("bucket").agg(F.ceil(F.count("*") / chunk).alias("chunks"))
    members = led.join(stars, "bucket").select("bucket", F.pmod(F.xxhash64("id"), "chunks").alias("cell"), "id", F.col("id").alias("comp"))
    leaders = stars.select("bucket", F.explode(up_to(F.col("chunks"))).alias("cell"), F.col("bucket").alias("id"), F.col("bucket").alias("comp"))
    first = verified(members.union(leaders))

    labels = linked(first).withColumnRenamed("node", "id")
    held = cut(shared.drop("leader").join(labels, "id", "left").select("key", "id", F.coalesce("component", "id").alias("comp")))
    parts = held.groupBy("key", "comp").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("id")).alias("x"))
    mixed = parts.groupBy("key").agg(F.max(F.struct("m", "comp")).alias("big"), F.count("*").alias("c"), F.sum("m").alias("n"), F.bit_xor("x").alias("x")).where("c > 1")
    # buckets of the same documents are one
    mixed = mixed.groupBy("n", "x").agg(F.min(F.struct("key", F.col("big.comp").alias("of"), F.ceil(F.col("big.m") / chunk).alias("p"), F.ceil((F.col("n") - F.col("big.m")) / chunk).alias("q"))).alias("k"))
    # chunks of the largest component meet all chunks of the others, and these each other
    p, q, mine = F.col("p"), F.col("q"), F.xxhash64("id")
    own, other = F.pmod(mine, p), F.pmod(mine, q)
    among = F.transform(up_to(q), lambda j: p * q + F.greatest(other, j) * q + F.least(other, j))
    cells = F.when(F.col("comp") == F.col("of"), F.transform(up_to(q), lambda j: own * q + j)).otherwise(F.concat(F.transform(up_to(p), lambda i: i * q + other), F.when(q > 1, among).otherwise(F.array().cast("array<bigint>"))))
    rest = held.join(mixed.select("k.*"), "key").select(F.col("key").alias("bucket"), F.explode(cells).alias("cell"), "id", "comp")
    return first.union(verified(rest))


def near_copy_groups(docs: DataFrame, width: int = 5, threshold: float = 0.8, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component) of every document; a component is what pairs of at least this Jaccard similarity join."""
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    marked = cut(map_arrow(given, lambda batches: _mark(batches, width), "id long, whole binary, keys array<long>, fp long"))
    firsts = cut(marked.groupBy("whole").agg(F.min("id").alias("first"), F.first("keys").alias("keys"), F.first("fp").alias("fp"), F.count("*").alias("n")))
    links = near_copy_links(given, firsts.select(F.col("first").alias("id"), "keys", "fp"), width, threshold, chunk)
    labels = linked(links).select(F.col("node").alias("first"), "component")
    named = cut(firsts.drop("keys", "fp").join(labels, "first", "left").select("whole", "n", F.coalesce("component", "first").alias("component")))
    return join_counted(marked.select("id", "whole"), named, "whole", "n", marked.count()).select(F.col("id").alias(id_col), "component")
