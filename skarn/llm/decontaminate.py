"""Benchmark decontamination: every training passage queries a BM25 inverted index of test items with block-max WAND.

Items are indexed by their words; a posting's impact is its share of the item's own BM25 score, so a score is
the covered share of an item, and one threshold serves all. A document's words are cut into passages of twice the
longest item, each half overlapping the next, so every item-long stretch lies whole in a passage. Items are numbered
into blocks; each term knows its largest impact in each block. For all passages of a batch at once, the sums of
block maxima rule out blocks that cannot reach the threshold; in the blocks that remain, WAND moves cursors over the
postings, skips by the sum of the maxima, and scores the items it cannot rule out. All items above the threshold are
verified in the stretch of the passage that has most of their words and is at most SPREAD times as long as the item and SLACK words: of the
item's question (all sentences but the last) and answer (the last; of an item of one sentence, the last third of its words), shares of
the words that occur there in order must both reach ``least_overlap``. Items of fewer than SHORT words must stand there word for word.

The index goes to the tasks; items beyond ``block_items`` are searched in further passes, so its size is bounded.
Document frequencies, mean and greatest length are those of all items in every pass, so results don't depend on the passes; they
are gathered in one stream over the items. Documents are scanned whole and never shuffled.

Defined results: null and empty texts match nothing; items with fewer than LEAST words are no evidence and match nothing; items with a null id
are reported with it; equal items are all reported; repeated documents are reported each; with no items the result is empty; other columns are not read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from skarn.functions.runtime import map_arrow

WORD = re.compile(r"[^\W_]+")
SENTENCE_END = re.compile(r"[.!?\n]+")
K1, B = 1.2, 0.75
BLOCK = 4
#: Terms in more than this share of the items have their block maxima in a dense table.
COMMON = 0.1
#: Items of fewer words than these match nothing, or must stand word for word.
LEAST, SHORT = 3, 8
SPREAD, SLACK = 1.5, 8
SLICE = 1 << 20
FLUSH = 200_000


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    said = [w for w in map(words, SENTENCE_END.split(text)) if w]
    if len(said) > 1:
        return [w for s in said[:-1] for w in s], said[-1]
    all_words = said[0] if said else []
    k = len(all_words) - max(1, len(all_words) // 3)
    return all_words[:k], all_words[k:]


def in_order(part: list[str], passage: list[str]) -> float:
    """Share of part's words in its longest common subsequence with the passage."""
    if not part:
        return 1.0
    at: dict[str, int] = {}
    for i, w in enumerate(part):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(part)) - 1
    state = full
    for w in passage:
        if m := at.get(w):
            met = state & m
            state = ((state + met) | (state - met)) & full
    return (len(part) - state.bit_count()) / len(part)


def densest(passage: list[str], wanted: set[str], size: int) -> list[str]:
    """The first stretch of ``size`` words that has most of the wanted ones."""
    hits = np.concatenate(([0], np.cumsum([w in wanted for w in passage])))
    if len(passage) <= size:
        return passage
    at = int((hits[size:] - hits[:-size]).argmax())
    return passage[at : at + size]


def overlaps(parts: tuple[list[str], list[str]], passage: list[str]) -> list[float]:
    """Shares of question and answer that the passage has."""
    item = parts[0] + parts[1]
    if len(item) < SHORT:
        found = any(passage[i : i + len(item)] == item for i, w in enumerate(passage) if w == item[0])
        return [float(found)] * 2
    near = densest(passage, set(item), int(SPREAD * len(item)) + SLACK)
    return [in_order(x, near) for x in parts]


@dataclass
class Totals:
    """Statistics of all items."""

    items: int
    mean: float
    longest: int
    df: Counter


def totals(texts: Iterator[str]) -> Totals:
    df, n, words_held, longest = Counter(), 0, 0, 1
    for text in texts:
        said = words(text)
        if len(said) >= LEAST:
            df.update(set(said))
            n, words_held, longest = n + 1, words_held + len(said), max(longest, len(said))
    return Totals(n, words_held / max(1, n) or 1.0, longest, df)


@dataclass
class Index:
    item_ids: list
    parts: list[tuple[list[str], list[str]]]
    terms: dict[str, int]
    postings: list[list[tuple[int, float]]]  # of each term: (item, impact) by item
    common: np.ndarray  # of each term: its row in the dense table of block maxima, or -1
    dense: np.ndarray
    block_of: np.ndarray  # the other terms' blocks and block maxima, term after term
    block_most: np.ndarray
    block_at: np.ndarray  # of each term: where its blocks begin
    longest: int
    n_blocks: int


def build_index(items: list[tuple[object, str]], of: Totals | None = None) -> Index:
    of = of or totals(t or "" for _, t in items)
    parts = [question_and_answer(t or "") for _, t in items]
    bags = [Counter(q + a) for q, a in parts]
    df, mean, n, sizes = of.df, of.mean, len(items), [sum(b.values()) for b in bags]
    terms = {w: i for i, w in enumerate(dict.fromkeys(w for bag in bags for w in bag))}
    postings: list[list[tuple[int, float]]] = [[] for _ in terms]
    for i, bag in enumerate(bags):
        weight = {w: math.log(1 + (of.items - df[w] + 0.5) / (df[w] + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[i] / mean)) for w, tf in bag.items()}
        total = sum(weight.values())
        for w, x in weight.items():
            postings[terms[w]].append((i, x / total))
    often = [t for t, p in enumerate(postings) if len(p) > COMMON * n]
    common, n_blocks = np.full(len(terms), -1), -(-n // BLOCK)
    common[often] = np.arange(len(often))
    dense = np.zeros((len(often), n_blocks), np.float32)
    block_of, block_most, block_at = [], [], [0]
    for t, p in enumerate(postings):
        best: dict[int, float] = {}
        for i, x in p:
            best[i // BLOCK] = max(x, best.get(i // BLOCK, 0.0))
        if common[t] >= 0:
            dense[common[t], list(best)] = list(best.values())
        else:
            block_of += best
            block_most += best.values()
        block_at.append(len(block_of))
    return Index([i for i, _ in items], parts, terms, postings, common, dense, np.array(block_of, np.int64), np.array(block_most), np.array(block_at), of.longest, n_blocks)


def wand(index: Index, terms: list[int], block: int, least: float) -> list[tuple[int, float]]:
    """(item, score) of the block's items that score at least ``least`` for these distinct terms."""
    lists = []
    for t in terms:
        whole = index.postings[t]
        p = whole[bisect_left(whole, (block * BLOCK,)) : bisect_left(whole, ((block + 1) * BLOCK,))]
        if p:
            lists.append([0, p, max(x for _, x in p)])
    found = []
    while lists:
        lists.sort(key=lambda c: c[1][c[0]][0])
        bound, pivot = 0.0, None
        for c in lists:
            bound += c[2]
            if bound >= least - 1e-9:
                pivot = c[1][c[0]][0]
                break
        if pivot is None:
            break
        if lists[0][1][lists[0][0]][0] == pivot:
            score = 0.0
            for c in lists:
                if c[1][c[0]][0] != pivot:
                    break
                score += c[1][c[0]][1]
                c[0] += 1
            if score >= least - 1e-9:
                found.append((pivot, score))
        else:
            for c in lists:
                while c[0] < len(c[1]) and c[1][c[0]][0] < pivot:
                    c[0] += 1
        lists = [c for c in lists if c[0] < len(c[1])]
    return found


def survivors(index: Index, passage: np.ndarray, term: np.ndarray, n: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(passage, block) pairs whose sums of block maxima reach the threshold; passage and term list distinct pairs."""
    row = index.common[term]
    present = np.zeros((n, len(index.dense)), np.float32)
    present[passage[row >= 0], row[row >= 0]] = 1
    base = present @ index.dense
    p, t = passage[row < 0], term[row < 0]
    size = index.block_at[t + 1] - index.block_at[t]
    at = np.repeat(index.block_at[t] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    key, of = np.unique(np.repeat(p, size) * index.n_blocks + index.block_of[at], return_inverse=True)
    bound = np.bincount(of, index.block_most[at], key.size) + base.reshape(-1)[key]
    key = key[bound >= least - 1e-5]
    alone = np.flatnonzero(base.reshape(-1) >= least - 1e-5)  # blocks that common terms alone lift to the threshold
    key = np.unique(np.concatenate((key, alone))) if alone.size else key
    return key // index.n_blocks, key % index.n_blocks


def slices(text: str, overlap: int) -> Iterator[list[str]]:
    """The words of a text in slices that share ``overlap`` words, so that very long texts fit."""
    held: list[str] = []
    at = 0
    while at < len(text):
        to = at + SLICE
        if to < len(text):
            cut = WORD.match(text, to)  # not inside a word
            to = cut.end() if cut else to
        new = words(text[at:to])
        yield held + new
        held, at = (held + new)[-overlap:], to


class Matcher:
    def __init__(self, index: Index, least_score: float, least_overlap: float):
        self.index, self.least_score, self.least_overlap = index, least_score, least_overlap
        self.step = max(64, index.longest)
        self.clear()

    def clear(self) -> None:
        self.passages: list[tuple[int, list[str], int]] = []  # (document, its words, start)
        self.ids: list[np.ndarray] = []
        self.owner: list[np.ndarray] = []
        self.held = 0

    def add(self, doc: int, text: str) -> None:
        for said in slices(text, 2 * self.step):
            get = self.index.terms.get
            ids = np.fromiter((get(w, -1) for w in said), np.int32, len(said))
            known = np.flatnonzero(ids >= 0)
            for_each = max(1, -(-(len(said) - self.step) // self.step))
            first = len(self.passages)
            self.passages += [(doc, said, k * self.step) for k in range(for_each)]
            k = known // self.step
            for part, ok in ((k, k < for_each), (k - 1, k >= 1)):
                ok &= part < for_each
                self.owner.append(first + part[ok])
                self.ids.append(ids[known[ok]])
            self.held += len(said)

    def flush(self, best: dict[tuple[int, int], tuple[float, float, float]]) -> None:
        """Adds to best, of each (document, item) verified: score, question and answer overlap of the best passage."""
        if self.passages:
            n_terms = len(self.index.terms)
            pairs = np.unique(np.concatenate(self.owner).astype(np.int64) * n_terms + np.concatenate(self.ids))
            passage, term = pairs // n_terms, pairs % n_terms
            edges = np.searchsorted(passage, np.arange(len(self.passages) + 1))
            for p, block in zip(*(x.tolist() for x in survivors(self.index, passage, term, len(self.passages), self.least_score))):
                doc, said, at = self.passages[p]
                for item, score in wand(self.index, term[edges[p] : edges[p + 1]].tolist(), block, self.least_score):
                    shares = overlaps(self.index.parts[item], said[at : at + 2 * self.step])
                    if min(shares) >= self.least_overlap:
                        best[doc, item] = max(best.get((doc, item), (0.0, 0.0, 0.0)), (score, *shares))
        self.clear()


def contaminated(
    docs: DataFrame, items: DataFrame, least_score: float = 0.6, least_overlap: float = 0.8, block_items: int = 20_000,
    id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of every document and item that overlap."""
    ids, its = docs.schema[id_col].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    schema = f"{id_col} {ids}, {item_id} {its}, score double, question_overlap double, answer_overlap double"
    with_words = items.where(F.col(item_text).isNotNull()).select(item_id, item_text)
    passes = max(1, -(-with_words.count() // block_items))
    part = F.pmod(F.xxhash64(item_text), F.lit(passes))
    every, out = totals(r[0] for r in with_words.select(item_text).toLocalIterator()), None
    for k in range(passes):
        rows = [r for r in map(tuple, with_words.where(part == k).orderBy(item_id, item_text).collect()) if len(words(r[1])) >= LEAST]
        found = _one_pass(docs, build_index(rows, every), to_arrow_type(items.schema[item_id].dataType), least_score, least_overlap, schema, id_col, text_col) if rows else docs.sparkSession.createDataFrame([], schema)
        out = found if out is None else out.union(found)
    return out


def _one_pass(docs: DataFrame, index: Index, item_type: pa.DataType, least_score: float, least_overlap: float, schema: str, id_col: str, text_col: str) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, matcher = shared.value, Matcher(shared.value, least_score, least_overlap)
        for b in batches:
            best: dict[tuple[int, int], tuple[float, float, float]] = {}
            for i, text in enumerate(b.column(1)):
                matcher.add(i, text.as_py() or "")
                if matcher.held >= FLUSH:
                    matcher.flush(best)
            matcher.flush(best)
            rows = sorted(best)
            values = [best[r] for r in rows]
            columns = [b.column(0).take(pa.array([d for d, _ in rows], pa.int64())), pa.array([index.item_ids[i] for _, i in rows], item_type)]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array([round(v[k], 9) for v in values], pa.float64()) for k in range(3))], names=names)

    return map_arrow(docs.select(id_col, text_col), run, schema)
