"""Language-model scoring: a causal self-attention model on subword ids, and the corpus's word counts as a base line.

Words are ASCII-lower-cased runs of non-blanks; each is spelled in subword ids of a public vocabulary (with its leading
space). One head of causal self-attention over a window, with a bias for each distance, gives the odds of the next
id's class; the classes are groups of ids, and those that begin a word are apart from those that go on with one. Within a class
an id that begins a word has its share of the class, one that goes on with a word its share after the id before it. These
shares are counted over all training texts (the ``pairs`` most frequent pairs of ids, the others by the class alone), so the odds of
all next ids sum to one.

Weights are trained in numpy, by tasks, on every token of every training text, copies included. Texts are cut into pieces, which
bring the ids before them along, and a piece into windows as in scoring. Pieces are dealt into ROUNDS rounds by hash, a round's into
trainers of about ``trainer_windows`` windows each; all begin with the weights of the round before, take Adam steps over their own
windows (again and again up to LEAST_STEPS where they are few), and their weights are averaged. The number of trainers grows with
the corpus, the driver holds one set of weights. The classes come from the neighbours of all ids in all pieces. Scoring runs over
overlapping windows in batches with a causal mask; each token is scored once, by the window in which it has
the longer context. Contexts start anew every SEGMENT words of a very long text.

A word's probability is that of its ids, then of an id that begins a word, given that its first one begins a word; the
mass of all words is one. The score of a text is the sum over its words and the end token. The base score needs the count of
every word in all training texts. The ``hot_words`` most frequent go to the tasks as a
bounded table; the other occurrences are joined with the counts by word and summed back by document, so a word that
stands in very many rows never gathers in one task. A document is known by hashes of its id and text, not by a row number, so a
recomputed task gives the same keys; repeated rows share their sums.

Defined results: a null or empty text is one end token; repeated rows are scored each; with no training text all counts are 0
and the scores are those of even odds; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import ctypes
import math
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.functions.runtime import cut, map_arrow, ship
from skarn.llm.packing import encoder, token_bytes

#: A window's positions: first context alone, then those that are scored.
CONTEXT, STRIDE = 8, 16
WINDOW = CONTEXT + STRIDE
#: Classes of ids that begin a word and of those that go on with one; besides, the end token and the rare ids of both kinds have one each.
BEGIN, GO_ON = 21, 20
DIMENSIONS, CLASSES = 20, BEGIN + GO_ON + 3
#: Bound on attention scores and logits, so that their exponentials stay finite in single precision.
BOUND = 60.0
SUBWORDS = 50_257  # ids of the public vocabulary
SPACE_MARK = b" "
SEGMENT = 1 << 16
#: Targets of a piece of a training text.
PIECE = 64 * STRIDE
ROUNDS, LEAST_STEPS = 5, 120
#: Windows of a step; a trainer with more windows takes more at once.
BATCH, MOST_BATCH = 96, 512
#: How much a class's own shares count against those after one id.
BACK_OFF = 2.0
END = b""  # stands for the end token among words, which are never empty
FLUSH_WORDS = 300_000
#: The most frequent ids, whose places beside an id tell its class.
NEAR = 128
#: Words that a Python worker keeps spelled, ids that are scored and bytes of texts that are split at once, about.
MOST_SPELLED, FLUSH_SCORED, TOGETHER = 400_000, 8 * SEGMENT, 6 << 20


class Spelled:
    """Model ids of words, one word's behind another's, with their log probability within the classes and how often they are counted."""

    def __init__(self) -> None:
        self.place = {END: 0}
        self.ids, self.start, self.length, self.within = np.ones(1, np.uint16), np.zeros(1, np.int64), np.ones(1, np.int64), np.zeros(1)
        self.count, self.used = np.zeros(1), np.zeros(1)

    def places(self, words: list[bytes], vocabulary: Vocabulary | np.ndarray, hot: dict[bytes, int] | None = None) -> np.ndarray:
        """Of distinct words; those not met before are spelled. Model ids of the public ids instead of a vocabulary give no odds."""
        if hot:
            self.count[0] = hot.get(END, 0)
        at = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        unknown = np.flatnonzero(at < 0)
        self.used[at[at >= 0]] += 1
        if unknown.size:
            new = [words[i] for i in unknown.tolist()]
            ids, length = public_ids(new)
            at[unknown] = np.arange(len(self.place), len(self.place) + len(new))
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
            self.start = np.concatenate((self.start, self.ids.size + np.cumsum(length) - length))
            self.length = np.concatenate((self.length, length))
            odds = isinstance(vocabulary, Vocabulary)
            self.ids = np.concatenate((self.ids, (vocabulary.to if odds else vocabulary)[ids].astype(np.uint16)))
            self.used = np.concatenate((self.used, np.zeros(len(new))))
            self.within = np.concatenate((self.within, vocabulary.within(ids, length) if odds else np.zeros(length.size)))
            self.count = np.concatenate((self.count, np.fromiter(map(hot.get, new, repeat(0)) if hot else repeat(0, len(new)), np.float64, len(new))))
        return at

    def forget(self) -> None:
        """All words but the end token and those that were asked for again, up to half of the bound."""
        kept = np.argsort(-self.used[1:], kind="stable")[: MOST_SPELLED // 2] + 1
        kept = np.concatenate(([0], np.sort(kept[self.used[kept] > 0])))
        ids, length = self.laid_out(kept)
        new = np.full(self.start.size, -1)
        new[kept] = np.arange(kept.size)
        self.place = {w: k for w, k in zip(self.place, new.tolist()) if k >= 0}  # words stand by their places
        self.ids, self.start, self.length, self.within, self.count = ids, np.cumsum(length) - length, length, self.within[kept], self.count[kept]
        self.used = np.zeros(kept.size)

    def laid_out(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words at these places, end to end, and how many each has."""
        length = self.length[at]
        first = np.cumsum(length) - length
        return self.ids[np.repeat(self.start[at] - first, length) + np.arange(int(length.sum()))], length


_SPELLED: dict[str, Spelled] = {}


def spelled(tag: str) -> Spelled:
    """What this Python worker has spelled with a vocabulary, up to a bound."""
    if tag not in _SPELLED:
        _SPELLED.clear()
        _SPELLED[tag] = Spelled()
    if len(_SPELLED[tag].place) > MOST_SPELLED:
        _SPELLED[tag].forget()
    return _SPELLED[tag]


@dataclass
class Vocabulary:
    """Model ids: 0 is the start and padding, 1 the end token, 2 and 3 the rare ids that begin and go on with words, then the frequent ids."""

    to: np.ndarray  # model id of each public id
    group: np.ndarray  # class of each model id
    begins: np.ndarray  # of each class, whether its ids begin a word
    shares: np.ndarray  # natural log of each public id's share of its class
    pair: np.ndarray  # sorted codes (id before * SUBWORDS + id) of the pairs within words that are kept
    pair_count: np.ndarray
    after: np.ndarray  # sorted codes (id before * CLASSES + class), and their counts over the kept pairs
    after_count: np.ndarray
    tag: str = field(default_factory=lambda: uuid.uuid4().hex)

    def within(self, ids: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Natural log probability within their classes of the public ids of words that are laid end to end."""
        total, last = self.shares[ids], np.ones(ids.size, bool)
        last[np.cumsum(length) - length] = False
        k = np.flatnonzero(last)
        n = _look_up(self.pair, self.pair_count, ids[k - 1] * SUBWORDS + ids[k])
        m = _look_up(self.after, self.after_count, ids[k - 1] * CLASSES + self.group[self.to[ids[k]]])
        total[k] = np.log((n + BACK_OFF * np.exp(total[k])) / (m + BACK_OFF))
        return np.add.reduceat(total, np.cumsum(length) - length)


def _look_up(codes: np.ndarray, counts: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not codes.size:
        return np.zeros(wanted.size)
    at = np.minimum(np.searchsorted(codes, wanted), codes.size - 1)
    return np.where(codes[at] == wanted, counts[at], 0.0)


def keep_memory() -> None:
    """Has this process keep up to 64 MB that it freed: else arrays of some 100 KB, made anew in every step, are given back to the system and
    fetched again page by page, which took a third of the time of repeated steps in a fresh process. Only with glibc; elsewhere nothing changes."""
    try:
        mallopt = ctypes.CDLL(None).mallopt
    except (AttributeError, OSError, TypeError):
        return
    mallopt(-1, 64 << 20)  # M_TRIM_THRESHOLD
    mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of texts, end to end, and how many each has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, count = lists.flatten(), np.diff(lists.offsets.to_numpy()).astype(np.int64)
    blank = np.flatnonzero(pc.equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False))  # before, behind or without words
    if blank.size:
        count -= np.bincount(np.repeat(np.arange(count.size), count)[blank], minlength=count.size)
        words = words.filter(pc.greater(pc.binary_length(words), 0))
    return words.cast(pa.binary()), count


def row_groups(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Rows to take at a time, the first and how many, of TOGETHER bytes at most; a longer text alone."""
    size = np.cumsum(1 + pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < size.size:
        n = max(1, int(np.searchsorted(size, TOGETHER + (size[at - 1] if at else 0), side="right")) - at)
        yield at, n
        at += n


def as_bytes(words: pa.Array) -> list[bytes]:
    """to_pylist of a binary array without nulls, ten times as fast."""
    if not len(words):
        return []
    edges = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    data, edges = words.buffers()[2][int(edges[0]) : int(edges[-1])].to_pybytes(), (edges - edges[0]).tolist()
    return [data[a:b] for a, b in zip(edges, edges[1:])]


ODD_SPACE, ODD_IN_LINES = re.compile(r"[^\S ]|<\|"), re.compile(r"[^\S \n]|<\|")
LINE = 198  # the id of a line feed


def public_ids(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The public ids of words, each with its leading space, end to end, and how many each has. All are encoded in one call, on a
    line each; those with odd white space or special strings, which could reach over a line's end, by themselves."""
    encode, said = encoder(), lines(words)
    odd = [x.start() for x in ODD_IN_LINES.finditer(said)]
    alone = np.zeros(len(words), bool)
    if odd:
        alone[np.searchsorted(np.flatnonzero(np.frombuffer(said.encode("utf-32-le", "replace"), np.uint32) == ord("\n")), odd)] = True
        said = lines([w for w, x in zip(words, alone.tolist()) if not x])
    ids = encode(said).astype(np.int64)
    breaks = np.flatnonzero(ids == LINE)
    ids, length = np.delete(ids, breaks), (np.diff(np.concatenate(([-1], breaks, [ids.size]))) - 1)[: np.count_nonzero(~alone)]
    if not odd:
        return ids, length
    each = [encode(lines([words[i]])).astype(np.int64) for i in np.flatnonzero(alone)]
    every = np.empty(len(words), np.int64)
    every[alone], every[~alone] = [x.size for x in each], length
    by_itself = np.repeat(alone, every)
    out = np.empty(by_itself.size, np.int64)
    out[by_itself], out[~by_itself] = np.concatenate(each), ids
    return out, every


def lines(words: list[bytes]) -> str:
    """Words with their leading space, on a line each."""
    return (b" " + b"\n ".join(words)).decode("utf-8", "replace") if words else ""


@dataclass
class Attention:
    """Weights folded for scoring, by model id."""

    vocabulary: Vocabulary
    query: np.ndarray
    key: np.ndarray
    value: np.ndarray
    direct: np.ndarray  # logits that an id gives by itself
    out: np.ndarray
    distance: np.ndarray


def causal_mask(distance: np.ndarray) -> np.ndarray:
    """Factors of the attention odds of each scored position (row) to the window's positions: 0 where it can't look."""
    back = np.arange(CONTEXT, WINDOW)[:, None] - np.arange(WINDOW)[None, :]
    return np.where(back >= 0, np.exp(distance[np.maximum(back, 0)]), 0).astype(np.float32)


def layout(targets: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For segments laid end to end: the inputs (each segment begins with CONTEXT + 1 start ids, then its targets but the last),
    and of each window its place in the inputs, in the targets, and the end of its segment there."""
    n = -(-sizes // STRIDE)
    first = np.cumsum(sizes) - sizes
    inputs = np.zeros(targets.size + CONTEXT * sizes.size + WINDOW, targets.dtype)
    at = np.arange(targets.size) + np.repeat(CONTEXT * np.arange(1, sizes.size + 1), sizes)
    inputs[at + 1] = targets
    inputs[first + CONTEXT * np.arange(1, sizes.size + 1)] = 0
    shifted = (first + sizes + CONTEXT * np.arange(1, sizes.size + 1))[:-1]
    inputs[shifted] = 0
    k = STRIDE * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    return inputs, np.repeat(first + CONTEXT * np.arange(sizes.size), n) + k, np.repeat(first, n) + k, np.repeat(first + sizes, n)


def token_log_probs(m: Attention, targets: np.ndarray, sizes: np.ndarray, batch: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Natural log probability of every target's class, and of any class that begins a word there; segments of these sizes are laid end
    to end. The windows are those of ``layout``: inputs lie in blocks of STRIDE, behind a block of start ids for each segment, so that a window is a
    block with the ids before it, keys and values are looked up once, and windows share them."""
    blocks = -(-sizes // STRIDE) + 1
    at = np.arange(targets.size) + np.repeat(STRIDE * np.cumsum(blocks) - STRIDE * (blocks - 1) - (np.cumsum(sizes) - sizes), sizes)
    inputs, group = np.zeros(STRIDE * int(blocks.sum()) + 1, targets.dtype), np.zeros(STRIDE * int(blocks.sum()), np.int64)
    inputs[at + 1] = targets
    inputs[STRIDE * (np.cumsum(blocks) - blocks + 1)] = 0
    inputs[STRIDE * (np.cumsum(blocks) - blocks)] = 0  # where the last target of a segment would be an input
    group[at] = m.vocabulary.group[targets] + CLASSES * (at % (STRIDE * batch))
    out, new, mask, d = np.zeros(group.size, np.float32), np.zeros(group.size, np.float32), causal_mask(m.distance), m.key.shape[1]
    both, ones = np.concatenate((m.key, m.value), 1), np.ones(WINDOW, np.float32)
    sums = np.stack((np.ones(CLASSES), m.vocabulary.begins), 1).astype(np.float32)
    for b in range(0, group.size, STRIDE * batch):
        own = inputs[b : min(b + STRIDE * batch, group.size)]
        before = inputs[b - CONTEXT : b] if b else np.zeros(CONTEXT, inputs.dtype)
        kv = windowed(both.take(np.concatenate((before, own)), axis=0))
        a = m.query.take(own, axis=0).reshape(-1, STRIDE, d) @ kv[..., :d].transpose(0, 2, 1)
        np.exp(a, out=a)
        a *= mask
        z = (a @ kv[..., d:]).reshape(-1, d)
        z /= (a.reshape(-1, WINDOW) @ ones)[:, None]
        logits = z @ m.out
        logits += m.direct.take(own, axis=0)
        mine = logits.reshape(-1).take(group[b : b + own.size], mode="clip")
        np.exp(logits, out=logits)
        total = np.log(logits @ sums)
        np.subtract(mine, total[:, 0], out=out[b : b + own.size])
        np.subtract(total[:, 1], total[:, 0], out=new[b : b + own.size])
    return out[at], new[at]


def windowed(t: np.ndarray) -> np.ndarray:
    """The windows of CONTEXT + k * STRIDE rows, as a view."""
    return np.lib.stride_tricks.as_strided(t, ((len(t) - CONTEXT) // STRIDE, WINDOW, t.shape[1]), (STRIDE * t.strides[0], *t.strides))


def initial_weights(size: int, seed: int = 7) -> dict[str, np.ndarray]:
    rng, d = np.random.default_rng(seed), DIMENSIONS
    square = lambda m: rng.normal(0, d**-0.5, (d, m)).astype(np.float32)
    p = {"e": rng.normal(0, 0.3, (size, d)).astype(np.float32), "q": square(d), "k": square(d), "v": square(d), "o": square(CLASSES), "u": square(CLASSES)}
    return p | {"c": np.zeros(CLASSES, np.float32), "r": np.zeros(WINDOW, np.float32)}


def gradient(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean cross-entropy of the classes y (-1: none) at the scored positions of windows x."""
    grad, de = gradient_parts(p, x, y, causal_mask(p["r"]))
    n = max(1, int((y >= 0).sum()))
    return {k: g / n for k, g in (grad | {"e": gradient_of_ids(x, de, p["e"])}).items()}


def gradient_of_ids(x: np.ndarray, de: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Added up by id what rows de give to the ids x."""
    order = np.argsort(x.astype(np.uint16).reshape(-1), kind="stable")
    ids = x.reshape(-1)[order]
    new, out = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1]))), np.zeros_like(e)
    out[ids[new]] = np.add.reduceat(de.take(order, axis=0), new, axis=0)
    return out


def gradient_parts(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Of the sum of the cross-entropy: the gradient of all weights but "e", and a row for each id in x that goes to its row of "e"."""
    d, kind, back = DIMENSIONS, p["e"].dtype.type, np.maximum(np.arange(CONTEXT, WINDOW)[:, None] - np.arange(WINDOW)[None, :], 0)
    flat = lambda t: t.reshape(-1, t.shape[-1])
    # products of the same rows are one: of every id its key and value; the logits are of a position's mean value, its own id and a one
    kv, q_scaled, ouc = np.concatenate((p["k"], p["v"]), 1), p["q"] * kind(d**-0.5), np.concatenate((p["o"], p["u"], p["c"][None]))
    e = p["e"].take(x, axis=0)
    flat_e, zm = flat(e), np.empty((y.size, 2 * d + 1), kind)
    zm[:, d : 2 * d], zm[:, 2 * d] = flat(e[:, CONTEXT:]), 1
    mine = zm[:, d : 2 * d]
    both, q = (flat_e @ kv).reshape(*x.shape, 2 * d), (mine @ q_scaled).reshape(*y.shape, d)
    k, v = both[..., :d], both[..., d:]
    a = q @ k.transpose(0, 2, 1)
    np.exp(bounded(a), out=a)
    a *= mask
    a *= (1 / (flat(a) @ np.ones(WINDOW, kind))).reshape(*y.shape, 1)
    np.matmul(a, v, out=zm[:, :d].reshape(*y.shape, d, copy=False))
    g = zm @ ouc
    np.exp(bounded(g), out=g)
    g *= (1 / (g @ np.ones(CLASSES, kind)))[:, None]
    g.reshape(-1)[np.arange(0, g.size, CLASSES) + np.maximum(y, 0).reshape(-1)] -= 1
    if y.min(initial=0) < 0:
        g[y.reshape(-1) < 0] = 0
    dzm = g @ ouc[: 2 * d].T
    dz = dzm[:, :d].reshape(*y.shape, d, copy=False)
    ds = dz @ v.transpose(0, 2, 1)
    ds -= np.einsum("ij,ij->i", dzm[:, :d], zm[:, :d]).reshape(*y.shape, 1)
    ds *= a
    dq, dkv = flat(ds @ k), np.empty_like(both)
    np.matmul(ds.transpose(0, 2, 1), q, out=dkv[..., :d])
    np.matmul(a.transpose(0, 2, 1), dz, out=dkv[..., d:])
    de, own = (flat(dkv) @ kv.T).reshape(e.shape), dq @ q_scaled.T
    own += dzm[:, d:]
    de[:, CONTEXT:] += own.reshape(*y.shape, d)
    of_kv, of_ouc = flat_e.T @ flat(dkv), zm.T @ g
    grad = {"o": of_ouc[:d], "u": of_ouc[d : 2 * d], "c": of_ouc[2 * d], "q": mine.T @ dq * kind(d**-0.5), "k": of_kv[:, :d], "v": of_kv[:, d:]}
    return grad | {"r": np.bincount(back.reshape(-1), ds.sum(0).reshape(-1), WINDOW)}, flat(de)


def bounded(t: np.ndarray) -> np.ndarray:
    """t, cut to BOUND in place where it goes beyond."""
    return t if -BOUND <= t.min(initial=0) and t.max(initial=0) <= BOUND else np.clip(t, -BOUND, BOUND, out=t)


def gradient_of(p: dict[str, np.ndarray], rows: np.ndarray, group: np.ndarray) -> dict[str, np.ndarray]:
    """``gradient`` over windows (rows of model ids), by parts that a processor's cache holds."""
    x, y = examples(rows, group)
    n, mask = np.float32(1 / max(1, int((y >= 0).sum()))), causal_mask(p["r"])
    total, de = {k: np.zeros_like(v) for k, v in p.items() if k != "e"}, np.empty((x.size, DIMENSIONS), np.float32)
    for at in range(0, len(x), BATCH):
        part, de[at * WINDOW : (at + BATCH) * WINDOW] = gradient_parts(p, x[at : at + BATCH], y[at : at + BATCH], mask)
        for k, g in part.items():
            total[k] += g.astype(np.float32)
    return {k: g * n for k, g in (total | {"e": gradient_of_ids(x, de, p["e"])}).items()}


def descend(p: dict[str, np.ndarray], rows: np.ndarray, group: np.ndarray, rate: float, seed: int) -> dict[str, np.ndarray]:
    """Weights after Adam steps over all these windows (rows of model ids), in passes up to LEAST_STEPS steps at least."""
    p, rng, step = dict(p), np.random.default_rng(seed), 0
    mean, square = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    batch = min(MOST_BATCH, max(BATCH, len(rows) // LEAST_STEPS))
    while step < LEAST_STEPS:
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), batch):
            step += 1
            for n, gr in gradient_of(p, rows[order[at : at + batch]], group).items():
                mean[n] += np.float32(0.1) * (gr - mean[n])
                gr *= gr
                square[n] += np.float32(0.01) * (gr - square[n])
                root = np.sqrt(square[n])
                root *= np.float32((1 - 0.99**step) ** -0.5)
                root += np.float32(1e-8)
                p[n] = p[n] - np.float32(rate / (1 - 0.9**step)) * mean[n] / root
    return p


def fold(p: dict[str, np.ndarray], vocabulary: Vocabulary) -> Attention:
    e = p["e"]
    query, key, value, direct = e @ p["q"] * np.float32(DIMENSIONS**-0.5), e @ p["k"], e @ p["v"], e @ p["u"] + p["c"]
    norm = lambda t: float(np.sqrt((t * t).sum(-1)).max())
    query *= np.float32(min(1.0, BOUND / max(1e-9, norm(query) * norm(key))))
    most = np.abs(direct).max() + norm(value) * norm(p["o"].T)
    shrink = np.float32(min(1.0, BOUND / max(1e-9, most)))
    return Attention(vocabulary, query, key, value, direct * shrink, p["o"] * shrink, np.clip(p["r"], -20, 20))


def _clusters(points: np.ndarray, weight: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    if len(points) <= n:
        return np.arange(len(points))
    heavy = np.argsort(-weight, kind="stable")[: max(n, len(points) // 2)]
    centres = points[rng.choice(heavy, n, replace=False)]
    for _ in range(20):
        label = ((points[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
        for k in range(n):
            mine = label == k
            if weight[mine].sum() > 0:
                centres[k] = np.average(points[mine], axis=0, weights=weight[mine])
    return label


def near_columns(counts: np.ndarray) -> np.ndarray:
    """Of each model id its column among the NEAR most frequent, or -1."""
    column = np.full(counts.size, -1)
    near = np.argsort(-counts, kind="stable")[:NEAR]
    column[near] = np.arange(near.size)
    return column


def count_sides(a: np.ndarray, b: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Of each model id a row with how often the near ids stand right of it, then left of it; b stand right of a."""
    near = min(NEAR, column.size)
    out = np.zeros(column.size * 2 * near, np.int64)
    for own, other, shift in ((a, b, 0), (b, a, near)):
        c = column[other]
        out += np.bincount((own.astype(np.int64) * (2 * near) + c + shift)[c >= 0], minlength=out.size)
    return out.reshape(column.size, 2 * near)


def group_ids(windows: np.ndarray, begins: np.ndarray, seed: int = 7) -> np.ndarray:
    """Classes of model ids by what stands left and right of them in windows (rows of model ids)."""
    counts = np.bincount(windows.reshape(-1), minlength=begins.size)
    return group_sides(count_sides(windows[:, :-1].reshape(-1), windows[:, 1:].reshape(-1), near_columns(counts)), counts, begins, seed)


def group_sides(sides: np.ndarray, counts: np.ndarray, begins: np.ndarray, seed: int = 7) -> np.ndarray:
    """Classes of model ids by k-means over ``count_sides``; those that begin words and the others apart. begins tells them, of each
    model id."""
    size, rng = begins.size, np.random.default_rng(seed)
    sides = np.sqrt(sides / np.maximum(1, sides.sum(1, keepdims=True))).astype(np.float32)
    u, s, _ = np.linalg.svd(sides - sides.mean(0), full_matrices=False)
    points, weight = u[:, :16] * s[:16], np.log1p(counts)
    label = np.zeros(size, np.int64)
    label[:4] = (0, CLASSES - 3, CLASSES - 2, CLASSES - 1)  # the start is never a target
    for kind, n, first in ((True, BEGIN, 0), (False, GO_ON, BEGIN)):
        ids = 4 + np.flatnonzero(begins[4:] == kind)
        if ids.size:
            label[ids] = first + _clusters(points[ids], weight[ids], n, rng)
    return label


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, c) over all texts, the end token among them. Tasks count what they read and pass on counts, in bounded tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("c", "sum")]).rename_columns(["word", "c"])

        waiting = 0
        for b in batches:
            for at, n in row_groups(b.column(0)):
                found = split_words(b.column(0).slice(at, n))[0].value_counts()
                held.append(pa.table({"word": found.field(0), "c": found.field(1).cast(pa.int64())}))
                held.append(pa.table({"word": pa.array([END], pa.binary()), "c": pa.array([n], pa.int64())}))
                waiting += len(found)
                if waiting > 2 * FLUSH_WORDS:
                    held = [summed()]
                    waiting = held[0].num_rows
                    if waiting > FLUSH_WORDS:
                        yield from held[0].to_batches()
                        held, waiting = [], 0
        if held:
            yield from summed().to_batches()

    return map_arrow(docs.select(text_col), run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def subword_pairs(counts: DataFrame) -> DataFrame:
    """(before, id, n): how often a subword id follows another within the words of (word, c); before is -1 where it begins one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, c = b.column(0).to_pylist(), b.column(1).to_numpy()
            some = [i for i, w in enumerate(words) if w]
            if some:
                ids, length = public_ids([words[i] for i in some])
                before = np.concatenate(([0], ids[:-1] + 1))
                before[np.cumsum(length) - length] = 0
                code, at = np.unique(before * SUBWORDS + ids, return_inverse=True)
                n = np.bincount(at, np.repeat(c[some], length)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(code // SUBWORDS - 1), pa.array(code % SUBWORDS), pa.array(n)], names=["before", "id", "n"])

    return map_arrow(counts.select("word", "c"), run, "before long, id long, n long").groupBy("before", "id").agg(F.sum("n").alias("n"))


def at_least(df: DataFrame, count: str, most: int) -> int:
    """A count that at most ``most`` rows of df reach, by a histogram in steps of a sixteenth of a factor of two."""
    step = F.floor(16 * F.log2(count))
    held, low = 0, None
    for k, n in sorted(df.where(F.col(count) > 0).groupBy(step.alias("k")).count().collect(), reverse=True):
        held += n
        if held > most:
            break
        low = k
    return math.ceil(2 ** (low / 16) - 1e-9) if low is not None else 1 << 62


def model_ids(frequent: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The model id of each public id."""
    to = np.where(starts, 2, 3)
    to[frequent] = 4 + np.arange(frequent.size)
    return to


def vocabulary_of(to: np.ndarray, group: np.ndarray, often: np.ndarray, pairs: DataFrame, most_pairs: int) -> Vocabulary:
    """often: counts of the public ids."""
    begins = np.zeros(CLASSES, bool)
    begins[[*range(BEGIN), CLASSES - 3, CLASSES - 2]] = True
    kept = pairs.where((F.col("before") >= 0) & (F.col("n") >= at_least(pairs.where("before >= 0"), "n", most_pairs))).collect()
    often = often + 0.1
    of = group[to]
    shares = np.log(often / np.bincount(of, often, CLASSES)[of])
    code = np.array([r[0] * SUBWORDS + r[1] for r in kept], np.int64)
    n, order = np.array([r[2] for r in kept], np.float64), np.argsort(code)
    code, n = code[order], n[order]
    after, at = np.unique(code // SUBWORDS * CLASSES + of[code % SUBWORDS], return_inverse=True)
    return Vocabulary(to, group, begins, shares, code, n, after, np.bincount(at, n, after.size) if after.size else np.zeros(0))


def begins_word() -> np.ndarray:
    """Of each public id, whether it begins with a space."""
    out = np.zeros(SUBWORDS, bool)
    for token, i in token_bytes().items():
        out[i] = token.startswith(SPACE_MARK)
    return out


def training_pieces(training: DataFrame, to: np.ndarray, key: str = "u", text_col: str = "text") -> DataFrame:
    """(at, n, x): every text's model ids and its end in pieces of PIECE targets, each behind the CONTEXT + 1 ids before them (start ids at
    the text's start), packed; n is how many windows a piece has, ``at`` a hash of it, of the row's key and its place in the batch."""
    tag, start = uuid.uuid4().hex, np.zeros(CONTEXT + 1, np.uint16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        for b in batches:
            keys = (b.column(0).to_numpy() & 0xFFFFFFFF).tolist()
            for at, rows in row_groups(b.column(1)):
                hashes, n, packed = [], [], []
                words, count = split_words(b.column(1).slice(at, rows))
                words, store = words.dictionary_encode(), spelled(tag)
                every = with_ends(store.places(as_bytes(words.dictionary), to)[words.indices.to_numpy()], count)
                ids, length = store.laid_out(every)
                ends = np.cumsum(length)[np.cumsum(count + 1) - 1]
                for i, own in enumerate(np.split(ids, ends[:-1])):
                    own = np.concatenate((start, own))
                    for first in range(0, own.size - CONTEXT - 1, PIECE):
                        x = own[first : first + CONTEXT + 1 + PIECE].tobytes()
                        # copies in one table are dealt to different trainers
                        hashes.append(zlib.crc32(b"%d %d" % (at + i, first), zlib.crc32(x, keys[at + i])))
                        n.append(-(-(len(x) // 2 - CONTEXT - 1) // STRIDE))
                        packed.append(zlib.compress(x, 1))
                yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(n, pa.int32()), pa.array(packed, pa.binary())], names=["at", "n", "x"])

    return map_arrow(training.select(key, text_col), run, "at long, n int, x binary")


def unpacked(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Pieces end to end, and their sizes."""
    each = [np.frombuffer(zlib.decompress(x), np.uint16) for x in packed]
    return np.concatenate([np.zeros(0, np.uint16), *each]), np.array([x.size for x in each], np.int64)


def windows_of(packed: list[bytes]) -> np.ndarray:
    """Rows of CONTEXT + STRIDE + 1 model ids, behind the end of a text 0: all windows of pieces."""
    x, sizes = unpacked(packed)
    n = -(-(sizes - CONTEXT - 1) // STRIDE)
    k = STRIDE * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    first, end = np.repeat(np.cumsum(sizes) - sizes, n), np.repeat(np.cumsum(sizes), n)
    at = (first + k)[:, None] + np.arange(WINDOW + 1)
    return np.where(at < end[:, None], x[np.minimum(at, max(0, x.size - 1))], 0).astype(np.uint16)


def all_sides(pieces: DataFrame, column: np.ndarray) -> np.ndarray:
    """``count_sides`` over all pieces, added up in two steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((column.size, 2 * min(NEAR, column.size)), np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                x, sizes = unpacked(b.column(0).slice(at, 2000).to_pylist())
                place = np.arange(x.size) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                right = np.flatnonzero(place > CONTEXT)  # what stands before was a piece's own
                total += count_sides(x[right - 1], x[right], column)
        task = TaskContext.get().partitionId()
        parts = [part.tobytes() for part in np.array_split(total.reshape(-1), PIECES)]
        yield pa.RecordBatch.from_arrays([pa.array([task] * PIECES, pa.int32()), pa.array(range(PIECES), pa.int32()), pa.array(parts, pa.binary())], names=["task", "piece", "v"])

    def add(t: pa.Table) -> pa.Table:
        v = np.sum([np.frombuffer(v, np.int64) for v in t["v"].to_pylist()], axis=0)
        return pa.table({"task": pa.array([0], pa.int32()), "piece": pa.array([t["piece"][0].as_py()], pa.int32()), "v": pa.array([v.tobytes()], pa.binary())})

    schema = "task int, piece int, v binary"
    near = max(1, math.isqrt(pieces.rdd.getNumPartitions()))
    half = map_arrow(pieces.select("x"), run, schema).groupBy("piece", F.pmod("task", F.lit(near))).applyInArrow(lambda key, t: add(t), schema)
    found = half.groupBy("piece").applyInArrow(add, schema).orderBy("piece").select("v").collect()
    whole = np.concatenate([np.frombuffer(r[0], np.int64) for r in found]) if found else np.zeros(column.size * 2 * min(NEAR, column.size), np.int64)
    return whole.reshape(column.size, -1)


def examples(rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inputs, and the classes of the next ids at the scored positions (-1 behind the end)."""
    rows = rows.astype(np.int64)
    y = rows[:, CONTEXT + 1 :]
    return rows[:, :-1], np.where(y == 0, -1, group[y])


PIECES = 16


def train_round(pieces: DataFrame, p: dict[str, np.ndarray], group: np.ndarray, trainers: int, rate: float) -> dict[str, np.ndarray]:
    """The weights after a round: the trainers' own, averaged by their windows in two steps."""
    names, shapes = list(p), {k: v.shape for k, v in p.items()}
    shared = pieces.sparkSession.sparkContext.broadcast((p, group))

    def learn(t: pa.Table) -> pa.Table:
        keep_memory()
        p, group = shared.value
        rows = windows_of([x for _, x in sorted(zip(t["at"].to_pylist(), t["x"].to_pylist()))])  # however the rows came
        new = descend(p, rows, group, rate, len(rows))
        parts = np.array_split(np.concatenate([new[k].reshape(-1) for k in names]).astype(np.float64), PIECES)
        trainer = t["trainer"][0].as_py()
        return pa.table({"trainer": pa.array([trainer] * PIECES, pa.int32()), "piece": pa.array(range(PIECES), pa.int32()), "n": pa.array([float(len(rows))] * PIECES), "v": pa.array([part.tobytes() for part in parts], pa.binary())})

    def mean(t: pa.Table) -> pa.Table:
        n = t["n"].to_numpy()
        total = sum(w * np.frombuffer(v, np.float64) for w, v in sorted(zip(n.tolist(), t["v"].to_pylist())))
        return pa.table({"trainer": pa.array([t["trainer"][0].as_py()], pa.int32()), "piece": pa.array([t["piece"][0].as_py()], pa.int32()), "n": pa.array([n.sum()]), "v": pa.array([(total / n.sum()).tobytes()], pa.binary())})

    schema = "trainer int, piece int, n double, v binary"
    near = max(1, math.isqrt(trainers))
    made = pieces.select(F.pmod("at", F.lit(trainers)).cast("int").alias("trainer"), "at", "x").groupBy("trainer").applyInArrow(learn, schema)
    half = made.groupBy("piece", F.pmod("trainer", F.lit(near))).applyInArrow(lambda key, t: mean(t), schema)
    whole = np.concatenate([np.frombuffer(r[0], np.float64) for r in half.groupBy("piece").applyInArrow(mean, schema).orderBy("piece").select("v").collect()])
    out, at = {}, 0
    for k in names:
        size = math.prod(shapes[k])
        out[k], at = whole[at : at + size].reshape(shapes[k]).astype(np.float32), at + size
    shared.unpersist()
    return out


def fit(training: DataFrame, counts: DataFrame, text_col: str = "text", key: str = "u", vocabulary: int = 4096, most_pairs: int = 500_000, trainer_windows: int = 64_000) -> Attention:
    """The model of all training texts; counts are their (word, c), key a column with a hash of the row's id."""
    ship(training.sparkSession)
    pairs, starts = cut(subword_pairs(counts)), begins_word()
    often = np.zeros(SUBWORDS)
    for i, n in pairs.groupBy("id").agg(F.sum("n")).collect():
        often[i] = n
    frequent = np.argsort(-often, kind="stable")[: min(vocabulary, np.count_nonzero(often))]
    to = model_ids(frequent, starts)
    pieces = cut(training_pieces(training, to, key, text_col))
    n = pieces.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ends = (counts.where(F.col("word") == F.lit(END)).agg(F.sum("c")).first()[0]) or 0
    seen = np.bincount(to, often, 4 + frequent.size)
    seen[:2] = ends  # every text has a start and an end
    group = group_sides(all_sides(pieces, near_columns(seen)), seen, np.concatenate(([True, True, True, False], starts[frequent])))
    v = vocabulary_of(to, group, often, pairs, most_pairs)
    p = initial_weights(v.group.size)
    trainers = max(1, round(n / ROUNDS / trainer_windows))
    few = n < ROUNDS * BATCH * 8  # so few that a round takes all of them
    for k in range(ROUNDS if n else 0):
        mine = pieces if few else pieces.where(F.pmod(F.shiftright("at", 8), F.lit(ROUNDS)) == k)
        p = train_round(mine, p, v.group, trainers, 0.01 * min(1.0, 1.5 * (1 - k / ROUNDS)))
    return fold(p, v)


PARTS = "u long, t long, copies long, n_tokens long, n_known long, base double, score double, word binary, k long"


def score(docs: DataFrame, is_training: Column, hot_words: int = 200_000, id_col: str = "doc_id", text_col: str = "text", extra: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, extra columns, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    extra = extra or {}
    given = docs.select(id_col, text_col, *(c.alias(k) for k, c in extra.items()), is_training.alias("_training"))
    named = given.withColumns({"u": F.xxhash64(F.col(id_col).isNull(), id_col), "t": F.xxhash64(text_col)})
    training = named.where("_training")
    counts = cut(word_counts(training, text_col))
    total, vocab = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    hot = {bytes(r[0]): r[1] for r in counts.where(F.col("c") >= at_least(counts, "c", hot_words)).collect()}
    shared = docs.sparkSession.sparkContext.broadcast((fit(training, counts, text_col), hot))
    denominator = total + 0.1 * (vocab + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        model, hot = shared.value
        for b in batches:
            yield from _score_batch(model, hot, b, denominator)

    parts = map_arrow(named.select("u", "t", text_col), run, PARTS)
    parts = parts.join(counts.withColumnRenamed("word", "_w"), F.col("word") == F.col("_w"), "left")
    c, rare = F.coalesce("c", F.lit(0)), F.col("k") > 0
    base = F.when(rare, F.col("k") * F.log10((c + 0.1) / F.lit(denominator))).otherwise(F.col("base"))
    known = F.when(rare, F.when(c > 0, F.col("k")).otherwise(0)).otherwise(F.col("n_known"))
    summed = parts.groupBy("u", "t").agg(F.sum("n_tokens").alias("n_tokens"), F.sum(known).alias("n_known"), F.sum(base).alias("base_score"), F.sum("score").alias("score"), F.sum("copies").alias("copies"))
    each = lambda c: (F.col(c) / F.col("copies")).alias(c)
    whole = lambda c: each(c).cast("long").alias(c)
    kept = named.select("u", "t", id_col, *extra)
    return kept.join(summed, ["u", "t"]).select(id_col, *extra, whole("n_tokens"), whole("n_known"), F.lit(total).cast("long").alias("train_tokens"), each("base_score"), each("score"))


def _score_batch(model: Attention, hot: dict[bytes, int], rows: pa.RecordBatch, denominator: float) -> Iterator[pa.RecordBatch]:
    """Of each segment of a document a row of sums over its words, without the base score of rare words, and a row for each rare word."""
    u, t = rows.column(0).to_numpy(), rows.column(1).to_numpy()
    for at, n_rows in row_groups(rows.column(2)):
        words, count = split_words(rows.column(2).slice(at, n_rows))
        words, store = words.dictionary_encode(), spelled(model.vocabulary.tag)
        spelling = pa.concat_arrays([pa.array([END], pa.binary()), words.dictionary])
        place = np.concatenate(([0], store.places(as_bytes(words.dictionary), model.vocabulary, hot)))
        every = with_ends(words.indices.to_numpy() + np.int64(1), count)
        c = store.count[place]
        base, is_hot = np.where(c > 0, np.log10((c + 0.1) / denominator), 0.0), c > 0
        # segments of the texts with their ends
        n = -(-(count + 1) // SEGMENT)
        row, k = np.repeat(np.arange(n_rows), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        size, last = np.minimum(count[row] + 1 - SEGMENT * k, SEGMENT), k == n[row] - 1
        begin = np.concatenate(([0], np.cumsum(size)))
        run = np.cumsum(np.add.reduceat(store.length[place[every]], begin[:-1])) // FLUSH_SCORED
        edges = [0, *(np.flatnonzero(run[1:] != run[:-1]) + 1).tolist(), run.size]
        for first, end in zip(edges, edges[1:]):
            own = slice(first, end)
            code, of = every[begin[first] : begin[end]], np.repeat(np.arange(end - first), size[own])
            log_p = log_probs_of(model, store, place[code], size[own], ~last[own])
            tokens, n_known, bases, scores = (np.bincount(of, x, end - first) for x in (np.ones(of.size), is_hot[code], base[code], log_p))
            pairs, times = np.unique((of * place.size + code)[~is_hot[code]], return_counts=True)
            owner, rare = at + row[own], pairs // place.size
            by, zeros = np.concatenate((owner, owner[rare])), np.zeros(rare.size)
            # a key of its own for each segment's row, which can't be a word: null keys would all be dealt to one task
            keys = pa.concat_arrays([pa.array([b" %d" % u[i] for i in owner], pa.binary()), spelling.take(pa.array(pairs % place.size))])
            columns = [
                pa.array(u[by]), pa.array(t[by]), *(pa.array(np.concatenate((x, zeros)).astype(np.int64)) for x in (k[own] == 0, tokens, n_known)),
                *(pa.array(np.concatenate((x, zeros))) for x in (bases, scores)), keys, pa.array(np.concatenate((np.zeros(owner.size, np.int64), times))),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in PARTS.split(", ")])


def with_ends(words: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The words of texts that have ``count`` words each, and 0 behind each text."""
    out, is_word = np.zeros(words.size + count.size, np.int64), np.ones(words.size + count.size, bool)
    is_word[np.cumsum(count + 1) - 1] = False
    out[is_word] = words
    return out


def distinct(segments: list[list[bytes]]) -> tuple[list[bytes], np.ndarray]:
    """The distinct words of segments, the end token first, and the place among them of every word."""
    every = pa.array([END, *chain.from_iterable(segments)], pa.binary()).dictionary_encode()
    return every.dictionary.to_pylist(), every.indices.to_numpy()[1:].astype(np.int64)


def word_log_probs(model: Attention, segments: list[list[bytes]]) -> np.ndarray:
    """``log_probs_of`` of segments, each a list of words."""
    words, code = distinct(segments)
    store = spelled(model.vocabulary.tag)
    return log_probs_of(model, store, store.places(words, model.vocabulary)[code], np.array([len(s) for s in segments]), np.array([s[-1] != END for s in segments]))


def log_probs_of(model: Attention, store: Spelled, place: np.ndarray, count: np.ndarray, open_end: np.ndarray) -> np.ndarray:
    """log10 probability under attention of every word of segments, each a run of ``count`` words with a context of its own. A segment that doesn't end
    with the end token gets one that isn't scored, so that the mass of what may follow its last word is known. place tells the words' places
    in store."""
    scored = np.ones(place.size + int(open_end.sum()), bool)
    edges = np.cumsum(count + open_end)
    scored[edges[open_end] - 1] = False
    every = np.zeros(scored.size, np.int64)  # the added ends are the end token, which has place 0
    every[scored] = place
    targets, length = store.laid_out(every)
    ends = np.cumsum(length)
    first = ends - length
    of_class, new = token_log_probs(model, targets, np.diff(np.concatenate(([0], ends[edges - 1]))))
    begun = new[first].astype(np.float64)  # the log mass of all ids that begin a word, where this word begins
    follows = np.append(begun[1:], 0.0)
    follows[edges - 1] = 0.0  # nothing follows the end
    return ((np.add.reduceat(of_class.astype(np.float64), first) + store.within[every] - begun + follows) / np.log(10))[scored]
