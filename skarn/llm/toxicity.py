"""Toxicity: a support vector machine on the gapped subsequence string kernel, with Nystrom landmarks.

A text is cut into sentences, a sentence into units: its words (by white space, outer punctuation off) and runs of single
characters pulled together ("i d i o t"). The kernel of two strings sums over their common subsequences of ``ORDER`` characters (of the
landmark's length if it is shorter), each weighted down for every character that it leaves out between its first and last, in either string, and less so for
characters that are no letters, so what is put in between or left out only lowers it. Landmarks are spans of units drawn from the labelled
texts, the more likely the more a span's texts differ in label (chi-square) and the less the landmarks drawn before cover it. A sentence's features are,
for each landmark, the largest kernel of its units, as a share of the landmark's kernel with itself and 0 below ``FLOOR``, whitened by the
landmarks' own kernel matrix. The machine is linear in these; a text's score is a logistic
scale, fitted to the labelled texts, of its most toxic sentence, of how many are toxic, and of how dense they stand.

Training: labels belong to texts, so the machine is fitted in rounds: first every sentence of a toxic text is positive, then of each toxic
text the sentence that the last machine likes best; all sentences of the other texts are negative. The landmarks themselves, also with characters put in, are
positive too where the machine takes them for toxic. At most ``sample_rows`` labelled texts of each label (those with the smallest hashes of their ids) are used, each of at
most ``sample_bytes`` bytes: longer texts don't train, but every text is scored whole.

A unit that shares too few characters with every landmark for a common subsequence has kernel 0 with all
of them, so it is passed over by a test on character sets without being compared.

Defined results: a null, empty or blank text has no units and gets the score of a text without toxic units; without
positive labels or landmarks all get score 0; of rows with one id the smallest text trains; labels without a text, null and other labels are not used; ties
cannot matter; an empty table gives an empty result; repeated rows are scored each; other columns are not read.
"""

from __future__ import annotations

import heapq
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skarn.functions.runtime import cut, map_arrow

ORDER = 4
#: Weight of a character between: of the landmark or a letter or digit of the unit, and any other character of the unit.
DECAY, DECAY_OTHER = 0.5, 0.9
WIDTH = 40
#: Stands before each unit, so that beginnings of words are strings of their own; white space can't be in a unit.
START = "\n"
SPANS = (4, 5, 6)
#: Kernels below this share of the landmark's own count as none.
FLOOR = 0.15
OUTER = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "¡¿«»„“”‘’…–—"
SPACED = re.compile(r"(?<!\S)(?:\S\s{1,3}){2,}\S(?!\S)")
SENTENCE_END = re.compile(r"(?<=[.!?])\s+|\n+")
INSERTED = ".-*_"
#: A unit can be drawn as a landmark if it stands in so many toxic texts and its chi-square is so large.
LEAST_TEXTS, LEAST_CHI_SQUARE = 3, 10.0
#: Landmarks are drawn until they leave less than this share of all odds uncovered.
COVERED = 0.005
#: A span that stands around another in this share of its texts nearly always does.
NEARLY = 0.8
#: Sentences of other texts weigh this much in all against the positive ones, as a text goes by the worst of its many sentences; and
#: toxic texts are rarer than the sample has them.
OTHER_SENTENCES, OTHER_TEXTS = 10.0, 2.5
ROUNDS = 4
#: As many units as a text has that consists of a landmark with characters put in, for the scale.
MIDDLING_UNITS = 40
#: Units compared at once, so that the tables stay in a core's cache.
CHUNK = 2048


def units(text: str) -> set[str]:
    """The distinct units of a lower-cased text, each after the mark of a beginning."""
    out = {w.strip(OUTER) for w in text.split()}
    for m in SPACED.finditer(text):
        out.add("".join(m[0].split()))
    for w in [w for w in out if len(w) > WIDTH]:
        out.discard(w)
        out.update(w[i : i + WIDTH] for i in range(0, len(w) - WIDTH // 2, WIDTH // 2))
    out.discard("")
    return {START + w for w in out}


def _codes(words: list[str], width: int) -> np.ndarray:
    return np.array(words, dtype=f"U{width}").view(np.uint32).reshape(len(words), width)


def _masks(codes: np.ndarray) -> np.ndarray:
    bits = np.where(codes > 0, np.uint64(1) << (codes & 63).astype(np.uint64), np.uint64(0))
    return np.bitwise_or.reduce(bits, axis=1)


_ALNUM = np.array([chr(c).isalnum() for c in range(128)])


def subsequence_kernel(codes: np.ndarray, landmark: str, order: int) -> np.ndarray:
    """The kernel of each unit (row of character codes, 0 after its end) with a landmark."""
    t = [ord(c) for c in landmark]
    n, one = codes.shape[0], np.float32(1)
    out = np.zeros(n, np.float32)
    prefix = np.zeros((order, len(t) + 1, n), np.float32)
    prefix[0] = 1.0
    columns = np.ascontiguousarray(codes.T)
    fades = np.where((columns < 128) & ~_ALNUM[np.minimum(columns, 127)], np.float32(DECAY_OTHER), np.float32(DECAY))
    for k in range(codes.shape[1]):
        same = {c: (columns[k] == c) * one for c in set(t)}
        for j, c in enumerate(t):
            out += same[c] * prefix[order - 1, j]
        for i in range(order - 1, 0, -1):
            run = np.zeros(n, np.float32)
            for j, c in enumerate(t):
                run *= np.float32(DECAY)
                run += same[c] * prefix[i - 1, j]
                prefix[i, j + 1] *= fades[k]
                prefix[i, j + 1] += run
        # prefix[i, j]: common subsequences of i characters, weighted by what they span up to the ends of both
    return out


def least_shared(landmark: str, order: int) -> int:
    """The fewest distinct characters (by mask bit) that a subsequence of the landmark can have."""
    return min(len({ord(c) & 63 for c in s}) for s in combinations(landmark, order))


def kernels(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Of every unit (row) its kernel with every landmark (column), as a share of the landmark's own, 0 below FLOOR."""
    out = np.zeros((len(words), len(landmarks)), np.float32)
    size = np.fromiter(map(len, words), np.int64, len(words))
    marks = []
    for z in landmarks:
        order, codes = min(ORDER, len(z)), _codes([z], len(z))
        marks.append((z, order, _masks(codes)[0], least_shared(z, order), subsequence_kernel(codes, z, order)[0]))
    low = 0
    for width in (4, 6, 8, 10, 12, 16, 24, WIDTH):
        group = np.flatnonzero((size > low) & (size <= width))
        low = width
        for at in range(0, group.size, 20_000):
            rows = group[at : at + 20_000]
            codes = _codes([words[i] for i in rows.tolist()], width)
            masks = _masks(codes)
            for k, (z, order, mask, least, own) in enumerate(marks):
                some = np.flatnonzero(np.bitwise_count(masks & mask) >= least)
                for b in range(0, some.size, CHUNK):
                    part = some[b : b + CHUNK]
                    out[rows[part], k] = subsequence_kernel(codes[part], z, order) / own
    out[out < FLOOR] = 0
    return out


@dataclass
class Model:
    landmarks: list[str]
    weights: np.ndarray  # of the raw kernels: the machine's weights times the whitening
    bias: float
    scale: np.ndarray
    tag: str = field(default_factory=lambda: uuid.uuid4().hex)

    def score(self, seen: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(seen @ self.scale[:-1] + self.scale[-1], -30, 30)))


def spans(unit: str) -> set[str]:
    """What of a unit can be a landmark: all of it, and its short substrings."""
    return {unit[i : i + n] for n in SPANS for i in range(len(unit) - n + 1)} | ({unit} if len(unit) <= WIDTH // 2 else set())


def draw_landmarks(toxic: list[set[str]], other: list[set[str]], most: int = 48, seed: int = 11) -> list[str]:
    """Spans of units drawn without replacement: the odds go by the square of chi-square, times the square of the share of a span's units in toxic
    texts that no landmark drawn before is part of. A span drawn is widened to the longest that nearly always stands around it."""
    n, m = len(toxic), len(other)
    cut_up = {u: spans(u) for u in set().union(*toxic)}
    bad = Counter(z for found in toxic for z in set().union(*(cut_up[u] for u in found)))
    often = {z for z, k in bad.items() if k >= LEAST_TEXTS}
    good = Counter(z for found in other for z in set().union(*(cut_up[u] if u in cut_up else spans(u) for u in found)) if z in often)
    chi = {}
    for z in often:
        a, b = bad[z] / n, good[z] / m
        chi[z] = (a - b) ** 2 / (a / n + b / m) if a > b else 0.0
    pool = sorted(z for z, x in chi.items() if x >= LEAST_CHI_SQUARE)
    if not pool:
        return []
    times = Counter(u for found in toxic for u in found)
    holders: dict[str, dict[str, int]] = {z: {} for z in pool}
    for u, k in times.items():
        for z in cut_up[u] & holders.keys():
            holders[z][u] = k
    whole = {z: sum(h.values()) for z, h in holders.items()}
    odds, rng, out = np.array([chi[z] for z in pool]) ** 2, np.random.default_rng(seed), []
    left, enough = odds, COVERED * odds.sum()
    while len(out) < most and left.sum() > enough:
        drawn = pool[int(np.searchsorted(np.cumsum(left), rng.random() * left.sum(), side="right").clip(0, len(pool) - 1))]
        near = [z for z in pool if drawn in z and chi[z] >= NEARLY * chi[drawn] and bad[z] >= NEARLY * bad[drawn]]
        wide = max(near, key=lambda z: (len(z), z))
        if wide not in out:
            out.append(wide)
        for h in holders.values():
            for u in [u for u in h if drawn in u]:
                del h[u]
        left = odds * np.array([sum(holders[z].values()) / whole[z] for z in pool]) ** 2
    return out


def one_of_copies(texts: list[str]) -> list[str]:
    """Texts without those whose eight smallest unit hashes came before, so that copies don't count as so many witnesses."""
    seen: dict[tuple[int, ...], str] = {}
    for t in texts:
        seen.setdefault(tuple(heapq.nsmallest(8, (zlib.crc32(u.encode()) for u in units(t)))), t)
    return list(seen.values())


def stretched(word: str, extra: int) -> str:
    """The word with ``extra`` characters put in, always at the same places."""
    out = list(word)
    for k in range(extra):
        out.insert(1 + (k * 2 + extra) % max(1, len(out) - 1), INSERTED[(len(word) + k) % len(INSERTED)])
    return "".join(out)


def fit_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-4, rounds: int = 50) -> np.ndarray:
    """Weights (the last one the bias) of the squared-hinge machine, by Newton steps."""
    x1 = np.hstack((x, np.ones((len(x), 1))))
    w = np.zeros(x1.shape[1])
    ridge = np.diag(np.append(np.full(x.shape[1], penalty), 1e-6))
    for _ in range(rounds):
        active = y * (x1 @ w) < 1
        xa = x1[active] * weight[active, None]
        step = np.linalg.solve(xa.T @ x1[active] + ridge, xa.T @ y[active])
        if np.allclose(step, w, atol=1e-9):
            break
        w = step
    return w


def fit_scale(x: np.ndarray, label: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights (the last one the offset) of the logistic scale; labels are pulled in a little, so the fit stays finite."""
    n1, n0 = label.sum(), (~label).sum()
    target = np.where(label, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, w = np.hstack((x, np.ones((len(x), 1)))), np.zeros(x.shape[1] + 1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (weight * (p * (1 - p) + 1e-6))[:, None]).T @ x + 1e-2 * np.eye(w.size)
        step = np.linalg.solve(hess, x.T @ (weight * (target - p)) - 1e-2 * w)
        w = w + step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-7:
            break
    return w


def evidence(decisions: list[float], bias: float, n_units: int) -> tuple[float, float, float]:
    """What the scale looks at: the most toxic sentence, how many are toxic, and how dense they stand."""
    if not decisions:
        return bias, 0.0, 0.0
    many = float((1 / (1 + np.exp(-4 * np.array(decisions)))).sum())
    return max(decisions), float(np.log1p(many)), many / n_units**0.5


def sentence_features(text: str, found: set[str], rows: dict[str, np.ndarray]) -> list[np.ndarray]:
    """Of a text with these units the features of each sentence that has any; rows are the units' kernels where not all are 0."""
    active = [u for u in found if u in rows]
    if len(active) < 2:
        return [rows[u] for u in active]
    out, met, every = [], set(), set(active)
    for s in SENTENCE_END.split(text):
        mine = units(s) & every
        if mine:
            met |= mine
            out.append(np.maximum.reduce([rows[u] for u in mine]))
    return out + [rows[u] for u in active if u not in met]  # a unit that spans two sentences stands by itself


def active_rows(words: list[str], landmarks: list[str]) -> dict[str, np.ndarray]:
    x = kernels(words, landmarks)
    return {words[i]: x[i] for i in np.flatnonzero(x.any(axis=1)).tolist()}


def train(toxic: list[str], other: list[str]) -> Model | None:
    """A model of lower-cased texts."""
    toxic, other = one_of_copies(toxic), one_of_copies(other)
    bad, good = [units(t) for t in toxic], [units(t) for t in other]
    landmarks = draw_landmarks(bad, good) if bad and good else []
    if not landmarks:
        return None
    rows = active_rows(sorted(set().union(*bad, *good)), landmarks)
    shown, clean = [sentence_features(t, u, rows) for t, u in zip(toxic, bad)], [sentence_features(t, u, rows) for t, u in zip(other, good)]
    own = kernels(landmarks, landmarks).astype(np.float64)
    values, vectors = np.linalg.eigh((own + own.T) / 2 + 1e-3 * np.eye(len(landmarks)))
    whiten = vectors @ np.diag(np.maximum(values, 1e-3) ** -0.5) @ vectors.T
    negative = np.array([f for found in clean for f in found] + [np.zeros(len(landmarks))], np.float64)
    positive = [(np.array(f, np.float64), np.full(len(f), 1 / len(f))) for f in shown if f]
    if not positive:
        return None
    forms = [(z, [z, *(stretched(z, k) for k in (1, 2, 3)), *([".".join(z)] if len(z) <= WIDTH // 2 else [])]) for z in landmarks]
    form_rows = kernels([w for _, f in forms for w in f], landmarks).astype(np.float64)
    form_of = np.repeat(np.arange(len(forms)), [len(f) for _, f in forms])
    weights, bias = None, 0.0
    for _ in range(ROUNDS):
        if weights is None:
            p, share, extra = np.vstack([x for x, _ in positive]), np.concatenate([w for _, w in positive]), np.zeros((0, len(landmarks)))
        else:
            p, share = np.stack([x[(x @ weights).argmax()] for x, _ in positive]), np.ones(len(positive))
            extra = form_rows[(own @ weights + bias > 0)[form_of]]
        x = np.vstack((p, extra, negative)) @ whiten
        y = np.concatenate((np.ones(len(p) + len(extra)), -np.ones(len(negative))))
        weight = np.concatenate((share / share.sum(), np.full(len(extra), 0.5 / max(1, len(extra))), np.full(len(negative), OTHER_SENTENCES / len(negative))))
        w = fit_svm(x, y, weight)
        weights, bias = whiten @ w[:-1], float(w[-1])
    looked = lambda found, texts: [evidence([float(f @ weights) + bias for f in x], bias, len(u)) for x, u in zip(found, texts)]
    # the scale is fitted to what a text shows: a toxic text without a sentence in question tells nothing of the scale
    marked = [x for x in looked(shown, bad) if x[1] > 0]
    forms = [evidence([d], bias, MIDDLING_UNITS) for d in (extra @ weights + bias).tolist()]
    x = np.array(marked + forms + looked(clean, good))
    label = np.arange(len(x)) < len(marked) + len(forms)
    weight = np.concatenate((np.ones(len(marked)), np.full(len(forms), len(marked) / max(1, len(forms))), np.full(len(clean), OTHER_TEXTS)))
    return Model(landmarks, weights, bias, fit_scale(x, label, weight))


#: Of the model of that tag: the kernels of units met by this Python worker, and units without any, up to a bound.
_MET: dict[str, tuple[dict[str, np.ndarray], set[str]]] = {}
MOST_MET = 400_000


def decide(model: Model, texts: list[str]) -> np.ndarray:
    """The evidence in each text."""
    if model.tag not in _MET:
        _MET.clear()
    rows, none = _MET.setdefault(model.tag, ({}, set()))
    if len(none) + len(rows) > MOST_MET:
        rows.clear()
        none.clear()
    found = [units(t) for t in texts]
    new = [u for u in set().union(*found) if u not in rows and u not in none] if found else []
    got = active_rows(new, model.landmarks)
    rows.update(got)
    none.update(u for u in new if u not in got)
    return np.array([evidence([float(f @ model.weights) + model.bias for f in sentence_features(t, u, rows)], model.bias, len(u)) for t, u in zip(texts, found)])


def training_rows(docs: DataFrame, labels: DataFrame, sample_rows: int, sample_bytes: int, label_col: str, id_col: str, text_col: str) -> dict[int, list[str]]:
    """The texts drawn of each label. Ids with a usable text are joined with the labels before the draw; a bound on the hash comes first, so that few rows
    are ordered, and of the texts only those drawn move, one of each id."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).distinct()
    usable = docs.where(F.col(text_col).isNotNull() & (F.octet_length(text_col) <= sample_bytes)).select(F.col(id_col).alias("_given"), F.lower(text_col).alias("_text"))
    held = cut(known.join(usable.select("_given").distinct(), F.col("_id") == F.col("_given")).select("_id", "_label", F.pmod(F.xxhash64("_id"), F.lit(1 << 40)).alias("_hash")))
    sizes = {r[0]: r[1] for r in held.groupBy("_label").count().collect()}
    bound = F.coalesce(*(F.when(F.col("_label") == k, F.lit(int(min(1.0, 2.0 * sample_rows / n) * (1 << 40)))) for k, n in sorted(sizes.items())), F.lit(0))
    by_hash = Window.partitionBy("_label").orderBy("_hash", "_id")
    drawn = held.where(F.col("_hash") <= bound).withColumn("_nth", F.row_number().over(by_hash)).where(F.col("_nth") <= sample_rows)
    rows = usable.join(F.broadcast(drawn), F.col("_given") == F.col("_id")).groupBy("_label", "_nth").agg(F.min("_text").alias("_text")).collect()
    return {k: [r[2] for r in sorted(rows) if r[0] == k] for k in (0, 1)}


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 1000, sample_bytes: int = 1 << 18, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """A model of docs with labels."""
    of = training_rows(docs, labels, sample_rows, sample_bytes, label_col, id_col, text_col)
    return train(of[1], of[0])


SLICE = 1000


def score(docs: DataFrame, model: Model | None, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", extra: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, extra columns, score, predicted) of every document."""
    extra = extra or {}
    given = docs.select(id_col, *(c.alias(k) for k, c in extra.items()), F.lower(F.coalesce(text_col, F.lit(""))).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, max(1, whole.num_rows), SLICE):
                b = whole.slice(at, SLICE)
                s = model.score(decide(model, b.column(b.num_columns - 1).to_pylist())) if model else np.zeros(b.num_rows)
                made = [pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], names=[*b.schema.names[:-1], "score", "predicted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1])
    return map_arrow(given, run, f"{schema}, score double, predicted int")
