"""Language identification by prediction by partial matching.

Each language has a variable-order byte context tree with counts from its training texts. The frozen trees
give the code length of a byte after its context: -log2(n / (N + q)) where the context knows the byte
(n of its N bytes, q distinct), else the escape -log2(q / (N + q)) and the same question in the next
shorter context, down to eight bits for a byte without context. A text goes to the language with the
shortest code. For speed the trees are compiled, once for each Python worker, into sorted tables of the contexts and
grams seen, of each length; a batch looks up only its distinct grams. The tables grow with what was seen and not with the
number of byte values, so the order is the same for every alphabet and number of languages.

Texts are lower-cased; ASCII bytes that aren't letters separate words, and runs of separators count as one.

Training: at most ``sample_rows`` distinct texts of each language (those with the smallest text hashes), each of at most
``sample_bytes`` bytes; texts are otherwise used whole, and every text is scored whole.

Defined results: null texts and texts without a letter get ``und`` with score 0; ties go to the language
that sorts first; with no training text all get ``und``; an empty table gives an empty result; repeated rows
are scored one by one; other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skarn.functions.runtime import map_arrow

PAD = 3
LETTERS = bytes(range(97, 123))
_COMPILED: dict[str, list[list[tuple[np.ndarray, ...]]]] = {}
CHUNK = 1 << 20


@dataclass
class Model:
    langs: list[str]
    classes: bytes  # the class of each byte value: 0 separator, the last class for bytes never seen in training
    counts: list[tuple[np.ndarray, np.ndarray]]  # of each language: (order+1)-gram codes and how often each came
    order: int
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    @property
    def size(self) -> int:
        return max(self.classes) + 1


#: Bytes that separate words become spaces, all others stay.
SEPARATE = bytes(b if b >= 128 or b in LETTERS else 32 for b in range(256))


def body(text: bytes) -> bytes:
    return b" ".join(text.translate(SEPARATE).split()) + b" "


def codes(classes: np.ndarray, order: int, size: int) -> np.ndarray:
    """The code of each byte with the ``order`` bytes before it."""
    n = classes.size - order
    out = np.zeros(max(n, 0), np.int64)
    for k in range(order + 1):
        out *= size
        out += classes[k : k + n]
    return out


def train(texts: dict[str, list[bytes]], order: int = PAD) -> Model:
    langs = sorted(texts)
    bodies = {lang: [body(t) for t in texts[lang]] for lang in langs}
    seen = sorted({b for lang in langs for t in bodies[lang] for b in t} - {32})
    classes = bytearray([len(seen) + 1]) * 256
    classes[32] = 0
    for k, b in enumerate(seen):
        classes[b] = k + 1
    size = len(seen) + 2
    counts = []
    for lang in langs:
        each = [np.unique(codes(np.frombuffer((b" " * order + t).translate(bytes(classes)), np.uint8), order, size), return_counts=True) for t in bodies[lang]]
        grams, at = np.unique(np.concatenate([g for g, _ in each]), return_inverse=True)
        counts.append((grams, np.bincount(at, np.concatenate([n for _, n in each])).astype(np.int64)))
    return Model(langs, bytes(classes), counts, order)


def compile_tables(m: Model) -> list[list[tuple[np.ndarray, ...]]]:
    """Of each language and context length: the grams seen, their bits, the contexts seen, the bits of their escapes."""
    if m.key not in _COMPILED:
        _COMPILED.clear()
        out = []
        for code, n in m.counts:
            levels = []
            for k in range(m.order + 1):
                grams, at = np.unique(code % m.size ** (k + 1), return_inverse=True)
                times = np.bincount(at, n).astype(np.float64)
                contexts, of = np.unique(grams // m.size, return_inverse=True)
                total, distinct = np.bincount(of, times), np.bincount(of)
                levels.append((grams, -np.log2(times / (total + distinct)[of]), contexts, -np.log2(distinct / (total + distinct))))
            out.append(levels)
        _COMPILED[m.key] = out
    return _COMPILED[m.key]


def _find(table: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of x in a sorted table, and which of them are there."""
    at = np.minimum(np.searchsorted(table, x), table.size - 1)
    return at, table[at] == x


def gram_bits(levels: list[tuple[np.ndarray, ...]], code: np.ndarray, size: int) -> np.ndarray:
    """Bits of the last byte of each gram after the bytes before it, in one language."""
    bits, left = np.zeros(code.size), np.arange(code.size)
    for k in range(len(levels) - 1, -1, -1):
        grams, cost, contexts, escape = levels[k]
        g = code[left] % size ** (k + 1)
        at, hit = _find(grams, g)
        bits[left[hit]] += cost[at[hit]]
        left, g = left[~hit], g[~hit]
        at, known = _find(contexts, g // size)
        # bytes unknown in the context cost the escape besides what the next shorter context asks
        bits[left[known]] += escape[at[known]]
    bits[left] += 8
    return bits


def code_lengths(m: Model, texts: list[bytes]) -> np.ndarray:
    """Bits of each whole text (row) in each language (column)."""
    tables, out = compile_tables(m), np.zeros((len(texts), len(m.langs)))
    parts, owner, held = [], [], 0

    def flush() -> None:
        nonlocal parts, owner, held
        if parts:
            ends = np.cumsum([len(p) for p in parts])
            code = codes(np.frombuffer(b"".join(parts), np.uint8), m.order, m.size)
            # of each part from its first byte after the context; the next part's context is skipped
            edges = np.stack((np.concatenate(([0], ends[:-1])), ends - m.order), 1).reshape(-1)[:-1]
            distinct, place = np.unique(code, return_inverse=True)
            for k, levels in enumerate(tables):
                np.add.at(out[:, k], owner, np.add.reduceat(gram_bits(levels, distinct, m.size)[place], edges)[::2])
        parts, owner, held = [], [], 0

    for i, text in enumerate(texts):
        coded = (b" " * m.order + body(text)).translate(m.classes)
        for at in range(m.order, len(coded), CHUNK):
            parts.append(coded[at - m.order : at + CHUNK])
            owner.append(i)
            held += len(parts[-1])
            if held >= CHUNK:
                flush()
    flush()
    return out


def posterior(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The language with the shortest code, and its share of the probability."""
    best = bits.argmin(1)
    return best, 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)


def training_texts(labelled: DataFrame, sample_rows: int, sample_bytes: int, lang_col: str = "lang", text_col: str = "text") -> dict[str, list[bytes]]:
    """At most sample_rows distinct texts of each language, by hash: a bounded sample, the same at every partitioning and number of copies."""
    known = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.octet_length(text_col) <= sample_bytes))
    known = known.select(lang_col, text_col, F.xxhash64(text_col).alias("hash"))
    share = F.pmod("hash", F.lit(1 << 30)) / float(1 << 30)
    sizes = {r[0]: r[1] for r in known.select(lang_col, "hash").distinct().groupBy(lang_col).count().collect()}
    if not sizes:
        return {}
    take = F.coalesce(*(F.when(F.col(lang_col) == k, F.lit(min(1.0, 2.0 * sample_rows / n))) for k, n in sorted(sizes.items())))
    few = known.where(share < take).distinct()
    few = few.withColumn("nth", F.row_number().over(Window.partitionBy(lang_col).orderBy("hash", text_col))).where(F.col("nth") <= sample_rows)
    out: dict[str, list[bytes]] = {}
    for lang, text in few.select(lang_col, F.lower(text_col)).toLocalIterator():
        out.setdefault(lang, []).append(text.encode())
    return out


def fit(labelled: DataFrame, sample_rows: int = 400, sample_bytes: int = 1 << 18, order: int = PAD) -> Model | None:
    texts = training_texts(labelled, sample_rows, sample_bytes)
    return train(texts, order) if texts else None


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", extra: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, extra columns, lang_pred, score, bits_per_byte) of every document."""
    extra = extra or {}
    lettered = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    given = docs.select(id_col, *(c.alias(k) for k, c in extra.items()), F.when(lettered, F.lower(text_col)).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.num_columns - 1).cast(pa.binary()).to_pylist()
            lang, score, rate = np.full(len(texts), "und", object), np.zeros(len(texts)), np.zeros(len(texts))
            some = [i for i, t in enumerate(texts) if t is not None]
            if some and model:
                bits = code_lengths(model, [texts[i] for i in some])
                best, share = posterior(bits)
                lang[some], score[some] = np.array(model.langs, object)[best], share
                rate[some] = bits.min(1) / [len(body(texts[i])) for i in some]
            made = [pa.array(lang, pa.string()), pa.array(score), pa.array(rate)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], names=[*b.schema.names[:-1], "lang_pred", "score", "bits_per_byte"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1])
    return map_arrow(given, run, f"{schema}, lang_pred string, score double, bits_per_byte double")
