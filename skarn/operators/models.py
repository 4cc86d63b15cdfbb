"""Stand-ins for embedding and reranking models, and the contract that real ones must keep: same length, same order."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def hashed_vector(text: str | None, dims: int = 768, unit: bool = True) -> np.ndarray:
    """Numbers in [-1, 1) from SHA-256 digests of the text and a big-endian counter, scaled to length 1."""
    seed = (text or "").encode()
    digests = (hashlib.sha256(seed + k.to_bytes(4, "big")).digest() for k in range(-(-dims // 8)))
    v = np.frombuffer(b"".join(digests), ">u4")[:dims] / 2.0**31 - 1.0
    size = np.sqrt((v * v).sum())
    return v / size if unit and size else v


def embedder(encode: Callable[[list[str]], list] | None = None, dims: int = 768, batch: int = 32) -> Callable[[Column], Column]:
    """Column of texts -> column of vectors. Texts go to ``encode`` in small batches; a batch that fails or comes back in
    another length leaves null vectors. Without ``encode`` the vectors are hashed."""
    encode = encode or (lambda texts: [hashed_vector(t, dims) for t in texts])

    def embed(text: Column) -> Column:
        @F.pandas_udf("array<float>")
        def run(s: pd.Series) -> pd.Series:
            out: list = []
            for at in range(0, len(s), batch):
                part = ["" if t is None else t for t in s.iloc[at : at + batch]]
                try:
                    got = [np.asarray(v, np.float32) for v in encode(part)]
                except Exception:  # a model's failure must not end the indexing
                    got = []
                out += got if len(got) == len(part) else [None] * len(part)
            return pd.Series(out, index=s.index)

        return run(text)

    return embed
