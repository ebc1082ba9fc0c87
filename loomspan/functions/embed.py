"""A deterministic embedder that needs no model: hashed words and word pairs, of unit length."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def hashing_embedder(width: int = 64) -> Callable[[list[str]], list[np.ndarray]]:
    import re
    import zlib

    def embed(texts: list[str]) -> list[np.ndarray]:
        out = []
        for text in texts:
            v = np.zeros(width)
            words = re.findall(r"\w+", (text or "").lower())
            for w in (*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))):
                h = zlib.crc32(w.encode())
                v[h % width] += 1 if h >> 31 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).astype(np.float32))
        return out

    return embed


def embedding(embed: Callable[[list[str]], list[np.ndarray]]):
    """A pandas UDF from text to array<float> by any embedder of lists of texts; null for null."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            some = [t for t in texts if t is not None]
            vectors = iter(embed(some))
            yield pd.Series([None if t is None else next(vectors).tolist() for t in texts])

    return run
