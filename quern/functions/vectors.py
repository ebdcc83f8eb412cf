"""Vector arithmetic in double precision."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W_]+")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Column) -> Column:
    """Unit length; a zero vector becomes null. The length is computed once, not for each component."""
    known = F.array(F.struct(a.alias("v"), norm(a).alias("n")))
    return F.get(F.transform(known, lambda s: F.when(s["n"] > 0, F.transform(s["v"], lambda x: x.cast("double") / s["n"]))), F.lit(0))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def mean_available(*values: Column) -> Column:
    """Mean of the values that are there, null if none is."""
    kept = F.filter(F.array(*[F.nanvl(v.cast("double"), F.lit(None).cast("double")) for v in values]), lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(kept, F.lit(0.0), lambda s, x: s + x), F.size(kept))


class _Hashes(dict):
    """CRC-32 of words met of late."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = zlib.crc32(word.encode())
        return h


_hashes = _Hashes()


def _encode(texts, dim: int) -> np.ndarray:
    """Signed counts of word hashes, unit length; no words give zeros."""
    words = [_WORD.findall((x or "").lower()) for x in texts]
    h = np.array([_hashes[w] for some in words for w in some], np.int64)
    row = np.repeat(np.arange(len(words)), [len(some) for some in words])
    out = np.bincount(row * dim + (h >> 1) % dim, np.where(h & 1, 1.0, -1.0), len(words) * dim).astype(float).reshape(len(words), dim)
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, size, out=out, where=size > 0)


def encoder(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """The stand-in for a text encoder as a function of lists, a row a text."""
    return lambda texts: _encode(texts, dim)


def hashed(text: Column, dim: int = 64) -> Column:
    """A deterministic stand-in for a text encoder, in Arrow batches; null stays null."""

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        v = _encode(s.tolist(), dim).tolist()
        return pd.Series([None if x is None else r for x, r in zip(s, v, strict=True)])

    return run(text)


def hashed_all(texts: Column, dim: int = 64) -> Column:
    """The same for every element of an array of texts; all arrays of a batch go through together."""

    @F.pandas_udf("array<array<double>>")
    def run(s: pd.Series) -> pd.Series:
        v, out, at = _encode([x for some in s if some is not None for x in some], dim).tolist(), [], 0
        for some in s:
            out.append(None if some is None else v[at : at + len(some)])
            at += 0 if some is None else len(some)
        return pd.Series(out)

    return run(texts)


def hashed_bytes(content: Column, dim: int = 64) -> Column:
    """A deterministic stand-in for an image encoder: signed counts of byte values; null or empty content gives null."""

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        def one(x):
            if not x:
                return None
            v = np.bincount((np.frombuffer(x, np.uint8) >> 1) % dim, np.where(np.frombuffer(x, np.uint8) & 1, 1.0, -1.0), dim)
            size = np.linalg.norm(v)
            return list(v / size) if size else list(v)

        return s.map(one, na_action=None)

    return run(content)
