"""Words of many texts at once, as 64-bit hashes, straight from Arrow buffers.

A word is a maximal run of bytes other than 20 and 09-0D (hex). A-Z count as a-z. Work goes over
pieces of about ``STEP`` bytes cut at word starts, so memory is bounded for texts of any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

STEP = 1 << 19
U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240611))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BYTE[65:91] = _BYTE[97:123]
_CASED = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_P, _Q = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
_powers: tuple[np.ndarray, np.ndarray] | None = None


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    x = x ^ U(salt)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, STEP + (STEP >> 1))
        up = np.full(size, _P, U)
        up[0] = 1
        down = np.full(size, U(pow(int(_P), -1, 2**64)), U)
        down[0] = 1
        with np.errstate(over="ignore"):
            powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size > 4 * STEP:
            return powers
        _powers = powers
    return _powers


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and their offsets; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and where each text's words begin (one more entry than texts)."""
    data, offsets = buffers(texts)
    starts, ends = spans(data, offsets)
    return hashes(data, starts, ends), np.searchsorted(starts, offsets).astype(np.int64)


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of all texts start and end."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~_SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    before[0] = True
    np.logical_not(solid[:-1], out=before[1:])
    starts = np.flatnonzero(solid & (before | cut[:n]))
    after = np.empty(n, bool)
    after[-1] = True
    np.logical_not(solid[1:], out=after[:-1])
    return starts, np.flatnonzero(solid & (after | cut[1:])) + 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, cased: bool = False) -> np.ndarray:
    """Hashes of the words at ``starts`` to ``ends``; ``cased``: A-Z differ from a-z."""
    table = _CASED if cased else _BYTE
    out = np.empty(len(starts), U)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + STEP)))
        at, to = int(starts[lo]), int(ends[hi - 1])
        up, down = _power(to - at)
        with np.errstate(over="ignore"):
            run = np.empty(to - at + 1, U)
            run[0] = 0
            np.cumsum(table[data[at:to]] * up[: to - at], out=run[1:])
            s, e = starts[lo:hi] - at, ends[lo:hi] - at
            out[lo:hi] = mix((run[e] - run[s]) * down[s] + (e - s).astype(U))
        lo = hi
    return out


def fold(h: np.ndarray, n: int) -> np.ndarray:
    """Order-dependent hash of every ``n`` consecutive entries."""
    k = len(h) - n + 1
    if k <= 0:
        return np.zeros(0, U)
    with np.errstate(over="ignore"):
        out = h[:k].copy()
        for j in range(1, n):
            out *= _Q
            out += h[j : j + k]
        return mix(out, n)


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """For every text its sorted distinct ``n``-word shingles; with fewer words, the sequence as one; else empty."""
    h, at = words(texts)
    every = fold(h, n)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= n:
            s = np.sort(every[a : b - n + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            yield s[keep]
        else:
            yield fold(h[a:b], b - a) if b > a else h[:0]


def pieces(batch: pa.RecordBatch, column: str, most: int = 4 * STEP) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text each, at least a row."""
    _, offsets = buffers(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        to = min(to, batch.num_rows)
        yield batch.slice(at, to - at)
        at = to
    pa.default_memory_pool().release_unused()  # a worker is kept for other tasks
