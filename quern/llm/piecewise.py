"""Context-triggered piecewise hashing: fingerprints of texts that tell how much of two texts is the same.

A rolling hash over seven bytes cuts a text into pieces wherever its value is the last one modulo the block size, so cuts depend
on what stands there and not on where it stands. Each piece gives a unit of twelve bits. The block size is 3 times a
power of two, the smallest one with at most ``UNITS - 1`` cuts in the whole text (and no less than a ``16 * UNITS``-th of its
bytes, so that a long text needs few cuts in memory); the fingerprint holds the units at that size and at
twice that size: ``size:units:units``. Two fingerprints are compared where they share a block size, by the edit distance of their
units without substitution.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm import scratch
from quern.llm.wordhash import U, mix

#: Bytes that a cut depends on; most units of the finer signature; smallest block size; bytes worked on together.
WINDOW, UNITS, LEAST, STEP = 7, 64, 3, 1 << 18
_SEED = np.random.Generator(np.random.PCG64(7))
_ROLL = _SEED.integers(1, 2**32, 256, dtype=np.uint64).astype(np.uint32)
_PIECE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_P = 0x9E3779B97F4A7C15
_Q = pow(_P, -1, 2**64)
_powers: np.ndarray | None = None


def _up() -> np.ndarray:
    """Powers of _P for one step."""
    global _powers
    if _powers is None:
        _powers = np.full(STEP, _P, U)
        _powers[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(_powers, out=_powers)
    return _powers


def _triggers(data: np.ndarray) -> np.ndarray:
    """The rolling hash of every byte and the six before it, where there are as many."""
    table = _ROLL[data]
    roll = table.copy()
    with np.errstate(over="ignore"):
        for back in range(1, min(WINDOW, len(data))):
            roll[back:] += table[:-back] * np.uint32(pow(0x01000193, back, 2**32))
        roll ^= roll >> np.uint32(15)
        roll *= np.uint32(0x2C1B3C6D)
        return roll ^ roll >> np.uint32(12)


def _cuts(data: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ends, rolling hashes, sums of all bytes before them) of the pieces at block size ``size``, a step at a time."""
    ends, rolls, sums, base, lift = [], [], [], U(0), 1
    with np.errstate(over="ignore"):
        for at in range(0, len(data), STEP):
            some = data[at : at + STEP]
            before = max(0, at - WINDOW + 1)
            roll = _triggers(data[before : at + len(some)])[at - before :]
            hit = np.flatnonzero(roll % np.uint32(size) == size - 1)
            run = np.cumsum(_PIECE[some] * _up()[: len(some)])
            ends.append(hit + at + 1)
            rolls.append(roll[hit].astype(np.int64))
            sums.append(base + U(lift) * run[hit])
            base = base + U(lift) * run[-1]
            lift = lift * pow(_P, len(some), 2**64) % 2**64
    total = np.array([base], U)
    return np.concatenate([*ends, [len(data)]]), np.concatenate(rolls), np.concatenate([*sums, total])


def _units(ends: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Twelve bits for each piece, which depend on its bytes alone; the last piece may have no byte and then gives none."""
    starts = np.concatenate([[0], ends[:-1]])
    with np.errstate(over="ignore"):
        own = (sums - np.concatenate([np.zeros(1, U), sums[:-1]])) * np.array([pow(_Q, int(s), 2**64) for s in starts], U)
        return (mix(own ^ mix((ends - starts).astype(U))) >> U(52)).astype(np.uint16)[ends > starts]


def _text(units: np.ndarray) -> str:
    """Two characters a unit."""
    n = len(units)
    bits = np.zeros((n + n % 2, 12), np.uint8)
    bits[:n] = units[:, None] >> np.arange(11, -1, -1, dtype=np.uint16) & 1
    return base64.b64encode(np.packbits(bits.ravel()).tobytes()).decode()[: 2 * n]


def fingerprint(data: bytes) -> str:
    """``size:units:units`` of the whole of ``data``; ``3::`` for no bytes."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return f"{LEAST}::"
    size = LEAST
    while size * UNITS * 16 <= len(raw):
        size *= 2
    ends, rolls, sums = _cuts(raw, size)
    while len(rolls) > UNITS - 1:
        size, use = 2 * size, rolls % (2 * size) == 2 * size - 1
        keep = np.append(use, True)
        ends, rolls, sums = ends[keep], rolls[use], sums[keep]
    keep = np.append(rolls % (2 * size) == 2 * size - 1, True)
    return f"{size}:{_text(_units(ends, sums))}:{_text(_units(ends[keep], sums[keep]))}"


def distance(a: list[str], b: list[str]) -> int:
    """Units to take out and put in to turn ``a`` into ``b``: a row of the table of longest common subsequences at a time, in the
    bits of one number."""
    at: dict[str, int] = {}
    for k, unit in enumerate(a):
        at[unit] = at.get(unit, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for unit in b:
        met = row & at.get(unit, 0)
        row = (row + met | row - met) & full
    return len(a) + len(b) - 2 * (len(a) - row.bit_count())


def likeness(one: str, other: str) -> float:
    """0 to 1: 1 for equal fingerprints, else the larger of 1 - distance / units at the block sizes that both have, else 0."""
    if one == other:
        return 1.0
    sides = []
    for text in (one, other):
        size, *found = text.split(":")
        sides.append({int(size) << k: [x[i : i + 2] for i in range(0, len(x), 2)] for k, x in enumerate(found)})
    best = 0.0
    for size in sides[0].keys() & sides[1].keys():
        a, b = sides[0][size], sides[1][size]
        if a and b:
            best = max(best, 1 - distance(a, b) / (len(a) + len(b)))
    return best


def edited(text: str, following: str) -> str:
    """``text`` with its last half, rounded down, replaced by as much of ``following`` as there is."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_DONE = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _result(doc: int | None, text: str, own: str, following: str, its: str) -> tuple:
    new = edited(text, following).encode()
    print_ = fingerprint(new)
    return doc, len(text), hashlib.sha256(new).hexdigest(), own, print_, likeness(own, print_), likeness(own, its)


def _batch(rows: list[tuple], names: list[str], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, schema.field(n).type) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names)


_ROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((n, pa.string()) for n in _DONE[2:5]), *((n, pa.float64()) for n in _DONE[5:]), ("part", pa.int32()), ("role", pa.int8()), ("text", pa.string())])
#: What a stored row is: a result, the first row of a range, or its last, which waits for the next range's first.
_RESULT, _FIRST, _LAST = range(3)


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text) of one range in order, each with the one after it; one batch and one row are held."""
    part, held = TaskContext.get().partitionId(), None
    names = _ROW.names
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            text = text.as_py() or ""
            own = fingerprint(text.encode())
            if held is None:
                rows.append((doc, None, None, own, None, None, None, part, _FIRST, text))
            else:
                rows.append((*_result(*held, text, own), part, _RESULT, None))
            held = doc, text, own
        if rows:
            yield _batch(rows, names, _ROW)
    if held is not None:
        yield _batch([(held[0], None, None, held[2], None, None, None, part, _LAST, held[1])], names, _ROW)


def _over_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("doc_id", "text", "fingerprint", "following", "its"))
        rows = [_result(doc, text or "", own, following or "", its) for doc, text, own, following, its in zip(*columns, strict=True)]
        if rows:
            yield _batch(rows, _DONE, _ROW)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row of ``docs``.

    The next document is the next row by doc_id, nulls first, rows with equal ids by a hash of their texts; after the last row
    comes the first, which may be the same one. A null text counts as empty: no units, likeness 1 to another empty one and 0
    to any other text. Equal texts have equal fingerprints, whatever their ids. Texts of any length are worked on whole, in
    steps. Other columns are ignored. An empty table gives no rows.

    Texts are dealt by ranges once, so that most rows meet the next one in their own task; the first and last row of each range are
    stored with their texts and meet afterwards.
    """
    scratch.bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    found = scratch.table(dealt.mapInArrow(_in_order, f"{_SCHEMA}, part int, role tinyint, text string"), "prints")
    first = found.where(F.col("role") == _FIRST).select(F.col("part").alias("at"), F.col("text").alias("following"), F.col("fingerprint").alias("its"))
    parts = first.select("at")  # a row a range
    after = parts.withColumn("to", F.coalesce(F.lead("at").over(Window.orderBy("at")), F.min("at").over(Window.partitionBy())))
    last = found.where(F.col("role") == _LAST).select("doc_id", "text", "fingerprint", "part")
    met = last.join(after.withColumnRenamed("at", "part"), "part").join(first.withColumnRenamed("at", "to"), "to")
    rest = met.select("doc_id", "text", "fingerprint", "following", "its").mapInArrow(_over_edges, _SCHEMA)
    return found.where(F.col("role") == _RESULT).select(*_DONE).unionByName(rest)
