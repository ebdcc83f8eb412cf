"""Token ids in Simple-8b words, in files with a dictionary and block offsets.

A word has a selector in its top four bits and up to 60 values below, first value lowest. Values are ranks of
ids by frequency in the file, so common ids are small; ids without a rank are escaped, one to a word. Every
block of ``BLOCK`` ids begins a word of its own, and the file lists where.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm import scratch
from quern.llm.bpe import words
from quern.llm.wordhash import pieces

U = np.uint64
#: Format: (values, bits of each) by selector; the last selector is the escape, a raw id in 60 bits.
SELECTORS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE, BLOCK, RANKS = 15, 1 << 16, 1 << 16
MAGIC, HEAD = b"S8BK", "<4sIIIQII"
PER_FILE = 8_000_000


#: Bits that a rank takes, at least one.
_BITS = np.ceil(np.log2(np.maximum(np.arange(RANKS), 1) + 1.0)).astype(np.int8)


def pack(ranks: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Words for one block. ``ranks`` below 0 are escaped with their ``raw`` id."""
    n = len(ranks)
    bits = np.append(_BITS, np.int8(99))[ranks]  # the last entry serves -1
    best, at = np.full(n, ESCAPE, np.int8), np.arange(n, dtype=np.int32)
    top = int(bits.max(initial=1, where=bits < 99))
    for s in range(len(SELECTORS) - 1, -1, -1):
        count, width = SELECTORS[s]
        if s and SELECTORS[s - 1][1] >= top:
            continue  # a selector with more values holds all that this one does
        over = np.where(bits > width, at, np.int32(n + 64))
        free = np.minimum.accumulate(over[::-1])[::-1] - at
        best[free >= count] = s
    starts, i, steps = [], 0, np.where(best == ESCAPE, 1, np.array([c for c, _ in SELECTORS] + [1, 1])[best]).tolist()
    while i < n:
        starts.append(i)
        i += steps[i]
    start = np.array(starts, np.int64)
    chosen, out = best[start], np.zeros(len(start), U)
    padded = np.concatenate([np.maximum(ranks, 0), np.zeros(64, ranks.dtype)]).astype(U)
    for s, (count, width) in enumerate(SELECTORS):
        if len(k := np.flatnonzero(chosen == s)):
            word = np.full(len(k), U(s) << U(60))
            for j in range(count):
                word |= padded[start[k] + j] << U(j * width)
            out[k] = word
    k = np.flatnonzero(chosen == ESCAPE)
    out[k] = (U(ESCAPE) << U(60)) | raw[start[k]].astype(U)
    return out


def unpack(words: np.ndarray, n: int, ids: np.ndarray) -> np.ndarray:
    """The ``n`` ids of a block of words; ``ids`` by rank."""
    chosen = (words >> U(60)).astype(np.int64)
    counts = np.array([c for c, _ in SELECTORS] + [1, 1])[chosen]
    at = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(int(at[-1]), np.int64)
    for s, (count, width) in enumerate(SELECTORS):
        if len(k := np.flatnonzero(chosen == s)):
            mask = U((1 << width) - 1)
            for j in range(count):
                out[at[k] + j] = ids[np.minimum((words[k] >> U(j * width)) & mask, U(max(len(ids) - 1, 0))).astype(np.int64)]
    k = np.flatnonzero(chosen == ESCAPE)
    out[at[k]] = (words[k] & U((1 << 60) - 1)).astype(np.int64)
    return out[:n]


def write_file(part: int, seq: int, doc_ids: list, lengths: list[int], ids: np.ndarray) -> bytes:
    """A file of documents, less its closing newline."""
    if len(ids) and ids.max() < 1 << 20:  # a table of counts instead of a sort
        every = np.bincount(ids)
        known = np.flatnonzero(every)
        count, place = every[known], np.zeros(len(every), np.int32)
        place[known] = np.arange(len(known), dtype=np.int32)
        inverse = place[ids]
    else:
        known, inverse, count = np.unique(ids, return_inverse=True, return_counts=True)
    order = np.argsort(-count, kind="stable")[:RANKS]
    rank = np.full(len(known), -1, np.int64)
    rank[order] = np.arange(len(order))
    blocks = [pack(rank[inverse[i : i + BLOCK]], ids[i : i + BLOCK]) for i in range(0, len(ids), BLOCK)]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<u8")
    head = struct.pack(HEAD, MAGIC, part, seq, len(doc_ids), len(ids), len(order), len(blocks))
    valid = np.array([d is not None for d in doc_ids], "u1")
    names = np.array([d or 0 for d in doc_ids], "<i8")
    return b"".join([head, valid.tobytes(), names.tobytes(), np.array(lengths, "<u4").tobytes(), known[order].astype("<u4").tobytes(), offsets.tobytes(), *(b.astype("<u8").tobytes() for b in blocks)])


def read_file(data: bytes, with_ids: bool = True) -> tuple[int, int, list, np.ndarray, np.ndarray]:
    """(part, seq, doc ids, lengths, ids) of a file."""
    magic, part, seq, n_docs, n_ids, n_ranks, n_blocks = struct.unpack_from(HEAD, data)
    if magic != MAGIC:
        raise ValueError("not a file of this format")
    at = struct.calcsize(HEAD)

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, n, at)
        at += out.nbytes
        return out

    valid, names, lengths = take("u1", n_docs), take("<i8", n_docs), take("<u4", n_docs)
    known, offsets = take("<u4", n_ranks).astype(np.int64), take("<u8", n_blocks + 1).astype(np.int64)
    docs = [int(d) if v else None for d, v in zip(names, valid, strict=True)]
    if not with_ids:
        return part, seq, docs, lengths, np.zeros(0, np.int64)
    words = take("<u8", int(offsets[-1]))
    blocks = [unpack(words[a:b], min(BLOCK, n_ids - i * BLOCK), known) for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True))]
    return part, seq, docs, lengths, np.concatenate(blocks) if blocks else np.zeros(0, np.int64)


def write(docs: DataFrame, vocabulary: str, path: str, end_id: int = 0, per_file: int = PER_FILE) -> None:
    """Encodes whole texts (null: empty) and writes them under ``path`` in ascending order of doc_id.

    Null ids come first; equal ids are ordered by text. Each document gets ``end_id`` at its end. Tasks hold
    about one file of ``per_file`` ids at a time, or one longer document. Other columns are ignored; an empty table
    leaves no file.
    """
    scratch.bound_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").drop("tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part, seq = words(vocabulary), TaskContext.get().partitionId(), 0
        names, lengths, held = [], [], []

        def file() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([write_file(part, seq, names, lengths, np.concatenate(held).astype(np.int64))], pa.binary())], ["blob"])

        for batch in batches:
            for some in pieces(batch, "text"):
                ids, n = known.encode(some.column("text"))
                names += some.column("doc_id").to_pylist()
                lengths += (n + 1).tolist()
                held.append(np.insert(ids, np.cumsum(n), end_id))
                if sum(map(len, held)) >= per_file:
                    yield file()
                    names, lengths, held, seq = [], [], [], seq + 1
        if names:
            yield file()

    scratch.write_files(rows.mapInArrow(run, "blob binary"), "blob", path)


def read(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files, in whose order ``start`` counts."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, s, int(n.sum())) for p, s, _, n, _ in (read_file(x, False) for x in batch.column("content").to_pylist())]
            part, seq, n = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(seq, pa.int64()), pa.array(n, pa.int64())], ["part", "seq", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column("content"):
                part, seq, docs, lengths, ids = read_file(x.as_py())
                at = np.concatenate([[0], np.cumsum(lengths.astype(np.int64))])
                raw = ids.astype("<u4")
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(at[:-1]), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64()), pa.array([part] * len(docs), pa.int64()), pa.array([seq] * len(docs), pa.int64())], ["doc_id", "inside", "n_tokens", "ids_crc32", "part", "seq"])

    files = scratch.read_files(spark, path).select("content")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    first = files.mapInArrow(sizes, "part long, seq long, n long").select("part", "seq", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    rows = files.mapInArrow(run, "doc_id long, inside long, n_tokens long, ids_crc32 long, part long, seq long")
    return rows.join(first, ["part", "seq"]).select("doc_id", (F.col("first") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def roundtrip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Writes ``docs`` to the shared folder and reports on what the files hold; an empty table gives no rows."""
    path = scratch.folder(docs.sparkSession, "ids")
    write(docs, vocabulary, path)
    return read(docs.sparkSession, path)
