"""Benchmark decontamination by spaced-seed hashing.

Fixed masks read seven of eight to ten neighbouring words and ignore the others. Any window of 13 words that
differs in at most two places agrees on some mask somewhere inside it (the four masks were chosen so), hence
joining mask hashes finds every such window, and checking the alignment around hits leaves no false one.
Shorter items may differ in one place if they are not too short: of three masks that each ignore another third, one agrees.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import scratch
from quern.llm.wordhash import U, fold, mix, pieces, words

#: Word positions that each mask reads.
MASKS = ((0, 1, 2, 3, 5, 6, 7), (0, 1, 2, 4, 7, 8, 9), (0, 1, 2, 3, 4, 5, 6), (0, 1, 2, 4, 5, 6, 7))
WINDOW, MOST_DIFFERENT = 13, 2
#: By default, the shortest items that are searched for; shorter items than ``WINDOW`` that may differ in one place, below none.
SHORTEST, ONE_DIFFERENT = 5, 9
#: Bits of the fixed-size filter (2 MB) that lets most document hashes stop at the scan.
BITS = 1 << 24
#: What stands for a document, by names of its own.
DOC, _DOC = ["_doc", "_tag"], "_doc long, _tag long"


def _hashes(h: np.ndarray, lengths: tuple[int, ...], loose: int) -> Iterator[tuple[np.ndarray, int]]:
    """(hash at every position, span) of each mask, and of plain runs or thirds left out for the given lengths of short items."""
    masks = [(k + 1, mask, mask[-1] + 1) for k, mask in enumerate(MASKS)]
    for n in lengths:
        if n >= loose:
            masks += [(16 * n + k, tuple(j for j in range(n) if not k * n // 3 <= j < (k + 1) * n // 3), n) for k in range(3)]
    with np.errstate(over="ignore"):
        for salt, mask, span in masks:
            n = len(h) - span + 1
            if n > 0:
                out = np.full(n, salt, U)
                for j in mask:
                    out = out * U(0xD6E8FEB86659FD93) + h[j : j + n]
                yield mix(out), span
    for n in lengths:
        if len(h) >= n:
            yield mix(fold(h, n), 0x1F83D9ABFB41BD6B), n


def _seeds(shortest: int, loose: int):
    """Benchmark items: their seeds (hash, item, pos) with the item's words and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                h, at = words(part.column("text"))
                rows = []
                for item, a, b in zip(part.column("item_id").to_pylist(), at[:-1], at[1:], strict=True):
                    if item is None or b - a < shortest:
                        continue
                    own = h[a:b]
                    for x, span in _hashes(own, (int(b - a),) if b - a < WINDOW else (), loose):
                        if b - a >= WINDOW or span == b - a:
                            rows += [(v, item, i) for i, v in enumerate(x.view(np.int64).tolist())]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["hash", "item_id", "item_pos"])

    return run


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "text"):
            h, at = words(part.column("text"))
            raw = [h[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("item_id"), pa.array(np.diff(at)), pa.array(raw, pa.binary())], ["item_id", "n", "words"])


def _hits(bits, lengths: tuple[int, ...], loose: int):
    """Per cluster of filter hits in a document: its place, the words around it, and the hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = bits.value
        for batch in batches:
            for part in pieces(batch, "text"):
                h, at = words(part.column("text"))
                found = []
                for x, _ in _hashes(h, lengths, loose):
                    low = x & U(BITS - 1)
                    at_hit = np.flatnonzero(filter_[(low >> U(3)).astype(np.int64)] >> (low & U(7)).astype(np.uint8) & 1)
                    found.append((at_hit, x[at_hit]))
                if not found:
                    continue
                pos, value = (np.concatenate(c) for c in zip(*found, strict=True))
                if not len(pos):
                    continue
                order = np.argsort(pos, kind="stable")
                pos, value = pos[order], value[order]
                doc = np.searchsorted(at, pos, side="right") - 1
                first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (pos[1:] - pos[:-1] > 2 * WINDOW)]))
                rows = []
                for lo, hi in zip(first, np.append(first[1:], len(pos)), strict=True):
                    d = doc[lo]
                    a, b = max(at[d], pos[lo] - WINDOW), min(at[d + 1], pos[hi - 1] + 2 * WINDOW)
                    rows.append((int(d), int(a - at[d]), h[a:b].tobytes(), (pos[lo:hi] - a).tolist(), value[lo:hi].view(np.int64).tolist()))
                d, start, around, place, hashes = zip(*rows, strict=True)
                ids = [part.column(c).take(pa.array(d)) for c in DOC]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(start, pa.int64()), pa.array(around, pa.binary()), pa.array(place, pa.list_(pa.int32())), pa.array(hashes, pa.list_(pa.int64()))], [*DOC, "start", "around", "places", "hashes"])

    return run


def overlap(doc: np.ndarray, item: np.ndarray, shift: int, window: int = WINDOW, most: int = MOST_DIFFERENT, loose: int = ONE_DIFFERENT) -> int:
    """Equal words of the best qualifying window where item word ``i`` lies at document word ``i + shift``; else 0.

    A window is ``window`` words with at most ``most`` different; items shorter than that must agree whole, but for one
    word if they have ``loose`` or more.
    """
    lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
    w, bad = (window, most) if len(item) >= window else (len(item), int(len(item) >= loose))
    if hi - lo < w:
        return 0
    same = np.concatenate([[0], np.cumsum(doc[lo + shift : hi + shift] == item[lo:hi])])
    best = int((same[w:] - same[:-w]).max())
    return best if best >= w - bad else 0


def _check(loose: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [overlap(np.frombuffer(a, U), np.frombuffer(b, U), s, loose=loose) for a, b, s in zip(*(batch.column(c).to_pylist() for c in ("around", "words", "shift")), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*DOC, "item_id")), pa.array(found, pa.int64())], [*DOC, "item_id", "overlap"]).filter(pa.array([x > 0 for x in found], pa.bool_()))

    return run


def _keyed(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with DOC: its id, or for a null id a hash of its text."""
    none = F.col(doc).isNull()
    return docs.withColumns({DOC[0]: F.coalesce(F.col(doc).cast("long"), F.lit(0)), DOC[1]: F.when(none, F.xxhash64(F.col(text).cast("string")).bitwiseOR(F.lit(1))).otherwise(F.lit(0).cast("long"))})


def leaks(docs: DataFrame, benchmark: DataFrame, shortest: int = SHORTEST, one_different: int = ONE_DIFFERENT) -> DataFrame:
    """(DOC, item_id, overlap): documents with a window of a benchmark item, and its equal words.

    Words are runs of bytes other than white space, A-Z as a-z. A leak is 13 words in a row that equal the
    item's but for two at most. Shorter items must occur whole: but for one word from ``one_different`` words on (3 at least, 9 by
    default), word for word below that, and never below ``shortest`` words (5 by default; such items are ordinary phrases that clean
    documents hold too). Items with
    equal words count as the one with the smallest id. Null texts have no leaks, nor do items without an id; rows that share
    an id are one document, those without an id one for each text (``DOC``); repeated rows change nothing, texts may be of
    any length, other columns are ignored. Any table may be empty.

    The broadcast filter has a fixed size, whatever the benchmark's; a full filter only sends more rows to the
    join, which is a plain equi-join of hashes.
    """
    spark, loose = docs.sparkSession, max(3, one_different)
    scratch.bound_batches(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    items = items.mapInArrow(_words, "item_id long, n long, words binary").where(F.col("n") >= max(1, shortest))
    kept = scratch.table(items.groupBy("words", "n").agg(F.min("item_id").alias("item_id")), "items")
    texts = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    seeds = scratch.table(texts.join(kept.select("item_id").distinct(), "item_id", "left_semi").mapInArrow(_seeds(max(1, shortest), loose), "hash long, item_id long, item_pos long").distinct(), "seeds")

    low = f"(hash & {BITS - 1})"
    cells = seeds.groupBy(F.expr(f"cast({low} div 32 as int)").alias("cell")).agg(F.expr(f"bit_or(shiftleft(1L, cast({low} % 32 as int)))").alias("bits")).collect()
    filter_ = np.zeros(BITS // 32, "<u4")
    for r in cells:  # at most BITS / 32 rows
        filter_[r.cell] = r.bits & 0xFFFFFFFF
    lengths = tuple(sorted(r.n for r in kept.where(F.col("n") < WINDOW).select("n").distinct().collect()))
    shared = spark.sparkContext.broadcast(filter_.view(np.uint8))

    rows = _keyed(docs.select("doc_id", F.col("text").cast("string").alias("text"))).where("text is not null").select(*DOC, "text")
    clusters = scratch.table(rows.mapInArrow(_hits(shared, lengths, loose), f"{_DOC}, start long, around binary, places array<int>, hashes array<long>").distinct(), "clusters")
    hits = clusters.select(*DOC, "start", F.explode(F.arrays_zip("places", "hashes")).alias("h")).select(*DOC, "start", F.col("h.places").alias("place"), F.col("h.hashes").alias("hash"))
    met = hits.join(seeds, "hash").select(*DOC, "start", "item_id", (F.col("place") - F.col("item_pos")).alias("shift")).distinct()
    both = met.join(clusters.select(*DOC, "start", "around"), [*DOC, "start"]).join(kept.select("item_id", "words"), "item_id")
    checked = both.select(*DOC, "item_id", "around", "words", "shift").mapInArrow(_check(loose), f"{_DOC}, item_id long, overlap long")
    return checked.groupBy(*DOC, "item_id").agg(F.max("overlap").alias("overlap"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that leak (see ``leaks`` for the options), null ids included; all columns stay, whatever
    their names. Rows with a null text stay unless another row with their id leaks; texts of any length are read whole."""
    plain, (doc, text) = scratch.numbered(docs, "doc_id", "text")
    found = leaks(docs, benchmark, **options).select(*DOC).distinct()
    return _keyed(plain, doc, text).join(found, DOC, "left_anti").select(*plain.columns).toDF(*docs.columns)


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, contaminated, n_items, item_ids, best_overlap) for every document; see ``leaks`` for the options."""
    found = leaks(docs, benchmark, **options).groupBy(*DOC).agg(F.count("*").alias("n_items"), F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("overlap").alias("best_overlap"))
    out = _keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).drop("text").join(found, DOC, "left")
    return out.select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"), F.coalesce("best_overlap", F.lit(0)).alias("best_overlap"))
