"""An exact index of vectors by cells, kept as a table, and its search by bounds.

Every vector goes to the nearest of a bounded number of pivots, which are drawn from the corpus. A cell knows how far its
furthest vector is from its pivot, so the angle between a question and a pivot bounds every cosine in the cell. A
search visits the nearest cell first, which fixes the score that others must beat, and then only the cells whose bound reaches
that score. The pivots alone go to all tasks. Vectors and questions meet by group of cells: a question goes once to each group,
with the names of the cells that it visits there, and a group's answer is its best few, so that neither grows with the cells.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.sources.shared import folder, stored

#: Cells at most; vectors of a block at most; vectors dealt by one more salt; questions that meet a copy of a group, about.
CELLS, BLOCK, SALTED, VISITS = 1024, 4096, 1 << 22, 50_000
#: Vectors of a group, about, and bytes of them.
HELD, BYTES = 32_768, 16 << 20
#: Room for errors of double precision in bounds (radians, cosines).
SLACK = 1e-7
#: Decimals by which scores are told apart; equal ones go by id.
PLACES = 12


def units(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows that are usable, their vectors at unit length): not null, without null or non-finite components, not zero."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    row = np.repeat(np.arange(len(lengths)), lengths)
    bad = np.bincount(row, ~np.isfinite(flat), len(lengths)) > 0
    top = np.zeros(len(lengths))
    np.maximum.at(top, row, np.where(np.isfinite(flat), np.abs(flat), 0.0))
    use = (lengths > 0) & ~bad & (top > 0)
    kept = np.flatnonzero(use)
    if not len(kept):
        return kept, np.zeros((0, 0))
    if len(set(lengths[kept].tolist())) > 1:
        raise ValueError("vectors differ in length")
    v = flat[use[row]].reshape(len(kept), -1) / top[kept, None]
    return kept, v / np.linalg.norm(v, axis=1, keepdims=True)


def best(q: np.ndarray, own: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, score) of the best ``k`` of ``v`` for every row of ``q``, ties by id."""
    s = q @ v.T
    if s.shape[1] > k:  # all that may tie with the k-th
        edge = np.partition(s, -k, axis=1)[:, -k]
        r, c = np.nonzero(s >= edge[:, None] - 2e-12)
    else:
        r, c = (x.ravel() for x in np.indices(s.shape))
    score, ids = s[r, c], own[c]
    return _least(r, ids, score, k)


def _least(r: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -score.round(PLACES), r))
    r, ids, score = r[order], ids[order], score[order]
    keep = np.arange(len(r)) - np.searchsorted(r, r) < k
    return r[keep], ids[keep], score[keep]


def best_of(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best ``k`` of every row of what ``best`` has found in several blocks."""
    return _least(*(np.concatenate(x) for x in zip(*found, strict=True)), k)


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def _dealt(pivots):
    """(cell, salt, id, v, far): each usable vector with its nearest pivot and how far that is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pivots.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 8192):
                some = batch.slice(lo, 8192)
                kept, v = units(some.column("v"))
                if not len(kept):
                    continue
                s = v @ p.T
                cell = s.argmax(axis=1)
                far = _angle(s[np.arange(len(v)), cell])
                ids = some.column("vec_id").take(pa.array(kept))
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), ids, pa.array([x.tobytes() for x in v], pa.binary()), pa.array(far)], ["cell", "vec_id", "v", "far"])

    return run


_TABLE = "cell int, block long, n int, far double, ids binary, v binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell to blocks of one cell; a block at most is held."""
    part, seq, cell, ids, vs, far = TaskContext.get().partitionId(), 0, None, [], [], 0.0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([part << 32 | seq], pa.int64()), pa.array([len(ids)], pa.int32()), pa.array([far]), pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), pa.array([b"".join(vs)], pa.binary())], ["cell", "block", "n", "far", "ids", "v"])

    for batch in batches:
        for c, i, v, f in zip(*(batch.column(x).to_pylist() for x in ("cell", "vec_id", "v", "far")), strict=True):
            if c != cell or len(ids) == BLOCK:
                if ids:
                    yield out()
                    seq += 1
                cell, ids, vs, far = c, [], [], 0.0
            ids.append(i)
            vs.append(v)
            far = max(far, f)
    if ids:
        yield out()


def usable(rows: DataFrame, id_: str) -> DataFrame:
    return rows.select(F.col(id_).cast("long").alias(id_), F.col("v").cast("array<double>").alias("v")).where(F.col("v").isNotNull() & F.col(id_).isNotNull())


def extent(rows: DataFrame) -> tuple[int, int]:
    """(rows, components) of usable (v); vectors of several lengths are an error, but for empty ones, which are never found."""
    size = F.size("v")
    r = rows.agg(F.count("*").alias("n"), F.min(F.when(size > 0, size)).alias("least"), F.max(size).alias("most")).first()
    if r.least is not None and r.least != r.most:
        raise ValueError("vectors differ in length")
    return r.n, r.most or 0


def build(corpus: DataFrame, path: str | None = None, cells: int | None = None) -> DataFrame:
    """The index of (vec_id, v) as a table, written to ``path`` or the shared folder; ``open_index`` reads it again.

    Vectors that are null, empty, zero or hold null or non-finite components are never found and left out, as are rows without an id;
    vectors of different lengths are an error. There are about half the root of n cells, ``CELLS`` at most; their pivots
    are the vectors with the smallest hashes. All vectors are indexed. A cell of any size is many blocks, dealt by salt.
    """
    spark = corpus.sparkSession
    rows = usable(corpus, "vec_id")
    n, _ = extent(rows)
    wanted = min(CELLS, cells or max(1, math.isqrt(n) // 2))
    drawn = rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(4 * wanted).select("v").toArrow().combine_chunks()  # bounded
    kept, p = units(drawn["v"].chunk(0)) if drawn.num_rows else ([], np.zeros((0, 0)))
    p = p[np.sort(np.unique(p, axis=0, return_index=True)[1])[:wanted]] if len(kept) else np.zeros((1, 1))
    pivots = spark.sparkContext.broadcast(p)
    if len(kept):
        dealt = rows.mapInArrow(_dealt(pivots), "cell int, vec_id long, v binary, far double")
    else:
        dealt = rows.where("false").select(F.lit(0).cast("int").alias("cell"), "vec_id", F.lit(b"").alias("v"), F.lit(0.0).alias("far"))
    salts = max(1, -(-n // SALTED))
    sorted_ = dealt.repartition("cell", F.pmod(F.xxhash64("vec_id"), F.lit(salts))).sortWithinPartitions("cell")
    blocks = sorted_.mapInArrow(_blocks, _TABLE)
    points = spark.createDataFrame([(k, x.tobytes()) for k, x in enumerate(p)], "cell int, pivot binary")  # CELLS at most
    path = path or folder(spark, "index")
    blocks.join(F.broadcast(points), "cell").write.mode("overwrite").parquet(path)
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{_TABLE}, pivot binary").parquet(path)


class _Cells:
    """Pivots, reach and sizes of the cells that hold vectors, and their groups.

    A group is a run of cells, or a part of a cell that is larger than a group, whose blocks are dealt out then.
    """

    def __init__(self, index: DataFrame):
        rows = index.groupBy("cell").agg(F.any_value("pivot").alias("pivot"), F.max("far").alias("far"), F.sum("n").alias("n"), F.count("*").alias("blocks")).collect()  # CELLS at most
        rows = sorted(rows, key=lambda r: r.cell)
        self.cell = np.array([r.cell for r in rows], np.int32)
        self.pivots = np.stack([np.frombuffer(r.pivot) for r in rows]) if rows else np.zeros((0, 0))
        self.far, self.n = np.array([r.far for r in rows]), np.array([r.n for r in rows])
        most = max(1, min(HELD, BYTES // (8 * max(1, self.pivots.shape[1])), -(-int(self.n.sum()) // (2 * index.sparkSession.sparkContext.defaultParallelism))))
        self.group, self.parts, self.groups, held = np.zeros(len(rows), np.int32), np.ones(len(rows), np.int32), 0, 0
        for at, r in enumerate(rows):
            if not held or held + r.n > most:
                self.groups, held = self.groups + 1, 0
            held += r.n
            self.group[at] = self.groups - 1
            if r.n > most:
                self.parts[at] = min(-(-r.n // most), r.blocks)
                self.groups, held = self.groups + int(self.parts[at]) - 1, 0

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """The largest cosine that any vector of each cell can have with each question."""
        return np.cos(np.maximum(_angle(q @ self.pivots.T) - self.far - SLACK, 0.0))


#: The groups from ``group`` on, ``parts`` of them, and the cells that the question visits there, as 32-bit integers.
_VISIT = "group int, parts int, qid long, q binary, least double, cells binary"


def _visits(c: _Cells, at: np.ndarray, counts: np.ndarray, qid: pa.Array, q: pa.Array, least: pa.Array) -> pa.RecordBatch:
    """Rows that visit the cells ``at``, the first of ``counts`` in the first row and so on; all of a row's are of one group."""
    ends = np.concatenate([[0], np.cumsum(counts)])
    cells = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer((ends * 4).astype(np.int32)), pa.py_buffer(c.cell[at].astype("<i4").tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(c.group[at[ends[:-1]]]), pa.array(c.parts[at[ends[:-1]]]), qid, q, least, cells], ["group", "parts", "qid", "q", "least", "cells"])


def _first(cells, k: int):
    """Each question with the cell that it visits first: the nearest one with ``k`` vectors, or with as many as any has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = cells.value
        enough = c.n >= min(k, int(c.n.max()))
        for batch in batches:
            for lo in range(0, batch.num_rows, 8192):
                some = batch.slice(lo, 8192)
                kept, q = units(some.column("v"))
                if not len(kept):
                    continue
                if q.shape[1] != c.pivots.shape[1]:
                    raise ValueError("vectors differ in length")
                near = np.where(enough, q @ c.pivots.T, -2.0).argmax(axis=1)
                yield _visits(c, near, np.ones(len(near), int), some.column("qid").take(pa.array(kept)), pa.array([x.tobytes() for x in q], pa.binary()), pa.array(np.full(len(q), -2.0)))

    return run


def _further(cells):
    """A row for each group with other cells whose bound reaches the question's score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = cells.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                some = batch.slice(lo, 1024)
                q = np.stack([np.frombuffer(x) for x in some.column("q").to_pylist()])
                least = some.column("least").to_numpy()
                first = np.frombuffer(b"".join(some.column("cells").to_pylist()), "<i4")
                open_ = c.bounds(q) >= least[:, None] - SLACK
                open_[np.arange(len(q)), np.searchsorted(c.cell, first)] = False
                for at in range(0, len(q), 64):
                    r, cell = np.nonzero(open_[at : at + 64])  # groups are runs of cells
                    if len(r):
                        starts = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (c.group[cell[1:]] != c.group[cell[:-1]])]))
                        take = some.take(pa.array(r[starts] + at))
                        yield _visits(c, cell, np.diff(np.concatenate([starts, [len(r)]])), take.column("qid"), take.column("q"), take.column("least"))

    return run


def _scored(k: int):
    """Rows by group: its blocks first, which are held, then its questions, a batch of them at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of = [], None
        for batch in batches:
            side, group, copy = (batch.column(x).to_numpy() for x in ("side", "group", "copy"))
            ends = np.flatnonzero(np.concatenate([(side[1:] != side[:-1]) | (side[1:] == 0) | (group[1:] != group[:-1]) | (copy[1:] != copy[:-1]), [True]])) + 1
            for lo, hi in zip([0, *ends[:-1]], ends, strict=True):
                if (group[lo], copy[lo]) != of:
                    held, of = [], (group[lo], copy[lo])
                if side[lo] == 0:
                    own = np.frombuffer(batch.column("ids")[lo].as_py(), "<i8")
                    held.append((batch.column("cell")[lo].as_py(), own, np.frombuffer(batch.column("q")[lo].as_py()).reshape(len(own), -1)))
                    continue
                for at in range(lo, hi, 512):
                    some = batch.slice(at, min(512, hi - at))
                    q = np.stack([np.frombuffer(x) for x in some.column("q").to_pylist()])
                    visited = some.column("cells").to_pylist()
                    row, cell = np.repeat(np.arange(len(q)), [len(x) // 4 for x in visited]), np.frombuffer(b"".join(visited), "<i4")
                    order = np.argsort(cell, kind="stable")
                    row, cell = row[order], cell[order]
                    found = []
                    for of_cell, own, v in held:
                        rows = row[np.searchsorted(cell, of_cell) : np.searchsorted(cell, of_cell, "right")]
                        if len(rows):
                            r, i, s = best(q[rows], own, v, k)
                            found.append((rows[r], i, s))
                    if not found:
                        continue
                    r, i, s = best_of(found, k)
                    keep = s >= some.column("least").to_numpy()[r] - SLACK
                    yield pa.RecordBatch.from_arrays([some.column("qid").take(pa.array(r[keep])), pa.array(i[keep]), pa.array(s[keep])], ["qid", "vec_id", "score"])

    return run


def _met(visits: DataFrame, index: DataFrame, found: _Cells, k: int) -> DataFrame:
    """(qid, vec_id, score) of stored visits: the best ``k`` of every group that a question visits.

    Groups with very many questions come in copies, each for some of them.
    """
    spark = visits.sparkSession
    asked = visits.withColumn("group", F.explode(F.sequence(F.col("group"), F.col("group") + F.col("parts") - 1)))
    counts = asked.groupBy("group").agg(F.ceil(F.count("*") / VISITS).cast("int").alias("copies"))
    counts = F.broadcast(stored(counts, "copies"))  # a row a group
    groups = spark.createDataFrame(list(zip(found.cell.tolist(), found.group.tolist(), found.parts.tolist(), strict=True)), "cell int, first int, parts int")  # CELLS at most
    blocks = index.join(F.broadcast(groups), "cell").withColumn("group", (F.col("first") + F.pmod(F.xxhash64("block"), F.col("parts"))).cast("int"))
    held = blocks.join(counts, "group").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    null = lambda kind: F.lit(None).cast(kind)
    held = held.select("group", "copy", F.lit(0).alias("side"), "cell", null("long").alias("qid"), null("double").alias("least"), null("binary").alias("cells"), "ids", F.col("v").alias("q"))
    asked = asked.join(counts, "group").withColumn("copy", F.pmod(F.xxhash64("qid"), F.col("copies")).cast("int"))
    asked = asked.select("group", "copy", F.lit(1).alias("side"), null("int").alias("cell"), "qid", "least", "cells", null("binary").alias("ids"), "q")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * found.groups)  # so that few groups fall together
    both = held.unionByName(asked).repartition(parts, "group", "copy").sortWithinPartitions("group", "copy", "side")
    return both.mapInArrow(_scored(k), "qid long, vec_id long, score double")


def ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.round("score", PLACES).desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(questions: DataFrame, index: DataFrame, k: int = 3, report: dict | None = None) -> DataFrame:
    """(qid, vec_id, score, rank): exactly the ``k`` nearest by cosine of each question (qid, v), ties by vec_id.

    Questions that are null, empty, zero, hold null or non-finite components or have no id find nothing. ``report`` receives the pairs of
    questions and cells (``pairs``), those that were visited (``visited``), the number of groups (``groups``) and the rows by
    which questions were sent to them (``sent``).
    """
    spark = questions.sparkSession
    found = _Cells(index)
    if not len(found.cell):
        return questions.where("false").select(F.col("qid").cast("long").alias("qid"), F.lit(0).cast("long").alias("vec_id"), F.lit(0.0).alias("score"), F.lit(1).alias("rank"))
    cells = spark.sparkContext.broadcast(found)
    first = stored(usable(questions, "qid").mapInArrow(_first(cells, k), _VISIT), "first")
    near = stored(_met(first, index, found, k), "near")
    edge = ranked(near, k).where(F.col("rank") == k).select("qid", F.col("score").alias("edge"))
    scored = first.join(edge, "qid", "left").select("cells", "qid", "q", F.coalesce("edge", "least").alias("least"))
    more = stored(scored.mapInArrow(_further(cells), _VISIT), "visits")
    if report is not None:
        n, r = first.count(), more.agg(F.sum(F.length("cells") / 4).cast("long").alias("cells"), F.count("*").alias("rows")).first()
        report.update(pairs=n * len(found.cell), visited=n + (r.cells or 0), groups=found.groups, sent=n + r.rows)
    return ranked(near.unionByName(_met(more, index, found, k)), k)
