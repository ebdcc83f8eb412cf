"""Cosine near-duplicates by tiles in the order of principal components.

Vectors are rotated to principal axes, sorted into tiles by their leading coordinates, and compared tile by
tile: leading dimensions first, with the product of the rest bounded by suffix norms, so most pairs stop early.
Tiles whose boxes lie further apart than the threshold allows are never compared.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import scratch
from quern.llm.graph import components

#: Vectors of a tile; leading coordinates of a tile's box; rows compared at a time; room for errors of double precision.
TILE, BOX, STRIP, SLACK = 4096, 8, 1024, 1e-9
#: Leading coordinates that are compared first; share of open pairs above which products are made for all pairs; open
#: pairs followed up at a time; blocks that one block meets in a task, about.
LEAD, DENSE, PAIRS, AT_ONCE = 16, 0.02, 1 << 17, 16


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def axes(vectors: DataFrame, dim: int) -> np.ndarray:
    """Principal axes (columns, leading first) of all unit vectors, from sums of outer products.

    Every task adds up its own; the sums of ``dim`` squared cells combine before the shuffle and are all the driver gets.
    """

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            if batch.num_rows:
                x = _unit(_matrix(batch.column("v"), dim))
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim)), pa.array(total.ravel())], ["cell", "x"])

    total = np.zeros(dim * dim)
    for r in vectors.select("v").mapInArrow(part, "cell long, x double").groupBy("cell").agg(F.sum("x").alias("x")).collect():
        total[r.cell] = r.x
    return np.ascontiguousarray(np.linalg.eigh(total.reshape(dim, dim))[1][:, ::-1])


def _tiles(basis: np.ndarray, kind: str):
    """Tiles of rotated order: where they come, ids, multiplicities, raw vectors and the box of leading coordinates."""
    dim, lead = len(basis), min(BOX, len(basis))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        part, seq = TaskContext.get().partitionId(), 0

        def tile() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            raw = _matrix(t.column("v").combine_chunks(), dim)
            y = _unit(raw) @ basis[:, :lead]
            blobs = (t.column("cid").to_numpy().astype("<i8"), t.column("n").to_numpy().astype("<i8"), raw.astype(kind))
            return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([seq]), *(pa.array([b.tobytes()], pa.binary()) for b in blobs), pa.array([y.min(axis=0).tolist()]), pa.array([y.max(axis=0).tolist()])], ["part", "seq", "ids", "n", "raw", "low", "high"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                held.append(batch.slice(at, TILE - sum(b.num_rows for b in held)))
                at += held[-1].num_rows
                if sum(b.num_rows for b in held) == TILE:
                    yield tile()
                    held.clear()
                    seq += 1
        if held:
            yield tile()

    return run


def _coordinates(basis: np.ndarray, width: float):
    """Cells of the three leading coordinates, and the fourth."""
    dim, names = len(basis), ["cid", "n", "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                y = np.pad(_unit(_matrix(batch.column("v"), dim)) @ basis[:, :4], ((0, 0), (0, max(0, 4 - dim))))
                cells = np.floor(y[:, :3] / width).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(cells[:, k]) for k in range(3)), pa.array(y[:, 3])], [*names, "c1", "c2", "c3", "c4"])

    return run


class Block:
    """Vectors to compare: unit and rotated, and for every level the leading coordinates with the norm of the rest.

    The product of two such rows is what the leading coordinates give plus the most that the rest can add.
    """

    def __init__(self, ids: np.ndarray, n: np.ndarray, raw: np.ndarray, basis: np.ndarray):
        self.ids, self.n, self.raw = ids, n, raw
        self.unit = _unit(raw.astype(float)) @ basis
        dim = len(basis)
        self.levels = sorted({min(dim, LEAD << k) for k in range(dim.bit_length())})
        self.rest = [np.sqrt(np.maximum(0, 1 - (self.unit[:, :k] ** 2).sum(axis=1))) for k in self.levels]
        self.bound = np.concatenate([self.unit[:, : self.levels[0]], self.rest[0][:, None]], axis=1).astype(np.float32)


def linked(a: Block, b: Block, lo: int, t: float) -> np.ndarray:
    """Which of ``STRIP`` rows of ``a`` from ``lo`` on and of all rows of ``b`` have cosine >= ``t``.

    Leading coordinates come first, in single precision with room for its error; what stays open goes on level by
    level in double precision, pair by pair where few are open. Products within ``SLACK`` of ``t`` are redone unrotated.
    """
    to = min(lo + STRIP, len(a.ids))
    open_ = a.bound[lo:to] @ b.bound.T >= t - 1e-5
    i, j = np.nonzero(open_)
    value, at = None, 0
    if len(i) > open_.size * DENSE:
        value = np.zeros(open_.shape)
        for k, level in enumerate(a.levels):
            value += a.unit[lo:to, at:level] @ b.unit[:, at:level].T
            open_ &= value + a.rest[k][lo:to, None] * b.rest[k][None, :] >= t - SLACK
            at = level
            if np.count_nonzero(open_) <= open_.size * DENSE:
                break
        i, j = np.nonzero(open_)
        value = value[i, j]
    out = np.zeros(open_.shape, bool)
    for s in range(0, len(i), PAIRS):
        p, q = i[s : s + PAIRS], j[s : s + PAIRS]
        v, done = (np.zeros(len(p)), 0) if value is None else (value[s : s + PAIRS], at)
        for k, level in enumerate(a.levels):
            if level > done and len(p):
                v = v + np.einsum("ij,ij->i", a.unit[p + lo, done:level], b.unit[q, done:level])
                keep = v + a.rest[k][p + lo] * b.rest[k][q] >= t - SLACK
                p, q, v, done = p[keep], q[keep], v[keep], level
        sure = v >= t + SLACK
        out[p[sure], q[sure]] = True
        for x, y in zip(p[~sure].tolist(), q[~sure].tolist(), strict=True):
            u, w = a.raw[x + lo].astype(float), b.raw[y].astype(float)
            out[x, y] = np.dot(u, w) / (math.sqrt(np.dot(u, u)) * math.sqrt(np.dot(w, w))) >= t
    return out


def _links(a: Block, b: Block, same: bool, t: float) -> Iterator[pa.RecordBatch]:
    """Links of each vector of two blocks (or within one), and a forest of edges that joins what is linked."""
    names, none = ["a", "b", "links"], lambda n: pa.nulls(n, pa.int64())
    count, edges = [np.zeros(len(x.ids), np.int64) for x in (a, b)], []
    every, shift = (a.ids, 0) if same else (np.concatenate([a.ids, b.ids]), len(a.ids))
    root = np.arange(len(every))
    for lo in range(0, len(a.ids), STRIP):
        hit = linked(a, b, lo, t)
        if same:
            r = np.arange(len(hit))
            hit[r, r + lo] = False
        rows = np.flatnonzero(hit.any(axis=1))
        if not len(rows):
            continue
        count[0][lo + rows] += hit[rows] @ b.n
        if not same:
            count[1] += a.n[lo + rows] @ hit[rows]
        for i in rows.tolist():
            found = np.unique(root[np.append(np.flatnonzero(hit[i]) + shift, i + lo)])
            if len(found) > 1:
                edges += [(int(every[found[0]]), int(every[k])) for k in found[1:]]
                root[np.isin(root, found[1:])] = found[0]
    for x, n in zip((a, b)[: 1 if same else 2], count, strict=False):
        if len(k := np.flatnonzero(n)):
            yield pa.RecordBatch.from_arrays([pa.array(x.ids[k]), none(len(k)), pa.array(n[k])], names)
    if edges:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*edges, strict=True)] + [none(len(edges))], names)


def _compare(basis: np.ndarray, kind: str, t: float):
    """Rows in order: the tiles of a block, then those of each block it meets. Two blocks are held, no pair leaves the task."""
    dim = len(basis)

    def block(rows: list[dict]) -> Block:
        join = lambda c, kind: np.frombuffer(b"".join(r[c] for r in rows), kind)
        return Block(join("ids", "<i8"), join("n", "<i8"), join("raw", kind).reshape(-1, dim), basis)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for k in range(batch.num_rows) for r in batch.slice(k, 1).to_pylist())
        one = None
        for (a, _, side, b), some in itertools.groupby(rows, lambda r: (r["block_a"], r["chunk"], r["side"], r["block_b"])):
            if side == 0:
                one = block(list(some))
            else:
                yield from _links(one, one if a == b else block(list(some)), a == b, t)

    return run


def _of_dimension(vectors: DataFrame, dim: int, t: float) -> DataFrame:
    """(a, b, links): links of class ``a`` where ``b`` is null, else an edge of the forest."""
    basis, reach = axes(vectors, dim), math.sqrt(max(0.0, 2 - 2 * t)) + SLACK
    width = max(reach, 0.05)
    kind = "<f4" if "float" in vectors.schema["v"].dataType.simpleString() else "<f8"
    v = vectors.schema["v"].dataType.simpleString()
    n = vectors.count()
    order = ("c1", "c2", "c3", "c4", "cid")
    placed = vectors.mapInArrow(_coordinates(basis, width), f"cid long, n long, v {v}, c1 long, c2 long, c3 long, c4 double")
    placed = placed.repartitionByRange(max(1, math.ceil(n / TILE)), *order).sortWithinPartitions(*order)
    tiles = scratch.table(placed.select("cid", "n", "v").mapInArrow(_tiles(basis, kind), "part long, seq long, ids binary, n binary, raw binary, low array<double>, high array<double>"), "tiles")
    # partitions of less than a tile go together, so that the number of partitions doesn't make the number of blocks
    parts = tiles.agg(F.max("part")).first()[0] + 1
    blocks = tiles.withColumn("block", F.floor(F.col("part") / max(1, math.floor(TILE * parts / n))) * (1 << 31) + F.col("seq"))
    lead = min(BOX, dim)
    boxes = blocks.groupBy("block").agg(*[F.min(F.col("low")[k]).alias(f"l{k}") for k in range(lead)], *[F.max(F.col("high")[k]).alias(f"h{k}") for k in range(lead)])
    boxes = scratch.table(boxes, "boxes")
    cells = lambda k, more: F.sequence(F.floor((F.col(f"l{k}") - more) / width), F.floor((F.col(f"h{k}") + more) / width))
    x, y = boxes, boxes.select(*[F.col(c).alias(f"{c}_b") for c in boxes.columns])
    for k in range(min(3, dim)):
        x = x.withColumn(f"k{k}", F.explode(cells(k, 0.0)))
        y = y.withColumn(f"k{k}", F.explode(F.sequence(F.floor((F.col(f"l{k}_b") - reach) / width), F.floor((F.col(f"h{k}_b") + reach) / width))))
    gaps = [F.greatest(F.col(f"l{k}") - F.col(f"h{k}_b"), F.col(f"l{k}_b") - F.col(f"h{k}"), F.lit(0.0)) for k in range(lead)]
    near = x.join(y, [f"k{k}" for k in range(min(3, dim))]).where(F.col("block") <= F.col("block_b")).where(sum((g * g for g in gaps), F.lit(0.0)) <= reach * reach)
    near = pairs = scratch.table(near.select(F.col("block").alias("block_a"), "block_b").distinct(), "near")
    met = near.groupBy("block_a").count().agg(F.sum("count").alias("pairs"), F.max("count").alias("most")).first()
    near = near.withColumn("chunk", F.pmod(F.xxhash64("block_b"), F.lit(math.ceil(met.most / AT_ONCE))))
    data = blocks.select("block", "part", "ids", "n", "raw")
    first = near.select("block_a", "chunk").distinct().join(data.withColumnRenamed("block", "block_a"), "block_a").select("block_a", "chunk", F.lit(0).alias("side"), F.lit(-1).cast("long").alias("block_b"), "part", "ids", "n", "raw")
    other = near.join(data.withColumnRenamed("block", "block_b"), "block_b")
    # a block against itself is there already: no bytes
    slim = lambda c: F.when(F.col("block_a") != F.col("block_b"), F.col(c)).otherwise(F.lit(b"")).alias(c)
    other = other.select("block_a", "chunk", F.lit(1).alias("side"), "block_b", "part", *map(slim, ("ids", "n", "raw")))
    deal = first.unionByName(other).repartition(max(1, math.ceil(met.pairs / AT_ONCE)), "block_a", "chunk").sortWithinPartitions("block_a", "chunk", "side", "block_b", "part")
    out = scratch.table(deal.mapInArrow(_compare(basis, kind, t), "a long, b long, links long"), "compared")
    scratch.drop(tiles, boxes, pairs)
    return out


def near_vectors(table: DataFrame, threshold: float = 0.9, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) for every row: links are pairs with cosine >= ``threshold``.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of
    different lengths never link. Equal vectors (by 128 bits of hash) are one class that is compared once and counts as
    many times as it has rows, so a very common vector costs no more than one. Rows sharing an id stay rows of their own;
    a null id keeps its row with a null component. ``component_id`` is the smallest id reachable by links. An empty table
    gives no rows; other columns are ignored.
    """
    spark = table.sparkSession
    scratch.bound_batches(spark)
    v = F.col(vector_column)
    rows = table.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v"))
    fine = F.col("v").isNotNull() & (F.size("v") > 0)
    fine &= F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("v", F.when(fine, F.col("v")))
    rows = scratch.table(rows.withColumns({"h1": F.when(F.col("v").isNotNull(), F.xxhash64("v")), "h2": F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(1), "v"))}), "vectors")
    classes = rows.where("h1 is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.any_value("v").alias("v"))
    classes = scratch.table(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")  # written once, so the numbers stand
    found = None
    for r in sorted(x.d for x in classes.select(F.size("v").alias("d")).distinct().collect()):
        part = _of_dimension(classes.where(F.size("v") == r).select("cid", "n", "v"), r, threshold)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select(F.col("vec_id").alias(id_column), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    links = found.where("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
    label = components(found.where("b is not null").select("a", "b"))
    named = classes.select("h1", "h2", "cid", "rep", "n").join(label.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "label").join(links, "cid", "left").select("h1", "h2", "n", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = scratch.skew_join(rows.select("vec_id", "h1", "h2"), scratch.table(named, "named"), ["h1", "h2"], "n")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return out.select(F.col("vec_id").alias(id_column), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
