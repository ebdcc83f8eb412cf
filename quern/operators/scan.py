"""Fills along an order without a window for each group: ranges are filled by themselves, and what a range ends with is carried
on to the next. A group of any size is spread over as many ranges as it takes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from quern.sources.shared import stored, unused


def _changes(columns: list[pa.Array], n: int) -> np.ndarray:
    """Whether each of ``n`` rows but the first differs from the one before it; nulls are equal."""
    out = np.zeros(n - 1, bool)
    for c in columns:
        a, b = c.slice(1), c.slice(0, n - 1)
        out |= pc.xor(a.is_null(), b.is_null()).to_numpy(zero_copy_only=False)
        out |= pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
    return out


def _filled(by: list[str], value: str, seed: str | None, inclusive: bool, names: list[str]):
    """Rows of a range in order, with the filled value, whether it is open (its group may have begun in an earlier range, and
    none of this range's values has reached it), and the range. One more row holds what the range ends with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, before, unsure = TaskContext.get().partitionId(), None, None, True
        for batch in batches:
            n, first = batch.num_rows, row is None
            if not n:
                continue
            own = batch.column(value)
            raw = own.is_valid().to_numpy(zero_copy_only=False)
            row = batch.slice(0, 1) if first else row
            before = pa.nulls(1, own.type) if first else before
            starts = _changes([pa.concat_arrays([row.column(c), batch.column(c)]) for c in by], n + 1)
            if first:
                starts[0] = True
            if seed is not None:
                own = pc.if_else(pc.and_(pa.array(starts), own.is_null()), batch.column(seed), own)
            # places count from the row before the batch: where the last value of each one's group is
            both = pa.concat_arrays([before, own])
            valid = both.is_valid().to_numpy(zero_copy_only=False)
            begins = np.maximum.accumulate(np.concatenate([[0], np.where(starts, np.arange(1, n + 1), 0)]))
            last = np.maximum.accumulate(np.where(valid, np.arange(n + 1), -1))
            has = last >= begins
            shown = (last[1:], has[1:]) if inclusive else (last[:-1], has[:-1] & ~starts)
            filled = both.take(pa.array(np.where(shown[1], shown[0], 0), mask=~shown[1]))
            open_ = np.zeros(n, bool)
            if unsure:
                later = np.flatnonzero(starts[first:]) + first
                end = int(later[0]) if len(later) else n
                seen = np.flatnonzero(raw[:end])
                open_[: min(end, seen[0] + (not inclusive)) if len(seen) else end] = True
                unsure = end == n and not len(seen)
            yield pa.RecordBatch.from_arrays([*batch.columns, filled, pa.array(open_), pa.array(np.full(n, part, np.int32)), pa.array(np.zeros(n, bool))], names)
            row, before = batch.slice(n - 1, 1), both.take(pa.array([last[-1] if has[-1] else None], pa.int64()))
        if row is not None:
            end = [c if name in by else pa.nulls(1, c.type) for name, c in zip(row.schema.names, row.columns, strict=True)]
            yield pa.RecordBatch.from_arrays([*end, before, pa.array([unsure]), pa.array([part], pa.int32()), pa.array([True])], names)

    return run


def fill(df: DataFrame, by: list[str], order: list[Column], value: Column, name: str, inclusive: bool = True, seed: Column | None = None) -> DataFrame:
    """``df`` with ``name``: the last non-null ``value`` of each row's group in ``order``, at the row or before it, or only before
    it (``inclusive=False``). Where there is none, the ``seed`` of the group's first row (inclusive fills only), else null.

    ``by`` may be empty; null keys are a group. A column called ``name`` is replaced, others stay, whatever their names. Rows
    equal in ``order`` come in any order. An empty table stays empty. The filled ranges are stored once in the shared folder,
    and one row for each of them is carried on.
    """
    if seed is not None and not inclusive:
        raise ValueError("a seed goes with an inclusive fill")
    quoted = lambda c: F.col(f"`{c.replace('`', '``')}`")
    plain = {c.lower(): f"c{k}" for k, c in enumerate(df.columns)}
    groups, mine = [plain[c.lower()] for c in by], unused(df, "_v", "_s")
    rows = df.withColumn(mine[0], value)
    if seed is not None:
        rows = rows.withColumn(mine[1], seed)
    sort, parts = [*map(quoted, by), *order], int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if sort:
        rows = rows.repartitionByRange(parts, *sort).sortWithinPartitions(*sort)
    rows = rows.toDF(*plain.values(), "v", *["s"] * (seed is not None))
    names = [*rows.columns, "filled", "open", "part", "end"]
    types = [*(f.dataType for f in rows.schema.fields), rows.schema["v"].dataType, BooleanType(), IntegerType(), BooleanType()]
    schema = StructType([StructField(n, t) for n, t in zip(names, types, strict=True)])
    found = stored(rows.mapInArrow(_filled(groups, "v", None if seed is None else "s", inclusive, names), schema), "filled")

    own = [f"b{i}" for i in range(len(groups))]
    ends = found.where("end").select(*[F.col(g).alias(b) for g, b in zip(groups, own, strict=True)], "part", "filled", "open")  # a row a range
    w = Window.partitionBy(*own).orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    sure = F.last(F.when(~F.col("open"), F.struct("filled")), ignorenulls=True).over(w)
    carry = F.when(sure.isNotNull(), sure["filled"]).otherwise(F.first("filled").over(w))
    filled_ranges = sorted(r.part for r in ends.select("part").collect())  # numbers of ranges
    after = df.sparkSession.createDataFrame(list(zip(filled_ranges, filled_ranges[1:], strict=False)), "part int, to int")
    carried = ends.select(*own, F.struct(carry.alias("value")).alias("carry"), "part").join(F.broadcast(after), "part").drop("part")
    same = F.col("open") & (F.col("part") == F.col("to"))
    for g, b in zip(groups, own, strict=True):
        same &= F.col(g).eqNullSafe(F.col(b))
    out = found.where("not end").join(F.broadcast(carried), same, "left")
    filled = F.when(F.col("carry").isNotNull(), F.col("carry.value")).otherwise(F.col("filled"))
    return out.select(*[F.col(p).alias(c) for c, p in zip(df.columns, plain.values(), strict=True) if c.lower() != name.lower()], filled.alias(name))
