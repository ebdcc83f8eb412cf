"""Mixing sources to target weights by pivotal rounding of fractional copy numbers."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm import scratch

#: Units that meet in one group of the first round, and residuals in one group of later rounds, about.
GROUP, FAN_IN = 4096, 32
WEIGHTS, MOST = (5.0, 2.0, 1.0), 3
KEY = ["_mix_a", "_mix_b"]


def n_words(text: Column) -> Column:
    """Runs of bytes other than white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Adds target and ratio to (source, source_size, units).

    Sources by code point, null last, take ``weights`` in turn and share the sum of all sizes; where a target
    would pass ``most`` times its source it stops there, and the excess goes to the others by weight. That
    is one level ``x`` with the sum of min(most * size, x * weight) equal to the whole: sources are capped in
    order of size per weight, so running sums give the level. Only sources, not rows, meet in the windows.
    """
    every = Window.partitionBy()
    order = Window.orderBy("ratio", "place")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = sources.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("cap") / F.col("weight"))
    s = s.withColumn("whole", F.sum("source_size").over(every).cast("double")).withColumn("all_weight", F.sum("weight").over(every))
    rest, free = F.col("whole") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)), F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    s = s.withColumn("capped", F.col("ratio") * free <= rest)
    kept = lambda c: F.coalesce(F.sum(F.when(F.col("capped"), F.col(c))).over(every), F.lit(0.0))
    s = s.withColumn("level", F.try_divide(F.col("whole") - kept("cap"), F.col("all_weight") - kept("weight")))
    s = s.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("weight"))))
    return s.select("source", "source_size", "units", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("ratio"))


def pivot(p: np.ndarray, draw: np.ndarray) -> tuple[np.ndarray, int]:
    """Rounds probabilities in order: a carried unit meets the next, and mass moves between the two at random
    until one is 0 or 1. Returns the probabilities after that and the place of the last fractional one, or -1.

    Each keeps its expectation, and after every meeting the total is unchanged.
    """
    p, held = p.astype(float).copy(), -1
    for i in range(len(p)):
        if not 1e-12 < p[i] < 1 - 1e-12:
            p[i] = round(p[i])
            continue
        if held < 0:
            held = i
            continue
        a, b = p[held], p[i]
        s = a + b
        if s <= 1:
            lose, gain = (i, held) if draw[i] * s < a else (held, i)
            p[lose], p[gain] = 0.0, s
        else:
            full, part = (i, held) if draw[i] * (2 - s) < 1 - a else (held, i)
            p[full], p[part] = 1.0, s - 1
            gain = part
        if 1e-12 < p[gain] < 1 - 1e-12:
            held = gain
        else:
            p[gain] = round(p[gain])
            held = -1
    return p, held


def _draws(uid: np.ndarray, seed: int) -> np.ndarray:
    """A number in [0, 1) for every unit that depends on it and ``seed`` alone."""
    x = uid.view(np.uint64) ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    with np.errstate(over="ignore"):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x >> np.uint64(11)).astype(float) / 2**53


def _round(seed: int, turn: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", *KEY], ascending=False, ignore_index=True)
        draw = _draws(group[KEY[0]].to_numpy(np.int64), seed * 64 + turn)
        p, held = pivot(group["p"].to_numpy(), draw)
        group["open"] = False
        if held >= 0 and group["buckets"].iloc[0] <= 1:
            p[held] = float(draw[held] < p[held])
        elif held >= 0:
            group.loc[held, "open"] = True
        group["p"] = p
        return group[["source", "bucket", "buckets", *KEY, "size", "p", "open"]]

    return run


def decide(units: DataFrame, seed: int = 0) -> DataFrame:
    """(KEY, extra) for units (source, KEY, size, p): extra is 1 with probability p, else 0.

    Units of a source are dealt by hash into groups of about ``GROUP``; each group rounds its own from the
    largest down, so partners are alike and the words taken hardly move. One residual at most leaves a group;
    residuals climb a tree of ``FAN_IN`` groups a node until one is left in each source, which is decided alone.
    A source of any size loads no task with more than a group, and equal inputs give equal results.
    """
    schema = f"source string, bucket long, buckets long, {KEY[0]} long, {KEY[1]} long, size long, p double, open boolean"
    n = units.groupBy(F.col("source").alias("its")).agg(F.ceil(F.count("*") / GROUP).cast("long").alias("buckets"))
    n = scratch.table(n, "sources")
    level = units.join(n, F.col("source").eqNullSafe(F.col("its"))).drop("its").withColumn("bucket", F.pmod(KEY[0], "buckets"))
    deepest, done = n.agg(F.max("buckets")).first()[0] or 0, None
    for turn in range(64):
        rounded = scratch.table(level.groupBy("source", "bucket").applyInPandas(_round(seed, turn), schema), "rounded")
        part = rounded.where("not open").select(*KEY, F.col("p").cast("long").alias("extra"))
        done = part if done is None else done.unionByName(part)
        if deepest <= 1:
            return done
        deepest = math.ceil(deepest / FAN_IN)
        level = rounded.where("open").withColumn("bucket", F.floor(F.col("bucket") / FAN_IN)).withColumn("buckets", F.ceil(F.col("buckets") / FAN_IN)).drop("open")
    return done


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with 128 bits that stand for a whole row; complex values count as their JSON."""
    cells = []
    for f in docs.schema.fields:
        c = F.col(f"`{f.name.replace('`', '``')}`")
        c = F.to_json(F.struct(c.alias("x")), {"ignoreNullFields": "false"}) if f.dataType.typeName() in ("array", "map", "struct", "variant") else c
        cells += [c, c.isNull()]
    return docs.withColumns({k: F.xxhash64(F.lit(i), *cells) for i, k in enumerate(KEY)})


def _classes(docs: DataFrame, seed: int, weights: tuple[float, ...], most: int) -> DataFrame:
    """(KEY, doc_id, source, size, n, source_size, target, total) for classes of equal rows: how often they're taken.

    A class of n equal rows counts n times ``ratio``: the whole part is taken, the fraction meets other classes.
    """
    rows = _keyed(docs).select(*KEY, "doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text").cast("string")).alias("size"))
    classes = rows.groupBy(*KEY).agg(F.any_value("doc_id").alias("doc_id"), F.any_value("source").alias("source"), F.any_value("size").alias("size"), F.count("*").alias("n"))
    classes = scratch.table(classes, "classes")
    sources = targets(classes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count("*").alias("units")), weights, most)
    sources = scratch.table(sources.drop("units").withColumnRenamed("source", "its"), "sources")
    classes = classes.join(sources, F.col("source").eqNullSafe(F.col("its"))).drop("its").withColumn("share", F.col("n") * F.col("ratio"))
    extra = decide(classes.select("source", *KEY, "size", (F.col("share") - F.floor("share")).alias("p")), seed)
    return classes.join(extra, KEY).select(*KEY, "doc_id", "source", "size", "n", "source_size", "target", (F.floor("share") + F.col("extra")).alias("total"))


def plan(docs: DataFrame, seed: int = 0, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for every row.

    Size is the number of words, 0 for null or empty texts. A document is taken ``floor(target / source size)``
    times and once more by pivotal rounding of the fraction, so never more than ``most`` times. Of n equal rows some
    are taken once more than others, so that together they come to n times their share, rounded. Rows with equal ids
    that differ in anything else are rows of their own. A null source is a source. Empty tables and sources without
    words take nothing. Reruns with the same ``seed`` agree, however rows are partitioned. Of other columns only the
    fact that rows differ in them counts. Texts of any length count whole; only their sizes are shuffled.
    """
    rows = scratch.repeat(_classes(docs, seed, weights, most), F.col("n"), "_mix_k", KEY)
    copies = F.floor(F.col("total") / F.col("n")) + (F.col("_mix_k") < F.pmod("total", "n")).cast("long")
    return rows.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mix(docs: DataFrame, seed: int = 0, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``docs`` mixed: each row as often as ``plan`` takes it, with its own columns, whatever their names.

    Equal rows collapse before they are shuffled and are spelled out again in blocks. Nulls, ties and empty tables are as in
    ``plan``; texts of any length stay whole.
    """
    taken = _classes(docs, seed, weights, most).where("total > 0").select(*KEY, F.col("total").alias("_mix_total"))
    plain, _ = scratch.numbered(docs)
    rows = _keyed(plain).dropDuplicates(KEY).join(taken, KEY)
    return scratch.repeat(rows, F.col("_mix_total"), "_mix_k", KEY).select(*plain.columns).toDF(*docs.columns)
