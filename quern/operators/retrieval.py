"""Exact top-k search and context assembly for whole sets of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from quern.functions import text
from quern.functions.vectors import cosine
from quern.operators import vectorindex
from quern.sources.shared import stored, unused

#: Corpus vectors, and bytes of them, that go to all tasks as they are; beyond either the corpus is indexed.
GROUP, BYTES = 65_536, 32 << 20


def _answered(corpus, k: int):
    """All of a small corpus against each batch of questions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, v = corpus.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                kept, q = vectorindex.units(some.column("v"))
                if not len(kept):
                    continue
                if q.shape[1] != v.shape[1]:
                    raise ValueError("vectors differ in length")
                r, i, s = vectorindex.best_of([vectorindex.best(q, own[lo : lo + vectorindex.BLOCK], v[lo : lo + vectorindex.BLOCK], k) for lo in range(0, len(v), vectorindex.BLOCK)], k)
                place = np.arange(len(r)) - np.searchsorted(r, r) + 1
                yield pa.RecordBatch.from_arrays([some.column("qid").take(pa.array(kept[r])), pa.array(i), pa.array(s), pa.array(place.astype(np.int32))], ["qid", "vec_id", "score", "rank"])

    return run


def top_k(queries: DataFrame, corpus: DataFrame, k: int = 3) -> DataFrame:
    """(qid, vec_id, score, rank): the ``k`` nearest by cosine, ties by vec_id.

    Queries (qid, v) and corpus (vec_id, v). Vectors that are null, empty, zero or hold null or non-finite components find
    nothing and are never found, nor do rows without an id; vectors of different lengths are an error. A corpus of ``GROUP``
    vectors and ``BYTES`` at most, which is counted first, goes to all tasks whole, and nothing is shuffled; a
    larger one is indexed and searched by bounds (see ``vectorindex``), as is one that is kept as an index.
    """
    rows = vectorindex.usable(corpus, "vec_id")
    n, dim = vectorindex.extent(rows)
    if n > GROUP or n * dim * 8 > BYTES:
        return vectorindex.search(queries, vectorindex.build(corpus), k)
    table = rows.select("vec_id", "v").toArrow().combine_chunks()  # bounded as above
    kept, v = vectorindex.units(table["v"].chunk(0)) if table.num_rows else (np.zeros(0, int), np.zeros((0, 0)))
    asked, schema = vectorindex.usable(queries, "qid"), "qid long, vec_id long, score double, rank int"
    if not len(kept):
        return asked.where("false").select("qid", F.col("qid").alias("vec_id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    own = table["vec_id"].to_numpy()[kept]
    return asked.mapInArrow(_answered(corpus.sparkSession.sparkContext.broadcast((own, v)), k), schema)


def alignment(vectors: DataFrame, id_column: str = "vec_id") -> DataFrame:
    """One row: rows, distinct ids, smallest, largest, and whether ids are 0 .. n-1."""
    c = F.col(id_column)
    out = vectors.agg(F.count("*").alias("n"), F.count_distinct(c).alias("n_ids"), F.min(c).alias("first"), F.max(c).alias("last"))
    return out.withColumn("aligned", (F.col("n") == F.col("n_ids")) & (F.coalesce("first", F.lit(0)) == 0) & (F.coalesce("last", F.lit(-1)) == F.col("n") - 1))


def contexts(questions: DataFrame, hits: DataFrame, lookup: DataFrame, default: str = text.NO_CONTEXT) -> DataFrame:
    """(qid, rag_context, n_passages): passages of the hits in rank order, blank and missing ones skipped."""
    found = hits.join(lookup.select("vec_id", "passage"), "vec_id").where(text.strip(F.col("passage")) != "")
    joined = found.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "passage"))), lambda x: x["passage"]).alias("passages"))
    out = questions.select("qid").join(joined, "qid", "left")
    return out.select("qid", F.coalesce(F.array_join("passages", "\n\n"), F.lit(default)).alias("rag_context"), F.coalesce(F.size("passages"), F.lit(0)).alias("n_passages"))


def best_passage(questions: DataFrame, passages: DataFrame, encode: Callable[[Column], Column]) -> DataFrame:
    """(qid, best, n_passages): the largest cosine of each question (qid, v) to the passages (qid, passages) of its context.

    A passage that is null or blank has no say; each distinct passage is encoded once, whatever the number of contexts it is in.
    ``best`` is null without a passage, or where all cosines are undefined. Questions without a row of passages stay.
    """
    each = passages.select("qid", F.explode("passages").alias("passage")).where(text.strip(F.col("passage")) != "")
    known = each.select("passage").distinct().withColumn("p", encode(F.col("passage")))
    met = each.join(known, "passage").join(questions.select("qid", "v"), "qid")
    found = met.groupBy("qid").agg(F.max(cosine(F.col("v"), F.col("p"))).alias("best"), F.count("*").alias("n_passages"))
    return questions.select("qid").join(found, "qid", "left").select("qid", "best", F.coalesce("n_passages", F.lit(0)).alias("n_passages"))


def remembered(texts: DataFrame, column: str, path: str, encode: Callable[[Column], Column], name: str = "embedding") -> DataFrame:
    """``texts`` with the vector of ``column``, from a store of vectors by content at ``path`` that lasts across runs.

    Only texts that the store lacks are encoded, each once, and appended before anything is read; texts count as equal if
    they are so once stripped. A null text has a null vector. Of vectors that two runs have stored at the same time one counts.
    """
    spark = texts.sparkSession
    key, t = unused(texts, "_key", "_t")
    rows = texts.withColumn(t, text.strip(F.col(column))).withColumn(key, F.sha2(F.col(t), 256))
    wanted = rows.where(F.col(t).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.any_value(t).alias("text"))
    try:
        wanted = wanted.join(spark.read.parquet(path).select("key"), "key", "left_anti")
    except AnalysisException:
        pass  # there is no store yet
    wanted.select("key", encode(F.col("text")).alias("vector")).write.mode("append").parquet(path)
    store = spark.read.parquet(path).groupBy("key").agg(F.any_value("vector").alias(name))
    if name in texts.columns:
        rows = rows.drop(name)
    return rows.join(store.withColumnRenamed("key", key), key, "left").drop(key, t)


def combine(text_context, image_context, default: str = text.NO_CONTEXT):
    """Text route first, then images; blanks skipped; the default if nothing is left."""
    parts = F.filter(F.array(text_context, image_context), lambda x: x.isNotNull() & (text.strip(x) != ""))
    return F.when(F.size(parts) == 0, F.lit(default)).otherwise(F.array_join(parts, "\n\n"))


def similarity(a: str, b: str):
    return cosine(F.col(a), F.col(b))


def rekey(images: DataFrame, order: str, vector: str) -> DataFrame:
    """Images that have a vector, numbered 0.. in order."""
    kept = images.where(F.col(vector).isNotNull())
    return number(kept, [order], "vector_index")


def strict_lookup(rows: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """``rows`` with the value of their key; a key that the table lacks is an error, named in its message."""
    found = rows.join(table.select(key, F.struct(value).alias("_found")), key, "left")
    missing = F.raise_error(F.concat(F.lit(f"no {value} for {key} "), F.col(key).cast("string")))
    return found.withColumn(value, F.when(F.col("_found").isNotNull(), F.col("_found")[value]).otherwise(missing)).drop("_found")


def _name(c: str) -> Column:
    return F.col(f"`{c.replace('`', '``')}`")


def _ranged(df: DataFrame, order: list) -> tuple[DataFrame, str, str]:
    """``df`` sorted by ranges and stored, with the place of each row: its partition, and its number in that.

    Ranges come from samples, which another plan over the same rows would draw anew; hence all that goes by these places
    reads one stored table.
    """
    part, row, at = unused(df, "_p", "_r", "_m")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    rows = rows.withColumns({part: F.shiftright(at, 33), row: F.col(at).bitwiseAND(F.lit((1 << 33) - 1))}).drop(at)
    return stored(rows, "ranged"), part, row


def number(df: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """Dense global numbers in order without a one-task window: rows a partition, then offsets.

    The sorted rows are stored once in the shared folder. Rows equal in ``order`` get numbers next to each other; a column
    called ``name`` is replaced, all others stay, whatever their names.
    """
    keep = [c for c in df.columns if c.lower() != name.lower()]
    ranged, part, row = _ranged(df, [_name(c) for c in order])
    its, offset = unused(ranged, "_q", "_o")
    counts = ranged.groupBy(F.col(part).alias(its)).count()
    before = Window.orderBy(its).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(its, F.coalesce(F.sum("count").over(before), F.lit(0)).alias(offset))  # a row a partition
    out = ranged.join(F.broadcast(offsets), F.col(part) == F.col(its))
    return out.select(*map(_name, keep), (F.col(offset) + F.col(row) + start).alias(name))


def places(df: DataFrame, by: list[str], order: list[Column], name: str, size: str) -> DataFrame:
    """Each row's number from 0 within its group, and the size of the group, however few and large the groups are.

    Groups and order together are cut into ranges and stored once; what a group has in earlier ranges comes from one row for
    each group in each range. Columns called ``name`` or ``size`` are replaced, all others stay, whatever their names.
    """
    keep = [c for c in df.columns if c.lower() not in (name.lower(), size.lower())]
    ranged, part, row = _ranged(df, [*map(_name, by), *order])
    its, least, n, before, total, *keys = unused(ranged, "_q", "_least", "_n", "_before", "_total", *[f"_k{i}" for i in range(len(by))])
    runs = ranged.groupBy(*[_name(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col(part).alias(its)).agg(F.count("*").alias(n), F.min(row).alias(least))
    w = Window.partitionBy(*keys).orderBy(its).rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*keys, its, least, F.coalesce(F.sum(n).over(w), F.lit(0)).alias(before), F.sum(n).over(Window.partitionBy(*keys)).alias(total))
    same = F.col(part) == F.col(its)
    for c, k in zip(by, keys, strict=True):
        same &= _name(c).eqNullSafe(F.col(k))
    return ranged.join(runs, same).select(*map(_name, keep), (F.col(before) + F.col(row) - F.col(least)).alias(name), F.col(total).alias(size))
