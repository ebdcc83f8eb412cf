"""From page blocks to passages, chunks and audits."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quern.functions import text
from quern.operators.scan import fill
from quern.sources.shared import unused


def ordered_join(order: list[Column], value: Column, sep: str) -> Column:
    """Aggregate: values joined in an explicit order, nulls skipped."""
    rows = F.array_sort(F.collect_list(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], value.alias("v"))))
    return F.array_join(F.transform(rows, lambda x: x["v"]), sep)


def outline(entries: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Headers (header_id, hierarchy, title, page_index, page_number) of (pos, level, title, page); pages before the first go."""
    rows = entries.select(*(by or []), F.col("pos").alias("header_id"), F.col("level").alias("hierarchy"), text.normalize_space(F.col("title")).alias("title"), (F.col("page") - 1).alias("page_index"), F.col("page").alias("page_number"))
    return rows.where("page_index >= 0")


def as_of(left: DataFrame, right: DataFrame, by: list[str], on: str, carry: list[str], tie: list[str]) -> DataFrame:
    """Each left row with the last right row at or before it: union, then the last right row so far. No range join, and no
    window for each key: keys of any size, or none at all, are spread over ranges."""
    side, found, *ties = unused(left, "_side", "_c", *[f"_t{i}" for i in range(len(tie))])
    r = right.select(*by, on, *[F.col(c).alias(t) for c, t in zip(tie, ties, strict=True)], F.struct(*carry).alias(found), F.lit(0).alias(side))
    left_ = left.select("*", F.lit(None).cast(r.schema[found].dataType).alias(found), F.lit(1).alias(side))
    both = left_.unionByName(r, allowMissingColumns=True)
    out = fill(both, by, [F.col(c) for c in (on, side, *ties)], F.col(found), found).where(F.col(side) == 1)
    return out.select(*left.columns, *[F.col(found)[c].alias(c) for c in carry])


def subsections(headers: DataFrame, blocks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Passages by header, in each document (``by``). A header owns pages up to the next header's; of those on one page
    only the last does. Blocks before the first header belong to none; headers after the last page are left out.

    Every block looks up its header as of its page, so no range join is made and documents spread over tasks.
    """
    by = by or []
    owned = as_of(blocks.select(*by, "page_index", "block_no", "text"), headers.select(*by, "page_index", "header_id"), by, "page_index", ["header_id"], ["header_id"])
    body = owned.where("header_id is not null").groupBy(*by, "header_id").agg(ordered_join([F.col("page_index"), F.col("block_no")], F.col("text"), "\n").alias("raw"))
    top = blocks.groupBy(*by).agg(F.max("page_index").alias("_top"))
    seen = headers.join(top, by) if by else headers.join(F.broadcast(top))  # one row
    out = seen.where(F.col("page_index") <= F.col("_top")).drop("_top").join(body, [*by, "header_id"], "left")
    passage = text.normalize_passage(F.coalesce("raw", F.lit("")))
    return out.select(*headers.columns, text.subsection_key(F.col("header_id"), F.col("title")).alias("subsection_key"), passage.alias("passage")).withColumns({"char_count": F.char_length("passage"), "image_marker_count": F.regexp_count("passage", F.lit(text.IMAGE_MARKER)), "table_marker_count": F.regexp_count("passage", F.lit("<t\\s+\\d+>"))})


def table_records(found: DataFrame) -> DataFrame:
    """(table_id, page_index, bbox, text) of the tables (page_index, table_no, bbox, cells) that a detector has found.

    Ids run over all pages from 1; a table without text, or whose cells couldn't be read (null), has a fixed text.
    """
    from quern.operators.retrieval import number

    return number(found, ["page_index", "table_no"], "table_id", start=1).select("table_id", "page_index", "bbox", text.table_text(F.col("cells")).alias("text"))


def image_records(images: DataFrame, stem: Column, folder: str) -> DataFrame:
    """(image_id, page_index, bbox, image_path, error) of image blocks (page_index, block_no, bbox, image, ext).

    Ids run over all pages from 1. An image without bytes has an error and no path, but keeps its id and marker.
    """
    from quern.operators.retrieval import number
    from quern.sources.sinks import image_name

    rows = number(images, ["page_index", "block_no"], "image_id", start=1)
    good = F.col("image").isNotNull() & (F.octet_length("image") > 0)
    path = F.concat(F.lit(folder.rstrip("/") + "/"), image_name(stem, F.col("page_index") + 1, F.col("image_id"), F.col("ext")))
    return rows.select("image_id", "page_index", "bbox", F.when(good, path).alias("image_path"), F.when(~good, F.lit("the image has no bytes")).alias("error"), "image")


def page_text(blocks: DataFrame, records: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """(page_index, block_no, text) of text blocks (page_index, block_no, lines), in each document (``by``): spans run together
    within a line, lines are joined, lone bullets repaired; a blank block is a newline. A block within a table (``table_id`` not
    null) gives the table once a page, at its first block, from ``records``."""
    by = by or []
    raw = F.array_join(F.transform("lines", lambda spans: F.array_join(spans, "")), "\n")
    body = text.repair_bullets(raw)
    own = blocks.withColumn("_text", F.when(text.strip(body) == "", F.lit("\n")).otherwise(body))
    if records is None:
        return own.select(*by, "page_index", "block_no", F.col("_text").alias("text"))
    first = emit_once(own, [*by, "page_index", "table_id"], ["block_no"], "_first").join(records.select(*by, "table_id", F.col("text").alias("_table")), [*by, "table_id"], "left")
    markup = F.concat(F.lit("\n\n<t "), F.col("table_id"), F.lit(">\n"), F.col("_table"), F.lit("\n</t>\n\n"))
    shown = F.when(F.col("_table").isNull(), F.col("_text")).when(F.col("_first"), markup)
    return first.select(*by, "page_index", "block_no", shown.alias("text")).where("text is not null")


#: Levels of the grid: the side of a cell is two to its level; what fits none of them is in the one cell of level ``WHOLE``.
LEVELS, WHOLE = (-40, 60), 1000


def first_containing(points: DataFrame, boxes: DataFrame, on: str, x: Column, y: Column, margin: float = 1.0) -> DataFrame:
    """Every point with the lowest box_id of its ``on`` group that holds it, edges widened by ``margin``, else null.

    A box lies on the level of a grid whose cells are as large as it is, so in four cells at most; a point looks into one cell of
    each level that any box is on. Hence points meet the boxes around them, however many a group has; the best box is a
    minimum that combines early. Boxes with a null, NaN or reversed side hold nothing; infinite sides hold all beyond.
    """
    px, py, x0, y0, x1, y1, level, cx, cy = unused(points.join(boxes.drop(*[c for c in boxes.columns if c in points.columns]).limit(0)), "_x", "_y", "_x0", "_y0", "_x1", "_y1", "_level", "_cx", "_cy")
    edges = {x0: F.col("x0") - margin, y0: F.col("y0") - margin, x1: F.col("x1") + margin, y1: F.col("y1") + margin}
    b = boxes.select(on, "box_id", *[c.cast("double").alias(n) for n, c in edges.items()]).where((F.col(x0) <= F.col(x1)) & (F.col(y0) <= F.col(y1)) & ~F.isnan(x1) & ~F.isnan(y1))
    side = F.greatest(F.col(x1) - F.col(x0), F.col(y1) - F.col(y0), F.lit(2.0 ** LEVELS[0]))
    far = F.greatest(*map(F.abs, map(F.col, (x0, y0, x1, y1))))
    fits = (side <= 2.0 ** LEVELS[1]) & (far <= side * 2.0**50)
    b = b.withColumn(level, F.when(fits, F.ceil(F.log2(side))).otherwise(F.lit(WHOLE)).cast("int"))
    cell = lambda c: F.when(F.col(level) == WHOLE, F.lit(0)).otherwise(F.floor(c / F.pow(F.lit(2.0), F.col(level)))).cast("long")
    for name, low, high in ((cx, x0, x1), (cy, y0, y1)):
        b = b.withColumn(name, F.explode(F.sequence(cell(F.col(low)), cell(F.col(high)))))
    levels = sorted(r[0] for r in b.select(level).distinct().collect())  # LEVELS at most
    p = points.select("point_id", on, x.cast("double").alias(px), y.cast("double").alias(py), F.explode(F.array(*map(F.lit, levels)).cast("array<int>")).alias(level))
    p = p.withColumns({cx: cell(F.col(px)), cy: cell(F.col(py))})
    hit = p.join(b, [on, level, cx, cy]).where((F.col(px) >= F.col(x0)) & (F.col(px) <= F.col(x1)) & (F.col(py) >= F.col(y0)) & (F.col(py) <= F.col(y1)))
    best = hit.groupBy("point_id").agg(F.min("box_id").alias("box_id"))
    return points.join(best, "point_id", "left")


def emit_once(df: DataFrame, by: list[str], order: list[str], flag: str = "emit") -> DataFrame:
    return df.withColumn(flag, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) == 1)


def fill_section(df: DataFrame, by: list[str], order: list[str], is_section: Column, title: Column, name: str) -> DataFrame:
    """The latest section title so far; before any, the first row's own title. Groups of any size are spread over ranges."""
    return fill(df, by, [F.col(c) for c in order], F.when(is_section, title), name, seed=title)


def neighbours(df: DataFrame, by: list[str], order: list[str], usable: Column, value: Column) -> DataFrame:
    """Nearest usable value before and after each row: a fill along the order, and one against it."""
    (v,) = unused(df, "_usable")
    rows = df.withColumn(v, F.when(usable, value))
    rows = fill(rows, by, [F.col(c) for c in order], F.col(v), "antecedent", inclusive=False)
    return fill(rows, by, [F.col(c).desc() for c in order], F.col(v), "subsequent", inclusive=False).drop(v)


def image_contexts(passages_: DataFrame) -> DataFrame:
    """(subsection_key, figure_id, caption, antecedent, subsequent) of every image marker in (subsection_key, passage)."""
    marked = passages_.select("subsection_key", "passage", F.explode(F.sequence(F.lit(1), F.regexp_count("passage", F.lit(text.IMAGE_MARKER)))).alias("nth")).where("nth > 0")
    ids = F.regexp_extract_all("passage", F.lit(text.IMAGE_MARKER), F.lit(1))
    parts = F.split(F.col("passage"), "<img\\s+\\d+>", -1)
    row = marked.withColumns({"figure_id": F.get(ids, F.col("nth") - 1).cast("int"), "_parts": parts, "_ids": ids})
    marker = lambda k: F.concat(F.lit("<img "), k, F.lit(">"))
    before = F.array_join(F.transform(F.slice("_parts", F.lit(1), F.col("nth")), lambda p, i: F.concat(p, F.when(i < F.col("nth") - 1, marker(F.get("_ids", i))).otherwise(F.lit("")))), "")
    after = F.array_join(F.transform(F.slice("_parts", F.col("nth") + 1, F.size("_parts")), lambda p, i: F.concat(p, F.coalesce(marker(F.get("_ids", i + F.col("nth"))), F.lit("")))), "")
    row = row.withColumns({"_before": before, "_after": F.regexp_replace(after, "(?U)^\\s+", "")})
    good = lambda c: F.filter(text.passages(c), text.plain_paragraph)
    return row.select("subsection_key", "figure_id", text.caption(F.col("_after")).alias("caption"), F.get(F.reverse(good(F.col("_before"))), F.lit(0)).alias("antecedent"), F.get(good(text.after_caption(F.col("_after"))), F.lit(0)).alias("subsequent"))


def chunk_audit(chunks: DataFrame, limit: int = 512, count: Callable[[Column], Column] = text.token_count) -> DataFrame:
    """Tokens, as ``count`` counts them (for a vocabulary file see ``wordpieces.counter``), and characters of each chunk."""
    c = F.col("chunk_passage")
    return chunks.withColumns({"token_count": count(c), "char_count": F.char_length(c)}).withColumns({"max_seq_length": F.lit(limit), "exceeds_encoder_limit": F.col("token_count") > limit})


def truncation(audit: DataFrame) -> DataFrame:
    over = F.count_if(F.col("exceeds_encoder_limit"))
    return audit.agg(F.count("*").alias("n"), over.alias("n_over"), F.round(F.coalesce(F.try_divide(over * 100.0, F.count("*")), F.lit(0.0)), 4).alias("percent_over"))


def semantic_split(passages_: DataFrame, encode_all, percentile: float = 0.95, buffer: int = 1) -> DataFrame:
    """(key, chunk_no, chunk): passages cut after sentences whose meaning moves more than usual.

    Every sentence is encoded with its neighbours, all of a passage in one call; a cut follows where the cosine distance
    to the next exceeds the given percentile of the passage's distances (linear interpolation). One sentence is one chunk.
    A passage stays in its row throughout, so nothing is shuffled.
    """
    from quern.functions.vectors import dot, norm

    s = passages_.select("key", F.filter(F.split(F.regexp_replace("passage", "(?<=[.!?])\\s+", "\u0001"), "\u0001"), lambda x: text.strip(x) != "").alias("_s")).where(F.size("_s") > 0)
    around = F.transform("_s", lambda x, i: F.array_join(F.slice("_s", F.greatest(i - buffer, F.lit(0)) + 1, F.least(i, F.lit(buffer)) + 1 + buffer), " "))
    s = s.withColumn("_e", encode_all(around)).withColumn("_v", F.transform("_e", lambda v: F.struct(v.alias("v"), norm(v).alias("n"))))
    later = F.slice("_v", F.lit(2), F.greatest(F.size("_v") - 1, F.lit(0)))
    s = s.withColumn("_gap", F.slice(F.zip_with("_v", later, lambda a, b: F.lit(1.0) - F.try_divide(dot(a["v"], b["v"]), a["n"] * b["n"])), F.lit(1), F.size("_v") - 1))
    known = F.array_sort(F.filter("_gap", lambda g: g.isNotNull()))
    s = s.withColumn("_known", known).withColumn("_at", (F.size("_known") - 1) * F.lit(percentile))
    low, high = F.get("_known", F.floor("_at").cast("int")), F.get("_known", F.ceil("_at").cast("int"))
    s = s.withColumn("_edge", low + (F.col("_at") - F.floor("_at")) * (high - low))
    cuts = F.filter(F.transform("_gap", lambda g, i: F.when(g > F.col("_edge"), i + 1)), lambda x: x.isNotNull())
    s = s.withColumn("_cuts", cuts).withColumn("_from", F.concat(F.array(F.lit(0)), "_cuts")).withColumn("_to", F.concat("_cuts", F.array(F.size("_s"))))
    chunks = F.transform(F.arrays_zip("_from", "_to"), lambda x: F.array_join(F.slice("_s", x["_from"] + 1, x["_to"] - x["_from"]), " "))
    return s.select("key", F.posexplode(chunks).alias("chunk_no", "chunk")).withColumn("chunk_no", F.col("chunk_no").cast("long"))


def _cuts(v: np.ndarray, percentile: float) -> np.ndarray:
    """After which sentences (from 1) a passage is cut: where the distance of neighbouring vectors, to 12 decimals, exceeds the
    percentile. Equal sentences are thus never told apart by rounding."""
    size = np.linalg.norm(v, axis=1)
    both = size[:-1] * size[1:]
    with np.errstate(invalid="ignore", divide="ignore"):
        gaps = np.where(both > 0, 1.0 - (v[:-1] * v[1:]).sum(axis=1) / both, np.nan)
    gaps = gaps.round(12)
    known = np.sort(gaps[~np.isnan(gaps)])
    if not len(known):
        return np.zeros(0, int)
    at = (len(known) - 1) * percentile
    low, high = known[math.floor(at)], known[math.ceil(at)]
    return np.flatnonzero(gaps > round(low + (at - math.floor(at)) * (high - low), 12)) + 1


def split_batches(passages_: DataFrame, encode: Callable[[list[str]], np.ndarray], percentile: float = 0.95, buffer: int = 1, most: int = 20_000) -> DataFrame:
    """As ``semantic_split``, for an encoder of lists of texts: sentences, vectors and cuts in one Arrow pass, so that no vector
    ever becomes a row. Passages go through it together, some ``most`` sentences at a time, at least one whole passage."""
    sentences = F.filter(F.split(F.regexp_replace("passage", "(?<=[.!?])\\s+", "\u0001"), "\u0001"), lambda x: text.strip(x) != "")
    rows = passages_.select("key", sentences.alias("s")).where(F.size("s") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, lo = np.cumsum(batch.column("s").value_lengths().to_numpy()), 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")))
                some = batch.column("s").slice(lo, hi - lo).to_pylist()
                v = encode([" ".join(s[max(0, i - buffer) : i + 1 + buffer]) for s in some for i in range(len(s))])
                at, owner, place, chunks = 0, [], [], []
                for k, s in enumerate(some):
                    edges = [0, *_cuts(v[at : at + len(s)], percentile).tolist(), len(s)]
                    at += len(s)
                    chunks += [" ".join(s[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
                    owner += [lo + k] * (len(edges) - 1)
                    place += range(len(edges) - 1)
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(owner)), pa.array(place, pa.int64()), pa.array(chunks, pa.string())], ["key", "chunk_no", "chunk"])
                lo = hi

    schema = StructType([StructField("key", rows.schema["key"].dataType), StructField("chunk_no", LongType()), StructField("chunk", StringType())])
    return rows.mapInArrow(run, schema)
