"""Line deduplication by a fixed-depth tree of log templates.

A line goes down the tree by its number of tokens and its leading tokens, tokens with digits read as fields. In
a leaf, tokens that recur at their place are constants and all others are fields; lines with the same constants
share a template, if constants make up enough of it. A line that recurs by itself, fields aside, is a template
whatever its share of fields, but for lines of fields alone. Lines whose template recurs in several documents are
dropped.

Tokens are 64-bit hashes throughout, made for all texts of a batch at once. A leaf with one line needs no
tokens at all: its line is its template. Tokens travel only for leaves where different lines meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quern.llm import scratch
from quern.llm.wordhash import U, buffers, hashes, mix, pieces, spans

#: What a token with a digit counts as.
FIELD = 0x3C2A3E
#: Bits of the fixed-size filter (2 MB) that lets most lines stop at the scan.
BITS = 1 << 24
#: 128 bits that stand for a row.
ROW = ["_row", "_row2"]
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


class Lines(NamedTuple):
    """Lines with enough tokens, in order; ``tokens`` of line i are ``first[i]`` to ``first[i] + count[i]``."""

    text: np.ndarray
    at: np.ndarray
    first: np.ndarray
    count: np.ndarray
    leaf: np.ndarray
    line: np.ndarray
    own: np.ndarray
    shaped: np.ndarray
    tokens: np.ndarray


def lines_of(texts: pa.Array, depth: int, least: int) -> Lines:
    """Lines of ``least`` tokens or more. ``at`` is a line's number in its text, ``own`` stands for the text's words,
    ``shaped`` says whether the line has a token without digits."""
    data, offsets = buffers(texts)
    starts, ends = spans(data, offsets)
    none = np.zeros(0, np.int64)
    if not len(starts):
        return Lines(none, none, none, none, none.view(U), none.view(U), none.view(U), none.astype(bool), none.view(U))
    h = hashes(data, starts, ends, cased=True)
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    field = digits[ends] > digits[starts]
    tokens = np.where(field, U(FIELD), h)
    text = np.searchsorted(offsets, starts, side="right") - 1
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    at = breaks[starts] - breaks[offsets[text]]

    opens = np.concatenate([[True], text[1:] != text[:-1]])
    first = np.flatnonzero(opens | np.concatenate([[True], at[1:] != at[:-1]]))
    count = np.diff(np.append(first, len(starts)))
    begins = np.flatnonzero(opens)
    sizes = np.diff(np.append(begins, len(starts)))
    with np.errstate(over="ignore"):
        own = np.add.reduceat(mix(h ^ mix((np.arange(len(h)) - np.repeat(begins, sizes)).astype(U))), begins)
        line = mix(np.add.reduceat(mix(tokens ^ mix((np.arange(len(h)) - np.repeat(first, count)).astype(U), 7)), first) ^ count.astype(U))
        leaf = mix(count.astype(U))
        for j in range(depth):
            leaf = mix(leaf * U(0xD6E8FEB86659FD93) + np.where(count > j, tokens[np.minimum(first + j, len(h) - 1)], U(0)))
    own = own[np.cumsum(opens)[first] - 1]
    constant = count - np.add.reduceat(field.astype(np.int64), first)
    use = count >= least
    first, count = first[use], count[use]
    return Lines(text[first], at[first], first, count, leaf[use], line[use], own[use], constant[use] > 0, tokens)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == U else x.astype(np.int64))


def _met(depth: int, least: int):
    """(leaf, line, own, shaped) of every line, once a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                x = lines_of(part.column("text"), depth, least)
                _, one = np.unique(mix(x.line ^ mix(x.own)), return_index=True)
                yield pa.RecordBatch.from_arrays([_long(x.leaf[one]), _long(x.line[one]), _long(x.own[one]), pa.array(x.shaped[one])], ["leaf", "line", "own", "shaped"])

    return run


def _tokens(depth: int, least: int, table):
    """(line, tokens) of lines whose leaf may be in a bit table, once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = table.value
        for batch in batches:
            for part in pieces(batch, "text"):
                x = lines_of(part.column("text"), depth, least)
                _, one = np.unique(x.line, return_index=True)
                one = one[_among(bits, x.leaf[one])]
                rows = [x.tokens[a : a + n].view(np.int64) for a, n in zip(x.first[one].tolist(), x.count[one].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([_long(x.line[one]), pa.array(rows, pa.list_(pa.int64()))], ["line", "tokens"])

    return run


def _among(bits: np.ndarray, x: np.ndarray) -> np.ndarray:
    low = (x & U(BITS - 1)).astype(np.int64)
    return (bits[low >> 3] >> (low & 7).astype(np.uint8) & 1).astype(bool)


def _filter(keys: DataFrame, column: str):
    """A broadcast bit table of fixed size; a full one only lets more rows through to the joins."""
    low = f"({column} & {BITS - 1})"
    table = np.zeros(BITS // 32, "<u4")
    for r in keys.groupBy(F.expr(f"cast({low} div 32 as int)").alias("cell")).agg(F.expr(f"bit_or(shiftleft(1L, cast({low} % 32 as int)))").alias("bits")).collect():
        table[r.cell] = r.bits & 0xFFFFFFFF  # at most BITS / 32 rows
    return keys.sparkSession.sparkContext.broadcast(table.view(np.uint8))


def recurring(docs: DataFrame, min_documents: int = 3, depth: int = 3, min_tokens: int = 4, similarity: float = 0.75) -> DataFrame:
    """(line, template, support) of every masked line that belongs to a recurring template.

    A masked line in ``min_documents`` texts is a template by itself if any of its tokens is constant; ``similarity``
    is the share of constants that different lines of a leaf need to count as one template.
    Tokens are runs of bytes other than white space (20, 09-0D), a line ends at 0A. Support counts texts with
    different words, so exact copies of a document make nothing recur, nor does one text with many lines of a
    template. Counts combine before they are shuffled and cover all documents.
    """
    scratch.bound_batches(docs.sparkSession)
    texts = docs.select(F.col("text").cast("string").alias("text")).where("text is not null")
    met = scratch.table(texts.mapInArrow(_met(depth, min_tokens), "leaf long, line long, own long, shaped boolean").distinct(), "met")
    counted = met.groupBy("leaf", "line", "shaped").agg(F.count("*").alias("n"))
    leaves = scratch.table(counted.groupBy("leaf").agg(F.sum("n").alias("met"), F.count("*").alias("lines"), F.min("line").alias("line"), F.max("shaped").alias("shaped")).where(F.col("met") >= min_documents), "leaves")
    alone = leaves.where("lines = 1 and shaped").select("line", F.xxhash64("leaf", "line").alias("template"), F.col("met").alias("support"))

    several = leaves.where("lines > 1").select("leaf")
    tokens = texts.mapInArrow(_tokens(depth, min_tokens, _filter(several, "leaf")), "line long, tokens array<long>").groupBy("line").agg(F.any_value("tokens").alias("tokens"))
    lines = scratch.table(counted.join(several, "leaf", "left_semi").select("leaf", "line", "shaped", "n").join(tokens, "line"), "lines")
    places = lines.select("leaf", "line", "n", F.posexplode("tokens").alias("at", "token"))
    constant = places.where(F.col("token") != FIELD).groupBy("leaf", "at", "token").agg(F.sum("n").alias("times")).where(F.col("times") >= min_documents).select("leaf", "at", "token")
    fixed = places.join(constant, ["leaf", "at", "token"]).groupBy("leaf", "line").agg(F.count("*").alias("constants"), F.bit_xor(F.xxhash64("at", "token")).alias("sum"))
    itself = lines.where(F.col("shaped") & (F.col("n") >= min_documents)).select("line", F.xxhash64("leaf", "line").alias("template"), F.col("n").alias("support"))
    shaped = fixed.join(lines.select("line", F.size("tokens").alias("size")), "line").where(F.col("constants") >= similarity * F.col("size"))
    shaped = scratch.table(shaped.select("line", F.xxhash64("leaf", "constants", "sum").alias("template")), "shaped")
    support = met.select("line", "own").join(shaped, "line").select("template", "own").distinct().groupBy("template").agg(F.count("*").alias("support"))
    shared = shaped.join(support.where(F.col("support") >= min_documents), "template").select("line", "template", "support")
    return alone.unionByName(shared).unionByName(itself.join(shared, "line", "left_anti"))


def _split(depth: int, least: int, table):
    """(_row, _row2, _at, _line) of lines that may be in a bit table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = table.value
        for batch in batches:
            for part in pieces(batch, "text"):
                x = lines_of(part.column("text"), depth, least)
                use = _among(bits, x.line)
                rows = pa.array(x.text[use])
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(rows) for c in ROW), _long(x.at[use]), _long(x.line[use])], [*ROW, "_at", "_line"])

    return run


@F.pandas_udf(StringType())
def _kept(texts: pd.Series, gone: pd.Series) -> pd.Series:
    """Texts without the lines of the given numbers; null where no numbers are given."""
    out = []
    for text, numbers in zip(texts, gone, strict=True):
        if numbers is None:
            out.append(None)
            continue
        lines = text.split("\n")
        keep = np.ones(len(lines), bool)
        keep[np.asarray(numbers, np.int64)] = False
        out.append("\n".join(compress(lines, keep.tolist())))
    return pd.Series(out, dtype=object)


def drop_lines(docs: DataFrame, min_documents: int = 3, depth: int = 3, min_tokens: int = 4, similarity: float = 0.75) -> DataFrame:
    """All rows and columns of ``docs``, texts without the lines of recurring templates, with n_lines and n_dropped.

    See ``recurring`` for the options; lines of fewer than ``min_tokens`` tokens are kept however often they recur.
    A null text stays null with no lines; a text of which nothing is left is empty. Rows equal in id and text, null ids
    included, get equal results. An empty table gives no rows. Texts may be of any length and hold any number of lines: work grows with
    their lines. Columns named n_lines or n_dropped are replaced; those of any other name stay.
    """
    bad = scratch.table(recurring(docs, min_documents, depth, min_tokens, similarity).select(F.col("line").alias("_line")).distinct(), "bad")
    docs = docs.drop("n_lines", "n_dropped")
    plain, (doc, text) = scratch.numbered(docs, "doc_id", "text")
    cells = [c for name in (doc, text) for c in (F.col(name), F.col(name).isNull())]
    keyed = plain.withColumns({c: F.xxhash64(F.lit(i), *cells) for i, c in enumerate(ROW)})
    texts = keyed.select(*ROW, F.col(text).cast("string").alias("text")).where("text is not null")
    where = texts.mapInArrow(_split(depth, min_tokens, _filter(bad, "_line")), "_row long, _row2 long, _at long, _line long")
    gone = where.join(bad, "_line").groupBy(*ROW).agg(F.collect_set("_at").alias("_gone"))
    out = keyed.join(gone, ROW, "left")
    shown = F.col(text).cast("string")
    n = F.when(shown.isNull(), F.lit(0)).otherwise(F.length(shown) - F.length(F.replace(shown, F.lit("\n"), F.lit(""))) + 1).cast("long")
    less = _kept(F.when(F.col("_gone").isNotNull(), shown), F.col("_gone"))
    columns = [F.coalesce(less, shown).alias(c) if c == text else F.col(c) for c in plain.columns]
    return out.select(*columns, n.alias("n_lines"), F.coalesce(F.size("_gone").cast("long"), F.lit(0).cast("long")).alias("n_dropped")).toDF(*docs.columns, "n_lines", "n_dropped")


def report(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_chars, kept_md5) for every document. ``min_tokens=1`` leaves out no line."""
    out = drop_lines(docs.select("doc_id", "text"), **options)
    return out.select("doc_id", "n_lines", "n_dropped", F.coalesce(F.char_length("text").cast("long"), F.lit(0).cast("long")).alias("kept_chars"), F.md5(F.col("text").cast("binary")).alias("kept_md5"))
