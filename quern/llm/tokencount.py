"""Token counts by a compiled transducer whose chunk maps compose.

A chunk of text maps any state to another: up to its first sure cut it goes on with the word that is open when it
begins, then it emits a known number of tokens, and from its last sure cut on a word stays open. Such maps are
(head, count, tail), or a mere fragment where a chunk has no cut; they compose associatively. The transducer itself
works in such chunks of some hundred bytes side by side (see ``bpe``); texts of over ``CHUNK`` characters are also
dealt to tasks in chunks, whose maps meet in a tree.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import scratch
from quern.llm.bpe import Transducer, compiled
from quern.llm.wordhash import pieces

CHUNK, FAN_IN = 1 << 20, 64
#: White space after anything else begins a word whatever is around it.
_CUT = re.compile(r"(?<=\S)[ \n]")
Map = tuple[bool, str, int, str]


def _ends(text: str) -> tuple[int, int] | None:
    """The first and the last sure cut of a chunk."""
    first = _CUT.search(text)
    if not first:
        return None
    for b in range(len(text) - 1, first.start(), -1):
        if text[b] in " \n" and not text[b - 1].isspace():
            return first.start(), b
    return first.start(), first.start()


def chunk_maps(t: Transducer, texts: list[str]) -> list[Map]:
    """(closed, head, count, tail) of each chunk; an open one has only a head."""
    ends = [_ends(x) for x in texts]
    n = t.counts(pa.array([x[e[0] : e[1]] if e else "" for x, e in zip(texts, ends, strict=True)], pa.string())).tolist()
    return [(True, x[: e[0]], k, x[e[1] :]) if e else (False, x, 0, "") for x, e, k in zip(texts, ends, n, strict=True)]


def compose(t: Transducer, maps: list[Map]) -> Map:
    """The map of neighbouring chunks, in order; the same however they are grouped."""
    closed, head, seam, seams, n = False, [], [], [], 0
    for shut, a, k, b in maps:
        (seam if closed else head).append(a)
        if shut:
            if closed:
                seams.append("".join(seam))
            closed, seam, n = True, [b], n + k
    return closed, "".join(head), n + int(t.counts(pa.array(seams, pa.string())).sum()), "".join(seam)


def total(t: Transducer, maps: list[Map]) -> int:
    """Tokens of a text from the maps of its chunks in order."""
    _, head, n, tail = compose(t, maps)
    return n + int(t.counts(pa.array([head, tail], pa.string())).sum())


def count(docs: DataFrame, path: str, limit: int = 1024, chunk: int = CHUNK, fan_in: int = FAN_IN) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row; null texts are empty.

    Counts equal ``tokenizers`` with the vocabulary at ``path``, without added special tokens, their strings in
    a text handled as its default. Texts of over ``chunk`` characters are counted in chunks, whose maps are composed
    ``fan_in`` at a time in as many rounds as the longest text needs. Other columns are ignored; null ids and repeated
    rows are counted like any row; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).withColumn("row", F.monotonically_increasing_id()).withColumn("n_bytes", F.octet_length("text").cast("long"))
    n = F.char_length("text")
    parts = F.when(n <= chunk, F.lit(1)).otherwise(F.ceil(n / chunk)).cast("int")
    cut = F.when(n <= chunk, F.array("text")).otherwise(F.transform(F.sequence(F.lit(0), parts - 1), lambda i: F.substring(F.col("text"), i * chunk + 1, F.lit(chunk))))
    rows = rows.withColumn("parts", parts).select("row", "doc_id", "n_bytes", "parts", F.posexplode(cut).alias("part", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = compiled(path)
        for batch in batches:
            for some in pieces(batch, "text"):
                whole, texts = pa.compute.equal(some.column("parts"), 1), some.column("text")
                n_ = t.counts(pa.compute.if_else(whole, texts, "")).tolist()
                found = [(False, "", k, "") for k in n_]
                for i, m in zip(long := [i for i, one in enumerate(whole.to_pylist()) if not one], chunk_maps(t, [texts[i].as_py() for i in long]), strict=True):
                    found[i] = m
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in ("row", "doc_id", "n_bytes", "parts", "part")), *columns(found)], names)

    def join(last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = compiled(path)
            for batch in batches:
                for k in range(batch.num_rows):
                    one = batch.slice(k, 1)
                    maps = [(m["closed"], m["head"], m["n"], m["tail"]) for m in one.column("maps")[0].as_py()]
                    found = (False, "", total(t, maps), "") if last else compose(t, maps)
                    yield pa.RecordBatch.from_arrays([*(one.column(c) for c in ("row", "doc_id", "n_bytes", "parts", "part")), *columns([found])], names)

        return run

    def columns(found: list[Map]) -> list[pa.Array]:
        closed, head, n_, tail = zip(*found, strict=True)
        return [pa.array(closed), pa.array(head, pa.string()), pa.array(n_, pa.int64()), pa.array(tail, pa.string())]

    names = ["row", "doc_id", "n_bytes", "parts", "part", "closed", "head", "n", "tail"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"row long, doc_id {kind}, n_bytes long, parts int, part int, closed boolean, head string, n long, tail string"
    maps = scratch.table(rows.mapInArrow(run, schema), "maps")
    most = maps.agg(F.max("parts")).first()[0] or 1
    counted, level = maps.where("parts = 1"), maps.where("parts > 1")
    while most > 1:
        most = -(-most // fan_in)
        group = level.groupBy("row", F.floor(F.col("part") / fan_in).cast("int").alias("part"))
        level = group.agg(F.first("doc_id").alias("doc_id"), F.first("n_bytes").alias("n_bytes"), F.first("parts").alias("parts"), F.sort_array(F.collect_list(F.struct(F.col("part").alias("at"), "closed", "head", "n", "tail"))).alias("maps"))
        level = level.select("row", "doc_id", "n_bytes", "parts", "part", "maps").mapInArrow(join(most == 1), schema)
        if most == 1:
            counted = counted.unionByName(level)
    return counted.select("doc_id", "n_bytes", F.col("n").alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > limit)
