"""WARC archives with a Zstandard dictionary in a leading skippable frame and a frame for every record."""

from __future__ import annotations

import base64
import hashlib
import io
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import scratch

#: Format: magic numbers of the skippable frames with the dictionary and with the closing newline.
DICTIONARY, CLOSING = 0x184D2A5D, 0x184D2A50
PER_FILE, DICTIONARY_SIZE, SAMPLE = 16 << 20, 32 << 10, 1 << 20
#: Bits of the table that says which payloads may recur (512 kB, whatever the data).
BITS = 1 << 21
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record; a revisit names the response it equals and has the HTTP head only."""
    head = _HTTP % len(payload)
    block = head if refers_to is not None else head + payload
    name = "none" if page_id is None else page_id
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:page:{name}>",
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": " ".join((url or "").split()),
        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        "WARC-Block-Digest": f"sha1:{digest(block)}",
        "Payload-Bytes": len(payload),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(block),
    }
    if refers_to is not None:
        fields |= {"WARC-Refers-To": f"<urn:page:{refers_to}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained on pieces spread over all records, about ``SAMPLE`` bytes in all; where they hold too little to train on,
    the pieces themselves are the dictionary."""
    whole = sum(map(len, records))
    size = min(4096, max(64, whole // 512))
    some = [r[k : k + size] for r in records for k in range(0, len(r), size)]
    some = some[:: max(1, whole // SAMPLE)]
    try:
        return zstandard.train_dictionary(DICTIONARY_SIZE, some, k=200, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(some)[:DICTIONARY_SIZE], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes], level: int = 3) -> bytes:
    """A file of records, less its closing newline: the dictionary in a skippable frame, then a frame for each record."""
    own = dictionary(records)
    raw, press = own.as_bytes(), zstandard.ZstdCompressor(level=level, dict_data=own)
    return b"".join([struct.pack("<II", DICTIONARY, len(raw)), raw, *(press.compress(r) for r in records), struct.pack("<II", CLOSING, 1)])


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of every record of an archive."""
    magic, n = struct.unpack_from("<II", data)
    if magic != DICTIONARY:
        raise ValueError("no dictionary frame")
    plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + n]))
    with plain.stream_reader(io.BytesIO(data[8 + n :]), read_across_frames=True) as stream:
        text = io.BufferedReader(stream, 1 << 20)
        while line := text.readline():
            if not line.startswith(b"WARC/"):
                raise ValueError("a record should begin here")
            fields = {}
            while (line := text.readline()) not in (b"\r\n", b""):
                key, _, value = line.decode().partition(": ")
                fields[key] = value.rstrip("\r\n")
            block = text.read(int(fields["Content-Length"]))
            if text.read(4) != b"\r\n\r\n" or fields["WARC-Block-Digest"] != f"sha1:{digest(block)}":
                raise ValueError("a record is damaged")
            yield fields, block


def _referring(pages: DataFrame, at_least: int) -> DataFrame:
    """(page_id, url, html, refers_to), see ``write``.

    Only digests meet in the grouping. A table of fixed size says which digests may recur; pages with others go
    straight on. The rest are joined, payloads that very many pages share by broadcast.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"))
    rows = rows.withColumn("same", F.when(F.octet_length("html") >= at_least, F.unhex(F.sha2(F.col("html").cast("binary"), 256))))
    ids = rows.where("same is not null").groupBy("same", "page_id").agg(F.count("*").alias("n"))
    groups = ids.groupBy("same").agg(F.max("page_id").alias("first"), F.max_by("n", "page_id").alias("ties"), F.sum("n").alias("n"))
    groups = scratch.table(groups.where("n > 1 and first is not null"), "groups")
    low = F.pmod(F.xxhash64("same"), F.lit(BITS))
    cells = groups.groupBy(F.floor(low / 64).alias("cell")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(same), {BITS}) % 64 as int))")).alias("bits"))  # at most BITS / 64 rows
    rows = rows.withColumn("low", low).withColumn("cell", F.floor(F.col("low") / 64)).join(F.broadcast(cells), "cell", "left")
    may = F.col("same").isNotNull() & (F.expr("shiftrightunsigned(coalesce(bits, 0L), cast(low % 64 as int)) & 1") == 1)
    rows = rows.select("page_id", "url", "html", "same", may.alias("may"))
    alone = rows.where("not may").select("page_id", "url", "html", F.lit(None).cast("long").alias("refers_to"))
    met = scratch.skew_join(rows.where("may").drop("may"), groups, ["same"], "n")
    tied = (F.col("page_id") == F.col("first")) & (F.col("ties") > 1)
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first"))
    plain = met.where(~F.coalesce(tied, F.lit(False))).select("page_id", "url", "html", refers.alias("refers_to"))
    # rows that share the largest id: one is the response, by the greatest url
    several = met.where(tied).groupBy("same", "page_id", "url").agg(F.any_value("html").alias("html"), F.count("*").alias("n"))
    best = several.groupBy(F.col("same").alias("its")).agg(F.max(F.coalesce("url", F.lit(""))).alias("best"), F.max(F.col("url").isNotNull()).alias("has"))
    several = several.join(best, F.col("same") == F.col("its"))
    chosen = (F.col("url").isNotNull() == F.col("has")) & (F.coalesce("url", F.lit("")) == F.col("best")) & (F.col("k") == 0)
    several = scratch.repeat(several, F.col("n"), "k", ["same", "url"]).select("page_id", "url", "html", F.when(~chosen, F.col("page_id")).alias("refers_to"))
    return alone.unionByName(plain).unionByName(several)


def write(pages: DataFrame, path: str, at_least: int = 0, per_file: int = PER_FILE) -> None:
    """One record per row of (page_id, url, html): payload is the html in UTF-8, empty for null.

    Of rows with equal payloads of ``at_least`` bytes or more, the one with the largest page_id is the response, of
    several with that id one of them; all others are revisits of it. Smaller payloads and groups without any id are
    responses. Null ids count as smallest. Repeated rows are records of their own; other columns are ignored; an empty
    table leaves no archive. Payloads of any size are recorded whole.
    """
    scratch.bound_batches(pages.sparkSession)
    rows = _referring(pages, at_least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def file() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([archive(held)], pa.binary())], ["blob"])

        for batch in batches:
            for page, url, html, first in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                held.append(record(page, url, html.encode(), first))
                size += len(held[-1])
                if size >= per_file:
                    yield file()
                    held, size = [], 0
        if held:
            yield file()

    scratch.write_files(rows.mapInArrow(run, "blob binary"), "blob", path)


def read(spark, path: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of every record under ``path``."""

    def number(x: str | None) -> int | None:
        x = (x or "").removeprefix("<urn:page:").removesuffix(">")
        return int(x) if x and x != "none" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column("content"):
                rows, size = [], 0
                for f, block in records(x.as_py()):
                    body = block.partition(b"\r\n\r\n")[2] if f["WARC-Type"] == "response" else None
                    if body is not None and f"sha1:{digest(body)}" != f["WARC-Payload-Digest"]:
                        raise ValueError("a payload is damaged")
                    rows.append((number(f["WARC-Record-ID"]), f["WARC-Target-URI"], int(f["Payload-Bytes"]), f["WARC-Payload-Digest"].removeprefix("sha1:"), f["WARC-Type"], number(f.get("WARC-Refers-To")), body))
                    size += len(block)
                    if size > 8 << 20:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*rows, strict=True), kinds, strict=True)], [k for k, _ in kinds])

    return scratch.read_files(spark, path).select("content").mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def roundtrip(pages: DataFrame, at_least: int = 0) -> DataFrame:
    """Archives ``pages`` in the shared folder and returns what the archives say of each record, payloads left out."""
    path = scratch.folder(pages.sparkSession, "warc")
    write(pages, path, at_least)
    return read(pages.sparkSession, path).drop("payload")
