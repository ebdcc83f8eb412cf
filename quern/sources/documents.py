"""Paginated documents as a data source: files, or documents in a column of Parquet files, to outlines, blocks, tables and images.

``register(spark)``, then ``spark.read.format("documents").option("path", ...).option("rows", "blocks").load()``. A document
is parsed where it is read, whole, by the function that the option ``parser`` names (``module:function``, bytes to records); the
one for HTML stands in where none is given.
"""

from __future__ import annotations

import base64
import binascii
import importlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from html import unescape
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: What each kind of row holds besides the document it is from and the error.
ROWS = {
    "outline": "pos long, level int, title string, page int",
    "blocks": "page_index int, block_no int, bbox array<double>, lines array<array<string>>, table_no int",
    "tables": "page_index int, table_no int, bbox array<double>, cells array<array<string>>",
    "images": "page_index int, block_no int, bbox array<double>, image binary, ext string",
}
#: Bytes of documents in a partition, about; rows in an Arrow batch.
PARTITION, BATCH = 16 << 20, 4096


@dataclass
class Document:
    """What a parser gives: rows in the order of ``ROWS``. Pages count from 0, but for those of the outline, from 1."""

    outline: list[tuple] = field(default_factory=list)
    blocks: list[tuple] = field(default_factory=list)
    tables: list[tuple] = field(default_factory=list)
    images: list[tuple] = field(default_factory=list)


_BLOCKS = frozenset("address article aside blockquote body caption dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section table tbody td tfoot th thead title tr ul".split())
_SKIPPED = frozenset(("script", "style", "template"))
#: A reference to a character, which ends in a semicolon; an ampersand without is one.
_REFERENCE = re.compile(r"&(?:(#[0-9]+|#[xX][0-9a-fA-F]+)|([a-zA-Z][a-zA-Z0-9]*))?;?")
#: Tags without attributes, and elements whose content isn't markup.
_TAG = re.compile(r"<(/?[a-zA-Z][a-zA-Z0-9]*)>")
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript plaintext svg math".split())
_DATA = re.compile(r"data:image/([\w.+-]+);base64,(.*)", re.DOTALL)


class _Html(HTMLParser):
    """A heading opens a page and is the first block on it; what stands before the first heading is on page 0. A block is
    text between two tags of block elements; ``<br>`` ends a line. Boxes are places: (0, n, 1, n + 1) for the n-th block."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.doc, self.page, self.n, self.skip = Document(), 0, 0, 0
        self.line: list[str] = []
        self.lines: list[list[str]] = []
        self.level, self.cells, self.inside, self.headed = 0, None, 0, False

    def _box(self) -> list[float]:
        return [0.0, float(self.n), 1.0, float(self.n + 1)]

    def _close(self) -> None:
        if not self.line and not self.lines:
            return
        lines = [*self.lines, self.line] if self.line else self.lines
        self.line, self.lines = [], []
        if not any(x.strip() for line in lines for x in line):
            return
        if self.level:
            self.headed = True
            title = " ".join("".join(x) for x in lines)
            self.doc.outline.append((len(self.doc.outline), self.level, title, self.page + 1))
        if self.cells and self.cells[-1]:
            self.cells[-1][-1] = "\n".join("".join(x) for x in lines)
        self.doc.blocks.append((self.page, self.n, self._box(), lines, len(self.doc.tables) if self.cells is not None else None))
        self.n += 1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _SKIPPED:
            self.skip += 1
        if tag == "br":
            self.lines, self.line = [*self.lines, self.line], []
        if tag == "img":
            self._image(dict(attrs).get("src") or "")
        if tag not in _BLOCKS:
            return
        self._close()
        self.level = int(tag[1]) if tag[0] == "h" and tag[1:].isdigit() else 0
        if self.level and (self.headed or self.n):
            self.page, self.n = self.page + 1, 0
        if tag == "table":
            self._end_table()
            self.cells, self.first = [], self._box()
        elif self.cells is not None and tag == "tr":
            self.cells.append([])
        elif self.cells and tag in ("td", "th"):
            self.cells[-1].append(None)

    def handle_endtag(self, tag: str) -> None:
        if tag in _SKIPPED:
            self.skip = max(0, self.skip - 1)
        if tag in _BLOCKS:
            self._close()
            self.level = 0
        if tag == "table":
            self._end_table()

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.line.append(data)

    def _end_table(self) -> None:
        if self.cells is not None:
            self.doc.tables.append((self.page, len(self.doc.tables), [*self.first[:3], float(max(self.n, self.first[1] + 1))], self.cells or None))
        self.cells = None

    def _image(self, src: str) -> None:
        self._close()
        found, image, ext = _DATA.fullmatch(src), None, src.rpartition(".")[2] if "." in src else "png"
        if found:
            ext = found[1].split("+")[0]
            try:
                image = base64.b64decode(found[2], validate=True)
            except binascii.Error:
                image = None
        self.doc.images.append((self.page, self.n, self._box(), image, ext))
        self.n += 1

    def end(self) -> Document:
        self.close()
        self._close()
        self._end_table()
        return self.doc


def _loose(found: re.Match) -> str:
    whole = found[0]
    return whole if whole[-1] == ";" and (found[1] or found[2] and found[2] + ";" in html5) else "&amp;" + whole[1:]


def html(content: bytes) -> Document:
    """HTML in UTF-8; bytes that are none become U+FFFD. Nothing that is malformed is an error. A reference to a character
    needs its semicolon: ``&amp`` without one, as where a text was cut, is those four characters.

    Where every ``<`` opens a tag without attributes, and all content is markup, the tags are told apart by one pattern."""
    text, parser = content.decode("utf-8", "replace"), _Html()
    if "&" in text:
        text = _REFERENCE.sub(_loose, text)
    parts = _TAG.split(text)
    if text.count("<") != len(parts) // 2 or not _RAW.isdisjoint(map(str.lower, parts[1::2])):
        parser.feed(text)
        return parser.end()
    tags = iter(parts)
    if data := next(tags):
        parser.handle_data(unescape(data))
    for tag, data in zip(tags, tags, strict=True):
        if tag[0] == "/":
            parser.handle_endtag(tag[1:].lower())
        else:
            parser.handle_starttag(tag.lower(), [])
        if data:
            parser.handle_data(unescape(data) if "&" in data else data)
    return parser.end()


def _named(name: str) -> Callable[[bytes], Document]:
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


@dataclass
class _Part(InputPartition):
    """Files, or row groups of Parquet files."""

    pieces: list[tuple[str, int | None]]

    def __init__(self, pieces: list[tuple[str, int | None]]):
        super().__init__(None)
        self.pieces = pieces


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: pa.Schema):
        self.path, self.what, self.content = options["path"], options.get("rows", "blocks"), options.get("content")
        self.key, self.parser = options.get("key", "path"), options.get("parser", f"{__name__}:html")
        self.most, self.strict, self.schema = int(options.get("bytes", PARTITION)), options.get("mode", "failfast") == "failfast", schema

    def _files(self) -> tuple[pa.fs.FileSystem, list[pa.fs.FileInfo]]:
        fs, path = _store(self.path)
        info = fs.get_file_info(path)
        if info.type == pa.fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.is_file else fs.get_file_info(pa.fs.FileSelector(path, recursive=True))
        hidden = lambda f: any(x[0] in "._" for x in f.path[len(path) :].split("/") if x)
        return fs, sorted((f for f in found if f.is_file and not hidden(f)), key=lambda f: f.path)

    def partitions(self) -> list[InputPartition]:
        fs, files = self._files()
        pieces: list[tuple[str, int | None, int]] = []
        for f in files:
            if self.content is None:
                pieces.append((f.path, None, f.size))
            else:
                meta = pa.parquet.read_metadata(f.path, filesystem=fs)
                pieces += [(f.path, g, meta.row_group(g).total_byte_size) for g in range(meta.num_row_groups)]
        out, size = [], self.most
        for path, group, n in pieces:
            if size + n > self.most:
                out.append([])
                size = 0
            out[-1].append((path, group))
            size += n
        return [_Part(p) for p in out]

    def _documents(self, pieces: list[tuple[str, int | None]]) -> Iterator[tuple[object, bytes | None]]:
        fs, _ = _store(self.path)
        for path, group in pieces:
            if group is None:
                with fs.open_input_file(path) as file:
                    yield path, file.read()
                continue
            with pa.parquet.ParquetFile(path, filesystem=fs) as file:
                for batch in file.iter_batches(batch_size=64, row_groups=[group], columns=[self.key, self.content]):
                    for key, text in zip(batch.column(self.key).to_pylist(), batch.column(self.content), strict=True):
                        body = text.as_py()
                        yield key, body.encode() if isinstance(body, str) else body

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        parse, rows = _named(self.parser), []
        for key, content in self._documents(partition.pieces):
            try:
                found = getattr(parse(content), self.what) if content is not None else []
                rows += [(key, *row, None) for row in found]
            except Exception as e:
                if self.strict:
                    raise ValueError(f"document {key} can't be parsed: {e}") from e
                rows.append((key, *[None] * (len(self.schema) - 2), str(e)))
            while len(rows) >= BATCH:
                yield self._batch(rows[:BATCH])
                rows = rows[BATCH:]
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: Iterable[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema)


def _store(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if re.match(r"[a-z][a-z0-9+.-]*:/", path):
        return pa.fs.FileSystem.from_uri(path)
    return pa.fs.LocalFileSystem(), path


class DocumentSource(DataSource):
    """Options: ``path``; ``rows`` (outline, blocks, tables or images); ``parser``; ``bytes`` of documents in a partition.

    With ``content`` the path holds Parquet files, whose column of that name has the documents and whose column ``key``
    (``keyType``, by default long) names them; without it every file is a document, named by its path. A document that can't be parsed
    is an error, or with ``mode`` permissive a row with its message. Null documents give no rows, nor do empty ones. Files are dealt
    to partitions by their size, Parquet files by their row groups; a document is never split. Only names and sizes
    reach the driver.
    """

    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        what = self.options.get("rows", "blocks")
        if what not in ROWS:
            raise ValueError(f"rows is one of {', '.join(ROWS)}")
        key = f"`{self.options.get('key', 'path')}` {self.options.get('keyType', 'long')}" if "content" in self.options else "path string"
        return f"{key}, {ROWS[what]}, error string"

    def reader(self, schema) -> DataSourceReader:
        from pyspark.sql.pandas.types import to_arrow_schema

        return _Reader(dict(self.options), to_arrow_schema(schema))


def register(spark: SparkSession) -> None:
    """Makes both formats, ``documents`` to read and ``images`` to write, known to the session."""
    from quern.sources.images import ImageSink

    spark.dataSource.register(DocumentSource)
    spark.dataSource.register(ImageSink)
