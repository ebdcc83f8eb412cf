"""Image bytes to files of given names: ``df.write.format("images").option("path", ...)`` for rows (name, content).

A task writes into a folder of its own, which counts only once the task has ended well; the job's commit moves what
counts to its place, so a task that is lost, tried again or run twice leaves each file once and whole.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from quern.sources.documents import _store

#: Folders of tasks whose files are moved at a time.
MOVES = 16


def _key(name: str) -> bytes:
    return hashlib.blake2b(name.encode(), digest_size=8).digest()


@dataclass
class _Written(WriterCommitMessage):
    """The folder of a task that ended well, hashes of the names in it, and a name that it met twice, if any."""

    folder: str
    keys: bytes
    twice: str | None


def _names(fs: pa.fs.FileSystem, folder: str) -> list[str]:
    return [f.base_name for f in fs.get_file_info(pa.fs.FileSelector(folder))]


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex

    @property
    def staging(self) -> str:
        return f"{_store(self.path)[1]}/_staging-{self.job}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, names, twice, folder = _store(self.path)[0], {}, None, f"{self.staging}/{uuid.uuid4().hex}"
        fs.create_dir(folder, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content"), strict=True):
                if not name or "/" in name or name[0] in "._":
                    raise ValueError(f"{name!r} is no file name")
                twice = name if name in names else twice
                with fs.open_output_stream(f"{folder}/{name}") as file:
                    file.write(content.as_buffer() if content.is_valid else b"")
                names[name] = _key(name)
        return _Written(folder, b"".join(names.values()), twice)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = _store(self.path)
        done = [m for m in messages if isinstance(m, _Written)]
        twice = next((m.twice for m in done if m.twice is not None), None) or self._shared(fs, done)
        if twice is not None:
            self.abort(messages)
            raise ValueError(f"several images are called {twice}")
        if self.overwrite:
            old = [f for f in fs.get_file_info(pa.fs.FileSelector(root)) if not f.base_name.startswith("_staging-")]
            for f in old:
                fs.delete_dir(f.path) if f.type == pa.fs.FileType.Directory else fs.delete_file(f.path)

        def moved(m: _Written) -> None:
            for name in _names(fs, m.folder):
                fs.move(f"{m.folder}/{name}", f"{root}/{name}")

        with ThreadPoolExecutor(MOVES) as pool:
            list(pool.map(moved, done))
        self._clear()

    @staticmethod
    def _shared(fs: pa.fs.FileSystem, done: list[_Written]) -> str | None:
        """A name that two tasks wrote. Names are looked at only where hashes are equal."""
        found, times = np.unique(np.concatenate([np.zeros(0, "<u8"), *(np.frombuffer(m.keys, "<u8") for m in done)]), return_counts=True)
        again = found[times > 1]
        met: Counter[str] = Counter()
        for m in done:
            if len(again) and np.isin(np.frombuffer(m.keys, "<u8"), again).any():
                met.update(n for n in _names(fs, m.folder) if np.frombuffer(_key(n), "<u8")[0] in again)
        return next((n for n, k in met.items() if k > 1), None)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        fs = _store(self.path)[0]
        if fs.get_file_info(self.staging).type != pa.fs.FileType.NotFound:
            fs.delete_dir(self.staging)


class ImageSink(DataSource):
    """Mode append replaces files of the same names, overwrite all that is in the folder. Two rows with one name are an error, and
    nothing is written then; so is a name with a slash or a leading dot or underscore. A null content is an empty file.
    Eight bytes a file pass through the driver, which moves the files; their bytes and names don't."""

    @classmethod
    def name(cls) -> str:
        return "images"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if {f.name for f in schema.fields} != {"name", "content"}:
            raise ValueError("rows are (name, content)")
        return _Writer(self.options["path"], overwrite)
