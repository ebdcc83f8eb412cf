"""Readers: CSV with pandas-like nulls, JSON lookups, pages, settings files."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

# Strings that tabular readers take for null.
NULL_STRINGS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def read_csv(spark: SparkSession, path: str, schema: StructType | str, nulls: bool = True) -> DataFrame:
    """CSV with a header, quoted newlines and doubled quotes; a byte order mark is skipped."""
    df = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8").csv(path)
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    return df.withColumns({c: F.when(~F.col(c).isin(NULL_STRINGS), F.col(c)) for c in text}) if nulls and text else df


def read_lookup(spark: SparkSession, path: str, value: str) -> DataFrame:
    """A JSON object of keyed records as rows (key, fields...)."""
    whole = spark.read.option("wholetext", True).text(path)
    body = F.from_json(F.replace("value", F.lit("﻿"), F.lit("")), f"map<string,struct<{value}>>")
    return whole.select(F.explode(body).alias("key", "record")).select("key", "record.*")


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content); columns not used are not read."""
    return spark.read.format("binaryFile").load(path)


#: Bytes of files in a batch, about.
_HELD = 16 << 20


def read_named(names: DataFrame, path: str) -> DataFrame:
    """(name, length, content) of the files in a folder that ``names`` (name) has, opened where its rows are: the driver lists
    nothing, and small files share a task. A file that is missing is an error."""
    from quern.sources.documents import _store

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _store(path.rstrip("/"))
        for batch in batches:
            rows, size = [], 0
            for name in batch.column("name").to_pylist():
                with fs.open_input_file(f"{root}/{name}") as file:
                    content = file.read()
                rows.append((name, len(content), content))
                size += len(content)
                if size >= _HELD:
                    yield _files(rows)
                    rows, size = [], 0
            yield _files(rows)

    return names.select("name").mapInArrow(run, "name string, length long, content binary")


def _files(rows: list[tuple]) -> pa.RecordBatch:
    name, length, content = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(name, pa.string()), pa.array(length, pa.int64()), pa.array(content, pa.binary())], ["name", "length", "content"])


def require_headers(headers: DataFrame) -> DataFrame:
    if headers.isEmpty():
        raise ValueError("the document has no outline")
    return headers


def require_paths(paths: list[str], spark: SparkSession | None = None) -> None:
    """Raises once, naming every path that is missing; with a session, paths of any file system that Spark knows."""

    def there(path: str) -> bool:
        if spark is None:
            return os.path.exists(path)
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)

    if missing := [p for p in paths if not there(p)]:
        raise FileNotFoundError("missing: " + ", ".join(missing))


def read_environment(names: dict[str, str | None], path: str | None = None, environment: dict[str, str] | None = None) -> dict[str, str | None]:
    """Settings by name with their defaults: a settings file first, if there is one, then the environment; blank counts as
    not set."""
    found = read_settings(path) if path and os.path.exists(path) else {}
    given = os.environ if environment is None else environment
    first = lambda *values: next((v for v in values if v and v.strip()), None)
    return {n: first(found.get(n), given.get(n), default) for n, default in names.items()}


def read_settings(path: str, required: tuple[str, ...] = ()) -> dict[str, str]:
    """KEY=value lines; blank lines and comments skipped, "export " and quotes taken off."""
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    if os.path.isdir(path):
        raise IsADirectoryError(path)
    try:
        with open(path, encoding="utf-8-sig") as file:
            lines = [x.strip() for x in file]
    except (OSError, UnicodeDecodeError) as e:
        raise OSError(f"the settings file can't be read: {e}") from e
    if not any(lines):
        raise ValueError("the settings file is empty")
    out = {}
    for n, line in enumerate(lines, 1):
        if not line or line.startswith("#"):
            continue
        key, sign, value = line.removeprefix("export ").partition("=")
        if not sign or not key.strip():
            raise ValueError(f"line {n} is no KEY=value")
        value = value.strip()
        out[key.strip()] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value
    for key in required:
        if not out.get(key, "").strip():
            raise ValueError(f"{key} is missing or blank")
    return out
