"""Writers: tables reused or recomputed, CSV and JSON exports, image names, reports."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

MODES = ("reuse_only", "run_if_missing", "force_rerun")


def materialize(spark: SparkSession, path: str, make: Callable[[], DataFrame], mode: str = "run_if_missing") -> DataFrame:
    """The table at ``path``: read, or made and written, as ``mode`` says."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    if mode != "force_rerun":
        try:
            return spark.read.parquet(path)
        except AnalysisException:
            if mode == "reuse_only":
                raise
    make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def append_cell(df: DataFrame, path: str, by: list[str]) -> None:
    """Adds finished rows to a report, one folder per cell, instead of rewriting it. For cells that are made whole and may be
    made again see ``replace_cells``."""
    df.write.mode("append").partitionBy(*by).parquet(path)


def replace_cells(df: DataFrame, path: str, by: list[str]) -> None:
    """Writes whole cells of a report: each cell of ``df`` takes the place of what the report had for it, other cells stay. A job
    that died after its write and runs again leaves every row once."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_csv(df: DataFrame, path: str, mark: bool = False) -> None:
    """CSV with a header; ``mark`` puts a byte order mark at the start of every file, before the first column's name."""
    if mark and df.columns:
        df = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0])
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_object(spark: SparkSession, value: dict | list, path: str) -> None:
    """One small JSON document, indented by two, UTF-8 as it is; what JSON doesn't know is written as text."""
    body = json.dumps(value, indent=2, ensure_ascii=False, default=str)
    spark.createDataFrame([(body,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def export(tables: dict[str, DataFrame | None], folder: str) -> None:
    """One Parquet folder per entity; those that are None are left out."""
    for name, df in tables.items():
        if df is not None:
            df.write.mode("overwrite").parquet(f"{folder}/{name}")


def delete(spark: SparkSession, path: str) -> bool:
    """Deletes a checkpoint or report in any file system that Spark knows; False if there was none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


class Performance:
    """Seconds of named stages, written as a report at the end, after a failure too.

    ``with Performance(spark, path) as p: with p.stage("chunking"): ...``. The same stage adds up, or with
    ``accumulate=False`` the last time stands.
    """

    def __init__(self, spark: SparkSession, path: str, accumulate: bool = True):
        self.spark, self.path, self.accumulate, self.seconds = spark, path, accumulate, {}

    def __enter__(self) -> Performance:
        self.began = datetime.now(UTC)
        return self

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        began = time.monotonic()
        try:
            yield
        finally:
            now = time.monotonic() - began
            self.seconds[name] = now + (self.seconds.get(name, 0.0) if self.accumulate else 0.0)

    def __exit__(self, kind, error, trace) -> None:
        status = "completed" if error is None else "failed"
        report = {"started": self.began.isoformat(), "ended": datetime.now(UTC).isoformat(), "status": status, "error": error and str(error), "stages": self.seconds, "total_seconds": sum(self.seconds.values())}
        write_object(self.spark, report, self.path)


def image_name(stem: Column, page: Column, image: Column, ext: Column) -> Column:
    """stem_p001_img0001.ext, numbers wider than their field kept whole, extension lower-case without dots."""
    pad = lambda c, n: F.lpad(c.cast("string"), F.greatest(F.lit(n), F.length(c.cast("string"))), F.lit("0"))
    return F.concat(stem, F.lit("_p"), pad(page, 3), F.lit("_img"), pad(image, 4), F.lit("."), F.lower(F.replace(ext, F.lit("."), F.lit(""))))


def folder_bytes(spark: SparkSession, path: str) -> DataFrame:
    """Total size of the files under a folder; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
