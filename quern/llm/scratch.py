"""Shared work folder: tables that cut lineage, and raw files written and read by Spark itself.

Everything lands under ``spark.checkpoint.dir`` of the session, which driver and executors share.
Only where that is unset (tests, a laptop) a temporary folder of this machine stands in.
"""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: str | None = None


def folder(spark: SparkSession, name: str) -> str:
    """A new, unused path in the shared work folder."""
    global _own
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        _own = _own or "file://" + tempfile.mkdtemp(prefix="quern-")
        top = _own
    return f"{top.rstrip('/')}/quern/{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back: later uses neither recompute it nor depend on live executors."""
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quern_path = path
    return out


def numbered(df: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """``df`` with its columns called c0, c1 and so on, and what ``names`` are called there: nothing that an operator adds
    can clash. ``toDF(*df.columns)`` gives the names back."""
    place = {c.lower(): f"c{k}" for k, c in enumerate(df.columns)}
    return df.toDF(*place.values()), [place[n.lower()] for n in names]


def drop(*tables: DataFrame) -> None:
    """Deletes tables that nothing reads any more."""
    for df in tables:
        jvm, path = df.sparkSession._jvm, df._quern_path
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Spark's cleaner removes shuffle files once their plans are collected; long steps needn't wait for that."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], rows: str) -> DataFrame:
    """Left join with ``right``, whose ``keys`` are unique and whose column ``rows`` says how many left rows have them.

    Keys with a thousandth of all these rows or more are joined by broadcast: there are a thousand of them at most.
    The other keys are shuffled, and none of them is hot.
    """
    total = right.agg(F.sum(rows)).first()[0] or 0
    hot = F.col(rows) * 1000 >= max(1, total)
    most, rest = right.where(hot), right.where(~hot)
    known = most.select(*keys, F.lit(True).alias("_hot"))
    marked = left.join(F.broadcast(known), keys, "left")
    out = marked.where("_hot is null").drop("_hot").join(rest, keys, "left")
    return out.unionByName(marked.where("_hot").drop("_hot").join(F.broadcast(most), keys, "left"))


def repeat(df: DataFrame, times: Column, index: str, keys: list[str], block: int = 1024) -> DataFrame:
    """Each row ``times`` times with an index from 0; in blocks dealt by ``keys``, so that very many copies of one row
    spread over tasks."""
    zero = F.lit(0).cast("long")
    few = df.where(times.between(1, block)).withColumn(index, F.explode(F.sequence(zero, times - 1)))
    many = df.where(times > block).withColumn("_block", F.explode(F.sequence(zero, F.floor((times - 1) / block))))
    many = many.repartition(*keys, "_block").withColumn(index, F.explode(F.sequence(F.col("_block") * block, F.least((F.col("_block") + 1) * block, times) - 1)))
    return few.unionByName(many.drop("_block"))


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of 4 MB at most, or one longer row, however long the texts are.

    Spark reads this setting when a plan runs, so it stays set for the session; it changes no result.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def write_files(df: DataFrame, column: str, path: str) -> None:
    """One file per row, holding the bytes of ``column`` and one closing newline byte.

    Spark's own text writer and commit protocol do the work, so lost tasks leave nothing behind and
    any file system Spark knows will do. Formats stored this way end in a newline by design.
    """
    df.select(F.col(column).cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("compression", "none").text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of every file under ``path``."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
