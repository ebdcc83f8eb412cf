"""Tables in the folder that driver and executors share: they cut lineage and fix what is read twice.

The folder is ``spark.checkpoint.dir``. Only where that is unset, on a local master, a folder of this machine stands in
until the program ends.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None


def folder(spark: SparkSession, name: str) -> str:
    """A new, unused path in the shared folder."""
    global _own
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if _own is None:
            _own = tempfile.mkdtemp(prefix="quern-")
            atexit.register(shutil.rmtree, _own, ignore_errors=True)
        top = "file://" + _own
    return f"{top.rstrip('/')}/quern/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back, columns of any name; all that is derived from it sees the same rows."""
    spark, path = df.sparkSession, folder(df.sparkSession, name)
    plain = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
    plain.write.parquet(path)
    return spark.read.schema(plain.schema).parquet(path).toDF(*df.columns)


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, made longer where ``df`` has them as columns, in whatever case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
