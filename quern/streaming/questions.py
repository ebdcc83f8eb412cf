"""Questions as a stream: each micro-batch is answered from a stored index and lands in a folder of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from quern.operators import vectorindex


def answers(questions: DataFrame, index: str, path: str, k: int = 3) -> DataStreamWriter:
    """A stream of (qid, v) that writes (qid, vec_id, score, rank, batch) under ``path``; start it with a checkpoint.

    ``index`` is the path of an index that ``vectorindex.build`` has written; each batch reads it as it is then, so that
    an index that has been replaced serves the next batch. A batch overwrites its own folder and no other: one that is
    replayed after a failure adds no row. Rows that no question finds are none; an empty batch leaves an empty folder or none.
    """

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        found = vectorindex.search(batch.select("qid", "v"), vectorindex.open_index(spark, index), k)
        found.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return questions.writeStream.foreachBatch(one).outputMode("append")
