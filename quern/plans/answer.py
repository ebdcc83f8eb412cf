"""Questions to model-ready prompts, and evaluation runs that resume."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators import evaluation, prompts, retrieval
from quern.sources import sinks


def retrieve(questions: DataFrame, corpus: DataFrame, lookup: DataFrame, k: int = 3) -> DataFrame:
    """Contexts of (qid, v) from (vec_id, v) and (vec_id, passage)."""
    return retrieval.contexts(questions, retrieval.top_k(questions, corpus, k), lookup)


def ask(questions: DataFrame, corpus: DataFrame, lookup: DataFrame, date: Column, k: int = 3) -> DataFrame:
    """(qid, question, rag_context, system, prompt) of (qid, question, v)."""
    found = retrieve(questions, corpus, lookup, k)
    return questions.join(found, "qid").select("qid", "question", "rag_context", prompts.system(date).alias("system"), prompts.prompt(F.col("question"), F.col("rag_context")).alias("prompt"))


def run_pending(todo: DataFrame, path: str, generate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Generates what the report at ``path`` lacks, adds it there, and returns the whole report."""
    spark = todo.sparkSession
    try:
        done = spark.read.parquet(path)
    except Exception as e:  # no report yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = None
    rows = todo if done is None else evaluation.pending(todo, done)
    if done is None or not rows.isEmpty():
        sinks.append_cell(generate(rows), path, ["model_name", "architecture_config"])
    return spark.read.parquet(path)
