"""A corpus pipeline of five stages over ``documents``; every stage reads what the one before wrote. Texts of any length are
worked on whole in each of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontam, jaccard, langid, mixing, scratch, sharding
from quern.sources.shared import unused

#: Stages learn, draw and compare, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without any recognisable language: null, blank or letterless texts, and those of which the
    model knows no word or n-gram. If no language can be learned, all documents with a letter stay. Null ids and repeated
    rows are documents like any other; extra columns stay, whatever their names; an empty table stays empty."""
    model = langid.train(docs)
    if not model.langs:
        return docs.where(F.col("text").rlike("\\p{L}"))
    names = unused(docs, "_language", "_score", "_known")
    return langid.identify(docs, model, names).where(F.col(names[2]) > 0).drop(*names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the smallest id, of each group linked by Jaccard >= 0.8 over 5-word shingles.

    Rows sharing that id stay, as do rows with a null id and those without any word, which link with nothing; extra columns
    stay; an empty table stays empty."""
    groups = jaccard.similar_groups(docs, words=5, threshold="0.8")
    gone = groups.where(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[f"`{c.replace('`', '``')}`" for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark, with or without an id; others keep all their columns."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents of each source up to its target weight; repeats are rows of their own. Documents without words have
    no weight and may go with their source's fraction; equal rows are taken as often as they stand there, rounded."""
    return mixing.mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds slot and shard of every document, by its id; rows without one share a shard. Columns of these names are
    replaced."""
    return sharding.place(docs)


STAGES = [
    ("language ID", language),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source mix", mixture),
    ("sharding", shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.table(docs, f"stage{k}")
            if k:
                scratch.drop(kept)
            kept = docs
    return docs
