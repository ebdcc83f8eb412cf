"""The registered queries of the library, each over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def _all() -> dict[str, tuple[Query, str | None]]:
    from quern.plans import digest_queries, document_queries, evaluation_queries, retrieval_queries

    return digest_queries.QUERIES | document_queries.QUERIES | retrieval_queries.QUERIES | evaluation_queries.QUERIES


def queries() -> dict[str, Query]:
    return {name: run for name, (run, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
