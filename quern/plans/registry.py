"""Helpers for registering queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def registrar(into: dict) -> Callable:
    """A decorator that registers a query under its function's name; tables named as parameters are read for it, but for
    ``spark`` and ``sf_dir``, which are passed as they are."""

    def query(sql: str | None = None) -> Callable:
        def add(f: Callable) -> Callable:
            names = f.__code__.co_varnames[: f.__code__.co_argcount]
            given = {"spark": lambda spark, sf_dir: spark, "sf_dir": lambda spark, sf_dir: sf_dir}
            into[f.__name__] = (lambda spark, sf_dir: f(*[given[n](spark, sf_dir) if n in given else read(spark, sf_dir, n) for n in names]), sql)
            return f

        return add

    return query
