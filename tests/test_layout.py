"""Numbers and places by ranges: every row, wide tables, ties, nulls, any number of partitions, reruns."""

import pytest
from pyspark.sql import functions as F

from quern.operators import evaluation, retrieval
from quern.sources import shared


@pytest.fixture(scope="module")
def wide(spark):
    """50,000 rows in no order, a group of half of them, a null group, columns named like the operators' own."""
    rows = spark.range(50_000).withColumn("key", F.pmod(F.xxhash64("id"), F.lit(1 << 40)))
    group = F.when(F.col("key") % 2 == 0, F.lit("hot")).when(F.col("key") % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("g"), F.col("key") % 900))
    own = {"group": group, "a b`c": F.concat(F.lit("x"), "key"), "_p": F.col("key") % 11, "_r": F.lit(1), "_q": F.lit(2), "_o": F.lit(3), "count": F.lit(4), "_least": F.lit(5), "_k0": F.lit(6), "wide": F.repeat(F.lit("z"), 50)}
    return rows.withColumns(own).repartition(7, "key")


@pytest.fixture(params=["4", "64"])
def parts(spark, request):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_number_counts_every_row(wide, parts):
    for _ in range(2):
        out = retrieval.number(wide, ["key"], "n", start=1)
        assert out.columns == [*wide.columns, "n"]
        rows = out.select("key", "n").toPandas().sort_values("key")
        assert rows["n"].tolist() == list(range(1, 50_001))
    assert out.drop("n").exceptAll(wide).isEmpty() and out.count() == 50_000


def test_number_of_ties_nulls_and_none(wide, parts):
    ties = retrieval.number(wide, ["group"], "key")
    assert ties.columns == [c for c in wide.columns if c != "key"] + ["key"]
    rows = ties.select("group", "key").toPandas()
    assert sorted(rows["key"]) == list(range(50_000))
    assert rows[rows["group"].isna()]["key"].max() == rows["group"].isna().sum() - 1
    assert retrieval.number(wide.where("false"), ["key"], "n").count() == 0


def test_places_within_groups(wide, parts):
    out = retrieval.places(wide, ["group"], [F.col("key").desc()], "at", "size")
    assert out.columns == [*wide.columns, "at", "size"]
    rows = out.select("group", "key", "at", "size").toPandas().fillna({"group": "null"})
    assert len(rows) == 50_000
    wanted = rows.groupby("group")["key"].rank(ascending=False).astype(int) - 1
    assert (rows["at"] == wanted).all() and (rows["size"] == rows.groupby("group")["key"].transform("size")).all()
    assert retrieval.places(wide.where("false"), ["group"], [F.col("key")], "at", "size").count() == 0
    assert retrieval.places(wide.select("key", "group"), ["GROUP"], [F.col("key")], "at", "size").agg(F.max("size")).first()[0] == rows["size"].max()


def test_work_of_a_wide_table_is_even(wide, parts):
    tasks = wide.withColumns({"qid": F.concat(F.lit("q_"), "key"), "model": F.lit("m")})
    out = evaluation.split_work(tasks, ["model"], [F.col("key")], 4)
    loads = sorted(r["count"] for r in out.groupBy("worker_id").count().collect())
    assert loads == [12_500] * 4 and {r.worker_id for r in out.select("worker_id").distinct().collect()} == {1, 2, 3, 4}


def test_shared_tables(spark, wide):
    one = shared.stored(wide.withColumn("r", F.rand()), "x")
    assert one.columns == [*wide.columns, "r"] and one.exceptAll(one).isEmpty() and one.agg(F.sum("r")).first() == one.agg(F.sum("r")).first()
    assert shared.unused(wide.limit(1), "_P", "free", "free") == ["_P_", "free", "free_"]
