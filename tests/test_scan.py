"""Fills along an order against windows: hot groups, long empty stretches, nulls, several ranges a group."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.operators import digest, scan


@pytest.fixture(scope="module")
def rows(spark):
    """Half of all rows in one group; values rare enough that whole ranges have none; columns with the scan's own names."""
    n = spark.range(6_000).withColumn("at", F.pmod(F.xxhash64("id"), F.lit(1 << 40)))
    group = F.when(F.col("id") % 2 == 0, F.lit("hot")).when(F.col("id") % 31 == 0, F.lit(None)).otherwise(F.concat(F.lit("g"), F.col("id") % 200))
    value = F.when(F.pmod(F.xxhash64("at"), F.lit(700)) == 0, F.concat(F.lit("v"), "at"))
    return n.withColumns({"group": group, "v": value, "open": F.lit(1), "end": F.lit("e"), "part": F.col("id"), "c0": F.lit(2), "title": F.when(F.col("id") % 3 > 0, F.concat(F.lit("t"), "at"))}).repartition(5, "at")


@pytest.fixture(params=["1", "4", "40"])
def parts(spark, request):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def same(got, wanted):
    assert sorted(got.columns) == sorted(wanted.columns)
    key = lambda r: str(tuple(r))
    assert sorted(map(key, got.select(*wanted.columns).collect())) == sorted(map(key, wanted.collect()))


@pytest.mark.parametrize("by", [["group"], []])
def test_fill_equals_a_window(rows, parts, by):
    w = Window.partitionBy(*by).orderBy("at")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    last = lambda over: F.last("v", ignorenulls=True).over(over)
    at = [F.col("at")]
    same(scan.fill(rows, by, at, F.col("v"), "filled"), rows.withColumn("filled", last(upto)))
    same(scan.fill(rows, by, at, F.col("v"), "end", inclusive=False), rows.withColumn("end", last(before)))
    same(scan.fill(rows, by, at, F.col("v"), "x", seed=F.col("title")), rows.withColumn("x", F.coalesce(last(upto), F.first("title").over(upto))))


def test_fill_of_few_rows(spark, rows, parts):
    assert scan.fill(rows.where("false"), ["group"], [F.col("at")], F.col("v"), "x").collect() == []
    one = rows.where("id = 5")
    assert scan.fill(one, ["group"], [F.col("at")], F.lit(7), "x").first()["x"] == 7
    assert scan.fill(one, ["group"], [F.col("at")], F.lit(7), "x", inclusive=False).first()["x"] is None
    with pytest.raises(ValueError):
        scan.fill(one, [], [F.col("at")], F.lit(7), "x", inclusive=False, seed=F.lit(1))


def test_neighbours_and_sections(rows, parts):
    w = Window.partitionBy("group").orderBy("at")
    v = F.when(F.col("v").isNotNull(), F.col("at"))
    wanted = rows.withColumns({"antecedent": F.last(v, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), "subsequent": F.first(v, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))})
    same(digest.neighbours(rows, ["group"], ["at"], F.col("v").isNotNull(), F.col("at")), wanted)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    title = F.coalesce(F.last(F.when(F.col("v").isNotNull(), F.col("title")), ignorenulls=True).over(upto), F.first("title").over(upto))
    same(digest.fill_section(rows, ["group"], ["at"], F.col("v").isNotNull(), F.col("title"), "section"), rows.withColumn("section", title))


@pytest.mark.parametrize("by", [["group"], []])
def test_as_of_hot_keys_and_without_keys(rows, parts, by):
    left, right = rows.where("v is null"), rows.where("v is not null").select(*by, "at", F.col("id").alias("found"), "open")
    got = digest.as_of(left.drop("open"), right, by, "at", ["found", "open"], ["found"])
    w = Window.partitionBy(*by).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    f = rows.withColumn("found", F.last(F.when(F.col("v").isNotNull(), F.col("id")), ignorenulls=True).over(w)).where("v is null")
    same(got.select("id", "found"), f.select("id", "found"))
    assert got.columns == [c for c in left.columns if c != "open"] + ["found", "open"]
