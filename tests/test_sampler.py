"""Samples of own runs, one that fails included; pieces of a streamed answer in whole batches."""

import pytest
from pyspark.sql import functions as F

from quern.operators import evaluation, reporting
from quern.sources.sampler import Sampler


def test_samples_of_own_runs(spark, tmp_path):
    path = str(tmp_path / "runs")
    with Sampler(spark, path, "good", seconds=0.02, most=8) as s:
        with s.stage("sum"):
            spark.range(2_000_000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id")).collect()
        with s.stage("rest"):
            spark.range(1000).write.format("noop").mode("overwrite").save()
    assert s.seconds > 0.02 and len(s.samples) <= 10
    with pytest.raises(Exception, match="stop here"), Sampler(spark, path, "bad") as s, s.stage("fails"):
        spark.range(10).select(F.raise_error(F.lit("stop here"))).collect()
    samples, stages = spark.read.parquet(f"{path}/samples"), spark.read.parquet(f"{path}/stages")
    profile = {r.run: r for r in reporting.profile(samples.where("executor = 'driver'"), "run", "at", "heap_mb").collect()}
    assert set(profile) == {"good", "bad"} and all(r.peak >= r.start > 0 and r.peak >= r.end > 0 for r in profile.values())
    times = {r.run: r for r in reporting.stage_times(stages, "run", "stage", "seconds", ["sum", "rest", "fails"]).collect()}
    assert times["good"]["sum"] > 0 and times["good"]["rest"] is not None and times["good"]["fails"] is None
    assert [(r.status, r.failed_tasks > 0) for r in stages.where("run = 'bad'").select("status", "failed_tasks").distinct().collect()] == [("FAILED", True)]


def test_pieces_come_in_batches_and_in_time(spark):
    rows = spark.createDataFrame([(k, "p" * k if k != 3 else None) for k in range(6)], "id long, prompt string").coalesce(1)
    out = evaluation.generate_pieces(rows, lambda p: (f"{p}{n}" for n in range(len(p) * 100)), "id")
    got = out.collect()
    assert sorted((r.id, r.piece_no) for r in got) == [(k, n) for k in range(6) if k != 3 for n in range(k * 100)]
    assert all(r.piece == "p" * r.id + str(r.piece_no) for r in got)
    assert evaluation.generate_pieces(rows.where("false"), lambda p: iter(()), "id").count() == 0


def test_pieces_are_gathered():
    import itertools

    import pandas as pd

    batches = lambda: iter([pd.DataFrame({"id": [1, 2], "prompt": ["a", "b"]})])
    frames = list(evaluation._gathered(batches(), lambda p: (p * 2 for _ in range(700)), "id", "prompt", 512, 1e9))
    assert [len(f) for f in frames] == [512, 512, 376]
    clock = itertools.count()
    frames = list(evaluation._gathered(batches(), lambda p: iter("xy"), "id", "prompt", 512, 2, lambda: next(clock)))
    assert sum(len(f) for f in frames) == 4 and len(frames) > 1


def test_history_within_a_bound(spark):
    from quern.operators import prompts

    turns = spark.createDataFrame([(1, k, "user", f"t{k}") for k in range(5)] + [(2, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): [m.content for m in r.history] for r in prompts.history(turns, most=2).collect()}
    assert got == {(1, k): [f"t{j}" for j in range(max(0, k - 2), k)] for k in range(5)} | {(2, 0): []}
