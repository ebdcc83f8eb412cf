import pytest

from quern.plans import answer
from quern.sources import files, sinks


def test_csv_with_quotes_newlines_and_mark(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿id,t\n1,"a ""b""\nc"\n2,NA\n', encoding="utf-8")
    got = files.read_csv(spark, str(tmp_path / "a.csv"), "id int, t string").orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, 'a "b"\nc'), (2, None)]


def test_settings_and_paths(tmp_path):
    p = tmp_path / "s"
    p.write_text('# x\nexport A="b=c"\n\nB=2\n')
    assert files.read_settings(str(p), ("A",)) == {"A": "b=c", "B": "2"}
    with pytest.raises(ValueError):
        files.read_settings(str(p), ("C",))
    with pytest.raises(FileNotFoundError, match="no1.*no2"):
        files.require_paths(["no1", "no2"])


def test_materialize_and_resume(spark, tmp_path):
    made = []
    make = lambda: made.append(1) or spark.range(3)
    path = str(tmp_path / "t")
    for mode in ("run_if_missing", "run_if_missing", "reuse_only", "force_rerun"):
        assert sinks.materialize(spark, path, make, mode).count() == 3
    assert len(made) == 2
    todo = spark.createDataFrame([("q_1", "m", "SLM"), ("q_2", "m", "SLM")], "id string, model_name string, architecture_config string")
    report = str(tmp_path / "r")
    answer.run_pending(todo.where("id = 'q_1'"), report, lambda d: d)
    assert answer.run_pending(todo, report, lambda d: d).count() == 2


def test_chat_sessions(spark, tmp_path):
    from quern.streaming import chat

    spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "conv_id long, turn long, text string").coalesce(1).write.parquet(str(tmp_path / "in"))
    turns = spark.readStream.schema("conv_id long, turn long, text string").parquet(str(tmp_path / "in"))
    q = chat.sessions(turns, lambda text, history: f"{len(history)}:{text}").writeStream.format("memory").queryName("chats").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.conv_id, r.turn, r.answer) for r in spark.table("chats").collect()) == [(1, 1, "0:a"), (1, 2, "2:b"), (2, 1, "0:c")]
