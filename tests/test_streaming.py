"""Sessions and questions as streams: histories, restarts, idle sessions, replayed batches."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quern.operators import vectorindex
from quern.streaming import chat, questions


def written(spark, folder, k, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder) if rows else None


def run(df, name, checkpoint):
    q = df.writeStream.format("parquet").option("path", name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert q.exception() is None


def test_sessions_equal_the_batch_history(spark, tmp_path):
    """Three runs from one checkpoint see what a history over all rows sees."""
    schema, source, out = "conv_id long, turn long, text string", str(tmp_path / "in"), str(tmp_path / "out")
    batches = [[(1, 1, "a"), (1, 2, "b"), (2, 1, "x")], [(1, 3, "c"), (2, 2, "/clear"), (2, 3, "y")], [(1, 4, "d"), (2, 4, "z"), (3, 1, "q")]]
    for rows in batches:
        written(spark, source, 0, rows, schema)
        stream = spark.readStream.schema(schema).parquet(source)
        run(chat.sessions(stream, lambda text, history: "|".join([*(f"{r[0]}{t}" for r, t in history), text])), out, str(tmp_path / "c"))
    got = {(r.conv_id, r.turn): (r.answer, r.n_history) for r in spark.read.parquet(out).collect()}
    wanted, history = {}, {}
    for conv, turn, text in sorted(r for b in batches for r in b):
        if text == "/clear":
            history[conv] = []
            continue
        before = history.setdefault(conv, [])
        said = "|".join([*(f"{r[0]}{t}" for r, t in before), text])
        wanted[conv, turn] = (said, len(before))
        before += [("user", text), ("assistant", said)]
    assert got == wanted


class Handle:
    """State and timers of one session, counting writes."""

    def __init__(self):
        self.turns, self.timers, self.writes = [], [], 0

    def getListState(self, name, schema):
        return self

    def get(self):
        return iter(self.turns)

    def appendValue(self, row):
        self.turns, self.writes = [*self.turns, row], self.writes + 1

    def clear(self):
        self.turns = []

    def listTimers(self):
        return iter(self.timers)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def registerTimer(self, at):
        self.timers.append(at)


def test_a_turn_writes_one_element_and_idle_sessions_end():
    class Now:
        def getCurrentProcessingTimeInMs(self):
            return 1000 + handle.writes

    handle, session = Handle(), chat._Session(lambda text, history: str(len(history)), 50)
    session.init(handle)
    step = lambda *rows: [r for f in session.handleInputRows((1,), iter([pd.DataFrame(rows, columns=["turn", "text"])]), Now()) for r in f["answer"]]
    assert step((2, "b"), (1, "a")) == ["0", "2"] and handle.writes == 2 and handle.timers == [1052]
    assert step((3, "c")) == ["4"] and handle.writes == 3 and handle.timers == [1053]
    assert [len(f) for f in session.handleExpiredTimer(key=(1,), timerValues=Now(), expiredTimerInfo=None)] == [0] and handle.turns == []
    assert step((4, "d")) == ["0"] and step((5, "/clear")) == [] and handle.turns == [] and handle.timers == []


def test_questions_as_a_stream(spark, tmp_path):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(300, 5))
    corpus = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, v array<double>")
    index, out, source = str(tmp_path / "index"), str(tmp_path / "out"), str(tmp_path / "in")
    vectorindex.build(corpus, index)
    asked = corpus.where("vec_id % 30 = 0").withColumnRenamed("vec_id", "qid")
    for part in (asked.where("qid < 150"), asked.where("qid >= 150")):
        part.coalesce(1).write.mode("append").parquet(source)
        q = questions.answers(spark.readStream.schema(asked.schema).parquet(source), index, out, 4).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(60)
        assert q.exception() is None
    columns = ["qid", "vec_id", "rank"]
    whole = vectorindex.search(asked, vectorindex.open_index(spark, index), 4).select(columns)
    got = spark.read.parquet(out)
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, whole.collect())) and got.select("batch").distinct().count() == 2
    n = got.count()
    # the second batch again, as after a failure between its write and its commit
    last = [p for p in (tmp_path / "c" / "commits").iterdir() if p.name in ("1", ".1.crc")]
    for p in last:
        p.unlink()
    q = questions.answers(spark.readStream.schema(asked.schema).parquet(source), index, out, 4).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert len(last) and spark.read.parquet(out).count() == n == whole.count()
    assert spark.read.parquet(out).groupBy("qid", "rank").count().agg(F.max("count")).first()[0] == 1
