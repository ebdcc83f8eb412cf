"""The index against brute force, with bounds at work, ties, hot copies and odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import retrieval, vectorindex

CORPUS, ASKED = "vec_id long, v array<double>, score double", "qid long, v array<double>"


def brute(rows, asked, k):
    ids, v = np.array([i for i, x in rows]), np.array([x for _, x in rows], float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    out = {}
    for q, x in asked:
        s = (v @ (np.array(x) / np.linalg.norm(x))).round(12)
        out[q] = [(int(ids[j]), float(s[j])) for j in np.lexsort((ids, -s))[:k]]
    return out


def answers(df):
    out = {}
    for r in df.orderBy("qid", "rank").collect():
        out.setdefault(r.qid, []).append((r.vec_id, round(r.score, 12)))
    return out


@pytest.fixture(scope="module")
def rows():
    """Clusters, a third of all rows copies of one vector, ties."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8))
    v = [(centres[k % 12] + 0.05 * rng.normal(size=8)).round(3).tolist() for k in range(2000)]
    return [(k, x) for k, x in enumerate(v)] + [(5000 + k, v[3]) for k in range(1000)]


def test_index_equals_brute_force(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(vectorindex, "VISITS", 30)
    odd = [(7000, None), (7001, []), (7002, [0.0] * 8), (7003, [None] + [1.0] * 7), (7004, [float("nan")] * 8), (7005, [float("inf")] * 8), (None, [1.0] * 8)]
    corpus = spark.createDataFrame([(i, x, 0.5) for i, x in rows + odd], CORPUS).repartition(6)
    rng = np.random.default_rng(6)
    asked = [(i, x) for i, x in rows[:150]] + [(9000 + k, rng.normal(size=8).tolist()) for k in range(20)] + [(9900, (-np.array(rows[0][1])).tolist())]
    questions = spark.createDataFrame(asked + [(100_000 + k, x) for k, (_, x) in enumerate(odd[:-1])] + [(None, [1.0] * 8)], ASKED)
    index = vectorindex.build(corpus, str(tmp_path / "index"))
    assert index.agg(F.sum("n")).first()[0] == 3000 and 1 < index.select("cell").distinct().count() <= 27
    report = {}
    for k in (1, 4):
        got = answers(vectorindex.search(questions, vectorindex.open_index(spark, str(tmp_path / "index")), k, report))
        assert {q: x for q, x in got.items() if q is not None and q < 100_000} == brute(rows, asked, k)
        assert not [q for q in got if q is None or q >= 100_000]
        assert answers(retrieval.top_k(questions, corpus, k)) == got
    assert report["visited"] < 0.25 * report["pairs"]


def test_search_with_fewer_vectors_than_k(spark, rows):
    corpus = spark.createDataFrame([(i, x, 0.0) for i, x in rows[:7]], CORPUS)
    questions = spark.createDataFrame([(1, rows[0][1]), (2, [0.0] * 8)], ASKED)
    index = vectorindex.build(corpus, cells=3)
    assert answers(vectorindex.search(questions, index, 20)) == brute(rows[:7], [(1, rows[0][1])], 20)
    nothing = vectorindex.build(corpus.where("false"))
    assert nothing.count() == 0 and vectorindex.search(questions, nothing, 3).count() == 0
    assert vectorindex.search(questions.where("false"), index, 3).count() == 0


def test_top_k_of_odd_vectors(spark, monkeypatch):
    one = lambda rows, schema: spark.createDataFrame(rows, schema)
    bad = [(1, None, 0.0), (2, [], 0.0), (3, [0.0, 0.0], 0.0), (4, [None, 1.0], 0.0), (None, [1.0, 1.0], 0.0)]
    questions = one([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (None, [1.0, 0.0])], ASKED)
    for group in (100, 0):
        monkeypatch.setattr(retrieval, "GROUP", group)
        assert retrieval.top_k(questions, one(bad, CORPUS), 3).count() == 0
        assert answers(retrieval.top_k(questions, one([*bad, (9, [1e-200, 0.0], 0.0), (8, [2.0, 2.0], 0.0)], CORPUS), 3)) == {1: [(9, 1.0), (8, round(0.5**0.5, 12))]}
        with pytest.raises(ValueError, match="differ in length"):
            retrieval.top_k(questions, one([(1, [1.0], 0.0), (2, [1.0, 2.0], 0.0)], CORPUS), 3)
        with pytest.raises(Exception, match="differ in length"):
            retrieval.top_k(questions, one([(1, [1.0, 1.0, 1.0], 0.0)], CORPUS), 3).collect()


def test_questions_go_to_groups_not_cells(spark, rows, tmp_path, monkeypatch):
    """Vectors that spread evenly are all visited, but a question travels once a group; a cell beyond a group comes in parts."""
    monkeypatch.setattr(vectorindex, "HELD", 600)
    monkeypatch.setattr(vectorindex, "VISITS", 40)
    rng = np.random.default_rng(8)
    even = [(k, x) for k, x in enumerate(rng.normal(size=(3000, 16)).tolist())]
    for data, path in ((even, "even"), (rows, "hot")):
        corpus = spark.createDataFrame([(i, x, 0.5) for i, x in data], CORPUS).repartition(6)
        questions = spark.createDataFrame(data[:120], ASKED)
        index, report = vectorindex.build(corpus, str(tmp_path / path)), {}
        assert answers(vectorindex.search(questions, index, 3, report)) == brute(data, data[:120], 3)
        assert 1 < report["groups"] < index.select("cell").distinct().count()
        assert report["sent"] <= 120 * (report["groups"] + 1) and report["sent"] <= report["visited"]
        if path == "even":
            assert report["visited"] > 0.9 * report["pairs"] > 2 * report["sent"]


def test_parts_of_a_large_cell(spark, monkeypatch):
    """One cell of many blocks: its parts are groups of their own and all are searched."""
    monkeypatch.setattr(vectorindex, "HELD", 3000)
    rng = np.random.default_rng(9)
    data = [(k, x) for k, x in enumerate(rng.normal(size=(9000, 4)).round(2).tolist()) if any(x)]
    index, report = vectorindex.build(spark.createDataFrame([(i, x, 0.5) for i, x in data], CORPUS), cells=1), {}
    questions = spark.createDataFrame(data[:30], ASKED)
    assert answers(vectorindex.search(questions, index, 5, report)) == brute(data, data[:30], 5)
    assert report["groups"] == 3 and index.count() == 3 and report["sent"] == 30


def test_a_small_corpus_is_met_by_block():
    """Memory for a batch of questions stays far below the products with all vectors, also where all tie."""
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    v = np.repeat([[0.6, 0.8]], 40_000, axis=0)
    batch = pa.RecordBatch.from_arrays([pa.array(range(256)), pa.array([[3.0, 4.0]] * 256)], ["qid", "v"])
    tracemalloc.start()
    out = next(retrieval._answered(SimpleNamespace(value=(np.arange(40_000)[::-1], v)), 3)([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.num_rows == 768 and out.column("vec_id").to_pylist()[:6] == [0, 1, 2, 0, 1, 2]
    assert peak < 256 * 40_000 * 8 * 2
