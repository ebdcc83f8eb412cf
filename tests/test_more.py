"""Grid containment, passages of a context, remembered vectors, word pieces, cells of a report, JSON as written."""

import math
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import vectors, wordpieces
from quern.operators import digest, retrieval
from quern.sources import sinks


def test_boxes_by_the_grid_equal_all_pairs(spark):
    rng = random.Random(3)
    boxes = []
    for k in range(400):
        w, h = (10 ** rng.uniform(-3, 3) for _ in range(2))
        x, y = rng.uniform(-500, 500), rng.uniform(-500, 500)
        boxes.append((k, k % 3, x, y, x + w, y + h))
    boxes += [(900, 0, 5.0, 5.0, 5.0, 5.0), (901, 1, 9.0, 0.0, 1.0, 2.0), (902, 1, None, 0.0, 1.0, 2.0), (903, 2, float("nan"), 0.0, 1.0, 1.0), (904, 2, -math.inf, -math.inf, math.inf, math.inf), (905, 0, 1e17, 1e17, 1e17, 1e17), (906, 0, -1e300, -1.0, 1e300, 1.0)]
    points = [(k, k % 3, rng.uniform(-600, 600), rng.uniform(-600, 600)) for k in range(1500)] + [(2000, 0, 5.5, 4.5), (2001, 0, 1e17, 1e17), (2002, 1, None, 0.0), (2003, 2, 1e200, -1e200), (2004, 0, 0.0, 0.0), (2005, None, 0.0, 0.0)]
    b = spark.createDataFrame(boxes, "box_id int, g int, x0 double, y0 double, x1 double, y1 double")
    p = spark.createDataFrame(points, "point_id int, g int, px double, py double").withColumn("_x", F.lit(1))
    for margin in (0.0, 1.0):
        got = {r.point_id: r.box_id for r in digest.first_containing(p, b, "g", F.col("px"), F.col("py"), margin).collect()}
        inside = lambda q, x: None not in (*q, *x) and q[1] == x[1] and x[2] - margin <= q[2] <= x[4] + margin and x[3] - margin <= q[3] <= x[5] + margin  # noqa: B023, E731
        assert got == {q[0]: min((x[0] for x in boxes if inside(q, x)), default=None) for q in points}
    plan = digest.first_containing(p, b, "g", F.col("px"), F.col("py"))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert digest.first_containing(p, b.where("false"), "g", F.col("px"), F.col("py")).where("box_id is null").count() == len(points)


def test_best_passage_equals_plain_maximum(spark):
    texts = ["the cat sat", "a dog ran", "cat and dog", " \n", None, "??"]
    contexts = [(1, texts), (2, ["a dog ran", "the cat sat"]), (3, []), (4, None), (5, [" "])]
    passages = spark.createDataFrame(contexts, "qid long, passages array<string>")
    dim = len(spark.createDataFrame([("x",)], "t string").select(vectors.hashed(F.col("t")).alias("v")).first().v)
    asked = {q: vectors._encode(["the cat ran"], dim)[0] for q in range(1, 7)}
    questions = spark.createDataFrame([(q, v.tolist()) for q, v in asked.items()], "qid long, v array<double>")
    got = {r.qid: (r.best, r.n_passages) for r in retrieval.best_passage(questions, passages, vectors.hashed).collect()}
    for q, some in [*contexts, (6, None)]:
        kept = [t for t in some or [] if t and t.strip()]
        scores = [float(asked[q] @ v) for t in kept if np.linalg.norm(v := vectors._encode([t], dim)[0]) > 0]
        assert got[q][1] == len(kept) and (got[q][0] == pytest.approx(max(scores)) if scores else got[q][0] is None)


def test_remembered_vectors(spark, tmp_path):
    path, seen = str(tmp_path / "store"), str(tmp_path / "seen")
    os.makedirs(seen)

    @F.pandas_udf("array<double>")
    def encode(t):
        import uuid

        for x in t:
            open(f"{seen}/{uuid.uuid4().hex}", "w").write(x)
        return t.map(lambda x: [float(len(x)), 1.0])

    rows = spark.createDataFrame([(1, "a"), (2, " a "), (3, "bb"), (4, None), (5, "")], "id long, text string").withColumn("_key", F.lit(1))
    for more, encoded in (([], 3), ([(6, "ccc"), (7, "bb")], 4)):
        df = rows.unionByName(spark.createDataFrame([(i, t, 1) for i, t in more], "id long, text string, _key int"))
        out = {r.id: r.embedding for r in retrieval.remembered(df, "text", path, encode).collect()}
        assert out == {r.id: None if r.text is None else [float(len(r.text.strip())), 1.0] for r in df.collect()}
        assert len(os.listdir(seen)) == encoded
        assert retrieval.remembered(df, "text", path, encode).count() == df.count() and len(os.listdir(seen)) == encoded


def test_word_pieces_equal_plain_loops(spark, tmp_path):
    rng = random.Random(4)
    vocabulary = sorted({("##" if rng.random() < 0.5 else "") + "".join(rng.choices("abc", k=rng.randrange(1, 5))) for _ in range(60)} | {".", "_", "##"})
    path = tmp_path / "v.txt"
    path.write_text("\n".join(vocabulary) + "\n\n", encoding="utf-8")
    known, p = set(wordpieces.read_vocabulary(str(path))), wordpieces.Pieces(vocabulary)

    def plain(word):
        n, at = 0, 0
        while at < len(word):
            end = next((e for e in range(len(word), at, -1) if ("##" if at else "") + word[at:e] in known), None)
            if end is None:
                return 1
            n, at = n + 1, end
        return n

    words = ["".join(rng.choices("abcd", k=rng.randrange(1, 12))) for _ in range(500)]
    assert [p.word(w) for w in words] == [plain(w) for w in words] and p.word("a" * 101) == 1
    assert p.count("Ab. Ç_b\n") == plain("ab") + 1 + plain("c") + 1 + plain("b")
    chunks = spark.createDataFrame([(1, "ab."), (2, None), (3, "")], "id long, chunk_passage string")
    got = [r.token_count for r in digest.chunk_audit(chunks, 3, wordpieces.counter(vocabulary)).orderBy("id").collect()]
    assert got == [plain("ab") + 3, None, 2]
    assert digest.chunk_audit(chunks).where("id = 1").first().token_count == 4


def test_cells_are_replaced(spark, tmp_path):
    path = str(tmp_path / "report")
    cell = lambda c, n: spark.createDataFrame([(k, c) for k in range(n)], "k long, cell string")
    for c, n in (("a", 3), ("b", 2), ("a", 3), ("a", 4)):  # a job that ran again, and one that made more
        sinks.replace_cells(cell(c, n), path, ["cell"])
    assert sorted((r.cell, r.k) for r in spark.read.parquet(path).collect()) == [("a", k) for k in range(4)] + [("b", k) for k in range(2)]


def test_json_as_written(spark, tmp_path):
    path = str(tmp_path / "o")
    sinks.write_object(spark, {"é": [1, None], "when": np.float64(2)}, path)
    (name,) = [f for f in os.listdir(path) if f.startswith("part-")]
    assert open(f"{path}/{name}", encoding="utf-8").read() == '{\n  "é": [\n    1,\n    null\n  ],\n  "when": 2.0\n}\n'


def test_split_in_one_pass_equals_plain_loops(spark):
    rng = random.Random(9)
    said = lambda: " ".join("".join(rng.choices("abcdef ", k=rng.randrange(1, 40))) + rng.choice(".!? ") for _ in range(rng.randrange(1, 30)))
    rows = [(k, said()) for k in range(150)] + [(900, None), (901, ""), (902, " . "), (903, "one"), (904, "Same. " * 2000)]
    df = spark.createDataFrame(rows, "key long, passage string").repartition(3)
    wanted = []
    for key, passage in rows:
        some = [x for x in re.split(r"(?<=[.!?])\s+", passage or "") if x.strip()]
        if not some:
            continue
        v = vectors._encode([" ".join(some[max(0, i - 1) : i + 2]) for i in range(len(some))], 16)
        gaps = []
        for x, y in zip(v, v[1:], strict=False):
            size = math.sqrt(sum(x * x)) * math.sqrt(sum(y * y))
            gaps.append(round(1 - sum(a * b for a, b in zip(x, y, strict=True)) / size, 12) if size else None)
        known = sorted(g for g in gaps if g is not None)
        at = (len(known) - 1) * 0.95
        edge = round(known[math.floor(at)] + (at - math.floor(at)) * (known[math.ceil(at)] - known[math.floor(at)]), 12) if known else 9
        cuts = [0, *(i + 1 for i, g in enumerate(gaps) if g is not None and g > edge), len(some)]
        wanted += [(key, n, " ".join(some[a:b])) for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    for most in (1, 20_000):
        assert sorted(map(tuple, digest.split_batches(df, vectors.encoder(16), most=most).collect())) == sorted(wanted)
    assert digest.split_batches(df.where("false"), vectors.encoder(16)).count() == 0
