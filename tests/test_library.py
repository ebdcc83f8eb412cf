"""Operators against plain Python on generated rows, and the branches that the registered queries don't reach."""

import json
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import text, vectors
from quern.operators import digest, evaluation, prompts, reporting, retrieval
from quern.plans import answer
from quern.sources import files, sinks

BULLETS = "●•▪▫◦"


def encoded(x, dim):
    out = np.zeros(dim)
    for w in re.findall(r"[^\W_]+", (x or "").lower()):
        h = zlib.crc32(w.encode())
        out[(h >> 1) % dim] += 1 if h & 1 else -1
    return out / np.linalg.norm(out) if out.any() else out


def cosine(a, b):
    return float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)) if a.any() and b.any() else None


def lines_at_random(rng):
    some = ["", "", " ", "●", "• ", "plain", "more text", "• item", "<img 3>", "▪\t", "x  y"]
    return "\n".join(rng.choice(some) for _ in range(rng.randrange(1, 12)))


def repaired(x):
    lines = [re.sub("[ \t]+", " ", y).strip() for y in x.split("\n")]
    if not any(lines):
        return "\n"
    out, grows = [], False
    for k, y in enumerate(lines):
        lone = k + 1 == len(lines) or not lines[k + 1]
        if y and y in BULLETS:
            out.append(y if lone else y + " ")
            grows = not lone
        elif y and grows:
            out[-1] += y if out[-1][-1] == " " else " " + y
        else:
            out.append(y)
            grows = False
    return re.sub("\n{3,}", "\n\n", "\n".join(out)).strip("\n")


def merged(x):
    lines = [y for y in (re.sub("[ \t]+", " ", z).strip() for z in x.split("\n")) if y]
    item = lambda y: bool(re.match(f"[{BULLETS}] ", y))
    if not x.strip():
        return ""
    if re.fullmatch(r"<img\s+\d+>", x.strip()):
        return x.strip()
    out, open_ = [], False
    for k, y in enumerate(lines):
        hard = item(y) or (k + 1 < len(lines) and item(lines[k + 1])) or bool(re.fullmatch(r"<img\s+\d+>", y))
        if open_ and not hard:
            out[-1] += " " + y
        else:
            out.append(y)
        open_ = not hard
    return "\n".join(out)


def test_lines_by_plain_rules(spark):
    rng = random.Random(1)
    some = [lines_at_random(rng) for _ in range(400)]
    rows = spark.createDataFrame([(x,) for x in some], "c string").select("c", text.repair_bullets(F.col("c")).alias("r"), text.merge_paragraph(F.col("c")).alias("m")).collect()
    assert [r.r for r in rows] == [repaired(x) for x in some]
    assert [r.m for r in rows] == [merged(x) for x in some]


def test_split_by_meaning(spark):
    rng = random.Random(2)
    made = [" ".join("".join(rng.choice("abcd") for _ in range(2)) for _ in range(rng.randrange(1, 7))) + rng.choice(".!?") for _ in range(400)]
    texts = [" ".join(rng.choice(made) for _ in range(rng.randrange(1, 25))) for _ in range(60)] + ["one", "", " ", ". . .", None]
    want = set()
    for key, x in enumerate(texts):
        s = [y for y in re.split(r"(?<=[.!?])\s+", x or "") if y.strip()]
        v = [encoded(" ".join(s[max(0, k - 1) : k + 2]), 16) for k in range(len(s))]
        gaps = [None if (c := cosine(a, b)) is None else 1 - c for a, b in zip(v, v[1:], strict=False)]
        known = [g for g in gaps if g is not None]
        edge = np.percentile(known, 95) if known else None
        at = [0, *(k + 1 for k, g in enumerate(gaps) if g is not None and g > edge + 1e-12), len(s)] if s else []
        want |= {(key, k, " ".join(s[a:b])) for k, (a, b) in enumerate(zip(at, at[1:], strict=False))}
    rows = spark.createDataFrame(list(enumerate(texts)), "key long, passage string")
    got = digest.semantic_split(rows, lambda c: vectors.hashed_all(c, 16))
    assert {tuple(r) for r in got.collect()} == want


def test_similarities_by_plain_rules(spark):
    rng = random.Random(3)
    said = lambda: rng.choice([None, "", " ".join(rng.choice("abcdef") * 2 for _ in range(4)), "aa bb\n\ncc dd\n\n\n ee"])
    rows = [(k, said(), said(), said(), said()) for k in range(80)]
    df = spark.createDataFrame(rows, "k long, q string, a string, r string, c string")
    for got in evaluation.semantic(df, vectors.hashed_all, "q", "a", "r", "c").collect():
        _, q, a, r, c = rows[got.k]
        v = {n: None if x is None else encoded(x, 64) for n, x in (("q", q), ("a", a), ("r", r))}
        near = lambda x, y: None if x is None or y is None else cosine(x, y)
        passages = [encoded(p, 64) for p in (c or "").split("\n\n") if p.strip()]
        best = lambda x: max((s for p in passages if (s := near(p, x)) is not None), default=None)
        want = [near(v["a"], v["r"]), near(v["q"], v["a"]), best(v["r"]), best(v["q"])]
        found = [got.answer_reference, got.question_answer, got.context_reference, got.question_context]
        assert [None if x is None else round(x, 9) for x in found] == [None if x is None else round(x, 9) for x in want]
        known = [x for x in want if x is not None]
        assert got.semantic_mean is None if not known else got.semantic_mean == pytest.approx(np.mean(known))


def test_encoders(spark):
    texts = ["a b a", "", None, "Ünï x_y", "a b a"]
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select(vectors.hashed(F.col("t"), 8).alias("v")).collect()
    for r, x in zip(rows, texts, strict=True):
        assert r.v is None if x is None else np.allclose(r.v, encoded(x, 8))
    images = spark.createDataFrame([(b"ab",), (b"",), (None,)], "b binary").select(vectors.hashed_bytes(F.col("b"), 64).alias("v")).collect()
    assert np.isclose(np.linalg.norm(images[0].v), 1) and [r.v for r in images[1:]] == [None, None]


def test_top_k_over_several_groups(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "GROUP", 100)
    rng = np.random.default_rng(4)
    v = rng.normal(size=(700, 6)).round(1)
    v[100:140] = v[0]
    v[7] = 0
    corpus = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)] + [(9000, None)], "vec_id long, v array<double>").repartition(5)
    asked = [0, 7, 101, 300, 699]
    queries = corpus.where(F.col("vec_id").isin(asked)).withColumnRenamed("vec_id", "qid")
    got = {}
    for r in retrieval.top_k(queries, corpus, 5).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.vec_id))
    unit = v / np.where(np.linalg.norm(v, axis=1, keepdims=True) > 0, np.linalg.norm(v, axis=1, keepdims=True), np.nan)
    for q in asked:
        s = (unit @ unit[q]).round(12)
        best = [int(k) for k in np.lexsort((np.arange(700), -np.nan_to_num(s, nan=-9))) if not np.isnan(s[k])][:5]
        assert sorted(got.get(q, [])) == list(enumerate(best, 1))
    assert retrieval.top_k(queries, corpus.where("vec_id < 2"), 5).where("qid = 0").count() == 2
    assert retrieval.top_k(queries, corpus.where("false"), 5).count() == retrieval.top_k(queries.where("false"), corpus, 5).count() == 0


def test_numbers_and_places(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["hot"] * 9 + ["b", None]), rng.randrange(50), k) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, x int, k long").repartition(7)
    order = lambda r: (r[0] is not None, r[0] or "", r[1], r[2])
    want = {r[2]: n for n, r in enumerate(sorted(rows, key=order), 1)}
    assert {r.k: r.n for r in retrieval.number(df, ["g", "x", "k"], "n", start=1).collect()} == want
    groups = {}
    for r in sorted(rows, key=order):
        groups.setdefault(r[0], []).append(r[2])
    got = retrieval.places(df, ["g"], [F.col("x"), F.col("k")], "at", "size").collect()
    assert len(got) == 500 and all(groups[r.g][r.at] == r.k and r.size == len(groups[r.g]) for r in got)
    parts = evaluation.split_work(df, ["g"], [F.col("x"), F.col("k")], 4).collect()
    for r in parts:
        assert r.worker_id == groups[r.g].index(r.k) // -(-len(groups[r.g]) // 4) + 1


def test_page_text_and_tables(spark):
    tables = spark.createDataFrame([(0, 0, [["a", None], [" b ", "c"]]), (0, 1, None), (1, 0, [[" "]])], "page_index int, table_no int, cells array<array<string>>").withColumn("bbox", F.lit("box"))
    records = digest.table_records(tables)
    assert [(r.table_id, r.text) for r in records.orderBy("table_id").collect()] == [(1, "a |\nb | c"), (2, text.TABLE_FAILURE), (3, text.TABLE_FAILURE)]
    blocks = spark.createDataFrame([(0, 0, [["one ", "two"], ["three"]], None), (0, 1, [["x"]], 1), (0, 2, [["y"]], 1), (1, 0, [[" "]], None), (1, 1, [["●"], ["item"]], None)], "page_index int, block_no int, lines array<array<string>>, table_id long")
    got = [r.text for r in digest.page_text(blocks, records).orderBy("page_index", "block_no").collect()]
    assert got == ["one two\nthree", "\n\n<t 1>\na |\nb | c\n</t>\n\n", "\n", "● item"]
    assert [r.text for r in digest.page_text(blocks).orderBy("page_index", "block_no").collect()][1:3] == ["x", "y"]


def test_subsections_of_several_documents(spark):
    headers = spark.createDataFrame([("a", 0, "A", 1), ("a", 1, "B", 1), ("a", 2, "late", 9), ("b", 0, "C", 0), ("c", 0, "none", 0)], "doc string, header_id int, title string, page_index int")
    blocks = spark.createDataFrame([("a", 0, 0, "before"), ("a", 1, 0, "x  y"), ("a", 2, 1, "<img 4> z"), ("a", 2, 0, "w"), ("b", 0, 0, "q")], "doc string, page_index int, block_no int, text string")
    got = digest.subsections(headers, blocks, ["doc"])
    assert sorted((r.doc, r.header_id, r.passage, r.image_marker_count) for r in got.collect()) == [("a", 0, "", 0), ("a", 1, "x y w\n\n<img 4>\n\nz", 1), ("b", 0, "q", 0)]
    assert got.select("subsection_key").where("doc = 'b'").first()[0] == "000::C"
    plan = got._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "SinglePartition" not in plan
    pages = spark.createDataFrame([(0, 1, " T\n", 0), (1, 2, "U", 3)], "pos int, level int, title string, page int")
    assert [tuple(r) for r in digest.outline(pages).collect()] == [(1, 2, "U", 2, 3)]
    with pytest.raises(ValueError, match="outline"):
        files.require_headers(digest.outline(pages.where("false")))


def test_keys_cover(spark):
    keys = lambda *ids: spark.createDataFrame([(i, "m", None) for i in ids], "id int, model_name string, architecture_config string")
    assert tuple(evaluation.cover(keys(1, 2, 3), keys(2, 3, 3, 4, 4)).first()) == (1, 1, 2)  # nulls are equal
    full = lambda *ids: keys(*ids).fillna("x")
    evaluation.require_cover(full(1, 2), full(2, 1))
    with pytest.raises(ValueError, match="1 missing"):
        evaluation.require_cover(full(1, 2), full(2))
    both = evaluation.merged([full(1, 2).withColumn("s", F.lit(1)), full(2).withColumn("s", F.lit(2))])
    assert sorted((r.id, r.s) for r in both.collect()) == [(1, 1), (2, 2)]


def test_judging_with_retries(spark, tmp_path):
    log = str(tmp_path / "tries")

    def score(row):
        with open(log, "a") as f:
            f.write(f"{row['id']}\n")
        tries = open(log).read().split().count(row["id"])
        if row["id"] == "never" or (row["id"] == "third" and tries < 3):
            raise OSError(f"no {row['id']}")
        return {"m": 0.5}

    rows = spark.createDataFrame([("first",), ("third",), ("never",)], "id string").coalesce(1).withColumns({"model_name": F.lit("m"), "architecture_config": F.lit("SLM")})
    judged = spark.createDataFrame(evaluation.judge(rows, score, ["m"], base_seconds=0.01).collect(), "id string, model_name string, architecture_config string, m double, error_type string, error_message string")
    assert {r.id: (r.m, r.error_type, r.error_message) for r in judged.collect()} == {"first": (0.5, None, None), "third": (0.5, None, None), "never": (None, "OSError", "no never")}
    assert sorted(open(log).read().split()) == ["first", *["never"] * 3, *["third"] * 3]
    failed = evaluation.failures(judged, F.lit(2)).collect()
    assert [(r.worker_id, r.id, r.error_type) for r in failed] == [(2, "never", "OSError")] and re.fullmatch(r"[-0-9]{10}T[:0-9]{8}", failed[0].timestamp)
    with pytest.raises(RuntimeError, match="1 keys missing, 1 rows failed"):
        evaluation.completed(rows, judged)
    assert evaluation.completed(rows.where("id <> 'never'"), judged.where("id <> 'never'")).count() == 2


def test_routing_needs_an_image(spark):
    rows = spark.createDataFrame([("SLM", None), ("Text-RAG", None), ("Image-RAG", "i")], "c string, image string")
    assert [tuple(r[0]) for r in rows.select(evaluation.route(F.col("c"), F.col("image"))).collect()] == [(False, False, False), (True, True, False), (True, False, True)]
    with pytest.raises(Exception, match="needs an image"):
        rows.withColumn("image", F.lit(None)).select(evaluation.route(F.col("c"), F.col("image"))).collect()


def test_prompts_and_lookups(spark):
    rows = spark.createDataFrame([(None,), (" ",), (" Insufficient context! ",), ("a passage",)], "c string")
    got = rows.select(prompts.response_mode(F.col("c")).alias("mode"), prompts.prompt(F.lit("why {x}?"), F.col("c")).alias("p")).collect()
    assert [r.mode for r in got] == ["GENERAL_ENT"] * 3 + ["REFERENCE_SUPPORTED"]
    assert all("why {x}?" in r.p and prompts.DISCLAIMERS[r.mode] in r.p for r in got) and "    a passage\n" in got[3].p
    assert rows.limit(1).select(prompts.system(F.lit("2026-01-05").cast("date"))).first()[0].startswith("Today: 05 January 2026\n")
    table = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    found = retrieval.strict_lookup(spark.createDataFrame([(1,), (2,)], "k int"), table, "k", "v")
    assert sorted(map(str, (r.v for r in found.collect()))) == ["None", "x"]
    with pytest.raises(Exception, match="no v for k 3"):
        retrieval.strict_lookup(spark.createDataFrame([(3,)], "k int"), table, "k", "v").collect()
    questions = spark.createDataFrame([(1, "q", [1.0, 0.0])], "qid long, question string, v array<double>")
    asked = answer.ask(questions, spark.createDataFrame([(5, [1.0, 0.1]), (6, [0.0, 1.0])], "vec_id long, v array<double>"), spark.createDataFrame([(5, "five"), (6, " ")], "vec_id long, passage string"), F.lit("2026-01-05").cast("date")).first()
    assert asked.rag_context == "five" and "    five\n" in asked.prompt and "REFERENCE_SUPPORTED" in asked.prompt


def test_reports(spark):
    rows = spark.createDataFrame([("x", "s", 1.0), ("x", "t", 2.0), ("x", "s", 3.0), ("y", "t", 4.0), (None, "s", 5.0)], "m string, e string, v double")
    got = reporting.pivot_counts(rows, "m", "e", ["s", "t"], ["y", "absent", "x"]).orderBy("place").collect()
    assert [(r.m, r.s, r.t) for r in got] == [("y", 0, 1), ("absent", None, None), ("x", 2, 1)]
    both = {r.m: (r.v_s, r.v_t, r.v_difference) for r in reporting.compare(rows, ["m"], "e", ["s", "t"], ["v"]).collect()}
    assert both == {"x": (2.0, 2.0, 0.0), "y": (None, 4.0, None), None: (5.0, None, None)}
    last = reporting.stage_times(rows.withColumn("at", F.col("v")), "m", "e", "v", ["s", "t"], accumulate=False, ts="at")
    assert {r.m: (r.s, r.t) for r in last.collect()}["x"] == (3.0, 2.0)


def test_files_and_reports_written(spark, tmp_path):
    at = str(tmp_path)
    sinks.write_csv(spark.createDataFrame([(1, "é")], "a int, b string").coalesce(1), f"{at}/c", mark=True)
    assert next((tmp_path / "c").glob("part-*")).read_bytes().startswith("﻿a,b".encode())
    assert [tuple(r) for r in files.read_csv(spark, f"{at}/c", "a int, b string").collect()] == [(1, "é")]
    sinks.export({"one": spark.range(2), "none": None}, f"{at}/e")
    assert {p.name for p in (tmp_path / "e").iterdir()} == {"one"}
    assert sinks.delete(spark, f"{at}/e") and not sinks.delete(spark, f"{at}/e")
    with pytest.raises(KeyError), sinks.Performance(spark, f"{at}/p") as p:
        for _ in range(2):
            with p.stage("a"):
                pass
        raise KeyError("stopped")
    report = json.loads(next((tmp_path / "p").glob("part-*")).read_text())
    assert report["status"] == "failed" and list(report["stages"]) == ["a"] and "stopped" in report["error"]
    (tmp_path / "l.json").write_text('{"k1": {"x": 1}, "k2": {"x": null}}')
    assert sorted(map(str, files.read_lookup(spark, f"{at}/l.json", "x: int").collect())) == ["Row(key='k1', x=1)", "Row(key='k2', x=None)"]
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "f").write_bytes(b"12345")
    assert sinks.folder_bytes(spark, f"{at}/b").first()[0] == 5
    sinks.write_json(spark.createDataFrame([(1, None)], "a int, b string").coalesce(1), f"{at}/j")
    assert json.loads(next((tmp_path / "j").glob("part-*")).read_text()) == {"a": 1, "b": None}
    with pytest.raises(FileNotFoundError, match="no1"):
        files.require_paths([f"{at}/b", f"{at}/no1"], spark)
    (tmp_path / "env").write_text("A=1\nB= \n")
    assert files.read_environment({"A": "0", "B": "2", "C": None, "D": "d"}, f"{at}/env", {"B": "", "C": "c"}) == {"A": "1", "B": "2", "C": "c", "D": "d"}
    (tmp_path / "bad").write_bytes(b"\xff\xfe=\x00")
    with pytest.raises(OSError, match="can't be read"):
        files.read_settings(f"{at}/bad")


def test_sessions_over_batches(spark, tmp_path):
    from quern.streaming import chat

    said = lambda *rows: spark.createDataFrame(rows, "conv_id long, turn long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    said((1, 1, "a"), (2, 1, "x"))
    turns = spark.readStream.schema("conv_id long, turn long, text string").parquet(str(tmp_path / "in"))
    q = chat.sessions(turns, lambda t, history: f"{len(history)}:{t}").writeStream.format("memory").queryName("later").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    said((1, 2, "b"), (2, 2, "/clear"), (2, 3, "y"))
    q.processAllAvailable()
    q.stop()
    assert sorted((r.conv_id, r.turn, r.answer) for r in spark.table("later").collect()) == [(1, 1, "0:a"), (1, 2, "2:b"), (2, 1, "0:x"), (2, 3, "0:y")]
