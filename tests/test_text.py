"""Text rules against the documented cases."""

import pytest
from pyspark.sql import functions as F

from quern.functions import text, vectors
from quern.operators import digest, evaluation, reporting

CASES = [
    (text.repair_bullets, "●\nitem 1\nitem 2", "● item 1 item 2"),
    (text.repair_bullets, "●\n\nx", "●\n\nx"),
    (text.repair_bullets, " \n\t", "\n"),
    (text.merge_paragraph, "a\nb\n• c", "a\nb\n• c"),
    (text.merge_paragraph, "a\nb\nc", "a b c"),
    (text.merge_paragraph, "<img 3>", "<img 3>"),
    (text.normalize_passage, "a <img 7> b", "a\n\n<img 7>\n\nb"),
    (text.caption, "\nFigure 2a: cap\nmore\n\nbody", "Figure 2a: cap\nmore"),
    (text.caption, "body\n\nFigure 2: late", None),
    (text.normalize_space, "​ a\r\n\r\n\r\n\t b ", "a\n\n b"),
    (text.strip_markers, "<img 1>\n\n<t 2>\na | b\n</t>\n\nx", "a | b\n\nx"),
    (text.response_pattern, "no context from faiss", "Missing context statement"),
    (text.response_pattern, "the RAG system says", "Grounding/RAG exposure"),
    (text.response_pattern, None, "Faultless"),
]


@pytest.mark.parametrize("rule, given, wanted", CASES)
def test_rules(spark, rule, given, wanted):
    assert spark.createDataFrame([(given,)], "c string").select(rule(F.col("c"))).first()[0] == wanted


def test_contexts_cells_and_means(spark):
    rows = spark.createDataFrame([(None,), ("",), ("nan",), ("INSUFFICIENT CONTEXT!",), ("a\n\nb",)], "c string")
    assert [r[0] for r in rows.select(text.context_list(F.col("c"))).collect()] == [[], [], [], [], ["a", "b"]]
    cells = spark.createDataFrame([([["a", None], ["", ""], [""]],)], "c array<array<string>>")
    assert cells.select(text.flatten_cells(F.col("c"))).first()[0] == "a |\n|"
    means = spark.createDataFrame([(0.5, None), (None, None), (float("nan"), 1.0)], "a double, b double")
    assert [r[0] for r in means.select(vectors.mean_available(F.col("a"), F.col("b"))).collect()] == [0.5, None, 1.0]
    sd = spark.createDataFrame([(None, None), (1.0, None)], "m double, s double")
    assert [r[0] for r in sd.select(reporting.mean_sd_text(F.col("m"), F.col("s"))).collect()] == ["—", "1.00 ± nan"]


def test_image_contexts(spark):
    rows = spark.createDataFrame([("k", "p\n\nFigure 1: c\n\n<img 1>\n\n<img 2>\n\nq")], "subsection_key string, passage string")
    got = {r.figure_id: (r.antecedent, r.subsequent) for r in digest.image_contexts(rows).collect()}
    assert got[2] == ("p", "q")


def test_subsections_sharing_a_page(spark):
    headers = spark.createDataFrame([(0, 1, "A", 0, 1), (1, 2, "B", 1, 2), (2, 2, "C", 1, 2), (3, 1, "late", 9, 10)], "header_id int, hierarchy int, title string, page_index int, page_number int")
    blocks = spark.createDataFrame([(0, 0, "x"), (1, 0, "y"), (2, 0, "z")], "page_index int, block_no int, text string")
    got = {r.header_id: r.passage for r in digest.subsections(headers, blocks).collect()}
    assert got == {0: "x", 1: "", 2: "y z"}


def test_order_and_keep_last(spark):
    rows = spark.createDataFrame([("q_10", 1, 1), ("q_2", 1, 2), ("zzz", 1, 3), ("q_2", 2, 2)], "id string, seq int, score int")
    assert [r.id for r in rows.where("seq = 1").orderBy(evaluation.question_number(F.col("id"))).collect()] == ["q_2", "q_10", "zzz"]
    assert evaluation.keep_last(rows, ["id"], ["seq"]).where("id = 'q_2'").first().seq == 2


def test_precision_and_support(spark):
    v = spark.createDataFrame([([1, 0, 1],), ([0],), ([],)], "v array<int>")
    got = [r[0] for r in v.select(evaluation.context_precision(F.col("v"))).collect()]
    assert got[0] == pytest.approx((1 + 2 / 3) / 2) and got[1:] == [None, None]
    assert [r[0] for r in v.select(evaluation.supported_share(F.col("v"))).collect()][1:] == [0.0, None]


def test_upper_case_is_that_of_sql():
    import duckdb

    every = [chr(k) for k in range(1, 0x110000) if not 0xD800 <= k < 0xE000]
    wanted = duckdb.execute("SELECT list_transform(?, lambda c: upper(c))", [every]).fetchone()[0]
    assert [text.upper(c) for c in every] == wanted and text.upper("erßie") == "ERẞIE"
