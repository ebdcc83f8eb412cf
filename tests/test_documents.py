"""Documents to rows by the data source, images to files by the sink."""

import base64
import os

import pytest
from pyspark.sql import functions as F

from quern.operators import digest
from quern.sources import documents, images

PNG = bytes(range(256))
HTML = f"""<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{}}</style><script>var a="<p>no</p>";</script></head><body>
<p>before<h1>One</h1><!-- <p>no</p> --><p>a <b>bold</b> b<br>second<p>next</p>
<table><tr><th>x</th><td></td></tr><tr><td>1<br>2</td><td> y </td></tr></table><img src="data:image/PNG;base64,{base64.b64encode(PNG).decode()}">
<h2>Two <i>too</i></h2><table></table><img src="a/b.JPG"><img src="data:image/gif;base64,??"><ul><li>item<li>last</ul></body>"""


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    documents.register(spark)
    top = tmp_path_factory.mktemp("docs")
    for k in range(7):
        (top / f"d{k}.html").write_text(HTML if k < 5 else "", encoding="utf-8")
    (top / "_hidden").write_text("<h1>no</h1>")
    return str(top)


def read(spark, path, rows, **options):
    return spark.read.format("documents").option("path", path).option("rows", rows).options(**options).load()


def test_html_to_rows(spark, folder):
    outline = read(spark, folder, "outline").where("path like '%d3%'").drop("path").orderBy("pos").collect()
    assert [tuple(r) for r in outline] == [(0, 1, "One", 2, None), (1, 2, "Two too", 3, None)]
    blocks = read(spark, folder, "blocks").where("path like '%d0%'").orderBy("page_index", "block_no").collect()
    text = [(r.page_index, r.block_no, "\n".join("".join(x) for x in r.lines).strip(), r.table_no) for r in blocks]
    assert text == [(0, 0, "T & t", None), (0, 1, "before", None), (1, 0, "One", None), (1, 1, "a bold b\nsecond", None), (1, 2, "next", None), (1, 3, "x", 0), (1, 4, "1\n2", 0), (1, 5, "y", 0), (2, 0, "Two too", None), (2, 3, "item", None), (2, 4, "last", None)]
    tables = read(spark, f"file://{folder}", "tables").where("path like '%d1%'").orderBy("table_no").collect()
    assert [(r.page_index, r.table_no, r.bbox, r.cells) for r in tables] == [(1, 0, [0.0, 3.0, 1.0, 6.0], [["x", None], ["1\n2", " y "]]), (2, 1, [0.0, 1.0, 1.0, 2.0], None)]
    found = read(spark, folder, "images").where("path like '%d2%'").orderBy("page_index", "block_no").collect()
    assert [(r.page_index, r.block_no, r.image and bytes(r.image), r.ext) for r in found] == [(1, 6, PNG, "PNG"), (2, 1, None, "JPG"), (2, 2, None, "gif")]


def test_partitions_by_size_and_row_group(spark, folder, tmp_path):
    assert read(spark, folder, "outline", bytes=str(len(HTML.encode()) + 1)).rdd.getNumPartitions() >= 5
    assert read(spark, folder, "outline").rdd.getNumPartitions() == 1
    rows = [(k, HTML if k % 3 else None, "x") for k in range(30)]
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame(rows, "id long, body string, title string").repartition(3).write.parquet(path)
    got = read(spark, path, "outline", content="body", key="id", bytes="1")
    assert got.columns == ["id", "pos", "level", "title", "page", "error"] and got.rdd.getNumPartitions() == 3
    assert sorted((r.id, r.title) for r in got.collect()) == sorted((k, t) for k in range(30) if k % 3 for t in ("One", "Two too"))


def fails(content: bytes) -> documents.Document:
    if content:
        raise RuntimeError("no such format")
    return documents.Document()


def test_parsers_and_failures(spark, folder):
    name = "quern.sources.documents:html"
    assert read(spark, folder, "outline", parser=name).count() == 10
    with pytest.raises(Exception, match="can't be parsed"):
        read(spark, folder, "outline", parser="quern.sources.documents:_named").collect()
    bad = read(spark, folder, "tables", parser="quern.sources.documents:_named", mode="permissive").collect()
    assert len(bad) == 7 and all(r.error and r.cells is None for r in bad)
    with pytest.raises(Exception, match="rows is one of"):
        read(spark, folder, "nothing").collect()
    with pytest.raises(Exception, match="absent"):
        read(spark, folder + "/absent", "blocks").collect()


def test_rows_feed_the_operators(spark, folder):
    one = lambda rows: read(spark, f"{folder}/d0.html", rows)
    headers = digest.outline(one("outline"))
    tables = digest.table_records(one("tables"))
    assert [(r.table_id, r.text) for r in tables.orderBy("table_id").collect()] == [(1, "x |\n1\n2 | y"), (2, "[table detected but text extraction failed]")]
    blocks = one("blocks").withColumn("table_id", F.col("table_no") + 1)
    text = digest.page_text(blocks, tables)
    got = {r.title: r.passage for r in digest.subsections(headers, text).collect()}
    assert got["One"].startswith("One") and "<t 1>" in got["One"] and "bold" in got["One"] and got["Two too"].startswith("Two too")


def written(path):
    return {f: open(os.path.join(path, f), "rb").read() for f in os.listdir(path) if f[0] not in "._"}


def test_images_are_written_once(spark, tmp_path, folder):
    path = str(tmp_path / "img")
    rows = spark.range(40).select(F.concat(F.lit("i"), "id", F.lit(".png")).alias("name"), F.repeat(F.col("id").cast("string"), 1000).cast("binary").alias("content")).repartition(6)
    save = lambda df, mode: df.write.format("images").option("path", path).mode(mode).save()
    save(rows, "append")
    wanted = {f"i{k}.png": str(k).encode() * 1000 for k in range(40)}
    assert written(path) == wanted
    save(rows.where("name = 'i1.png'").withColumn("content", F.lit(b"new")), "append")
    assert written(path) == wanted | {"i1.png": b"new"}
    save(rows.where("name = 'i2.png'"), "overwrite")
    assert written(path) == {"i2.png": wanted["i2.png"]}
    save(rows.where("false"), "append")
    assert list(written(path)) == ["i2.png"]
    for bad in ("a/b.png", ".a", ""):
        with pytest.raises(Exception, match="no file name"):
            save(rows.withColumn("name", F.when(F.col("name") == "i7.png", bad).otherwise(F.col("name"))), "append")
    with pytest.raises(Exception, match="several images"):
        save(rows.withColumn("name", F.lit("same.png")), "append")
    with pytest.raises(Exception, match="name, content"):
        save(rows.select("name"), "append")
    assert list(written(path)) == ["i2.png"]


def test_lost_and_doubled_tasks_leave_one_file(tmp_path):
    import pyarrow as pa

    path = str(tmp_path / "img")
    batch = pa.RecordBatch.from_pydict({"name": ["a", "b"], "content": [b"1", None]})

    def broken():
        yield batch
        raise OSError("executor lost")

    w = images._Writer(path, False)
    with pytest.raises(OSError):
        w.write(broken())
    first, second = w.write(iter([batch])), w.write(iter([batch]))  # the second attempt isn't among the messages
    w.commit([None, first])
    assert written(path) == {"a": b"1", "b": b""} and second.folder != first.folder
    again = images._Writer(path, False)
    again.write(iter([batch]))
    again.abort([])
    assert written(path) == {"a": b"1", "b": b""}


def test_names_of_two_tasks_and_files_by_name(spark, tmp_path, folder):
    import pyarrow as pa

    from quern.sources.files import read_named

    path, batch = str(tmp_path / "img"), lambda *names: pa.RecordBatch.from_pydict({"name": list(names), "content": [b"x"] * len(names)})
    w = images._Writer(path, False)
    for parts in ([batch("a", "b"), batch("b", "c")], [batch("a", "b", "a")]):
        with pytest.raises(ValueError, match="several images are called [ab]"):
            w.commit([w.write(iter([b])) for b in parts])
        assert written(path) == {}
    message = w.write(iter([batch(*(f"n{k}" for k in range(1000)))]))
    assert len(message.keys) == 8000  # what the driver gets for each file
    w.commit([message])
    files = read_named(spark.range(0, 1000, 1, 7).select(F.concat(F.lit("n"), "id").alias("name")), path)
    assert files.rdd.getNumPartitions() == 7 and {tuple(r) for r in files.collect()} == {(f"n{k}", 1, b"x") for k in range(1000)}
    with pytest.raises(Exception, match="none"):
        read_named(spark.createDataFrame([("none",)], "name string"), path).collect()


def test_references_need_their_semicolon():
    found = documents.html(b"<h1>a&amp</h1><p>&ampx; &#65 &#65; &lt;b&am &amp;amp; &copy;</p><a>&amp</a>")
    assert found.outline == [(0, 1, "a&amp", 1)]
    assert ["".join(x) for x in found.blocks[1][3]] == ["&ampx; &#65 A <b&am &amp; \u00a9"]
    assert documents.html(b"<table>x<tr><td>1</table>").tables[0][3] == [["1"]]  # text before any row
