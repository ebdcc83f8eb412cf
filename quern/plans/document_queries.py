"""Queries on documents as the data source reads them, and on images as the sink writes them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text
from quern.operators import digest
from quern.plans.digest_queries import _MERGED
from quern.plans.registry import registrar
from quern.sources import documents, shared

QUERIES: dict = {}
query = registrar(QUERIES)
_c = F.col


def _read(spark, path: str, rows: str, key: str, content: str):
    documents.register(spark)
    return spark.read.format("documents").option("path", path).option("rows", rows).option("key", key).option("content", content).load()


def _pages(spark, sf_dir: str, rows: str):
    return _read(spark, f"{sf_dir}/pages.parquet", rows, "page_id", "html").drop("error")


_TAGS = "|".join(sorted(documents._BLOCKS))
_PLAIN = "replace(replace(replace(replace(replace(replace(x, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
_texts = lambda html: f"""
WITH s AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->|<![^>]*>', '', 'g'), '<br[^>]*>', chr(10), 'g') AS x FROM (SELECT page_id, {html} AS html FROM pages) p),
t AS (SELECT page_id, regexp_replace(regexp_replace(x, '</?(?:{_TAGS})(?:\\s[^>]*)?>', chr(1), 'g'), '<[^>]*>', '', 'g') AS x FROM s),
b AS (SELECT page_id, unnest(string_split({_PLAIN}, chr(1))) AS x, unnest(range(1, len(string_split(x, chr(1))) + 1)) AS k FROM t),
c AS (SELECT page_id, k, trim(x, ' ' || chr(9) || chr(10) || chr(13)) AS x FROM b WHERE trim(x, ' ' || chr(9) || chr(10) || chr(13)) <> '')
"""  # noqa: E731
_TITLE = "SELECT page_id, trim(regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1)) AS x FROM pages"


@query(f"SELECT page_id, 0::BIGINT AS header_id, 1 AS hierarchy, trim(regexp_replace({_PLAIN}, '[ \\t]+', ' ', 'g')) AS title, 1 AS page_index, 2 AS page_number FROM ({_TITLE}) p WHERE x <> ''")
def reader_outline(spark, sf_dir):
    """Headings of all pages, read and parsed by the data source."""
    return digest.outline(_pages(spark, sf_dir, "outline"), ["page_id"])


@query(f"{_texts('html')} SELECT page_id, count(*) AS n_blocks, md5(string_agg(x, chr(1) ORDER BY k)) AS blocks_md5 FROM c GROUP BY page_id")
def reader_blocks(spark, sf_dir):
    """The text blocks of all pages in order."""
    shown = text.strip(F.array_join(F.transform("lines", lambda x: F.array_join(x, "")), "\n"))
    blocks = _pages(spark, sf_dir, "blocks").select("page_id", "page_index", "block_no", shown.alias("text"))
    order = [_c("page_index"), _c("block_no")]
    return blocks.groupBy("page_id").agg(F.count("*").alias("n_blocks"), F.md5(digest.ordered_join(order, _c("text"), "\x01").cast("binary")).alias("blocks_md5"))


@query(f"""{_texts("substr(html, strpos(html, '<h1'))")},
o AS (SELECT page_id, string_agg(array_to_string(list_transform(string_split(x, chr(10)), lambda y: trim(y)), chr(10)), chr(10) ORDER BY k) AS raw FROM c GROUP BY 1),
p AS (SELECT page_id, array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace(raw, '[ \t]*\n[ \t]*', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), chr(10) || chr(10)), lambda x: {_MERGED}), lambda x: x <> ''), chr(10) || chr(10)) AS passage FROM o)
SELECT page_id, length(passage) AS char_count, md5(passage) AS passage_md5 FROM p
""")
def reader_subsections(spark, sf_dir):
    """Outline and blocks of the data source to passages by heading."""
    headers = digest.outline(_pages(spark, sf_dir, "outline"), ["page_id"])
    blocks = digest.page_text(_pages(spark, sf_dir, "blocks"), by=["page_id"])
    out = digest.subsections(headers, blocks, ["page_id"])
    return out.select("page_id", _c("char_count").cast("long").alias("char_count"), F.md5(_c("passage").cast("binary")).alias("passage_md5"))


@query("SELECT l_orderkey, 1 AS page_index, 0 AS table_no, count(*) AS n_lines, md5(string_agg(l_linenumber || ' | ' || l_partkey, chr(10) ORDER BY l_linenumber, l_partkey)) AS table_md5 FROM lineitem GROUP BY l_orderkey")
def reader_tables(spark, lineitem):
    """Every order as a document with a table of its lines, written by Spark and read back by the data source."""
    row = F.concat(F.lit("<tr><td>"), "l_linenumber", F.lit("</td><td> "), "l_partkey", F.lit("\n</td></tr>"))
    body = F.concat(F.lit("<p>order</p><h1>lines</h1><table>"), digest.ordered_join([_c("l_linenumber"), _c("l_partkey")], row, ""), F.lit("</table>"))
    path = shared.folder(spark, "orders")
    lineitem.groupBy("l_orderkey").agg(body.alias("html")).write.parquet(path)
    found = _read(spark, path, "tables", "l_orderkey", "html")
    return found.select("l_orderkey", "page_index", "table_no", F.size("cells").cast("long").alias("n_lines"), F.md5(text.table_text(_c("cells")).cast("binary")).alias("table_md5"))


@query("SELECT 'doc_p' || lpad((p_size + 1)::VARCHAR, 3, '0') || '_img' || CASE WHEN row_number() OVER (ORDER BY p_size, p_partkey) < 10000 THEN lpad(row_number() OVER (ORDER BY p_size, p_partkey)::VARCHAR, 4, '0') ELSE row_number() OVER (ORDER BY p_size, p_partkey)::VARCHAR END || '.png' AS name, length(p_name) AS n_bytes, md5(p_name) AS content_md5 FROM part")
def image_sink(spark, part):
    """Image records written to files under their names, and the files read back."""
    from quern.sources.files import read_named

    documents.register(spark)
    path = shared.folder(spark, "images")
    found = part.select(_c("p_size").alias("page_index"), _c("p_partkey").alias("block_no"), F.lit(None).alias("bbox"), _c("p_name").cast("binary").alias("image"), F.lit(".PNG").alias("ext"))
    records = digest.image_records(found, F.lit("doc"), path).where("error is null")
    named = records.select(F.substring_index("image_path", "/", -1).alias("name"), _c("image").alias("content"))
    named.write.format("images").option("path", path).mode("append").save()
    return read_named(named, path).select("name", _c("length").alias("n_bytes"), F.md5("content").alias("content_md5"))


@query("SELECT p_partkey, CASE WHEN p_size % 5 > 0 THEN 2 END::INT AS width, CASE WHEN p_size % 5 > 0 THEN 1 END::INT AS height, CASE WHEN p_size % 5 > 0 THEN lpad(to_hex(p_partkey), 6, '0') || lpad(to_hex(p_size), 6, '0') END AS pixels, p_size % 5 = 0 AS failed FROM part")
def image_rgb(part):
    """Image files of two pixels for each part, some of them cut short, to RGB."""
    from quern.functions.pixels import rgb

    colour = lambda c: F.lpad(F.hex(c), 6, "0")
    body = F.unhex(F.concat(colour(_c("p_partkey")), F.when(_c("p_size") % 5 > 0, colour(_c("p_size"))).otherwise(F.lit(""))))
    p = part.select("p_partkey", rgb(F.concat(F.lit("P6 2 1 255\n").cast("binary"), body)).alias("p"))
    return p.select("p_partkey", "p.width", "p.height", F.hex("p.pixels").alias("pixels"), _c("p.error").isNotNull().alias("failed"))
