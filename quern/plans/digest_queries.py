"""Digest queries: documents and pages to passages, chunks and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text
from quern.operators import digest, retrieval
from quern.plans.registry import registrar

QUERIES: dict = {}
query = registrar(QUERIES)
_c = F.col


@query("SELECT page_id, (pos - 1)::BIGINT AS header_id, 1 AS hierarchy, trim(regexp_replace(title, '[ \\t]+', ' ', 'g'), ' ' || chr(10)) AS title, pos - 1 AS page_index, pos AS page_number FROM (SELECT page_id, unnest(range(1, len(t) + 1)) AS pos, unnest(t) AS title FROM (SELECT page_id, regexp_extract_all(html, '<h1[^>]*>([^<]*)</h1>', 1) AS t FROM pages)) x")
def outline_scan(pages):
    found = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("<h1[^>]*>([^<]*)</h1>"), F.lit(1))).alias("pos", "title"))
    entries = found.select("page_id", _c("pos").cast("long").alias("pos"), F.lit(1).alias("level"), "title", (_c("pos").cast("long") + 1).alias("page"))
    return digest.outline(entries, ["page_id"])


_MERGED = "array_to_string(list_filter(list_transform(string_split(x, chr(10)), lambda y: trim(regexp_replace(y, '[ \\t]+', ' ', 'g'))), lambda y: y <> ''), ' ')"


@query(f"""
WITH h AS (SELECT conv_id, turn AS header_id, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations WHERE role = 'user'),
o AS (SELECT h.conv_id, h.header_id, string_agg(c.text, chr(10) ORDER BY c.turn) AS raw FROM h JOIN conversations c ON c.conv_id = h.conv_id AND c.turn >= h.header_id AND (h.next IS NULL OR c.turn < h.next) GROUP BY 1, 2),
p AS (SELECT conv_id, header_id, array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace(raw, '[ \t]*\n[ \t]*', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), chr(10) || chr(10)), lambda x: {_MERGED}), lambda x: x <> ''), chr(10) || chr(10)) AS passage FROM o)
SELECT conv_id, header_id, CASE WHEN header_id < 1000 THEN lpad(header_id::VARCHAR, 3, '0') ELSE header_id::VARCHAR END || '::turn' AS subsection_key, length(passage) AS char_count, md5(passage) AS passage_md5 FROM p
""")
def subsections(conversations):
    """Every user turn heads a subsection that runs to the next one; a conversation is a document, a turn a page."""
    headers = conversations.where("role = 'user'").select("conv_id", _c("turn").alias("header_id"), F.lit("turn").alias("title"), _c("turn").alias("page_index"))
    blocks = conversations.select("conv_id", _c("turn").alias("page_index"), F.lit(0).alias("block_no"), "text")
    out = digest.subsections(headers, blocks, ["conv_id"])
    return out.select("conv_id", "header_id", "subsection_key", _c("char_count").cast("long").alias("char_count"), F.md5(_c("passage").cast("binary")).alias("passage_md5"))


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_size, p_partkey) AS table_id, p_size AS page_index, CASE WHEN p_size % 3 = 0 THEN '[table detected but text extraction failed]' WHEN p_size % 3 = 1 THEN p_name || ' | ' || p_brand ELSE p_type END AS text FROM part")
def table_scan(part):
    """Tables with cells, without readable cells (null) and with blank ones."""
    one = lambda *c: F.array(*c)
    none = F.lit(None).cast("string")
    cells = F.when(_c("p_size") % 6 == 0, F.lit(None)).when(_c("p_size") % 3 == 0, one(one(F.lit(" ")))).when(_c("p_size") % 3 == 1, one(one("p_name", "p_brand"))).otherwise(one(one("p_type"), one(none)))
    found = part.select("p_partkey", _c("p_size").alias("page_index"), _c("p_partkey").alias("table_no"), _c("p_partkey").alias("bbox"), cells.alias("cells"))
    return digest.table_records(found).select(_c("bbox").alias("p_partkey"), _c("table_id").cast("long").alias("table_id"), "page_index", "text")


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_size, p_partkey) AS image_id, CASE WHEN p_size % 4 <> 0 THEN 'img/doc_p' || lpad((p_size + 1)::VARCHAR, 3, '0') || '_img' || CASE WHEN row_number() OVER (ORDER BY p_size, p_partkey) < 10000 THEN lpad(row_number() OVER (ORDER BY p_size, p_partkey)::VARCHAR, 4, '0') ELSE row_number() OVER (ORDER BY p_size, p_partkey)::VARCHAR END || '.png' END AS image_path, CASE WHEN p_size % 4 = 0 THEN 'the image has no bytes' END AS error FROM part")
def image_scan(part):
    """Images without bytes keep their number, with an error and no path."""
    data = F.when(_c("p_size") % 8 == 0, F.lit(b"")).when(_c("p_size") % 4 != 0, _c("p_name").cast("binary"))
    found = part.select(_c("p_size").alias("page_index"), _c("p_partkey").alias("block_no"), _c("p_partkey").alias("bbox"), data.alias("image"), F.lit(".PNG").alias("ext"))
    return digest.image_records(found, F.lit("doc"), "img").select(_c("bbox").alias("p_partkey"), _c("image_id").cast("long").alias("image_id"), "image_path", "error")


@query("SELECT p_partkey, p_partkey AS figure_id, 'Figure ' || p_partkey || ': ' || p_brand AS caption, p_name AS antecedent, p_type AS subsequent FROM part")
def image_context(part):
    """Caption and nearest paragraphs of an image, over another image and its own caption."""
    marker = F.concat(F.lit("\n\n<img "), _c("p_partkey"), F.lit("> "))
    passage = F.concat(_c("p_name"), F.lit("\n\nFigure 0: other"), marker, F.lit("Figure "), _c("p_partkey"), F.lit(": "), _c("p_brand"), F.lit("\n\n<img 999999999>\n\n"), _c("p_type"))
    found = digest.image_contexts(part.select(_c("p_partkey").alias("subsection_key"), passage.alias("passage"))).where("figure_id <> 999999999")
    return found.select(_c("subsection_key").alias("p_partkey"), _c("figure_id").cast("long").alias("figure_id"), "caption", "antecedent", "subsequent")


@query("SELECT p_partkey, p_size % 4 = 0 AS plain FROM part")
def paragraph_kind(part):
    shown = F.when(_c("p_size") % 4 == 0, _c("p_name")).when(_c("p_size") % 4 == 1, F.concat(F.lit(" <img "), "p_size", F.lit("> "))).when(_c("p_size") % 4 == 2, F.concat(F.lit("Figure "), "p_size", F.lit("b : "), "p_name")).otherwise(F.lit(" \n"))
    return part.select("p_partkey", text.plain_paragraph(shown).alias("plain"))


@query("SELECT page_id, len(regexp_extract_all(html, '<p[ >]'))::BIGINT AS n_paragraphs, len(regexp_extract_all(html, '<li[ >]'))::BIGINT AS n_items FROM pages")
def marker_counts(pages):
    return pages.select("page_id", F.regexp_count("html", F.lit("<p[ >]")).cast("long").alias("n_paragraphs"), F.regexp_count("html", F.lit("<li[ >]")).cast("long").alias("n_items"))


@query("SELECT p_partkey, 'Figure ' || p_partkey || ': ' || p_name AS caption FROM part")
def caption_extract(part):
    after = F.concat(F.lit(" Figure "), _c("p_partkey"), F.lit(": "), _c("p_name"), F.lit("\n\nbody <img 2>"))
    return part.select("p_partkey", text.caption(after).alias("caption"))


@query("SELECT p_partkey, p_name || chr(10) || chr(10) || '<img ' || p_partkey || '>' || chr(10) || chr(10) || p_brand AS protected FROM part")
def protect_markers(part):
    return part.select("p_partkey", text.protect_markers(F.concat("p_name", F.lit(" \n<img "), "p_partkey", F.lit("> "), "p_brand")).alias("protected"))


@query("WITH t AS (SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[ \\t]+', ' ', 'g'))), chr(10)) AS t FROM documents) SELECT doc_id, md5(CASE WHEN trim(t, chr(10)) = '' THEN chr(10) ELSE trim(regexp_replace(t, '\\n{3,}', chr(10) || chr(10), 'g'), chr(10)) END) AS block_md5 FROM t")
def block_text(documents):
    """A document as a block of lines, a span for each word and the spaces after it."""
    lines = F.transform(F.split("text", "\n", -1), lambda x: F.split(x, "(?<= )", -1))
    blocks = documents.select(_c("doc_id").alias("page_index"), F.lit(0).alias("block_no"), lines.alias("lines"))
    return digest.page_text(blocks).select(_c("page_index").alias("doc_id"), F.md5(_c("text").cast("binary")).alias("block_md5"))


@query("SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY round_even(embedding[2]::DOUBLE, 1), round_even(embedding[1]::DOUBLE, 1), vec_id) AS place FROM embeddings")
def block_order(embeddings):
    order = [F.bround(F.get("embedding", F.lit(k)).cast("double"), 1) for k in (1, 0)]
    rows = embeddings.select("vec_id", "label", order[0].alias("y"), order[1].alias("x"))
    placed = retrieval.places(rows, ["label"], [_c("y"), _c("x"), _c("vec_id")], "at", "n")
    return placed.select("vec_id", "label", (_c("at") + 1).alias("place"))


@query("SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY pos)) AS passage_md5, count(*) AS n_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents) x GROUP BY doc_id")
def passage_assembly(documents):
    blocks = documents.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return blocks.groupBy("doc_id").agg(F.md5(digest.ordered_join([_c("pos")], _c("line"), "\n").cast("binary")).alias("passage_md5"), F.count("*").alias("n_lines"))


@query("""
WITH l AS (SELECT doc_id, trim(x) AS line, pos FROM (SELECT doc_id, unnest(string_split(replace(text, '. ', '.' || chr(10) || '• '), chr(10))) AS x, unnest(range(0, len(string_split(replace(text, '. ', '.' || chr(10) || '• '), chr(10))))) AS pos FROM documents) y WHERE trim(x) <> ''),
h AS (SELECT *, starts_with(line, '• ') OR coalesce(starts_with(lead(line) OVER w, '• '), false) AS hard FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
g AS (SELECT *, sum(CASE WHEN hard OR coalesce(before, true) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS grp FROM (SELECT *, lag(hard) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM h) z),
j AS (SELECT doc_id, grp, string_agg(line, ' ' ORDER BY pos) AS t FROM g GROUP BY 1, 2)
SELECT d.doc_id, md5(coalesce(string_agg(t, chr(10) ORDER BY grp), '')) AS merged_md5 FROM documents d LEFT JOIN j ON j.doc_id = d.doc_id GROUP BY d.doc_id
""")
def paragraph_merge(documents):
    listed = F.replace("text", F.lit(". "), F.lit(".\n• "))
    return documents.select("doc_id", F.md5(text.merge_paragraph(listed).cast("binary")).alias("merged_md5"))


@query("SELECT doc_id, md5(replace(array_to_string(list_transform(string_split(text, chr(10)), lambda x: trim(x)), chr(10)), chr(10), chr(10) || '● ')) AS repaired_md5 FROM documents")
def bullet_repair(documents):
    return documents.select("doc_id", F.md5(text.repair_bullets(F.replace("text", F.lit("\n"), F.lit("\n●\n"))).cast("binary")).alias("repaired_md5"))


@query("SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1 AS emit FROM events")
def emit_once(events):
    return digest.emit_once(events.select("event_id", "user_id", "event_type", "ts"), ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("SELECT e.event_id, h.header_id FROM (SELECT * FROM events WHERE event_type <> 'signup') e ASOF LEFT JOIN (SELECT ts, user_id, event_id AS header_id FROM events WHERE event_type = 'signup') h ON e.user_id = h.user_id AND e.ts >= h.ts")
def page_asof_header(events):
    pages = events.where("event_type <> 'signup'").select("user_id", "ts", "event_id")
    headers = events.where("event_type = 'signup'").select("user_id", "ts", _c("event_id").alias("header_id"))
    return digest.as_of(pages, headers, ["user_id"], "ts", ["header_id"], ["header_id"]).select("event_id", "header_id")


@query("""
WITH b AS (SELECT label AS box_id, label % 3 AS g, avg(embedding[1]::DOUBLE) - 0.05 AS x0, avg(embedding[1]::DOUBLE) + 0.05 AS x1, avg(embedding[2]::DOUBLE) - 0.05 AS y0, avg(embedding[2]::DOUBLE) + 0.05 AS y1 FROM embeddings GROUP BY label)
SELECT v.vec_id AS point_id, min(b.box_id) AS box_id FROM embeddings v LEFT JOIN b ON b.g = v.label % 3 AND v.embedding[1] BETWEEN b.x0 - 0.02 AND b.x1 + 0.02 AND v.embedding[2] BETWEEN b.y0 - 0.02 AND b.y1 + 0.02 GROUP BY v.vec_id
""")
def bbox_first_match(embeddings):
    x, y = F.get("embedding", F.lit(0)).cast("double"), F.get("embedding", F.lit(1)).cast("double")
    boxes = embeddings.groupBy("label").agg((F.avg(x) - 0.05).alias("x0"), (F.avg(x) + 0.05).alias("x1"), (F.avg(y) - 0.05).alias("y0"), (F.avg(y) + 0.05).alias("y1"))
    boxes = boxes.select(_c("label").alias("box_id"), (_c("label") % 3).alias("g"), "x0", "x1", "y0", "y1")
    points = embeddings.select(_c("vec_id").alias("point_id"), (_c("label") % 3).alias("g"), "embedding")
    return digest.first_containing(points, boxes, "g", x, y, 0.02).select("point_id", "box_id")


@query("SELECT conv_id, turn, coalesce(last_value(CASE WHEN role = 'user' THEN md5(text) END IGNORE NULLS) OVER w, first_value(md5(text)) OVER w) AS section FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)")
def section_ffill(conversations):
    return digest.fill_section(conversations, ["conv_id"], ["turn"], _c("role") == "user", F.md5(_c("text").cast("binary")), "section").select("conv_id", "turn", "section")


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS antecedent, first_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS subsequent FROM conversations")
def neighbor_passages(conversations):
    return digest.neighbours(conversations, ["conv_id"], ["turn"], _c("role") == "user", _c("turn")).select("conv_id", "turn", "antecedent", "subsequent")


@query("SELECT doc_id, pos, row_number() OVER (ORDER BY doc_id, pos) - 1 AS vector_index, row_number() OVER (ORDER BY doc_id, pos) AS chunk_id FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10)))))::INT AS pos FROM documents) x WHERE trim(line) <> ''")
def chunk_sequence(documents):
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).where(text.strip(_c("line")) != "").select("doc_id", "pos")
    return retrieval.number(lines, ["doc_id", "pos"], "vector_index").withColumn("chunk_id", _c("vector_index") + 1)


_AUDIT = "SELECT doc_id, (len(regexp_extract_all(text, '[a-zA-Z0-9_]+|[^a-zA-Z0-9_ \\n]')) + 2)::BIGINT AS token_count, length(text)::BIGINT AS char_count FROM documents"


def _audit(documents):
    return digest.chunk_audit(documents.select("doc_id", "lang", _c("text").alias("chunk_passage")))


@query(f"SELECT *, 512 AS max_seq_length, token_count > 512 AS exceeds_encoder_limit FROM ({_AUDIT}) a")
def chunk_audit(documents):
    return _audit(documents).select("doc_id", _c("token_count").cast("long").alias("token_count"), _c("char_count").cast("long").alias("char_count"), "max_seq_length", "exceeds_encoder_limit")


@query(f"SELECT count(*) AS n, count(*) FILTER (token_count > 512) AS n_over, round(coalesce(100.0 * count(*) FILTER (token_count > 512) / nullif(count(*), 0), 0), 4)::DOUBLE AS percent_over FROM ({_AUDIT}) a")
def truncation_summary(documents):
    return digest.truncation(_audit(documents))


@query("SELECT o.lang, o.place, c.n FROM (VALUES ('en', 0), ('de', 1), ('fr', 2), ('es', 3), ('xx', 4)) o(lang, place) LEFT JOIN (SELECT lang, count(*) AS n FROM documents GROUP BY lang) c ON c.lang = o.lang")
def class_counts(documents):
    from quern.operators.reporting import class_counts as counts

    return counts(documents, "lang", ["en", "de", "fr", "es", "xx"])


@query("SELECT doc_id, CASE WHEN doc_id < 1000 THEN lpad(doc_id::VARCHAR, 3, '0') ELSE doc_id::VARCHAR END || '::' || source AS subsection_key FROM documents")
def subsection_key(documents):
    return documents.select("doc_id", text.subsection_key(_c("doc_id"), _c("source")).alias("subsection_key"))


@query("SELECT source AS section_title, min(doc_id) + 1 AS subsection_id, md5(array_to_string(list_sort(list(doc_id)), ',')) AS chunk_ids_md5, count(*) AS n_chunks FROM documents GROUP BY source")
def subsection_metadata(documents):
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",")
    return documents.groupBy(_c("source").alias("section_title")).agg((F.min("doc_id") + 1).alias("subsection_id"), F.md5(ids.cast("binary")).alias("chunk_ids_md5"), F.count("*").alias("n_chunks"))


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS seq, 'Hierarchy ' || quality AS hierarchy FROM labels WHERE quality IS NOT NULL")
def density_seq(labels):
    kept = labels.na.drop(subset=["quality"]).select("doc_id", F.concat(F.lit("Hierarchy "), "quality").alias("hierarchy"))
    return retrieval.number(kept, ["doc_id"], "seq", start=1)


@query("SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10))) AS clean_md5 FROM documents")
def normalize_space(documents):
    return documents.select("doc_id", F.md5(text.normalize_space(_c("text")).cast("binary")).alias("clean_md5"))


@query("SELECT p_partkey, trim(p_name || ' ' || chr(10) || p_brand) AS clean FROM part")
def strip_markers(part):
    return part.select("p_partkey", text.strip_markers(F.concat("p_name", F.lit(" <img 3>\n<t 1>\n"), "p_brand", F.lit("\n</t>"))).alias("clean"))


@query("SELECT p_partkey, p_size % 2 = 0 AS is_item, p_size % 5 = 0 AND p_size % 2 = 1 AS is_line FROM part")
def bullet_flags(part):
    line = F.when(_c("p_size") % 2 == 0, F.concat(F.lit(" • "), _c("p_name"))).when(_c("p_size") % 5 == 0, F.lit("• ")).otherwise(_c("p_name"))
    return part.select("p_partkey", text.is_bullet_item(line).alias("is_item"), text.is_bullet_line(line).alias("is_line"))


@query("SELECT doc_id, len(list_filter(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)), lambda x: trim(x) <> ''))::BIGINT AS n_passages FROM documents")
def split_passages(documents):
    return documents.select("doc_id", F.size(text.passages(F.replace("text", F.lit("\n"), F.lit("\n\n")))).cast("long").alias("n_passages"))


@query("SELECT d.doc_id, l.quality IS NULL AS is_missing, CASE WHEN l.quality = 0 THEN NULL WHEN l.quality IS NOT NULL THEN '1' END AS normalized FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def missing_text(documents, labels):
    rows = documents.select("doc_id").join(labels, "doc_id", "left")
    shown = F.when(_c("quality") == 0, F.lit("  \n")).otherwise(_c("quality").cast("string"))
    return rows.select("doc_id", text.is_missing(_c("quality").cast("string")).alias("is_missing"), text.blank_to_null(shown).alias("normalized"))


@query("SELECT p_partkey, p_name || ' | ' || p_brand || chr(10) || '|' || chr(10) || p_type || ' |' AS flat FROM part")
def table_flatten(part):
    cells = F.array(F.array("p_name", "p_brand"), F.array(F.lit(""), F.lit(" ")), F.array(F.lit(None).cast("string")), F.array(_c("p_type"), F.lit(None).cast("string")))
    return part.select("p_partkey", text.flatten_cells(cells).alias("flat"))


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS figure_id FROM part")
def figure_counter(part):
    return retrieval.number(part.select("p_partkey"), ["p_partkey"], "figure_id", start=1)


@query("SELECT p_partkey, 'doc_p' || lpad(p_size::VARCHAR, 3, '0') || '_img' || CASE WHEN p_partkey < 10000 THEN lpad(p_partkey::VARCHAR, 4, '0') ELSE p_partkey::VARCHAR END || '.png' AS image_name FROM part")
def image_name_format(part):
    from quern.sources.sinks import image_name

    return part.select("p_partkey", image_name(F.lit("doc"), _c("p_size"), _c("p_partkey"), F.lit(".PNG")).alias("image_name"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%d %B %Y') AS shown FROM orders")
def date_format(orders):
    return orders.select("o_orderkey", F.date_format("o_orderdate", "dd MMMM yyyy").alias("shown"))


@query("SELECT (SELECT count(*) FROM documents) AS chunk_count, (SELECT count(DISTINCT source) FROM documents) AS subsection_count, (SELECT count(*) FROM pages) AS image_record_count, (SELECT count(*) FROM embeddings) AS embedding_rows, (SELECT max(len(embedding)) FROM embeddings)::BIGINT AS embedding_dim")
def build_manifest(documents, pages, embeddings):
    d = documents.agg(F.count("*").alias("chunk_count"), F.count_distinct("source").alias("subsection_count"))
    e = embeddings.agg(F.count("*").alias("embedding_rows"), F.max(F.size("embedding")).cast("long").alias("embedding_dim"))
    one = lambda df: df.withColumn("_one", F.lit(1))  # noqa: E731  single rows
    return one(d).join(one(pages.agg(F.count("*").alias("image_record_count"))), "_one").join(one(e), "_one").drop("_one")


@query(None)
def semantic_split(documents):
    from quern.functions.vectors import encoder

    return digest.split_batches(documents.select(_c("doc_id").alias("key"), _c("text").alias("passage")), encoder(16))


@query("SELECT event_id, (props->>'k')::INT AS k, coalesce((props->>'absent')::INT, -1) AS absent FROM events")
def json_first(events):
    m = F.from_json("props", "map<string,int>")
    return events.select("event_id", F.try_element_at(m, F.lit("k")).alias("k"), F.coalesce(F.try_element_at(m, F.lit("absent")), F.lit(-1)).alias("absent"))


@query("""SELECT event_id, '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS packed FROM events""")
def json_pack(events):
    return events.select("event_id", F.to_json(F.struct("event_id", "event_type")).alias("packed"))
