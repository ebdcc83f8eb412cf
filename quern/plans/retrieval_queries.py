"""Retrieval and prompt queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text, vectors
from quern.operators import prompts, retrieval
from quern.plans.registry import registrar

QUERIES: dict = {}
query = registrar(QUERIES)
_c = F.col

_TOP = """WITH s AS (SELECT q.vec_id AS qid, c.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 12) AS score FROM embeddings q JOIN embeddings c ON q.vec_id % 20 = 0),
t AS (SELECT qid, vec_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM s)"""


def _hits(embeddings, k=3):
    corpus = embeddings.select("vec_id", _c("embedding").alias("v"))
    return retrieval.top_k(corpus.where("vec_id % 20 = 0").select(_c("vec_id").alias("qid"), "v"), corpus, k)


@query(f"{_TOP} SELECT qid, vec_id, rank, round(score, 6) AS score FROM t WHERE rank <= 3")
def topk_cosine(embeddings):
    return _hits(embeddings).select("qid", "vec_id", _c("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(f"{_TOP}, d AS (SELECT doc_id AS vec_id, text FROM documents) SELECT q.vec_id AS qid, md5(coalesce(string_agg(trim(d.text, ' ' || chr(10)), chr(10) || chr(10) ORDER BY t.rank), 'Insufficient context!')) AS context_md5, count(d.text) AS n_passages FROM (SELECT vec_id FROM embeddings WHERE vec_id % 20 = 0) q LEFT JOIN (SELECT * FROM t WHERE rank <= 3) t ON t.qid = q.vec_id LEFT JOIN d ON d.vec_id = t.vec_id GROUP BY q.vec_id")
def rag_context(embeddings, documents):
    lookup = documents.select(_c("doc_id").alias("vec_id"), text.strip(_c("text")).alias("passage"))
    questions = embeddings.where("vec_id % 20 = 0").select(_c("vec_id").alias("qid"))
    out = retrieval.contexts(questions, _hits(embeddings), lookup)
    return out.select("qid", F.md5(_c("rag_context").cast("binary")).alias("context_md5"), _c("n_passages").cast("long").alias("n_passages"))


@query(f"{_TOP} SELECT qid, string_agg(p_brand || ' ' || p_type, chr(10) || chr(10) ORDER BY rank) AS rag_context FROM t JOIN part ON p_partkey = vec_id WHERE rank <= 3 GROUP BY qid")
def rag_context_image(embeddings, part):
    both = F.array_join(F.filter(F.array("p_brand", "p_type"), lambda x: text.strip(x) != ""), " ")
    lookup = part.select(_c("p_partkey").alias("vec_id"), both.alias("passage"))
    questions = embeddings.where("vec_id % 20 = 0").select(_c("vec_id").alias("qid"))
    return retrieval.contexts(questions, _hits(embeddings), lookup).where("n_passages > 0").select("qid", "rag_context")


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS vector_index FROM part WHERE p_size % 3 <> 0")
def image_rekey(part):
    images = part.select("p_partkey", F.when(_c("p_size") % 3 != 0, _c("p_size")).alias("v"))
    return retrieval.rekey(images, "p_partkey", "v").select("p_partkey", "vector_index")


@query("SELECT vec_id, p_name AS image_path FROM embeddings LEFT JOIN part ON p_partkey = vec_id * 7")
def marker_lookup(embeddings, part):
    return embeddings.select("vec_id").join(part.select((_c("p_partkey")).alias("k"), _c("p_name").alias("image_path")), _c("k") == _c("vec_id") * 7, "left").drop("k")


@query("SELECT l_orderkey, l_linenumber, p_name AS image_path FROM lineitem JOIN part ON p_partkey = l_partkey")
def figure_lookup(lineitem, part):
    """A part that is missing would be an error."""
    rows = lineitem.select("l_orderkey", "l_linenumber", _c("l_partkey").alias("p_partkey"))
    return retrieval.strict_lookup(rows, part.select("p_partkey", _c("p_name").alias("image_path")), "p_partkey", "image_path").drop("p_partkey")


@query("SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 4) AS length_before, 1.0::DOUBLE AS length_after, round(embedding[1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS first FROM embeddings")
def l2_normalize(embeddings):
    unit = embeddings.withColumn("u", vectors.normalize(_c("embedding")))
    return unit.select("vec_id", F.round(vectors.norm(_c("embedding")), 4).alias("length_before"), F.round(vectors.norm(_c("u")), 4).alias("length_after"), F.round(F.get("u", F.lit(0)), 5).alias("first"))


@query("SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def pair_cosine(embeddings):
    other = embeddings.select((_c("vec_id") - 1).alias("vec_id"), _c("embedding").alias("other"))
    return embeddings.join(other, "vec_id").select("vec_id", F.round(vectors.cosine(_c("embedding"), _c("other")), 5).alias("cosine"))


@query("SELECT count(*) AS n, count(DISTINCT vec_id) AS n_ids, min(vec_id) AS first, max(vec_id) AS last, count(*) = count(DISTINCT vec_id) AND min(vec_id) = 0 AND max(vec_id) = count(*) - 1 AS aligned FROM embeddings")
def index_alignment(embeddings):
    return retrieval.alignment(embeddings)


@query("SELECT conv_id, turn, count(*) OVER w AS n_before, md5(coalesce(string_agg(role || ':' || text, chr(10)) OVER w, '')) AS history_md5 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def chat_history(conversations):
    h = prompts.history(conversations)
    shown = F.array_join(F.transform("history", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n")
    return h.select("conv_id", "turn", F.size("history").cast("long").alias("n_before"), F.md5(shown.cast("binary")).alias("history_md5"))


_quoted = lambda x: "'" + x.replace("'", "''") + "'"


@query(f"WITH c AS (SELECT *, CASE item_id % 3 WHEN 0 THEN 'Passage ' || item_id WHEN 1 THEN ' ' || chr(10) ELSE ' Insufficient context! ' END AS context, CASE item_id % 3 WHEN 0 THEN 'REFERENCE_SUPPORTED' ELSE 'GENERAL_ENT' END AS mode FROM benchmark) SELECT item_id, mode, md5(replace(replace(replace(replace({_quoted(prompts.TEMPLATE)}, '{{response_mode}}', mode), '{{safety_disclaimer}}', CASE WHEN item_id % 3 = 0 THEN {_quoted(prompts.DISCLAIMERS[prompts.GROUNDED])} ELSE {_quoted(prompts.DISCLAIMERS[prompts.GENERAL])} END), '{{retrieved_passage}}', context), '{{user_question}}', text)) AS prompt_md5 FROM c")
def prompt_assembly(benchmark):
    context = F.when(_c("item_id") % 3 == 0, F.concat(F.lit("Passage "), "item_id")).when(_c("item_id") % 3 == 1, F.lit(" \n")).otherwise(F.lit(f" {text.NO_CONTEXT} "))
    p = prompts.prompt(_c("text"), context)
    return benchmark.select("item_id", prompts.response_mode(context).alias("mode"), F.md5(p.cast("binary")).alias("prompt_md5"))


@query("WITH h AS (SELECT conv_id, turn, role, text, string_agg(role || ':' || text, chr(10)) OVER w AS before, count(*) OVER w AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT conv_id, turn, n + 2 AS n_messages, md5('system:be brief' || chr(10) || coalesce(before || chr(10), '') || 'user:' || text) AS messages_md5 FROM h WHERE role = 'user'")
def message_assembly(conversations):
    """System turn, earlier turns, the user's own."""
    h = prompts.history(conversations).where("role = 'user'").withColumn("m", prompts.messages(F.lit("be brief"), _c("history"), _c("text")))
    shown = F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "\n")
    return h.select("conv_id", "turn", F.size("m").cast("long").alias("n_messages"), F.md5(shown.cast("binary")).alias("messages_md5"))


@query("SELECT doc_id, CASE WHEN source IN ('src0', 'src1') THEN source ELSE 'src0' END AS card FROM documents")
def model_default(documents):
    return documents.select("doc_id", F.when(_c("source").isin("src0", "src1"), _c("source")).otherwise(F.lit("src0")).alias("card"))


@query(None)
def embed_hash(documents):
    return documents.select("doc_id", vectors.hashed(_c("text")).alias("embedding"))


@query(None)
def embed_distinct(conversations):
    """Each distinct text is encoded once and joined back."""
    stripped = conversations.select("conv_id", "turn", text.strip(_c("text")).alias("t"))
    encoded = stripped.select("t").distinct().withColumn("embedding", vectors.hashed(_c("t")))
    return stripped.join(encoded, "t").select("conv_id", "turn", "embedding")


@query(None)
def best_passage(conversations):
    """Every conversation's first turn against all its turns as passages."""
    first = conversations.groupBy(_c("conv_id").alias("qid")).agg(F.min_by("text", "turn").alias("t"), F.collect_list("text").alias("passages"))
    return retrieval.best_passage(first.select("qid", vectors.hashed(_c("t")).alias("v")), first, vectors.hashed)


@query(None)
def embed_remembered(spark, conversations):
    """All turns by a store of vectors; the second pass over it encodes nothing."""
    from quern.sources import shared

    path, rows = shared.folder(spark, "vectors"), conversations.select("conv_id", "turn", "text")
    retrieval.remembered(rows, "text", path, vectors.hashed)
    return retrieval.remembered(rows, "text", path, vectors.hashed).drop("text")


@query(f"{_TOP} SELECT qid, round(max(score), 5) AS best FROM t WHERE rank <= 4 AND vec_id <> qid GROUP BY qid")
def max_passage_sim(embeddings):
    """The largest similarity of each question to its passages, which are its hits but for itself."""
    hits = _hits(embeddings, 4).where("vec_id <> qid").select("qid", "vec_id")
    both = hits.join(embeddings.select("vec_id", _c("embedding").alias("p")), "vec_id").join(embeddings.select(_c("vec_id").alias("qid"), _c("embedding").alias("q")), "qid")
    return both.groupBy("qid").agg(F.round(F.max(vectors.cosine(_c("q"), _c("p"))), 5).alias("best"))


@query("SELECT p_partkey, p_size % 3 <> 0 AS encoded FROM part WHERE p_size % 3 <> 0")
def image_encode(part):
    """Images without content are skipped."""
    v = vectors.hashed_bytes(F.when(_c("p_size") % 3 != 0, _c("p_name").cast("binary")))
    return part.select("p_partkey", v.alias("v")).where("v is not null").select("p_partkey", (F.abs(vectors.norm(_c("v")) - 1) < 1e-9).alias("encoded"))
