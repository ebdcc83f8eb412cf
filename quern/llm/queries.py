"""The registered queries of this package, and their SQL where DuckDB can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.warc import roundtrip

    return roundtrip(_table(spark, sf_dir, "pages")).drop("url")


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.simple8b import roundtrip

    return roundtrip(_table(spark, sf_dir, "documents"), _vocabulary())


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.tokencount import count

    return count(_table(spark, sf_dir, "documents"), _vocabulary())


def op5_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.linetemplates import report

    return report(_table(spark, sf_dir, "documents"), min_tokens=1)


def op6_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.pcatiles import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.mixing import plan

    return plan(_table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op7_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.sharding import place

    return place(_table(spark, sf_dir, "documents").select("doc_id"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.decontam import report

    return report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.jaccard import similar_groups

    return similar_groups(_table(spark, sf_dir, "documents"), words=3, threshold="0.9")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.langid import predictions

    return predictions(_table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.merkle import manifest

    return manifest(_table(spark, sf_dir, "documents"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.piecewise import fingerprints

    return fingerprints(_table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.whitening import whiten

    return whiten(_table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc, op3_token_ids, op4_token_counts, op5_line_templates, op6_near_vectors, op2_mix, op7_shard, op8_decontaminate, op9_jaccard_join, op10_language, op11_merkle_manifest, op12_fingerprints, op13_whitening, pipeline)}


ORACLES: dict[str, str] = {
    "op6_near_vectors": """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
), l AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9
), r(x, y) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x
), c AS (
  SELECT x AS vec_id, min(y) AS component_id FROM r GROUP BY x
), n AS (
  SELECT x AS vec_id, count(*) AS n_links FROM l GROUP BY x
)
SELECT c.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, c.component_id, c.vec_id = c.component_id AS kept
FROM c LEFT JOIN n ON c.vec_id = n.vec_id
""",
    "op9_jaccard_join": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS g
  FROM d, unnest(range(1, greatest(len(w) - 1, 2))) AS u(i) WHERE len(w) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 90 * (a.n + b.n - k)
), r(x, y) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) c ON c.x = d.doc_id
""",
    "op1_warc": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), g AS (
  SELECT html, max(page_id) AS first, count(*) AS n FROM p GROUP BY html
), h AS (
  SELECT p.page_id, octet_length(encode(p.html))::BIGINT AS payload_bytes, sha1(p.html) AS hex,
         CASE WHEN g.n > 1 AND (p.page_id IS NULL OR p.page_id <> g.first) THEN g.first END AS refers_to
  FROM p JOIN g ON p.html = g.html
), d AS (
  SELECT *, list_transform(range(0, 8), lambda k: ('0x' || hex[k * 5 + 1 : k * 5 + 5])::BIGINT) AS five FROM h
)
SELECT page_id, payload_bytes, refers_to,
       CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       list_aggregate(list_transform(five, lambda v: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(v >> 15)::INT + 1] || 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((v >> 10) & 31)::INT + 1] || 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((v >> 5) & 31)::INT + 1] || 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(v & 31)::INT + 1]), 'string_agg', '') AS payload_digest
FROM d
""",
    "op11_merkle_manifest": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source,
         coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') AS head, text,
         CASE WHEN list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(1, 9)), lambda x, i: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END))) % 2 = 1 THEN replace(text, chr(10), '') ELSE text END AS changed
  FROM documents
), e AS (
  SELECT doc_id, source, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf, sha256(head || coalesce(octet_length(encode(changed)) || ':' || changed, '-')) AS changed FROM d
), f AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER () AS r FROM e
), t(tree, level, k, h, n) AS (
  SELECT tree, 0, k, leaf, count(*) OVER (PARTITION BY tree) FROM f
  UNION ALL
  SELECT tree, level + 1, k // 3, sha256(string_agg(h, '' ORDER BY k)), (n + 2) // 3 FROM t WHERE n > 1 GROUP BY tree, level, k // 3, n
), s AS (
  SELECT tree, h, level AS levels FROM t WHERE n = 1
), u(level, k, h, n) AS (
  SELECT 0, tree, h, count(*) OVER () FROM s
  UNION ALL
  SELECT level + 1, k // 3, sha256(string_agg(h, '' ORDER BY k)), (n + 2) // 3 FROM u WHERE n > 1 GROUP BY level, k // 3, n
), nodes AS (
  SELECT tree, level, k, h, n FROM t UNION ALL SELECT -1, level, k, h, n FROM u
), runs AS (
  SELECT tree, level, k // 3 AS run, list(h ORDER BY k) AS hs FROM nodes WHERE n > 1 GROUP BY 1, 2, 3
), p(r, tree, level, k, node, proof) AS (
  SELECT r, tree, 0, k, changed, '' FROM f
  UNION ALL
  SELECT p.r, CASE WHEN g.hs IS NULL THEN -1 ELSE p.tree END, CASE WHEN g.hs IS NULL THEN 0 ELSE p.level + 1 END, CASE WHEN g.hs IS NULL THEN p.tree ELSE p.k // 3 END,
         CASE WHEN g.hs IS NULL THEN p.node ELSE sha256(array_to_string(hs[1 : p.k % 3], '') || p.node || array_to_string(hs[p.k % 3 + 2 :], '')) END,
         CASE WHEN g.hs IS NULL THEN p.proof ELSE p.proof || array_to_string(hs[1 : p.k % 3], '') || array_to_string(hs[p.k % 3 + 2 :], '') END
  FROM p LEFT JOIN runs g ON g.tree = p.tree AND g.level = p.level AND g.run = p.k // 3 WHERE NOT (p.tree = -1 AND g.hs IS NULL)
), z AS (
  SELECT r, arg_max(node, level) AS node, arg_max(proof, level) AS proof FROM p WHERE tree = -1 GROUP BY r
), w AS (
  SELECT h AS root FROM u WHERE n = 1
)
SELECT f.doc_id, f.leaf, s.h AS subroot, w.root, sha256(z.proof) AS proof_sha256, z.node AS folded_root, z.node = w.root AS verified
FROM f JOIN s ON s.tree = f.tree JOIN z ON z.r = f.r CROSS JOIN w
""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
