"""Evaluation and reporting queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import text, vectors
from quern.operators import evaluation, reporting
from quern.plans.registry import registrar

QUERIES: dict = {}
query = registrar(QUERIES)
_c = F.col
_TYPES = ["view", "signup", "error", "click", "purchase"]
_MATRIX = "SELECT 'q_' || lpad((item_id + 1)::VARCHAR, 3, '0') AS id, m AS model_name, a AS architecture_config FROM benchmark CROSS JOIN (VALUES ('1B'), ('3B')) x(m) CROSS JOIN (VALUES ('SLM'), ('Text-RAG'), ('Image-Text-RAG'), ('Image-RAG')) y(a)"


def _matrix(benchmark):
    return evaluation.matrix(benchmark.select(evaluation.question_id(_c("item_id")).alias("id")), ["1B", "3B"])


@query(_MATRIX)
def eval_matrix(benchmark):
    return _matrix(benchmark)


@query("SELECT item_id FROM benchmark ORDER BY item_id LIMIT 10")
def eval_limit(benchmark):
    return benchmark.select("item_id").orderBy("item_id").limit(10)


@query("SELECT item_id, 'q_' || lpad((item_id + 1)::VARCHAR, 3, '0') AS id, item_id + 1 AS number FROM benchmark")
def question_id(benchmark):
    q = evaluation.question_id(_c("item_id"))
    return benchmark.select("item_id", q.alias("id"), evaluation.question_number(q).cast("long").alias("number"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'SLM' WHEN doc_id % 5 = 1 THEN 'Image-Text-RAG' WHEN doc_id % 5 = 2 THEN 'Text-RAG' WHEN doc_id % 5 = 3 THEN 'Image-RAG' ELSE 'RAG enabled, no retrieval input' END AS architecture FROM documents")
def architecture_label(documents):
    k = _c("doc_id") % 5
    return documents.select("doc_id", text.architecture(k != 0, k.isin(1, 2), k.isin(1, 3)).alias("architecture"))


@query("SELECT d.doc_id, l.quality IS NOT NULL AS has_context, CASE WHEN l.quality IS NULL THEN 2 ELSE 5 END AS n_metrics FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def metric_routing(documents, labels):
    rows = documents.select("doc_id", "text").join(labels, "doc_id", "left")
    context = F.when(_c("quality").isNotNull(), _c("text")).otherwise(F.lit(text.NO_CONTEXT))
    has = F.size(text.context_list(context)) > 0
    return rows.select("doc_id", has.alias("has_context"), F.when(has, 5).otherwise(2).alias("n_metrics"))


@query("SELECT d.doc_id, l.quality FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality IS NOT NULL AND l.toxic IS NOT NULL")
def dropna_rows(documents, labels):
    return documents.select("doc_id").join(labels, "doc_id", "left").na.drop("any").drop("toxic")


@query("SELECT count(*) AS n, sum(doc_id)::BIGINT AS total FROM documents")
def dropna_cols(documents, labels):
    """Columns with any null go: one aggregate decides, then the survivors are selected."""
    rows = documents.select("doc_id").join(labels, "doc_id", "left")
    holes = rows.agg(*[F.count_if(_c(c).isNull()).alias(c) for c in rows.columns]).first()
    kept = rows.select(*[c for c in rows.columns if not holes[c]])
    return kept.agg(F.count("*").alias("n"), F.sum(kept.columns[0]).alias("total"))


@query("SELECT doc_id, lang, NULL::INT AS quality FROM documents UNION ALL SELECT doc_id, NULL, quality FROM labels")
def align_schema(documents, labels):
    return documents.select("doc_id", "lang").unionByName(labels.select("doc_id", "quality"), allowMissingColumns=True)


@query("SELECT count(*) FILTER (text IS NULL OR trim(text) = '') AS blank_text, count(*) FILTER (lang IS NULL) AS null_lang, greatest(count(*), 10) AS longest FROM documents")
def validation_counts(documents):
    return documents.agg(F.count_if(text.is_missing(_c("text"))).alias("blank_text"), F.count_if(_c("lang").isNull()).alias("null_lang"), F.greatest(F.count("*"), F.lit(10)).alias("longest"))


@query("SELECT doc_id, try_cast(CASE WHEN doc_id % 2 = 0 THEN doc_id::VARCHAR ELSE lang END AS DOUBLE) AS number FROM documents")
def coerce_numeric(documents):
    return documents.select("doc_id", F.when(_c("doc_id") % 2 == 0, _c("doc_id").cast("string")).otherwise(_c("lang")).try_cast("double").alias("number"))


@query(f"SELECT * FROM ({_MATRIX}) m WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT 'q_' || lpad((user_id % 40 + 1)::VARCHAR, 3, '0') AS id FROM events WHERE event_type = 'purchase' AND user_id % 3 = 0) d WHERE d.id = m.id AND m.model_name = '1B' AND m.architecture_config = 'SLM')")
def resume_anti(benchmark, events):
    done = events.where("event_type = 'purchase' and user_id % 3 = 0").select(evaluation.question_id(_c("user_id") % 40).alias("id"), F.lit("1B").alias("model_name"), F.lit("SLM").alias("architecture_config"))
    return evaluation.pending(_matrix(benchmark), done)


@query("SELECT user_id, event_type, event_id, round(value, 4) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) x WHERE r = 1")
def dedup_keep_last(events):
    return evaluation.keep_last(events.select("user_id", "event_type", "event_id", "ts", "value"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", F.round("value", 4).alias("value"))


_SPLIT = "SELECT event_id, event_type, (floor((row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1) / ceil(count(*) OVER (PARTITION BY event_type) / 4.0)) + 1)::INT AS worker_id FROM events"


def _split(events):
    return evaluation.split_work(events.select("event_id", "event_type", "ts"), ["event_type"], [_c("ts"), _c("event_id")], 4).drop("ts")


@query(_SPLIT)
def worker_split(events):
    return _split(events)


@query(f"SELECT worker_id, count(*) AS n_rows, count(*) FILTER (event_type = 'view') AS slm_rows, 2 * count(*) FILTER (event_type = 'view') + 5 * count(*) FILTER (event_type <> 'view') AS estimated_calls, count(*) = count(DISTINCT event_id) AS exact_cover FROM ({_SPLIT}) s GROUP BY worker_id")
def worker_validate(events):
    slm = F.count_if(_c("event_type") == "view")
    return _split(events).groupBy("worker_id").agg(F.count("*").alias("n_rows"), slm.alias("slm_rows"), (2 * slm + 5 * F.count_if(_c("event_type") != "view")).alias("estimated_calls"), (F.count("*") == F.count_distinct("event_id")).alias("exact_cover"))


@query("SELECT event_id, row_number() OVER (ORDER BY CASE event_type WHEN 'purchase' THEN 1 WHEN 'view' THEN 2 END NULLS LAST, user_id, event_id) AS place FROM events")
def custom_order(events):
    """Listed types first, the rest last; numbered without a one-task window."""
    from quern.operators.retrieval import number

    keyed = events.select("event_id", "user_id", F.coalesce(evaluation.enum_order(_c("event_type"), ["purchase", "view"]), F.lit(99)).alias("k"))
    return number(keyed, ["k", "user_id", "event_id"], "place", start=1).select("event_id", "place")


@query("SELECT event_id, 'value is negative or an error' AS error FROM events WHERE event_type = 'error' OR value < 0")
def failure_split(events):
    bad = (_c("event_type") == "error") | (_c("value") < 0)
    return evaluation.outcomes(events.select("event_id", "event_type", "value"), F.when(~bad, _c("value")), F.when(bad, F.lit("value is negative or an error")))[1].select("event_id", "error")


@query("SELECT o.o_orderkey, o.o_orderstatus, l.n_lines, round(l.revenue, 2) AS revenue, c.c_name, CASE o.o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 WHEN 'P' THEN 3 END::INT AS status_order FROM orders o LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines, sum(l_extendedprice) AS revenue FROM lineitem GROUP BY 1) l ON l.l_orderkey = o.o_orderkey LEFT JOIN customer c ON c.c_custkey = o.o_custkey")
def final_report(orders, lineitem, customer):
    lines = lineitem.groupBy(_c("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_lines"), F.round(F.sum("l_extendedprice"), 2).alias("revenue"))
    merged = reporting.merge_reports(orders.select("o_orderkey", "o_custkey", "o_orderstatus"), lines, keys=["o_orderkey"])
    merged = reporting.merge_reports(merged, customer.select(_c("c_custkey").alias("o_custkey"), "c_name"), keys=["o_custkey"])
    return merged.select("o_orderkey", "o_orderstatus", "n_lines", "revenue", "c_name", evaluation.enum_order(_c("o_orderstatus"), ["O", "F", "P"]).cast("int").alias("status_order"))


@query(f"SELECT role, pattern, count(*) AS n FROM (SELECT role, CASE WHEN regexp_matches(lower(text), '{text.MISSING_CONTEXT}') THEN 'Missing context statement' WHEN regexp_matches(lower(text), '{text.GROUNDING_EXPOSURE}') THEN 'Grounding/RAG exposure' WHEN regexp_matches(lower(text), '{text.REFUSAL.replace("'", "''")}') THEN 'Refusal' ELSE 'Faultless' END AS pattern FROM conversations) x GROUP BY role, pattern")
def response_pattern(conversations):
    return conversations.select("role", text.response_pattern(_c("text")).alias("pattern")).groupBy("role", "pattern").agg(F.count("*").alias("n"))


@query("SELECT d.item_id, CASE item_id % 4 WHEN 0 THEN 'Missing context statement' WHEN 1 THEN 'Grounding/RAG exposure' WHEN 2 THEN 'Refusal' ELSE 'Faultless' END AS pattern FROM benchmark d")
def pattern_rules(benchmark):
    """Answers of each kind, the earlier rule first where two match."""
    said = F.array(*map(F.lit, ["The Passage Is Missing, says the RAG.", "As the RAG system has it, I cannot answer.", "I can't answer that.", "A plain answer about drag and storage."]))
    return benchmark.select("item_id", text.response_pattern(F.get(said, (_c("item_id") % 4).cast("int"))).alias("pattern"))


@query("SELECT user_id % 10 AS bucket, " + ", ".join(f"count(*) FILTER (event_type = '{t}') AS {t}" for t in _TYPES) + " FROM events GROUP BY 1")
def pattern_pivot(events):
    return reporting.pivot_counts(events.select((_c("user_id") % 10).alias("bucket"), "event_type"), "bucket", "event_type", _TYPES)


@query(f"SELECT id, model_name, architecture_config, architecture_config <> 'SLM' AS rag_enabled, architecture_config IN ('Text-RAG', 'Image-Text-RAG') AS uses_query, architecture_config IN ('Image-RAG', 'Image-Text-RAG') AS uses_image FROM ({_MATRIX}) m")
def ui_routing(benchmark):
    rows = _matrix(benchmark).withColumn("image", F.when(_c("architecture_config").contains("Image"), _c("id")))
    return rows.select(*evaluation.KEYS, evaluation.route(_c("architecture_config"), _c("image")).alias("r")).select(*evaluation.KEYS, "r.*")


@query("SELECT item_id, unnest(range(0, len(string_split(text, ' '))))::INT AS piece_no, unnest(string_split(text, ' ')) AS piece FROM benchmark")
def generate_pieces(benchmark):
    """A stub that gives its answer word by word."""
    return evaluation.generate_pieces(benchmark.select("item_id", _c("text").alias("prompt")), lambda p: iter(p.split(" ")), "item_id")


@query("SELECT o.bucket, o.place, " + ", ".join(f"c.{t}" for t in _TYPES) + " FROM (SELECT unnest([12, 3, 1, 11]) AS bucket, unnest(range(0, 4))::INT AS place) o LEFT JOIN (SELECT user_id % 10 AS bucket, " + ", ".join(f"count(*) FILTER (event_type = '{t}') AS {t}" for t in _TYPES) + " FROM events GROUP BY 1) c ON c.bucket = o.bucket")
def pattern_pivot_order(events):
    """Given rows in a given order; those that are absent altogether are null, not 0."""
    return reporting.pivot_counts(events.select((_c("user_id") % 10).alias("bucket"), "event_type"), "bucket", "event_type", _TYPES, [12, 3, 1, 11])


@query("SELECT event_type, round(avg(value) FILTER (user_id % 2 = 0), 4) AS value_even, round(avg(value) FILTER (user_id % 2 = 1), 4) AS value_odd, round(round(avg(value) FILTER (user_id % 2 = 0), 4) - round(avg(value) FILTER (user_id % 2 = 1), 4), 4) AS value_difference FROM events GROUP BY 1")
def evaluator_pivot(events):
    rows = events.select("event_type", "value", F.when(_c("user_id") % 2 == 0, "even").otherwise("odd").alias("evaluator"))
    return reporting.compare(rows, ["event_type"], "evaluator", ["even", "odd"], ["value"])


@query("SELECT (SELECT count(*) FROM (SELECT event_id FROM events WHERE event_type = 'signup')) AS missing, (SELECT count(*) FROM labels WHERE doc_id % 2 = 0) AS unexpected, (SELECT count(*) FROM events WHERE event_type = 'error') AS repeated")
def worker_keys(events, labels):
    """Expected against observed keys: signups are missing, errors are there twice, keys below 0 aren't expected."""
    ids = lambda df: df.select("event_id")
    observed = ids(events.where("event_type <> 'signup'")).unionByName(ids(events.where("event_type = 'error'"))).unionByName(labels.where("doc_id % 2 = 0").select((-1 - _c("doc_id")).alias("event_id")))
    return evaluation.cover(ids(events), observed, ["event_id"])


@query("SELECT user_id, event_type, arg_max(event_id, event_id) AS event_id, CASE WHEN bool_or(event_id % 2 = 1) THEN 2 ELSE 1 END AS part FROM events WHERE event_id % 2 = 1 OR (user_id, event_type) NOT IN (SELECT user_id, event_type FROM events WHERE event_id % 2 = 1) GROUP BY 1, 2")
def checkpoint_merge(events):
    """Two workers' rows: where both have a key, the second's stays, and the last of its own."""
    last = lambda df, k: evaluation.keep_last(df.select("user_id", "event_type", "event_id"), ["user_id", "event_type"], ["event_id"]).withColumn("part", F.lit(k))
    return evaluation.merged([last(events.where("event_id % 2 = 0"), 1), last(events.where("event_id % 2 = 1"), 2)], ["user_id", "event_type"])


@query("SELECT event_id, CASE WHEN event_type <> 'error' THEN round(value * 2, 4) END AS score, CASE WHEN event_type = 'error' THEN 'ValueError' END AS error_type, CASE WHEN event_type = 'error' THEN 'no score for ' || event_id END AS error_message FROM events")
def judge_scores(events):
    """A stub judge that never scores errors; the others are scored at the first try."""

    def score(row):
        if row["event_type"] == "error":
            raise ValueError(f"no score for {row['event_id']}")
        return {"score": row["value"] * 2}

    judged = evaluation.judge(events.select("event_id", "event_type", "value"), score, ["score"], base_seconds=0)
    return judged.select("event_id", F.round("score", 4).alias("score"), "error_type", "error_message")


@query("SELECT item_id, CASE WHEN item_id % 2 = 0 THEN upper(left(text, 5)) END AS response FROM benchmark")
def generate_stub(benchmark):
    """A stub generator; null prompts aren't asked."""
    rows = benchmark.select("item_id", F.when(_c("item_id") % 2 == 0, _c("text")).alias("prompt"))
    return evaluation.generate(rows, lambda prompts: [text.upper(p[:5]) for p in prompts]).select("item_id", "response")


@query("SELECT l_returnflag, l_linestatus, round(avg(l_discount) * 100, 4) AS discount_mean, round(stddev_samp(l_discount) * 100, 4) AS discount_sd, round(avg(l_tax) * 100, 4) AS tax_mean, round(stddev_samp(l_tax) * 100, 4) AS tax_sd, count(*) AS n FROM lineitem GROUP BY 1, 2")
def mean_sd_summary(lineitem):
    return reporting.mean_sd(lineitem, ["l_returnflag", "l_linestatus"], {"discount": _c("l_discount"), "tax": _c("l_tax")}, 100)


@query("SELECT l_returnflag, metric_label, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, count(value) AS n FROM (SELECT l_returnflag, 'l_quantity' AS metric_label, l_quantity AS value FROM lineitem UNION ALL SELECT l_returnflag, 'l_tax', l_tax FROM lineitem) x GROUP BY 1, 2")
def metric_long(lineitem):
    return reporting.long_metrics(lineitem.select("l_returnflag", "l_quantity", "l_tax"), ["l_returnflag"], ["l_quantity", "l_tax"])


@query("SELECT event_type, round(avg(value), 4) AS runtime_mean, round(stddev_samp(value), 4) AS runtime_sd, count(*) AS n FROM events GROUP BY 1")
def efficiency_table(events):
    return reporting.mean_sd(events, ["event_type"], {"runtime": _c("value")})


@query("SELECT lang, round(avg(quality), 4) AS quality, round(avg(toxic), 4) AS toxic FROM (SELECT lang, source, avg(l.quality) AS quality, avg(l.toxic) AS toxic FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY lang, source) x GROUP BY lang")
def evaluator_compare(documents, labels):
    one = documents.select("doc_id", "lang", "source").join(labels, "doc_id").groupBy("lang", "source").agg(F.avg("quality").alias("quality"), F.avg("toxic").alias("toxic"))
    return one.groupBy("lang").agg(F.round(F.avg("quality"), 4).alias("quality"), F.round(F.avg("toxic"), 4).alias("toxic"))


@query("SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING count(DISTINCT event_type) = 5)")
def common_ids(events):
    common = events.groupBy("user_id").agg(F.count_distinct("event_type").alias("n")).where("n = 5")
    return events.select("event_id", "user_id").join(common, "user_id", "left_semi")


@query("SELECT event_id, round(event_id / nullif(value, 0), 4) AS tokens_per_second FROM events")
def throughput(events):
    return events.select("event_id", F.round(F.try_divide(_c("event_id"), _c("value")), 4).alias("tokens_per_second"))


@query('SELECT user_id, round(arg_min(value, ts), 4) AS start, round(arg_max(value, ts), 4) AS "end", round(max(value), 4) AS peak, round(max(value) - arg_min(value, ts), 4) AS delta FROM events GROUP BY user_id')
def resource_profile(events):
    return reporting.profile(events, "user_id", "ts", "value")


@query("SELECT user_id, " + ", ".join(f"round(sum(value) FILTER (event_type = '{t}'), 4) AS {t}" for t in _TYPES) + " FROM events GROUP BY user_id")
def stage_times(events):
    return reporting.stage_times(events, "user_id", "event_type", "value", _TYPES)


@query("SELECT d.doc_id, round(CASE WHEN l.quality IS NULL THEN CASE WHEN d.doc_id % 2 = 0 THEN 0.5 END WHEN d.doc_id % 2 = 0 THEN (l.quality + 0.5) / 2.0 ELSE l.quality END::DOUBLE, 4) AS mean FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def row_mean_skipna(documents, labels):
    rows = documents.select("doc_id").join(labels, "doc_id", "left")
    return rows.select("doc_id", F.round(vectors.mean_available(_c("quality"), F.when(_c("doc_id") % 2 == 0, 0.5)), 4).alias("mean"))


@query(None)
def semantic_metrics(conversations):
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = conversations.withColumns({"answer": F.lead("text").over(w), "reference": F.lead("text", 2).over(w), "context": F.lag("text").over(w)})
    out = evaluation.semantic(rows, vectors.hashed_all, "text", "answer", "reference", "context")
    return out.select("conv_id", "turn", "answer_reference", "context_reference", "question_answer", "question_context", "answer_mean", "context_mean", "semantic_mean")


@query("SELECT p_partkey, p_name, p_size FROM part")
def csv_roundtrip(part):
    """Written as CSV to the shared folder and read back with its schema."""
    from quern.sources import files, shared, sinks

    spark = part.sparkSession
    path = shared.folder(spark, "csv")
    sinks.write_csv(part.select("p_partkey", "p_name", "p_size"), path, mark=True)
    return files.read_csv(spark, path, "p_partkey long, p_name string, p_size int")


@query("WITH u AS (SELECT doc_id // 10 AS g, quality AS q, row_number() OVER w AS r, sum(quality) OVER w AS s FROM labels WHERE quality IS NOT NULL WINDOW w AS (PARTITION BY doc_id // 10 ORDER BY doc_id)) SELECT g, round(sum(CASE WHEN q = 1 THEN s / r::DOUBLE ELSE 0 END) / nullif(sum(q), 0), 6) AS context_precision, round(sum(q)::DOUBLE / count(*), 6) AS supported_share FROM u GROUP BY g")
def judge_formulas(labels):
    """Ten neighbouring documents as the ordered verdicts on an answer's contexts, or on its claims."""
    rows = labels.where("quality is not null").groupBy(F.floor(_c("doc_id") / 10).alias("g")).agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "quality"))), lambda x: x["quality"].cast("int")).alias("v"))
    return rows.select("g", F.round(evaluation.context_precision(_c("v")), 6).alias("context_precision"), F.round(evaluation.supported_share(_c("v")), 6).alias("supported_share"))
