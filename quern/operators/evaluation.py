"""The evaluation matrix: what to run, what is done, who does it, and the scores."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.functions import text, vectors
from quern.operators.retrieval import places
from quern.sources.shared import unused

# The key of every evaluation table, and configurations in their order.
KEYS = ["id", "model_name", "architecture_config"]
ARCHITECTURES = ["SLM", "Text-RAG", "Image-Text-RAG", "Image-RAG"]


def question_id(index: Column) -> Column:
    return F.concat(F.lit("q_"), F.lpad((index + 1).cast("string"), F.greatest(F.lit(3), F.length((index + 1).cast("string"))), F.lit("0")))


def question_number(id_: Column) -> Column:
    """The number in an id, a thousand million where there is none."""
    return F.coalesce(F.replace(id_, F.lit("q_"), F.lit("")).try_cast("int"), F.lit(1_000_000_000))


def matrix(questions: DataFrame, models: list[str], configurations: list[str] = ARCHITECTURES) -> DataFrame:
    """Models x configurations x questions; the two lists are exploded arrays, not joins."""
    out = questions.withColumn("model_name", F.explode(F.array(*map(F.lit, models))))
    return out.withColumn("architecture_config", F.explode(F.array(*map(F.lit, configurations))))


def pending(todo: DataFrame, done: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Rows whose key is not done yet."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row by ``order`` of each key, by an aggregate that combines before it shuffles."""
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_r"))
    return last.select("_r.*")


def enum_order(c: Column, values: list[str]) -> Column:
    """Place of a value in a list from 1, null if absent."""
    return F.nullif(F.array_position(F.array(*map(F.lit, values)), c), F.lit(0))


def split_work(df: DataFrame, by: list[str], order: list[Column], workers: int) -> DataFrame:
    """worker_id 1..workers: each group in order, cut into runs of equal length. No group is gathered in one task."""
    place, n = unused(df, "_place", "_n")
    out = places(df, by, order, place, n)
    return out.withColumn("worker_id", F.floor(F.col(place) / F.ceil(F.col(n) / workers)).cast("int") + 1).drop(place, n)


def cover(expected: DataFrame, observed: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """One row: how many expected keys are missing, how many observed ones are not expected, and how many observed ones
    are there more than once. Sets are equal where all three are 0."""
    marked = lambda df, e, o: df.select(*keys, F.lit(e).alias("_e"), F.lit(o).alias("_o"))
    both = marked(expected, 1, 0).unionByName(marked(observed, 0, 1)).groupBy(*keys).agg(F.sum("_e").alias("_e"), F.sum("_o").alias("_o"))
    return both.agg(F.count_if(F.col("_o") == 0).alias("missing"), F.count_if(F.col("_e") == 0).alias("unexpected"), F.count_if(F.col("_o") > 1).alias("repeated"))


def require_cover(expected: DataFrame, observed: DataFrame, keys: list[str] = KEYS) -> None:
    """Raises where the keys aren't the same, each once."""
    found = cover(expected, observed, keys).first().asDict()
    if any(found.values()):
        raise ValueError("the keys differ: " + ", ".join(f"{n} {k}" for k, n in found.items() if n))


def merged(parts: list[DataFrame], keys: list[str] = KEYS) -> DataFrame:
    """Checkpoints of several workers as one table; of rows with equal keys the one from the last part stays."""
    rows = parts[0].withColumn("_part", F.lit(0))
    for k, part in enumerate(parts[1:], 1):
        rows = rows.unionByName(part.withColumn("_part", F.lit(k)), allowMissingColumns=True)
    return keep_last(rows, keys, ["_part"]).drop("_part")


def generate(df: DataFrame, answer: Callable[[list[str]], list[str]], prompt: str = "prompt", name: str = "response") -> DataFrame:
    """``df`` with the answers of a generator, which gets the prompts of a batch; null prompts are not asked."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            asked = batch[prompt].notna()
            out = pd.Series([None] * len(batch), index=batch.index, dtype=object)
            if asked.any():
                out[asked] = list(answer(batch.loc[asked, prompt].tolist()))
            yield batch.assign(**{name: out})

    return df.mapInPandas(run, StructType([*(f for f in df.schema if f.name != name)]).add(name, "string"))


def _gathered(batches: Iterator[pd.DataFrame], stream: Callable[[str], Iterator[str]], key: str, prompt: str, most: int, seconds: float, clock: Callable[[], float] = time.monotonic) -> Iterator[pd.DataFrame]:
    rows, began = [], clock()
    for batch in batches:
        for k, asked in zip(batch[key], batch[prompt], strict=True):
            for n, piece in enumerate(stream(asked) if asked is not None else ()):
                rows.append((k, n, piece))
                if len(rows) >= most or clock() - began >= seconds:
                    yield pd.DataFrame(rows, columns=[key, "piece_no", "piece"])
                    rows, began = [], clock()
    if rows:
        yield pd.DataFrame(rows, columns=[key, "piece_no", "piece"])


def generate_pieces(df: DataFrame, stream: Callable[[str], Iterator[str]], key: str, prompt: str = "prompt", most: int = 512, seconds: float = 0.5) -> DataFrame:
    """(key, piece_no, piece) of generators that give an answer piece by piece. Pieces are handed on ``most`` at a time, or what
    there is with the first piece after ``seconds``."""
    run = lambda batches: _gathered(batches, stream, key, prompt, most, seconds)
    return df.select(key, prompt).mapInPandas(run, StructType([df.schema[key]]).add("piece_no", "integer").add("piece", "string"))


def route(configuration: Column, image: Column) -> Column:
    """What a configuration uses: struct (rag_enabled, uses_query, uses_image). One with images needs an image: without,
    it's an error."""
    with_image = configuration.isin("Image-RAG", "Image-Text-RAG")
    given = F.when(with_image & image.isNull(), F.raise_error(F.lit("this configuration needs an image"))).otherwise(with_image)
    return F.struct((configuration != "SLM").alias("rag_enabled"), configuration.isin("Text-RAG", "Image-Text-RAG").alias("uses_query"), given.cast("boolean").alias("uses_image"))


def judge(df: DataFrame, score: Callable[[dict], dict[str, float | None]], metrics: list[str], retries: int = 3, base_seconds: float = 2.0) -> DataFrame:
    """``df`` with a judge's scores, and error_type and error_message of rows for which the last try failed too.

    A row is tried ``retries`` times, with pauses of ``base_seconds`` times the number of tries so far; the rows of a
    task wait for each other only.
    """

    def tried(row: dict) -> dict:
        for attempt in range(1, retries + 1):
            try:
                found = score(row)
                return {m: found.get(m) for m in metrics} | {"error_type": None, "error_message": None}
            except Exception as e:  # a judge may fail in any way
                last = e
                if attempt < retries:
                    time.sleep(base_seconds * attempt)
        return dict.fromkeys(metrics) | {"error_type": type(last).__name__, "error_message": str(last)}

    names = [*metrics, "error_type", "error_message"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            scored = pd.DataFrame([tried(r) for r in batch.to_dict("records")], columns=names, index=batch.index)
            yield batch.assign(**{c: scored[c].astype("float64" if c in metrics else object) for c in names})

    schema = StructType([f for f in df.schema if f.name not in names])
    for m in metrics:
        schema = schema.add(m, "double")
    return df.mapInPandas(run, schema.add("error_type", "string").add("error_message", "string"))


def failures(judged: DataFrame, worker: Column, keys: list[str] = KEYS) -> DataFrame:
    """(timestamp, worker_id, keys, error_type, error_message) of failed rows."""
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    return judged.where("error_type is not null").select(now.alias("timestamp"), worker.alias("worker_id"), *keys, "error_type", "error_message")


def completed(expected: DataFrame, judged: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """The scored rows, if there is one for every expected key; raises otherwise, what is done stays where it was written."""
    scored = judged.where("error_type is null").drop("error_type", "error_message")
    missing = expected.select(*keys).distinct().join(scored.select(*keys), keys, "left_anti").count()
    failed = judged.where("error_type is not null").count()
    if missing or failed:
        raise RuntimeError(f"the evaluation is incomplete: {missing} keys missing, {failed} rows failed")
    return scored


def semantic(df: DataFrame, encode_all, question: str, answer: str, reference: str, context: str) -> DataFrame:
    """Four similarities and their means. The three texts of a row and its passages are encoded in one call.

    Context similarities are the largest over the passages of the context, null where there is none; a null text has
    no similarity.
    """
    three = [F.coalesce(F.col(c), F.lit("")) for c in (question, answer, reference)]
    passages = F.coalesce(text.passages(F.col(context)), F.array().cast("array<string>"))
    out = df.withColumn("_v", encode_all(F.concat(F.array(*three), passages)))
    side = {n: F.when(F.col(c).isNotNull(), F.get("_v", F.lit(k))) for k, (n, c) in enumerate((("q", question), ("a", answer), ("r", reference)))}
    best = lambda v: F.array_max(F.transform(F.slice("_v", F.lit(4), F.greatest(F.size("_v") - 3, F.lit(0))), lambda p: vectors.cosine(p, v)))
    out = out.withColumns({"answer_reference": vectors.cosine(side["a"], side["r"]), "question_answer": vectors.cosine(side["q"], side["a"]), "context_reference": best(side["r"]), "question_context": best(side["q"])})
    mean = vectors.mean_available
    out = out.withColumns({"answer_mean": mean(F.col("answer_reference"), F.col("question_answer")), "context_mean": mean(F.col("context_reference"), F.col("question_context")), "semantic_mean": mean(*map(F.col, ("answer_reference", "question_answer", "context_reference", "question_context")))})
    return out.drop("_v")


def context_precision(verdicts: Column) -> Column:
    """Mean precision at the relevant ranks of an ordered array of 0/1 verdicts."""
    hits = F.transform(verdicts, lambda v, i: F.when(v == 1, F.aggregate(F.slice(verdicts, F.lit(1), i + 1), F.lit(0), lambda s, x: s + x) / (i + 1)).otherwise(F.lit(0.0)))
    return F.try_divide(F.aggregate(hits, F.lit(0.0), lambda s, x: s + x), F.aggregate(verdicts, F.lit(0), lambda s, x: s + x))


def supported_share(verdicts: Column) -> Column:
    """Faithfulness or recall: the share of claims that hold."""
    return F.try_divide(F.aggregate(verdicts, F.lit(0), lambda s, x: s + x), F.size(verdicts))


def outcomes(df: DataFrame, score: Column, error: Column) -> tuple[DataFrame, DataFrame]:
    """(scored, failed): one pass gives (score, error) and two sinks read it."""
    rows = df.withColumns({"score": score, "error": error})
    return rows.where("error is null").drop("error"), rows.where("error is not null").drop("score")
