"""Language identification: words by per-language log frequency, unseen words by ever shorter n-grams."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from quern.llm import scratch
from quern.llm.wordhash import pieces

UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")
_LONGEST = 5


def tokens(text: str) -> list[str]:
    """Lower-case runs of letters."""
    return [w for w in _WORD.findall(text.lower()) if w[0].isalpha() or any(map(str.isalpha, w))]


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of a word with its ends marked; single characters without marks."""
    marked = word if n == 1 else f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def _columns(rows: pa.Table | list[tuple], names: list[str]) -> pa.Table:
    """Rows as columns, strings but for the numbers at the end."""
    if isinstance(rows, pa.Table):
        return rows.select(names).combine_chunks()
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.table([pa.array(c, pa.int64() if n in ("size", "n") else pa.string()) for n, c in zip(names, columns, strict=True)], names)


class Model:
    """Log frequencies per language of known words and of character n-grams.

    An entry holds only the languages it was seen in; in all others its log is that of its table's zero count.
    """

    def __init__(self, words: pa.Table | list[tuple[str, str, int]], counts: pa.Table | list[tuple[str, str, int, int]] | None = None):
        """``words``: (lang, word, n). ``counts``: (lang, n-gram, its size, n), by default of these words."""
        words = _columns(words, ["lang", "word", "n"])
        if counts is None:
            counts = [(lang, g, size, n) for lang, word, n in zip(*(c.to_pylist() for c in words.columns), strict=True) for size in range(1, _LONGEST + 1) for g in grams(word, size)]
        counts = _columns(counts, ["lang", "gram", "size", "n"])
        self.langs = sorted({*words["lang"].unique().to_pylist(), *counts["lang"].unique().to_pylist()})
        at = pa.array(self.langs, pa.string())
        #: Known words and their places; sorted n-grams by n, whose places follow on from those of the words.
        self.known: dict[str, int] = {w: k for k, w in enumerate(words["word"].unique().to_pylist())}
        entry = pc.index_in(words["word"], words["word"].unique())
        self.grams, self.first = [np.zeros(0, "U1")], [0]
        parts, langs, ns, first = [entry.to_numpy().astype(np.int64)], [pc.index_in(words["lang"], at).to_numpy()], [words["n"].to_numpy()], len(self.known)
        for size in range(1, _LONGEST + 1):
            some = counts.filter(pc.equal(counts["size"], size))
            table, place = np.unique(np.array(some["gram"].to_pylist(), f"U{size}"), return_inverse=True)
            self.grams.append(table)
            self.first.append(first)
            parts.append(place + first)
            langs.append(pc.index_in(some["lang"], at).to_numpy())
            ns.append(some["n"].to_numpy())
            first += len(table)
        self._fill(np.concatenate(parts).astype(np.int64), np.concatenate(langs).astype(np.int64), np.concatenate(ns).astype(float))

    def _fill(self, entry: np.ndarray, lang: np.ndarray, n: np.ndarray) -> None:
        """Smoothed by a half per table: ``base`` has the logs of zero counts, ``more`` what seen entries add to them."""
        wide, sizes = max(1, len(self.langs)), np.array([len(self.known), *map(len, self.grams[1:])])
        self.table = np.repeat(np.arange(len(sizes), dtype=np.int8), sizes)
        cell, at = np.unique(entry * wide + lang, return_inverse=True)
        n = np.bincount(at, n, len(cell))
        entry, self.lang = cell // wide, (cell % wide).astype(np.int32)
        table = self.table[entry].astype(np.int64)
        totals = np.bincount(table * wide + self.lang, n, len(sizes) * wide).reshape(len(sizes), wide) + 0.5 * np.maximum(sizes, 1)[:, None]
        self.base = np.log(0.5 / totals)
        self.more = np.log((n + 0.5) / 0.5).astype(np.float32)
        self.start = np.concatenate([[0], np.cumsum(np.bincount(entry, minlength=len(self.table)))])

    def sums(self, entries: np.ndarray, shares: np.ndarray, owners: np.ndarray, n: int) -> np.ndarray:
        """For each of ``n`` owners the logs per language of its entries, by their shares."""
        wide = len(self.langs)
        tables = np.bincount(owners * len(self.base) + self.table[entries], shares, n * len(self.base)).reshape(n, -1)
        count = self.start[entries + 1] - self.start[entries]
        at = np.repeat(self.start[entries] - np.cumsum(count) + count, count) + np.arange(count.sum())
        own = np.bincount(np.repeat(owners, count) * wide + self.lang[at], self.more[at] * np.repeat(shares, count), n * wide)
        return tables @ self.base + own.reshape(n, wide)

    def places(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(entries, owners): what each word's score is the mean of, its own entry if known, else its known n-grams of
        the longest size that has any. Owners are places in ``words``; those without entries are unknown altogether."""
        own = [(i, k) for k, w in enumerate(words) if (i := self.known.get(w)) is not None]
        out = [np.array(own, np.int64).reshape(-1, 2)]
        left = [k for k, w in enumerate(words) if w not in self.known]
        for n in range(_LONGEST, 0, -1):
            table = self.grams[n]
            if not left or not len(table):
                continue
            found = [(g, k) for k in left for g in grams(words[k], n)]
            if not found:
                continue
            names, owner = np.array([g for g, _ in found], f"U{n}"), np.array([k for _, k in found])
            at = np.minimum(np.searchsorted(table, names), len(table) - 1)
            hit = table[at] == names
            out.append(np.stack([at[hit] + self.first[n], owner[hit]], axis=1))
            done = set(owner[hit].tolist())
            left = [k for k in left if k not in done]
        entries, owners = np.concatenate(out).T
        return entries, owners


class Scorer:
    """Scores texts; remembers what a bounded number of white-space pieces contribute."""

    def __init__(self, model: Model, memory: int = 120_000):
        # 64 MB of rows, however many languages there are
        self.model, self.memory = model, max(1, min(memory, (16 << 20) // max(1, len(model.langs))))
        self.chunk = min(20_000, self.memory)
        self.rows = np.zeros((self.memory + 1, len(model.langs)), np.float32)
        self.words = np.zeros(self.memory + 1)
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {}

    def _learn(self, new: list[str]) -> None:
        """Fills the rows of new pieces together."""
        found = [(w, k) for k, piece in enumerate(new) for w in tokens(piece)]
        entries, word = self.model.places([w for w, _ in found])
        piece, n = np.array([k for _, k in found], np.int64), np.bincount(word, minlength=len(found))
        a, b = len(self.at), len(self.at) + len(new)
        self.rows[a:b] = self.model.sums(entries, 1 / n[word], piece[word], len(new))
        self.words[a:b] = np.bincount(piece[n > 0], minlength=len(new))
        self.at.update(zip(new, range(a, b), strict=True))

    def total(self, text: str) -> np.ndarray:
        """Summed log scores of all words, and the number of words of which anything is known last."""
        pieces_, sums = Counter(text.split()), np.zeros(len(self.model.langs) + 1)
        counts = list(pieces_.items())
        for lo in range(0, len(counts), self.chunk):
            some = counts[lo : lo + self.chunk]
            if len(self.at) + len(some) > self.memory:
                self._clear()
            if new := [p for p, _ in some if p not in self.at]:
                self._learn(new)
            rows, n = np.array([self.at[p] for p, _ in some]), np.array([n for _, n in some], float)
            sums[:-1] += n @ self.rows[rows]
            sums[-1] += n @ self.words[rows]
        return sums

    def predict(self, text: str | None) -> tuple[str, float, int]:
        """Language, score, and the number of words of which anything is known."""
        sums = self.total(text) if text and self.model.langs else np.zeros(1)
        if not sums[-1] and not (self.model.langs and text and any(map(str.isalpha, text))):
            return UNKNOWN, 0.0, 0
        best = int(np.argmax(sums[:-1]))
        return self.model.langs[best], 1.0 / float(np.exp(np.maximum(sums[:-1] - sums[best], -700)).sum()), round(sums[-1])


def held_out(id_column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3, is 1; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()

    def rows() -> pa.RecordBatch:
        keys = list(seen)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([seen[k] for k in keys], pa.int64())], ["lang", "word", "n"])

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            seen.update((lang, w) for w in tokens(text))
            if len(seen) > 50_000:
                yield rows()
                seen.clear()
    yield rows()


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()

    def rows() -> pa.RecordBatch:
        lang, gram, size = zip(*seen, strict=True) if seen else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(gram, pa.string()), pa.array(size, pa.int32()), pa.array(seen.values(), pa.int64())], ["lang", "gram", "size", "n"])

    for batch in batches:
        for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True):
            for size in range(1, _LONGEST + 1):
                for g in grams(word, size):
                    seen[lang, g, size] += n
            if len(seen) > 50_000:
                yield rows()
                seen.clear()
    yield rows()


def _most(counts: DataFrame, by: list[str], what: str, most: int) -> DataFrame:
    """The ``most`` frequent rows of ``counts`` for each ``by``, ties by ``what``."""
    order = Window.partitionBy(*by).orderBy(F.col("n").desc(), what)
    return counts.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= most).drop("_place")


def train(docs: DataFrame, docs_per_language: int = 2_000, words_per_language: int = 100_000, grams_per_language: int = 100_000) -> Model:
    """Fits on rows with text and lang that aren't held out.

    A sample of ``docs_per_language`` rows of each language at most, chosen by a hash of id and text. All languages
    and all words of the sample count: those seen twice or more in a language are known words, and all make up
    its n-grams. The model holds the ``words_per_language`` most frequent known words of each language, and of its
    n-grams of each size the ``grams_per_language`` most frequent; so much and no more reaches the driver for a language.
    """
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    rows = rows.withColumn("draw", F.xxhash64("doc_id", "text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    first = lambda df: df.withColumn("place", place).where(F.col("place") <= docs_per_language)  # noqa: E731  tasks keep as many at most
    edge = first(rows.select("lang", "draw")).groupBy("lang").agg(F.max("draw").alias("edge"))
    some = first(rows.join(F.broadcast(edge), "lang").where(F.col("draw") <= F.col("edge"))).select("lang", "text", "place")
    some = some.repartition("lang", F.col("place") % 16).select("lang", "text")
    words = scratch.table(some.mapInArrow(_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    counts = words.mapInArrow(_grams, "lang string, gram string, size int, n long").groupBy("lang", "gram", "size").agg(F.sum("n").alias("n"))
    return Model(_most(words.where("n > 1"), ["lang"], "word", words_per_language).toArrow(), _most(counts, ["lang", "size"], "gram", grams_per_language).toArrow())


def identify(docs: DataFrame, model: Model | None = None, names: tuple[str, ...] = ("lang_pred", "score")) -> DataFrame:
    """All rows and columns of ``docs`` with language and score under these ``names``, from whole texts alone; a third name is for the
    number of words of which anything is known.

    A text that is null or has no letter is ``und`` with score 0, as is every text if nothing could be learned. Every other text
    gets a learned language, the first by code point among the best; one of which the model knows nothing, not so much as a single
    character, has no known word and equal chances for all.
    The score is the posterior of the language under equal priors. Columns of these names are replaced, others stay
    whatever their names and types; repeated rows and rows with a null id get their results like any other; an empty
    table gives no rows.
    """
    scratch.bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(train(docs) if model is None else model)
    docs = docs.drop(*names).withColumn("text", F.col("text").cast("string"))
    own = len(docs.columns)
    columns = [f"c{k}" for k in range(own + len(names))]
    text = columns[docs.columns.index("text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for part in pieces(batch, text):
                found = zip(*(scorer.predict(t.as_py()) for t in part.column(text)), strict=True)
                more = [pa.array(c, kind) for c, kind in zip(found, (pa.string(), pa.float64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *more[: len(names)]], columns)

    plain = docs.toDF(*columns[:own])
    schema = StructType([*plain.schema.fields, *map(StructField, columns[own:], (StringType(), DoubleType(), LongType()))])
    return plain.mapInArrow(run, schema).toDF(*docs.columns, *names)


def predictions(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every document, from a model of those not held out."""
    model = train(docs)
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
