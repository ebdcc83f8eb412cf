"""N-gram Jaccard join by universe partition and pigeonhole, verified exactly.

Shingles are hashed into ``m`` segments. ``m`` depends on the size band ``[l, u]`` of a set: two sets
with Jaccard at least ``t`` whose smaller one has at most ``u`` shingles differ in at most
``H = floor(u * (1 - t) / t)`` of them, so with ``m = H + 1 + k`` at least ``k + 1`` segments hold the same subset in
both. Every set joins the scheme of its own band and that of the band below; bands are as wide as partners reach.

Each set emits the hash of every non-empty segment subset. A segment empty in both sets says nothing and is not
indexed: a set with at most ``k`` empty segments shares a filled one with every partner. Sets with ``e > k`` empty
segments also emit the one-deletion neighbourhood (the subset less one shingle) of the first ``r`` segments. If all
segments on which two such sets agree are empty, then among any ``e_x + e_y - k`` segments one is filled in both and
differs by one shingle, so the pair meets there if ``e <= (k + r) / 2`` in both. Sets with still more empty segments
meet their partners at the empty segments themselves. No set of any size can miss a partner. ``k`` and ``r`` are
allocated per band by cost: signatures of ``k`` more segments against deletions against pairs expected at empty
segments, from the counts of all documents in the band.

A task combines equal keys before they are shuffled: of three sets or more it sends the one with the smallest id, and
the others as finished links to it. Candidates are stars: the smallest id of a bucket against the others, so a group of many copies gives as
many rows as it has members. Where a bucket still spans several components after that, its other pairs
across components matter too. Passages that many documents share fill such buckets. Here the spare segments count
again: a set with ``e`` empty segments shares ``k + 1 - e`` filled ones with each partner, so sets with company in fewer
buckets than that have no partner and are left out, as are, later on, those in fewer mixed buckets. Of the others the
pairs aren't listed as they meet: of each such set the shingles rarest among these sets, one more than it may lack in a
partner, are joined instead. Every similar pair shares one of them, early enough in both orders. The order is
by counts over all these sets in a table of fixed size; collisions there cost time, never a pair. Sets
are 64-bit shingle hashes; checks compare whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import scratch
from quern.llm.graph import components
from quern.llm.wordhash import U, mix, pieces, shingle_sets

#: Signatures in one shuffle partition, about.
PER_TASK = 500_000
#: Kinds of signatures, the ones that lead a bucket first: a whole subset (LED: that of others too, which a task has
#: linked to it), one less a shingle, an empty segment of a set with many, or with some; and a finished link.
FULL, LED, LESS, FEW, NONE, LINK = range(6)
#: Of so many segments one at least is spare, so that sets which share a passage only are told apart by counts.
SPARE = 3
#: Bits of the table that says which texts to fetch for checks (2 MB, whatever the data).
ID_BITS = 1 << 24
#: Cells of the table of shingle counts that ranks shingles by rarity (16 MB, whatever the data).
CELLS = 1 << 22
#: Words of 64 parities that go with a set into the join on rare shingles.
PARITIES = 4


class Schemes:
    """Bands, segment counts and allocations. ``counts``: sets per band, from all documents."""

    def __init__(self, threshold: Fraction, top: int, counts: dict[int, int] | None = None):
        low, lows, highs = 1, [], []
        while True:
            high = max(low, math.floor(low / threshold))
            lows.append(low)
            highs.append(high)
            if high >= top:
                break
            low = high + 1
        self.high, self.least = np.array(highs), [math.floor(u * (1 - threshold) / threshold) + 1 for u in highs]
        here = [(counts or {}).get(k, 0) for k in range(len(highs))]
        found = [self._allocate(lo, least, n + more) for lo, least, n, more in zip(lows, self.least, here, [*here[1:], 0], strict=True)]
        self.spare, self.r = (np.array(x) for x in zip(*found, strict=True))
        self.m = np.array(self.least) + self.spare

    @staticmethod
    def _allocate(low: int, least: int, n: int) -> tuple[int, int]:
        """(spare segments, segments that get neighbourhoods): the cheapest for ``n`` sets of ``low`` shingles.

        Empty segments are taken as Poisson; that decides on cost alone.
        """
        best, cost = (0, 0), math.inf
        if least == 1 or not n:
            return best
        at = np.arange(1, 4097)
        logs = np.concatenate([[0.0], np.cumsum(np.log(at))])
        floor = -(-least // SPARE)
        for spare in range(floor, floor + least + 1, max(1, least // 64)):
            m = least + spare
            each = low / m
            mean = max(m * math.exp(-each), 1e-12)
            over = np.maximum(0.0, 1 - np.cumsum(np.exp(np.concatenate([[0.0], at * math.log(mean)]) - logs - mean)))
            most = lambda e: float(over[min(e, 4096)])
            for r in (0, *(1 << k for k in range(1, m.bit_length()))):
                use, rare = most(spare), most(max(spare, (spare + r) // 2))
                now = m + use * (r * each + mean) + rare * use * n * math.exp(-each)
                if now < cost:
                    best, cost = (spare, r), now
        return best

    def band(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.high, sizes)


def _segments(sets: list[np.ndarray], docs: np.ndarray, scheme: np.ndarray, s: Schemes) -> Iterator[tuple[np.ndarray, int | np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, kind, docs, needs) of all sets, each under the scheme given for it. ``needs``: how many whole subsets of a
    set's own every partner has too, at least, and 1 where that says nothing."""
    m, r = s.m[scheme], s.r[scheme]
    base = np.concatenate([[0], np.cumsum(m)])
    which = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    h = np.concatenate(sets)
    with np.errstate(over="ignore"):
        seg = ((h >> U(32)) * m[which].astype(U) >> U(32)).astype(np.int64)
        at = base[which] + seg
        g = mix(h, 0x5851F42D4C957F2D)
        total = np.zeros(base[-1], U)
        np.add.at(total, at, g)
        count = np.bincount(at, minlength=base[-1])
        owner = np.repeat(np.arange(len(sets)), m)
        salt = mix((scheme[owner].astype(U) << U(32)) + (np.arange(base[-1]) - base[owner]).astype(U), 0x14057B7EF767814F)
        filled = count > 0
        empty = m - np.bincount(owner[filled], minlength=len(sets))
        need = np.clip(s.spare[scheme] + 1 - empty, 1, 32_767).astype(np.int32)
        yield mix(total[filled] ^ salt[filled]), FULL, docs[owner[filled]], need[owner[filled]]
        more = empty > s.spare[scheme]
        if more.any():
            near = more[which] & (seg < r[which]) & (count[at] > 1)
            yield mix((total[at[near]] - g[near]) ^ salt[at[near]]), LESS, docs[which[near]], need[which[near]]
            rare, gone = empty > (s.spare[scheme] + r) // 2, ~filled & more[owner]
            yield mix(~salt[gone], 1), np.where(rare[owner[gone]], FEW, NONE).astype(np.int8), docs[owner[gone]], need[owner[gone]]


def _profile(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                rows = [(len(x), *_print(x), _sketch(x)) for x in shingle_sets(part.column("text"), n)]
                size, one, two, sketch = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, pa.int64()) for c in (size, one, two)), pa.array(sketch, pa.binary())], ["doc_id", "n_shingles", "f1", "f2", "sketch"])

    return run


def _print(x: np.ndarray) -> tuple[np.int64, np.int64]:
    """128 bits that stand for a whole set."""
    with np.errstate(over="ignore"):
        a, b = mix(x, 0x2545F4914F6CDD1D).sum(dtype=U), mix(x, 0x7FB5D329728EA185).sum(dtype=U)
    return a.astype(np.int64), b.astype(np.int64)


def _sketch(x: np.ndarray) -> bytes:
    """Parities of the shingles in each of a power of two of cells, about as many cells as shingles.

    Two sets differ in at least as many shingles as their parities do.
    """
    cells = 1 << min(13, max(6, (len(x) - 1).bit_length()))
    odd = np.bincount((x & U(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def _apart(x: bytes, y: bytes) -> int:
    """Shingles in which two sets differ, at least; the longer sketch is folded to the shorter."""
    a, b = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _may_link(t: Fraction):
    up, down = t.numerator, t.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b, a, b = (batch.column(c).to_pylist() for c in ("n_a", "n_b", "sketch_a", "sketch_b"))
            keep = [up * max(m, n) <= down * min(m, n) and (down + up) * _apart(x, y) <= (down - up) * (m + n) for m, n, x, y in zip(n_a, n_b, a, b, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _bits(ids: DataFrame):
    """A broadcast bit table of fixed size in which the bits of all ``ids`` (id) are set."""
    cell = F.col("id").bitwiseAND(F.lit(ID_BITS - 1))
    cells = ids.groupBy((cell / 32).cast("int").alias("cell")).agg(F.expr(f"bit_or(shiftleft(1L, cast((id & {ID_BITS - 1}) % 32 as int)))").alias("bits"))
    table = np.zeros(ID_BITS // 32, "<u4")
    for r in cells.collect():  # at most ID_BITS / 32 rows
        table[r.cell] = r.bits & 0xFFFFFFFF
    return ids.sparkSession.sparkContext.broadcast(table.view(np.uint8))


def _near(ids):
    """Documents whose id may be among those of a fixed-size bit table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ids.value
        for batch in batches:
            batch = batch.filter(batch.column("doc_id").is_valid())
            low = batch.column("doc_id").to_numpy() & (ID_BITS - 1)
            yield batch.filter(pa.array((table[low >> 3] >> (low & 7).astype(np.uint8) & 1).astype(bool)))

    return run


def _parities(x: np.ndarray) -> np.ndarray:
    """Parities of the shingles in each of 64 * ``PARITIES`` cells, as 64-bit words."""
    odd = np.bincount((x & U(64 * PARITIES - 1)).astype(np.int64), minlength=64 * PARITIES) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8")


def _cell(x: np.ndarray) -> np.ndarray:
    return (mix(x, 0x3C6EF372FE94F82B) & U(CELLS - 1)).astype(np.int64)


def _cell_counts(n: int):
    """How many sets have a shingle in each cell, summed over a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int32)
        for batch in batches:
            for part in pieces(batch, "text"):
                for x in shingle_sets(part.column("text"), n):
                    np.add.at(total, _cell(x), 1)
        used = np.flatnonzero(total)
        for k in range(0, len(used), 200_000):
            some = used[k : k + 200_000]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some].astype(np.int64))], ["cell", "n"])

    return run


_ODD = [f"odd{k}" for k in range(PARITIES)]


def _rarest(n: int, t: Fraction, counts):
    """The shingles of each set, rarest first, that a partner can't all lack, with their places in that order."""
    up, down = t.numerator, t.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counts.value
        for batch in batches:
            for part in pieces(batch, "text"):
                ids, out = part.column("doc_id").to_numpy(), []
                for doc, x in zip(ids, shingle_sets(part.column("text"), n), strict=True):
                    if len(x):
                        most = len(x) - -(-up * len(x) // down) + 1
                        first = x[np.lexsort((x, table[_cell(x)]))[:most]]
                        out.append((first, np.arange(len(first), dtype=np.int32), *(np.full(len(first), v, np.int64) for v in (len(x), doc, *_parities(x)))))
                if out:
                    shingle, *others = (np.concatenate(c) for c in zip(*out, strict=True))
                    for k in range(0, len(shingle), 200_000):
                        j = slice(k, k + 200_000)
                        yield pa.RecordBatch.from_arrays([pa.array(c[j]) for c in (shingle.view(np.int64), *others)], ["shingle", "place", "size", "doc", *_ODD])

    return run


def _across(nodes: DataFrame, texts: DataFrame, n: int, t: Fraction) -> DataFrame:
    """A table of pairs (a, b) of ``nodes`` (doc, label) with different labels that may reach ``t``."""
    spark = nodes.sparkSession
    near = texts.mapInArrow(_near(_bits(nodes.select(F.col("doc").alias("id")))), "doc_id long, text string")
    near = near.join(nodes.select(F.col("doc").alias("doc_id")), "doc_id", "left_semi")
    near = scratch.table(near.select("doc_id", "text"), "near")
    cells = near.mapInArrow(_cell_counts(n), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).where("n > 1")
    cells = cells.select("cell", F.least("n", F.lit(2**31 - 1)).cast("int").alias("n")).toArrow()  # at most CELLS rows of 8 bytes
    counts = np.ones(CELLS, np.int32)
    counts[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    rare = near.mapInArrow(_rarest(n, t, spark.sparkContext.broadcast(counts)), "shingle long, place int, size long, doc long, " + ", ".join(f"{c} long" for c in _ODD))
    rare = scratch.table(rare.join(nodes, "doc"), "rare")
    shared = rare.groupBy("shingle").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most").select("shingle")
    both = rare.join(shared, "shingle")
    x, y = both.alias("x"), both.alias("y")
    up, down = t.numerator, t.denominator
    left = F.least(F.col("x.size") - F.col("x.place"), F.col("y.size") - F.col("y.place"))  # bounds what the two share
    both_sizes = F.col("x.size") + F.col("y.size")
    apart = sum((F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}"))) for c in _ODD), F.lit(0))  # at most what they differ in
    fits = (F.col("x.label") < F.col("y.label")) & (left * (up + down) >= both_sizes * up) & (apart * (up + down) <= both_sizes * (down - up))
    met = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & fits)
    pairs = scratch.table(met.select(F.least("x.doc", "y.doc").alias("a"), F.greatest("x.doc", "y.doc").alias("b")).distinct(), "across")
    scratch.drop(near, rare)
    return pairs


_SIGNED = "key long, kind byte, doc long, need int, first long"


def _combined(key: np.ndarray, doc: np.ndarray, need: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Full signatures of a piece: where three or more sets meet, the smallest id stays and the rest are links to it,
    with its need in the upper half of theirs."""
    order = np.lexsort((doc, key))
    key, doc, need = key[order], doc[order], need[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(first, len(key)))
    head, many = np.repeat(first, size), np.repeat(size > 2, size)
    link = many & (np.arange(len(key)) != head)
    kind = np.where(link, LINK, np.where(many, LED, FULL)).astype(np.int8)
    yield from _batches(key, kind, doc, np.where(link, need | need[head] << 16, need), doc[head], link)


def _batches(key: np.ndarray, kind: np.ndarray, doc: np.ndarray, need: np.ndarray, first: np.ndarray, link: np.ndarray) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(key), 200_000):
        j = slice(k, k + 200_000)
        yield pa.RecordBatch.from_arrays([pa.array(key[j]), pa.array(kind[j]), pa.array(doc[j]), pa.array(need[j]), pa.array(first[j], mask=~link[j])], ["key", "kind", "doc", "need", "first"])


def _sign(n: int, s: Schemes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[tuple] = set()  # a batch signs equal sets once: their smallest id there
            order = batch.take(pa.compute.sort_indices(batch.column("doc_id")))
            for part in pieces(order, "text"):
                ids, sets, at = part.column("doc_id"), [], []
                for i, x in enumerate(shingle_sets(part.column("text"), n)):
                    if len(x) and ids[i].is_valid and (p := (len(x), *_print(x))) not in seen:
                        seen.add(p)
                        sets.append(x)
                        at.append(ids[i].as_py())
                if not sets:
                    continue
                docs, band = np.array(at, np.int64), s.band(np.array([len(x) for x in sets]))
                lower = np.flatnonzero(band > 0)
                for some, scheme in ((range(len(sets)), band), (lower.tolist(), band[lower] - 1)):
                    if len(scheme):
                        for key, kind, doc, need in _segments([sets[i] for i in some], docs[some], scheme, s):
                            key = key.view(np.int64)
                            if kind is FULL:
                                yield from _combined(key, doc, need)
                            else:
                                yield from _batches(key, np.broadcast_to(np.asarray(kind, np.int8), len(key)), doc, need, doc, np.zeros(len(key), bool))

    return run


_MET = ["key", "first", "first_need", "doc", "need", "n"]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, kind, doc, links after all: (bucket, its first document, each other). Holds one batch and one row.

    Links pass. Buckets of two that no task has combined carry no key, since no pair is left to check in them; ``n`` says
    how many of them two sets share.
    """
    last: tuple | None = None
    for batch in batches:
        link = batch.column("kind").to_numpy() == LINK
        if link.any():
            done = batch.filter(pa.array(link))
            both = done.column("need").to_numpy()
            yield pa.RecordBatch.from_arrays([done.column("key"), done.column("first"), pa.array(both >> 16), done.column("doc"), pa.array(both & 0xFFFF), pa.array(np.ones(len(both), np.int32))], _MET)
            batch = batch.filter(pa.array(~link))
        if not batch.num_rows:
            continue
        row = [batch.column(c).to_numpy() for c in ("key", "kind", "doc", "need")]
        if last is not None:
            row = [np.concatenate([np.array([x], c.dtype), c]) for x, c in zip(last, row, strict=True)]
        key, kind, doc, need = row
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(first, len(key)))
        open_ = np.logical_or.reduceat(kind == LED, first)
        open_[[0, -1]] = True
        head = np.repeat(first, size)
        last = tuple(c[first[-1]] for c in row)
        use = (np.isin(kind[head], (FULL, LED, FEW))) & (np.arange(len(key)) != head) & (doc != doc[head])
        more = np.repeat((size > 2) | open_, size)
        few, lead = use & ~more, head[use & ~more]
        pair, times = np.unique(np.stack([doc[lead], need[lead].astype(np.int64), doc[few], need[few].astype(np.int64)]), axis=1, return_counts=True)
        many = use & more
        k = np.concatenate([key[many], np.zeros(pair.shape[1], np.int64)])
        if len(k):
            columns = [(doc[head[many]], pair[0]), (need[head[many]], pair[1].astype(np.int32)), (doc[many], pair[2]), (need[many], pair[3].astype(np.int32)), (np.ones(many.sum(), np.int32), times.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([pa.array(k, mask=np.arange(len(k)) >= many.sum()), *(pa.array(np.concatenate(c)) for c in columns)], _MET)


def _check(n: int, t: Fraction):
    up, down = t.numerator, t.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text_b"):
                a, text = part.column("a").to_pylist(), part.column("text_a")
                change = [0, *(i for i in range(1, len(a)) if a[i] != a[i - 1] or text[i] != text[i - 1]), len(a)]
                lead = shingle_sets(text.take(pa.array(change[:-1])), n)
                other = shingle_sets(part.column("text_b"), n)
                keep = np.zeros(len(a), bool)
                for lo, hi in zip(change[:-1], change[1:], strict=True):
                    x = next(lead)
                    for i in range(lo, hi):
                        y = next(other)
                        if up * max(len(x), len(y)) <= down * min(len(x), len(y)) and len(x):
                            at = np.searchsorted(x, y)
                            at[at == len(x)] = 0
                            both = int(np.count_nonzero(x[at] == y))
                            keep[i] = down * both >= up * (len(x) + len(y) - both)
                yield part.select(["a", "b"]).filter(pa.array(keep))

    return run


def _verified(pairs: DataFrame, sized: DataFrame, texts: DataFrame, n: int, t: Fraction) -> DataFrame:
    """The pairs (a, b) whose sets reach ``t``.

    Sizes and parity sketches first drop pairs that differ too much for certain; whole texts are fetched for the
    rest only. All joins are plain equi-joins, so hot ids are split at run time.
    """
    for end in ("a", "b"):
        pairs = pairs.join(sized.select(F.col("doc_id").alias(end), F.col("n_shingles").alias(f"n_{end}"), F.col("sketch").alias(f"sketch_{end}")).distinct(), end)
    left = scratch.table(pairs.mapInArrow(_may_link(t), "a long, b long").distinct(), "left")
    near = texts.mapInArrow(_near(_bits(left.select(F.explode(F.array("a", "b")).alias("id")))), "doc_id long, text string")
    with_b = left.join(near.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(near.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_check(n, t), "a long, b long").distinct()


def similar_groups(docs: DataFrame, words: int = 5, threshold: Fraction | str = "0.8", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for every row: exact Jaccard links over distinct ``words``-word shingles.

    Words are runs of bytes other than white space (20, 09-0D), A-Z taken as a-z. Fewer words than
    ``words``: the whole sequence is the one shingle. Null, empty or blank texts: 0 shingles, linked with
    nothing. Equal texts and repeated rows link. Rows sharing an id are one node that links as any of them
    does. A null id keeps its row, with a null component. Other columns are ignored. An empty table gives
    an empty result.
    """
    spark, t = docs.sparkSession, Fraction(threshold)
    scratch.bound_batches(spark)
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    sized = scratch.table(docs.mapInArrow(_profile(words), "doc_id long, n_shingles long, f1 long, f2 long, sketch binary"), "sizes")

    known = sized.where("n_shingles > 0 and doc_id is not null")
    top = known.agg(F.max("n_shingles")).first()[0]
    label = sized.select(F.col("doc_id").alias("node")).where("false").withColumn("label", F.col("node"))
    if top:
        s = Schemes(t, top)
        band = F.array_position(F.transform(F.array(*[F.lit(int(x)) for x in s.high]), lambda x: x >= F.col("n_shingles")), F.lit(True)) - 1
        counts = {int(r.band): r["count"] for r in known.groupBy(band.alias("band")).count().collect()}
        s = Schemes(t, top, counts)
        rows = sum(c * int(s.m[k] + s.m[max(0, k - 1)]) for k, c in counts.items())

        same = known.groupBy("n_shingles", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"), F.count("*").alias("rows")).where("rep <> last").drop("last")
        copies = scratch.skew_join(known.select("doc_id", "n_shingles", "f1", "f2"), scratch.table(same, "same"), ["n_shingles", "f1", "f2"], "rows")
        copies = scratch.table(copies.where("doc_id <> rep").select(F.col("doc_id").alias("id"), "rep").distinct(), "copies")

        signed = docs.mapInArrow(_sign(words, s), _SIGNED)
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // PER_TASK)
        deal = F.when(F.col("kind") == LINK, F.xxhash64("key", "doc")).otherwise(F.col("key"))
        sorted_ = signed.repartition(parts, deal).sortWithinPartitions((F.col("kind") == LINK), "key", "kind", "doc")
        del signed
        met = scratch.table(sorted_.mapInArrow(_stars, "key long, first long, first_need int, doc long, need int, n int"), "met")
        del sorted_
        scratch.release(spark)

        def of_copies(pairs: DataFrame) -> DataFrame:
            for end in ("a", "b"):
                pairs = pairs.join(copies.withColumnRenamed("id", end), end, "left").withColumn(end, F.coalesce("rep", end)).drop("rep")
            return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

        full, two = met.where("key is not null"), met.where("key is null")
        members = full.select("key", F.col("first").alias("doc"), F.col("first_need").alias("need")).unionByName(full.select("key", "doc", "need")).distinct()
        members = scratch.table(members, "members")
        company = members.select("doc", "need", F.lit(1).alias("n")).unionByName(two.select(F.col("first").alias("doc"), F.col("first_need").alias("need"), "n")).unionByName(two.select("doc", "need", "n"))
        able = company.groupBy("doc", "need").agg(F.sum("n").alias("n")).where("n >= need").select("doc").distinct()
        able = scratch.table(able, "able")
        starred = met.select(F.col("first").alias("a"), F.col("doc").alias("b")).distinct()
        for end in ("a", "b"):
            starred = starred.join(able.withColumnRenamed("doc", end), end, "left_semi")
        pairs = scratch.table(of_copies(starred), "pairs")
        equal = copies.select(F.col("rep").alias("a"), F.col("id").alias("b"))
        links = scratch.table(_verified(pairs, sized, docs, words, t).unionByName(equal), "links")
        scratch.release(spark)
        label = components(links)

        scratch.drop(met)
        bare, members = members, members.join(able, "doc", "left_semi")
        members = members.join(label.withColumnRenamed("node", "doc"), "doc", "left").withColumn("label", F.coalesce("label", "doc"))
        members = scratch.table(members, "members")
        scratch.drop(bare, able)
        mixed = members.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most").select("key")
        crossing = members.join(mixed, "key").groupBy("doc", "label", "need").agg(F.count("*").alias("n")).where("n >= need").select("doc", "label").distinct()
        crossing = crossing.join(copies.withColumnRenamed("id", "doc"), "doc", "left").select(F.coalesce("rep", "doc").alias("doc"), "label").distinct()
        crossing = scratch.table(crossing, "crossing")
        across = _across(crossing, docs, words, t)
        rest = scratch.table(across.join(pairs, ["a", "b"], "left_anti"), "rest")
        scratch.drop(members, crossing, across, pairs)
        if not rest.isEmpty():
            late = scratch.table(_verified(rest, sized, docs, words, t), "late")
            if not late.isEmpty():
                label = components(links.unionByName(late))
    out = sized.join(label.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select(F.col("doc_id").alias(id_column), "n_shingles", F.coalesce("label", "doc_id").alias("component_id"))
