"""Merkle manifest of a dataset: a tree of three children over each source, one over the sources, a proof for every row.

Leaves are numbered within their source by ranges, so a hot source is many ranges. An aligned block is ``ARITY ** DEPTH`` leaves,
that is whole subtrees; blocks are independent of one another. Within a block a traversal goes leaf by leaf: for
every level a treehash stack builds the next run of siblings while the present one is still needed, and stacks
take turns, the one with the lowest top first, so that a block of n leaves needs some multiple of log n digests besides
the leaves. The roots of the blocks are the leaves of the next round, as often as it takes, and the paths of a round are
appended to those of the round below. The sources are one more tree of the same kind.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import scratch
from quern.operators.retrieval import places

#: Children of a node; levels of a block, of 729 leaves then.
ARITY, DEPTH = 3, 6
_HEX = 64


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def height(n: int) -> int:
    """Levels above ``n`` nodes until one remains."""
    h = 0
    while n > 1:
        n, h = -(-n // ARITY), h + 1
    return h


class Treehash:
    """Builds the up to ``ARITY`` nodes of one run at ``level``, a leaf at a time; shorter runs at the end count as whole."""

    def __init__(self, leaves: Sequence[str], level: int, run: int):
        self.leaves, self.level = leaves, level
        self.at = min(len(leaves), run * ARITY ** (level + 1))
        self.end = min(len(leaves), (run + 1) * ARITY ** (level + 1))
        self.done: list[str] = []
        self.stack: list[list] = []  # (level, digests of one open run), levels falling

    @property
    def finished(self) -> bool:
        return self.at >= self.end

    @property
    def top(self) -> int:
        """Level of the lowest node on the stack; an empty stack stands at its own level."""
        return self.stack[-1][0] if self.stack else self.level

    def held(self) -> int:
        return len(self.done) + sum(len(nodes) for _, nodes in self.stack)

    def step(self) -> None:
        """Takes one leaf and closes the runs that it completes."""
        node, level = self.leaves[self.at], 0
        self.at += 1
        while level < self.level:
            if self.stack and self.stack[-1][0] == level:
                self.stack[-1][1].append(node)
            else:
                self.stack.append([level, [node]])
            if self.at < self.end and self.at % ARITY ** (level + 1):
                return
            node, level = digest("".join(self.stack.pop()[1])), level + 1
        self.done.append(node)


class Traversal:
    """Authentication paths of the leaves of one tree in order: for each leaf the siblings of every level, run together."""

    def __init__(self, leaves: Sequence[str], levels: int):
        self.leaves, self.levels = leaves, levels
        self.runs, self.next, self.most = [], [], 0
        for level in range(levels):
            first = Treehash(leaves, level, 0)
            while not first.finished:
                first.step()
            self.runs.append(first.done)
            self.next.append(Treehash(leaves, level, 1))

    @property
    def root(self) -> str:
        """The tree's root; valid before the first path has been taken."""
        return digest("".join(self.runs[-1])) if self.levels else self.leaves[0]

    def _advance(self, to: int) -> None:
        """Puts in place the runs that leaf ``to`` needs, then lets the stacks take a leaf for each level."""
        for level in range(self.levels):
            if to % ARITY ** (level + 1) == 0:
                hash_ = self.next[level]
                while not hash_.finished:
                    hash_.step()
                self.runs[level] = hash_.done
                self.next[level] = Treehash(self.leaves, level, to // ARITY ** (level + 1) + 1)
        for _ in range(self.levels):
            open_ = [h for h in self.next if not h.finished]
            if not open_:
                break
            min(open_, key=lambda h: (h.top, h.level)).step()
        self.most = max(self.most, sum(map(len, self.runs)) + sum(h.held() for h in self.next))

    def paths(self) -> Iterator[list[str]]:
        for at in range(len(self.leaves)):
            if at:
                self._advance(at)
            path = []
            for level, run in enumerate(self.runs):
                own = at // ARITY**level % ARITY
                path.append("".join(x for k, x in enumerate(run) if k != own))
            yield path


def fold(leaf: str, at: int, path: Sequence[str]) -> str:
    """The root that follows from a leaf at place ``at`` and its siblings."""
    for siblings in path:
        own = at % ARITY * _HEX
        leaf, at = digest(siblings[:own] + leaf + siblings[own:]), at // ARITY
    return leaf


def _blocks(depth: int):
    """Rows (tree, at, size, digest) by block in order; a block at most is held. Gives every node's path within its block,
    and the block's root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ats, leaves, size, block = None, [], [], 0, ARITY**depth

        def out() -> pa.RecordBatch:
            t, n = Traversal(leaves, min(depth, height(size))), len(leaves)
            root = t.root
            columns = [pa.array([key[0]] * n, pa.int64()), pa.array(ats, pa.int64()), pa.array([size] * n, pa.int64()), pa.array(list(t.paths()), pa.list_(pa.string())), pa.array([root] + [None] * (n - 1), pa.string())]
            return pa.RecordBatch.from_arrays(columns, ["tree", "at", "size", "path", "root"])

        for batch in batches:
            for tree, at, n, leaf in zip(*(batch.column(c).to_pylist() for c in ("tree", "at", "size", "digest")), strict=True):
                if (now := (tree, at // block)) != key:
                    if leaves:
                        yield out()
                    key, ats, leaves, size = now, [], [], n
                ats.append(at)
                leaves.append(leaf)
        if leaves:
            yield out()

    return run


def authenticate(nodes: DataFrame, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """(tree, at, path) of every node (tree, at, size, digest), and (tree, root) of every tree.

    Trees have any size: each round leaves one node for each block of ``depth`` levels and ends when every tree has one. Nodes of a tree are dealt
    by block, so a large one is spread like many small ones.
    """
    rounds, roots, block = [], None, ARITY**depth
    while True:
        dealt = nodes.select("tree", "at", "size", "digest", F.floor(F.col("at") / block).alias("block")).repartition("tree", "block").sortWithinPartitions("tree", "at")
        found = scratch.table(dealt.mapInArrow(_blocks(depth), "tree long, at long, size long, path array<string>, root string"), "paths")
        rounds.append(found)
        tops = found.where("root is not null").select("tree", F.floor(F.col("at") / block).alias("at"), F.ceil(F.col("size") / block).alias("size"), F.col("root").alias("digest"))
        ended = tops.where("size = 1").select("tree", F.col("digest").alias("root"))
        roots = ended if roots is None else roots.unionByName(ended)
        nodes = tops.where("size > 1")
        if nodes.isEmpty():
            break
    paths = rounds[-1].select("tree", "at", "path")
    for below in reversed(rounds[:-1]):
        upper = paths.select(F.col("tree").alias("_tree"), F.col("at").alias("_at"), F.col("path").alias("_upper"))
        own = below.select("tree", "at", "path").join(upper, (F.col("tree") == F.col("_tree")) & (F.floor(F.col("at") / block) == F.col("_at")), "left")
        paths = own.select("tree", "at", F.concat("path", F.coalesce("_upper", F.array().cast("array<string>"))).alias("path"))
    return paths, roots


def field(value: Column) -> Column:
    """``-`` for null, else the bytes of its UTF-8 text, a colon and the text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column) -> Column:
    return F.sha2(F.concat(*map(field, (F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text))).cast("binary"), 256)


def _proved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, tree, path, upper, changed = (batch.column(c).to_pylist() for c in ("at", "tree", "path", "upper", "changed"))
        proof = [digest("".join(a) + "".join(b)) for a, b in zip(path, upper, strict=True)]
        folded = [fold(fold(x, k, a), t, b) for x, k, t, a, b in zip(changed, at, tree, path, upper, strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "leaf", "subroot")), pa.array(proof, pa.string()), pa.array(folded, pa.string())], ["doc_id", "leaf", "subroot", "proof_sha256", "folded_root"])


def manifest(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row of ``docs``.

    A row is a leaf: the hash of doc_id, source, lang, n_chars and text as texts. Leaves of a source ascend by doc_id (nulls
    first, then by leaf); of rows that are equal in all five each has its own place, and which is which doesn't matter. A null
    source is a source, the first one; sources ascend by their bytes. A tree of one leaf is that leaf. ``folded_root`` starts
    from the tampered leaf: the text without its newlines where 2 divides the crc32 of the id in decimal; rows without an id
    aren't tampered with, nor are null texts. Texts may be of any length and are read once, by the JVM; only
    digests are shuffled. Other columns are ignored. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("source", "lang")), F.col("n_chars").cast("long").alias("n_chars"), F.col("text").cast("string").alias("text"))
    newline = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.col("text").contains("\n")
    rows = docs.select("doc_id", "source", leaf(F.col("text")).alias("leaf"), F.when(newline, leaf(F.replace("text", F.lit("\n"), F.lit("")))).alias("changed"))
    rows = scratch.table(rows, "leaves")

    sources = places(rows.select("source").distinct().withColumn("all", F.lit(0)), ["all"], [F.col("source").asc_nulls_first()], "tree", "sources")
    sources = scratch.table(sources.select("source", "tree", "sources"), "sources").withColumnRenamed("source", "_source")
    placed = places(rows, ["source"], [F.col("doc_id"), F.col("leaf")], "at", "size")
    placed = placed.join(sources.drop("sources"), F.col("source").eqNullSafe(F.col("_source")))
    placed = scratch.table(placed.select("doc_id", "leaf", "changed", "tree", "at", "size"), "placed")

    paths, subroots = authenticate(placed.select("tree", "at", "size", F.col("leaf").alias("digest")), depth)
    subroots = scratch.table(subroots, "subroots")
    tops = subroots.join(sources.select("tree", "sources"), "tree").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"), F.col("sources").alias("size"), F.col("root").alias("digest"))
    upper, root = authenticate(tops, depth)
    upper = upper.select(F.col("at").alias("tree"), F.col("path").alias("upper"))

    trees = subroots.withColumnRenamed("root", "subroot").join(upper, "tree")
    out = placed.join(paths, ["tree", "at"]).join(trees, "tree")
    out = out.select("doc_id", "leaf", "subroot", "at", "tree", "path", "upper", F.coalesce("changed", "leaf").alias("changed"))
    out = out.mapInArrow(_proved, "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string")
    whole = root.select("root")  # one row
    return out.join(F.broadcast(whole)).withColumn("verified", F.col("folded_root") == F.col("root")).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
