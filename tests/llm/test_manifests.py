"""Merkle manifest, piecewise fingerprints and whitening against plain versions, with nulls, ties, repeats and odd texts."""

import base64
import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from quern.llm import merkle, piecewise, whitening

DOCS = "doc_id long, text string, source string, lang string, n_chars long, size string, root string, part int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    """A hot source, a null one, sources of one row, null and long texts, repeated rows, rows without an id, clashing columns."""
    rng, rows = random.Random(11), []
    for k in range(900):
        text = " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9))) for _ in range(rng.choice([0, 1, 5, 40, 200])))
        rows.append((k * 3, text + rng.choice(["", "\nlast\n"]), rng.choice(["hot"] * 6 + ["a", "b", None, ""]), rng.choice(["en", None]), rng.choice([len(text), None]), "x", "y", 1))
    rows += [(5, None, "one", None, None, None, None, None), rows[7], rows[7], (None, "no id\n", "hot", "en", 5, "x", "y", 2), (None, None, None, None, None, None, None, None), (7, "é" * 300_000 + "\n", "ünï", "en", 1, "x", "y", 3), (8, "", "hot", "", 0, "", "", 0)]
    return spark.createDataFrame(rows, DOCS)


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def siblings(tree, at):
    out = []
    for level in tree[:-1]:
        first = at // 3 * 3
        out.append(([x for k, x in enumerate(level[first : first + 3], first) if k != at], at - first))
        at //= 3
    return out


def plain_manifest(rows):
    show = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: sha("".join(map(show, (r.doc_id, r.source, r.lang, r.n_chars, text))))
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        by[s].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
    trees = {s: levels([leaf(r, r.text) for r in by[s]]) for s in names}
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(by[s]):
            path = siblings(trees[s], i) + siblings(top, k)
            changed = r.text
            if r.doc_id is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0:
                changed = r.text.replace("\n", "")
            node = leaf(r, changed)
            for near, own in path:
                node = sha("".join([*near[:own], node, *near[own:]]))
            proof = sha("".join(x for near, _ in path for x in near))
            out.append((r.doc_id, leaf(r, r.text), trees[s][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: [(x is not None, x if x is not None else 0) for x in r])


@pytest.mark.parametrize("depth", [6, 2])
def test_manifest_equals_plain_trees(spark, docs, depth):
    """Two levels a block: several rounds, last blocks of one leaf."""
    got = merkle.manifest(docs, depth)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    wanted = plain_manifest(docs.collect())
    assert in_order(map(tuple, got.collect())) == in_order(wanted)
    assert 0 < sum(not x[-1] for x in wanted) < len(wanted)


def test_manifest_of_one_and_none(spark, docs):
    assert merkle.manifest(docs.where("false")).count() == 0
    one = merkle.manifest(docs.where("doc_id = 5")).collect()
    assert len(one) == 1 and one[0].leaf == one[0].subroot == one[0].root and one[0].proof_sha256 == sha("") and one[0].verified


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28, 243, 244, 729])
def test_traversal(n):
    """Every path folds to the root; digests held grow with the levels, not with the leaves."""
    leaves = [sha(str(k)) for k in range(n)]
    t = merkle.Traversal(leaves, merkle.height(n))
    assert t.root == levels(leaves)[-1][0]
    assert [merkle.fold(leaves[k], k, p) for k, p in enumerate(t.paths())] == [t.root if n == 1 else levels(leaves)[-1][0]] * n
    assert t.most <= 8 * max(1, merkle.height(n))


def plain_fingerprint(data):
    roll = piecewise._ROLL.tolist()
    bytes_ = piecewise._PIECE.tolist()

    def trigger(i):
        h = sum(roll[data[i - k]] * pow(0x01000193, k, 2**32) for k in range(min(7, i + 1))) % 2**32
        h ^= h >> 15
        h = h * 0x2C1B3C6D % 2**32
        return h ^ h >> 12

    def unit(piece):
        x = sum(bytes_[c] * pow(piecewise._P, k, 2**64) for k, c in enumerate(piece)) % 2**64
        return int(piecewise.mix(np.array([x], np.uint64) ^ piecewise.mix(np.array([len(piece)], np.uint64)))[0]) >> 52

    def units(size):
        out, first = [], 0
        for i in range(len(data)):
            if values[i] % size == size - 1:
                out.append(unit(data[first : i + 1]))
                first = i + 1
        return out + [unit(data[first:])] * (first < len(data))

    values = [trigger(i) for i in range(len(data))]
    size = 3
    while size * 1024 <= len(data) or sum(v % size == size - 1 for v in values) > 63:
        size *= 2
    show = lambda x: base64.b64encode(int("".join(f"{u:012b}" for u in x + [0] * (len(x) % 2)) or "0", 2).to_bytes((len(x) + len(x) % 2) * 12 // 8, "big")).decode()[: 2 * len(x)]
    return f"{size}:{show(units(size))}:{show(units(2 * size))}"


@pytest.mark.parametrize("step", [piecewise.STEP, 64])
def test_fingerprint_equals_plain_loops(monkeypatch, step):
    monkeypatch.setattr(piecewise, "STEP", step)
    monkeypatch.setattr(piecewise, "_powers", None)
    rng = random.Random(2)
    for data in (b"", b"a", b"ab", b"aaaaaaaaaaaa" * 30, "é ü".encode() * 3, *(bytes(rng.choices(b"abcdefgh \n", k=rng.choice([5, 30, 300, 3000, 9000]))) for _ in range(12))):
        assert piecewise.fingerprint(data) == plain_fingerprint(data)
    monkeypatch.setattr(piecewise, "_powers", None)


def test_distance_and_likeness():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(0, 70))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert piecewise.distance(a, b) == len(a) + len(b) - 2 * table[-1][-1]
    assert piecewise.likeness("3::", "3::") == 1.0 and piecewise.likeness("3::", "3:ab:ab") == 0.0
    assert piecewise.likeness("3:abcd:ab", "6:ab:xy") == 1.0 and piecewise.likeness("3:abcd:ab", "24:ab:ab") == 0.0
    text = " ".join(rng.choice("abcdefgh") * rng.randrange(1, 8) for _ in range(2000))
    other = " ".join(rng.choice("abcdefgh") * rng.randrange(1, 8) for _ in range(2000))
    one = piecewise.fingerprint(text.encode())
    assert piecewise.likeness(one, piecewise.fingerprint((text[:6000] + "zz" + text[6000:]).encode())) > 0.9
    assert 0.3 < piecewise.likeness(one, piecewise.fingerprint(piecewise.edited(text, other).encode())) < 0.7
    assert piecewise.likeness(one, piecewise.fingerprint(other.encode())) < 0.15


@pytest.mark.parametrize("parts", ["1", "7", "1500"])
def test_fingerprints_equal_plain_order(spark, docs, parts):
    """One range, several, and more ranges than rows."""
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None and r.doc_id != 21]  # ties aside
    rows = sorted(rows, key=lambda r: r[0])
    wanted = {}
    for k, (doc, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        new = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        own, its, other = (piecewise.fingerprint(x.encode()) for x in (text, new, after))
        wanted[doc] = (len(text), sha(new), own, its, piecewise.likeness(own, its), piecewise.likeness(own, other))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", parts != "1500")
    try:
        if parts == "1500":
            few = docs.where("doc_id < 90 and doc_id <> 21")
            got = {r.doc_id: tuple(r)[1:] for r in piecewise.fingerprints(few).collect()}
            assert len(got) == few.count() and all(got[d] == wanted[d] for d in sorted(got)[:-1])
        else:
            got = {r.doc_id: tuple(r)[1:] for r in piecewise.fingerprints(docs.where("doc_id <> 21")).collect()}
            assert got == wanted
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", True)


def test_fingerprints_of_odd_rows(spark, docs):
    assert piecewise.fingerprints(docs.where("false")).count() == 0
    every = piecewise.fingerprints(docs)
    assert every.count() == docs.count() and every.where("fingerprint is null or edited_sha256 is null").count() == 0
    twice = every.where("doc_id = 21").collect()
    assert len(twice) == 3 and len({r.fingerprint for r in twice}) == 1 and sorted(r.near_next for r in twice)[1:] == [1.0, 1.0]
    alone = piecewise.fingerprints(docs.where("doc_id = 5")).collect()
    assert [tuple(r) for r in alone] == [(5, 0, sha(""), "3::", "3::", 1.0, 1.0)]
    one = piecewise.fingerprints(docs.where("doc_id = 7")).collect()[0]  # follows itself
    assert one.n_chars == 300_001 and one.edited_sha256 == sha("é" * 300_001)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n long, component string")


def plain_whitening(rows):
    fine = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(np.int64)) for i, v, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    x = np.array(sorted({tuple(v.tolist()) for _, v in fine}))
    n, s = len(x), x.sum(axis=0)
    e, v = np.linalg.eigh((x - s / n).T @ (x - s / n) / n)
    return fine, n, s, e[::-1], v[:, ::-1]


def test_whitening_equals_plain(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(400, 9)) * np.array([5, 3, 2, 1.5, 1, 0.5, 0.1, 0.05, 200])
    rows = [(k, v.tolist(), 0, k, "c") for k, v in enumerate(base)] + [(1000 + k, base[0].tolist(), 0, 1, "c") for k in range(300)]
    odd = [(2000, None, 0, 1, "c"), (2001, [None] * 9, 0, 1, "c"), (2002, [float("nan")] * 9, 0, 1, "c"), (2003, [float("inf")] + [0.0] * 8, 0, 1, "c"), (2004, [1.0] * 3, 0, 1, "c"), (2005, [], 0, 1, "c"), (2006, [1e30] * 9, 0, 1, "c"), (None, base[5].tolist(), None, None, None), rows[3]]
    got = whitening.whiten(vectors(spark, rows + odd)).collect()
    fine, n, s, e, v = plain_whitening([r for r in rows + odd if r[0] not in (2004, 2005, 2006)])
    assert len(got) == 4 * len(fine) and {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), []).append(r)
    signs = {}
    for i, x in fine:
        for c in range(4):
            r = by[i, c + 1][0]
            assert r.deviation == sum((n * int(a) - int(b)) ** 2 for a, b in zip(x, s, strict=True))
            want = float((x - s / n) @ v[:, c] / math.sqrt(e[c]))
            sign = signs.setdefault(c, 1 if want * r.whitened > 0 else -1)
            assert abs(sign * r.whitened - want) < 1e-8
            assert abs(r.explained - e[c] / e.sum()) < 1e-12


def test_whitening_of_degenerate_tables(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None, 0, 1, "c"), (2, [], 0, 1, "c")])).count() == 0
    same = whitening.whiten(vectors(spark, [(1, [1.0, 2.0], 0, 1, "c"), (2, [1.0, 2.0], 0, 1, "c")])).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same) == [(i, c, 1, 0, 0.0, 0.0, 0.0) for i in (1, 2) for c in (1, 2)]
    line = whitening.whiten(vectors(spark, [(1, [0.0, 0.0], 0, 1, "c"), (2, [1.0, 1.0], 0, 1, "c")])).collect()
    assert {(r.component, round(abs(r.whitened), 9), round(r.explained, 9)) for r in line} == {(1, 1.0, 1.0), (2, 0.0, 0.0)}
    wide = whitening.whiten(vectors(spark, [(1, [1e9], 0, 1, "c"), (2, [-1e9], 0, 1, "c"), (3, [0.0], 0, 1, "c")])).collect()
    assert {r.vec_id: r.deviation for r in wide} == {1: None, 2: None, 3: 0}
    assert 9 * (256 * 10**9) ** 2 > 2**63


def test_jacobi_keeps_small_eigenvalues():
    rng = np.random.default_rng(8)
    for n in (1, 2, 3, 8, 33):
        scale = np.diag(10.0 ** -np.arange(n))
        a = scale @ (np.eye(n) + 0.1 * (lambda m: m + m.T)(rng.normal(size=(n, n)) / n)) @ scale
        e, v = whitening.jacobi(a)
        assert np.allclose(v.T @ v, np.eye(n), atol=1e-13)
        assert (np.diff(e) <= 0).all()
        residual = np.abs(a @ v - v * e) / np.sqrt(np.abs(np.outer(np.diag(a), e)) + 1e-300)
        assert residual.max() < 1e-12
    assert whitening.jacobi(np.zeros((4, 4)))[0].tolist() == [0.0] * 4
