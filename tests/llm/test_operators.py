"""Operators against brute force, round trips and held-out accuracy, with nulls, blanks, ties and repeats."""

import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import bpe, decontam, graph, jaccard, langid, linetemplates, mixing, pcatiles, sharding, simple8b, tokencount, warc

DOCS = "doc_id long, text string, lang string, source string, component_id string"


def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def words(rng, n, pool=3000):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Unrelated texts, copies, near copies at many distances, a shared passage, odd texts, a null id."""
    rng, rows = random.Random(5), []
    passage = words(rng, 60)
    for k in range(120):
        rows.append(words(rng, rng.choice([1, 2, 3, 5, 12, 40, 150, 400])))
    for k in range(40):
        base = rows[rng.randrange(len(rows))].split()
        for _ in range(rng.randrange(1, 1 + max(1, len(base) // 12))):
            base[rng.randrange(len(base))] = f"x{rng.randrange(999)}"
        rows.append(" ".join(base))
    rows += [passage + " " + words(rng, 60) for _ in range(20)] + rows[:10] + [None, "", " \n\t", "A b", "a B", "É", "a<|endoftext|> b ", "x y  z\r\n", "long " * 30000]
    data = [(i, t, rng.choice(["en", None]), rng.choice(["s1", "s2", None]), "clash") for i, t in enumerate(rows)]
    return spark.createDataFrame([*data, data[3], (None, "no id here", "en", "s1", "c")], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) or (frozenset([tuple(w)]) if w else frozenset())


@pytest.mark.parametrize("n, t", [(3, "0.9"), (5, "0.8"), (1, "0.5")])
def test_jaccard_equals_all_pairs(spark, docs, n, t):
    sets = {r.doc_id: shingles(r.text, n) for r in docs.where("doc_id is not null").collect()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids, f = sorted(sets), Fraction(t)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if both and both * f.denominator >= f.numerator * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = jaccard.similar_groups(docs, n, t).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), find(r.doc_id))
    assert jaccard.similar_groups(empty(spark), n, t).count() == 0


def test_pairs_across_components_hold_every_link(spark):
    """Sets that share a passage but don't link give few pairs; those that link are all there."""
    rng = random.Random(9)
    passage = words(rng, 30)
    rows = [passage + " " + words(rng, 20) for _ in range(60)]
    for k in range(0, 20, 2):  # a near copy of some
        rows[k + 1] = rows[k] + " x"
    sets = [shingles(x, 3) for x in rows]
    linked = {(i, j) for j in range(60) for i in range(j) if 10 * len(sets[i] & sets[j]) >= 9 * len(sets[i] | sets[j])}
    texts = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    nodes = texts.select(F.col("doc_id").alias("doc"), F.col("doc_id").alias("label"))
    got = {(r.a, r.b) for r in jaccard._across(nodes, texts, 3, Fraction("0.9")).collect()}
    assert len(linked) == 10 and linked <= got and len(got) < 100
    assert jaccard._across(nodes.withColumn("label", F.lit(0)), texts, 3, Fraction("0.9")).count() == 0
    assert jaccard._across(nodes.where("false"), texts, 3, Fraction("0.9")).count() == 0


@pytest.mark.parametrize("t", ["0.9", "0.8"])
def test_no_size_misses_a_partner(t):
    """Sets at the threshold, whatever their sizes, share a signature; tight tables make every rule do its part."""
    rng, f = np.random.default_rng(3), Fraction(t)
    new = lambda n: rng.integers(1, 2**63, n).astype(np.uint64)

    def keys(x, s, scheme):
        out = {}
        for key, kind, _, need in jaccard._segments([x], np.array([0]), np.array([scheme]), s):
            for k, what in zip(key.tolist(), np.broadcast_to(kind, len(key)).tolist(), strict=True):
                out.setdefault(k, set()).add(what)
            if kind is jaccard.FULL:
                least = int(need.max(initial=1))
        return out, least

    few = dict.fromkeys(range(200), 1)
    for counts in (few, dict.fromkeys(range(200), 10**7)):
        s = jaccard.Schemes(f, 6000, counts)
        if counts is not few:  # no segments to spare: many sets need neighbourhoods or empty segments
            s.m, s.spare, s.r = np.array(s.least), 0 * s.spare, np.minimum(s.r + 8, s.least)
        for _ in range(150):
            size = int(np.exp(rng.uniform(np.log(2), np.log(4000))))
            common = new(size)
            apart = int(size * (1 / f - 1))  # the most that two sets with these in common may differ in
            one = int(rng.integers(0, apart + 1))
            x, y = np.concatenate([common, new(one)]), np.concatenate([common, new(apart - one)])
            small = min(len(x), len(y))
            scheme = int(s.band(np.array([small]))[0])
            (a, need_a), (b, need_b) = keys(x, s, scheme), keys(y, s, scheme)
            whole = sum(jaccard.FULL in a[k] and jaccard.FULL in b[k] for k in a.keys() & b.keys())
            assert all(whole >= need for need in (need_a, need_b) if need > 1)
            met = [(k, a[k] | b[k]) for k in a.keys() & b.keys()]
            assert int(s.band(np.array([max(len(x), len(y))]))[0]) <= scheme + 1
            assert any(kinds & {jaccard.FULL, jaccard.FEW} for _, kinds in met) or any(kinds == {jaccard.LESS} for _, kinds in met)


def test_parities_bound_differences():
    rng = np.random.default_rng(1)
    for _ in range(200):
        x, y = (np.unique(rng.integers(0, 2**63, rng.integers(1, 900)).astype(np.uint64)) for _ in range(2))
        y = np.unique(np.concatenate([y[: len(y) // 3], x[: rng.integers(0, len(x) + 1)]])) if len(x) else y
        assert jaccard._apart(jaccard._sketch(x), jaccard._sketch(y)) <= len(np.setxor1d(x, y))


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(500, 560)] + [(None, 3)]
    label = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    for a, b in edges:
        if a is not None:
            assert label.get(a, a) == label.get(b, b) <= min(a, b)


def test_decontamination(spark):
    rng = random.Random(3)
    items = [words(rng, 40) for _ in range(20)] + [words(rng, 8), "too short here", None]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(None, "x")], "item_id long, text string")

    def changed(text, places):
        w = text.split()
        for p in places:
            w[p] = "other"
        return " ".join(w)

    cases = [words(rng, 200) for _ in range(30)]
    cases += [words(rng, 50) + " " + items[0].upper() + " " + words(rng, 9), changed(items[1], range(0, 40, 7)), changed(items[2], range(0, 40, 4)), " ".join(items[3].split()[5:18]), " ".join(items[4].split()[5:17]), items[20], changed(items[20], [3]), "too short here", None, ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "doc_id long, text string")

    def brute(text):
        w, out = (text or "").lower().split(), set()
        for k, item in enumerate(items):
            b = (item or "").lower().split()
            if len(b) >= 5 and any(decontam.overlap(np.array(w, object), np.array(b, object), s) for s in range(-len(b), len(w) + 1)):
                out.add(k)
        return out

    got = {r.doc_id: r for r in decontam.report(docs, bench).collect()}
    assert {i: set(r.item_ids) for i, r in got.items()} == {i: brute(t) for i, t in enumerate(cases)}
    assert [got[30 + k].contaminated for k in range(10)] == [True, True, False, True, False, True, False, False, False, False]
    assert decontam.report(docs, bench.where("false")).where("contaminated").count() == 0


def test_decontamination_of_short_items(spark):
    """Items of 9 to 12 words are found with any one word changed, wherever they stand, but not with two."""
    rng = random.Random(13)
    items = {n: words(rng, n) for n in range(5, 13)}
    cases = []
    for n, item in items.items():
        for places in [(), *((p,) for p in range(n)), (0, n - 1), (n // 2, n // 2 + 1)]:
            w = item.split()
            for p in places:
                w[p] = "other"
            for a, b in ((0, 0), (30, 0), (0, 30), (30, 30)):
                cases.append((len(cases), f"{words(rng, a)} {' '.join(w)} {words(rng, b)}", [n] if len(places) <= (n >= 9) else []))
    docs = spark.createDataFrame([c[:2] for c in cases], "doc_id long, text string")
    got = {r.doc_id: r.item_ids for r in decontam.report(docs, spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()}
    assert got == {i: wanted for i, _, wanted in cases}


def test_mixing(spark, docs):
    p = mixing.plan(docs).toPandas()
    assert len(p) == docs.count()
    again = mixing.plan(docs.repartition(7)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert sorted(map(str, p[key].values.tolist())) == sorted(map(str, again[key].values.tolist()))
    assert (p.taken <= 3 * p["size"]).all() and set(p["size"]) == {len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs.collect()}
    sources = p.groupby(p.source.fillna("~")).agg(S=("size", "sum"), t=("target", "first"), k=("taken", "sum"), big=("size", "max"))
    weight, total = dict(zip(sorted(sources.index), (5, 2, 1), strict=False)), sources.S.sum()
    target, open_ = dict.fromkeys(weight, 0.0), set(weight)
    while open_:
        share = {s: (total - sum(target[x] for x in weight if x not in open_)) * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sources.S[s]}
        target |= share | {s: 3.0 * sources.S[s] for s in over}
        if not over:
            break
        open_ -= over
    for s in weight:
        assert sources.t[s] == pytest.approx(target[s])
        assert abs(sources.k[s] - target[s]) <= sources.big[s]
    assert mixing.plan(empty(spark)).count() == 0
    taken = mixing.mix(docs)
    assert taken.columns == docs.columns and taken.count() == int(p.copies.sum())


def test_pivot_keeps_totals_and_chances():
    rng = np.random.default_rng(4)
    p = rng.random(9)
    sums = np.zeros(9)
    for _ in range(4000):
        out, held = mixing.pivot(p, rng.random(9))
        assert out.sum() == pytest.approx(p.sum()) and sum(0 < x < 1 for x in out) == (held >= 0)
        sums += out
    assert np.abs(sums / 4000 - p).max() < 0.04


def test_simple8b_round_trip():
    rng = np.random.default_rng(6)
    for ids in (rng.integers(0, 50257, 70000), np.zeros(500, np.int64), rng.geometric(0.05, 3000), np.array([7]), np.zeros(0, np.int64), np.arange(66000) * 3):
        lengths = [len(ids)] if len(ids) else []
        part, seq, names, n, back = simple8b.read_file(simple8b.write_file(2, 3, [None] * len(lengths), lengths, ids) + b"\n")
        assert (part, seq, n.tolist()) == (2, 3, lengths) and (back == ids).all()


def test_token_ids_and_counts(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    rows = sorted(((r.doc_id is not None, r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0], r[1] or 0))
    ids = [t.encode(x, add_special_tokens=False).ids + [0] for _, _, x in rows]
    got = sorted(simple8b.roundtrip(docs, vocabulary()).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [r[1] for r in rows]
    assert [(r.n_tokens, r.ids_crc32) for r in got] == [(len(x), zlib.crc32(np.array(x, "<u4"))) for x in ids]
    assert [r.start for r in got] == np.cumsum([0, *map(len, ids)])[:-1].tolist()
    for chunk in (tokencount.CHUNK, 97):
        n = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tokencount.count(docs, vocabulary(), chunk=chunk).collect()}
        assert n == {i: (len(x.encode()), len(k) - 1, len(k) > 1025) for (_, i, x), k in zip(rows, ids, strict=True)}
    assert simple8b.roundtrip(empty(spark), vocabulary()).count() == tokencount.count(empty(spark), vocabulary()).count() == 0


def test_warc_round_trip(spark):
    rows = [(i, f"http://h/{i}\r\nx: y", f"<p>{i % 7}</p>" * (i % 7 + 1)) for i in range(60)] + [(61, None, None), (62, "u", ""), (None, "u", "<p>0</p>"), (None, "u", "alone"), (5, "u", "é" * 9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("refers_to", F.lit("clash"))
    got = warc.roundtrip(pages).collect()
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = max(first.get(html or "", -1), i)
    wanted = sorted((str(i), len((h or "").encode()), warc.digest((h or "").encode()), *(("response", None) if first.get(h or "", i) == i else ("revisit", first[h or ""]))) for i, _, h in rows)
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == [tuple(x) for x in wanted]
    assert warc.roundtrip(pages, at_least=10**6).where("record_type = 'revisit'").count() == 0
    assert warc.roundtrip(pages.where("false")).count() == 0


def test_near_vectors_equal_all_pairs(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(60, 24))
    v = [b + rng.normal(size=24) * s for b in base for s in (0, 0.05, 0.15, 0.3)]
    rows = [(i, [float(np.float32(x)) for x in u]) for i, u in enumerate(v)]
    rows += [(900, rows[0][1]), (901, rows[0][1]), (902, None), (903, [0.0] * 24), (904, [float("nan")] * 24), (905, [None] * 24), (906, [2 * x for x in rows[4][1]]), (907, rows[8][1][:5]), (908, [])]
    got = {r.vec_id: r for r in pcatiles.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    fine = {i: np.array(u) for i, u in rows if u and None not in u and np.isfinite(u).all() and any(u)}
    links = {i: {j for j in fine if j != i and len(fine[i]) == len(fine[j]) and fine[i] @ fine[j] / np.sqrt(fine[i] @ fine[i]) / np.sqrt(fine[j] @ fine[j]) >= 0.9} for i in fine}
    for i, _ in rows:
        reach, todo = {i}, [i]
        while todo:
            new = links.get(todo.pop(), set()) - reach
            reach |= new
            todo += new
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (len(links.get(i, ())), min(reach), min(reach) == i)


def test_line_templates(spark):
    rng = random.Random(8)
    bad = "Copyright notice number {} all rights reserved here"
    rows = [(i, "\n".join([words(rng, 9), bad.format(i), words(rng, 12)])) for i in range(12)]
    rows += [(20 + i, "only this one line is copied as a whole\n" + rows[0][1]) for i in range(4)] + [(30, None), (31, "")]
    out = {r.doc_id: r for r in linetemplates.drop_lines(spark.createDataFrame(rows, "doc_id long, text string").withColumn("line", F.lit("clash"))).collect()}
    for i in range(12):
        assert out[i].text.split("\n") == [x for k, x in enumerate(rows[i][1].split("\n")) if k != 1] and (out[i].n_lines, out[i].n_dropped) == (3, 1)
    assert out[21].n_dropped == 1 and out[30].text is None and out[31].text == ""


def test_line_templates_equal_brute_force(spark):
    rng = random.Random(9)

    def line():
        kind = rng.randrange(5)
        if kind == 0:
            return f"order {rng.randrange(99)} was sent to {rng.choice('abcdefgh')} on day {rng.randrange(9)} of the week"
        if kind == 1:
            return " ".join(rng.choice("pqr") for _ in range(rng.randrange(3, 7)))
        if kind == 2:
            return rng.choice(["", "  ", "one two three", "the\tsame line  again\r", "The same line again"])
        return words(rng, rng.randrange(3, 9), 40).replace("w", rng.choice("xy"))

    texts = ["\n".join(line() for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    texts += texts[:8] + ["\n".join(f"alone {k} has many such lines" for k in range(9)), None, "", "\n\n", "x " * 30000]
    split = lambda x: re.findall(r"[^\x20\x09-\x0D]+", x)
    mask = lambda x: tuple("<*>" if re.search("[0-9]", w) else w for w in split(x))
    met = {(t, tuple(split(x))) for x in texts if x for y in x.split("\n") if len(t := mask(y)) >= 4}
    times, seen, owners = {}, {}, {}
    for t, _ in met:
        seen[len(t), t[:3]] = seen.get((len(t), t[:3]), 0) + 1
        for k in enumerate(t):
            times[len(t), t[:3], k] = times.get((len(t), t[:3], k), 0) + 1
    shape = lambda t: (len(t), t[:3], tuple(k for k in enumerate(t) if k[1] != "<*>" and times[len(t), t[:3], k] >= 3))
    for t, own in met:
        if seen[len(t), t[:3]] >= 3 and len(shape(t)[2]) >= 0.75 * len(t):
            owners.setdefault(shape(t), set()).add(own)
    bad = {t for t, _ in met if len(owners.get(shape(t), ())) >= 3}
    want = [x if not x else "\n".join(y for y in x.split("\n") if mask(y) not in bad) for x in texts]
    out = linetemplates.drop_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert bad and [r.text for r in out] == want
    empty_ = spark.createDataFrame([], "doc_id long, text string")
    assert linetemplates.drop_lines(empty_).count() == 0


def test_short_lines_recur(spark, tmp_path):
    """The registered query drops lines of any number of tokens; those without a constant or in too few texts stay."""
    from quern.llm import queries

    rng = random.Random(10)
    rows = [(i, "\n".join([words(rng, 9), "All rights reserved.", "Menu", "And  so", str(i), "", words(rng, 9)] + ["Rare one"] * (i < 2))) for i in range(6)] + [(7, "Menu"), (8, "Menu\n\nall"), (9, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op5_line_templates(spark, str(tmp_path)).collect()}
    assert [(r.n_lines, r.n_dropped) for _, r in sorted(got.items())] == [(8, 3)] * 2 + [(7, 3)] * 4 + [(1, 1), (3, 1), (0, 0)]
    assert got[7].kept_chars == 0 and got[8].kept_chars == len("\nall")


def test_lines_with_many_fields_recur(spark):
    """Lines that recur but for their fields go, alone in a leaf or not; lines of fields only and rare ones stay."""
    rng = random.Random(11)
    head = lambda i: [f"Page {i} of 10", f"Posted on {i} May {2000 + i}", f"Tel 020 {i}946 0000", f"{i} {i} {i} 7"]
    rows = [(i, "\n".join([*head(i), words(rng, 9)])) for i in range(5)]
    rows += [(10, "Tel 020 7946 0000\nTel 020 7946 home\nPage 3 of chapter"), (11, "Fax 020 7946 0000"), (12, "Fax 020 7946 0001")]
    out = {r.doc_id: r for r in linetemplates.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(5):
        assert (out[i].text.split("\n"), out[i].n_dropped) == (rows[i][1].split("\n")[3:], 3)
    assert [out[k].n_dropped for k in (10, 11, 12)] == [1, 0, 0]


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = docs.join(langid.predictions(docs), "doc_id").where("held_out").select((F.col("lang") == F.col("lang_pred")).cast("int").alias("ok"), "score")
    r = got.agg(F.avg("ok"), F.min("score"), F.max("score")).first()
    assert r[0] > 0.98 and 0 <= r[1] <= r[2] <= 1
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (4, "the and")], "doc_id long, text string")
    model = langid.Model([("en", "the", 5), ("fr", "les", 5)])
    assert [x.lang_pred for x in langid.identify(odd, model).orderBy("doc_id").collect()] == ["und", "und", "und", "en"]
    assert [x.lang_pred for x in langid.identify(odd, langid.Model([])).collect()] == ["und"] * 4


def test_every_language_is_learned(spark):
    """Neither a language with very many words nor many languages push another one out, nor words seen once."""

    def word(k, alphabet):
        return word(k // len(alphabet), alphabet) + alphabet[k % len(alphabet)] if k else ""

    ids = (i for i in range(10**6) if zlib.crc32(str(i).encode()) % 3 != 1)
    large = " ".join(word(k, "abcdefghijklm") for k in range(10**5, 165_000))
    small, once = "nopq rsnu tvwn onsr " * 2, " ".join(word(k, "αβγδε") for k in range(700, 720))
    rows = [(next(ids), large, "aa") for _ in range(3)] + [(next(ids), small, "zz"), (next(ids), once, "yy")]
    rows += [(next(ids), f"{chr(0x4E00 + k)}{chr(0x4E00 + k)} " * 2, f"l{k:03}") for k in range(250)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = [(r.lang, r.lang_pred) for r in docs.join(langid.predictions(docs), "doc_id").collect()]
    assert len(got) == len(rows) and all(a == b for a, b in got)
    model = langid.train(docs)
    assert len(model.langs) == 253 and len(model.known) == 65_000 + 4 + 250


def test_scores_equal_plain_sums():
    rng = random.Random(12)
    counts = [(lang, "".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))), rng.randrange(1, 9)) for lang in "xyz" for _ in range(30)]
    model, tables = langid.Model(counts), [{} for _ in range(6)]
    for lang, w, n in counts:
        for size in range(6):
            for g in langid.grams(w, size) if size else [w]:
                tables[size].setdefault(g, dict.fromkeys("xyz", 0))[lang] += n
    log = [{g: [np.log((row[x] + 0.5) / sum(r[x] + 0.5 for r in t.values())) for x in "xyz"] for g, row in t.items()} for t in tables]

    def score(w):
        if w in log[0]:
            return np.array(log[0][w])
        for n in range(5, 0, -1):
            if found := [log[n][g] for g in langid.grams(w, n) if g in log[n]]:
                return np.mean(found, axis=0)
        return np.zeros(3)

    found = ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 9))) for _ in range(200)]
    known = sum(bool(set(w) & set("abc")) for w in found)
    assert langid.Scorer(model).total(" ".join(found)) == pytest.approx([*sum(map(score, found)), known], rel=1e-4)
    assert langid.Scorer(model, 7).total(" ".join(found)) == pytest.approx([*sum(map(score, found)), known], rel=1e-4)


def test_lookup_table(spark, docs):
    a, b = sharding.lookup(tuple("abcdefgh")), sharding.lookup(tuple("abcdefg"))
    assert np.ptp(np.bincount(a)) <= 1 and len(a) == 65537
    assert (a[a < 7] == b[a < 7]).mean() > 0.85
    got = sharding.place(docs, 8).collect()
    assert len(got) == docs.count() and all(r.shard == sharding.lookup(tuple(f"shard-{k:05d}" for k in range(8)))[r.slot] for r in got)


def test_parities_never_exceed_what_sets_differ_in():
    import numpy as np

    from quern.llm import jaccard

    rng = np.random.default_rng(5)
    for n, other in ((3, 1), (100, 4), (100, 60), (2000, 90)):
        every = np.unique(rng.integers(0, 2**63, n + other, dtype=np.uint64))
        x, y = every[: len(every) - other], every[other // 2 :]
        apart = int(np.bitwise_count(jaccard._parities(x) ^ jaccard._parities(y)).sum())
        assert apart <= len(np.setxor1d(x, y)) and (apart > 10 or other < 60)
    assert len(jaccard._parities(x)) == len(jaccard._ODD)
