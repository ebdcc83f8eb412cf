"""Independent brute force, odd inputs, clashing names, ties and repeats."""

import random
import re
import struct
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import bpe, decontam, jaccard, langid, linetemplates, mixing, pcatiles, sharding, tokencount, warc


def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def words(rng, n, pool=3000):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


def odd_texts(rng, n):
    some = ["a", "b", " ", "  ", "\n", "\n\n", "\t", "'s", "'re", "'r", "'", "''", "ll", "1", "23", "!", "...", "é", "日本", " x", "the", " the", "ing", "<|endoftext|>", "<|endof", "\r\n", "\x1c", "😀", "aaaa", "----", "\x00", "²", "\u00a0", "\u3000"]
    out = ["".join(rng.choice(some) for _ in range(rng.randrange(40))) for _ in range(n)]
    out += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x80, 0x3000), rng.randrange(0xE000, 0x20000)])) for _ in range(rng.randrange(60))) for _ in range(n // 4)]
    return [*out, "", "a" * 3000, " " * 2000, "ab" * 2000 + " x", "=-" * 900, "a b\n\nc d", "x\n", "  indented\n    more\n"]


def test_transducer_equals_the_library():
    from tokenizers import Tokenizer

    library, texts = Tokenizer.from_file(vocabulary()), odd_texts(random.Random(1), 3000)
    ids = [library.encode(x, add_special_tokens=False).ids for x in texts]
    column = pa.array([*texts, None])
    assert bpe.compiled(vocabulary()).counts(column).tolist() == [*map(len, ids), 0]
    assert bpe.Transducer(vocabulary(), transitions=2000, states=500).counts(column).tolist() == [*map(len, ids), 0]
    for memory in (10**6, 300):
        known = bpe.Words(vocabulary(), memory)
        for _ in range(2):
            flat, n = known.encode(column)
            assert n.tolist() == [*map(len, ids), 0] and flat.tolist() == [i for x in ids for i in x]


def test_chunk_maps_are_associative():
    """However a text is cut and its maps are grouped, the count is that of the whole text."""
    rng = random.Random(2)
    t = bpe.compiled(vocabulary())
    for text in [x * 3 for x in odd_texts(rng, 150)]:
        at = sorted({0, len(text), *(rng.randrange(len(text) + 1) for _ in range(rng.randrange(9)))})
        maps = tokencount.chunk_maps(t, [text[a:b] for a, b in zip(at, at[1:], strict=False)])
        want = int(t.counts(pa.array([text]))[0])
        while len(maps) > 1:
            assert tokencount.total(t, maps) == want
            k = rng.randrange(len(maps) - 1)
            maps[k : k + 2] = [tokencount.compose(t, maps[k : k + 2])]
        assert not maps or tokencount.total(t, maps) == want


def test_counting_rounds(spark):
    texts = [x * 9 for x in odd_texts(random.Random(3), 40)]
    docs = spark.createDataFrame([(k, x) for k, x in enumerate(texts)] + [(None, "no id"), (0, None)], "doc_id long, text string")
    whole = sorted(map(str, tokencount.count(docs, vocabulary()).collect()))
    assert sorted(map(str, tokencount.count(docs, vocabulary(), chunk=37, fan_in=3).collect())) == whole


def test_archives_always_have_a_dictionary(spark):
    rng = random.Random(4)
    for records in ([b"x"], [b"one record"] * 3, [words(rng, 20_000).encode() for _ in range(40)], [words(rng, 9).encode() for _ in range(900)]):
        data = warc.archive([warc.record(k, "u", r, None) for k, r in enumerate(records)])
        magic, n = struct.unpack_from("<II", data)
        assert magic == warc.DICTIONARY and n > 0
        assert [block.partition(b"\r\n\r\n")[2] for _, block in warc.records(data)] == records


def test_archive_of_ties_and_repeats(spark):
    """Of rows that share the largest id of a payload one is the response."""
    rows = [(7, "u", "same"), (7, "v", "same"), (7, "v", "same"), (7, None, "same"), (3, "u", "same"), (None, "u", "same"), (None, "x", "alone"), (None, "x", "alone"), (9, None, "long " * 300_000), (8, "u", "")]
    got = warc.roundtrip(spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"first": F.lit(1), "n": F.lit(2), "k": F.lit(3), "may": F.lit(True)})).collect()
    assert sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in got) == sorted([("7", 4, "response", None), *[("7", 4, "revisit", 7)] * 3, ("3", 4, "revisit", 7), ("None", 4, "revisit", 7), *[("None", 5, "response", None)] * 2, ("9", 1_500_000, "response", None), ("8", 0, "response", None)])


def test_mixing_equal_rows_and_names(spark):
    """Equal rows are taken together as often as their share says, not all or none; other columns stay as they are."""
    rows = [(1, "five words are in here", "b", 0, 1.5)] * 1000 + [(k, words(random.Random(k), 9), "a", k, None) for k in range(2, 300)] + [(None, None, None, 1, 2.0)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, uid double").withColumns({"mix_copies": F.lit(1), "mix_copy": F.lit(2), "_mix_x": F.create_map(F.lit("a"), F.lit(1)), "a b": F.struct(F.lit(1).alias("c d"))})
    p = mixing.plan(docs).toPandas()
    assert len(p) == len(rows)
    same = p[p.doc_id == 1]
    assert abs(same.taken.sum() - same.target.iloc[0]) <= 5 and same.copies.max() - same.copies.min() <= 1
    for _, s in p.groupby("source"):
        assert abs(s.taken.sum() - s.target.iloc[0]) <= s["size"].max()
        ratio = s.target.iloc[0] / s.source_size.iloc[0]
        assert set(s.copies) <= {int(ratio), int(ratio) + 1}
    out = mixing.mix(docs)
    assert out.columns == docs.columns and out.count() == p.copies.sum()
    assert sorted(map(str, out.select("doc_id", "size", "uid", "`a b`").distinct().collect()))[:3] == sorted(map(str, docs.join(out.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "size", "uid", "`a b`").distinct().collect()))[:3]
    assert mixing.mix(docs.where("false")).count() == 0


def test_chances_of_mixing(spark):
    """Over seeds, every unit of a group is taken once more with its own chance."""
    units = spark.createDataFrame([("s", k, 0, 10 + k, p) for k, p in enumerate([0.2, 0.5, 0.9, 0.4, 0.75])], "source string, _mix_a long, _mix_b long, size long, p double")
    sums = np.zeros(5)
    for seed in range(60):
        for r in mixing.decide(units, seed).collect():
            sums[r._mix_a] += r.extra
    assert np.abs(sums / 60 - [0.2, 0.5, 0.9, 0.4, 0.75]).max() < 0.25


def test_line_templates_keep_other_columns(spark):
    rows = [(k % 5 if k else None, f"all of these lines recur here\nown {'x' * k} y z w", k) for k in range(9)] + [(1, None, 1), (1, "", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone int").withColumns({"row": F.lit("r"), "at": F.lit(1), "line": F.lit("l"), "a b": F.lit(2)})
    out = linetemplates.drop_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert sorted((str(r.doc_id), str(r.text), r.gone, r.row, r.at, r.line, r["a b"]) for r in out.collect()) == sorted((str(i), str(t and t.split("\n")[-1]), k, "r", 1, "l", 2) for i, t, k in rows)
    assert linetemplates.drop_lines(docs.where("false")).count() == 0


def test_vectors_over_several_tiles(spark):
    """More vectors than a tile holds, in clusters and spread, with null and repeated ids and infinities."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(300, 12))
    v = np.concatenate([np.repeat(centres, 30, axis=0) + 0.12 * rng.normal(size=(9000, 12)), rng.normal(size=(500, 12)), np.repeat(centres[:1], 400, axis=0)]).astype(np.float32)
    rows = [(k, x.tolist()) for k, x in enumerate(v)] + [(None, v[0].tolist()), (3, v[500].tolist()), (99_001, [float("inf")] * 12), (99_002, [0.0] * 12)]
    got = pcatiles.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)).collect()
    every = np.array([x for _, x in rows[:-2]], float)
    unit = every / np.linalg.norm(every, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    label = np.arange(len(every))
    while True:
        new = np.minimum(label, np.where(near, label[None, :], len(label)).min(axis=1))
        if (new == label).all():
            break
        label = new
    ids = [i for i, _ in rows[:-2]]
    least = {c: min(i for i, x in zip(ids, label, strict=True) if x == c and i is not None) for c in set(label.tolist())}
    want = [(str(i), int(n), None if i is None else least[c], i is not None and least[c] == i) for i, n, c in zip(ids, near.sum(axis=1), label.tolist(), strict=True)] + [("99001", 0, 99_001, True), ("99002", 0, 99_002, True)]
    key = lambda r: tuple(map(str, r))
    assert sorted(((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in got), key=key) == sorted(want, key=key)


def test_shards_equal_plain_rules(spark):
    """The table filled by the rule as it's stated, slots by the XXH64 of the id."""
    import hashlib

    names, size = [f"shard-{k:05d}" for k in range(7)], 65_537
    orders = []
    for n in names:
        a, b = (int.from_bytes(hashlib.sha256(n.encode()).digest()[i : i + 8], "big") for i in (0, 8))
        orders.append(iter([(a + k * (b % (size - 1) + 1)) % size for k in range(size)]))
    table = {}
    while len(table) < size:
        for shard, order in enumerate(orders):
            if len(table) < size:
                table[next(x for x in order if x not in table)] = shard
    rows = [(k, "s") for k in (*range(200), -5, 2**62, 7, 7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string").withColumns({"slot": F.lit("x"), "cell": F.lit(1)})
    got = sharding.place(docs, 7).collect()
    signed = lambda h: h - 2**64 if h >= 2**63 else h
    slot = {k: (42 if k is None else signed(xxhash.xxh64(struct.pack("<q", k), seed=42).intdigest())) % size for k, _ in rows}
    assert sorted((str(r.doc_id), r.slot, r.shard) for r in got) == sorted((str(k), slot[k], table[slot[k]]) for k, _ in rows)
    assert sharding.place(docs.where("false"), 7).count() == 0


def leaking(text, items):
    """Items that a text holds, by the rule as it's stated: 13 words with two others at most, items of 9 to 12 words with one,
    of 5 to 8 with none."""
    split = lambda x: re.findall(r"[^\x20\x09-\x0D]+", (x or "").lower())
    w, out = split(text), set()
    for k, item in items:
        b = split(item)
        n, most = (13, 2) if len(b) >= 13 else (len(b), int(len(b) >= 9))
        if len(b) >= 5:
            for i in range(len(b) - n + 1):
                if any(sum(x != y for x, y in zip(b[i : i + n], w[j : j + n], strict=True)) <= most for j in range(len(w) - n + 1)):
                    out.add(k)
                    break
    return out


def test_decontamination_by_the_rule(spark):
    rng = random.Random(6)
    items = [(k, words(rng, n, 60)) for k, n in enumerate([5, 6, 8, 9, 10, 12, 13, 14, 20, 40, 4])]
    rows = []
    for k in range(160):
        b = rng.choice(items)[1].split()
        a = rng.randrange(len(b))
        part = b[a : a + rng.randrange(4, 22)] if rng.random() < 0.5 else list(b)
        for _ in range(rng.randrange(4)):
            part[rng.randrange(len(part))] = "other"
        rows.append((k if k % 10 else None, f"{words(rng, rng.randrange(30), 60)} {' '.join(part)} {words(rng, rng.randrange(30), 60)}", "x", k))
    rows += [(3, items[9][1], "x", 1000), (500, "z " * 200_000 + items[8][1], "x", 1001), (501, None, "x", 1002), (502, "", "x", 1003)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, around string, item_id int").withColumns({"start": F.lit(1), "_n": F.lit(2)})
    bench = spark.createDataFrame(items, "item_id long, text string")
    by_id = {}
    for i, t, _, k in rows:
        by_id.setdefault(i if i is not None else ("none", t), set()).update(leaking(t, items))
    want = sorted((str(i), sorted(by_id[i if i is not None else ("none", t)])) for i, t, _, _ in rows)
    assert sorted((str(r.doc_id), r.item_ids) for r in decontam.report(docs, bench).collect()) == want
    left = decontam.decontaminate(docs, bench)
    assert left.columns == docs.columns
    assert sorted(r.item_id for r in left.collect()) == sorted(k for i, t, _, k in rows if not by_id[i if i is not None else ("none", t)])
    assert decontam.report(docs.where("false"), bench).count() == decontam.decontaminate(docs.where("false"), bench).count() == 0


def test_language_by_plain_scores(spark):
    """Predictions of whole texts from sums of plain scores; ties, repeats, long texts, odd columns, an empty table."""
    model = langid.Model([("en", "the", 5), ("en", "cat", 3), ("fr", "les", 5), ("fr", "chat", 4), ("de", "katze", 2)])

    def plain(text):
        found = np.zeros(3)
        n = 0
        for w in langid.tokens(text or ""):
            entries, _ = model.places([w])
            if len(entries):
                n += 1
                found += model.sums(entries, np.full(len(entries), 1 / len(entries)), np.zeros(len(entries), int), 1)[0]
        letters = any(map(str.isalpha, text or ""))  # a lettered text has a learned language, known or not
        return (model.langs[int(np.argmax(found))], 1 / np.exp(found - found.max()).sum()) if n or letters else ("und", 0.0)

    texts = ["the cat", "les chats", "katzen", "cats les", "кот", None, "", "7 !", "the cat", "chat " * 50_000 + "the", "zzz"]
    docs = spark.createDataFrame([(k, t, "old", {"c d": 1}) for k, t in enumerate(texts)], "doc_id long, text string, lang_pred string, `a b` struct<`c d`: int>").withColumns({"_0": F.lit(1)})
    out = langid.identify(docs, model)
    assert out.columns == ["doc_id", "text", "a b", "_0", "lang_pred", "score"]
    for r in out.collect():
        lang, score = plain(r.text)
        assert r.lang_pred == lang and r.score == pytest.approx(score, rel=1e-3, abs=1e-6) and r["a b"]["c d"] == 1
    assert langid.identify(docs.where("false"), model).count() == 0
    assert langid.predictions(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_near_duplicates_of_odd_rows(spark):
    """Repeated ids, hot copies and hot passages in many partitions; the stage keeps other columns."""
    rng = random.Random(7)
    passage, rows = words(rng, 60), []
    for k in range(400):
        rows.append((k, passage + " " + words(rng, 30)) if k % 4 else (k, "the very same text " * 9))
    rows += [(k + 1000, x + " y" if x.startswith("w") else x) for k, x in rows[:40]] + [(5, rows[9][1]), (None, rows[1][1]), (2000, None), (2001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(9).withColumns({"component_id": F.lit(1), "key": F.lit(2), "first": F.lit(3)})
    split = lambda x: re.findall(r"[^\x20\x09-\x0D]+", (x or "").lower())
    sets = [(i, frozenset(tuple(w[a : a + 5]) for a in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])) for i, w in ((i, split(t)) for i, t in rows)]
    root = {i: i for i, _ in rows if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if None not in (i, j) and x and y and 10 * len(x & y) >= 8 * len(x | y):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    got = jaccard.similar_groups(docs, 5, "0.8").collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == sorted((str(i), "None" if i is None else str(find(i))) for i, _ in rows)
    left = corpus_pipeline.near_duplicates(spark, docs, "")
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(i) for i, _ in rows if i is None or find(i) == i)


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Stage by stage against plain rules, with nulls, repeats, clashing names; an empty table stays empty."""
    rng = random.Random(8)
    item = words(rng, 30)
    rows = [(k, words(rng, 40), rng.choice(["en", None]), rng.choice(["s", "t", None])) for k in range(80)]
    rows += [(100 + k, t, lang, s) for k, (_, t, lang, s) in enumerate(rows[:20])]
    rows += [(200, f"{words(rng, 9)} {item}", "en", "s"), (None, f"{words(rng, 9)} {item} x", "en", "s"), (None, words(rng, 30), "en", "t"), (201, None, "en", "s"), (202, "", None, "s"), (203, "12 34 !", "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({c: F.lit(1) for c in ("n_chars", "score", "lang_pred", "size", "uid", "gone", "row", "slot")})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages, at, left = dict(corpus_pipeline.STAGES), str(tmp_path), docs
    keep = {
        "language ID": lambda r: bool(re.search(r"[^\W\d_]", r[1] or "")),
        "near duplicates": lambda r: r[0] is None or not 100 <= r[0] < 120,
        "decontamination": lambda r: item not in (r[1] or ""),
    }
    for name, rule in keep.items():
        left = stages[name](spark, left, at)
        rows = [r for r in rows if rule(r)]
        assert left.columns == docs.columns
        assert sorted((str(r.doc_id), r.text) for r in left.collect()) == sorted((str(r[0]), r[1]) for r in rows)
    mixed = stages["source mix"](spark, left, at)
    assert mixed.columns == docs.columns
    taken = {}
    for r in mixed.collect():
        taken[r.source] = taken.get(r.source, 0) + len(r.text.split())
    for r in mixing.plan(left).select("source", "target").distinct().collect():
        assert abs(taken.get(r.source, 0) - r.target) <= 60
    out = stages["sharding"](spark, mixed, at)
    assert out.count() == mixed.count() and set(out.columns) == {*docs.columns, "shard"}
    nothing = docs.where("false")
    for stage in stages.values():
        nothing = stage(spark, nothing, at)
    assert nothing.count() == 0
    assert corpus_pipeline.run(spark, at).count() == out.count()


def test_unseen_scripts_and_bounded_samples(spark):
    """A text in letters of which nothing is known has a learned language; rows without an id don't widen the sample."""
    model = langid.Model([("en", "the", 5), ("de", "der", 5)])
    docs = spark.createDataFrame([(1, "\u4e2d\u6587"), (2, "\u0e44\u0e17\u0e22 7"), (3, "the"), (4, "7"), (5, None)], "doc_id long, text string")
    got = [(r.lang_pred, r.score, r.k) for r in langid.identify(docs, model, ("lang_pred", "score", "k")).orderBy("doc_id").collect()]
    assert got[0] == got[1] == ("de", 0.5, 0) and got[2][0] == "en" and got[2][2] == 1 and got[3:] == [("und", 0.0, 0)] * 2
    rows = [(None, f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}w{chr(97 + k // 676)}", "en") for k in range(3000)]
    rows += [(None, "same", "xx")] * 500 + [(1, "one", "one")]
    learned = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), docs_per_language=40)
    assert learned.langs == ["en", "one", "xx"]
    assert len(learned.grams[3]) <= 3 * 40 * 6 and learned.known == {"same": 0}
    few = langid.train(spark.createDataFrame([(0, "aa bb cc aa bb aa", "x"), (1, "dd dd", "y")], "doc_id long, text string, lang string"), words_per_language=2, grams_per_language=1)
    assert sorted(few.known) == ["aa", "bb", "dd"] and few.langs == ["x", "y"]


CLASHING = ["_doc", "_tag", "_mix_a", "_mix_b", "_mix_k", "_mix_total", "_gone", "_row", "_row2", "_line", "_at", "_language", "_score", "_known", "c0", "c1", "hash", "item_id", "text_b"]


def test_columns_with_private_names_stay(spark):
    rng = random.Random(2)
    item = words(rng, 30)
    rows = [(k, words(rng, 30) + "\nthe very same long line here", "en", rng.choice("st")) for k in range(9)] + [(50, item, "en", "s"), (None, None, None, None)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs = plain.withColumns({c: F.lit(k) for k, c in enumerate(CLASHING)})
    values = tuple(range(len(CLASHING)))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    for out in (decontam.decontaminate(docs, bench), mixing.mix(docs), corpus_pipeline.language(spark, docs, "")):
        assert out.columns == docs.columns and {tuple(r)[4:] for r in out.collect()} == {values}
    lines = linetemplates.drop_lines(docs)
    assert lines.columns == [*docs.columns, "n_lines", "n_dropped"]
    got = lines.collect()
    assert len(got) == 11 and {tuple(r)[4:-2] for r in got} == {values}
    assert {r.doc_id: (r.n_lines, r.n_dropped) for r in got if r.doc_id in (3, 50, None)} == {3: (2, 1), 50: (1, 0), None: (0, 0)}


def test_very_many_lines_of_a_text(spark):
    """200,000 recurring lines in one text go in time that grows with the lines."""
    lines = [f"recurring line alpha beta w{k % 5}x" for k in range(200_000)]
    own = ["this line stands here alone today", "", "so does this other line here"]
    rows = [(0, "\n".join([own[0], *lines, own[1], own[2]]))] + [(k, "\n".join([*lines[:5], " ".join(f"{'abcdefg'[k]}{j}".replace(str(j), "xyzuvw"[j]) for j in range(6))])) for k in range(1, 5)]
    out = {r.doc_id: r for r in linetemplates.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0].text == "\n".join(own) and (out[0].n_lines, out[0].n_dropped) == (200_003, 200_000)
    assert all(out[k].n_dropped == 5 for k in range(1, 5))


@pytest.mark.parametrize("shortest, loose", [(1, 3), (3, 6), (5, 9)])
def test_short_items_by_the_options(spark, shortest, loose):
    """Items of 1 to 12 words: whole from ``shortest`` words on, but for one word from ``loose`` words on."""
    rng = random.Random(21)
    items = {n: words(rng, n, 10**6) for n in range(1, 13)}
    cases = []
    for n, item in items.items():
        for places in [(), *((p,) for p in range(n)), (0, n - 1)]:
            w = item.split()
            for p in places:
                w[p] = "other"
            cases.append((len(cases), f"{words(rng, 20, 10**6)} {' '.join(w)} {words(rng, 20, 10**6)}", [n] if n >= shortest and len(set(places)) <= (n >= loose) else []))
    docs = spark.createDataFrame([c[:2] for c in cases], "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {r.doc_id: r.item_ids for r in decontam.report(docs, bench, shortest=shortest, one_different=loose).collect()}
    assert got == {i: wanted for i, _, wanted in cases}
