"""The numbered operators against brute force, on small fixtures with nulls, ties, repeats and clashing columns."""

import hashlib
import os
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewheel.llm import boosting, bpe, fingerprints, line_templates, ngram_join, packing, permutation_index, pii, quality, queries, sharding, warc
from tidewheel.llm.components import connected_components

FOLDER = "/root/testdata/sf0.001"
WORDS = "the of and to in that is was for on are with as by at from or an be this which not have had but".split()


def corpus():
    rng = np.random.default_rng(5)
    base = [" ".join(rng.choice(WORDS, 40)) for _ in range(12)]
    texts = [None, "", "   \n\t ", "one", "one", "One", "two words", base[0], base[0].upper(), base[0]]
    for b in base:
        for _ in range(4):
            words = b.split()
            words[rng.integers(40)] = "changed"
            texts.append(" ".join(words))
    texts += [b + "\n" + "Copyright 2021 by the house of words\nlast " + str(i) for i, b in enumerate(base[:5])]
    texts.append(" ".join(rng.choice(WORDS, 3000)))
    return [(i * 3, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


def frame(spark, rows):
    """With columns whose names clash with those that the operators make."""
    return spark.createDataFrame([(i, t, "x", 1, 2.0) for i, t in rows], "doc_id long, text string, node string, n int, score double").repartition(3)


def shingles(text, n):
    words = text.encode().lower().split() if text else []
    return frozenset(zip(*(words[i:] for i in range(n)))) if len(words) >= n else frozenset([tuple(words)] if words else [])


def brute_components(rows, n, least):
    sets = {i: shingles(t, n) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) * least.denominator >= least.numerator * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("n,least,weight,frequent", [(3, Fraction(9, 10), 1 << 20, 8), (5, Fraction(4, 5), 300, 2), (2, Fraction(1, 2), 100, 3)])
def test_ngram_join(spark, rows, monkeypatch, n, least, weight, frequent):
    monkeypatch.setattr(ngram_join, "TASK_WEIGHT", weight)
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similarity_join(frame(spark, rows), n, least).collect()}
    assert got == brute_components(rows, n, least)


def test_ngram_join_of_nothing(spark):
    assert ngram_join.similarity_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = ngram_join.similarity_join(spark.createDataFrame([(None, "a b c"), (1, None)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_shingles) for r in rows) == [(0, 1), (1, 0)]


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (7, 7), (9, 8), (8, 10), (None, 4)] + [(100 + i, 101 + i) for i in range(40)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert {got[i] for i in (1, 2, 3)} == {1} and {got[i] for i in (8, 9, 10)} == {8} and {got[i] for i in range(100, 141)} == {100}


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            fine = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                    "card": 16 <= len(digits) <= 19 and pii.luhn(digits or "1"), "phone": 8 <= len(digits) <= 15}[kind]
            if fine:
                out.append((kind, m.start(), m.end()))
    return out


PERSONAL = ["a@b.com_x@y.org, me@host me@x.y.z.", "1.2.3.4.5.6.7.8 and 300.1.1.1 0001.02.3.255", "pay 4111 1111 1111 1111 or 4111-1111-1111-1112",
            "call +1 (017) 555-7713 now +12 +1 2 3", "é😀 +49 170 1234567 x@y.de", "@@a@b.c@d.e", "12 4111111111111111", "", "no data", "+" * 50, "9" * 400]


@pytest.mark.parametrize("text", PERSONAL)
def test_base_spans(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_find_and_redact(spark):
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate([*PERSONAL, None, PERSONAL[0]])], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in pii.find_pii(docs).collect()}
    for i, t in enumerate([*PERSONAL, None, PERSONAL[0]]):
        base = plain_spans(t or "")
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
        assert set(f"{k}:{s}:{e}" for k, s, e in base) <= set(got[i].spans.split(","))
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(Counter(k for k, _, _ in base)[k] for k in BASE)
    clean = {r.doc_id: r.text for r in pii.redacted(docs).collect()}
    assert clean[0] == "<EMAIL><EMAIL>, me@host <EMAIL>." and clean[11] is None and clean[8] == "no data"


def test_judged_spans_are_added_without_overlap():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] + x[:, 1] > 0).astype(float)
    model = boosting.calibrated(boosting.fit(x[::2], y[::2]), x[1::2], y[1::2])
    assert ((model.probability(x[1::2]) > 0.5) == y[1::2]).mean() > 0.9
    always = pii.Judge(boosting.Boosted(5.0, ()), 0.5)
    text = "card 12 4111111111111111 end"
    base = pii.base_spans(text)
    added = pii.added_spans(text, base, {"card": always})
    spans = sorted((s, e) for _, s, e in base + added)
    assert added and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_judges_add_what_the_base_rules_miss(spark):
    rng = np.random.default_rng(8)
    n = lambda k: "".join(map(str, rng.integers(1, 10, k)))
    w = lambda: " ".join(rng.choice(WORDS, 6))
    texts = [f"{w()} and so. {w()} call +{n(2)} {n(3)} {n(7)} or write to {rng.choice(WORDS)}.{n(2)}@host{n(1)}.example.org {w()} order {n(12)} of {n(9)} {w()}"
             for _ in range(400)]
    missed = ["49 170 1234567", "jane.12 (at) host3 (dot) example (dot) org"]
    texts.append(f"{w()} call {missed[0]} or write to {missed[1]} {w()} order {n(12)} {w()}")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known = pii.judges(pii.sample(docs))
    assert pii.base_spans(texts[-1]) == []
    assert {texts[-1][s:e] for _, s, e in pii.added_spans(texts[-1], [], known)} == set(missed)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")
def test_quality_on_held_out_labels(spark):
    folder = FOLDER.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    extra = spark.createDataFrame([(-1, None), (-2, "")], "doc_id long, text string")
    scored = quality.quality_scores(docs.select("doc_id", "text").union(extra), labels)
    rows = scored.join(labels, "doc_id", "left").collect()
    held = [(r.score, r.quality, r.predicted) for r in rows if r.held_out and r.quality is not None]
    good, bad = ([s for s, q, _ in held if q == v] for v in (1, 0))
    assert np.mean([[g > b for b in bad] for g in good]) > 0.95
    assert all(p == (s >= 0.3) for s, _, p in held) and all(0 <= r.score <= 1 for r in rows)
    assert [r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows].count(False) == 0


def test_quality_without_labels(spark, rows):
    got = quality.quality_scores(frame(spark, rows), spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert {r.score for r in got} == {0.5}


def test_packing(spark, rows):
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(tokenizer)
    rows = rows + [(8000, "<|endoftext|>"), (8001, "a <|endoftext|> b"), (8002, "x<|endoftext|><|endoftext|> y <|endoftext"), (8003, " <|endoftext|> ")]
    assert plain.encode("a <|endoftext|> b", add_special_tokens=False).ids.count(50256) == 1
    rows = rows + [(9000 + i, "<|endoftext|> a  b\n c" + " x" * i) for i in range(40)]
    got = packing.packed(frame(spark, rows), tokenizer).collect()
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
    total = 0
    for i, text in rows:
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.start for r in pieces] == np.cumsum([0, *(r.length for r in pieces)])[:-1].tolist() and sum(r.length for r in pieces) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start: r.start + r.length].tobytes()) for r in pieces)
        assert len(ids) > 2048 or len(pieces) == 1
        total += len(ids)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in places.values():
        ends = np.cumsum([n for _, n in sorted(spans)])
        assert [o for o, _ in sorted(spans)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert len(places) <= -(-total // 2048) + 1


def test_plan_uses_up_all_pieces():
    rng = np.random.default_rng(2)
    counts = np.bincount(np.minimum(rng.lognormal(4, 1.2, 5000).astype(int) + 1, 2048), minlength=2049)
    found = packing.plan(counts)
    used = Counter()
    for lengths, times in found:
        assert sum(lengths) <= 2048
        for n in lengths:
            used[n] += times
    assert all(used[n] == counts[n] for n in range(2049))
    assert sum(t for _, t in found) <= -(-int((np.arange(2049) * counts).sum()) // 2048) + 1


def test_bpe(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    texts = [None, "", "a  b \n\t c d 　 e'll I'm \U0001f600\U0001f600 中文 12٣ \x85x  ", "a Āb", " " * 40,
             "x" * 200, "\x1c\x1d a", "the the Donaudampfschiff the", "\x00\x01"]
    got = {r.doc_id: r for r in bpe.encoded(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()}
    for i, t in enumerate(texts):
        ids = plain.encode_ordinary(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()), repr(t)
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_bpe_folds_pairs_of_ids(spark):
    """The fold's table holds each pair of ids that joins to a token, and made-up words have the library's ids, whether known or not."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.read_ranks(path)
    of = bpe.merges(ranks)
    bytes_of = {rank: token for token, rank in ranks.items()}
    assert len(of) > 50_000 and all(bytes_of[pair >> 16] + bytes_of[pair & 65535] == bytes_of[rank] for pair, rank in list(of.items())[::97])
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(["th", "en", "é", "ß", "lich", "aa", "X", "中", "o"], rng.integers(1, 12))) for _ in range(200)]
    texts = [" ".join(words[k: k + 50]) for k in range(0, 200, 25)] + ["\0 \0\0", "aaaaaaaaaaaaaaa"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in bpe.encoded(docs, path).collect():
        ids = plain.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_permutation_index(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 16))
    x[300:420] = x[300]  # copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9001, None), (9002, [0.0] * 16), (9003, [None] * 16), (9004, [float("nan")] * 16), (9020, [1.0])]
    got = {}
    for r in permutation_index.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 700, 20))
    hits = 0
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(700), -s))[:20]
        assert [r for r, _, _ in sorted(found)] == list(range(1, 21))
        assert all(abs(score - x[q] @ x[v]) < 1e-9 for _, v, score in found)
        hits += len(set(best.tolist()) & {v for _, v, _ in found})
    assert hits / (20 * len(got)) >= 0.9
    copies = [v for _, v, _ in sorted(got[300]) if 300 < v < 420]
    assert copies and copies == list(range(301, 301 + len(copies)))


def test_permutation_index_of_nothing(spark):
    vectors = spark.createDataFrame([(0, None, 1.0), (20, [0.0], 1.0), (40, [float("nan")], 1.0)], "vec_id long, embedding array<double>, score double")
    for rows in (vectors, vectors.filter("false")):
        got = permutation_index.nearest(rows)
        assert got.count() == 0 and got.columns == ["query_id", "rank", "vec_id", "score"]
    alone = spark.createDataFrame([(0, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert permutation_index.nearest(alone).count() == 0


def test_quality_of_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "b text", "z"), (1, "a text", "z"), (2, "other words here", "z"), (1, None, "z")] * 3, "doc_id long, text string, label string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (3, 7)], "doc_id long, quality int")
    once = quality.train(docs, labels)
    again = quality.train(docs.repartition(5), labels)
    assert (once[0] == again[0]).all() and once[1] == again[1]
    assert quality.quality_scores(docs, labels).count() == 12


def test_features_at_the_start_of_a_text():
    # What would be ahead of place 0 is not the end of the text.
    assert pii.describe("12 34 a7b", ("card", 0, 2)) == pii.describe("12 34 aab", ("card", 0, 2))
    assert pii.describe("12 34 a7b", ("card", 0, 2))[-3:-1] == [0.0, 1.0]


def test_fingerprints(spark, rows):
    got = {r.doc_id: r for r in fingerprints.fingerprints(frame(spark, rows)).collect()}
    order = sorted(rows, reverse=True)
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        a, b = shingles(t, 5), shingles(after, 5)
        if len(a | b) <= 64 and t.isascii() and after.isascii():
            assert got[i].near_next == (len(a & b) / len(a | b) if a | b else 1.0)
    same = {}
    for i, t in rows:
        assert same.setdefault(t or "", got[i].fingerprint) == got[i].fingerprint
    assert len(set(same.values())) > len(same) // 2


def test_merged_sketches(spark):
    df = spark.createDataFrame([(list(range(0, 900)), list(range(600, 1500)))], "a array<long>, b array<long>")
    h = [fingerprints.sketch(F.transform(c, lambda v: F.xxhash64(v))) for c in ("a", "b")]
    both = fingerprints.sketch(F.transform(F.array_union("a", "b"), lambda v: F.xxhash64(v)))
    row = df.select((fingerprints.merged(*h) == both).alias("same"), fingerprints.resemblance(*h).alias("r"), fingerprints.containment(*h).alias("c"),
                    fingerprints.distinct_shingles(both).alias("n")).first()
    assert row.same and abs(row.r - 0.2) < 0.15 and abs(row.c - 1 / 3) < 0.25 and 1000 < row.n < 2200


def test_sharding(spark):
    table = {r.slot: r.shard for r in sharding.lookup_table(spark, sharding.SHARDS[:5], 101).collect()}
    assert set(table) == set(range(101)) and max(Counter(table.values()).values()) - min(Counter(table.values()).values()) <= 1
    fewer = {r.slot: r.shard for r in sharding.lookup_table(spark, sharding.SHARDS[:4], 101).collect()}
    assert sum(table[s] != fewer[s] for s in table if table[s] in sharding.SHARDS[:4]) < 50
    # The turns by hand.
    names, slots = sorted(sharding.SHARDS[:5]), 101
    digest = [hashlib.md5(n.encode()).hexdigest() for n in names]
    order = [[(int(d[:8], 16) + j * (int(d[8:16], 16) % (slots - 1) + 1)) % slots for j in range(slots)] for d in digest]
    owner = {}
    for turn in range(slots):
        owner[next(s for s in order[turn % 5] if s not in owner)] = names[turn % 5]
    assert table == owner
    placed = sharding.place(spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "k long, slot string"), "k", sharding.lookup_table(spark, ("x", "y"), 7), 7).collect()
    assert len(placed) == 3 and len({r.shard for r in placed if r.k == 1}) == 1
    with pytest.raises(ValueError):
        sharding.lookup_table(spark, ("a", "b"), 100)


def test_groups_of_long_lines_take_linear_steps(spark):
    """Ten times the tokens take far less than a hundred times the steps: no fold over the places within a loop over them."""
    plan = spark.range(1).select(line_templates._groups(F.split(F.lit("a b c d e f"), " ")).alias("g"))._jdf.queryExecution().analyzed().toString()
    at = [m.start() for m in re.finditer(r"aggregate\(", plan)]
    assert len(at) == 1 and "but" not in plan[:at[0]]
    text = F.transform(F.sequence(F.lit(0), F.col("id").cast("int")), lambda i: F.lit("w"))
    sizes = spark.range(10).select(F.size(line_templates._groups(text)).alias("n")).collect()
    assert [r.n for r in sizes][3:] == [2 + (0 if k == 1 else min(k, int((k + 3) * 0.3 + 1e-9) + 1)) + k - 1 for k in range(1, 8)]


def test_lines_are_masked_again_only_where_they_are_held(spark):
    """Of the copies of a line one place is looked at again; blanks, tabs and digits are masked as by the plain patterns."""
    text = "\n".join(["the vessel left port 12 at noon", "the vessel  left\tport 7a at dusk", " x9 y", "no digits in this line", "1 2 3", "", "a b1c d2 3e <*>"])
    docs = spark.createDataFrame([(i, text) for i in range(40)], "doc_id long, text string")
    lines = line_templates.lines_of(docs, 1)
    got = {r.pos: r.line for r in lines.filter("doc_id = 0").collect()}
    assert got == {0: "the vessel left port <*> at noon", 1: "the vessel left port <*> at dusk", 2: "x9 y", 3: "no digits in this line", 4: "<*> <*> <*>",
                   6: "a <*> <*> <*> <*>"}
    one = lines.groupBy("leaf", "key").agg(F.min(F.xxhash64(*line_templates.PLACE)).alias("at"))
    held = line_templates._held_lines(docs, one).collect()
    assert {r.line for r in held} == {v for v in got.values() if v.count(" ") > 1} and len(held) < 40


def test_line_templates(spark, rows):
    note = "Copyright {} by the house of words all rights"
    texts = [f"{w}{w} opens a text of its own\n{note.format(2000 + i)}\nend" for i, w in enumerate("abcdef")] + [None, "", "short\nshort"]
    lines = "this line is the same in every text"
    texts += [f"{lines}\n{lines}\n{w}{w}{w} more of {w}" for w in "ghi"]
    docs = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)], "doc_id long, text string, n_dropped int")
    got = {r.doc_id: (r.text, r.n_dropped) for r in line_templates.without_recurring_lines(docs).collect()}
    assert got[0] == (texts[0], 0) and got[3] == (texts[3].replace(note.format(2003) + "\n", ""), 1)
    assert got[6] == (None, 0) and got[7] == ("", 0) and got[8] == ("short\nshort", 0)
    assert got[9] == (texts[9], 0) and got[10] == ("hhh more of h", 2)
    assert line_templates.without_recurring_lines(docs.filter("false")).count() == 0


def test_short_lines_recur_too(spark, tmp_path):
    texts = [f"{w} opens\n\n \nshare this\nLes.\n{n}\n{w} ends here" for n, w in enumerate(["one", "two", "three", "four"])]
    folder = str(tmp_path)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    got = {r.doc_id: (r.text, r.n_dropped) for r in queries.op9_line_templates(spark, folder).collect()}
    assert got[0] == (texts[0], 0)
    # Numbers that stand alone are not one line, and lines without any token stay.
    assert all(got[i] == (texts[i].replace("share this\nLes.\n", ""), 2) for i in (1, 2, 3))


def test_lines_recur_from_two_documents_on(spark):
    words = np.random.default_rng(6).choice(WORDS, 60).tolist()
    edited = [*words[:30], "edited", *words[31:]]
    same = "these words stand in just two texts"
    texts = [f"first text\n{same}\n{' '.join(words)}", f"second text\n{' '.join(edited)}\n{same}", "he saw the old dog", "he saw the old cat"]
    texts += [f"these words stand {w}{w} {w} {w}{w}{w} texts" for w in "abc"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_templates.without_recurring_lines(docs).collect()}
    # Two short lines that differ in a word are no template.
    assert got == {i: t for i, t in enumerate(texts)} | {1: "second text"}


def test_templates_in_a_full_leaf(spark):
    rng = np.random.default_rng(7)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 8))
    forms = ["this page is kept by {} for all friends of the house", "this page is sold by {} at the price of {} coins"]
    texts = [forms[k % 2].format(word(), word()) for k in range(8)]
    texts += ["this page is " + " ".join(word() for _ in range(len(forms[0].split()) - 3)) for _ in range(60)]
    assert len({len(t.split()) for t in texts}) == 1
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_templates.without_recurring_lines(docs).collect()}
    assert got == {i: "" if 2 <= i < 8 else t for i, t in enumerate(texts)}


@pytest.mark.parametrize("chunk", [7, 1 << 18])
def test_archives(spark, tmp_path, chunk):
    body = "<html>" + "é\r\nWARC/1.1\r\n\r\n" * 12 + "\r"
    pages = [(5, "http://a\r\nx", body), (2, None, body), (9, "u", body), (1, "u", "short"), (3, "u", "short"), (4, "u", None), (6, "u", ""), (2, "again", body)]
    path = str(tmp_path / "warc")
    warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string"), path, chunk)
    chunks = warc.read_archives(spark, path).collect()
    last = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or 0) for r in chunks if r["last"])
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(i, len((h or "").encode()), sha(h or ""), "revisit" if h == body and i != 2 else "response", 2 if h == body and i != 2 else 0) for i, _, h in pages]
    assert last == sorted(want)
    assert chunk > 100 or max(r.chunk_bytes for r in chunks) <= 4 * chunk
    assert sum(r.chunk_bytes for r in chunks if r.page_id == 2) == 2 * len(body.encode())


def test_cut_archives_stop_the_job(spark, tmp_path):
    path = str(tmp_path / "warc")
    warc.write_archives(spark.createDataFrame([(1, "u", "abcdefghijklmnop")], "page_id long, url string, html string").coalesce(1), path, 7)
    lines = [(r.value.encode(), "f") for r in spark.read.option("lineSep", "\r\n").text(path).collect()]
    heads = [i for i, (v, _) in enumerate(lines) if v.startswith(b"WARC/")]
    for rest in (lines[:heads[-1]], lines[:heads[-1] + 2], lines[:heads[-1]] + lines[:heads[-1]], lines[:heads[-1]] + [(v, "g") for v, _ in lines]):
        reader = warc._Reader()
        with pytest.raises(ValueError):
            for value, file in rest:
                reader.line(file, value)
            reader.end()
    reader = warc._Reader()
    assert [bool(r["last"]) for value, file in lines if (r := reader.line(file, value))][-1]
    reader.end()


def test_near_duplicates_of_repeated_ids(spark):
    a, b, z = "a " * 3 + "text of its own in here", "another one that has nothing of it", "and a third one all alone here"
    near = " ".join(f"w{i}" for i in range(60))
    rows = [(3, b), (5, b), (5, a), (7, a), (9, z), (9, z), (11, near), (11, near + " more"), (12, near), (13, None), (13, ""), (None, a), (None, a)]
    got = ngram_join.near_duplicate_free(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = Counter((r.doc_id, r.text) for r in got)
    kept = [t for i, t in got.elements() if i in (11, 12)]
    assert len(kept) == 1 and kept[0].startswith(near)
    assert {k: n for k, n in got.items() if k[0] != 11} == {(3, b): 1, (5, a): 1, (9, z): 1, (13, None): 1, (13, ""): 1, (None, a): 2}


def test_templates_shuffle_places_twice_at_most(spark):
    lines = ["one two three a b", "one two three a c", "one two three d b", "one two three d c", "five six seven x y", "five six seven z y"]
    groups = [1, 1, 1, 1, 2, 2]
    rows = [(g, 4 if g == 1 else 2, 1, g, k, line) for k, (g, line) in enumerate(zip(groups, lines, strict=True))]
    grouped = spark.createDataFrame(rows, "group long, group_docs long, docs long, leaf long, key long, line string")
    templates = line_templates._templates(grouped)
    # Of two tokens that each have half of the documents the greater is constant; a place without any is a blank.
    assert {r.key: r.template for r in templates.collect()} == {
        0: "one two three <*> <*>", 1: "one two three <*> c", 2: "one two three d <*>", 3: "one two three d c",
        4: "five six seven <*> y", 5: "five six seven <*> y"}
    plan = templates._jdf.queryExecution().sparkPlan().toString()
    assert "max_by" not in plan and "SortAggregate" not in plan


def test_bpe_keeps_its_tables_out_of_plans(spark):
    """As literals of the plan, tables of some MB stay in the driver as text after each run."""
    docs = spark.createDataFrame([(1, "some words"), (2, "some words   ")], "doc_id long, text string")
    got = bpe.encoded(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    plan = got._jdf.queryExecution()
    assert len(plan.toString()) < 200_000
    # No step hands a table on in its rows.
    assert not re.search(r"AS _(whole|merges|words|pieces)#", plan.sparkPlan().toString())
    assert [r.decoded_sha256 for r in got.orderBy("doc_id").collect()] == [hashlib.sha256(t.encode()).hexdigest() for _, t in docs.collect()]
