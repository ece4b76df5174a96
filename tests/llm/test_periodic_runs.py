"""Runs against brute force over all periods, and the query's digests against a plain loop."""

import hashlib
import os
import random
import re
import zlib

import pytest

from tidewheel.llm import periodic_runs, queries

FOLDER = "/root/testdata/sf0.001"


def brute(words, times=4, least=6):
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            own = words[i: j + q]
            if len(own) >= max(least, times * q) and not any(own[d:] == own[: len(own) - d] for d in range(1, q)):
                out.append((i, len(own), q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("times,least", [(4, 6), (2, 2), (3, 5), (5, 6)])
def test_runs(times, least):
    rng = random.Random(times)
    for _ in range(700):
        n, kinds = rng.randint(0, 60), rng.choice([1, 2, 2, 3, 5])
        words = [rng.randrange(kinds) for _ in range(n)]
        if rng.random() < 0.5 and n > 10:
            a = rng.randrange(n - 5)
            p = rng.randint(1, max(1, (n - a) // 4))
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        want = brute(words, times, least)
        assert periodic_runs.runs_of(words, times, least) == want
        assert periodic_runs.text_runs([str(w).encode() for w in words], times, least) == want


def test_every_run_lies_in_a_stretch():
    rng = random.Random(2)
    words = [str(rng.randrange(400)).encode() for _ in range(3000)]
    words[700:700] = [b"x", b"y", b"z"] * 40
    words[2000:2000] = words[100:180] * 5 + words[100:130]
    found = periodic_runs.stretches(words, 4, 6)
    assert sum(b - a for a, b in found) < 800
    assert brute(words) == periodic_runs.text_runs(words)


def test_long_periodic_text_is_linear():
    for period in (1, 7, 5000):
        assert periodic_runs.runs_of([i % period for i in range(40_000)]) == [(0, 40_000, period)]


def plain(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    gone = {i for s, w, q in runs for i in range(s + q, s + w)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None, None, None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{w},{q}\n" for s, w, q in runs)),
            sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def digests(spark, docs):
    found = periodic_runs.run_digests(periodic_runs.periodic_runs(periodic_runs.with_repetition(docs)))
    return sorted((tuple(r) for r in found.collect()), key=str)


def test_digests(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("aé") if i % 3 else rng.choice(["Aa", "aa", "b b", "c"]) for _ in range(rng.randint(0, 90)))) for i in range(300)]
    rows += [(None, None), (None, "a " * 9), (10, None), (10, ""), (11, " \t\n"), (12, "x\n" * 30), (12, "x\n" * 30)]
    docs = spark.createDataFrame([(i, t, 1, "r") for i, t in rows], "doc_id long, text string, n_words int, runs string").repartition(3)
    got = digests(spark, docs)
    assert got == sorted((plain(i, t) for i, t in rows), key=str)
    assert digests(spark, docs.filter("false")) == []


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")
def test_query(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").filter("n_chars < 4000").select("doc_id", "text")
    assert digests(spark, docs) == sorted((plain(r.doc_id, r.text) for r in docs.collect()), key=str)
    out = queries.op11_periodic_runs(spark, FOLDER)
    assert dict(out.dtypes) == {"doc_id": "bigint", "n_runs": "bigint", "start": "bigint", "length": "bigint", "period": "bigint",
                                "exponent_milli": "bigint", "runs_sha256": "string", "collapsed_sha256": "string"}
