"""The self-join part by part of its keys: results as for all keys at once, and what is left on disk."""

import os
from fractions import Fraction

import numpy as np
import pytest
from test_operators import brute_components, corpus, frame

from tidewheel.llm import line_templates, ngram_join


@pytest.fixture
def parted(monkeypatch):
    """Several parts of each kind even for a small table."""
    for name in ("PART_KEYS", "PART_WEIGHT"):
        monkeypatch.setattr(ngram_join, name, 16)
    monkeypatch.setattr(ngram_join, "PARTS", 2)


def test_part_count():
    assert [ngram_join.part_count(n, 10, 8) for n in (0, 1, 10, 11, 20, 21, 40, 41, 10**9)] == [1, 1, 1, 2, 2, 4, 4, 8, 8]


def test_parts_hold_all_keys_once():
    values = np.random.default_rng(1).integers(0, 2**64, 1000, "uint64")
    found = np.concatenate([ngram_join.of_part(values, part, 8) for part in range(8)])
    assert sorted(found.tolist()) == sorted(values.tolist())


def test_components_in_parts(spark, parted, monkeypatch):
    monkeypatch.setattr(ngram_join, "TASK_WEIGHT", 200)
    monkeypatch.setattr(ngram_join, "FREQUENT", 2)
    rows = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similarity_join(frame(spark, rows), 3, Fraction(4, 5)).collect()}
    assert got == brute_components(rows, 3, Fraction(4, 5))


def test_keys_are_gone_from_disk(spark, parted):
    """Of a run, only tables that its result is read from stay in the shared folder."""
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    rows = corpus()
    want = {i: c for i, (_, c) in brute_components(rows, 3, Fraction(4, 5)).items()}
    got = ngram_join.near_duplicate_free(frame(spark, rows), 3, Fraction(4, 5))
    assert sorted(r.doc_id for r in got.collect()) == sorted(i for i, c in want.items() if c in (i, None))
    left = {name.rsplit("-", 1)[0] for name in set(os.listdir(folder)) - before}
    assert not left & {"prefixes", "again", "shared", "edges", "frequent", "pairs", "classes", "late"}


def test_edges_by_part(spark, parted, monkeypatch):
    """No part has more than a share of the keys, and the parts together give what all keys at once do."""
    rows = [(k, k // 2 * 1000 + k, 3) for k in range(64) for _ in range(2)] + [(k, -k, 3) for k in range(64)] + [(7, n, 3) for n in range(9)]
    postings = spark.createDataFrame(rows, "token long, node long, n int").repartition(3)
    monkeypatch.setattr(ngram_join, "PARTS", 4)
    seen = []
    own = ngram_join._shared
    monkeypatch.setattr(ngram_join, "_shared", lambda part, key: seen.append(part.count()) or own(part, key))
    edges, often = ngram_join.edges_in_parts(postings, "token", 8)
    assert len(seen) == 4 and sum(seen) == len(rows) and max(seen) <= len(rows) // 3
    # Token 0 has one node only, token 7 is a frequent one.
    assert sorted(tuple(r) for r in edges.collect()) == sorted((k // 2 * 1000 + k, -k) for k in range(1, 64) if k != 7)
    assert sorted(tuple(r) for r in often.select("token", "node", "n").collect()) == sorted(r for r in rows if r[0] == 7)


def test_lines_are_gone_from_disk(spark):
    """What the stage of lines leaves for those after it is the table that its result is read from."""
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    rows = [(i, "a line that is in all of them\n" + " ".join([word] * (4 + 3 * i))) for i, word in enumerate(("red", "green", "blue", "grey"))]
    got = line_templates.without_recurring_lines(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_dropped) for r in got) == [(0, 0), (1, 1), (2, 1), (3, 1)]
    assert {name.rsplit("-", 1)[0] for name in set(os.listdir(folder)) - before} == {"hits"}
