"""The forest's components against all pairs, with regions of every kind, and the SQL of both joins."""

import os
from fractions import Fraction

import numpy as np
import pytest
from test_operators import WORDS, brute_components, corpus, frame

from tidewheel.llm import lsh_forest, ngram_join, queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("size,least,region,weight", [(3, Fraction(17, 20), 64, 1 << 20), (5, Fraction(4, 5), 3, 300), (1, Fraction(1, 2), 2, 100)])
def test_components(spark, monkeypatch, size, least, region, weight):
    """Small regions and tasks, so that regions are parted, stay large at the last depth, and blocks are cut."""
    monkeypatch.setattr(lsh_forest, "REGION", region)
    monkeypatch.setattr(ngram_join, "TASK_WEIGHT", weight)
    rows = corpus()
    got = {r.doc_id: r for r in lsh_forest.near_duplicates(frame(spark, rows), size, least).collect()}
    want = brute_components(rows, size, least)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (i == want[i][1]) for i, r in got.items())


def test_large_group_of_near_copies(spark):
    rng = np.random.default_rng(3)
    base = rng.choice(WORDS, 200).tolist()
    rows = [(0, " ".join(base))]
    for i in range(1, 300):
        words = list(base)
        words[int(rng.integers(200))] = f"w{i}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(rng.choice(WORDS, 60))) for i in range(100)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in lsh_forest.near_duplicates(frame(spark, rows), 3, Fraction(17, 20)).collect()}
    assert got == brute_components(rows, 3, Fraction(17, 20))


def test_pairs_at_the_similarity_are_found(spark):
    """Pairs just at 17/20: 170 common words of 200 in the union."""
    rows = []
    for k in range(400):
        common = [f"c{k}x{j}" for j in range(170)]
        rows += [(2 * k, " ".join(common + [f"a{k}x{j}" for j in range(15)])), (2 * k + 1, " ".join(common + [f"b{k}x{j}" for j in range(15)]))]
    got = lsh_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 1, Fraction(17, 20))
    assert {r.doc_id: r.component_id for r in got.collect()} == {i: i // 2 * 2 for i in range(800)}
    first, last = lsh_forest.depths(Fraction(17, 20))
    assert first < last and (1 - 0.85 ** last) ** lsh_forest.TREES <= lsh_forest.MISS


def test_ids_and_nothing(spark):
    near = " ".join(f"w{i}" for i in range(60))
    rows = [(None, near), (3, near), (2, near + " more"), (2, "other"), (5, None), (6, ""), (7, "a b"), (8, "A b"), (9, "a  b c")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, kept int")
    got = sorted((tuple(r) for r in lsh_forest.near_duplicates(docs, 3, Fraction(17, 20)).collect()), key=str)
    assert got == sorted([(None, 58, None, 0, None, True), (3, 58, 3, 1, 2, False), (2, 59, 2, 1, 2, True), (2, 1, 2, 0, 2, True), (5, 0, 5, 0, 5, True),
                          (6, 0, 6, 0, 6, True), (7, 1, 7, 0, 7, True), (8, 1, 7, 0, 7, False), (9, 1, 9, 0, 9, True)], key=str)
    assert lsh_forest.near_duplicates(docs.filter("false")).count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["op2_ngram_join", "op12_lsh_forest"])
def test_queries_match_their_oracles(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    want = con.execute(queries.ORACLES[name])
    names = [c[0] for c in want.description]
    out = queries.QUERIES[name](spark, FOLDER)
    assert sorted(out.columns) == sorted(names)
    assert sorted(tuple(r) for r in out.select(*names).collect()) == sorted(want.fetchall())
