"""The manifest against hand-made trees, with nulls, ties, lone leaves and clashing columns, and against its SQL."""

import hashlib
import os
import zlib

import numpy as np
import pytest

from tidewheel.llm import merkle, queries

FOLDER = "/root/testdata/sf0.01"
CELLS = ("doc_id", "source", "lang", "n_chars", "text")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(hashes):
    levels = [hashes]
    while len(levels[-1]) > 1:
        h = levels[-1]
        levels.append([digest("".join(h[i: i + 8])) for i in range(0, len(h), 8)])
    return levels


def path(levels, j):
    out = []
    for h in levels[:-1]:
        a = j // 8 * 8
        out.append(("".join(h[a:j]), "".join(h[j + 1: a + 8])))
        j //= 8
    return out


def by_hand(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    order = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    for own in groups.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
    trees = {k: tree([leaf_of(r) for r in groups[k]]) for k in order}
    top = tree([trees[k][-1][0] for k in order])
    out = []
    for place, k in enumerate(order):
        for j, row in enumerate(groups[k]):
            steps = path(trees[k], j) + path(top, place)
            edited = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
            h = leaf_of([*row[:4], row[4].translate(LOW) if row[4] is not None else None]) if edited else leaf_of(row)
            for a, b in steps:
                h = digest(a + h + b)
            out.append((row[0], leaf_of(row), trees[k][-1][0], top[-1][0], digest("".join(a + b for a, b in steps)), h, h == top[-1][0]))
    return out


def rows_of(sizes):
    rng = np.random.default_rng(3)
    out = []
    for lang, n in sizes.items():
        out += [(int(rng.integers(10_000)) * 7, f"s{i % 3}" if i % 5 else None, lang, i if i % 4 else None, f"Text É {i} of {lang}") for i in range(n)]
    return out


@pytest.mark.parametrize("sizes", [
    {"en": 1}, {"en": 1, None: 1}, {"en": 9, "de": 8, "": 1, None: 65}, {f"l{i}": 1 + i % 3 for i in range(70)}, {"en": 513, "é": 2}])
def test_proofs(spark, sizes):
    rows = rows_of(sizes)
    rows += [(None, None, "en", None, None), (None, None, "en", None, "A"), (21, "s", "en", 1, None), (21, "s", "en", 1, ""), (21, "s", "en", 1, "")]
    docs = spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree string, idx int")
    got = [tuple(r) for r in merkle.verified_rows(docs.repartition(5)).collect()]
    assert sorted(got, key=str) == sorted(by_hand(rows), key=str)


def test_deep_trees(spark, monkeypatch):
    """Subtrees of two levels, so that several stored levels lie over each other."""
    monkeypatch.setattr(merkle, "KEPT", 2)
    monkeypatch.setattr(merkle, "SUBTREE", 64)
    rows = rows_of({"en": 700, "fr": 64, None: 130})
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert sorted(map(str, merkle.verified_rows(docs).collect())) == sorted(map(str, (merkle.verified_rows(docs.repartition(7)).collect())))
    assert sorted((tuple(r) for r in merkle.verified_rows(docs).collect()), key=str) == sorted(by_hand(rows), key=str)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")
    assert merkle.verified_rows(docs).count() == 0
    assert merkle.manifest(docs, list(CELLS), "lang", "doc_id").root().count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")
def test_query_matches_its_oracle(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    want = con.execute(queries.ORACLES["op13_merkle"])
    names = [c[0] for c in want.description]
    got = queries.op13_merkle(spark, FOLDER).select(*names).collect()
    assert sorted(tuple(r) for r in got) == sorted(want.fetchall())
