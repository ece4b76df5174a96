"""Keywords in one pass and as a join, against plain substring search."""

import random

import pytest
from pyspark.sql import functions as F

from tidewheel.functions import keywords, text
from tidewheel.sources import dimensions


def brute(texts, words):
    return sorted((i, w) for i, t in texts for w in set(words) if w is not None and t is not None and w in t)


@pytest.fixture(scope="module")
def large():
    """100,000 words and texts that hold some, as parts of longer words too."""
    rng = random.Random(4)
    word = lambda n: "".join(rng.choices("abcdeé😀", k=n))
    words = list({word(rng.randint(5, 9)) for _ in range(104_000)})[:100_000]
    texts = [(i, " ".join(rng.choice(words) + word(rng.randint(0, 2)) for _ in range(40))) for i in range(60)]
    return texts + [(900, None), (901, ""), (902, words[0] * 3000)], words


def test_dictionary_of_many_words(spark, large):
    texts, words = large
    docs = spark.createDataFrame([(i, t, "k") for i, t in texts], "id long, body string, keyword string").repartition(4)
    dictionary = spark.createDataFrame([(w, 1) for w in [*words, words[5], None]], "keyword string, id int").repartition(4)
    want = brute(texts, words)
    assert len(want) > 2400
    for sent in (1 << 30, 0):
        assert sorted(tuple(r) for r in keywords.keyword_matches(docs, dictionary, "id", "body", sent).collect()) == want


@pytest.mark.parametrize("sent", [1 << 20, 0])
def test_short_empty_and_no_keywords(spark, sent):
    texts = [(1, "ab.c\nde"), (2, None), (3, ""), (4, "aaaa"), (5, "é😀e")]
    words = ["a", "ab", "aa", "", "c\nd", ".", "é", "😀e", "aaaaa", None, "zz"]
    docs, dictionary = spark.createDataFrame(texts, "id long, body string"), spark.createDataFrame([(w,) for w in words], "keyword string")
    assert sorted(tuple(r) for r in keywords.keyword_matches(docs, dictionary, "id", "body", sent).collect()) == brute(texts, words)
    assert keywords.keyword_matches(docs, dictionary.filter("false"), "id", "body", sent).count() == 0
    assert keywords.keyword_matches(docs.filter("false"), dictionary, "id", "body", sent).count() == 0


def test_small_dictionary_is_sent_and_a_large_one_joined(spark):
    docs, words = spark.createDataFrame([(1, "abcdef")], "id long, body string"), spark.createDataFrame([("abcde",)], "keyword string")
    plans = [keywords.keyword_matches(docs, words, "id", "body", sent)._jdf.queryExecution().toString() for sent in (5, 4)]
    assert ["ArrowEvalPython" in p for p in plans] == [True, False]
    assert "NestedLoop" not in plans[1] and "Cartesian" not in plans[1]
    with pytest.raises(ValueError):
        keywords.group_hits(F.lit("x"), [["x" * (keywords.SENT_BYTES + 1)]])


def test_group_hits(spark):
    groups = [["halt", "halted", "halt"], ["War"], ["", "z"], []]
    rows = spark.createDataFrame([(1, "halted award"), (2, None), (3, "")], "id long, low string")
    got = {r.id: r.h for r in rows.select("id", keywords.group_hits(F.col("low"), groups).alias("h")).collect()}
    assert got == {1: [3, 0, 1, 0], 2: None, 3: [0, 0, 1, 0]}
    strict = keywords.group_hits(F.col("low"), groups, keywords.Match(word_boundary=True, fold_case=True))
    assert {r.id: r.h for r in rows.select("id", strict.alias("h")).collect()}[1] == [1, 0, 1, 0]


def test_classify_looks_through_a_title_once(spark):
    titles = [(0, "Smelter halted as Gas shortage bites - x"), (1, "AMID a sTrike, mine closed BECAUSE OF floods in Mali"), (2, None), (3, "Qatar"),
              (4, "Closed becauſe of the long strike"), (5, "closed followİng heavy storms"), (6, "due to x, after the flood receded")]
    df = spark.createDataFrame(titles, "i int, title string")
    out = text.classify(df, dimensions.event_types(), dimensions.metal_keywords(), dimensions.countries())
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    got = {r.i: r for r in out.collect()}
    plain = {r.i: r.cause for r in df.select("i", text.cause(F.col("title")).alias("cause")).collect()}
    assert {i: r.cause for i, r in got.items()} == plain
    assert plain[0] == "Gas shortage bites" or plain[0] == "shortage bites"
    assert plain[4] == "the long strike" and plain[5] == "heavy storms" and plain[6] == "the flood receded"
    # Two keywords of one type beat one of another; the first type wins ties.
    assert (got[0].etype, got[1].etype, got[1].country, got[3].metals) == ("Plant/Smelter Closure", "Plant/Smelter Closure", "Mali", ["Metals"])
    assert got[2].etype is None and got[2].country is None and got[2].metals == ["Metals"]


def test_only_grams_of_the_dictionary_leave_a_text(spark, monkeypatch):
    """Texts longer than a slice, keywords over its edges and of every gram size; other places of a text give no rows."""
    monkeypatch.setattr(keywords, "SLICE", 10)
    rng = random.Random(7)
    texts = [(i, "".join(rng.choices("abé😀 ", k=rng.randint(0, 60)))) for i in range(80)] + [(900, "x" * 500), (901, "abé\0ab"), (902, "q" * 10 + "edge of it")]
    words = [*{t[a: a + n] for _, t in texts[:20] for a, n in ((3, 1), (5, 2), (8, 3), (6, 4), (4, 7), (2, 8), (1, 15), (9, 30)) if len(t) > 40}, "é\0a", "qqedge of i", "zzz"]
    bits = keywords._bits(keywords._keyword_grams(spark.createDataFrame([(w,) for w in words], "keyword string")))
    assert sum(len(h) for _, h in keywords._grams_in(["xy" * 400, "", None], bits, list(keywords.GRAMS))) == 0
    found = {w for w in words if len(w) == 8 for _, h in keywords._grams_in([t for _, t in texts if w in t], bits, [8]) if len(h)}
    assert found == {w for w in words if len(w) == 8}
    docs, dictionary = spark.createDataFrame(texts, "id long, body string"), spark.createDataFrame([(w,) for w in words], "keyword string")
    assert sorted(tuple(r) for r in keywords._by_grams(docs, "id", "body", dictionary).collect()) == brute(texts, words)
