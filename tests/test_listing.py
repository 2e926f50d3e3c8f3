"""Lookups and checks of given results on small tables."""

import datetime

from pyspark.sql import functions as F

from citeweave.functions import text as T
from citeweave.operators import listing as L


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_resolve_keys(spark):
    units = spark.createDataFrame([("quran:2:255", "quran", "2:255"), ("muslim:5", "muslim", "5"), ("muslim:7a", "muslim", "7a")], "key string, collection string, number string")
    aliases = spark.createDataFrame([("sahihmuslim", "muslim"), ("forty", "forty")], "alias string, collection string")
    pointers = spark.createDataFrame([("forty:1", "muslim:5")], "key string, source_key string")
    asked = spark.createDataFrame([("2:255",), ("quran:2:255",), ("Sahih Muslim 5",), ("muslim:7a",), ("Forty 1",), ("none 9",)], "ask string")
    got = {r.ask: (r.key, r.resolved_by) for r in L.resolve_keys(asked, units, aliases, pointers).collect()}
    assert got == {"2:255": ("quran:2:255", "verse"), "quran:2:255": ("quran:2:255", "verse"), "Sahih Muslim 5": ("muslim:5", "name"), "muslim:7a": ("muslim:7a", "key"), "Forty 1": ("muslim:5", "pointer"), "none 9": (None, None)}


def test_ranges(spark):
    r = L.chapter_ranges(spark.createDataFrame([(1, 7), (2, 286)], "chapter int, length int"))
    assert rows(r.select("first_id", "last_id")) == [(1, 7), (8, 293)]
    assert L.rows_in_chapter(spark.range(1, 300), r, 2).count() == 286
    units = spark.createDataFrame([("a", 1), ("b", 2)], "key string, x int")
    assert rows(L.by_keys(units, spark.createDataFrame([("b",), ("b",), ("z",)], "key string"), columns=["x"])) == [("b", 2)]


def test_given_results(spark):
    docs = spark.createDataFrame([(1, "The Matn and the matn of it")], "doc_id int, text string")
    terms = spark.createDataFrame([(1, 1, " matn ", "g"), (1, 2, "Matn", "g"), (1, 3, "x", "g"), (1, 4, "absent", "g"), (1, 5, "the", "g")], "doc_id int, ord int, form string, gloss string")
    assert rows(L.valid_terms(terms, docs, ["the"]).select("form")) == [("matn",)]
    seg = spark.createDataFrame([(1, 0), (1, 1)], "doc_id int, seg int")
    quiz = spark.createDataFrame([(1, "q", ["a", "b", "c", "d"], 3, 1), (1, "r", ["a"], 0, 0), (1, "s", ["a", "b", "c", "d"], 4, 0), (1, "t", ["a", "b", "c", "d"], 0, 2)], "doc_id int, question string, options array<string>, answer int, paragraph int")
    assert rows(L.valid_quiz(quiz, seg).select("question")) == [("q",)]
    f = spark.createDataFrame([(1, k, f"k{k}", f"ref {k}") for k in range(5)] + [(2, 1, "k", "r"), (2, 2, "k2", "r2")], "doc_id int, span int, key string, reference string")
    q = L.source_quiz(f).orderBy("span").collect()
    assert len(q) == 4 and all(r.options[r.answer] == f"ref {r.span}" and len(set(r.options)) == 4 for r in q)


def test_lists(spark):
    units = spark.createDataFrame([("a", "f", 1, "x" * 300), ("b", "f", 2, "bb"), ("c", None, 3, "cc")], "key string, family_id string, ord int, text string")
    assert {(r.key, r.other, len(r.text)) for r in L.family_listing(units).collect()} == {("a", "b", 2), ("b", "a", 241)}
    now = F.lit(datetime.datetime(2024, 6, 1))
    box = spark.createDataFrame([(1, "dispute", datetime.datetime(2024, 5, 1)), (2, "odd", datetime.datetime(2024, 5, 2)), (3, "suggest", datetime.datetime(2023, 1, 1))], "id int, kind string, ts timestamp")
    assert [(r.id, r.kind) for r in L.messages(box, now).collect()] == [(2, "feedback"), (1, "dispute")]
    reviews = spark.createDataFrame([("a", 1, 1, 5), ("a", 2, 3, 10), ("b", 1, 2, 99)], "key string, ts int, box int, due int")
    assert rows(L.due_cards(reviews, F.lit(50)).select("key", "learned")) == [("a", True)]
    q = spark.createDataFrame([(1, "red apples and green pears")], "query int, text string")
    s = spark.createDataFrame([(1, 0, "green pears here"), (1, 1, "red only"), (2, 0, "nothing")], "doc_id int, seg int, text string")
    assert [(r.seg, r.shared) for r in L.matching_passages(q, s).orderBy("rank").collect()] == [(0, 2), (1, 1)]
    a = spark.createDataFrame([(1, "said <q>" + "كلمة " * 6 + "</q> then " + "كلمة " * 6), (2, "كلمة كلمة")], "id int, text string")
    assert [(r.id, r.n) for r in L.leak_runs(a).collect()] == [(1, 0)]
    st = spark.createDataFrame([("verbatim", True), ("paraphrase", False), ("misquote", None), ("verbatim", None)], "status string, agrees boolean")
    assert L.attention(st).count() == 2 and L.review_queue(st).count() == 1
    assert [r.t for r in st.select(L.tone(F.col("status")).alias("t")).collect()] == ["good", "none", "warn", "good"]


def test_leaks(spark):
    """A run that is a source's words, one that is nearly, one of nobody, and one in a tag."""
    source = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    answers = spark.createDataFrame([(1, f"He wrote: {source}."), (2, "some other words that stand nowhere at all"), (3, f"<q>{source}</q> done"), (4, "5 alpha beta gamma delta epsilon zeta eta 6"), (5, None)], "id int, text string")
    sources = spark.createDataFrame([(7, source), (8, "alpha beta gamma delta and then quite other words")], "key int, text string")
    got = {(r.id, r.source) for r in L.leaks(answers, sources, T.latin_words(F.col("text")), word="[a-z]+", between="[ ,.;:]+").collect()}
    assert got == {(1, 7), (4, 7)}


def test_mentions_and_ranges(spark):
    m = spark.createDataFrame([(1, None, 1), (1, "Ali", 3), (1, "Aly", 2), (None, "x", 1), (2, None, 1)], "id int, name string, ord int")
    assert {(r.id, r.name, r.n) for r in L.mention_counts(m).collect()} == {(1, "Aly", 3), (2, None, 1)}
    refs = spark.createDataFrame([("a", 1, 3), ("b", 5, 5)], "ref string, low int, high int")
    rows = spark.createDataFrame([(2, "x"), (3, "y"), (5, "z")], "number int, text string")
    assert sorted((r.ref, r.text) for r in L.ranged(refs, rows, "low", "high", "number").collect()) == [("a", "x"), ("a", "y"), ("b", "z")]
