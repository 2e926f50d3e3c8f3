"""Normal forms and keys on hand-made rows."""

import json

import pytest
from pyspark.sql import functions as F

from citeweave.functions import align as A
from citeweave.functions import text as T

# Sentences of our own, with keys worked out by hand.
VECTORS = [
    ("ٱلْوَلَدُ فِي المَدْرَسَةِ", "الولد في المدرسه", "ولد في مدرس", "الو لول ولد في الم لمد مدر درس رسه"),
    ("أَكَلَتْ الْقِطَّةُ سَمَكَةً!", "اكلت القطه سمكه", "اكلت قط سمك", "اكل كلت الق لقط قطه سمك مكه"),
    ("وبيوتهم، كبيرة", "وبيوتهم كبيره", "بيوت كبير", "وبي بيو يوت وته تهم كبي بير يره"),
    ("", "", "", ""),
    (None, "", "", ""),
]


@pytest.mark.parametrize("text, norm, stems, trigrams", VECTORS)
def test_arabic_keys(spark, text, norm, stems, trigrams):
    r = spark.createDataFrame([(text,)], "t string").select(T.norm(F.col("t")).alias("n")).select(
        "n", F.array_join(T.stems(F.col("n")), " ").alias("s"), F.array_join(T.trigrams(F.col("n")), " ").alias("t")).first()
    assert (r.n, r.s, r.t) == (norm, stems, trigrams)


def test_two_normal_forms(spark):
    df = spark.createDataFrame([("قال النبي صلى الله عليه وسلم ٣ مرات [^2]",)], "t string")
    r = df.select(T.norm(F.col("t")).alias("a"), T.linkage_norm(F.col("t")).alias("b")).first()
    assert r.a == "قال النبي مرات" and r.b == "قال النبي ٣ مرات"


def test_latin(spark):
    df = spark.createDataFrame([("The Résumé of résumé naïve cats, cats and 42 dogs",), (None,)], "t string")
    got = df.select(T.latin_tokens(F.col("t"), decompose=True).alias("x"), T.alias_key(F.col("t")).alias("k")).collect()
    assert got[0].x == ["sume", "nai", "cats", "dogs"]
    assert got[0].k == "theresumeofresumenaivecatscatsanddogs"
    assert got[1].x == []


def test_small_functions(spark):
    df = spark.createDataFrame([("a  b ,c *d* \\_e[^1]", 125.7, ["a", "b"], ["b", "c", "d"], "{bad", [1.0, 0.0], [1.0, 1.0], "at-Talaq", "al-'Alaq")], "t string, s double, x array<string>, y array<string>, j string, u array<double>, v array<double>, c string, d string")
    r = df.select(
        T.plain(F.col("t")).alias("p"), T.clock(F.col("s")).alias("c"), T.overlap(F.col("x"), F.col("y")).alias("o"), F.to_json(T.json_or(F.col("j"), "a int", F.struct(F.lit(7).alias("a")))).alias("j"),
        T.cosine(F.col("u"), F.col("v")).alias("k"), T.clip(F.lit("abcdef"), 3).alias("z"), T.arabic_digits(F.lit("a12")).alias("n"), T.content_id(F.lit(" x ")).alias("h"),
        T.chapter_key(F.col("c")).alias("t1"), T.chapter_key(F.col("d")).alias("t2"), T.word_grams(F.array(*map(F.lit, "abcde")), 4).alias("g"), T.word_grams(F.array(F.lit("a")), 4).alias("g1"),
    ).first()
    assert (r.p, r.c, r.o, json.loads(r.j), round(r.k, 6), r.z, r.n, len(r.h)) == ("a b,c d _e", "2:05", 0.5, {"a": 7}, 0.707107, "abc…", "a١٢", 32)
    assert r.t1 != r.t2 and r.g == ["a b c d", "b c d e"] and r.g1 == ["a"]


def test_guesses(spark):
    df = spark.createDataFrame([("ini adalah buku yang baik dan itu",), ("this is the best of all that",), ("قال رسول الله",)], "t string")
    assert [r.g for r in df.select(T.guess_language(F.col("t")).alias("g")).collect()] == ["id", "en", "ar"]


def aligned(a, b):
    return A.local_alignment(a.split(), b.split(), A.Relations(A._stem))


def test_alignment_by_hand():
    r = aligned("b c d", "a b c d e")
    assert (r["similarity"], r["coverage"], r["first"], r["last"]) == (1.0, 1.0, 1, 3)
    r = aligned("one two xx four", "zero one two three four five")
    assert (r["same"], r["changed"], r["extra"], r["missing"]) == (3, 1, 0, 0) and r["similarity"] == 0.75
    r = aligned("one two four", "one two three four")
    assert (r["same"], r["missing"]) == (3, 1) and r["similarity"] == 0.75 and r["coverage"] == 1
    r = aligned("alpha", "beta")
    assert (r["similarity"], r["extra"], r["first"]) == (0.0, 1, -1)
    assert aligned("", "a")["similarity"] == 0 and aligned("a", "")["extra"] == 1
    assert aligned("writting", "writing")["near"] == 1


def test_alignment_columns(spark):
    df = spark.createDataFrame([(["a", "b"], ["a", "b", "c"]), (None, ["a"])], "x array<string>, y array<string>")
    got = df.select(A.align(F.col("x"), F.col("y")).alias("a"), A.similarity(F.col("x"), F.col("y")).alias("s"), A.containment(F.col("x"), F.col("y")).alias("c"))
    r = got.select("a.similarity", A.classify(F.col("a.similarity"), F.col("a.coverage")).alias("k"), A.difference_text(F.col("a.ops")).alias("d"), F.round("s", 6).alias("s"), "c").collect()
    assert tuple(r[0]) == (1.0, "verbatim", "", 0.8, 1.0) and r[1].k == "not_found"
    assert A.edit_distance("kitten", "sitting") == 3


def test_matching_words_against_difflib():
    import random
    from difflib import SequenceMatcher

    import numpy as np

    rng = random.Random(2)
    for _ in range(400):
        a, b = ([rng.randint(0, rng.choice([2, 6, 40])) for _ in range(rng.randint(0, 25))] for _ in "ab")
        want = sum(x.size for x in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
        assert A.matching_words(np.array(a, np.int64), np.array(b, np.int64)) == want, (a, b)


def test_edit_distance_of_words_needs_no_arrays(monkeypatch):
    """Short words are compared letter by letter, to the same distances as by rows of arrays."""
    import random

    from citeweave.functions import align as A

    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(0, 9)))
    pairs = [(word(), word()) for _ in range(300)]
    tail = "".join(rng.choice("xyz") for _ in range(40))
    by_arrays = [A.edit_distance(a + tail, b + tail) for a, b in pairs]  # an equal end does not change the distance
    monkeypatch.setattr(A, "np", None)
    assert [A.edit_distance(a, b) for a, b in pairs] == by_arrays


@pytest.mark.parametrize("cells", [1, 300, A.CELLS])
def test_pairs_aligned_together_as_alone(monkeypatch, cells):
    """Pairs of all lengths, empty ones included, give what each gives alone, and words of all lengths their edits."""
    import random

    monkeypatch.setattr(A, "CELLS", cells)
    rng = random.Random(6)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    words += [w[:-1] + rng.choice("abcde") for w in words if len(w) > 3] + ["الكتاب", "كتاب", "والكتاب", "قال", "وقال", "ا", ""]
    sources = [[rng.choice(words) for _ in range(rng.choice([0, 1, 3, 12, 30]))] for _ in range(150)]
    spoken = [[w for w in s[2:12] if rng.random() < 0.8] + [rng.choice(words)] * rng.randint(0, 2) for s in sources]
    alone = [A.local_alignment(a, b, A.Relations(A._stem)) for a, b in zip(spoken, sources)]
    together = A.placements(spoken, sources, A.Relations(A._stem))
    assert [tuple(x) for x in zip(*(c.tolist() for c in together))] == [(x["coverage"], x["first"], x["last"]) for x in alone]
    pairs = [(rng.choice(words), rng.choice(words)) for _ in range(300)] + [("a" * 40, "ab" * 30), ("", "abc"), ("", "")]
    assert A.edit_distances(*map(list, zip(*pairs))).tolist() == [A.edit_distance(a, b) for a, b in pairs]


def test_places_are_found_together(spark, monkeypatch):
    """A batch of pairs is aligned as one, not pair by pair."""
    asked, plain = [], A.placements
    monkeypatch.setattr(A, "local_alignment", None)
    monkeypatch.setattr(A, "placements", lambda spoken, source, relation: asked.append(len(spoken)) or plain(spoken, source, relation))
    spoken, source = [["one", "two"]] * 40 + [["xyz"]], [["zero", "one", "two", "three"]] * 41
    got = A.placements(spoken, source, A.Relations(A._stem))
    assert [x.tolist() for x in got] == [[1.0] * 40 + [0.0], [1] * 40 + [-1], [2] * 40 + [-1]] and asked == [41]
    df = spark.createDataFrame(list(zip(spoken, source)) + [(None, ["a"]), (["a"], None)], "a array<string>, b array<string>").coalesce(1)
    rows = df.select(A.place(F.col("a"), F.col("b")).alias("x")).select("x.*").collect()
    assert sorted(tuple(r) for r in rows) == sorted([(1.0, 1, 2)] * 40 + [(0.0, -1, -1)] * 3)
