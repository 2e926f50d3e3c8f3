"""Citations, numbers, chains, quoted speech and record splits on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from citeweave.functions import records as P
from citeweave.operators import parts as X
from citeweave.functions.citations import extract_citations, text_tokens
from citeweave.functions.text import chapter_key
from vocabulary import CUES, tables


def verse(chapter, first, last=None):
    return ("chapter", chapter, first, last or first, None, None)


def numbered(collection, number=""):
    return ("collection", None, None, None, collection, number)


@pytest.mark.parametrize("name, same", [("Al-Baqarah", "al baqoroh"), ("Asy-Syu'ara", "Ash-Shu'ara"), ("Ali Imran", "Ali 'Imran")])
def test_spellings_meet(spark, name, same):
    r = spark.createDataFrame([(name, same)], "a string, b string").select(chapter_key(F.col("a")).alias("a"), chapter_key(F.col("b")).alias("b")).first()
    assert r.a == r.b != ""


CITED = [
    ("sebagaimana dalam QS 2:255 tentang", [verse(2, 255)]),
    ("(26:88-89)", [verse(26, 88, 89)]),
    ("QS. Al-Baqarah [2]: 183", [verse(2, 183)]),
    ("Allah berfirman dalam surat Al-Baqarah ayat 255", [verse(2, 255)]),
    ("QS Asy-Syu'ara: 88-89", [verse(26, 88, 89)]),
    ("HR Bukhari no. 1", [numbered("bukhari", "1")]),
    ("HR Bukhari no. 12a, said", [numbered("bukhari", "12a")]),
    ("(HR. Muslim no. 2564)", [numbered("muslim", "2564")]),
    ("diriwayatkan oleh Ibnu Majah nomor 4216", [numbered("ibnmajah", "4216")]),
    ("Riyadhus Shalihin no. 681", [numbered("riyadussalihin", "681")]),
    ("Shahih Bukhari 6018", [numbered("bukhari", "6018")]),
    ("HR Abu Dawud no 4031", [numbered("abudawud", "4031")]),
    ("رواه البخاري", [numbered("bukhari")]),
    ("أخرجه أبو داود", [numbered("abudawud")]),
    ("(HR Muslim).", [numbered("muslim")]),
    ("diriwayatkan oleh Imam Bukhari dan Muslim", [numbered("bukhari")]),
    ("{وَاتَّقُواْ اللّهَ}[البقرة:203]", [verse(2, 203)]),
    ("[آل عمران:102]", [verse(3, 102)]),
    ("[الطور:٢٦-٢٧]", [verse(52, 26, 27)]),
    ("[البقؤة:197]", [verse(2, 197)]),
    ("سورة البقرة آية 255", [verse(2, 255)]),
    ("Surah At-Talaq ayat 2", [verse(65, 2)]),
    ("Surah Al-'Alaq ayat 1", [verse(96, 1)]),
    ("Surat An-Nashr ayat 1", [verse(110, 1)]),
    ("Surat Al-'Ashr ayat 2", [verse(103, 2)]),
    ("Sura at-Talaq Q.65:2-3 says", [verse(65, 2, 3)]),
    ("(HR. Bukhari No. 812 dan Muslim No. 490)", [numbered("bukhari", "812"), numbered("muslim", "490")]),
    ("HR Bukhari 1 dan Muslim 1907", [numbered("bukhari", "1"), numbered("muslim", "1907")]),
    ("bow down (in worship).[Quran 2:43]", [verse(2, 43)]),
    ("Qur'an 9:79", [verse(9, 79)]),
    ("the Quran 41 times", []), ("pada menit 12:30 beliau berkata ada 3 hal", []), ("tahun 2024 ada 100 orang", []), ("QS 2:300", []), ("Al-Baqarah 5", []), (None, []), ("", []),
]


def test_citations(spark):
    names, chapters = tables(spark)
    df = spark.createDataFrame([(k, x) for k, (x, _) in enumerate(CITED)], "doc_id int, text string")
    got = {k: [] for k in range(len(CITED))}
    for r in sorted(extract_citations(df, names, chapters, CUES).collect(), key=lambda r: (r.doc_id, r.start)):
        got[r.doc_id].append(tuple(r[k] for k in ("kind", "chapter", "first", "last", "collection", "number")))
        assert CITED[r.doc_id][0][r.start : r.end] == r.text
    assert [got[k] for k in range(len(CITED))] == [want for _, want in CITED]


def test_citation_phrases(spark):
    names, chapters = tables(spark)
    df = spark.createDataFrame([(1, "so (HR. Bukhari No. 812 dan Muslim No. 490)"), (2, "x " * 5000 + "in surat Al-Baqarah ayat 255-256.")], "doc_id int, text string")
    got = extract_citations(df, names, chapters, CUES).orderBy("doc_id", "start").collect()
    assert [(r.text, r.start) for r in got] == [("HR. Bukhari No. 812", 4), ("Muslim No. 490", 28), ("surat Al-Baqarah ayat 255-256", 10003)]
    assert extract_citations(df.where("doc_id = 0"), names, chapters, CUES).count() == 0


def test_tokens():
    assert [(t["kind"], t["key"]) for t in text_tokens("Al-'Alaq 12a\n[٢]: قَالَ")] == [("word", "alalaq"), ("number", "12"), ("word", "a"), ("mark", "\n"), ("mark", "["), ("number", "2"), ("mark", "]"), ("mark", ":"), ("word", "قال")]
    assert text_tokens(None) == []


@pytest.mark.parametrize("number, want", [
    ("1079 a", ["1079a"]), ("2711, 2712", ["2711", "2712"]), ("1697/1698 a", ["1697a", "1698a"]), ("5709-5712", ["5709", "5710", "5711", "5712"]),
    ("546 b-d", ["546b", "546c", "546d"]), ("Introduction 3", ["i003"]), ("", []), (None, []), ("12", ["12"]),
])
def test_numbers(spark, number, want):
    df = spark.createDataFrame([(number,)], "n string")
    assert df.select(P.expand_numbers(F.col("n")).alias("x")).first().x == want


def test_columns(spark):
    df = spark.createDataFrame([("391b", "A > Qāl > Abīh > Ibn Saʿīd Wāb. Ḥujr", '[prematn]x [narrator id="7"]Ali[/narrator][/prematn][matn]He said "go" [b]now[/b][/matn]', 'he said "a" and “b” "')], "n string, c string, m string, q string")
    r = df.select(
        P.canonical_number(F.col("n")).alias("n"), P.number_base(F.col("n")).alias("b"), P.chain_names(F.col("c")).alias("c"), P.marked_part(F.col("m"), "matn").alias("m"),
        P.marked_narrators(F.col("m")).alias("w"), P.quoted_pieces(F.col("q")).alias("q"),
    ).first()
    assert (r.n, r.b, r.c, r.m, r.q) == ("391.2", "391", ["A", "his father", "Ibn Saʿīd and Ibn Ḥujr"], 'He said "go" now', ["“b”"])
    assert [(w.id, w.name) for w in r.w] == [("7", "Ali")]


def test_quoted_speech(spark):
    shown = "قال رسول الله إنما الأعمال بالنيات ثم سكت وقال لا ضرر ولا ضرار"
    marked = '[matn]قال رسول الله "إِنَّمَا الأَعْمَالُ بِالنِّيَّاتِ" ثم سكت وقال "لا ضرر [b]ولا[/b] إضرار"[/matn] "خارج"'
    rows = [(1, shown, marked), (2, None, marked), (3, shown, "no marks"), (4, shown, None), (5, "قال «نعم» ثم", marked), (6, "one two three four", '[matn]"two three" and "one two"[/matn]'), (7, "one two", '[matn]"three four five"[/matn]')]
    df = spark.createDataFrame(rows, "id int, shown string, marked string")
    got = sorted((r.id, r.quote, dict((a, b) for a, b, _ in rows)[r.id][r.a : r.b]) for r in X.quoted_speech(df).collect())
    assert got == [(1, 0, "إنما الأعمال بالنيات"), (1, 1, "لا ضرر ولا ضرار"), (6, 0, "two three")]


def test_split_records(spark):
    long = " ".join(["كلمه"] * 20)
    cases = [
        ("حدثنا علي عن عمر قال كان النبي يقوم", None, None, ("حدثنا علي عن عمر قال", "كان النبي يقوم", None, "chain_then_speech")),
        ("a b c « one two » three", None, None, ("a b c", "one two » three", None, "quote_mark")), ('"a b" c d e f', None, None, (None, '"a b" c d e f', None, "unsplit")),
        ("x y المرء مع من أحب", None, "المرء مع من أحب", ("x y", "المرء مع من أحب", None, "aligned_to_parallel")), ("كلام قصير", None, None, (None, "كلام قصير", None, "unsplit")),
        (None, None, None, (None, "", None, "unsplit")), ("", "tirmidhi", "", (None, "", None, "unsplit")),
        (f"حدثنا علي قال {long} قال أبو عيسى حديث حسن", "tirmidhi", None, ("حدثنا علي قال", long, "قال أبو عيسى حديث حسن", "chain_then_speech")),
        (f"قال أبو عيسى حدثنا علي قال {long}", "tirmidhi", None, ("قال أبو عيسى حدثنا علي قال", long, None, "chain_then_speech")), ("حدثنا علي قال", None, None, (None, "حدثنا علي قال", None, "unsplit")),
    ]
    df = spark.createDataFrame([(k, *c[:3]) for k, c in enumerate(cases)], "id int, text string, book string, parallel string")
    got = {r.id: (r.chain, r.body, r.notes, r.method) for r in X.split_records(df).collect()}
    assert got == {k: c[3] for k, c in enumerate(cases)}
    assert X.split_records(df.limit(0)).count() == 0


def test_split_records_in_their_rows(spark):
    rows = [(1, "x y « one two", None, None), (1, "a b c « d", None, None), (None, "la la le « un", None, "zz")]
    df = spark.createDataFrame(rows, "id int, text string, book string, parallel string")
    parts = X.split_records(df)
    assert sorted((r.chain or "", r.body, r.method) for r in parts.collect()) == [("", "x y « one two", "unsplit"), ("a b c", "d", "quote_mark"), ("la la le", "un", "quote_mark")]
    plan = parts._jdf.queryExecution().executedPlan().toString()  # no memory of a task that grows with its rows
    assert not [node for node in ("Exchange", "Sort", "Window", "Aggregate", "Join") if node in plan]


def test_tokens_in_their_rows(spark):
    text = " \n😀 a,\t—  قَالَ\x0bb2\u00a0c "
    df = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "x")], "id int, t string")
    found = X.tokens(df, "t", ["id"], places=True)
    assert sorted((r.id, r.n, r.key, (text if r.id == 1 else "x")[r.a : r.b]) for r in found.collect()) == [(1, 0, "a", "a,"), (1, 1, "قال", "قَالَ"), (1, 2, "b2c", "b2\u00a0c"), (4, 0, "x", "x")]
    assert dict(found.dtypes)["a"] == "bigint" and sorted((r.id, r.n, r.key) for r in X.tokens(df, "t", ["id"]).collect()) == [(1, 0, "a"), (1, 1, "قال"), (1, 2, "b2c"), (4, 0, "x")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [node for node in ("Exchange", "Sort", "Window") if node in plan]
