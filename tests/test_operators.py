"""Relational operators on small tables worked by hand."""

import json

from pyspark.sql import functions as F

from citeweave.functions.align import Relations, local_alignment
from citeweave.operators import documents as D
from citeweave.operators import evaluate as E
from citeweave.operators import link as L
from citeweave.operators import records as R
from citeweave.operators import retrieve as I
from citeweave.operators import verify as V
from citeweave.operators.graph import connected_components
from citeweave.sources import readers, sinks
from citeweave.streaming import streams


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 102), (102, 101), (7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 102: 100}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_grades(spark):
    words = ["Sahih", "Hasan Sahih", "Da'if Munkar", "موضوع", "No grade", "Silent", "strong chain", "??", None]
    df = spark.createDataFrame([(w,) for w in words], "g string").select(R.grade_class(F.col("g"), F.lower("g")).alias("c"))
    assert [r.c for r in df.collect()] == ["sahih", "hasan_sahih", "daif", "mawdu", None, "silent", "accepted", "other", None]
    grades = spark.createDataFrame([(1, "x", "sahih", "Sahih", "a", True, 1), (1, "x", "daif", "Weak", "b", False, 2), (2, "y", "hasan", "Hasan", "a", False, 1), (2, "y", "hasan", "Good", "b", False, 2), (3, "z", "silent", "Silent", "a", False, 1)], "unit int, grader string, class string, grade string, source string, primary boolean, ord int")
    c = R.combine_grades(grades)
    got = {(r.unit, r["class"]): (r.grade, r.wordings, r.conflict) for r in c.collect()}
    assert got[1, "sahih"] == ("Sahih", ["Sahih"], True) and got[2, "hasan"] == ("Hasan", ["Good", "Hasan"], False)
    units = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, "muslim")], "unit int, collection string")
    assert {r.unit: r.status for r in R.grade_summary(c, units).collect()} == {1: "disputed", 2: "hasan", 3: "silent", 4: "ungraded", 5: "sahihayn"}


def test_rank_fusion_and_parts(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query int, key string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], "query int, key string, rank int")
    assert [r.key for r in I.fuse([a, b], 3).orderBy("rank").collect()] == ["y", "x", "z"]
    parts = spark.createDataFrame([(1, "k#p", 1), (1, "k", 3), (1, "m", 2)], "query int, key string, rank int")
    assert rows(I.fold_parts(parts).select("key", "rank")) == [("k", 1), ("m", 2)]
    assert rows(I.append_absent(spark.createDataFrame([(1, "k", 0.5, 1)], "query int, key string, score double, rank int"), parts.withColumn("key", F.regexp_replace("key", "#p", ""))).select("key")) == [("k",), ("m",)]


def test_embedding_cache(spark):
    texts = spark.createDataFrame([("a b",), ("a b",), ("c",)], "text string")
    embed = lambda c: F.array(F.length(c).cast("float"))
    cache = spark.createDataFrame([], "hash string, vector array<float>")
    vectors, new = I.embed_missing(texts, cache, embed, "m", 8)
    assert vectors.count() == 3 and new.count() == 2
    assert I.embed_missing(texts, new, embed, "m", 8)[1].count() == 0
    good, bad = I.intake(spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0]), ("x" * 65, [1.0, 2.0])], "id string, v array<float>"), 2)
    assert good.count() == 1 and bad.count() == 2


def test_bm25_both_ways(spark):
    units = spark.createDataFrame([(k, [f"w{(k * j) % 17}" for j in range(1, 2 + k % 9)]) for k in range(60)] + [(99, [])], "key int, words array<string>")
    q = spark.createDataFrame([(n, f"w{t}") for n in range(6) for t in range(n, n + 4)] + [(7, "absent")], "query int, token string")
    few, many = (rows(I.bm25(q, units, 5, most).select("query", "key", "score", "rank")) for most in (1 << 20, 0))
    assert few == many and len(few) == 30
    assert I.bm25(q.where("query = 7"), units, 5).count() == 0


def test_nearest_in_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    v = rng.normal(size=(60, 5))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "key long, vector array<double>")
    got = {}
    for r in I.nearest(df.where("key % 20 = 0"), df, 4, block=2).collect():
        got.setdefault(r["query"], []).append((r["rank"], r.key))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in (0, 20, 40):
        want = [k for k in np.argsort(-(u @ u[q])) if k != q][:4]
        assert [k for _, k in sorted(got[q])] == want


def test_nearest_with_many_ties_in_small_blocks(spark, monkeypatch):
    """Few similarities are held at a time; of equal ones the smaller keys stay."""
    monkeypatch.setattr(I, "HELD", (2, 3))
    df = spark.createDataFrame([(k, [1.0, float(k % 2)]) for k in range(40)], "key long, vector array<double>")
    got = sorted((r["query"], r["rank"], r.key) for r in I.nearest(df.where("key < 10"), df, 5).collect())
    assert got == [(q, n + 1, x) for q in range(10) for n, x in enumerate([k for k in range(40) if k % 2 == q % 2 and k != q][:5])]


def test_search_of_units_equals_a_saved_index(spark):
    units = spark.createDataFrame([(k, [f"w{(k * j) % 23}" for j in range(1, 2 + k % 9)]) for k in range(80)] + [(99, [])], "key int, words array<string>")
    asked = spark.createDataFrame([(n, [f"w{t}" for t in range(n, n + 6)]) for n in range(9)] + [(10, ["absent"])], "query int, words array<string>")
    saved = I.postings(units, F.col("words")), I.unit_lengths(units, F.col("words"))
    for few, share in ((None, 1.0), (3, 0.2)):
        assert rows(I.search_units(units, asked, 5, few, share)) == rows(I.search_index(*saved, asked, 5, few, share))


def test_verify_statuses(spark):
    words = [f"w{k}{chr(97 + k % 26)}" for k in range(40)]
    swapped = [w if k % 6 else "changed" for k, w in enumerate(words)]
    passages = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    docs = spark.createDataFrame([(1, "before it " + " ".join(words) + " after"), (2, " ".join(swapped)), (3, "nothing alike here at all"), (4, None), (5, " ".join(words[:5]))], "doc_id long, text string")
    got = {r.doc_id: (r.status, r.first_word) for r in V.verify(passages, docs).collect()}
    assert got == {1: ("verbatim", 2), 2: ("misquote", got[2][1]), 5: ("not_found", 0)}


def test_verify_finds_every_passage(spark):
    texts = {k: " ".join(f"p{k}w{i}" for i in range(12)) for k in range(10)} | {10: "only three words", 11: "", 12: "once", 13: None}
    passages = spark.createDataFrame(list(texts.items()), "item_id long, text string")
    docs = spark.createDataFrame([(1, " and then ".join(texts[k] for k in range(10))), (2, "here stand Only, three words; once"), (3, "only three other words"), (4, "only three")], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): (r.status, r.similarity, r.first_word) for r in V.verify(passages, docs).collect()}
    assert got == {(1, k): ("verbatim", 1.0, 14 * k) for k in range(10)} | {(2, 10): ("verbatim", 1.0, 2), (2, 12): ("verbatim", 1.0, 5)}
    words = lambda df: df.select(df.columns[0], F.split("text", " ").alias("words"))
    assert V.gram_candidates(words(passages), words(docs)).count() == 5 and V.gram_candidates(words(passages), words(docs), None).count() == 10


def test_verify_reads_long_documents_whole(spark):
    words = [f"p{k}w" for k in range(30)]
    noise = lambda seed, n: [f"n{(seed * 7919 + i * 31) % 997}x" for i in range(n)]
    swapped = [w if k % 6 else "changed" for k, w in enumerate(words)]
    texts = {
        1: words[3:8] + noise(1, 9000) + words + noise(2, 3000), 2: noise(3, 50) + swapped + noise(4, 6000) + words[:4] + noise(5, 6000),
        3: words[:12] * 400 + noise(6, 5000) + words, 4: noise(7, 5000) + words[:15] + noise(8, 50) + words[15:] + noise(9, 5000),
    }
    passages = spark.createDataFrame([(1, " ".join(words)), (2, "two words")], "item_id long, text string")
    docs = spark.createDataFrame([(k, " ".join(v)) for k, v in texts.items()] + [(5, "two words " * 10_000)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): (r.status, r.similarity, r.first_word) for r in V.verify(passages, docs).collect()}
    whole = {k: local_alignment(words, v, Relations()) for k, v in texts.items()}
    assert {k: v[1:] for k, v in got.items() if k[1] == 1} == {(k, 1): (round(a["similarity"], 6), a["first"]) for k, a in whole.items()}
    assert [got[k, 1][0] for k in sorted(texts)] == ["verbatim", "misquote", "verbatim", "not_found"] and got[5, 2] == ("verbatim", 1.0, 0)
    assert (got[1, 1][2], got[3, 1][2]) == (9005, 9800)


def test_choose_match(spark):
    schema = "span int, key string, score double, verbatim boolean, cited boolean, graded boolean, source_rank int, length int, similarity double, coverage double"
    df = spark.createDataFrame([
        (1, "a", 10.0, False, False, False, 1, 5, 0.9, 0.9), (1, "b", 9.6, False, False, True, 2, 5, 0.8, 0.9), (1, "c", 8.0, False, True, True, 1, 5, 0.5, 0.5),
        (2, "a", 10.0, True, False, False, 1, 9, 1.0, 1.0), (2, "b", 12.0, False, True, True, 1, 5, 0.7, 0.7),
    ], schema)
    m = V.choose_match(df)
    assert {r.span: (r.key, r.closest) for r in m.collect()} == {1: ("b", None), 2: ("b", "a")}
    near = {r.span: (r.near, r.also) for r in V.near_lists(df, m).collect()}
    assert near == {1: (["a", "c"], ["a"]), 2: (["a"], ["a"])}


def test_citation_check_and_decisions(spark):
    members = spark.createDataFrame([("a:1", "f", "a"), ("b:2", "f", "b"), ("c:3", None, "c")], "key string, family_id string, collection string")
    f = spark.createDataFrame([(1, "a:1", "b:2", None), (2, "a:1", "c:3", None), (3, "a:1", None, "b"), (4, "c:3", None, "c"), (5, "c:3", None, None)], "span int, key string, cited_key string, cited_collection string")
    assert {r.span: r.agrees for r in V.citation_agrees(f, members).collect()} == {1: True, 2: False, 3: True, 4: True, 5: None}
    spans = spark.createDataFrame([(1, 1), (1, 2)], "doc_id int, span int")
    have, need = V.split_decided(spans, spark.createDataFrame([(1, 1, "paraphrase", 0.8)], "doc_id int, span int, label string, confidence double"))
    assert have.count() == 1 and [r.span for r in need.collect()] == [2]


def test_intervals(spark):
    lead = spark.createDataFrame([(1, 10, 20)], "d int, a int, b int")
    follow = spark.createDataFrame([(1, 19, 30), (1, 20, 25), (2, 12, 15)], "d int, a int, b int")
    assert rows(V.merge_intervals(lead, follow, ["d"], 8)) == [(1, 10, 20), (1, 20, 25), (2, 12, 15)]


def test_segments(spark):
    md = "# Title\n\n## One\n\npara a\n\n---\n\n" + "Sentence number x is here. " * 60 + "\n\n## Two\nlast"
    got = D.markdown_segments(spark.createDataFrame([(1, md)], "doc_id int, text string")).orderBy("seg").collect()
    assert got[0].text == "para a" and got[0].section == "One" and got[0].title == "Title" and got[-1].section == "Two"
    long = [r.text for r in got[1:-1]]
    assert all(len(t) <= 800 for t in long) and " ".join(long) == ("Sentence number x is here. " * 60).strip()
    srt = "1\n00:00:01,000 --> 00:00:02,000\n<i>Hello</i>\n\n2\n00:00:03.000 --> 00:00:04.500\nthere\n\n3\n01:00:10,000 --> 01:00:11,000\nlate"
    cues = D.subtitle_segments(spark.createDataFrame([(1, srt)], "doc_id int, text string")).orderBy("seg").collect()
    assert [(c.start, c.end, c.text) for c in cues] == [(1.0, 4.5, "Hello there"), (3610.0, 3611.0, "late")]
    r = spark.createDataFrame([(srt, md)], "a string, b string").select(D.is_subtitle(F.col("a")).alias("a"), D.is_subtitle(F.col("b")).alias("b"), D.route(F.col("b")).alias("r")).first()
    assert (r.a, r.b, r.r) == (True, False, "document")


def test_marks_and_masks(spark):
    docs = spark.createDataFrame([(1, "He said one two and three four."), (2, "plain")], "doc_id int, text string")
    spans = spark.createDataFrame([(1, 5, 8, 15), (1, 6, 12, 17), (1, 7, 20, 30)], "doc_id int, span long, a long, b long")
    pieces = D.marked_pieces(docs, spans)
    by_doc = {}
    for r in pieces.orderBy("doc_id", "piece").collect():
        by_doc.setdefault(r.doc_id, []).append((r.text, r.span))
    assert by_doc == {1: [("He said ", None), ("one two", 5), (" and ", None), ("three four", 7), (".", None)], 2: [("plain", None)]}
    m = {r.doc_id: r for r in D.masked(pieces).withColumn("back", D.restored(F.col("masked"), F.col("quotes"))).collect()}
    assert m[1].masked == "He said ⟦0⟧ and ⟦1⟧." and m[1].back == "He said one two and three four." and m[2].back == "plain"


def test_batches_terms_titles(spark):
    seg = spark.createDataFrame([(1, k, "x" * n) for k, n in enumerate((30, 30, 50, 90, 10))], "doc_id int, seg int, text string")
    assert [r.batch for r in D.size_batches(seg, 100).orderBy("seg").collect()] == [0, 0, 1, 2, 2]
    terms = spark.createDataFrame([("t1", "Iman", False), ("t2", "salah", True)], "term string, form string, lower_only boolean")
    got = D.tag_terms(spark.createDataFrame([(1, "Salah and salah, iman is IMAN.")], "doc_id int, text string"), terms)
    assert rows(got.select("term", "position")) == [("t1", 3), ("t2", 2)]
    t = spark.createDataFrame([("", "", "my-file_x.md", "op"), (None, None, None, "word " * 30)], "g string, h string, f string, o string").select(D.choose_title(*map(F.col, "ghfo")).alias("t")).collect()
    assert t[0].t == "my file x" and len(t[1].t) <= 70


def test_links(spark):
    def records(pairs):
        return spark.createDataFrame([(i, t.split()) for i, t in pairs], "id int, words array<string>")

    left = records([(1, "a b c d e f g h"), (2, "p q r s t"), (3, "zz yy")])
    right = records([(11, "a b c d e f g x"), (12, "q r s t u v w"), (13, "b c d e")])
    assert {(r.left_id, r.right_id) for r in L.text_links(left, right).collect()} == {(1, 11), (2, 12), (1, 13)}
    ranks = spark.createDataFrame([(11, 2), (12, 1), (13, 1)], "id int, rank int")
    links = L.copy_links(left, right, ranks)
    assert [(r.copy, r.source) for r in links.where("rank = 1").orderBy("copy").collect()] == [(1, 13), (2, 12)]
    grades = spark.createDataFrame([(13, "sahih"), (12, "hasan")], "unit int, grade string")
    assert rows(L.inherited_grades(links, grades).select("unit", "via", "grade")) == [(1, 13, "sahih"), (2, 12, "hasan")]
    members = spark.createDataFrame([(13, "f", True, 1), (20, "f", False, 2), (21, None, False, 3)], "unit int, family_id string, core boolean, ord int")
    assert rows(L.borrowed_grades(members, grades).select("unit", "via", "grade")) == [(20, 13, "sahih")]
    claims = spark.createDataFrame([("g1", "h", 0.9), ("g2", "h", 0.8), ("g3", "k", 0.7)], "guest string, host string, score double")
    assert rows(L.split_claims(claims).select("guest", "key", "parallel_of")) == [("g1", "h", None), ("g2", "h.s2", "h"), ("g3", "k", None)]
    assert rows(L.presence(spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "id int, gram string"), spark.createDataFrame([("a",)], "gram string"))) == [(1, "some"), (2, "none")]


def test_numbers_resolved(spark):
    refs = spark.createDataFrame([(1, "c", "10a", 10), (2, "c", "10b", 10), (3, "c", "99", 99), (4, "c", "55", 55)], "ref int, collection string, number string, number_base int")
    recs = spark.createDataFrame([("c", 10, "10a", 1, "c:10a"), ("c", 10, "10c", 2, "c:10c")], "collection string, number_base int, number string, ord int, key string")
    ptr = spark.createDataFrame([("c", "99", "d:1")], "collection string, number string, source_key string")
    got = {r.ref: (r.key, r.resolved_by) for r in R.resolve_numbers(refs, recs, ptr).collect()}
    assert got == {1: ("c:10a", "number"), 2: ("c:10a", "base"), 3: ("d:1", "pointer"), 4: (None, None)}


def test_evaluation(spark):
    passages = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve")], "item_id long, text string")
    planted = E.mutate(passages, F.split("text", " ")).withColumn("text", F.array_join("words", " "))
    docs = planted.select(F.row_number().over(__import__("pyspark").sql.Window.orderBy("recipe")).cast("long").alias("doc_id"), "text", "recipe", "expect")
    found = V.verify(passages, docs).join(docs, "doc_id")
    got = {r.recipe: r.status for r in found.collect()}
    assert got["whole"] == "verbatim" and "foreign" not in got
    e = spark.createDataFrame([(1, 1, ["a", "b"]), (1, 2, ["c", "d"])], "doc_id int, id int, words array<string>")
    f = spark.createDataFrame([(1, 7, ["a", "b", "x"]), (1, 8, ["c"])], "doc_id int, id int, words array<string>")
    assert rows(E.assign(e, f).select("item", "finding")) == [(1, 7), (2, 8)]
    r = spark.createDataFrame([("r", 1, "verbatim", ["k"], "verbatim", "k", None, None, None, None), ("r", 2, "not_found", [], None, None, None, None, None, None), ("r", 2, "verbatim", ["k"], "misquote", "z", "x", "g", True, False)],
                              "arm string, run int, status string, keys array<string>, got_status string, got_key string, grade string, got_grade string, agrees boolean, got_agrees boolean")
    s = E.score_rows(r)
    top = E.summary(s, ["arm"]).first()
    assert (top["items"], top.detected, top.status, top.source, top.invented, top.abstention, top.citation) == (3, 100.0, 66.7, 50.0, 100.0, 100.0, 0.0)
    assert E.spread(E.summary(s, ["arm", "run"]), ["status", "source"]).first().status == "50.0–100.0"
    assert {x.status: x.r for x in E.status_matrix(s, ["r"]).collect()} == {"verbatim": 50.0, "not_found": 100.0}


def test_sources(spark, tmp_path):
    book = {"book": {"alias": "b"}, "chapters": [{"title": {"en": "C"}, "items": [{"ref": "b:1", "number": "1", "text": {"en": "x"}}], "sections": [{"title": {"en": "S"}, "items": [{"ref": "b:2", "number": "2", "text": {"en": "y"}}, {"ref": "b:1", "number": "1", "text": {"en": "again"}}], "subsections": [{"title": {"en": "U"}, "items": [{"ref": "b:3", "number": "3", "source": {"ref": "o:9"}}]}]}]}]}
    (tmp_path / "book.json").write_text(json.dumps(book))
    df = readers.nested_book(spark, str(tmp_path / "book.json"))
    assert {r.ref: r.trail for r in df.collect()} == {"b:1": ["C"], "b:2": ["C", "S"], "b:3": ["C", "S", "U"]}
    assert rows(readers.text_leaves(df).select("ref")) == [("b:1",), ("b:2",)] and rows(readers.pointers(df).select("key", "source_key")) == [("b:3", "o:9")]
    for lang in ("ar", "en"):
        (tmp_path / f"{lang}.json").write_text(json.dumps({"metadata": {"name": "n", "sections": {"1": "First"}}, "hadiths": [{"hadithnumber": k, "text": f"{lang}{k}", "grades": [], "reference": {"book": 1, "hadith": k}} for k in range(1, 4 if lang == "ar" else 3)]}))
    e = readers.editions(spark, {x: str(tmp_path / f"{x}.json") for x in ("ar", "en")})
    assert rows(e.select("number", "text_ar", "text_en", "section")) == [(1.0, "ar1", "en1", "First"), (2.0, "ar2", "en2", "First"), (3.0, "ar3", None, "First")]
    (tmp_path / "p.json").write_text(json.dumps({"data": [{"collection": "c", "hadithNumber": "1", "bookNumber": "1", "chapterId": "2", "hadith": [{"lang": "ar", "body": "A", "urn": 1, "grades": []}, {"lang": "en", "body": "E", "urn": 2, "grades": [{"graded_by": "x", "grade": "y"}]}]}]}))
    assert rows(readers.api_pages(spark, str(tmp_path / "p.json")).select("number", "body_ar", "body_en", "urn_en")) == [("1", "A", "E", 2)]
    wiki = spark.createDataFrame([(1, "intro\n== Body ==\ntext\n== References ==\nref\n== More ==\nend")], "doc_id int, text string")
    assert [r.text for r in readers.wiki_text(wiki).orderBy("line").collect()] == ["intro", "== Body ==", "text", "== More ==", "end"]
    units = spark.createDataFrame([("a", "T", "body", "said"), ("b", None, "other", None)], "key string, title string, text string, part string")
    req = sinks.requests(units, F.col("title"), F.col("text"), F.col("part"))
    assert ("a", "title: T | text: body") in rows(req) and req.count() == 3
    sinks.write_requests(req, str(tmp_path / "out"), 2)
    (tmp_path / "res.json").write_text('{"id": "a", "v": 1}\n{"id": "zz", "v": 2}\n')
    good, failed = sinks.read_results(spark, str(tmp_path / "out"), str(tmp_path / "res.json"), "id string, v int")
    assert rows(good) == [("a", 1)] and rows(failed) == [("a#p",), ("b",)]
    now = F.timestamp_millis(F.lit(0))
    sinks.write_versioned(units, str(tmp_path / "store"), "v1", now, 7)
    assert sinks.read_versioned(spark, str(tmp_path / "store"), "v1", now).count() == 2 and sinks.read_versioned(spark, str(tmp_path / "store"), "v1", now + F.expr("interval 8 days")).count() == 0


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(1, "k", "2024-01-01 00:10:00", "same text"), (2, "k", "2024-01-01 00:20:00", "same text"), (3, "k", "2024-01-01 01:20:00", "other")], "id int, key string, t string, text string").withColumn("ts", F.to_timestamp("t")).write.parquet(str(src))
    stream = lambda: spark.readStream.schema("id int, key string, t string, text string, ts timestamp").parquet(str(src))

    def result(df, name, mode):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination(60)
        return spark.table(name)

    assert result(streams.first_seen(stream(), "text", "ts"), "seen", "append").count() == 2
    words = " ".join(f"word{k}" for k in range(12))
    spark.createDataFrame([(1, "x " + words)], "doc_id long, text string").write.parquet(str(tmp_path / "seg"))
    found = []
    q = streams.check_segments(spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "seg")), spark.createDataFrame([(5, words)], "item_id long, text string"), lambda df, n: found.extend(df.collect()), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert [(r.doc_id, r.item_id, r.status) for r in found] == [(1, 5, "verbatim")]
