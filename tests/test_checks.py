"""Checking of spans, exact containment, group ranks and stateful streams on small tables worked by hand."""

import random
from collections import Counter

from pyspark.sql import functions as F

from citeweave.operators import common as C
from citeweave.operators import evaluate as E
from citeweave.operators import records as R
from citeweave.operators import verify as V
from citeweave.plans.materialize import materialize, release, shared_dir
from citeweave.streaming import streams


def test_windows_cross_the_border_of_units(spark):
    verses = [(f"1:{k}", 1, k, [f"v{k}w{j}" for j in range(6)]) for k in range(1, 8)]
    units = spark.createDataFrame(verses, "key string, grp int, ord int, words array<string>")
    over = verses[2][3][3:] + verses[3][3] + verses[4][3][:2]
    spoken = spark.createDataFrame([(1, "1:3", over), (1, "1:4", over), (2, "1:7", ["v7w1", "v7w2", "v7w3"]), (3, "1:1", ["none", "of", "these"])], "span int, key string, words array<string>")
    got = {(r.span, r.key): r for r in V.aligned_windows(spoken, units).collect()}
    assert set(got) == {(1, "1:3"), (2, "1:7"), (3, "1:1")}  # both candidates of span 1 cover the same units
    assert got[1, "1:3"].covered == ["1:3", "1:4", "1:5"] and got[1, "1:3"].a.similarity == 1.0
    assert got[2, "1:7"].covered == ["1:7"] and got[3, "1:1"].covered == ["1:1"] and got[3, "1:1"].a.similarity == 0


def test_check_spans(spark):
    a, b = "to be or not to be that is the question".split(), "all that glitters is not gold says the old song".split()
    units = spark.createDataFrame([("A", a, True, 1, "sahih"), ("A2", a[:9], False, 2, "sahih"), ("B", b, True, 1, "daif")], "key string, words array<string>, graded boolean, source_rank int, grade_status string")
    spans = spark.createDataFrame([(1, a, False), (2, b, False), (3, ["quite", "other", "words"], False), (4, ["quite", "other", "words"], True), (5, a[:5] + ["maybe"] + a[6:], False)], "span int, words array<string>, optional boolean")
    hits = spark.createDataFrame([(1, "A", 1), (1, "B", 2), (2, "B", 1), (3, "A", 1), (4, "A", 1), (5, "A", 1), (5, "A2", 2)], "span int, key string, rank int")
    cited = spark.createDataFrame([(1, "A2"), (2, "A")], "span int, key string")
    got = {r.span: r for r in V.check_spans(spans, [hits, hits], cited, units).collect()}
    assert set(got) == {1, 2, 3, 5}  # an optional span without a match is left out
    assert (got[1].key, got[1].closest, got[1].status) == ("A2", "A", "paraphrase")  # the source that is named, and the one that is verbatim
    assert (got[2].key, got[2].text_status, got[2].status, got[2].confidence) == ("B", "verbatim", "weak_or_disputed", 1.0)
    assert (got[3].key, got[3].status) == (None, "not_found")
    assert got[5].key == "A" and got[5].status == "misquote" and "maybe" in got[5].difference


def test_meaning(spark):
    spans = spark.createDataFrame([(1,), (2,), (3,)], "span int")
    hits = spark.createDataFrame([(s, k, n) for s in (1, 2, 3) for n, k in enumerate("ABCDEF", 1)], "span int, key string, rank int")
    picks = spark.createDataFrame([(1, "B", 0.9), (2, "F", 0.9), (3, "A", 0.5)], "span int, key string, confidence double")
    got = {r.span: (r.key, r.status) for r in V.meaning_findings(spans, [hits], picks).collect()}
    assert got == {1: ("B", "meaning"), 2: (None, "not_found"), 3: (None, "not_found")}


def test_contained_passages_of_any_length(spark):
    passages = [(1, "fourteen"), (2, "one two three four"), (3, "a b c"), (4, "x y"), (5, "one two three four five six"), (6, ""), (7, " two  three "), (8, None), (9, "four\nfive")]
    docs = [(1, "one two three fourteen"), (2, "za b cd"), (3, "say one two three four five six seven"), (4, None), (5, "x y"), (6, "one two  three x"), (7, "four\nfive"), (8, "x  y")]
    got = {(r.doc_id, r.item_id) for r in V.contained(spark.createDataFrame(passages, "item_id int, text string"), spark.createDataFrame(docs, "doc_id int, text string")).collect()}
    assert got == {(d, i) for d, x in docs for i, p in passages if x is not None and p is not None and p in x}


def test_many_passages_in_one_document(spark):
    """A document that quotes ten passages, and one with a chance gram far ahead of the passage, lose nothing."""
    r = random.Random(4)
    words = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    quoted = [words(20) for _ in range(10)]
    long = quoted[0][:4] + words(6000) + quoted[0]
    df = spark.createDataFrame([(1, " . ".join(" ".join(q + words(30)) for q in quoted)), (2, " ".join(long))], "doc_id int, text string")
    passages = spark.createDataFrame([(k, " ".join(q)) for k, q in enumerate([*quoted, words(3)])], "item_id int, text string")
    got = {(x.doc_id, x.item_id): x for x in V.verify(passages, df).collect()}
    assert all((got[1, k].status, got[1, k].similarity) == ("verbatim", 1.0) for k in range(10))
    assert (got[2, 0].status, got[2, 0].first_word) == ("verbatim", 6004)


def test_numbers_and_ranks(spark):
    r = random.Random(1)
    rows = [(r.choice("aab"), r.randrange(50), i) for i in range(500)] + [("hot", 7, 500 + i) for i in range(500)] + [("one", None, 2000), (None, 3, 2001)]
    df = spark.createDataFrame(rows, "g string, v int, id long")
    got = C.numbered(df.where("g is not null"), ["g"], "id", "n", 16).collect()
    for g in ("a", "b", "hot"):
        assert [x.n for x in sorted((x for x in got if x.g == g), key=lambda x: x.id)] == list(range(1, 1 + sum(x[0] == g for x in rows)))
    p = {x.g: x for x in E.percentiles(df, ["g"], "v", {"p0": 0.0, "p50": 0.5, "p100": 1.0}).collect()}
    m = {x.g: x.median for x in E.medians(df, ["g"], "v").collect()}
    for g in ("a", "b", "hot"):
        v = sorted(x[1] for x in rows if x[0] == g)
        assert (p[g].p0, p[g].p50, p[g].p100, p[g].n) == (v[0], v[len(v) // 2], v[-1], len(v))
        assert m[g] == (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2
    assert "one" not in p and E.medians(df.where("g = 'none'"), ["g"], "v").count() == 0


def test_pairs_of_a_frequent_key(spark):
    left = spark.createDataFrame([(2 * i, "hot") for i in range(300)] + [(10_000, "x")], "id long, k string")
    right = spark.createDataFrame([(2 * i + 1, "hot") for i in range(200)] + [(10_001, None)], "id long, k string")
    got = {(x.left_id, x.right_id) for x in R.pair_equal(left, right, "k", "m").collect()}
    assert got == {(2 * i, 2 * i + 1) for i in range(200)}


def test_reports(spark):
    df = spark.createDataFrame([(k, "x" if k % 3 else "y") for k in range(10)], "id int, kind string")
    got = Counter((r.kind, r.n, round(r.share, 2)) for r in E.comparison_report(df, "kind", ["id"]).collect())
    assert got == {("x", 6, 60.0): 3, ("y", 4, 40.0): 3}
    assert {r.family_id: (r.collections, r.members) for r in R.family_sizes(spark.createDataFrame([("f", "a"), ("f", "a"), ("f", "b"), (None, "c")], "family_id string, collection string")).collect()} == {"f": (2, 3)}


def test_released_tables(spark):
    df = materialize(spark.range(5))
    assert df.count() == 5
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert files.exists(path)
    release(spark)
    assert not files.exists(path)


def test_stateful_streams(spark, tmp_path):
    times = ["2024-01-01 00:10:00", "2024-01-01 00:20:00", "2024-01-01 00:40:00", "2024-01-01 01:20:00", "2024-01-03 00:00:00"]
    for k, batch in enumerate(([0, 1], [2, 3], [4])):
        rows = [(i, "k" if i < 4 else "z", times[i]) for i in batch]
        spark.createDataFrame(rows, "id int, key string, t string").withColumn("ts", F.to_timestamp("t")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("id int, key string, t string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def result(df, name):
        q = df.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(240)
        return spark.table(name).collect()

    assert {r.id: r.allowed for r in result(streams.hourly_quota(stream(), "key", "ts", 2, "1 hour"), "allowed_rows")} == {0: True, 1: True, 2: False, 3: True, 4: True}
