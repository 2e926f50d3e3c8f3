"""Stateful streams, keyed tables, saved indexes and folders of texts."""

import glob
import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from citeweave.functions.text import latin_words
from citeweave.operators import retrieve as I
from citeweave.operators import verify as V
from citeweave.plans.materialize import materialize
from citeweave.sources import readers, sinks
from citeweave.streaming import state, streams


@pytest.fixture(scope="module", autouse=True)
def rocksdb(spark):
    names = ("spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions")
    before = {n: spark.conf.get(n, None) for n in names}
    state.use_rocksdb(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "1")  # a state store a batch, not many
    yield
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


class Feed:
    """A folder that gets a file a batch, and a query over it that goes on from its checkpoint."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema, self.n = spark, folder, schema, 0
        os.makedirs(folder / "in")

    def add(self, made):
        self.n += 1
        self.spark.createDataFrame(made, self.schema).coalesce(1).write.parquet(str(self.folder / "tmp"))
        (part,) = glob.glob(str(self.folder / "tmp" / "part-*"))
        shutil.move(part, str(self.folder / "in" / f"{self.n:03}.parquet"))
        shutil.rmtree(self.folder / "tmp")

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(str(self.folder / "in"))

    def run(self, df):
        got = []
        q = df.writeStream.foreachBatch(lambda b, _: got.extend(tuple(r) for r in b.collect())).option("checkpointLocation", str(self.folder / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(180)
        return got


def test_keys_expire_without_rows_of_their_own(spark, tmp_path):
    """Restarts go on from the checkpoint; a renewed key lives on; late rows are dropped."""
    feed = Feed(spark, tmp_path, "key string, ts timestamp")
    at = lambda t: __import__("datetime").datetime.fromisoformat(f"2024-01-0{t}")
    form = lambda got: sorted((k, str(t)[8:16], live) for k, t, live in got)
    query = lambda: state.expiring(feed.stream(), "key", "ts", "1 day")
    feed.add([("a", at("1 00:00")), ("b", at("1 06:00"))])
    assert form(feed.run(query())) == [("a", "01 00:00", True), ("b", "01 06:00", True)]
    feed.add([("b", at("1 20:00"))])
    feed.add([("c", at("2 03:00"))])  # the watermark passes a's day
    got = form(feed.run(query()))
    assert ("b", "01 20:00", True) in got and ("a", "01 00:00", False) in got and not any(k == "b" and not live for k, _, live in got)
    feed.add([("d", at("4 00:00"))])
    feed.add([("a", at("1 01:00")), ("d", at("4 01:00"))])  # a's row is late
    got = form(feed.run(query()))
    assert ("b", "01 20:00", False) in got and ("c", "02 03:00", False) in got and not any(k == "a" for k, _, _ in got)


def test_results_are_kept(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else a time to live asks for batches for ever
    feed = Feed(spark, tmp_path, "key string, value string")
    feed.add([("a", "1"), ("b", "2")])
    assert sorted(feed.run(state.cached_results(feed.stream(), "key", "value", "1 hour"))) == [("a", "1", False), ("b", "2", False)]
    feed.add([("a", "9"), ("c", "3"), ("c", "4")])
    assert sorted(feed.run(state.cached_results(feed.stream(), "key", "value", "1 hour"))) == [("a", "1", True), ("c", "3", False), ("c", "3", True)]
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def test_quotations_over_the_border_of_segments(spark, tmp_path):
    """What a stream of segments, cut anywhere and partly out of order, finds is what whole documents give."""
    rng = random.Random(6)
    word = lambda: f"w{rng.randint(0, 4000)}"
    passages = [(k, " ".join(word() for _ in range(rng.randint(8, 20)))) for k in range(6)]
    texts = {d: [word() for _ in range(60)] for d in range(4)}
    for d, k, at in ((0, 0, 10), (0, 1, 40), (1, 2, 5), (2, 3, 30), (2, 0, 55), (3, 4, 0)):
        texts[d][at:at] = passages[k][1].split()
    feed = Feed(spark, tmp_path, "doc_id long, seg long, text string, ts timestamp")
    when = __import__("datetime").datetime(2024, 1, 1)
    made = [(d, seg, " ".join(words[i : i + 9]), when) for d, words in texts.items() for seg, i in enumerate(range(0, len(words), 9))]
    made[2], made[3] = made[3], made[2]
    for k in range(0, len(made), 8):
        feed.add(made[k : k + 8])
    found = []
    p = spark.createDataFrame(passages, "item_id long, text string")
    q = streams.check_segments(feed.stream(), p, lambda df, n: found.extend(df.collect()), str(tmp_path / "cp"), "ts")
    q.awaitTermination(400)
    whole = V.verify(p, spark.createDataFrame([(d, " ".join(w)) for d, w in texts.items()], "doc_id long, text string"))
    want = {(r.doc_id, r.item_id, r.first_word) for r in whole.where("status = 'verbatim'").collect()}
    assert len(want) == 6
    assert {(r.doc_id, r.item_id, r.first_word) for r in found if r.status == "verbatim"} == want


def files_of(path):
    return {os.path.basename(f): os.path.dirname(f) for f in glob.glob(f"{path}/_bucket=*/part-*")}


def test_changes_touch_only_their_parts(spark, tmp_path):
    path, keys = str(tmp_path / "t"), ["k"]
    sinks.write_keyed(spark.createDataFrame([(f"k{i}", i, "old") for i in range(200)], "k string, v long, s string"), path, keys, 16)
    before = files_of(path)
    new = spark.createDataFrame([("k3", 33, "new"), ("k3", 34, "again"), ("k999", 1, "new"), (None, 5, "null")], "k string, v long, s string")
    touched = sinks.upsert_keyed(spark, path, new, keys, ["v"], 16)
    after = files_of(path)
    assert 1 <= touched <= 3 and len(set(before.values()) - {before[f] for f in before if f in after}) <= touched  # all other files keep their names
    got = {r.k: (r.v, r.s) for r in sinks.read_keyed(spark, path).collect()}
    assert len(got) == 202 and got["k3"] == (33, "new") and got["k999"] == (1, "new") and got[None] == (5, "null") and got["k4"] == (4, "old")
    assert sinks.backfill_keyed(spark, path, spark.createDataFrame([("k4", "filled")], "k string, s string"), "k", "s", 16) == 1
    assert {r.k: r.s for r in sinks.read_keyed(spark, path).collect()}["k4"] == "filled"
    other = str(tmp_path / "u")
    sinks.write_keyed(spark.createDataFrame([("k4", "x"), ("k5", "y")], "k string, w string"), other, keys, 16)
    gone = spark.createDataFrame([("k4",), ("nothing",)], "k string")
    assert sinks.delete_keyed(spark, [path, other], gone, keys, 16) <= 4
    assert "k4" not in {r.k for r in sinks.read_keyed(spark, path).collect()} and rows(sinks.read_keyed(spark, other)) == [("k5", "y")]
    assert sinks.upsert_keyed(spark, path, new.limit(0), keys, ["v"], 16) == 0


def test_search_from_a_saved_index(spark, sf):
    """The saved postings give what the units themselves give; the rarest tokens alone are asked where that is said."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("key"), "text")
    sinks.write_index(docs, {"words": latin_words(F.col("text")), "heads": F.transform(latin_words(F.col("text")), lambda w: F.substring(w, 1, 4))}, "saved_texts", 4)
    items = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("query"), latin_words(F.col("text")).alias("words"))
    index, lengths = sinks.read_index(spark, "saved_texts", "words")
    got = I.search_index(index, lengths, items, 5)
    want = I.bm25(items.select("query", F.explode(F.array_distinct("words")).alias("token")), docs.select("key", latin_words(F.col("text")).alias("words")), 5)
    top = lambda df: {(r.query, r["rank"]): round(r.score, 4) for r in df.collect()}
    assert top(got) == top(want)
    few = I.search_index(index, lengths, items, 5, tokens=3, max_share=0.1)
    assert few.count() and few.agg(F.max("score")).first()[0] <= got.agg(F.max("score")).first()[0]
    for t in ("postings", "lengths", "df"):
        spark.sql(f"DROP TABLE saved_texts_{t}")


def test_folder_of_texts(spark, tmp_path):
    folder = tmp_path / "texts"
    os.makedirs(folder / "deep")
    (folder / "a.md").write_text("# Title\n\n## Part\n\nFirst words.\n\nSecond words.\n")
    (folder / "b.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\nHello\n\n2\n00:00:03,000 --> 00:00:04,500\nthere\n")
    (folder / "deep" / "c.txt").write_text("Body line\n== References ==\ngone\n== More ==\nstays")
    files = readers.text_files(spark, str(folder))
    name = F.element_at(F.split("doc_id", "/"), -1)
    assert rows(files.select(name, "kind")) == [("a.md", "markdown"), ("b.srt", "subtitle"), ("c.txt", "wiki")]
    got = rows(readers.file_segments(files).select(name, "seg", "section", "start", "text"))
    assert ("a.md", 0, "Part", None, "First words.") in got and ("b.srt", 0, None, 1.0, "Hello there") in got
    assert [r[4] for r in got if r[0] == "c.txt"] == ["Body line", "== More ==", "stays"]
    q = readers.text_files(spark, str(folder), stream=True).writeStream.format("memory").queryName("arrived").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert rows(spark.table("arrived").select(name, "kind")) == rows(files.select(name, "kind"))


def test_index_of_a_plan(spark):
    """Queries without a hit, and an index without units."""
    empty = spark.createDataFrame([], "token string, key long, tf long"), spark.createDataFrame([], "key long, length long")
    asked = spark.createDataFrame([(1, ["a"]), (2, [])], "query int, words array<string>")
    assert I.search_index(*empty, asked, 3).count() == 0
    index = materialize(spark.createDataFrame([("a", 1, 2), ("b", 2, 1)], "token string, key long, tf long"))
    assert [(r.query, r.key) for r in I.search_index(index, spark.createDataFrame([(1, 2), (2, 1)], "key long, length long"), asked, 3).collect()] == [(1, 1)]
