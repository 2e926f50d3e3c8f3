"""Substring dedup: recurring passages, sharded Aho-Corasick automata, and every occurrence of them.

A window is 50 consecutive words. Each window has an anchor: of its 8-word phrases the one with the least hash. Equal
windows have equal anchors at equal places, so only windows with one anchor can be equal, and the windows of a text that
share an anchor form a run, about one for every 22 words. A run is a row of a few numbers.

Runs whose anchor stands in two documents are candidates. Equal runs, and windows of runs that differ, say which
document has a passage first; neighbouring stretches with the same source are joined, and so give the recurring passages
and where they are expected. The passages are cut from their first documents and compiled into automata shard by shard,
and the text of every expected occurrence is streamed through the automaton of its passage: hashes only propose, and no
word is removed that an automaton has not found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeweave.llm.common import materialize

WINDOW, PHRASE = 50, 8
#: Low bits of a packed anchor hold its position; a longer text is taken in pieces.
PLACE_BITS = 26
PIECE = (1 << PLACE_BITS) - WINDOW
#: Rows of one key that a task takes; more frequent keys are joined by broadcast, and passages salted.
HOT = 4096
#: Words of the passages of an automaton, and texts that it streams, on average.
SHARD_WORDS, SHARD_TEXTS = 200_000, 10_000
_BASE = 0x9E3779B97F4A7C15


class _Words(dict):
    """64-bit hash of a word, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 3)
        return h


_WORDS = _Words()
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    if len(_POWERS[0]) <= n:
        size, inverse = max(2 * n, 1 << 14), pow(_BASE, -1, 1 << 64)
        for k, b in enumerate((_BASE, inverse)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _prefix(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers(len(words) + 1)
    x = np.array(list(map(_WORDS.__getitem__, words)), np.uint64)
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(x * up[: len(words)]))), down


def _hashes(prefix: np.ndarray, down: np.ndarray, start: np.ndarray, size) -> np.ndarray:
    return _mixed((prefix[start + size] - prefix[start]) * down[start])


def _sliding_min(v: np.ndarray, m: int) -> np.ndarray:
    size = 1
    while 2 * size <= m:
        v, size = np.minimum(v[:-size], v[size:]), 2 * size
    return np.minimum(v[: len(v) - (m - size)], v[m - size :]) if size < m else v


def runs(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, hash of the whole run, first word and number of words of each run of windows with one anchor."""
    found = []
    for at in range(0, max(1, len(words) - WINDOW + 1), PIECE):
        part = words[at : at + PIECE + WINDOW - 1]
        n = len(part) - WINDOW + 1
        if n < 1:
            continue
        prefix, down = _prefix(part)
        phrase = _hashes(prefix, down, np.arange(len(part) - PHRASE + 1), PHRASE)
        mask = np.uint64((1 << PLACE_BITS) - 1)
        packed = (phrase & ~mask) | np.arange(len(phrase), dtype=np.uint64)
        anchor = (_sliding_min(packed, WINDOW - PHRASE + 1) & mask).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        size = np.diff(np.append(first, n)) - 1 + WINDOW
        whole = _hashes(prefix, down, first, size) ^ _mixed((anchor[first] - first).astype(np.uint64) * np.uint64(1000003) + size.astype(np.uint64))
        found.append((phrase[anchor[first]].view(np.int64), whole.view(np.int64), first + at, size))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else tuple(np.zeros(0, np.int64) for _ in range(4))


def _split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").split()  # on bytes this takes ASCII white space only


def _sliced(batches: Iterator[pa.RecordBatch], rows: int = 200) -> Iterator[pa.RecordBatch]:
    """The batches in parts of which few rows are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _sliced(batches):
        out = [[], [], [], [], [], []]
        for doc, mark, text in zip(*(c.to_pylist() for c in batch.columns)):
            if doc is None:
                continue
            got = runs(_split(text))
            for k, x in enumerate((*got, np.full(len(got[0]), doc), np.full(len(got[0]), mark))):
                out[k].append(x)
        if out[0]:
            a, w, s, n, d, m = (np.concatenate(x) for x in out)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(w), pa.array(s.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(d.astype(np.int64)), pa.array(m.astype(np.int64))], names=["anchor", "run", "start", "size", "doc_id", "mark"])
    _WORDS.clear()


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, mark, text, asked) into the windows of the runs asked for, with their place in the run and in the document."""
    names = ["anchor", "run", "h", "place", "doc_id", "mark", "start", "last_doc"]
    for batch in _sliced(batches):
        out: list[list[np.ndarray]] = [[] for _ in names]
        for doc, mark, text, asked in zip(*(c.to_pylist() for c in batch.columns)):
            words = _split(text)
            for a in asked:
                prefix, down = _prefix(words[a["start"] : a["start"] + a["size"]])
                place = np.arange(a["size"] - WINDOW + 1)
                h = _hashes(prefix, down, place, WINDOW).view(np.int64)
                for k, x in enumerate((a["anchor"], a["run"], h, place, doc, mark, place + a["start"], a["last_doc"])):
                    out[k].append(x if isinstance(x, np.ndarray) else np.full(len(h), x, np.int64))
        if out[0]:
            kinds = {"place": np.int32, "start": np.int32}
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(kinds.get(n, np.int64))) for n, x in zip(names, out)], names=names)
    _WORDS.clear()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, mark, text, asked) into the stretches asked for, with their words."""
    kinds = {"kind": pa.int32(), "doc_id": pa.int64(), "mark": pa.int64(), "start": pa.int32(), "shards": pa.list_(pa.int32()), "words": pa.string()}
    for batch in _sliced(batches):
        out = []
        for doc, mark, text, asked in zip(*(c.to_pylist() for c in batch.columns)):
            words = _split(text)
            out += [(a["kind"], doc, mark, a["start"], a["shards"], b" ".join(words[a["start"] : a["start"] + a["length"]]).decode()) for a in asked]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds.values())], names=list(kinds))


def _located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams texts through the automaton of their shard. Rows are (shard, kind, doc_id, mark, start, words), sorted by
    shard and kind: kind 0 is a passage with the first document that has it, kind 1 a text. Gives (doc_id, mark, start, size) to remove."""
    shard, auto = None, None
    first: dict[tuple, int] = {}
    ids: dict[bytes, int] = {}
    for batch in _sliced(batches):
        out = []
        for s, kind, doc, mark, start, text in zip(*(c.to_pylist() for c in batch.columns)):
            if s != shard:
                shard, auto = s, None
                first.clear(), ids.clear()
            words = _split(text)
            if kind == 0:
                key = tuple(ids.setdefault(w, len(ids) + 1) for w in words)
                first[key] = min(doc, first.get(key, doc))
                continue
            if auto is None:
                auto = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
                for key, d in first.items():
                    auto.add_word(key, (len(key), d))
                auto.make_automaton()
            spans = sorted((end - n + 1, end + 1) for end, (n, d) in auto.iter(tuple(ids.get(w, 0) for w in words)) if d < doc)
            upto = -1
            for a, b in spans:
                if a > upto:
                    out.append([doc, mark, start + a, b - a])
                elif b > upto:
                    out[-1][3] += b - upto
                upto = max(upto, b)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["doc_id", "mark", "start", "size"])


def _joined(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame) -> DataFrame:
    """`left` joined with `right`. The keys in `hot`, of which there are few, have too many rows on the left for one task: their right rows are broadcast."""
    hot = F.broadcast(hot.select(*keys))
    cold = left.join(hot, keys, "left_anti").join(right, keys)
    return cold.unionByName(left.join(F.broadcast(right.join(hot, keys, "left_semi")), keys))


def _per_document(asked: DataFrame, fields: list) -> DataFrame:
    """Row per document with all that is asked of its text; no more than the text has places."""
    return asked.groupBy("doc_id", "mark").agg(F.collect_list(F.struct(*fields)).alias("asked"))


def _stretches(rows: DataFrame, shared: DataFrame, distinct: DataFrame, hot: int) -> DataFrame:
    """(anchor, run, place, length, source, source_mark, source_start): stretches of a run that a document has first, and where."""
    whole = distinct.where("not varied and doc_id < last_doc").select("anchor", "run", F.lit(0).alias("place"), F.col("size").alias("length"), F.col("doc_id").alias("source"), F.col("mark").alias("source_mark"), F.col("start").alias("source_start"))
    asked = _per_document(distinct.where("varied"), ["anchor", "run", "start", "size", "last_doc"])
    read = rows.join(asked, ["doc_id", "mark"]).select("doc_id", "mark", "text", "asked")
    windows = materialize(read.mapInArrow(_windows, "anchor long, run long, h long, place int, doc_id long, mark long, start int, last_doc long"))
    first = windows.groupBy("anchor", "h").agg(F.min(F.struct("doc_id", "mark", "start")).alias("w"), F.max("last_doc").alias("last_doc"), F.count("*").alias("n"))
    first = materialize(first.where(F.col("w.doc_id") < F.col("last_doc")))
    placed = _joined(windows.select("anchor", "h", "run", "place"), first.select("anchor", "h", "w"), ["anchor", "h"], first.where(F.col("n") > hot))
    # windows of a run are fewer than words of a window: those with one source and shift join
    placed = placed.groupBy("anchor", "run", F.col("w.doc_id").alias("source"), F.col("w.mark").alias("source_mark"), (F.col("w.start") - F.col("place")).alias("shift"))
    placed = placed.agg(F.min("place").alias("place"), (F.max("place") - F.min("place") + WINDOW).alias("length"))
    return materialize(whole.unionByName(placed.withColumn("source_start", F.col("shift") + F.col("place")).drop("shift")))


def _passages(occurrences: DataFrame) -> DataFrame:
    """Neighbouring stretches of a document joined where their sources are neighbours too."""
    same = ["doc_id", "mark", "source", "source_mark", "shift"]
    along = Window.partitionBy(*same).orderBy("start", "length")
    df = occurrences.withColumn("shift", F.col("start") - F.col("source_start")).withColumn("end", F.col("start") + F.col("length"))
    apart = F.col("start") > F.coalesce(F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    df = df.withColumn("apart", apart.cast("int")).withColumn("passage", F.sum("apart").over(along))
    df = df.groupBy(*same, "passage").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return df.select("doc_id", "mark", "start", (F.col("end") - F.col("start")).alias("length"), "source", "source_mark", (F.col("start") - F.col("shift")).alias("source_start"))


def recurring_spans(rows: DataFrame) -> DataFrame:
    """(doc_id, mark, start, size): words that a window covers which also starts in a document with a smaller doc_id.

    `rows` has doc_id, mark (a hash of the text: rows of one doc_id may differ) and text.
    """
    found = materialize(rows.mapInArrow(_run_rows, "anchor long, run long, start int, size int, doc_id long, mark long"))
    hot = max(HOT, found.count() >> 17)  # of keys with more rows there are at most 2^17
    again = found.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.min("run").alias("x"), F.max("run").alias("y"), F.count("*").alias("n")).where("a < b")
    again = materialize(again.select("anchor", (F.col("x") != F.col("y")).alias("varied"), "n"))
    shared = materialize(_joined(found, again.select("anchor", "varied"), ["anchor"], again.where(F.col("n") > hot)))
    distinct = shared.groupBy("anchor", "run").agg(F.min(F.struct("doc_id", "mark", "start", "size")).alias("p"), F.max("doc_id").alias("last_doc"), F.first("varied").alias("varied"), F.count("*").alias("n"))
    distinct = materialize(distinct.select("anchor", "run", "p.*", "last_doc", "varied", "n"))

    stretches = _stretches(rows, shared, distinct, hot)
    here = _joined(shared.select("anchor", "run", "doc_id", "mark", "start"), stretches, ["anchor", "run"], distinct.where(F.col("n") > hot)).where(F.col("doc_id") > F.col("source"))
    passages = materialize(_passages(here.select("doc_id", "mark", (F.col("start") + F.col("place")).alias("start"), "length", "source", "source_mark", "source_start")))

    key = ["source", "source_mark", "source_start", "length"]
    patterns = materialize(passages.groupBy(*key).agg(F.count("*").alias("n")))
    salts = F.ceil(F.col("n") / hot).cast("int")
    sizes = patterns.agg(F.coalesce(F.sum(F.col("length") * salts), F.lit(0)).alias("words"), F.coalesce(F.sum("n"), F.lit(0)).alias("texts")).first()
    shards = max(1, -(-sizes["words"] // SHARD_WORDS), -(-sizes["texts"] // SHARD_TEXTS))

    def shard(salt: Column) -> Column:
        return F.pmod(F.xxhash64(*key, salt), F.lit(shards)).cast("int")

    # a frequent passage goes to as many shards as its occurrences ask for
    frequent = F.broadcast(patterns.where(F.col("n") > hot).select(*key, salts.alias("salts")))
    texts = passages.join(frequent, key, "left").withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.coalesce("salts", F.lit(1))).cast("int"))
    stretch = lambda kind, own: [F.lit(kind).alias("kind"), "start", "length", own.alias("shards")]
    asked = texts.select("doc_id", "mark", *stretch(1, F.array(shard(F.col("salt")))))
    sources = patterns.select(F.col("source").alias("doc_id"), F.col("source_mark").alias("mark"), F.col("source_start").alias("start"), "length", F.array_distinct(F.transform(F.sequence(F.lit(0), salts - 1), shard)).alias("shards"))
    asked = _per_document(asked.unionByName(sources.select("doc_id", "mark", *stretch(0, F.col("shards")))), ["kind", "start", "length", "shards"])
    cut = rows.join(asked, ["doc_id", "mark"]).select("doc_id", "mark", "text", "asked").mapInArrow(_cut, "kind int, doc_id long, mark long, start int, shards array<int>, words string")
    routed = cut.select(F.explode("shards").alias("shard"), "kind", "doc_id", "mark", "start", "words").repartition("shard").sortWithinPartitions("shard", "kind")
    return routed.mapInArrow(_located, "doc_id long, mark long, start int, size int")


def kept_words(text: str | None, spans) -> tuple[list[bytes], int]:
    """Words of a text outside all (start, size), and the number of all its words."""
    words = _split(text)
    if spans is None or not len(spans):
        return words, len(words)
    gone = np.zeros(len(words) + 1, np.int64)
    for s in spans:
        gone[s["start"]] += 1
        gone[s["start"] + s["size"]] -= 1
    return [w for w, g in zip(words, np.cumsum(gone)) if not g], len(words)


def with_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with a column `_spans`, null where nothing recurs."""
    mark = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), mark.alias("mark"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    spans = recurring_spans(rows.select("doc_id", "mark", "text")).groupBy("doc_id", "mark").agg(F.collect_set(F.struct("start", "size")).alias("_spans"))
    spans = spans.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "_spans")
    marked = docs.withColumn("_own", mark)
    return marked.join(spans, (marked[doc_id].cast("long") == spans["_id"]) & (marked["_own"] == spans["_mark"]), "left").drop("_id", "_mark", "_own")


def substring_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Row per input row: doc_id, n_words, n_removed and kept_sha256 of the kept words joined by one space.

    A word goes if a window of 50 words covers it that also starts in a document with a smaller doc_id; windows are
    those of the input. Null is the empty text. Texts under 50 words keep all; so do rows with a null doc_id, which do
    not count as a first place either. Rows of one doc_id are one document's: they never remove from one another. An
    empty table gives an empty table; other columns are not read.
    """
    df = with_spans(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))

    @F.pandas_udf("n_words long, n_removed long, kept_sha256 string")
    def judged(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for x, s in zip(texts, spans):
            kept, n = kept_words(x, s)
            out.append((n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        return pd.DataFrame(out, columns=["n_words", "n_removed", "kept_sha256"])

    return df.select("doc_id", judged("text", "_spans").alias("j")).select("doc_id", "j.n_words", "j.n_removed", "j.kept_sha256")


def remove_recurring(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with the recurring words taken out of `text`. A text that loses none stays as it is, white space included."""
    @F.pandas_udf("string")
    def kept(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([x if s is None else b" ".join(kept_words(x, s)[0]).decode() for x, s in zip(texts, spans)], dtype=object)

    df = with_spans(docs, doc_id, text)
    return df.withColumn(text, kept(F.col(text), F.col("_spans"))).select(*docs.columns)
