"""Toxicity by class-conditional Kneser-Ney models of words in their context.

Labelled texts are counted as pairs of words, by class. A pair that a class shows often enough keeps its own estimate, a
rarer one backs off to the word, which counts by the number of its contexts; at both levels what a class's counts do not
carry is filled from the counts of both classes together. A text is as toxic as its worst passage: the toxic less the
ordinary log-likelihood of so many words, by their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeweave.llm.common import materialize
from citeweave.operators.common import broadcast_if_small

#: Standard errors of a count that are taken off it. Counts up to its square are wholly left to the shared ones.
DISCOUNT = 2.0

#: Words of a passage: about an expression and the words beside it.
PASSAGE = 4

#: Context of a text's first word.
START = -1

#: Bits of the filter of the pairs whose contexts are counted, at most; with more pairs more others pass it and are counted too.
FILTER_BITS = 1 << 27

#: Words that are counted together before they are shuffled, and words of a block of texts.
TOGETHER = 1 << 21

#: Bytes of a model that is broadcast; a larger one is joined.
MODEL_BYTES = 48 << 20

_LOW, _HIGH, _BINS = -4.0, 8.0, 2048


def fold(doc_id: Column) -> Column:
    """crc32 of the decimal id mod 5: 0 is held out, 1 sets the threshold, the rest is counted; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def tokens(text: Column) -> Column:
    """Hashes of the runs of letters of the lower-cased text."""
    return F.transform(F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}]+"), ""), lambda w: F.xxhash64(w))


def pair_key(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Key of a word after another, of the kind of a word's own."""
    x = (h.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (w.astype(np.uint64) + np.uint64(0xD1B54A32D192ED03))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


def discount(c: Column) -> Column:
    return F.least(c.cast("double"), DISCOUNT * F.sqrt(c))


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, the word before each, offsets of the texts) of a column of token lists."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    w = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    h = np.empty_like(w)
    h[1:] = w[:-1]
    h[offsets[:-1][offsets[:-1] < len(w)]] = START
    return w, h, offsets


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, w, t, o) of (words, toxic): the distinct pairs of some texts at a time, with their occurrences in each class."""

    def made(held):
        w, h, toxic = (np.concatenate(x) for x in zip(*held))
        keys = pair_key(h, w)
        order = np.argsort(keys, kind="stable")
        keys, toxic = keys[order], toxic[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        t = np.add.reduceat(toxic, first)
        n = np.diff(np.append(first, len(keys)))
        at = order[first]
        by_word = np.argsort(w[at])  # equal words side by side take less room
        return pa.RecordBatch.from_arrays([pa.array(x[by_word]) for x in (h[at], w[at], t, n - t)], names=["h", "w", "t", "o"])

    held, size = [], 0
    for batch in batches:
        w, h, offsets = _flat(batch.column(0))
        held.append((w, h, np.repeat(batch.column(1).to_numpy().astype(np.int64), np.diff(offsets))))
        size += len(w)
        if size >= TOGETHER:
            yield made(held)
            held, size = [], 0
    if size:
        yield made(held)


def _contexts(batches: Iterator[pa.RecordBatch], wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(h, w, x, t, o) of (words, toxic): the pairs that pass the filter with each word x before them, some texts at a time, and whether in each class."""

    def made(held):
        w, h, x, toxic = (np.concatenate(c) for c in zip(*held))
        keys = pair_key(x, pair_key(h, w))
        order = np.argsort(keys, kind="stable")
        keys, toxic = keys[order], toxic[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        t, o = np.maximum.reduceat(toxic, first), np.maximum.reduceat(1 - toxic, first)
        at = order[first]
        by_pair = np.lexsort((h[at], w[at]))
        return pa.RecordBatch.from_arrays([pa.array(c[by_pair]) for c in (h[at], w[at], x[at], t, o)], names=["h", "w", "x", "t", "o"])

    held, size = [], 0
    for batch in batches:
        w, h, offsets = _flat(batch.column(0))
        x = np.empty_like(h)
        x[1:] = h[:-1]
        x[offsets[:-1][offsets[:-1] < len(w)]] = START
        keep = _passes(wanted, pair_key(h, w))
        toxic = np.repeat(batch.column(1).to_numpy().astype(np.int64), np.diff(offsets))
        held.append((w[keep], h[keep], x[keep], toxic[keep]))
        size += int(keep.sum())
        if size >= TOGETHER:
            yield made(held)
            held, size = [], 0
    if size:
        yield made(held)


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, null, null, null) of pairs that may have enough contexts in a class, and rows (null, w, t, o), parts of the number of contexts of every word."""

    def parts(held):
        w, t, o = (np.concatenate(x) for x in zip(*held))
        words, place = np.unique(w, return_inverse=True)
        sums = (np.bincount(place, weights=x != 0, minlength=len(words)).astype(np.int64) for x in (t, o))
        return pa.RecordBatch.from_arrays([pa.nulls(len(words), pa.int64()), pa.array(words), *map(pa.array, sums)], names=["key", "w", "t", "o"])

    held, size = [], 0
    for batch in batches:
        h, w, t, o = (batch.column(k).to_numpy() for k in range(4))
        often = np.maximum(t, o) > DISCOUNT**2  # there are no more contexts than occurrences
        if often.any():
            none = pa.nulls(int(often.sum()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(pair_key(h[often], w[often])), none, none, none], names=["key", "w", "t", "o"])
        held.append((w, t, o))
        size += len(w)
        if size >= TOGETHER:
            yield parts(held)
            held, size = [], 0
    if size:
        yield parts(held)


def _filter(keys: DataFrame, most_bits: int = FILTER_BITS) -> np.ndarray:
    """A bit for each of `keys` (key), in words of 64; few other keys have theirs set as long as these are few for `most_bits`."""
    slots = max(1, min(most_bits, 1 << (16 * keys.count()).bit_length()) // 64)
    slot = F.shiftrightunsigned("key", 6).bitwiseAND(F.lit(slots - 1)).alias("slot")
    bit = F.expr("shiftleft(1L, cast(key & 63 AS int))")
    table = keys.groupBy(slot).agg(F.bit_or(bit).alias("bits")).toArrow()
    made = np.zeros(slots, dtype=np.uint64)
    made[table.column("slot").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return made


def _passes(made: np.ndarray, keys: np.ndarray) -> np.ndarray:
    k = keys.view(np.uint64)
    return (made[(k >> np.uint64(6)) & np.uint64(len(made) - 1)] >> (k & np.uint64(63))) & np.uint64(1) != 0


@F.pandas_udf(T.LongType())
def _keyed(h: pd.Series, w: pd.Series) -> pd.Series:
    return pd.Series(pair_key(h.to_numpy(), w.to_numpy()))


def language_models(counted: DataFrame) -> DataFrame:
    """(key, llr): log of the toxic over the ordinary probability of each word, and of each pair, with enough contexts in a class.

    `counted` has words (hashes) and toxic (0 or 1). All counts are Kneser-Ney's numbers of contexts, which copies of a text
    do not raise: of a word, the different words before it; of a pair, those before the pair. A class's estimate of a word
    is its discounted count by the class's sum; of a pair, its discounted count by that of its first word. To both, the
    estimate from the counts of both classes is added, with one weight: what is rare in both is equally likely in both and
    left out. Pairs that do not even occur often enough are told apart by a first scan; of the others, and of few besides,
    every word before them is counted by a second one.
    """
    add = lambda c: F.sum(c).alias(c)
    pairs = counted.mapInArrow(_pairs, "h long, w long, t long, o long").groupBy("h", "w").agg(add("t"), add("o"))
    levels = materialize(pairs.mapInArrow(_levels, "key long, w long, t long, o long"))
    words = materialize(levels.where("key is null").groupBy("w").agg(add("t"), add("o")))
    sums = (F.coalesce(F.sum(c), F.lit(0)) for c in ("t", "o"))
    toxic, ordinary, free = words.agg(*sums, F.coalesce(F.sum(discount(F.col("t")) + discount(F.col("o"))), F.lit(0.0))).first()
    shared = free / max(1, toxic + ordinary)
    share = lambda c, total: F.when(total > 0, (F.col(c) - discount(F.col(c))) / total).otherwise(F.lit(0.0))

    def log_ratio(toxic: Column, ordinary: Column) -> Column:
        both = shared * (F.col("t") + F.col("o")) / (toxic + ordinary)
        return (F.log(share("t", toxic) + both) - F.log(share("o", ordinary) + both)).cast("float").alias("llr")

    single = words.where(F.greatest("t", "o") > DISCOUNT**2).select(F.col("w").alias("key"), log_ratio(F.lit(toxic), F.lit(ordinary)))
    contexts = words.select(F.col("w").alias("h"), F.col("t").alias("ht"), F.col("o").alias("ho"))
    wanted = counted.sparkSession.sparkContext.broadcast(_filter(levels.where("key is not null").select("key")))
    before = counted.mapInArrow(lambda batches: _contexts(batches, wanted.value), "h long, w long, x long, t long, o long").groupBy("h", "w", "x").agg(F.max("t").alias("t"), F.max("o").alias("o"))
    often = before.groupBy("h", "w").agg(add("t"), add("o")).where(F.greatest("t", "o") > DISCOUNT**2)
    double = often.join(contexts, "h").select(_keyed("h", "w").alias("key"), log_ratio(F.col("ht"), F.col("ho")))
    return materialize(single.union(double))


class Passages:
    """Scores lists of tokens by a table of keys and their log ratios."""

    def __init__(self, keys: np.ndarray, llr: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.llr = keys[order], np.append(llr[order].astype(np.float64), 0.0)

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether the table has the key, its log ratio or 0)."""
        if not len(self.keys):
            return np.zeros(len(keys), dtype=bool), np.zeros(len(keys))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        found = self.keys[at] == keys
        return found, np.where(found, self.llr[at], 0.0)

    def best(self, lists: pa.Array) -> np.ndarray:
        """For each text the mean log ratio of its passage with the highest, a shorter text counting as one passage."""
        w, h, offsets = _flat(lists)
        paired, of_pair = self.of(pair_key(h, w))
        x = np.concatenate([[0.0], np.cumsum(np.where(paired, of_pair, self.of(w)[1]))])
        best = np.zeros(len(offsets) - 1)
        for k in np.flatnonzero(np.diff(offsets)):
            a, b = offsets[k], offsets[k + 1]
            n = min(PASSAGE, b - a)
            best[k] = np.max(x[a + n : b + 1] - x[a : b + 1 - n]) / PASSAGE
        return best


def _with_scores(batches: Iterator[pa.RecordBatch], passages: Passages) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rest = [batch.column(k) for k in range(1, batch.num_columns)]
        yield pa.RecordBatch.from_arrays([*rest, pa.array(passages.best(batch.column(0)))], names=[*batch.schema.names[1:], "llr"])


def held_model(model: DataFrame, most_bytes: int) -> Broadcast | None:
    """Keys and log ratios of a model of at most `most_bytes`, else nothing."""
    if model.count() > most_bytes // 12:
        return None
    found = model.toArrow()
    return model.sparkSession.sparkContext.broadcast((found.column("key").to_numpy(), found.column("llr").to_numpy()))


def _scored(df: DataFrame, model: DataFrame, held: Broadcast | None) -> DataFrame:
    """`df` (words, ...) with `llr` in place of the words. A model that is not `held` is not broadcast: texts are dealt
    to blocks, the distinct keys of a block are joined with it, and what they find is cogrouped with the block's texts."""
    rest = [f for f in df.schema.fields if f.name != "words"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "llr double"])
    if held is not None:
        return df.mapInArrow(lambda batches: _with_scores(batches, Passages(*held.value)), schema)

    size = df.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    blocks = 1 + size // TOGETHER
    dealt = materialize(df.withColumn("block", F.floor(F.rand(7) * blocks).cast("long")))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, block in enumerate(batch.column(1).to_pylist()):
                w, h, _ = _flat(batch.column(0).slice(k, 1))
                x = np.unique(np.concatenate([w, pair_key(h, w)]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), block)), pa.array(x)], names=["block", "key"])

    wanted = dealt.select("words", "block").mapInArrow(keys, "block long, key long").distinct()
    known = wanted.join(model, "key").select(F.col("block").alias("_block"), "key", "llr")

    def scored(texts: pa.Table, table: pa.Table) -> pa.Table:
        passages = Passages(table.column("key").to_numpy(), table.column("llr").to_numpy())
        texts = texts.drop_columns(["block"])
        return pa.Table.from_batches(list(_with_scores(texts.to_batches(), passages)))

    both = dealt.select("words", *(f.name for f in rest), "block").groupBy("block").cogroup(known.groupBy("_block"))
    return both.applyInArrow(scored, schema)


def threshold(counts: dict[tuple[int, int], int]) -> tuple[float, float]:
    """(threshold, slope) of the logistic curve for counts of (bin, class): fewest wrong verdicts, in the middle of the ties."""
    n = np.zeros((2, _BINS))
    for (k, toxic), m in counts.items():
        n[toxic, k] += m
    edges = np.linspace(_LOW, _HIGH, _BINS + 1)
    if not n[0].sum() or not n[1].sum():
        return _HIGH, 1.0
    wrong = np.concatenate([[0], np.cumsum(n[1])]) + np.concatenate([np.cumsum(n[0][::-1])[::-1], [0]])
    best = np.flatnonzero(wrong == wrong.min())
    last = next((k for k in range(1, len(best)) if best[k] != best[k - 1] + 1), len(best)) - 1
    at = (edges[best[0]] + edges[best[last]]) / 2
    x, slope = (edges[:-1] + edges[1:]) / 2 - at, 1.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * x, -30, 30)))
        up = (n[1] * x).sum() - ((n[0] + n[1]) * p * x).sum()
        slope = float(np.clip(slope + up / max(1e-9, ((n[0] + n[1]) * p * (1 - p) * x * x).sum()), 0.5, 60.0))
    return float(at), slope


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", model_bytes: int = MODEL_BYTES) -> DataFrame:
    """(doc_id, held_out, score, predicted, llr), one row per input row.

    Learns from all labelled rows whose `fold` is not 0; one in four of them only sets the threshold. Of several labels of
    a doc_id the largest holds; null labels and rows with a null doc_id teach nothing (the latter are not held out). Null,
    empty and letterless texts have a log ratio of 0; very long texts are scored whole, passage by passage; repeated rows
    are scored alike; of tied passages one is as good as another; an empty table gives an empty table, and without labels
    of both kinds nothing is predicted toxic. Columns besides those named are not read.
    """
    df = docs.select(tokens(F.col(text)).alias("words"), F.col(doc_id).alias("doc_id"))
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).cast("int").alias("toxic")).where(fold(F.col("_id")) != 0)
    taught = df.join(broadcast_if_small(materialize(known)), F.col("doc_id") == F.col("_id")).select("words", "toxic", fold(F.col("doc_id")).alias("fold"))
    model = language_models(taught.where("fold > 1").select("words", "toxic"))
    held = held_model(model, model_bytes)
    steps = F.floor((F.col("llr") - _LOW) / (_HIGH - _LOW) * _BINS)
    bins = F.least(F.greatest(steps, F.lit(0)), F.lit(_BINS - 1)).cast("int").alias("bin")
    seen = _scored(taught.where("fold = 1").select("words", "toxic"), model, held).groupBy(bins, "toxic").count().collect()  # at most two rows a bin
    at, slope = threshold({(r["bin"], r["toxic"]): r["count"] for r in seen})
    score = 1 / (1 + F.exp(-F.lit(slope) * (F.col("llr") - at)))
    held_out = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")
    scored = _scored(df, model, held).withColumn("score", score)
    return scored.select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "llr")
