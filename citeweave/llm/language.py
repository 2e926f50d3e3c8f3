"""Hierarchical language identification with linear support vector machines.

A first model tells the language family; within a family, one machine for each pair of languages votes. All models
are linear in hashed character n-grams, so a prediction is one pass over a text's code points.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeweave.llm.common import with_text_columns

# ISO 639-1 codes by family. Codes that are not listed share the family "other".
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi".split(),
    "romance": "an ca es fr gl it la oc pt ro".split(),
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk".split(),
    "baltic": "lt lv".split(),
    "uralic": "et fi hu".split(),
    "turkic": "az kk ky tr tt uz".split(),
    "semitic": "am ar he mt".split(),
    "indic": "bn gu hi mr ne pa sa ur".split(),
    "austronesian": "id jv ms tl".split(),
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}
UNKNOWN = "und"
N_BITS = 15
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Hashed counts of lower-cased letter bigrams and trigrams, at unit length: (places, values). None without a letter."""
    code = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    keep = _letters()[code]
    if not keep.any():
        return None
    code = np.where(keep, code, np.uint32(32))
    code = code[keep | np.concatenate(([True], keep[:-1]))]  # runs of other characters become one space
    code = np.concatenate(([np.uint32(32)], code, [np.uint32(32)])).astype(np.uint32)
    two = code[:-1] * np.uint32(0x9E3779B1) + code[1:] * np.uint32(0x85EBCA77)
    three = (two[:-1] ^ (two[:-1] >> np.uint32(15))) * np.uint32(0xC2B2AE3D) + code[2:] * np.uint32(0x27D4EB2F)
    mixed = np.concatenate((two, three))
    counts = np.bincount(((mixed * np.uint32(0x9E3779B1)) >> np.uint32(32 - N_BITS)).astype(np.int64), minlength=1 << N_BITS)
    at = np.flatnonzero(counts)
    value = np.sqrt(counts[at])
    return at, value / np.sqrt((value * value).sum())


def train_svm(rows: list[tuple[np.ndarray, np.ndarray]], sign: np.ndarray, epochs: int = 12, reg: float = 1e-4) -> np.ndarray:
    """Weights (the last is the bias) of a linear machine with hinge loss, by averaged stochastic subgradient steps."""
    w = np.zeros((1 << N_BITS) + 1)
    total, n, rng, scale = np.zeros_like(w), 0, np.random.default_rng(7), 1.0
    balance = {s: len(sign) / (2 * max(1, (sign == s).sum())) for s in (-1.0, 1.0)}
    for epoch in range(epochs):
        for i in rng.permutation(len(rows)):
            at, value = rows[i]
            n += 1
            rate = 1.0 / (1.0 + reg * n * 10)
            scale *= 1 - rate * reg
            if sign[i] * scale * (w[at] @ value + w[-1]) < 1:
                step = rate * sign[i] * balance[sign[i]] / scale
                w[at] += step * value
                w[-1] += step * 0.1
        if epoch >= epochs // 2:
            total += scale * w
    return (total / max(1, epochs - epochs // 2)).astype(np.float32)


def _pairs(rows, labels: list[str]) -> dict[tuple[str, str], np.ndarray]:
    found = {}
    for a, b in combinations(sorted(set(labels)), 2):
        own = [i for i, x in enumerate(labels) if x in (a, b)]
        found[a, b] = train_svm([rows[i] for i in own], np.array([1.0 if labels[i] == a else -1.0 for i in own]))
    return found


def _vote(models: dict, names: list[str], row) -> tuple[str, float]:
    """The name that wins most pairs, then has the larger sum of margins, and the least probability of its pairs."""
    if len(names) == 1:
        return names[0], 1.0
    at, value = row
    won, least = {x: [0, 0.0] for x in names}, {x: 1.0 for x in names}
    for (a, b), w in models.items():
        m = float(w[at] @ value + w[-1])
        p = 1 / (1 + np.exp(-4 * np.clip(m, -50, 50)))
        for x, s, q in ((a, m, p), (b, -m, 1 - p)):
            won[x][0] += s > 0
            won[x][1] += s
            least[x] = min(least[x], q)
    best = max(sorted(names), key=lambda x: won[x])
    return best, least[best]


class LanguageModel:
    """Families first, then the languages of the family that was predicted."""

    def __init__(self, rows, labels: list[str]):
        family = [FAMILY.get(x, "other") for x in labels]
        self.families = sorted(set(family))
        self.family_models = _pairs(rows, family)
        self.languages = {f: sorted({x for x, g in zip(labels, family) if g == f}) for f in self.families}
        self.models = {f: _pairs([r for r, g in zip(rows, family) if g == f], [x for x, g in zip(labels, family) if g == f]) for f in self.families}

    def predict(self, text: str | None) -> tuple[str, float]:
        row = features(text)
        if row is None or not self.families:
            return UNKNOWN, 0.0
        family, p = _vote(self.family_models, self.families, row)
        lang, q = _vote(self.models[family], self.languages[family], row)
        return lang, float(min(p, q))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of (lang, text) rows as bytes; texts without a letter give none."""
    for batch in batches:
        for k in range(0, batch.num_rows, 100):
            part = batch.slice(k, 100).to_pylist()
            found = [(r["lang"], f) for r in part if (f := features(r["text"]))]
            columns = [x for x, _ in found], [at.astype("<u2").tobytes() for _, (at, _) in found], [v.astype("<f4").tobytes() for _, (_, v) in found]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.binary(), pa.binary()))], names=["lang", "at", "value"])


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", per_language: int = 600, max_rows: int = 20_000) -> LanguageModel:
    """Fits the models on a bounded sample: about `per_language` rows of every label, fewer of each where that makes more than `max_rows`.

    Every label that a row has is learned. Rows are chosen by a hash of their text, so equal tables give equal models
    whatever their partitions. Executors turn texts into features, at most 192 kB each; these alone are collected.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row per label
    each = min(per_language, max(10, max_rows // max(1, len(counts))))
    wanted = labelled.sparkSession.createDataFrame([(x, min(1.0, each / n)) for x, n in counts.items()], "lang string, share double")
    at = F.pmod(F.xxhash64("text", F.lit(11)), F.lit(1 << 20)) / (1 << 20)
    chosen = rows.join(F.broadcast(wanted), "lang").where(at < F.col("share")).select("lang", "text").dropDuplicates(["text", "lang"])
    order = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("text", F.lit(13)), "text"))
    chosen = chosen.withColumn("n", order).where(F.col("n") <= 2 * each)  # repeats of a text share its hash, never more than this
    sample = chosen.select("lang", "text").mapInArrow(_rows, "lang string, at binary, value binary").collect()
    sample.sort(key=lambda r: (r["lang"], bytes(r["at"]), bytes(r["value"])))
    found = [(np.frombuffer(r["at"], "<u2").astype(np.int64), np.frombuffer(r["value"], "<f4").astype(np.float64)) for r in sample]
    return LanguageModel(found, [r["lang"] for r in sample])


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Adds `lang_pred` and `score` from the whole text alone; `und` and 0 for a text that is null or has no letter."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: 128 kB for each pair of languages in a family

    return with_text_columns(docs, text, lambda: shared.value.predict, [("lang_pred", "string"), ("score", "double")])


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    """True for the documents that are kept from training."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def language_id(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 600) -> DataFrame:
    """Trains on the rows of `docs` that are not held out and predicts every row; one row per input row.

    Null or letterless texts give `und` with score 0; so does every text if no row has a label to learn from. With a
    single label every text with a letter gets it, with score 1. Very long texts are read whole in one pass. Repeated
    rows are predicted alike; an empty table gives an empty table; columns besides the three named are not read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    model = train(rows.where(~held_out(F.col("doc_id"))), per_language=per_language)
    df = identify(rows.select("doc_id", "text"), model)
    return df.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
