"""Spelling variants: words one edit apart, of which the far more frequent one is taken for the form of the other.

Nobody compares words with words. The vocabulary is put into Bloom filters, sharded by length, whose blocks are single
64-bit words; each word generates its deletions and replacements and probes the filters of the lengths these have.
Only what the filters let through is shuffled, to an exact join with the vocabulary that removes the false positives.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.llm.common import ascii_lower, let, materialize

LETTERS = "A-Za-zÀ-ÿ"
MIN_LENGTH = 7
MIN_COUNT = 2
TYPO_IN = 31
FORM_TIMES = 10

#: Code points that a word may have, lower-cased, in order.
ALPHABET = np.array([*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)], dtype=np.int64)
_RANK = np.zeros(0x100, dtype=np.int64)
_RANK[ALPHABET] = np.arange(len(ALPHABET))

#: Words of one filter at most, bits for each, and bits that a word sets in its block.
SHARD_WORDS = 1 << 18
BITS = 16
SET = 5

#: Longer words share the filters of this length.
LONGEST = 64

#: Bytes of filters that are broadcast at a time; more of them take further passes over the vocabulary.
ROUND_BYTES = 64 << 20

#: Edits that are probed at a time in a task.
PROBES = 1 << 20


def runs(text: Column, least: int = MIN_LENGTH) -> Column:
    """Maximal runs of letters of at least `least` code points, A-Z lower-cased. Shorter ones cannot become a word."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))


def with_typo(doc_id: Column, run: Column) -> Column:
    """The run, less one code point if `TYPO_IN` divides the crc32 of `<doc_id>:<run>`; a null id is written as nothing."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % TYPO_IN == 0, cut).otherwise(run)


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): words of at least `MIN_LENGTH` code points that occur at least `MIN_COUNT` times over all texts."""
    found = docs.select(F.col(doc_id).alias("doc_id"), F.explode(runs(F.col(text))).alias("run")).select(with_typo(F.col("doc_id"), F.col("run")).alias("word"))
    return found.where(F.length("word") >= MIN_LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_COUNT)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _at(position: np.ndarray, letter: np.ndarray) -> np.ndarray:
    """Random number of a letter at a position; a word's hash is the exclusive or of those of its letters, mixed."""
    return _mixed((position.astype(np.uint64) * np.uint64(256) + letter.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def _ranks(words: list[str]) -> np.ndarray:
    """(words, length) ranks of the letters of words of one length."""
    return _RANK[np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8).reshape(len(words), -1)]


def _hashes(ranks: np.ndarray) -> np.ndarray:
    return np.bitwise_xor.reduce(_at(np.arange(ranks.shape[1])[None, :], ranks), axis=1)


def _sub(h: np.ndarray, subs: int) -> np.ndarray:
    return (_mixed(h + np.uint64(1)) % np.uint64(subs)).astype(np.int64)


def _bits(h: np.ndarray) -> np.ndarray:
    """The bits that a word sets in its block."""
    h, mask = _mixed(h), np.zeros(h.shape, dtype=np.uint64)
    for k in range(SET):
        mask |= np.uint64(1) << ((h >> np.uint64(6 * k)) & np.uint64(63))
    return mask


def _block(h: np.ndarray, blocks: int) -> np.ndarray:
    return ((h >> np.uint64(20)) & np.uint64(blocks - 1)).astype(np.int64)


def blocks_of(words: int) -> int:
    """Blocks of a filter for so many words, a power of two."""
    return 1 << max(0, math.ceil(math.log2(max(1, words * BITS / 64))))


def _shards_of(words: list[str], subs: dict[int, int]) -> np.ndarray:
    """Number of the shard of each word within its length."""
    sub = np.zeros(len(words), dtype=np.int64)
    lengths = np.array([len(w) for w in words])
    for length in np.unique(lengths):
        here = np.flatnonzero(lengths == length)
        sub[here] = _sub(_hashes(_ranks([words[i] for i in here])), subs[min(int(length), LONGEST)])
    return sub


def bloom_filters(vocab: DataFrame, subs: dict[int, int]) -> DataFrame:
    """(length, sub, filter): a blocked Bloom filter for each shard of at most about `SHARD_WORDS` words."""

    def sharded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            w = df["word"].tolist()
            yield pd.DataFrame({"length": [min(len(x), LONGEST) for x in w], "sub": _shards_of(w, subs), "word": w})

    def build(df: pd.DataFrame) -> pd.DataFrame:
        words = df["word"].tolist()
        made = np.zeros(blocks_of(len(words)), dtype=np.uint64)
        for length in sorted(set(map(len, words))):
            h = _hashes(_ranks([w for w in words if len(w) == length]))
            np.bitwise_or.at(made, _block(h, len(made)), _bits(h))
        return pd.DataFrame({"length": [int(df["length"].iat[0])], "sub": [int(df["sub"].iat[0])], "filter": [made.tobytes()]})

    shards = vocab.select("word").mapInPandas(sharded, "length int, sub long, word string")
    return shards.groupBy("length", "sub").applyInPandas(build, "length int, sub long, filter binary")


class Probe:
    """Edits of words that the filters of some shards let through."""

    def __init__(self, filters: dict[tuple[int, int], bytes], subs: dict[int, int]):
        self.filters = {k: np.frombuffer(v, dtype=np.uint64) for k, v in filters.items()}
        self.subs = subs

    def hits(self, h: np.ndarray, length: int) -> np.ndarray:
        """Places in the flat array `h` of hashes of words of `length` that a filter here has."""
        length = min(length, LONGEST)
        own = [s for s in range(self.subs.get(length, 0)) if (length, s) in self.filters]
        if not own:
            return np.zeros(0, dtype=np.int64)
        found, sub = [], _sub(h, self.subs[length]) if self.subs[length] > 1 else None
        for s in own:
            at, f = None if sub is None else np.flatnonzero(sub == s), self.filters[length, s]
            x = h if at is None else h[at]
            bits = _bits(x)
            hit = np.flatnonzero((f[_block(x, len(f))] & bits) == bits)
            found.append(hit if at is None else at[hit])
        return np.concatenate(found)

    def edits(self, words: list[str]) -> Iterator[tuple[int, str]]:
        """(place of the word, edit) for words of one length: every deletion, and every replacement by a later letter.

        Insertions are the deletions of the longer word, replacements by an earlier letter those of the other word.
        """
        length = len(words[0])
        if not any((min(n, LONGEST), s) in self.filters for n in (length - 1, length) for s in range(self.subs.get(min(n, LONGEST), 0))):
            return
        ranks = _ranks(words)
        where = np.arange(length)
        own = _at(where[None, :], ranks)
        whole = np.bitwise_xor.reduce(own, axis=1)
        # one letter less: the letters before it stand, those behind move up
        before = np.bitwise_xor.accumulate(own, axis=1) ^ own
        moved = np.zeros_like(own)
        moved[:, 1:] = _at(where[None, :-1], ranks[:, 1:])
        behind = np.bitwise_xor.reduce(moved, axis=1)[:, None] ^ np.bitwise_xor.accumulate(moved, axis=1)
        first = np.ones(ranks.shape, dtype=bool)
        first[:, 1:] = ranks[:, 1:] != ranks[:, :-1]  # equal neighbours give one deletion
        w, i = np.nonzero(first)
        for k in self.hits((before ^ behind)[w, i], length - 1):
            x = words[w[k]]
            yield int(w[k]), x[: i[k]] + x[i[k] + 1 :]
        letters = np.arange(len(ALPHABET))
        each = max(1, PROBES // (len(words) * len(ALPHABET)))
        for start in range(0, length, each):
            at = where[start : start + each]
            changed = (whole[:, None] ^ own[:, at])[:, :, None] ^ _at(at[:, None], letters[None, :])[None, :, :]
            w, i, c = np.nonzero(letters[None, None, :] > ranks[:, at][:, :, None])
            for k in self.hits(changed[w, i, c], length):
                x, p = words[w[k]], int(at[i[k]])
                yield int(w[k]), x[:p] + chr(ALPHABET[c[k]]) + x[p + 1 :]


def neighbours(vocab: DataFrame) -> DataFrame:
    """(word, n, near, near_n): both directions of all pairs of words of `vocab` (word, n) that differ by one code point inserted, deleted or replaced."""
    spark = vocab.sparkSession
    sizes = {r["length"]: r["m"] for r in vocab.groupBy(F.least(F.length("word"), F.lit(LONGEST)).alias("length")).agg(F.count("*").alias("m")).collect()}  # a row for each length up to LONGEST
    subs = {length: -(-m // SHARD_WORDS) for length, m in sizes.items()}
    shards = [(length, s) for length in sorted(subs) for s in range(subs[length])]
    each = max(1, ROUND_BYTES // (blocks_of(2 * SHARD_WORDS) * 8))
    filters = materialize(bloom_filters(vocab, subs)) if shards else None
    positives = None
    for k in range(0, len(shards), each):
        chosen = shards[k : k + each]
        wanted = F.struct("length", F.col("sub").cast("long").alias("sub")).isin([F.struct(F.lit(a).cast("int").alias("length"), F.lit(b).cast("long").alias("sub")) for a, b in chosen])
        held = spark.sparkContext.broadcast({(r["length"], r["sub"]): bytes(r["filter"]) for r in filters.where(wanted).collect()})  # at most ROUND_BYTES

        def probed(frames: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            probe = Probe(held.value, subs)
            for df in frames:
                words, n = df["word"].tolist(), df["n"].tolist()
                by_length: dict[int, list[int]] = {}
                for i, w in enumerate(words):
                    by_length.setdefault(len(w), []).append(i)
                for length, places in by_length.items():
                    few = max(1, PROBES // (length * len(ALPHABET)))
                    for j in range(0, len(places), few):
                        part = places[j : j + few]
                        made = [(words[part[i]], n[part[i]], e) for i, e in probe.edits([words[i] for i in part])]
                        if made:
                            yield pd.DataFrame(made, columns=["word", "n", "near"])

        here = vocab.select("word", "n").mapInPandas(probed, "word string, n long, near string")
        positives = here if positives is None else positives.union(here)
    if positives is None:
        return vocab.select("word", "n", F.col("word").alias("near"), F.col("n").alias("near_n")).limit(0)
    exact = vocab.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    pairs = materialize(positives.join(exact, "near").select("word", "n", "near", "near_n"))
    return pairs.union(pairs.select("near", "near_n", "word", "n"))


def _rooted(forms: DataFrame, most: int) -> DataFrame:
    """`forms` (word, form, ...) and `root`, the last word that following forms reaches. A form is at least `FORM_TIMES` as frequent as its word, so `most` bounds the steps; each round doubles those taken."""
    steps = math.log(max(1, most / MIN_COUNT), FORM_TIMES)
    way = forms.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    for _ in range(max(0, math.ceil(math.log2(max(1.0, steps + 1))))):
        way = materialize(way)
        on = way.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        way = way.join(on, F.col("root") == F.col("_word"), "left").select("word", F.coalesce("_root", "root").alias("root"))
    return forms.join(way, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row for each word of the vocabulary.

    `n` counts the word over all texts, `n_near` its near words; `form` is the near word with the largest count (ties: the
    smallest word), if that is at least `FORM_TIMES` the word's own, else null; `root` follows forms to the last. Null and
    empty texts have no words; very long texts and words are taken whole; each of repeated rows counts; a null doc_id is
    written as nothing before the colon; an empty table gives an empty table; columns besides the two named are not read.
    """
    vocab = materialize(vocabulary(docs, doc_id, text))
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("form")))
    near = neighbours(vocab).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("_best"))
    df = vocab.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "_best")
    far = -F.col("_best.n") >= FORM_TIMES * F.col("n")
    forms = materialize(df.select("word", "n", "n_near", F.when(far, F.col("_best.form")).alias("form"), F.when(far, -F.col("_best.n")).alias("form_n")))
    most = forms.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    return _rooted(forms, most).select("word", "form", "root", "n", "n_near", "form_n")
