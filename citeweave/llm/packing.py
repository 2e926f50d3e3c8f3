"""Best-fit packing of tokenized documents by linear grouping.

Lengths are whole numbers up to the capacity, so a histogram of bounded size says all that a plan needs. Large lengths
are cut into groups of equal cardinality and rounded up to the largest of their group; a linear programme over these
few sizes, by column generation, picks configurations; actual documents take the places of the rounded ones; what is
left over and the small documents go best-fit into the remaining space. The plan is a list of fragments (ranks of one
length that take consecutive sequences at one offset), which the documents then look up in parallel.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeweave.llm.common import materialize

CAPACITY = 2048
END = 0
#: Rows of one length that a task numbers at once.
SALT_ROWS = 1000
#: Documents whose words are looked up together.
ROWS = 1200
_TOKENIZERS: dict[str, tuple] = {}
# A word of plain letters and the marks behind it, which the vocabulary's pattern takes apart in just this way.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


class _Known:
    """Ids that were met lately, in two halves: a full one becomes the older one and a new one is begun."""

    def __init__(self, most: int):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.now, self.older = {"": b""}, {}

    def missing(self, keys) -> list:
        """The keys that are in neither half; the others are in the newer one from now on."""
        if len(self.now) > self.most:
            self.older, self.now = self.now, {"": b""}
        now, older, out = self.now, self.older.get, []
        for k in [k for k in keys if k not in now]:
            ids = older(k)
            if ids is None:
                out.append(k)
            else:
                now[k] = ids
        return out


#: Words that a worker remembers, about.
REMEMBER = 200_000

_PIECES, _PARTS = _Known(REMEMBER), _Known(REMEMBER * 3 // 2)


def vocabulary_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _tokenizers(path: str) -> tuple:
    """The tokenizer, and its model alone for words that its normalizers would leave as they are."""
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        t = Tokenizer.from_file(path)
        bare = Tokenizer(t.model)
        bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        _PIECES.clear(), _PARTS.clear()
        _TOKENIZERS.clear()
        _TOKENIZERS[path] = t, bare
    return _TOKENIZERS[path]


def _ids(tokenizer, words: list[str]) -> Iterator[bytes]:
    for at in range(0, len(words), 10_000):
        for e in tokenizer.encode_batch_fast(words[at : at + 10_000], add_special_tokens=False):
            yield array("I", e.ids).tobytes()


def token_bytes(texts: list[str | None], path: str) -> Iterator[bytes]:
    """Ids of each text as little-endian unsigned 32-bit integers, with END behind.

    This vocabulary's tokens never reach over white space, so a text's ids are those of its pieces between white space,
    and a piece that was met before is looked up; so are the lower-cased word and the marks of a plain one.
    """
    full, bare = _tokenizers(path)
    split = [(x or "").encode("utf-8").split() for x in texts]
    new = {w: w.decode() for w in _PIECES.missing({w for p in split for w in p})}
    plain = {w: (m[1].lower(), m[2]) for w, x in new.items() if (m := _PLAIN.fullmatch(x))}
    parts = _PARTS.missing({y for xs in plain.values() for y in xs if y})
    part, piece = _PARTS.now, _PIECES.now
    part.update(zip(parts, _ids(bare, parts)))
    piece.update((w, part[a] + part[b]) for w, (a, b) in plain.items())
    other = [w for w in new if w not in plain]
    piece.update(zip(other, _ids(full, [new[w] for w in other])))
    end = np.array([END], "<u4").tobytes()
    for p in split:
        yield b"".join(map(piece.__getitem__, p)) + end


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, path: str | None = None, together: int = ROWS, remember: int = REMEMBER) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document, those over `capacity` tokens in pieces of it.

    Words of `together` documents are looked up at a time, and the ids of about four to five times `remember` words and
    parts of words are held by a worker: what they cost in memory they save in time. A worker keeps them from task to
    task, and with fewer than `REMEMBER` only within one, for executors that are short of memory.
    """
    path = path or vocabulary_file()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _PIECES.most, _PARTS.most = remember, remember * 3 // 2
        for whole in batches:
            for at in range(0, whole.num_rows, together):
                batch = whole.slice(at, together)
                out = []
                for doc, raw in zip(batch.column(0).to_pylist(), token_bytes(batch.column(1).to_pylist(), path)):
                    step = 4 * capacity
                    out += [(doc, k, a // 4, len(raw[a : a + step]) // 4, zlib.crc32(raw[a : a + step])) for k, a in enumerate(range(0, len(raw), step))]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        if remember < REMEMBER:
            _PIECES.clear(), _PARTS.clear()  # the worker goes on to other tasks, whose memory this is

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _best_pattern(sizes: np.ndarray, value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of most value that fits: an unbounded knapsack."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        best[c], took[c] = best[c - 1], -1
        fit = np.flatnonzero(sizes <= c)
        if len(fit):
            v = best[c - sizes[fit]] + value[fit]
            k = int(np.argmax(v))
            if v[k] > best[c] + 1e-12:
                best[c], took[c] = v[k], fit[k]
    pattern, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            pattern[took[c]] += 1
            c -= sizes[took[c]]
    return best[capacity], pattern


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 300) -> list[tuple[np.ndarray, int]]:
    """(how many of each size in a sequence, number of such sequences), rounded down from the linear programme."""
    basis = np.diag((capacity // sizes).astype(float))
    for _ in range(rounds):
        value, pattern = _best_pattern(sizes, np.linalg.solve(basis.T, np.ones(len(sizes))), capacity)
        if value <= 1 + 1e-7:
            break
        x, step = np.linalg.solve(basis, demand), np.linalg.solve(basis, pattern)
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = pattern
    x = np.linalg.solve(basis, demand)
    return [(basis[:, k].round().astype(int), int(np.floor(x[k] + 1e-9))) for k in range(len(sizes)) if x[k] >= 1 - 1e-9]


class Plan:
    """Places for a histogram of lengths: `fragments` of (length, first rank, number, first sequence, offset)."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY, large: int = CAPACITY // 3, groups: int = 32):
        self.capacity, self.sequences, self.fragments = capacity, 0, []
        self.rank = dict.fromkeys(counts, 0)
        self.open: dict[int, list[list[int]]] = {}  # runs [first sequence, number] of sequences with that much space left
        self.space: list[int] = []  # sorted keys of `open`
        left = dict(sorted(((n, c) for n, c in counts.items() if c > 0), reverse=True))
        if capacity in left:
            self._place(capacity, self._opened(left.pop(capacity)), 0)
        self._grouped({n: c for n, c in left.items() if n >= large}, groups)
        for n in left:
            self._best_fit(n, counts[n] - self.rank[n])

    def _opened(self, n: int) -> list[int]:
        self.sequences += n
        return [self.sequences - n, n]

    def _place(self, length: int, run: list[int], offset: int) -> None:
        self.fragments.append((length, self.rank[length], run[1], run[0], offset))
        self.rank[length] += run[1]

    def _leave(self, space: int, run: list[int]) -> None:
        if space:
            if space not in self.open:
                self.space.insert(bisect_left(self.space, space), space)
            self.open.setdefault(space, []).append(run)

    def _grouped(self, left: dict[int, int], groups: int) -> None:
        total = sum(left.values())
        if not total:
            return
        most, queues, size = -(-total // groups), [], []
        filled = most
        for n, c in left.items():
            while c:
                if filled == most:
                    if not size or size[-1] != n:
                        queues.append([])
                        size.append(n)  # the largest of the group
                    filled = 0
                take = min(c, most - filled)
                queues[-1].append([n, take])
                c, filled = c - take, filled + take
        sizes, demand = np.array(size), np.array([sum(c for _, c in q) for q in queues], float)
        for pattern, n in configurations(sizes, demand, self.capacity):
            runs = [[*self._opened(n), 0]]
            for g in np.repeat(np.arange(len(sizes)), pattern):
                after = []
                for first, many, used in runs:
                    while many and queues[g]:
                        length, there = queues[g][0]
                        take = min(many, there)
                        self._place(length, [first, take], used)
                        after.append([first, take, used + length])
                        first, many = first + take, many - take
                        queues[g][0][1] -= take
                        if not queues[g][0][1]:
                            queues[g].pop(0)
                    if many:
                        after.append([first, many, used])
                runs = after
            for first, many, used in runs:
                self._leave(self.capacity - used, [first, many])

    def _best_fit(self, length: int, n: int) -> None:
        while n > 0:
            k = bisect_left(self.space, length)
            if k == len(self.space):
                many = -(-n // (self.capacity // length))
                space, run = self.capacity, self._opened(many)
            else:
                space = self.space[k]
                run = self.open[space].pop()
                if not self.open[space]:
                    del self.open[space]
                    self.space.pop(k)
                if run[1] > n:
                    self._leave(space, [run[0] + n, run[1] - n])
                    run = [run[0], n]
            self._place(length, run, self.capacity - space)
            self._leave(space - length, run)
            n -= run[1]


def best_plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The plan of fewest sequences over three bounds for large lengths: a third, two fifths and half of the capacity.

    The lower the bound, the more documents a configuration joins, and the fewer are left to close its gaps.
    """
    return min((Plan(counts, capacity, large) for large in (capacity // 3, 2 * capacity // 5, capacity // 2 + 1)), key=lambda p: p.sequences)


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, path: str | None = None, together: int = ROWS, remember: int = REMEMBER) -> DataFrame:
    """Row per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset.

    Null is the empty text, a document of the end token alone; repeated rows are packed each; an empty table gives an
    empty table; other columns are not read. Only the histogram of lengths, `capacity` rows at most, is collected.
    """
    items = materialize(pieces(docs, doc_id, text, capacity, path, together, remember))
    counts = {r["length"]: r["count"] for r in items.groupBy("length").count().collect()}
    plan = sorted(best_plan(counts, capacity).fragments)
    table = np.array(plan, np.int64).reshape(-1, 5)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    # The rank of a piece among those of its length: numbered within salts of a bounded size, then moved by the salts before.
    many = docs.sparkSession.createDataFrame([(n, -(-c // SALT_ROWS)) for n, c in counts.items()], "length long, salts int")
    items = items.join(F.broadcast(many), "length")  # `capacity` rows at most
    items = items.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("salts")).cast("int")).drop("salts")
    before = items.groupBy("length", "salt").count().withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).drop("count")
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = items.withColumn("own", own).join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("own") - 1)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        t = shared.value
        n, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        k = np.searchsorted((t[:, 0] << 44) + t[:, 1], (n << 44) + r, side="right") - 1
        return pd.DataFrame({"sequence_id": t[k, 3] + r - t[k, 1], "offset": t[k, 4]})

    df = ranked.withColumn("at", place("length", "rank"))
    return df.select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")
