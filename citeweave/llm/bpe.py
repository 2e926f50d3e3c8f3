"""Byte-level BPE by a global shuffle of distinct words.

Documents are gathered into blocks of a bounded number of characters. A block explodes its pre-tokens into two
tables: each distinct pre-token once, with its slot in the block, and the documents' sequences of slots. The pre-tokens
of all blocks meet by a shuffle on the word, where every distinct one is encoded once and its ids join all its slots;
these go back to their blocks, which put the documents together by position. So the shuffles carry the blocks'
vocabularies and compressed positions, never the texts, and a frequent word has no more rows than there are blocks.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters that make a block full. A longer document is a block of its own.
BLOCK_CHARS = 40_000_000
#: A row of a block's first table is numbered partition, block, slot.
SLOT_BITS, BLOCK_BITS = 26, 14
#: Pieces that a block remembers, and tokens of which the sequences are compressed together.
PIECES, CHUNK_TOKENS = 150_000, 1_000_000
#: Code points below this have no other letters, numbers or white space than those `_narrow` names.
NARROW = 0x250


def ranks_file(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@lru_cache(maxsize=2)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def _encoder(path: str, split: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=split, mergeable_ranks=_ranks(path), special_tokens={})


@lru_cache(maxsize=2)
def _token_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """All tokens' bytes on end, and where each starts: the token-byte table, of a fixed size."""
    ranks = _ranks(path)
    by_id: list[bytes] = [b""] * (max(ranks.values()) + 1)
    for token, k in ranks.items():
        by_id[k] = token
    starts = np.concatenate(([0], np.cumsum([len(x) for x in by_id])))
    return np.frombuffer(b"".join(by_id), np.uint8), starts


@lru_cache(maxsize=2)
def _splitter(split: str) -> Callable[[str], list[str]]:
    """`findall` of the pattern. Texts of Latin letters alone take the same pattern with its classes spelled out, which `re` knows."""
    import regex

    wide = regex.compile(split)
    letters, numbers = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾"
    narrow = re.compile(split.replace(r"[^\s\p{L}\p{N}]", rf"[^\s{letters}{numbers}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]").replace(r"\s", "\x00").replace("\x00", r"\s"))
    odd = re.compile(f"[^\x00-{chr(NARROW - 1)}]|[\x1c-\x1f]")  # `re` takes U+001C to U+001F as white space
    return lambda text: (wide if odd.search(text) else narrow).findall(text)


class Block:
    """Splits texts into pre-tokens and numbers the distinct ones. A piece between single spaces is split once."""

    def __init__(self, split: str):
        self.find = _splitter(split)
        self.slots: dict[str, int] = {}
        self.pieces: dict[str, int] = {}
        self.parts: list[list[int]] = []
        self.loose: set[str] = set()

    def _slots(self, text: str) -> list[int]:
        slots = self.slots
        return [slots.setdefault(x, len(slots)) for x in self.find(text)]

    def _piece(self, piece: str) -> int:
        """Number of a piece, or -1 if it touches other white space, so that a match may reach over its ends."""
        k = self.pieces.get(piece, -2)
        if k == -2:
            if not piece or piece[0].isspace() or piece[-1].isspace():
                self.loose.add(piece)
                k = -1
            else:
                k = len(self.parts)
                self.parts.append(self._slots(" " + piece))
            if len(self.pieces) < PIECES:
                self.pieces[piece] = k
        return k

    def add(self, text: str) -> None:
        """Numbers the pre-tokens of a text, in the order in which `sequence` does."""
        first, *rest = text.split(" ")
        for x in [x for x in rest if x not in self.pieces]:
            self._piece(x)
        whole = not text or not first or first[-1:].isspace() or not self.loose.isdisjoint(rest)
        self._slots(text if whole else first)
        del self.parts[PIECES:]

    def sequence(self, text: str) -> np.ndarray:
        first, *rest = text.split(" ")
        known, own = self.pieces.get, self._piece
        numbers = [known(x, -2) for x in rest]
        if -2 in numbers:
            numbers = [own(x) if k == -2 else k for x, k in zip(rest, numbers)]
        if not text or not first or first[-1:].isspace() or -1 in numbers:
            out = self._slots(text)
        else:
            out = self._slots(first)
            out.extend(chain.from_iterable(map(self.parts.__getitem__, numbers)))
        del self.parts[PIECES:]  # those of pieces that are not remembered
        return np.array(out, np.int32)


def _pack(sequences: list[np.ndarray]) -> bytes:
    """Slots with their bytes by significance, compressed: most slots are small."""
    flat = np.concatenate(sequences) if sequences else np.zeros(0, np.int32)
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(flat.view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpack(packed: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view(np.int32).ravel()


def _texts(batches: Iterator[pa.RecordBatch], rows: int = 200) -> Iterator[tuple[int | None, str | None]]:
    """Rows of the batches, of which few are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield from zip(part.column(0).to_pylist(), part.column(1).to_pylist())


def _blocks(batches: Iterator[pa.RecordBatch], split: str, words: bool, block_chars: int) -> Iterator[pa.RecordBatch]:
    """Rows of one of the two tables of each block; both calls see the same partition and so number blocks alike."""
    part, k, n, held, block = TaskContext.get().partitionId(), 0, 0, 0, Block(split)
    ids: list[int | None] = []
    sequences: list[np.ndarray] = []

    def places() -> pa.RecordBatch:
        row = {"block": pa.array([(part << BLOCK_BITS) + k], pa.int64()), "doc_ids": pa.array([ids], pa.list_(pa.int64())), "sizes": pa.array([[len(x) for x in sequences]], pa.list_(pa.int32())), "slots": pa.array([_pack(sequences)], pa.binary())}
        return pa.RecordBatch.from_pydict(row)

    def vocabulary() -> Iterator[pa.RecordBatch]:
        if len(block.slots) >> SLOT_BITS or k >> BLOCK_BITS:
            raise ValueError("one text has over 2^26 distinct words, or a partition over 2^14 blocks of 40 MB")
        first, all_words = (((part << BLOCK_BITS) + k) << SLOT_BITS), list(block.slots)
        for at in range(0, len(all_words), 50_000):
            own = all_words[at : at + 50_000]
            yield pa.RecordBatch.from_pydict({"slot": pa.array(np.arange(at, at + len(own)) + first), "word": pa.array(own, pa.string())})

    for doc, text in _texts(batches):
        text = text or ""
        if n and (n + len(text) > block_chars or len(block.slots) >> (SLOT_BITS - 1)):
            if words:
                yield from vocabulary()
            elif ids:
                yield places()
            k, n, held, block, ids, sequences = k + 1, 0, 0, Block(split), [], []
        n += len(text) + 1
        if words:
            block.add(text)
            continue
        ids.append(doc)
        sequences.append(block.sequence(text))
        held += len(sequences[-1])
        if held >= CHUNK_TOKENS:
            yield places()
            ids, sequences, held = [], [], 0
    if words and n:
        yield from vocabulary()
    elif ids:
        yield places()


def encode_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Token ids of every whole text: doc_id and `ids` (little-endian unsigned 32-bit integers).

    Null is the empty text, which has no ids; repeated rows are encoded each; an empty table gives an empty table;
    other columns are not read. `docs` must give the same rows in the same partitions when it is read twice, as a
    scan of files does.
    """
    return _encoded(docs, doc_id, text, path or ranks_file(), pattern(), block_chars, lambda ids: (ids,), [("ids", "binary")])


_KINDS = {"binary": pa.binary(), "long": pa.int64(), "string": pa.string()}


def _encoded(docs: DataFrame, doc_id: str, text: str, path: str, split: str, block_chars: int, finish: Callable[[bytes], tuple], columns: list[tuple[str, str]]) -> DataFrame:
    """`finish` of the ids of each document, in the task that puts them together."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    kind = "<u2" if len(_ranks(path)) <= 1 << 16 else "<u4"

    words = rows.mapInArrow(lambda it: _blocks(it, split, True, block_chars), "slot long, word string")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by word: each distinct one is encoded once, and its ids join all its slots."""
        encode, whole = _encoder(path, split)._core_bpe.encode_single_piece, _ranks(path).get
        last, known = None, b""
        for batch in batches:
            out = []
            for x in batch.column(1).to_pylist():
                if x != last:
                    raw = x.encode("utf-8")
                    last, known = x, np.array(encode(raw) if (k := whole(raw)) is None else [k], kind).tobytes()
                out.append(known)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["slot", "ids"])

    known = words.repartition("word").sortWithinPartitions("word").mapInArrow(encoded, "slot long, ids binary")
    known = known.withColumn("block", F.shiftright("slot", SLOT_BITS))
    places = rows.mapInArrow(lambda it: _blocks(it, split, False, block_chars), "block long, doc_ids array<long>, sizes array<int>, slots binary")

    def together(own: pa.Table, vocab: pa.Table) -> pa.Table:
        slot = vocab.column("slot").to_numpy() & ((1 << SLOT_BITS) - 1)
        ids = vocab.column("ids").combine_chunks()
        ids = ids if isinstance(ids, pa.Array) else pa.concat_arrays(ids.chunks)
        many = np.zeros(len(slot), np.int64)
        offsets = np.zeros(len(slot), np.int64)
        flat = np.zeros(0, kind)
        if len(slot):
            ends = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1].astype(np.int64) // int(kind[2])
            flat = np.frombuffer(ids.buffers()[2], kind, count=ends[-1])
            offsets[slot], many[slot] = ends[:-1], np.diff(ends)
        docs_, out = [], []
        for doc_ids, sizes, packed in zip(*(own.column(c).to_pylist() for c in ("doc_ids", "sizes", "slots"))):
            s = _unpack(packed)
            for doc, part in zip(doc_ids, np.split(s, np.cumsum(sizes)[:-1])):
                size = many[part]
                ends = np.cumsum(size)
                at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(offsets[part] - (ends - size), size)
                docs_.append(doc)
                out.append(finish(flat[at].astype("<u4").tobytes()))
        made = list(zip(*out)) or [[] for _ in columns]
        return pa.table({"doc_id": pa.array(docs_, pa.int64())} | {n: pa.array(x, _KINDS[t]) for x, (n, t) in zip(made, columns)})

    schema = ", ".join(f"{n} {t}" for n, t in [("doc_id", "long"), *columns])
    return places.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(together, schema)


def decode(ids: bytes, path: str) -> bytes:
    """Bytes of the tokens of `ids`, by the token-byte table."""
    table, starts = _token_bytes(path)
    k = np.frombuffer(ids, "<u4").astype(np.int64)
    size = starts[k + 1] - starts[k]
    ends = np.cumsum(size)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[k] - (ends - size), size)
    return table[at].tobytes()


def bpe_round_trip(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Encodes every whole text, decodes the ids, and returns digests of both; see `encode_documents`."""
    path = path or ranks_file()

    def digests(ids: bytes) -> tuple[int, str, str]:
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decode(ids, path)).hexdigest()

    return _encoded(docs, doc_id, text, path, pattern(), block_chars, digests, [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")])
