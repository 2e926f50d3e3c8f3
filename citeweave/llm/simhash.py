"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified links and their components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.llm.common import materialize, with_text_columns
from citeweave.operators.graph import connected_components

BITS = 64
#: Fingerprints compared with one another in one task at most; a larger block is cut into pairs of chunks.
CHUNK = 2048
#: Blocks that full ones are cut into besides, and at most.
STEP, MOST_BLOCKS = 3, 11


def simhash(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Signed 64-bit fingerprint: a bit is set if it is in over half the hashes of the word shingles; 0 without words."""
    words = (text or "").encode("utf-8").lower().split()  # on bytes both take ASCII only
    if not words:
        return 0
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [h(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        hashes = [h(joined[a:b], seed) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(2 * bits.sum(0, dtype=np.int64) > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return with_text_columns(rows, "text", lambda: lambda x: (simhash(x, shingle),), [("fp", "long")]).select("doc_id", "fp")


def block_keys(fp: Column, n_blocks: int, distance: int) -> Column:
    """Array of hashes, one for each choice of all but `distance` blocks. Two fingerprints of that distance or less share one."""
    cut = [BITS * i // n_blocks for i in range(n_blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(cut, cut[1:])]
    keys = []
    for k, own in enumerate(combinations(masks, n_blocks - distance)):
        mask = sum(own)
        keys.append(F.xxhash64(F.lit(k), fp.bitwiseAND(F.lit(mask - (1 << BITS) if mask >> (BITS - 1) else mask))))
    return F.array(*keys)


def _forest(fp: np.ndarray, doc: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that connect what pairs within `distance` connect: fewer than there are fingerprints."""
    fp, label, links = fp.view(np.uint64), np.arange(len(fp)), []  # bits of signed numbers are counted without the sign
    for a in range(len(fp) - 1):
        near = a + 1 + np.flatnonzero(np.bitwise_count(fp[a + 1 :] ^ fp[a]) <= distance)
        near = near[label[near] != label[a]]
        while len(near):
            b = near[0]
            links.append((int(doc[a]), int(doc[b])))
            label[label == label[b]] = label[a]
            near = near[label[near] != label[a]]
    return links


def _links(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Links of each run of rows with one `part`; rows arrive sorted by it. A run holds two chunks at most."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def closed(part, fp, doc) -> pa.RecordBatch:
        cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True]))) if len(part) else np.zeros(1, int)
        links = [x for a, b in zip(cut, cut[1:]) if b - a > 1 for x in _forest(fp[a:b], doc[a:b], distance)]
        return pa.RecordBatch.from_pydict({"u": pa.array([x[0] for x in links], pa.int64()), "v": pa.array([x[1] for x in links], pa.int64())})

    for batch in batches:
        now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
        if not len(now[0]):
            continue
        last = int(np.flatnonzero(now[0] == now[0][-1])[0])  # the last run may go on
        if last:
            held.append(tuple(x[:last] for x in now))
            yield closed(*(np.concatenate(x) for x in zip(*held)))
            held = []
        elif held and held[-1][0][-1] != now[0][0]:
            yield closed(*(np.concatenate(x) for x in zip(*held)))
            held = []
        held.append(tuple(x[last:] for x in now))
    if held:
        yield closed(*(np.concatenate(x) for x in zip(*held)))


def near_links(reps: DataFrame, distance: int = 3, n_blocks: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """Links (u, v) between the documents of (doc_id, fp), each fp once, that connect all pairs within `distance` bits.

    With `n_blocks` blocks, any such pair agrees in all but `distance` of them; more blocks for more fingerprints keep
    a chance meeting rare. The fingerprints of blocks with over `chunk` of them are cut into `STEP` blocks more, so that
    those that meet agree in more bits, as often as there are `MOST_BLOCKS` at most. A block that is full even then is
    dealt by hash into chunks, and each pair of chunks is a task: no task grows with the block and nothing is left out.
    Only links of a forest come out.
    """
    if n_blocks is None:
        n = reps.count()
        n_blocks = distance + (2 if n < 1 << 26 else 3 if n < 1 << 32 else 4)
    keyed = reps.select(F.explode(block_keys(F.col("fp"), n_blocks, distance)).alias("key"), "fp", "doc_id")
    sizes = materialize(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    full, finer = sizes.where(F.col("n") > chunk), None
    if n_blocks + STEP <= MOST_BLOCKS and not full.isEmpty():
        # at most 1 / `chunk` of the keys are full
        finer = near_links(materialize(keyed.join(full, "key", "left_semi").select("fp", "doc_id").distinct()), distance, n_blocks + STEP, chunk)
        sizes = sizes.where(F.col("n") <= chunk)
    shared = keyed.join(sizes, "key")
    chunks = F.ceil(F.col("n") / chunk).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(5)), F.greatest(chunks, F.lit(1))).cast("int")
    mates = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda y: F.xxhash64("key", F.least(F.col("own"), y), F.greatest(F.col("own"), y)))
    part = F.when(F.col("n") <= chunk, F.array("key")).otherwise(mates)
    dealt = shared.withColumns({"chunks": chunks, "own": own}).select(F.explode(part).alias("part"), "fp", "doc_id")
    dealt = dealt.repartition("part").sortWithinPartitions("part", "doc_id")
    links = dealt.select("part", F.col("fp"), "doc_id").mapInArrow(lambda it: _links(it, distance), "u long, v long")
    return (links if finer is None else links.unionByName(finer)).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = 3, shingle: int = 3, n_blocks: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """Row per input row: doc_id, fingerprint (hexadecimal) and component_id, the smallest doc_id it is linked to.

    Documents link where their fingerprints differ in `distance` bits or fewer; equal fingerprints are one node. Null
    and wordless texts have fingerprint zero and link like any other. Rows of one doc_id are documents of their own
    that share it; rows with a null doc_id get the component of their fingerprint. An empty table gives an empty
    table; other columns are not read.
    """
    fps = materialize(fingerprints(docs, doc_id, text, shingle))
    reps = materialize(fps.groupBy("fp").agg(F.min("doc_id").cast("long").alias("doc_id")))
    parts = connected_components(near_links(reps.where("doc_id is not null"), distance, n_blocks, chunk))
    # one doc_id may stand for several fingerprints, which then are of one component
    named = materialize(reps.join(parts, reps["doc_id"] == parts["node"], "left").select("fp", F.coalesce("component", "doc_id").alias("component_id")))
    return fps.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", broadcast_rows: int = 2_000_000, **options) -> DataFrame:
    """`docs` without the documents whose component has a smaller doc_id. Rows with a null doc_id stay.

    The ids that go are broadcast up to `broadcast_rows` of them (32 MB), and joined by a shuffle beyond.
    """
    found = near_duplicates(docs, doc_id, text, **options)
    gone = materialize(found.where(F.col("component_id") < F.col("doc_id")).select(F.col("doc_id").alias("_gone")).distinct())
    if gone.count() <= broadcast_rows:
        gone = F.broadcast(gone)
    return docs.join(gone, docs[doc_id] == gone["_gone"], "left_anti")
