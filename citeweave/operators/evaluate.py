"""Quality measurement: planted tests, assignment, scores, retrieval and answer checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeweave.functions.text import overlap
from citeweave.operators.common import at_ranks, null_safe_join, top
from citeweave.operators.records import mutual_best
from citeweave.plans.materialize import materialize

#: Vectors of a block, and how many of them are compared with another block at a time.
BLOCK, HELD = 4096, 256


def mutate(passages: DataFrame, words: Column, seed: int = 0) -> DataFrame:
    """(item_id, recipe, words, expect): planted forms of passages: whole, one word swapped, a third dropped, foreign words.

    The word that is hit follows from a hash of the id and the seed.
    """
    df = passages.select("item_id", words.alias("w"))
    at = F.pmod(F.xxhash64("item_id", F.lit(seed)), F.greatest(F.size("w"), F.lit(1)))
    forms = F.array(
        F.struct(F.lit("whole").alias("recipe"), F.col("w").alias("words"), F.lit("verbatim").alias("expect")),
        F.struct(F.lit("swap").alias("recipe"), F.transform("w", lambda x, i: F.when(i % 4 == at % 4, F.lit("zzzz")).otherwise(x)).alias("words"), F.lit("misquote").alias("expect")),
        F.struct(F.lit("drop").alias("recipe"), F.filter("w", lambda x, i: i % 5 != at % 5).alias("words"), F.lit("paraphrase").alias("expect")),
        F.struct(F.lit("foreign").alias("recipe"), F.transform("w", lambda x: F.concat(F.lit("qq"), F.reverse(x))).alias("words"), F.lit("not_found").alias("expect")),
    )
    return df.select("item_id", F.explode(forms).alias("f")).select("item_id", "f.*")


def assign(expected: DataFrame, findings: DataFrame, least: float = 0.4) -> DataFrame:
    """One-to-one (doc_id, item, finding, weight) within each document, by word overlap of at least `least`, best first. Both sides are (doc_id, id, words).

    Ids may repeat over documents; a null doc_id is no document. Pairs without a word in common are never met.
    """
    e, f = expected.select("doc_id", F.col("id").alias("item"), F.col("words").alias("x")), findings.select("doc_id", F.col("id").alias("finding"), F.col("words").alias("y"))
    edges = e.join(f, "doc_id").withColumn("weight", overlap(F.col("x"), F.col("y"))).where(F.col("weight") >= least)
    pairs = mutual_best(edges.select(F.struct("doc_id", "item").alias("a"), F.struct("doc_id", "finding").alias("b"), "weight"))
    return pairs.select("a.doc_id", "a.item", "b.finding", "weight")


def score_rows(assigned: DataFrame) -> DataFrame:
    """Adds what is right in rows with expected (status, keys, grade, agrees) and got (got_status, got_key, got_grade, got_agrees)."""
    found = F.col("got_status").isNotNull()
    return assigned.withColumns({
        "detected": found | (F.col("status") == "not_found"),
        "status_ok": F.coalesce(F.col("got_status"), F.lit("not_found")) == F.col("status"),
        "source_ok": F.when(F.size("keys") > 0, F.coalesce(F.array_contains("keys", F.col("got_key")), F.lit(False))),
        "invented": F.when(F.col("got_grade").isNotNull(), F.coalesce(F.col("got_grade") != F.col("grade"), F.lit(True))),
        "citation_ok": F.when(F.col("agrees").isNotNull(), F.coalesce(F.col("got_agrees") == F.col("agrees"), F.lit(False))),
    })


def percent(c: Column) -> Column:
    """Share of true in per cent with one decimal, of the rows where it is known."""
    return F.round(100 * F.avg(c.cast("int")), 1)


def summary(rows: DataFrame, by: list[str]) -> DataFrame:
    hard = F.col("status").isin("verbatim", "not_found")
    return rows.groupBy(*by).agg(
        F.count("*").alias("items"), percent(F.col("detected")).alias("detected"), percent(F.col("status_ok")).alias("status"), percent(F.when(hard, F.col("status_ok"))).alias("status_hard"),
        percent(F.col("source_ok")).alias("source"), percent(F.col("invented")).alias("invented"), percent(F.when(F.col("status") == "not_found", F.col("status_ok"))).alias("abstention"), percent(F.col("citation_ok")).alias("citation"),
    )


def status_matrix(rows: DataFrame, arms: list[str]) -> DataFrame:
    """Share of right statuses by expected status, a column for each arm."""
    return rows.groupBy("status").pivot("arm", arms).agg(percent(F.col("status_ok")))


def spread(summaries: DataFrame, metrics: list[str]) -> DataFrame:
    """`min–max` of each metric over the runs of an arm, one number where they agree, `–` where there is none."""
    def span(m: str) -> Column:
        low, high = F.min(m), F.max(m)
        return F.when(low.isNull(), "–").when(low == high, low.cast("string")).otherwise(F.concat(low.cast("string"), F.lit("–"), high.cast("string"))).alias(m)

    return summaries.groupBy("arm").agg(*map(span, metrics))


def pool(units: DataFrame, wanted: DataFrame, distractors: int, seed: int = 0, key: str = "key") -> DataFrame:
    """`wanted` units and `distractors` others, the ones of least seeded hash, so that the pool can be made again."""
    others = units.join(wanted.select(key).distinct(), key, "left_anti").orderBy(F.xxhash64(key, F.lit(seed)), key).limit(distractors)
    return units.join(wanted.select(key).distinct(), key, "left_semi").unionByName(others)


def cited_within(answers: DataFrame) -> DataFrame:
    """Adds `invalid`, the cited keys (array `cited`) that were not among the `returned`."""
    return answers.withColumn("invalid", F.array_except("cited", "returned"))


def percentiles(df: DataFrame, by: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """Values at the nearest index floor(n * p) of each group; no group is gathered or put in order in one task."""
    return at_ranks(df, by, value, {c: F.least(F.col("n") - 1, F.floor(F.col("n") * p)) for c, p in points.items()})


def medians(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, n, median): the middle value, or the mean of the two in the middle."""
    two = at_ranks(df, by, value, {"_low": F.floor((F.col("n") - 1) / 2), "_high": F.floor(F.col("n") / 2)})
    return two.select(*by, "n", ((F.col("_low") + F.col("_high")) / 2).alias("median"))


def comparison_report(compared: DataFrame, kind: str, order: list[str], most: int = 3) -> DataFrame:
    """How many compared records are of each kind, null being one, their share of all in per cent, and the first `most` of them as samples with their `place`."""
    counts = compared.groupBy(kind).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))
    counts = counts.crossJoin(F.broadcast(total)).withColumn("share", 100 * F.col("n") / F.col("_total")).drop("_total")  # one row
    return null_safe_join(counts, top(compared, [kind], order, most, "place"), [kind])


def accepted(*parts: DataFrame) -> DataFrame:
    """(unit, accepted): the sorted set of keys that count as right for a unit, of any number of (unit, key) tables: its source, same texts, copies."""
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    return both.groupBy("unit").agg(F.sort_array(F.collect_set("key")).alias("accepted"))


def _blocks(vectors: DataFrame, block: int) -> DataFrame:
    """(b, ids, labels, labelled, units, norms): blocks of vectors (id, label, vector), each column an array as bytes; a norm of -1 stands for a null vector."""
    parts = min(100, -(-max(1, vectors.count()) // (2 * block)))
    rows = vectors.select(F.col("id").cast("long"), F.when(F.col("label").isNotNull(), F.xxhash64("label")).alias("label"), F.col("vector").cast("array<double>")).repartition(parts)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def cut(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, n
            table = pa.Table.from_batches(held) if held else None
            while table is not None and (table.num_rows >= block or last and table.num_rows):
                part, table = table.slice(0, block).combine_chunks(), table.slice(block)
                lists, none = part.column("vector").combine_chunks(), part.column("vector").is_null().to_numpy()
                size = len(lists.flatten()) // max(1, int((~none).sum()))
                m = np.zeros((len(none), size))
                m[~none] = lists.flatten().to_numpy(zero_copy_only=False).reshape(int((~none).sum()), size)
                norms = np.linalg.norm(m, axis=1)
                units = m / np.where(norms > 0, norms, 1)[:, None]
                code = part.column("label").combine_chunks()
                data = [part.column("id").to_numpy(), code.fill_null(0).to_numpy(), code.is_valid().to_numpy(zero_copy_only=False), units, np.where(none, -1, norms)]
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() << 32 | n]), *(pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in data)], names=["b", "ids", "labels", "labelled", "units", "norms"])
                n += 1
            held = table.to_batches() if table is not None else []

        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= block:
                yield from cut(False)
        yield from cut(True)

    return materialize(rows.mapInArrow(packed, "b long, ids binary, labels binary, labelled binary, units binary, norms binary"))


def _similar(left: dict, right: dict, i=slice(None), j=slice(None)) -> tuple[np.ndarray, float]:
    """Cosines of rows `i` of one block with rows `j` of another in single precision, and how far these may be off; -3 of a row with itself, -2 with a null vector, 2 with one of length 0, which come last and first as SQL orders nulls and NaN."""
    x, y = left["fast"][i], right["fast"][j]
    s = x @ y.T if x.shape[1] == y.shape[1] else np.zeros((len(x), len(y)), np.float32)  # one has only null vectors
    a, b = left["norms"][i], right["norms"][j]
    if (a <= 0).any() or (b <= 0).any():
        s[a == 0] = 2
        s[:, b == 0] = 2
        s[a < 0] = -2
        s[:, b < 0] = -2
    mine, theirs = left["ids"][i], right["ids"][j]
    if np.isin(mine, theirs).any():
        s[mine[:, None] == theirs[None, :]] = -3
    return s, 1.2e-7 * (x.shape[1] + 4) + 1e-9


def _exactly(left: dict, right: dict, i: np.ndarray, j: np.ndarray, near: np.ndarray) -> np.ndarray:
    """The cosines of pairs of rows in double precision, rounded as SQL does; `near` has those that are not cosines."""
    out = near.astype(np.float64)
    plain = np.flatnonzero(np.abs(near) < 1.5)
    for at in range(0, len(plain), 1 << 16):
        these = plain[at : at + (1 << 16)]
        out[these] = np.round(np.einsum("nd,nd->n", left["units"][i[these]], right["units"][j[these]]), 9)
    return out


def first_hits(vectors: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """(query, first): for every vector (id, label, vector) the rank among its exact cosine neighbours, ties by id, of the first that has its label; null if that is not among the first `k`.

    All vectors are compared with all: blocks meet each other, of which a task holds two at a time, and none goes through
    the driver. First the best neighbour with the same label is found, then the vectors before it are counted, so nothing
    but a number or two is kept of a vector and its neighbours are never put in order.
    """
    blocks = _blocks(vectors, block)

    def unpacked(row: dict, side: str) -> dict:
        kinds = {"ids": np.int64, "labels": np.int64, "labelled": np.bool_, "units": np.float64, "norms": np.float64, "best": np.float64, "key": np.int64}
        out = {c: np.frombuffer(row[f"{side}{c}"], t) for c, t in kinds.items() if f"{side}{c}" in row}
        out["units"] = out["units"].reshape(len(out["ids"]), -1)
        return out | {"fast": out["units"].astype(np.float32)}

    def met(left: DataFrame, start, add, names: list[str]) -> DataFrame:
        """Every block of `left` with every block; what `add` sums up for one of them is given once for a task."""
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, own, state = None, None, None
            given = lambda: pa.RecordBatch.from_pydict({"b": [at], **{c: [np.ascontiguousarray(state[c]).tobytes()] for c in names}}, schema=pa.schema([("b", pa.int64()), *((c, pa.binary()) for c in names)]))
            for batch in batches:
                for k in range(batch.num_rows):
                    row = batch.slice(k, 1).to_pylist()[0]
                    if row["b"] != at:
                        if at is not None:
                            yield given()
                        at, own = row["b"], unpacked(row, "")
                        state = start(own)
                    add(state, own, unpacked(row, "_"))
            if at is not None:
                yield given()

        others = blocks.select(*(F.col(c).alias(f"_{c}") for c in blocks.columns if c != "b"))
        return left.crossJoin(others).mapInArrow(each, f"b long, {', '.join(f'{c} binary' for c in names)}")

    def no_best(own: dict) -> dict:
        n = len(own["ids"])
        return {"best": np.full(n, -np.inf), "key": np.full(n, np.iinfo(np.int64).max), "seen": np.zeros(n, np.bool_)}

    def better(state: dict, i: np.ndarray, best: np.ndarray, key: np.ndarray) -> None:
        wins = (best > state["best"][i]) | ((best == state["best"][i]) & (key < state["key"][i]))
        state["best"][i[wins]], state["key"][i[wins]] = best[wins], key[wins]

    def nearest_hit(state: dict, own: dict, other: dict) -> None:
        state["seen"] |= (own["ids"] != other["ids"].min()) | (own["ids"] != other["ids"].max())
        for label in np.unique(own["labels"][own["labelled"]]):
            i, j = (np.flatnonzero((x["labels"] == label) & x["labelled"]) for x in (own, other))
            if len(j):
                s, off = _similar(own, other, i, j)
                x, y = np.nonzero((s >= s.max(axis=1)[:, None] - 2 * off) & (s > -3))  # one of these is the best
                r, x, y = _exactly(own, other, i[x], j[y], s[x, y]), i[x], other["ids"][j[y]]
                order = np.lexsort((y, -r, x))
                order = order[np.diff(x[order], prepend=-1) != 0]
                better(state, x[order], r[order], y[order])

    def one_best(found: pa.Table) -> pa.Table:
        rows, state = found.to_pylist(), None
        for row in rows:
            best, key, seen = np.frombuffer(row["best"]), np.frombuffer(row["key"], np.int64), np.frombuffer(row["seen"], np.bool_)
            state = state or {"best": np.full(len(best), -np.inf), "key": np.full(len(best), np.iinfo(np.int64).max), "seen": np.zeros(len(best), np.bool_)}
            better(state, np.arange(len(best)), best, key)
            state["seen"] |= seen
        return pa.table({"b": rows[0:1] and [rows[0]["b"]], **{c: pa.array([state[c].tobytes()], pa.binary()) for c in state}})

    def before(state: dict, own: dict, other: dict) -> None:
        for at in range(0, len(own["ids"]), HELD):
            rows = slice(at, at + HELD)
            (s, off), best = _similar(own, other, rows), own["best"][rows, None]
            sure, about = s > best + off, s >= best - off
            surely = np.count_nonzero(sure, axis=1)
            state["before"][rows] += surely
            if np.count_nonzero(about) != surely.sum():  # what precision and rounding decide, or the id
                i, j = np.nonzero(about & ~sure & (s > -3))
                r, i = _exactly(own, other, at + i, j, s[i, j]), at + i
                wins = (r > own["best"][i]) | ((r == own["best"][i]) & (other["ids"][j] < own["key"][i]))
                state["before"] += np.bincount(i[wins], minlength=len(own["ids"]))

    def ranked(found: pa.Table) -> pa.Table:
        rows = found.to_pylist()
        read = lambda c, kind, row=rows[0]: np.frombuffer(row[c], kind)
        total = sum(read("before", np.int64, row) for row in rows)
        seen, none = read("seen", np.bool_), np.isinf(read("best", np.float64)) | (total >= k)
        return pa.table({"query": pa.array(read("ids", np.int64)[seen]), "first": pa.array((total + 1)[seen], mask=none[seen])})

    best = met(blocks, no_best, nearest_hit, ["best", "key", "seen"]).groupBy("b").applyInArrow(one_best, "b long, best binary, key binary, seen binary")
    asked = materialize(blocks.join(best, "b"))
    counted = met(asked, lambda own: {"before": np.zeros(len(own["ids"]), np.int64)}, before, ["before"])
    return counted.join(asked.select("b", "ids", "best", "seen"), "b").groupBy("b").applyInArrow(ranked, "query long, first long")
