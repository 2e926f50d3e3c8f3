"""Merkle manifest of a table: a leaf for each row, a tree for each source, a tree over the sources, and proofs.

Every run of `FAN` nodes becomes the digest of its members. Leaves are numbered within ranges, so a source of any size is
dealt over tasks; superblocks of `FAN ** height` consecutive leaves are reduced to one node each, these nodes again, until
every tree has one. Proofs come down the same way: the leaves of a superblock and the nodes outside it that their proofs
need are cogrouped, and one function finishes the local reduction, joins both parts of a proof and folds it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeweave.llm.common import materialize
from citeweave.operators.common import broadcast_if_small

FAN = 3

#: A superblock holds 3 ** 6 = 729 leaves.
HEIGHT = 6

#: Small trees that are in one group together.
TOGETHER = 16

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

#: Number of the tree over the sources; those of the sources start at 0.
TOP = -1

_PATH = "array<struct<before: string, after: string>>"


def digest(value: str) -> str:
    return hashlib.sha256(value.encode()).hexdigest()


def leaf_digest(fields: Iterable[Column]) -> Column:
    """Digest of a row: each field `-` if null, else the number of its UTF-8 bytes, a colon and the value."""
    parts = []
    for f in fields:
        s = f.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def tampered_text(doc_id: Column, text: Column) -> Column:
    """The text as a row's tampering leaves it: without line ends where 2 divides the crc32 of the id, which a null id has not."""
    return F.when(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.translate(text, "\n", "")).otherwise(text)


def _placed(df: DataFrame, tree: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(`df` with `_id`, offsets): `_id` less `_first` plus `_before` of the row's (tree, `_part`) in the offsets is its
    number from 0 within the tree by `order`; `_n` is the size of the tree. Offsets have a row for each tree and range."""
    cuts = [F.col(c).asc_nulls_first() for c in (*tree, *order)]
    placed = materialize(df.repartitionByRange(*cuts).sortWithinPartitions(*cuts).withColumn("_id", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_id", 33))
    runs = placed.groupBy(*tree, "_part").agg(F.min("_id").alias("_first"), F.count("*").alias("_m"))
    whole = Window.partitionBy(*tree) if tree else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("_m").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed, runs.withColumns({"_before": before, "_n": F.sum("_m").over(whole)}).drop("_m")


def _runs_up(nodes: list[str], n: int, height: int) -> list[list[str]]:
    """The levels of a superblock from its nodes up: `height` runs if its tree of `n` nodes goes on above it, else to one node."""
    levels = [nodes]
    while len(levels) <= height if n > FAN**height else len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([digest("".join(below[i : i + FAN])) for i in range(0, len(below), FAN)])
    return levels


def _path(levels: list[list[str]], at: int) -> list[tuple[str, str]]:
    """Siblings of a node before and after it, level by level."""
    found = []
    for level in levels[:-1]:
        start = at - at % FAN
        found.append(("".join(level[start:at]), "".join(level[at + 1 : start + FAN])))
        at //= FAN
    return found


def _pieces(rows: pd.DataFrame) -> Iterator[tuple[tuple[int, int], pd.DataFrame]]:
    """Superblocks of a group, nodes in order."""
    yield from rows.sort_values(["tree", "pos"], kind="stable").groupby(["tree", "block"], sort=False)


def _packed(df: DataFrame, large: Column) -> DataFrame:
    """Adds `pack`, by which rows are grouped: one superblock of a large tree, or some small trees together."""
    return df.withColumn("pack", F.struct(F.when(large, F.col("tree")).otherwise(F.floor(F.col("tree") / TOGETHER)).alias("t"), F.when(large, F.col("block")).otherwise(F.lit(-1)).alias("b")))


def _in_superblocks(nodes: DataFrame, height: int) -> DataFrame:
    return _packed(nodes.withColumn("block", F.floor(F.col("pos") / FAN**height)), F.col("n") > FAN**height)


def _climb(leaves: DataFrame, most: int, height: int) -> tuple[list[DataFrame], DataFrame]:
    """([nodes of each round], roots (tree, digest)); `most` is the size of the largest tree."""

    def reduce(rows: pd.DataFrame) -> pd.DataFrame:
        made = []
        for (tree, block), p in _pieces(rows):
            n = int(p["n"].iat[0])
            made.append((tree, block, -(-n // FAN**height), _runs_up(p["digest"].tolist(), n, height)[-1][0]))
        return pd.DataFrame(made, columns=["tree", "pos", "n", "digest"])

    rounds, roots = [leaves], leaves.where("n = 1").select("tree", "digest")
    while most > 1:
        nodes = _in_superblocks(rounds[-1].where("n > 1").select("tree", "pos", "n", "digest"), height)
        rounds.append(materialize(nodes.groupBy("pack").applyInPandas(reduce, "tree long, pos long, n long, digest string")))
        roots = roots.union(rounds[-1].where("n = 1").select("tree", "digest"))
        most = -(-most // FAN**height)
    return rounds, roots


_OUTER = f"tree long, pos long, n long, path {_PATH}, subroot string, root string"


def _carried(node, path, outer) -> tuple:
    return node.tree, node.pos, node.n, [{"before": b, "after": a} for b, a in path], outer.subroot, outer.root


def _descend(rounds: list[DataFrame], above: DataFrame, height: int, finish=_carried, schema: str = _OUTER) -> DataFrame:
    """`finish(node, its path to the root of everything, row of what lies outside its superblock)` for each node of the first round.

    `above` has a row for each tree: tree, path (of its root), subroot, root.
    """

    def exchange(make, names):
        def cogrouped(rows: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
            known = {(o.tree, o.block): o for o in outer.itertuples(index=False)}
            made = []
            for key, p in _pieces(rows):
                levels, o = _runs_up(p["digest"].tolist(), int(p["n"].iat[0]), height), known[key]
                outside = [(s["before"], s["after"]) for s in o.path]
                made += [make(node, _path(levels, at) + outside, o) for at, node in enumerate(p.itertuples(index=False))]
            return pd.DataFrame(made, columns=names)

        return cogrouped

    paths = None
    for k in range(len(rounds) - 1, -1, -1):
        tops = rounds[k].where("n = 1").select("tree", F.col("pos").alias("block"), "n").join(above, "tree")
        outer = tops if paths is None else tops.unionByName(paths.withColumnRenamed("pos", "block"))
        make, out = (finish, schema) if k == 0 else (_carried, _OUTER)
        nodes = _in_superblocks(rounds[k], height).groupBy("pack")
        outer = _packed(outer.toDF(*outer.columns), F.col("n") > 1).groupBy("pack")  # renamed: both sides come from one table
        paths = nodes.cogroup(outer).applyInPandas(exchange(make, _names(out)), out)
    return paths


def _names(schema: str) -> list[str]:
    return T.StructType.fromDDL(schema).fieldNames()


_PROOF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _proved(node, path, outer) -> tuple:
    """A document's proof, and the root that folding it from the leaf as it is found gives."""
    folded = node.tampered
    for before, after in path:
        folded = digest(before + folded + after)
    proof = digest("".join(b + a for b, a in path))
    return (None if pd.isna(node.doc_id) else int(node.doc_id)), node.digest, outer.subroot, outer.root, proof, folded, folded == outer.root


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, height: int = HEIGHT) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), one row per input row.

    `fields` name doc_id (integer), source, two more and text, in the order in which a leaf takes them; one that the table
    lacks is null. A null field is `-`, so it differs from an empty one; null sources are a source, the first; null doc_ids
    come first in it and are never tampered with. Rows of one source and doc_id are ordered by their leaf, so equal rows
    have equal digests and each keeps its place; very long texts are hashed whole, where they are scanned; an empty table
    gives an empty table; further columns are not read. `verified` is true where the tampering changed nothing.
    """
    given = [F.col(f"`{c}`") if c in docs.columns else F.lit(None) for c in fields]
    named = docs.select(*(c.cast(t).alias(n) for c, t, n in zip(given, ("long", "string", "string", "string", "string"), FIELDS)))
    columns = [F.col(c) for c in FIELDS]
    text = tampered_text(columns[0], columns[-1])
    leaves = named.select("doc_id", "source", leaf_digest(columns).alias("digest"), F.when(text != F.col("text"), leaf_digest([*columns[:-1], text])).alias("tampered"))
    leaves, runs = _placed(leaves, ["source"], ["doc_id", "digest"])
    sources, source_runs = _placed(runs.select("source").distinct(), [], ["source"])
    sources = sources.join(broadcast_if_small(source_runs), "_part").select("source", (F.col("_id") - F.col("_first") + F.col("_before")).alias("tree"), F.col("_n").alias("_sources"))
    sources = materialize(sources)
    runs = runs.join(sources.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).select("tree", "_s", F.col("_part").alias("_p"), "_first", "_before", "_n")
    runs = materialize(runs)
    place = (F.col("_id") - F.col("_first") + F.col("_before")).alias("pos")
    here = F.col("source").eqNullSafe(F.col("_s")) & (F.col("_part") == F.col("_p"))
    leaves = leaves.join(broadcast_if_small(runs), here).select("tree", place, F.col("_n").alias("n"), "digest", F.coalesce("tampered", "digest").alias("tampered"), "doc_id")
    most, n_sources = runs.agg(F.coalesce(F.max("_n"), F.lit(0)), F.count_distinct("tree")).first()
    rounds, subroots = _climb(leaves, most, height)
    subroots = materialize(subroots)
    top, root = _climb(subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(n_sources).cast("long").alias("n"), "digest"), n_sources, height)
    none = F.array().cast(_PATH)
    whole = root.select("tree", none.alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    up = _descend(top, whole, height).select(F.col("pos").alias("tree"), "path", "root")
    above = materialize(up.join(subroots, "tree").select("tree", "path", F.col("digest").alias("subroot"), "root"))
    return _descend(rounds, above, height, _proved, _PROOF)
