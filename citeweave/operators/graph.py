"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.operators.common import broadcast_if_small
from citeweave.plans.materialize import materialize


#: Edges of a node that one task takes; the ends of a node with more meet its minimum where they are.
HUB = 4096


def _least(edges: DataFrame) -> DataFrame:
    """(u, m, degree): the smallest neighbour of each node."""
    return materialize(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree")))


def by_shuffle(df: DataFrame) -> DataFrame:
    """Marks `df`, a table with a row for each node, so that it is not broadcast in joins: that would send it to the driver in every round."""
    return df.hint("merge")


def _met(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Edges with the minimum of `u`. The edges of hubs are not shuffled: their minima, one for `HUB` edges at most, come to them."""
    hubs = broadcast_if_small(least.where(F.col("degree") > HUB).select("u", "m"))
    rest = least.where(F.col("degree") <= HUB).select("u", "m")
    return edges.join(hubs, "u").unionByName(edges.join(hubs, "u", "left_anti").join(by_shuffle(rest), "u"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest node of its neighbourhood."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("u", "m").alias("m"), "degree")
    return _met(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links every smaller neighbour of a node, and the node, to the smallest of them. Edges run from u down to v."""
    least = _least(edges)
    moved = _met(edges, least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge between two different nodes; component is the smallest node reached.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until every component is a star. Each round is
    written out, so that lineage stays short; minima are combined before they are shuffled, so that no node's
    neighbours are gathered in one place. Nulls and loops are dropped.
    """
    e = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where(F.col(u).isNotNull() & F.col(v).isNotNull() & (F.col(u) != F.col(v)))
    e, before = materialize(e.distinct()), None
    for _ in range(max_rounds):
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before or not now[0]:
            break
        before = tuple(now)
        e = materialize(_small_star(materialize(_large_star(e))))
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def extended_components(components: DataFrame, edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) of `components` (node, component) and further edges, as if all edges had been there from the start.

    Only the ends of the new edges and the components that they touch are gone through: these become the nodes of a small
    graph, whose components say which old ones are one now.
    """
    known = components.select("node", "component")
    ends = edges.where(F.col(u).isNotNull() & F.col(v).isNotNull() & (F.col(u) != F.col(v))).select(F.col(u).alias("_a"), F.col(v).alias("_b"))
    at = ends.join(by_shuffle(known.toDF("_a", "_ca")), "_a", "left").join(by_shuffle(known.toDF("_b", "_cb")), "_b", "left")
    at = materialize(at.select("_a", "_b", F.coalesce("_ca", "_a").alias("u"), F.coalesce("_cb", "_b").alias("v")))
    moved = materialize(connected_components(at).toDF("component", "_to"))
    old = known.join(broadcast_if_small(moved), "component", "left").select("node", F.coalesce("_to", "component").alias("component"))
    fresh = at.select(F.col("_a").alias("node"), F.col("u").alias("component")).union(at.select(F.col("_b").alias("node"), F.col("v").alias("component"))).distinct()
    fresh = fresh.join(by_shuffle(known.select("node")), "node", "left_anti").join(by_shuffle(moved), "component", "left").select("node", F.coalesce("_to", "component").alias("component"))
    return old.unionByName(fresh)
