"""Helpers of the relational operators."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeweave.plans.materialize import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def broadcast_if_small(df: DataFrame, most: int = 64 << 20) -> DataFrame:
    """Marks `df` for broadcast if its rows take at most about `most` bytes as text; a larger one is left to a shuffle join.

    Every row counts as eight bytes for each column and its strings and arrays besides; at most `most` / 16 rows are looked at.
    """
    plain = lambda f: F.length(F.col(f"`{f.name}`")) if f.dataType.typeName() == "string" else F.length(F.to_json(F.struct(F.col(f"`{f.name}`"))))
    wide = [F.coalesce(plain(f), F.lit(0)) for f in df.schema.fields if f.dataType.typeName() in ("string", "array", "struct", "map")]
    size = sum(wide, F.lit(8 * max(1, len(df.columns))))
    rows = most // 16
    n, total = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and total <= most else df


def top(df: DataFrame, keys, order, k: int, name: str = "rank") -> DataFrame:
    """The first `k` rows of each key under a total order, numbered from 1."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, rank).where(F.col(name) <= k)


def first_of(df: DataFrame, keys, order) -> DataFrame:
    return top(df, keys, order, 1, "_first").drop("_first")


def when_of(ladder: list[tuple[Column, object]], default) -> Column:
    e = None
    for condition, value in ladder:
        value = value if isinstance(value, Column) else F.lit(value)
        e = F.when(condition, value) if e is None else e.when(condition, value)
    return e.otherwise(default if isinstance(default, Column) else F.lit(default))


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal `keys`, of which nulls equal one another; the keys are the left side's."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(renamed, reduce(and_, on), how).drop(*(f"_right_{k}" for k in keys))


def in_ranges(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """`df` written in ranges of (keys, order), nulls first, with the `_part` of a row and its `_id`, which ascends over all.

    Ranges are cut by a sample of any orderable type, so a key with very many rows is dealt over tasks.
    """
    cuts = [F.col(c).asc_nulls_first() for c in (*keys, *order)]
    rows = materialize(df.repartitionByRange(*cuts).sortWithinPartitions(*cuts).withColumn("_id", F.monotonically_increasing_id()))
    return rows.withColumn("_part", F.shiftright("_id", 33))


def before_in_key(runs: DataFrame, keys: list[str], size: str) -> DataFrame:
    """Adds `_before` to `runs` (keys, _part, size): what the key's earlier parts hold."""
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn("_before", F.coalesce(F.sum(size).over(earlier), F.lit(0)))


def numbered(df: DataFrame, keys: list[str], order: str, name: str, frequent: int = 1 << 17) -> DataFrame:
    """Adds the row's number from 1 among those of its key, null being a key, by `order`, nulls first.

    Keys of more than `frequent` rows are numbered in ranges of their rows, which are then moved by the ranges before.
    """
    hot = df.groupBy(*keys).agg(F.count("*").alias("_m")).where(F.col("_m") > frequent).drop("_m")
    hot = materialize(hot)
    plain = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).asc_nulls_first())).cast("long")
    if hot.isEmpty():
        return df.withColumn(name, plain)
    hot = broadcast_if_small(hot)  # a row for `frequent` rows at most
    rows = in_ranges(null_safe_join(df, hot, keys, "left_semi"), keys, [order])
    runs = before_in_key(rows.groupBy(*keys, "_part").agg(F.min("_id").alias("_first"), F.count("*").alias("_m")), keys, "_m")
    moved = null_safe_join(rows, broadcast_if_small(runs.drop("_m")), [*keys, "_part"])
    moved = moved.withColumn(name, F.col("_id") - F.col("_first") + F.col("_before") + 1).select(*df.columns, name)
    return null_safe_join(df, hot, keys, "left_anti").withColumn(name, plain).unionByName(moved)


def at_ranks(df: DataFrame, by: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """(by, n, a column for each rank): the values of `value` (no nulls) at ranks from 0, given as expressions of the group's size `n`. A null in `by` is a group.

    Equal values are counted first; ranges of values are added up, and only distinct values of one range are put in
    order in a task.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_m"))
    rows = in_ranges(counts, by, [value])
    runs = before_in_key(rows.groupBy(*by, "_part").agg(F.sum("_m").alias("_s")), by, "_s")
    runs = runs.withColumn("n", F.sum("_s").over(Window.partitionBy(*by))).drop("_s")
    upto = F.col("_before") + F.sum("_m").over(Window.partitionBy(*by, "_part").orderBy(value))
    placed = null_safe_join(rows, broadcast_if_small(runs), [*by, "_part"]).withColumn("_upto", upto)
    here = lambda rank: (F.col("_upto") - F.col("_m") <= rank) & (rank < F.col("_upto"))
    return placed.groupBy(*by).agg(F.max("n").alias("n"), *(F.max(F.when(here(r), F.col(value))).alias(c) for c, r in ranks.items()))
