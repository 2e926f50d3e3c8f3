"""Sinks: records, tables, search indexes, request exports and result imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.operators.common import first_of
from citeweave.operators.records import upsert
from citeweave.operators.retrieve import postings, token_df, unit_lengths
from citeweave.plans.materialize import materialize


def write_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_index(units: DataFrame, fields: dict[str, Column], name: str, buckets: int = 64, least: dict[str, int] | None = None) -> None:
    """Saves postings, unit lengths and pruned document frequencies of (key, …) as tables `name_postings`, `name_lengths`, `name_df`.

    Postings are bucketed and sorted by token, so that joins on tokens need no further shuffle of the index.
    """
    for k, (field, tokens) in enumerate(fields.items()):
        mode = "overwrite" if k == 0 else "append"
        index = postings(units, tokens, field=field)
        index.write.mode(mode).bucketBy(buckets, "token").sortBy("token").saveAsTable(f"{name}_postings")
        unit_lengths(units, tokens).withColumn("field", F.lit(field)).write.mode(mode).saveAsTable(f"{name}_lengths")
        token_df(index, (least or {}).get(field, 1)).write.mode(mode).saveAsTable(f"{name}_df")


def requests(units: DataFrame, title: Column, text: Column, part: Column | None = None, longest: int = 6000) -> DataFrame:
    """(id, text): `title: … | text: …` of each unit, and of its part as `key#p` where it has one."""
    body = lambda t: F.substring(F.concat(F.lit("title: "), F.coalesce(title, F.lit("none")), F.lit(" | text: "), t), 1, longest)
    df = units.where(text.isNotNull()).select(F.col("key").alias("id"), body(text).alias("text"))
    if part is not None:
        df = df.unionByName(units.where(part.isNotNull()).select(F.concat("key", F.lit("#p")).alias("id"), body(part).alias("text")))
    return df


def write_requests(df: DataFrame, path: str, per_file: int = 5000) -> None:
    """Shards of `per_file` requests and a manifest of their ids."""
    df.write.mode("overwrite").option("maxRecordsPerFile", per_file).json(f"{path}/requests")
    df.select("id").write.mode("overwrite").parquet(f"{path}/manifest")


def read_results(spark: SparkSession, path: str, results: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(results that the manifest asked for, manifest ids without one)."""
    manifest = spark.read.parquet(f"{path}/manifest")
    found = spark.read.schema(schema).json(results).where("id is not null")
    return found.join(manifest, "id", "left_semi"), manifest.join(found.select("id"), "id", "left_anti")


def read_index(spark: SparkSession, name: str, field: str) -> tuple[DataFrame, DataFrame]:
    """(postings, lengths) of one field of a saved index, for `retrieve.search_index`."""
    return tuple(spark.table(f"{name}_{part}").where(F.col("field") == field) for part in ("postings", "lengths"))


BUCKET = "_bucket"


def _bucketed(df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    return df.withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


def write_keyed(df: DataFrame, path: str, keys: list[str], buckets: int = 64) -> None:
    """Saves a table in `buckets` parts by the hash of its keys, so that later changes read and write the parts that they touch."""
    _bucketed(df, keys, buckets).repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(path)


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(BUCKET)


def _change(spark: SparkSession, path: str, by: DataFrame, keys: list[str], buckets: int, change) -> int:
    """Rewrites the parts that hold keys of `by` as `change(old rows, rows of `by`)` says; returns how many parts that were.

    The new rows are written beside the table before a part is replaced, so a lost job leaves the old parts or is run again.
    """
    by = materialize(_bucketed(by, keys, buckets))
    touched = sorted(r[0] for r in by.select(BUCKET).distinct().collect())  # `buckets` numbers at most
    if not touched:
        return 0
    old = spark.read.parquet(path).where(F.col(BUCKET).isin(touched))
    new = materialize(change(old, by))
    new.repartition(BUCKET).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(BUCKET).parquet(path)
    left = {r[0] for r in new.select(BUCKET).distinct().collect()}
    for k in set(touched) - left:  # a part without rows is not written over
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{BUCKET}={k}")
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return len(touched)


def upsert_keyed(spark: SparkSession, path: str, rows: DataFrame, keys: list[str], order: list[str], buckets: int = 64) -> int:
    """Puts `rows` over those of equal keys, the first by `order` where a key repeats; rewrites only the parts that they fall into."""
    def change(old: DataFrame, new: DataFrame) -> DataFrame:
        return upsert(old, first_of(new, keys, order), keys)

    return _change(spark, path, rows, keys, buckets, change)


def backfill_keyed(spark: SparkSession, path: str, values: DataFrame, key: str, column: str, buckets: int = 64) -> int:
    """`backfill` of a saved table, in the parts that hold the keys."""
    return _change(spark, path, values, [key], buckets, lambda old, v: backfill(old, v, key, column))


def delete_keyed(spark: SparkSession, paths: list[str], gone: DataFrame, keys: list[str], buckets: int = 64) -> int:
    """Deletes keys from several saved tables, in the parts that hold them."""
    return sum(_change(spark, path, gone.select(*keys).distinct(), keys, buckets, lambda old, g: old.join(g.select(*keys), keys, "left_anti")) for path in paths)


def backfill(df: DataFrame, values: DataFrame, key: str, column: str) -> DataFrame:
    """`column` set from (key, column) where a value is given."""
    v = values.select(F.col(key), F.col(column).alias("_v"))
    return df.join(v, key, "left").withColumn(column, F.coalesce("_v", column)).drop("_v")


def write_versioned(df: DataFrame, path: str, version: str, now: Column, days: int) -> None:
    """Adds results to a store partitioned by version, with the time they expire."""
    df.withColumns({"version": F.lit(version), "expires_at": now + F.expr(f"interval {days} days")}).write.mode("append").partitionBy("version").parquet(path)


def read_versioned(spark: SparkSession, path: str, version: str, now: Column) -> DataFrame:
    return spark.read.parquet(path).where((F.col("version") == version) & (F.col("expires_at") > now))


def sample_rows(units: DataFrame, wanted: DataFrame, collections: list[str], numbers: dict[str, tuple[int, int]]) -> DataFrame:
    """Units that are wanted by key, of whole collections, or in a number range of one."""
    keep = F.col("collection").isin(collections)
    for c, (low, high) in numbers.items():
        keep = keep | ((F.col("collection") == c) & F.col("number_base").between(low, high))
    return units.where(keep).unionByName(units.where(~keep).join(wanted.select("key").distinct(), "key", "left_semi"))
