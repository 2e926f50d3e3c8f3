"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeweave.plans.materialize import materialize

__all__ = ["SPACE", "ascii_lower", "let", "materialize", "table", "with_text_columns", "words"]

#: ASCII white space, the separators of a word in `[^\x20\x09-\x0D]+`.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once per row."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and leaves every other character alone."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def words(text: Column) -> Column:
    """Array of the maximal runs without ASCII white space; empty for null or blank text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


#: Texts that are Python objects at a time.
SLICE = 200


def with_text_columns(df: DataFrame, text: str, make: Callable[[], Callable[[str | None], tuple]], added: list[tuple[str, str]]) -> DataFrame:
    """`df` and the columns `added` (name, type), of which `make()(text)` gives a tuple per row. Rows are taken a few at a time."""
    names = [n for n, _ in added]
    schema = T.StructType([f for f in df.schema.fields if f.name not in names] + T.StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in added)).fields)
    rest, at = [c for c in df.columns if c not in names], df.columns.index(text)
    kinds = {"string": pa.string(), "double": pa.float64(), "long": pa.int64(), "array<string>": pa.list_(pa.string())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                part = batch.slice(k, SLICE)
                made = list(zip(*map(f, part.column(at).to_pylist())))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), *(pa.array(x, kinds[t]) for x, (_, t) in zip(made, added))], names=[*rest, *names])

    return df.mapInArrow(run, schema)
