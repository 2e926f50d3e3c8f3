"""Retrieval quality over all vectors, against DuckDB."""

import math
import random

import duckdb
import pytest

from citeweave.operators import evaluate as E
from citeweave.plans import queries as plans


def made(n, rng):
    """Vectors of few values, so that many are equal; some are null, zero or without a label."""
    rows = []
    for k in range(n):
        v = None if k % 41 == 7 else [0.0, 0.0, 0.0] if k % 37 == 5 else [float(rng.randint(-2, 2)) for _ in range(3)]
        rows.append((3 * k, v, None if k % 29 == 3 else "only" if k == 11 else rng.choice("abcdefghij")))
    return rows


@pytest.mark.parametrize("block", [7, 64, 2048])
def test_first_hits_are_those_of_sql(spark, block):
    rows = made(150, random.Random(1))
    con = duckdb.connect()
    con.sql("CREATE TABLE v (id BIGINT, e DOUBLE[], label VARCHAR)")
    con.executemany("INSERT INTO v VALUES (?, ?, ?)", rows)
    sql = """WITH s AS (SELECT q.id AS q, q.label = v.label AS hit, row_number() OVER (PARTITION BY q.id ORDER BY round(list_cosine_similarity(q.e, v.e), 9) DESC, v.id) AS rank FROM v q JOIN v ON q.id <> v.id)
        SELECT q, min(CASE WHEN hit THEN rank END) FROM s WHERE rank <= 9 GROUP BY 1"""
    df = spark.createDataFrame(rows, "id long, vector array<double>, label string")
    got = {r["query"]: r["first"] for r in E.first_hits(df, 9, block).collect()}
    assert got == dict(con.sql(sql).fetchall())
    assert None in got.values() and {1, 2} <= set(got.values())


def test_first_hits_of_few_vectors(spark):
    names = "id long, vector array<double>, label string"
    assert E.first_hits(spark.createDataFrame([], names), 5).collect() == []
    assert E.first_hits(spark.createDataFrame([(1, [1.0], "a")], names), 5).collect() == []
    assert sorted(tuple(r) for r in E.first_hits(spark.createDataFrame([(1, None, "a"), (2, None, "a"), (3, [-2.0], "b")], names), 5, 1).collect()) == [(1, 1), (2, 1), (3, None)]
    assert sorted(tuple(r) for r in E.first_hits(spark.createDataFrame([(1, [1.0], "a"), (2, [3.0], "b"), (3, [-2.0], "b")], names), 5).collect()) == [(1, None), (2, 2), (3, 2)]


def test_recall_asks_every_vector(spark, tmp_path):
    """No id is divisible by 20: a twentieth of the ids as queries has nothing to count."""
    rng = random.Random(2)
    rows = [(20 * k + 1, [rng.gauss(0, 1) for _ in range(4)], rng.randint(0, 3)) for k in range(90)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.sql(plans.ORACLES["recall_mrr"])
    got = plans.QUERIES["recall_mrr"](spark, str(tmp_path)).first()
    assert got["queries"] == 90
    assert all(math.isclose(got[c], v, abs_tol=1e-6) for c, v in zip(want.columns, want.fetchall()[0]))
