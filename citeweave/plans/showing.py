"""Registered queries of keys, presentation and quizzes, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeweave.functions.text import alias_key
from citeweave.operators import documents as D
from citeweave.operators import listing as G
from citeweave.operators.common import table
from citeweave.plans.queries import _LINES, query


@query("""WITH a AS (SELECT o_orderkey AS ask_id, o_orderkey % 4 AS n, o_custkey % 150 AS k, o_custkey % 30 AS c, o_custkey % 6 AS v FROM orders),
r AS (SELECT a.*, s_suppkey IS NOT NULL AS known, n_nationkey IS NOT NULL AS verse FROM a LEFT JOIN supplier ON s_suppkey = k LEFT JOIN nation ON n_nationkey = c AND n_regionkey = v)
SELECT ask_id, CASE WHEN n < 2 AND known THEN 'sup:' || k WHEN n >= 2 AND verse THEN 'quran:' || c || ':' || v END AS key, CASE WHEN n = 0 AND known THEN 'name' WHEN n = 1 AND known THEN 'key' WHEN n >= 2 AND verse THEN 'verse' END AS resolved_by FROM r""")
def keys_resolved(spark, sf_dir):
    """Keys as people write them: a collection's name and a number, a key, chapter and verse, with and without the book's name."""
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    k, c, v = F.col("o_custkey") % 150, F.col("o_custkey") % 30, F.col("o_custkey") % 6
    n = F.col("o_orderkey") % 4
    form = F.when(n == 0, text("  Suppliers # ", k)).when(n == 1, text("SUP:", k)).when(n == 2, text(c, ":", v)).otherwise(text("Quran:", c, ":", v))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ask_id"), form.alias("ask"))
    suppliers = table(spark, sf_dir, "supplier").select(text("sup:", F.col("s_suppkey")).alias("key"), F.lit("sup").alias("collection"), F.col("s_suppkey").cast("string").alias("number"))
    verses = table(spark, sf_dir, "nation").select(text("quran:", F.col("n_nationkey"), ":", F.col("n_regionkey")).alias("key"), F.lit("quran").alias("collection"), text(F.col("n_nationkey"), ":", F.col("n_regionkey")).alias("number"))
    aliases = spark.createDataFrame([("suppliers", "sup")], "alias string, collection string").withColumn("alias", alias_key(F.col("alias")))
    none = spark.createDataFrame([], "key string, source_key string")
    found = G.resolve_keys(orders.select("ask").distinct(), suppliers.unionByName(verses), aliases, none)
    return orders.join(found, "ask").select("ask_id", "key", "resolved_by")


@query("""SELECT doc_id || '' AS key, CASE source WHEN 'src0' THEN 'Nullte' WHEN 'src1' THEN 'First' ELSE source END || ' ' || doc_id AS reference, coalesce(lang, 'none') AS title, n_chars AS en,
CASE WHEN doc_id % 3 = 0 THEN 'u' || doc_id ELSE 's' || doc_id END AS url FROM documents""")
def rows_presented(spark, sf_dir):
    """Documents as they are shown: the collection's name in a language or else in English, titles and addresses that fall back."""
    names = spark.createDataFrame([("src0", "Zeroth", "Nullte"), ("src1", "First", None)], "collection string, name_en string, name_de string")
    key = F.col("doc_id").cast("string")
    units = table(spark, sf_dir, "documents").select(
        key.alias("key"), F.col("source").alias("collection"), key.alias("number"), F.col("lang").alias("title_en"), F.lit("none").alias("chapter_en"), F.lit(None).cast("string").alias("ar_matn"),
        F.col("n_chars").alias("en_text"), F.lit(None).cast("string").alias("id_text"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("u"), key)).alias("url"), F.concat(F.lit("s"), key).alias("sunnah_url"),
    )
    return G.presented(units, names, "de").select("key", "reference", "title", F.col("texts.en").alias("en"), "url")


@query(f"""WITH {_LINES}, n AS (SELECT doc_id, max(seg) AS last FROM lines GROUP BY 1), i AS (SELECT doc_id, doc_id % 6 AS o, doc_id % 5 AS answer, doc_id % 12 AS paragraph FROM documents)
SELECT doc_id, answer, paragraph FROM i JOIN n USING (doc_id) WHERE o = 4 AND answer <= 3 AND paragraph <= last""")
def quizzes_checked(spark, sf_dir):
    """Quiz items with too few or too many options, answers and paragraphs that are not there, are left out."""
    docs = table(spark, sf_dir, "documents")
    options = F.when(F.col("doc_id") % 6 == 0, F.array().cast("array<string>")).otherwise(F.array_repeat(F.lit("x"), (F.col("doc_id") % 6).cast("int")))
    items = docs.select("doc_id", options.alias("options"), (F.col("doc_id") % 5).alias("answer"), (F.col("doc_id") % 12).alias("paragraph"))
    return G.valid_quiz(items, D.line_segments(docs)).select("doc_id", "answer", "paragraph")


@query("""WITH f AS (SELECT l_orderkey AS doc_id, l_linenumber AS span, l_partkey AS key, 'p' || l_partkey % 50 AS reference FROM lineitem),
s AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY doc_id, reference ORDER BY span, key) = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY span, reference) - 1 AS n, count(*) OVER (PARTITION BY doc_id) AS total, list(reference) OVER (PARTITION BY doc_id ORDER BY span, reference ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS a FROM s),
w AS (SELECT *, list_transform(range(1, least(3, total - 1) + 1), lambda k: a[(n + k) % total + 1]) AS wrong FROM o WHERE total >= 3 AND n < 4), z AS (SELECT *, n % (len(wrong) + 1) AS slot FROM w)
SELECT doc_id, span, key, array_to_string(list_concat(list_concat(wrong[:slot], [reference]), wrong[slot + 1:]), ' ') AS options, slot::BIGINT AS answer FROM z""")
def source_quizzes(spark, sf_dir):
    """Which part is this line from: the first lines of each order, with the order's other parts as wrong answers."""
    lines = table(spark, sf_dir, "lineitem")
    findings = lines.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("span"), F.col("l_partkey").alias("key"), F.concat(F.lit("p"), (F.col("l_partkey") % 50).cast("string")).alias("reference"))
    return G.source_quiz(findings).select("doc_id", "span", "key", F.array_join("options", " ").alias("options"), F.col("answer").cast("long"))
