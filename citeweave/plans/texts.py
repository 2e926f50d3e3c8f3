"""Registered queries of the parts and keys of texts, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeweave.functions import records as P
from citeweave.functions import text as T
from citeweave.operators import listing as G
from citeweave.operators import parts as X
from citeweave.operators import records as R
from citeweave.operators.common import table, when_of
from citeweave.plans.queries import query

_CHAIN, _SPEECH = ["de", "the", "der", "que"], ["la", "and", "und", "en"]


@query(f"""WITH t AS (SELECT conv_id * 100 + turn AS id, role, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w, turn % 2 = 0 AS even FROM conversations),
k AS (SELECT *, list_transform(w, lambda x: regexp_replace(lower(x), '[^a-z0-9]', '', 'g')) AS k FROM t),
c AS (SELECT *, coalesce(list_min(list_filter(range(len(w)), lambda i: role = 'assistant' AND k[i + 1] = 'de' AND k[i + 2] = 'la' AND i > 0.3 * len(w))), len(w)) AS cut FROM k),
h AS (SELECT *, CASE WHEN even THEN list_filter(k[8:], lambda x: x <> '')[:4] ELSE [] END AS head FROM c),
s AS (SELECT *, CASE WHEN len(head) > 0 THEN list_min(list_filter(range(cut), lambda i: list_filter(k[i + 1:least(i + 8, cut)], lambda x: x <> '')[:len(head)] = head)) END AS aligned,
  list_min(list_filter(range(cut), lambda i: w[i + 1][1] IN ('"', '«', '“') AND i <= floor(0.8 * cut))) AS quote, list_max(list_filter(range(cut), lambda i: k[i + 1] IN ({', '.join(f"'{w}'" for w in _CHAIN)}) AND i <= floor(0.75 * cut))) AS last FROM h),
z AS (SELECT *, list_min(list_filter(range(cut), lambda i: k[i + 1] IN ({', '.join(f"'{w}'" for w in _SPEECH)}) AND i > last AND i < last + 12)) + 1 AS speech FROM s),
f AS (SELECT *, coalesce(aligned, CASE WHEN quote > 2 THEN quote END, speech) AS start, CASE WHEN aligned IS NOT NULL THEN 'aligned_to_parallel' WHEN quote > 2 THEN 'quote_mark' ELSE 'chain_then_speech' END AS m FROM z),
g AS (SELECT *, CASE WHEN start < cut THEN start END AS spot FROM f)
SELECT id, nullif(array_to_string(w[:coalesce(spot, 0)], ' '), '') AS chain, CASE WHEN spot IS NULL THEN array_to_string(w[:cut], ' ') ELSE trim(array_to_string(w[spot + 1:cut], ' '), ' "«»“”') END AS body,
  nullif(array_to_string(w[cut + 1:], ' '), '') AS notes, CASE WHEN spot IS NULL THEN 'unsplit' ELSE m END AS method FROM g""")
def records_split(spark, sf_dir):
    """Turns of conversations as reports: chain, body and remark by the token job, with words of these texts; even turns have a parallel text."""
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text", F.col("role").alias("book"), "turn")
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[ \t\n\x0B\f\r]+"), "")
    parallel = F.when(F.col("turn") % 2 == 0, F.array_join(F.slice(words, F.lit(8), F.greatest(F.size(words), F.lit(1))), " "))
    return X.split_records(rows.withColumn("parallel", parallel), _CHAIN, _SPEECH, {"assistant": "de la"})


@query()
def speech_ranges(spark, sf_dir):
    """Where the sentences of a turn, quoted in a marked edition without every seventh word, stand in the turn; `tests` has a brute force."""
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("text").alias("shown"))
    kept = F.transform(F.split("shown", r"(?<=[.])\s+"), lambda s: F.array_join(F.filter(F.split(F.translate(s, '"[]', ""), r"\s+"), lambda w, i: i % 7 != 6), " "))
    marked = F.concat(F.lit("[matn]"), F.array_join(F.transform(kept, lambda s: F.concat(F.lit('"'), s, F.lit('"'))), " and "), F.lit("[/matn]"))
    return X.quoted_speech(rows.withColumn("marked", marked))


_REFERENCES = """WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS k, l_partkey % 900 AS m, l_linenumber AS n FROM lineitem),
x AS (SELECT id, CASE n WHEN 1 THEN k || '' WHEN 2 THEN k || '-' || (k + 3) WHEN 3 THEN k || 'a-c' WHEN 4 THEN k || ', ' || m || '/7b' WHEN 5 THEN k || ',' || m || ' d' WHEN 6 THEN 'Introduction ' || m ELSE ' ' END AS number,
  CASE n WHEN 1 THEN [k || ''] WHEN 2 THEN [k || '', (k + 1) || '', (k + 2) || '', (k + 3) || ''] WHEN 3 THEN [k || 'a', k || 'b', k || 'c'] WHEN 4 THEN [k || 'b', m || 'b', '7b'] WHEN 5 THEN [k || 'd', m || 'd'] WHEN 6 THEN ['i' || lpad(m || '', 3, '0')] ELSE [] END AS e FROM r)"""


@query(f"{_REFERENCES} SELECT id, array_to_string(e, ' ') AS numbers FROM x")
def numbers_expanded(spark, sf_dir):
    """References written as single numbers, ranges, letter ranges, lists with a letter for all, introductions and blanks; the SQL builds what each must give."""
    k, m, n = F.col("l_orderkey").cast("string"), (F.col("l_partkey") % 900).cast("string"), F.col("l_linenumber")
    last = (F.col("l_orderkey") + 3).cast("string")
    forms = when_of([(n == 1, k), (n == 2, F.concat(k, F.lit("-"), last)), (n == 3, F.concat(k, F.lit("a-c"))), (n == 4, F.concat(k, F.lit(", "), m, F.lit("/7b"))), (n == 5, F.concat(k, F.lit(","), m, F.lit(" d"))), (n == 6, F.concat(F.lit("Introduction "), m))], " ")
    refs = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + n).alias("id"), forms.alias("number"))
    return refs.select("id", F.array_join(P.expand_numbers(F.col("number")), " ").alias("numbers"))


@query("""SELECT user_id AS id, min_by(event_type, event_id) AS name, count(*) AS n FROM events WHERE user_id IS NOT NULL GROUP BY 1""")
def narrator_mentions(spark, sf_dir):
    """How often each one is mentioned, by the first name given."""
    return G.mention_counts(table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("name"), F.col("event_id").alias("ord")))


@query("""WITH o AS (SELECT doc_id, lang, source, n_chars FROM documents), n AS (SELECT doc_id + CASE WHEN doc_id % 7 = 0 THEN 1000000 ELSE 0 END AS doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE lang END AS lang, source, n_chars FROM documents)
SELECT n.doc_id FROM n LEFT JOIN o ON o.doc_id = n.doc_id WHERE o.doc_id IS NULL OR n.lang IS DISTINCT FROM o.lang""")
def rows_changed(spark, sf_dir):
    """Rows that are new or that differ, nulls included, from the table before."""
    old = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    new = old.withColumns({"lang": F.when(F.col("doc_id") % 5 == 0, F.lit(None)).otherwise(F.col("lang")), "doc_id": F.col("doc_id") + F.when(F.col("doc_id") % 7 == 0, 1_000_000).otherwise(0)})
    return R.changed_rows(old, new, "doc_id", ["lang", "n_chars"]).select("doc_id")


@query()
def leaks_matched(spark, sf_dir):
    """Passages taken for generated answers: runs of words in them that a document has, with the document; `tests` has a case by hand."""
    answers = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    sources = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text")
    return G.leaks(answers, sources, T.latin_words(F.col("text")), word="[A-Za-z]+", between="[ ,.;:]+").select("id", F.col("n").cast("long"), "run", "source", "similarity")
