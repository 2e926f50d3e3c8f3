"""More registered queries: linkage, verdicts, evaluation and listings over the driver's tables, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeweave.functions import records as P
from citeweave.functions import text as T
from citeweave.operators import documents as D
from citeweave.operators import evaluate as E
from citeweave.operators import link as K
from citeweave.operators import listing as G
from citeweave.operators import records as R
from citeweave.operators import retrieve as I
from citeweave.operators import spans as S
from citeweave.operators import verify as V
from citeweave.operators.common import table
from citeweave.plans.queries import _LINES, _WORDS, query
from citeweave.sources import sinks

_LONG = "long"


def _long(*names):
    return [F.col(n).cast(_LONG).alias(n) for n in names]


# --- linkage ---------------------------------------------------------------------------------------------------------


@query(f"""WITH d AS (SELECT {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
g AS (SELECT DISTINCT array_to_string(w[i:i+4], ' ') AS g FROM d, unnest(generate_series(1, len(w) - 4)) AS t(i)),
p AS (SELECT item_id, array_to_string(w[i:i+4], ' ') AS g FROM b, unnest([1, 6, 11, 16]) AS t(i) WHERE i + 4 <= len(w))
SELECT item_id, CASE WHEN count(g.g) = 0 THEN 'none' WHEN count(g.g) = count(*) THEN 'all' ELSE 'some' END AS present FROM p LEFT JOIN g ON p.g = g.g GROUP BY 1""")
def probe_presence(spark, sf_dir):
    words = T.latin_words(F.col("text"))
    grams = table(spark, sf_dir, "documents").select(F.explode(V.placed_grams(words, 5)["gram"]).alias("gram"))
    placed = F.filter(V.placed_grams(words, 5), lambda g: g["position"].isin(0, 5, 10, 15))
    probes = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.explode(placed["gram"]).alias("gram"))
    return K.presence(probes, grams).withColumnRenamed("id", "item_id")


@query("""WITH c AS (SELECT l_partkey AS host, l_orderkey * 10 + l_linenumber AS guest, l_quantity AS score FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY score DESC, guest) AS n FROM c)
SELECT guest, CASE WHEN n = 1 THEN host::VARCHAR ELSE host || '.s' || n END AS key, CASE WHEN n > 1 THEN host::VARCHAR END AS parallel_of FROM r""")
def claim_split(spark, sf_dir):
    claims = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("host"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("guest"), F.col("l_quantity").alias("score"))
    return K.split_claims(claims).select("guest", "key", "parallel_of")


@query("""WITH r AS (SELECT c_custkey, c_nationkey::VARCHAR AS k, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer) SELECT c_custkey, CASE WHEN n = 1 THEN k ELSE k || '~' || c_custkey END AS key FROM r""")
def key_collisions(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("key"))
    return K.renamed_collisions(df, "key", "c_custkey")


@query("""SELECT d.doc_id, coalesce(nullif(d.lang, ''), p.lang) AS lang, coalesce(nullif(d.source, ''), p.source) AS source FROM documents d LEFT JOIN documents p ON p.doc_id + 1 = d.doc_id""")
def filled_columns(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return K.merged(df, df.withColumn("doc_id", F.col("doc_id") + 1), ["lang", "source"], "doc_id")


@query(f"""WITH {_LINES}, n AS (SELECT source AS unit, lang, l.doc_id * 100000 + seg AS ord, l.text, l.doc_id % 2 AS s, substr(lower(l.text), 1, 80) AS k FROM lines l JOIN documents d ON l.doc_id = d.doc_id WHERE length(l.text) >= 40),
r AS (SELECT *, row_number() OVER (PARTITION BY unit, lang, k ORDER BY s, ord) AS n FROM n) SELECT unit, lang, ord, md5(text) AS text FROM r WHERE n = 1""")
def notes_merged(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    lines = D.line_segments(docs).where(F.length("text") >= 40).join(docs.select("doc_id", "lang", F.col("source").alias("unit")), "doc_id")
    notes = lambda s: lines.where(F.col("doc_id") % 2 == s).select("unit", "lang", (F.col("doc_id") * 100_000 + F.col("seg")).alias("ord"), "text")
    return K.merged_notes(notes(0), notes(1), F.lower("text")).select("unit", "lang", "ord", F.md5(F.col("text").cast("binary")).alias("text"))


@query("""WITH o AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS k, arg_max(o_orderkey, struct_pack(a := o_totalprice, b := o_orderkey)) AS p FROM orders GROUP BY 1)
SELECT o_custkey, array_to_string(list_concat([p], list_filter(k, lambda x: x <> p)), ',') AS keys FROM o""")
def pointer_moved(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("key")))).alias("m"), F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("p"))
    return o.select("o_custkey", F.array_join(F.transform(K.pointer_first(F.col("m"), F.col("p")), lambda x: x["key"].cast("string")), ",").alias("keys"))


_COMPARED = """l AS (SELECT c_nationkey::VARCHAR AS collection, c_custkey::VARCHAR AS number, c_mktsegment AS value FROM customer WHERE c_custkey % 2 = 0),
r AS (SELECT c_nationkey || ':' || (c_custkey - 1) AS k, c_mktsegment AS other FROM customer WHERE c_custkey % 4 <> 0), p AS (SELECT collection, number, '0:' || number AS target FROM l WHERE number::BIGINT % 10 = 0),
c AS (SELECT l.*, r.other, CASE WHEN other IS NULL THEN 'unmatched' WHEN other = value THEN 'agrees' ELSE 'differs' END AS state FROM l LEFT JOIN p USING (collection, number) LEFT JOIN r ON k = coalesce(target, collection || ':' || number))"""


def _compared(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("collection"), "c_custkey", F.col("c_mktsegment").alias("value"))
    left = c.where("c_custkey % 2 = 0").select("collection", F.col("c_custkey").cast("string").alias("number"), "value")
    right = c.where("c_custkey % 4 != 0").select("collection", (F.col("c_custkey") - 1).cast("string").alias("number"), "value")
    pointers = left.where(F.col("number").cast("long") % 10 == 0).select("collection", "number", F.concat(F.lit("0:"), F.col("number")).alias("target"))
    return K.comparison(left, right, pointers)


@query(f"WITH {_COMPARED} SELECT collection, number, value, other, state FROM c")
def dataset_comparison(spark, sf_dir):
    return _compared(spark, sf_dir).select("collection", "number", "value", "other", "state")


@query(f"""WITH {_COMPARED}, n AS (SELECT state, count(*) AS n FROM c GROUP BY 1), s AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY collection, number) AS k FROM c)
SELECT state, n, round(100.0 * n / (SELECT count(*) FROM c), 4) AS share, k, collection, number FROM n JOIN s USING (state) WHERE k <= 3""")
def comparison_report(spark, sf_dir):
    return E.comparison_report(_compared(spark, sf_dir), "state", ["collection", "number"]).select("state", "n", F.round("share", 4).alias("share"), F.col("place").cast(_LONG).alias("k"), "collection", "number")


_FAMILY = """m AS (SELECT doc_id AS unit, lang AS family_id, doc_id % 3 = 0 AS core, doc_id AS ord FROM documents), g AS (SELECT doc_id AS unit, quality FROM labels)"""


@query(f"""WITH {_FAMILY}, lender AS (SELECT family_id, min(ord) AS via FROM m WHERE core AND family_id IS NOT NULL AND unit IN (SELECT unit FROM g) GROUP BY 1)
SELECT m.unit, via, g.quality FROM m JOIN lender USING (family_id) JOIN g ON g.unit = via WHERE m.unit NOT IN (SELECT unit FROM g)""")
def grades_borrowed(spark, sf_dir):
    members = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("unit"), F.col("lang").alias("family_id"), (F.col("doc_id") % 3 == 0).alias("core"), F.col("doc_id").alias("ord"))
    return K.borrowed_grades(members, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("unit"), "quality")).select("unit", "via", "quality")


@query("""WITH l AS (SELECT o_custkey AS copy, o_orderkey AS source, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders)
SELECT copy AS unit, source AS via, l_returnflag AS grade, l_linenumber FROM l JOIN lineitem ON l_orderkey = source WHERE rank <= 3""")
def grades_inherited(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("copy"), F.col("o_orderkey").alias("source"), F.col("o_totalprice").alias("score"), F.lit(0).alias("source_rank"))
    links = I.top(o, ["copy"], [F.desc("score"), "source"], 3)
    grades = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("unit"), F.col("l_returnflag").alias("grade"), "l_linenumber")
    return K.inherited_grades(links, grades).select("unit", "via", "grade", "l_linenumber")


@query("""WITH c AS (SELECT p_partkey AS left_id, p_partkey + i AS number, i AS position FROM part, unnest([3, 1, 2]) AS t(i)), r AS (SELECT l_suppkey AS number, min(l_orderkey) AS right_id FROM lineitem GROUP BY 1),
j AS (SELECT left_id, right_id, row_number() OVER (PARTITION BY left_id ORDER BY list_position([3, 1, 2], position)) AS k, list_position([3, 1, 2], position) - 1 AS position FROM c JOIN r USING (number))
SELECT left_id, right_id, position::BIGINT AS position FROM j WHERE k = 1""")
def suffix_preference(spark, sf_dir):
    right = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("number")).agg(F.min("l_orderkey").alias("id"))
    left = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    return K.preferred_suffix(left, right, F.array(*(F.col("id") + k for k in (3, 1, 2)))).select("left_id", "right_id", F.col("position").cast(_LONG))


@query("""WITH c AS (SELECT l_orderkey AS guest, l_partkey AS host, l_discount AS score FROM lineitem), d AS (SELECT DISTINCT guest, host, score FROM c WHERE score >= 0.05),
k AS (SELECT DISTINCT l_partkey AS host FROM lineitem WHERE l_returnflag = 'R'), r AS (SELECT d.*, row_number() OVER (PARTITION BY guest ORDER BY score DESC, (k.host IS NOT NULL), d.host) AS n FROM d LEFT JOIN k USING (host))
SELECT guest, host, score FROM r WHERE n = 1""")
def unclaimed_hosts(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    claimed = lines.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("host"))
    return K.unclaimed_first(lines.select(F.col("l_orderkey").alias("guest"), F.col("l_partkey").alias("host"), F.col("l_discount").alias("score")), claimed, 0.05)


@query("""WITH s AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'i' || doc_id ELSE doc_id::VARCHAR END AS number, CASE WHEN doc_id % 5 = 0 THEN 'x' END AS same_as, n_chars > 3000 AS st, CASE WHEN lang = 'en' THEN 'none' WHEN lang = 'de' THEN 'some' ELSE 'all' END AS present FROM documents),
r AS (SELECT CASE WHEN starts_with(number, 'i') THEN 'introduction' WHEN same_as IS NOT NULL THEN 'same_as_previous' WHEN st THEN 'editor_statement' WHEN present = 'none' THEN 'absent' WHEN present = 'some' THEN 'partly_present' ELSE 'present' END AS reason FROM s)
SELECT reason, count(*) AS n FROM r GROUP BY 1""")
def leftover_reasons(spark, sf_dir):
    number = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("i"), F.col("doc_id").cast("string"))).otherwise(F.col("doc_id").cast("string"))
    present = F.when(F.col("lang") == "en", "none").when(F.col("lang") == "de", "some").otherwise("all")
    reason = K.leftover_reason(number, F.when(F.col("doc_id") % 5 == 0, "x"), F.coalesce(F.col("n_chars") > 3000, F.lit(False)), present)
    return table(spark, sf_dir, "documents").select(reason.alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, array_to_string(list_filter([CASE WHEN n_chars < 500 THEN 'short' END, CASE WHEN lang IS NULL THEN 'no_lang' END, CASE WHEN source = 'src0' THEN 'first_source' END], lambda x: x IS NOT NULL), ',') AS flags FROM documents""")
def record_flags(spark, sf_dir):
    ladder = {"short": F.col("n_chars") < 500, "no_lang": F.col("lang").isNull(), "first_source": F.col("source") == "src0"}
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(K.flags(ladder), ",").alias("flags"))


@query("""SELECT d.doc_id AS unit, string_agg(k, ',' ORDER BY k) AS accepted FROM documents d, LATERAL (SELECT DISTINCT k FROM (SELECT d.doc_id AS k UNION ALL SELECT doc_id FROM labels l WHERE l.doc_id = d.doc_id + 1 UNION ALL SELECT doc_id FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1)) GROUP BY 1""")
def accepted_keys(spark, sf_dir):
    units, labels = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("unit")), table(spark, sf_dir, "labels")
    same = labels.select((F.col("doc_id") - 1).alias("unit"), F.col("doc_id").alias("key"))
    copies = labels.where("quality = 1").select(F.col("doc_id").alias("unit"), F.col("doc_id").alias("key"))
    df = E.accepted(units.select("unit", F.col("unit").alias("key")), same.join(units, "unit", "left_semi"), copies.join(units, "unit", "left_semi"))
    return df.select("unit", F.array_join(F.transform("accepted", lambda k: k.cast("string")), ",").alias("accepted"))


@query("""SELECT origin, count(*) AS n, count(chars) AS with_chars, sum(id)::BIGINT AS ids FROM (SELECT 'paired' AS origin, d.doc_id AS id, n_chars AS chars FROM documents d JOIN labels USING (doc_id) UNION ALL SELECT 'extra', doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'other', item_id, NULL FROM benchmark) GROUP BY 1""")
def records_stacked(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("chars")), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    parts = {"paired": docs.join(labels, "id"), "extra": docs.join(labels, "id", "left_anti"), "other": table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"))}
    return R.stacked(parts).groupBy("origin").agg(F.count("*").alias("n"), F.count("chars").alias("with_chars"), F.sum("id").alias("ids"))


@query("""SELECT lang AS family_id, count(DISTINCT source) AS sources, count(*) AS members FROM documents WHERE lang IS NOT NULL GROUP BY 1""")
def family_sizes(spark, sf_dir):
    return R.family_sizes(table(spark, sf_dir, "documents").select(F.col("lang").alias("family_id"), F.col("source").alias("collection"))).select("family_id", F.col("collections").alias("sources"), "members")


@query("""SELECT conv_id, turn // 4 AS chunk, string_agg(role, ' ' ORDER BY turn) AS roles, min(turn)::BIGINT AS first FROM conversations GROUP BY 1, 2""")
def unit_chunks(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    df = R.chunked(c.withColumn("chunk", F.floor(F.col("turn") / 4)), ["conv_id", "chunk"], "turn", "role")
    return df.select("conv_id", F.col("chunk").cast(_LONG), F.array_join("parts", " ").alias("roles"), F.col("first").cast(_LONG).alias("first"))


@query("""WITH r AS (SELECT 'BUILDING' AS c, 0 AS k UNION ALL SELECT 'MACHINERY', 1) SELECT c_custkey, row_number() OVER (ORDER BY k NULLS LAST, c_mktsegment, c_custkey) AS id FROM customer LEFT JOIN r ON c = c_mktsegment""")
def corpus_ids(spark, sf_dir):
    units = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("collection"), F.col("c_custkey").alias("ord"))
    ranks = spark.createDataFrame([("BUILDING", 0), ("MACHINERY", 1)], "collection string, rank int")
    return R.corpus_ids(units, ranks).select("c_custkey", "id")


@query("""SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber) - 1 AS n FROM lineitem""")
def lines_renumbered(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    return R.renumbered(lines, ["l_orderkey"], ["l_shipdate", "l_linenumber"]).select("l_orderkey", "l_linenumber", F.col("n").cast(_LONG))


@query("""SELECT o_orderkey AS key, coalesce(string_agg(l_partkey, ',' ORDER BY l_linenumber, l_partkey::VARCHAR) FILTER (l_returnflag = 'R'), '') AS absorbed FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def numbers_absorbed(spark, sf_dir):
    guests = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("ord"), F.col("l_partkey").cast("string").alias("number"))
    return R.absorbed(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key")), guests).select("key", F.array_join("absorbed", ",").alias("absorbed"))


@query("""SELECT s_suppkey, n_name AS name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_regionkey <> 2""")
def people_named(spark, sf_dir):
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.when(F.col("n_regionkey") != 2, F.col("n_name")).otherwise("").alias("name"))
    return K.named_people(table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("id")), names).select("s_suppkey", "name")


@query("""WITH t AS (SELECT doc_id, source, len(regexp_extract_all(lower(text), 'and')) AS n FROM documents WHERE source IN ('src1', 'src3')), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, doc_id) AS k FROM t) SELECT doc_id, source, k FROM r WHERE k <= 10""")
def kinds_ranked(spark, sf_dir):
    units = table(spark, sf_dir, "documents").withColumn("kind", F.col("source"))
    df = I.of_kinds(units, ["src1", "src3"]).select("doc_id", "source", F.regexp_count(F.lower("text"), F.lit("and")).alias("n"))
    return I.top(df, ["source"], [F.desc("n"), "doc_id"], 10, "k").select("doc_id", "source", F.col("k").cast(_LONG))


# --- verdicts --------------------------------------------------------------------------------------------------------

_ALIGNED = """a AS (SELECT user_id AS span, event_id AS key, value AS score, event_type = 'purchase' AS verbatim, event_type = 'click' AS cited, event_id % 2 = 0 AS graded, event_id % 5 AS source_rank, length(event_type) AS length, (value / 100)::DOUBLE AS similarity, ((event_id % 100) / 100.0)::DOUBLE AS coverage FROM events),
k AS (SELECT *, CASE WHEN bool_or(verbatim) OVER (PARTITION BY span) THEN verbatim ELSE score >= max(score) OVER (PARTITION BY span) - 0.5 END AS keep FROM a),
r AS (SELECT *, row_number() OVER (PARTITION BY span ORDER BY keep DESC, cited DESC, graded DESC, source_rank, length, key) AS r FROM k),
n AS (SELECT *, row_number() OVER (PARTITION BY span ORDER BY (cited AND similarity >= 0.6 AND coverage >= 0.6)::INT DESC, r) AS n, first_value(key) OVER (PARTITION BY span ORDER BY r) AS c FROM r),
m AS (SELECT span, key, CASE WHEN c <> key THEN c END AS closest FROM n WHERE n = 1)"""


def _aligned(spark, sf_dir):
    kind = lambda x: F.col("event_type") == x
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("span"), F.col("event_id").alias("key"), F.col("value").alias("score"), kind("purchase").alias("verbatim"), kind("click").alias("cited"), (F.col("event_id") % 2 == 0).alias("graded"),
        (F.col("event_id") % 5).alias("source_rank"), F.length("event_type").alias("length"), (F.col("value") / 100).alias("similarity"), ((F.col("event_id") % 100) / 100).alias("coverage"),
    )


@query(f"WITH {_ALIGNED} SELECT span, key, closest FROM m")
def chosen_match(spark, sf_dir):
    return V.choose_match(_aligned(spark, sf_dir)).select("span", "key", "closest")


@query(f"""WITH {_ALIGNED}, rest AS (SELECT a.* FROM a JOIN m USING (span) WHERE a.key <> m.key),
near AS (SELECT *, row_number() OVER (PARTITION BY span ORDER BY score DESC, key) AS k FROM rest), n2 AS (SELECT span, string_agg(key, ',' ORDER BY k) AS near FROM near WHERE k <= 3 GROUP BY 1),
also AS (SELECT *, row_number() OVER (PARTITION BY span ORDER BY verbatim DESC, graded DESC, source_rank, similarity DESC, key) AS k FROM rest WHERE verbatim OR (similarity >= 0.6 AND coverage >= 0.6)), a2 AS (SELECT span, string_agg(key, ',' ORDER BY k) AS also FROM also WHERE k <= 12 GROUP BY 1)
SELECT span, near, also FROM n2 FULL JOIN a2 USING (span)""")
def near_and_also(spark, sf_dir):
    df = _aligned(spark, sf_dir)
    joined = lambda c: F.array_join(F.transform(c, lambda k: k.cast("string")), ",").alias(c)
    return V.near_lists(df, V.choose_match(df)).select("span", joined("near"), joined("also"))


@query("""WITH s AS (SELECT d.doc_id, CASE WHEN n_chars > 2000 THEN 'verbatim' WHEN n_chars > 1000 THEN 'paraphrase' WHEN n_chars > 600 THEN 'misquote' ELSE 'not_found' END AS text, CASE WHEN quality = 0 THEN 'daif' WHEN toxic = 1 THEN 'disputed' ELSE 'sahih' END AS g, lang IS NULL AS o FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT doc_id, CASE WHEN o AND text IN ('not_found', 'misquote') THEN NULL WHEN g IN ('daif', 'mawdu', 'disputed') AND text NOT IN ('misquote', 'not_found') THEN 'weak_or_disputed' ELSE text END AS status FROM s""")
def final_verdict(spark, sf_dir):
    df = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    text = F.when(F.col("n_chars") > 2000, "verbatim").when(F.col("n_chars") > 1000, "paraphrase").when(F.col("n_chars") > 600, "misquote").otherwise("not_found")
    grade = F.when(F.col("quality") == 0, "daif").when(F.col("toxic") == 1, "disputed").otherwise("sahih")
    return df.select("doc_id", V.final_status(text, grade, F.col("lang").isNull()).alias("status"))


@query("""WITH f AS (SELECT o_orderkey AS span, o_custkey AS key, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey + o_orderkey % 2 END AS ck, CASE WHEN o_orderkey % 3 = 1 THEN o_orderkey % 25 END AS cc FROM orders),
m AS (SELECT c_custkey AS key, c_mktsegment AS fam, c_nationkey AS col FROM customer),
x AS (SELECT f.*, m.col, m.fam, EXISTS (SELECT 1 FROM m o WHERE o.fam = m.fam AND (o.key = f.ck OR (f.ck IS NULL AND o.col = f.cc))) AS hit FROM f LEFT JOIN m USING (key))
SELECT span, CASE WHEN ck IS NULL AND cc IS NULL THEN NULL ELSE coalesce(CASE WHEN ck IS NOT NULL THEN ck = key ELSE cc = col END, false) OR hit END AS agrees FROM x""")
def citation_check(spark, sf_dir):
    members = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("family_id"), F.col("c_nationkey").alias("collection"))
    n = F.col("o_orderkey")
    f = table(spark, sf_dir, "orders").select(n.alias("span"), F.col("o_custkey").alias("key"), F.when(n % 3 == 0, F.col("o_custkey") + n % 2).alias("cited_key"), F.when(n % 3 == 1, n % 25).alias("cited_collection"))
    return V.citation_agrees(f, members).select("span", "agrees")


@query("""WITH s AS (SELECT doc_id, 0 AS span, lang FROM documents), d AS (SELECT doc_id, 0 AS span, CASE WHEN quality = 1 THEN 'misquote' ELSE 'different_text' END AS label FROM labels)
SELECT count(*) FILTER (d.label IS NOT NULL) AS decided, count(*) FILTER (d.label IS NULL) AS open, count(*) FILTER (d.label = 'misquote') AS misquotes FROM s LEFT JOIN d USING (doc_id, span)""")
def decisions_joined(spark, sf_dir):
    spans = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("span"), "lang")
    decisions = table(spark, sf_dir, "labels").select("doc_id", F.lit(0).alias("span"), F.when(F.col("quality") == 1, "misquote").otherwise("different_text").alias("label"), F.lit(0.9).alias("confidence"))
    done, open_ = V.split_decided(spans, decisions)
    both = done.select(F.lit(1).alias("d"), "label").unionByName(open_.select(F.lit(0).alias("d"), F.lit(None).cast("string").alias("label")))
    return both.agg(F.count_if(F.col("d") == 1).alias("decided"), F.count_if(F.col("d") == 0).alias("open"), F.count_if(F.col("label") == "misquote").alias("misquotes"))


@query("""WITH p AS (SELECT user_id AS span, event_id % 50 AS key, value / 100 AS confidence FROM events), o AS (SELECT DISTINCT user_id AS span, event_id % 50 AS key FROM events WHERE event_type = 'view'),
g AS (SELECT p.*, row_number() OVER (PARTITION BY span ORDER BY confidence DESC, key) AS k FROM p WHERE confidence >= 0.6 AND EXISTS (SELECT 1 FROM o WHERE o.span = p.span AND o.key = p.key)) SELECT span, key, round(confidence, 9) AS confidence FROM g WHERE k = 1""")
def picks_accepted(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    picks = e.select(F.col("user_id").alias("span"), (F.col("event_id") % 50).alias("key"), (F.col("value") / 100).alias("confidence"))
    return V.accepted_picks(picks, e.where("event_type = 'view'").select(F.col("user_id").alias("span"), (F.col("event_id") % 50).alias("key"))).select("span", "key", F.round("confidence", 9).alias("confidence"))


@query("""WITH f AS (SELECT user_id AS q, event_id % 40 AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rank FROM events WHERE event_type = 'view'),
a AS (SELECT q, k, min(rank) AS rank FROM f WHERE rank <= 5 GROUP BY 1, 2), x AS (SELECT DISTINCT user_id AS q, event_id % 40 AS k FROM events WHERE event_type = 'purchase'),
n AS (SELECT q, k, 1000000 + row_number() OVER (PARTITION BY q ORDER BY k) AS rank FROM x), u AS (SELECT * FROM a UNION ALL SELECT * FROM n)
SELECT q AS query, k AS key, min(rank)::BIGINT AS rank FROM u GROUP BY 1, 2""")
def appended_candidates(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("query"), "event_id", (F.col("event_id") % 40).alias("key"), "event_type")
    lists = I.top(e.where("event_type = 'view'"), ["query"], ["event_id"], 5).groupBy("query", "key").agg(F.min("rank").alias("rank")).withColumn("score", F.lit(1.0))
    return I.append_absent(lists, e.where("event_type = 'purchase'").select("query", "key").distinct()).select("query", "key", F.col("rank").cast(_LONG))


@query("""WITH h AS (SELECT user_id AS q, (event_id % 9) AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rank FROM events) SELECT q AS query, k::VARCHAR AS key, min(rank) AS rank FROM h GROUP BY 1, 2""")
def parts_folded(spark, sf_dir):
    hits = I.numbered_hits(table(spark, sf_dir, "events").select(F.col("user_id").alias("query"), F.concat((F.col("event_id") % 9).cast("string"), F.lit("#"), F.col("event_id").cast("string")).alias("key"), "event_id"), "event_id")
    return I.fold_parts(hits).select("query", "key", F.col("rank").cast(_LONG))


# --- evaluation ------------------------------------------------------------------------------------------------------

_SCORED = """a AS (SELECT d.doc_id, lang AS arm, CASE WHEN n_chars > 2000 THEN 'verbatim' WHEN n_chars > 900 THEN 'misquote' ELSE 'not_found' END AS status, source AS want, CASE WHEN quality = 1 THEN 'verbatim' WHEN quality = 0 THEN 'not_found' END AS got, CASE WHEN doc_id % 2 = 0 THEN source ELSE 'src1' END AS got_key, CASE WHEN toxic = 1 THEN 'x' WHEN toxic = 0 AND doc_id % 4 = 0 THEN 'y' END AS got_grade, doc_id % 3 = 0 AS agrees, doc_id % 2 = 0 AS got_agrees FROM documents d LEFT JOIN labels l USING (doc_id) WHERE lang IS NOT NULL),
s AS (SELECT arm, status, got IS NOT NULL OR status = 'not_found' AS detected, coalesce(got, 'not_found') = status AS status_ok, coalesce(got_key = want, false) AS source_ok, CASE WHEN got_grade IS NOT NULL THEN got_grade <> 'y' END AS invented, coalesce(got_agrees = agrees, false) AS citation_ok FROM a)"""


def _scored(spark, sf_dir):
    df = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").where("lang is not null")
    status = F.when(F.col("n_chars") > 2000, "verbatim").when(F.col("n_chars") > 900, "misquote").otherwise("not_found")
    got = F.when(F.col("quality") == 1, "verbatim").when(F.col("quality") == 0, "not_found")
    even = F.col("doc_id") % 2 == 0
    df = df.select(
        F.col("lang").alias("arm"), status.alias("status"), F.array("source").alias("keys"), F.lit("y").alias("grade"), (F.col("doc_id") % 3 == 0).alias("agrees"), got.alias("got_status"),
        F.when(even, F.col("source")).otherwise("src1").alias("got_key"), F.when(F.col("toxic") == 1, "x").when((F.col("toxic") == 0) & (F.col("doc_id") % 4 == 0), "y").alias("got_grade"), even.alias("got_agrees"),
    )
    return E.score_rows(df)


@query(f"""WITH {_SCORED} SELECT arm, count(*) AS items, round(100 * avg(detected::INT), 1) AS detected, round(100 * avg(status_ok::INT), 1) AS status, round(100 * avg(CASE WHEN status IN ('verbatim', 'not_found') THEN status_ok::INT END), 1) AS status_hard,
  round(100 * avg(source_ok::INT), 1) AS source, round(100 * avg(invented::INT), 1) AS invented, round(100 * avg(CASE WHEN status = 'not_found' THEN status_ok::INT END), 1) AS abstention, round(100 * avg(citation_ok::INT), 1) AS citation FROM s GROUP BY 1""")
def evaluation_summary(spark, sf_dir):
    return E.summary(_scored(spark, sf_dir), ["arm"])


@query(f"WITH {_SCORED} SELECT status, round(100 * avg(CASE WHEN arm = 'en' THEN status_ok::INT END), 1) AS en, round(100 * avg(CASE WHEN arm = 'de' THEN status_ok::INT END), 1) AS de FROM s WHERE arm IN ('en', 'de') GROUP BY 1")
def status_by_arm(spark, sf_dir):
    return E.status_matrix(_scored(spark, sf_dir).where(F.col("arm").isin("en", "de")), ["en", "de"])


@query("""WITH r AS (SELECT event_type AS arm, user_id % 5 AS run, count(*) AS n FROM events GROUP BY 1, 2) SELECT arm, CASE WHEN min(n) = max(n) THEN min(n)::VARCHAR ELSE min(n) || '–' || max(n) END AS n FROM r GROUP BY 1""")
def spread_over_runs(spark, sf_dir):
    runs = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("arm"), (F.col("user_id") % 5).alias("run")).agg(F.count("*").alias("n"))
    return E.spread(runs, ["n"])


@query("""WITH a AS (SELECT o_orderkey AS id, list(l_partkey ORDER BY l_linenumber) AS cited, list(l_partkey ORDER BY l_linenumber) FILTER (l_discount > 0.03) AS r FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT id, len(list_distinct(list_filter(cited, lambda x: NOT list_contains(coalesce(r, []), x))))::INT AS invalid FROM a""")
def citations_within(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list("l_partkey").alias("cited"), F.collect_list(F.when(F.col("l_discount") > 0.03, F.col("l_partkey"))).alias("returned"))
    return E.cited_within(lines).select("id", F.size("invalid").alias("invalid"))


@query(f"""WITH w AS (SELECT item_id, list_distinct({_WORDS}) AS a FROM benchmark), d AS (SELECT doc_id, list_distinct({_WORDS}) AS b FROM documents),
o AS (SELECT item_id, doc_id, len(list_intersect(a, b)) AS n, least(len(a), len(b)) AS m FROM w JOIN d ON doc_id = item_id + 1)
SELECT item_id, doc_id, round(CASE WHEN m > 0 THEN n / m ELSE 0 END, 6) AS overlap FROM o""")
def word_overlap(spark, sf_dir):
    words = T.latin_words(F.col("text"))
    items = table(spark, sf_dir, "benchmark").select("item_id", words.alias("a"), (F.col("item_id") + 1).alias("doc_id"))
    df = items.join(table(spark, sf_dir, "documents").select("doc_id", words.alias("b")), "doc_id")
    return df.select("item_id", "doc_id", F.round(T.overlap(F.col("a"), F.col("b")), 6).alias("overlap"))


# --- listings --------------------------------------------------------------------------------------------------------


@query("""WITH q AS (SELECT user_id AS doc_id, event_type AS status, event_id FROM events) SELECT event_id, status FROM q WHERE status IN ('error', 'view')""")
def reader_attention(spark, sf_dir):
    names = {"error": "not_found", "view": "misquote"}
    status = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), F.col("event_type")), F.lit("verbatim"))
    df = table(spark, sf_dir, "events").select("event_id", F.col("event_type"), status.alias("status"), F.lit(True).alias("agrees"))
    return G.attention(df).select("event_id", F.col("event_type").alias("status"))


@query("""SELECT doc_id, CASE WHEN quality = 1 THEN 'good' WHEN toxic = 1 THEN 'warn' ELSE 'none' END AS tone FROM labels""")
def grade_tone(spark, sf_dir):
    status = F.when(F.col("quality") == 1, "sahih").when(F.col("toxic") == 1, "disputed").otherwise("ungraded")
    return table(spark, sf_dir, "labels").select("doc_id", G.tone(status).alias("tone"))


@query("""WITH c AS (SELECT c_nationkey AS chapter, count(*) AS length FROM customer GROUP BY 1), r AS (SELECT *, sum(length) OVER (ORDER BY chapter) AS last_id FROM c) SELECT chapter, length, (last_id - length + 1)::BIGINT AS first_id, last_id::BIGINT AS last_id FROM r""")
def chapter_id_ranges(spark, sf_dir):
    return G.chapter_ranges(table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("chapter")).agg(F.count("*").alias("length"))).select("chapter", "length", "first_id", "last_id")


@query("""WITH u AS (SELECT p_brand AS family_id, p_partkey AS key, p_name AS text FROM part), f AS (SELECT *, row_number() OVER (PARTITION BY family_id ORDER BY key) AS o FROM u),
p AS (SELECT u.key, f.key AS other, f.text, row_number() OVER (PARTITION BY u.key ORDER BY f.o) AS rank FROM u JOIN f USING (family_id) WHERE f.o <= 5 AND u.key <> f.key)
SELECT key, other, CASE WHEN length(text) > 12 THEN substr(text, 1, 12) || '…' ELSE text END AS text, rank FROM p WHERE rank <= 4""")
def family_members(spark, sf_dir):
    units = table(spark, sf_dir, "part").select(F.col("p_brand").alias("family_id"), F.col("p_partkey").alias("key"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("text"))
    return G.family_listing(units, 4, 12).select("key", "other", "text", F.col("rank").cast(_LONG))


@query(f"""WITH q AS (SELECT item_id AS query, list_distinct(list_filter({_WORDS}, lambda x: length(x) >= 3 AND NOT list_contains([{", ".join(f"'{w}'" for w in T.LATIN_STOP)}], x))) AS w FROM benchmark), qt AS (SELECT query, unnest(w) AS t FROM q),
s AS (SELECT conv_id, turn, list_distinct({_WORDS}) AS w FROM conversations), st AS (SELECT conv_id, turn, unnest(w) AS t FROM s), v AS (SELECT query, conv_id, turn, count(*) AS shared FROM qt JOIN st USING (t) GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY shared DESC, conv_id, turn) AS rank FROM v) SELECT query, conv_id, turn, shared, rank FROM r WHERE rank <= 5""")
def passage_search(spark, sf_dir):
    segments = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("seg"), "text")
    df = G.matching_passages(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text"), segments)
    return df.select("query", F.col("doc_id").alias("conv_id"), F.col("seg").alias("turn"), "shared", F.col("rank").cast(_LONG))


@query("""WITH l AS (SELECT user_id, arg_max(event_id, struct_pack(a := ts, b := event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY 1), m AS (SELECT max(ts) AS now FROM events) SELECT l.user_id AS key, event_id % 5 + 1 >= 3 AS learned FROM l, m WHERE ts + INTERVAL 1 HOUR <= now""")
def cards_due(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    now = e.agg(F.max("ts")).first()[0]
    last = e.groupBy("user_id", "ts").agg(F.max("event_id").alias("event_id"))
    reviews = last.select(F.col("user_id").alias("key"), "ts", (F.col("event_id") % 5 + 1).alias("box"), (F.col("ts") + F.expr("interval 1 hour")).alias("due"))
    return G.due_cards(reviews, F.lit(now)).select("key", "learned")


@query("""SELECT event_id AS id, CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'feedback' END AS kind FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 5 DAY""")
def message_box(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    now = e.agg(F.max("ts")).first()[0]
    return G.messages(e.select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), "ts"), F.lit(now), None, ("click", "view"), 5).select("id", "kind")


@query("""WITH a AS (SELECT conv_id * 1000 + turn AS id, regexp_extract_all(text, '(?:[A-Za-z]+[ ,.;:]+){4,}[A-Za-z]+') AS r FROM conversations WHERE role = 'assistant') SELECT id, i - 1 AS n, r[i] AS run FROM a, unnest(generate_series(1, least(len(r), 12))) AS t(i)""")
def leaked_runs(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return G.leak_runs(c, word="[A-Za-z]+", between="[ ,.;:]+").select("id", F.col("n").cast(_LONG), "run")


@query("""WITH t AS (SELECT doc_id, i AS ord, form FROM documents, unnest([1, 2, 3, 4]) AS t(i), LATERAL (SELECT ['und', 'The ', 'x', 'la'][i] AS form)), v AS (SELECT t.doc_id, ord, trim(form) AS form FROM t JOIN documents d USING (doc_id) WHERE length(trim(form)) BETWEEN 2 AND 40 AND contains(lower(d.text), lower(trim(form))))
SELECT doc_id, ord::BIGINT AS ord, form FROM v""")
def terms_checked(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    forms = F.array(*map(F.lit, ("und", "The ", "x", "la")))
    terms = docs.select("doc_id", F.posexplode(forms).alias("ord", "form")).withColumns({"ord": F.col("ord") + 1, "gloss": F.lit("")})
    return G.valid_terms(terms, docs).select("doc_id", F.col("ord").cast(_LONG), "form")


@query(f"""WITH {_LINES}, o AS (SELECT * FROM lines WHERE length(text) > 0) SELECT doc_id, max(seg)::BIGINT AS last, count(*) AS n, sum(length(text))::BIGINT AS chars FROM o GROUP BY 1""")
def segments_batched(spark, sf_dir):
    segments = D.line_segments(table(spark, sf_dir, "documents")).where(F.length("text") > 0)
    df = D.size_batches(segments.select("doc_id", F.col("seg").cast("int").alias("seg"), "text"), 1000)
    # a batch is within its size unless it is one segment
    sizes = df.groupBy("doc_id", "batch").agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("n"), F.max("seg").alias("last")).where("chars <= 1000 or n = 1")
    return sizes.groupBy("doc_id").agg(F.max("last").cast(_LONG).alias("last"), F.sum("n").alias("n"), F.sum("chars").alias("chars"))


@query("""SELECT doc_id, coalesce(nullif(trim(CASE WHEN doc_id % 3 = 0 THEN source END), ''), nullif(trim(CASE WHEN doc_id % 3 = 1 THEN ' ' END), ''), 'file name ' || doc_id) AS title FROM documents""")
def titles(spark, sf_dir):
    n = F.col("doc_id") % 3
    name = F.concat(F.lit("file-name_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return table(spark, sf_dir, "documents").select("doc_id", D.choose_title(F.when(n == 0, F.col("source")), F.when(n == 1, F.lit(" ")), name, F.col("text")).alias("title"))


@query("""SELECT doc_id, sha256(substr(text, 1, greatest(length(text) // 4, 0)) || substr(text, length(text) // 4 + 1, 10) || substr(text, length(text) // 4 + 11)) AS whole, length(text)::BIGINT AS n FROM documents""")
def quotes_marked(spark, sf_dir):
    """The marked pieces of every text, put together again, are the text; masked quotes come back by `restored`."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = docs.select("doc_id", F.lit(0).alias("span"), F.floor(F.length("text") / 4).alias("a")).withColumn("b", F.col("a") + 10)
    pieces = D.marked_pieces(docs, spans.select("doc_id", F.col("span").cast(_LONG), F.col("a").cast(_LONG), F.col("b").cast(_LONG)))
    back = D.masked(pieces).select("doc_id", D.restored(F.col("masked"), F.col("quotes")).alias("t"))
    return back.select("doc_id", F.sha2(F.col("t").cast("binary"), 256).alias("whole"), F.length("t").cast(_LONG).alias("n"))


@query("""WITH w AS (SELECT doc_id, regexp_split_to_array(text, '[^A-Za-zÀ-ÖØ-öø-ÿ''’-]+') AS w FROM documents), t AS (SELECT doc_id, x, generate_subscripts(w, 1) - 1 AS i FROM w, LATERAL (SELECT unnest(w) AS x)),
t2 AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS i FROM w), h AS (SELECT doc_id, lower(x) AS term, min(i) AS position FROM t2 WHERE lower(x) IN ('the', 'und', 'les') AND (lower(x) <> 'und' OR x = 'und') GROUP BY 1, 2) SELECT doc_id, term, position::BIGINT AS position FROM h""")
def terms_tagged(spark, sf_dir):
    terms = spark.createDataFrame([("the", "the", False), ("und", "und", True), ("les", "les", False)], "term string, form string, lower_only boolean")
    return D.tag_terms(table(spark, sf_dir, "documents"), terms, letter="A-Za-zÀ-ÖØ-öø-ÿ").select("doc_id", "term", F.col("position").cast(_LONG))


# --- keys, sinks and states ------------------------------------------------------------------------------------------


@query(f"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(text, '[\u200B\u200E\u200F\u061C\u202A-\u202E\u2066-\u2069\uFEFF\u00AD]', '', 'g'), '[ \t]+', ' ', 'g'), ' +([.,،؛:])', '\\1', 'g'))) AS cleaned FROM documents""")
def text_cleaned(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.clean(F.col("text")).cast("binary")).alias("cleaned"))


@query("""SELECT doc_id, substr(sha256(trim(text)), 1, 32) AS id, CASE WHEN length(text) > 60 THEN substr(text, 1, 60) || '…' ELSE text END AS opening FROM documents""")
def content_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.content_id(F.col("text")).alias("id"), T.clip(F.col("text"), 60).alias("opening"))


@query("""SELECT event_id, (event_id // 60) || ':' || lpad((event_id % 60)::VARCHAR, 2, '0') AS clock, translate(event_id::VARCHAR, '0123456789', '٠١٢٣٤٥٦٧٨٩') AS shown FROM events""")
def clock_and_digits(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.clock(F.col("event_id")).alias("clock"), T.arabic_digits(F.col("event_id").cast("string")).alias("shown"))


@query("""WITH n AS (SELECT l_orderkey, l_linenumber, l_orderkey || chr((96 + l_linenumber)::INT) AS number FROM lineitem) SELECT number, l_orderkey || '.' || l_linenumber AS canonical, l_orderkey::VARCHAR AS base, list_aggregate([l_orderkey || chr((96 + l_linenumber)::INT)], 'string_agg', ',') AS expanded FROM n""")
def number_keys(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.concat(F.col("l_orderkey").cast("string"), F.char(96 + F.col("l_linenumber"))).alias("number"))
    return lines.select("number", P.canonical_number(F.col("number")).alias("canonical"), P.number_base(F.col("number")).alias("base"), F.array_join(P.expand_numbers(F.col("number")), ",").alias("expanded"))


@query(f"""WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents), g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+3], ' ') AS g FROM w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS t(i) WHERE len(w) > 0) SELECT doc_id, count(*) AS n, min(g) AS first FROM g GROUP BY 1""")
def word_gram_sets(spark, sf_dir):
    grams = table(spark, sf_dir, "documents").select("doc_id", T.word_grams(T.latin_words(F.col("text"))).alias("g")).where(F.size("g") > 0)
    return grams.select("doc_id", F.size("g").cast(_LONG).alias("n"), F.array_min("g").alias("first"))


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) SELECT a.vec_id, round(list_cosine_similarity(a.e, b.e), 9) AS similarity FROM v a JOIN v b ON b.vec_id = a.vec_id + 1""")
def vector_cosine(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    both = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")
    return both.select("vec_id", F.round(T.cosine(F.col("embedding"), F.col("other")), 9).alias("similarity"))


@query("""SELECT count(*) AS accepted, (SELECT count(*) FROM embeddings WHERE len(embedding) <> 64 OR length(vec_id::VARCHAR) > 3) AS rejected FROM embeddings WHERE len(embedding) = 64 AND length(vec_id::VARCHAR) <= 3""")
def vector_intake(spark, sf_dir):
    good, bad = I.intake(table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("v")), 64, longest=3)
    both = good.select(F.lit(1).alias("g")).unionByName(bad.select(F.lit(0).alias("g")))
    return both.agg(F.count_if(F.col("g") == 1).alias("accepted"), F.count_if(F.col("g") == 0).alias("rejected"))


@query("""SELECT d.doc_id, CASE WHEN l.quality IS NOT NULL THEN 'q' || l.quality ELSE d.source END AS source FROM documents d LEFT JOIN labels l USING (doc_id)""")
def column_backfill(spark, sf_dir):
    values = table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("source"))
    return sinks.backfill(table(spark, sf_dir, "documents").select("doc_id", "source"), values, "doc_id", "source")


@query("""SELECT doc_id AS key, quality AS value, 1 AS version FROM labels WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, -quality, 0 FROM labels WHERE doc_id % 2 = 1""")
def table_upsert(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), "quality")
    old = labels.select("key", (-F.col("quality")).alias("value"), F.lit(0).alias("version"))
    return R.upsert(old, labels.where("key % 2 = 0").select("key", F.col("quality").alias("value"), F.lit(1).alias("version")), ["key"])


@query("""SELECT 'title: ' || coalesce(source, 'none') || ' | text: ' || substr(text, 1, 100) AS text, doc_id::VARCHAR AS id FROM documents""")
def request_lines(spark, sf_dir):
    units = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("key"), "source", F.substring("text", 1, 100).alias("text"))
    return sinks.requests(units, F.col("source"), F.col("text")).select("id", "text")


@query("""SELECT c.c_custkey AS ref, 'bukhari:' || c_custkey || chr((97 + c_custkey % 3)::INT) AS key FROM customer c WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, NULL FROM customer WHERE c_custkey % 2 = 1""")
def names_numbers(spark, sf_dir):
    aliases = spark.createDataFrame([("bukhari", "bukhari")], "alias string, collection string")
    n = F.col("c_custkey")
    refs = table(spark, sf_dir, "customer").select(n.alias("ref"), F.when(n % 2 == 0, "sahihbukhari").otherwise("nobody").alias("name"), F.concat(F.lit("no. "), n.cast("string"), F.char((97 + n % 3).cast("int"))).alias("number"))
    return S.named_numbers(refs, aliases, F.col("name"))


@query("""SELECT doc_id, source FROM documents WHERE source = 'src2' OR (source = 'src1' AND doc_id BETWEEN 10 AND 500) UNION ALL SELECT doc_id, source FROM documents d WHERE coalesce(source, '') <> 'src2' AND NOT (coalesce(source, '') = 'src1' AND doc_id BETWEEN 10 AND 500) AND doc_id IN (SELECT doc_id FROM labels)""")
def sample_taken(spark, sf_dir):
    units = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("key"), F.coalesce("source", F.lit("")).alias("collection"), F.col("doc_id").alias("number_base"), "source")
    return sinks.sample_rows(units, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key")), ["src2"], {"src1": (10, 500)}).select("doc_id", "source")
