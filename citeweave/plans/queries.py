"""The registered queries: each operator over the driver's tables, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeweave.functions import text as T
from citeweave.operators import documents as D
from citeweave.operators import evaluate as E
from citeweave.operators import listing as G
from citeweave.operators import records as R
from citeweave.operators import retrieve as I
from citeweave.operators import verify as V
from citeweave.operators.common import broadcast_if_small, numbered, table, top

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_STOP = ", ".join(f"'{w}'" for w in T.LATIN_STOP)
_WORDS = "list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')"
_TOKENS = f"""
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
tok AS (SELECT doc_id, unnest(w) AS token, generate_subscripts(w, 1) AS pos FROM docs),
"""
_LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seg FROM documents)"


@query(f"""WITH {_TOKENS}
kept AS (SELECT doc_id, token, min(pos) AS pos FROM tok WHERE length(token) >= 3 AND token NOT IN ({_STOP}) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM kept)
SELECT d.doc_id, coalesce(string_agg(token, ' ' ORDER BY k), '') AS tokens FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id GROUP BY 1""")
def norm_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.latin_tokens(F.col("text")), " ").alias("tokens"))


@query(f"WITH {_TOKENS} f AS (SELECT token, count(DISTINCT doc_id) AS df FROM tok GROUP BY 1) SELECT token, df FROM f WHERE df >= 30")
def token_df(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return I.token_df(I.postings(docs, T.latin_words(F.col("text")), "doc_id"), 30).select("token", "df")


@query(f"""WITH {_TOKENS}
f AS (SELECT token, count(DISTINCT doc_id) AS df FROM tok GROUP BY 1 HAVING count(DISTINCT doc_id) >= 30),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
q AS (SELECT item_id, token, min(p) AS p FROM (SELECT item_id, unnest(w) AS token, generate_subscripts(w, 1) AS p FROM b) GROUP BY 1, 2),
d AS (SELECT item_id, token, p, coalesce(df, 0) AS df FROM q LEFT JOIN f USING (token)),
r AS (SELECT item_id, token, df, row_number() OVER (PARTITION BY item_id ORDER BY df, p) AS k FROM d WHERE df <= 0.05 * (SELECT count(*) FROM documents))
SELECT item_id, token, df FROM r WHERE k <= 12""")
def rarest_tokens(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    frequencies = I.token_df(I.postings(docs, T.latin_words(F.col("text")), "doc_id"), 30)
    return I.rarest_tokens(items, T.latin_words(F.col("text")), frequencies, docs.count(), 12, 0.05, "item_id").select(F.col("query").alias("item_id"), "token", "df")


def _bm25(spark, sf_dir, k=10):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    q = items.select(F.col("item_id").alias("query"), F.explode(T.latin_tokens(F.col("text"))).alias("token"))
    return I.bm25(q, docs.select(F.col("doc_id").alias("key"), T.latin_words(F.col("text")).alias("words")), k)


_BM25 = f"""{_TOKENS}
p AS (SELECT doc_id, token, count(*) AS tf FROM tok GROUP BY 1, 2),
len AS (SELECT doc_id, len(w) AS n FROM docs), st AS (SELECT count(*) AS n, avg(n) AS mean FROM len),
qa AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
qb AS (SELECT item_id, token, min(p) AS pos FROM (SELECT item_id, unnest(w) AS token, generate_subscripts(w, 1) AS p FROM qa) WHERE length(token) >= 3 AND token NOT IN ({_STOP}) GROUP BY 1, 2),
qc AS (SELECT item_id, token FROM qb),
dfq AS (SELECT token, count(*) AS df FROM p GROUP BY 1),
s AS (SELECT item_id, p.doc_id, round(sum(greatest(ln((st.n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len.n / st.mean))), 6) AS score
  FROM qc JOIN p USING (token) JOIN dfq USING (token) JOIN len ON len.doc_id = p.doc_id CROSS JOIN st GROUP BY 1, 2),
bm AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s)"""


@query(f"WITH {_BM25} SELECT item_id, doc_id, score, rank FROM bm WHERE rank <= 10")
def bm25_topk(spark, sf_dir):
    return _bm25(spark, sf_dir).select(F.col("query").alias("item_id"), F.col("key").alias("doc_id"), "score", F.col("rank").cast("long"))


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.e, v.e), 9) AS s FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, s AS similarity, rank FROM r WHERE rank <= 10""")
def cosine_topk(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    df = I.nearest(v.where("key % 20 = 0"), v, 10)
    return df.select(F.col("query").alias("query_id"), F.col("key").alias("vec_id"), "similarity", F.col("rank").cast("long"))


_GRAMS = """
dg AS (SELECT doc_id, i AS p, array_to_string(w[i:i+3], ' ') AS gram FROM docs, unnest(generate_series(1, len(w) - 3)) AS t(i)),
ig AS (SELECT item_id, i AS q, array_to_string(w[i:i+3], ' ') AS gram FROM items, unnest(generate_series(1, len(w) - 3)) AS t(i)),
"""
_BOTH = f"docs AS (SELECT doc_id, {_WORDS} AS w FROM documents), items AS (SELECT item_id, {_WORDS} AS w FROM benchmark), {_GRAMS}"


@query(f"""WITH {_BOTH}
c AS (SELECT doc_id, item_id, count(DISTINCT gram) AS shared FROM dg JOIN ig USING (gram) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY shared DESC, item_id) AS k FROM c)
SELECT doc_id, item_id, shared FROM r WHERE k <= 5""")
def shingle_candidates(spark, sf_dir):
    words = T.latin_words(F.col("text")).alias("words")
    items, docs = table(spark, sf_dir, "benchmark").select("item_id", words), table(spark, sf_dir, "documents").select("doc_id", words)
    return V.gram_candidates(items, docs).select("doc_id", "item_id", "shared")


@query(f"""WITH {_BM25},
b AS (SELECT item_id, doc_id, rank FROM bm WHERE rank <= 10),
items AS (SELECT item_id, {_WORDS} AS w FROM benchmark), {_GRAMS.rstrip().rstrip(',')},
g AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY shared DESC, doc_id) AS rank FROM (SELECT item_id, doc_id, count(DISTINCT gram) AS shared FROM dg JOIN ig USING (gram) GROUP BY 1, 2)),
u AS (SELECT item_id, doc_id, rank, 0 AS l FROM b UNION ALL SELECT item_id, doc_id, rank, 1 FROM g WHERE rank <= 10),
f AS (SELECT item_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score, min(l * 1000000 + rank) AS o FROM u GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, o, doc_id) AS rank FROM f)
SELECT item_id, doc_id, score, rank FROM r WHERE rank <= 24""")
def rrf_fuse(spark, sf_dir):
    words = T.latin_words(F.col("text")).alias("words")
    items, docs = table(spark, sf_dir, "benchmark").select("item_id", words), table(spark, sf_dir, "documents").select("doc_id", words)
    grams = V.gram_candidates(items, docs, None)
    grams = top(grams.select(F.col("item_id").alias("query"), F.col("doc_id").alias("key"), "shared"), ["query"], [F.desc("shared"), "key"], 10)
    fused = I.fuse([_bm25(spark, sf_dir), grams], 24)
    return fused.select(F.col("query").alias("item_id"), F.col("key").alias("doc_id"), "score", F.col("rank").cast("long"))


@query("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def containment_exact(spark, sf_dir):
    return V.contained(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


@query(f"""WITH c AS (SELECT doc_id, item_id, len({_WORDS.replace('text', 'd.text')}) AS n FROM documents d JOIN benchmark b ON contains(regexp_replace(' ' || lower(d.text) || ' ', '[^a-z0-9]+', ' ', 'g'), regexp_replace(' ' || lower(b.text) || ' ', '[^a-z0-9]+', ' ', 'g')))
SELECT doc_id, item_id, 'verbatim' AS status FROM c""")
def quoted_verbatim(spark, sf_dir):
    found = verify_documents(spark, sf_dir)
    return found.where("status = 'verbatim' and similarity = 1").select("doc_id", "item_id", "status")


@query(f"""WITH {_BOTH}
s AS (SELECT doc_id, item_id, p - q AS shift FROM dg JOIN ig USING (gram)), n AS (SELECT item_id, len(w) AS n FROM items)
SELECT doc_id, item_id, floor(shift / greatest(4 * n, {V.WIDTH}))::BIGINT AS "range", min(shift)::BIGINT AS low, max(shift)::BIGINT AS high, count(*) AS shared FROM s JOIN n USING (item_id) GROUP BY 1, 2, 3""")
def candidate_ranges(spark, sf_dir):
    """What `verify_documents` aligns: every range of shifts of every passage and document that share a gram."""
    words = T.latin_words(F.col("text")).alias("words")
    df = V.shift_ranges(table(spark, sf_dir, "benchmark").select("item_id", words), table(spark, sf_dir, "documents").select("doc_id", words))
    return df.select("doc_id", "item_id", "range", F.col("low").cast("long"), F.col("high").cast("long"), "shared")


@query()
def verify_documents(spark, sf_dir):
    """Flagship: every benchmark passage that a document quotes, aligned and classified."""
    return V.verify(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


@query(f"""WITH RECURSIVE {_LINES},
l AS (SELECT DISTINCT doc_id, regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g') AS k FROM lines WHERE length(text) >= 120),
h AS (SELECT k, min(doc_id) AS m FROM l GROUP BY k), e AS (SELECT DISTINCT doc_id AS a, m AS b FROM l JOIN h USING (k) WHERE doc_id <> m),
both_ AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT a AS node, a AS seen FROM both_ UNION SELECT r.node, b.b FROM reach r JOIN both_ b ON r.seen = b.a)
SELECT node AS doc_id, min(seen) AS family_id FROM reach GROUP BY 1""")
def near_copy_families(spark, sf_dir):
    """Documents that share a long line are of one family; each line links its documents to the first of them."""
    lines = D.line_segments(table(spark, sf_dir, "documents")).where(F.length("text") >= 120)
    keyed = lines.select("doc_id", F.xxhash64(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")).alias("k")).distinct()
    first = keyed.groupBy("k").agg(F.min("doc_id").alias("first"))
    links = keyed.join(first, "k").where("doc_id != first").select(F.col("doc_id").alias("u"), F.col("first").alias("v")).distinct()
    ranks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("key"), F.lit(0).alias("rank"))
    return R.families(links, ranks).select(F.col("key").alias("doc_id"), "family_id")


_SIDES = """l AS (SELECT doc_id AS id, text AS t, lower(split_part(text, chr(10), 1)) AS f FROM documents WHERE doc_id % 2 = 0),
r AS (SELECT doc_id AS id, text AS t, lower(split_part(text, chr(10), 1)) AS f FROM documents WHERE doc_id % 2 = 1),
p1 AS (SELECT a.id AS left_id, b.id AS right_id, 'text' AS method FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY id) AS n FROM l) a JOIN (SELECT *, row_number() OVER (PARTITION BY t ORDER BY id) AS n FROM r) b ON a.t = b.t AND a.n = b.n),
l2 AS (SELECT * FROM l WHERE id NOT IN (SELECT left_id FROM p1)), r2 AS (SELECT * FROM r WHERE id NOT IN (SELECT right_id FROM p1)),
p2 AS (SELECT a.id AS left_id, b.id AS right_id, 'first_line' AS method FROM (SELECT *, row_number() OVER (PARTITION BY f ORDER BY id) AS n FROM l2) a JOIN (SELECT *, row_number() OVER (PARTITION BY f ORDER BY id) AS n FROM r2) b ON a.f = b.f AND a.n = b.n),
p AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2)"""


def _sides(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("text"), F.sha2(F.lower(F.substring_index("text", "\n", 1)), 256).alias("first_line"))
    return df.where("id % 2 = 0"), df.where("id % 2 = 1")


@query(f"WITH {_SIDES} SELECT left_id, right_id, method FROM p")
def link_cascade(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    return R.match_cascade(left, right, [("text", "text"), ("first_line", "first_line")])


@query(f"""WITH {_SIDES} SELECT id AS doc_id, 'left' AS side FROM l WHERE id NOT IN (SELECT left_id FROM p) UNION ALL SELECT id, 'right' FROM r WHERE id NOT IN (SELECT right_id FROM p)""")
def leftovers(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    pairs = R.match_cascade(left, right, [("text", "text"), ("first_line", "first_line")])
    rest = lambda df, c, side: df.join(pairs.select(F.col(c).alias("id")), "id", "left_anti").select(F.col("id").alias("doc_id"), F.lit(side).alias("side"))
    return rest(left, "left_id", "left").unionByName(rest(right, "right_id", "right"))


@query(f"""WITH w AS (SELECT conv_id, turn, len({_WORDS}) AS n FROM conversations),
s AS (SELECT *, last_value(CASE WHEN n > 12 THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM w)
SELECT conv_id, turn, CASE WHEN n <= 12 THEN before END AS same_as FROM s""")
def same_as_previous(spark, sf_dir):
    df = table(spark, sf_dir, "conversations")
    return R.same_as_previous(df, ["conv_id"], ["turn"], F.size(T.latin_words(F.col("text"))), F.lit(True), "turn").select("conv_id", "turn", "same_as")


@query("""SELECT o_orderkey, lag(o_orderkey) OVER w AS previous, lead(o_orderkey) OVER w AS next FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def prev_next(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return R.neighbours(df, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderkey").select("o_orderkey", "previous", "next")


@query("""WITH refs AS (SELECT o_orderkey AS ref, c.c_nationkey AS collection, o.o_custkey + o_orderkey % 3 AS number FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey),
c AS (SELECT ref, number, c_custkey AS key, row_number() OVER (PARTITION BY ref ORDER BY (c_custkey IS NOT NULL AND c_custkey = number) DESC, c_custkey NULLS LAST) AS k
  FROM refs LEFT JOIN customer ON c_nationkey = collection AND c_custkey // 10 = number // 10)
SELECT ref, key, CASE WHEN key = number THEN 'number' WHEN key IS NOT NULL THEN 'base' END AS resolved_by FROM c WHERE k = 1""")
def resolve_number(spark, sf_dir):
    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    base = lambda c: F.floor(F.col(c) / 10)
    refs = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("ref"), F.col("c_nationkey").alias("collection"), (F.col("o_custkey") + F.col("o_orderkey") % 3).alias("number"))
    records = customers.select(F.col("c_nationkey").alias("collection"), base("c_custkey").alias("number_base"), F.col("c_custkey").alias("number"), F.col("c_custkey").alias("ord"), F.col("c_custkey").alias("key"))
    return R.resolve_numbers(refs.withColumn("number_base", base("number")), records).select("ref", "key", "resolved_by")


@query("""SELECT a.l_orderkey, a.l_linenumber, b.l_linenumber AS near_line, b.l_partkey AS near_part FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber BETWEEN a.l_linenumber - 4 AND a.l_linenumber + 2""")
def range_neighbours(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    refs = lines.select("l_orderkey", "l_linenumber")
    df = R.expand_window(refs, lines, "l_orderkey", "l_linenumber", 4, 2)
    return df.select("l_orderkey", "l_linenumber", F.col("row_l_linenumber").alias("near_line"), F.col("row_l_partkey").alias("near_part"))


@query("""WITH s AS (SELECT *, last_value(CASE WHEN event_type = 'click' THEN struct_pack(i := event_id, t := ts) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM events)
SELECT event_id, CASE WHEN ts - c.t <= INTERVAL 1 DAY THEN c.i END AS click_id FROM s WHERE event_type = 'purchase'""")
def asof_attach(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    near = F.col("ts") - F.col("_seen.ts") <= F.expr("interval 1 day")
    df = V.attach_last(df, ["user_id"], ["ts", "event_id"], F.col("event_type") == "click", F.struct("event_id", "ts"), near)
    return df.where("event_type = 'purchase'").select("event_id", F.col("attached.event_id").alias("click_id"))


@query("""WITH e AS (SELECT user_id, epoch_us(ts) // 1000000 AS a, epoch_us(ts) // 1000000 + 3600 AS b, event_type FROM events),
l AS (SELECT DISTINCT user_id, a, b FROM e WHERE event_type = 'purchase'), f AS (SELECT DISTINCT user_id, a, b FROM e WHERE event_type = 'view')
SELECT user_id, a, b FROM l UNION ALL SELECT user_id, a, b FROM f WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.user_id = f.user_id AND l.a < f.b AND f.a < l.b)""")
def interval_merge(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("a"), "event_type").withColumn("b", F.col("a") + 3600)
    side = lambda kind: e.where(F.col("event_type") == kind).select("user_id", "a", "b").distinct()
    return V.merge_intervals(side("purchase"), side("view"), ["user_id"], 3600)


@query(f"""WITH {_LINES} SELECT doc_id, seg, length(text) AS n_chars, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM lines""")
def segments_offsets(spark, sf_dir):
    return D.line_segments(table(spark, sf_dir, "documents")).select("doc_id", "seg", F.length("text").cast("long").alias("n_chars"), "start")


@query(f"""WITH {_LINES}, s AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM lines),
p AS (SELECT doc_id, o AS pos FROM documents, unnest([0, n_chars // 2, n_chars - 1]) AS t(o))
SELECT DISTINCT p.doc_id, p.pos AS "offset", max(seg) AS seg FROM p JOIN s ON s.doc_id = p.doc_id AND s.start <= p.pos GROUP BY 1, 2""")
def segment_at(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    points = docs.select("doc_id", F.explode(F.array(F.lit(0).cast("long"), F.floor(F.col("n_chars") / 2), F.col("n_chars") - 1)).alias("offset")).distinct()
    return D.segment_at(points, D.line_segments(docs)).select("doc_id", "offset", "seg")


@query(f"""WITH {_LINES}, s AS (SELECT doc_id, seg, last_value(CASE WHEN length(text) < 30 THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seg) AS section FROM lines)
SELECT doc_id, seg, section, CASE WHEN section IS DISTINCT FROM lag(section) OVER (PARTITION BY doc_id ORDER BY seg) THEN section END AS shown FROM s""")
def section_carry(spark, sf_dir):
    df = D.carried_sections(D.line_segments(table(spark, sf_dir, "documents")), F.length("text") < 30)
    return df.select("doc_id", "seg", "section", "shown")


_GRADES = """g AS (SELECT l_partkey AS unit, l_suppkey % 4 AS grader, CASE l_returnflag WHEN 'A' THEN 'sahih' WHEN 'N' THEN 'hasan' ELSE 'daif' END AS class,
  CASE WHEN l_quantity < 25 THEN 'low' ELSE 'high' END AS grade, l_linestatus AS source, l_discount > 0.05 AS prim, l_orderkey * 100 + l_linenumber AS ord FROM lineitem),
c AS (SELECT unit, grader, class, arg_min(grade, ord) AS grade, string_agg(DISTINCT grade, ',' ORDER BY grade) AS wordings, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, bool_or(prim) AS prim,
  count(*) OVER (PARTITION BY unit, grader) > 1 AS conflict FROM g GROUP BY 1, 2, 3)"""


def _combined(spark, sf_dir):
    ord_ = F.struct((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("ord"), "_metadata.file_path", "_metadata.row_index")  # of one number the first row
    g = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("unit"), (F.col("l_suppkey") % 4).alias("grader"), F.when(F.col("l_returnflag") == "A", "sahih").when(F.col("l_returnflag") == "N", "hasan").otherwise("daif").alias("class"),
        F.when(F.col("l_quantity") < 25, "low").otherwise("high").alias("grade"), F.col("l_linestatus").alias("source"), (F.col("l_discount") > 0.05).alias("primary"), ord_.alias("ord"),
    )
    return R.combine_grades(g)


@query(f"WITH {_GRADES} SELECT unit, grader, class, grade, wordings, sources, prim, conflict FROM c")
def grade_combine(spark, sf_dir):
    return _combined(spark, sf_dir).select("unit", "grader", "class", "grade", F.array_join("wordings", ",").alias("wordings"), F.array_join("sources", ",").alias("sources"), F.col("primary").alias("prim"), "conflict")


@query(f"""WITH {_GRADES}, s AS (SELECT unit, list(DISTINCT class) AS k, count(DISTINCT grader) AS graders, bool_or(conflict) AS sc FROM c GROUP BY 1)
SELECT p_partkey AS unit, CASE WHEN p_brand = 'Brand#11' THEN 'sahihayn' WHEN k IS NULL THEN 'ungraded'
  WHEN (list_contains(k, 'sahih') OR list_contains(k, 'hasan')) AND list_contains(k, 'daif') THEN 'disputed' WHEN list_contains(k, 'sahih') AND list_contains(k, 'hasan') THEN 'hasan_or_sahih'
  WHEN list_contains(k, 'daif') THEN 'daif' WHEN list_contains(k, 'sahih') THEN 'sahih' ELSE 'hasan' END AS status, coalesce(graders, 0) AS graders, coalesce(sc, false) AS source_conflict
FROM part LEFT JOIN s ON unit = p_partkey""")
def grade_summary(spark, sf_dir):
    units = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("unit"), F.col("p_brand").alias("collection"))
    return R.grade_summary(_combined(spark, sf_dir), units, ("Brand#11",)).select("unit", "status", "graders", "source_conflict")


@query(f"""WITH {_GRADES}, r AS (SELECT unit, grader, grade, len(string_split(sources, ',')) AS n, row_number() OVER (PARTITION BY unit, grader ORDER BY len(string_split(sources, ',')) DESC, grade, class) AS k FROM c)
SELECT unit, grader, max(CASE WHEN k = 1 THEN grade END) AS grade, max(CASE WHEN k = 1 THEN n END) AS n_sources, count(*) - 1 AS n_others FROM r GROUP BY 1, 2""")
def grade_view(spark, sf_dir):
    return R.grade_view(_combined(spark, sf_dir)).select("unit", "grader", "grade", F.size("sources").cast("long").alias("n_sources"), F.size("others").cast("long").alias("n_others"))


@query("""WITH c AS (SELECT user_id AS id, substr(event_type, 1, (1 + event_id % 5)::INT) AS name, count(*) AS n FROM events GROUP BY 1, 2),
v AS (SELECT c.id, c.name, c.n, sum(o.n) AS votes FROM c JOIN c o ON c.id = o.id AND (starts_with(c.name, o.name) OR starts_with(o.name, c.name)) GROUP BY 1, 2, 3),
r AS (SELECT *, sum(n) OVER (PARTITION BY id) AS total, row_number() OVER (PARTITION BY id ORDER BY votes DESC, n DESC, name) AS k FROM v)
SELECT id, name, votes::BIGINT AS votes, total::BIGINT AS total FROM r WHERE k = 1 AND votes >= 0.2 * total""")
def majority_vote(spark, sf_dir):
    name = F.expr("substring(event_type, 1, cast(1 + event_id % 5 as int))")  # spellings that are openings of one another
    return R.majority(table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), name.alias("name")), 0.2)


@query("""SELECT source, count(*) AS n, CASE WHEN source IN ('src0', 'src1') THEN 'core' WHEN source = 'src2' THEN 'anthology' ELSE 'other' END AS grp FROM documents GROUP BY 1""")
def collection_counts(spark, sf_dir):
    return G.collection_counts(table(spark, sf_dir, "documents"), "source", {"src0": "core", "src1": "core", "src2": "anthology"}, "other")


@query("""SELECT source, lang, n, first_doc, row_number() OVER (PARTITION BY source ORDER BY first_doc) AS chapter FROM (SELECT source, lang, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1, 2)""")
def chapters(spark, sf_dir):
    return G.chapter_list(table(spark, sf_dir, "documents"), "source", "lang", "doc_id").withColumnsRenamed({"first": "first_doc", "place": "chapter"})


@query("""SELECT doc_id, source, lang, n_chars, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS place FROM documents""")
def chapter_rows(spark, sf_dir):
    """Every row of every chapter (source, lang), also of those without a name, with its place; a reader pages by place."""
    df = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    return numbered(df.withColumn("_k", F.struct("source", "lang")), ["_k"], "doc_id", "place").drop("_k")


@query("""WITH r AS (SELECT o_orderkey, c.c_custkey, c_acctbal FROM orders JOIN customer c ON c.c_custkey BETWEEN o_custkey AND o_custkey + 2) SELECT o_orderkey, c_custkey, c_acctbal FROM r""")
def range_expand(spark, sf_dir):
    refs = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("first"), (F.col("o_custkey") + 2).alias("last"))
    return G.ranged(refs, table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "first", "last", "c_custkey")


@query("""SELECT DISTINCT u.doc_id, u.lang, u.n_chars FROM documents u JOIN labels l ON u.doc_id = l.doc_id WHERE l.toxic = 1""")
def batch_lookup(spark, sf_dir):
    return G.by_keys(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id", ["lang", "n_chars"])


@query("""SELECT count(*) AS docs, count(*) FILTER (lang = 'en') AS english, count(*) FILTER (n_chars > 1000) AS long_docs, count(DISTINCT source) AS sources, sum(n_chars)::BIGINT AS chars FROM documents""")
def corpus_totals(spark, sf_dir):
    counted = {"docs": F.lit(True), "english": F.col("lang") == "en", "long_docs": F.col("n_chars") > 1000}
    return G.totals(table(spark, sf_dir, "documents"), counted, {"sources": "source"}, {"chars": "n_chars"})


@query("""SELECT event_type, round(median(value), 6) AS median, round(100 * avg(CASE WHEN value >= 50 THEN 1 ELSE 0 END), 4) AS share, count(*) AS n FROM events GROUP BY 1""")
def pairing_stats(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", "value")
    share = e.groupBy("event_type").agg(F.round(100 * F.avg((F.col("value") >= 50).cast("int")), 4).alias("share"))
    return E.medians(e, ["event_type"], "value").join(share, "event_type").select("event_type", F.round("median", 6).alias("median"), "share", "n")


@query("""SELECT user_id, count(*) AS total, count(*) FILTER (event_type = 'error') AS n_error, count(*) FILTER (event_type = 'purchase') AS n_purchase, count(*) FILTER (event_type = 'view') AS n_view FROM events GROUP BY 1""")
def report_summary(spark, sf_dir):
    df = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("status"))
    return D.report_summary(df, ["error", "purchase", "view"]).withColumnRenamed("doc_id", "user_id")


@query("""WITH e AS (SELECT user_id, date_trunc('day', ts) AS day, event_id, event_type, ts, CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END AS s FROM events)
SELECT user_id, count(*) AS n, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS statuses, min(epoch_us(ts)) AS first_start, arg_min(event_id, struct_pack(a := s, b := ts, c := event_id)) AS lead_event, strftime(day, '%Y-%m-%d') AS day FROM e GROUP BY user_id, day""")
def stack_lead(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.date_format("ts", "yyyy-MM-dd").alias("key"), F.lit(None).cast("string").alias("family_id"), F.col("event_id").alias("span"), F.col("event_type").alias("status"), F.unix_micros(F.col("ts").cast("timestamp")).alias("start"))
    df = D.stacks(e, {"error": 0, "purchase": 1})
    return df.select(F.col("doc_id").alias("user_id"), "n", F.array_join("statuses", ",").alias("statuses"), F.col("first_start"), F.col("lead").alias("lead_event"), F.col("source").alias("day"))


@query("""SELECT event_id, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id) <= 1 AS allowed FROM events""")
def hourly_quota(spark, sf_dir):
    return R.hourly_quota(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "user_id", "ts", ["ts", "event_id"], 1).select("event_id", "allowed")


@query("""WITH t AS (SELECT doc_id, sha256(trim(text)) AS hash FROM documents WHERE length(trim(text)) BETWEEN 40 AND 100000) SELECT hash, min(doc_id) AS doc_id FROM t GROUP BY 1""")
def dedupe_hash(spark, sf_dir):
    return R.submissions(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", ["doc_id"]).select("hash", "doc_id")


@query("""SELECT l.doc_id, l.quality, l.toxic FROM labels l WHERE l.doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars < 500)""")
def cascade_delete(spark, sf_dir):
    gone = table(spark, sf_dir, "documents").where("n_chars < 500")
    return R.delete_cascade({"labels": table(spark, sf_dir, "labels")}, gone, "doc_id")["labels"].select("doc_id", "quality", "toxic")


@query("""SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def incremental_todo(spark, sf_dir):
    return R.missing_rows(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id")


@query("""SELECT event_id FROM events WHERE ts + INTERVAL 7 DAY > (SELECT max(ts) FROM events)""")
def ttl_filter(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "ts")
    return R.live(e.crossJoin(F.broadcast(e.agg(F.max("ts").alias("now")))), F.col("ts") + F.expr("interval 7 day"), F.col("now")).select("event_id")


@query("""WITH e AS (SELECT *, event_type <> 'error' AS ok, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events),
b AS (SELECT event_id, ts, ok, least(5, 1 + sum(ok::INT) OVER (PARTITION BY user_id, run ORDER BY ts, event_id)) AS box FROM e)
SELECT event_id, box::BIGINT AS box, epoch_us(CASE WHEN ok THEN ts + to_days([0, 1, 3, 7, 16][box::BIGINT]::INT) ELSE ts + INTERVAL 1 MILLISECOND END) AS due FROM b""")
def review_boxes(spark, sf_dir):
    df = R.review_boxes(table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type"), ["user_id"], ["ts", "event_id"], F.col("event_type") != "error", "ts")
    return df.select("event_id", F.col("box").cast("long"), F.unix_micros(F.col("due").cast("timestamp")).alias("due"))


@query(f"""SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '(?i)\\b({"|".join(T.INDONESIAN_WORDS)})\\b')) > len(regexp_extract_all(text, '(?i)\\b({"|".join(T.ENGLISH_WORDS)})\\b')) THEN 'id' ELSE 'en' END AS guess FROM documents""")
def lang_guess(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.guess_language(F.col("text")).alias("guess"))


@query("""WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '[ء-ي]')) AS a, len(regexp_extract_all(text, '[A-Za-z]')) AS b FROM documents) SELECT doc_id, round(a / greatest(1, a + b), 6) AS share, b AS latin FROM c""")
def script_share(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(T.script_share(F.col("text")), 6).alias("share"), T.latin_letters(F.col("text")).cast("long").alias("latin"))


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings),
s AS (SELECT q.vec_id AS q, q.label = v.label AS hit, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.e, v.e), 9) DESC, v.vec_id) AS rank FROM v q JOIN v ON q.vec_id <> v.vec_id),
f AS (SELECT q, min(CASE WHEN hit THEN rank END) AS first FROM s WHERE rank <= 50 GROUP BY 1)
SELECT count(*) AS queries, round(avg(CASE WHEN first = 1 THEN 1.0 ELSE 0 END), 6) AS recall_1, round(avg(CASE WHEN first <= 10 THEN 1.0 ELSE 0 END), 6) AS recall_10, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr FROM f""")
def recall_mrr(spark, sf_dir):
    """Every vector asks for its neighbours among all others."""
    e = table(spark, sf_dir, "embeddings")
    first = E.first_hits(e.select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector")), 50)
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    return first.agg(F.count("*").alias("queries"), share(F.col("first") == 1).alias("recall_1"), share(F.col("first") <= 10).alias("recall_10"), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


@query("""SELECT event_type, list_sort(list(value))[floor(count(*) * 0.5)::INT + 1] AS p50, list_sort(list(value))[least(count(*), floor(count(*) * 0.9)::INT + 1)] AS p90 FROM events GROUP BY 1""")
def percentile_nearest(spark, sf_dir):
    return E.percentiles(table(spark, sf_dir, "events"), ["event_type"], "value", {"p50": 0.5, "p90": 0.9}).drop("n")


@query("""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \\t]+', ' ', 'g')) AS text FROM pages""")
def page_text(spark, sf_dir):
    raw = F.regexp_replace(F.regexp_replace("html", r"(?is)<script.*?</script>|<style.*?</style>", " "), "<[^>]*>", " ")
    return table(spark, sf_dir, "pages").select("page_id", F.trim(F.regexp_replace(raw, r"[ \t]+", " ")).alias("text"))


@query("""SELECT doc_id, CASE WHEN length(text) > 1500 OR (length(text) > 400 AND len(list_filter(regexp_split_to_array(text, '\\n\\s*\\n'), lambda p: trim(p) <> '')) >= 3) THEN 'document' ELSE 'quote' END AS route FROM documents""")
def input_route(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", D.route(F.col("text")).alias("route"))


@query("""WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS token FROM documents), t AS (SELECT unnest(['with', 'was', 'avec', 'nicht', 'para']) AS term)
SELECT term, count(DISTINCT doc_id) AS docs, count(*) AS n FROM w JOIN t ON token = term GROUP BY 1""")
def term_counts(spark, sf_dir):
    terms = spark.createDataFrame([(w,) for w in ("with", "was", "avec", "nicht", "para")], "term string")
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.latin_words(F.col("text"))).alias("term"))
    per_doc = words.join(broadcast_if_small(terms), "term").groupBy("term", "doc_id").agg(F.count("*").alias("m"))
    return per_doc.groupBy("term").agg(F.count("*").alias("docs"), F.sum("m").alias("n"))


@query("""SELECT c_mktsegment, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""")
def segment_names(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    counts = table(spark, sf_dir, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"))
    return counts.join(broadcast_if_small(nation), F.col("c_nationkey") == F.col("n_nationkey")).select("c_mktsegment", "n_name", "n")

