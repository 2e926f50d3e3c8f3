"""Passages quoted in documents: candidates by shared word grams, alignment of windows, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeweave.functions.align import align, align_windows, classify, difference_text
from citeweave.functions.text import bound, latin_words
from citeweave.operators.common import broadcast_if_small, first_of, top, when_of
from citeweave.operators.retrieve import append_absent, fuse
from citeweave.plans.materialize import materialize

GRAM, SLACK = 4, 10
#: Least width, in words, of a range of shifts that shares a window.
WIDTH = 256


def placed_grams(words: Column, n: int = GRAM) -> Column:
    """Array of (position, gram) of every word n-gram."""
    def grams(ws: Column) -> Column:
        last = F.size(ws) - n
        placed = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.struct(i.alias("position"), F.array_join(F.slice(ws, i + 1, n), " ").alias("gram")))
        return F.when(last >= 0, placed).otherwise(F.array().cast("array<struct<position:int,gram:string>>"))

    return bound(words, grams)


def gram_pairs(passages: DataFrame, docs: DataFrame, n: int = GRAM, short: bool = False) -> DataFrame:
    """(doc_id, item_id, gram, p, q): where the word n-grams of the passages stand in the documents, and where in the passage.

    Both tables are (id, words). The grams of the passages are broadcast while they are few; every document keeps only
    grams that a passage has before anything is shuffled. With `short` a passage of fewer than `n` words is a gram as a
    whole; one without words has none.
    """
    def placed(df: DataFrame, key: str, position: str, grams: Column) -> DataFrame:
        return df.select(key, F.explode(grams).alias("g")).select(key, F.col("g.gram").alias("gram"), F.col("g.position").alias(position))

    # at most n - 1 rows
    sizes = [r.n for r in passages.select(F.size("words").alias("n")).where(F.col("n").between(1, n - 1)).distinct().collect()] if short else []
    right = placed(passages, "item_id", "q", placed_grams(F.col("words"), n))
    for size in sizes:
        right = right.unionByName(placed(passages.where(F.size("words") == size), "item_id", "q", placed_grams(F.col("words"), size)))
    grams = [placed_grams(F.col("words"), size) for size in [n, *sizes]]
    left = placed(docs, "doc_id", "p", F.concat(*grams) if sizes else grams[0])
    return left.join(broadcast_if_small(right), "gram")


def gram_candidates(passages: DataFrame, docs: DataFrame, k: int | None = 5, n: int = GRAM) -> DataFrame:
    """(doc_id, item_id, shared): the `k` passages with the most distinct grams in common with a document, or all that have one."""
    votes = gram_pairs(passages, docs, n).groupBy("doc_id", "item_id").agg(F.count_distinct("gram").alias("shared"))
    return top(votes, ["doc_id"], [F.desc("shared"), "item_id"], k).drop("rank") if k else votes


def shift_ranges(passages: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, item_id, range, low, high, shared): where a passage would start in a document by each gram that they share, in ranges of shifts as wide as four passages and `WIDTH` words at least.

    Both tables are (id, words); passages shorter than a gram count as a whole.
    """
    shifts = gram_pairs(passages, docs, short=True).select("doc_id", "item_id", (F.col("p") - F.col("q")).alias("shift"))
    shifts = shifts.join(broadcast_if_small(passages.select("item_id", F.size("words").alias("n"))), "item_id")
    span = F.floor(F.col("shift") / F.greatest(4 * F.col("n"), F.lit(WIDTH))).alias("range")
    return shifts.groupBy("doc_id", "item_id", span).agg(F.min("shift").alias("low"), F.max("shift").alias("high"), F.count("*").alias("shared"))


def verify(passages: DataFrame, docs: DataFrame, slack: int = SLACK) -> DataFrame:
    """Findings (doc_id, item_id, similarity, coverage, status, first_word, difference): how each passage stands in every document that shares a gram with it.

    The passage is the spoken side and the document the source, so coverage is the share of the passage that the
    document has. Both tables are (id, text). A shared gram gives a shift, where the passage would start. An alignment
    has fewer than two missing words for each of the passage, so all that run through a gram lie within two lengths
    on both sides of the passage at its shift. Shifts are dealt into ranges, each with a window of that margin, and
    the best alignment of all windows is taken: a window is bounded by the passage, however long the document.
    """
    words = latin_words(F.col("text")).alias("words")
    return verify_words(passages.select("item_id", words), docs.select("doc_id", words), slack).drop("last_word")


def verify_words(p: DataFrame, d: DataFrame, slack: int = SLACK) -> DataFrame:
    """`verify` of (item_id, words) and (doc_id, words), with the `last_word` too."""
    found = shift_ranges(p, d).groupBy("doc_id", "item_id").agg(F.array_sort(F.collect_list(F.struct("low", "high"))).alias("ranges"))
    df = found.join(p.withColumnRenamed("words", "passage"), "item_id").join(d, "doc_id")
    n = F.size("passage")
    margin = 2 * n + slack
    placed = F.transform("ranges", lambda r: F.struct(F.greatest(r["low"] - margin, F.lit(0)).alias("at"), (r["high"] + n + margin).alias("to")))
    df = df.select("doc_id", "item_id", "passage", "words", placed.alias("placed"))
    df = df.select("doc_id", "item_id", "passage", F.col("placed.at").alias("at"), F.transform("placed", lambda r: F.slice("words", r["at"] + 1, r["to"] - r["at"])).alias("windows"))
    df = df.repartition("doc_id", "item_id").withColumn("a", align_windows(F.col("passage"), F.col("at"), F.col("windows")))
    status = text_status(F.col("a"))
    return df.select(
        "doc_id", "item_id", F.round("a.similarity", 6).alias("similarity"), F.round("a.coverage", 6).alias("coverage"), status.alias("status"),
        F.col("a.first").cast("long").alias("first_word"), F.col("a.last").cast("long").alias("last_word"), difference_text(F.col("a.ops")).alias("difference"),
    )


def contained(passages: DataFrame, docs: DataFrame, inner: int = 3, few: int = 3) -> DataFrame:
    """(doc_id, item_id) of every passage whose text stands in a document's, character by character. Both tables are (id, text).

    What stands between the first and the last piece of a passage are whole pieces of any text that has it: up to
    `inner` of them, hashed, are the key of a join. A passage of one or two pieces is looked up in the vocabulary of
    the documents, by the first `few` characters of its first piece, which is a part of some piece of any text that has
    it. All pairs that meet are checked. A passage of white space alone is compared with every text.
    """
    piece = lambda t: F.array_remove(F.split(t, r"\s+"), "")
    keyed = passages.where(F.col("text").isNotNull()).select("item_id", F.col("text").alias("passage"), piece(F.col("text")).alias("pieces"))
    keyed = keyed.withColumn("n", F.least(F.greatest(F.size("pieces") - 2, F.lit(0)), F.lit(inner)))
    sizes = [r.n for r in keyed.select("n").distinct().collect() if r.n]  # `inner` rows at most
    d = docs.where(F.col("text").isNotNull()).select("doc_id", "text")
    hashed = lambda ws, n: F.transform(F.sequence(F.lit(0), F.size(ws) - n), lambda i: F.xxhash64(*(F.get(ws, i + k) for k in range(n))))
    met = None
    for n in sizes:
        own = keyed.where(F.col("n") == n).select("item_id", F.xxhash64(*(F.get("pieces", F.lit(k + 1)) for k in range(n))).alias("key"))
        there = d.withColumn("ws", piece(F.col("text"))).where(F.size("ws") >= n).select("doc_id", F.explode(F.array_distinct(hashed(F.col("ws"), n))).alias("key"))
        pairs = there.join(broadcast_if_small(own), "key").select("doc_id", "item_id")
        met = pairs if met is None else met.unionByName(pairs)
    short = keyed.where((F.col("n") == 0) & (F.size("pieces") > 0)).select("item_id", F.get("pieces", F.lit(0)).alias("needle"))
    short = materialize(short.withColumn("key", F.substring("needle", 1, few)))
    if not short.isEmpty():
        letters = F.split("piece", "")
        parts = F.concat(*(F.transform(letters, lambda c, i: F.concat(c, *(F.coalesce(F.get(letters, i + k), F.lit("")) for k in range(1, n)))) for n in range(1, few + 1)))
        owned = materialize(d.select("doc_id", F.explode(F.array_distinct(piece(F.col("text")))).alias("piece")))
        words = owned.select("piece").distinct().select("piece", F.explode(F.array_distinct(parts)).alias("key"))
        held = words.join(broadcast_if_small(short), "key").where(F.contains("piece", F.col("needle"))).select("piece", "item_id")
        pairs = owned.join(held, "piece").select("doc_id", "item_id").distinct()
        met = pairs if met is None else met.unionByName(pairs)
    blank = keyed.where(F.size("pieces") == 0).select("item_id", "passage")
    found = d.join(broadcast_if_small(blank), F.contains("text", F.col("passage"))).select("doc_id", "item_id")
    if met is None:
        return found
    checked = met.join(d, "doc_id").join(keyed.select("item_id", "passage"), "item_id").where(F.contains("text", F.col("passage")))
    return checked.select("doc_id", "item_id").unionByName(found)


def text_status(a: Column, label: Column | None = None) -> Column:
    """Status of an alignment; in the grey band a stored label, else misquote if words were changed and paraphrase if not."""
    grey = F.when(a["changed"] > 0, "misquote").otherwise("paraphrase")
    if label is not None:
        grey = F.when(label == "different_text", "not_found").otherwise(F.coalesce(label, grey))
    c = classify(a["similarity"], a["coverage"])
    return F.when(c == "grey", grey).otherwise(c)


def choose_match(aligned: DataFrame) -> DataFrame:
    """One match for each span of (span, key, score, verbatim, cited, graded, source_rank, length, similarity, coverage).

    Verbatim candidates come first, else those within half a point of the best score; then cited, graded, source rank,
    shortest, key. A cited candidate with similarity and coverage of 0.6 becomes the match and the former one `closest`.
    """
    w = Window.partitionBy("span")
    best = F.max("score").over(w)
    any_verbatim = F.max(F.col("verbatim").cast("int")).over(w) == 1
    kept = aligned.withColumn("_keep", F.when(any_verbatim, F.col("verbatim")).otherwise(F.col("score") >= best - 0.5))
    order = [F.desc("_keep"), F.desc("cited"), F.desc("graded"), "source_rank", "length", "key"]
    ranked = kept.withColumn("_r", F.row_number().over(w.orderBy(*order)))
    named = F.col("cited") & (F.col("similarity") >= 0.6) & (F.col("coverage") >= 0.6)
    ranked = ranked.withColumn("_named", F.row_number().over(w.orderBy(F.desc(named.cast("int")), "_r"))).withColumn("_closest", F.first("key").over(w.orderBy("_r")))
    chosen = ranked.where(F.col("_named") == 1)
    return chosen.withColumn("closest", F.when(F.col("_closest") != F.col("key"), F.col("_closest"))).drop("_keep", "_r", "_named", "_closest")


def aligned_windows(spoken: DataFrame, units: DataFrame, before: int = 4, after: int = 4) -> DataFrame:
    """(span, key, covered, a): candidates (span, key, words) aligned to their unit joined with its neighbours, and the keys that the alignment covers.

    `units` is (key, grp, ord, words). A quotation across the border of units is found whole; of candidates of a span
    whose alignments cover the same units one is kept, the best and then the first by key.
    """
    at = spoken.select("span", "key").join(units.select("key", "grp", "ord"), "key").withColumn("_o", F.explode(F.sequence(F.col("ord") - before, F.col("ord") + after)))
    near = at.join(units.select("grp", F.col("ord").alias("_o"), F.col("key").alias("_key"), F.col("words").alias("_words")), ["grp", "_o"])
    window = near.groupBy("span", "key").agg(F.array_sort(F.collect_list(F.struct("_o", "_key", "_words"))).alias("w"))  # before + after + 1 units
    owners = F.flatten(F.transform("w", lambda x: F.array_repeat(x["_key"], F.size(x["_words"]))))
    df = window.select("span", "key", F.flatten(F.transform("w", lambda x: x["_words"])).alias("window"), owners.alias("owners")).join(spoken.select("span", "key", "words"), ["span", "key"])
    df = df.withColumn("a", align(F.col("words"), F.col("window")))
    own = F.array_distinct(F.slice("owners", F.greatest(F.col("a.first"), F.lit(0)) + 1, F.greatest(F.col("a.last") - F.col("a.first") + 1, F.lit(0))))
    df = df.select("span", "key", F.when(F.col("a.first") >= 0, own).otherwise(F.array("key")).alias("covered"), "a")
    return first_of(df, ["span", "covered"], [F.desc("a.similarity"), F.desc("a.coverage"), "key"])


def span_candidates(lists: list[DataFrame], cited: DataFrame, limit: int = 24) -> DataFrame:
    """(span, key): the `limit` best of several fused (span, key, rank) lists, and what the span cites (span, key) behind them."""
    fused = fuse([part.withColumnRenamed("span", "query") for part in lists], limit)
    return append_absent(fused, cited.select(F.col("span").alias("query"), "key").distinct()).select(F.col("query").alias("span"), "key")


def check_spans(spans: DataFrame, lists: list[DataFrame], cited: DataFrame, units: DataFrame, limit: int = 24, neighbours: int = 0) -> DataFrame:
    """Findings of quoted spans: candidates, alignment of all of them, the match, its verdict, and the lists of other sources.

    `spans` is (span, words, optional), `lists` are retrieval lists (span, key, rank), `cited` is (span, key), `units`
    (key, words, graded, source_rank, grade_status), with (grp, ord) where `neighbours` units on both sides are to be
    joined. Gives (span, key, covered, text_status, status, confidence, similarity, coverage, difference, closest, near,
    also); a span without candidates is not found, an optional one without a match is left out.
    """
    candidates = span_candidates(lists, cited, limit).join(spans.select("span", "words"), "span")
    if neighbours:
        df = aligned_windows(candidates, units, neighbours, neighbours)
    else:
        df = candidates.join(units.select("key", F.col("words").alias("_w")), "key").withColumn("a", align(F.col("words"), F.col("_w"))).select("span", "key", F.array("key").alias("covered"), "a")
    own = units.select("key", "graded", "source_rank", "grade_status", F.size("words").alias("length"))
    named = cited.select("span", "key", F.lit(True).alias("cited")).distinct()
    df = df.join(own, "key").join(named, ["span", "key"], "left").withColumn("cited", F.coalesce("cited", F.lit(False)))
    points = F.col("a.same") + 0.75 * F.col("a.variant") + 0.5 * F.col("a.near")
    df = df.withColumns({"score": points, "similarity": F.col("a.similarity"), "coverage": F.col("a.coverage"), "verbatim": classify(F.col("a.similarity"), F.col("a.coverage")) == "verbatim"})
    match = choose_match(df)
    found = match.join(near_lists(df, match), "span", "left").withColumn("text_status", text_status(F.col("a")))
    found = spans.select("span", "optional").join(found, "span", "left").withColumn("text_status", F.coalesce("text_status", F.lit("not_found")))
    sure = F.round(F.when(F.col("text_status") == "not_found", 1 - F.coalesce("similarity", F.lit(0.0))).otherwise(F.col("similarity")), 3)
    found = found.withColumn("status", final_status(F.col("text_status"), F.coalesce("grade_status", F.lit("")), F.col("optional"))).where(F.col("status").isNotNull())
    matched = lambda c: F.when(F.col("text_status") != "not_found", F.col(c)).alias(c)
    return found.select("span", matched("key"), matched("covered"), "text_status", "status", sure.alias("confidence"), F.round("similarity", 6).alias("similarity"), F.round("coverage", 6).alias("coverage"), difference_text(F.col("a.ops")).alias("difference"), "closest", "near", "also")


def meaning_findings(spans: DataFrame, lists: list[DataFrame], picks: DataFrame, offered: int = 5, least: float = 0.6) -> DataFrame:
    """(span, key, status, confidence) of spans that give a source's meaning: a judge's pick (span, key, confidence) counts if it was among the `offered` candidates and is sure enough."""
    top_few = fuse([part.withColumnRenamed("span", "query") for part in lists], offered).select(F.col("query").alias("span"), "key")
    good = accepted_picks(picks, top_few, least)
    df = spans.select("span").join(good, "span", "left")
    return df.select("span", "key", F.when(F.col("key").isNotNull(), "meaning").otherwise("not_found").alias("status"), F.round(F.coalesce("confidence", F.lit(0.0)), 3).alias("confidence"))


def near_lists(aligned: DataFrame, matches: DataFrame, near: int = 3, also: int = 12) -> DataFrame:
    """(span, near, also): the best other candidates, and those of the same or close wording with graded ones and better sources first."""
    rest = aligned.join(matches.select("span", F.col("key").alias("match")), "span").where(F.col("key") != F.col("match"))
    n = top(rest, ["span"], [F.desc("score"), "key"], near).groupBy("span").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "key"))), lambda x: x["key"]).alias("near"))
    close = rest.where(F.col("verbatim") | ((F.col("similarity") >= 0.6) & (F.col("coverage") >= 0.6)))
    a = top(close, ["span"], [F.desc("verbatim"), F.desc("graded"), "source_rank", F.desc("similarity"), "key"], also)
    a = a.groupBy("span").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "key"))), lambda x: x["key"]).alias("also"))
    return n.join(a, "span", "full_outer")


def final_status(text: Column, grade_status: Column, optional: Column) -> Column:
    """Weak or disputed sources override all but a misquote; an optional span without a match gives null and is dropped."""
    weak = grade_status.isin("daif", "mawdu", "disputed")
    dropped = F.coalesce(optional, F.lit(False)) & text.isin("not_found", "misquote")
    return when_of([(dropped, F.lit(None).cast("string")), (weak & ~text.isin("misquote", "not_found"), "weak_or_disputed")], text)


def citation_agrees(findings: DataFrame, members: DataFrame) -> DataFrame:
    """Adds `agrees` to (span, key, cited_key, cited_collection): the cited key is the match or of its family, or a family member is in the cited collection.

    `members` is (key, family_id, collection). Null where nothing was cited. A family is met by the key or the collection
    that is asked for, never as a whole.
    """
    df = findings.join(members.select("key", F.col("family_id").alias("_f"), F.col("collection").alias("_own")), "key", "left")
    named = members.where("family_id is not null")
    by_key = named.select(F.col("family_id").alias("_f"), F.col("key").alias("cited_key"), F.lit(True).alias("_same_family")).distinct()
    by_collection = named.select(F.col("family_id").alias("_f"), F.col("collection").alias("cited_collection"), F.lit(True).alias("_collection_in_family")).distinct()
    df = df.join(by_key, ["_f", "cited_key"], "left").join(by_collection, ["_f", "cited_collection"], "left")
    key, collection = F.col("cited_key"), F.col("cited_collection")
    sure = lambda c: F.coalesce(c, F.lit(False))
    agrees = F.when(key.isNotNull(), sure(key == F.col("key")) | sure(F.col("_same_family"))).when(collection.isNotNull(), sure(collection == F.col("_own")) | sure(F.col("_collection_in_family")))
    return df.withColumn("agrees", agrees).select(*findings.columns, "agrees")


def split_decided(spans: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(spans with a stored label and confidence, spans that a judge must still see). `decisions` is (doc_id, span, label, confidence)."""
    df = spans.join(decisions.select("doc_id", "span", "label", "confidence"), ["doc_id", "span"], "left")
    return df.where(F.col("label").isNotNull()), df.where(F.col("label").isNull()).drop("label", "confidence")


def accepted_picks(picks: DataFrame, offered: DataFrame, least: float = 0.6) -> DataFrame:
    """Picks (span, key, confidence) that were offered (span, key) and are confident enough, one for each span."""
    good = picks.where(F.col("confidence") >= least).join(offered.select("span", "key").distinct(), ["span", "key"], "left_semi")
    return first_of(good, ["span"], [F.desc("confidence"), "key"])


def merge_intervals(leading: DataFrame, following: DataFrame, keys: list[str], width: int) -> DataFrame:
    """`leading` and those of `following` (keys, a, b) that overlap none of it. Both sides are dealt into buckets of `width`, so the join is on equality."""
    def dealt(df: DataFrame) -> DataFrame:
        return df.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("a") / width), F.floor((F.col("b") - 1) / width))))

    l, f = dealt(leading).alias("l"), dealt(following).alias("f")
    meets = [F.col(f"l.{k}") == F.col(f"f.{k}") for k in [*keys, "_bucket"]] + [F.col("l.a") < F.col("f.b"), F.col("f.a") < F.col("l.b")]
    gone = f.join(l, meets, "left_semi").select(*keys, "a", "b").distinct()
    return leading.unionByName(following.join(gone, [*keys, "a", "b"], "left_anti"))


def attach_last(events: DataFrame, keys: list[str], order: list, marks: Column, value: Column, within: Column | None = None) -> DataFrame:
    """Adds `attached`: `value` of the last earlier row for which `marks` holds, null where `within` (over column `_seen`) fails. One window, no join."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = events.withColumn("_seen", F.last(F.when(marks, value), ignorenulls=True).over(w))
    return df.withColumn("attached", F.col("_seen") if within is None else F.when(within, F.col("_seen"))).drop("_seen")
