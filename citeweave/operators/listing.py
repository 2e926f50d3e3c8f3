"""Lookups, listings and checks of given results: keys, presentation, reports, terms, quizzes and passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeweave.functions.text import alias_key, clip, latin_tokens
from citeweave.operators.common import broadcast_if_small, first_of, top, when_of
from citeweave.operators.verify import verify_words


def by_keys(units: DataFrame, keys: DataFrame, key: str = "key", columns: list[str] | None = None) -> DataFrame:
    """Units of the distinct keys asked for, with the columns asked for."""
    df = units.select(key, *columns) if columns else units
    return df.join(broadcast_if_small(keys.select(key).distinct()), key, "left_semi")


def ranged(refs: DataFrame, rows: DataFrame, first: str, last: str, number: str) -> DataFrame:
    """Rows whose `number` is from `first` to `last` of a reference: the range as an equality join."""
    return refs.withColumn(number, F.explode(F.sequence(first, last))).drop(first, last).join(rows, number)


def collection_counts(units: DataFrame, collection: str, groups: dict[str, str], default: str) -> DataFrame:
    """(collection, n, grp): units of each collection and the group that it is shown in."""
    return units.groupBy(collection).agg(F.count("*").alias("n")).withColumn("grp", when_of([(F.col(collection) == c, g) for c, g in groups.items()], default))


def chapter_list(units: DataFrame, collection: str, chapter: str, order: str) -> DataFrame:
    """(collection, chapter, n, first, place): units of each chapter, where it begins, and its place by that among those of its collection."""
    df = units.groupBy(collection, chapter).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return df.withColumn("place", F.row_number().over(Window.partitionBy(collection).orderBy("first")).cast("long"))  # chapters, not units


def totals(units: DataFrame, counted: dict[str, Column], distinct: dict[str, str], added: dict[str, str]) -> DataFrame:
    """One row: rows for which each condition holds, distinct values and sums of columns, by their names."""
    return units.agg(*(F.count_if(c).alias(k) for k, c in counted.items()), *(F.count_distinct(c).alias(k) for k, c in distinct.items()), *(F.sum(c).alias(k) for k, c in added.items()))


def mention_counts(mentions: DataFrame) -> DataFrame:
    """(id, name, n): how often each narrator of (id, name, ord) is mentioned, by the first name given; a null name is none."""
    first = F.min_by("name", F.when(F.col("name").isNotNull(), F.struct("ord", "name")))
    return mentions.where(F.col("id").isNotNull()).groupBy("id").agg(first.alias("name"), F.count("*").alias("n"))


def resolve_keys(asked: DataFrame, units: DataFrame, aliases: DataFrame, pointers: DataFrame) -> DataFrame:
    """(ask, key, resolved_by) of free-form asks: `c:v` of the scripture, `prefix:c:v`, a key, `name number`, or a pointer's key.

    `units` is (key, collection, number), `aliases` (alias, collection), `pointers` (key, source_key).
    """
    a = asked.select(F.col("ask"), F.trim(F.lower("ask")).alias("_t"))
    pair = F.regexp_extract("_t", r"^(?:quran:)?(\d{1,3}):(\d{1,3})$", 0)
    a = a.withColumn("_verse", F.when(pair != "", F.concat(F.lit("quran:"), F.regexp_replace(pair, "^quran:", ""))))
    a = a.withColumn("_name", alias_key(F.regexp_extract("_t", r"^(.*?)[\s:#]*\d+[a-z]?$", 1))).withColumn("_number", F.regexp_extract("_t", r"(\d+[a-z]?)$", 1))
    keys = units.select(F.col("key").alias("_k"))
    a = a.join(aliases.select(F.col("alias").alias("_name"), "collection"), "_name", "left").withColumn("_by_name", F.concat_ws(":", "collection", "_number"))
    one = lambda n, k, by: F.struct(F.lit(n).alias("n"), k.alias("k"), F.lit(by).alias("by"))
    tries = F.array(one(1, F.col("_verse"), "verse"), one(2, F.col("_t"), "key"), one(3, F.when(F.col("collection").isNotNull(), F.col("_by_name")), "name"))
    t = a.select("ask", F.explode(tries).alias("x")).select("ask", "x.n", F.col("x.k").alias("_k"), "x.by").where("_k is not null")
    direct = t.join(keys, "_k").select("ask", "n", F.col("_k").alias("key"), "by")
    pointed = t.join(pointers.select(F.col("key").alias("_k"), "source_key"), "_k").select("ask", (F.col("n") + 10).alias("n"), F.col("source_key").alias("key"), F.lit("pointer").alias("by"))
    best = first_of(direct.unionByName(pointed), ["ask"], ["n", "key"])
    return asked.select("ask").join(best.select("ask", "key", F.col("by").alias("resolved_by")), "ask", "left")


def presented(units: DataFrame, names: DataFrame, lang: str) -> DataFrame:
    """(key, reference, title, texts, url): units as shown, the collection's name in the language asked for."""
    n = names.select("collection", F.coalesce(F.col(f"name_{lang}"), F.col("name_en")).alias("_name"))
    df = units.join(broadcast_if_small(n), "collection", "left")
    return df.select(
        "key", F.concat_ws(" ", F.coalesce("_name", "collection"), "number").alias("reference"), F.coalesce("title_en", "chapter_en").alias("title"),
        F.struct(F.col("ar_matn").alias("ar"), F.col("en_text").alias("en"), F.col("id_text").alias("id")).alias("texts"), F.coalesce("url", "sunnah_url").alias("url"),
    )


def chapter_ranges(chapters: DataFrame) -> DataFrame:
    """Adds `first_id` and `last_id`, the contiguous ids of each chapter of (chapter, length), by a running sum."""
    w = Window.partitionBy(F.lit(0)).orderBy("chapter")  # a table of chapters, not of verses
    last = F.sum("length").over(w)
    return chapters.withColumns({"first_id": last - F.col("length") + 1, "last_id": last})


def rows_in_chapter(rows: DataFrame, ranges: DataFrame, chapter: int) -> DataFrame:
    r = F.broadcast(ranges.where(F.col("chapter") == chapter).select("first_id", "last_id"))  # one row
    return rows.join(r, F.col("id").between(F.col("first_id"), F.col("last_id"))).drop("first_id", "last_id")


def attention(findings: DataFrame) -> DataFrame:
    """Findings a reader should look at: not found, weak or disputed, misquoted, or with a citation that disagrees."""
    return findings.where(F.col("status").isin("not_found", "weak_or_disputed", "misquote") | ~F.coalesce("agrees", F.lit(True)))


def review_queue(findings: DataFrame) -> DataFrame:
    return findings.where(F.col("status").isin("not_found", "weak_or_disputed", "misquote"))


def tone(status: Column) -> Column:
    return when_of([(status.isin("verbatim", "sahih", "hasan", "hasan_sahih", "sahihayn", "accepted", "hasan_or_sahih"), "good"), (status.isin("daif", "mawdu", "disputed", "misquote", "not_found", "weak_or_disputed"), "warn")], "none")


def valid_terms(terms: DataFrame, docs: DataFrame, blocked: list[str] = [], most: int = 40) -> DataFrame:  # noqa: B006
    """Model-given terms (doc_id, ord, form, gloss) that stand in their text: 2 to 40 characters, one for each spelling, `most` for a text."""
    df = terms.withColumn("form", F.trim("form")).join(docs.select("doc_id", F.lower("text").alias("_t")), "doc_id")
    df = df.where(F.length("form").between(2, 40) & (F.instr("_t", F.lower("form")) > 0) & ~F.lower("form").isin(blocked)).withColumn("_l", F.lower("form"))
    df = first_of(df, ["doc_id", "_l"], ["ord"])
    return top(df, ["doc_id"], ["ord"], most).drop("_t", "_l", "rank")


def valid_quiz(items: DataFrame, segments: DataFrame) -> DataFrame:
    """Quiz items (doc_id, question, options, answer, paragraph) with four options, an answer among them and a paragraph of the text."""
    n = segments.groupBy("doc_id").agg(F.max("seg").alias("_last"))
    return items.join(n, "doc_id").where((F.size("options") == 4) & F.col("answer").between(0, 3) & F.col("paragraph").between(0, F.col("_last"))).drop("_last")


def source_quiz(findings: DataFrame, most: int = 4) -> DataFrame:
    """Questions `which source is this from` for up to `most` matched findings (doc_id, span, key, reference) of a document that has three sources or more.

    The wrong options are the next sources of the document in order, and the right one's place follows from the question's number.
    """
    sources = first_of(findings.where("key is not null"), ["doc_id", "reference"], ["span", "key"])
    w = Window.partitionBy("doc_id")
    df = sources.withColumns({"n": F.row_number().over(w.orderBy("span", "reference")) - 1, "total": F.count("*").over(w)})
    df = df.withColumn("all", F.collect_list("reference").over(w.orderBy("span", "reference").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).where("total >= 3 and n < {}".format(most))
    wrong = F.transform(F.sequence(F.lit(1), F.least(F.lit(3), F.col("total") - 1)), lambda k: F.get("all", ((F.col("n") + k) % F.col("total")).cast("int")))
    slot = (F.col("n") % (F.size(wrong) + 1)).cast("int")
    options = F.concat(F.slice(wrong, F.lit(1), slot), F.array("reference"), F.slice(wrong, slot + 1, F.size(wrong)))
    return df.select("doc_id", "span", "key", options.alias("options"), slot.alias("answer"))


def due_cards(reviews: DataFrame, now: Column) -> DataFrame:
    """The last review of each card (key, ts, box, due): those due, and whether they count as learned."""
    last = first_of(reviews, ["key"], [F.desc("ts")])
    return last.where(F.col("due") <= now).withColumn("learned", F.col("box") >= 3)


def matching_passages(questions: DataFrame, segments: DataFrame, k: int = 5) -> DataFrame:
    """(query, doc_id, seg, shared, rank): the segments with the most distinct words of a question (query, text)."""
    q = questions.select("query", F.explode(latin_tokens(F.col("text"))).alias("w"))
    s = segments.select("doc_id", "seg", F.explode(latin_tokens(F.col("text"))).alias("w"))
    return top(s.join(broadcast_if_small(q), "w").groupBy("query", "doc_id", "seg").agg(F.count("*").alias("shared")), ["query"], [F.desc("shared"), "doc_id", "seg"], k)


def family_listing(units: DataFrame, limit: int = 12, shown: int = 240) -> DataFrame:
    """(key, other, text, rank): up to `limit` other members of each unit's family by `ord`, the opening of their text."""
    u = units.where("family_id is not null")
    other = u.select("family_id", F.col("key").alias("other"), F.col("ord").alias("_o"), clip(F.col("text"), shown).alias("text"))
    few = top(other, ["family_id"], ["_o", "other"], limit + 1, "_n")
    pairs = u.select("key", "family_id").join(few, "family_id").where("key != other")
    return top(pairs, ["key"], ["_n"], limit).drop("_n", "_o", "family_id")


def messages(box: DataFrame, now: Column, kind: str | None = None, kinds: tuple[str, ...] = ("dispute", "suggest", "feedback"), days: int = 180) -> DataFrame:
    """Messages (id, kind, ts, …) younger than `days`, unknown kinds as feedback, newest first."""
    df = box.withColumn("kind", F.when(F.col("kind").isin(*kinds), F.col("kind")).otherwise(F.lit("feedback"))).where(F.col("ts") > now - F.expr(f"interval {days} days"))
    return (df.where(F.col("kind") == kind) if kind else df).orderBy(F.desc("ts"), "id")


def leak_runs(answers: DataFrame, least: int = 5, most: int = 12, word: str = "[ء-ي]+", between: str = r"[\s،.؛:]+") -> DataFrame:
    """(id, n, run): the first runs of `least` target-script words and more outside tags in generated answers (id, text), to be checked against sources."""
    bare = F.regexp_replace("text", r"(?s)<([a-z]+)\b[^>]*>.*?</\1>|<[^>]*>", " | ")
    runs = F.regexp_extract_all(bare, F.lit(rf"(?:{word}{between}){{{least - 1},}}{word}"), F.lit(0))
    return answers.select("id", F.posexplode(F.slice(runs, 1, most)).alias("n", "run"))


def leaks(answers: DataFrame, sources: DataFrame, words: Column, least: float = 0.75, **runs) -> DataFrame:
    """(id, n, run, source, similarity): runs of generated answers that are a source's words, each with the source that it is most like, of at least `least`.

    `sources` is (key, text); `words` are the words of a column `text`, for runs and sources alike. A run is aligned to the
    sources that share a gram with it.
    """
    found = leak_runs(answers, **runs)
    as_text = found.select(F.struct("id", "n").alias("item_id"), F.col("run").alias("text"))
    met = verify_words(as_text.select("item_id", words.alias("words")), sources.select(F.col("key").alias("doc_id"), words.alias("words")))
    best = first_of(met.where(F.col("similarity") >= least), ["item_id"], [F.desc("similarity"), "doc_id"])
    best = best.select(F.col("item_id.id").alias("id"), F.col("item_id.n").alias("n"), F.col("doc_id").alias("source"), "similarity")
    return found.join(best, ["id", "n"])
