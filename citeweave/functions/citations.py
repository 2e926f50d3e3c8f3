"""Citations said or written in texts, as a table: chapter and verses, or collection and number.

A text becomes an array of tokens. Every number, and every word that announces a report, is an anchor with the few words
around it; names are then looked up by joins with the caller's vocabulary, never in code:

- `names` is (name, kind, chapter, collection): spellings, kind being `chapter` or `collection`;
- `chapters` is (chapter, length): verses outside a chapter are no citation;
- `cues` has three lists of word keys: `scripture` (words that announce a chapter), `report` (words that announce a
  collection) and `filler` (words between a name and its number).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.functions.text import bound, spelling_key, word_key
from citeweave.operators.common import broadcast_if_small, top
from citeweave.plans.materialize import materialize

TOKENS = "array<struct<kind:string,key:string,a:int,b:int,before:string,after:string>>"
#: Words before an anchor that are looked at, and of them those that a name may have.
CONTEXT, NAME_WORDS = 6, 4
_TOKEN = re.compile(r"(?P<word>[^\W\d_][^\W\d_ؐ-ًؚ-ْٰ]*(?:[ؐ-ًؚ-ْٰ'’`ʿʾ-]+[^\W\d_]+)*[ً-ْٰ]*)|(?P<number>\d+)|(?P<mark>\n|[^\w\s]|_)")


def text_tokens(text: str | None) -> list[dict]:
    """Words, numbers and marks in order, each with its key, its place and the characters next to it (white space aside)."""
    text, out = text or "", []
    for m in _TOKEN.finditer(text):
        kind = m.lastgroup
        key = word_key(m[0]) if kind == "word" else "".join(str(unicodedata.decimal(c)) for c in m[0]) if kind == "number" else m[0]
        out.append({"kind": kind, "key": key, "a": m.start(), "b": m.end(), "before": text[max(0, m.start() - 3) : m.start()].rstrip()[-1:], "after": text[m.end() : m.end() + 3].lstrip()[:1]})
    return out


def tokens(text: Column) -> Column:
    @F.pandas_udf(TOKENS)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([text_tokens(x) for x in batch])

    return found(text)


def keys_of(names: DataFrame) -> DataFrame:
    """(kind, key, chapter, collection) of a table of names; one row for each key."""
    letters = F.pandas_udf(lambda s: s.map(word_key), "string")
    df = names.select("kind", letters("name").alias("letters"), "chapter", "collection")
    df = df.select("kind", name_key(F.col("letters"), F.col("kind")).alias("key"), "chapter", "collection").where("key <> ''")
    return df.groupBy("kind", "key").agg(F.min(F.struct("chapter", "collection")).alias("v")).select("kind", "key", "v.*")


def name_key(letters: Column, kind: Column) -> Column:
    """Latin chapter names meet by their sound, Arabic ones without the article; collections by their letters."""
    latin = letters.rlike("^[a-z]")
    return F.when(kind == "collection", letters).when(latin, spelling_key(letters)).otherwise(F.regexp_replace(letters, "^ال(?=..)", ""))


def _number(token: Column) -> Column:
    return F.when((token["kind"] == "number") & (F.length(token["key"]) <= 5), token["key"].cast("int"))


def _anchors(df: DataFrame, report: Column) -> DataFrame:
    """Row per number that starts a reference, and per word that announces a report, with the words around it."""
    at = lambda t, i: F.get(t, i)
    mark = lambda t, i, *marks: F.coalesce(at(t, i)["key"].isin(*marks), F.lit(False))
    number = lambda t, i: F.coalesce(at(t, i)["kind"] == "number", F.lit(False))
    words = lambda part: F.filter(part, lambda x: x["kind"] == "word")

    def anchor(t: Column, i: Column) -> Column:
        colon = i + F.when(mark(t, i + 1, "]"), 2).otherwise(1)  # `[2]: 183` is read like `2: 183`
        pair = number(t, i) & mark(t, colon, ":") & number(t, colon + 1)
        own = F.when(pair, colon + 1).otherwise(i)
        ranged = mark(t, own + 1, "-", "–") & number(t, own + 2)
        letter = F.when((at(t, own + 1)["kind"] == "word") & (at(t, own + 1)["a"] == at(t, own)["b"]) & (F.length(at(t, own + 1)["key"]) == 1), at(t, own + 1)["key"])
        low = F.greatest(i - 2 * CONTEXT, F.lit(0))
        left = F.slice(t, low + 1, i - low)
        # what an earlier number or line has stays with it
        stop = F.coalesce(F.array_max(F.transform(left, lambda x, k: F.when((x["kind"] == "number") | x["key"].isin("\n", "!", "?"), k))), F.lit(-1))
        near = words(F.slice(left, stop + 2, F.lit(2 * CONTEXT)))
        return F.struct(
            at(t, i)["kind"].alias("kind"), at(t, i)["a"].alias("at"), (at(t, i)["before"] == "(").alias("opened"),
            F.when(pair, _number(at(t, i))).alias("chapter"), _number(at(t, own)).alias("first"), F.coalesce(F.when(ranged, _number(at(t, own + 2))), _number(at(t, own))).alias("last"), letter.alias("letter"),
            F.when(ranged, at(t, own + 2)["b"]).when(letter.isNotNull(), at(t, own + 1)["b"]).otherwise(at(t, own)["b"]).alias("end"),
            F.slice(near, F.greatest(F.size(near) - (CONTEXT - 1), F.lit(1)), F.lit(CONTEXT)).alias("left"),
            words(F.slice(t, i + 2, F.lit(2 * CONTEXT))).alias("right"),
        )

    def places(t: Column) -> Column:
        # the verse of a pair and the end of a range belong to the number before
        follows = lambda i: (mark(t, i - 1, ":") & (number(t, i - 2) | (mark(t, i - 2, "]") & number(t, i - 3)))) | (mark(t, i - 1, "-", "–") & number(t, i - 2))
        starts = lambda x, i: F.when(((x["kind"] == "number") & ~follows(i)) | ((x["kind"] == "word") & F.array_contains(report, x["key"])), i)
        return F.transform(F.array_compact(F.transform(t, starts)), lambda i: anchor(t, i))

    return df.select("doc_id", "text", F.explode(bound(tokens(F.col("text")), places)).alias("x")).select("doc_id", F.col("x.*"), "text")


def _named(anchors: DataFrame, candidates: Column, names: DataFrame) -> DataFrame:
    """Adds the name that an anchor has, if any: kind, chapter or collection, and its first word and length."""
    df = anchors.withColumn("c", F.explode(candidates)).select("*", "c.*").drop("c")
    df = df.withColumn("as", F.explode(F.array(F.lit("chapter"), F.lit("collection")))).withColumn("key", name_key(F.col("letters"), F.col("as")))
    n = names.select(F.col("kind").alias("as"), "key", F.col("chapter").alias("by_chapter"), "collection")
    return df.join(broadcast_if_small(n), ["as", "key"], "left")


def _misspelt(df: DataFrame, names: DataFrame) -> DataFrame:
    """(letters, chapter) of Arabic names that are one letter off a single chapter's. Both sides are joined by their forms without one letter."""
    def forms(key: Column) -> Column:
        return F.concat(F.array(key), F.transform(F.sequence(F.lit(1), F.length(key)), lambda k: F.concat(F.substring(key, F.lit(1), k - 1), F.substring(key, k + 1, F.length(key)))))

    asked = df.select("letters", "key").distinct().where(F.length("key") >= 3)
    known = names.where((F.col("kind") == "chapter") & ~F.col("key").rlike("[a-z]") & (F.length("key") >= 4)).select(F.col("key").alias("known"), F.col("chapter").alias("near"))
    pairs = asked.withColumn("form", F.explode(forms(F.col("key")))).join(known.withColumn("form", F.explode(forms(F.col("known")))), "form").where(F.levenshtein("key", "known") <= 1)
    return pairs.groupBy("letters").agg(F.min("near").alias("near"), F.count_distinct("near").alias("n")).where("n = 1").drop("n")


def extract_citations(docs: DataFrame, names: DataFrame, chapters: DataFrame, cues: dict[str, list[str]], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, kind, chapter, first, last, collection, number, start, end, text) of every citation in a table of texts.

    A number is a citation of the longest name that ends before it, cues and marks aside: of a chapter if a scripture cue
    or an opening bracket goes before, else of a collection. `chapter:verse` needs a cue or a bracket alone. A report cue
    followed by a collection without a number is a citation of the collection.
    """
    keyed = keys_of(names)
    scripture, report, filler = (F.array(*map(F.lit, cues[c])).cast("array<string>") for c in ("scripture", "report", "filler"))
    is_cue = lambda x: F.array_contains(scripture, x["key"]) | F.array_contains(report, x["key"]) | F.array_contains(filler, x["key"])
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    base = F.coalesce(F.col("left")[0]["a"], F.col("at"))
    df = _anchors(rows.where(F.col("text").isNotNull()), report)
    df = df.withColumn("left", F.when(F.size("left") > 0, F.col("left"))).withColumn("base", F.least(base, F.col("at")))
    # only a piece of the text goes on with each anchor
    df = df.withColumn("piece", F.expr("substring(text, base + 1, greatest(end, at) + 200 - base)")).drop("text").withColumn("left", F.coalesce("left", F.array().cast(df.schema["right"].dataType)))
    df = materialize(df)  # texts are taken apart once
    cite = lambda start, end: F.expr(f"substring(piece, {start} - base + 1, {end} - {start})")
    void = lambda t: F.lit(None).cast(t)
    verse = ["doc_id", F.lit("chapter").alias("kind"), "chapter", "first", "last", void("string").alias("collection"), void("string").alias("number"), "start", "end", cite("start", "end").alias("text")]
    lengths = broadcast_if_small(chapters.select("chapter", "length"))
    within = F.col("first").between(1, F.col("length")) & F.col("last").between(F.col("first"), F.col("length"))

    # chapter:verse
    cue_at = F.array_max(F.transform(F.slice("left", F.greatest(F.size("left") - 3, F.lit(1)), F.lit(4)), lambda x: F.when(F.array_contains(scripture, x["key"]), x["a"])))
    pairs = df.where(F.col("chapter").isNotNull()).withColumn("start", F.coalesce(cue_at, F.when(F.col("opened"), F.col("at"))))
    pairs = pairs.where(F.col("start").isNotNull()).join(lengths, "chapter").where(within).select(*verse)

    # name and number
    def before(left: Column) -> Column:
        last = F.coalesce(F.array_max(F.transform(left, lambda x, k: F.when(~is_cue(x), k))), F.lit(-1))

        def of(k: int) -> Column:
            part = F.slice(left, F.greatest(last - (k - 2), F.lit(1)), F.lit(k))
            skip = F.array_max(F.transform(left, lambda x, i: F.when((i < last - (k - 1)) & ~is_cue(x), i)))
            lead = F.slice(left, F.coalesce(skip, F.lit(-1)) + 2, F.greatest(last - (k - 1) - F.coalesce(skip, F.lit(-1)) - 1, F.lit(0)))
            cue = F.array_min(F.transform(lead, lambda x: F.when(F.array_contains(scripture, x["key"]) | F.array_contains(report, x["key"]), x["a"])))
            name = F.struct(F.lit(k).alias("size"), F.array_join(F.transform(part, lambda x: x["key"]), "").alias("letters"), part[0]["a"].alias("name_at"), F.coalesce(cue, part[0]["a"]).alias("start"), part[0]["before"].isin("(", "[").alias("bracket"))
            return F.when(last >= k - 1, name)

        return F.array_compact(F.array(*map(of, range(1, NAME_WORDS + 1))))

    numbered = df.where((F.col("kind") == "number") & F.col("chapter").isNull() & F.col("first").isNotNull())
    found = _named(numbered, bound(F.col("left"), before), keyed)
    cued = F.exists("left", lambda x: F.array_contains(scripture, x["key"])) | F.col("bracket")
    found = found.where((F.col("as") == "collection") | cued)
    odd = _misspelt(found.where((F.col("as") == "chapter") & F.col("by_chapter").isNull() & F.col("letters").rlike("^[ء-ي]")), keyed)
    found = found.join(broadcast_if_small(odd), "letters", "left").withColumn("near", F.when(F.col("as") == "chapter", F.col("near")))
    found = found.where(F.col("by_chapter").isNotNull() | F.col("collection").isNotNull() | F.col("near").isNotNull())
    order = [F.desc(F.col("as") == "chapter"), F.col("by_chapter").isNull(), F.desc("size"), "key"]
    found = top(found, ["doc_id", "at"], order, 1, "_first").drop("_first")
    verses = found.where(F.col("as") == "chapter").withColumn("chapter", F.coalesce("by_chapter", "near")).join(lengths, "chapter").where(within).select(*verse)
    number = F.concat(F.col("first").cast("string"), F.coalesce("letter", F.lit("")))
    # the end of a range is not part of a collection's number
    reports = found.where(F.col("as") == "collection").select("doc_id", F.lit("collection").alias("kind"), void("int").alias("chapter"), void("int").alias("first"), void("int").alias("last"), "collection", number.alias("number"), "start", "end", cite("start", "end").alias("text"), "name_at")

    # report cue and name
    def behind(right: Column) -> Column:
        first = F.array_min(F.transform(right, lambda x, k: F.when(~is_cue(x), k)))

        def of(k: int) -> Column:
            part = F.slice(right, first + 1, F.lit(k))
            name = F.struct(F.lit(k).alias("size"), F.array_join(F.transform(part, lambda x: x["key"]), "").alias("letters"), part[0]["a"].alias("name_at"), part[k - 1]["b"].alias("stop"))
            return F.when((first <= 3) & (F.size(part) == k), name)

        return F.array_compact(F.array(*map(of, range(1, NAME_WORDS))))

    told = _named(df.where(F.col("kind") == "word"), bound(F.col("right"), behind), keyed).where((F.col("as") == "collection") & F.col("collection").isNotNull())
    told = top(told, ["doc_id", "name_at"], ["at", F.desc("size")], 1, "_first").join(reports.select("doc_id", "name_at"), ["doc_id", "name_at"], "left_anti")
    told = told.select("doc_id", F.lit("collection").alias("kind"), void("int").alias("chapter"), void("int").alias("first"), void("int").alias("last"), "collection", F.lit("").alias("number"), F.col("at").alias("start"), F.col("stop").alias("end"), cite("at", "stop").alias("text"))
    # two anchors never share a number or a name
    return pairs.unionByName(verses).unionByName(reports.drop("name_at")).unionByName(told)
