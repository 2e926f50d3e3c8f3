"""Parts of records as jobs over their tokens: chain and body of a report, and quoted speech of a marked edition in the shown one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeweave.functions.align import place
from citeweave.functions.text import bound, linkage_norm
from citeweave.operators.common import first_of
from citeweave.plans.materialize import materialize

# Words of transmission and of speech, in normal form, and how remarks of compilers begin.
CHAIN_WORDS = "حدثنا حدثني اخبرنا اخبرني انبانا عن سمعت وحدثنا وحدثني واخبرنا ح".split()
SPEECH_WORDS = "قال قالت يقول تقول ان انه انها انهم قالا يحدث".split()
COMPILER_REMARKS = {"tirmidhi": "قال ابو عيسي", "abudawud": "قال ابو داود"}
# Shares of a record before or behind which its parts may begin, and distances in words.
REMARK_AFTER, QUOTE_WITHIN, CHAIN_WITHIN, SPEECH_WITHIN, HEAD, HEAD_WITHIN = 0.3, 0.8, 0.75, 12, 4, 8
# Fixed value: share of a quotation that must be found.
SAID_SHARE = 0.6

#: Words that a quotation may begin earlier or later by, and end by, than where most of its words say.
NEAR = 8

QUOTES = ("\"", "«", "“")


def token_key(word: Column) -> Column:
    """A word's letters in the linkage norm, or its Latin letters and digits; empty if it has neither."""
    latin = F.regexp_replace(F.lower(word), "[^a-z0-9]", "")
    return F.when(word.rlike(r"[\u0600-\u06FF]"), bound(linkage_norm(word, composed=True), lambda arabic: F.when(arabic != "", arabic).otherwise(latin))).otherwise(latin)


def words_in(text: str) -> Column:
    return F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"\S+"), F.lit(0))


def tokens(df: DataFrame, text: str, keys: list[str], places: bool = False) -> DataFrame:
    """(keys, n, key): the words of a text that have a key, numbered from 0; with `places` also the characters from `a` to before `b` that they take.

    Numbers and places are found in the text's own row, so that its tokens need not be shuffled and sorted for them.
    """
    blank = lambda c: c.isin(*" \t\n\x0B\f\r")
    chars = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit("(?s)."), F.lit(0))
    begins = bound(chars, lambda cs: F.filter(F.transform(cs, lambda c, i: F.when(~blank(c) & ((i == 0) | blank(F.get(cs, i - 1))), i.cast("long"))), lambda i: i.isNotNull()))
    if places:
        found = bound(begins, lambda at: F.transform(words_in(text), lambda w, i: F.struct(token_key(w).alias("key"), F.get(at, i).alias("a"), (F.get(at, i) + F.length(w)).alias("b"))))
    else:
        found = F.transform(words_in(text), lambda w: F.struct(token_key(w).alias("key")))
    return df.select(*keys, F.posexplode(F.filter(found, lambda t: t["key"] != "")).alias("n", "t")).select(*keys, "n", "t.*")


def split_records(records: DataFrame, chain_words: list[str] = CHAIN_WORDS, speech_words: list[str] = SPEECH_WORDS, remarks: dict[str, str] = COMPILER_REMARKS) -> DataFrame:
    """(id, chain, body, notes, method) of reports (id, text, book, parallel), one row for each.

    A record's tokens stay in its row, as an array, and filters on it find where its parts begin, so nothing is shuffled
    or sorted and a task holds the tokens of one record at a time. A compiler's remark in the later part is cut off as
    `notes`. What is left begins its body where the head of the parallel text stands; else at the first opening quote,
    unless that is among the first three words or in the last part; else behind the first word of speech that follows the
    last one of transmission closely. A record without any of these is a body alone, as is one whose body would be empty;
    null and empty texts have an empty body.
    """
    none = F.array().cast("array<string>")
    head = F.aggregate(words_in("parallel"), none, lambda h, w: F.when(F.size(h) < HEAD, F.concat(h, F.array_remove(F.array(token_key(w)), ""))).otherwise(h))
    found = bound(F.transform(words_in("text"), lambda w, i: F.struct(i.alias("i"), w.alias("word"), token_key(w).alias("key"))), lambda t: bound(head, lambda h: _parts(t, h, chain_words, speech_words, remarks)))
    return records.select("id", found.alias("_p")).select("id", "_p.chain", "_p.body", "_p.notes", "_p.method")


def _parts(t: Column, head: Column, chain_words: list[str], speech_words: list[str], remarks: dict[str, str]) -> Column:
    """Struct of a record's parts, for its tokens (i, word, key) and the first keys of its parallel text."""
    places = lambda rows, here: F.transform(F.filter(rows, here), lambda x: x["i"])
    said = lambda rows: F.array_join(F.transform(rows, lambda x: x["word"]), " ")

    def remark(x: Column) -> Column:
        here = F.lit(False)
        for book, phrase in remarks.items():
            these = F.col("book") == book
            for k, word in enumerate(phrase.split()):
                these = these & (F.get(t, x["i"] + k)["key"] == word)
            here = here | F.coalesce(these, F.lit(False))
        return (x["i"] > REMARK_AFTER * F.size(t)) & here

    def opens(x: Column) -> Column:
        here = F.lit(False)
        for mark in QUOTES:
            here = here | x["word"].startswith(mark)
        return here

    def started(kept: Column) -> Column:
        upto = lambda x, share: x["i"] <= F.floor(share * F.size(kept))
        ahead = lambda x: F.array_remove(F.transform(F.slice(kept, x["i"] + 1, HEAD_WITHIN), lambda y: y["key"]), "")
        heads = lambda x: x["key"].isin("") | (x["key"] == F.get(head, F.lit(0)))  # noqa: E731 (most words are ruled out by this alone)
        aligned = F.when(F.size(head) > 0, F.array_min(places(kept, lambda x: heads(x) & (F.slice(ahead(x), F.lit(1), F.size(head)) == head))))
        quote = F.array_min(places(kept, lambda x: opens(x) & upto(x, QUOTE_WITHIN)))
        last = F.array_max(places(kept, lambda x: x["key"].isin(chain_words) & upto(x, CHAIN_WITHIN)))
        spoken = lambda x, after: x["key"].isin(speech_words) & (x["i"] > after) & (x["i"] < after + SPEECH_WITHIN)
        speech = bound(last, lambda after: F.array_min(places(kept, lambda x: spoken(x, after))) + 1)
        ways = F.array(*(
            F.struct(start.cast("int").alias("start"), F.lit(method).alias("method"))
            for start, method in [(aligned, "aligned_to_parallel"), (bound(quote, lambda q: F.when(q > 2, q)), "quote_mark"), (speech, "chain_then_speech")]
        ))
        way = F.get(F.filter(ways, lambda x: x["start"].isNotNull()), F.lit(0))
        return bound(way, lambda x: F.when(x["start"] < F.size(kept), x))

    def parts(kept: Column, x: Column) -> Column:
        start = F.coalesce(x["start"], F.lit(0))
        behind = said(F.slice(kept, start + 1, F.size(kept)))
        return F.struct(
            F.nullif(said(F.slice(kept, F.lit(1), start)), F.lit("")).alias("chain"),
            F.when(x["start"].isNull(), behind).otherwise(F.regexp_replace(behind, '^[ "«»“”]+|[ "«»“”]+$', "")).alias("body"),
            F.nullif(said(F.slice(t, F.size(kept) + 1, F.size(t))), F.lit("")).alias("notes"),
            F.coalesce(x["method"], F.lit("unsplit")).alias("method"),
        )

    cut = F.coalesce(F.array_min(places(t, remark)), F.size(t))
    return bound(F.slice(t, F.lit(1), cut), lambda kept: bound(started(kept), lambda x: parts(kept, x)))


def quoted_speech(editions: DataFrame) -> DataFrame:
    """(id, quote, a, b): the characters of the shown text that hold the quotations of the marked edition, for (id, shown, marked).

    The words of each straight quotation between [matn] and [/matn] are looked up in the shown text; where most of them
    would begin together, a window of it is aligned to them, and the range counts if `SAID_SHARE` of them are found
    there and it lies behind those of the quotations before. A shown text that has quotation marks of its own has none.
    """
    plain = F.regexp_replace(F.regexp_extract("marked", r"(?s)\[matn\](.*?)\[/matn\]", 1), r"\[/?[a-z]+(?:\s[^\]]*)?\]", "")
    asked = editions.where(~F.coalesce(F.col("shown").rlike("[«»“]"), F.lit(True)))
    quotes = asked.select("id", F.posexplode(F.regexp_extract_all(plain, F.lit('"[^"]*"'), F.lit(0))).alias("quote", "text"))
    wanted = materialize(tokens(quotes, "text", ["id", "quote"]))
    shown = materialize(tokens(asked, "shown", ["id"], places=True))
    began = F.floor((F.col("s.n") - F.col("q.n")) / NEAR).alias("start")
    starts = wanted.alias("q").join(shown.alias("s"), ["id", "key"]).groupBy("id", "quote", began).agg(F.count("*").alias("hits"))
    starts = first_of(starts, ["id", "quote"], [F.desc("hits"), "start"])
    words = wanted.groupBy("id", "quote").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "key"))), lambda x: x["key"]).alias("want"))
    texts = shown.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "key", "a", "b"))).alias("t"))
    low = F.greatest((F.col("start") - 1) * NEAR, F.lit(0))
    met = starts.join(words, ["id", "quote"]).join(texts, "id").withColumn("w", F.slice("t", (low + 1).cast("int"), (F.size("want") + 3 * NEAR).cast("int")))
    met = met.repartition("id", "quote").select("id", "quote", "w", place(F.col("want"), F.transform("w", lambda x: x["key"])).alias("x"))
    met = materialize(met.select("id", "quote", "w", "x.coverage", "x.first", "x.last"))  # a filter would align once more
    met = met.where((F.col("coverage") >= SAID_SHARE) & (F.col("first") >= 0)).select("id", "quote", F.get("w", F.col("first"))["a"].alias("a"), F.get("w", F.col("last"))["b"].alias("b"))
    before = F.max("b").over(Window.partitionBy("id").orderBy("quote").rowsBetween(Window.unboundedPreceding, -1))
    return met.withColumn("_b", before).where(F.col("_b").isNull() | (F.col("a") >= F.col("_b"))).drop("_b")
