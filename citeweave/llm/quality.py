"""Quality rules by distribution divergence, in DataFrame functions only.

The documents that have a language say what is usual in it: its most common words, and the median shares of these words
and of the character classes. Every document is then compared with the references of its language.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeweave.llm.common import let, materialize, words

#: Common words that make a language's histogram.
N_COMMON = 20

#: Lower-case letters and white space go first, in one pass; the other classes are then taken off what is left.
PLAIN = r"[a-z\x20\x09-\x0D]+"
CHAR_CLASSES = {
    "wide": r"[^\x00-\x7F]+",
    "upper": "[A-Z]+",
    "digit": "[0-9]+",
    "point": "[.,;:!?'\"()-]+",
}
SYMBOLS = "[^#*$%&|<>]+"
WINDOW = 8


def _rows(docs: DataFrame, doc_id: str, text: str, lang: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(lang).alias("lang"))


def common_words(rows: DataFrame, n: int = N_COMMON) -> dict[str, list[str]]:
    """The `n` most frequent words of each language over all its documents, ties by the word: lower case, without full stops and commas behind, and with a letter."""
    df = rows.where(F.col("lang").isNotNull()).select("lang", F.explode(words(F.col("text"))).alias("w")).select("lang", F.lower(F.rtrim("w", F.lit(".,"))).alias("w"))
    counts = df.groupBy("lang", "w").agg(F.count("*").alias("n")).where(F.col("w").rlike(r"\p{L}"))
    ranked = counts.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "w"))).where(F.col("k") <= n)
    lists: dict[str, list[str]] = {}
    for r in sorted(ranked.select("lang", "k", "w").collect()):  # `n` rows for each language
        lists.setdefault(r["lang"], []).append(r["w"])
    return lists


def _counted(df: DataFrame, common: dict[str, list[str]]) -> DataFrame:
    """Row per document with its text, words, the size of each character class and its common words."""
    df = df.withColumns({"w": words(F.col("text")), "n_chars": F.length("text"), "left": F.regexp_replace("text", PLAIN, "")})
    df = df.withColumns({"word_chars": F.length(F.array_join("w", "")), "size_left": F.length("left"), "n_plain": F.col("n_chars") - F.length("left")})
    for name, pattern in CHAR_CLASSES.items():
        df = df.withColumn("left", F.regexp_replace("left", pattern, ""))
        df = df.withColumn(f"n_{name}", F.col("size_left") - F.length("left")).withColumn("size_left", F.length("left"))
    known = sorted({v + end for k in common.values() for w in k for v in (w, w.capitalize()) for end in ("", ".", ",")})
    # told from the rest by a look-up, and only then brought to one form
    hits = F.transform(F.filter("w", lambda w: w.isin(known)), lambda w: F.lower(F.rtrim(w, F.lit(".,"))))
    df = df.withColumn("common", hits if known else F.array().cast("array<string>"))
    among = lambda values: lambda w: w.isin(values)
    most = [F.struct(F.size(F.filter("common", among(v))).alias("n"), F.lit(k).alias("lang")) for k, v in common.items()]
    guess = F.array_max(F.array(*most))["lang"] if most else F.lit(None).cast("string")
    return df.withColumn("ref_lang", F.when(F.col("lang").isin(list(common)), F.col("lang")).otherwise(guess))


def _histograms(df: DataFrame, common: dict[str, list[str]]) -> DataFrame:
    """Adds `char_p` and `word_p`, each an array of shares that sums to 1 (or to 0 for an empty text)."""
    share = lambda n, total: F.when(total > 0, n / total).otherwise(F.lit(0.0))
    space = F.col("n_chars") - F.col("word_chars")
    sizes = [F.col("n_plain") - space, space, *(F.col(f"n_{k}") for k in CHAR_CLASSES), F.col("size_left")]
    lists = reduce(lambda e, kv: F.when(F.col("ref_lang") == kv[0], F.array(*map(F.lit, kv[1]))).otherwise(e), common.items(), F.lit(None).cast("array<string>"))
    counts = F.transform(lists, lambda x: share(F.size(F.filter("common", lambda w: w == x)), F.size("w")))
    with_rest = let(counts, lambda c: F.concat(c, F.array(F.lit(1.0) - F.aggregate(c, F.lit(0.0), lambda a, x: a + x))))
    return df.withColumns({"char_p": F.array(*(share(n, F.col("n_chars")) for n in sizes)), "word_p": with_rest})


def language_references(histograms: DataFrame, min_words: int) -> DataFrame:
    """One row per language: the median share of each class over all its documents of at least `min_words`.

    Medians, so that neither junk nor a few long documents move a reference.
    """
    n = len(CHAR_CLASSES) + 3, N_COMMON + 1
    medians = [F.percentile_approx(F.get(c, F.lit(i)), 0.5, 1000).alias(f"{c}{i}") for c, k in zip(("char_p", "word_p"), n) for i in range(k)]
    df = histograms.where(F.col("lang").isNotNull() & (F.col("n_words") >= min_words)).groupBy("lang").agg(*medians)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    unit = lambda c, k: let(F.array_compact(F.array(*(F.col(f"{c}{i}") for i in range(k)))), lambda a: let(total(a), lambda t: F.transform(a, lambda x: x / t)))
    return df.select(F.col("lang").alias("ref_lang"), unit("char_p", n[0]).alias("char_q"), unit("word_p", n[1]).alias("word_q"))


def jensen_shannon(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, the root of the divergence in bits, 0 to 1; null if either side is null."""
    term = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    parts = F.zip_with(p, q, lambda x, y: (term(x, (x + y) / 2) + term(y, (x + y) / 2)) / 2)
    return F.sqrt(F.abs(F.aggregate(parts, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))))  # a sum of rounded terms may be just below 0


def noise(bins: Column, n_words: Column) -> Column:
    """Distance from its own distribution that a sample of `n_words` in so many bins has on average: the smaller the sample, the larger."""
    return F.sqrt((bins - 1) / (8 * math.log(2) * n_words))


def repeated_words(word_list: Column) -> Column:
    """Number of words inside a window of 8 words that occurs twice or more in the same text.

    Windows are compared by the 64-bit hash of their words.
    """
    window = let(word_list, lambda a: F.transform(a, lambda w, i: F.xxhash64(w, *(F.get(a, i + k) for k in range(1, WINDOW)))))
    windows = F.slice(window, F.lit(1), F.greatest(F.size(word_list) - (WINDOW - 1), F.lit(0)))

    def covered(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = let(ordered, lambda o: F.filter(F.transform(o, lambda s, k: F.when((s["h"] == F.get(o, k - 1)["h"]) | (s["h"] == F.get(o, k + 1)["h"]), s["i"])), lambda i: i.isNotNull()))
        steps = let(F.array_sort(twice), lambda p: F.transform(p, lambda x, k: F.when(k == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), x - F.get(p, k - 1)))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))


def quality_rules(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
    max_char_distance: float = 0.2, max_word_distance: float = 0.12, min_words: int = 50,
) -> DataFrame:
    """Judges every whole text; one row per input row.

    Base counts: `n_words`, `word_chars`, `n_symbols`, `n_dup_lines`, `n_repeat_words`; `base_failed` below 20 words or
    with more than 30 % of the words in repeated windows. `char_distance` and `word_distance` are the Jensen-Shannon
    distances of the shares of character classes and common words from the reference of the document's language
    (`lang`, or the language whose common words occur most where it is null). `kept` asks both to be at most the limit
    above what a sample of the text's length shows by chance. A text with fewer than `min_words` words, or where no
    document has a language to learn from, is not judged by distance. Null and empty texts have no words and fail the
    base rules; very long texts are counted whole; repeated rows are judged each, equal counts share a rank by the word;
    an empty table gives an empty table; columns besides the three named are not read.
    """
    rows = _rows(docs, doc_id, text, lang)
    common = common_words(rows)
    df = _histograms(_counted(rows, common), common)
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("lines", lines).select(
        "doc_id", "lang", "ref_lang", "char_p", "word_p",
        F.size("w").cast("long").alias("n_words"),
        F.col("word_chars").cast("long"),
        F.length(F.regexp_replace("left", SYMBOLS, "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("w")).cast("long").alias("n_repeat_words"),
    )
    df = materialize(df)  # numbers only: the references need every document before the first verdict
    df = df.join(F.broadcast(language_references(df, min_words)), "ref_lang", "left")  # a row per language
    df = df.withColumns({
        "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
        "char_distance": jensen_shannon(F.col("char_p"), F.col("char_q")),
        "word_distance": jensen_shannon(F.col("word_p"), F.col("word_q")),
    })
    within = lambda c, q, limit: F.col(c) <= limit + noise(F.size(q), F.col("n_words"))
    usual = (F.col("n_words") < min_words) | (within("char_distance", "char_q", max_char_distance) & within("word_distance", "word_q", max_word_distance))
    df = df.withColumn("kept", ~F.col("base_failed") & F.coalesce(usual, F.lit(True)))
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ref_lang", "char_distance", "word_distance")
