"""Linking records of overlapping sources: gram candidates, copies, neighbours, enrichment and leftovers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeweave.functions.align import containment, similarity
from citeweave.operators.common import broadcast_if_small, first_of, top, when_of
from citeweave.operators.records import match_cascade
from citeweave.operators.similar import contained_pairs, needed, overlapping_pairs
from citeweave.plans.materialize import materialize


def scored(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Adds `containment` of the left in the right text and their `similarity`."""
    df = pairs.join(left.select(F.col("id").alias("left_id"), F.col("words").alias("_l")), "left_id").join(right.select(F.col("id").alias("right_id"), F.col("words").alias("_r")), "right_id")
    df = df.withColumns({"containment": containment(F.col("_l"), F.col("_r")), "similarity": similarity(F.col("_l"), F.col("_r"))})
    return df.drop("_l", "_r")


def text_links(left: DataFrame, right: DataFrame, share: float = 0.2, contained: float = 0.8, similar: float = 0.55) -> DataFrame:
    """Pairs that are contained or similar enough, of all in which either text (id, words) has at least `share` of the other's grams."""
    pairs = scored(overlapping_pairs(left, right, share).select("left_id", "right_id", "shared"), left, right)
    return pairs.where((F.col("containment") >= contained) | (F.col("similarity") >= similar))


def copy_links(copies: DataFrame, sources: DataFrame, ranks: DataFrame, least: float = 0.7, keep: int = 5, share: float = 0.2) -> DataFrame:
    """(copy, source, score, rank): up to `keep` sources of each copy by containment of the shorter text in the longer, then source rank (id, rank), then id.

    Every pair in which either text has at least `share` of the other's grams is looked at. The limit is asked of the
    containment itself; for the order it is rounded to two places.
    """
    words = lambda df, name, c: df.select(F.col("id").alias(name), F.col("words").alias(c))
    pairs = broadcast_if_small(materialize(overlapping_pairs(copies, sources, share)))  # comes to the texts
    df = words(copies, "left_id", "a").join(pairs, "left_id").join(words(sources, "right_id", "b"), "right_id")
    shorter = F.size("a") <= F.size("b")
    exact = containment(F.when(shorter, F.col("a")).otherwise(F.col("b")), F.when(shorter, F.col("b")).otherwise(F.col("a")))
    df = df.withColumn("exact", exact).where(F.col("exact") >= least).withColumn("score", F.round("exact", 2))
    df = df.join(ranks.select(F.col("id").alias("right_id"), F.col("rank").alias("source_rank")), "right_id", "left")
    return top(df.select(F.col("left_id").alias("copy"), F.col("right_id").alias("source"), "score", "source_rank"), ["copy"], [F.desc("score"), F.col("source_rank").asc_nulls_last(), "source"], keep)


def by_numbers(numbers: str, accept):
    """Edges of a cascade pass: a left record's `numbers` (array, preferred first) against the right ones' `number`.

    `accept` gives columns of both sides and the weight, below 1 and null for a pair that does not count; the weight of
    a pair is reckoned where the two meet, so no pair is shuffled that does not count, nor a record whose numbers the
    other side has not.
    """
    def edges(left: DataFrame, right: DataFrame) -> DataFrame:
        own, theirs, weight = accept
        there = broadcast_if_small(right.select("number").distinct())
        asked = broadcast_if_small(left.select(F.explode(numbers).alias("number")).distinct())
        wanted = left.select("*", F.posexplode(numbers).alias("place", "number")).join(there, "number", "left_semi").select(F.col("id").alias("left_id"), "place", "number", *own)
        found = right.join(asked, "number", "left_semi").select("number", F.col("id").alias("right_id"), *theirs)
        pairs = wanted.join(found, "number").select("left_id", "right_id", "place", weight.alias("weight"))
        best = pairs.where("weight is not null").groupBy("left_id", "right_id").agg(F.min("place").alias("place"), F.max("weight").alias("weight"))
        return best.select("left_id", "right_id", (F.col("weight") - F.col("place")).alias("weight"))

    return edges


def by_grams(part: str, share: float, least: float, whole: bool = False):
    """Edges of a cascade pass: pairs in which the right `words` have at least `share` of the grams of the left `part`, with the share of them that is there, or of both texts' grams with `whole`, as weight of at least `least`."""
    def edges(left: DataFrame, right: DataFrame) -> DataFrame:
        must = max(share, least / (2 - least) - 1e-9) if whole else max(share, least)  # the weight alone asks for so many of the left text's grams
        pairs = contained_pairs(left.select("id", F.col(part).alias("words")), right.select("id", "words"), must).where(F.col("shared") >= needed(F.col("left_size"), share))
        weight = 2 * F.col("shared") / (F.col("left_size") + F.col("right_size")) if whole else F.col("shared") / F.col("left_size")
        return pairs.withColumn("weight", weight).where(F.col("weight") >= least).select("left_id", "right_id", "weight")

    return edges


def by_overlap(part: str, least: float, or_part: str | None = None, or_least: float = 0.5):
    """For `by_numbers`: counts pairs whose left `part`, or else `or_part`, has enough of its words in the right text; half the better share is the weight."""
    hashed = lambda c, name: F.array_distinct(F.transform(c, lambda w: F.xxhash64(w))).alias(name)
    within = lambda c: F.coalesce(F.size(F.array_intersect(c, "_w")) / F.nullif(F.size(c), F.lit(0)), F.lit(0.0))
    x, y = within("_a"), within("_b")
    weight = F.when((x >= least) | (y >= or_least), F.greatest(x, y) / 2)
    return [hashed(part, "_a"), hashed(or_part or part, "_b")], [hashed("words", "_w")], weight


def five_passes(left: DataFrame, right: DataFrame, same: str | None = None) -> DataFrame:
    """Records of two editions paired one-to-one: number, suffixed number, body in the text, whole text, number with other evidence.

    `left` is (id, numbers, suffixes, chain, body, words), `right` (id, number, words); chains, bodies and texts are
    arrays of words. Nulls and empty parts meet nothing. With `same`, a column of both sides, rows of equal value are
    paired before all passes, in order of their ids, so that copies do not meet each other over and over.
    """
    agrees = by_overlap("words", 0.5, "body", 0.85)
    left = left.withColumn("_both", F.concat("numbers", "suffixes"))
    return match_cascade(left, right, [
        *([("same", same)] if same else []),
        ("number", by_numbers("numbers", agrees)),
        ("suffix", by_numbers("suffixes", agrees)),
        ("body", by_grams("body", 0.8, 0.8)),
        ("text", by_grams("words", 0.2, 0.55, whole=True)),
        ("evidence", by_numbers("_both", by_overlap("chain", 0.7, "body", 0.5))),
    ])


def enriched(guests: DataFrame, hosts: DataFrame, claimed: DataFrame, near: int = 3, letters: str = "abcde", grams: int = 8, share: float = 0.1, least: float = 0.6) -> DataFrame:
    """The host of each guest of a third source (guest, host, score), both (id, collection, number, words).

    Candidates are the hosts of the very number, of numbers up to `near` away plain or with a letter, of introductions as
    near; guests that have none among these take the `grams` hosts of the collection with the most shared grams. The
    share of the guest's words that a host has, in order, decides; hosts that nobody claimed go before others.
    """
    base = F.regexp_extract("number", r"^i?(\d+)", 1).cast("int")
    at = F.transform(F.sequence(F.lit(-near), F.lit(near)), lambda d: d + base)
    plain = F.flatten(F.transform(at, lambda n: F.concat(F.array(n.cast("string")), F.array(*(F.concat(n.cast("string"), F.lit(x)) for x in letters)))))
    intro = F.transform(at, lambda n: F.concat(F.lit("i"), F.lpad(n.cast("string"), 3, "0")))
    wanted = F.array_distinct(F.concat(F.array("number"), F.when(F.col("number").startswith("i"), intro).otherwise(plain)))
    g = guests.where(base.isNotNull()).select(F.col("id").alias("guest"), "collection", F.explode(wanted).alias("number"))
    by_number = g.join(hosts.select(F.col("id").alias("host"), "collection", "number"), ["collection", "number"]).select("guest", "host")
    words = lambda df, name, c: df.select(F.col("id").alias(name), F.col("words").alias(c), F.col("collection").alias(f"{c}_in"))

    def good(pairs: DataFrame) -> DataFrame:
        df = pairs.join(words(guests, "guest", "_g"), "guest").join(words(hosts, "host", "_h"), "host")
        return df.withColumn("score", containment(F.col("_g"), F.col("_h"))).where(F.col("score") >= least).select("guest", "host", "score")

    near_ones = materialize(good(by_number))
    rest = guests.join(near_ones.select(F.col("guest").alias("id")), "id", "left_anti")
    met = contained_pairs(rest.select(F.struct(F.lit(0).alias("side"), "id").alias("id"), "words"), hosts.select(F.struct(F.lit(1).alias("side"), "id").alias("id"), "words"), share)
    met = met.select(F.col("left_id.id").alias("guest"), F.col("right_id.id").alias("host"), "shared").join(words(guests, "guest", "_g"), "guest").join(words(hosts, "host", "_h"), "host").where(F.col("_g_in").eqNullSafe(F.col("_h_in")))
    found = near_ones.unionByName(good(top(met.select("guest", "host", "shared"), ["guest"], [F.desc("shared"), "host"], grams).select("guest", "host")))
    return unclaimed_first(found, claimed, least)


def inherited_grades(links: DataFrame, grades: DataFrame, best: int = 3) -> DataFrame:
    """Grades (unit, …) of the best sources, given to their copies with `via`, the source."""
    return links.where(F.col("rank") <= best).join(grades, links["source"] == grades["unit"]).drop("unit").withColumnsRenamed({"copy": "unit", "source": "via"}).drop("score", "source_rank", "rank")


def borrowed_grades(members: DataFrame, grades: DataFrame) -> DataFrame:
    """Grades of the first core member of a family for its members without any. `members` is (unit, family_id, core, ord)."""
    graded = members.join(grades.select("unit").distinct(), "unit", "left_semi")
    lender = first_of(graded.where("core and family_id is not null").select("family_id", F.col("unit").alias("via"), "ord"), ["family_id"], ["ord", "via"]).drop("ord")
    bare = members.where("family_id is not null").join(grades.select("unit").distinct(), "unit", "left_anti").select("unit", "family_id")
    return bare.join(lender, "family_id").drop("family_id").join(grades.withColumnRenamed("unit", "via"), "via")


def near_numbers(left: DataFrame, right: DataFrame, before: int = 4, after: int = 2, least: float = 0.6, group: str | None = None) -> DataFrame:
    """The best right record for each leftover whose number is near, in the same `group` if one is named: (id, number, words) on both sides, the range as an equality join."""
    keys = [group] if group else []
    wide = left.withColumn("_n", F.explode(F.sequence(F.col("number") - before, F.col("number") + after)))
    pairs = wide.join(right.select(F.col("number").alias("_n"), F.col("id").alias("right_id"), *keys), ["_n", *keys]).select(F.col("id").alias("left_id"), "right_id").where("left_id != right_id").distinct()
    good = scored(pairs, left, right).where(F.col("containment") >= least)
    return first_of(good, ["left_id"], [F.desc("containment"), "right_id"])


def preferred_suffix(left: DataFrame, right: DataFrame, candidates: Column) -> DataFrame:
    """(left_id, right_id, position): the first of a record's candidate numbers, in order, that a right record has."""
    c = left.select(F.col("id").alias("left_id"), F.posexplode(candidates).alias("position", "number"))
    return first_of(c.join(right.select("number", F.col("id").alias("right_id")), "number"), ["left_id"], ["position", "right_id"]).select("left_id", "right_id", "position")


def unclaimed_first(candidates: DataFrame, claimed: DataFrame, least: float = 0.6) -> DataFrame:
    """The best candidate (guest, host, score) of each guest, hosts that nobody claimed before others of the same score."""
    df = candidates.where(F.col("score") >= least).join(claimed.select("host").distinct().withColumn("_c", F.lit(1)), "host", "left")
    return first_of(df, ["guest"], [F.desc("score"), F.col("_c").asc_nulls_first(), "host"]).drop("_c")


def split_claims(claims: DataFrame) -> DataFrame:
    """Adds `key`: the first claimant of a host takes its key, further ones `host.s2`, `host.s3`, … linked by `parallel_of`."""
    n = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("score"), "guest"))
    df = claims.withColumn("_n", n)
    return df.withColumns({"key": F.when(F.col("_n") == 1, F.col("host")).otherwise(F.concat("host", F.lit(".s"), F.col("_n"))), "parallel_of": F.when(F.col("_n") > 1, F.col("host"))}).drop("_n")


def renamed_collisions(records: DataFrame, key: str, order: str) -> DataFrame:
    """A key that is taken gets `~order` behind it; the first record by order keeps it."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return records.withColumn("_n", n).withColumn(key, F.when(F.col("_n") == 1, F.col(key)).otherwise(F.concat(key, F.lit("~"), F.col(order).cast("string")))).drop("_n")


def merged(left: DataFrame, right: DataFrame, fill: list[str], key: str = "key") -> DataFrame:
    """Left records with empty columns filled from their pairs; of several right rows of a key the least by `fill`, nulls last."""
    one = first_of(right.select(key, *fill), [key], [F.col(c).asc_nulls_last() for c in fill])
    r = one.select(F.col(key), *(F.col(c).alias(f"_{c}") for c in fill))
    df = left.join(r, key, "left")
    empty = lambda c: F.col(c).isNull() | (F.col(c).cast("string") == "")
    return df.withColumns({c: F.when(empty(c), F.col(f"_{c}")).otherwise(F.col(c)) for c in fill}).drop(*(f"_{c}" for c in fill))


def appended_grades(grades: DataFrame, pairs: DataFrame, others: DataFrame, source: str) -> DataFrame:
    """Grades (unit, grader, grade, source) and those of the paired records (`pairs`: unit, other; `others`: unit, grader, grade), which come from `source`."""
    theirs = pairs.join(others.withColumnRenamed("unit", "other"), "other").select("unit", "grader", "grade", F.lit(source).alias("source"))
    return grades.select("unit", "grader", "grade", "source").unionByName(theirs).distinct()


def grader_agreement(grades: DataFrame, others: DataFrame, pairs: DataFrame) -> DataFrame:
    """(grader, pairs, agreeing, percent): where a grader classed both records of a pair (unit, other), how often in the same class.

    Both tables are (unit, grader, class); a grader's several classes of a unit are compared each with each.
    """
    mine = grades.select("unit", "grader", F.col("class").alias("_a")).distinct()
    theirs = others.select(F.col("unit").alias("other"), "grader", F.col("class").alias("_b")).distinct()
    both = pairs.select("unit", "other").join(mine, "unit").join(theirs, ["other", "grader"])
    found = both.groupBy("grader").agg(F.count("*").alias("pairs"), F.count_if(F.col("_a").eqNullSafe(F.col("_b"))).alias("agreeing"))
    return found.withColumn("percent", F.round(100 * F.col("agreeing") / F.col("pairs"), 1))


def named_people(mentions: DataFrame, names: DataFrame) -> DataFrame:
    """Adds `name` to mentions (…, id) from (id, name); a missing or empty name is null."""
    known = names.where(F.col("name").isNotNull() & (F.trim("name") != "")).select("id", "name")
    return mentions.join(broadcast_if_small(known), "id", "left")


def merged_notes(notes: DataFrame, more: DataFrame, normal: Column, first: int = 80) -> DataFrame:
    """Union of (unit, lang, ord, text) without later notes whose language and first normal characters an earlier one has."""
    both = notes.withColumn("_s", F.lit(0)).unionByName(more.withColumn("_s", F.lit(1))).withColumn("_k", F.substring(normal, 1, first))
    return first_of(both, ["unit", "lang", "_k"], ["_s", "ord"]).drop("_k", "_s")


def presence(probes: DataFrame, grams: DataFrame) -> DataFrame:
    """(id, present): `none`, `some` or `all` of a record's probes (id, gram) are in the other source's grams (gram).

    Grams that nobody asks for are dropped before any is shuffled, as long as the probes are few.
    """
    asked = broadcast_if_small(probes.select("gram").distinct())
    known = grams.select("gram").join(asked, "gram", "left_semi").distinct().withColumn("_hit", F.lit(1))
    df = probes.join(known, "gram", "left").groupBy("id").agg(F.count("*").alias("n"), F.count("_hit").alias("hits"))
    return df.select("id", F.when(F.col("hits") == 0, "none").when(F.col("hits") == F.col("n"), "all").otherwise("some").alias("present"))


def leftover_reason(number: Column, same_as: Column, statement: Column, present: Column) -> Column:
    return when_of([(number.startswith("i"), "introduction"), (same_as.isNotNull(), "same_as_previous"), (statement, "editor_statement"), (present == "none", "absent"), (present == "some", "partly_present")], "present")


def flags(ladder: dict[str, Column]) -> Column:
    """Array of the names whose condition holds."""
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in ladder.items())))


def pointer_first(matches: Column, pointer: Column) -> Column:
    """`matches` (array of struct with `key`) with the pointer's target moved to the front."""
    return F.concat(F.filter(matches, lambda m: m["key"] == pointer), F.filter(matches, lambda m: ~m["key"].eqNullSafe(pointer)))


def comparison(left: DataFrame, right: DataFrame, pointers: DataFrame) -> DataFrame:
    """Left records (collection, number, value) with the right value of their number, by way of a pointer (collection, number, target) where there is one."""
    p = pointers.select("collection", "number", "target")
    df = left.join(p, ["collection", "number"], "left").withColumn("_k", F.coalesce("target", F.concat_ws(":", "collection", "number")))
    r = right.select(F.concat_ws(":", "collection", "number").alias("_k"), F.col("value").alias("other"))
    df = df.join(r, "_k", "left").drop("_k")
    return df.withColumn("state", F.when(F.col("other").isNull(), "unmatched").when(F.col("other") == F.col("value"), "agrees").otherwise("differs"))
