"""Record linkage, gradings, families and listings over keyed records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeweave.functions.text import ascii_folded
from citeweave.operators.common import broadcast_if_small, first_of, null_safe_join, numbered, when_of
from citeweave.operators.graph import by_shuffle, connected_components
from citeweave.plans.materialize import materialize

# Grade classes by rank, and which of them accept or reject.
GRADE_RANK = {"sahih": 5, "hasan_sahih": 4, "hasan": 3, "accepted": 3, "daif": 1, "mawdu": 0}
ACCEPTED, REJECTED = ("sahih", "hasan_sahih", "hasan", "accepted"), ("daif", "mawdu")
# Wordings of grades, the first class that fits counts.
GRADE_WORDS = [
    (None, ["no grade"], ["لا نعرف حكم"]),
    ("same_as_before", ["same as before"], ["مكرر"]),
    ("silent", ["silent"], ["سكت عنه"]),
    ("mawdu", ["fabricat", "mawdu", "maudu", "forged", "invalid"], ["موضوع", "باطل"]),
    ("daif", ["da'if", "daif", "da`if", "weak", "munkar", "shadh", "anomal", "rejected", "repudiat", "not accepted"], ["ضعيف", "منكر", "شاذ", "ليس بصحيح"]),
    ("sahih", ["corroborated"], ["متواتر"]),
]
SOUND, GOOD = (["sahih", "sound", "agreed", "authentic"], ["صحيح", "متفق"]), (["hasan", "good"], ["حسن"])
FAIR = (["strong", "fair", "accepted"], ["قوي", "جيد", "مقبول", "محتج به", "محتجّ به"])


def _has(text: Column, values: list[str]) -> Column:
    e = F.lit(False)
    for v in values:
        e = e | F.contains(text, F.lit(v))
    return e


# Spellings of graders' names, the first one that a name holds counts.
GRADER_ALIASES = [
    ("albani", "al-Albani"), ("الألباني", "al-Albani"), ("zai", "Zubair Ali Zai"), ("zubair", "Zubair Ali Zai"), ("zubayr", "Zubair Ali Zai"), ("علی زئی", "Zubair Ali Zai"),
    ("baqi", "Muhammad Fuad Abd al-Baqi"), ("عبد الباقي", "Muhammad Fuad Abd al-Baqi"), ("shakir", "Ahmad Muhammad Shakir"), ("ghuddah", "Abu Ghuddah"), ("hilali", "Salim al-Hilali"),
    ("arna", "Shuayb al-Arnaut"), ("muhyi", "Muhammad Muhyi al-Din Abd al-Hamid"), ("dhahabi", "al-Dhahabi"), ("darussalam", "Darussalam"), ("bukhari", "al-Bukhari"), ("tirmidhi", "al-Tirmidhi"), ("muslim", "Muslim"),
]


def canonical_graders(rows: DataFrame, name: str, aliases: DataFrame | None = None) -> DataFrame:
    """Adds `grader`, the one name of a grader: of the first alias (ord, pattern, grader) that stands in the name or in its ASCII lower case, else the name trimmed; null for none.

    Distinct names meet the patterns, which are a short table (`GRADER_ALIASES` by default); rows meet their name.
    """
    if aliases is None:
        aliases = rows.sparkSession.createDataFrame([(k, p, g) for k, (p, g) in enumerate(GRADER_ALIASES)], "ord int, pattern string, grader string")
    names = rows.select(F.col(name).alias("_name")).where("_name is not null and _name != ''").distinct().withColumn("_folded", ascii_folded(F.col("_name")))
    holds = F.contains("_folded", F.col("pattern")) | F.contains("_name", F.col("pattern"))
    known = names.join(broadcast_if_small(aliases.select("ord", "pattern", F.col("grader").alias("_grader"))), holds, "left")
    known = known.groupBy("_name").agg(F.coalesce(F.min_by("_grader", "ord"), F.trim("_name")).alias("grader"))
    return rows.join(known, F.col(name) == F.col("_name"), "left").drop("_name")


def grade_class(grade: Column, folded: Column) -> Column:
    """Coarse class of a grade's wording. `folded` is the wording in ASCII lower case, for the Latin words."""
    either = lambda pair: _has(folded, pair[0]) | _has(grade, pair[1])
    ladder = [(grade.isNull() | (grade == ""), F.lit(None).cast("string"))]
    ladder += [(either((a, b)), F.lit(c).cast("string")) for c, a, b in GRADE_WORDS]
    ladder += [(either(SOUND) & either(GOOD), "hasan_sahih"), (either(SOUND), "sahih"), (either(GOOD), "hasan"), (either(FAIR), "accepted")]
    return when_of(ladder, "other")


def combine_grades(grades: DataFrame) -> DataFrame:
    """One row per (unit, grader, class): first grade by `ord` (of any orderable type, without ties), sorted wordings and sources, any primary; `conflict` if the grader has more classes."""
    df = grades.groupBy("unit", "grader", "class").agg(
        F.min_by("grade", F.when(F.col("grade").isNotNull(), F.col("ord"))).alias("grade"),
        F.sort_array(F.collect_set("grade")).alias("wordings"),
        F.sort_array(F.collect_set("source")).alias("sources"),
        F.max("primary").alias("primary"),
    )
    return df.withColumn("conflict", F.count("*").over(Window.partitionBy("unit", "grader")) > 1)


def grade_view(combined: DataFrame) -> DataFrame:
    """One row per (unit, grader): the entry with most sources, its other wordings in `others`."""
    w = Window.partitionBy("unit", "grader")
    order = [F.desc(F.size("sources")), "grade"]
    df = combined.withColumn("_r", F.row_number().over(w.orderBy(*order))).withColumn("others", F.collect_list(F.struct("_r", "grade")).over(w))
    rest = F.transform(F.filter("others", lambda x: x["_r"] > 1), lambda x: x["grade"])
    return df.where(F.col("_r") == 1).withColumn("others", rest).drop("_r")


def grade_summary(combined: DataFrame, units: DataFrame, canonical: tuple[str, ...] = ("bukhari", "muslim")) -> DataFrame:
    """(unit, status, graders, conflict, source_conflict) for every unit of (unit, collection)."""
    df = combined.groupBy("unit").agg(F.collect_set("class").alias("classes"), F.count_distinct("grader").alias("graders"), F.max("conflict").alias("source_conflict"))
    df = units.select("unit", "collection").join(df, "unit", "left")
    among = lambda names: F.array_intersect("classes", F.array(*map(F.lit, names)))
    accepted, rejected, ranked = among(ACCEPTED), among(REJECTED), among(tuple(GRADE_RANK))
    has = lambda c: F.array_contains("classes", c)
    lowest = when_of([(has(c), c) for c in sorted(GRADE_RANK, key=GRADE_RANK.get)], F.lit(None).cast("string"))
    status = when_of([
        (F.col("collection").isin(list(canonical)), "sahihayn"),
        (F.col("classes").isNull(), "ungraded"),
        ((F.size(ranked) == 0) & has("same_as_before"), "same_as_before"),
        ((F.size(ranked) == 0) & has("silent"), "silent"),
        ((F.size(accepted) > 0) & (F.size(rejected) > 0), "disputed"),
        (F.size(accepted) > 1, "hasan_or_sahih"),
        (F.size(rejected) > 0, lowest),
        (F.size(accepted) == 1, F.get(accepted, F.lit(0))),
    ], "other")
    df = df.withColumn("status", status)
    return df.select("unit", "status", F.coalesce("graders", F.lit(0)).alias("graders"), (F.col("status") == "disputed").alias("conflict"), F.coalesce("source_conflict", F.lit(False)).alias("source_conflict"))


def pair_equal(left: DataFrame, right: DataFrame, key: str, method: str) -> DataFrame:
    """One-to-one pairs (left_id, right_id, method) of rows with equal keys: the n-th of one side with the n-th of the other, by id."""
    def side(df: DataFrame, name: str) -> DataFrame:
        df = df.where(F.col(key).isNotNull()).select(F.col("id").alias(name), F.col(key).alias("_k"))
        return numbered(df, ["_k"], name, "_n")

    return side(left, "left_id").join(side(right, "right_id"), ["_k", "_n"]).select("left_id", "right_id", F.lit(method).alias("method"))


def match_cascade(left: DataFrame, right: DataFrame, passes: list) -> DataFrame:
    """Pairs (left_id, right_id, method) by each pass in turn; a pass sees the rows that the ones before left over, so no record is used twice.

    A pass is (method, key column), which pairs equal keys in order, or (method, function of both sides that gives edges
    (left_id, right_id, weight)), of which the best are taken one-to-one. Records are written out once, pairs by every
    pass; what a pass leaves is read without those.
    """
    found, sides = [], (materialize(left), materialize(right))

    def rest(side: int) -> DataFrame:
        df, name = sides[side], ("left_id", "right_id")[side]
        for pairs in found:
            df = df.join(broadcast_if_small(pairs.select(F.col(name).alias("id"))), "id", "left_anti")
        return df

    for method, how in passes:
        left, right = rest(0), rest(1)
        if callable(how):
            edges = how(left, right).select(F.col("left_id").alias("a"), F.col("right_id").alias("b"), "weight")
            pairs = mutual_best(edges).select(F.col("a").alias("left_id"), F.col("b").alias("right_id"), F.lit(method).alias("method"))
        else:
            pairs = pair_equal(left, right, how, method)
        found.append(materialize(pairs))
    return reduce(DataFrame.unionByName, found)


def mutual_best(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """One-to-one matching of weighted edges (a, b, weight), equal to picking the best edge again and again.

    A round keeps the edges that are the best of both their ends and drops both ends; it is written out. Edges of equal
    weight are ordered by the md5 of `a|b`, so that many equal ones do not wait for one another; the best edge of an end is an
    aggregate, so no end's edges are gathered. Chains of ever lighter edges bound the rounds; what is left after `rounds`
    raises.
    """
    order = F.struct((-F.col("weight")).alias("w"), F.md5(F.concat_ws("|", F.col("a").cast("string"), F.col("b").cast("string"))).alias("tie"), "a", "b")
    left, found = materialize(edges.select("a", "b", "weight")), None
    for _ in range(rounds):
        if left.isEmpty():
            return found if found is not None else left
        best = lambda side: left.groupBy(side).agg(F.min(order).alias("_m")).select("_m.a", "_m.b", (-F.col("_m.w")).alias("weight"))  # noqa: E731, B023
        pairs = materialize(best("a").join(best("b").select("a", "b"), ["a", "b"]))
        found = pairs if found is None else found.unionByName(pairs)
        left = materialize(left.join(pairs.select("a"), "a", "left_anti").join(pairs.select("b"), "b", "left_anti"))
    raise RuntimeError(f"edges are left after {rounds} rounds")


def family_links(parallels: DataFrame, same_as: DataFrame, matches: DataFrame, pointers: DataFrame, least: float = 0.85) -> DataFrame:
    """(u, v, link) of all four kinds: parallels and same texts (key, other), anthology pointers (key, other), and matches (key, other, score) of at least `least`."""
    kinds = {"parallel": parallels, "same_as": same_as, "match": matches.where(F.col("score") >= least), "pointer": pointers}
    typed = [df.where("key is not null and other is not null and key != other").select(F.col("key").alias("u"), F.col("other").alias("v"), F.lit(k).alias("link")) for k, df in kinds.items()]
    return reduce(DataFrame.unionByName, typed).distinct()


def families(links: DataFrame, ranks: DataFrame) -> DataFrame:
    """(key, family_id) of linked records (u, v); the family is named by its member of least (rank, key) in `ranks` (id, key, rank). A record without a link has none."""
    return named_families(connected_components(links), ranks)


def named_families(components: DataFrame, ranks: DataFrame) -> DataFrame:
    """(key, family_id) of components (node, component), as `families`; components that took further links give new names."""
    df = components.join(by_shuffle(ranks), F.col("node") == F.col("id")).select("component", "key", "rank")
    name = df.groupBy("component").agg(F.min(F.struct("rank", "key")).alias("_m"))
    return df.join(by_shuffle(name), "component").select("key", F.col("_m.key").alias("family_id"))


def corpus_ids(units: DataFrame, ranks: DataFrame) -> DataFrame:
    """Adds `id` from 1: units (collection, ord, …) in order of their collection's `rank` in `ranks` (collection, rank), then its name, then `ord`; units without a collection come last.

    Collections are counted and moved by those before; a large one is numbered in ranges, so none is in one task.
    """
    counts = null_safe_join(units.groupBy("collection").agg(F.count("*").alias("_n")), ranks, ["collection"], "left")
    before = F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy(F.col("rank").asc_nulls_last(), F.col("collection").asc_nulls_last())) - F.col("_n")  # a row per collection
    offsets = counts.select("collection", before.alias("_before"))
    df = null_safe_join(numbered(units, ["collection"], "ord", "id"), broadcast_if_small(offsets), ["collection"])
    return df.withColumn("id", F.col("id") + F.col("_before")).drop("_before")


def renumbered(rows: DataFrame, keys: list[str], order: list, name: str = "n") -> DataFrame:
    """Adds the row's number from 0 in its group's order."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def absorbed(hosts: DataFrame, guests: DataFrame, key: str = "key") -> DataFrame:
    """Adds `absorbed`, the numbers of the guests (key, ord, number) folded into each host, in order; empty where there are none."""
    lists = guests.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "number"))), lambda x: x["number"]).alias("absorbed"))
    df = hosts.join(lists, key, "left")
    return df.withColumn("absorbed", F.coalesce("absorbed", F.array().cast(lists.schema["absorbed"].dataType)))


def stacked(parts: dict[str, DataFrame]) -> DataFrame:
    """All records of several tables with their `origin`; columns that one lacks are null there."""
    both = None
    for origin, df in parts.items():
        df = df.withColumn("origin", F.lit(origin))
        both = df if both is None else both.unionByName(df, allowMissingColumns=True)
    return both


def family_sizes(members: DataFrame) -> DataFrame:
    """(family_id, collections, members): how many collections and records a family has."""
    return members.where("family_id is not null").groupBy("family_id").agg(F.count_distinct("collection").alias("collections"), F.count("*").alias("members"))


def chunked(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Row per chunk with its `first` place and its values in order, `parts`. A chunk is of bounded size by its key."""
    df = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))).alias("_p"), F.min(order).alias("first"))
    return df.withColumn("parts", F.transform("_p", lambda x: x["v"])).drop("_p")


def same_as_previous(records: DataFrame, partition: list[str], order: list[str], words: Column, marker: Column, key: str, long_words: int = 12) -> DataFrame:
    """Adds `same_as`: for a short record with the marker, the last longer one before it."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(words > long_words, F.col(key)), ignorenulls=True).over(w)
    return records.withColumn("_last", last).withColumn("same_as", F.when((words <= long_words) & marker, F.col("_last"))).drop("_last")


def resolve_numbers(refs: DataFrame, records: DataFrame, pointers: DataFrame | None = None) -> DataFrame:
    """Adds `key` to (ref, collection, number, number_base): the record of that very number, else the first by `ord` of its base, else a pointer's."""
    df = refs.join(records.select("collection", "number_base", F.col("number").alias("_n"), F.col("ord").alias("_o"), F.col("key").alias("_key")), ["collection", "number_base"], "left")
    df = first_of(df, ["ref"], [F.desc(F.coalesce(F.col("_n") == F.col("number"), F.lit(False))), F.col("_o").asc_nulls_last(), "_key"])
    df = df.withColumn("resolved_by", when_of([(F.col("_n") == F.col("number"), "number"), (F.col("_key").isNotNull(), "base")], F.lit(None).cast("string"))).withColumnRenamed("_key", "key").drop("_n", "_o")
    if pointers is None:
        return df
    p = pointers.select("collection", "number", F.col("source_key").alias("_p"))
    df = df.join(p, ["collection", "number"], "left")
    return df.withColumn("resolved_by", F.when(F.col("key").isNull() & F.col("_p").isNotNull(), "pointer").otherwise(F.col("resolved_by"))).withColumn("key", F.coalesce("key", "_p")).drop("_p")


def neighbours(df: DataFrame, partition: list[str], order: list[str], key: str) -> DataFrame:
    """Adds `previous` and `next` key in the order given."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumns({"previous": F.lag(key).over(w), "next": F.lead(key).over(w)})


def expand_window(refs: DataFrame, rows: DataFrame, group: str, number: str, before: int, after: int) -> DataFrame:
    """Rows of the group within [number - before, number + after] of each reference: the range as an equality join."""
    wide = refs.withColumn("_n", F.explode(F.sequence(F.col(number) - before, F.col(number) + after)))
    r = rows.withColumnsRenamed({number: "_n", **{c: f"row_{c}" for c in rows.columns if c not in (group, number)}})
    return wide.join(r, [group, "_n"]).withColumnRenamed("_n", f"row_{number}")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """`new` over `old`: the last row of each key, new rows being later."""
    both = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)), allowMissingColumns=True)
    return first_of(both, keys, [F.desc("_v")]).drop("_v")


def delete_cascade(tables: dict[str, DataFrame], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Every derived table without the rows of deleted keys."""
    return {name: df.join(gone.select(key).distinct(), key, "left_anti") for name, df in tables.items()}


def changed_rows(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of `new` that are new or differ from `old` in any of `columns`."""
    o = old.select(F.col(key), *(F.col(c).alias(f"_{c}") for c in columns), F.lit(True).alias("_old"))
    differs = F.col("_old").isNull()
    for c in columns:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    return new.join(o, key, "left").where(differs).select(new.columns)


def missing_rows(units: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Units whose key has no result yet."""
    return units.join(done.select(key).distinct(), key, "left_anti")


def majority(names: DataFrame, share: float = 0.6) -> DataFrame:
    """(id, name, votes, total) of the spelling that wins: spellings that are a prefix of one another support each other."""
    counts = names.groupBy("id", "name").agg(F.count("*").alias("n"))
    other = counts.select("id", F.col("name").alias("other"), F.col("n").alias("m"))
    support = counts.join(other, "id").where(F.col("name").startswith(F.col("other")) | F.col("other").startswith(F.col("name")))
    votes = support.groupBy("id", "name").agg(F.sum("m").alias("votes"), F.max("n").alias("own"))
    total = counts.groupBy("id").agg(F.sum("n").alias("total"))
    best = first_of(votes.join(total, "id"), ["id"], [F.desc("votes"), F.desc("own"), "name"])
    return best.where(F.col("votes") >= share * F.col("total")).select("id", "name", "votes", "total")


def review_boxes(events: DataFrame, key: list[str], order: list[str], success: Column, ts: str, days: tuple[int, ...] = (0, 1, 3, 7, 16)) -> DataFrame:
    """Adds `box` and `due` of spaced repetition after each review: a success moves up a box (of 5), a failure back to the first."""
    w = Window.partitionBy(*key).orderBy(*order)
    df = events.withColumn("_run", F.sum((~success).cast("int")).over(w))
    in_run = Window.partitionBy(*key, "_run").orderBy(*order)
    box = F.least(F.lit(5), F.lit(1) + F.sum(success.cast("int")).over(in_run))
    wait = F.when(~success, F.expr("interval 1 millisecond")).otherwise(F.make_dt_interval(F.element_at(F.array(*map(F.lit, days)), F.col("box").cast("int"))))
    return df.withColumn("box", box).withColumn("due", F.col(ts) + wait).drop("_run")


def hourly_quota(requests: DataFrame, key: str, ts: str, order: list[str], most: int) -> DataFrame:
    """Adds `allowed`: the first `most` requests of a key in each clock hour."""
    w = Window.partitionBy(key, F.date_trunc("hour", ts)).orderBy(*order)
    return requests.withColumn("allowed", F.row_number().over(w) <= most)


def live(df: DataFrame, expires: Column, now: Column) -> DataFrame:
    return df.where(expires > now)


def submissions(texts: DataFrame, text: str, order: list[str], shortest: int = 40, longest: int = 100_000) -> DataFrame:
    """The first row of each distinct trimmed text of a permitted length, with its content hash."""
    t = F.trim(F.col(text))
    df = texts.where(F.length(t).between(shortest, longest)).withColumn("hash", F.sha2(t, 256))
    return first_of(df, ["hash"], order)
