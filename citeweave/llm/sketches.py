"""Document fingerprints: invertible Bloom lookup sketches of paragraphs, in DataFrame functions only.

A paragraph's digest is a 64-bit hash. A sketch has three tables of `width` cells; a digest falls into one cell of each,
which adds up a signed count (the sign is a bit of the digest's check hash) and the XORs of digests and check hashes.
Two sketches subtract cell by cell: what both texts share cancels out, and cells that hold a single digest are peeled
until none is left. The squares of the subtracted counts of the small printed sketch estimate how many digests differ;
that picks the width of the sketch that is peeled, and a pair that cannot be peeled is tried again at twice the width.

Cells are rows: they are added up by grouping, where one shuffle by document has brought all digests of a pair.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeweave.llm.common import let, materialize
from citeweave.operators.common import broadcast_if_small

#: Cells per table of the printed fingerprint, and the least of a sketch that is peeled.
WIDTH = 8
TABLES = 3
#: Peeling steps; each takes the single cells of one table.
STEPS = 9
#: A paragraph ends at a line break or behind the end of a sentence.
PARAGRAPH_END = r"\n|(?<=[.!?])[\x20\x09]+"


def paragraph_digests(text: Column) -> Column:
    """Distinct digests of the non-empty paragraphs of a text."""
    return F.array_distinct(F.transform(F.array_remove(F.split(text, PARAGRAPH_END), ""), lambda p: F.xxhash64(p)))


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit(-1))


def _sign(check: Column) -> Column:
    return (1 - 2 * check.bitwiseAND(F.lit(1))).cast("int")


def _place(key: Column, table: int, width: Column, trial: int = 0) -> Column:
    """The cell of one table that a digest falls into; widths are powers of two, and every trial places anew."""
    return F.xxhash64(key, F.lit(table + TABLES * trial)).bitwiseAND((width - 1).cast("long")).cast("int") + table * width


def _cells(digests: DataFrame, keys: list[str], trial: int = 0) -> DataFrame:
    """Rows (keys, q, n, key, chk) of (keys, width, side, key): each digest in a cell of each table."""
    chk = digests.withColumn("chk", _check(F.col("key"))).withColumn("n", F.col("side") * _sign(F.col("chk")))
    return chk.select(*keys, F.explode(F.array(*(_place(F.col("key"), t, F.col("width"), trial) for t in range(TABLES)))).alias("q"), "n", "key", "chk")


def fingerprints(versions: DataFrame, n_versions: int) -> DataFrame:
    """(rid, cells): the small sketch of every version of (rid, lists: an array of digest arrays), place by place.

    A cell is struct(q, n0, key0, chk0, n1, ...), one triple for each version. Rows without any digest are left out.
    """
    rows = versions.select("rid", F.posexplode("lists").alias("version", "list")).select("rid", "version", F.explode("list").alias("key"))
    cells = _cells(rows.withColumns({"side": F.lit(1), "width": F.lit(WIDTH)}), ["rid", "version"])
    own = lambda v, c, zero: F.when(F.col("version") == v, F.col(c)).otherwise(zero)
    zero = F.lit(0).cast("long")
    sums = [s for v in range(n_versions) for s in (F.sum(own(v, "n", F.lit(0))).alias(f"n{v}"), F.bit_xor(own(v, "key", zero)).alias(f"key{v}"), F.bit_xor(own(v, "chk", zero)).alias(f"chk{v}"))]
    added = cells.groupBy("rid", "q").agg(*sums)
    return added.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct(*added.columns[1:]))).alias("cells"))


def printed(cells: Column, version: int) -> Column:
    """The filled cells of a version's small sketch as text: place, count, digest and check in hexadecimal."""
    n, key, chk = (f"{c}{version}" for c in ("n", "key", "chk"))
    filled = F.filter(cells, lambda c: (c[n] != 0) | (c[key] != 0) | (c[chk] != 0))
    one = lambda c: F.concat_ws(":", c["q"].cast("string"), c[n].cast("string"), F.lower(F.hex(c[key])), F.lower(F.hex(c[chk].bitwiseAND(F.lit(0xFFFFFFFF)))))
    return F.coalesce(F.array_join(F.transform(filled, one), " "), F.lit(""))


def estimated_width(cells: Column, a: int, b: int) -> Column:
    """Cells per table for the difference of two versions.

    With random signs, the squared counts of a table of the subtracted sketch add up to the number of differing
    digests on average; as many cells in each table, and a little more, leave two thirds of all cells free.
    """
    squares = F.aggregate(cells, F.lit(0.0), lambda s, c: s + F.pow(c[f"n{a}"] - c[f"n{b}"], F.lit(2.0)))
    wanted = WIDTH + F.coalesce(squares, F.lit(0.0)) / TABLES
    return F.pow(F.lit(2.0), F.ceil(F.log2(wanted))).cast("int")


def peeled(pairs: DataFrame, trial: int = 0) -> DataFrame:
    """Rows (rid, kind, width, q, n, key, chk, single) that peeling leaves of (rid, kind, width, a, b).

    A `single` row is a recovered digest, `key`, on the side that `n` and its sign say; any other row is a cell that
    could not be peeled. A pair without rows has no difference.
    """
    keys = ["rid", "kind", "width"]
    sides = pairs.select(*keys, F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(c).alias("list")) for s, c in ((1, "a"), (-1, "b"))))).alias("s"))
    digests = sides.select(*keys, "s.side", F.explode("s.list").alias("key"))

    def added(df: DataFrame) -> DataFrame:
        sums = df.groupBy(*keys, "q").agg(F.sum("n").alias("n"), F.bit_xor("key").alias("key"), F.bit_xor("chk").alias("chk"), F.max("single").alias("single"))
        return sums.where((F.col("n") != 0) | (F.col("key") != 0) | (F.col("chk") != 0))

    def cell(q, n, single) -> Column:
        return F.struct(q.alias("q"), n.cast("long").alias("n"), F.col("key").alias("key"), F.col("chk").alias("chk"), single.alias("single"))

    cells = added(_cells(digests, keys, trial).withColumn("single", F.lit(False)))
    q, n, width = F.col("q"), F.col("n"), F.col("width")
    for step in range(STEPS):
        # The cells of one table at a time: no two of them hold the same digest. A single cell stays as what it gave.
        own, others = step % TABLES, [t for t in range(TABLES) if t != step % TABLES]
        single = ~F.col("single") & (F.abs(n) == 1) & (q >= own * width) & (q < (own + 1) * width) & (F.col("chk") == _check(F.col("key")))
        taken = F.array(cell(q, n, F.lit(True)), *(cell(_place(F.col("key"), t, width, trial), -n, F.lit(False)) for t in others))
        moved = cells.select(*keys, F.explode(F.when(single, taken).otherwise(F.array(cell(q, n, F.col("single"))))).alias("c"))
        cells = added(moved.select(*keys, "c.*"))
    return cells


def differences(pairs: DataFrame, digests: bool = False, again: DataFrame | None = None) -> DataFrame:
    """(rid, kind, n_differing) of (rid, kind, width, a, b), for the pairs that differ; with `digests` also `plus` and `minus`.

    `plus` are the digests that only `a` has, `minus` those that only `b` has. Pairs that cannot be peeled are tried
    again at twice the width, as often as it takes. `pairs` should be dealt by rid; `again` has the same pairs as they
    can be read again at little cost, without a shuffle, of which those that failed alone are dealt.
    """
    found, again = None, (pairs if again is None else again).select("rid", "kind", "a", "b")
    for trial in count():
        single = F.col("single").cast("int")
        sums = [F.sum(single).cast("long").alias("n_differing"), (F.min(single) == 1).alias("done"), F.first("width").alias("width")]
        if digests:
            side = F.col("n") * _sign(F.col("chk"))
            sums += [F.sort_array(F.collect_list(F.when(F.col("single") & (side == s), F.col("key")))).alias(c) for s, c in ((1, "plus"), (-1, "minus"))]
        tried = materialize(peeled(pairs, trial).groupBy("rid", "kind").agg(*sums))
        good = tried.where("done").drop("done", "width")
        found = good if found is None else found.unionByName(good)
        failed = tried.where("not done").select("rid", "kind", (F.col("width") * 2).alias("width"))
        if failed.isEmpty():
            return found
        left = materialize(again.join(broadcast_if_small(failed), ["rid", "kind"]))
        pairs, again = left.repartition("rid"), left.drop("width")


def likeness(n_a: Column, n_b: Column, n_differing: Column) -> Column:
    """Dice coefficient of two digest sets by their sizes and the number of recovered differences; 1 for two empty sets."""
    both = n_a + n_b
    return F.when(both == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - F.coalesce(n_differing, F.lit(0)) / both))


def with_next(docs: DataFrame, per_bucket: int = 256, max_buckets: int = 16384) -> DataFrame:
    """Adds `next_text`, the text of the next doc_id, and after the last that of the first, and both texts' `digests`, `next_digests`.

    Buckets of doc_ids are cut at approximate quantiles, so that each holds about `per_bucket` rows; the first row of
    each bucket also goes to the bucket before. Quantiles are literals of the plan, so there are `max_buckets` at most;
    in larger tables a bucket holds more rows, which its task sorts on disk. Texts are shuffled once.
    """
    n = docs.count()
    k = max(1, min(max_buckets, n // per_bucket))
    cuts = (docs.agg(F.percentile_approx("doc_id", [i / k for i in range(1, k)], 10 * k).alias("c")).first()["c"] if k > 1 else None) or []
    cuts = sorted(set(cuts))
    coarse = cuts[::128]
    upto = lambda a: F.size(F.filter(a, lambda c: c <= F.col("doc_id")))
    longs = lambda v: F.array(*(F.lit(x).cast("long") for x in v)).cast("array<long>")
    part = let(upto(longs(coarse)), lambda i: F.when(i == 0, F.lit(0)).otherwise((i - 1) * 128 + upto(F.slice(longs(cuts), (i - 1) * 128 + 1, F.lit(128)))))
    df = docs.withColumn("bucket", F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(part) if cuts else F.when(F.col("doc_id").isNull(), F.lit(1)).otherwise(F.lit(0)))
    heads = {r["bucket"]: r["head"] for r in df.groupBy("bucket").agg(F.min("doc_id").alias("head")).collect()}  # a row per bucket
    order = sorted(heads)
    first = docs.sparkSession.createDataFrame([(heads[b], order[i - 1]) for i, b in enumerate(order)], "head long, goes_to int")
    guests = df.join(F.broadcast(first), df["doc_id"].eqNullSafe(first["head"])).select("doc_id", "text", F.col("goes_to").alias("bucket"), F.lit(True).alias("guest"))
    w = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_first())
    both = df.select("doc_id", "text", "bucket", F.lit(False).alias("guest")).unionByName(guests)
    both = both.withColumn("next_text", F.lead("text").over(w))
    both = both.withColumn("digests", paragraph_digests(F.col("text"))).withColumn("next_digests", F.lead("digests").over(w))
    return both.where(~F.col("guest")).select("doc_id", "text", "next_text", "digests", "next_digests")


def document_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints every whole text and its edited form; one row per input row.

    The edited text has its last floor(n / 2) code points replaced by the first as many of the next document in order
    of doc_id (after the last, the first; rows of one doc_id in order of their text, a null doc_id last). Null is the
    empty text, with the empty fingerprint; very long texts are sketched as wide as their differences ask; the only row
    of a table is its own next one; repeated rows are fingerprinted each; an empty table gives an empty table; other
    columns are not read. `near_*` is the Dice likeness of the digest sets, recovered from the subtracted sketches.
    """
    df = with_next(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    df = df.withColumn("n_chars", F.length("text").cast("long"))
    df = df.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring(F.col("next_text"), F.lit(1), half)))
    # One column of lists: they have most digests in common, and so take little more room than one.
    df = materialize(df.select(
        F.monotonically_increasing_id().alias("rid"), "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.array("digests", paragraph_digests(F.col("edited")), "next_digests").alias("lists"),
    ))
    # The filter is what both uses of `dealt` come to anyway: with it they are alike, and share one shuffle.
    dealt = df.select("rid", "lists").where("rid is not null and lists is not null and size(lists) > 0").repartition("rid")
    prints = fingerprints(dealt, 3)
    widths = F.array(*(F.struct(F.lit(k).alias("kind"), estimated_width(F.col("cells"), 0, k).alias("width")) for k in (1, 2)))
    pairs = dealt.join(prints.select("rid", widths.alias("widths")), "rid").select("rid", "lists", F.explode("widths").alias("w"))
    both = [F.get("lists", F.lit(0)).alias("a"), F.get("lists", F.col("kind")).alias("b")]
    pairs = pairs.select("rid", "w.kind", "w.width", "lists").select("rid", "kind", "width", *both)
    found = differences(pairs, again=df.select("rid", F.explode(F.array(F.lit(1), F.lit(2))).alias("kind"), "lists").select("rid", "kind", *both))
    by_kind = found.groupBy("rid").agg(*(F.max(F.when(F.col("kind") == k, F.col("n_differing"))).alias(f"differing{k}") for k in (1, 2)))
    sizes = df.select("rid", "doc_id", "n_chars", "edited_sha256", *(F.size(F.get("lists", F.lit(k))).alias(f"size{k}") for k in range(3)))
    shown = prints.select("rid", printed(F.col("cells"), 0).alias("fingerprint"), printed(F.col("cells"), 1).alias("edited_fingerprint"))
    done = sizes.join(shown, "rid", "left").join(by_kind, "rid", "left")
    near = lambda k: likeness(F.col("size0"), F.col(f"size{k}"), F.col(f"differing{k}"))
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return done.select("doc_id", "n_chars", "edited_sha256", blank("fingerprint"), blank("edited_fingerprint"), near(1).alias("near_edited"), near(2).alias("near_next"))
