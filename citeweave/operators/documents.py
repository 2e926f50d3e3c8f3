"""Documents as segments: scans, offsets, sections, marks and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeweave.operators.common import broadcast_if_small


def line_segments(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, seg, text, start): lines of a text and where each begins in the lines joined by one character."""
    df = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(F.col(text), "\n")).alias("seg", "text"))
    return with_offsets(df)


def with_offsets(segments: DataFrame) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    return segments.withColumn("start", F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0)))


def segment_at(points: DataFrame, segments: DataFrame) -> DataFrame:
    """The segment that holds each (doc_id, offset): the last that starts at or before it. A union and one window, no range join."""
    both = segments.select("doc_id", F.col("start").alias("_at"), F.lit(0).alias("_kind"), "seg", F.lit(None).cast("long").alias("offset"))
    both = both.unionByName(points.select("doc_id", F.col("offset").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("int").alias("seg"), "offset"))
    w = Window.partitionBy("doc_id").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("seg", F.last("seg", ignorenulls=True).over(w)).where("_kind = 1").select("doc_id", "offset", "seg")


def carried_sections(segments: DataFrame, is_header: Column) -> DataFrame:
    """Adds `section`, the last header at or above, and `shown`, the section where it differs from that of the segment before."""
    w = Window.partitionBy("doc_id").orderBy("seg")
    df = segments.withColumn("section", F.last(F.when(is_header, F.col("text")), ignorenulls=True).over(w))
    before = F.lag("section").over(w)
    return df.withColumn("shown", F.when(~F.col("section").eqNullSafe(before), F.col("section")))


def packed_sentences(text: Column, longest: int = 1200, size: int = 800) -> Column:
    """Pieces of a paragraph: whole up to `longest` characters, else cut at sentence ends and packed up to `size`. A longer sentence stays whole."""
    parts = F.array_remove(F.split(text, r"(?<=[.!?؟۔])\s+"), "")

    def add(done: Column, part: Column) -> Column:
        last = F.coalesce(F.element_at(done, -1), F.lit(""))
        joins = (F.size(done) > 0) & (F.length(last) + 1 + F.length(part) <= size)
        return F.when(joins, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.concat(last, F.lit(" "), part)))).otherwise(F.concat(done, F.array(part)))

    return F.when(F.length(text) <= longest, F.array(text)).otherwise(F.aggregate(parts, F.array().cast("array<string>"), add))


def markdown_segments(files: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, seg, section, title, text) of markdown texts: `#` title, `##` section, paragraphs between blank lines, rules skipped."""
    df = files.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(F.col(text), r"\r?\n")).alias("line", "raw"))
    df = df.withColumn("raw", F.trim("raw"))
    w = Window.partitionBy("doc_id").orderBy("line")
    head = F.regexp_extract("raw", r"^##+\s+(.*)$", 1)
    df = df.withColumns({"section": F.last(F.when(head != "", head), ignorenulls=True).over(w), "title": F.first(F.when(F.col("raw").rlike(r"^#\s+"), F.regexp_replace("raw", r"^#\s+", "")), ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    df = df.where((F.col("raw") != "") & ~F.col("raw").rlike(r"^(#|---+$)"))
    df = df.select("doc_id", "line", "section", "title", F.posexplode(packed_sentences(F.col("raw"))).alias("part", "text"))
    return df.withColumn("seg", F.row_number().over(Window.partitionBy("doc_id").orderBy("line", "part")) - 1).select("doc_id", "seg", "section", "title", "text")


CUE = r"(?:(\d+):)?(\d{1,2}):(\d{2})[.,](\d{3})\s*-->\s*(?:(\d+):)?(\d{1,2}):(\d{2})[.,](\d{3})"


def is_subtitle(text: Column) -> Column:
    return F.substring(text, 1, 2000).rlike(CUE)


def subtitle_segments(files: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 400, gap: float = 4.0) -> DataFrame:
    """(doc_id, seg, start, end, text) of subtitle files: cues without tags, joined while they stay under `size` characters and `gap` seconds."""
    df = files.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(F.col(text), r"\r?\n\s*\r?\n")).alias("n", "block")).where(F.col("block").rlike(CUE))
    second = lambda k: sum(F.coalesce(F.try_to_number(F.nullif(F.regexp_extract("block", CUE, k + i), F.lit("")), F.lit("999999")).cast("double"), F.lit(0.0)) * f for i, f in enumerate((3600, 60, 1, 0.001)))
    said = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("block", rf"(?s)^.*?{CUE}[^\n]*\n?", ""), "<[^>]*>", ""), r"\s+", " "))
    df = df.select("doc_id", F.struct("n", F.round(second(1), 3).alias("start"), F.round(second(5), 3).alias("end"), said.alias("text")).alias("c")).where(F.col("c.text") != "")
    kind = "array<struct<start:double,end:double,text:string>>"

    def add(done: Column, c: Column) -> Column:
        last = F.element_at(done, -1)
        joins = (F.size(done) > 0) & (F.length(last["text"]) + F.length(c["text"]) < size) & (c["start"] - last["end"] < gap)
        one = lambda a, b, t: F.array(F.struct(a.alias("start"), b.alias("end"), t.alias("text"))).cast(kind)
        return F.when(joins, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), one(last["start"], c["end"], F.concat(last["text"], F.lit(" "), c["text"])))).otherwise(F.concat(done, one(c["start"], c["end"], c["text"])))

    merged = df.groupBy("doc_id").agg(F.array_sort(F.collect_list("c")).alias("cues")).withColumn("cues", F.aggregate("cues", F.array().cast(kind), add))
    return merged.select("doc_id", F.posexplode("cues").alias("seg", "c")).select("doc_id", "seg", "c.start", "c.end", "c.text")


def choose_title(given: Column, heading: Column, file_name: Column, opening: Column) -> Column:
    """Given title, else heading, else the file name in words, else the opening up to 70 characters at a word end."""
    name = F.nullif(F.trim(F.regexp_replace(F.regexp_replace(file_name, r"\.[A-Za-z0-9]+$", ""), r"[-_]+", " ")), F.lit(""))
    short = F.when(F.length(opening) <= 70, opening).otherwise(F.regexp_replace(F.substring(opening, 1, 71), r"\s+\S*$", ""))
    return F.coalesce(F.nullif(F.trim(given), F.lit("")), F.nullif(F.trim(heading), F.lit("")), name, short)


def route(text: Column) -> Column:
    """`document` for long texts or several paragraphs, else `quote`."""
    paragraphs = F.size(F.filter(F.split(text, r"\n\s*\n"), lambda p: F.trim(p) != ""))
    return F.when((F.length(text) > 1500) | ((F.length(text) > 400) & (paragraphs >= 3)), "document").otherwise("quote")


def size_batches(segments: DataFrame, size: int = 6000) -> DataFrame:
    """Adds `batch`: a new one starts where the batch would pass `size` characters. One ordered fold per document."""
    grouped = segments.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seg", F.length("text").alias("n")))).alias("s"))
    start = F.struct(F.lit(0).alias("batch"), F.lit(0).alias("used"), F.array().cast("array<struct<seg:int,batch:int>>").alias("out"))

    def add(a: Column, x: Column) -> Column:
        new = (a["used"] > 0) & (a["used"] + x["n"] > size)
        batch = F.when(new, a["batch"] + 1).otherwise(a["batch"])
        return F.struct(batch.alias("batch"), F.when(new, x["n"]).otherwise(a["used"] + x["n"]).alias("used"), F.concat(a["out"], F.array(F.struct(x["seg"].alias("seg"), batch.alias("batch")).cast("struct<seg:int,batch:int>"))).alias("out"))

    placed = grouped.select("doc_id", F.explode(F.aggregate("s", start, add)["out"]).alias("o")).select("doc_id", "o.seg", "o.batch")
    return segments.join(placed, ["doc_id", "seg"])


def marked_pieces(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, piece, text, span): the text cut at its spans (doc_id, span, a, b); overlapping later spans are skipped. The pieces on end are the text."""
    own = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("a", "b", "span"))).alias("spans"))
    kind = "array<struct<text:string,span:bigint>>"
    start = F.struct(F.lit(1).alias("at"), F.array().cast(kind).alias("out"))

    def add(s: Column, x: Column) -> Column:
        plain = F.struct(F.substring(F.col("text"), s["at"], (x["a"] + 1 - s["at"]).cast("int")).alias("text"), F.lit(None).cast("long").alias("span"))
        quote = F.struct(F.substring(F.col("text"), (x["a"] + 1).cast("int"), (x["b"] - x["a"]).cast("int")).alias("text"), x["span"].cast("long").alias("span"))
        more = F.struct((x["b"] + 1).cast("int").alias("at"), F.concat(s["out"], F.array(plain, quote).cast(kind)).alias("out"))
        return F.when((x["a"] + 1 < s["at"]) | (x["b"] > F.length("text")), s).otherwise(more)

    df = docs.join(own, "doc_id", "left").withColumn("f", F.aggregate(F.coalesce("spans", F.array().cast("array<struct<a:bigint,b:bigint,span:bigint>>")), start, add))
    rest = F.array(F.struct(F.substring(F.col("text"), F.col("f.at"), F.length("text")).alias("text"), F.lit(None).cast("long").alias("span"))).cast(kind)
    pieces = F.filter(F.concat(F.col("f.out"), rest), lambda p: p["text"] != "")
    return df.select("doc_id", F.posexplode(pieces).alias("piece", "p")).select("doc_id", "piece", "p.text", "p.span")


def masked(pieces: DataFrame) -> DataFrame:
    """(doc_id, masked, quotes): quoted pieces replaced by ⟦n⟧, to be put back by `restored` after translation."""
    w = Window.partitionBy("doc_id").orderBy("piece")
    n = F.sum(F.col("span").isNotNull().cast("int")).over(w) - 1
    df = pieces.withColumn("shown", F.when(F.col("span").isNotNull(), F.format_string("⟦%d⟧", n)).otherwise(F.col("text")))
    by_piece = lambda c: F.array_sort(F.collect_list(F.struct("piece", c)))
    return df.groupBy("doc_id").agg(
        F.array_join(F.transform(by_piece("shown"), lambda x: x["shown"]), "").alias("masked"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("span").isNotNull(), F.struct("piece", "text")))), lambda x: x["text"]).alias("quotes"),
    )


def restored(text: Column, quotes: Column) -> Column:
    """`text` with every ⟦n⟧ replaced by the n-th quote."""
    return F.aggregate(F.transform(quotes, lambda q, i: F.struct(q.alias("q"), i.alias("i"))), text, lambda t, x: F.replace(t, F.format_string("⟦%d⟧", x["i"]), x["q"]))


def tag_terms(docs: DataFrame, terms: DataFrame, doc_id: str = "doc_id", text: str = "text", letter: str = r"\p{L}") -> DataFrame:
    """(doc_id, term, form, position): the first whole-word place of each term (term, form, lower_only) in a text; terms are broadcast while they are few."""
    words = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(F.col(text), rf"[^{letter}'’-]+")).alias("position", "word")).where("word != ''")
    hits = words.join(broadcast_if_small(terms), F.lower("word") == F.lower("form")).where(~F.col("lower_only") | (F.col("word") == F.lower("word")))
    w = Window.partitionBy("doc_id", "term").orderBy("position", F.desc(F.length("form")), "form")
    return hits.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("doc_id", "term", "form", "position")


def report_summary(findings: DataFrame, statuses: list[str]) -> DataFrame:
    return findings.groupBy("doc_id").agg(F.count("*").alias("total"), *(F.count_if(F.col("status") == s).alias(f"n_{s}") for s in statuses))


def stacks(findings: DataFrame, severity: dict[str, int]) -> DataFrame:
    """Findings of one source (family, else key) in a document: count, statuses, first start and the lead, the most severe and then earliest."""
    rank = F.coalesce(F.element_at(F.create_map(*(x for k, v in severity.items() for x in (F.lit(k), F.lit(v)))), F.col("status")), F.lit(len(severity)))
    df = findings.withColumn("source", F.coalesce("family_id", "key"))
    return df.groupBy("doc_id", "source").agg(
        F.count("*").alias("n"), F.sort_array(F.collect_set("status")).alias("statuses"), F.min("start").alias("first_start"),
        F.min_by("span", F.struct(rank, F.col("start"), F.col("span"))).alias("lead"),
    )
