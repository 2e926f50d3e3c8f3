"""Scans of book exports, editions, API dumps and parallel texts into flat records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.operators.common import broadcast_if_small, first_of
from citeweave.operators.documents import is_subtitle, markdown_segments, subtitle_segments

ITEM = "struct<ref:string,number:string,title:struct<en:string,ar:string>,text:struct<en:string,ar:string>,chain:struct<en:string,ar:string>,grade:struct<en:string,ar:string>,grader:struct<en:string,ar:string>,id:string,source:struct<ref:string>>"
SUBSECTION = f"struct<title:struct<en:string,ar:string>,items:array<{ITEM}>>"
SECTION = f"struct<title:struct<en:string,ar:string>,items:array<{ITEM}>,subsections:array<{SUBSECTION}>>"
CHAPTER = f"struct<number:string,title:struct<en:string,ar:string>,items:array<{ITEM}>,sections:array<{SECTION}>>"
BOOK = f"book struct<alias:string,title:struct<en:string,ar:string>>, chapters array<{CHAPTER}>"
EDITION = "metadata struct<name:string,sections:map<string,string>>, hadiths array<struct<hadithnumber:double,arabicnumber:double,text:string,grades array<struct<name:string,grade:string>>,reference struct<book:int,hadith:int>>>".replace("grades array", "grades:array").replace("reference struct", "reference:struct")
PAGE = "data array<struct<collection:string,hadithNumber:string,bookNumber:string,chapterId:string,hadith:array<struct<lang:string,body:string,urn:bigint,chapterTitle:string,grades:array<struct<graded_by:string,grade:string>>>>>>"


def nested_book(spark: SparkSession, path: str) -> DataFrame:
    """(book, ref, number, trail, item, path): leaves of a nested export at any level with the titles above them; the first of each ref.

    Levels are exploded one by one, never walked on the driver.
    """
    raw = spark.read.schema(BOOK).option("multiLine", True).json(path)
    chapters = raw.select(F.col("book.alias").alias("book"), F.posexplode("chapters").alias("c", "chapter"))
    sections = chapters.select("book", "c", "chapter", F.posexplode("chapter.sections").alias("s", "section"))
    subsections = sections.select("book", "c", "s", "chapter", "section", F.posexplode("section.subsections").alias("u", "subsection"))
    none = F.lit(-1)

    def leaves(df: DataFrame, own: str, at: list, titles: list[str]) -> DataFrame:
        df = df.select("book", *at, F.array_compact(F.array(*(F.col(f"{t}.title.en") for t in titles))).alias("trail"), F.posexplode(f"{own}.items").alias("i", "item"))
        return df

    parts = [
        leaves(chapters, "chapter", ["c", none.alias("s"), none.alias("u")], ["chapter"]),
        leaves(sections, "section", ["c", "s", none.alias("u")], ["chapter", "section"]),
        leaves(subsections, "subsection", ["c", "s", "u"], ["chapter", "section", "subsection"]),
    ]
    df = parts[0].unionByName(parts[1]).unionByName(parts[2]).where("item.ref is not null")
    df = df.select("book", F.col("item.ref").alias("ref"), F.col("item.number").alias("number"), "trail", "item", F.struct("c", "s", "u", "i").alias("path"))
    return first_of(df, ["book", "ref"], ["path"])


def text_leaves(book: DataFrame) -> DataFrame:
    return book.where("item.text is not null and item.source is null")


def pointers(book: DataFrame) -> DataFrame:
    """(key, collection, number, source_key): leaves that point to a record of another book."""
    return book.where("item.source.ref is not null and number is not null").select(F.concat_ws(":", "book", "number").alias("key"), F.col("book").alias("collection"), "number", F.col("item.source.ref").alias("source_key"))


def editions(spark: SparkSession, paths: dict[str, str], lead: str = "ar") -> DataFrame:
    """Rows of the leading edition with the texts of the others by number and the section title of its book."""
    def read(lang: str) -> DataFrame:
        df = spark.read.schema(EDITION).option("multiLine", True).json(paths[lang])
        return df.select(F.col("metadata.sections").alias("sections"), F.explode("hadiths").alias("h"))

    base = read(lead)
    df = base.select(F.col("h.hadithnumber").alias("number"), F.col("h.text").alias(f"text_{lead}"), F.col("h.grades").alias("grades"), F.col("h.reference.book").alias("book"), F.try_element_at("sections", F.col("h.reference.book").cast("string")).alias("section"))
    for lang in sorted(set(paths) - {lead}):
        other = read(lang).select(F.col("h.hadithnumber").alias("number"), F.col("h.text").alias(f"text_{lang}"))
        df = df.join(first_of(other, ["number"], [f"text_{lang}"]), "number", "left")
    return df


def api_pages(spark: SparkSession, glob: str, langs: tuple[str, ...] = ("ar", "en")) -> DataFrame:
    """(collection, number, book, chapter, file, body_xx, urn_xx, title_xx, grades_xx): pages of an API dump, language rows side by side."""
    rows = spark.read.schema(PAGE).option("multiLine", True).json(glob).select(F.input_file_name().alias("file"), F.explode("data").alias("d"))
    df = rows.select("file", F.col("d.collection").alias("collection"), F.col("d.hadithNumber").alias("number"), F.col("d.bookNumber").alias("book"), F.col("d.chapterId").alias("chapter"), F.explode("d.hadith").alias("h"))
    pick = lambda field, lang: F.max(F.when(F.col("h.lang") == lang, F.col(f"h.{field}")))
    cols = [pick(field, lang).alias(f"{name}_{lang}") for lang in langs for name, field in (("body", "body"), ("urn", "urn"), ("title", "chapterTitle"))]
    cols += [F.max(F.when(F.col("h.lang") == lang, F.to_json("h.grades"))).alias(f"grades_{lang}") for lang in langs]
    return df.groupBy("collection", "number", "book", "chapter", "file").agg(*cols)


def parallel_texts(texts: dict[str, DataFrame], chapters: DataFrame, lead: str) -> DataFrame:
    """(key, chapter, verse, ord, text_xx, chapter name): texts (verse_key `c:v`, text) side by side, in order of chapter and verse."""
    df = texts[lead].withColumnRenamed("text", f"text_{lead}")
    for lang in sorted(set(texts) - {lead}):
        df = df.join(texts[lang].withColumnRenamed("text", f"text_{lang}"), "verse_key", "left")
    parts = F.split("verse_key", ":")
    df = df.withColumns({"chapter": parts[0].cast("int"), "verse": parts[1].cast("int")})
    starts = chapters.select(F.col("id").alias("chapter"), "name", F.col("before"))
    df = df.join(broadcast_if_small(starts), "chapter", "left")
    return df.withColumn("ord", F.col("before") + F.col("verse")).drop("before")


def wiki_text(pages: DataFrame, dropped: tuple[str, ...] = ("references", "notes", "external links", "see also", "further reading", "bibliography", "sources", "citations")) -> DataFrame:
    """(doc_id, line, text) of wiki texts without reference-type sections, each up to the next heading."""
    from pyspark.sql import Window

    lines = pages.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    heading = F.lower(F.trim(F.regexp_extract("text", r"^\s*=+\s*(.*?)\s*=+\s*$", 1)))
    section = F.last(F.when(heading != "", heading), ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("line"))
    return lines.withColumn("section", section).where(F.col("section").isNull() | ~F.col("section").isin(*dropped)).drop("section")


def text_files(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """(doc_id, kind, text): files of a folder and below, `doc_id` being the path; kind is `subtitle`, `wiki` or `markdown` by what stands in the file.

    With `stream`, files that arrive are read once each. Executors read the files, whatever store they are in.
    """
    reader = spark.readStream.schema("value string") if stream else spark.read
    files = reader.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(path)
    files = files.select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))
    wiki = F.col("text").rlike(r"(?m)^\s*==+[^=\n]+==+\s*$")
    return files.select("doc_id", F.when(is_subtitle(F.col("text")), "subtitle").when(wiki, "wiki").otherwise("markdown").alias("kind"), "text")


def file_segments(files: DataFrame) -> DataFrame:
    """(doc_id, kind, seg, section, start, end, text): `text_files` cut into segments by their kind, each by the form that columns of texts have too."""
    of = lambda kind: files.where(F.col("kind") == kind)
    none = lambda t: F.lit(None).cast(t)
    marked = markdown_segments(of("markdown")).select("doc_id", F.lit("markdown").alias("kind"), F.col("seg").cast("long"), "section", none("double").alias("start"), none("double").alias("end"), "text")
    timed = subtitle_segments(of("subtitle")).select("doc_id", F.lit("subtitle").alias("kind"), F.col("seg").cast("long"), none("string").alias("section"), F.col("start").cast("double"), F.col("end").cast("double"), "text")
    lines = wiki_text(of("wiki")).select("doc_id", F.lit("wiki").alias("kind"), F.col("line").cast("long").alias("seg"), none("string").alias("section"), none("double").alias("start"), none("double").alias("end"), "text")
    return marked.unionByName(timed).unionByName(lines)
