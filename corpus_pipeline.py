"""Corpus pipeline: the stages that turn `documents` into packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; all but the last return the
columns of their input, also columns beyond those of documents and whatever their names. `n_chars` follows the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.llm import language, packing, pii, simhash, substrings
from citeweave.llm.common import materialize, table

#: A prediction below this won no majority among the pairs of languages.
MIN_SCORE = 0.5


def _numbered(docs: DataFrame) -> DataFrame:
    """Columns by number, so that no name clashes with what a stage adds."""
    return docs.toDF(*(f"_c{k}" for k in range(len(docs.columns))))


def _number(docs: DataFrame, name: str) -> str:
    return f"_c{docs.columns.index(name)}"


def _named(df: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of `docs` by their names again, some of them changed."""
    return df.select(*(changed.get(c, F.col(f"_c{k}")).alias(c) for k, c in enumerate(docs.columns)))


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter or without a clear language; a missing `lang` is filled in.

    Null and empty texts have no letter and go; so does a prediction with a score below `MIN_SCORE`. Very long texts are
    read whole; repeated rows are judged alike; of tied languages the model takes the first by name; a null doc_id does
    not matter; without any label to learn from every document is without a language and goes; an empty table stays empty.
    """
    model = language.train(docs.where(~language.held_out(F.col("doc_id"))))
    known = language.identify(_numbered(docs), model, _number(docs, "text")).where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= MIN_SCORE))
    return _named(known, docs, lang=F.coalesce(_number(docs, "lang"), "lang_pred"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near copies.

    Null, empty and wordless texts are copies of one another; very long texts are fingerprinted whole; repeated rows of
    one doc_id are one document, which stays or goes as a whole; rows with a null doc_id stay; an empty table stays empty.
    """
    return simhash.drop_near_duplicates(docs).select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes passages of 50 words and more out of all documents but the first that has them; rows stay.

    A null text stays null and an empty one empty; very long texts are taken in pieces that overlap; rows of one doc_id
    never remove from one another, and rows with a null doc_id keep all; an empty table stays empty.
    """
    return _measured(substrings.remove_recurring(docs))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by pseudonyms of the same format, with the session's key.

    A null text stays null and an empty one empty; very long texts take time in proportion to their length; repeated
    rows are changed alike; where formats overlap the earlier start wins; an empty table stays empty.
    """
    return _measured(_named(pii.with_pseudonyms(_numbered(docs), pii.session_key(spark), _number(docs, "text")), docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 2048 tokens.

    A null or empty text is a document of the end token alone; longer ones than a sequence are cut; repeated rows are
    packed each; pieces of one length are placed in order of doc_id; an empty table gives an empty table.
    """
    return packing.pack(docs, together=400, remember=50_000)  # executors hold what earlier stages left, too


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("pii", pseudonyms),
    ("packing", packed),
]

#: Language models, automata and tokenizers have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
