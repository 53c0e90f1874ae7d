"""A corpus pipeline of five stages over ``documents``; each stage's rows are written and read again for the next.

All stages but the last return the columns of their input, whatever else it has beside ``doc_id``, ``text`` and ``lang``, and whatever
those are called; an empty table passes through all of them.  Ids may be null or repeated: rows are never told apart
by them alone.  Texts are read whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import common, decontaminate, langid, pieces, pii, similar

#: a document's least language score, and the share of benchmark words above which it goes as a whole
LEAST_SCORE, MOST_COVERED = 0.5, 0.5
#: words of a shingle, and the share of shingles in common from which documents are near copies
SHINGLE_WORDS, LEAST_SIMILARITY = 5, 0.8


def _with_text(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The carried rows with their cleaned texts, in the columns of ``docs``; rows whose text is null or unchanged stay as they are."""
    made = {"text": F.col("clean_text"), "n_chars": F.char_length("clean_text")}
    kinds = {f.name: f.dataType for f in docs.schema}
    return found.select(*[F.when(F.col("row.text").isNull() | (F.col("row.text") == F.col("clean_text")), F.col(f"row.{c}")).otherwise(made[c].cast(kinds[c])).alias(c) if c in made else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; a missing label is set.

    Null and empty texts, and those without a letter, go; repeated rows are judged alike; without any label all rows go.
    """
    model = langid.train(docs.select("doc_id", "text", "lang"))
    return langid.accepted(docs, model, LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Rows without an id take part and stay where no row of their group has one; different texts under one id are judged each by
    itself; of repeated rows one stays; null and empty texts are one group.
    """
    return similar.distinct_texts(docs, SHINGLE_WORDS, LEAST_SIMILARITY)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words inside benchmark passages; those mostly made of them go.

    Null and empty texts stay as they are, repeated rows are treated alike, and an empty benchmark changes nothing.
    """
    found = decontaminate.contaminated_spans(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), clean=True, carry=True)
    return _with_text(found.where(F.col("n_hit") <= MOST_COVERED * F.col("n_words")), docs)


def sanitised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data, and the terms that reveal it, generalised.

    Every row stays; null and empty texts, and texts without personal data, stay as they are; repeated rows are treated alike.
    """
    return _with_text(pii.find(docs, clean=True, carry=True), docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with begin and end, and the text that they decode to.

    Every row gives one; null and empty texts are begin and end alone; other columns are left out.
    """
    return pieces.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminated", decontaminated),
    ("sanitised", sanitised),
    ("encoded", encoded),
]

#: Encoding, near-copy components and automata are no matter for SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written to the shared folder and read again; what a stage has put there besides is removed after it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    begun = len(common.MADE)
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        common.sweep(spark, begun, keep=(common.MADE[-1],))
    return docs
