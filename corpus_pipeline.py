"""The corpus pipeline: language ID, line dedup, near duplicates, decontamination, SentencePiece.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, all
but the last with the columns of documents.  run() writes each stage's result as Parquet into the
shared folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import DOCUMENT_COLUMNS, pick, stored, table
from quillspark.llm.decontaminate import scan
from quillspark.llm.language_id import UND, fit_documents, language_id
from quillspark.llm.line_dedup import line_dedup
from quillspark.llm.ngram_jaccard import one_of_each
from quillspark.llm.sentencepiece_scan import sentencepiece_decode, sentencepiece_encode

#: A document whose language is less certain is rejected.
LEAST_SCORE = 0.5
#: Shingles of a part of a large group: half of the operator's own, as workers of other stages are still there.
PART = 1 << 19


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without language or of uncertain one; lang becomes the prediction."""
    got = language_id(docs, fit_documents(docs), keep=DOCUMENT_COLUMNS)
    kept = got.where((F.col("lang_pred") != UND) & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.col("lang_pred")).select(*DOCUMENT_COLUMNS)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that too many documents of their source have."""
    got = line_dedup(docs, keep=DOCUMENT_COLUMNS)
    return got.withColumn("n_chars", F.length("text").cast("long")).select(*DOCUMENT_COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: sets of five-word shingles, similarity of 0.8 or more."""
    return one_of_each(docs, DOCUMENT_COLUMNS, width=5, percent=80, most=PART)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark."""
    got = scan(docs, table(spark, sf_dir, "benchmark"), keep=DOCUMENT_COLUMNS)
    return got.where(F.size("runs") == 0).select(*DOCUMENT_COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_ids and whether the ids decode to the text."""
    got = sentencepiece_decode(sentencepiece_encode(docs, keep=("doc_id", "lang", "source", "text")))
    n = F.when(F.col("ids").isNull(), 0).otherwise(F.size("ids")).cast("long")
    return got.select("doc_id", "lang", "source", "ids", n.alias("n_ids"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_boilerplate),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontaminate", decontaminate),
    ("sentencepiece", tokenize),
]

#: SQL cannot express the first and the last stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents."""
    docs = pick(table(spark, sf_dir, "documents"), *DOCUMENT_COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
