"""The queries of the training-data operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, sql, toxicity, url_filter
from .common import pick, table
from .filter_audit import filter_audit
from .html_density import html_extract
from .language_id import fit_documents, held_out, language_id
from .line_dedup import line_dedup
from .ngram_jaccard import ngram_jaccard
from .periodic_runs import periodic_runs
from .quality_rules import quality_rules
from .secret_scan import digest, secret_scan
from .sentencepiece_scan import sentencepiece_decode, sentencepiece_encode
from .substring_dedup import substring_dedup


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every URL of pages: host, path, rule and verdict; the trees learn from URLs that the rules decide."""
    pages = table(spark, sf_dir, "pages")
    return url_filter.url_filter(pages, url_filter.fit_by_rules(pages))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents without the boilerplate lines of their source."""
    return line_dedup(table(spark, sf_dir, "documents"), host="source")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    got = language_id(docs, fit_documents(docs))
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document, and whether they decode to its text."""
    ids = sentencepiece_encode(table(spark, sf_dir, "documents"))
    decoded = sentencepiece_decode(ids)
    n = F.when(F.col("ids").isNull(), 0).otherwise(F.size("ids")).cast("long")
    return decoded.select("doc_id", "ids", n.alias("n_ids"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_extract(table(spark, sf_dir, "pages"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document, learnt from labels."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document by 3-word shingles, Jaccard 0.9."""
    return ngram_jaccard(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    return decontaminate.digest(decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of documents."""
    return digest(secret_scan(table(spark, sf_dir, "documents")))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    return quality_rules(table(spark, sf_dir, "documents"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the windows of 20 words that also start earlier."""
    got = substring_dedup(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def repeated_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text; in one text of ten (by h = crc32 of the id) the words from n mod g on (g = h div 10) repeat with
    period 1 + (n - a) div (3 + g mod 8), a being where they begin."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    d = pick(docs, "doc_id", "text").withColumn("h", h)
    words = F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)")))
    d = d.withColumn("w", words).withColumn("n", F.size("w").cast("long")).withColumn("g", F.expr("h div 10"))
    d = d.withColumn("a", F.expr("if(n > 0, g % n, 0)")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    tail = F.expr("array_join(transform(w, (x, i) -> if(i < a, x, w[cast(a + (i - a) % p AS INT)])), ' ')")
    return d.select("doc_id", F.when(F.col("n") > 0, tail).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words in every document, one in ten of which is given a repeated tail."""
    got = periodic_runs(repeated_tails(table(spark, sf_dir, "documents")))
    best = F.expr("array_max(transform(runs, r -> named_struct('length', r.length, 'start', -r.start, 'period', -r.period)))")
    listed = F.expr("concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')))")
    start, length, period = -F.col("best.start"), F.col("best.length"), -F.col("best.period")
    return got.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        start.alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove in all their orders, by source."""
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_line_dedup": op2_line_dedup,
    "op3_language_id": op3_language_id,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_html_extract": op5_html_extract,
    "op6_toxicity": op6_toxicity,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_decontaminate": op8_decontaminate,
    "op9_secret_scan": op9_secret_scan,
    "op10_quality_rules": op10_quality_rules,
    "op11_substring_dedup": op11_substring_dedup,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE_SQL: dict[str, str] = dict(sql.ORACLE_SQL)
