"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

A document is kept if it passes the base rules and every row of the threshold table.  Texts are
judged whole.  Null texts count as empty: they have no words, fail the base rule on the number of
words and are dropped (kept = false).  Each input row gives one output row, repeated rows included;
other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, pick

SYMBOLS = "#*$%&|<>"
#: Function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in a is that for it on with as was be by this are or from at "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine auch "
    "de la le et les du en un une que qui dans pour par sur au pas est avec "
    "el los las del y se por con una su para al lo como más esta"
).split()


#: Also at the start of a sentence.
STOP_FORMS = STOP_WORDS + [w.capitalize() for w in STOP_WORDS]


@dataclass(frozen=True)
class Rule:
    """A measure must lie within [low, high]; it is asked only of texts of at least min_words words."""

    measure: str
    low: float | None = None
    high: float | None = None
    min_words: int = 0


#: The threshold table.
RULES = (
    Rule("mean_word_chars", 2.0, 16.0),
    Rule("symbol_ratio", None, 0.3),
    Rule("shout_ratio", None, 0.3),
    Rule("stop_word_ratio", 0.02, None, min_words=50),
    Rule("dup_line_ratio", None, 0.5),
    Rule("repeat_word_ratio", None, 0.2),
)


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row."""
    return F.transform(F.array(value), body)[0]


def n_repeat_words(words: Column, width: int = 5) -> Column:
    """The words that lie in windows of width words which occur at least twice in the text."""

    def hashes(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        hit = let(pairs, lambda s: F.transform(F.filter(s, lambda x, k: F.get(s, k - 1)["h"].eqNullSafe(x["h"]) | F.get(s, k + 1)["h"].eqNullSafe(x["h"])), lambda x: x["i"]))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-width).alias("last"))
        total = F.aggregate(F.sort_array(hit), start, lambda a, p: F.struct((a["n"] + F.least(F.lit(width), p - a["last"])).alias("n"), p.alias("last")))
        return total["n"]

    return F.when(F.size(words) <= width, F.lit(0).cast("long")).otherwise(let(hashes(words), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h))))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and the counts from which all measures follow."""
    d = pick(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    trimmed = F.btrim(F.col("text"), F.lit(WHITE))
    words = F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split(F.col("text"), "\n"), lambda x: F.length(F.translate(x, WHITE, "")) > 0)
    of_words = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), n_repeat_words(w).alias("n_repeat_words"), F.size(F.filter(w, lambda x: x.isin(STOP_FORMS))).cast("long").alias("n_stop_words")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    counted = d.select("doc_id", "text", of_words.alias("w"), of_lines.alias("l"))
    return counted.select(
        "doc_id",
        "w.*",
        "l.*",
        F.length(F.translate("text", WHITE, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length("text") - F.length(F.translate("text", "!", ""))).cast("long").alias("n_shouts"),
    )


def compiled(rules: tuple[Rule, ...] = RULES) -> Column:
    """The threshold table as one boolean expression over the columns of measures()."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    named = {
        "mean_word_chars": F.col("word_chars") / words,
        "symbol_ratio": F.col("n_symbols") / words,
        "shout_ratio": F.col("n_shouts") / words,
        "stop_word_ratio": F.col("n_stop_words") / words,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_word_ratio": F.col("n_repeat_words") / words,
    }
    verdict = F.lit(True)
    for r in rules:
        ok = F.lit(True)
        if r.low is not None:
            ok = ok & (named[r.measure] >= r.low)
        if r.high is not None:
            ok = ok & (named[r.measure] <= r.high)
        verdict = verdict & ((F.col("n_words") < r.min_words) | ok)
    return verdict


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_stop_words."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return measures(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & compiled(rules)).alias("kept"), "n_stop_words")
