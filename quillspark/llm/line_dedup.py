"""Line dedup by site-relative frequency, on DataFrame functions alone.

Pages are grouped by host; for each line, the pages of the host that contain it are divided by all
pages of the host, and lines above the ratio are dropped from the host's pages.  Lines compare
without the white space around them; blank lines are never counted or dropped.  A line must also be
on ``min_pages`` pages of the host, and (with ``differing``) these pages must have two different texts
at least, so that single pages and exact copies alone make no boilerplate; beyond that the ratio
decides, whatever a host's size.

Near copies are no independent pages, and would strip each other of all that they share.  So lines are
counted twice: first on all pages, which gives the lines in question; then on the pages of which these
are no more than half of the lines, as are other pages of a site but not near copies of one.  A line
goes if it passes in both counts, each with its own pages.  Only where most of a page's lines are on
over half of its host's pages, and those are ``many`` at least, they count without that: such a host
has pages of next to nothing but boilerplate.

The counts are taken on 128-bit hashes of the lines, each at most once a page, so that neither texts
nor groups of pages are gathered.  A host has at most (mean lines of a page) / ratio such lines, so a
host's drop list is short whatever its number of pages.  The lists of all hosts are written to the
shared folder, whose size decides how they reach the pages: broadcast below Spark's broadcast
threshold, else a sort-merge join by host in which AQE splits a hot host.

Null texts stay null and have no lines.  Pages without host (null) are left as they are.  Repeated
rows count as pages of their own.  No page is dropped: one that loses all lines keeps an empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, pick, stored

#: The ratio lies within the gap between lines that all hosts share (8.6 % of the pages and more) and
#: those that also repeat by chance (4.8 % and less), as measured on 10,000 documents of 20 hosts.
RATIO, MIN_PAGES = 0.06, 2
#: A line on over half of a host's pages, and on so many, counts whatever else is on them.
MANY = 10


def _trim(line: Column) -> Column:
    return F.btrim(line, F.lit(WHITE))


def _key(line: Column) -> Column:
    """128 bits of a line, as a text: Spark keeps sets of texts by hash, but those of structs by comparing all pairs."""
    return F.concat_ws("_", F.xxhash64(line), F.xxhash64(F.lit("line"), line))


def _lines(text: str) -> Column:
    """The different lines of a text with other than white space, by their hashes."""
    trimmed = F.transform(F.split(text, "\n"), _trim)
    return F.array_distinct(F.transform(F.filter(trimmed, lambda x: x != ""), _key))


def _passing(counts: DataFrame, totals: DataFrame, ratio: float, min_pages: int, differing: bool) -> DataFrame:
    """Lines on min_pages pages and above the ratio; counts: host, line, n_pages, apart; totals: host, n_host."""
    counts = counts.where(F.col("n_pages") >= min_pages)
    counts = counts.where("apart") if differing else counts
    return counts.join(totals, "host").where(F.col("n_pages") > ratio * F.col("n_host"))


def boilerplate(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, differing: bool = True, many: int = MANY) -> DataFrame:
    """host and drop array<string>: the hashes of the lines to drop; pages: host, text."""
    p = pages.where("host IS NOT NULL").select("host", _lines("text").alias("lines"), F.xxhash64("text").alias("whole"))
    measures = [F.count("*").alias("n_pages"), (F.min("whole") < F.max("whole")).alias("apart")]
    totals = p.groupBy("host").agg(F.count("*").alias("n_host"))
    counts = p.select("host", "whole", F.explode("lines").alias("line")).groupBy("host", "line").agg(*measures)
    first = stored(_passing(counts, totals, ratio, min_pages, differing), "lines-in-question")
    asked = first.groupBy("host").agg(F.collect_list("line").alias("asked"))
    alone = p.join(asked, "host").withColumn("shared", F.array_intersect("lines", "asked")).where(2 * F.size("shared") <= F.size("lines"))
    # a row without line for each page
    rows = alone.select("host", "whole", F.explode(F.concat("shared", F.array(F.lit(None).cast("string")))).alias("line"))
    again = stored(rows.groupBy("host", "line").agg(*measures), "lines-again")
    second = _passing(again.where("line IS NOT NULL"), again.where("line IS NULL").select("host", F.col("n_pages").alias("n_host")), ratio, min_pages, differing)
    everywhere = first.where((2 * F.col("n_pages") > F.col("n_host")) & (F.col("n_pages") >= many))
    return second.select("host", "line").union(everywhere.select("host", "line")).distinct().groupBy("host").agg(F.collect_list("line").alias("drop"))


def line_dedup(docs: DataFrame, host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES, keep: tuple[str, ...] = ("doc_id",), differing: bool = True) -> DataFrame:
    """The columns of keep, host, text without boilerplate lines, n_lines (with other than white space) and n_dropped."""
    names = [c for c in dict.fromkeys((*keep, host, "text"))]
    d = pick(docs, *names).withColumn("__host", F.col(host))
    drop = stored(boilerplate(d.select(F.col(host).alias("host"), "text"), ratio, min_pages, differing), "boilerplate").withColumnRenamed("host", "__host")
    lines = F.split("text", "\n")
    hits = F.array_intersect(_lines("text"), "__drop")
    kept = F.when(F.size("__hits") == 0, F.col("__lines")).otherwise(F.filter("__lines", lambda x: ~F.array_contains("__hits", _key(_trim(x)))))
    d = d.join(drop.withColumnRenamed("drop", "__drop"), "__host", "left").withColumns({"__lines": lines, "__hits": hits})
    kept = F.when(F.col("__drop").isNull(), F.col("__lines")).otherwise(kept)
    d = d.withColumn("__kept", kept)
    solid = F.size(F.filter("__lines", lambda x: _trim(x) != ""))
    dropped = F.size("__lines") - F.size("__kept")
    out = [c for c in names if c not in ("text",)]
    return d.select(
        *out,
        F.when(F.col("text").isNull(), F.lit(None).cast("string")).when(dropped == 0, F.col("text")).otherwise(F.array_join("__kept", "\n")).alias("text"),
        F.when(F.col("text").isNull(), F.lit(0).cast("long")).otherwise(solid.cast("long")).alias("n_lines"),
        F.when(F.col("text").isNull(), F.lit(0).cast("long")).otherwise(dropped.cast("long")).alias("n_dropped"),
    )
