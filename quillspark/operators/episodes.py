"""Episodic memory: consolidation by gaps in time, scope summaries, polls of what is stale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import trim

#: Gaps in seconds: of the tool, and of the sweep.
TOOL_GAP, SWEEP_GAP = 3600, 7200


def sessionize(rows: DataFrame, gap: int, by: str | list[str], at: str = "created_at", key: str = "summary_id") -> DataFrame:
    """Adds cluster, counted from a group's first: a new one where more than gap seconds have passed."""
    w = Window.partitionBy(by).orderBy(at, key)
    new = F.coalesce((F.col(at) - F.lag(at).over(w) > gap).cast("int"), F.lit(0))
    return rows.withColumn("__new", new).withColumn("cluster", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def consolidate(rows: DataFrame, gap: int = TOOL_GAP, by: str = "space", at: str = "created_at", key: str = "summary_id") -> DataFrame:
    """by, first_at, last_at, n and newest (position of the cluster, newest first).

    Rows are clustered within stretches of time first, so that a hot group is many tasks; what then
    meets by group are clusters, which join across the stretches' bounds.
    """
    stretch = F.floor(F.col(at) / max(86_400, 8 * gap))
    parts = sessionize(rows.withColumn("__stretch", stretch), gap, [by, "__stretch"], at, key)
    parts = parts.groupBy(by, "__stretch", "cluster").agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count("*").alias("n")).drop("__stretch", "cluster")
    w = Window.partitionBy(by).orderBy("first_at", "last_at")
    new = F.coalesce((F.col("first_at") - F.lag("last_at").over(w) > gap).cast("int"), F.lit(0))
    whole = parts.withColumn("__new", new).withColumn("cluster", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    c = whole.groupBy(by, "cluster").agg(F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.sum("n").alias("n"))
    return c.withColumn("newest", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("first_at")))).drop("cluster")


def head_or_all(s: Column, n_bytes: int = 200) -> Column:
    """The first n bytes; the whole text if it is shorter or the cut would split a character."""
    latin = F.decode(F.substring(F.encode(s, "UTF-8"), n_bytes + 1, 1), "ISO-8859-1")
    begins = ~latin.rlike("[\\x{80}-\\x{BF}]")
    chars = F.length(F.regexp_replace(F.decode(F.substring(F.encode(s, "UTF-8"), 1, n_bytes), "ISO-8859-1"), "[\\x{80}-\\x{BF}]", ""))
    return F.when((F.octet_length(s) <= n_bytes) | ~begins, s).otherwise(F.left(s, chars))


def scope_summaries(sources: DataFrame) -> DataFrame:
    """scope, content (heads of 200 bytes, a line each), source_hash and n of sources (scope, sort, source_id, content).

    Heads and hashes of a scope's sources are gathered in order, for a summary holds all heads; whole
    contents are not: the hash is that of their hashes.
    """
    short = sources.select("scope", "sort", "source_id", head_or_all(F.col("content")).alias("head"), F.sha2("content", 256).alias("hash"))
    out = short.groupBy("scope").agg(F.sort_array(F.collect_list(F.struct("sort", "source_id", "head", "hash"))).alias("rows"))
    text = F.array_join(F.transform("rows", lambda r: r["head"]), "\n")
    whole = F.array_join(F.transform("rows", lambda r: r["hash"]), "\n")
    return out.select("scope", text.alias("content"), F.sha2(whole, 256).alias("source_hash"), F.size("rows").cast("long").alias("n"))


def directory_sources(chunks: DataFrame, files: DataFrame, depth: int = 1) -> DataFrame:
    """Sources of each directory of depth parts: chunks (file_id, chunk_ord, chunk_id, content), files (file_id, path)."""
    f = files.select("file_id", "path", F.substring_index("path", "/", depth).alias("scope"))
    return chunks.join(f, "file_id").select("scope", F.struct("path", "chunk_ord").alias("sort"), F.col("chunk_id").alias("source_id"), "content")


def tag_sources(summaries: DataFrame, records: DataFrame, tags: DataFrame) -> DataFrame:
    """Sources of each tag (tag): summaries whose tags (JSON) hold it, and active records that carry it.

    summaries: summary_id, tags (JSON), content, created_at; records: record_id, tag, kind, status, content, created_at.
    """
    names = tags.select("tag").distinct()
    listed = summaries.withColumn("tag", F.explode(F.array_distinct(F.from_json("tags", "array<string>"))))
    episodes = listed.join(names, "tag", "left_semi").select(F.col("tag").alias("scope"), F.col("created_at").alias("sort"), F.col("summary_id").alias("source_id"), "content")
    kinds = ("document", "analysis", "plan", "summary")
    own = records.where(F.col("kind").isin(*kinds) & (F.col("status") == "active")).join(names, "tag", "left_semi").select(F.col("tag").alias("scope"), F.col("created_at").alias("sort"), F.concat(F.lit("record:"), "record_id").alias("source_id"), "content")
    return episodes.unionByName(own)


def recent(rows: DataFrame, k: int, by: str = "space", at: str = "created_at", key: str = "summary_id") -> DataFrame:
    """The newest k of each group, with position."""
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(at), F.asc(key)))).where(F.col("position") <= k)


def unconsolidated(rows: DataFrame) -> DataFrame:
    return rows.where("consolidated_by IS NULL")


def stale_for_embedding(rows: DataFrame, updated: str = "updated_at", embedded: str = "embedded_at") -> DataFrame:
    """Rows changed since their embedding, or without one."""
    return rows.where(F.col(embedded).isNull() | (F.col(updated) > F.coalesce(F.col(embedded), F.lit(0))))


def lacking_summary(chunks: DataFrame, summaries: DataFrame, summarizer: str) -> DataFrame:
    """Chunks without a summary by a summarizer."""
    have = summaries.where(F.col("summarizer") == summarizer).select("chunk_id")
    return chunks.join(have, "chunk_id", "left_anti")


def latest_summary(summaries: DataFrame) -> DataFrame:
    """chunk_id and its latest summary."""
    return summaries.groupBy("chunk_id").agg(F.max_by("content", F.struct("updated_at", "summary_id")).alias("content"))


def thread_text(turns: DataFrame, by: str = "conv_id", at: str = "turn") -> DataFrame:
    """One text for each thread, its turns in order."""
    rows = F.sort_array(F.collect_list(F.struct(at, "role", "text")))
    return turns.groupBy(by).agg(rows.alias("r")).select(by, F.array_join(F.transform("r", lambda x: F.concat(F.coalesce(x["role"], F.lit("")), F.lit(": "), trim(F.coalesce(x["text"], F.lit(""))))), "\n").alias("thread"), F.size("r").cast("long").alias("n_turns"))


def reflect(episodes: DataFrame, results: DataFrame, budget: int, n: int = 10, k: int = 5) -> DataFrame:
    """What a reflection works on: the newest n episodes, and search results packed into half the budget."""
    from .retrieval import pack

    e = recent(episodes, n).select(F.lit("episode").alias("part"), F.col("position").cast("long").alias("position"), F.col("summary_id").cast("string").alias("id"))
    r = pack(results, budget // 2, k).select(F.lit("result").alias("part"), (F.col("slot") + 1).cast("long").alias("position"), F.col("chunk_id").cast("string").alias("id"))
    return e.unionByName(r)
