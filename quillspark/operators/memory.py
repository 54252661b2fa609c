"""Summaries, records, levels of detail and aliases as stored rows: searching, polling, counting, committing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stemming import stems
from ..functions.text import trim
from ..session import cut
from .records import upsert
from .retrieval import CANDIDATES, bm25

#: Rows of a poll, and of a search for records; results that such a search asks for, as a multiple.
POLL, RECORDS, OVER = 256, 100, 3
EMBEDDED_KINDS = ("episode", "reflection", "procedure")
TRUSTED = ("trusted", "vetted")


def bodies(summaries: DataFrame) -> DataFrame:
    """summary_id and body, what searches read; summaries: summary_id, title, content."""
    return summaries.select("summary_id", F.concat_ws(" ", "title", "content").alias("body"))


def summary_search(summaries: DataFrame, queries: DataFrame, k: int = CANDIDATES, index=None) -> DataFrame:
    """query_id, summary_id, bm25 and rank over stems of titles and contents; index: a stored one of these bodies by stems."""
    texts = bodies(summaries)
    if index is not None:
        return index.search(queries, k, texts=texts)
    return bm25(texts, queries, key="summary_id", text="body", k=k, stem=stems)


def trusted_by_text(summaries: DataFrame, queries: DataFrame, k: int = CANDIDATES, index=None) -> DataFrame:
    """query_id, summary_id and position: of the best k by text those that are trusted or vetted, by importance."""
    found = summary_search(summaries, queries, k, index).join(summaries.where(F.col("trust").isin(*TRUSTED)).select("summary_id", "importance"), "summary_id")
    return found.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("importance"), "summary_id"))).select("query_id", "summary_id", "position")


def trusted_by_tag(summaries: DataFrame, tag: str, k: int, by: str = "space") -> DataFrame:
    """The first k trusted or vetted summaries of each space with a tag (tags: array), by importance, with position."""
    w = Window.partitionBy(by).orderBy(F.desc("importance"), "summary_id")
    return summaries.where(F.col("trust").isin(*TRUSTED) & F.array_contains("tags", tag)).withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)


def record_search(ranked: DataFrame, k: int) -> DataFrame:
    """Of each query's first 3 k results (k: 100 at most) the first k that are records, with position; ranked: query_id, kind, rank."""
    k = min(k, RECORDS)
    w = Window.partitionBy("query_id").orderBy("rank")
    return ranked.where((F.col("rank") <= OVER * k) & (F.col("kind") == "record")).withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)


def stale_summaries(summaries: DataFrame, limit: int | None = POLL) -> DataFrame:
    """Episodes, reflections and procedures changed since their embedding, the first of them by id."""
    out = summaries.where(F.col("kind").isin(*EMBEDDED_KINDS) & (F.col("updated_at") > F.coalesce("embedded_at", F.lit(0))))
    return out.orderBy("summary_id").limit(limit) if limit else out


def stale_records(records: DataFrame, limit: int | None = POLL) -> DataFrame:
    """Searchable active records changed since their embedding, the first of them by id."""
    out = records.where((F.col("searchable") == 1) & (F.col("status") == "active") & (F.col("updated_at") > F.coalesce("embedded_at", F.lit(0))))
    return out.orderBy("record_id").limit(limit) if limit else out


def stale_chunks(chunks: DataFrame, files: DataFrame, limit: int | None = POLL) -> DataFrame:
    """Chunks without embedding, with their file's path where there is one, the first of them by id."""
    out = chunks.where("embedded_at IS NULL").join(files.select("file_id", "path"), "file_id", "left")
    return out.orderBy("chunk_id").limit(limit) if limit else out


def stale_scopes(scopes: DataFrame, limit: int) -> DataFrame:
    """Scope summaries marked stale, oldest first; scopes: scope, stale, generated_at."""
    return scopes.where("stale = 1").orderBy("generated_at", "scope").limit(limit)


def apply_aliases(aliases: DataFrame, upserts: DataFrame, stale: DataFrame) -> DataFrame:
    """Aliases after a run: its rows update or insert by space and tag, its stale tags (space, tag) go."""
    return upsert(aliases, upserts, ["space", "tag"]).join(stale.select("space", "tag").distinct(), ["space", "tag"], "left_anti")


def lod_counts(lods: DataFrame) -> DataFrame:
    """space, lod_level (null: all) and n."""
    return lods.rollup("space", "lod_level").agg(F.count("*").alias("n")).where("space IS NOT NULL")


def index_consistency(rows: DataFrame, indexed: DataFrame, key: str) -> DataFrame:
    """One row: numbers of rows and of indexed ones, of rows that are not indexed, and of indexed ones without row."""
    both = rows.select(key, F.lit(1).alias("a")).join(indexed.select(key, F.lit(1).alias("b")), key, "full_outer")
    return both.agg(F.count("a").alias("n_rows"), F.count("b").alias("n_indexed"), F.count_if(F.col("b").isNull()).alias("n_missing"), F.count_if(F.col("a").isNull()).alias("n_orphans"))


def store_reflection(summaries: DataFrame, reflections: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """Summaries with new reflections, and reflection_id and source_id of their sources.

    reflections: summary_id, space, title, content, tags (array), importance, source_ids (array).
    """
    new = reflections.withColumns({"kind": F.lit("reflection"), "created_at": F.lit(now).cast("bigint"), "updated_at": F.lit(now).cast("bigint")})
    links = reflections.select(F.col("summary_id").alias("reflection_id"), F.explode(F.array_distinct("source_ids")).alias("source_id"))
    return summaries.unionByName(new.drop("source_ids"), allowMissingColumns=True), links


def short_ids(rows: DataFrame, key: str, hashed: Column, order: str, least: int = 3) -> DataFrame:
    """key and short_id: in order, each row takes the shortest prefix of its hash, of least characters at
    least, that no row before it has taken; the whole hash if all are.

    By length: of the rows still without id that share a prefix, the first takes it.  With n rows this
    takes about log16(n) rounds after the first, each over the rows that are left.
    """
    left = cut(rows.select(key, hashed.alias("__h"), F.col(order).alias("__o")))
    done, n, longest = None, least, left.agg(F.max(F.length("__h"))).first()[0] or 0
    while n <= max(longest, least) and not left.isEmpty():
        at = F.left("__h", F.lit(n))
        first = left.groupBy(at.alias("p")).agg(F.min(F.struct("__o", key)).alias("f")).select("p", F.col(f"f.{key}").alias(key))
        done = first.select(key, F.col("p").alias("short_id")) if done is None else done.union(first.select(key, F.col("p").alias("short_id")))
        done = cut(done)
        left = cut(left.join(done, key, "left_anti"))
        n += 1
    rest = left.select(key, F.col("__h").alias("short_id"))
    return rest if done is None else done.union(rest)


def display_ids(tasks: DataFrame, edges: DataFrame, short: DataFrame, prefix: str) -> DataFrame:
    """task_id and display: prefix-short id, or for a child its parent's with its number in the family after a stop."""
    own = short.select("task_id", F.concat(F.lit(f"{prefix}-"), "short_id").alias("own"))
    parents = edges.where("edge_kind = 'parent_of'").groupBy(F.col("to_id").alias("task_id")).agg(F.min("from_id").alias("parent_id"))
    t = tasks.select("task_id", "child_seq").join(own, "task_id").join(parents, "task_id", "left").join(own.select(F.col("task_id").alias("parent_id"), F.col("own").alias("up")), "parent_id", "left")
    child = F.concat("up", F.lit("."), F.col("child_seq").cast("string"))
    return t.select("task_id", F.coalesce(child, "own").alias("display"))


def document_capsules(sections: DataFrame, titles: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """key and capsule: title — first sentence — Sections: headings of the first two levels, whichever are there.

    sections: key, ord, heading_path, content; titles: key, title of front matters, which go before the first heading.
    A sentence ends at the first '. '; a text that ends in a full stop is one; else it is the first line or 200 bytes.
    """
    from ..functions.text import stub_sentence

    leaf = trim(F.regexp_replace(F.element_at(F.split("heading_path", " > "), -1), "^#+", ""))
    headed = F.col("heading_path") != ""
    s = sections.withColumns({"leaf": leaf, "said": F.when(trim(F.col("content")) != "", stub_sentence(F.col("content")))})
    at = F.struct("ord")
    out = s.groupBy(key).agg(
        F.min_by("leaf", F.when(headed, at)).alias("head"),
        F.min_by("said", F.when(F.coalesce("said", F.lit("")) != "", at)).alias("said"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(headed & (F.size(F.split("heading_path", " > ")) <= 2), F.struct("ord", "leaf")))), lambda x: x["leaf"]), ", ").alias("outline"),
    )
    if titles is not None:
        out = out.join(titles.select(key, F.col("title").alias("own")), key, "left").withColumn("head", F.coalesce("own", "head"))
    outline = F.when(F.col("outline") != "", F.concat(F.lit("Sections: "), "outline"))
    return out.select(key, F.concat_ws(" — ", "head", "said", outline).alias("capsule"))
