"""Tags: raw counts, clusters by similarity, aliases and what a new clustering changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .similarity import classes, closest, similar_links

THRESHOLD, NEAR_DUPLICATE = 0.85, 0.95


def raw_tags(uses: DataFrame) -> DataFrame:
    """source, tag, n and last_seen of uses (source, tag, updated_at)."""
    return uses.groupBy("source", "tag").agg(F.count("*").alias("n"), F.max(F.coalesce("updated_at", F.lit(0))).alias("last_seen"))


def dedupe(raw: DataFrame) -> DataFrame:
    """tag, n and last_seen over all sources."""
    return raw.groupBy("tag").agg(F.sum("n").alias("n"), F.max("last_seen").alias("last_seen"))


def clusters(candidates: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """tag, cluster (its least tag) and canonical (most references, then shortest, then first); candidates: tag, n, embedding."""
    pairs = similar_links(candidates, threshold).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    c = components(pairs, candidates.select(F.col("tag").alias("node"))).select(F.col("node").alias("tag"), F.col("component").alias("cluster"))
    m = c.join(candidates.select("tag", "n"), "tag")
    best = m.groupBy("cluster").agg(F.min_by("tag", F.struct((-F.col("n")).alias("n"), F.octet_length(F.col("tag").cast("string")).alias("len"), "tag")).alias("canonical"))
    return m.join(best, "cluster").select("tag", "cluster", "canonical")


def recluster_diff(new: DataFrame, old: DataFrame, version: str) -> DataFrame:
    """tag and change (new, updated, unchanged or stale) of clusters (tag, canonical, cluster) against a
    snapshot (tag, canonical, cluster, version)."""
    n = new.select("tag", F.col("canonical").alias("c1"), F.col("cluster").alias("k1"))
    o = old.select("tag", F.col("canonical").alias("c0"), F.col("cluster").alias("k0"), F.col("version").alias("v0"), F.lit(True).alias("had"))
    both = n.join(o, "tag", "full_outer")
    changed = ~(F.col("c0").eqNullSafe(F.col("c1")) & F.col("k0").eqNullSafe(F.col("k1")) & F.col("v0").eqNullSafe(F.lit(version)))
    change = F.when(F.col("c1").isNull(), "stale").when(F.col("had").isNull(), "new").when(changed, "updated").otherwise("unchanged")
    return both.select("tag", change.alias("change"))


def alias_counts(aliases: DataFrame) -> DataFrame:
    """space, raw tags, canonicals and clusters."""
    return aliases.groupBy("space").agg(F.count("*").alias("n_raw"), F.countDistinct("canonical").alias("n_canonical"), F.countDistinct("cluster").alias("n_clusters"))


def alias_page(aliases: DataFrame, limit: int, offset: int = 0, canonical: str | None = None) -> DataFrame:
    """A page of aliases in order."""
    a = aliases if canonical is None else aliases.where(F.col("canonical") == canonical)
    return a.orderBy("canonical", "tag").offset(offset).limit(limit)


def expanded_digests(asked: DataFrame, aliases: DataFrame) -> DataFrame:
    """id and tags of asked (id, tag): the SHA-256 of its lower-cased tag with all members of its classes, sorted, each once, with commas.

    aliases: tag, canonical.  Tags of the same classes have one list, which is made once and never copied to each tag.
    """
    a = aliases.where("tag IS NOT NULL AND canonical IS NOT NULL").select("tag", "canonical").distinct()
    of = a.groupBy("tag").agg(F.array_sort(F.collect_set("canonical")).alias("classes"))
    wanted = of.join(asked.select("tag").distinct(), "tag", "left_semi")
    kinds = wanted.select("classes").distinct().select("classes", F.explode("classes").alias("canonical"))
    members = kinds.join(a.select("canonical", F.lower("tag").alias("member")), "canonical").select("classes", "member").distinct()
    lists = members.groupBy("classes").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("member")), ","), 256).alias("tags"))
    digests = wanted.join(lists, "classes").select("tag", "tags")
    return asked.join(digests, "tag", "left").select("id", F.coalesce("tags", F.sha2(F.lower("tag"), 256)).alias("tags"))


def near_duplicates(vectors: DataFrame, threshold: float = NEAR_DUPLICATE) -> DataFrame:
    """id, best (the most similar other one, of equals the first) and cosine of vectors (id, embedding) that another one is close to."""
    apart, copies = closest(vectors, threshold, "id")
    same = classes(vectors, "id").select("id", "first")
    # a vector's further ids have its pairs with other vectors too
    scored = apart.select(F.col("a").alias("first"), F.col("b").alias("other"), "cosine").join(same, "first").select("id", "other", "cosine")
    scored = scored.union(copies.select("b", "a", "cosine")).union(copies.groupBy("a").agg(F.min("b"), F.first("cosine")))
    best = scored.groupBy("id").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "other")).alias("m"))
    return best.select("id", F.col("m.other").alias("best"), (-F.col("m.c")).alias("cosine"))


def alias_map(aliases: DataFrame) -> DataFrame:
    """space and canonical map<tag, canonical>, lower-cased."""
    pairs = F.map_from_entries(F.array_sort(F.collect_set(F.struct(F.lower("tag").alias("tag"), F.lower("canonical").alias("canonical")))))
    first = aliases.withColumn("n", F.row_number().over(Window.partitionBy("space", F.lower("tag")).orderBy("canonical"))).where("n = 1")
    return first.groupBy("space").agg(pairs.alias("canonical"))
