"""Records, blobs and upserts: content addressing, integrity, replacing and merging, latest wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a record's kind allows: embedding, summaries, search.
POLICY = {"document": (True, True, True), "analysis": (True, True, True), "plan": (True, True, True), "summary": (True, True, True), "implementation": (True, False, True), "review": (True, False, True), "custom": (True, False, True), "snapshot": (False, False, False)}


def policy(kind: Column) -> Column:
    """struct<embed, summarize, search>; unknown kinds as custom."""
    out = F.struct(*[F.lit(x).alias(n) for x, n in zip(POLICY["custom"], ("embed", "summarize", "search"), strict=True)])
    for name, flags in POLICY.items():
        out = F.when(kind == name, F.struct(*[F.lit(x).alias(n) for x, n in zip(flags, ("embed", "summarize", "search"), strict=True)])).otherwise(out)
    return out


def record_list(records: DataFrame, tags: DataFrame | None = None, tag: str | None = None, limit: int | None = None, **equal: str) -> DataFrame:
    """Records with the given columns' values and tag, latest first, then by id."""
    out = records
    for name, value in equal.items():
        out = out.where(F.col(name) == value)
    if tag is not None and tags is not None:
        out = out.join(tags.where(F.col("tag") == tag).select("record_id").distinct(), "record_id", "left_semi")
    out = out.orderBy(F.desc("updated_at"), F.asc("record_id"))
    return out.limit(limit) if limit is not None else out


def content_store(blobs: DataFrame, content: str = "content") -> DataFrame:
    """content_hash, content and size, each content once."""
    keyed = blobs.select(F.sha2(F.col(content), 256).alias("content_hash"), F.col(content).alias("content"))
    return keyed.dropDuplicates(["content_hash"]).withColumn("size", F.octet_length("content").cast("long"))


def payload_refs(records: DataFrame) -> DataFrame:
    """content_hash and its references with a payload."""
    return records.where("payload_available = 1").groupBy("content_hash").agg(F.count("*").alias("n_refs"))


def payload_refs_besides(records: DataFrame) -> DataFrame:
    """record_id and the references to its content by other records with a payload."""
    n = payload_refs(records)
    own = F.when(F.col("payload_available") == 1, 1).otherwise(0)
    return records.join(n, "content_hash", "left").select("record_id", (F.coalesce("n_refs", F.lit(0)) - own).cast("long").alias("n_others"))


def integrity(refs: DataFrame, blobs: DataFrame) -> DataFrame:
    """content_hash and state (ok, missing, corrupt, orphan, stale) of references against stored blobs.

    refs: content_hash, payload_available; blobs: content_hash (its name), actual_hash (of its bytes).
    """
    r = refs.groupBy("content_hash").agg(F.max("payload_available").alias("live"))
    both = r.join(blobs.select("content_hash", "actual_hash"), "content_hash", "full_outer")
    there = F.col("actual_hash").isNotNull()
    state = F.when(F.col("live").isNull(), "orphan").when(~there & (F.col("live") == 1), "missing").when(~there, "evicted").when(F.col("live") == 0, "stale").when(F.col("actual_hash") != F.col("content_hash"), "corrupt").otherwise("ok")
    return both.select("content_hash", state.alias("state"))


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by order: an upsert of a log of changes.  Combines before it shuffles."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return best.select(*keys, *[F.col("__row")[c].alias(c) for c in rest])


def replace_groups(old: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """All rows of new, and those of old whose group is not in new."""
    return old.join(new.select(*by).distinct(), by, "left_anti").select(*new.columns).unionByName(new)


def merge_scoped(target: DataFrame, source: DataFrame, key: str, scope: list[str]) -> DataFrame:
    """A merge: source rows update or insert; target rows of the source's scopes that it lacks are deleted."""
    kept = target.join(source.select(key), key, "left_anti").join(source.select(*scope).distinct(), scope, "left_anti")
    return kept.select(*source.columns).unionByName(source)


def upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """A merge without deletion."""
    return target.join(source.select(*keys), keys, "left_anti").select(*source.columns).unionByName(source)


def changes(manifest: DataFrame, scan: DataFrame, version: int) -> DataFrame:
    """path and change (new, changed, unchanged, deleted): a scan (path, hash) against a manifest (path, hash, version)."""
    m = manifest.select("path", F.col("hash").alias("h0"), F.col("version").alias("v0"), F.lit(True).alias("had"))
    both = m.join(scan.select("path", F.col("hash").alias("h1"), F.lit(True).alias("has")), "path", "full_outer")
    same = F.col("h0").eqNullSafe(F.col("h1")) & F.col("v0").eqNullSafe(F.lit(version))
    return both.select("path", F.when(F.col("has").isNull(), "deleted").when(F.col("had").isNull(), "new").when(same, "unchanged").otherwise("changed").alias("change"))


def trusted(summaries: DataFrame, limit: int) -> DataFrame:
    """The first limit trusted or vetted summaries of each space by importance, with position."""
    w = Window.partitionBy("space").orderBy(F.desc("importance"), F.asc("summary_id"))
    return summaries.where(F.col("trust").isin("trusted", "vetted")).withColumn("position", F.row_number().over(w)).where(F.col("position") <= limit)


def job_claim(jobs: DataFrame, now: int, limit: int) -> DataFrame:
    """The first limit jobs that are ready and due, by priority, time and id."""
    return jobs.where((F.col("status") == "ready") & (F.col("scheduled_at") <= now)).orderBy("priority", "scheduled_at", "job_id").limit(limit)


def stuck_jobs(jobs: DataFrame, now: int, after: int) -> DataFrame:
    """Jobs in progress, or pending, that nothing has moved for after seconds."""
    return jobs.where(((F.col("status") == "in_progress") & (F.col("started_at") < now - after)) | ((F.col("status") == "pending") & (F.col("updated_at") < now - after)))


def percentiles(values: DataFrame, by: str, value: str, q: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Nearest-rank percentiles: exact, by counts of values, whose running sums find the ranks."""
    n = values.groupBy(by, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(by).orderBy(value)
    run = n.withColumn("upto", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(Window.partitionBy(by)))
    return run.groupBy(by).agg(*[F.min(F.when(F.col("upto") >= F.ceil(F.col("n") * x), F.col(value))).alias(f"p{round(100 * x)}") for x in q])


def containing(rows: DataFrame, column: str, words: str) -> DataFrame:
    """Rows whose text holds the words, without case of A-Z."""
    low = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return rows.where(F.contains(low(F.col(column)), low(F.lit(words))))


def having_json(rows: DataFrame, column: str, path: str, value: str) -> DataFrame:
    """Rows whose JSON has a value at a path."""
    return rows.where(F.get_json_object(column, path) == value)


def expire(lods: DataFrame, now_iso: str) -> DataFrame:
    """Levels of detail that have not expired; times are RFC 3339 texts of one zone."""
    return lods.where(F.col("expires_at").isNull() | (F.col("expires_at") >= now_iso))
