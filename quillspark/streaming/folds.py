"""Event folds, each as a batch over a log and as a stream with the same result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of a task that events set, and which event types carry them.
FIELDS = {"title": "string", "description": "string", "priority": "int", "due_ts": "bigint", "task_type": "string", "assignee": "string", "defer_until": "bigint", "blocked_reason": "string"}


def _get(name: str, kind: str = "string") -> Column:
    return F.get_json_object("payload", f"$.{name}").cast(kind)


def fold_tasks(events: DataFrame, order: tuple[str, ...] = ("timestamp", "event_id")) -> DataFrame:
    """task_id with status and fields after all events; tasks without a created event do not exist.

    Last write wins for each field by itself: one aggregate, which combines before the shuffle.
    events: event_id, task_id, timestamp, event_type, payload (JSON).
    """
    at = F.struct(*order)
    sets = F.col("event_type").isin("task_created", "task_updated")
    last = lambda c: F.max_by(c, F.when(c.isNotNull(), at))
    cols = [last(F.when(sets, _get(n, k))).alias(n) for n, k in FIELDS.items()]
    status = F.when(F.col("event_type") == "status_changed", _get("new_status")).when(F.col("event_type") == "task_created", F.coalesce(_get("status"), F.lit("open")))
    made = F.min(F.when(F.col("event_type") == "task_created", F.col("timestamp")))
    out = events.groupBy("task_id").agg(*cols, last(status).alias("status"), made.alias("created_at"), F.max("timestamp").alias("updated_at"))
    return out.where("created_at IS NOT NULL").withColumn("priority", F.coalesce("priority", F.lit(4))).withColumn("task_type", F.coalesce("task_type", F.lit("task")))


def fold_pairs(events: DataFrame, added: str, removed: str, field: str, name: str, order: tuple[str, ...] = ("timestamp", "event_id")) -> DataFrame:
    """task_id and name: pairs whose last event added them (labels, dependencies, notes)."""
    e = events.where(F.col("event_type").isin(added, removed)).withColumn(name, _get(field))
    last = e.groupBy("task_id", name).agg(F.max_by("event_type", F.struct(*order)).alias("t"))
    return last.where(F.col("t") == added).select("task_id", name)


def fold_parents(events: DataFrame, order: tuple[str, ...] = ("timestamp", "event_id")) -> DataFrame:
    """task_id and parent_id as last set; a cleared parent has no row."""
    e = events.where(F.col("event_type").isin("task_created", "parent_set")).withColumn("parent_id", _get("parent_task_id"))
    e = e.where("event_type = 'parent_set' OR parent_id IS NOT NULL")
    return e.groupBy("task_id").agg(F.max_by(F.struct("parent_id"), F.struct(*order)).alias("p")).where("p.parent_id IS NOT NULL").select("task_id", "p.parent_id")


def fold_externals(events: DataFrame, order: tuple[str, ...] = ("timestamp", "event_id")) -> DataFrame:
    """task_id, source, external_id, blocking and resolved_at after all events."""
    kinds = ("external_id_added", "external_id_removed", "external_blocker_added", "external_blocker_resolved")
    at = F.struct(*order)
    e = events.where(F.col("event_type").isin(*kinds)).withColumn("source", _get("source")).withColumn("external_id", _get("external_id"))
    last = lambda *names: F.max(F.when(F.col("event_type").isin(*names), at))
    resolved = F.max_by(F.coalesce(_get("resolved_at", "bigint"), F.col("timestamp")), F.when(F.col("event_type") == "external_blocker_resolved", at))
    g = e.groupBy("task_id", "source", "external_id").agg(last("external_id_removed").alias("gone"), last("external_id_added", "external_blocker_added").alias("came"), last("external_blocker_added").alias("block"), last("external_blocker_resolved").alias("solved"), resolved.alias("r"))
    g = g.where("came IS NOT NULL AND (gone IS NULL OR came > gone)")
    live = F.col("block").isNotNull() & (F.col("gone").isNull() | (F.col("block") > F.col("gone")))
    done = live & F.col("solved").isNotNull() & (F.col("solved") > F.col("block"))
    return g.select("task_id", "source", "external_id", live.cast("int").alias("blocking"), F.when(done, F.col("r")).alias("resolved_at"))


def fold_comments(events: DataFrame, order: tuple[str, ...] = ("timestamp", "event_id")) -> DataFrame:
    """task_id, comment_id, author, body, created_at and updated_at of comments after all events."""
    at = F.struct(*order)
    e = events.where(F.col("event_type").isin("comment_added", "comment_updated")).withColumn("comment_id", _get("comment_id"))
    e = e.withColumn("comment_id", F.coalesce("comment_id", F.when(F.col("event_type") == "comment_added", F.col("event_id").cast("string"))))
    added = F.col("event_type") == "comment_added"
    g = e.groupBy("task_id", "comment_id").agg(F.max_by("actor", F.when(added, at)).alias("author"), F.max_by(_get("body"), at).alias("body"), F.min(F.when(added, F.col("timestamp"))).alias("created_at"), F.max("timestamp").alias("updated_at"))
    return g.where("created_at IS NOT NULL")


def fold_transfers(events: DataFrame, spaces: DataFrame, order: tuple[str, ...] = ("timestamp", "event_id")) -> DataFrame:
    """task_id, space and display_id of tasks (task_id, space) after their last transfer; display_id is null without one."""
    last = events.where("event_type = 'task_transferred'").groupBy("task_id").agg(F.max_by(F.struct(_get("to_space").alias("space"), _get("new_display_id").alias("display_id")), F.struct(*order)).alias("t"))
    return spaces.select("task_id", "space").join(last, "task_id", "left").select("task_id", F.coalesce("t.space", "space").alias("space"), F.col("t.display_id").alias("display_id"))


def note_links(notes: DataFrame, chunks: DataFrame, files: DataFrame) -> DataFrame:
    """task_id, chunk_id and path of note links (task_id, chunk_id): the chunk's file, null where either is gone."""
    return notes.join(chunks.select("chunk_id", "file_id"), "chunk_id", "left").join(files.select("file_id", "path"), "file_id", "left").select("task_id", "chunk_id", "path")


def fold_record_tags(events: DataFrame, order: tuple[str, ...] = ("timestamp", "event_id")) -> DataFrame:
    """record_id and tag: those of the creation, and those whose last event added them."""
    made = events.where("event_type = 'record_created'").select("record_id", *order, F.explode(F.from_json(F.get_json_object("payload", "$.tags"), "array<string>")).alias("tag"), F.lit(True).alias("on"))
    own = events.where(F.col("event_type").isin("tag_added", "tag_removed")).select("record_id", *order, _get("tag").alias("tag"), (F.col("event_type") == "tag_added").alias("on"))
    return made.union(own).groupBy("record_id", "tag").agg(F.max_by("on", F.struct(*order)).alias("on")).where("on").select("record_id", "tag")


def fold_record_links(events: DataFrame, order: tuple[str, ...] = ("timestamp", "event_id")) -> DataFrame:
    """record_id, task_id and chunk_id whose last event added the link."""
    e = events.where(F.col("event_type").isin("link_added", "link_removed")).select("record_id", *order, _get("task_id").alias("task_id"), _get("chunk_id").alias("chunk_id"), (F.col("event_type") == "link_added").alias("on"))
    return e.groupBy("record_id", "task_id", "chunk_id").agg(F.max_by("on", F.struct(*order)).alias("on")).where("on").select("record_id", "task_id", "chunk_id")


def fold_records(events: DataFrame, order: tuple[str, ...] = ("timestamp", "event_id")) -> DataFrame:
    """record_id, title, kind, status, retention, pinned and payload_available after all events."""
    at = F.struct(*order)
    kind = F.col("event_type")
    last = lambda c: F.max_by(c, F.when(c.isNotNull(), at))
    own = kind.isin("record_created", "record_updated")
    status = F.when(kind == "record_created", "active").when(kind == "record_archived", "archived")
    pinned = F.when(kind == "record_pinned", 1).when(kind == "record_unpinned", 0).when(kind == "record_created", 0)
    payload = F.when(kind == "record_created", 1).when(kind == "payload_evicted", 0)
    out = events.groupBy("record_id").agg(
        last(F.when(own, _get("title"))).alias("title"), last(F.when(own, _get("kind"))).alias("kind"), last(status).alias("status"), last(F.when(kind == "retention_set", _get("retention_class"))).alias("retention"), last(pinned).alias("pinned"), last(payload).alias("payload_available"), F.min(F.when(kind == "record_created", F.col("timestamp"))).alias("created_at"), F.max("timestamp").alias("updated_at")
    )
    return out.where("created_at IS NOT NULL")


def fold_links(events: DataFrame, order: tuple[str, ...] = ("timestamp", "event_id")) -> DataFrame:
    """Edges whose last event created them; edges to themselves are left out."""
    keys = ["from_type", "from_id", "to_type", "to_id", "edge_kind"]
    last = events.where("NOT (from_type = to_type AND from_id = to_id)").groupBy(*keys).agg(F.max_by("event_type", F.struct(*order)).alias("t"))
    return last.where("t = 'link_created'").select(*keys)


def coalesce_files(events: DataFrame) -> DataFrame:
    """path and action (index, delete or rename, with to_path) of file events (seq, path, action, to_path).

    A path's last action counts; paths that were renamed away have no other action, whenever it came.
    """
    gone = events.where("action = 'renamed'").select("path").distinct()
    rest = events.where("action <> 'renamed'").join(gone, "path", "left_anti")
    last = rest.groupBy("path").agg(F.max_by("action", "seq").alias("a")).select("path", F.when(F.col("a") == "deleted", "delete").otherwise("index").alias("action"), F.lit(None).cast("string").alias("to_path"))
    return last.unionByName(events.where("action = 'renamed'").select("path", F.lit("rename").alias("action"), "to_path"))


def stream_latest(stream: DataFrame, key: str, value: str, seq: str) -> DataFrame:
    """The last value of each key of a stream by seq, as a streaming aggregate in update mode."""
    return stream.groupBy(key).agg(F.max(F.struct(seq, value)).alias("m")).select(key, F.col(f"m.{value}").alias(value), F.col(f"m.{seq}").alias(seq))


def stream_tasks(stream: DataFrame) -> DataFrame:
    """fold_tasks over a stream of events, in update or complete mode."""
    return fold_tasks(stream)
