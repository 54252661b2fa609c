"""JSONL event logs: reading, and an import of issues from a foreign tracker's export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TASK_EVENT = "event_id string, task_id string, timestamp bigint, actor string, event_type string, event_version int, payload string"
RECORD_EVENT = "event_id string, record_id string, timestamp bigint, actor string, event_type string, event_version int, payload string"
ISSUE = "id string, title string, description string, status string, priority int, issue_type string, assignee string, created_at string, updated_at string, closed_at string, close_reason string, labels array<string>, dependencies array<struct<issue_id:string,depends_on_id:string,type:string>>, comments array<struct<id:string,author:string,text:string,created_at:string>>"


def read_task_events(spark: SparkSession, path: str) -> DataFrame:
    """All task events; lines that are no event (broken, or without id) are left out."""
    return spark.read.schema(TASK_EVENT).json(path).where("event_id IS NOT NULL")


def read_record_events(spark: SparkSession, path: str, record_id: str | None = None) -> DataFrame:
    """All record events, or one record's; the filter is part of the scan.  Lines that are no event are left out."""
    out = spark.read.schema(RECORD_EVENT).json(path).where("event_id IS NOT NULL")
    return out if record_id is None else out.where(F.col("record_id") == record_id)


def issues_to_events(issues: DataFrame) -> DataFrame:
    """Task events (created, labels, dependencies, parents, comments, closed) of exported issues, in one order per issue."""
    at = lambda c: F.coalesce(F.unix_timestamp(F.to_timestamp(c)), F.lit(0))
    status = F.when(F.col("status").isin("open", "in_progress", "blocked"), F.col("status")).when(F.col("status") == "closed", "done").otherwise("open")

    def event(df: DataFrame, kind: str, step: int, when, actor, payload) -> DataFrame:
        body = F.to_json(F.struct(*[c.alias(n) for n, c in payload.items()]))
        return df.select(F.concat_ws(":", "id", F.lit(kind), F.sha2(body, 256)).alias("event_id"), F.col("id").alias("task_id"), when.alias("timestamp"), actor.alias("actor"), F.lit(kind).alias("event_type"), F.lit(1).alias("event_version"), body.alias("payload"), F.lit(step).alias("step"))

    me = F.lit("import")
    created, changed = at(F.col("created_at")), F.coalesce(F.unix_timestamp(F.to_timestamp("updated_at")), at(F.col("created_at")))
    parts = [event(issues, "task_created", 0, created, me, {"title": F.col("title"), "description": F.col("description"), "priority": F.coalesce("priority", F.lit(4)), "task_type": F.coalesce("issue_type", F.lit("task")), "assignee": F.col("assignee"), "status": F.lit("open")})]
    parts.append(event(issues.select("*", F.explode("labels").alias("l")), "label_added", 1, created, me, {"label": F.col("l")}))
    deps = issues.select("*", F.explode("dependencies").alias("d"))
    parts.append(event(deps.where("d.type = 'parent-child'"), "parent_set", 2, created, me, {"parent_task_id": F.col("d.depends_on_id")}))
    parts.append(event(deps.where("d.type <> 'parent-child'"), "dependency_added", 3, created, me, {"depends_on_task_id": F.col("d.depends_on_id")}))
    notes = issues.select("*", F.explode("comments").alias("c"))
    parts.append(event(notes, "comment_added", 4, at(F.col("c.created_at")), F.coalesce("c.author", me), {"body": F.col("c.text")}))
    parts.append(event(issues.where(status != "open"), "status_changed", 5, F.coalesce(F.unix_timestamp(F.to_timestamp("closed_at")), changed), me, {"new_status": status, "reason": F.col("close_reason")}))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def import_report(events: DataFrame) -> DataFrame:
    """event_type and n."""
    return events.groupBy("event_type").agg(F.count("*").alias("n"))
