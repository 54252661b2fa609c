"""The entities of the engine as relations over the driver's tables, in SQL that Spark and DuckDB share.

Each name maps to a SELECT over tables and earlier relations.  Tables with times get a column of
epoch seconds first (o_epoch, l_epoch, e_epoch), the one thing that the two dialects write differently.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Epoch seconds that stand for the present in all queries.
NOW = 1_000_000_000
TIMES = {"orders": ("o_orderdate", "o_epoch"), "lineitem": ("l_shipdate", "l_epoch"), "events": ("ts", "e_epoch")}

RELATIONS = {
    "tasks": """SELECT o_orderkey AS task_id, 'Order ' || CAST(o_orderkey AS STRING) AS title,
        'Customer ' || CAST(o_custkey AS STRING) || ' asked. Price ' || CAST(CAST(round(o_totalprice) AS BIGINT) AS STRING) AS description,
        CASE WHEN o_orderstatus = 'F' AND o_custkey % 7 = 0 THEN 'cancelled' WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'P' THEN 'in_progress'
             WHEN o_custkey % 11 = 0 THEN 'blocked' ELSE 'open' END AS status,
        CAST(substring(o_orderpriority, 1, 1) AS INT) - 1 AS priority, CASE WHEN o_orderkey % 17 = 0 THEN 'epic' ELSE 'task' END AS task_type,
        CASE WHEN o_custkey % 5 <> 0 THEN o_epoch + 2592000 END AS due_ts, CASE WHEN o_custkey % 13 = 0 THEN o_epoch + 315360000 END AS defer_until,
        CASE WHEN o_custkey % 19 = 0 THEN 'waiting' END AS blocked_reason, o_epoch AS created_at, o_epoch + o_custkey AS updated_at,
        CASE WHEN o_custkey % 3 = 0 THEN o_epoch + 100 END AS embedded_at, 's' || CAST(o_custkey % 3 AS STRING) AS space,
        'User' || CAST(o_custkey % 50 AS STRING) AS assignee, CAST(o_orderkey % 10 AS BIGINT) AS child_seq FROM orders_t""",
    "entity_links": """SELECT l_orderkey AS from_id, l_partkey AS to_id, CASE WHEN l_linenumber = 1 AND l_quantity > 40 THEN 'blocks' ELSE 'relates_to' END AS edge_kind, l_epoch AS created_at
        FROM lineitem_t UNION ALL SELECT CAST(floor(o_orderkey / 10) AS BIGINT), o_orderkey, 'parent_of', o_epoch FROM orders_t WHERE o_orderkey >= 10""",
    "external_ids": """SELECT l_orderkey AS task_id, CASE WHEN l_quantity > 45 THEN 1 ELSE 0 END AS blocking, CASE WHEN l_discount > 0.05 THEN l_epoch END AS resolved_at FROM lineitem_t WHERE l_returnflag = 'R'""",
    "task_labels": """SELECT DISTINCT l_orderkey AS task_id, l_returnflag || l_linestatus AS label FROM lineitem_t""",
    "sagas": """SELECT c_custkey AS saga_id, CASE c_custkey % 4 WHEN 0 THEN 'planning' WHEN 1 THEN 'open' WHEN 2 THEN 'closed' ELSE 'cancelled' END AS status FROM customer""",
    "saga_tasks": """SELECT o_custkey AS saga_id, o_orderkey AS task_id, o_epoch AS added_at FROM orders_t
        UNION ALL SELECT o_custkey, o_orderkey + 100000000000, o_epoch FROM orders_t WHERE o_orderstatus = 'P'""",
    "chunks": """SELECT doc_id AS chunk_id, doc_id AS file_id, 0 AS chunk_ord, text AS content, source AS space, source || '/' || lang || '/doc' || CAST(doc_id AS STRING) || '.md' AS path,
        1000000000 - 86400 * (doc_id % 400) AS created_at, CAST(doc_id % 97 AS DOUBLE) / 97 AS pagerank, CAST(doc_id % 11 AS DOUBLE) / 11 AS importance, lang FROM documents""",
    "part_links": """SELECT l_partkey AS src, l_suppkey + 1000000000000 AS dst FROM lineitem_t""",
    "summaries": """SELECT event_id AS summary_id, 'u' || CAST(user_id AS STRING) AS space, e_epoch AS created_at, e_epoch + user_id AS updated_at, CASE WHEN value > 20 THEN e_epoch END AS embedded_at,
        CASE WHEN event_id % 3 = 0 THEN event_id END AS consolidated_by, CASE event_type WHEN 'click' THEN 'trusted' WHEN 'view' THEN 'vetted' ELSE 'untrusted' END AS trust, value AS importance, event_type AS kind FROM events_t""",
    "records": """SELECT p_partkey AS record_id, p_name AS title, CASE p_partkey % 4 WHEN 0 THEN 'document' WHEN 1 THEN 'snapshot' WHEN 2 THEN 'plan' ELSE 'review' END AS kind, CASE WHEN p_partkey % 9 = 0 THEN 'archived' ELSE 'active' END AS status,
        p_brand AS tag, p_retailprice AS price, 'h' || CAST(p_partkey % 701 AS STRING) AS content_hash, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE 1 END AS payload_available, 1000000 + p_partkey % 1000 AS updated_at FROM part""",
    "jobs": """SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'in_progress' ELSE CASE WHEN o_custkey % 2 = 0 THEN 'ready' ELSE 'pending' END END AS status,
        CAST(substring(o_orderpriority, 1, 1) AS INT) AS priority, o_epoch AS scheduled_at, o_epoch AS started_at, o_epoch + o_custkey AS updated_at, CAST(o_custkey % 9 AS INT) AS attempts FROM orders_t""",
    "aliases": """SELECT p_name || CAST(p_partkey AS STRING) AS tag, p_brand AS canonical, p_type AS cluster, 's' || CAST(p_size % 5 AS STRING) AS space FROM part""",
    "uses": """SELECT event_type AS source, json_k AS tag, e_epoch AS updated_at FROM (SELECT *, CAST(user_id % 40 AS STRING) AS json_k FROM events_t) x""",
    "task_events": """SELECT event_id, e_epoch AS ts_s, user_id AS task_id, event_type, value FROM events_t""",
    "doc_links": """SELECT chunk_id AS source_file_id, (chunk_id * 31 + 7) % 997 AS target_file_id FROM chunks UNION ALL SELECT chunk_id, (chunk_id * 17 + 3) % 499 FROM chunks""",
    "notes": """SELECT event_id AS summary_id, 'u' || CAST(user_id % 20 AS STRING) AS space, CASE WHEN event_id % 5 = 0 THEN 'Viewing of pages' WHEN event_id % 5 = 1 THEN 'Purchases and orders' ELSE 'Errors' END AS title,
        event_type || ' events were ' || CASE WHEN event_id % 3 = 0 THEN 'happily processed' WHEN event_id % 3 = 1 THEN 'relational and conditional' ELSE 'hoping for signups' END || ' by user ' || CAST(user_id AS STRING) AS content,
        CASE event_type WHEN 'click' THEN 'trusted' WHEN 'view' THEN 'vetted' ELSE 'untrusted' END AS trust, value AS importance, e_epoch AS created_at, e_epoch + user_id AS updated_at, CASE WHEN value > 20 THEN e_epoch END AS embedded_at,
        CASE event_id % 4 WHEN 0 THEN 'episode' WHEN 1 THEN 'reflection' WHEN 2 THEN 'procedure' ELSE 'summary' END AS kind, 'k' || CAST(event_id % 6 AS STRING) AS tag FROM events_t""",
    "task_log": """SELECT event_id, CAST(user_id % 50 AS STRING) AS task_id, e_epoch AS timestamp, 'a' || CAST(event_id % 7 AS STRING) AS actor, CAST((event_id * 7 + user_id) % 56 AS STRING) AS other,
        CASE event_id % 8 WHEN 0 THEN 'comment_added' WHEN 1 THEN 'comment_updated' WHEN 2 THEN 'parent_set' WHEN 3 THEN 'dependency_added' WHEN 4 THEN 'note_linked' WHEN 5 THEN 'note_unlinked' WHEN 6 THEN 'task_transferred' ELSE 'task_created' END AS event_type,
        CASE event_id % 8 WHEN 0 THEN '{"comment_id":"c' || CAST(event_id % 3 AS STRING) || '","body":"b' || CAST(event_id AS STRING) || '"}' WHEN 1 THEN '{"comment_id":"c' || CAST(event_id % 3 AS STRING) || '","body":"b' || CAST(event_id AS STRING) || '"}'
             WHEN 2 THEN CASE WHEN event_id % 5 = 0 THEN '{}' ELSE '{"parent_task_id":"' || CAST((event_id * 7 + user_id) % 56 AS STRING) || '"}' END WHEN 3 THEN '{"depends_on_task_id":"' || CAST((event_id * 7 + user_id) % 56 AS STRING) || '"}'
             WHEN 6 THEN '{"to_space":"s' || CAST(event_id % 4 AS STRING) || '","new_display_id":"d' || CAST(event_id AS STRING) || '"}' WHEN 7 THEN '{"title":"t"}' ELSE '{"chunk_id":"' || CAST(event_id % 30 AS STRING) || '"}' END AS payload FROM events_t""",
    "record_log": """SELECT event_id, CAST(user_id % 40 AS STRING) AS record_id, e_epoch AS timestamp, event_id % 30 AS chunk,
        CASE event_id % 9 WHEN 0 THEN 'record_created' WHEN 1 THEN 'tag_added' WHEN 2 THEN 'tag_removed' WHEN 3 THEN 'link_added' WHEN 4 THEN 'link_removed' WHEN 5 THEN 'record_archived' WHEN 6 THEN 'record_pinned' WHEN 7 THEN 'retention_set' ELSE 'payload_evicted' END AS event_type,
        CASE event_id % 9 WHEN 0 THEN '{"title":"r' || CAST(event_id AS STRING) || '","kind":"plan","tags":["x' || CAST(event_id % 4 AS STRING) || '"]}' WHEN 1 THEN '{"tag":"x' || CAST(event_id % 4 AS STRING) || '"}' WHEN 2 THEN '{"tag":"x' || CAST(event_id % 4 AS STRING) || '"}'
             WHEN 7 THEN '{"retention_class":"c' || CAST(event_id % 3 AS STRING) || '"}' ELSE '{"chunk_id":"' || CAST(event_id % 30 AS STRING) || '"}' END AS payload FROM events_t""",
    "file_events": """SELECT event_id AS seq, 'f' || CAST(user_id AS STRING) || '/' || CAST(event_id % 7 AS STRING) AS path, CASE event_type WHEN 'error' THEN 'deleted' WHEN 'signup' THEN CASE WHEN event_id % 50 = 0 THEN 'renamed' ELSE 'created' END ELSE 'changed' END AS action,
        CASE WHEN event_type = 'signup' AND event_id % 50 = 0 THEN 'moved/' || CAST(event_id AS STRING) END AS to_path FROM events_t""",
}


def _names(sql: str) -> list[str]:
    return [n for n in dict.fromkeys(re.findall(r"\b(?:FROM|JOIN) (\w+)", sql))]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _epoch(df: DataFrame, name: str):
    """Epoch seconds of a time; those without zone are UTC, whatever the session's zone."""
    if df.schema[name].dataType.typeName() == "timestamp_ntz":
        return F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(name)).cast("bigint")
    return F.col(name).cast("bigint")


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A relation, or a table (name_t with its column of epoch seconds)."""
    if name.endswith("_t"):
        base = name[:-2]
        df = table(spark, sf_dir, base)
        return df.withColumn(TIMES[base][1], _epoch(df, TIMES[base][0]))
    if name not in RELATIONS:
        return table(spark, sf_dir, name)
    sql = RELATIONS[name].replace("{", "{{").replace("}", "}}")  # braces of JSON, not of names
    for n in _names(sql):
        sql = re.sub(rf"\b(FROM|JOIN) {n}\b", rf"\1 {{{n}}}", sql)
    return spark.sql(sql, **{n: relation(spark, sf_dir, n) for n in _names(RELATIONS[name])})


def oracle(sql: str) -> str:
    """DuckDB SQL with the relations that it names, as common table expressions."""
    need: list[str] = []

    def add(text: str) -> None:
        for n in re.findall(r"\b(\w+)\b", text):
            if n in need:
                continue
            if n in RELATIONS:
                add(RELATIONS[n])
                need.append(n)
            elif n.endswith("_t") and n[:-2] in TIMES:
                need.append(n)

    add(sql)
    parts = []
    for n in need:
        if n in RELATIONS:
            parts.append(f"{n} AS ({RELATIONS[n]})")
        else:
            at, to = TIMES[n[:-2]]
            parts.append(f"{n} AS (SELECT *, CAST(floor(epoch({at})) AS BIGINT) AS {to} FROM {n[:-2]})")
    body = sql.strip()
    recursive = ""
    if m := re.match(r"WITH (RECURSIVE )?", body):
        recursive, body = m[1] or "", ", " + body[m.end() :] if parts else body[m.end() :]
    else:
        body = " " + body
    return f"WITH {recursive}{', '.join(parts)}{body}" if parts or body.startswith(", ") else sql
