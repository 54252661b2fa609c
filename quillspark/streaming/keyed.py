"""Keyed state of streams: what a task's labels, parent, external ids and comments are after the events so far.

The batch folds of ``folds`` regroup a whole log.  Here each task has a map of its entities in the state
store of the stream, and a micro-batch loads and rewrites the entities that its events touch, no others.
Events may come in any order and more than once: each entity keeps the place (timestamp, event_id) of
what last set it, so that the result is that of the batch fold over all events so far.

A row goes out for each touched entity: task_id, kind (label, parent, external or comment), key, present,
value (JSON) and n, which rises with each row of an entity, so that its last row is the one that holds.
With ``ttl_ms`` entities that no event has touched for as long leave the store; the stream then runs on
processing time.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUT = "task_id string, kind string, key string, present boolean, value string, n bigint"
KINDS = {"label_added": "label", "label_removed": "label", "task_created": "parent", "parent_set": "parent", "external_id_added": "external", "external_id_removed": "external", "external_blocker_added": "external", "external_blocker_resolved": "external", "comment_added": "comment", "comment_updated": "comment"}
#: The provider that keeps maps by entry; a stream with keyed state needs it.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def entity(event_type: str, event_id, payload: dict) -> str | None:
    """The key of the entity that an event is about, within its task and kind; None if it is about none."""
    kind = KINDS[event_type]
    if kind == "label":
        return payload.get("label")
    if kind == "parent":
        return None if event_type == "task_created" and payload.get("parent_task_id") is None else ""
    if kind == "external":
        return json.dumps([payload.get("source"), payload.get("external_id")])
    return payload.get("comment_id") or (str(event_id) if event_type == "comment_added" else None)


def applied(state: dict, event_type: str, at: list, actor: str | None, payload: dict) -> dict:
    """The state of an entity after one more event, whenever it comes."""
    later = lambda name: name not in state or at > state[name]
    if event_type.startswith("label"):
        if later("at"):
            state |= {"at": at, "on": event_type == "label_added"}
    elif KINDS[event_type] == "parent":
        if later("at"):
            state |= {"at": at, "parent": payload.get("parent_task_id")}
    elif KINDS[event_type] == "external":
        for name, types in (("gone", ("external_id_removed",)), ("came", ("external_id_added", "external_blocker_added")), ("block", ("external_blocker_added",)), ("solved", ("external_blocker_resolved",))):
            if event_type in types and later(name):
                state[name] = at
                if name == "solved":
                    state["resolved"] = payload["resolved_at"] if payload.get("resolved_at") is not None else at[0]
    else:
        if event_type == "comment_added":
            state["created"] = min(at[0], state.get("created", at[0]))
            if later("by"):
                state |= {"by": at, "author": actor}
        if payload.get("body") is not None and later("said"):
            state |= {"said": at, "body": payload["body"]}
        state["updated"] = max(at[0], state.get("updated", at[0]))
    return state


def shown(kind: str, state: dict) -> tuple[bool, dict]:
    """Whether an entity is there, and what it shows."""
    if kind == "label":
        return state["on"], {}
    if kind == "parent":
        return state["parent"] is not None, {"parent_id": state["parent"]}
    if kind == "external":
        none: list = []
        gone = state.get("gone", none)
        live = state.get("block", none) > gone
        done = live and state.get("solved", none) > state["block"]
        return state.get("came", none) > gone, {"blocking": int(live), "resolved_at": state["resolved"] if done else None}
    return "created" in state, {"author": state.get("author"), "body": state.get("body"), "created_at": state.get("created"), "updated_at": state["updated"]}


class Entities(StatefulProcessor):
    """The entities of a task, by kind and key."""

    def __init__(self, ttl_ms: int | None = None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entities = handle.getMapState("entities", "kind string, key string", "state string", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator:  # noqa: N802, N803 - names of the interface
        import pandas as pd

        changed: dict[tuple[str, str], dict] = {}
        for pdf in rows:
            for event_id, at, kind, actor, text in zip(pdf["event_id"], pdf["timestamp"], pdf["event_type"], pdf["actor"], pdf["payload"], strict=True):
                payload = json.loads(text or "{}")
                event_id = event_id.item() if hasattr(event_id, "item") else event_id
                name = entity(kind, event_id, payload)
                if name is None:
                    continue
                of = (KINDS[kind], name)
                if of not in changed:
                    changed[of] = json.loads(self.entities.getValue(of)[0]) if self.entities.containsKey(of) else {"n": 0}
                applied(changed[of], kind, [int(at), event_id], actor, payload)
        out = []
        for of, state in changed.items():
            state["n"] += 1
            self.entities.updateValue(of, (json.dumps(state),))
            present, value = shown(of[0], state)
            out.append((key[0], *of, present, json.dumps(value), state["n"]))
        yield pd.DataFrame(out, columns=["task_id", "kind", "key", "present", "value", "n"])

    def close(self) -> None:
        pass


def stream_entities(events: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Changes of entities as a stream in update mode; events: event_id, task_id, timestamp, actor, event_type, payload (JSON)."""
    spark = events.sparkSession
    spark.conf.set(*PROVIDER)
    e = events.where(F.col("event_type").isin(*KINDS)).select(F.col("task_id").cast("string").alias("task_id"), "event_id", "timestamp", "event_type", "actor", "payload")
    return e.groupBy("task_id").transformWithStateInPandas(Entities(ttl_ms), OUT, "Update", "none" if ttl_ms is None else "ProcessingTime")


def current(rows: DataFrame) -> DataFrame:
    """task_id, kind, key and value of the entities that are there after all rows of a stream of changes."""
    last = rows.groupBy("task_id", "kind", "key").agg(F.max_by(F.struct("present", "value"), "n").alias("r"))
    return last.where("r.present").select("task_id", "kind", "key", "r.value")
