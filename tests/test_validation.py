"""Validation of event logs against a replay, event by event."""

from __future__ import annotations

import json
import random

import pytest
from conftest import SMALL

from quillspark.plans.queries import QUERIES, _doubtful_log
from quillspark.plans.relations import relation
from quillspark.streaming.validation import invalid_events

SCHEMA = "event_id bigint, task_id string, timestamp bigint, event_type string, payload string"


def replay(events):
    """Problems of events (in their order), applying those that are valid."""
    tasks, edges, out = set(), set(), {}
    for event_id, task, _, kind, payload in events:
        p = json.loads(payload)
        parent, to = p.get("parent_task_id"), p.get("depends_on_task_id")
        problem = None
        if kind == "task_created":
            problem = "task exists" if task in tasks else "itself" if parent == task else "unknown parent" if parent and parent not in tasks else None
            if not problem:
                tasks.add(task)
        elif task not in tasks:
            problem = "unknown task"
        elif kind == "dependency_added":
            seen, todo = {to}, [to]
            while todo:
                at = todo.pop()
                more = {b for a, b in edges if a == at} - seen
                seen |= more
                todo += more
            problem = "unknown dependency" if to not in tasks else "itself" if to == task else "cycle" if task in seen else None
            if not problem:
                edges.add((task, to))
        elif kind == "dependency_removed":
            edges.discard((task, to))
        elif kind == "parent_set" and parent:
            problem = "itself" if parent == task else None if parent in tasks else "unknown parent"
        if problem:
            out[event_id] = problem
    return out


def random_log(r, first):
    """Events of one log; its tasks are its own."""
    names = [f"{first}-{k}" for k in range(r.randint(2, 7))]
    out = []
    for k in range(r.randint(1, 40)):
        kind = r.choice(["task_created", "task_created", "dependency_added", "dependency_added", "dependency_added", "dependency_removed", "parent_set", "comment_added"])
        a, b = r.choice(names), r.choice(names)
        payload = {"depends_on_task_id": b} if kind.startswith("dependency") else {"parent_task_id": b} if kind == "parent_set" and r.random() < 0.9 or kind == "task_created" and r.random() < 0.3 else {}
        out.append((first + k, a, k // 3, kind, json.dumps(payload)))
    return out


@pytest.mark.parametrize("limit", [100_000, 4])
def test_logs(spark, limit):
    """Logs side by side in one log; with small components in tasks, and with halving."""
    r = random.Random(limit)
    logs = [random_log(r, 100 * k) for k in range(1000 if limit > 4 else 12)]
    rows = [e for log in logs for e in log]
    r.shuffle(rows)
    got = {x.event_id: x.problem for x in invalid_events(spark.createDataFrame(rows, SCHEMA).repartition(4), limit=limit).collect()}
    want = {k: p for log in logs for k, p in replay(log).items()}
    assert got == want and {"cycle", "task exists", "unknown parent", "unknown dependency", "itself", "unknown task"} == set(want.values())


def test_order_matters(spark):
    dep = lambda b: json.dumps({"depends_on_task_id": b})
    made = [(k, t, k, "task_created", "{}") for k, t in enumerate("abc", 1)]
    rows = [*made, (4, "a", 4, "task_created", "{}"), (5, "a", 5, "dependency_added", dep("b")), (6, "b", 6, "dependency_added", dep("a")), (7, "a", 7, "dependency_removed", dep("b")), (8, "b", 8, "dependency_added", dep("a")), (9, "a", 9, "dependency_added", dep("b")), (10, "d", 10, "dependency_added", dep("a")), (11, "d", 11, "task_created", '{"parent_task_id":"e"}'), (12, "b", 12, "dependency_added", dep("a"))]
    got = {x.event_id: x.problem for x in invalid_events(spark.createDataFrame([*rows, rows[0]], SCHEMA)).collect()}
    assert got == {4: "task exists", 6: "cycle", 9: "cycle", 10: "unknown task", 11: "unknown parent"} == replay(rows)
    assert invalid_events(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query(spark):
    rows = sorted(_doubtful_log(lambda n: relation(spark, SMALL, n)).collect(), key=lambda r: (r.timestamp, r.event_id))
    got = {x.event_id: x.problem for x in QUERIES["invalid_events"](spark, SMALL).collect()}
    assert got == replay([(r.event_id, r.task_id, r.timestamp, r.event_type, r.payload) for r in rows])


def test_pairs_that_are_added_again_and_again(spark, monkeypatch):
    """One component whose valid edges outnumber the limit, of few pairs: a stretch is a replay, no search by joins."""
    from quillspark.streaming import validation

    monkeypatch.setattr(validation, "reach", lambda *a: pytest.fail("a stretch went down to one event"))
    r = random.Random(5)
    rows = [(k, f"t{k}", k, "task_created", "{}") for k in range(5)]
    for k in range(5, 200):
        rows.append((k, f"t{r.randrange(5)}", k, r.choice(["dependency_added"] * 5 + ["dependency_removed"]), json.dumps({"depends_on_task_id": f"t{r.randrange(5)}"})))
    got = {x.event_id: x.problem for x in invalid_events(spark.createDataFrame(rows, SCHEMA), limit=70).collect()}
    assert got == replay(rows) and "cycle" in got.values()


def test_unknown_references_search_no_cycles(spark, monkeypatch):
    from quillspark.streaming import validation

    monkeypatch.setattr(validation, "closing_events", lambda *a: pytest.fail("cycles are not asked for"))
    rows = [e for k in range(100) for e in random_log(random.Random(k), 100 * k)]
    got = {x.event_id: x.problem for x in validation.unknown_references(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = {k: p for n in range(100) for k, p in replay(rows_of(n)).items() if p != "cycle"}
    assert got == want
    QUERIES["unknown_references"](spark, SMALL).limit(1).collect()


def rows_of(n):
    return random_log(random.Random(n), 100 * n)
