"""Keyed stream state against the batch folds, over a restart."""

from __future__ import annotations

import json
import random

from quillspark.streaming import folds
from quillspark.streaming.keyed import current, stream_entities

SCHEMA = "event_id bigint, task_id string, timestamp bigint, actor string, event_type string, payload string"


def events(seed, n):
    r = random.Random(seed)
    out = []
    for k in range(n):
        kind = r.choice(["label_added", "label_removed", "task_created", "parent_set", "external_id_added", "external_id_removed", "external_blocker_added", "external_blocker_resolved", "comment_added", "comment_updated", "status_changed"])
        payload = {"label": r.choice("xyz"), "source": "gh", "external_id": r.choice("12"), "comment_id": r.choice("cd"), "body": f"b{k}"}
        if r.random() < 0.7:
            payload |= {"parent_task_id": r.choice("pq")}
        if r.random() < 0.5:
            payload |= {"resolved_at": k}
        if kind == "comment_added" and r.random() < 0.3:
            del payload["comment_id"]
        out.append((1000 * seed + k, r.choice("abc"), r.randint(0, 30), r.choice(["ann", "bob"]), kind, json.dumps(payload)))
    return out


def test_stream_equals_batch_after_a_restart(spark, tmp_path):
    first, second = events(1, 60), events(2, 40)
    schema = spark.createDataFrame([], SCHEMA).schema

    def run(rows, name):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = stream_entities(spark.readStream.schema(schema).json(str(tmp_path / "in")))
        q = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True)
        q = q.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(str(tmp_path / f"out/batch={name}{n}"))).start()
        q.awaitTermination(200)
        assert q.exception() is None

    run(first, "a")
    run([*second, *first[:10]], "b")  # a new stream on the same checkpoint; some events come twice
    got = {(r.task_id, r.kind, r.key): json.loads(r.value) for r in current(spark.read.parquet(str(tmp_path / "out"))).collect()}
    log = spark.createDataFrame(first + second, SCHEMA)
    want = {(r.task_id, "label", r.label): {} for r in folds.fold_pairs(log, "label_added", "label_removed", "label", "label").collect()}
    want |= {(r.task_id, "parent", ""): {"parent_id": r.parent_id} for r in folds.fold_parents(log).collect()}
    want |= {(r.task_id, "external", json.dumps([r.source, r.external_id])): {"blocking": r.blocking, "resolved_at": r.resolved_at} for r in folds.fold_externals(log).collect()}
    want |= {(r.task_id, "comment", r.comment_id): {"author": r.author, "body": r.body, "created_at": r.created_at, "updated_at": r.updated_at} for r in folds.fold_comments(log).collect()}
    assert got == want and len({k for _, k, _ in want}) == 4
