"""Operators on hand-written fixtures: ranks, budgets, readiness, graphs, sources, folds."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import ann, episodes, graph, records, retrieval, tags, tasks
from quillspark.sources import events as event_logs
from quillspark.sources import markdown
from quillspark.streaming import folds, validation


def test_profiles_sum_to_one():
    assert all(abs(sum(w) - 1) < 0.01 for w in retrieval.PROFILES.values())
    assert retrieval.resolve_profile("auto") == "default"


def test_rank_ties_by_id(spark):
    rows = [("q", i, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0) for i in ("b", "a", "c")] + [("q", "z", 1.0, 0.0, 0.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "query_id string, chunk_id string, sim_vector double, bm25 double, age_seconds double, pagerank double, tag_match double, importance double")
    got = [r.chunk_id for r in retrieval.rank(df, "lookup").orderBy("rank").collect()]
    assert got == ["z", "a", "b", "c"]


def test_tag_match_may_exceed_one(spark):
    row = spark.createDataFrame([(["bug", "bugs"], ["Bug", "bugs"], {"bug": "bug", "bugs": "bug"})], "q array<string>, c array<string>, m map<string,string>")
    assert row.select(retrieval.tag_match(F.col("q"), F.col("c"), F.col("m"))).first()[0] == 2.0
    assert abs(row.select(retrieval.tag_match(F.array(F.lit("bug")), F.array(F.lit("bugs")), F.col("m"))).first()[0] - 0.7) < 1e-12
    assert row.select(retrieval.tag_match(F.array().cast("array<string>"), F.col("c"))).first()[0] == 0.0


def test_fusion_confidence(spark):
    v = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "a", 1)], "query_id int, chunk_id string, rank int")
    k = spark.createDataFrame([(1, "b", 1), (1, "c", 2)], "query_id int, chunk_id string, rank int")
    q = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    got = {r.query_id: (r.confidence, r.k, r.overlap) for r in retrieval.fusion_confidence(v, k, q).collect()}
    assert got == {1: (0.5, 2, 1), 2: (0.0, 5, 0), 3: (1.0, 0, 0)}


def test_pack_stops_at_the_first_overflow(spark):
    df = spark.createDataFrame([(1, 1, 50), (1, 2, 60), (1, 3, 1), (2, 1, 500)], "query_id int, rank int, stub_tokens int")
    assert {(r.query_id, r["rank"]) for r in retrieval.pack(df, 100, 10).collect()} == {(1, 1), (2, 1)}


def test_expand_truncates(spark):
    text = "word. " * 40
    df = spark.createDataFrame([(1, 1, "abcd", 1), (1, 2, text, 60), (1, 3, "x", 1)], "query_id int, rank int, content string, token_estimate int")
    got = sorted((r["rank"], r.truncated, r.content) for r in retrieval.expand(df, 40).collect())
    assert [g[:2] for g in got] == [(1, False), (2, True)]
    assert got[1][2].endswith("\n[truncated]") and len(got[1][2]) <= 4 * 34 + 12
    assert [r["rank"] for r in retrieval.expand(df, 20).collect()] == [1]


def test_graph_expand_takes_the_best_seed(spark):
    c = spark.createDataFrame([(1, "a", "fa", 0.9, 0.0, 0.1, ["t"], 0.5, 0.0), (1, "b", "fb", 0.2, 0.0, 0.1, ["t"], 0.5, 0.0)], "query_id int, chunk_id string, file_id string, sim_vector double, bm25 double, pagerank double, tags array<string>, importance double, age_seconds double")
    links = spark.createDataFrame([("fa", "fc"), ("fb", "fc"), ("fa", "fb")], "source_file_id string, target_file_id string")
    chunks = spark.createDataFrame([("c", "fc", 0.3, 1.0), ("b", "fb", 0.1, 0.0)], "chunk_id string, file_id string, pagerank double, age_seconds double")
    got = {r.chunk_id: (r.sim_vector, r.importance, r.tags) for r in retrieval.graph_expand(c, links, chunks).collect()}
    assert got == {"a": (0.9, 0.5, ["t"]), "b": (0.45, 0.5, ["t"]), "c": (0.45, 1.0, [])}


def test_rerank_only_where_in_doubt(spark):
    ranked = spark.createDataFrame([(1, "a", 0.9, 1, 0.1), (1, "b", 0.8, 2, 0.7), (2, "a", 0.9, 1, 0.1), (2, "b", 0.8, 2, 0.7)], "query_id int, chunk_id string, score double, rank int, other double")
    conf = spark.createDataFrame([(1, 0.2), (2, 0.5)], "query_id int, confidence double")
    got = {(r.query_id, r.chunk_id): r["rank"] for r in retrieval.rerank(ranked, conf, F.col("other")).collect()}
    assert got == {(1, "b"): 1, (1, "a"): 2, (2, "a"): 1, (2, "b"): 2}


def test_lod_levels(spark):
    results = spark.createDataFrame([("u1", "c1", "h1"), ("u2", "c2", "h2"), ("u3", "c3", "h3")], "uri string, content string, source_hash string")
    lods = spark.createDataFrame([("u1", "L1", "x1", "h1", "2030"), ("u1", "L0", "y1", "h1", None), ("u2", "L0", "y2", "old", None)], "uri string, lod_level string, content string, source_hash string, expires_at string")
    at = lambda level, now="2025": {r.uri: (r.lod_content, r.actual_lod, r.lod_fresh, r.enqueue) for r in retrieval.resolve_lod(results, lods, now, level).collect()}
    assert at("L1") == {"u1": ("x1", "L1", True, False), "u2": ("y2", "L0", False, True), "u3": ("c3", "L2", True, True)}
    assert at("L1", "2031")["u1"] == ("x1", "L1", False, True)
    assert at("L0") == {"u1": ("y1", "L0", True, False), "u2": ("y2", "L0", False, False), "u3": ("c3", "L2", True, False)}
    assert at("L2")["u1"] == ("c1", "L2", True, False)


def test_ann_recall(spark):
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), "embedding")
    q = v.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    exact = {(r.query_id, r.chunk_id) for r in retrieval.knn(v, q, k=10).collect()}
    index = ann.build(v)
    modes = {m: {(r.query_id, r.chunk_id) for r in ann.search(index, q, k=10, mode=m).collect()} for m in ann.MODES}
    assert modes["exact"] == exact and len(exact & modes["refined"]) / len(exact) >= 0.9 and len(exact & modes["fast"]) / len(exact) >= 0.7
    with pytest.raises(ValueError, match="mode"):
        ann.search(index, q, mode="other")


def test_ann_copies_and_gaps(spark):
    """Copies of a vector are all found; rows without vector, or with one of another length, are not; nothing is found in nothing."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 7))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(k, [float(y) for y in x[k if k < 200 else 0]]) for k in range(300)] + [(400, None), (401, [1.0, 0.0])]
    v = spark.createDataFrame(rows, "chunk_id int, embedding array<float>")
    q = spark.createDataFrame([(1, rows[0][1]), (2, None), (3, [1.0])], "query_id int, embedding array<float>")
    got = ann.search(ann.build(v), q, k=101).collect()
    assert {r.query_id for r in got} == {1} and {r.chunk_id for r in got if r.sim > 0.999999 - 1e-6} == {0, *range(200, 300)}
    assert ann.search(ann.build(v.limit(0)), q).count() == 0


def test_codes_against_residuals():
    rng = np.random.default_rng(4)
    rest = rng.standard_normal((600, 5)).astype(np.float32)
    books = ann.codebooks(rest)
    codes = ann.encode(rest, books)
    decoded = np.concatenate([books[m][codes[:, m]] for m in range(3)], axis=1)
    assert codes.shape == (600, 3) and np.abs(decoded[:, 5]).max() == 0 and np.mean((decoded[:, :5] - rest) ** 2) < 0.05
    q = rng.standard_normal((4, 5)).astype(np.float32)
    table = ann.table_of(q, books)
    assert np.allclose(sum(table[:, m][:, codes[:, m]] for m in range(3)), q @ decoded[:, :5].T, atol=1e-4)


def test_ann_recall_of_the_largest_table(spark):
    from quillspark.plans.queries import QUERIES

    sf = "/root/testdata/sf0.1"
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), "embedding")
    q = v.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    exact = {(r.query_id, r.chunk_id) for r in retrieval.knn(v, q, k=10).collect()}
    found = {(r.query_id, r.chunk_id) for r in QUERIES["ann_search"](spark, sf).collect()}
    assert {a for a, _ in found} == {a for a, _ in exact} and len(exact & found) / len(exact) >= 0.9


def test_ann_probes_follow_cells():
    rng = np.random.default_rng(7)
    for n in (500, 5000, 20000):
        x = rng.standard_normal((n, 32)).astype(np.float32)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        centres = ann.kmeans(x, int(n**0.5) + 1, rounds=4)
        probes = ann.fit_probes(x, centres)
        q, cells = x[1 : n : n // 50], np.argsort(-(x @ centres.T), axis=1)[:, : ann.SPREAD]
        seen = np.argsort(-(q @ centres.T), axis=1)[:, :probes]
        near = np.argsort(-(q @ x.T), axis=1)[:, :10]
        assert np.mean([np.isin(cells[a], b).any(axis=1).mean() for a, b in zip(near, seen, strict=True)]) >= 0.9


def test_model_sees_doubtful_queries_alone(spark):
    rows = [(q, c, f"text {c}", 1.0 - c / 100, c + 1) for q in (1, 2) for c in range(90)]
    ranked = spark.createDataFrame(rows, "query_id int, chunk_id int, content string, score double, rank int").repartition(3)
    conf = spark.createDataFrame([(1, 0.1), (2, 0.9)], "query_id int, confidence double")
    queries = spark.createDataFrame([(1, "one"), (2, "two")], "query_id int, text string")

    def make():
        def model(pairs):
            assert len(pairs) <= 7 and set(pairs["question"]) == {"one"} and pairs["chunk_id"].max() < 20
            assert all(t == f"text {c}" for t, c in zip(pairs["text"], pairs["chunk_id"], strict=True))
            return [None if c == 3 else c / 10 + 2 for c in pairs["chunk_id"]]

        return model

    got = {(r.query_id, r["rank"]): r.chunk_id for r in retrieval.rerank_by_model(ranked, conf, make, queries, pairs=7).collect()}
    first = [c for c in range(19, -1, -1) if c != 3] + [3, *range(20, 90)]
    assert [got[1, k + 1] for k in range(90)] == first and [got[2, k + 1] for k in range(90)] == list(range(90))


TASK = "task_id string, status string, priority int, task_type string, due_ts bigint, defer_until bigint, blocked_reason string, updated_at bigint, space string"
EDGE = "from_id string, to_id string, edge_kind string"


def task(i, status="open", **k):
    return (i, status, k.get("priority", 2), k.get("kind", "task"), k.get("due"), k.get("defer"), k.get("why"), 0, "s")


def flagged(spark, rows, edges, ext=()):
    t, e = spark.createDataFrame(rows, TASK), spark.createDataFrame(list(edges), EDGE)
    x = spark.createDataFrame(list(ext), "task_id string, blocking int, resolved_at bigint")
    return t, e, tasks.flags(t, e, x, 1000)


def test_readiness(spark):
    rows = [task("free"), task("orphan"), task("met"), task("done", "done"), task("child"), task("grand"), task("top", why="x"), task("kid"), task("over", "done", why="x"), task("ext"), task("later", defer=2000), task("held", "blocked"), task("past", defer=10)]
    edges = [("orphan", "nowhere", "blocks"), ("met", "done", "blocks"), ("top", "child", "parent_of"), ("child", "grand", "parent_of"), ("over", "kid", "parent_of")]
    _, _, f = flagged(spark, rows, edges, [("ext", 1, None), ("free", 1, 5), ("met", 0, None)])
    ready = {r.task_id for r in tasks.ready(f).collect()}
    stuck = {r.task_id for r in tasks.blocked(f).collect()}
    assert ready == {"free", "met", "kid", "past"}
    assert stuck == {"orphan", "child", "grand", "top", "ext", "later"}  # held is in neither


@pytest.mark.parametrize("seed", [1, 2])
def test_ready_and_blocked_part_the_open_tasks(spark, seed):
    rng = random.Random(seed)
    rows = [task(str(i), rng.choice(["open", "in_progress", "done"])) for i in range(8)]
    edges = [(str(rng.randrange(8)), str(rng.randrange(9)), "blocks") for _ in range(10)]
    _, _, f = flagged(spark, rows, edges)
    ready, stuck = ({r.task_id for r in x.collect()} for x in (tasks.ready(f), tasks.blocked(f)))
    assert not ready & stuck
    assert ready | stuck == {r[0] for r in rows if r[1] != "done"}


def test_due_dates_none_last(spark):
    rows = [task("a"), task("b", due=5), task("c", due=3), task("e", kind="epic"), task("p", priority=0)]
    got = [r.task_id for r in tasks.top(spark.createDataFrame(rows, TASK), tasks.list_order(), 9).orderBy("position").collect()]
    assert got == ["p", "e", "c", "b", "a"]


def test_cascade_and_stats(spark):
    t = spark.createDataFrame([task("a"), task("b", "cancelled")], TASK)
    m = spark.createDataFrame([("s", "a"), ("s", "b"), ("s", "gone"), ("only", "b")], "saga_id string, task_id string")
    assert {r.task_id: r.outcome for r in tasks.cascade(m, t, "done").where("saga_id = 's'").collect()} == {"a": "closed", "b": "skipped", "gone": "failed"}
    got = {r.saga_id: (r.total, r.orphan, r.completion_pct) for r in tasks.saga_stats(m, t).collect()}
    assert got == {"s": (2, 1, 0.0), "only": (1, 0, None)}
    with pytest.raises(ValueError):
        tasks.cascade(m, t, "open")


def test_subtree_cap(spark):
    e = spark.createDataFrame([("a", f"k{i}", "parent_of") for i in range(5)], EDGE)
    new, m = spark.createDataFrame([("s", "a")], "saga_id string, task_id string"), spark.createDataFrame([("s", "k0")], "saga_id string, task_id string")
    assert {r.task_id for r in tasks.add_with_subtree(new, e, m, cap=6).collect()} == {"a", "k1", "k2", "k3", "k4"}
    with pytest.raises(ValueError):
        tasks.add_with_subtree(new, e, m, cap=5)


def edges(spark, rows):
    return spark.createDataFrame(rows, "src int, dst int")


def test_reach_and_cycles(spark):
    e = edges(spark, [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5)])
    seeds = spark.createDataFrame([(1,)], "node int")
    assert {(r.node, r.depth) for r in graph.reach(e, seeds, max_depth=3).collect()} == {(1, 0), (2, 1), (3, 2), (4, 3)}
    new = edges(spark, [(3, 2), (5, 1), (9, 9), (1, 5)])
    assert {(r.src, r.dst): r.cycle for r in graph.would_cycle(e, new).collect()} == {(3, 2): True, (5, 1): True, (9, 9): True, (1, 5): False}
    assert {r.node for r in graph.cyclic_nodes(e).collect()} == {1, 2, 3}


def test_components_of_a_path(spark):
    e = edges(spark, [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)])
    got = {r.node: r.component for r in graph.components(e, spark.createDataFrame([(i,) for i in [*range(41), 100, 101, 200]], "node int")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 200}
    assert graph.components(edges(spark, [])).count() == 0


def test_pagerank(spark):
    flat = edges(spark, [(1, 2), (2, 1)])
    assert {r.pagerank for r in graph.pagerank(flat).collect()} == {0.5}
    got = {r.node: r.pagerank for r in graph.pagerank(edges(spark, [(1, 3), (1, 3), (1, 2), (2, 3)]), spark.createDataFrame([(9,)], "node int")).collect()}
    assert got[3] == 1.0 and min(got.values()) == 0.0 and 0 < got[2] < 1 and set(got) == {1, 2, 3, 9}


def test_links_to_the_shortest_path(spark):
    links = spark.createDataFrame([("note", "wiki"), ("b/note.md", "markdown"), ("note", "external"), ("none", "wiki")], "target_path string, link_type string")
    files = spark.createDataFrame([("f1", "a/b/note.md"), ("f2", "c/note.md"), ("f3", "notes.md")], "file_id string, path string")
    got = {(r.target_path, r.link_type): r.target_file_id for r in graph.resolve_links(links, files).collect()}
    assert got == {("note", "wiki"): "f2", ("b/note.md", "markdown"): "f1", ("note", "external"): None, ("none", "wiki"): None}


def test_sessions_keep_the_exact_gap(spark):
    df = spark.createDataFrame([("s", i, t) for i, t in enumerate([0, 100, 201, 301, 402])], "space string, summary_id int, created_at bigint")
    got = [(r.first_at, r.n, r.newest) for r in episodes.consolidate(df, 100).orderBy("first_at").collect()]
    assert got == [(0, 2, 3), (201, 2, 2), (402, 1, 1)]


def test_integrity_and_upserts(spark):
    refs = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("d", 0)], "content_hash string, payload_available int")
    blobs = spark.createDataFrame([("a", "a"), ("b", "x"), ("d", "d"), ("e", "e")], "content_hash string, actual_hash string")
    assert {r.content_hash: r.state for r in records.integrity(refs, blobs).collect()} == {"a": "ok", "b": "corrupt", "c": "missing", "d": "stale", "e": "orphan"}
    old = spark.createDataFrame([(1, "f", "x"), (2, "f", "y"), (3, "g", "z")], "id int, file string, v string")
    new = spark.createDataFrame([(1, "f", "new")], "id int, file string, v string")
    assert {tuple(r) for r in records.merge_scoped(old, new, "id", ["file"]).collect()} == {(1, "f", "new"), (3, "g", "z")}
    assert {tuple(r) for r in records.upsert(old, new, ["id"]).collect()} == {(1, "f", "new"), (2, "f", "y"), (3, "g", "z")}


def test_tag_clusters(spark):
    v = {"bug": [1.0, 0.0], "bugs": [0.99, 0.141], "perf": [0.0, 1.0], "defect": [0.9, 0.436]}
    df = spark.createDataFrame([(t, n, v[t]) for t, n in (("bug", 2), ("bugs", 5), ("perf", 1), ("defect", 2))], "tag string, n int, embedding array<float>")
    got = {r.tag: (r.cluster, r.canonical) for r in tags.clusters(df, 0.95).collect()}
    assert got == {"bug": ("bug", "bugs"), "bugs": ("bug", "bugs"), "defect": ("bug", "bugs"), "perf": ("perf", "perf")}


MD = """---
title: T
tags: [a, b]
importance: 3
---
intro

# One
text `code`
```
# no heading
```
## Two *em*
more

Title
=====
end
"""


def test_sections_and_front_matter():
    fm, _ = markdown.frontmatter(MD)
    assert markdown.signals(fm) == (["a", "b"], 1.0)
    got = [(s[0], s[1].decode()) for s in markdown.sections(MD)]
    assert [g[0] for g in got] == ["", "# One", "# One > ## Two em", "# Title"]
    assert got[0][1] == "intro" and "# no heading" in got[1][1]
    raw = MD.encode()
    assert all(raw[lead : lead + len(content)] == content for _, content, _, _, lead in markdown.sections(MD))


def test_chunks_fit_and_cover():
    text = "# H\n" + "\n\n".join(f"Satz {i} über das Ding. " * 12 for i in range(30)) + "\n\n" + "ohne Ende " * 400
    got = markdown.chunk(text)
    assert all(0 < c[5] <= 400 for c in got) and [c[0] for c in got] == list(range(len(got)))
    squeeze = lambda s: "".join(s.split())
    assert squeeze("".join(c[1] for c in got)) == squeeze(text.removeprefix("# H\n"))
    assert markdown.chunk("") == [] and markdown.chunk(None) == []


def test_issue_import(spark, tmp_path):
    (tmp_path / "i.jsonl").write_text('{"id":"x","title":"T","status":"closed","priority":1,"created_at":"2024-01-01T00:00:00Z","closed_at":"2024-01-02T00:00:00Z","labels":["l"],"dependencies":[{"issue_id":"x","depends_on_id":"y","type":"blocks"},{"issue_id":"x","depends_on_id":"p","type":"parent-child"}]}\n')
    ev = event_logs.issues_to_events(spark.read.schema(event_logs.ISSUE).json(str(tmp_path)))
    assert {r.event_type: r.n for r in event_logs.import_report(ev).collect()} == {"task_created": 1, "label_added": 1, "dependency_added": 1, "parent_set": 1, "status_changed": 1}
    assert [(r.task_id, r.title, r.status, r.priority) for r in folds.fold_tasks(ev).collect()] == [("x", "T", "done", 1)]


LOG = [("e1", "t1", 1, "task_created", '{"title":"A"}'), ("e2", "t1", 2, "task_updated", '{"priority":0}'), ("e3", "t1", 3, "status_changed", '{"new_status":"done"}'), ("e4", "t1", 3, "label_added", '{"label":"x"}'), ("e5", "t1", 4, "label_removed", '{"label":"x"}'), ("e6", "t1", 5, "label_added", '{"label":"y"}'), ("e7", "lost", 5, "status_changed", '{"new_status":"done"}'), ("e8", "t1", 6, "external_blocker_added", '{"source":"gh","external_id":"1"}'), ("e9", "t1", 7, "external_blocker_resolved", '{"source":"gh","external_id":"1"}'), ("f1", "t1", 8, "parent_set", '{"parent_task_id":"t9"}')]


def log(spark):
    return spark.createDataFrame(LOG, "event_id string, task_id string, timestamp bigint, event_type string, payload string")


def test_event_folds(spark):
    e = log(spark)
    for twice in (e, e.union(e)):  # replay changes nothing
        assert [(r.task_id, r.title, r.priority, r.status, r.updated_at) for r in folds.fold_tasks(twice).collect()] == [("t1", "A", 0, "done", 8)]
        assert [tuple(r) for r in folds.fold_pairs(twice, "label_added", "label_removed", "label", "label").collect()] == [("t1", "y")]
        assert [tuple(r) for r in folds.fold_externals(twice).collect()] == [("t1", "gh", "1", 1, 7)]
        assert [tuple(r) for r in folds.fold_parents(twice).collect()] == [("t1", "t9")]
    assert {(r.event_id, r.problem) for r in validation.invalid_events(e).collect()} == {("e7", "unknown task"), ("f1", "unknown parent")}


def test_stream_equals_batch(spark, tmp_path):
    e = log(spark)
    e.coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).json(str(tmp_path / "in"))
    q = folds.stream_tasks(stream).writeStream.outputMode("complete").format("memory").queryName("folded").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("folded").collect()} == {tuple(r) for r in folds.fold_tasks(e).collect()}


def test_file_events(spark):
    rows = [(1, "a", "created", None), (2, "a", "deleted", None), (3, "b", "deleted", None), (4, "b", "created", None), (5, "c", "changed", None), (6, "c", "renamed", "d")]
    got = {tuple(r) for r in folds.coalesce_files(spark.createDataFrame(rows, "seq int, path string, action string, to_path string")).collect()}
    assert got == {("a", "delete", None), ("b", "index", None), ("c", "rename", "d")}
