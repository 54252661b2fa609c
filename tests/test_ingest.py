"""Snapshot tables, incremental ingest and folders as streams."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from quillspark.operators.records import merge_scoped, upsert
from quillspark.sources.ingest import Ingest
from quillspark.sources.markdown import chunk, scan_folder
from quillspark.sources.snapshots import BucketTable, Conflict

ROW = "k bigint, g string, v string"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_upsert_sink(spark, tmp_path):
    t = BucketTable(spark, f"file://{tmp_path}/t", ROW, ["k"], buckets=4)
    assert t.read().count() == 0
    first = spark.createDataFrame([(k, f"g{k % 2}", "old") for k in range(20)] + [(None, "g0", "none")], ROW)
    assert t.change(lambda old: upsert(old, first, ["k"]), first) == 1
    new = spark.createDataFrame([(3, "g1", "new"), (99, "g9", "new")], ROW)
    assert t.change(lambda old: upsert(old, new, ["k"]), new) == 2
    want = {(k, f"g{k % 2}", "old") for k in range(20) if k != 3} | {(3, "g1", "new"), (99, "g9", "new"), (None, "g0", "none")}
    assert set(rows_of(t.read())) == want and t.read().count() == len(want) and set(rows_of(t.read(1))) == set(rows_of(first))
    assert t.change(lambda old: old.where("k <> 3"), new) == 3
    assert (3, "g1", "new") not in rows_of(t.read()) and t.read().count() == len(want) - 1
    t.clean()
    assert t.read().count() == len(want) - 1


def test_failed_write_leaves_the_old_state(spark, tmp_path):
    t = BucketTable(spark, f"file://{tmp_path}/t", ROW, ["k"], buckets=3)
    first = spark.createDataFrame([(k, "g", "old") for k in range(12)], ROW)
    t.change(lambda old: first, first)
    bad = first.withColumn("v", F.when(F.col("k") == 7, F.raise_error(F.lit("lost"))).otherwise("new").cast("string"))
    with pytest.raises(Exception, match="lost"):
        t.change(lambda old: upsert(old, bad, ["k"]), first)
    assert rows_of(t.read()) == rows_of(first) and t.log.versions() == [1]
    # killed between the data and the end of the pointer
    (tmp_path / "t/log/000000000002.json").write_text('{"where": {"0": "da')
    assert rows_of(t.read()) == rows_of(first)
    new = first.withColumn("v", F.lit("new"))
    assert t.change(lambda old: new, first) == 3 and rows_of(t.read()) == rows_of(new)


def test_second_of_two_writers_fails(spark, tmp_path):
    t = BucketTable(spark, f"file://{tmp_path}/t", ROW, ["k"], buckets=2)
    rows = spark.createDataFrame([(1, "a", "x")], ROW)

    def slow(old):
        BucketTable(spark, f"file://{tmp_path}/t", ROW, ["k"]).change(lambda o: rows, rows)
        return old

    with pytest.raises(Conflict):
        t.change(slow, rows)
    assert rows_of(t.read()) == [(1, "a", "x")]
    with pytest.raises(ValueError, match="not touched"):
        t.change(lambda old: spark.range(50).select(F.col("id").alias("k"), F.lit("g").alias("g"), F.lit("v").alias("v")), rows)


def test_scoped_merge_through_the_sink(spark, tmp_path):
    """Rows of the source's scopes that it lacks go, in the buckets of these scopes alone."""
    t = BucketTable(spark, f"file://{tmp_path}/t", ROW, ["g"], buckets=8)
    first = spark.createDataFrame([(k, f"g{k % 3}", "old") for k in range(9)], ROW)
    t.change(lambda old: first, first)
    before = t.log.state()[1]["where"]
    new = spark.createDataFrame([(0, "g0", "new"), (30, "g0", "new")], ROW)
    t.change(lambda old: merge_scoped(old, new, "k", ["g"]), new)
    assert rows_of(t.read()) == sorted([(k, f"g{k % 3}", "old") for k in range(9) if k % 3] + [(0, "g0", "new"), (30, "g0", "new")], key=str)
    after = t.log.state()[1]["where"]
    assert sum(before[b] != after[b] for b in before) == 1


def test_incremental_runs(spark, tmp_path, monkeypatch):
    folder = tmp_path / "notes"
    folder.mkdir()
    texts = {f"n{k}.md": f"# Note {k}\n\nText of note {k}.\n\n## Part\n\nMore." for k in range(5)}
    for n, t in texts.items():
        (folder / n).write_text(t)
    store = Ingest(spark, f"file://{tmp_path}/store", buckets=4)

    def held():
        return {(r.path.rsplit("/", 1)[1], r.ord, r.content) for r in store.chunks.read().collect()}

    def want():
        return {(n, c[0], c[1]) for n, t in texts.items() for c in chunk(t)}

    assert store.run_folder(str(folder), 1) == {"new": 5} and held() == want()
    versions = (store.files.log.versions(), store.chunks.log.versions())
    assert store.run_folder(str(folder), 2) == {} and (store.files.log.versions(), store.chunks.log.versions()) == versions
    texts["n1.md"] = "# Other\n\nText."
    (folder / "n1.md").write_text(texts["n1.md"])
    texts["n9.md"] = "New."
    (folder / "n9.md").write_text("New.")
    del texts["n2.md"]
    (folder / "n2.md").unlink()
    # a run that fails after its marks leaves the old chunks; the next one does all of its work
    with monkeypatch.context() as m:
        m.setattr(store.chunks, "change", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            store.run_folder(str(folder), 3)
    assert ("n2.md", 0, chunk("# Note 2\n\nText of note 2.\n\n## Part\n\nMore.")[0][1]) in held()
    assert store.run_folder(str(folder), 4) == {"stuck": 2, "deleted": 1} and held() == want()
    gone = store.files.read().where("deleted_at IS NOT NULL").collect()
    assert [(r.path.rsplit("/", 1)[1], r.state) for r in gone] == [("n2.md", "indexed")]
    # another chunker version takes all again, and a file that comes back is new
    (folder / "n2.md").write_text("Back.")
    texts["n2.md"] = "Back."
    later = Ingest(spark, f"file://{tmp_path}/store", version=store.version + 1)
    assert later.run_folder(str(folder), 5) == {"changed": 5, "new": 1} and held() == want()


def test_file_stream(spark, tmp_path):
    folder = tmp_path / "notes"
    folder.mkdir()
    for n in ("a", "b", "c"):
        (folder / f"{n}.md").write_text(f"Text of {n}.")
    store = Ingest(spark, f"file://{tmp_path}/store", buckets=2)
    listing = lambda: scan_folder(spark, str(folder)).select(F.regexp_extract("path", "([^/]+)$", 1).alias("path"), "content")

    def events(n):
        return {(r.path, r.action, r.to_path) for r in store.events.read().where(F.col("batch") == n).collect()}

    assert store.batch(listing(), 0, 1) and events(0) == {("a.md", "created", None), ("b.md", "created", None), ("c.md", "created", None)}
    (folder / "a.md").write_text("Other text.")
    (folder / "b.md").rename(folder / "z.md")
    (folder / "c.md").unlink()
    assert store.batch(listing(), 1, 2)
    want = {("a.md", "changed", None), ("b.md", "renamed", "z.md"), ("c.md", "deleted", None)}
    assert events(1) == want and {r.path for r in store.chunks.read().collect()} == {"a.md", "z.md"}
    (folder / "d.md").write_text("Late.")
    assert not store.batch(listing(), 1, 3) and events(1) == want  # a replayed batch changes nothing
    assert not store.batch(listing(), 0, 3) and store.events.read().count() == 6


def test_watch(spark, tmp_path):
    folder = tmp_path / "notes"
    folder.mkdir()
    (folder / "a.md").write_text("Text.")
    store = Ingest(spark, f"file://{tmp_path}/store", buckets=2)
    q = store.watch(lambda: scan_folder(spark, str(folder)).select("path", "content"), f"file://{tmp_path}/c", lambda: 1, "1 second")
    try:
        for _ in range(100):
            if store.chunks.read().count():
                break
            time.sleep(1)
        assert q.exception() is None and [r.action for r in store.events.read().collect()] == ["created"]
    finally:
        q.stop()
