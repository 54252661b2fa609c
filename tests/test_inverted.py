"""The stored index against BM25 over the texts, as texts come, change and go."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions.stemming import stems
from quillspark.operators.inverted import InvertedIndex
from quillspark.operators.retrieval import bm25

DOCS, ASKED = "chunk_id bigint, content string", "query_id bigint, text string"


def texts(r, ids):
    return [(k, " ".join(r.choice(["the", "the", "a", "of", *(f"w{i}" for i in range(40))]) + r.choice(["", "", "."]) for _ in range(r.randint(0, 40)))) for k in ids]


def same(spark, index, rows, k, queries):
    docs, q = spark.createDataFrame(rows, DOCS), spark.createDataFrame(queries, ASKED)
    for every in (True, False):
        want = {(x.query_id, x.chunk_id, x.rank, round(x.bm25, 6)) for x in bm25(docs, q, k=k, every=every, stem=index.stem).collect()}
        got = {(x.query_id, x.chunk_id, x.rank, round(x.bm25, 6)) for x in index.search(q, k, every, docs).collect()}
        assert got == want and want


@pytest.mark.parametrize(("slot", "stem"), [(4, None), (1000, stems)])
def test_index(spark, tmp_path, slot, stem):
    r = random.Random(slot)
    rows = dict(texts(r, range(120)) + [(200, None), (201, ""), (202, "!!")])
    queries = [(1, "the w1"), (2, "w2 w3 the of"), (3, 'w5 "the w7"'), (4, "absent w1"), (5, None), (6, "a"), (7, "The W9 w9 of a the w11 w12")]
    index = InvertedIndex(spark, f"file://{tmp_path}/index", stem=stem, buckets=5, slot=slot)
    index.build(spark.createDataFrame(sorted(rows.items()), DOCS))
    same(spark, index, sorted(rows.items()), 7, queries)
    changed, gone = dict(texts(r, [1, 2, 3, 300, 301])), [4, 5, 999]
    rows = {k: t for k, t in (rows | changed).items() if k not in gone}
    index.update(spark.createDataFrame(sorted(changed.items()), DOCS), spark.createDataFrame([(k,) for k in gone], "chunk_id bigint"))
    same(spark, index, sorted(rows.items()), 7, queries)
    again = dict(texts(r, [2, 4, 301]))
    rows |= again
    index.update(spark.createDataFrame(sorted(again.items()), DOCS))
    same(spark, index, sorted(rows.items()), 50, queries)
    index.merge()
    same(spark, index, sorted(rows.items()), 7, queries)
    index.clean()
    same(spark, index, sorted(rows.items()), 7, queries)
    assert len(index.log.state()[1]["runs"]) == 1 and len(index.log.names("data")) == 2


def test_reads_asked_terms_alone(spark, tmp_path):
    index = InvertedIndex(spark, f"file://{tmp_path}/index", buckets=16)
    index.build(spark.createDataFrame(texts(random.Random(1), range(100)), DOCS))
    asked = spark.createDataFrame([("w1",)], "term string")
    plan = index._blocks(index.log.state()[1], asked)._jdf.queryExecution().executedPlan().toString()
    assert "of#" in plan.split("PartitionFilters: [")[1].split("]")[0] and "EqualTo(term,w1)" in plan


def test_failed_update_leaves_the_index(spark, tmp_path):
    rows = texts(random.Random(2), range(50))
    index = InvertedIndex(spark, f"file://{tmp_path}/index", buckets=3)
    index.build(spark.createDataFrame(rows, DOCS))
    bad = spark.range(3).select(F.col("id").alias("chunk_id"), F.when(F.col("id") == 2, F.raise_error(F.lit("lost"))).otherwise("w1").cast("string").alias("content"))
    with pytest.raises(Exception, match="lost"):
        index.update(bad)
    same(spark, InvertedIndex(spark, f"file://{tmp_path}/index"), rows, 5, [(1, "w1"), (2, "the a")])


def test_empty(spark, tmp_path):
    index = InvertedIndex(spark, f"file://{tmp_path}/index")
    q = spark.createDataFrame([(1, "w1")], ASKED)
    with pytest.raises(ValueError, match="no index"):
        index.search(q)
    index.build(spark.createDataFrame([], DOCS))
    assert index.search(q).count() == index.search(q, every=False).count() == 0
    index.update(spark.createDataFrame([(1, "w1 w2")], DOCS))
    assert [(x.chunk_id, x.bm25) for x in index.search(q).collect()] == [(1, 1.0)]


def most_rows(plan):
    """The most rows that a node of an executed plan gave."""
    kind = plan.getClass().getSimpleName()
    below = [plan.finalPhysicalPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if kind.endswith("QueryStageExec") else [plan.children().apply(k) for k in range(plan.children().size())]
    rows = plan.metrics().get("numOutputRows")
    return max([rows.get().value() if rows.isDefined() else 0, *map(most_rows, below)])


def test_common_term_is_looked_up_in_the_rarest_terms_slots(spark, tmp_path):
    n = 600
    index = InvertedIndex(spark, f"file://{tmp_path}/index", buckets=2, slot=4)
    index.build(spark.createDataFrame([(k, f"order {k}") for k in range(n)], DOCS), changes=False)
    found = index.search(spark.createDataFrame([(k, f"Order {k}") for k in range(n)], ASKED), 3)
    assert sorted((x.query_id, x.chunk_id, x.rank) for x in found.collect()) == [(k, k, 1) for k in range(n)]
    assert most_rows(found._jdf.queryExecution().executedPlan()) <= 10 * n  # not queries by slots: n * n / 4


@pytest.mark.parametrize(("slot", "stem"), [(4, None), (1000, stems)])
def test_index_for_reading_alone(spark, tmp_path, slot, stem):
    rows = [*texts(random.Random(slot), range(120)), (200, None), (201, ""), (202, "!!")]
    index = InvertedIndex(spark, f"file://{tmp_path}/index", stem=stem, buckets=5, slot=slot)
    docs = spark.createDataFrame(rows, DOCS)
    index.build(docs, changes=False)
    same(spark, index, rows, 7, [(1, "the w1"), (2, "w2 w3 the of"), (3, 'w5 "the w7"'), (4, "absent w1"), (5, None), (6, "a"), (7, "The W9 w9 of a the w11 w12")])
    assert not any(n.startswith("forward") for n in index.log.names("data"))
    state = index.log.state()[1]
    for change in (lambda: index.update(docs), index.merge):
        with pytest.raises(ValueError, match="reading alone"):
            change()
    index.build(docs)
    assert {n: index.log.state()[1][n] for n in ("n_docs", "total")} == {n: state[n] for n in ("n_docs", "total")}
    index.update(spark.createDataFrame([(1, "w1")], DOCS))
    empty = InvertedIndex(spark, f"file://{tmp_path}/empty")
    empty.build(spark.createDataFrame([], DOCS), changes=False)
    assert empty.search(spark.createDataFrame([(1, "w1")], ASKED)).count() == 0


def test_texts_are_read_for_phrases_alone(spark, tmp_path):
    index = InvertedIndex(spark, f"file://{tmp_path}/index", buckets=2)
    index.build(spark.createDataFrame([(1, "w1 w2"), (2, "w1")], DOCS), changes=False)
    lost = spark.range(1, 3).select(F.col("id").alias("chunk_id"), F.raise_error(F.lit("read")).cast("string").alias("content"))
    plain, quoted = spark.createDataFrame([(1, "w1")], ASKED), spark.createDataFrame([(1, '"w1 w2"')], ASKED)
    assert index.search(plain, texts=lost).count() == 2
    with pytest.raises(Exception, match="read"):
        index.search(quoted, texts=lost).collect()
