"""The corpus pipeline on the smallest tables, and on documents with edge cases."""

from __future__ import annotations

import re

import pyarrow as pa
from conftest import SMALL
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm.common import DOCUMENT_COLUMNS, table
from quillspark.llm.sentencepiece_scan import decode
from quillspark.llm.vocabulary import vocabulary


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    ws = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return frozenset(tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))) if ws else frozenset()


def test_stages(spark):
    d = table(spark, SMALL, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_jaccard", "decontaminate", "sentencepiece"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in d.collect()}
        d = spark.createDataFrame(stage(spark, d, SMALL).toPandas(), d.select(*DOCUMENT_COLUMNS).schema)
        assert d.columns == list(DOCUMENT_COLUMNS)
        after = {r.doc_id: r for r in d.collect()}
        assert after.keys() <= before.keys()
        if name == "line_dedup":
            assert after.keys() == before.keys() and all(r.n_chars == len(r.text) for r in after.values())
        elif name == "language_id":
            assert sum(r.lang == before[k].lang for k, r in after.items()) >= 0.9 * len(before)
        elif name == "ngram_jaccard":
            rows = [shingles(r.text) for r in after.values()]
            assert not any(a and b and 100 * len(a & b) >= 80 * len(a | b) for i, a in enumerate(rows) for b in rows[:i])
            for k in before.keys() - after.keys():
                s = shingles(before[k].text)
                assert any(100 * len(s & shingles(r.text)) >= 80 * len(s | shingles(r.text)) for j, r in before.items() if j != k)
        else:
            items = [words(r.text) for r in table(spark, SMALL, "benchmark").collect()]
            grams = {tuple(w[i : i + 10]) for w in items for i in range(max(1, len(w) - 9)) if w}
            dirty = {k for k, r in before.items() if any(tuple(words(r.text)[i : i + 10]) in grams for i in range(len(words(r.text))))}
            assert before.keys() - after.keys() == dirty


def test_shared_lines_go_everywhere(spark):
    """A line that goes from one source goes from each source that has it in many texts."""
    d = table(spark, "/root/testdata/sf0.1", "documents")
    after = corpus_pipeline.drop_boilerplate(spark, d, SMALL)

    def lines(docs):
        x = docs.select("source", "text", F.explode(F.array_distinct(F.transform(F.split("text", "\n"), lambda l: F.btrim(l)))).alias("line")).where("line <> ''")
        return {(r.source, r.line) for r in x.groupBy("source", "line").agg(F.count_distinct("text").alias("n")).where("n >= 40").collect()}

    before, left = lines(d), lines(after)
    gone = {line for _, line in before - left}
    assert len({s for s, _ in before}) == 20 and gone and not [x for x in left if x[1] in gone]


def test_lines_of_small_sources(spark):
    rows = [(k, f"menu\nown {k}", "en", "two", 1) for k in range(2)] + [(10 + k, "menu\nsame", "en", "copies", 1) for k in range(3)] + [(20, "menu\nalone", "en", "one", 1)]
    rows += [(30 + k, f"{'menu' if k < 3 else 'other'}\nown {k}", "en", "fifty", 1) for k in range(50)] + [(90 + k, f"menu\nown {k}", "en", None, 1) for k in range(2)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_boilerplate(spark, d, SMALL).collect()}
    assert [got[k] for k in (0, 1, 10, 11, 12, 20)] == ["own 0", "own 1", "menu\nsame", "menu\nsame", "menu\nsame", "menu\nalone"]
    assert got[30] == "menu\nown 0" and got[79] == "own 49" and got[90] == "menu\nown 0"  # 6 % is not over the ratio


def test_near_copies_do_not_strip_each_other(spark):
    """Two near copies in a small source keep what they share; a notice on other pages goes from them too."""
    text = [f"line {k} of a text that two pages share" for k in range(9)]
    rows = [(k, "\n".join(["a notice", *text, f"own end {k}"]), "en", "s", 1) for k in range(2)] + [(2 + k, f"{'a notice' if k < 6 else 'none'}\nown {k}\nmore {k}", "en", "s", 1) for k in range(20)]
    rows += [(100 + k, "\n".join([*text, f"own end {k}"]), "en", "two", 1) for k in range(2)]
    rows += [(200 + k, "\n".join([*text, f"own {k}"]), "en", "shop", 1) for k in range(12)]
    rows += [(300, None, "en", "s", 1), (301, " \n", "en", "s", 1), (302, LONG, "en", "long", 1), (303, LONG + "\nx", "en", "long", 1), (302, LONG, "en", "long", 1)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_boilerplate(spark, d, SMALL).collect()}
    assert all(got[k] == "\n".join([*text, f"own end {k % 100}"]) for k in (0, 1, 100, 101)) and got[2] == "own 0\nmore 0"
    assert got[200] == "own 0"  # nearly all of a source's pages, ten at least: boilerplate
    assert got[302] == LONG and got[303] == LONG + "\nx" and got[300] is None


LONG = "\n".join(f"line {k} of a very long text" for k in range(50_000))


def test_run(spark):
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert got and all(r.round_trip and r.n_ids == len(r.ids) for r in got)
    assert all(decode(vocabulary().spelt, pa.array([r.ids], pa.list_(pa.int32())))[0] for r in got)


def test_edges(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "the cat sat on the mat", "en", "s", 9), (3, "the cat sat on the mat", "en", "s", 9), (None, "the dog ran to the house", "en", None, 9), (4, "1 2 3", None, "s", 5), (5, "die Katze und der Hund", "de", "s", 5)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in corpus_pipeline.STAGES:
        d = stage(spark, d.select("*", F.lit("no").alias("TEXT")), SMALL)
    assert sorted(r.n_ids > 0 for r in d.collect()) == [True] * d.count()
    empty = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SMALL)
    assert empty.count() == 0
