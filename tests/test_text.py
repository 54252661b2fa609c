"""Text scalars on small inputs, ties and edges."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators.episodes import head_or_all


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "s string").select(expr(F.col("s"))).first()[0]


def test_bytes_count_not_characters(spark):
    assert one(spark, "é日本", T.estimate_tokens) == 2
    assert one(spark, "", T.estimate_tokens) == 0


@pytest.mark.parametrize("a,b", [("hello   \nworld\n", "hello\r\nworld\r\n"), ("", "  "), ("a\t\nb", "a\nb")])
def test_hash_classes(spark, a, b):
    assert one(spark, a, T.content_hash) == one(spark, b, T.content_hash)


def test_hash_differs(spark):
    assert one(spark, "a\n\n", T.content_hash) != one(spark, "a", T.content_hash)


def test_head_keeps_characters_whole(spark):
    s = "é" * 150
    assert one(spark, s, lambda c: T.head(c, 201)) == "é" * 101
    assert one(spark, s, head_or_all) == "é" * 100
    assert one(spark, "a" + s, head_or_all) == "a" + s
    assert one(spark, "short", head_or_all) == "short"


def test_cut_at_word(spark):
    assert one(spark, "ab " * 200, lambda c: T.cut_at_word(c, 400)) == ("ab " * 200)[:399].rstrip()
    assert one(spark, "x" * 500, lambda c: T.cut_at_word(c, 400)) == "x" * 400


def test_chunk_l0(spark):
    s = "Use `foo_bar` now. Then API_KEY and HttpServer, `foo_bar`."
    assert one(spark, s, lambda c: T.chunk_l0(F.lit("# A"), c)) == "# A: Use `foo_bar` now. | foo_bar, API_KEY, HttpServer"
    assert one(spark, "  ", lambda c: T.chunk_l0(F.lit("# A"), c)) == "# A"


def test_episode_l0(spark):
    assert one(spark, "Goal: fix it\nOutcome: done", T.episode_l0) == "fix it"
    assert one(spark, "Goal:\nOutcome:\nOutcome: done", T.episode_l0) == "done"
    assert one(spark, "", T.episode_l0) == ""


def test_titled_abstracts(spark):
    assert one(spark, "First.\n\nSee `ab`.", lambda c: T.reflection_l0(F.lit("T"), c)) == "T: First.. Key: ab"
    assert one(spark, "step one\nstep two", lambda c: T.procedure_l0(F.lit(""), c)) == "step one"
    assert one(spark, "a\n\nb\n\nc\n\nd API_KEY", T.extractive_l1) == "a\n\nb\n\nc\n\n...\n\nKey terms: API_KEY"


def test_capsules(spark):
    assert one(spark, "One. Two.", lambda c: T.stub_capsule(F.lit(" T "), c)) == "T — One."
    assert one(spark, None, lambda c: T.stub_capsule(F.lit(None).cast("string"), c)) == ""
    assert one(spark, "Do it. Now", lambda c: T.task_capsule(F.lit("T"), c, F.array(F.lit("a"), F.lit("b")), F.lit(1))) == "T. Do it.. Tags: a, b. Priority: high."
    assert one(spark, None, lambda c: T.outcome_capsule(F.lit("T"), c)) == "T. Completed."
    assert one(spark, "Text...", lambda c: T.record_capsule(F.lit("T"), F.lit("plan"), c, F.array().cast("array<string>"))) == "T. Kind: plan. Text."
    assert one(spark, "ab. " * 200, lambda c: T.record_abstract(F.lit("T"), c, F.array(F.lit("x")))) == "T\n\n" + ("ab. " * 125)[:499] + "\n\nTags: x"


def test_links(spark):
    got = one(spark, "[[a|b]] ![i](p.png) [x](http://y) [[c]] [z](rel.md)", T.extract_links)
    assert [tuple(r) for r in got] == [("a", "b", "wiki"), ("c", "c", "wiki"), ("http://y", "x", "external"), ("rel.md", "z", "markdown")]


def test_uris(spark):
    parts = lambda c: T.uri_parts(c, "kb")
    assert tuple(one(spark, "kb://s/record/r1", parts)) == ("s", "record", "r1")
    assert one(spark, "kb://s/record/r1/x", parts) is None
    assert one(spark, "kb://s/other/r1", parts) is None


def test_times(spark):
    assert one(spark, "x", lambda c: T.ts_to_iso(F.lit(1_700_000_000))) == "2023-11-14T22:13:20+00:00"
    for s, want in (("2023-11-14T22:13:20Z", 1_700_000_000), ("2023-11-14T23:13:20+01:00", 1_700_000_000), ("2023-11-14T22:13:20", 1_700_000_000), ("17", 17), ("soon", None), (None, None)):
        assert one(spark, s, T.parse_timestamp) == want
    assert T.time_scope("7d", 1_000_000) == 1_000_000 - 7 * 86400
    assert T.time_scope("-7d", 1) is None and T.time_scope("7", 1) is None and T.time_scope("", 1) is None


def test_queries_and_prefixes():
    assert T.sanitize_query('foo "a b" bar-baz "open') == '"foo" "a b" "bar-baz" "open"'
    assert [T.project_prefix(n) for n in ("data_store", "b2c-gateway", "the-02", "a b c", "eo")] == ["DST", "BGT", "BRN", "ABC", "EOX"]


def test_backoff(spark):
    got = [one(spark, "x", lambda c, n=n: T.backoff_seconds(F.lit(n))) for n in (0, 1, 2, 7, 50)]
    assert got == [30, 30, 60, 1920, 1920]
