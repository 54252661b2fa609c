"""Operators that no query with SQL covers in full, against plain versions on small fixtures."""

from __future__ import annotations

import hashlib
import json
import random

import numpy as np
from pyspark.sql import functions as F

from quillspark.functions.stemming import stems
from quillspark.operators import graph, retrieval, similarity, tags
from quillspark.sources import blobs, events, markdown
from quillspark.streaming import folds


def test_stems(spark):
    """Words and stems as published with the algorithm."""
    pairs = "caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration digitizer digit operator oper feudalism feudal decisiveness decis hopefulness hope formaliti formal sensibiliti sensibl triplicate triplic formalize formal electrical electr goodness good revival reviv allowance allow inference infer adjustable adjust replacement replac adoption adopt communism commun activate activ effective effect probate probat rate rate cease ceas controll control roll roll été été 42 42".split()
    got = spark.createDataFrame([(pairs[::2],)], "t array<string>").select(stems(F.col("t")).alias("s")).first().s
    assert got == pairs[1::2]


def unit(x):
    return (x / np.linalg.norm(x)).tolist()


def test_similar_pairs_are_all_found(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    rows = [(k, unit(centres[k % 6] + 0.4 * rng.normal(size=8))) for k in range(150)] + [(200 + k, unit(centres[0])) for k in range(20)] + [(300, None)]
    d = spark.createDataFrame(rows, "tag int, embedding array<double>")
    plain = {k: np.array(v) for k, v in rows if v is not None}
    want = {(a, b) for a in plain for b in plain if a < b and round(float(plain[a] @ plain[b]), 6) >= 0.85}
    for block in (7, 2048):
        got = {(r.a, r.b) for r in similarity.similar_pairs(d, 0.85, block=block).collect()}
        # copies (200 to 219) are linked with their first alone, and only it with others
        further = set(range(201, 220))
        assert got == {p for p in want if not further & set(p)} | {(200, k) for k in further}
    dup = {r.id: (r.best, r.cosine) for r in tags.near_duplicates(d.withColumnRenamed("tag", "id"), 0.85).collect()}
    for a in plain:
        others = sorted((-round(float(plain[a] @ plain[b]), 6), b) for b in plain if b != a)
        assert (a in dup) == (-others[0][0] >= 0.85) and (a not in dup or dup[a][0] == others[0][1])


def test_nearest_in_blocks_with_ties(spark):
    rng = np.random.default_rng(6)
    rows = [(k, unit(rng.normal(size=5))) for k in range(40)] + [(100 + k, unit(np.ones(5))) for k in range(10)] + [(300, None), (301, [1.0])]
    v = spark.createDataFrame(rows, "id int, embedding array<double>").repartition(3)
    q = spark.createDataFrame([(f"q{k}", r[1]) for k, r in enumerate(rows[:20] + rows[-4:])], "query_id string, embedding array<double>")
    plain = {k: np.array(x) for k, x in rows if x is not None and len(x) == 5}
    for most in (4096, 6):
        got = {}
        for r in similarity.nearest(v, q, "id", 4, most=most).collect():
            got.setdefault(r.query_id, {})[r["rank"]] = r.id
        for k, (_, x) in enumerate(rows[:20] + rows[-4:]):
            if x is None or len(x) != 5:
                assert x is not None or f"q{k}" not in got
                continue
            order = sorted(plain, key=lambda i: (-round(min(max(float(plain[i] @ np.array(x)), 0), 1), 9), i))
            assert [got[f"q{k}"][n] for n in (1, 2, 3, 4)] == order[:4]


def test_closing_edges_against_reachability(spark):
    rng = random.Random(3)
    for n, m in ((8, 12), (20, 30), (5, 0)):
        e = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}
        reach = {(a, a) for a in range(n)} | e
        for _ in range(n):
            reach |= {(a, d) for a, b in reach for c, d in e if b == c}
        got = {(r.src, r.dst) for r in graph.closing_edges(spark.createDataFrame(list(e), "src int, dst int")).collect()}
        assert got == {(a, b) for a, b in e if (b, a) in reach}


def test_phrases_and_any_term(spark):
    d = spark.createDataFrame([(1, "red apples and green pears"), (2, "green apples and red pears"), (3, "plums")], "chunk_id int, content string")
    q = spark.createDataFrame([(1, 'pears "red apples"'), (2, "red apples"), (3, '"" plums'), (4, "red plums"), (5, "")], "query_id int, text string")
    found = lambda every: {(r.query_id, r.chunk_id) for r in retrieval.bm25(d, q, every=every).collect()}
    assert found(True) == {(1, 1), (2, 1), (2, 2), (3, 3)}
    assert found(False) == {(1, 1), (2, 1), (2, 2), (3, 3), (4, 1), (4, 2), (4, 3)}


def test_blobs(spark, tmp_path):
    data = [b"short", b"a" * 1000, random.Random(1).randbytes(400), b"", b"a" * 1000, None]
    path = str(tmp_path / "store")
    blobs.write(spark.createDataFrame([(bytearray(b) if b is not None else None,) for b in data[:3]], "data binary"), path)
    blobs.write(spark.createDataFrame([(bytearray(b) if b is not None else None,) for b in data], "data binary"), path)
    stored = {r.content_hash: r for r in spark.read.parquet(path).collect()}
    names = {hashlib.sha256(b).hexdigest(): b for b in data if b is not None}
    assert stored.keys() == names.keys() and spark.read.parquet(path).count() == 4
    assert [stored[hashlib.sha256(b).hexdigest()].encoding for b in data[:4]] == ["identity", "zstd", "identity", "identity"]
    bad = spark.createDataFrame([("f" * 64, "zstd", bytearray(b"no"), 2), ("e" * 64, "identity", bytearray(b"no"), 2)], "content_hash string, encoding string, data binary, original_size bigint")
    bad.write.mode("append").parquet(path)
    wanted = spark.createDataFrame([(h,) for h in [*names, "f" * 64, "e" * 64, "0" * 64]], "content_hash string")
    got = {r.content_hash: (None if r.data is None else bytes(r.data), r.state) for r in blobs.read(spark, path, wanted).collect()}
    assert got == {h: (b, "ok") for h, b in names.items()} | {"f" * 64: (None, "corrupt"), "e" * 64: (None, "corrupt"), "0" * 64: (None, "missing")}


def test_scan_of_folders_and_logs(spark, tmp_path):
    for name, text in {"a.md": "# One", "sub/b.md": "two", ".hidden/c.md": "no", "drafts/d.md": "no", "e.txt": "no"}.items():
        f = tmp_path / name
        f.parent.mkdir(exist_ok=True)
        f.write_text(text)
    got = {r.path.rsplit("/", 1)[1]: r.content for r in markdown.scan_folder(spark, str(tmp_path), ignore="/drafts/").collect()}
    assert got == {"a.md": "# One", "b.md": "two"}
    log = tmp_path / "log.jsonl"
    rows = [{"event_id": "e1", "task_id": "t1", "record_id": "r1", "timestamp": 5, "actor": "x", "event_type": "task_created", "event_version": 1, "payload": {"title": "T", "tags": ["a"]}}]
    log.write_text("\n".join([*map(json.dumps, rows), "{broken", ""]))
    one = events.read_task_events(spark, str(log)).collect()
    assert [(r.event_id, r.task_id, json.loads(r.payload)["title"]) for r in one] == [("e1", "t1", "T")]
    assert [r.record_id for r in events.read_record_events(spark, str(log)).collect()] == ["r1"]


def test_externals(spark):
    def e(k, kind, **payload):
        return (k, "t", k * 10, kind, json.dumps({"source": "gh", "external_id": "1"} | payload))

    log = [e(1, "external_id_added"), e(2, "external_blocker_added"), e(3, "external_blocker_resolved", resolved_at=99), e(4, "external_id_removed", external_id="2"), e(5, "external_blocker_added", external_id="3"), e(6, "external_id_removed", external_id="3")]
    d = spark.createDataFrame(log, "event_id int, task_id string, timestamp bigint, event_type string, payload string")
    assert [tuple(r) for r in folds.fold_externals(d).collect()] == [("t", "gh", "1", 1, 99)]


def test_chunks_of_headed_texts(spark):
    """Sections become chunks of their own; byte ranges cover the text, and contents are what lies in them."""
    text = "Lead é.\n\n# One\n\nFirst. Second.\n\n## Two\n\n" + "A sentence that fills. " * 200 + "\n\n# Three\n"
    got = sorted(markdown.chunk_documents(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, text string")).collect(), key=lambda r: r.ord)
    raw = text.encode()
    assert {r.doc_id for r in got} == {1} and [r.ord for r in got] == list(range(len(got)))
    assert [got[0].heading_path, got[1].heading_path, got[2].heading_path] == ["", "# One", "# One > ## Two"]
    assert all(r.token_estimate <= 400 and r.content in raw[r.byte_start : r.byte_end].decode() for r in got)
    assert "".join("".join(r.content.split()) for r in got) == "".join(("Lead é. First. Second. " + "A sentence that fills. " * 200).split())


def test_expanded_digests(spark):
    """Tags of several classes, of unknown ones, and classes whose members are listed once and not by tag."""
    import hashlib

    from quillspark.operators import tags

    pairs = [("Ab", "x"), ("b", "x"), ("b", "y"), ("c", "y"), ("C", "z"), (None, "x"), ("d", None), ("b", "x"), *((f"m{k}", "big") for k in range(600))]
    asked = [(1, "Ab"), (2, "b"), (3, "c"), (4, "C"), (5, "d"), (6, "Other"), (7, None), (8, "b"), *((100 + k, f"m{k}") for k in range(600))]
    out = tags.expanded_digests(spark.createDataFrame(asked, "id int, tag string"), spark.createDataFrame(pairs, "tag string, canonical string"))
    got = {r.id: r.tags for r in out.collect()}

    def want(t):
        own = {c for a, c in pairs if a == t and c}
        return t and hashlib.sha256(",".join(sorted({t.lower()} | {a.lower() for a, c in pairs if a and c in own})).encode()).hexdigest()

    assert got == {k: want(t) for k, t in asked} and len(asked) == out.count()


def test_compact_ids_by_groups(spark):
    """Against all prefixes, with groups of a few ids; ids are not multiplied by their prefixes."""
    import random

    from test_inverted import most_rows

    from quillspark.operators import tasks

    r = random.Random(3)
    ids = [*{"T-" + "".join(r.choice("ab\u00e9") for _ in range(r.randint(0, 9))) for _ in range(300)}, "T-a", "T-" + "a" * 90, "T-" + "a" * 89 + "b", "T-a"]
    for some, least, most in ((ids, 3, 5), (ids, 4, 10_000), (ids[:1], 3, 5), ([*ids, "x", None], 1, 4)):
        out = tasks.compact_ids(spark.createDataFrame([(x,) for x in some], "task_id string"), least, most)
        rows = out.collect()
        own = {x for x in some if x is not None}
        want = {x: next((x[:n] for n in range(min(least, len(x)), len(x) + 1) if not any(o != x and o.startswith(x[:n]) for o in own)), x) for x in own} | ({None: None} if None in some else {})
        assert {x.task_id: x.short_id for x in rows} == want and len(rows) == len(want)
        assert most_rows(out._jdf.queryExecution().executedPlan()) <= len(some)


def test_pairs_are_reduced_where_they_are_found(spark):
    """Vectors that are all alike: tasks give links and best pairs by vector, not all pairs."""
    from test_inverted import most_rows

    rng = np.random.default_rng(6)
    rows = [(k, unit(np.array([1.0, 0, 0, 0]) + 0.05 * rng.normal(size=4))) for k in range(200)] + [(200 + k, unit(np.array([0, 1.0, 0, 0]) + 0.05 * rng.normal(size=4))) for k in range(3)]
    d = spark.createDataFrame(rows, "tag int, embedding array<double>")
    sims = {k: np.round(np.clip(np.array([u for _, u in rows]) @ np.array(v), -1, 1), 6) for k, v in rows}
    for block, products in ((64, 1000), (16_384, 1 << 22)):
        links = similarity.similar_links(d, 0.85, block=block, products=products)
        got = {frozenset(r) for r in links.collect()}
        groups = {k: k for k, _ in rows}
        for a, b in got:
            x, y = groups[a], groups[b]
            groups = {k: min(x, y) if g in (x, y) else g for k, g in groups.items()}
        assert groups == {k: 0 if k < 200 else 200 for k, _ in rows}
        best = similarity.closest(d, 0.85, block=block, products=products)[0]
        assert {r.a: (r.b, r.cosine) for r in best.collect()} == {k: max(((j, float(c)) for j, c in enumerate(s) if j != k), key=lambda x: (x[1], -x[0])) for k, s in sims.items()}
        assert all(most_rows(x._jdf.queryExecution().executedPlan()) < 200 * 199 / 2 for x in (links, best))
