"""Substring dedup, periodic runs and the filter audit against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F
from test_operators import DOCS, EDGES, docs, read

from quillspark.llm import filter_audit, periodic_runs, substring_dedup
from quillspark.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# --- substring dedup -----------------------------------------------------------------------------


def dedup(rows, width):
    """(doc_id, kept words, removed spans) of rows of (doc_id, text)."""
    last = 1 << 63
    ws = [WORD.findall(t or "") for _, t in rows]
    first = {}
    for (d, _), w in zip(rows, ws, strict=True):
        for i in range(len(w) - width + 1):
            at, g = (last if d is None else d, i), tuple(w[i : i + width])
            first[g] = min(first.get(g, at), at)
    out = []
    for (d, _), w in zip(rows, ws, strict=True):
        gone = {k for i in range(len(w) - width + 1) if first[tuple(w[i : i + width])] < (last if d is None else d, i) for k in range(i, i + width)}
        out.append((d, " ".join(x for k, x in enumerate(w) if k not in gone), len(w), len(gone)))
    return sorted(out, key=str)


def shared_texts(seed, n=60):
    """Texts of few words with passages and copies among them."""
    r = random.Random(seed)
    passages = [[f"p{r.randint(0, 9)}" for _ in range(r.randint(4, 40))] for _ in range(4)]
    rows = []
    for k in range(n):
        w = [f"w{r.randint(0, 30)}" for _ in range(r.randint(0, 30))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            at = r.randint(0, len(w))
            w[at:at] = p[r.randint(0, 3) : len(p) - r.randint(0, 3)]
        w += ["z"] * r.choice([0, 0, 0, 40])
        rows.append((r.randint(0, n), "  ".join(w)))
        if r.random() < 0.3:
            rows.append((k + n, rows[r.randrange(len(rows))][1]))
    return rows


@pytest.mark.parametrize(("width", "prefix", "most", "together"), [(6, 3, 50_000, 4 << 20), (6, 3, 2, 200), (6, 6, 1, 1), (20, 8, 50_000, 500), (1, 1, 50_000, 300)])
def test_substring_dedup(spark, monkeypatch, width, prefix, most, together):
    monkeypatch.setattr(substring_dedup, "TOGETHER", together)
    rows = shared_texts(width)
    d = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = substring_dedup.substring_dedup(d, width=width, prefix=prefix, most=most).collect()
    assert sorted(((r.doc_id, r.kept, r.n_words, r.n_removed) for r in got), key=str) == dedup(rows, width)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)


def test_substring_dedup_edges(spark):
    rows = [*EDGES, (7, EDGES[3][1] + " end", "en", "s", 1), (7, "other text of that id", "en", "s", 1), (None, EDGES[3][1], None, None, None)]
    got = substring_dedup.substring_dedup(docs(spark, rows), width=5, prefix=2).collect()
    assert sorted(((r.doc_id, r.kept, r.n_words, r.n_removed) for r in got), key=str) == dedup([r[:2] for r in rows], 5)
    assert substring_dedup.substring_dedup(spark.createDataFrame([], DOCS)).count() == 0


def test_word_hashes():
    texts = ["a bb  a", "", " \t", "bb a", "é\x85é bb", "x" * 50]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    for at_once in (1, 2, 100):
        w, first = substring_dedup.word_hashes(data, offsets, at_once)
        words = [x for t in texts for x in WORD.findall(t)]
        assert first.tolist() == [0, 3, 3, 3, 5, 7, 8] and len(w) == len(words)
        assert all((w[i] == w[j]) == (words[i] == words[j]) for i in range(len(w)) for j in range(i))


# --- periodic runs -------------------------------------------------------------------------------


def brute_runs(w, least=6, times=4):
    out = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i < len(w) - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if n >= max(least, times * q) and not any(all(w[k] == w[k + s] for k in range(i, i + n - s)) for s in range(1, q)):
                out.append((i, n, q))
            i = j
    return sorted(out, key=lambda x: (x[0], x[2]))


def collapsed(w, found):
    gone = {k for a, n, q in found for k in range(a + q, a + n)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


@pytest.mark.parametrize(("least", "times", "together"), [(6, 4, 4 << 20), (2, 2, 1), (3, 3, 300)])
def test_periodic_runs(spark, monkeypatch, least, times, together):
    monkeypatch.setattr(periodic_runs, "TOGETHER", together)
    r, rows = random.Random(least), []
    for k in range(250):
        w = [r.choice("abcdefgh"[: r.randint(1, 8)]) for _ in range(r.randint(0, 50))]
        if w and r.random() < 0.5:
            a = r.randrange(len(w))
            p = 1 + (len(w) - a) // r.randint(2, 9)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        rows.append((k, "\n ".join(w)))
    got = {x.doc_id: x for x in periodic_runs.periodic_runs(spark.createDataFrame(rows, "doc_id bigint, text string"), least=least, times=times).collect()}
    for k, t in rows:
        w = t.split()
        want = brute_runs(w, least, times)
        assert [tuple(x) for x in got[k].runs] == want and got[k].collapsed == collapsed(w, want) and got[k].n_words == len(w)


def test_periodic_runs_edges(spark):
    rows = [*EDGES, (8, "na " * 5000, "en", "s", 1), (9, "a b a b a b a b " * 3, "en", "s", 1)]
    got = periodic_runs.periodic_runs(docs(spark, rows), keep=("doc_id", "text")).collect()
    assert len(got) == len(rows)
    for x in got:
        w = WORD.findall(x.text or "")
        want = {8: [(0, 5000, 1)], 4: [(0, 24000, 6)]}.get(x.doc_id) or brute_runs(w)
        assert [tuple(r) for r in x.runs] == want and x.collapsed == collapsed(w, want)
    assert periodic_runs.periodic_runs(spark.createDataFrame([], DOCS)).count() == 0


def test_squares_split_rests(monkeypatch):
    """What is left of a class is smaller than a part of it, and so splits others."""
    used = []
    monkeypatch.setattr(periodic_runs, "_rest", lambda *a, f=periodic_runs._rest: used.append(1) or f(*a))
    r = random.Random(3)
    for _ in range(300):
        w = [int(r.random() < 0.1) for _ in range(r.randint(10, 60))]
        ids = np.array([5 + x for x in w] + [0])
        assert [tuple(x) for x in periodic_runs.runs(ids, np.full(len(ids), len(w) // 4)).tolist()] == brute_runs(w)
    assert used


def test_op12(spark):
    got = {r.doc_id: r for r in QUERIES["op12_periodic_runs"](spark, SMALL).collect()}
    rows = read(spark, "documents").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for doc_id, text in rows:
        w, h = WORD.findall(text or ""), zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        found, x = brute_runs(w) if len(w) < 3000 else None, got[doc_id]
        if found is None:
            continue
        best = max(found, key=lambda r: (r[1], -r[0], -r[2])) if found else (None,) * 3
        assert (x.n_runs, x.start, x.length, x.period) == (len(found), *best)
        assert x.exponent_milli == (1000 * best[1] // best[2] if found else None)
        assert x.runs_sha256 == sha("".join(f"{s},{n},{q}\n" for s, n, q in found)) and x.collapsed_sha256 == sha(collapsed(w, found))


# --- filter audit --------------------------------------------------------------------------------


def fails(text, doc_id, least):
    t = text or ""
    w = WORD.findall(t)
    got = (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)), doc_id is not None and least.get(t, doc_id) < doc_id)
    return {f for f, x in zip("ABCDE", got, strict=True) if x}


def audit(rows, labels):
    least = {}
    for d, t, *_ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    good, toxic = ({d for d, *m in labels if m[k] == 1 and d is not None} for k in (0, 1))
    out = {}
    for order in itertools.permutations("ABCDE"):
        for d, t, _, source, *_ in rows:
            bad, gone = fails(t, d, least), False
            for step, f in enumerate(order, 1):
                c = out.setdefault((source or "", "".join(order), step), Counter())
                removed = not gone and f in bad
                c["redundant"] += gone and f in bad
                c["removed"] += removed
                c["unique_fails"] += bad == {f}
                c["good_lost"] += removed and d in good
                c["toxic_lost"] += removed and d in toxic
                gone = gone or removed
                c["kept"] += not gone
    shapley = defaultdict(int)
    for (part, order, step), c in out.items():
        shapley[part, order[step - 1]] += c["removed"]
    return {k: tuple(c[x] for x in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")) + (shapley[k[0], k[1][k[2] - 1]],) for k, c in out.items()}


def audited(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def test_filter_audit(spark):
    r = random.Random(5)
    texts = [" ".join(r.choice(["one", "two", "Three", "F#UR", "five"]) + str(r.randint(0, n)) for _ in range(r.randint(30, 80))) for n in (1, 9, 99) for _ in range(8)]
    rows = [(r.randint(0, 300), r.choice(texts), "en", r.choice(["s", "t", None]), 1) for _ in range(150)] + [(k, texts[0], "en", "hot", 1) for k in range(400, 600)]
    rows += [*EDGES, (2, None, "en", "s", 0), (1, "", "en", "s", 0), (7, None, None, None, None), (None, texts[0], None, "hot", 1), (None, texts[0], None, "hot", 1)]
    labels = [(k, r.choice([0, 1, None]), r.choice([0, 1])) for k in r.choices(range(500), k=300)] + [(None, 1, 1)]
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").withColumn("part", F.lit("x"))
    assert audited(filter_audit.filter_audit(docs(spark, rows), known)) == audit(rows, labels)
    empty = spark.createDataFrame([], DOCS)
    assert filter_audit.filter_audit(empty, known).count() == 0
    assert audited(filter_audit.filter_audit(docs(spark, EDGES), known.limit(0))) == audit(EDGES, [])


def test_equal_prints(spark, monkeypatch):
    """Texts of one fingerprint are told apart, within tasks and over their bounds."""
    monkeypatch.setattr(filter_audit.F, "xxhash64", lambda *c: F.lit(1).cast("long"))
    rows = [(k, f"text {k % 3}", "en", "s", 1) for k in random.Random(1).sample(range(500), 200)]
    assert audited(filter_audit.filter_audit(docs(spark, rows), spark.createDataFrame([(1, 1, 1)], "doc_id bigint, quality int, toxic int"))) == audit(rows, [(1, 1, 1)])
