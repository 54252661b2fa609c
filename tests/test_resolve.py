"""Ids from prefixes against a plain version, input by input."""

from __future__ import annotations

import hashlib
import random
import re

from quillspark.operators.resolve import resolve


def plain(text, space, tasks, children):
    """(task_id, verdict, n)"""
    ids = {t[0] for t in tasks}
    if text in ids:
        return text, "exact", 1
    if m := re.fullmatch(r"(.*)\.(\d+)", text, re.S):
        parent = plain(m[1], space, tasks, children)[0]
        if parent and (parent, int(m[2])) in children:
            return children[parent, int(m[2])], "child", 1
    own = [t for t in tasks if space is None or t[2] == space]
    dash = text.find("-")
    bare = text[dash + 1 :] if 1 <= dash <= 4 else text
    looks = []
    if re.fullmatch("[0-9a-f]{3,}", bare):
        looks += [[t[0] for t in own if t[1] == bare], [t[0] for t in own if t[1] and t[1].startswith(bare)]]
    big = text.upper()
    short = len(bare) < 4 if 1 <= dash <= 4 else dash < 0 and len(text) < 4
    if not short:
        looks.append([t[0] for t in own if t[0].startswith(big if dash >= 0 else f"BRN-{big}")])
    found = next((x for x in looks if x), [])
    return (found[0], "unique", 1) if len(found) == 1 else (None, "ambiguous" if found else "short" if short else "none", len(found))


def test_resolve(spark):
    r = random.Random(4)
    tasks = []
    for k in range(60):
        hashed = hashlib.sha256(str(k // 2 if k < 6 else k).encode()).hexdigest()[:8]
        tasks.append((f"BRN-01J{r.choice('AB')}{r.choice('CD')}{k:03d}", hashed if k % 7 else None, f"s{k % 2}", k % 4))
    edges = [(tasks[k // 3][0], tasks[k][0], "parent_of" if k % 5 else "blocks") for k in range(1, 60)]
    seq = {t[0]: t[3] for t in tasks}
    children = {}
    for a, b, kind in edges:
        if kind == "parent_of":
            children[a, seq[b]] = min(b, children.get((a, seq[b]), b))
    inputs = set()
    for t in tasks:
        inputs |= {(t[0], None), (t[0][: r.randint(1, 12)], r.choice([None, "s0", "s1"])), (t[0][4 : r.randint(5, 12)].lower(), None), (f"{t[0]}.{r.randint(0, 4)}", None), (f"{t[0][4:]}.{r.randint(0, 4)}.{r.randint(0, 4)}", r.choice([None, "s0"]))}
        if t[1]:
            inputs |= {(t[1][: r.randint(2, 8)], r.choice([None, "s0"])), (f"brn-{t[1]}", None), (f"brn-{t[1][:4]}.{r.randint(0, 3)}", None)}
    inputs |= {("", None), (".1", None), ("zzzz", None), ("019571A8-1", None), ("brn-", None), ("x.99999999999999999999", None)}
    got = {(x.input, x.space): (x.task_id, x.verdict, x.n) for x in resolve(spark.createDataFrame(sorted(inputs, key=str), "input string, space string"), spark.createDataFrame(tasks, "task_id string, display_id string, space string, child_seq bigint"), spark.createDataFrame(edges, "from_id string, to_id string, edge_kind string")).collect()}
    want = {(t, s): plain(t, s, tasks, children) for t, s in inputs}
    assert got == want and {"exact", "child", "unique", "ambiguous", "none", "short"} == {v for _, v, _ in want.values()}
