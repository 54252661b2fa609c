"""Periodic runs of words, by Crochemore's partition refinement.

A run is a stretch of consecutive words with smallest period q (words q apart are the same) of at least
``max(least, times * q)`` words that no neighbouring word extends keeping period q.

The positions of a text are kept in classes: at level L two positions share a class if the L words from
each on are equal.  Level L + 1 comes from level L by splitting: position i leaves its class if the
class of i + 1 was split, and of the parts of a split class all but the largest split others at the
next level (the smaller halves), so that a position is handled at most log n times.  Members of a class
are linked in order; a link from i to i + q that stands at level q is a square of period q, as the word
group of length q at i is followed by itself.  Its root is primitive, or the link would be shorter.
Squares of one period at consecutive positions are merged into a run.

All texts of a slice of an Arrow batch are refined together with arrays (a mark that occurs nowhere else
ends each text, classes never reach over texts), as levels, not positions, cost Python calls.  Levels
end at n / times words of a text, as no longer period makes a run.

Defined cases: null and empty texts have no words and no runs, and an empty collapsed text; each row
gives one row, repeated rows included; further columns are ignored, those named in ``keep`` are passed on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import in_slices, pick

LEAST, TIMES = 6, 4
#: Bytes of text that are refined together.
TOGETHER = 4 << 20

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _links(positions: np.ndarray, classes: np.ndarray, nxt: np.ndarray, prv: np.ndarray) -> None:
    """Links members of classes; positions are sorted by class, then position."""
    nxt[positions], prv[positions] = -1, -1
    together = classes[1:] == classes[:-1]
    a, b = positions[:-1][together], positions[1:][together]
    nxt[a], prv[b] = b, a


def _rest(at: int, nxt: np.ndarray, prv: np.ndarray) -> list[int]:
    """All members of the class of a position."""
    out, i = [at], int(prv[at])
    while i >= 0:
        out.append(i)
        i = int(prv[i])
    i = int(nxt[at])
    while i >= 0:
        out.append(i)
        i = int(nxt[i])
    return out


def squares(ids: np.ndarray, cap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and periods of all squares with primitive root and a period of at most cap at the position.

    ids: at each position a number, the same for equal words of one text and for nothing else.
    """
    n = len(ids)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    order = np.argsort(ids, kind="stable")
    cls = np.empty(n, np.int64)
    new = np.concatenate(([True], ids[order][1:] != ids[order][:-1]))
    cls[order] = np.cumsum(new) - 1
    used = int(cls[order[-1]]) + 1
    size = np.zeros(n + 1, np.int64)
    size[:used] = np.bincount(cls, minlength=used)
    nxt, prv, since = np.empty(n, np.int64), np.empty(n, np.int64), np.ones(n, np.int64)
    _links(order, cls[order], nxt, prv)
    small, level, most = np.arange(n), 1, int(cap.max())
    found: list[tuple[np.ndarray, np.ndarray]] = []
    while level < most and len(small):
        q = small[small > 0] - 1
        q = q[(size[cls[q]] > 1) & (cap[q] > level)]
        if not len(q):
            break
        of, to = cls[q], cls[q + 1]
        by = np.lexsort((q, to, of))
        q, of, to = q[by], of[by], to[by]
        # parts: stretches of q of one old class and one splitting class
        begin = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (to[1:] != to[:-1]))))
        length = np.diff(np.append(begin, len(q)))
        old = of[begin]
        head = np.flatnonzero(np.concatenate(([True], old[1:] != old[:-1])))  # first part of each old class
        total, largest = np.add.reduceat(length, head), np.maximum.reduceat(length, head)
        group = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(old))))
        left = size[old[head]] - total
        top = np.zeros(len(begin), bool)  # the first of the largest parts of each old class
        equal = np.flatnonzero(length == largest[group])
        top[equal[np.concatenate(([True], group[equal][1:] != group[equal][:-1]))]] = True
        stays = top & (left[group] == 0)  # the largest part keeps the class if nothing else is left in it
        moved = ~stays
        if not moved.any():
            break
        n_new = int(moved.sum())
        name = np.full(len(begin), -1, np.int64)
        name[moved] = used + np.arange(n_new)
        used += n_new
        if used > len(size):
            size = np.append(size, np.zeros(used, np.int64))
        size[name[moved]] = length[moved]
        np.subtract.at(size, old[moved], length[moved])
        goes = np.repeat(moved, length)
        m, label = q[goes], np.repeat(name, length)[goes]
        # what splits at the next level: all parts but the largest of each class
        rest = (left > 0) & (left < largest)
        splits = np.repeat(moved & ~(top & rest[group]), length)[goes]
        # links: moved members leave their old lists, chain by chain
        by = np.lexsort((m, cls[m]))
        s = m[by]
        chained = (nxt[s[:-1]] == s[1:]) & (cls[s[:-1]] == cls[s[1:]])
        first, last = s[np.concatenate(([True], ~chained))], s[np.concatenate((~chained, [True]))]
        p, r = prv[first], nxt[last]
        changed = np.concatenate((m, p[p >= 0]))
        was = nxt[changed]
        nxt[p[p >= 0]] = r[p >= 0]
        prv[r[r >= 0]] = p[r >= 0]
        cls[m] = label
        _links(m, label, nxt, prv)
        gone = (was >= 0) & (nxt[changed] != was)
        i, gap = changed[gone], (was - changed)[gone]
        hit = (since[i] <= gap) & (gap <= level)
        found.append((i[hit], gap[hit]))
        level += 1
        since[changed[nxt[changed] != was]] = level
        small = m[splits]
        if rest.any():  # rarely: what is left of a class is smaller than a part of it
            beside = np.concatenate((p[p >= 0], r[r >= 0]))
            member = dict(zip(cls[beside].tolist(), beside.tolist(), strict=True))
            more = [x for c in old[head][rest].tolist() for x in _rest(member[c], nxt, prv)]
            small = np.concatenate((small, np.array(more, np.int64)))
    i = np.flatnonzero(nxt >= 0)
    gap = nxt[i] - i
    hit = (since[i] <= gap) & (gap <= cap[i])
    found.append((i[hit], gap[hit]))
    at, gap = (np.concatenate(x) for x in zip(*found, strict=True))
    within = gap <= cap[at]
    return at[within], gap[within]


def runs(ids: np.ndarray, cap: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """(start, length, period) of all runs, sorted so."""
    at, gap = squares(ids, cap)
    by = np.lexsort((at, gap))
    at, gap = at[by], gap[by]
    if not len(at):
        return np.empty((0, 3), np.int64)
    begin = np.flatnonzero(np.concatenate(([True], (gap[1:] != gap[:-1]) | (at[1:] != at[:-1] + 1))))
    end = np.append(begin[1:], len(at)) - 1
    period = gap[begin]
    length = at[end] - at[begin] + 2 * period
    out = np.stack((at[begin], length, period), axis=1)[length >= np.maximum(least, times * period)]
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _slice(least: int, times: int):
    def run(batch: pa.RecordBatch) -> dict:
        texts = [(x or b"").split() for x in batch.column("text").cast(pa.binary()).to_pylist()]
        numbers: dict[bytes, int] = {}
        count = np.array([len(t) for t in texts], np.int64)
        offset = np.concatenate(([0], np.cumsum(count + 1)))
        ids = np.full(int(offset[-1]), -1, np.int64)
        for t, at in zip(texts, offset.tolist(), strict=False):
            ids[at : at + len(t)] = [numbers.setdefault(w, len(numbers)) for w in t]
        of = np.repeat(np.arange(len(texts)), count + 1)
        ids = np.where(ids < 0, of, len(texts) + of * max(1, len(numbers)) + ids)  # nothing is equal over texts
        got = runs(ids, (count // times)[of], least, times)
        where = np.searchsorted(got[:, 0], offset)
        out = {c: batch.column(c) for c in batch.schema.names if c not in ("n_words", "runs", "collapsed")}
        found, collapsed = [], []
        for k, t in enumerate(texts):
            own = got[where[k] : where[k + 1]]
            if len(own):
                starts = own[:, 0] - offset[k]
                edge = np.zeros(len(t) + 1, np.int64)
                np.add.at(edge, starts + own[:, 2], 1)
                np.add.at(edge, starts + own[:, 1], -1)
                t = [t[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
                found.append([{"start": a, "length": b, "period": c} for a, b, c in zip(starts.tolist(), own[:, 1].tolist(), own[:, 2].tolist(), strict=True)])
            else:
                found.append([])
            collapsed.append(b" ".join(t))
        return out | {"n_words": count, "runs": found, "collapsed": pa.array(collapsed, pa.binary()).cast(pa.string())}

    return run


def periodic_runs(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), least: int = LEAST, times: int = TIMES) -> DataFrame:
    """The columns of keep, n_words, runs array<struct<start, length, period>> (word numbers, by start,
    then period) and collapsed: the words without those that a run repeats after its first period."""
    names = tuple(dict.fromkeys((*keep, "text")))
    d = pick(docs, *names)
    held = ", ".join(f"`{c}` {t}" for c, t in d.dtypes if c in keep)
    return in_slices(d, f"{held}, n_words bigint, runs {RUNS}, collapsed string", _slice(least, times), most=TOGETHER)
