"""Toxicity by cumulative-link ordinal regression.

P(grade > k) = 1 / (1 + exp(-(w.x - t_k))): one weight vector w for all ordered thresholds t_0 <
t_1 < ..., over sparse features of the text (which words occur in it, lower-cased, and which beginnings
of words, so that inflected forms share what was learnt).  The output is the
expected severity, the sum of P(grade > k) over k, and the most probable grade.

Grades of labelled texts: 0 where the label says not toxic; toxic texts are graded 1 or 2 by the share
of words with a feature that labelled toxic texts have and others practically never do (none or up to
3 %, above).  Only the training uses labels.

The fit takes a bounded sample of labelled rows (per label, about the ``most`` least hashes of ids; copies
of a text count once), keeps the ``words`` features (a bound on the model) that at least ``least`` sample
texts hold and that separate the labels best (chi-square), and maximises the likelihood with an L1 penalty by accelerated proximal
gradient over the sample's feature lists, in numpy on the driver.

Texts are read whole.  Null texts and texts without words have no features.  Without labelled texts of
both kinds every text has severity 0.  Each row gives one row, repeated rows included; other columns
are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_hash, in_slices, pick

#: Largest number of labelled rows of each label in the fit.
MOST = 4_000
LEAST, WORDS, GRADES = 8, 1_200, 3
#: Severity from which a text is toxic.  Of labels of sf0.1 whose id leaves other remainders than 0 by 5, those that leave
#: 1 chose it (greatest difference of the shares found among toxic and other texts), in a fit on the rest.
TOXIC = 0.15
WORD = re.compile(r"[^\W\d_]+")


PREFIXES = (4, 5)
BUCKETS = 1 << 22


def features(text: str | None) -> set[str]:
    """The text's words, and ^ with the first characters of longer ones."""
    words = set(WORD.findall(text.lower())) if text else set()
    return words.union(*[{"^" + w[:k] for w in words if len(w) > k} for k in PREFIXES])


@dataclass
class Ordinal:
    """Shared weights by word, and ordered thresholds."""

    weights: dict[str, float]
    thresholds: list[float]

    def severity(self, found: set[str]) -> tuple[float, int]:
        z = sum(self.weights[w] for w in found & self.weights.keys())
        over = [1 / (1 + np.exp(-np.clip(z - t, -50, 50))) for t in self.thresholds]
        p = [1.0, *over, 0.0]
        return float(sum(over)), int(np.argmax([a - b for a, b in zip(p, p[1:], strict=False)]))


def document_counts(texts: list[str], toxic: list[int], least: int = LEAST) -> tuple[Counter, Counter]:
    """Texts that have a feature, by label; only of features that at least ``least`` texts may have.

    A first pass counts buckets of hashes, so that the many rare features are never held.
    """
    buckets = np.zeros(BUCKETS, np.int32)
    for t in texts:
        np.add.at(buckets, np.fromiter((zlib.crc32(f.encode()) % BUCKETS for f in features(t)), np.int64), 1)
    counts = (Counter(), Counter())
    for t, x in zip(texts, toxic, strict=True):
        counts[x].update(f for f in features(t) if buckets[zlib.crc32(f.encode()) % BUCKETS] >= least)
    return counts


def fit_ordinal(texts: list[str], grades: list[int], counts: tuple[Counter, Counter] | None = None, n_grades: int = GRADES, least: int = LEAST, words: int = WORDS, l1: float = 1e-3, rounds: int = 400) -> Ordinal:
    """Maximum likelihood with an L1 penalty on the weights; thresholds start at the grades' shares."""
    y = np.array(grades)
    if len(set(grades)) < 2:
        return Ordinal({}, [50.0] * (n_grades - 1))
    neg, pos = counts or document_counts(texts, [int(g > 0) for g in grades], least)
    n1, n0 = int((y > 0).sum()), int((y == 0).sum())

    def chi(w: str) -> float:
        a, b = pos[w], neg[w]
        k, n = a + b, n1 + n0
        e = k * n1 / n
        return (a - e) ** 2 / max(e * (1 - k / n), 1e-9)

    chosen = sorted((w for w in pos.keys() | neg.keys() if pos[w] + neg[w] >= least), key=lambda w: (-chi(w), w))[:words]
    at = {w: k for k, w in enumerate(chosen)}
    held = [[at[w] for w in features(t) if w in at] for t in texts]
    column = np.array([k for row in held for k in row], np.int64)
    row = np.repeat(np.arange(len(texts)), [len(r) for r in held])
    share = np.array([np.clip((y > k).mean(), 1e-3, 1 - 1e-3) for k in range(n_grades - 1)])
    t = np.log((1 - share) / share)
    # thresholds as a first one and positive gaps
    theta = np.concatenate((np.zeros(len(chosen)), [t[0]], np.log(np.maximum(np.diff(t), 0.05))))

    def split(v):
        return v[: len(chosen)], np.concatenate(([v[len(chosen)]], v[len(chosen)] + np.cumsum(np.exp(np.clip(v[len(chosen) + 1 :], -6, 4)))))

    rows = np.arange(len(y))

    def probabilities(v):
        """P(grade > k) with 1 before and 0 after, and that of the own grade."""
        w, ts = split(v)
        z = np.bincount(row, w[column], len(y))
        over = 1 / (1 + np.exp(-np.clip(z[:, None] - ts[None, :], -50, 50)))
        p = np.concatenate((np.ones((len(y), 1)), over, np.zeros((len(y), 1))), axis=1)
        return p, np.maximum(p[rows, y] - p[rows, y + 1], 1e-12)

    def value(v):
        return -np.log(probabilities(v)[1]).mean()

    def loss(v):
        p, own = probabilities(v)
        d = p * (1 - p)
        gz = -(d[rows, y] - d[rows, y + 1]) / own
        gt = np.zeros(p.shape[1] - 2)
        for k in range(len(gt)):
            up, low = y == k + 1, y == k  # p[k+1] is the upper bound of grade k+1 and the lower one of k
            gt[k] = np.sum(d[up, k + 1] / own[up]) - np.sum(d[low, k + 1] / own[low])
        n = len(y)
        gaps = np.exp(np.clip(v[len(chosen) + 1 :], -6, 4))
        tail = np.cumsum(gt[::-1])[::-1]
        return -np.log(own).mean(), np.concatenate((np.bincount(column, gz[row], len(chosen)) / n, [gt.sum() / n], tail[1:] * gaps / n))

    def shrink(v, step):
        out = v.copy()
        w = out[: len(chosen)]
        out[: len(chosen)] = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
        return out

    v, last, momentum, step = theta, theta, 1.0, 1.0
    for _ in range(rounds):
        nxt = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        u = v + (momentum - 1) / nxt * (v - last)
        f, g = loss(u)
        while True:
            new = shrink(u - step * g, step)
            d = new - u
            if value(new) <= f + g @ d + (d @ d) / (2 * step) + 1e-12 or step < 1e-6:
                break
            step /= 2
        last, v, momentum, step = v, new, nxt, step * 1.1
        if np.abs(v - last).max() < 1e-5:
            break
    w, ts = split(v)
    return Ordinal({c: float(k) for c, k in zip(chosen, w, strict=True) if k}, ts.tolist())


def graded(texts: list[str], toxic: list[int]) -> tuple[list[str], list[int], tuple[Counter, Counter]]:
    """Labelled texts, copies once, with grades and counts."""
    rows = list(dict.fromkeys(zip(texts, toxic, strict=True)))
    neg, pos = counts = document_counts([t for t, _ in rows], [x for _, x in rows])
    n1, n0 = max(sum(x for _, x in rows), 1), max(sum(1 - x for _, x in rows), 1)
    own = {w for w, k in pos.items() if k >= LEAST and k / n1 > 50 * (neg[w] + 0.1) / n0}
    grades = []
    for t, x in rows:
        ws = WORD.findall(t.lower()) if x else []
        share = sum(w in own or any("^" + w[:k] in own for k in PREFIXES if len(w) > k) for w in ws) / max(len(ws), 1)
        grades.append(0 if not x else 1 if share <= 0.03 else 2)
    return [t for t, _ in rows], grades, counts


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST) -> Ordinal:
    """Learns from a bounded sample of labelled rows."""
    marks = pick(labels, "doc_id", "toxic").where("doc_id IS NOT NULL AND toxic IS NOT NULL").select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic")).distinct()
    few = by_hash(marks.where("toxic = 0"), "doc_id", most).union(by_hash(marks.where("toxic = 1"), "doc_id", most))
    rows = pick(docs, "doc_id", "text").where("text IS NOT NULL").join(F.broadcast(few), "doc_id").select("text", "toxic").collect()  # about 2 * most labels at most
    return fit_ordinal(*graded([r["text"] for r in rows], [r["toxic"] for r in rows]))


def toxicity(docs: DataFrame, model: Ordinal, threshold: float = TOXIC) -> DataFrame:
    """doc_id, severity (expected, 0 to 2), grade (most probable) and toxic (severity at or over the threshold)."""
    d = pick(docs, "doc_id", "text")
    shared = d.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict:
        got = [shared.value.severity(features(t)) for t in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "severity": [round(s, 6) for s, _ in got], "grade": [g for _, g in got], "toxic": [s >= threshold for s, _ in got]}

    return in_slices(d, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, severity double, grade int, toxic boolean", run)
