"""URL filters: gradient-boosted trees on lexical features, behind a table of rules.

Features of a URL: lengths of host, path and query, depth, labels of the host, hyphens, digit ratio,
entropy of its characters, numbers of parameters and fragments, longest label, and statistics of
suffixes: how often labelled URLs with the host's last label, its last two, its first label, the
path's first part and the path's file suffix were blocked (smoothed towards the mean; missing for
suffixes that no labelled URL has, for which the trees take both ways by what they hold).

Labelled URLs are those that the rules decide; the trees learn from a bounded sample of them (the
about ``most`` least hashes, distinct URLs) and judge the rest.  Logistic loss, histograms of 32 bins,
depth-limited trees, shrinkage; all in numpy on the driver, whose data is the bounded sample.

Null URLs and those without :// have empty host and path; the trees judge them by their other
features.  If fewer than two kinds of labels occur, all URLs without rule get the one that does occur
(allow if none).  Each row gives one row, repeated rows included; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_hash, in_slices, lower_ascii, pick

#: Largest number of labelled URLs that the trees learn from.
MOST = 20_000
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (null if none) and its verdict.

    A rule fits its host and all subdomains, if the path starts with the rule's.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: len(r[0])):
        at, slash, rest = text.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


PARTS = re.compile(r"^(?:[^:/?#]*://)?([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$", re.S)


def lexical(url: str | None) -> tuple[list[float], list[str]]:
    """Numbers and the suffixes whose statistics make the other features."""
    url = url or ""
    host, path, query, fragment = (x or "" for x in PARTS.match(url).groups())
    labels, parts = host.lower().split("."), [p for p in path.split("/") if p]
    n = max(len(url), 1)
    counts = Counter(url)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    digits = sum(map(str.isdigit, url))
    numbers = [len(url), len(host), len(path), len(query), len(parts), len(labels), host.count("-"), digits / n, entropy, query.count("=") + query.count("&"), float(bool(fragment)), max(map(len, labels)), float(url.startswith("https")), float(path.endswith("/"))]
    file = parts[-1].rpartition(".")[2] if parts and "." in parts[-1] else ""
    return numbers, [f"0{labels[-1]}", f"1{'.'.join(labels[-2:])}", f"2{labels[0]}", f"3{parts[0] if parts else ''}", f"4{file}", f"5{labels[-1]}/{parts[0] if parts else ''}"]


@dataclass
class Trees:
    """Boosted regression trees: each is arrays of feature (-1: leaf), threshold, left, right, value and the
    left one's share of what a node holds, parents first.

    Where a feature is missing (nan, a suffix that no labelled URL has) both ways are taken, by their shares.
    """

    prior: float = 0.0
    trees: list[tuple[np.ndarray, ...]] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.prior)
        for feature, threshold, left, right, value, share in self.trees:
            weight = np.zeros((len(feature), len(x)))
            weight[0] = 1.0
            for k in range(len(feature)):
                if feature[k] < 0:
                    out += value[k] * weight[k]
                    continue
                cell = x[:, feature[k]]
                go = np.where(np.isnan(cell), share[k], cell <= threshold[k])
                weight[left[k]] = weight[k] * go
                weight[right[k]] = weight[k] * (1 - go)
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 4, rate: float = 0.2, bins: int = 32, least: float = 5.0, ridge: float = 1.0, share: float = 0.4) -> Trees:
    """Newton boosting of the logistic loss on histograms."""
    mean = float(np.clip(y.mean(), 1e-4, 1 - 1e-4))
    out = Trees(math.log(mean / (1 - mean)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    code = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    raw = np.full(len(y), out.prior)
    rng = np.random.default_rng(0)
    for _ in range(rounds):
        # each tree sees a part of the features, so that none decides alone
        seen = set(rng.permutation(x.shape[1])[: math.ceil(share * x.shape[1])].tolist())
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        nodes: list[list[float]] = []
        step = np.zeros(len(y))

        def grow(rows: np.ndarray, level: int) -> int:
            me = len(nodes)
            gs, hs = g[rows].sum(), h[rows].sum()
            nodes.append([-1, 0.0, -1, -1, -rate * gs / (hs + ridge), 0.0])
            best = (1e-6, -1, -1)
            if level < depth and len(rows) >= 2 * least:
                for f, e in enumerate(edges):
                    if not len(e) or f not in seen:
                        continue
                    c = code[rows, f]
                    gl = np.cumsum(np.bincount(c, g[rows], len(e) + 1))[:-1]
                    hl = np.cumsum(np.bincount(c, h[rows], len(e) + 1))[:-1]
                    nl = np.cumsum(np.bincount(c, minlength=len(e) + 1))[:-1]
                    gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                    gain[(nl < least) | (len(rows) - nl < least)] = -1
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (float(gain[k]), f, k)
            if best[1] < 0:
                step[rows] = nodes[me][4]
                return me
            _, f, k = best
            go = code[rows, f] <= k
            left, right = grow(rows[go], level + 1), grow(rows[~go], level + 1)
            nodes[me] = [f, float(edges[f][k]), left, right, 0.0, go.mean()]
            return me

        grow(np.arange(len(y)), 0)
        raw += step
        a = np.array(nodes)
        out.trees.append((a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4], a[:, 5]))
    return out


@dataclass
class UrlModel:
    trees: Trees
    rates: dict[str, float]

    def features(self, urls: list[str | None]) -> np.ndarray:
        rows = []
        for u in urls:
            numbers, suffixes = lexical(u)
            rows.append(numbers + [self.rates.get(s, np.nan) for s in suffixes])
        return np.array(rows, float).reshape(len(rows), 20)

    def block(self, urls: list[str | None]) -> np.ndarray:
        """Probability of block."""
        return 1 / (1 + np.exp(-self.trees.raw(self.features(urls))))


def fit(urls: list[str], y: list[int], smooth: float = 10.0) -> UrlModel:
    """Learns from labelled URLs (1: block)."""
    if len(set(y)) < 2:
        value = 1.0 if y and y[0] else 0.0
        return UrlModel(Trees(20.0 if value else -20.0), {})
    mean = sum(y) / len(y)
    n, hit = Counter(), Counter()
    for u, b in zip(urls, y, strict=True):
        for s in lexical(u)[1]:
            n[s] += 1
            hit[s] += b
    model = UrlModel(Trees(), {s: (hit[s] + smooth * mean) / (k + smooth) for s, k in n.items()})
    model.trees = boost(model.features(urls), np.array(y, float))
    return model


def fit_by_rules(pages: DataFrame, rules=RULES, most: int = MOST) -> UrlModel:
    """Learns from a bounded sample of the URLs that the rules decide."""
    p = pick(pages, "url").where("url IS NOT NULL")
    _, verdict = fitting_rule(*host_path(F.col("url")), rules)
    labelled = p.select("url", verdict.alias("verdict")).where("verdict IS NOT NULL").distinct()
    rows = by_hash(labelled, "url", most).collect()  # about most rows
    return fit([r["url"] for r in rows], [int(r["verdict"] == "block") for r in rows])


def url_filter(pages: DataFrame, model: UrlModel, rules=RULES, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict and p_block (the trees' probability)."""
    d = pick(pages, "page_id", "url")
    shared = d.sparkSession.sparkContext.broadcast(model)

    def score(batch: pa.RecordBatch) -> dict:
        return {"page_id": batch.column("page_id"), "url": batch.column("url"), "p_block": shared.value.block(batch.column("url").to_pylist()).tolist()}

    scored = in_slices(d, f"page_id {d.schema['page_id'].dataType.simpleString()}, url string, p_block double", score, rows=2048)
    host, path = host_path(F.col("url"))
    named = scored.select("page_id", host.alias("host"), path.alias("path"), "p_block")
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("p_block") >= threshold, "block").otherwise("allow")
    return named.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), F.round("p_block", 6).alias("p_block"))
