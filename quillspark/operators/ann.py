"""Approximate nearest vectors by cells and product codes; every vector is in the index.

Centres of cells come from k-means on a bounded sample.  A vector lies in the ``spread`` cells whose
centres are nearest, so that a query near a border finds it from either side.  In each of its cells a
vector is held as a code: what is left of it after the centre is cut into parts of a few dimensions, and
each part is the number of one of 256 vectors of that part's codebook, likewise fitted on the sample.
A query looks into the nearest ``probes`` cells; there its products with all codebook vectors are a
table, and a code's similarity is a sum of table entries.  The best ``REFINE`` * k codes are looked up
in the vectors themselves.  Probes are fitted on the sample to a recall.

Cells and queries meet by an equi-join on the cell, a group a task; cells with very many codes are dealt
out in parts.  Equal vectors are one code, so that a group of copies is no large cell.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import similarity
from ..session import cut
from .similarity import classes, matrix, nearest

#: Vectors that the cells and codebooks are fitted on.
SAMPLE = 20_000
#: Recall of the nearest DEPTH that probes are fitted to, by this many of the sample's vectors.
RECALL, DEPTH, TRIED = 0.95, 10, 500
#: Cells of a vector, dimensions of a part, codes that are looked up for each result, codes of a task.
SPREAD, PART, REFINE, CODES = 3, 2, 10, 200_000
MODES = ("exact", "refined", "fast")


@dataclass
class Index:
    """Centres and codebooks (bounded by the sample); codes by cell, distinct vectors, and keys by vector; the cells that a query looks into."""

    centres: np.ndarray
    books: np.ndarray
    codes: DataFrame  # id, cell, part, code
    vectors: DataFrame  # key, embedding, first
    parts: DataFrame  # cell, parts
    probes: int


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; centres start at evenly spaced vectors."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        at = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 0, total / np.maximum(norm, 1e-12), c)
    return c


def assigned(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The number of the nearest codebook vector of each row."""
    return (x @ book.T - 0.5 * (book**2).sum(axis=1)).argmax(axis=1)


def codebooks(rest: np.ndarray, part: int = PART, size: int = 256, rounds: int = 8) -> np.ndarray:
    """(parts, size, part): k-means of each part of the residuals; a last part that is short is filled with zeros."""
    n = math.ceil(rest.shape[1] / part)
    y = np.zeros((len(rest), n * part), np.float32)
    y[:, : rest.shape[1]] = rest
    out = np.zeros((n, size, part), np.float32)
    for m in range(n):
        own = y[:, m * part : (m + 1) * part]
        book = own[np.linspace(0, len(own) - 1, size).astype(int)].copy()
        for _ in range(rounds):
            at = assigned(own, book)
            total, count = np.zeros_like(book), np.bincount(at, minlength=size)[:, None]
            np.add.at(total, at, own)
            book = np.where(count > 0, total / np.maximum(count, 1), book)
        out[m] = book
    return out


def encode(rest: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Codes of residuals, a byte a part."""
    n, _, part = books.shape
    y = np.zeros((len(rest), n * part), np.float32)
    y[:, : rest.shape[1]] = rest
    return np.stack([assigned(y[:, m * part : (m + 1) * part], books[m]) for m in range(n)], axis=1).astype(np.uint8)


def table_of(q: np.ndarray, books: np.ndarray) -> np.ndarray:
    """(queries, parts, size): products of queries' parts with codebook vectors."""
    n, _, part = books.shape
    y = np.zeros((len(q), n * part), np.float32)
    y[:, : q.shape[1]] = q
    return np.einsum("qmd,msd->qms", y.reshape(len(q), n, part), books)


def fit_probes(x: np.ndarray, centres: np.ndarray, recall: float = RECALL, depth: int = DEPTH, tried: int = TRIED, spread: int = SPREAD) -> int:
    """The least number of cells in which this share of the nearest depth of evenly spaced vectors is found, themselves left out."""
    at = np.unique(np.linspace(0, len(x) - 1, min(tried, len(x))).astype(int))
    depth = min(depth, len(x) - 1)
    if depth < 1:
        return len(centres)
    cells = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :spread]
    found = np.zeros(len(centres), np.int64)  # neighbours by the first place of one of their cells among the vector's
    for part in np.array_split(at, math.ceil(len(at) / 100)):
        sim = x[part] @ x.T
        sim[np.arange(len(part)), part] = -np.inf
        near = np.argpartition(-sim, depth - 1, axis=1)[:, :depth]
        place = np.argsort(np.argsort(-(x[part] @ centres.T), axis=1, kind="stable"), axis=1)
        of = np.take_along_axis(place[:, None, :], cells[near], axis=2).min(axis=2)
        np.add.at(found, of, 1)
    return int(np.searchsorted(np.cumsum(found), recall * found.sum())) + 1


def build(vectors: DataFrame, key: str = "chunk_id", cells: int | None = None, sample: int = SAMPLE, spread: int = SPREAD) -> Index:
    """All vectors by cell; ceil(sqrt(n)) cells, at most a tenth of the sample, fitted on the sample's least hashes.  Vectors of another length than most are left out."""
    v = cut(classes(vectors, key))
    one = v.where(F.col(key) == F.col("first"))
    rows = one.select("embedding").orderBy(F.xxhash64(key), key).limit(sample).collect()
    size = int(np.bincount([len(r[0]) for r in rows]).argmax()) if rows else 1
    x = np.array([r[0] for r in rows if len(r[0]) == size], np.float32).reshape(-1, size)
    k = min(cells or max(1, min(math.ceil(math.sqrt(one.count())), sample // 10)), max(1, len(x)))
    centres = kmeans(x, k) if len(x) else np.zeros((1, size), np.float32)
    books = codebooks(x - centres[(x @ centres.T).argmax(axis=1)]) if len(x) else np.zeros((1, 256, PART), np.float32)
    shared = v.sparkSession.sparkContext.broadcast((centres, books))

    def coded(batches):
        centres, books = shared.value
        for pdf in batches:
            y = np.stack(pdf["embedding"].to_numpy()).astype(np.float32)
            near = np.argsort(-(y @ centres.T), axis=1, kind="stable")[:, :spread]
            for j in range(near.shape[1]):
                codes = encode(y - centres[near[:, j]], books)
                yield pd.DataFrame({"id": pdf[key], "cell": near[:, j].astype(np.int32), "code": [c.tobytes() for c in codes]})

    kind = v.schema[key].dataType.simpleString()
    codes = one.where(F.size("embedding") == size).select(key, "embedding").mapInPandas(coded, f"id {kind}, cell int, code binary")
    codes = cut(codes)
    parts = codes.groupBy("cell").agg(F.ceil(F.count("*") / CODES).cast("int").alias("parts"))  # a row a cell
    own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    codes = codes.join(F.broadcast(parts), "cell").select("id", "cell", own.alias("part"), "code")
    return Index(centres, books, codes, v, parts, fit_probes(x, centres, spread=spread))


def search(index: Index, queries: DataFrame, key: str = "chunk_id", k: int = DEPTH, probes: int | None = None, mode: str = "refined") -> DataFrame:
    """query_id, key, sim and rank of each query's nearest k.

    mode: 'exact' compares all vectors; 'refined' ranks the best codes again by the vectors themselves;
    'fast' takes the similarity of codes.  probes: cells that a query looks into, else the index's own.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    if mode == "exact":
        return nearest(index.vectors.select(key, "embedding"), queries, key, k, 6)
    q = queries.where("embedding IS NOT NULL").select("query_id", "embedding")
    shared = q.sparkSession.sparkContext.broadcast((index.centres, index.books, probes or index.probes))
    size = index.centres.shape[1]

    def probing(batches):
        centres, _, n = shared.value
        for pdf in batches:
            y = np.stack(pdf["embedding"].to_numpy()).astype(np.float32)
            near = np.argsort(-(y @ centres.T), axis=1, kind="stable")[:, :n].astype(np.int32)
            yield pd.DataFrame({"query_id": pdf["query_id"], "embedding": pdf["embedding"], "cells": list(near)})

    kinds = [q.schema["query_id"].dataType.simpleString(), index.codes.schema["id"].dataType.simpleString()]
    asked = q.where(F.size("embedding") == size).mapInPandas(probing, f"query_id {kinds[0]}, embedding array<float>, cells array<int>")
    asked = asked.select("query_id", "embedding", F.explode("cells").alias("cell")).join(F.broadcast(index.parts), "cell")
    asked = asked.select("query_id", "embedding", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    depth = k * (REFINE if mode == "refined" else 1)

    def match(asking: pa.Table, held: pa.Table) -> pa.Table:
        centres, books, _ = shared.value
        ids, who = held.column("id").combine_chunks(), asking.column("query_id").combine_chunks()
        found = []
        if len(ids) and len(who):
            codes = np.frombuffer(b"".join(held.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
            y = matrix(asking.column("embedding").combine_chunks()).astype(np.float32)
            centre = centres[asking.column("cell")[0].as_py()]
            for at in range(0, len(y), 64):
                t = table_of(y[at : at + 64], books)
                sims = np.repeat((y[at : at + 64] @ centre)[:, None], len(ids), axis=1)
                for m in range(books.shape[0]):
                    sims += t[:, m, :][:, codes[:, m]]
                n = min(depth, len(ids))
                best = np.argpartition(-sims, n - 1, axis=1)[:, :n]
                of = np.repeat(np.arange(at, at + len(sims)), n)
                found.append(pa.table({"query_id": who.take(pa.array(of)), "id": ids.take(pa.array(best.ravel())), "sim": np.take_along_axis(sims, best, axis=1).ravel().astype(np.float64)}))
        return pa.concat_tables(found) if found else pa.table({"query_id": who.slice(0, 0), "id": ids.slice(0, 0), "sim": pa.array([], pa.float64())})

    scored = asked.groupBy("cell", "part").cogroup(index.codes.groupBy("cell", "part")).applyInArrow(match, f"query_id {kinds[0]}, id {kinds[1]}, sim double")
    by = Window.partitionBy("query_id")
    # a vector comes from up to spread cells, with as many roundings
    near = scored.withColumn("n", F.row_number().over(by.orderBy(F.desc("sim"), "id"))).where(F.col("n") <= depth * SPREAD).groupBy("query_id", "id").agg(F.max("sim").alias("sim"))
    near = near.withColumn("n", F.row_number().over(by.orderBy(F.desc("sim"), "id"))).where(F.col("n") <= depth).drop("n")
    keys = index.vectors.select(F.col("first").alias("id"), key, "embedding")
    if mode == "refined":
        again = near.join(q.withColumnRenamed("embedding", "q"), "query_id").join(keys, "id").select("query_id", key, F.round(similarity(F.col("q"), F.col("embedding")), 6).alias("sim"))
    else:
        again = near.join(keys, "id").select("query_id", key, F.round(F.greatest(F.least("sim", F.lit(1.0)), F.lit(0.0)), 6).alias("sim"))
    return again.withColumn("rank", F.row_number().over(by.orderBy(F.desc("sim"), F.asc(key)))).where(F.col("rank") <= k)
