"""Benchmark decontamination: one Aho-Corasick automaton over the normalised windows of all
benchmark items, and one scan of each normalised text with offsets mapped back to the original.

Normalised means: A-Z lower-cased, words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ joined by one space.  A
window is ``width`` consecutive words of an item; an item of fewer words, but not none, is one
window.  A document word inside any occurrence of a window is hit.

The benchmark reaches the executors in blocks of at most ``block_bytes`` of text, one automaton and
one pass each, so that a large benchmark costs passes and not memory; all usual ones are one block.

Null or empty texts have no words and no hits.  Items without words match nothing; items without id
count under the empty id; items that share an id count once.  Each document row gives one row,
repeated rows included; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_slices, pick

WIDTH, BLOCK_BYTES = 10, 256 << 10
#: Bytes of words as they are but for A-Z, all others a space.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return [] if text is None else text.translate(NORMAL).split()


def windows(words: list[bytes], width: int) -> set[bytes]:
    if not words:
        return set()
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def automaton(items: list[tuple[str, str]], width: int):
    """Windows with a space on either side, as latin-1 strings -> (number of words, ids of items)."""
    import ahocorasick

    ids: dict[bytes, set[str]] = {}
    for item, text in items:
        for w in windows(words_of(text.encode()), width):
            ids.setdefault(w, set()).add(item)
    out = ahocorasick.Automaton()
    for w, of in ids.items():
        out.add_word(f" {w.decode('latin-1')} ", (w.count(b" ") + 1, tuple(of)))
    out.make_automaton()
    return out if ids else None


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words (ends exclusive) without overlaps, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def offsets(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code points of the original at which runs of words begin and end."""
    flat = np.frombuffer(text.translate(NORMAL), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flat.view(np.int8), [0]))))
    begin, end = edge[::2], edge[1::2]
    points = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
    return [(int(points[begin[a]]), int(points[end[b - 1]])) for a, b in runs]


RUNS = "array<struct<from:bigint,to:bigint>>"


def _scan(items, width: int, last: bool) -> Callable[[], Callable[[pa.RecordBatch], dict]]:
    def make():
        find = automaton(items.value, width)

        def run(batch: pa.RecordBatch) -> dict:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            out = {n: batch.column(n) for n in batch.schema.names if n not in ("runs", "items")} | {"n_words": [], "runs": [], "items": [], "spans": []}
            for text, runs, seen in zip(texts, batch.column("runs").to_pylist(), batch.column("items").to_pylist(), strict=True):
                words = words_of(text)
                hits, of = [(r["from"], r["to"]) for r in runs or ()], set(seen or ())
                if words and find is not None:
                    flat = b" %b " % b" ".join(words)
                    found = list(find.iter(flat.decode("latin-1")))
                    if found:
                        spaces = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
                        at = np.searchsorted(spaces, [e for e, _ in found])
                        for k, (_, (n, which)) in zip(at.tolist(), found, strict=True):
                            hits.append((k - n, k))
                            of.update(which)
                hits = merged(hits)
                out["n_words"].append(len(words))
                out["runs"].append([{"from": a, "to": b} for a, b in hits])
                out["items"].append(sorted(of))
                out["spans"].append([{"from": a, "to": b} for a, b in offsets(text, hits)] if last and hits else [])
            return out

        return run

    return make


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES):
    """The items in lists of at most block_bytes of text each (a larger item is a list of its own)."""
    rows, n = [], 0
    items = pick(benchmark, "item_id", "text").where("text IS NOT NULL").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    for r in items.toLocalIterator():
        size = len(r["text"].encode())
        if rows and n + size > block_bytes:
            yield rows
            rows, n = [], 0
        rows.append((r["item"], r["text"]))
        n += size
    yield rows


def scan(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep, text, n_words, runs (of hit words), items (ids, sorted) and spans (code points in the original)."""
    spark = docs.sparkSession
    d = pick(docs, *dict.fromkeys((*keep, "text")))
    named = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema)
    schema = f"{named}, n_words bigint, runs {RUNS}, items array<string>, spans {RUNS}"
    names = d.columns
    out = d.select("*", F.lit(None).cast(RUNS).alias("runs"), F.lit(None).cast("array<string>").alias("items"))
    parts = [spark.sparkContext.broadcast(b) for b in blocks(benchmark, block_bytes)]
    for k, part in enumerate(parts):
        out = in_slices(out.select(*names, "runs", "items"), schema, None, make=_scan(part, width, k == len(parts) - 1))
    return out


def digest(scanned: DataFrame) -> DataFrame:
    """Per document: words, hit words, items and their digest, verdict."""
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r["to"] - r["from"])
    return scanned.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
