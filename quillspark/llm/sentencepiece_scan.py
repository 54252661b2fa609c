"""SentencePiece encoding and decoding by a max-plus parallel scan.

The best segmentation of a text maximises the sum of its pieces' scores.  Over a chunk of text that
is a max-plus matrix T[e, x]: e characters at the chunk's start belong to a piece that began before
it, x characters after its end belong to a piece that began within it.  Matrices combine
associatively; from the combined ones follow the states at all boundaries, and each chunk is then
traced back for itself.

Texts of up to ``giant`` characters are one chunk, whose words (no piece runs over the beginning of a
run of spaces) are segmented many at a time.  Longer ones are dealt out by chunk: one row a chunk
yields its matrix; up to FAN neighbours combine to one matrix, these by document, which gives the
states between groups, then within each group; and the chunks go out with their states.  FAN * FAN
chunks are more than a string can hold, so no row has more than FAN matrices (16 x 16 pairs of
numbers each) but for the ids of a document, which are one row of the result.

Scores are whole numbers.  Between segmentations of equal score a second sum decides: each piece has
a number that follows from its place within its stretch (from one beginning of spaces to the next) and its
length.  So the best segmentation is one, and the ids do not depend on chunks.

Null texts have null ids, empty ones none.  Each row gives one row, repeated rows included; other
columns are ignored.  Decoding gives the text back exactly: characters without piece are spelt in
bytes.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_slices, pick, stored
from .vocabulary import LONG, PIECES, Vocabulary, by_size, vocabulary, words_of

CHUNK, GIANT, FAN = 16_384, 65_536, 512
CUT = re.compile(r"(?<! ) ")
NEVER = -(1 << 61)
#: Of sums of scores and of deciding numbers in one integer, for words of up to LONG characters.
SHIFT = 32


def decider(at: int, length: int) -> int:
    """26 bits that follow from a piece's place in its stretch and its length."""
    x = (at * 0x9E3779B1 + length * 0x85EBCA6B) & 0xFFFFFFFF
    x = ((x ^ x >> 15) * 0x2C1B3C6D) & 0xFFFFFFFF
    return ((x ^ x >> 12) * 0x297A2D39 & 0xFFFFFFFF) >> 6


def spelt_out(v: Vocabulary, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ids with code points (as -1 - c) put as the ids of their bytes, and how many each has become."""
    many = np.ones(len(ids), np.int64)
    odd = np.flatnonzero(ids < 0)
    if not len(odd):
        return ids, many
    points, of = np.unique(-1 - ids[odd], return_inverse=True)
    spelt = [chr(c).encode() for c in points.tolist()]
    many[odd] = np.array([len(b) for b in spelt])[of]
    out = np.repeat(ids, many)
    at = (np.cumsum(many) - many)[odd]
    for k in range(4):
        some = many[odd] > k
        out[at[some] + k] = v.byte[[b[k] if k < len(b) else 0 for b in spelt]][of[some]]
    return out, many


def best_words(v: Vocabulary, points: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the best segmentations of words of up to LONG characters, how many each has, and their scores."""
    n, width = len(size), points.shape[1]
    best = np.full(n * width, np.int64(-1 << 62))  # by place, word after word
    best[::width] = 0
    length, piece = np.zeros(n * width, np.uint8), np.zeros(n * width, np.int32)
    score, spelt = v.score << SHIFT, points.ravel()
    for at, k, word, ids in v.steps(points, size):
        begin = word * width + at
        total = best.take(begin) + score.take(ids, mode="wrap") + decider(at, k)
        better = np.flatnonzero(total > best.take(begin + k))
        end = begin.take(better) + k
        best[end], length[end], piece[end] = total.take(better), k, ids.take(better)
    first = np.arange(n) * width
    place, row, back = first + size, np.arange(n), []
    while len(row):
        end = place.take(row)
        ids, begin = piece.take(end), end - length.take(end)
        place[row] = begin
        column = np.full(n, np.iinfo(np.int32).min, np.int32)
        column[row] = np.where(ids >= 0, ids, -1 - spelt.take(begin))
        back.append(column)
        row = row[begin > first.take(row)]
    if not back:
        return np.zeros(0, np.int32), np.zeros(n, np.int64), np.zeros(n, np.int64)
    table = np.stack(back[::-1], axis=1)
    real = table != np.iinfo(np.int32).min
    ids, many = spelt_out(v, table[real])
    last = np.cumsum(real.sum(axis=1))
    total = np.concatenate(([0], np.cumsum(many)))[last]
    return ids, np.diff(total, prepend=0), best[first + size] >> SHIFT


def sweep(v: Vocabulary, s: str, begin: int, stop: int, origin: int, entries: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Best sums and deciding sums to each place from begin to reach, by entry: rows are places, columns entries.

    Entry e is the place begin + e.  Pieces begin in [begin, stop) and end at reach at most; s[0] is
    ``origin`` characters after the beginning of its stretch.
    """
    score, tie = np.full((reach - begin + 1, entries), NEVER), np.zeros((reach - begin + 1, entries), np.int64)
    for e in range(min(entries, reach - begin + 1)):
        score[e, e] = 0
    for at in range(begin, stop):
        a, b = score[at - begin], tie[at - begin]
        if (live := a > NEVER // 2).any():
            for end, i in v.edges(s, at, reach):
                p, q = np.where(live, a + v.score[i], NEVER), b + decider(origin + at, end - at)
                k = end - begin
                better = (p > score[k]) | (p == score[k]) & live & (q > tie[k])
                score[k], tie[k] = np.where(better, p, score[k]), np.where(better, q, tie[k])
    return score, tie


def best_path(v: Vocabulary, s: str, begin: int, stop: int, end: int, origin: int) -> tuple[list[int], int, int]:
    """Ids, score and deciding sum of the best segmentation of s[begin:end] whose pieces begin before stop."""
    best: list = [None] * (end - begin + 1)
    best[0] = (0, 0, 0, 0)
    score = v.score
    for at in range(begin, stop):
        if (a := best[at - begin]) is None:
            continue
        for e, i in v.edges(s, at, end):
            b = (a[0] + int(score[i]), a[1] + decider(origin + at, e - at))
            if best[e - begin] is None or b > best[e - begin][:2]:
                best[e - begin] = (*b, at, i)
    out, k = [], end
    while k > begin:
        _, _, at, i = best[k - begin]
        out.append(i if i >= 0 else -1 - ord(s[at]))
        k = at
    ids, _ = spelt_out(v, np.array(out[::-1], np.int64))
    return ids.tolist(), *best[-1][:2]


def encode_words(v: Vocabulary, words: list[str]) -> tuple[pa.ListArray, np.ndarray]:
    """Ids of words (stretches from cut to cut) and their scores."""
    many, score, parts, order = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [], []
    for place, points, size in by_size(words):
        ids, n, total = best_words(v, points, size)
        many[place], score[place] = n, total
        parts.append(ids)
        order.append(place)
    for k in [k for k, w in enumerate(words) if len(w) > LONG]:
        w = words[k]
        ids, score[k], _ = best_path(v, w, 0, len(w), len(w), 0)
        many[k] = len(ids)
        parts.append(np.array(ids, np.int32))
        order.append(np.array([k]))
    if not parts:
        return pa.array([], pa.list_(pa.int32())), score
    order = np.concatenate(order)
    offsets = np.concatenate(([0], np.cumsum(many[order]))).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts).astype(np.int32)))
    back = np.empty(len(words), np.int64)
    back[order] = np.arange(len(words))
    return lists.take(pa.array(back)), score


def encode_texts(v: Vocabulary, texts: list[str | None]) -> pa.ListArray:
    """The ids of texts, each as one chunk."""
    some = [t.encode() for t in texts if t]
    words, n = words_of(some, True)
    lists, _ = encode_words(v, words.dictionary.to_pylist())
    many = pc.list_value_length(lists).to_numpy().astype(np.int64)
    at = words.indices.to_numpy()
    each = np.concatenate(([0], np.cumsum(many[at])))
    ends = each[np.cumsum(n)] if len(n) else np.zeros(0, np.int64)
    full = np.zeros(len(texts), np.int64)
    full[[k for k, t in enumerate(texts) if t]] = np.diff(ends, prepend=0)
    offsets = np.concatenate(([0], np.cumsum(full))).astype(np.int32)
    flat = lists.take(words.indices).flatten()
    return pa.ListArray.from_arrays(pa.array(offsets), flat, mask=pa.array([t is None for t in texts], pa.bool_()))


def matrix(v: Vocabulary, s: str, n: int, origin: int) -> np.ndarray:
    """T[0 or 1, e, x] of the first n characters of s: scores and deciding sums; s goes on for as long as a piece may."""
    m = v.longest
    cuts = [c.start() for c in CUT.finditer(s, 1 if origin else 0)]
    inner = [c for c in cuts if c < n and (c or not origin)]
    reach = min([len(s), n + m - 1, *[c for c in cuts if c >= n]])
    out = np.stack((np.full((m, m), NEVER), np.zeros((m, m), np.int64)))
    if not inner:
        got = sweep(v, s, 0, n, origin, m, reach)
        k = max(0, reach - n + 1)
        for a in (0, 1):
            out[a, :, :k] = got[a][n : n + k].T
        return out
    first, last = inner[0], inner[-1]
    head = sweep(v, s, 0, first, origin, m, first)
    lists, score = encode_words(v, [s[a:b] for a, b in zip(inner, inner[1:], strict=False)])
    tail = sweep(v, s, last, n, -last, 1, reach)
    k = max(0, reach - n + 1)
    for a in (0, 1):
        # words between cuts add the same to all paths: their deciding sums may be left out
        out[a, :, :k] = head[a][first][:, None] + tail[a][n - last : n - last + k, 0][None, :] + (int(score.sum()) if a == 0 else 0)
    out[0][out[0] < NEVER // 2] = NEVER
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus with a second sum that decides between equals: combines the matrices of neighbours."""
    score = a[0][:, :, None] + b[0][None, :, :]
    best = score.max(axis=1)
    tie = np.where(score == best[:, None, :], a[1][:, :, None] + b[1][None, :, :], NEVER).max(axis=1)
    return np.stack((np.maximum(best, NEVER), np.where(best < NEVER // 2, 0, tie)))


def combined(ts: list[np.ndarray]) -> np.ndarray:
    """The product of neighbours, as a tree."""
    while len(ts) > 1:
        ts = [product(ts[k], ts[k + 1]) if k + 1 < len(ts) else ts[k] for k in range(0, len(ts), 2)]
    return ts[0]


def states(ts: list[np.ndarray], e: int = 0, x: int = 0) -> list[int]:
    """States at the boundaries of chunks between e and x: a scan forth, then a trace back."""
    fore = [ts[0][:, e : e + 1, :]]
    for t in ts[1:-1]:
        fore.append(product(fore[-1], t))
    out = [x]
    for k in range(len(ts) - 1, 0, -1):
        whole, tie = fore[k - 1][0][0] + ts[k][0][:, out[-1]], fore[k - 1][1][0] + ts[k][1][:, out[-1]]
        out.append(int(np.argmax(np.where(whole == whole.max(), tie, NEVER))))
    return [e, *out[::-1]]


def traced(v: Vocabulary, s: str, n: int, origin: int, e: int, x: int) -> list[int]:
    """The ids of the pieces that begin in the first n characters of s, between states e and x."""
    if e >= n:
        return []
    cuts = [c.start() for c in CUT.finditer(s, 1 if origin else 0, n) if (c.start() or not origin) and c.start() >= e]
    if not cuts:
        return best_path(v, s, e, n, n + x, origin)[0]
    out = best_path(v, s, e, cuts[0], cuts[0], origin)[0] if e < cuts[0] else []
    lists, _ = encode_words(v, [s[a:b] for a, b in zip(cuts, cuts[1:], strict=False)])
    out.extend(lists.flatten().to_pylist())
    return out + best_path(v, s, cuts[-1], n, n + x, -cuts[-1])[0]


def chunks_of(text: str, chunk: int, longest: int) -> list[tuple[str, int, int]]:
    """Chunks of a text: each with the characters that a piece may run on over, how many are its own, and
    how many of its stretch lie before it."""
    s, out, since = " " + text, [], 0
    for a in range(0, len(s), chunk):
        for c in CUT.finditer(s, max(a - chunk, 1), a + 1 if a else 0):
            since = c.start()
        out.append((s[a : a + chunk + longest - 1], min(chunk, len(s) - a), a - since))
    return out


def encode(v: Vocabulary, text: str, chunk: int = CHUNK) -> list[int]:
    """The ids of a text by chunks."""
    if not text:
        return []
    parts = chunks_of(text, chunk, v.longest)
    at = states([matrix(v, *p) for p in parts])
    return [i for p, e, x in zip(parts, at[:-1], at[1:], strict=True) for i in traced(v, *p, e, x)]


def sentencepiece_encode(docs: DataFrame, path: str = PIECES, chunk: int = CHUNK, giant: int = GIANT, keep: tuple[str, ...] = ("doc_id", "text"), fan: int = FAN) -> DataFrame:
    """The columns of keep, and ids array<int>."""
    d = pick(docs, *dict.fromkeys((*keep, "text")))
    named = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema)

    def whole():
        v = vocabulary(path)

        def run(batch: pa.RecordBatch) -> dict:
            return {n: batch.column(n) for n in batch.schema.names} | {"ids": encode_texts(v, batch.column("text").to_pylist())}

        return run

    size = F.coalesce(F.length("text"), F.lit(0))
    short = in_slices(d.where(size <= giant), f"{named}, ids array<int>", None, make=whole, most=16 << 20)
    # the giant texts, once each, as chunks
    long = stored(d.where(size > giant).withColumn("__key", F.sha2("text", 256)), "giant")

    def deal(batches):
        longest = vocabulary(path).longest
        for batch in batches:
            for key, text in zip(*(batch.column(c).to_pylist() for c in ("key", "text")), strict=True):
                parts = chunks_of(text, chunk, longest)
                for a in range(0, len(parts), 64):
                    some = parts[a : a + 64]
                    k = range(a, a + len(some))
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(some)), pa.array([x // fan for x in k], pa.int32()), pa.array(k, pa.int32()), *[pa.array([p[c] for p in some], t) for c, t in enumerate((pa.string(), pa.int32(), pa.int64()))]], names=["key", "part", "k", "s", "n", "origin"])

    texts = long.select(F.col("__key").alias("key"), "text").groupBy("key").agg(F.first("text").alias("text"))
    cells = stored(texts.mapInArrow(deal, "key string, part int, k int, s string, n int, origin bigint"), "chunks")

    def matrices():
        v = vocabulary(path)

        def run(batch: pa.RecordBatch) -> dict:
            ts = [matrix(v, *row).astype("<i8").tobytes() for row in zip(*(batch.column(c).to_pylist() for c in ("s", "n", "origin")), strict=True)]
            return {c: batch.column(c) for c in ("key", "part", "k")} | {"t": ts}

        return run

    m = vocabulary(path).longest
    read = lambda xs: [np.frombuffer(x["t"], "<i8").reshape(2, m, m) for x in xs]
    spread = cells.repartition(F.col("key"), F.col("k"))  # matrices and traces are the work: a task a few chunks
    ts = in_slices(spread, "key string, part int, k int, t binary", None, rows=16, make=matrices)
    groups = stored(ts.groupBy("key", "part").agg(F.sort_array(F.collect_list(F.struct("k", "t"))).alias("ts")), "matrices")

    def reduced(batch: pa.RecordBatch) -> dict:
        return {"key": batch.column("key"), "part": batch.column("part"), "t": [combined(read(ts)).astype("<i8").tobytes() for ts in batch.column("ts").to_pylist()]}

    def between(batch: pa.RecordBatch) -> dict:
        return {"key": batch.column("key"), "at": [states(read(ts)) for ts in batch.column("ts").to_pylist()]}

    def within(batch: pa.RecordBatch) -> dict:
        rows = zip(*(batch.column(c).to_pylist() for c in ("ts", "e", "x")), strict=True)
        return {"key": batch.column("key"), "k": [[t["k"] for t in ts] for ts in batch.column("ts").to_pylist()], "at": [states(read(ts), e, x) for ts, e, x in rows]}

    of_parts = in_slices(groups, "key string, part int, t binary", reduced, rows=4).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("part", "t"))).alias("ts"))
    ends = in_slices(of_parts, "key string, at array<int>", between, rows=4).select("key", F.posexplode(F.arrays_zip(F.expr("slice(at, 1, size(at) - 1)").alias("e"), F.expr("slice(at, 2, size(at) - 1)").alias("x"))).alias("part", "s"))
    inner = in_slices(groups.join(ends.select("key", "part", "s.e", "s.x"), ["key", "part"]), "key string, k array<int>, at array<int>", within, rows=4)
    at = inner.select("key", F.explode(F.arrays_zip(F.col("k").alias("k"), F.expr("slice(at, 1, size(at) - 1)").alias("e"), F.expr("slice(at, 2, size(at) - 1)").alias("x"))).alias("s")).select("key", "s.k", "s.e", "s.x")

    def traces():
        v = vocabulary(path)

        def run(batch: pa.RecordBatch) -> dict:
            rows = zip(*(batch.column(c).to_pylist() for c in ("s", "n", "origin", "e", "x")), strict=True)
            return {"key": batch.column("key"), "k": batch.column("k"), "ids": [traced(v, *row) for row in rows]}

        return run

    placed = cells.join(at, ["key", "k"])
    ids = in_slices(placed, "key string, k int, ids array<int>", None, rows=16, make=traces).groupBy("key").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("k", "ids"))), lambda c: c["ids"])).alias("ids"))
    return short.unionByName(long.join(ids.withColumnRenamed("key", "__key"), "__key").drop("__key")).select(*keep, "ids")


def decode(spelt: pa.BinaryArray, ids: pa.ListArray) -> list[str | None]:
    """Texts of ids, less the space that encoding puts before each."""
    flat = spelt.take(ids.flatten())
    at = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy())))
    place = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset : flat.offset + len(flat) + 1] if len(flat) else np.zeros(1, np.int32)
    data = flat.buffers()[2].to_pybytes() if len(flat) else b""
    out: list[str | None] = []
    for ok, a, b in zip(ids.is_valid().to_pylist(), place[at[:-1]].tolist(), place[at[1:]].tolist(), strict=True):
        out.append(data[a + (data[a : a + 1] == b" " and b > a) : b].decode() if ok else None)
    return out


def sentencepiece_decode(ids: DataFrame, path: str = PIECES, column: str = "ids", to: str = "decoded") -> DataFrame:
    """ids with the text of a column of ids added."""
    named = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ids.schema)

    def make():
        spelt = vocabulary(path).spelt

        def run(batch: pa.RecordBatch) -> dict:
            return {n: batch.column(n) for n in batch.schema.names} | {to: decode(spelt, batch.column(column))}

        return run

    return in_slices(ids, f"{named}, `{to}` string", None, make=make)
