"""Substring dedup by prefix-partitioned suffix trees.

A window is ``width`` consecutive words of a document; each word is removed that lies in a window whose
words also start earlier (in a document of smaller doc_id, or further left in the same one).

The suffix tree of all texts would fit no machine.  It is split by prefixes of suffixes, and only its
deep internal nodes are built:

1. *Suffixes.*  Each window names one suffix within it, that whose first ``prefix`` words have the least
   hash (the leftmost of equal ones).  Equal windows name equal suffixes at equal offsets, and
   neighbouring windows mostly the same one, so that about one suffix in six carries all windows: those
   that name it are its stretch, at most ``width - prefix + 1`` windows.
2. *Prefixes* that occur once are leaves near the root and go.  Stretches whose words are equal to those
   of an earlier stretch are removed whole, and need no tree: copies meet in each slice of a batch
   first, so that a prefix or text with a third of all rows is a few rows a slice.
3. *Groups.*  What is left is grouped by prefix.  Each group's suffixes are sorted, and the common
   lengths of neighbours give the internal nodes: suffixes beneath one node of depth d share d words.
   The words before the suffixes are sorted likewise, from right to left.  A window that begins j words
   before its suffix is a repeat of those that share its node at depth ``width - j`` and its node at
   depth j of the words before; all but the earliest of them are removed.
4. *Longer prefixes.*  A group of over ``most`` suffixes is split by the longest prefixes there are, the
   windows themselves; a node of that depth needs no tree, only its earliest window, which is a minimum
   that combines within tasks before it is shuffled.

Hashes only bring suffixes together, but for the equality of stretches in step 2 (two sums of 64 bits
over hashes of 64 bits of the words); trees compare words.  Texts are shuffled twice, once to be cut at
the stretches that are left, once to lose their words.

Defined cases: null and empty texts have no words.  Windows of repeated rows of one doc_id start at the
same place, so none of these rows is earlier than another.  Rows without doc_id come after all others
and count as rows of one document.  Each row gives one row; further columns are ignored, those named in
``keep`` are passed on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, in_slices, pick, release, slices, small_batches, stored

WIDTH, PREFIX = 20, 8
#: Suffixes of a group that is made one tree.
MOST = 50_000
#: Bytes of text of a slice.
TOGETHER = 4 << 20
#: Stands for no doc_id, after all others.
LAST = (1 << 63) - 1

U = np.uint64
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads them (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, U)
    out[0] = 1
    return np.multiply.accumulate(out)


_WHITE = np.zeros(256, bool)
_WHITE[[32, *range(9, 14)]] = True


def word_hashes(data: np.ndarray, offsets: np.ndarray, at_once: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of texts (bytes, with their offsets), and the number of the first word of each text."""
    solid = ~_WHITE[data]
    before = np.concatenate(([False], solid[:-1]))
    after = np.concatenate((solid[1:], [False]))
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner], after[inner - 1] = False, False
    begin, end = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    out = np.empty(len(begin), U)
    for a in range(0, len(begin), at_once):
        b, e = begin[a : a + at_once], end[a : a + at_once]
        length = e - b
        first = np.concatenate(([0], np.cumsum(length)))
        within = np.arange(first[-1]) - np.repeat(first[:-1], length)
        x = (data[np.repeat(b, length) + within].astype(U) + U(1)) * _powers(_ODD[0], int(length.max()))[within]
        out[a : a + at_once] = _mix(np.add.reduceat(x, first[:-1]) + length.astype(U) * U(_ODD[1]))
    return out, np.searchsorted(begin, offsets)


def stretches(w: np.ndarray, first: np.ndarray, width: int, prefix: int) -> dict[str, np.ndarray]:
    """The stretches of texts: text, lo (word at which the first window begins, in the text), n (windows), back (words
    from there to the suffix), a (hash of the prefix), s and t (of all words of the stretch)."""
    none = {c: np.empty(0, np.int64) for c in ("text", "lo", "n", "back", "a", "s", "t")}
    count = np.diff(first)
    of = np.repeat(np.arange(len(count)), np.maximum(count - width + 1, 0))
    if not len(of):
        return none
    starts = np.repeat(first[:-1], np.maximum(count - width + 1, 0))
    starts = starts + (np.arange(len(of)) - np.searchsorted(of, of))
    power = _powers(_ODD[0], prefix)
    g = np.zeros(len(w) - prefix + 1, U)
    for j in range(prefix):
        g += w[j : j + len(g)] * power[j]
    g = _mix(g)
    span = width - prefix + 1
    least, arg = g[: len(g) - span + 1].copy(), np.zeros(len(g) - span + 1, np.int64)
    for j in range(1, span):
        x = g[j : j + len(least)]
        less = x < least
        np.copyto(least, x, where=less)
        arg[less] = j
    suffix = starts + arg[starts]
    begin = np.flatnonzero(np.concatenate(([True], suffix[1:] != suffix[:-1])))
    n = np.diff(np.append(begin, len(suffix)))
    lo, suffix, of = starts[begin], suffix[begin], of[begin]
    out = {"text": of, "lo": lo - first[of], "n": n, "back": suffix - lo, "a": g[suffix].view(np.int64)}
    for name, base in (("s", _ODD[1]), ("t", _ODD[2])):
        power = _powers(base, len(w) + 1)
        total = np.concatenate((np.zeros(1, U), np.cumsum(_mix(w + U(base)) * power[: len(w)])))
        inverse = _powers(pow(base, -1, 1 << 64), len(w) + 1)
        out[name] = _mix((total[lo + n + width - 1] - total[lo]) * inverse[lo] + n.astype(U)).view(np.int64)
    return out


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a column of texts without gaps, and offsets."""
    whole = pa.array(column.cast(pa.large_binary()).fill_null(b""), pa.large_binary())
    offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = np.frombuffer(whole.buffers()[2], np.uint8) if whole.buffers()[2] is not None and offsets[-1] else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


#: One row a stretch.  key: where it meets others of its prefix; repeated: the prefix is known to occur again;
#: whole: it repeats an earlier stretch, so that all its windows go.
_STRETCH = "key bigint, a bigint, s bigint, t bigint, doc_id bigint, print bigint, lo int, n int, back int, repeated boolean, whole boolean"


def _before(doc: np.ndarray, lo: np.ndarray, doc2: np.ndarray, lo2: np.ndarray) -> np.ndarray:
    return (doc < doc2) | ((doc == doc2) & (lo < lo2))


def _find(width: int, prefix: int):
    def run(batch: pa.RecordBatch) -> dict:
        data, offsets = _texts(batch.column("text"))
        w, first = word_hashes(data, offsets) if len(data) else (np.empty(0, U), np.zeros(len(offsets), np.int64))
        x = stretches(w, first, width, prefix)
        doc = batch.column("doc_id").to_numpy(zero_copy_only=False)[x["text"]]
        mark = batch.column("print").to_numpy(zero_copy_only=False)[x["text"]]
        by = np.lexsort((x["lo"], doc, x["s"], x["a"]))
        a, s, t, doc, mark, lo, n, back = x["a"][by], x["s"][by], x["t"][by], doc[by], mark[by], x["lo"][by], x["n"][by], x["back"][by]
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (s[1:] != s[:-1]) | (t[1:] != t[:-1])))[: len(a)]
        lead = np.flatnonzero(new)[np.cumsum(new) - 1] if len(a) else by
        whole = _before(doc[lead], lo[lead], doc, lo)
        fresh = np.concatenate(([True], a[1:] != a[:-1]))[: len(a)]
        group = np.cumsum(fresh) - 1
        repeated = np.bincount(group, minlength=1)[group] > 1 if len(a) else whole
        # the first of each prefix tells other slices of it; the others, known to be repeats, meet equal ones alone,
        # and those that repeat one of their slice, however many, meet none
        key = np.where(fresh, a, _mix(a.view(U) + s.view(U) * U(_ODD[2])).view(np.int64))
        key = np.where(whole, _mix(mark.view(U) + lo.astype(U) * U(_ODD[1])).view(np.int64), key)
        return {"key": key, "a": a, "s": s, "t": t, "doc_id": doc, "print": mark, "lo": lo, "n": n, "back": back, "repeated": repeated, "whole": whole}

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drops stretches with a prefix of their own, and marks those that repeat an earlier one; rows are sorted by
    key, a, s, t, doc_id and lo.  The last key of a batch waits for the next batch, as its leads alone."""
    held: pa.Table | None = None

    def judge(x: pa.Table) -> pa.Table:
        c = {n: x.column(n).to_numpy() for n in ("key", "a", "s", "t", "doc_id", "lo", "repeated", "whole")}
        apart = lambda *names: np.concatenate(([True], np.logical_or.reduce([c[k][1:] != c[k][:-1] for k in names])))
        group = np.cumsum(apart("key", "a")) - 1
        many = (np.bincount(group) > 1)[group] | c["repeated"]
        lead = np.flatnonzero(apart("key", "a", "s", "t"))[np.cumsum(apart("key", "a", "s", "t")) - 1]
        whole = c["whole"] | _before(c["doc_id"][lead], c["lo"][lead], c["doc_id"], c["lo"])
        at = x.schema.get_field_index
        return x.set_column(at("repeated"), "repeated", pa.array(many)).set_column(at("whole"), "whole", pa.array(whole))

    for batch in batches:
        if not batch.num_rows:
            continue
        x = pa.Table.from_batches([batch])
        x = judge(pa.concat_tables([held, x]) if held is not None else x)
        key = x.column("key").to_numpy()
        cut = int(np.searchsorted(key, key[-1]))
        done, held = x.slice(0, cut), x.slice(cut)
        if held.num_rows > BATCH_BYTES >> 6:  # a large key: what repeats an earlier stretch is judged for good
            gone = held.column("whole")
            done, held = pa.concat_tables([done, held.filter(gone)]), held.filter(pa.compute.invert(gone))
        yield from done.filter(done.column("repeated")).combine_chunks().to_batches()
    if held is not None:
        yield from held.filter(held.column("repeated")).combine_chunks().to_batches()
    release()


def _cut(width: int):
    """The words of each stretch, joined by spaces."""

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {c: [] for c in ("a", "doc_id", "print", "lo", "n", "back", "wide", "words")}
        for text, doc, mark, parts in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("doc_id").to_pylist(), batch.column("print").to_pylist(), batch.column("parts").to_pylist(), strict=True):
            words = text.split()
            for p in parts:
                lo, n = p["lo"], p["n"]
                for c in ("a", "lo", "n", "back", "wide"):
                    out[c].append(p[c])
                out["doc_id"].append(doc)
                out["print"].append(mark)
                out["words"].append(b" ".join(words[lo : lo + n + width - 1]))
        return out

    return run


def _depths(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of sorted rows, and how many leading entries each has in common with the one before."""
    by = np.lexsort(x.T[::-1])
    same = np.cumprod(x[by][1:] == x[by][:-1], axis=1).sum(axis=1) if x.shape[1] else np.zeros(len(x) - 1, np.int64)
    return by, np.concatenate(([-1], same))


def repeats(a: np.ndarray, words: list[list[bytes]], doc: np.ndarray, lo: np.ndarray, n: np.ndarray, back: np.ndarray, width: int, prefix: int) -> np.ndarray:
    """For each stretch of some groups the windows that start elsewhere before, as bits."""
    numbers: dict[bytes, int] = {}
    m, span = len(words), width - prefix
    right, left = np.full((m, 1 + width), -1, np.int64), np.full((m, 1 + span), -1, np.int64)
    right[:, 0] = left[:, 0] = np.unique(a, return_inverse=True)[1]
    for k, (ws, b) in enumerate(zip(words, back.tolist(), strict=True)):
        i = [numbers.setdefault(w, len(numbers)) for w in ws]
        r, before = i[b : b + width], i[:b][::-1]
        right[k, 1 : 1 + len(r)] = r
        left[k, 1 : 1 + len(before)] = before
    out = np.zeros(m, np.int64)
    (by_right, deep_right), (by_left, deep_left) = _depths(right), _depths(left)
    node_right, node_left = np.empty(m, np.int64), np.empty(m, np.int64)
    for j in range(span + 1):  # windows that begin j words before their suffix
        has = np.flatnonzero((back >= j) & (back - j < n))
        if not len(has):
            continue
        # the nodes: suffixes beneath one share 1 + depth entries, the group's number among them
        node_right[by_right] = np.cumsum(deep_right < 1 + width - j)
        node_left[by_left] = np.cumsum(deep_left < 1 + j)
        start = lo[has] + back[has] - j
        by = np.lexsort((start, doc[has], node_left[has], node_right[has]))
        p, q, d, s = node_right[has][by], node_left[has][by], doc[has][by], start[by]
        new = np.concatenate(([True], (p[1:] != p[:-1]) | (q[1:] != q[:-1])))
        lead = np.flatnonzero(new)[np.cumsum(new) - 1]
        late = has[by][_before(d[lead], s[lead], d, s)]
        out[late] |= 1 << (back[late] - j)
    return out


def _trees(width: int, prefix: int):
    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Bits of repeated windows; rows are sorted by prefix, and a group is never split."""
        held: list[pa.RecordBatch] = []

        def judge(x: pa.Table) -> Iterator[pa.RecordBatch]:
            if not x.num_rows:
                return
            c = {k: x.column(k).to_numpy() for k in ("a", "doc_id", "lo", "n", "back")}
            bits = repeats(c["a"], [b.split(b" ") for b in x.column("words").to_pylist()], c["doc_id"], c["lo"].astype(np.int64), c["n"].astype(np.int64), c["back"].astype(np.int64), width, prefix)
            got = pa.table({"doc_id": x.column("doc_id"), "print": x.column("print"), "lo": x.column("lo"), "bits": pa.array(bits)})
            yield from got.filter(pa.array(bits != 0)).combine_chunks().to_batches()

        for batch in batches:
            for part in slices(batch, 8192, None):
                a = part.column("a").to_numpy()
                cut = int(np.searchsorted(a, a[-1]))
                if cut:
                    yield from judge(pa.Table.from_batches([*held, part.slice(0, cut)]))
                    held = []
                held.append(part.slice(cut))
        if held:
            yield from judge(pa.Table.from_batches(held))
        release()

    return trees


def _remove(width: int):
    def run(batch: pa.RecordBatch) -> dict:
        out: dict = {c: batch.column(c) for c in batch.schema.names if c not in ("text", "hits")}
        kept, spans, n_words, n_removed = [], [], [], []
        for text, hits in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("hits").to_pylist(), strict=True):
            words = (text or b"").split()
            n_words.append(len(words))
            if not hits:
                spans.append([])
                n_removed.append(0)
                kept.append(b" ".join(words))
                continue
            starts = sorted({h["lo"] + k for h in hits for k in range(h["bits"].bit_length()) if h["bits"] >> k & 1})
            found, b = [], -1
            for s in starts:
                if found and s <= b:
                    found[-1][1] = b = s + width
                else:
                    found.append([s, b := s + width])
            spans.append([{"start": s, "end": e} for s, e in found])
            n_removed.append(sum(e - s for s, e in found))
            left = [w for e, s in zip([0, *(e for _, e in found)], [*(s for s, _ in found), len(words)], strict=True) for w in words[e:s]]
            kept.append(b" ".join(left))
        return out | {"n_words": n_words, "n_removed": n_removed, "spans": spans, "kept": pa.array(kept, pa.binary()).cast(pa.string())}

    return run


def _wide(leaves: DataFrame, width: int) -> DataFrame:
    """Repeated windows of stretches of groups too large for one tree: doc_id, print, lo, bits."""

    def windows(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {c: [] for c in ("w", "doc_id", "print", "lo")}
        for words, doc, mark, lo, n in zip(*(batch.column(c).to_pylist() for c in ("words", "doc_id", "print", "lo", "n")), strict=True):
            ws = words.split(b" ")
            for k in range(n):
                out["w"].append(hashlib.blake2b(b" ".join(ws[k : k + width]), digest_size=16).digest())
                out["doc_id"].append(doc)
                out["print"].append(mark)
                out["lo"].append(lo + k)
        return out

    each = in_slices(leaves.select("words", "doc_id", "print", "lo", "n"), "w binary, doc_id bigint, print bigint, lo int", windows, 1024)
    first = each.groupBy("w").agg(F.min(F.struct("doc_id", "lo")).alias("first"))
    late = F.struct("doc_id", "lo") > F.col("first")
    return each.join(first, "w").where(late).select("doc_id", "print", "lo", F.lit(1).cast("long").alias("bits"))


def substring_dedup(docs: DataFrame, width: int = WIDTH, prefix: int = PREFIX, keep: tuple[str, ...] = ("doc_id",), most: int = MOST) -> DataFrame:
    """The columns of keep, n_words, n_removed, spans array<struct<start, end>> of the removed words, and kept: the
    other words, joined by spaces."""
    small_batches(docs.sparkSession)
    names = tuple(dict.fromkeys((*keep, "doc_id", "text")))
    d = pick(docs, *names)
    held = [(c, t) for c, t in d.dtypes if c in keep]
    d = d.select(*[F.col(c).alias(f"keep_{c}") for c, _ in held], "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.xxhash64("text").alias("print"))
    found = in_slices(d.where("text IS NOT NULL").select("text", "doc_id", "print"), _STRETCH, _find(width, prefix), most=TOGETHER)
    order = ("key", "a", "s", "t", "doc_id", "lo")
    met = stored(found.repartition("key").sortWithinPartitions(*order).mapInArrow(_meet, _STRETCH).drop("key", "s", "t", "repeated"), "stretches")
    leaves = met.where("NOT whole").drop("whole")
    large = leaves.groupBy("a").count().where(F.col("count") > most).select("a", F.lit(True).alias("wide"))
    marked = leaves.join(large, "a", "left").withColumn("wide", F.coalesce("wide", F.lit(False)))
    parts = marked.groupBy("doc_id", "print").agg(F.collect_set(F.struct("a", "lo", "n", "back", "wide")).alias("parts"))
    cut = in_slices(d.join(parts, ["doc_id", "print"]).select("text", "doc_id", "print", "parts"), "a bigint, doc_id bigint, print bigint, lo int, n int, back int, wide boolean, words binary", _cut(width), most=TOGETHER)
    cut = stored(cut, "suffixes")
    hits = "doc_id bigint, print bigint, lo int, bits bigint"
    trees = cut.where("NOT wide").select("a", "doc_id", "print", "lo", "n", "back", "words").repartition("a").sortWithinPartitions("a").mapInArrow(_trees(width, prefix), hits)
    gone = met.where("whole").select("doc_id", "print", "lo", F.expr("shiftleft(1L, n) - 1").alias("bits"))
    hit = gone.unionByName(trees).unionByName(_wide(cut.where("wide"), width)).groupBy("doc_id", "print").agg(F.collect_set(F.struct("lo", "bits")).alias("hits"))
    last = d.join(hit, ["doc_id", "print"], "left").drop("doc_id", "print")
    schema = ", ".join([*(f"`keep_{c}` {t}" for c, t in held), "n_words bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept string"])
    out = in_slices(last, schema, _remove(width), most=TOGETHER)
    return out.select(*[F.col(f"keep_{c}").alias(c) for c, _ in held], "n_words", "n_removed", "spans", "kept")
