"""N-gram Jaccard join by prefix trees: which documents' sets of n-word shingles are alike.

A document's set: distinct shingles of ``width`` lower-cased (A-Z) words; with fewer words, the whole
sequence as one.  Two documents link when 100 * |intersection| >= percent * |union|.

1. One pass over the texts gives each document's class, for equal sets are one class (a 128-bit digest)
   and exact copies cost one row of a few numbers, and the counts of shingles that repeat.
2. Sets that may link meet by signature: sets of sizes a and b that link differ in at most
   d = (a + b)(100 - percent) / (100 + percent) shingles, so of d + 1 + z blocks into which hashes deal
   the shingles, 1 + z are equal.  A second pass gives one row for each class and block: hash of size
   class, block and content.  Blocks that hold nothing but shingles of a table of frequent ones (at
   most ``known``), or nothing, are left out wherever at most z are such, for then an equal block of
   another kind is left.  Nothing is missed, but sets that share no more than a passage meet as well, and
   in a large table chains of such meetings would make one group of most of it.  So sets with a signature
   in common are a pair only if their sketches allow a link: a sketch has the parity of the shingles in
   each of some bins, and two of them differ in no more bits than their sets differ in shingles.
   Signatures of a few classes give all their pairs, those of up to MANY a forest of the pairs that
   the sketches allow, others a star.  Connected components of the pairs give groups.
3. The sets of a group meet in one task, or, if they hold more than ``most`` shingles, in parts of about
   that size, each together with the group's leader (its least class).  Sets that these links leave
   apart from the leader are then compared with those that are not, and with each other, in parts as well.
   In a task the sets, ordered globally by the shingles' frequency in the table and their hash, make a trie.
   Each set walks it once: nodes share the overlap of
   their common beginning, and a subtree is left as soon as the rest of its sets and of the walker
   cannot reach the bound, or all its sets are known to be connected with the walker.  Each task
   returns a forest of links, never all pairs.
4. Connected components of the forests give each class, and so each document, its component.

Null texts and texts without words have the empty set and link with nothing, copies of each other
included.  component_id is the least doc_id reachable by links, itself included; null ids count only
where a component has no other.  Each row gives one row, repeated rows included; other columns are
ignored.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE, cut, in_slices, pick, release, slices, small_batches, stored
from .components import components

WIDTH, PERCENT, MOST = 3, 90, 1 << 20
#: Size of the table of frequent shingles, and how often one must occur among COUNTED ones of a task to be counted.
KNOWN, REPEATED, COUNTED = 1 << 20, 2, 2 << 20
#: Classes of a signature whose pairs are rows, and of one whose pairs are compared in one task.
FEW, MANY = 16, 10_000
#: Least bits of a sketch.
BITS = 256
#: Bytes of text that are hashed at once; longer words are hashed alone.
SLICE, LONG_WORD = 4 << 20, 128
#: 128 bits of a text.
_KEY = ("__a", "__b")
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer of 64 bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of texts, and their number by text; all bytes of a place at once."""
    flat = b" ".join([(t or b"").lower() for t in texts]) + b" "
    data = np.frombuffer(flat, np.uint8)
    blank = (data == 32) | (data - np.uint8(9) < np.uint8(5))
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if not blank[0]:
        edge = np.concatenate(([0], edge))
    begin, end = edge[::2], edge[1::2]
    size = end - begin
    out = np.full(len(begin), 0xCBF29CE484222325, np.uint64)
    some, at, prime = np.flatnonzero(size <= LONG_WORD), 0, np.uint64(0x100000001B3)
    left = size[some]
    while len(some):
        out[some] = (out[some] ^ data[begin[some] + at]) * prime
        at += 1
        more = left > at
        some, left = some[more], left[more]
    out = mix(out)
    for k in np.flatnonzero(size > LONG_WORD).tolist():
        out[k] = xxhash.xxh3_64_intdigest(flat[begin[k] : end[k]])
    stop = np.cumsum([len(t or b"") + 1 for t in texts])
    return out, np.diff(np.searchsorted(begin, stop), prepend=0)


def shingle_sets(texts: list[bytes | None], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of each text."""
    if not texts:
        return []
    h, words = word_hashes(texts)
    k = np.minimum(words, width)
    many = np.where(words > 0, words - k + 1, 0)
    first = np.cumsum(words) - words
    stop = np.cumsum(many)
    begin = stop - many
    at = np.repeat(first - begin, many) + np.arange(int(many.sum()))
    of = np.repeat(k, many)
    out = of.astype(np.uint64)
    for i in range(width):
        if (of > i).all():
            out = mix(out * _A + h.take(at + i))
        else:
            some = np.flatnonzero(of > i)
            out[some] = mix(out[some] * _A + h[at[some] + i])
    for a, b in zip(begin.tolist(), stop.tolist(), strict=True):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[begin[many > 0]] = True
    kept = np.concatenate(([0], np.cumsum(new)))
    out = out[new]
    return [out[a:b] for a, b in zip(kept[begin].tolist(), kept[stop].tolist(), strict=True)]


def digest_of(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


class Classes:
    """Size classes: from low[c] on; sets that link are in the same class or in neighbours."""

    def __init__(self, percent: int) -> None:
        self.percent, self.low = percent, [1]

    def of(self, n: int) -> int:
        while self.low[-1] <= n:
            self.low.append(max(self.low[-1] + 1, self.low[-1] * 100 // self.percent + 1))
        return int(np.searchsorted(self.low, n, side="right")) - 1

    def blocks(self, c: int) -> tuple[int, int]:
        """Number of blocks, and how many may be empty, where the smaller set is in class c."""
        self.of((self.low[c] if c < len(self.low) else 1) * 4 + 8)
        small = self.low[c + 1] - 1
        both = small + min(self.low[c + 2] - 1, small * 100 // self.percent)
        differ = both * (100 - self.percent) // (100 + self.percent)
        z = differ // 6
        return (differ + 1 + z, z) if differ else (0, 0)


def node_of(digest: bytes) -> int:
    """64 bits of a class's digest: enough to bring sets together, for all are compared in full."""
    return int.from_bytes(digest[:8], "little", signed=True)


def signatures(sets: list[np.ndarray], classes: Classes, usual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of non-empty sets as signed 64-bit numbers, and the set of each; usual: sorted hashes of frequent shingles."""
    if not sets:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    s, size = np.concatenate(sets), np.array([len(x) for x in sets])
    salted = mix(s + _C)
    rare = usual[np.minimum(np.searchsorted(usual, s), len(usual) - 1)] != s if len(usual) else np.ones(len(s), bool)
    of, high = np.repeat(np.arange(len(sets)), size), s >> np.uint64(32)
    own = np.array([classes.of(n) for n in size.tolist()])
    sigs, sets_of = [], []
    for below in (0, 1):
        c = own - below  # with the sets of the same class, and with those of the class below
        shape = [classes.blocks(k) if k >= 0 else (0, 0) for k in c.tolist()]
        m, z = np.array([x for x, _ in shape]), np.array([x for _, x in shape])
        first = np.cumsum(m) - m
        some = np.flatnonzero(m[of] > 0)
        at = first[of[some]] + (high[some] % m[of[some]].astype(np.uint64)).astype(np.int64)
        total = np.zeros(int(m.sum()), np.uint64)
        np.add.at(total, at, salted[some])
        telling = np.bincount(at[rare[some]], minlength=len(total)) > 0
        block_of = np.repeat(np.arange(len(sets)), m)
        block = np.arange(len(total)) - first[block_of]
        sig = mix(total + mix(block.astype(np.uint64) * _A + c[block_of].astype(np.uint64) * _B))
        dull = m - np.bincount(block_of[telling], minlength=len(sets))
        kept = telling | (dull > z)[block_of]
        sigs.append(sig[kept])
        sets_of.append(block_of[kept])
    return np.concatenate(sigs).view(np.int64), np.concatenate(sets_of)


def combined(sig: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same meetings in fewer rows: of each signature its first node, and for every other node that has it
    a signature that the two alone have, once for all their common ones.  It does not serve candidates(), as pairs
    that do not meet directly hang together by the first node alone."""
    order = np.argsort(sig, kind="stable")
    sig, node = sig[order], node[order]
    new = np.ones(len(sig), bool)
    new[1:] = sig[1:] != sig[:-1]
    first = node[new][np.cumsum(new) - 1]
    apart = ~new & (first != node)
    a, b = np.minimum(first[apart], node[apart]).view(np.uint64), np.maximum(first[apart], node[apart]).view(np.uint64)
    own = mix(mix(a + _C) + b)
    _, at = np.unique(own, return_index=True)
    own, a, b = own[at].view(np.int64), a[at].view(np.int64), b[at].view(np.int64)
    return np.concatenate((sig[new], own, own)), np.concatenate((node[new], a, b))


def sketch(s: np.ndarray) -> bytes:
    """The parity of a set's shingles in each of a power of two of bins, twice as many as shingles at least."""
    bits = max(BITS, 1 << (2 * len(s) - 1).bit_length())
    odd = np.bincount((mix(s + _B) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of the bins of the shortest one: the parity of two bins together is that of their sum."""
    size = min(map(len, sketches)) // 8
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, size), axis=0) for x in sketches])


def may_link(differ: np.ndarray, n: np.ndarray, k: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of n and k shingles may link that differ in so many at least."""
    return np.maximum(differ, np.abs(n - k)) * (100 + percent) <= (n + k) * (100 - percent)


def near(sketches: list[bytes], n: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A forest of the pairs of sets (n: their sizes) that may link, by their sketches."""
    x, left, found, out = folded(sketches), np.arange(len(n)), [], []
    while len(left):
        if found:
            a = found.pop()
        else:
            a, left = int(left[0]), left[1:]
        good = may_link(np.bitwise_count(x[left] ^ x[a]).sum(axis=1, dtype=np.int64), n[left], n[a], percent)
        found += left[good].tolist()
        out += [(a, b) for b in left[good].tolist()]
        left = left[~good]
    return out


class Frequent:
    """Sorted hashes of frequent shingles and their counts over all texts: with the hash, the global order."""

    def __init__(self, shingles: np.ndarray, counts: np.ndarray) -> None:
        order = np.argsort(shingles)
        self.shingles, self.counts = shingles[order], counts[order]

    def of(self, s: np.ndarray) -> np.ndarray:
        """Counts of shingles, 0 for those that are not in the table."""
        if not len(self.shingles):
            return np.zeros(len(s), np.int64)
        at = np.minimum(np.searchsorted(self.shingles, s), len(self.shingles) - 1)
        return np.where(self.shingles[at] == s, self.counts[at], 0)


class Forest:
    """Union-find over the sets of a task, with labels for comparisons at large."""

    def __init__(self, n: int) -> None:
        self.label, self.links = np.arange(n), []

    def join(self, a: int, others: np.ndarray) -> None:
        for b in others.tolist():
            if self.label[b] != self.label[a]:
                self.label[self.label == self.label[b]] = self.label[a]
                self.links.append((a, b))


class Trie:
    """Sets in lexicographic order under one global order of shingles, as a path-compressed trie.

    A node has a run of shingles (flat[begin:end]), the range [lo, hi) of the sets beneath it, the
    depth at which it ends, and the least and greatest size of those sets.  Long runs are cut into
    nodes of ``run`` shingles, so that a walk can leave them half-way.
    """

    def __init__(self, sets: list[np.ndarray], often: Frequent | None = None, run: int = 32) -> None:
        flat = np.concatenate(sets)
        kinds, rank = np.unique(flat, return_inverse=True)
        place = np.arange(len(kinds))
        if often is not None:
            place[np.argsort(often.of(kinds), kind="stable")] = np.arange(len(kinds))  # rare ones first
        ranks = place[rank]
        self.kinds, size = len(kinds), np.array([len(s) for s in sets])
        stop = np.cumsum(size)
        runs = [np.sort(ranks[b - k : b]) for b, k in zip(stop.tolist(), size.tolist(), strict=True)]
        self.order = sorted(range(len(sets)), key=lambda i: runs[i].astype(">u4").tobytes())
        self.sets = [runs[i] for i in self.order]
        self.size = size[self.order]
        shared = [0]
        for a, b in zip(self.sets, self.sets[1:], strict=False):
            k = min(len(a), len(b))
            off = np.flatnonzero(a[:k] != b[:k])
            shared.append(int(off[0]) if len(off) else k)
        self._build(shared, run)

    def _build(self, shared: list[int], run: int) -> None:
        """Nodes by a stack over the common beginnings of neighbours."""
        parent, begin, end, depth, lo, hi = [], [], [], [], [], []
        at, flat = 0, []
        open_: list[tuple[int, int, int]] = []  # depth of its begin, first set, depth of its end
        spans = []
        for i, s in enumerate([*self.sets, None]):
            keep = shared[i] if s is not None else 0
            first = i
            while open_ and open_[-1][2] > keep:
                top, since, bottom = open_.pop()
                spans.append((max(top, keep), bottom, since, i))
                first = since
                if top < keep:
                    open_.append((top, since, keep))
            if s is not None and keep < len(s):
                open_.append((keep, i, len(s)))
        spans.sort(key=lambda x: (x[2], x[0]))
        stack: list[int] = []
        for top, bottom, since, till in spans:
            for a in range(top, bottom, run):
                b = min(a + run, bottom)
                while stack and not (lo[stack[-1]] <= since and till <= hi[stack[-1]] and depth[stack[-1]] <= a):
                    stack.pop()
                parent.append(stack[-1] if stack else -1)
                flat.append(self.sets[since][a:b])
                begin.append(at)
                at += b - a
                end.append(at)
                depth.append(b)
                lo.append(since)
                hi.append(till)
                stack.append(len(parent) - 1)
        self.flat = np.concatenate(flat)
        self.begin, self.end, self.depth, self.lo, self.hi = (np.array(x) for x in (begin, end, depth, lo, hi))
        up = np.array(parent)
        by = np.argsort(up, kind="stable")
        self.child = by
        self.child_at = np.searchsorted(up[by], np.arange(-1, len(up) + 1))
        self.least = np.array([self.size[a:b].min() for a, b in zip(lo, hi, strict=True)])
        self.most = np.array([self.size[a:b].max() for a, b in zip(lo, hi, strict=True)])
        #: Last nodes of sets: a set ends where its size is the node's depth.
        self.last = np.flatnonzero(self.least == self.depth)

    def children(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Children of nodes, and at which of them each hangs (-1: the root)."""
        a, b = self.child_at[nodes + 1], self.child_at[nodes + 2]
        n = b - a
        of = np.repeat(np.arange(len(nodes)), n)
        return self.child[np.repeat(a - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))], of

    def walk(self, x: int, percent: int, forest: Forest, given: np.ndarray | None = None) -> np.ndarray:
        """The sets after x (in order), or with given the sets that it marks, that link with x and are not known to be connected with it."""
        mine = np.zeros(self.kinds + 1, np.int64)
        mine[self.sets[x] + 1] = 1
        upto = np.cumsum(mine)  # upto[r]: x's shingles below r
        n = len(self.sets[x])
        apart = forest.label != forest.label[x]
        other = np.concatenate(([0], np.cumsum(apart if given is None else apart & given)))
        first = x + 1 if given is None else 0
        hits = []
        nodes, overlap = np.array([-1]), np.array([0])
        while len(nodes):
            kids, of = self.children(nodes)
            worth = (self.hi[kids] > first) & (other[self.hi[kids]] - other[np.maximum(self.lo[kids], first)] > 0)
            kids, base = kids[worth], overlap[of[worth]]
            if not len(kids):
                break
            size = self.end[kids] - self.begin[kids]
            start = np.concatenate(([0], np.cumsum(size)[:-1]))
            tokens = self.flat[np.repeat(self.begin[kids] - start, size) + np.arange(int(size.sum()))]
            got = base + np.add.reduceat(mine[tokens + 1], start)
            rest_x = n - upto[self.flat[self.end[kids] - 1] + 1]
            # overlap o of sizes n and k: 100 o >= percent (n + k - o); least k has the least bound
            least = np.maximum(self.least[kids], self.depth[kids])
            bound = -(-percent * (n + least) // (100 + percent))
            good = got + np.minimum(rest_x, self.most[kids] - self.depth[kids]) >= bound
            kids, got = kids[good], got[good]
            done = self.least[kids] == self.depth[kids]
            for k, o in zip(kids[done].tolist(), got[done].tolist(), strict=True):
                if 100 * o >= percent * (n + self.depth[k] - o):
                    hits.append(self.lo[k])  # equal sets do not occur: it is the first of its range
            nodes, overlap = kids, got
        return np.array([h for h in hits if h >= first and (given is None or given[h])], np.int64)


def links(sets: list[np.ndarray], percent: int, often: Frequent | None = None, label: list | None = None, asks: list[bool] | None = None) -> list[tuple[int, int]]:
    """A forest of the links among different sets (sorted arrays), or with asks of those between sets that ask
    and sets that do not; sets of equal label are known to be connected."""
    if len(sets) < 2:
        return []
    trie = Trie(sets, often)
    forest = Forest(len(sets))
    if label is not None:
        forest.label = np.unique([label[k] for k in trie.order], return_inverse=True)[1]
    asking = None if asks is None else np.array([asks[k] for k in trie.order], bool)
    for x in range(len(sets)) if asking is None else np.flatnonzero(asking).tolist():
        forest.join(x, trie.walk(x, percent, forest, None if asking is None else ~asking))
    return [(trie.order[a], trie.order[b]) for a, b in forest.links]


def shingled(docs: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """Of one pass over the texts, stored: doc_id, n_shingles, class, node (64 bits of the class; both null: the
    empty set), sketch (null where the task has just given that of the class) and _KEY (128 bits of the text);
    and token and n of shingles that repeat, each different set of a task counted once among COUNTED shingles."""
    d = pick(docs, "doc_id", "text").select("doc_id", "text", F.xxhash64("text").alias(_KEY[0]), F.xxhash64(F.lit("text"), "text").alias(_KEY[1]))
    kind = d.schema["doc_id"].dataType.simpleString()
    small_batches(d.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, np.ndarray] = {}
        many = 0

        def repeated() -> pa.RecordBatch:
            tokens, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *held.values()]), return_counts=True)
            often = n >= REPEATED
            tokens, n = pa.array(tokens[often].view(np.int64)), pa.array(n[often].astype(np.int64))
            none = [pa.nulls(len(n), t) for t in types]
            return pa.RecordBatch.from_arrays([*none, tokens, n], names=names)

        names, types = ["doc_id", *_KEY, "n_shingles", "class", "node", "sketch", "token", "n"], None
        for batch in batches:
            types = [batch.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary()]
            for part in slices(batch, 0, SLICE):
                sets = shingle_sets(part.column("text").cast(pa.binary()).to_pylist(), width)
                digests = [digest_of(s) if len(s) else None for s in sets]
                nodes = [None if c is None else node_of(c) for c in digests]
                columns = [*(part.column(c) for c in ("doc_id", *_KEY)), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(nodes, pa.int64())]
                none = pa.nulls(len(sets), pa.int64())
                given, full = [], []
                for c, s in zip(digests, sets, strict=True):
                    new = c is not None and c not in held
                    given.append(sketch(s) if new else None)
                    if new:
                        held[c] = s
                        many += len(s)
                        if many > COUNTED:
                            full.append(repeated())
                            held, many = {}, 0
                yield pa.RecordBatch.from_arrays([*columns, pa.array(given, pa.binary()), none, none], names=names)
                yield from full
        if held:
            yield repeated()
        held.clear()
        release()

    both = stored(d.mapInArrow(run, f"doc_id {kind}, {_KEY[0]} bigint, {_KEY[1]} bigint, n_shingles bigint, class binary, node bigint, sketch binary, token bigint, n bigint"), "shingled")
    return both.where("token IS NULL").drop("token", "n"), both.where("token IS NOT NULL").select("token", "n")


def frequent(counts: DataFrame, known: int = KNOWN) -> Frequent:
    """The most frequent shingles, at most known; counts: token and n.

    Spark adds the tasks' counts up; the driver gets how many shingles have each count, then those over
    the count at which the table is full.
    """
    counts = cut(counts.groupBy("token").agg(F.sum("n").alias("n")))
    capped = F.least("n", F.lit(10_000))
    least, total = 10_001, 0
    for r in counts.groupBy(capped.alias("c")).agg(F.count("*").alias("k")).orderBy(F.desc("c")).collect():
        total += r["k"]
        if total > known:
            break
        least = r["c"]
    found = counts.where(F.col("n") >= least).select("token", "n").toArrow()
    return Frequent(found.column(0).to_numpy().view(np.uint64), found.column(1).to_numpy())


def signed(docs: DataFrame, shared, width: int, percent: int) -> DataFrame:
    """sig and node of all classes; a class that a task has just seen is not repeated."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, seen, usual = Classes(percent), OrderedDict(), shared.value.shingles
        for batch in batches:
            for part in slices(batch, 0, SLICE):
                sets, nodes = [], []
                for s in shingle_sets(part.column("text").cast(pa.binary()).to_pylist(), width):
                    if not len(s):
                        continue
                    node = node_of(digest_of(s))
                    if node in seen:
                        seen.move_to_end(node)
                        continue
                    seen[node] = True
                    if len(seen) > 20_000:
                        seen.popitem(last=False)
                    sets.append(s)
                    nodes.append(node)
                sig, of = signatures(sets, classes, usual)
                yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(np.array(nodes, np.int64)[of])], names=["sig", "node"])
        release()

    return pick(docs, "text").mapInArrow(run, "sig bigint, node bigint")


def candidates(meetings: DataFrame, classed: DataFrame, percent: int) -> DataFrame:
    """u and v: pairs of classes by which all that link hang together; meetings: sig and node.

    Of the classes of a signature all pairs are looked at (of more than MANY a star is given as it is), so
    that nothing hangs on a third set's being like both; a pair goes on if its sketches allow a link.
    """
    by_sig = Window.partitionBy("sig")
    several = meetings.withColumns({"lo": F.min("node").over(by_sig), "hi": F.max("node").over(by_sig)}).where("lo <> hi")
    met = stored(several.groupBy("sig").agg(F.sort_array(F.collect_set("node")).alias("nodes")), "meetings")
    n = F.size("nodes")
    pairs = F.expr("explode(flatten(transform(sequence(0, size(nodes) - 2), i -> transform(slice(nodes, i + 2, size(nodes)), w -> struct(nodes[i] AS u, w AS v)))))")
    few = met.where(n <= FEW).select(pairs.alias("p")).select("p.*").distinct()
    # signatures with the same classes tell the same
    some = met.where((n > FEW) & (n <= MANY)).dropDuplicates(["nodes"]).select("sig", F.explode("nodes").alias("node"))
    star = met.where(n > MANY).select(F.col("nodes")[0].alias("u"), F.explode("nodes").alias("v")).where("u <> v")
    told = met.where(n <= MANY).select(F.explode("nodes").alias("node")).distinct()
    told = cut(classed.where("sketch IS NOT NULL").select("node", F.col("n_shingles").alias("n"), "sketch").join(told, "node", "left_semi").dropDuplicates(["node"]))
    side = lambda x: told.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))
    small_batches(meetings.sparkSession)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketches = zip(batch.column("sketch_u").to_pylist(), batch.column("sketch_v").to_pylist(), strict=True)
            differ = np.array([int(np.bitwise_count(np.bitwise_xor(*folded([a, b]))).sum()) for a, b in sketches], np.int64)
            good = may_link(differ, batch.column("n_u").to_numpy(), batch.column("n_v").to_numpy(), percent)
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(good))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                of = batch.column("of")[row].values
                node = of.field("node").to_numpy()
                found = near(of.field("sketch").to_pylist(), of.field("n").to_numpy(), percent)
                a, b = np.array(found, np.int64).reshape(-1, 2).T
                yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["u", "v"])

    few = few.join(side("u"), "u").join(side("v"), "v").mapInArrow(compare, "u bigint, v bigint")
    some = some.join(told, "node").groupBy("sig").agg(F.collect_list(F.struct("node", "n", "sketch")).alias("of")).select("of").mapInArrow(gather, "u bigint, v bigint")
    return few.union(some).union(star)



def keyed(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns, _KEY, __id and __none (the id, never null, and whether it is)."""
    return pick(docs, *names).select(*names, F.xxhash64("text").alias(_KEY[0]), F.xxhash64(F.lit("text"), "text").alias(_KEY[1]), *_ids())


def _ids() -> list:
    return [F.coalesce("doc_id", F.lit(0)).alias("__id"), F.col("doc_id").isNull().alias("__none")]


def jaccard_links(docs: DataFrame, classed: DataFrame, often: Frequent, width: int = WIDTH, percent: int = PERCENT, most: int = MOST) -> DataFrame:
    """u, v: a forest of links between classes; classed and often: of shingled(docs)."""
    shared = docs.sparkSession.sparkContext.broadcast(often)  # at most known shingles
    pairs = candidates(signed(docs, shared, width, percent), classed, percent)
    groups = cut(components(pairs).select("node", F.col("component").alias("group")))
    one = classed.where("class IS NOT NULL").groupBy("class", "node").agg(F.min(F.struct("doc_id", *_KEY)).alias("d"), F.first("n_shingles").alias("n"))
    grouped = groups.join(one, "node")
    parts = grouped.groupBy("group").agg(F.ceil(F.sum("n") / most).cast("int").alias("n_parts"), F.min("class").alias("leader"))
    member = grouped.join(parts, "group").select("class", "group", "n_parts", (F.col("class") == F.col("leader")).alias("leads"), "d.*")
    on = ["__id", "__none", *_KEY]
    texts = keyed(docs, "doc_id", "text").drop("doc_id").join(member.select("class", "group", "n_parts", "leads", *_ids(), *_KEY), on)
    texts = texts.select("class", "group", "n_parts", "leads", "text").dropDuplicates(["class"])  # of repeated rows, one

    def make_sets(batch: pa.RecordBatch) -> dict:
        sets = shingle_sets(batch.column("text").cast(pa.binary()).to_pylist(), width)
        return {n: batch.column(n) for n in ("class", "group", "n_parts", "leads")} | {"shingles": [s.tobytes() for s in sets]}

    sets = in_slices(texts, "class binary, group bigint, n_parts int, leads boolean, shingles binary", make_sets, most=SLICE)
    sets = stored(sets.withColumn("part", F.pmod(F.xxhash64("class"), F.col("n_parts")).cast("int")), "sets")

    def match(table: pa.Table) -> pa.Table:
        rows = zip(*(table.column(c).to_pylist() for c in ("class", "shingles", "label", "asks")), strict=True)
        by = {c: (s, label, asks) for c, s, label, asks in rows}
        names = sorted(by)
        label = [by[n][1] or n for n in names]
        asks = [by[n][2] for n in names]
        found = links([np.frombuffer(by[n][0], np.uint64) for n in names], percent, shared.value, label, None if None in asks else asks)
        return pa.table({"u": pa.array([names[a] for a, _ in found], pa.binary()), "v": pa.array([names[b] for _, b in found], pa.binary())})

    def met(dealt: DataFrame) -> DataFrame:
        return dealt.groupBy("task").applyInArrow(match, "u binary, v binary")

    none = [F.lit(None).cast("binary").alias("label"), F.lit(None).cast("boolean").alias("asks")]
    # every part with its group's leader, which each of them has once
    with_leader = F.when(F.col("leads"), F.sequence(F.lit(0), F.col("n_parts") - 1)).otherwise(F.array("part"))
    first = met(sets.select(F.explode(with_leader).alias("with"), "*").select(F.struct("group", "with").alias("task"), "class", "shingles", *none))
    if not (large := sets.where("n_parts > 1")).head(1):
        return first
    # of large groups, the sets that are not connected with their leader yet: with those that are, and among each other
    first = cut(first)
    known = components(first).withColumnRenamed("node", "class").withColumnRenamed("component", "label")
    marked = large.join(known, "class", "left").withColumn("label", F.coalesce("label", "class"))
    leader = marked.where("leads").select("group", F.col("label").alias("lead"))
    marked = cut(marked.join(leader, "group").withColumn("apart", F.col("label") != F.col("lead")))
    parts_of = lambda x: F.ceil(F.sum(F.when(x, F.length("shingles"))) / F.lit(8 * most)).cast("int")
    sizes = marked.groupBy("group").agg(parts_of(F.col("apart")).alias("n_rest"), parts_of(~F.col("apart")).alias("n_near")).where("n_rest > 0")
    # the parts that have met inside go together, so that only different ones need to meet
    m = marked.join(sizes, "group").withColumn("rest", F.floor(F.col("part") * F.least("n_rest", "n_parts") / F.col("n_parts")).cast("int")).withColumn("n_rest", F.least("n_rest", "n_parts"))
    m = m.withColumn("near", F.pmod(F.xxhash64("class", F.lit(1)), F.col("n_near")).cast("int"))
    rest, near = m.where("apart"), m.where("NOT apart")
    columns = ["class", "shingles", "label"]

    def at(kind: str, a: Column, b: Column) -> Column:
        return F.struct("group", F.lit(kind).alias("kind"), a.alias("a"), b.alias("b")).alias("task")

    others = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("o")
    o = F.col("o")
    asked = rest.select(others("n_near"), "*").select(at("near", F.col("rest"), o), *columns, F.lit(True).alias("asks"))
    given = near.select(others("n_rest"), "*").select(at("near", o, F.col("near")), *columns, F.lit(False).alias("asks"))
    pairs = rest.select(others("n_rest"), "*").where((o != F.col("rest")) | (F.col("n_rest") < F.col("n_parts")))
    among = pairs.select(at("rest", F.least("rest", o), F.greatest("rest", o)), *columns, F.when(o != F.col("rest"), F.col("rest") < o).alias("asks"))
    return first.union(met(asked.union(given).union(among)))


def ngram_jaccard(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, most: int = MOST) -> DataFrame:
    """doc_id, n_shingles, component_id, class (null: empty), component (a class) and _KEY."""
    classed, counts = shingled(docs, width)
    linked = components(jaccard_links(docs, classed, frequent(counts), width, percent, most)).withColumnRenamed("node", "class")
    one = classed.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("least"))
    whole = one.join(linked, "class", "left").withColumn("component", F.coalesce("component", "class"))
    least = whole.groupBy("component").agg(F.min("least").alias("component_id"))
    named = whole.join(least, "component").select("class", "component", "component_id")
    out = classed.join(named, "class", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "class", "component", *_KEY)


def one_of_each(docs: DataFrame, keep: tuple[str, ...], width: int = WIDTH, percent: int = PERCENT, most: int = MOST) -> DataFrame:
    """The columns of keep (doc_id and text among them) of one document of each group of linked ones.

    It is the one with the component's least doc_id; of its repeated rows, one.  Documents with the
    empty set are linked with nothing and all stay.
    """
    d = keyed(docs, *keep)
    blank = F.coalesce(F.btrim("text", F.lit(WHITE)), F.lit("")) == ""
    rows = ngram_jaccard(docs, width, percent, most).where("class IS NOT NULL AND doc_id <=> component_id")
    # a repeated id, or none, may come with several texts of a component: the least class and text stay
    least = F.min(F.struct("class", *_KEY)).alias("s")
    chosen = rows.groupBy("component").agg(least, F.first("doc_id").alias("doc_id")).select(*_ids(), *(f"s.{c}" for c in _KEY))
    on = ["__id", "__none", *_KEY]
    kept = d.where(~blank).join(chosen, on).dropDuplicates(on).select(*keep)
    return kept.unionByName(d.where(blank).select(*keep))
