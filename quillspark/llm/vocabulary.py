"""A public SentencePiece vocabulary as arrays, and walks of its trie for many words at once."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

SPACE = "▁"
#: Characters that have a column in the trie's table; the others are looked up by node and character.
ALPHABET = 112
#: Words of up to so many characters are walked together, longer ones alone.
LONG = 64
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


class Vocabulary:
    """Pieces with ids; log probabilities by rank, for the file holds the order of merges alone.

    Zipf-Mandelbrot: p(rank) is in proportion to 1 / (rank + 2.7).  Scores are whole numbers, logs times
    2 ** 16, so that sums do not depend on their order.  A character without piece costs the least score
    less 10 and is spelt in bytes.  A space is the piece character for it; that character itself, in a
    text, has no piece.  No piece has a space after another character, so each beginning of a run of
    spaces is a cut in every segmentation.

    The trie: node 0 is the root, ``to[node, code]`` the next node (0: none) for the usual characters,
    the sorted ``keys`` (node and code point) have the others; ``piece[node]`` is an id or -1.
    """

    def __init__(self, path: str = PIECES) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
        spelt = [b""] * n
        ids = {sp.id_to_piece(i): i for i in plain}
        if any(SPACE in p.lstrip(SPACE) for p in ids):
            raise ValueError("a piece holds a space after another character: words are no cuts")
        self.size, self.byte = n, np.zeros(256, np.int32)
        for i in range(n):
            if sp.is_byte(i):
                self.byte[int(sp.id_to_piece(i)[1:-1], 16)] = i
        for b, i in enumerate(self.byte.tolist()):
            spelt[i] = bytes([b])
        total = math.log(sum(1 / (r + 2.7) for r in range(len(plain))))
        logs = [-math.log(r + 2.7) - total for r in range(len(plain))]
        self.length, self.score = np.ones(n + 1, np.int64), np.zeros(n + 1, np.int64)
        self.score[plain] = [round(x * 65536) for x in logs]
        self.score[-1] = self.unknown = round((min(logs) - 10) * 65536)
        for p, i in ids.items():
            self.length[i] = len(p)
            spelt[i] = p.replace(SPACE, " ").encode()
        self.spelt = pa.array(spelt, pa.binary())
        self.longest = max(map(len, ids))
        self.ids = {p.replace(SPACE, " "): i for p, i in ids.items()}
        self._trie()

    def _trie(self) -> None:
        usual = [ch for ch, _ in Counter(ch for p in self.ids for ch in p).most_common(ALPHABET - 1)]
        self.code = np.zeros(0x110000, np.uint8)
        for k, ch in enumerate(usual):
            self.code[ord(ch)] = k + 1
        nodes: dict[str, int] = {"": 0}
        for p in sorted(self.ids, key=lambda p: (len(p), p)):
            for k in range(1, len(p) + 1):
                nodes.setdefault(p[:k], len(nodes))
        inner = sorted({p[:-1] for p in nodes if p}, key=nodes.__getitem__)
        order = {p: k for k, p in enumerate(inner)}  # nodes with children come first, the others have no row
        for p in nodes:
            order.setdefault(p, len(order))
        self.to = np.zeros((len(inner), ALPHABET), np.int32)
        self.piece = np.full(len(order), -1, np.int32)
        keys = []
        for p, k in order.items():
            self.piece[k] = self.ids.get(p, -1)
            if p and (c := self.code[ord(p[-1])]):
                self.to[order[p[:-1]], c] = k
            elif p:
                keys.append((order[p[:-1]] << 21 | ord(p[-1]), k))
        self.keys = np.array([a for a, _ in sorted(keys)], np.int64)
        self.ends = np.array([k for _, k in sorted(keys)], np.int32)

    def edges(self, s: str, at: int, stop: int | None = None) -> list[tuple[int, int]]:
        """(end, id) of the pieces that begin at a place of s; a character without piece has id -1."""
        ids = self.ids
        top = min(len(s) if stop is None else stop, at + self.longest)
        out = [(end, i) for end in range(at + 1, top + 1) if (i := ids.get(s[at:end])) is not None]
        return out if out and out[0][0] == at + 1 else [(at + 1, -1), *out]

    def steps(self, points: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """begin, length, words and pieces (-1: none) of all edges of words, by begin.

        points: code points, a row a word, zeros after its end.  All words take each step together.
        """
        codes, to, inner = self.code[points], self.to, len(self.to)
        rare = (codes == 0) & (points > 0)
        has_rare = rare.any(axis=0)
        for at in range(int(size.max(initial=0))):
            word = np.flatnonzero(size > at)
            node = np.zeros(len(word), np.int32)
            for end in range(at, points.shape[1]):
                after = to[node, codes[word, end]]
                if has_rare[end]:
                    odd = np.flatnonzero(rare[word, end])
                    key = node[odd].astype(np.int64) << 21 | points[word[odd], end]
                    k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                    after[odd] = np.where(self.keys[k] == key, self.ends[k], 0) if len(self.keys) else 0
                piece = self.piece[after]
                found = (after > 0) & (piece >= 0)
                if end == at and not found.all():
                    lost = word[~found]
                    yield at, 1, lost, np.full(len(lost), -1, np.int32)
                if found.any():
                    yield at, end - at + 1, word[found], piece[found]
                more = (after > 0) & (after < inner)
                word, node = word[more], after[more]
                if not len(word):
                    break


def matrix_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words, a row each with zeros after its end and a column of zeros at last, and their sizes."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    points = np.zeros((len(words), int(size.max(initial=0)) + 1), np.int32)
    points[np.arange(points.shape[1]) < size[:, None]] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.int32)
    return points, size


def by_size(words: list[str], rows: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places, code points and sizes of words of up to LONG characters, alike in size together."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(size, kind="stable")
    order = order[: np.searchsorted(size[order], LONG, side="right")]
    for a in range(0, len(order), rows):
        part = order[a : a + rows]
        yield part, *matrix_of([words[k] for k in part.tolist()])


def words_of(texts: list[bytes], cuts_at_runs: bool) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of texts, each with the spaces before it, as a dictionary, and their number by text.

    A word begins at a space after another character (cuts_at_runs), else at each space that another
    character follows, one space being taken with it; every text counts as if a space were before it.
    """
    flat = b"".join([b" " + t for t in texts])
    data = np.frombuffer(flat, np.uint8)
    blank = data == 32
    first = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=first[1:])
    if cuts_at_runs:
        begin = blank.copy()
        begin[1:] &= ~blank[:-1]
        begin[first[:-1]] = True
        at = np.flatnonzero(begin)
        ends = np.append(at[1:], len(data))
    else:
        begin = blank[:-1] & ~blank[1:] if len(blank) else blank
        at = np.flatnonzero(begin)
        space = np.flatnonzero(np.append(blank, True))
        ends = space[np.searchsorted(space, at, side="right")] if len(at) else at
        data, ends, at = _gathered(data, at, ends)
    offsets = np.append(at, ends[-1] if len(ends) else 0).astype(np.int32)
    found = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data))
    places = np.flatnonzero(begin)
    return found.dictionary_encode(), np.diff(np.searchsorted(places, first))


def _gathered(data: np.ndarray, at: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ranges [at, ends) of data put one after the other."""
    n = ends - at
    begin = np.cumsum(n) - n
    take = np.repeat(at - begin, n) + np.arange(int(n.sum()))
    return data[take], begin + n, begin


@cache
def vocabulary(path: str = PIECES) -> Vocabulary:
    return Vocabulary(path)
