"""Language ID by segmentation-marginalised unigrams.

Each language has probabilities for the pieces of a fixed public vocabulary.  A text's likelihood in
a language is the sum over all its segmentations, by the forward algorithm; pieces do not run over
spaces, so it is the product of its words' sums.  The prediction is the likeliest language, the score
its posterior under equal priors.

Piece probabilities are learnt from labelled texts (a bounded sample, see fit_documents) by expected
counts: under the last round's probabilities (at first, the vocabulary's own), forward and backward
sums give each piece's expected number in each word over all its segmentations.  Words are counted by
language once; each task returns sums (at most vocabulary x languages), Spark adds them up, and each
language's are smoothed towards those of all languages together.  A character without piece costs
every language the same.

Texts are read whole and cut into words at ASCII white space.  Null texts and texts without letter are
``und`` with score 0.  Equal scores go to the first language by name.  Texts without label teach
nothing; if nothing is labelled, every text is ``und``.  Each row gives one row, repeated rows
included; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, in_slices, pick, release, small_batches
from .vocabulary import LONG, PIECES, Vocabulary, by_size, vocabulary, words_of

UND = "und"
#: Pseudo-counts of a language's prior, spread as all languages' pieces are.
PRIOR = 500.0
#: Probability of a character without piece.
UNSEEN = 1e-8
#: Rounds of expected counts.
ROUNDS = 2
#: Documents to learn from: of a language, and in all.
EACH, MOST = 5_000, 20_000
#: Languages at most: labels beyond these, the rarest ones, are not learnt.
LANGUAGES = 1_000
#: Each character counts as so much within sums, so that words of up to LONG characters neither overflow nor vanish.
SCALE = 1e4
SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r\x00", b"      ")


def split(texts: list[str]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of texts, a space before each, as a dictionary, and their number by text."""
    return words_of([t.encode().translate(SPACES) for t in texts], False)


def weights(v: Vocabulary, p: np.ndarray) -> np.ndarray:
    """p (pieces, languages) with a last row for characters without piece, scaled by length."""
    whole = np.concatenate((p, np.full((1, p.shape[1]), UNSEEN)))
    return whole * SCALE ** v.length[:, None].astype(float)


def long_word(v: Vocabulary, p: np.ndarray, word: str) -> np.ndarray:
    """log of the sum over all segmentations of one word of any length, by language."""
    n, m = len(word), v.longest + 1
    ring, logs = np.zeros((m, p.shape[1])), np.zeros(p.shape[1])
    ring[0] = 1.0
    for at in range(n):
        base = ring[at % m].copy()
        ring[at % m] = 0.0
        for end, i in v.edges(word, at):
            ring[end % m] += base * (p[i] if i >= 0 else UNSEEN)
        if at % 8 == 7:
            most = ring.max(axis=0)
            most[most <= 0] = 1.0
            ring /= most
            logs += np.log(most)
    return np.log(ring[n % m]) + logs


def word_scores(v: Vocabulary, p: np.ndarray, words: list[str]) -> np.ndarray:
    """log of the sum over all segmentations of each word, by language: the forward algorithm over many
    words at once, place by place."""
    w, out = weights(v, p), np.zeros((len(words), p.shape[1]))
    for place, points, size in by_size(words):
        n, width = points.shape
        sums = np.zeros((n * width, p.shape[1]))  # a row a place, word after word
        sums[::width] = 1.0
        for at, k, word, ids in v.steps(points, size):
            row = word * width + at
            sums[row + k] += sums.take(row, axis=0) * w.take(ids, axis=0, mode="wrap")
        out[place] = np.log(sums[np.arange(n) * width + size]) - (size * np.log(SCALE))[:, None]
    for k in [k for k, x in enumerate(words) if len(x) > LONG]:
        out[k] = long_word(v, p, words[k])
    return out


def expected_counts(v: Vocabulary, p: np.ndarray, lang: np.ndarray, words: list[str], times: np.ndarray) -> np.ndarray:
    """Expected numbers of pieces (pieces, languages) in words of up to LONG characters, each in its language and counted times."""
    langs = p.shape[1]
    w, out = weights(v, p).ravel(), np.zeros((v.size + 1) * langs)
    for place, points, size in by_size(words):
        n, width = points.shape
        fore, back = np.zeros(n * width), np.zeros(n * width)
        fore[::width] = 1.0
        back[np.arange(n) * width + size] = 1.0
        steps = []
        for at, k, word, ids in v.steps(points, size):
            row, cell = word * width + at, np.where(ids < 0, v.size, ids) * langs + lang[place].take(word)
            weight = w.take(cell)
            fore[row + k] += fore.take(row) * weight
            steps.append((row, k, cell, weight))
        for row, k, _, weight in reversed(steps):
            back[row] += back.take(row + k) * weight
        share = np.repeat(times[place] / back[::width], width)
        cells = np.concatenate([c for _, _, c, _ in steps])
        values = np.concatenate([fore.take(row) * weight * back.take(row + k) * share.take(row) for row, k, _, weight in steps])
        out += np.bincount(cells, values, len(out))
    return out.reshape(-1, langs)[:-1]


class Model:
    """Piece probabilities by language: languages, and a (pieces, languages) array."""

    def __init__(self, langs: list[str], p: np.ndarray) -> None:
        self.langs, self.p = langs, p


def word_counts(labelled: DataFrame) -> DataFrame:
    """lang, word and n of labelled texts (lang, text); longer words than LONG characters teach nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = batch.column(0), batch.column(1)
            for lang in pc.unique(langs).to_pylist():
                words, _ = split(texts.filter(pc.equal(langs, lang)).to_pylist())
                n = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
                short = pa.array(pc.utf8_length(words.dictionary).to_numpy() <= LONG)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()).filter(short), words.dictionary.filter(short), pa.array(n.astype(np.int64)).filter(short)], names=["lang", "word", "n"])
        release()

    small_batches(labelled.sparkSession)
    labelled = pick(labelled, "lang", "text").where("lang IS NOT NULL AND text IS NOT NULL")
    return labelled.mapInArrow(run, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, path: str = PIECES, prior: float = PRIOR, rounds: int = ROUNDS) -> Model:
    """Learns from lang and text alone."""
    counted = cut(word_counts(labelled))
    langs = [r.lang for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()]
    langs.sort()
    v = vocabulary(path)
    p = np.repeat(np.exp(v.score[:-1, None] / 65536), len(langs), axis=1)
    for _ in range(rounds if langs else 0):
        shared = counted.sparkSession.sparkContext.broadcast((langs, p.astype(np.float32)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known, p = shared.value
            at, total = {x: k for k, x in enumerate(known)}, np.zeros(p.shape)
            for batch in batches:
                lang = np.array([at.get(x, -1) for x in batch.column(0).to_pylist()], np.int64)
                keep = np.flatnonzero(lang >= 0)
                words = batch.column(1).take(pa.array(keep)).to_pylist()
                total += expected_counts(vocabulary(path), p.astype(float), lang[keep], words, batch.column(2).to_numpy()[keep])
            piece, k = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(total[piece, k])], names=["lang", "piece", "n"])
            release()

        rows = counted.mapInArrow(run, "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow()
        c = np.zeros((v.size, len(langs)))
        c[rows["piece"].to_numpy(), rows["lang"].to_numpy()] = rows["n"].to_numpy()
        usual = (c / np.maximum(c.sum(axis=0), 1)).sum(axis=1) + 1e-6
        usual /= usual.sum()
        p = (c + prior * usual[:, None]) / (c.sum(axis=0) + prior)
    return Model(langs, p)


class Scorer:
    """Sums of the words' log likelihoods."""

    def __init__(self, v: Vocabulary, p: np.ndarray) -> None:
        self.v, self.p = v, p

    def __call__(self, texts: list[str]) -> np.ndarray:
        """(texts, languages)"""
        words, n = split(texts)
        known = word_scores(self.v, self.p, words.dictionary.to_pylist())
        out = np.zeros((len(texts), self.p.shape[1]))
        np.add.at(out, np.repeat(np.arange(len(texts)), n), known[words.indices.to_numpy()])
        return out


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def language_id(docs: DataFrame, model: Model, path: str = PIECES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep, lang_pred and score (0 to 1)."""
    d = pick(docs, *dict.fromkeys((*keep, "text")))
    named = ", ".join(f"`{n}` {d.schema[n].dataType.simpleString()}" for n in keep)
    shared = d.sparkSession.sparkContext.broadcast((model.langs, model.p.astype(np.float32)))

    def make():
        langs, p = shared.value
        scorer = Scorer(vocabulary(path), p.astype(np.float64))

        def run(batch: pa.RecordBatch) -> dict:
            texts = batch.column("text").to_pylist()
            ok = [k for k, t in enumerate(texts) if langs and t is not None and has_letter(t)]
            pred, score = [UND] * len(texts), [0.0] * len(texts)
            if ok:
                logs = scorer([texts[k] for k in ok])
                best = logs.argmax(axis=1)
                top = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
                for k, b, s in zip(ok, best.tolist(), top.tolist(), strict=True):
                    pred[k], score[k] = langs[b], s
            return {n: batch.column(n) for n in keep} | {"lang_pred": pred, "score": score}

        return run

    return in_slices(d, f"{named}, lang_pred string, score double", None, make=make, most=8 << 20)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def shared_bound(sizes: list[tuple[int, int]], each: int, most: int) -> int:
    """The largest bound up to each, 1 at least, under which the languages (size, how many) have at most most in all."""
    low, high = 1, max(each, 1)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if sum(min(n, mid) * k for n, k in sizes) <= most else (low, mid - 1)
    return low


def sample(docs: DataFrame, each: int = EACH, most: int = MOST) -> DataFrame:
    """lang and text of the documents to learn from: labelled, with an id and not held out.

    A document is taken by the hash of its id: all of a language with at most the bound of documents,
    else the share of hashes that makes about as many.  The bound is each, or less, so that all
    languages have about most in all, and each has one at least.  Of more than LANGUAGES languages the
    most frequent are learnt.  Only these and their sizes reach the driver, and each task gets them.
    """
    d = pick(docs, "doc_id", "text", "lang").where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    counts = d.groupBy("lang").agg(F.count("*").alias("n"), F.min(_share(F.col("doc_id"))).alias("least"))
    langs = counts.orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    bound = shared_bound([(min(r.n, each), 1) for r in langs], each, most)
    shares = [(r.lang, 1.0 if r.n <= bound else max(bound / r.n, r.least)) for r in langs]
    known = d.sparkSession.createDataFrame(shares, "lang string, __share double")
    return d.join(F.broadcast(known), "lang").where(_share(F.col("doc_id")) <= F.col("__share")).select("lang", "text")


def _share(doc_id: Column) -> Column:
    """A number from 0 to 1 that follows from an id."""
    return F.pmod(F.xxhash64(doc_id), F.lit(1 << 30)) / F.lit(float(1 << 30))


def fit_documents(docs: DataFrame, path: str = PIECES, each: int = EACH, most: int = MOST) -> Model:
    """The model of a bounded sample of documents that are not held out; those without id are not learnt from."""
    return fit(sample(docs, each, most), path)
