"""Filter interaction audit: what each filter removes in each order of filters, per part of a corpus.

Five filters judge whole texts (a null text is empty; words are runs of other than ASCII white space):

A  fewer than 50 words
B  100 * distinct words < 65 * words
C  100 * letters A-Z > 5 * code points
D  any of # $ % & * |
E  the same text has a smaller doc_id somewhere in the table

E comes from a sort: rows are range-partitioned by (fingerprint, doc_id), so that even a text that a
third of all rows share is split over tasks, and sorted within each task by (fingerprint, full text,
doc_id).  A task compares each row with its predecessor; full texts decide, fingerprints only bring
them together.  Rows that a task cannot judge alone are the least ids of the texts of its first
fingerprint; they are held against the least ids of the texts of other tasks' last fingerprints, a few
rows a task.  The sort's sampling sees fingerprints and ids, never texts.

A row's failures are a mask of five bits.  Masks are counted per part, 32 counters for all rows, for
those of good quality and for toxic ones; each order and step is a sum over these counters.

Defined cases: a row without doc_id fails E never and makes no other row fail it; repeated rows of one
doc_id do not make each other fail; rows without part count as the part ''; labels without doc_id label nothing, of several labels of one
doc_id any that is 1 counts; an empty table has no parts and no rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, pick, release, slices, small_batches, stored

FILTERS = "ABCDE"
FEWEST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 50, 65, 5
CAPITALS, SYMBOLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
BIT = {f: 1 << k for k, f in enumerate(FILTERS)}


def failures(text: str | None) -> int:
    """The mask of the filters A to D that a text fails."""
    raw = (text or "").encode()
    words = raw.split()
    out = BIT["A"] * (len(words) < FEWEST_WORDS)
    out |= BIT["B"] * (100 * len(set(words)) < DISTINCT_PERCENT * len(words))
    out |= BIT["C"] * (100 * (len(raw) - len(raw.translate(None, CAPITALS))) > CAPITAL_PERCENT * len(text or ""))
    return out | BIT["D"] * (len(raw.translate(None, SYMBOLS)) < len(raw))


#: head: the least id of a text of the task's first fingerprint, not yet judged by E.  last: no row of
#: the table, but the least id of a text of the task's last fingerprint.
_SCANNED = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("head", pa.bool_()), ("last", pa.bool_()), ("print", pa.int64()), ("whole", pa.string())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Masks of rows sorted by (print, text, doc_id), each compared with its predecessor."""
    first = before = text = least = None
    begun, texts = False, {}  # texts: of the current fingerprint, with their least ids
    for batch in batches:
        for part in slices(batch, batch.num_rows, BATCH_BYTES):
            out: list[tuple] = []
            for doc_id, mark, whole, source in zip(*(part.column(c).to_pylist() for c in ("doc_id", "print", "text", "part")), strict=True):
                if not begun:
                    begun, first = True, mark
                if mark != before:
                    before, text, texts = mark, None, {}
                if whole != text:
                    text, least = whole, doc_id
                    mask = failures(whole)
                    texts[whole] = least
                same = doc_id is not None and doc_id == least
                head = same and mark == first
                dup = doc_id is not None and least is not None and doc_id > least
                out.append((doc_id, source, mask | BIT["E"] * dup, head, False, mark if head else None, whole if head else None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), _SCANNED, strict=True)], schema=_SCANNED)
    ends = [(least, None, 0, False, True, before, whole) for whole, least in texts.items() if least is not None]
    if ends:
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*ends, strict=True), _SCANNED, strict=True)], schema=_SCANNED)
    release()


def failure_masks(docs: DataFrame, part: str = "source") -> DataFrame:
    """doc_id, part and mask of every row."""
    small_batches(docs.sparkSession)
    d = pick(docs, "doc_id", "text", part).toDF("doc_id", "text", "part")
    d = d.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("part", F.lit("")).alias("part"))
    d = d.withColumn("print", F.xxhash64("text"))
    ranged = d.repartitionByRange("print", "doc_id").sortWithinPartitions("print", "text", F.asc_nulls_last("doc_id"))
    scanned = stored(ranged.mapInArrow(_scan, "doc_id bigint, part string, mask int, head boolean, last boolean, print bigint, whole string"), "filter-audit")
    rows = scanned.where("NOT last")
    ends = scanned.where("last").groupBy("print", "whole").agg(F.min("doc_id").alias("least"))
    heads = rows.where("head").join(ends, ["print", "whole"], "left")
    dup = F.coalesce(F.col("least") < F.col("doc_id"), F.lit(False))
    heads = heads.withColumn("mask", F.when(dup, F.col("mask").bitwiseOR(BIT["E"])).otherwise(F.col("mask")))
    return rows.where("NOT head").select("doc_id", "part", "mask").unionByName(heads.select("doc_id", "part", "mask"))


def counters(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a part: arrays of counts by mask of all rows, of those of good quality and of toxic ones."""
    marks = pick(labels, "doc_id", "quality", "toxic").where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    one = masks.join(marks, "doc_id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    def each(c: str):
        return F.array(*[F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0)).cast("long") for m in range(1 << len(FILTERS))])

    return one.groupBy("part").agg(each("n").alias("n"), each("good").alias("good"), each("toxic").alias("toxic"))


def filter_audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """part, filter_order, step; kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley."""
    orders = " ".join("".join(o) for o in itertools.permutations(FILTERS))
    bits = "aggregate({}, 0, (a, f) -> a + if(f = '', 0, shiftleft(1, instr('" + FILTERS + "', f) - 1)))"
    c = counters(failure_masks(docs, part), labels).withColumn("filter_order", F.explode(F.split(F.lit(orders), " "))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    c = c.withColumn("before", F.expr(bits.format("split(substring(filter_order, 1, step - 1), '')"))).withColumn("bit", F.expr(bits.format("array(substring(filter_order, step, 1))")))
    total = lambda of, where, times="1L": F.expr(f"aggregate(sequence(0, {(1 << len(FILTERS)) - 1}), 0L, (a, m) -> a + if({where}, {of}[m] * {times}, 0L))")
    fails, new = "(m & bit) != 0", "(m & bit) != 0 AND (m & before) = 0"
    return c.select(
        "part",
        "filter_order",
        "step",
        total("n", "(m & (bit | before)) = 0").alias("kept"),
        total("n", new).alias("removed"),
        total("n", f"{fails} AND (m & before) != 0").alias("redundant"),
        total("n", "m = bit").alias("unique_fails"),
        total("good", new).alias("good_lost"),
        total("toxic", new).alias("toxic_lost"),
        total("n", fails, f"({math.factorial(len(FILTERS))} div bit_count(m))").alias("shapley"),
    )
