"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, cut  # noqa: F401 - cut is for the operators

#: ASCII white space, as in the class [\x20\x09-\x0D].
WHITE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns and no others.

    Columns are taken by position, so that further columns whose names differ only in case, or
    repeat, do not make a name ambiguous.  An exact match goes before one that ignores case, the
    first of several before the others.
    """
    have = df.columns
    lowered = [c.lower() for c in have]
    where = [have.index(n) if n in have else lowered.index(n.lower()) for n in names]
    plain = df.toDF(*[f"_{i}" for i in range(len(have))])
    return plain.select(*[F.col(f"_{i}").alias(n) for i, n in zip(where, names, strict=True)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, all else untouched."""
    return F.translate(c, UPPER, LOWER)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again."""
    path = os.path.join(checkpoint_dir(df.sparkSession), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def release() -> None:
    """Gives free memory back to the system: workers outlive their tasks."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: its memory stays with the worker
        pass


#: Bytes of an Arrow batch on its way to Python.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by bytes, unless its own bound is lower: rows may hold very long texts."""
    try:
        have = spark.conf.get(BATCH)
    except Exception:  # noqa: BLE001 - another release without this setting: its batches are bounded by rows
        return
    if int(have.rstrip("bB") if have.rstrip("bB").lstrip("-").isdigit() else BATCH_BYTES + 1) not in range(1, BATCH_BYTES + 1):
        spark.conf.set(BATCH, str(BATCH_BYTES))


def slices(batch: pa.RecordBatch, rows: int, most: int | None) -> Iterator[pa.RecordBatch]:
    """Parts of a batch: of some rows, or with most of about so many bytes of text."""
    if most is None or "text" not in batch.schema.names:
        yield from (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))
        return
    held = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy().astype(np.int64) + 64)
    at, before = 0, 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(held, before + most, side="right")))
        yield batch.slice(at, end - at)
        at, before = end, int(held[end - 1])


def in_slices(df: DataFrame, schema: str, fn: Callable[[pa.RecordBatch], dict] | None, rows: int = 256, make: Callable[[], Callable[[pa.RecordBatch], dict]] | None = None, most: int | None = None) -> DataFrame:
    """mapInArrow in slices of a few rows, or of most bytes of text, so that a task never holds more than a slice of results.

    fn gets a RecordBatch and returns {column: values}.  With make, fn is made once per task.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gc

        gc.disable()  # results are many small objects without cycles
        f = make() if make else fn
        try:
            for batch in batches:
                for part in slices(batch, rows, most):
                    got = f(part)
                    yield pa.RecordBatch.from_arrays([pa.array(got[x.name], type=x.type) if not isinstance(got[x.name], pa.Array) else got[x.name].cast(x.type) for x in out], schema=out)
                    del got, part
        finally:
            del f
            gc.enable()
            release()

    return df.mapInArrow(run, schema)


def by_hash(rows: DataFrame, key: str, most: int) -> DataFrame:
    """About most of the rows, those with the least hashes of a key; all of them if they are no more.

    Rows are counted first and then filtered by a threshold: nothing is sorted or sent anywhere.
    """
    n = rows.count()
    share = F.pmod(F.xxhash64(key), F.lit(1 << 30))
    return rows if n <= most else rows.where(share < int((1 << 30) * most / n))
