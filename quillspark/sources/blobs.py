"""Content-addressed blobs: stored by the hash of their bytes, compressed where it pays, checked when read."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes from which a blob is compressed.
THRESHOLD = 256


def compressed(blobs: DataFrame, threshold: int = THRESHOLD, column: str = "data") -> DataFrame:
    """content_hash (of the plain bytes), encoding (zstd or identity), data and original_size, each content once.

    Blobs under the threshold, and those that do not get smaller, stay as they are; null ones are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor()
        for batch in batches:
            out = []
            for b in batch.column("data").to_pylist():
                small = pack.compress(b) if len(b) >= threshold else b
                out.append(("zstd", small) if len(small) < len(b) else ("identity", b))
            yield pa.RecordBatch.from_arrays([batch.column("content_hash"), pa.array([e for e, _ in out], pa.string()), pa.array([d for _, d in out], pa.binary()), batch.column("original_size")], names=["content_hash", "encoding", "data", "original_size"])

    plain = blobs.where(F.col(column).isNotNull()).select(F.sha2(column, 256).alias("content_hash"), F.col(column).cast("binary").alias("data"), F.octet_length(column).cast("long").alias("original_size"))
    return plain.dropDuplicates(["content_hash"]).mapInArrow(run, "content_hash string, encoding string, data binary, original_size bigint")


def write(blobs: DataFrame, path: str, threshold: int = THRESHOLD) -> None:
    """Adds blobs to a store; those that it has are not written again."""
    spark = blobs.sparkSession
    new = compressed(blobs, threshold)
    try:
        known = spark.read.parquet(path).select("content_hash")
    except Exception as e:  # noqa: BLE001 - no store yet; anything else is an error
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = None
    (new if known is None else new.join(known, "content_hash", "left_anti")).write.mode("append").parquet(path)


def read(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """content_hash, data (plain) and state of wanted hashes: ok, missing, or corrupt (data null in both)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        import zstandard

        for batch in batches:
            out = []
            for h, e, d in zip(*(batch.column(c).to_pylist() for c in ("content_hash", "encoding", "data")), strict=True):
                try:
                    plain = None if d is None else zstandard.ZstdDecompressor().decompress(d) if e == "zstd" else d
                    out.append((plain, "missing") if plain is None else (plain, "ok") if hashlib.sha256(plain).hexdigest() == h else (None, "corrupt"))
                except zstandard.ZstdError:
                    out.append((None, "corrupt"))
            yield pa.RecordBatch.from_arrays([batch.column("content_hash"), pa.array([p for p, _ in out], pa.binary()), pa.array([s for _, s in out], pa.string())], names=["content_hash", "data", "state"])

    hashes = wanted.select("content_hash").distinct()
    both = hashes.join(spark.read.parquet(path), "content_hash", "left").select("content_hash", "encoding", "data")
    return both.mapInArrow(run, "content_hash string, data binary, state string")
