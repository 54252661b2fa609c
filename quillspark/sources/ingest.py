"""Incremental ingest of a folder of texts into stored tables, and the folder as a stream of changes.

``Ingest`` keeps a manifest of files and the chunks of their sections, each a ``BucketTable``.  A run
compares a scan with the manifest and chunks what is new or changed alone; what did not change is not
read beyond its hash, and a run over an unchanged folder writes nothing.  Files go through states: they
are marked ``pending`` before their chunks are written and ``indexed`` after, so that a run that failed
half-way leaves marks by which the next one does its work again.  Deleted files stay in the manifest
with the time of their deletion, without chunks.

``watch`` makes a stream of it: each micro-batch lists the folder against the manifest and hands on what
happened (created, changed, renamed, deleted); a rename is a path that is gone and one that is new with
the same content.  The number of the batch is stored with what it wrote, so that a batch that Spark
repeats after a failure is not applied twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import content_hash
from ..operators.records import changes, replace_groups, upsert
from ..session import cut
from .markdown import CHUNK_SCHEMA, CHUNKER_VERSION, chunk_documents, scan_folder
from .snapshots import BucketTable

FILES = "path string, hash string, version int, state string, seen_at bigint, deleted_at bigint"
CHUNKS = f"path string, {CHUNK_SCHEMA}, chunk_hash string"
EVENTS = "batch bigint, path string, action string, to_path string, hash string"


class Ingest:
    """The manifest and chunks of one folder at a path.  version: of the chunker; another one chunks all files anew."""

    def __init__(self, spark: SparkSession, path: str, version: int = CHUNKER_VERSION, buckets: int = 64):
        self.spark, self.version = spark, version
        self.files = BucketTable(spark, f"{path}/files", FILES, ["path"], buckets)
        self.chunks = BucketTable(spark, f"{path}/chunks", CHUNKS, ["path"], buckets)
        self.events = BucketTable(spark, f"{path}/events", EVENTS, ["batch"], buckets)

    def _mark(self, rows: DataFrame) -> None:
        self.files.change(lambda old: upsert(old, rows.select(*old.columns), ["path"]), rows)

    def plan(self, scan: DataFrame) -> DataFrame:
        """path, change (new, changed, deleted or stuck) and hash of what a run over a scan (path, hash) has to do."""
        known = self.files.read().where("deleted_at IS NULL")
        todo = changes(known, scan, self.version).where("change <> 'unchanged'")
        stuck = known.where("state <> 'indexed'").join(scan, "path", "left_semi").join(todo, "path", "left_anti").select("path", F.lit("stuck").alias("change"))
        # a deletion that was marked, but whose chunks are still there
        late = self.files.read().where("deleted_at IS NOT NULL AND state <> 'indexed'").join(scan, "path", "left_anti").select("path", F.lit("deleted").alias("change"))
        return todo.union(stuck).union(late).join(scan.select("path", "hash"), "path", "left")

    def run(self, texts: DataFrame, at: int) -> dict[str, int]:
        """Takes in texts (path, content), all there are at the time; the numbers of files by what was done."""
        scan = texts.select("path", content_hash(F.col("content")).alias("hash"))
        todo = cut(self.plan(scan))
        done = {r["change"]: r["count"] for r in todo.groupBy("change").count().collect()}  # four at most
        if not done:
            return done
        rows = lambda state: todo.select("path", F.coalesce("hash", F.lit("")).alias("hash"), F.lit(self.version).alias("version"), F.lit(state).alias("state"), F.lit(at).cast("long").alias("seen_at"), F.when(F.col("change") == "deleted", F.lit(at).cast("long")).alias("deleted_at"))
        self._mark(rows("pending"))
        fresh = texts.join(todo.where("change <> 'deleted'").select("path"), "path", "left_semi")
        made = chunk_documents(fresh, "path", "content")
        touched = todo.select("path")
        self.chunks.change(lambda old: replace_groups(old.join(todo.where("change = 'deleted'"), "path", "left_anti").join(fresh.select("path"), "path", "left_anti"), made, ["path"]), touched)
        self._mark(rows("indexed"))
        return done

    def run_folder(self, folder: str, at: int, ignore: str | None = None) -> dict[str, int]:
        """A run over the markdown files of a folder."""
        return self.run(scan_folder(self.spark, folder, ignore).select("path", "content"), at)

    # --- changes as a stream -------------------------------------------------------------------------

    def happened(self, scan: DataFrame) -> DataFrame:
        """path, action, to_path and hash of what happened to a folder since the manifest; scan: path, hash."""
        known = self.files.read().where("deleted_at IS NULL")
        diff = changes(known, scan, self.version).where("change <> 'unchanged'").join(scan.select("path", F.col("hash").alias("now")), "path", "left").join(known.select("path", F.col("hash").alias("was")), "path", "left")
        diff = cut(diff)
        nth = lambda c: F.row_number().over(Window.partitionBy(c).orderBy("path"))
        # the n-th of the paths with a content that are gone became the n-th new one with it
        gone = diff.where("change = 'deleted'").withColumn("n", nth("was")).select(F.col("path").alias("from"), F.col("was").alias("hash"), "n")
        new = diff.where("change = 'new'").withColumn("n", nth("now")).select(F.col("path").alias("to_path"), F.col("now").alias("hash"), "n")
        moved = cut(gone.join(new, ["hash", "n"]).select("from", "to_path", "hash"))
        rest = diff.join(moved.select(F.col("from").alias("path")), "path", "left_anti").join(moved.select(F.col("to_path").alias("path")), "path", "left_anti")
        action = F.when(F.col("change") == "new", "created").otherwise(F.col("change"))
        return rest.select("path", action.alias("action"), F.lit(None).cast("string").alias("to_path"), F.coalesce("now", "was").alias("hash")).union(moved.select("from", F.lit("renamed"), "to_path", "hash"))

    def batch(self, texts: DataFrame, number: int, at: int) -> bool:
        """Applies one micro-batch: writes what happened, then takes it in; False if this batch or a later one is applied already."""
        last = self.events.remembered("batch", -1)
        if number < last or number == last and self.events.remembered("taken", -1) == last:
            return False
        scan = texts.select("path", content_hash(F.col("content")).alias("hash"))
        if number > last:
            found = self.happened(scan).select(F.lit(number).cast("long").alias("batch"), "path", "action", "to_path", "hash")
            self.events.change(lambda old: replace_groups(old, found, ["batch"]), self.spark.createDataFrame([(number,)], "batch long"), batch=number)
        self.run(texts, at)
        version, state = self.events.log.state()
        self.events.log.commit(state | {"taken": number}, version)
        return True

    def watch(self, listing: Callable[[], DataFrame], checkpoint: str, clock: Callable[[], int], every: str = "10 seconds"):
        """A running stream that applies what listing() (path, content) shows at each trigger."""
        ticks = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        return ticks.writeStream.foreachBatch(lambda _, number: self.batch(listing(), number, clock())).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
