"""Tables that change by whole snapshots.

A folder holds data folders, which are never changed once written, and a log of pointers, one small
file a version.  A change writes its data folders first and its pointer last, so that a run that fails
or is killed at any moment leaves the state before it, and readers never see half of a change.  Of two
writers that start from one version the second finds its pointer taken and fails.

``BucketTable`` keeps rows in buckets by a hash of their keys; a change rewrites the buckets that it
touches and no others.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer has committed since the version that a change started from."""


class Snapshots:
    """The log of a folder: numbered states, each a JSON object, the last of which holds."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        """Names of a folder's entries; none if there is no such folder."""
        at, fs = self._fs(f"{self.path}/{folder}")
        return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []

    def folder(self, name: str) -> str:
        """The name of a data folder that does not exist yet."""
        return f"data/{name}-{uuid.uuid4().hex}"

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self.names("log") if n.endswith(".json")]

    def state(self, version: int | None = None) -> tuple[int, dict]:
        """The last version with its state (0 and nothing before the first); pointers that were not written to their end do not count."""
        for v in sorted(self.versions() if version is None else [version], reverse=True):
            at, fs = self._fs(f"{self.path}/log/{v:012d}.json")
            stream = fs.open(at)
            try:
                text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            try:
                return v, json.loads(text)
            except ValueError:
                continue
        return 0, {}

    def commit(self, state: dict, after: int) -> int:
        """Makes a state the one that follows a version."""
        last = max([0, *self.versions()])
        if self.state()[0] != after:
            raise Conflict(f"{self.path} is past version {after}")
        at, fs = self._fs(f"{self.path}/log/{last + 1:012d}.json")
        try:
            stream = fs.create(at, False)
        except Exception as e:
            raise Conflict(f"version {last + 1} of {self.path} is taken") from e
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        return last + 1

    def clean(self, used: Callable[[dict], set[str]], keep: int = 1) -> None:
        """Removes data folders that none of the last snapshots uses; for times without writers."""
        held: set[str] = set()
        for v in self.versions()[-keep:]:
            held |= used(self.state(v)[1])
        for name in self.names("data"):
            if f"data/{name}" not in held:
                at, fs = self._fs(f"{self.path}/data/{name}")
                fs.delete(at, True)


class BucketTable:
    """Rows in buckets by their keys, in snapshots.

    keys: the columns by which rows are found and changed; all rows of one key lie in one bucket, so that
    a change needs no other buckets.  A change is a function of the rows of the touched buckets.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, keys: list[str], buckets: int = 64):
        self.spark, self.keys, self.log = spark, keys, Snapshots(spark, path)
        self.schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        self.buckets = self.log.state()[1].get("buckets", buckets)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def read(self, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        """All rows of the last or another version, or those of some buckets."""
        where = self.log.state(version)[1].get("where", {})
        paths = [f"{self.log.path}/{folder}/__bucket={b}" for b, folder in where.items() if only is None or int(b) in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def change(self, by: Callable[[DataFrame], DataFrame], touched: DataFrame, **more) -> int:
        """Puts by(rows of the touched buckets) in their place; touched: at least the key columns of all that may change.

        more: what else the new state is to remember.  Returns the new version.
        """
        version, state = self.log.state()
        only = [r[0] for r in touched.select(self.bucket()).distinct().collect()]  # at most all buckets
        folder = self.log.folder("rows")
        new = by(self.read(version or None, only)).select(*[F.col(f.name).cast(f.dataType) for f in self.schema]).withColumn("__bucket", self.bucket())
        new.hint("rebalance", "__bucket").write.partitionBy("__bucket").parquet(f"{self.log.path}/{folder}")
        written = {n.partition("=")[2] for n in self.log.names(folder) if n.startswith("__bucket=")}
        if stray := written - {str(b) for b in only}:
            raise ValueError(f"rows of buckets that were not touched: {sorted(stray)}")
        where = {b: f for b, f in state.get("where", {}).items() if int(b) not in only} | dict.fromkeys(written, folder)
        return self.log.commit(state | more | {"buckets": self.buckets, "where": where}, version)

    def remembered(self, name: str, otherwise=None):
        return self.log.state()[1].get(name, otherwise)

    def clean(self, keep: int = 1) -> None:
        self.log.clean(lambda s: set(s.get("where", {}).values()), keep)
