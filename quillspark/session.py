"""Sessions and shared folders."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session for local runs; on a cluster, pass neither argument."""
    b = SparkSession.builder.appName("quillspark").config("spark.sql.session.timeZone", "UTC")
    if master:
        b = b.master(master).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    return b.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where it is unset, a fresh one for a local session alone."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quillspark-"))
    return str(sc.getCheckpointDir())


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the folder of spark.checkpoint.dir, its lineage gone."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
