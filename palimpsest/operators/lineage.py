"""Cutting lineage so that a lost executor costs one stage, not a whole loop."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's, or that of ``spark.checkpoint.dir``.

    Where neither is set, a session in one process (a ``local`` master, as in tests) gets a temporary
    folder; any other raises, since a folder of one machine would be another one on each.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="palimpsest-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder; its plan starts there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def keep(df: DataFrame, drop_shuffles: bool = False) -> DataFrame:
    """``df`` computed once and kept as a table in the shared folder: columns that a reader doesn't need
    aren't read, and repeated values take little room. ``drop_shuffles`` removes what was shuffled for it as
    soon as the table is written, not when the driver happens to collect its garbage."""
    spark = df.sparkSession
    at = f"{ensure_checkpoint_dir(spark)}/kept-{uuid.uuid4().hex}"
    before = spark.conf.get(DROP_SHUFFLES, "false")
    spark.conf.set(DROP_SHUFFLES, "true" if drop_shuffles else before)
    try:
        df.write.option("compression", "zstd").parquet(at)
    finally:
        spark.conf.set(DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(at)


def discard(kept: DataFrame) -> None:
    """Remove a table that keep() wrote and that nothing reads any more."""
    spark = kept.sparkSession
    for file in kept.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        if folder.getName().startswith("kept-"):
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
