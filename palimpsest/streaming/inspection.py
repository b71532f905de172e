"""The inspection as a stream: it holds no state, so the batch columns run unchanged; counts by event
time use a watermark. An extension, since passages also arrive as streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.cascade import inspect
from palimpsest.operators.lineage import ensure_checkpoint_dir


def read_stream(spark: SparkSession, path: str, files_at_once: int = 64) -> DataFrame:
    """New parquet files of a folder (or one file); the schema is that of what is there."""
    # as a glob, since a stream takes a plain path for a folder
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_at_once).parquet(f"{path}*")


def inspected_stream(stream: DataFrame, text: str = "text") -> DataFrame:
    return inspect(stream, text)


def counts_by_window(stream: DataFrame, ts: str, keys: list[str], window: str = "1 day", late: str = "2 days") -> DataFrame:
    return stream.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late).groupBy(F.window("_t", window).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def run_once(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Processes what there is, to parquet in the shared folder, and returns it."""
    spark = stream.sparkSession
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{base}/out")

    def keep(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{base}/out/{n}")

    q = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    last = (q.lastProgress or {}).get("batchId", 0)
    return spark.read.parquet(f"{base}/out/{last}")
