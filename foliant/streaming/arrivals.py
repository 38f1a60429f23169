"""Files that keep arriving, each processed once."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from foliant.session import cut, remove, shared_dir


def process_arrivals(spark: SparkSession, path: str, schema: str, handle: Callable[[DataFrame, int], None], checkpoint: str, fmt: str = "json") -> StreamingQuery:
    """Hands each batch of new files to ``handle``, then ends; run again, it takes up where the checkpoint says."""
    stream = spark.readStream.format(fmt).schema(schema).load(path)
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def request_counts(stream: DataFrame, time: str = "ts", late: str = "1 day", width: str = "1 day") -> DataFrame:
    """Requests per window and kind; rows later than ``late`` behind the newest are left out."""
    return stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late).groupBy(F.window("_t", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def without_retries(stream: DataFrame, keys: list[str], time: str, within: str = "30 seconds") -> DataFrame:
    """Rows without those that repeat the same keys within so long."""
    return stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", within).dropDuplicatesWithinWatermark([*keys]).drop("_t")


def arrived(spark: SparkSession, path: str, schema: str, each: Callable[[DataFrame], DataFrame], name: str, fmt: str = "parquet") -> DataFrame:
    """What ``each`` makes of every batch of files at ``path``, once a file: the batches are written to the shared folder by their
    number, so one that is run again after a loss replaces itself; state and batches are removed once they are read into the
    table returned."""
    base = f"{shared_dir(spark)}/foliant/{name}-{uuid.uuid4().hex}"
    process_arrivals(spark, path, schema, lambda batch, n: each(batch).write.mode("overwrite").parquet(f"{base}/out/batch={n}"), f"{base}/state", fmt).awaitTermination()
    out = cut(spark.read.parquet(f"{base}/out").drop("batch"), name)
    remove(spark, base)
    return out
