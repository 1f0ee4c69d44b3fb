"""Continual memory as a stream: each micro-batch merges its observations into a versioned snapshot.

Step-by-step indexing as Structured Streaming. Every batch writes a new
version and then a marker with its id; a batch that runs again after a failure finds its marker and changes nothing, so
the result is that of one run.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def merge_batch(batch: DataFrame, batch_id: int, folder: str) -> None:
    """Union with the state of the batch before: sums of support, sources once, the latest step."""
    spark = batch.sparkSession
    path = f"{folder}/state/v-{batch_id:010d}"
    if _exists(spark, f"{path}/_SUCCESS"):
        return
    seen = batch.groupBy("entity", "source").agg(F.sum("n").alias("n"), F.max("step").alias("step"))
    before = f"{folder}/state/v-{batch_id - 1:010d}"
    if batch_id and _exists(spark, before):
        seen = seen.unionByName(spark.read.parquet(before)).groupBy("entity", "source").agg(F.sum("n").alias("n"), F.max("step").alias("step"))
    seen.write.mode("overwrite").parquet(path)


def run_to_end(observations: DataFrame, folder: str) -> DataFrame:
    """Run a stream (entity, source, step, n) over what is there now; the records: entity, sources, support, last_seen."""
    spark = observations.sparkSession
    folder = f"{folder.rstrip('/')}/stream-{uuid.uuid4().hex[:12]}"
    query = (
        observations.writeStream.foreachBatch(lambda df, i: merge_batch(df, i, folder)).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    last = (query.lastProgress or {}).get("batchId", 0)
    while last and not _exists(spark, f"{folder}/state/v-{last:010d}"):
        last -= 1
    state = spark.read.parquet(f"{folder}/state/v-{last:010d}")
    return state.groupBy("entity").agg(F.count("*").alias("sources"), F.sum("n").alias("support"), F.max("step").alias("last_seen"))


def windowed_activity(events: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by window and type, late ones within the watermark counted: start, event_type, n. Works on streams and tables."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
