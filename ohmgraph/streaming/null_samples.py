"""Streams: hit lists that arrive as files are appended, batch by batch, to running totals and to the null store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ohmgraph.sinks.tables import NullStore


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, experiment, count): counts by window and type; rows later than ``late`` are dropped by the watermark."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), F.col("event_type").alias("experiment")).agg(F.count(F.lit(1)).alias("count"))
    return w.select(F.col("w.start").alias("start"), "experiment", "count")


def append_samples(spark: SparkSession, folder: str, schema: str, store: NullStore, sys_hash: str, sample_hash: str, checkpoint: str) -> StreamingQuery:
    """Appends node flows of new runs to the store; a batch that is run again after a failure is recognised by its number."""

    def put(df: DataFrame, epoch: int) -> None:
        try:
            done = store.find(sys_hash, sample_hash).filter(F.col("epoch") == epoch).limit(1).count()
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            done = 0
        if not done:
            store.insert(df.withColumn("epoch", F.lit(epoch).cast("long")), sys_hash, sample_hash)

    return spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
