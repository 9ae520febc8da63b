"""Sample operators on streams of frames. Point and neighbourhood operators are projections, so a clip over a
streaming DataFrame takes them unchanged; statistics of event-time windows carry a watermark."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.clip import Clip
from tessella.info import VideoInfo


def stream_clip(info: VideoInfo, frames: DataFrame) -> Clip:
    """A clip over streamed rows (n, plane, data)."""
    props = frames.select("n", F.create_map().cast("map<string,struct<i:array<bigint>,f:array<double>,d:array<string>>>").alias("props"))
    return Clip(info, frames, props)


def windowed_levels(samples: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """(start, count, low, high, total) of `value` per event-time window of `ts`; later rows than `late` are left out."""
    return samples.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w")).agg(
        F.count(F.lit(1)).alias("count"), F.min("value").alias("low"), F.max("value").alias("high"), F.sum("value").alias("total")
    ).select(F.col("w.start").alias("start"), "count", "low", "high", "total")


def drained(stream: DataFrame, path: str) -> DataFrame:
    """All that a streaming aggregation gives for what its source holds now: micro-batches until it's read, each
    replacing the table under `path`. A run that is stopped goes on from its checkpoint there."""

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/table")

    query = stream.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/table")


def shared(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir; local where it's unset)."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = tempfile.mkdtemp(prefix="tessella-")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
