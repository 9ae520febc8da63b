"""Clips made of tables: a frame for each embedding, a stereo sample for each event."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.clip import PROPS, Audio, Clip
from tessella.info import FLOAT, GRAY, INTEGER, RGB, YUV, AudioInfo, VideoFormat, VideoInfo

SIDE = 8


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _scaled(bits: int, data: str = "embedding"):
    """Embedding values as integer samples: (e + 0.6) in units of top / 1.2, rounded half to even and held in range."""
    top = float((1 << bits) - 1)
    return F.transform(data, lambda e: F.rint(F.least(F.greatest((e.cast("double") + 0.6) * (top / 1.2), F.lit(0.0)), F.lit(top))).cast("int"))


def _props(spark: SparkSession, sf_dir: str, length: int) -> DataFrame:
    """Label, whether a frame's label differs from the one before and after, and a duration of 1/24."""
    rows = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("n"), F.col("label").cast("long").alias("label"))
    before = rows.select((F.col("n") + 1).alias("n"), F.col("label").alias("last"))
    after = rows.select((F.col("n") - 1).alias("n"), F.col("label").alias("next"))
    both = rows.where(F.col("n") < length).join(before, "n", "left").join(after, "n", "left")
    one = lambda c: F.struct(F.array(c.cast("bigint")).alias("i"), F.lit(None).cast("array<double>").alias("f"), F.lit(None).cast("array<string>").alias("d"))
    change = lambda c: F.coalesce(F.col(c) != F.col("label"), F.lit(False)).cast("long")
    values = {"Label": F.col("label"), "_SceneChangePrev": change("last"), "_SceneChangeNext": change("next"), "_DurationNum": F.lit(1), "_DurationDen": F.lit(24)}
    return both.select("n", F.create_map(*[x for k, v in values.items() for x in (F.lit(k), one(v))]).cast(PROPS).alias("props"))


def gray(spark: SparkSession, sf_dir: str, bits: int = 8) -> Clip:
    """Embeddings as 8x8 gray frames; bits 32 keeps them as floats."""
    rows = _table(spark, sf_dir, "embeddings")
    length = rows.count()
    data = F.col("embedding") if bits == 32 else _scaled(bits)
    info = VideoInfo(VideoFormat(GRAY, FLOAT if bits == 32 else INTEGER, bits), SIDE, SIDE, length)
    return Clip(info, rows.select(F.col("vec_id").alias("n"), F.lit(0).alias("plane"), data.alias("data")), _props(spark, sf_dir, length))


def rgb(spark: SparkSession, sf_dir: str) -> Clip:
    """Three embeddings a frame; what is left over is dropped."""
    rows = _table(spark, sf_dir, "embeddings")
    length = rows.count() // 3
    frames = rows.where(F.col("vec_id") < 3 * length).select(F.expr("vec_id div 3").alias("n"), (F.col("vec_id") % 3).cast("int").alias("plane"), _scaled(8).alias("data"))
    return Clip(VideoInfo(VideoFormat(RGB), SIDE, SIDE, length), frames, _props(spark, sf_dir, length))


def yuv(spark: SparkSession, sf_dir: str) -> Clip:
    """As rgb, the second and third of each three halved by leaving out odd rows and columns."""
    whole = rgb(spark, sf_dir)
    half = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.get("data", (F.floor(i / 4) * 16 + i % 4 * 2).cast("int")))
    frames = whole.frames.withColumn("data", F.when(F.col("plane") == 0, F.col("data")).otherwise(half))
    return Clip(VideoInfo(VideoFormat(YUV, INTEGER, 8, 1, 1), SIDE, SIDE, len(whole)), frames, whole.props)


def audio(spark: SparkSession, sf_dir: str) -> Audio:
    """Events as 16-bit stereo samples."""
    rows = _table(spark, sf_dir, "events")
    left = F.rint(F.least(F.greatest(F.col("value") * 66, F.lit(-32768.0)), F.lit(32767.0))).cast("int")
    right = ((F.col("user_id") - 75) * 200).cast("int")
    return Audio(AudioInfo(48000, rows.count()), rows.select(F.col("event_id").alias("s"), F.array(left, right).alias("v")))
