"""Sharding by fixed virtual slots, with DataFrame and SQL functions only.

A record's slot is a hash of its doc_id and text, one of thousands whatever the shard count. Bytes are
summed per slot; a versioned map puts slots on shards, the largest first to the shard with the fewest
bytes, so shards' sizes are nearly equal (law `bytes`). Rebalancing edits the stored map: it moves
slots from the fullest to the emptiest shard and writes the next version; no record is hashed anew.

The map has one row per slot, so what is broadcast or ordered in one task is bounded by the number of
slots. A record's place in its shard is the count of records in the shard's slots before its own, plus
its rank in the slot; a slot holds about 1/4096 of the records whatever their source. Texts that one
doc_id repeats spread over slots; only equal rows share one.

Defined results: null and empty texts have size 1 and CRC 0; a null doc_id is hashed as such; equal
rows take places of their own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm import words as W

SLOTS, SHARDS = 4096, 8


def slotted(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot) for each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(text)))
    slot = F.conv(F.substring(key, 1, 8), 16, 10).cast("long") % slots
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), slot.cast("int").alias("virtual_slot"))


def loads(rows: DataFrame) -> DataFrame:
    """(virtual_slot, bytes, records)."""
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("records"))


def new_map(loads_: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(virtual_slot, shard, version 1): descending slots, each to the shard with the fewest bytes so far."""
    ordered = loads_.agg(F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("b"), "virtual_slot"))).alias("s"))
    start = F.struct(F.array(*[F.lit(0).cast("long")] * shards).alias("l"), F.array().cast("array<int>").alias("to"))

    def put(acc: F.Column, x: F.Column) -> F.Column:
        least = F.array_position(acc["l"], F.array_min(acc["l"])).cast("int")
        filled = F.transform(acc["l"], lambda v, i: F.when(i + 1 == least, v - x["b"]).otherwise(v))
        return F.struct(filled.alias("l"), F.concat(acc["to"], F.array(least - 1)).alias("to"))

    dealt = ordered.select("s", F.aggregate("s", start, put)["to"].alias("to"))
    return dealt.select(F.explode(F.arrays_zip(F.col("s.virtual_slot").alias("virtual_slot"), F.col("to").alias("to"))).alias("x")).select(F.col("x.virtual_slot").alias("virtual_slot"), F.col("x.to").alias("shard"), F.lit(1).alias("version"))


def rebalanced(map_: DataFrame, loads_: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The next version of a map for new loads and shard count: slots of shards above the mean are given away,
    smallest first, until they are down to it, and go to where most bytes are missing; the others stay."""
    known = loads_.join(F.broadcast(map_), "virtual_slot", "left").withColumn("shard", F.when(F.col("shard") < shards, F.col("shard")))
    mean = known.agg((F.sum("bytes") / shards).alias("mean"))
    used = Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot").rowsBetween(Window.unboundedPreceding, 0)
    kept = known.crossJoin(F.broadcast(mean)).withColumn("stays", F.col("shard").isNotNull() & (F.sum("bytes").over(used) <= F.col("mean")))
    held = kept.where("stays").groupBy("shard").agg(F.sum("bytes").alias("held"))
    every = map_.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard")).join(F.broadcast(held), "shard", "left")
    start_loads = every.agg(F.array_sort(F.collect_list(F.struct("shard", F.coalesce("held", F.lit(0)).alias("held")))).alias("h"))
    moving = kept.where("NOT stays").agg(F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("b"), "virtual_slot"))).alias("s"))
    start = F.struct(F.col("h.held").alias("l"), F.array().cast("array<int>").alias("to"))

    def put(acc: F.Column, x: F.Column) -> F.Column:
        least = F.array_position(acc["l"], F.array_min(acc["l"])).cast("int")
        return F.struct(F.transform(acc["l"], lambda v, i: F.when(i + 1 == least, v - x["b"]).otherwise(v)).alias("l"), F.concat(acc["to"], F.array(least - 1)).alias("to"))

    dealt = moving.crossJoin(F.broadcast(start_loads)).select("s", F.aggregate("s", start, put)["to"].alias("to"))
    moved = dealt.select(F.explode(F.arrays_zip(F.col("s.virtual_slot").alias("virtual_slot"), F.col("to").alias("to"))).alias("x")).select(F.col("x.virtual_slot").alias("virtual_slot"), F.col("x.to").alias("shard"))
    version = map_.agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("version"))
    return kept.where("stays").select("virtual_slot", "shard").unionByName(moved).crossJoin(F.broadcast(version))


def store(map_: DataFrame, path: str) -> int:
    """Write a map as path/version=N, never over an older one; returns N."""
    version = map_.agg(F.max("version")).head()[0] or 1
    map_.drop("version").write.parquet(f"{path}/version={version}")
    return version


def load(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored map, by default the newest."""
    maps = spark.read.schema("virtual_slot int, shard int, version int").parquet(path)
    version = maps.agg(F.max("version")).head()[0] if version is None else version
    return maps.where(F.col("version") == version)


def placed(rows: DataFrame, map_: DataFrame, loads_: DataFrame) -> DataFrame:
    """slotted() rows with shard and slot, the place in the shard from 0 without gaps."""
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each virtual slot: bounded by their number
    starts = map_.join(F.broadcast(loads_), "virtual_slot").select(F.col("virtual_slot").alias("of"), "shard", F.coalesce(F.sum("records").over(before), F.lit(0)).alias("first"))
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32"))
    return rows.withColumn("rank", rank).join(F.broadcast(starts), F.col("virtual_slot") == F.col("of")).withColumn("slot", F.col("first") + F.col("rank") - 1).drop("of", "first", "rank")


def sharded(docs: DataFrame, path: str, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot) for each row; the map is stored
    under path as version 1."""
    rows, spark = slotted(docs, slots), docs.sparkSession
    W.shared(spark, "")  # sees to a checkpoint folder
    held = loads(rows).checkpoint()  # a row for each slot, from one reading
    store(new_map(held, shards), path)
    out = placed(rows, load(spark, path), held)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
