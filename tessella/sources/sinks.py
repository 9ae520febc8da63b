"""Ordered outputs. Small ones come to the driver one partition at a time; bulk output is written by all tasks, as
Parquet or as parts of one raw stream."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.clip import HALO, Audio, Clip
from tessella.info import GRAY, YUV, need


def _packed(data: list, bits: int, is_float: bool) -> bytes:
    kind = {16: "<f2", 32: "<f4"}[bits] if is_float else "<u1" if bits <= 8 else "<u2" if bits <= 16 else "<u4"
    return np.asarray(data).astype(kind).tobytes()


def frames_in_order(clip: Clip, first: int = 0, last: int | None = None):
    """(n, planes in order) of a range of frames."""
    last = len(clip) - 1 if last is None else last
    rows = clip.frames.where(F.col("n").between(first, last)).groupBy("n").agg(F.array_sort(F.collect_list(F.struct("plane", "data"))).alias("planes"))
    for r in rows.orderBy("n").toLocalIterator(prefetchPartitions=True):
        yield r.n, [p.data for p in r.planes]


def write_raw(clip: Clip, out: BinaryIO, y4m: bool = False, order: tuple[int, ...] | None = None) -> None:
    """All frames' samples, little-endian, planes in order; y4m adds the stream's and frames' headers."""
    f = clip.info.format
    if y4m:
        need(f.family in (GRAY, YUV), "y4m: gray or YUV")
        chroma = {(0, 0): "444", (1, 0): "422", (1, 1): "420", (2, 0): "411", (2, 2): "410", (0, 1): "440"}.get((f.ss_w, f.ss_h), "")
        depth = "" if f.bits == 8 else "ps" if f.is_float and f.bits == 32 else "ph" if f.is_float else f"p{f.bits}"
        colour = f"mono{'' if f.bits == 8 else f.bits}" if f.family == GRAY else chroma + depth
        out.write(f"YUV4MPEG2 C{colour} W{clip.info.width} H{clip.info.height} F{clip.info.fps[0]}:{clip.info.fps[1]} Ip A0:0 XLENGTH={len(clip)}\n".encode())
    for _, planes in frames_in_order(clip):
        if y4m:
            out.write(b"FRAME\n")
        for p in order or range(len(planes)):
            out.write(_packed(planes[p], f.bits, f.is_float))


def _wave_format(clip: Audio) -> tuple[int, bytes]:
    """(bytes of samples in all, the format block of WAV and W64)."""
    i = clip.info
    size, n = (i.bits + 7) // 8, len(i.channels)
    return len(clip) * size * n, struct.pack("<HHIIHH", 3 if i.is_float else 1, n, i.rate, i.rate * n * size, n * size, size * 8)


def write_wav(clip: Audio, out: BinaryIO, header: bool = True) -> None:
    """Interleaved little-endian samples, with a RIFF header for WAV."""
    if header:
        total, kind = _wave_format(clip)
        need(total < 2**32 - 64, "wav: too long for a RIFF header")
        out.write(b"RIFF" + struct.pack("<I", 36 + total) + b"WAVEfmt " + struct.pack("<I", 16) + kind + b"data" + struct.pack("<I", total))
    _write_samples(clip, out)


def write_raw_parts(clip: Clip, path: str) -> DataFrame:
    """The bytes of write_raw() in files path/part-*.raw, written by all tasks in the order of frames, each under a
    name of its attempt until it's whole. Returns the parts' table (part, first, frames, offset, bytes) from
    path/index: the files one after another, by part, are the stream, and a part begins at byte `offset` of it."""
    info = clip.info
    f, planes = info.format, range(info.format.planes)
    size = sum(len(_packed([0], f.bits, f.is_float)) * math.prod(info.size(p)) for p in planes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        files, top = _filesystem(path)
        store, first, n = None, None, 0
        final, own = f"{top}/part-{task.partitionId():06d}.raw", f"{top}/_attempt-{task.partitionId():06d}-{task.taskAttemptId()}"
        for batch in batches:
            if store is None:
                files.create_dir(top, recursive=True)
                store, first = files.open_output_stream(own), batch.column(0)[0].as_py()
            for k in range(batch.num_rows):
                for p in planes:
                    store.write(_packed(batch.column(1 + p)[k].values.to_numpy(), f.bits, f.is_float))
            n += batch.num_rows
        if store is not None:
            store.close()
            files.move(own, final)
            cols = [pa.array([x], kind) for x, kind in ((task.partitionId(), pa.int32()), (first, pa.int64()), (n, pa.int64()), (first * size, pa.int64()), (n * size, pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["part", "first", "frames", "offset", "bytes"])

    rows = clip.frames.groupBy("n").agg(*(F.max(F.when(F.col("plane") == p, F.col("data"))).alias(f"p{p}") for p in planes))
    parts = int(clip.spark.conf.get("spark.sql.shuffle.partitions"))
    kinds = "part int, first long, frames long, offset long, bytes long"
    rows.repartitionByRange(parts, "n").sortWithinPartitions("n").mapInArrow(run, kinds).write.parquet(f"{path}/index")
    return clip.spark.read.schema(kinds).parquet(f"{path}/index").orderBy("part")


def _filesystem(path: str):
    """(file system, path in it) for local and remote URIs."""
    from pyarrow import fs

    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


#: How the identifiers of Wave64 blocks end, the file's own and the others'. Fixed values.
_W64_FILE = bytes.fromhex("2e91cf11a5d628db04c10000")
_W64_BLOCK = bytes.fromhex("f3acd3118cd100c04f8edb8a")


def write_w64(clip: Audio, out: BinaryIO) -> None:
    """As write_wav, with 64-bit sizes, which count each block's own 24 bytes of identifier and size."""
    total, kind = _wave_format(clip)
    pad = -total % 8
    form = b"fmt " + _W64_BLOCK + struct.pack("<Q", 24 + len(kind)) + kind
    data = b"data" + _W64_BLOCK + struct.pack("<Q", 24 + total)
    out.write(b"riff" + _W64_FILE + struct.pack("<Q", 40 + len(form) + len(data) + total + pad) + b"wave" + _W64_BLOCK + form + data)
    _write_samples(clip, out)
    out.write(bytes(pad))


def _write_samples(clip: Audio, out: BinaryIO) -> None:
    i = clip.info
    size = (i.bits + 7) // 8
    for r in clip.rows.orderBy("s").toLocalIterator(prefetchPartitions=True):
        v = np.asarray(r.v)
        if i.is_float:
            out.write(v.astype("<f4").tobytes())
        elif size == 3:
            out.write(v.astype("<i4").view("u1").reshape(-1, 4)[:, :3].tobytes())
        else:
            out.write(v.astype(f"<i{size}").tobytes())


def timecodes(clip: Clip) -> DataFrame:
    """(n, ms): when each frame begins, from the durations before it. Sums run within blocks, within blocks of
    blocks, and over those."""
    num = F.get(F.col("props").getItem("_DurationNum")["i"], 0)
    den = F.get(F.col("props").getItem("_DurationDen")["i"], 0)
    good = (num > 0) & (den > 0)
    ms = F.when(good, num * 1000.0 / den).otherwise(F.raise_error(F.lit("a frame without a duration")).cast("double"))
    rows = clip.props.select("n", F.floor(F.col("n") / HALO).alias("block"), ms.alias("ms"))
    first = rows.groupBy("block").agg(F.sum("ms").alias("all"))
    second = first.groupBy(F.floor(F.col("block") / HALO).alias("group")).agg(F.sum("all").alias("all"))  # a row for each HALO^2 frames
    earlier = lambda window, c="all": F.coalesce(F.sum(c).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    second = second.select("group", earlier(Window.orderBy("group")).alias("base"))
    first = first.withColumn("group", F.floor(F.col("block") / HALO)).withColumn("own", earlier(Window.partitionBy("group").orderBy("block")))
    starts = first.join(second, "group").select("block", (F.col("base") + F.col("own")).alias("base"))
    placed = rows.withColumn("own", earlier(Window.partitionBy("block").orderBy("n"), "ms"))
    return placed.join(starts, "block").select("n", (F.col("base") + F.col("own")).alias("ms"))


def props_json(clip: Clip) -> DataFrame:
    """(n, json): a frame's properties as an object; one value stands alone, several as a list."""

    def shown(v):
        number = lambda a: F.transform(a, lambda x: x.cast("string"))
        quoted = F.transform(v["d"], lambda x: F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(x, r"\\", r"\\\\\\\\"), '"', r'\\\\"'), F.lit('"')))
        items = F.coalesce(number(v["i"]), number(v["f"]), quoted, F.array().cast("array<string>"))
        return F.when(F.size(items) == 0, "null").when(F.size(items) == 1, F.get(items, 0)).otherwise(F.concat(F.lit("["), F.concat_ws(", ", items), F.lit("]")))

    parts = F.transform(F.array_sort(F.map_keys("props")), lambda k: F.concat(F.lit('"'), k, F.lit('": '), shown(F.element_at("props", k))))
    return clip.props.select("n", F.concat(F.lit("{"), F.concat_ws(", ", parts), F.lit("}")).alias("json"))


def write_parquet(clip: Clip, path: str) -> None:
    """The bulk sink: frames and properties as tables, written by all tasks."""
    clip.frames.write.parquet(f"{path}/frames")
    clip.props.write.parquet(f"{path}/props")
