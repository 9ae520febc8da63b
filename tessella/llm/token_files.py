"""Token ids in files of length-delimited records, with a separate offset index for shuffled reads.

Documents are range-partitioned by doc_id and, so that rows which share one spread too, a hash of the
text, and sorted; each task writes one file. A record is an
8-byte length, the masked CRC-32 of those bytes, the payload, and the payload's masked CRC-32, all
little-endian. A payload is a byte that says whether the doc_id is null, the doc_id (8 bytes), the
width of an id in bytes (1) and the ids. A CRC is masked (rotated right by 15 bits, plus a constant)
so that records which hold checksums don't check by accident.

Files go to the folder that all executors share, under a name of the attempt until they are whole,
so a task that runs again leaves the same file. The index is a Parquet table: part, record, doc_id,
offset and size in the file, ids, and ids before it in the part.

Defined results: null and empty texts have the end id alone; a null doc_id comes first; equal
doc_ids stand side by side, ordered by a hash of the text, then by text; an empty table gives no records; a record whose
checksums don't match stops the read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm import tokens
from tessella.llm import words as W

END = 2
_MASK = 0xA282EAD8


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + _MASK) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    payload = struct.pack("<?qB", doc_id is None, doc_id or 0, width) + ids.astype(f"<u{width}").tobytes()
    head = struct.pack("<Q", len(payload))
    return head + struct.pack("<I", masked(head)) + payload + struct.pack("<I", masked(payload))


def unframe(record: bytes) -> tuple[int | None, np.ndarray]:
    """(doc_id, uint32 ids) of a whole record."""
    head, check, payload = record[:8], *struct.unpack("<I", record[8:12]), record[12:-4]
    if masked(head) != check or struct.unpack("<Q", head)[0] != len(payload) or masked(payload) != struct.unpack("<I", record[-4:])[0]:
        raise ValueError("a damaged record")
    null, doc_id, width = struct.unpack("<?qB", payload[:10])
    return (None if null else doc_id), np.frombuffer(payload, f"<u{width}", offset=10).astype(np.uint32)


def _filesystem(path: str):
    """(file system, path in it) for local and remote URIs."""
    from pyarrow import fs

    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def write(spark: SparkSession, docs: DataFrame, tokenizer: str, path: str, end: int = END) -> None:
    """Write docs to path/part-*.bin and path/index, in ascending doc_id order."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        part, store, at, before = task.partitionId(), None, 0, 0
        make = tokens.encoder(tokenizer)
        width = 2 if make.tokenizer.get_vocab_size() <= 1 << 16 else 4
        files, top = _filesystem(path)
        final, own = f"{top}/part-{part:06d}.bin", f"{top}/_attempt-{part:06d}-{task.taskAttemptId()}"
        record = 0
        for batch in W.slices(batches, limit=tokens.SLICE):
            if store is None:
                files.create_dir(top, recursive=True)
                store = files.open_output_stream(own)
            ids, edge = make.encode(*W.raw(W.column(batch, "text")), end)
            sizes, rows = [], W.column(batch, "doc_id").to_pylist()
            for doc, a, b in zip(rows, edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                data = frame(doc, ids[a:b], width)
                store.write(data)
                sizes.append(len(data))
            size, n = np.array(sizes, np.int64), np.diff(edge).astype(np.int64)
            k = len(sizes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(k, part, np.int32)), pa.array(record + np.arange(k)), W.column(batch, "doc_id"), pa.array(at + np.cumsum(size) - size), pa.array(size), pa.array(n), pa.array(before + np.cumsum(n) - n)],
                ["part", "record", "doc_id", "offset", "size", "n_tokens", "before"],
            )
            at, before, record = at + int(size.sum()), before + int(n.sum()), record + k
        if store is not None:
            store.close()
            files.move(own, final)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tx", F.xxhash64("text"))
    ordered = rows.repartitionByRange(parts, "doc_id", "tx").sortWithinPartitions("doc_id", "tx", "text").select("doc_id", "text")
    ordered.mapInArrow(run, "part int, record long, doc_id long, offset long, size long, n_tokens long, before long").write.parquet(f"{path}/index")


def read(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """A row per record, read from the files by the index: doc_id, start, n_tokens, ids_crc32, and with
    `ids` the ids. Index rows may be filtered or shuffled before; each is one seek."""
    index = spark.read.schema("part int, record long, doc_id long, offset long, size long, n_tokens long, before long").parquet(f"{path}/index")
    # a row for each file
    sums = index.groupBy("part").agg(F.sum("n_tokens").alias("n")).select(F.col("part").alias("of"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = _filesystem(path)
        part, store = None, None
        for batch in batches:
            out = []
            for p, at, size in zip(*(W.column(batch, k).to_pylist() for k in ("part", "offset", "size")), strict=True):
                if p != part:
                    part, store = p, files.open_input_file(f"{top}/part-{p:06d}.bin")
                out.append(unframe(store.read_at(size, at)))
            starts = W.column(batch, "start")
            cols = [pa.array([d for d, _ in out], pa.int64()), starts, pa.array([len(x) for _, x in out], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for _, x in out], pa.int64())]
            if ids:
                cols.append(pa.array([x.astype(np.int64) for _, x in out], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    placed = index.join(sums, F.col("part") == F.col("of")).select("part", "offset", "size", (F.col("base") + F.col("before")).alias("start"))
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids)
