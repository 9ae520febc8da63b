"""Arrow-batch text helpers shared by the operators: words, hashes and windows as numpy arrays.

Everything here works on one bounded slice of an Arrow batch inside a Spark task; the
operators decide how rows are dealt out. Null texts count as empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_P = 0xD6E8FEB86659FD93
_Q = 0xA0761D6478BD642F
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: True for bytes of the words [^\x20\x09-\x0D]+
SPACED = ~_WHITE
#: True for bytes of the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (after A-Z became a-z)
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Words longer than this are hashed one by one.
LONG = 512


def _chunks(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number; zeros follow the end."""
    return np.ndarray(len(data) + 1, "<u8", np.append(data, np.zeros(9, np.uint8)), strides=(1,))


_TAIL = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each data[starts:ends]: eight bytes after another go through a mixer. Hashes of
    different seeds are independent of each other."""
    size = ends - starts
    step = np.uint64((_P, _Q)[seed])
    h = mix(size.astype(np.uint64) * step + np.uint64(seed))
    whole = _chunks(data)
    live, at = np.flatnonzero((size > 0) & (size <= LONG)), 0
    while len(live):
        x = whole[starts[live] + at]
        left = size[live] - at
        if (left < 8).any():
            x &= _TAIL[np.minimum(left, 8)]
        h[live] = mix(h[live] * step + x)
        live, at = live[left > 8], at + 8
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8, salt=bytes([seed])).digest(), "little")
    return h


def same_bytes(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether a[at:at+size] equals b[bt:bt+size], for each i."""
    out, x, y = np.ones(len(size), bool), _chunks(a), _chunks(b)
    live, k = np.flatnonzero((size > 0) & (size <= LONG)), 0
    while len(live):
        left = size[live] - k
        out[live] &= (x[at[live] + k] ^ y[bt[live] + k]) & _TAIL[np.minimum(left, 8)] == 0
        live, k = live[left > 8], k + 8
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = np.array_equal(a[at[i] : at[i] + size[i]], b[bt[i] : bt[i] + size[i]])
    return out


@dataclass
class Words:
    """Words of several texts; word i is data[starts[i]:ends[i]], text d has words first[d]:first[d+1]."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def last(self) -> np.ndarray:
        """For each word, where its text's words end."""
        return np.repeat(self.first[1:], self.counts)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return hashed(self.data, self.starts, self.ends, seed)

    def text(self, i: int, j: int) -> bytes:
        """Words i to j joined by single spaces."""
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(self.starts[i:j].tolist(), self.ends[i:j].tolist(), strict=True))


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Words:
    """Maximal runs of bytes that table marks, never across two texts."""
    inside = table[data]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edge = offsets[offsets < len(data)]
    begin[edge] = inside[edge]
    edge = offsets[offsets > 0] - 1
    end[edge] = inside[edge]
    starts = np.flatnonzero(begin)
    return Words(data, offsets, starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive word hashes, for each start (over text borders too), by halves."""
    n = len(h) - k + 1
    if n < 1 or k < 1:
        return np.zeros(0, np.uint64)
    span, done, out = 1, 0, None
    while True:
        if k & span:
            part = h[done : done + n]
            out = part.copy() if out is None else mix(out * np.uint64(_P) + part)
            done += span
        if done == k:
            return mix(out + np.uint64(k))
        h, span = mix(h[:-span] * np.uint64(_Q) + h[span:]), 2 * span


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive values."""
    n = len(x)
    if n < w:
        return x[:0]
    pad = -n % w
    y = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(y, axis=1).ravel()
    back = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string array; null is empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, at, data = texts.buffers()
    if not len(texts) or at is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about `limit` bytes of text; one longer text is a piece of its own."""
    for batch in batches:
        offsets = raw(column(batch, text))[1]
        at, n = 0, batch.num_rows
        while at < n:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, min(to, n) - at)
            at = min(to, n)


def longs(x: np.ndarray) -> pa.Array:
    """An int64 array over the same bits."""
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def lists(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    """list<int64>: values[offsets[i]:offsets[i+1]]."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), longs(values))


def shared(spark, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir, set here only if unset)."""
    import tempfile
    import uuid

    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        held = spark.sparkContext.getCheckpointDir()
        if not held:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessella-"))
            held = spark.sparkContext.getCheckpointDir()
        top = held
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(top)
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: For Python workers: large arrays go back to the system when they are freed, not when the worker ends.
LEAN = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(16 << 20)}


def small_batches(spark, rows: int = 1000) -> None:
    """Arrow batches of at most so many rows and 8 MB: by default they hold ten thousand, and texts may be long.
    Python workers that start from now on are LEAN."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    for name, value in LEAN.items():
        spark.sparkContext.environment.setdefault(name, value)


def free(columns: list[str], name: str) -> str:
    """A name that none of the columns has (Spark doesn't tell case apart)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def carried(docs):
    """A struct of all of docs' columns but text, and whether text is null, to go through an operator whole."""
    from pyspark.sql import functions as F

    return F.struct(F.col("text").isNull().alias(free(docs.columns, "is_null")), *(F.col(f"`{c}`") for c in docs.columns if c != "text"))


def restored(docs, rows, row: str, text):
    """Rows with a carried struct `row` back in the columns of docs; text: the column that takes text's place."""
    from pyspark.sql import functions as F

    missing = F.col(row).getField(free(docs.columns, "is_null"))
    return rows.select(*(F.when(missing & (text == ""), None).otherwise(text).alias(c) if c == "text" else F.col(row).getField(c).alias(c) for c in docs.columns))


def remove(spark, path: str) -> None:
    """Delete a folder of the shared file system."""
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    to.getFileSystem(spark._jsc.hadoopConfiguration()).delete(to, True)
