"""Cost-balanced packing of tokenized documents into sequences of a fixed capacity.

A task packs its documents in groups of about GROUP tokens, in the order it reads them, so nothing
is shuffled and memory is bounded. In a group, whole sequences are cut off documents longer than the
capacity; what is left is taken in descending length, each piece to the sequence of lowest attention
cost (linear in a piece's length plus quadratic in it) that still has room. A piece that fits
nowhere is cut at the widest room. A group opens as few sequences as hold its tokens, so it pads less
than one sequence.

Defined results: null and empty texts are one piece of the end id alone; equal rows are packed each
for itself; a null doc_id stays null; other columns are not read. Sequence ids are unique, and the
same whenever a task runs again over the same split of the input.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import tokens
from tessella.llm import words as W

CAPACITY, END = 4096, 2
GROUP = 1 << 20
LINEAR, QUADRATIC = 1.0, 1.0 / 1024


def pack(sizes: list[int], capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """((document, start, length, sequence, offset) of each piece, number of sequences)."""
    pieces, rest, n = [], [], 0
    for i, size in enumerate(sizes):
        start = 0
        while size - start >= capacity:
            pieces.append((i, start, capacity, n, 0))
            start, n = start + capacity, n + 1
        if size > start:
            rest.append((size - start, i, start))
    rest.sort(key=lambda x: (-x[0], x[1]))
    k = -(-sum(x[0] for x in rest) // capacity)
    load, cost = np.zeros(k, np.int64), np.zeros(k)
    for size, i, start in rest:
        while size:
            fits = load + size <= capacity
            s = int(np.where(fits, cost, np.inf).argmin()) if fits.any() else int(load.argmin())
            part = min(size, capacity - int(load[s]))
            pieces.append((i, start, part, n + s, int(load[s])))
            load[s] += part
            cost[s] += linear * part + quadratic * part * part
            size, start = size - part, start + part
    return pieces, n + k


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, group: int = GROUP, ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset;
    with `ids` also the token ids."""

    def batch_of(held: list[tuple], first: int) -> tuple[pa.RecordBatch, int]:
        found, n = pack([len(x) for _, x in held], capacity)
        cut = [held[i][1][s : s + k] for i, s, k, _, _ in found]
        cols = [
            pa.array([held[i][0] for i, *_ in found], pa.int64()),
            pa.array([s for _, s, *_ in found], pa.int64()),
            pa.array([k for _, _, k, *_ in found], pa.int64()),
            pa.array([zlib.crc32(x.tobytes()) for x in cut], pa.int64()),
            pa.array([len(held[i][1]) for i, *_ in found], pa.int64()),
            pa.array([first + q for *_, q, _ in found], pa.int64()),
            pa.array([o for *_, o in found], pa.int64()),
        ]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        if ids:
            edges = np.concatenate([[0], np.cumsum([len(x) for x in cut])]).astype(np.int32)
            cols.append(pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(cut).view(np.int32))))
            names.append("ids")
        return pa.RecordBatch.from_arrays(cols, names), first + n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        make = tokens.encoder(tokenizer, True)
        first, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in W.slices(batches, limit=tokens.SLICE):
            got, at = make.encode(*W.raw(W.column(batch, "text")), end)
            for doc, a, b in zip(W.column(batch, "doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                held.append((doc, got[a:b]))
                size += b - a
                if size >= group:
                    out, first = batch_of(held, first)
                    yield out
                    held, size = [], 0
        if held:
            yield batch_of(held, first)[0]

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * ids)
