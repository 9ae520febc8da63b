"""Benchmark decontamination by a prefix-filtered containment join.

An item's windows are its runs of 13 consecutive words (an item of fewer words is one window).
A window's set is its shingles; all of them must occur in a document that contains the window, so
the necessary prefix is one shingle, and the rarest by document frequency over the whole corpus is
joined. A shingle found in a document fixes where the window would lie: it must fit between the
text's first and last word (length and positional bounds), and then all of the window's words are
compared byte for byte.

Benchmarks are taken in blocks of a bounded number of words, each one a stated query set that is
broadcast and run against all documents, which pass through the blocks one after another in a single
reading; documents are neither shuffled nor paired.

Defined results: null and empty texts have no words and are never hit; items without words have no
windows; null item ids are written as the string "null"; every row of docs gives a row, repeated
ones too; other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import words as W

WINDOW, SHINGLE = 13, 5
#: At most about so many benchmark words are broadcast at a time.
BLOCK_WORDS = 2_000_000


def _prepared(texts: pa.Array) -> tuple[W.Words, np.ndarray]:
    data, offsets = W.raw(texts)
    got = W.words(W.LOWER[data], offsets, W.ALNUM)
    return got, got.hashes()


class Block:
    """The windows of some items: their words, shingles and, once chosen, each one's prefix shingle."""

    def __init__(self, items: list[tuple], window: int = WINDOW, shingle: int = SHINGLE):
        got, h = _prepared(pa.array([t for _, t in items], pa.string()))
        self.text, self.items, self.n = [], [], []
        at: dict[bytes, int] = {}
        by_size: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
        for i, (item, _) in enumerate(items):
            a, b = int(got.first[i]), int(got.first[i + 1])
            n = min(window, b - a)
            k = min(shingle, n)
            grams = W.windows(h[a:b], k) if n else h[:0]
            for s in range(a, b - n + 1 if n else a):
                text = got.text(s, s + n)
                if text not in at:
                    at[text] = len(self.text)
                    self.text.append(text)
                    self.items.append(set())
                    self.n.append(n)
                    by_size[k].append((at[text], grams[s - a : s - a + n - k + 1]))
                self.items[at[text]].add("null" if item is None else str(item))
        self.by_size = {k: ([w for w, _ in x], [g for _, g in x]) for k, x in by_size.items()}
        self.shingles = {k: np.unique(np.concatenate(g)) for k, (_, g) in self.by_size.items()}
        self.prefix: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def choose(self, frequency: dict[tuple[int, int], int]) -> None:
        """Order each window's shingles by rarity and keep the first, with its place in the window."""
        for k, (ids, grams) in self.by_size.items():
            held, place = [], []
            for g in grams:
                order = min(range(len(g)), key=lambda j: (frequency.get((k, int(g[j])), 0), int(g[j]), j))  # noqa: B023
                held.append(g[order])
                place.append(order)
            held, place, ids = np.array(held, np.uint64), np.array(place), np.array(ids)
            order = np.argsort(held, kind="stable")
            self.prefix[k] = held[order], ids[order], place[order]


def _within(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Places in x whose values are in sorted_; a bitmap over low bits drops most without a search."""
    bits = np.zeros(1 << 20, bool)
    bits[(sorted_ & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
    maybe = np.flatnonzero(bits[(x & np.uint64((1 << 20) - 1)).astype(np.int64)])
    at = np.searchsorted(sorted_, x[maybe])
    return maybe[sorted_[np.minimum(at, len(sorted_) - 1)] == x[maybe]]


def _frequencies(docs: DataFrame, block) -> dict[tuple[int, int], int]:
    """In how many documents each of the block's shingles occurs, counted over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = block.value.shingles
        count = {k: np.zeros(len(x), np.int64) for k, x in held.items()}
        for batch in W.slices(batches):
            got, h = _prepared(W.column(batch, "text"))
            doc, last = got.doc(), got.last()
            for k, known in held.items():
                grams = W.windows(h, k)
                at = _within(known, grams)
                at = at[at + k <= last[at]]
                pairs = np.unique(doc[at] * len(known) + np.searchsorted(known, grams[at]))
                count[k] += np.bincount(pairs % len(known), minlength=len(known))
        for k, known in held.items():
            some = count[k] > 0
            yield pa.RecordBatch.from_arrays([pa.array(np.full(some.sum(), k, np.int32)), W.longs(known[some]), pa.array(count[k][some])], ["k", "shingle", "n"])

    counted = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "k int, shingle long, n long").groupBy("k", "shingle").agg(F.sum("n").alias("n"))
    return {(r.k, r.shingle % (1 << 64)): r.n for r in counted.collect()}


def _contained(rows: DataFrame, block) -> DataFrame:
    """(row, text, n_words, spans list of (start, end) words, items) of each row, with what one block adds to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        for batch in W.slices(batches):
            got, h = _prepared(W.column(batch, "text"))
            doc, last = got.doc(), got.last()
            spans: dict[int, set] = defaultdict(set, {d: {(x["s"], x["e"]) for x in held} for d, held in enumerate(W.column(batch, "spans").to_pylist()) if held})
            items: dict[int, set] = defaultdict(set, {d: set(held) for d, held in enumerate(W.column(batch, "items").to_pylist()) if held})
            for k, (known, ids, places) in b.prefix.items():
                grams = W.windows(h, k)
                at = _within(known, grams)
                at = at[at + k <= last[at]]
                low, high = (np.searchsorted(known, grams[at], side) for side in ("left", "right"))
                for p, i, j in zip(at.tolist(), low.tolist(), high.tolist(), strict=True):
                    d = int(doc[p])
                    for x in range(i, j):
                        s = p - int(places[x])
                        e = s + b.n[ids[x]]
                        if s >= got.first[d] and e <= got.first[d + 1] and got.text(s, e) == b.text[ids[x]]:
                            spans[d].add((s - int(got.first[d]), e - int(got.first[d])))
                            items[d] |= b.items[ids[x]]
            yield pa.RecordBatch.from_arrays(
                [
                    *(W.column(batch, c) for c in ("row", "text")),
                    pa.array(got.counts),
                    pa.array([[{"s": s, "e": e} for s, e in sorted(spans.get(d, ()))] for d in range(batch.num_rows)], pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))),
                    pa.array([sorted(items.get(d, ())) for d in range(batch.num_rows)], pa.list_(pa.string())),
                ],
                ["row", "text", "n_words", "spans", "items"],
            )

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, text string, n_words long, spans array<struct<s:int,e:int>>, items array<string>")


def _covered(spans: str = "spans") -> F.Column:
    """Words in the union of sorted spans."""
    step = lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], acc["to"]))).alias("n"), F.greatest(acc["to"], x["e"]).alias("to"))
    return F.aggregate(spans, F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")), step)["n"].cast("long")


def blocks(spark: SparkSession, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block_words: int = BLOCK_WORDS) -> Iterator[Block]:
    """The benchmark in parts of about block_words words each, dealt by a hash of the text."""
    sized = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    total = sized.agg(F.sum(F.size(F.split("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")))).head()[0] or 0
    n = max(1, -(-total // block_words))
    for i in range(n):
        yield Block([tuple(r) for r in sized.where(F.pmod(F.xxhash64("text"), F.lit(n)) == i).distinct().collect()], window, shingle)


def contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(row, text, n_words, spans, items, n_hit, contaminated) for each row of docs; row: its other columns."""
    found = {"spans": "array<struct<s:int,e:int>>", "items": "array<string>"}
    out = docs.select(W.carried(docs).alias("row"), F.coalesce("text", F.lit("")).alias("text"), *(F.array().cast(kind).alias(name) for name, kind in found.items()))
    for block in blocks(spark, benchmark, window, shingle, block_words):
        block.choose(_frequencies(docs, spark.sparkContext.broadcast(block)))
        out = _contained(out, spark.sparkContext.broadcast(block))
    out = out.withColumn("n_hit", _covered())
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def without_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """The rows of docs, all columns, that aren't contaminated."""
    found = contamination(spark, docs, benchmark, window, shingle)
    return W.restored(docs, found.where("NOT contaminated"), "row", F.col("text"))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns."""
    return found.select(F.col("row.doc_id").cast("long").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


