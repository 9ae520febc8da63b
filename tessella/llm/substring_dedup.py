"""Substring deduplication over a log-structured fingerprint index.

A document's windows are its runs of `width` consecutive words. Of each window one k-word
fingerprint is kept, the least of those inside it (a minimiser), so equal windows have equal
fingerprints while only about one word in fourteen yields one. The index is a list of immutable
runs of fingerprints and their documents' bounds, each sorted by fingerprint; a new batch is merge-joined with
the runs, added as a run of its own, and runs of a level are compacted into one of the next.

Fingerprints that two documents share are candidates. They are verified on the texts: every
window at such a fingerprint is hashed again, by word hashes of another seed (so 128 independent
bits tell windows apart), and the smallest document is found for each.
Equal surroundings of a fingerprint are one class, so a group of n copies costs one class and n
short references, never pairs.

Defined results: null and empty texts have no words; a null doc_id is never removed from and is
nobody's earlier document; rows that share a doc_id don't count as earlier than each other;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import words as W

WIDTH, GRAM = 50, 25
_LOW = np.uint64((1 << 31) - 1)  # Arrow strings, and so their words, are fewer


def _minimisers(h: np.ndarray, last: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window starts, where each one's fingerprint starts, fingerprint hashes by word)."""
    grams = W.windows(h, gram)
    span = width - gram + 1
    least = W.sliding_min((grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64), span)
    starts = np.flatnonzero(np.arange(len(least)) + width <= last[: len(least)])
    return starts, (least[starts] & _LOW).astype(np.int64), grams


def _prepared(batch: pa.RecordBatch) -> tuple[W.Words, np.ndarray]:
    got = W.words(*W.raw(W.column(batch, "text")), W.SPACED)
    return got, got.hashes()


def fingerprints(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """(fp, doc_id): the selected fingerprints of each document with a doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches):
            got, h = _prepared(batch)
            _, at, grams = _minimisers(h, got.last(), width, gram)
            at = np.unique(at)
            ids = W.column(batch, "doc_id").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([W.longs(grams[at]), pa.array(ids[got.doc()[at]].astype(np.int64))], ["fp", "doc_id"])

    return _keyed(docs).select("doc_id", "text").mapInArrow(run, "fp long, doc_id long")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).where("doc_id IS NOT NULL")


class FingerprintIndex:
    """Sorted immutable runs of (fp, lo, hi), the smallest and largest document with each fingerprint, under
    one folder, and a manifest for each version. Runs are tables bucketed and sorted by fp, one row for each
    fingerprint, so probing and compaction are merge joins without a shuffle and no fingerprint is a large group.

    A crash between a run's write and its manifest leaves an unlisted run that nothing reads.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, fanout: int = 2):
        self.spark, self.path, self.fanout = spark, path, max(2, fanout)  # one run alone is never merged
        self.version, self.runs = 0, []
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        to = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
        if to.getFileSystem(spark._jsc.hadoopConfiguration()).exists(to):
            held = json.loads(spark.read.text(f"{path}/manifest/*").agg(F.max("value")).head()[0][12:])
            self.version, self.buckets, self.runs = held["version"], held["buckets"], held["runs"]
            for _, name in self.runs:
                spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (fp BIGINT, lo BIGINT, hi BIGINT) USING parquet CLUSTERED BY (fp) SORTED BY (fp) INTO {self.buckets} BUCKETS LOCATION '{path}/{name}'")

    def _commit(self, runs: list[list]) -> None:
        self.version, self.runs = self.version + 1, runs
        line = f"{self.version:012d}{json.dumps({'version': self.version, 'buckets': self.buckets, 'runs': runs})}"
        self.spark.range(1).select(F.lit(line).alias("value")).write.text(f"{self.path}/manifest/{self.version:012d}")

    def _write(self, bounds: DataFrame, level: int) -> list:
        name = f"run_{uuid.uuid4().hex}"
        bounds.write.bucketBy(self.buckets, "fp").sortBy("fp").option("path", f"{self.path}/{name}").saveAsTable(name)
        return [level, name]

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            W.remove(self.spark, f"{self.path}/{name}")

    def append(self, postings: DataFrame) -> DataFrame:
        """Write a batch's postings as a run. Returns (fp): those of its fingerprints that two documents,
        of the batch or of it and an earlier run, share."""
        bounds = postings.groupBy("fp").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
        run = self._write(bounds.repartition(self.buckets, "fp"), 0)
        found = self.spark.table(run[1])
        for _, name in self.runs:
            old = self.spark.table(name).select("fp", F.col("lo").alias("lo_old"), F.col("hi").alias("hi_old"))
            found = found.join(old.hint("merge"), "fp", "left").select("fp", F.least("lo", "lo_old").alias("lo"), F.greatest("hi", "hi_old").alias("hi"))
        self._commit([*self.runs, run])
        return found.where("lo < hi").select("fp")

    def compact(self) -> None:
        """While a level holds `fanout` runs, merge them into one of the next level and drop them."""
        level = 0
        while any(x[0] >= level for x in self.runs):
            full = [x for x in self.runs if x[0] == level]
            if len(full) >= self.fanout:
                merged = self.spark.table(full[0][1])
                for _, name in full[1:]:
                    more = self.spark.table(name).select("fp", F.col("lo").alias("lo_new"), F.col("hi").alias("hi_new"))
                    merged = merged.join(more.hint("merge"), "fp", "full").select("fp", F.least("lo", "lo_new").alias("lo"), F.greatest("hi", "hi_new").alias("hi"))
                run = self._write(merged, level + 1)
                self._commit([*(x for x in self.runs if x not in full), run])
                self._drop([name for _, name in full])
            level += 1

    def drop(self) -> None:
        """Delete the index."""
        self._drop([name for _, name in self.runs])
        self.runs = []
        W.remove(self.spark, self.path)


def _windows_at(live: DataFrame, width: int, gram: int, whole: bool) -> DataFrame:
    """For each run of windows that share a live fingerprint: (fp, cls, doc_id, tx, start, n), with `whole` also the window hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches):
            got, h = _prepared(batch)
            starts, at, grams = _minimisers(h, got.last(), width, gram)
            doc = got.doc()
            fps = W.column(batch, "fps")
            held = np.repeat(np.arange(batch.num_rows, dtype=np.uint64), np.diff(fps.offsets.to_numpy()))
            known = np.unique(fps.flatten().to_numpy().view(np.uint64) + held * W.GOLDEN)
            head = np.ones(len(at), bool)
            head[1:] = at[1:] != at[:-1]
            head = np.flatnonzero(head)
            runs = np.append(head, len(at))
            mine = grams[at[head]] + doc[at[head]].astype(np.uint64) * W.GOLDEN if len(head) else np.zeros(0, np.uint64)
            near = np.minimum(np.searchsorted(known, mine), max(0, len(known) - 1))
            on = known[near] == mine if len(known) else np.zeros(len(mine), bool)
            first, n = head[on], (runs[1:] - runs[:-1])[on]
            take = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
            full = W.windows(got.hashes(1), width)[starts[take]] if len(take) else np.zeros(0, np.uint64)
            edges = np.concatenate([[0], np.cumsum(n)])
            p, s = at[first], starts[first]
            cls = W.mix(np.add.reduceat(W.mix(full + _rank(n) * W.GOLDEN), edges[:-1]) if len(n) else np.zeros(0, np.uint64)) + (p - s).astype(np.uint64)
            ids, tx = (W.column(batch, c).to_numpy() for c in ("doc_id", "tx"))
            d = doc[p] if len(p) else np.zeros(0, np.int64)
            out = [W.longs(grams[p]), W.longs(cls), pa.array(ids[d]), pa.array(tx[d]), pa.array((s - got.first[d]).astype(np.int32)), pa.array(n.astype(np.int32))]
            if whole:
                out = [*out[:3], W.lists(full, edges)]
            yield pa.RecordBatch.from_arrays(out, ["fp", "cls", "doc_id", "h"] if whole else ["fp", "cls", "doc_id", "tx", "start", "n"])

    return live.select("doc_id", "tx", "text", "fps").mapInArrow(run, "fp long, cls long, doc_id long, h array<long>" if whole else "fp long, cls long, doc_id long, tx long, start int, n int")


def _rank(n: np.ndarray) -> np.ndarray:
    """0, 1, .. within each of the runs of n."""
    return (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)).astype(np.uint64)


def repeats(docs: DataFrame, live: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, found): the windows of each document that also start in a smaller one, as a list of
    (tx, start, n, hits); tx tells texts under one doc_id apart, hits null means all n windows.

    live: the fingerprints that several documents share. Windows around one that is alike wherever it occurs
    (one class) are settled by the class's smallest document; where there are more classes, one document of
    each class hashes its windows singly."""
    texts = _keyed(docs).select("doc_id", F.xxhash64("text").alias("tx"), "text")
    held = fingerprints(docs, width, gram).join(live.hint("merge"), "fp", "left_semi").groupBy("doc_id").agg(F.collect_set("fp").alias("fps"))
    mine = _windows_at(texts.join(held.hint("merge"), "doc_id"), width, gram, False)
    classes = mine.groupBy("fp", "cls").agg(F.min("doc_id").alias("lo"))
    kinds = classes.groupBy("fp").agg(F.count(F.lit(1)).alias("kinds"))
    classes = classes.join(kinds.hint("merge"), "fp")
    alone = classes.where("kinds = 1").select("fp", "cls", "lo", F.lit(None).cast("array<struct<at:int,lo:long>>").alias("each"))
    first = classes.where("kinds > 1").groupBy(F.col("lo").alias("doc_id")).agg(F.collect_set("fp").alias("fps"))
    apart = _windows_at(texts.join(first.hint("merge"), "doc_id"), width, gram, True).select("fp", "cls", "doc_id", F.posexplode("h").alias("at", "w"))
    least = apart.groupBy("fp", "w").agg(F.min("doc_id").alias("lo"))
    apart = apart.select("fp", "w", "cls", "at").join(least.hint("merge"), ["fp", "w"])
    apart = apart.groupBy("fp", "cls").agg(F.min("lo").alias("lo"), F.collect_set(F.struct("at", "lo")).alias("each"))
    mine = mine.join(alone.unionByName(apart).hint("merge"), ["fp", "cls"]).where("lo < doc_id")
    hits = F.transform(F.filter("each", lambda x: x["lo"] < F.col("doc_id")), lambda x: x["at"])
    return mine.groupBy("doc_id").agg(F.collect_list(F.struct("tx", "start", "n", hits.alias("hits"))).alias("found"))


def removed(docs: DataFrame, found: DataFrame, width: int = WIDTH, carry: bool = False) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, kept_sha256 and kept, the words left, joined by single
    spaces. With carry: instead row, the other columns, and text, unchanged where nothing was removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches):
            got = W.words(*W.raw(W.column(batch, "text")), W.SPACED)
            drop = np.zeros(len(got) + 1, np.int32)
            tx = W.column(batch, "tx").to_numpy()
            for d, spans in enumerate(W.column(batch, "found")):
                for x in spans.as_py() or ():
                    if x["tx"] == tx[d]:
                        at = got.first[d] + x["start"] + np.asarray(range(x["n"]) if x["hits"] is None else x["hits"], np.int64)
                        np.add.at(drop, at, 1)
                        np.add.at(drop, at + width, -1)
            gone = np.cumsum(drop[:-1]) > 0
            cut = np.diff(np.concatenate([[0], np.cumsum(gone)])[got.first])
            kept = np.flatnonzero(~gone)
            size = got.ends[kept] - got.starts[kept] + 1
            to = np.concatenate([[0], np.cumsum(size)])
            out = np.append(got.data, np.uint8(0))[np.repeat(got.starts[kept] - to[:-1], size) + np.arange(to[-1])]
            out[to[1:] - 1] = 0x20
            edge = to[np.searchsorted(kept, got.first)]
            texts = pa.array([out[a : max(a, b - 1)].tobytes() for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)], pa.binary())
            if carry:
                yield pa.RecordBatch.from_arrays([W.column(batch, "row"), pc.if_else(pa.array(cut > 0), texts.cast(pa.string()), W.column(batch, "text"))], ["row", "text"])
            else:
                sums = pa.array([hashlib.sha256(t).hexdigest() for t in texts.to_pylist()])
                yield pa.RecordBatch.from_arrays([W.column(batch, "doc_id"), pa.array(got.counts), pa.array(cut), sums, texts.cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    more = [W.carried(docs).alias("row")] if carry else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)
    rest = ["row"] if carry else []
    known, nameless = rows.where("doc_id IS NOT NULL"), rows.where("doc_id IS NULL")
    whole = known.select("doc_id", F.xxhash64("text").alias("tx"), "text", *rest).join(found.hint("merge"), "doc_id", "left")
    whole = whole.unionByName(nameless.select("doc_id", F.lit(0).cast("long").alias("tx"), "text", *rest, F.lit(None).cast(found.schema["found"].dataType).alias("found")))
    fields = f"row {rows.schema['row'].dataType.simpleString()}, text string" if carry else "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
    return whole.mapInArrow(run, fields)


def repeated_in(spark: SparkSession, docs: DataFrame, batches: int = 2, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """repeats() for all of docs through a fresh index, in `batches` ranges of doc_id: each batch becomes a run,
    which is merge-joined with the runs before it; runs are compacted; every candidate window is verified."""
    index = FingerprintIndex(spark, W.shared(spark, "fingerprints"), fanout=batches)
    place = W.shared(spark, "repeated")
    cuts = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), [i / batches for i in range(1, batches)], 1000).alias("at")).head()["at"] if batches > 1 else []
    edges = [None, *(cuts or []), None]
    for low, high in zip(edges, edges[1:], strict=False):
        part = docs if low is None else docs.where(F.col("doc_id") > low)
        part = part if high is None else part.where(F.col("doc_id") <= high)
        index.append(fingerprints(part, width, gram)).write.mode("append").parquet(place)
        index.compact()
    index.drop()
    return repeats(docs, spark.read.schema("fp long").parquet(place).distinct(), width, gram)


def dedup_corpus(spark: SparkSession, docs: DataFrame, batches: int = 2, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """All of docs deduplicated; see removed() for the columns."""
    return removed(docs, repeated_in(spark, docs, batches, width, gram), width)


def rewritten(spark: SparkSession, docs: DataFrame, batches: int = 2, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """docs, all columns, with the words left as text where any were removed; n_chars follows the text."""
    out = removed(docs, repeated_in(spark, docs, batches, width, gram), width, carry=True)
    out = W.restored(docs, out, "row", F.col("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def dedup_batch(spark: SparkSession, index: FingerprintIndex, batch: DataFrame, history: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """A new batch against all batches that the index holds. It becomes a run of the index. history: the earlier
    documents, read again only to verify. The batch's documents should have larger ids than those before."""
    place = W.shared(spark, "repeated")
    index.append(fingerprints(batch, width, gram)).write.parquet(place)
    index.compact()
    both = batch.select("doc_id", "text").unionByName(history.select("doc_id", "text"))
    return removed(batch, repeats(both, spark.read.schema("fp long").parquet(place), width, gram), width)
