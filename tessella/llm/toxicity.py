"""Toxicity scores from class-conditional Kneser-Ney models.

Two bigram models, of toxic and of ordinary labelled documents, count as Kneser and Ney do: bigrams by the
different words before them, words by the different words before them, so that copies of a passage add
nothing. All counts are kept. The discounts of counts 1, 2 and 3 or more are estimated from the counts of
counts, for each class and order. The back-off chain is

    class bigrams -> both classes' bigrams -> class words -> the corpus's words,

where the last counts the documents of the whole corpus that hold a word, and each step's weight is what
its discounts left over; so every distribution sums to 1, and a rare expression is judged alike by both
classes unless one really uses it. A word's probability is BIGRAM of the chain from bigrams and the rest
of the chain from words.

A toxic text is ordinary text with a share SHARE of toxic wording, so its model is the mixture of both.
The score is the length-normalised log-likelihood ratio of that mixture to the ordinary model, over the
whole text and over the PASSAGE and the NEAR consecutive words where it is highest (so that a passage
counts wherever it stands in a long text), through a logistic curve fitted on
labelled rows that the counts don't use. A missed toxic document counts as COST false alarms there.

Bounds: at most `per_class` labelled documents of each class, and of these at most SAMPLE_BYTES of text a
class (the first by a hash of doc_id that still have room), are learned from. So the models, which are
made on Spark and broadcast once, have no more than SAMPLE_BYTES bigrams whatever the corpus's size. The
corpus counts stay in a table of all words of all documents, of which the sample's words and the grand
total are read.

Defined results: null and empty texts have ratios of 0; without labelled rows of both classes every score
is 0; several labels of a document count as toxic if one does, null labels and labels of unknown documents
are ignored; of rows that share a labelled doc_id one text is learned from; a null doc_id is not held out;
every row gives a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import words as W

PER_CLASS, SAMPLE_BYTES = 3000, 8 << 20
BITS, CHUNK = 20, 1 << 21
BIGRAM, SHARE, NEAR, PASSAGE, COST, FOLDS = 0.1, 0.003, 4, 64, 3.0, 5
_START = np.uint64(0x5EED)


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def _pair(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return W.mix(word * np.uint64(3) + W.mix(before.copy()))


def _grams(batch: pa.RecordBatch) -> tuple[W.Words, np.ndarray, np.ndarray]:
    """(words, hashes of the words before, hashes of the words), in lower case."""
    data, offsets = W.raw(W.column(batch, "text"))
    got = W.words(W.LOWER[data], offsets, W.ALNUM)
    h = got.hashes()
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[got.first[:-1][got.counts > 0]] = _START
    return got, before, h


def _new(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Where each different h of each text is."""
    order = np.lexsort((h, doc))
    new = np.ones(len(h), bool)
    new[1:] = (doc[order][1:] != doc[order][:-1]) | (h[order][1:] != h[order][:-1])
    return order[new]


def corpus_counts(docs: DataFrame) -> DataFrame:
    """(word, n): how many documents of the corpus hold each word, by its 64-bit hash."""

    def told(parts: list[np.ndarray]) -> pa.RecordBatch:
        word, n = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([W.longs(word), pa.array(n.astype(np.int64))], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in W.slices(batches):
            got, _, h = _grams(batch)
            parts.append(h[_new(got.doc(), h)])
            size += len(parts[-1])
            if size > CHUNK:
                yield told(parts)
                parts, size = [], 0
        if parts:
            yield told(parts)

    return docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Lookup:
    """Values by 64-bit key. A bitmap of low bits keeps most searches away."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.maybe = np.zeros(1 << BITS, bool)
        self.maybe[_slot(keys)] = True

    def put(self, h: np.ndarray, out: np.ndarray) -> np.ndarray:
        """Overwrite out where h is a key; returns where it isn't."""
        held = np.zeros(len(h), bool)
        if len(self.keys):
            at = np.flatnonzero(self.maybe[_slot(h)])
            place = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
            ok = self.keys[place] == h[at]
            out[at[ok]] = self.values[place[ok]]
            held[at[ok]] = True
        return np.flatnonzero(~held)


@dataclass
class Model:
    """What a word adds to the log-likelihood ratio, by the word before it and itself.

    pair: of bigrams seen; head: how a word before changes the ratio of words not seen after it; word: the ratio
    of the classes' probabilities of words seen, for others `unseen`."""

    pair: Lookup
    head: Lookup
    word: Lookup
    unseen: float

    def gains(self, before: np.ndarray, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h))
        new = self.pair.put(_pair(before, h), out)
        ratio, head = np.full(len(new), self.unseen), np.ones(len(new))
        self.word.put(h[new], ratio)
        self.head.put(before[new], head)
        out[new] = np.log1p(SHARE * (ratio * head - 1))
        return out

    def features(self, batch: pa.RecordBatch) -> np.ndarray:
        """(1, mean gain of the text, the highest of PASSAGE and of NEAR words in a row) of each text."""
        got, before, h = _grams(batch)
        total = np.concatenate([[0.0], np.cumsum(self.gains(before, h))])
        n, doc = got.counts, got.doc()
        whole = total[got.first[1:]] - total[got.first[:-1]]

        def highest(width: int) -> np.ndarray:
            best = whole / width
            if len(h) >= width:
                near = (total[width:] - total[:-width]) / width
                at = np.flatnonzero(doc[: len(near)] == doc[width - 1 :])
                own = doc[at]
                head = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else own
                if len(head):
                    best[own[head]] = np.maximum.reduceat(near[at], head)
            return best

        return np.stack([np.ones(len(n)), whole / (n + 2 * NEAR), highest(PASSAGE), highest(NEAR)], 1)  # a few words prove little

    def score(self, batch: pa.RecordBatch, weights: np.ndarray | None) -> np.ndarray:
        if weights is None:
            return np.zeros(batch.num_rows)
        return 1 / (1 + np.exp(-np.clip(self.features(batch) @ weights, -30, 30)))


def discounts(counts: dict[int, int]) -> tuple[float, float, float]:
    """Discounts of the counts 1, 2 and 3 or more, by how many grams have the counts 1 to 4."""
    n1, n2, n3, n4 = (counts.get(i, 0) for i in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    found = (1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(x, 0.1), float(i)) for i, x in zip((1, 2, 3), found, strict=True))


def probabilities(grams: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, tuple[float, float]]:
    """The two models as tables: words (word, p0, p1), heads (before, b0, b1), pairs (before, word, p0, p1) and the
    weights that corpus shares have in either class's words. 0 is toxic, 1 ordinary.

    grams: the different (c, first, before, word); counts: corpus_counts(). A word w that isn't seen after a head h
    has probability b * p(w), and one that is in no class the weight times its corpus share."""
    zero = F.lit(0).cast("long")
    two = grams.groupBy("before", "word").agg(*(F.sum(F.when(F.col("c") == c, 1).otherwise(zero)).alias(f"n{c}") for c in (0, 1)))
    two = two.withColumn("n2", F.col("n0") + F.col("n1")).checkpoint()
    one = two.groupBy("word").agg(*(F.sum((F.col(f"n{c}") > 0).cast("long")).alias(f"n{c}") for c in (0, 1)))
    level = lambda df, names: df.select(F.explode(F.array(*(F.struct(F.lit(n).alias("of"), F.least(F.col(n), F.lit(5)).alias("n")) for n in names))).alias("x")).select("x.*").groupBy("of", "n").agg(F.count(F.lit(1)).alias("k")).collect()
    cut: dict[str, tuple[float, float, float]] = {}
    for name, rows in (("w", level(one, ("n0", "n1"))), ("b", level(two, ("n0", "n1", "n2")))):  # at most 5 rows for each count
        for n in {r.of for r in rows}:
            cut[name + n[1]] = discounts({r.n: r.k for r in rows if r.of == n})

    def taken(name: str, n: str) -> Column:
        d = cut[name]
        return F.when(F.col(n) <= 0, 0.0).when(F.col(n) == 1, d[0]).when(F.col(n) == 2, d[1]).otherwise(d[2])

    sums = one.agg(*(F.sum(f"n{c}").alias(f"n{c}") for c in (0, 1)), *(F.sum(taken(f"w{c}", f"n{c}")).alias(f"d{c}") for c in (0, 1))).head()
    total = counts.agg(F.sum("n")).head()[0] or 1
    back = tuple(sums[f"d{c}"] / sums[f"n{c}"] for c in (0, 1))
    share = F.coalesce(F.col("n"), F.lit(0)) / F.lit(float(total))
    of = lambda c: (F.col(f"n{c}") - taken(f"w{c}", f"n{c}")) / F.lit(float(sums[f"n{c}"])) + F.lit(back[c]) * share
    words = one.join(counts, "word", "left").select("word", *(of(c).alias(f"p{c}") for c in (0, 1))).checkpoint()
    heads = two.groupBy("before").agg(*(F.sum(f"n{k}").alias(f"s{k}") for k in (0, 1, 2)), *(F.sum(taken(f"b{k}", f"n{k}")).alias(f"d{k}") for k in (0, 1, 2)))
    left = lambda k: F.when(F.col(f"s{k}") > 0, F.col(f"d{k}") / F.col(f"s{k}")).otherwise(1.0)
    heads = heads.select("before", *(f"s{k}" for k in (0, 1, 2)), *(left(k).alias(f"l{k}") for k in (0, 1, 2)))
    kept = lambda k: F.when(F.col(f"s{k}") > 0, (F.col(f"n{k}") - taken(f"b{k}", f"n{k}")) / F.col(f"s{k}")).otherwise(0.0)
    chain = lambda c: F.lit(BIGRAM) * (kept(c) + F.col(f"l{c}") * (kept(2) + F.col("l2") * F.col(f"p{c}"))) + F.lit(1 - BIGRAM) * F.col(f"p{c}")
    pairs = two.join(heads, "before").join(words, "word").select("before", "word", *(chain(c).alias(f"p{c}") for c in (0, 1)))
    heads = heads.select("before", *((F.lit(1 - BIGRAM) + F.lit(BIGRAM) * F.col(f"l{c}") * F.col("l2")).alias(f"b{c}") for c in (0, 1)))
    return words, heads, pairs, back


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0, F.lit(False))


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, sample_bytes: int = SAMPLE_BYTES) -> tuple[Broadcast | None, np.ndarray | None]:
    """(the broadcast Model, its curve's weights), fitted on labelled rows that aren't held out, or nothing;
    three of four give counts, the fourth the curve."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    found = {r.toxic > 0: r.n for r in known.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    nothing = None, None
    if not (found.get(True) and found.get(False)):
        return nothing
    key = F.xxhash64("doc_id", F.lit(5))
    pick = lambda cond: known.where(cond).orderBy(key, "doc_id").limit(per_class)
    chosen = pick("toxic > 0").unionByName(pick("toxic <= 0")).select(F.col("doc_id").alias("chosen"), (F.col("toxic") > 0).alias("toxic"))
    W.shared(spark, "")  # sees to a checkpoint folder
    text = F.coalesce("text", F.lit(""))
    # at most 2 * per_class ids: a proven bound for the broadcast, for the groups and for the list of sizes
    rows = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("chosen")).groupBy("chosen", "toxic").agg(F.min_by(text, F.xxhash64(text)).alias("text")).checkpoint()
    room, fits = {True: sample_bytes, False: sample_bytes}, []
    for r in rows.select("chosen", "toxic", F.octet_length("text").alias("size")).orderBy(F.xxhash64("chosen", F.lit(5)), "chosen").collect():
        if r.size <= room[r.toxic]:
            room[r.toxic] -= r.size
            fits.append(r.chosen)
    if not fits:
        return nothing
    rows = rows.join(F.broadcast(spark.createDataFrame([(x,) for x in fits], "chosen long")), "chosen", "left_semi")
    rows = rows.select("toxic", "text", (F.pmod(F.xxhash64("chosen", F.lit(6)), F.lit(4)) == 0).alias("curve"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, limit=W.SLICE_BYTES // 2):
            got, before, h = _grams(batch)
            first = np.empty_like(before)
            first[1:] = before[:-1]
            first[got.first[:-1][got.counts > 0]] = _START
            at = _new(got.doc(), _pair(first, _pair(before, h)))
            toxic = W.column(batch, "toxic").to_numpy(zero_copy_only=False).astype(bool)[got.doc()[at]]
            yield pa.RecordBatch.from_arrays([pa.array((~toxic).astype(np.int32)), W.longs(first[at]), W.longs(before[at]), W.longs(h[at])], ["c", "first", "before", "word"])

    grams = rows.where("NOT curve").select("toxic", "text").distinct().mapInArrow(counted, "c int, first long, before long, word long").distinct().checkpoint()
    if grams.select("c").distinct().count() < 2:
        return nothing
    words, heads, pairs, back = probabilities(grams, corpus_counts(docs).checkpoint())
    gain = F.log1p(F.lit(SHARE) * (F.col("p0") / F.col("p1") - 1)).cast("float")
    held = spark.sparkContext.broadcast(
        Model(
            _lookup(pairs.mapInArrow(_paired, "k long, p0 double, p1 double").select("k", gain.alias("v"))),
            _lookup(heads.select(F.col("before").alias("k"), (F.col("b0") / F.col("b1")).cast("float").alias("v"))),
            _lookup(words.select(F.col("word").alias("k"), (F.col("p0") / F.col("p1")).cast("float").alias("v"))),
            back[0] / back[1],
        )
    )
    y, x = _featured(rows.where("curve").select("toxic", "text"), held)
    if not 0 < y.sum() < len(y):
        return nothing
    weight = np.where(y > 0, COST * found[True] / y.sum(), found[False] / (1 - y).sum())
    scale = np.append(1.0, np.maximum(x[:, 1:].std(axis=0), 1e-12))
    return held, fit_logistic(x / scale, y, weight * len(y) / weight.sum())[0] / scale


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key = _pair(*(W.column(batch, c).to_numpy().view(np.uint64) for c in ("before", "word")))
        yield pa.RecordBatch.from_arrays([W.longs(key), W.column(batch, "p0"), W.column(batch, "p1")], ["k", "p0", "p1"])


def _lookup(table: DataFrame) -> Lookup:
    got = table.toArrow()
    return Lookup(got["k"].to_numpy().view(np.uint64), got["v"].to_numpy())


def _featured(rows: DataFrame, held) -> tuple[np.ndarray, np.ndarray]:
    """(toxic, features) of labelled rows; held: a broadcast Model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches):
            x = held.value.features(batch)
            yield pa.RecordBatch.from_arrays([W.column(batch, "toxic"), W.lists(x.ravel(), np.arange(len(x) + 1) * x.shape[1]).cast(pa.list_(pa.int64()))], ["toxic", "x"])

    got = rows.mapInArrow(run, "toxic boolean, x array<long>").toArrow()
    y = got["toxic"].to_numpy().astype(float)
    return y, np.array(got["x"].to_pylist(), np.int64).view(np.float64).reshape(len(y), -1) if len(y) else np.zeros((0, 0))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> tuple[np.ndarray, float]:
    """(weights, loss) of a weighted logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (y - p)) - ridge * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        w += step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), 1e-9, 1 - 1e-9)
    return w, float(-(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() + ridge / 2 * (w @ w))


def scored(docs: DataFrame, held: Broadcast | None, weights: np.ndarray | None, column: str = "toxicity") -> DataFrame:
    """docs with a score of 0 to 1 by what train() gives."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches):
            score = held.value.score(batch, weights) if held else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*names, column])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, `{column}` double")


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs."""
    out = scored(docs.select("doc_id", "text"), *train(spark, docs, labels, per_class, sample_bytes), "score")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, sample_bytes: int = SAMPLE_BYTES, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, that score below the threshold."""
    score = W.free(docs.columns, "score")
    return scored(docs, *train(spark, docs, labels, per_class, sample_bytes), score).where(F.col(score) < threshold).drop(score)
