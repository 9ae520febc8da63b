"""Exact Jaccard self-join of word n-gram sets with token-combination prefixes.

A document's tokens are its distinct shingles. All sets are ordered alike: rare tokens by hash,
then frequent ones by hash. Sets with Jaccard >= 4/5 share a token among their first
n - ceil(4n/5) + 1. Rare tokens of that prefix are indexed singly. If the first shared token is a
frequent one, then all shared tokens are, and of the neighbours in the frequent part at most
|x-y| + |y-x| are torn apart, so some two neighbours are shared within the first
floor(2n/5) - 2r + 2 frequent tokens (r rare ones before them): that extended prefix is indexed by
combinations of two neighbours, and only in sets with fewer rare tokens than the prefix is long.
"Frequent" is a bounded set of tokens that many documents hold by counts over all of them; any
choice of that set gives the same links.

Equal sets are one class. In each posting list all classes are first paired with one hub: the class with
the least share of rare tokens, which is the likeliest middle of a family of near copies. Only lists whose
classes are then still in different components give more pairs: short lists all those between components,
long ones with other hubs in further rounds, and what is left all pairs between components at last. Lists
carry each class's size and number of rare tokens, which bound what two of them can share (positional bound),
so most pairs that can't link are never formed; others are cut by a parity sketch (its differing bits never exceed the sets' symmetric difference), and the rest
verified on the whole texts, by word hashes of another seed than the ones that found them.

The texts are read three times and, for those to verify, once a round: rows, sizes, classes and sketches are
kept in one table. Documents to verify are broadcast by their keys up to FEW, beyond that joined by a shuffle;
the result is the same.

Defined results: null, empty and all-space texts have no shingles and link with nothing; equal
rows are linked; rows with a null doc_id take part, and get a null component only if nothing with
an id is reachable; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import words as W

GRAM = 5
#: A posting list up to this long may give all its pairs; a token in more documents counts as frequent.
SHORT = 32
#: The documents to verify are broadcast (as two longs each) up to so many, else joined by a shuffle.
FEW = 1 << 16
#: At most so many tokens are frequent (the commonest); this bounds what is broadcast.
MOST_FREQUENT = 1 << 16
LOCAL = 4
FLUSH = 1 << 19


def shingle_sets(texts: pa.Array, gram: int = GRAM, seed: int = 0) -> list[np.ndarray]:
    """Each text's distinct shingles as a sorted array of 64-bit hashes."""
    data, offsets = W.raw(texts)
    got = W.words(W.LOWER[data], offsets, W.SPACED)
    h = got.hashes(seed)
    grams = W.windows(h, gram)
    out = []
    for a, b in zip(got.first[:-1].tolist(), got.first[1:].tolist(), strict=True):
        if b - a >= gram:
            u = np.sort(grams[a : b - gram + 1])
            keep = np.ones(len(u), bool)
            np.not_equal(u[1:], u[:-1], out=keep[1:])
            out.append(u[keep])
        else:
            out.append(W.windows(h[a:b], b - a)[:1] if b > a else h[:0])
    return out


def set_key(tokens: np.ndarray) -> int:
    """A 64-bit digest of a set."""
    total = int(np.add.reduce(W.mix(tokens))) + len(tokens) * int(W.GOLDEN)
    return int(W.mix(np.array([total % (1 << 64)], np.uint64))[0].view(np.int64))


def _sketch(tokens: np.ndarray) -> bytes:
    """Which of as many bits as tokens, at least, an odd number of them falls on."""
    bits = 1 << max(8, min(16, (len(tokens) - 1).bit_length()))
    odd = np.bincount((W.mix(tokens) >> np.uint64(40)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _apart(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """In how many bits sketches differ, the longer one folded to the shorter one's bits."""
    out = np.zeros(len(a), np.int64)
    sizes = np.array([[len(x), len(y)] for x, y in zip(a, b, strict=True)], np.int64).reshape(-1, 2)
    for pair in np.unique(sizes, axis=0):
        at = np.flatnonzero((sizes == pair).all(axis=1))
        least = int(pair.min())
        both = [np.bitwise_xor.reduce(np.frombuffer(b"".join(x[i] for i in at), np.uint64).reshape(len(at), -1, least // 8), axis=1) for x in (a, b)]
        out[at] = np.bitwise_count(both[0] ^ both[1]).sum(axis=1, dtype=np.int64)
    return out


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tx"), text.alias("text"))


def keyed(docs: DataFrame, gram: int = GRAM) -> DataFrame:
    """(doc_id, tx, n, cls, sketch): set size and class of each row; cls is null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches):
            sets = shingle_sets(W.column(batch, "text"), gram)
            cols = [W.column(batch, "doc_id"), W.column(batch, "tx"), pa.array([len(u) for u in sets], pa.int64()), pa.array([set_key(u) if len(u) else None for u in sets], pa.int64()), pa.array([_sketch(u) for u in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "tx", "n", "cls", "sketch"])

    return _rows(docs).mapInArrow(run, "doc_id long, tx long, n long, cls long, sketch binary")


def frequent_tokens(docs: DataFrame, gram: int = GRAM) -> np.ndarray:
    """Tokens in at least SHORT different sets, by counts of LOCAL and more in what one task holds at a time; sorted."""

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        u, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([W.longs(u[n >= LOCAL]), pa.array(n[n >= LOCAL].astype(np.int64))], ["token", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, set()
        for batch in W.slices(batches):
            for u in shingle_sets(W.column(batch, "text"), gram):
                if len(u) and (key := set_key(u)) not in seen:
                    seen.add(key)
                    held.append(u)
                    size += len(u)
            if size > 4 * FLUSH:
                yield counted(held)
                held, size, seen = [], 0, set()
        if held:
            yield counted(held)

    counts = _rows(docs).select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = counts.where(F.col("n") >= SHORT).orderBy(F.desc("n"), "token").limit(MOST_FREQUENT).select("token").toArrow()
    return np.sort(top["token"].to_numpy().view(np.uint64))


def signatures(tokens: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(single rare tokens of the prefix, combinations of two frequent neighbours of the extended prefix).

    tokens: sorted; common: which of them are frequent."""
    n = len(tokens)
    prefix = n - (4 * n + 4) // 5 + 1
    rare = tokens[~common]
    if len(rare) >= prefix:
        return rare[:prefix], tokens[:0]
    often = tokens[common][: max(2, 2 * n // 5 - 2 * len(rare) + 2)]
    return rare, W.mix(often[:-1] * np.uint64(3) + W.mix(often[1:].copy()))


def candidates(spark: SparkSession, docs: DataFrame, gram: int = GRAM) -> DataFrame:
    """(sig, cls, n, rare): the posting lists of single tokens that two classes or more hold, and of all combinations.
    n: the set's size; rare: how many of its tokens are rare, in lists of single tokens as -1 - rare."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = 16 * parts
    often = spark.sparkContext.broadcast(frequent_tokens(docs, gram))

    def packed(held: list[list[np.ndarray]], bucket: int | None) -> pa.RecordBatch:
        s, c, n, r = (np.concatenate(x) for x in held)
        if bucket is None:
            b = (s >> np.uint64(33)).astype(np.int64) % buckets
            order = np.argsort(b, kind="stable")
            s, c, n, r, b = s[order], c[order], n[order], r[order], b[order]
            names, at = np.unique(b, return_index=True)
        else:
            names, at = np.array([-1 - bucket]), np.array([0])
        edges = np.append(at, len(s))
        ints = [pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(x)) for x in (n, r)]
        return pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), W.lists(s, edges), W.lists(c, edges), *ints], ["bucket", "sig", "cls", "n", "rare"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, turn = often.value, TaskContext.get().partitionId()
        held: list[list[list[np.ndarray]]] = [[[], [], [], []], [[], [], [], []]]
        size, seen = [0, 0], set()
        for batch in W.slices(batches):
            sets = shingle_sets(W.column(batch, "text"), gram)
            every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            at = np.searchsorted(known, every)
            common = known[np.minimum(at, len(known) - 1)] == every if len(known) else np.zeros(len(every), bool)
            edge = 0
            for u in sets:
                mine = common[edge : edge + len(u)]
                edge += len(u)
                if not len(u) or (key := set_key(u)) in seen:
                    continue
                seen.add(key)
                rare = len(u) - int(mine.sum())
                for kind, sig in enumerate(signatures(u, mine)):
                    if len(sig):
                        ints = (np.full(len(sig), x, np.int32) for x in (len(u), rare if kind else -1 - rare))
                        for into, x in zip(held[kind], (sig, np.full(len(sig), key, np.int64).view(np.uint64), *ints), strict=True):
                            into.append(x)
                        size[kind] += len(sig)
            for kind in (0, 1):
                if size[kind] > FLUSH:
                    yield packed(held[kind], turn % buckets if kind else None)
                    held[kind], size[kind], turn = [[], [], [], []], 0, turn + 1
                    seen = set() if len(seen) > 100_000 else seen
        for kind in (0, 1):
            if size[kind]:
                yield packed(held[kind], turn % buckets if kind else None)

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def members(s: np.ndarray, c: np.ndarray, n: np.ndarray, r: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([W.longs(s), W.longs(c), pa.array(n), pa.array(r)], ["sig", "cls", "n", "rare"])

        def shared(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            s, c, n, r = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((c, s))
            s, c, n, r = s[order], c[order], n[order], r[order]
            new = np.ones(len(s), bool)
            new[1:] = (s[1:] != s[:-1]) | (c[1:] != c[:-1])
            s, c, n, r = s[new], c[new], n[new], r[new]
            same = np.append(False, s[1:] == s[:-1])
            same[:-1] |= same[1:]
            return members(s[same], c[same], n[same], r[same])

        at, held = None, []
        for batch in batches:
            for i, bucket in enumerate(W.column(batch, "bucket").to_pylist()):
                s, c = (W.column(batch, k)[i].values.to_numpy().view(np.uint64) for k in ("sig", "cls"))
                n, r = (W.column(batch, k)[i].values.to_numpy() for k in ("n", "rare"))
                if bucket < 0:
                    yield members(s, c, n, r)
                    continue
                if bucket != at and held:
                    yield shared(held)
                    held = []
                at = bucket
                held.append((s.copy(), c.copy(), n.copy(), r.copy()))
        if held:
            yield shared(held)

    fields = "bucket int, sig array<long>, cls array<long>, n array<int>, rare array<int>"
    dealt = _rows(docs).select("text").mapInArrow(emit, fields).repartition(parts, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(lists, "sig long, cls long, n int, rare int").distinct()


def _close_enough(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b) with the representatives of both, without those that size or sketch rules out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (W.column(batch, k).to_numpy() for k in ("na", "nb"))
            apart = _apart(*(W.column(batch, k).to_pylist() for k in ("sa", "sb")))
            yield batch.filter(pa.array(9 * apart <= na + nb)).select(["a", "b", "ra", "ta", "rb", "tb"])

    side = lambda x: classes.select(F.col("cls").alias(x), F.col("doc_id").alias(f"r{x}"), F.col("tx").alias(f"t{x}"), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    out = pairs.join(side("a"), "a").join(side("b"), "b").where("5 * least(na, nb) >= 4 * greatest(na, nb)")
    return out.select("a", "b", "ra", "ta", "rb", "tb", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long, ra long, ta long, rb long, tb long")


def verified(pairs: DataFrame, docs: DataFrame, gram: int = GRAM) -> DataFrame:
    """(a, b): the pairs whose sets, made again from the whole texts, have Jaccard >= 4/5."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "xa", W.SLICE_BYTES // 2):
            keep = []
            for u, v in zip(shingle_sets(W.column(batch, "xa"), gram, 1), shingle_sets(W.column(batch, "xb"), gram, 1), strict=True):
                both = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(100 * both >= 80 * (len(u) + len(v) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    need = pairs.select(F.col("ra").alias("doc_id"), F.col("ta").alias("tx")).union(pairs.select("rb", "tb")).distinct().checkpoint()
    need = F.broadcast(need) if need.count() <= FEW else need
    rows = _rows(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))))
    texts = rows.join(need, ["doc_id", "tx"], "left_semi").groupBy("doc_id", "tx").agg(F.first("text").alias("text"))
    side = lambda x: texts.select(F.col("doc_id").alias(f"r{x}"), F.col("tx").alias(f"t{x}"), F.col("text").alias(f"x{x}"))
    both = pairs.join(side("a"), ["ra", "ta"]).join(side("b"), ["rb", "tb"])
    return both.select("a", "b", "xa", "xb").mapInArrow(run, "a long, b long")


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, the smallest id that a[i] - b[i] connect each with)."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = at[: len(a)], at[len(a) :], np.arange(len(ids))
    while (label[x] != label[y]).any():
        low = np.minimum(label[x], label[y])
        for to in (label[x], label[y]):
            np.minimum.at(label, to, low)
        while (label[label] != label).any():
            label = label[label]
    return ids, ids[label]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links a - b as (cls, other) in both directions; each FLUSH of them as stars around their smallest class."""

    def told(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        ids, low = _stars(*(np.concatenate(x) for x in zip(*held, strict=True)))
        ids, low = ids[ids != low], low[ids != low]
        return pa.RecordBatch.from_arrays([pa.array(np.append(ids, low)), pa.array(np.append(low, ids))], ["cls", "other"])

    held, size = [], 0
    for batch in batches:
        held.append(tuple(W.column(batch, k).to_numpy() for k in ("a", "b")))
        size += batch.num_rows
        if size > FLUSH:
            yield told(held)
            held, size = [], 0
    if size:
        yield told(held)


def components(links: DataFrame) -> DataFrame:
    """(cls, root) for every class with a link: the smallest class reachable. The links that a task holds become stars
    first; few links are few tasks, so that little is left to do between them. Then labels move along links and
    jump to their label's label, with checkpoints for each round."""
    both = links.select("a", "b").hint("rebalance", "a").mapInArrow(_contracted, "cls long, other long").distinct().checkpoint()
    at = both.groupBy("cls").agg(F.least(F.col("cls"), F.min("other")).alias("root"))
    while True:
        least = both.join(at.select(F.col("cls").alias("other"), "root"), "other").groupBy("cls").agg(F.min("root").alias("seen"))
        moved = at.join(least, "cls").select("cls", F.least("root", "seen").alias("to"), "root").checkpoint()
        jumped = moved.join(moved.select(F.col("cls").alias("to"), F.col("to").alias("further")), "to").select("cls", F.least("to", "further").alias("root"), F.col("root").alias("was")).checkpoint()
        at = jumped.select("cls", "root")
        if jumped.where("root <> was").isEmpty():
            return at


def _alike(a: str, b: str) -> Column:
    """Whether classes of one list, with sizes n{a} and n{b}, can have a link that this list has to find: what they
    share is at most the smaller set, and in a list of combinations, where the first shared token is a frequent one,
    at most the smaller number of frequent tokens."""
    often = lambda x: F.when(F.col(f"rare{x}") < 0, F.col(f"n{x}")).otherwise(F.col(f"n{x}") - F.col(f"rare{x}"))
    return F.lit(9) * F.least(often(a), often(b)).cast("long") >= F.lit(4) * (F.col(f"n{a}").cast("long") + F.col(f"n{b}"))


def link_classes(spark: SparkSession, docs: DataFrame, classes: DataFrame, gram: int = GRAM, hubs: int = 2) -> DataFrame:
    """(cls, root) of those classes (cls, doc_id, tx, n, sketch; one row for each different set) that have links."""
    place = W.shared(spark, "postings")
    candidates(spark, docs, gram).write.parquet(place)
    members = spark.read.schema("sig long, cls long, n int, rare int").parquet(place)
    roots = None
    for turn in range(hubs + 1):
        at = members.withColumn("root", F.col("cls")) if roots is None else members.join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
        # the hub: first the class with the least share of rare tokens, then others by chance, one of each component
        order = F.when(F.col("rare") < 0, -1 - F.col("rare")).otherwise(F.col("rare")) / F.col("n") if roots is None else F.xxhash64("root", F.lit(turn))
        hub = F.min(F.struct(order.alias("order"), "cls", "root", "n", "rare"))
        lists = at.groupBy("sig").agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("lo"), F.max("root").alias("hi"), hub.alias("hub")).where("lo < hi")
        # short lists gave all their pairs in the second round
        lists = (lists.where(F.col("size") > SHORT) if turn > 1 else lists).select("sig", "size", F.col("hub.cls").alias("a"), F.col("hub.root").alias("root_a"), F.col("hub.n").alias("n_a"), F.col("hub.rare").alias("rare_a"))
        open_ = at.join(lists, "sig")
        star = lambda x: x.where("root <> root_a").where(_alike("", "_a")).select("a", F.col("cls").alias("b"))
        if roots is None:
            pairs = star(open_)
        else:
            open_ = open_.checkpoint()
            if open_.isEmpty():
                break
            whole = open_ if turn == hubs else open_.where(F.col("size") <= SHORT)
            whole = whole.select("sig", "cls", "root", "n", "rare")
            other = whole.toDF("sig", "b", "root_b", "n_b", "rare_b")
            pairs = whole.join(other, (whole["sig"] == other["sig"]) & (F.col("root") < F.col("root_b")) & _alike("", "_b")).select(F.col("cls").alias("a"), "b")
            pairs = pairs if turn == hubs else pairs.union(star(open_.where(F.col("size") > SHORT)))
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        new = verified(_close_enough(pairs, classes).checkpoint(), docs, gram).checkpoint()
        if roots is None or not new.isEmpty():
            roots = components(new if roots is None else new.union(roots.where("cls <> root").select("root", "cls")))
    W.remove(spark, place)
    return roots


def near_duplicates(spark: SparkSession, docs: DataFrame, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_shingles, component_id, tx) for each row of docs; tx: the hash of its text."""
    place = W.shared(spark, "sets")
    keyed(docs, gram).write.parquet(place)
    rows = spark.read.schema("doc_id long, tx long, n long, cls long, sketch binary").parquet(place)
    none = -(1 << 63)
    least = F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("order"), F.coalesce("doc_id", F.lit(none)).alias("doc_id"), "tx", "n", "sketch"))
    classes = rows.where("cls IS NOT NULL").groupBy("cls").agg(least.alias("r")).select("cls", "r.doc_id", "r.tx", "r.n", "r.sketch").checkpoint()
    roots = link_classes(spark, docs, classes, gram)
    placed = classes.join(roots, "cls", "left").select("cls", F.coalesce("root", "cls").alias("root"), F.when(F.col("doc_id") != none, F.col("doc_id")).alias("doc_id"))
    ids = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    placed = placed.join(ids, "root").select("cls", "component_id")
    out = rows.drop("sketch").join(placed, "cls", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "tx")
