"""Decontamination, substring deduplication and the n-gram join against brute force and SQL."""

import hashlib
from collections import Counter, defaultdict

import duckdb
import pytest

from tessella.llm import decontamination, ngram_jaccard, substring_dedup
from tessella.llm import words as W
from tessella.llm.oracles import ORACLES
from tessella.llm.queries import QUERIES

from .cases import SF, alnum, clashing, docs, lowered, nothing, rows, spaced

NAMES = ("documents", "benchmark", "conversations")


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    found = con.execute(ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == cols
    theirs = sorted((tuple(r[names.index(c)] for c in cols) for r in found.fetchall()), key=repr)
    assert sorted((tuple(r) for r in df.select(cols).collect()), key=repr) == theirs


def contained(texts, items):
    windows = defaultdict(set)
    for item, text in items:
        w = alnum(text)
        n = min(13, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[s : s + n])].add("null" if item is None else str(item))
    out = []
    for doc, text in texts:
        w, hit, held = alnum(text), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if names := windows.get(tuple(w[s : s + n])):
                    hit |= {*range(s, s + n)}
                    held |= names
        out.append((doc, len(w), len(hit), len(held), hashlib.sha256(",".join(sorted(held)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("block_words", [decontamination.BLOCK_WORDS, 40])
def test_decontamination(spark, block_words):
    passage = rows()[11][1]
    items = [(1, passage), (2, "One TWO"), (10, " ".join(passage.split()[5:30])), (None, "one"), (4, None), (5, "..."), (6, "a b a b a b a b a b a b a b a b"), (7, "one")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.digest(decontamination.contamination(spark, clashing(docs(spark)), benchmark, block_words=block_words))
    assert Counter(map(tuple, got.collect())) == Counter(contained([r[:2] for r in rows()], items))


def test_decontamination_of_nothing(spark):
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontamination.contamination(spark, nothing(spark), benchmark).count() == 0
    assert decontamination.contamination(spark, docs(spark), benchmark.limit(0)).where("contaminated").count() == 0
    wide = clashing(docs(spark))
    kept = decontamination.without_contaminated(spark, wide, benchmark.limit(0))
    assert kept.columns == wide.columns and Counter(map(tuple, kept.collect())) == Counter(map(tuple, wide.collect()))


def deduplicated(texts, width=50):
    least = {}
    for doc, text in texts:
        w = spaced(text)
        for s in range(len(w) - width + 1):
            key = tuple(w[s : s + width])
            if doc is not None:
                least[key] = min(doc, least.get(key, doc))
    out = []
    for doc, text in texts:
        w, gone = spaced(text), set()
        for s in range(len(w) - width + 1):
            if doc is not None and least[tuple(w[s : s + width])] < doc:
                gone |= {*range(s, s + width)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("batches", [1, 3])
def test_substring_dedup(spark, batches):
    got = substring_dedup.dedup_corpus(spark, clashing(docs(spark)), batches=batches).drop("kept")
    assert Counter(map(tuple, got.collect())) == Counter(deduplicated([r[:2] for r in rows()]))


def test_substring_dedup_of_nothing_and_rewriting(spark):
    assert substring_dedup.dedup_corpus(spark, nothing(spark)).count() == 0
    wide = clashing(docs(spark))
    got = substring_dedup.rewritten(spark, wide)
    assert got.columns == wide.columns and got.count() == len(rows())
    unchanged = {r[0] for r in deduplicated([r[:2] for r in rows()]) if not r[2]} - {None}
    texts = {(r.doc_id, r.text) for r in got.collect()}
    assert {(r[0], r[1]) for r in rows() if r[0] in unchanged and r[0] != 9} <= texts


def test_index_holds_what_came_before(spark):
    index = substring_dedup.FingerprintIndex(spark, W.shared(spark, "test-index"))
    old = spark.createDataFrame([(1, rows()[9][1]), (2, rows()[12][1])], "doc_id long, text string")
    assert substring_dedup.dedup_batch(spark, index, old, old.limit(0)).where("n_removed > 0").count() == 0
    new = spark.createDataFrame([(5, rows()[11][1]), (6, rows()[17][1])], "doc_id long, text string")
    index = substring_dedup.FingerprintIndex(spark, index.path)  # read back from its manifest
    got = {r.doc_id: r.n_removed for r in substring_dedup.dedup_batch(spark, index, new, old).collect()}
    assert got == {5: 70, 6: 0}
    index.drop()


def grouped(texts, gram=5):
    sets = []
    for doc, text in texts:
        w = spaced(lowered(text))
        sets.append((doc, {tuple(w[s : s + gram]) for s in range(len(w) - gram + 1)} if len(w) >= gram else {tuple(w)} if w else set()))
    root = list(range(len(sets)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[top(i)] = top(j)
    ids = defaultdict(list)
    for i, (doc, _) in enumerate(sets):
        if doc is not None:
            ids[top(i)].append(doc)
    return [(doc, len(s), min(ids[top(i)], default=None) if s else doc) for i, (doc, s) in enumerate(sets)]


def test_ngram_jaccard(spark):
    got = ngram_jaccard.near_duplicates(spark, clashing(docs(spark))).drop("tx")
    assert Counter(map(tuple, got.collect())) == Counter(grouped([r[:2] for r in rows()]))
    assert ngram_jaccard.near_duplicates(spark, nothing(spark)).count() == 0


@pytest.mark.parametrize("flush", [ngram_jaccard.FLUSH, 7])
def test_components_take_few_rounds(spark, monkeypatch, flush):
    """A long chain, a star and a pair: the links a task holds are contracted first, however few it holds at a time."""
    monkeypatch.setattr(ngram_jaccard, "FLUSH", flush)
    W.shared(spark, "")
    turn = [(i * 37) % 101 - 50 for i in range(101)]
    links = [*zip(turn, turn[1:], strict=False), *((1000 + i, 2000) for i in range(50)), (1 << 62, -(1 << 62)), (2000, 1000)]
    frame, kind = spark.createDataFrame(links, "a long, b long"), type(spark.range(0))
    rounds, checkpoint = [], kind.checkpoint
    monkeypatch.setattr(kind, "checkpoint", lambda self, *x: rounds.append(1) or checkpoint(self, *x))
    got = {r.cls: r.root for r in ngram_jaccard.components(frame).collect()}
    assert got == {x: -50 for x in turn} | {x: 1000 for x in [*range(1000, 1050), 2000]} | {x: -(1 << 62) for x in (1 << 62, -(1 << 62))}
    assert flush == 7 or len(rounds) <= 3


def test_ngram_jaccard_with_common_tokens(spark, monkeypatch):
    """Many near copies of one text: its shingles are frequent, so combinations are what links them."""
    monkeypatch.setattr(ngram_jaccard, "SHORT", 3)
    monkeypatch.setattr(ngram_jaccard, "LOCAL", 1)
    words = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(60):
        own = list(words)
        for k in range(i % 4):
            own[(7 * i + 13 * k) % 60] = f"x{i}"
        texts.append((i, " ".join(own)))
    texts += [(100 + i, " ".join(f"y{(i * j) % 17}" for j in range(1, 30))) for i in range(12)]
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    assert Counter(map(tuple, ngram_jaccard.near_duplicates(spark, frame).drop("tx").collect())) == Counter(grouped(texts))
