"""Quality rules: base counts and divergence from language references.

A reference is a language's mean histogram: characters by class, and its commonest words. Both are
counted over all documents with that lang in one pass. A document diverges if the Jensen-Shannon
distance (base 2, 0 to 1) of its character classes or of its common words to its language's reference
exceeds a limit, which is wider for short texts by SLACK / sqrt(words). Texts under MIN_WORDS words
don't diverge; a text in no known language is compared with the nearest reference.

Reference counts: all words of all documents are summed by language, and of each language the WORDS
commonest words are kept, by their hash where counts are equal. Every language has a reference. They are
broadcast in blocks of about BLOCK languages; documents pass through the blocks one after another.

Defined results: null and empty texts have no words and fail the base rule; a null lang is no known
language; every row gives a row, equal ones too; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm import words as W

WORDS, BLOCK, CHUNK, HELD = 100, 1024, 1 << 21, 64
MIN_WORDS, CHARS_LIMIT, WORDS_LIMIT, SLACK = 50, 0.25, 0.45, 0.6
REPEAT, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
#: Classes of characters by first byte: lower, upper, digit, blank, line end, stop, bracket or quote, symbol,
#: other sign, letter of two bytes, character of three bytes, of four; bytes within a character have none (12).
_CLASS = np.full(256, 8)
_CLASS[0x61:0x7B], _CLASS[0x41:0x5B], _CLASS[0x30:0x3A] = 0, 1, 2
_CLASS[[0x20, 0x09]], _CLASS[[0x0A, 0x0D]] = 3, 4
_CLASS[list(b".,;:!?")], _CLASS[list(b"()[]{}'\"")] = 5, 6
_CLASS[_SYMBOL] = 7
_CLASS[0x80:0xC0], _CLASS[0xC0:0xE0], _CLASS[0xE0:0xF0], _CLASS[0xF0:] = 12, 9, 10, 11
CLASSES = 12


def _sum(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offsets])


def base_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts of each text."""
    got = W.words(data, offsets, W.SPACED)
    out = {"n_words": got.counts, "word_chars": _sum(W.SPACED[data] & (data & 0xC0 != 0x80), offsets), "n_symbols": _sum(_SYMBOL[data], offsets)}
    lines = W.words(data, offsets, np.arange(256) != 0x0A)
    solid = np.concatenate([[0], np.cumsum(W.SPACED[data])])
    real = solid[lines.ends] > solid[lines.starts]
    doc = lines.doc()[real]
    key = lines.hashes()[real] + doc.astype(np.uint64) * W.GOLDEN
    first = np.unique(key, return_index=True)[1]
    n = len(offsets) - 1
    out["n_dup_lines"] = np.bincount(doc, minlength=n) - np.bincount(doc[first], minlength=n)
    grams = W.windows(got.hashes(), REPEAT)
    at = np.flatnonzero(np.arange(len(grams)) + REPEAT <= got.last()[: len(grams)])
    key = grams[at] + got.doc()[at].astype(np.uint64) * W.GOLDEN
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    cover = np.zeros(len(got) + 1, np.int32)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + REPEAT, -1)
    out["n_repeat_words"] = _sum(np.cumsum(cover[:-1]) > 0, got.first)
    return {k: v.astype(np.int64) for k, v in out.items()}


def _classes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n), np.diff(offsets))
    return np.bincount(doc * 13 + _CLASS[data], minlength=13 * n).reshape(n, 13)[:, :CLASSES]


def _spoken(data: np.ndarray, offsets: np.ndarray) -> tuple[W.Words, np.ndarray]:
    got = W.words(W.LOWER[data], offsets, W.ALNUM)
    return got, got.hashes()


def counted(docs: DataFrame) -> DataFrame:
    """(lang, kind, key, n): characters by class and all words (key CLASSES) of kind 0, each word by its hash of kind 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def told(lang: str, parts: list[np.ndarray], chars: np.ndarray) -> pa.RecordBatch:
            key, n = np.unique(np.concatenate(parts), return_counts=True)
            kinds = np.concatenate([np.zeros(CLASSES + 1, np.int32), np.ones(len(key), np.int32)])
            keys = np.concatenate([np.arange(CLASSES + 1), key.view(np.int64)])
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(kinds), pa.array(keys), pa.array(np.concatenate([chars, [n.sum()], n]).astype(np.int64))], ["lang", "kind", "key", "n"])

        for batch in W.slices(batches):
            data, offsets = W.raw(W.column(batch, "text"))
            classes = _classes(data, offsets)
            got, h = _spoken(data, offsets)
            langs = W.column(batch, "lang").to_pylist()
            for lang in set(langs):
                mine = np.array([x == lang for x in langs])
                one = held.setdefault(lang, [[], np.zeros(CLASSES, np.int64), 0])
                one[0].append(h[np.repeat(mine, got.counts)])
                one[1] += classes[mine].sum(axis=0)
                one[2] += len(one[0][-1])
                if one[2] > CHUNK or len(held) > HELD:  # the rest of it comes in further rows
                    yield told(lang, one[0], one[1])
                    del held[lang]
        for lang, one in held.items():
            yield told(lang, one[0], one[1])

    return docs.where("lang IS NOT NULL").select("lang", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "lang string, kind int, key long, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))


Reference = tuple[np.ndarray, np.ndarray, np.ndarray]


def references(docs: DataFrame) -> Iterator[dict[str, Reference]]:
    """Blocks of languages; by language: (share of each character class, hashes of its commonest words, their shares
    and the rest's)."""
    ranked = Window.partitionBy("lang", "kind").orderBy(F.desc("n"), F.desc("key"))  # of kind 0 there are fewer than WORDS
    rows = counted(docs).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= WORDS).drop("rank").checkpoint()
    blocks = max(1, -(-rows.where((F.col("kind") == 0) & (F.col("key") == CLASSES)).count() // BLOCK))
    for block in range(blocks):
        got = rows.where(F.pmod(F.xxhash64("lang"), F.lit(blocks)) == block).orderBy("lang").toArrow()
        langs, kind, key, n = got["lang"].to_pylist(), *(got[c].to_numpy() for c in ("kind", "key", "n"))
        heads = [i for i, x in enumerate(langs) if not i or x != langs[i - 1]]
        out = {}
        for i, j in zip(heads, [*heads[1:], len(langs)], strict=False):
            word = kind[i:j] == 1
            chars = np.zeros(CLASSES + 1)
            chars[key[i:j][~word]] = n[i:j][~word]
            keys, share = key[i:j][word].view(np.uint64), n[i:j][word] / max(1, chars[CLASSES])
            order = np.argsort(keys)
            out[langs[i]] = chars[:CLASSES] / max(1, chars[:CLASSES].sum()), keys[order], np.append(share[order], max(0.0, 1 - share.sum()))
        yield out


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The Jensen-Shannon distance (base 2) of each row of p to q."""
    m = (p + q) / 2
    part = lambda x: np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / np.where(m > 0, m, 1)), 0).sum(axis=-1)
    return np.sqrt(np.maximum(0, (part(p) + part(np.broadcast_to(q, p.shape))) / 2))


def ruled(spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS, chars_limit: float = CHARS_LIMIT, words_limit: float = WORDS_LIMIT, slack: float = SLACK) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, js_chars, js_words
    for each row of docs; the distances are null where there is no reference or no word."""
    W.shared(spark, "")  # sees to a checkpoint folder
    *others, last = [spark.sparkContext.broadcast(x) for x in references(docs)]

    def distances(batch: pa.RecordBatch, held: dict[str, Reference], data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(js_chars, js_words) so far: of a text's own language, of the nearest one if it has none."""
        langs = W.column(batch, "lang").to_pylist()
        best = np.stack([W.column(batch, c).to_numpy(zero_copy_only=False).astype(float) for c in ("js_chars", "js_words")])
        classes = _classes(data, offsets)
        got, h = _spoken(data, offsets)
        doc, some = got.doc(), got.counts > 0
        for lang in set(langs):
            mine = np.flatnonzero(np.array([x == lang for x in langs]) & some)
            if not len(mine):
                continue
            place = np.full(len(langs), -1)
            place[mine] = np.arange(len(mine))
            at = np.flatnonzero(place[doc] >= 0)
            words, row = h[at], place[doc[at]]
            shares = classes[mine] / np.maximum(1, classes[mine].sum(axis=1, keepdims=True))
            for chars, keys, share in held.values() if lang is None else filter(None, [held.get(lang)]):
                a = js_distance(shares, chars)
                near = np.minimum(np.searchsorted(keys, words), max(0, len(keys) - 1))
                kind = np.where(keys[near] == words, near, len(keys)) if len(keys) else np.zeros(len(words), np.int64)
                table = np.bincount(row * len(share) + kind, minlength=len(mine) * len(share)).reshape(len(mine), -1)
                b = js_distance(table / table.sum(axis=1, keepdims=True), share)
                nearer = np.isnan(best[0, mine]) | (a + b < best[0, mine] + best[1, mine])
                best[0, mine], best[1, mine] = np.where(nearer, a, best[0, mine]), np.where(nearer, b, best[1, mine])
        return best

    def passed(held) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in W.slices(batches):
                a, b = distances(batch, held.value, *W.raw(W.column(batch, "text")))
                cols = [*(W.column(batch, c) for c in ("doc_id", "lang", "text")), pa.array(a, from_pandas=True), pa.array(b, from_pandas=True)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "lang", "text", "js_chars", "js_words"])

        return run

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches):
            data, offsets = W.raw(W.column(batch, "text"))
            base = base_counts(data, offsets)
            n = base["n_words"]
            failed = (n < LEAST_WORDS) | (100 * base["n_repeat_words"] > MOST_REPEATED * n)
            a, b = distances(batch, last.value, data, offsets)
            room = slack / np.sqrt(np.maximum(n, 1))
            far = (n >= min_words) & ((np.nan_to_num(a) > chars_limit + room) | (np.nan_to_num(b) > words_limit + room))
            cols = [W.column(batch, "doc_id"), *(pa.array(x) for x in base.values()), pa.array(failed), pa.array(~failed & ~far), pa.array(a, from_pandas=True), pa.array(b, from_pandas=True)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", *base, "base_failed", "kept", "js_chars", "js_words"])

    nan = F.lit(None).cast("double")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.coalesce("text", F.lit("")).alias("text"), nan.alias("js_chars"), nan.alias("js_words"))
    for held in others:
        rows = rows.mapInArrow(passed(held), "doc_id long, lang string, text string, js_chars double, js_words double")
    return rows.mapInArrow(judged, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, js_chars double, js_words double")
