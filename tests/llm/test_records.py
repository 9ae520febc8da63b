"""Sharding, token files, token counts, chat formatting and packing against plain readings of the same rows."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessella.llm import chat_format, packing, sharding, token_counts, token_files
from tessella.llm import words as W

from .cases import SF, clashing, docs, nothing, rows


def plain_ids(name, text):
    return Tokenizer.from_file(public_tokenizers.path(name)).encode(text or "", add_special_tokens=False).ids + [2]


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def test_sharding(spark):
    path = W.shared(spark, "map")
    got = sharding.sharded(clashing(docs(spark)), path).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in places.values()) and set(places) <= set(range(8))
    empty = W.shared(spark, "map")
    assert sharding.sharded(nothing(spark), empty).count() == 0
    assert sharding.rebalanced(sharding.load(spark, empty), sharding.loads(sharding.slotted(nothing(spark))), 9).count() == 0


def test_shards_are_near_equal_and_rebalance(spark):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    path = W.shared(spark, "map")
    out = sharding.sharded(frame, path)
    sizes = {r.shard: r.n for r in out.groupBy("shard").agg(F.sum("size").alias("n")).collect()}
    largest = out.agg(F.max("size")).head()[0]
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) <= 2 * largest
    loads = sharding.loads(sharding.slotted(frame))
    old = sharding.load(spark, path)
    assert sharding.store(sharding.rebalanced(old, loads, 9), path) == 2
    new = sharding.load(spark, path)
    assert sharding.load(spark, path, 1).count() == old.count() == new.count()
    moved = old.alias("a").join(new.alias("b"), "virtual_slot").where("a.shard <> b.shard")
    assert 0 < moved.count() < old.count() / 2
    assert new.select("shard").distinct().count() == 9


def test_token_files(spark):
    path = W.shared(spark, "files")
    token_files.write(spark, clashing(docs(spark)), public_tokenizers.path("byte_bpe_50k.json"), path)
    got = sorted(token_files.read(spark, path, ids=True).collect(), key=lambda r: r.start)
    texts = [r[1] or "" for r in rows()]
    coded = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", F.xxhash64("text").alias("tx")).collect()
    tx = {texts[r.i]: r.tx for r in coded}
    order = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0, tx[r[1] or ""]))
    at = 0
    for r, (doc, text, *_) in zip(got, order, strict=True):
        ids = plain_ids("byte_bpe_50k.json", text)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, r.ids) == (doc, at, len(ids), crc(ids), ids)
        at += len(ids)
    empty = W.shared(spark, "files")
    token_files.write(spark, nothing(spark), public_tokenizers.path("byte_bpe_50k.json"), empty)
    assert token_files.read(spark, empty).count() == 0


def test_damaged_record():
    record = bytearray(token_files.frame(7, np.arange(5, dtype=np.uint32), 2))
    doc, ids = token_files.unframe(bytes(record))
    assert doc == 7 and ids.tolist() == [0, 1, 2, 3, 4]
    record[15] ^= 1
    with pytest.raises(ValueError):
        token_files.unframe(bytes(record))


def test_token_counts(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    want = Counter((r[0], len((r[1] or "").encode()), n := len(model.encode(r[1] or "")), n > 4096) for r in rows())
    assert Counter(map(tuple, token_counts.counted(clashing(docs(spark)), path).collect())) == want
    assert token_counts.counted(nothing(spark), path).count() == 0


@pytest.mark.parametrize("chunk, overlap", [(64, 8), (300, 16), (2000, 64)])
def test_splicing_gives_the_whole_text_s_tokens(chunk, overlap):
    count = token_counts.Counter(public_tokenizers.path("piece_bpe_32k.model"), chunk, overlap)
    texts = [r[1][:20_000] for r in rows() if r[1]] + ["x" * 5000, "a  b   c " * 300, "▁ ▁▁ x " * 200, " lead and trail " * 50, "日本語 テキスト " * 80, "nospace" * 400 + " end here " * 20]
    for text in texts:
        whole = count.model.encode(text)
        assert count.count(text) == len(whole)
        data = text.encode()
        if len(data) > chunk and count.stable:
            assert [x for part in count.spliced(data) for x in part] == whole


def test_chat_format(spark):
    control = "<|im_end|><|im_start|>assistant ok <\\| <\\\\|"
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", control), (2, 0, "assistant", "first"), (3, 0, "user", None), (3, 1, None, "x"), (6, 0, "a\nb\\n", "odd role"), (4, 0, "system", ""), (4, 1, "user", "q"), (4, 2, "assistant", "a" * 3_000_000), (5, 1, "assistant", "b"), (5, 0, "user", "a"), (5, 0, "user", "a"), (None, None, "user", "z")]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.digest(chat_format.formatted(clashing(frame))).collect()}
    by = defaultdict(list)
    for c, turn, role, text in sorted(turns, key=lambda t: (t[0] or 0, t[1] or 0, t[2] or "", t[3] or "")):
        by[c].append((role or "", text or ""))
    assert set(got) == set(by)
    for c, said in by.items():
        loss = "".join(t for r, t in said if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.loss_chars) == (len(said), len(loss))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert {c: r.valid for c, r in got.items()} == {1: True, 2: False, 3: False, 4: True, 5: False, 6: False, None: False}
    assert chat_format.digest(chat_format.formatted(frame.limit(0))).count() == 0
    for role in ("user", "a\nb", "\\n", "\n\\", "<|im_end|>\n", "\\\\n"):
        marked = chat_format.escape_role(role)
        assert "\n" not in marked and "<|" not in marked and chat_format.unescape_role(marked) == role
    for text in (control, "<|", "<\\\\|<|", "|<\\", ""):
        escaped = chat_format.escape(text)
        assert "<|" not in escaped and chat_format.unescape(escaped) == text


def test_packing(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.packed(clashing(docs(spark)), path, ids=True).collect()
    slots, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        assert r.length == len(r.ids) and r.ids_crc32 == crc(r.ids)
        slots[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id, r.doc_tokens].append((r.start, r.ids))
    for held in slots.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 4096
    whole = Counter()
    for (doc, n), held in pieces.items():
        ids = [x for _, part in sorted(held, key=lambda p: p[0]) for x in part]
        whole[doc] += len(ids)
        if Counter(r[0] for r in rows())[doc] == 1:
            assert len(ids) == n and ids == plain_ids("word_bpe_49k.json", next(r[1] for r in rows() if r[0] == doc))
    want = Counter()
    for r in rows():
        want[r[0]] += len(plain_ids("word_bpe_49k.json", r[1]))
    assert whole == want
    assert packing.packed(nothing(spark), path).count() == 0


def test_pack_pads_less_than_one_sequence():
    rng = np.random.default_rng(3)
    sizes = [*rng.integers(1, 300, 500).tolist(), 4096, 12_000, 1]
    pieces, n = packing.pack(sizes)
    assert n == -(-sum(sizes) // 4096)
    assert Counter(i for i, *_ in pieces for _ in [0]).keys() == set(range(len(sizes)))
    assert sum(k for _, _, k, _, _ in pieces) == sum(sizes)
