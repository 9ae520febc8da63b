"""Quality rules against brute force; toxicity by accuracy on held-out rows; the pipeline stage by stage."""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

import corpus_pipeline
from tessella.llm import decontamination, ngram_jaccard, packing, quality_rules, substring_dedup, toxicity

from .cases import SF, alnum, clashing, docs, nothing, rows, spaced


def base(text):
    w, text = spaced(text), text or ""
    grams = [tuple(w[s : s + 8]) for s in range(len(w) - 7)]
    often, hit = Counter(grams), set()
    for s, g in enumerate(grams):
        if often[g] > 1:
            hit |= {*range(s, s + 8)}
    lines, seen, again = text.split("\n"), set(), 0
    for line in lines:
        again += bool(spaced(line)) and line in seen
        seen.add(line)
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), again, len(hit), n < 20 or 100 * len(hit) > 30 * n


def test_base_counts(spark):
    got = quality_rules.ruled(spark, clashing(docs(spark)))
    want = Counter((r[0], *base(r[1])) for r in rows())
    found = got.collect()
    assert Counter(tuple(r)[:7] for r in found) == want
    assert not any(r.kept for r in found if r.base_failed)
    assert quality_rules.ruled(spark, nothing(spark)).count() == 0


def test_distances_on_the_corpus(spark):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    texts = frame.select("doc_id", "text", "lang").collect()
    got = {r.doc_id: r for r in quality_rules.ruled(spark, frame).collect()}
    assert len(got) == len(texts) and all(tuple(got[r.doc_id])[1:7] == base(r.text) for r in texts)
    common = {}
    for lang in {r.lang for r in texts}:
        count = Counter(x for r in texts if r.lang == lang for x in alnum(r.text))
        total = sum(count.values())
        edge = sorted(count.values(), reverse=True)[: quality_rules.WORDS + 1]
        common[lang] = {x: n / total for x, n in count.most_common(quality_rules.WORDS)}, len(edge) > quality_rules.WORDS and edge[-1] == edge[-2]
    for r in texts:
        share, tied = common[r.lang]
        w = alnum(r.text)
        if not w or tied:
            continue
        own = Counter(w)
        p = np.array([own[x] / len(w) for x in share] + [sum(n for x, n in own.items() if x not in share) / len(w)])
        q = np.array([*share.values(), 1 - sum(share.values())])
        m = (p + q) / 2
        part = lambda x: sum(a * np.log2(a / b) for a, b in zip(x, m, strict=True) if a > 0)  # noqa: B023, E731
        assert abs(got[r.doc_id].js_words - np.sqrt(max(0, (part(p) + part(q)) / 2))) < 1e-6
        assert 0 <= got[r.doc_id].js_chars <= 1


def kind(char):
    """A character's class, by a plain reading of the list of classes."""
    for k, group in enumerate(["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".,;:!?", "()[]{}'\"", "#*$%&|<>"]):
        if char in group:
            return k
    return 7 + len(char.encode())


def js(p, q):
    m = (p + q) / 2
    part = lambda x: sum(a * np.log2(a / b) for a, b in zip(x, m, strict=True) if a > 0)
    return np.sqrt(max(0, (part(p) + part(q)) / 2))


def test_distances_and_verdict_against_a_plain_version(spark):
    """Both distances and the verdict of every document, the same however the rows are dealt."""
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    texts = frame.select("doc_id", "text", "lang").collect()
    got = {r.doc_id: r for r in quality_rules.ruled(spark, frame.repartition(17)).collect()}
    assert {r.doc_id: r for r in quality_rules.ruled(spark, frame.coalesce(1)).collect()} == got
    chars = {lang: Counter(kind(c) for r in texts if r.lang == lang for c in r.text) for lang in {r.lang for r in texts}}
    share = lambda n: np.array([n[k] for k in range(12)]) / max(1, n.total())
    for r in texts:
        g, n = got[r.doc_id], len(spaced(r.text))
        if alnum(r.text):
            assert abs(g.js_chars - js(share(Counter(map(kind, r.text))), share(chars[r.lang]))) < 1e-6
        room = quality_rules.SLACK / np.sqrt(max(n, 1))
        far = n >= quality_rules.MIN_WORDS and ((g.js_chars or 0) > quality_rules.CHARS_LIMIT + room or (g.js_words or 0) > quality_rules.WORDS_LIMIT + room)
        assert g.kept == (not g.base_failed and not far)
    assert 0 < sum(g.kept for g in got.values()) < len(got)


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"  # 97 toxic rows are held out here; in sf0.01 only 6
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r for r in toxicity.toxicity(spark, spark.read.parquet(f"{sf}/documents.parquet"), labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    held = [(got[r.doc_id].predicted, r.toxic) for r in labels.collect() if r.doc_id in got and got[r.doc_id].held_out and r.toxic is not None]
    toxic = [p for p, t in held if t > 0]
    clean = [p for p, t in held if t <= 0]
    assert np.mean(toxic) >= 0.8 and np.mean(clean) <= 0.1


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(i, 1, int(i in (5, 9))) for i in range(20)] + [(None, 1, 1), (5, None, None), (999, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(spark, clashing(docs(spark)), labels)
    assert got.count() == len(rows())
    assert toxicity.toxicity(spark, docs(spark), labels.limit(0)).where("score <> 0").count() == 0
    assert toxicity.toxicity(spark, nothing(spark), labels).count() == 0
    wide = clashing(docs(spark))
    assert toxicity.without_toxic(spark, wide, labels.limit(0)).columns == wide.columns


def test_pipeline_stages(spark):
    """Each stage is its operator over what the one before kept, and its decisions take effect."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard", "substring_dedup", "decontamination", "packing"]
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = frame
        frame = stage(spark, before, SF).checkpoint()
        assert frame.columns == before.columns
        kept[name] = before, frame
    before, after = kept["toxicity"]
    scores = {r.doc_id: r.score for r in toxicity.toxicity(spark, before, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert {r.doc_id for r in after.collect()} == {d for d, s in scores.items() if s < 0.5}
    before, after = kept["ngram_jaccard"]
    assert {r.doc_id for r in after.collect()} == {r.component_id for r in ngram_jaccard.near_duplicates(spark, before).collect()}
    before, after = kept["substring_dedup"]
    cut = {r.doc_id: r for r in substring_dedup.dedup_corpus(spark, before).collect()}
    old = {r.doc_id: r.text for r in before.collect()}
    assert all(r.text == (cut[r.doc_id].kept if cut[r.doc_id].n_removed else old[r.doc_id]) for r in after.collect())
    before, after = kept["decontamination"]
    found = decontamination.digest(decontamination.contamination(spark, before, spark.read.parquet(f"{SF}/benchmark.parquet")))
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in found.collect() if not r.contaminated}
    out = corpus_pipeline.packed(spark, after, SF)
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in after.collect()}
    assert packing.CAPACITY == 4096


def test_stages_take_odd_tables(spark):
    for name, stage in corpus_pipeline.STAGES:
        wide = clashing(docs(spark))
        got = stage(spark, wide, SF)
        assert name == "packing" or got.columns == wide.columns
        assert got.count() > 0
        assert stage(spark, nothing(spark), SF).count() == 0


def test_toxicity_counts_every_occurrence():
    """A passage of words that the text has said before counts in both features."""
    names = [f"w{i}" for i in range(12)]
    single = {w: 0.5 for w in names}
    double = {(names[i], names[(i + 5) % 12]): 2.0 for i in range(12)}
    batch = lambda text: pa.RecordBatch.from_arrays([pa.array([text])], ["text"])
    code = lambda w: toxicity._grams(batch(w))[2]
    look = lambda keys, values: toxicity.Lookup(np.concatenate(keys), np.array(values))
    nothing = toxicity.Lookup(np.zeros(0, np.uint64), np.zeros(0))
    model = toxicity.Model(look([toxicity._pair(code(a), code(b)) for a, b in double], list(double.values())), nothing, look([code(w) for w in single], list(single.values())), 1.0)
    said = names * 4 + [names[i * 5 % 12] for i in range(12)]
    alone = np.log1p(toxicity.SHARE * -0.5)
    gain = [double.get(pair, alone) for pair in zip([None, *said], said, strict=False)]
    near = toxicity.NEAR
    _, mean, passage, best = model.features(batch(" ".join(said)))[0]
    assert abs(mean - sum(gain) / (len(said) + 2 * near)) < 1e-9
    assert abs(best - max(sum(gain[i : i + near]) / near for i in range(len(said) - near + 1))) < 1e-9 and best > 1.9
    assert abs(passage - sum(gain) / toxicity.PASSAGE) < 1e-9
    late = model.features(batch(" ".join(["z"] * 5000 + said + ["z"] * 3)))[0]
    assert late[1] < mean / 50 and late[2] > 0.9 * passage and late[3] > 0.9 * best
    assert model.features(batch("")).tolist() == [[1, 0, 0, 0]]


def _said(spark):
    """Documents of two classes, their grams and corpus counts."""
    texts = [(i, f"all say u{i % 30} and x{i} of {'bad' if i % 2 else 'good'} things and more of {'bad' if i % 3 else 'fine'} u{i % 7}") for i in range(80)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    start = int(toxicity._START)
    code = lambda w: int(toxicity._grams(pa.RecordBatch.from_arrays([pa.array([w])], ["text"]))[2].view(np.int64)[0])
    grams = {(1 - i % 2, *t) for i, text in texts for w in [[start, start, *map(code, alnum(text))]] for t in zip(w, w[1:], w[2:], strict=False)}
    return frame, grams


def test_toxicity_models_sum_to_one(spark):
    """Every context's distribution over all words of the corpus, seen after it or not, sums to 1 in both classes."""
    frame, grams = _said(spark)
    table = spark.createDataFrame([*grams], "c int, first long, before long, word long")
    counts = toxicity.corpus_counts(frame)
    words, heads, pairs, back = toxicity.probabilities(table, counts)
    words = {r.word: (r.p0, r.p1) for r in words.collect()}
    heads = {r.before: (r.b0, r.b1) for r in heads.collect()}
    pairs = {(r.before, r.word): (r.p0, r.p1) for r in pairs.collect()}
    corpus = {r.word: r.n for r in counts.collect()}
    total = sum(corpus.values())
    assert set(pairs) == {(b, w) for _, _, b, w in grams}
    for c in (0, 1):
        p = {w: words[w][c] if w in words else back[c] * n / total for w, n in corpus.items()}
        assert abs(sum(p.values()) - 1) < 1e-9
        for head, held in heads.items():
            assert abs(sum(pairs[head, w][c] if (head, w) in pairs else held[c] * x for w, x in p.items()) - 1) < 1e-9


def test_discounts_follow_counts_of_counts():
    y = 100 / (100 + 2 * 40)
    assert np.allclose(toxicity.discounts({1: 100, 2: 40, 3: 20, 4: 10, 5: 7}), (1 - 2 * y * 0.4, 2 - 3 * y * 0.5, 3 - 4 * y * 0.5))
    assert all(0 < d <= k for k, d in enumerate(toxicity.discounts({}), 1))


def test_toxicity_counts_each_word_of_the_corpus(spark):
    """Words have counts of their own, also where many share the upper bits of their hashes."""
    texts = [" ".join(f"v{i % m}" for i in range(0, 20_000, k)) for k in (1, 2, 3) for m in (20_000, 5_000)] + [None, "", "v1 v1"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    want = Counter(w for t in texts for w in set(alnum(t)))
    names = sorted(want)
    code = toxicity._grams(pa.RecordBatch.from_arrays([pa.array([" ".join(names)])], ["text"]))[2]
    upper = code >> np.uint64(64 - toxicity.BITS)
    assert len(np.unique(upper)) < len(names)
    assert {r.word: r.n for r in toxicity.corpus_counts(frame).collect()} == {int(h): want[w] for h, w in zip(code.view(np.int64), names, strict=True)}


def test_every_language_has_a_reference(spark, monkeypatch):
    """More languages than a block holds, one with words too rare for a share of 1/20000, and texts of no language."""
    texts = [(f"l{k}", " ".join(chr(0x4E00 + 60 * k + i % 60) + "a" * (k % 7) for i in range(240))) for k in range(150)]
    often = [f"o{i}" for i in range(quality_rules.WORDS)]
    texts += [("rare", " ".join([*often, *often, *(f"r{i}" for i in range(40_000))])), ("rare", " ".join(often[:80])), (None, texts[149][1]), (None, " ".join(often[:60]))]
    frame = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(texts)], "doc_id long, text string, lang string").repartition(3)
    got = {r.doc_id: r for r in quality_rules.ruled(spark, frame).collect()}
    assert all(got[i].js_words < 1e-6 and got[i].js_chars < 1e-6 for i in [*range(150), 152])
    counts = [Counter(alnum(t)) for lang, t in texts if lang == "rare"]
    total = sum(x.total() for x in counts)
    top = {w: sum(x[w] for x in counts) / total for w in often}
    p = np.array([1 / 80] * 80 + [0] * 21)
    q = np.array([*top.values(), 1 - sum(top.values())])
    assert abs(got[151].js_words - quality_rules.js_distance(p, q)) < 1e-6
    monkeypatch.setattr(quality_rules, "BLOCK", 16)
    assert {r.doc_id: r for r in quality_rules.ruled(spark, frame.repartition(5)).collect()} == got


def test_toxicity_finds_late_passages(spark):
    """Expressions of one class count wherever they stand, in short and in very long texts."""
    rng = np.random.default_rng(4)
    say = lambda n: " ".join(f"v{i}" for i in rng.integers(0, 2000, n))
    texts = [(i, f"{say(60)} {'nasty vile wretch' if i % 4 == 0 else 'kind calm friend'} {say(60)}") for i in range(400)]
    texts += [(1000, f"{say(30_000)} nasty vile wretch {say(20)} nasty vile wretch"), (1001, say(30_000)), (1002, say(40)), (1003, f"{say(20)} nasty vile wretch")]
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(spark, frame, labels).collect()}
    assert [got[i].predicted for i in range(1000, 1004)] == [1, 0, 0, 1]
    assert all(got[i].predicted == (i % 4 == 0) for i in range(400) if got[i].held_out)
    assert min(got[i].score for i in range(0, 400, 4)) > 10 * max(got[i].score for i in range(400) if i % 4)


def test_near_duplicates_are_decided_by_row(spark):
    """Of rows with one doc_id only those go whose own text is linked to a kept one."""
    say = lambda k: " ".join(f"{k}{i}" for i in range(40))
    table = [(3, say("x")), (9, say("x")), (9, say("y")), (9, say("y")), (4, ""), (5, None), (4, ""), (None, say("x")), (2, say("z") + " end"), (7, say("z"))]
    frame = spark.createDataFrame(table, "doc_id long, text string")
    got = Counter(map(tuple, corpus_pipeline.without_near_duplicates(spark, frame, SF).collect()))
    assert got == Counter([(3, say("x")), (9, say("y")), (4, ""), (5, None), (4, ""), (None, say("x")), (2, say("z") + " end")])


def test_near_duplicates_leave_a_short_plan(spark):
    """What is returned joins the rows with those kept; the search is not planned again, for each of its uses."""
    out = corpus_pipeline.without_near_duplicates(spark, docs(spark), SF)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 2
