"""Classifiers and the language model: held-out accuracy, brute-force probabilities, odd inputs."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import langid, lm, quality, toxicity
from graphloom.llm.common import in_fold
from tests.llm.conftest import prose

TONGUES = {"en": "the river and the stone were with this morning through water there which have", "de": "und der die das nicht mit sich auf werden eine schön über straße früh", "fr": "les des une dans pour avec être très où château rêve garçon leçon qui"}


@pytest.fixture(scope="module")
def tongues(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(240):
        lang = list(TONGUES)[i % 3]
        rows.append((i, " ".join(rng.choice(TONGUES[lang].split(), 25)), lang))
    rows += [(900, None, "en"), (901, "12345 --- 99", "de"), (902, "", None), (903, "und der schön über", None), (None, "les des une", "fr")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


def test_languages(tongues):
    model = langid.train(tongues.where(in_fold("doc_id", 4, 0, 1, 3)))
    got = langid.predict(tongues, model).select("*", in_fold("doc_id", 4, 2).alias("held")).collect()
    want = {r.doc_id: r.lang for r in tongues.collect()}
    held = [r for r in got if r.held and r.doc_id < 900]
    assert len(got) == 245 and len(held) > 30 and np.mean([r.lang_pred == want[r.doc_id] for r in held]) > 0.95
    by = {r.doc_id: r for r in got}
    assert all(by[k].lang_pred == "und" and by[k].score == 0 and not by[k].accepted for k in (900, 901, 902))
    assert by[903].lang_pred == "de" and all(0 <= r.score <= 1 for r in got)
    assert langid.predict(tongues.limit(0), model).count() == 0
    none = langid.train(tongues.where("lang = 'xx'"))
    assert {r.lang_pred for r in langid.predict(tongues, none).collect()} == {"und"}


def test_long_texts_are_read_whole():
    rng = np.random.default_rng(1)
    text = prose(rng, 400_000)
    at, share = langid.bag(text)
    assert abs(share.sum() - 1) < 1e-3 and sum(len(s) for s in langid.subwords(text)) > 3 * len(text) * 0.9


@pytest.fixture(scope="module")
def toxic(spark):
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        words = prose(rng, int(rng.integers(20, 200))).split()
        if bad:
            for w in rng.choice(["scumface", "vilebrat", "hategoat", "rotlord", "grimewit"], 4):
                words.insert(int(rng.integers(len(words))), w)
        rows.append((i, " ".join(words)))
        if i % 2 == 0 or bad:
            labels.append((i, int(bad)))
    rows += [(1000, None), (1001, "")]
    labels += [(None, 1), (3, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_toxicity(toxic):
    docs, labels = toxic
    learn = in_fold("doc_id", 5, 1, 2, 3, 4)
    model = toxicity.train(docs.where(learn), labels.where(learn))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [r.doc_id for r in docs.where(in_fold("doc_id", 5, 0)).collect() if r.doc_id < 1000]
    right = [(got[i] >= 0.5) == (i % 5 == 0) for i in held]
    assert np.mean(right) > 0.95 and got[1000] == got[1001] < 0.5
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert max(r.score for r in toxicity.score(docs, toxicity.train(docs, labels.where("toxic = 7"))).collect()) < 0.5  # no positives


def test_non_negative_risk_step():
    """The clean part of the risk stays out of the step where it would be negative."""
    rng = np.random.default_rng(0)
    pos = [np.unique(np.append(rng.integers(100, 200, 10), 7)).astype(np.int32) for _ in range(60)]
    unl = [rng.integers(100, 200, 10).astype(np.int32) for _ in range(300)] + pos[:30]
    score = toxicity.fit(pos, unl, 0.1)
    assert set(score.weight) == {7} and score.weight[7] > 0


def test_language_scores_equal_a_plain_loop():
    rng = np.random.default_rng(2)
    model = langid.Model(["a", "b", "c"], rng.normal(size=(langid.BUCKETS, 3)), rng.normal(size=3), 0.7, 0.5)

    def bucket(run, size):
        h = sum(x * c for x, c in zip(run, (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F))) & 0xFFFFFFFF
        h ^= size * 0x165667B1 & 0xFFFFFFFF
        h = (h ^ h >> 15) * 0x2C1B3C6D & 0xFFFFFFFF
        return h >> 12 & langid.BUCKETS - 1

    for text in ("Der schnelle Fuchs, 99 Mal!", "ünï çødé  --  x", "ab", "x" * 50, "日本語 テキスト です"):
        data = b" " + text.lower().encode() + b" "
        data = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in data)
        while b"  " in data:
            data = data.replace(b"  ", b" ")
        rows = [model.table[bucket(data[i : i + n], n)] for i in range(len(data) - 3) for n in (2, 3, 4)]
        z = (np.sum(rows, axis=0) / max(1, len(rows)) + model.bias) / model.temperature
        want = np.exp(z) / np.exp(z).sum()
        assert np.allclose(model.scores(text), want), text


def test_risk_over_patterns_equals_that_over_texts(spark, monkeypatch):
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["mild", "words", "vile", "viler", "bad", "bad"], int(n))) for n in rng.integers(0, 9, 300)]
    kept = np.unique([x for w in ("vile", "bad") for f in toxicity.word_features(w) for x in (f, f + 1)])
    bags = [toxicity.features(t) for t in texts]
    w, b = rng.normal(size=len(kept)), -0.3
    want = toxicity.moments(toxicity.dense(bags, kept), np.ones(len(bags)), w, b) / len(bags)
    df = spark.createDataFrame([(i, t or None) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    table = toxicity.pattern_counts(df, kept).cache()
    assert np.allclose(toxicity.Patterns(table, len(kept))(w, b), want)
    monkeypatch.setattr(toxicity, "PATTERNS", 1)  # a job for each step
    assert np.allclose(toxicity.Patterns(table, len(kept))(w, b), want)
    # the score is the plain sum of weights over the text's features
    model = toxicity.Model({int(k): float(x) for k, x in zip(kept, w)}, b)
    got = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    for i, bag in enumerate(bags):
        assert np.isclose(got[i], 1 / (1 + np.exp(-(b + sum(model.weight.get(int(x), 0.0) for x in bag)))))


@pytest.fixture(scope="module")
def graded(spark):
    rng = np.random.default_rng(6)
    rows, labels = [], []
    for i in range(500):
        good = i % 3 != 0
        text = (prose(rng, int(rng.integers(10, 400))) + ".") if good else " ".join("".join(rng.choice(list("zqxj$#@!0189"), int(rng.integers(3, 14)))) for _ in range(int(rng.integers(10, 300))))
        rows.append((i, text, i))
        labels.append((i, int(good), 0))
    return spark.createDataFrame(rows, "doc_id bigint, text string, _score bigint"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_quality(graded):
    docs, labels = graded
    learn = in_fold("doc_id", 4, 0, 1, 3)
    net = quality.train(docs.where(learn), labels.where(learn))
    got = {r.doc_id: r.score for r in quality.score(docs, net).collect()}
    held = [r.doc_id for r in docs.where(in_fold("doc_id", 4, 2)).collect()]
    assert np.mean([(got[i] >= 0.5) == (i % 3 != 0) for i in held]) > 0.93
    kept = quality.score(docs, net, keep_as="p")
    assert kept.columns == ["doc_id", "text", "_score", "p"] and docs.columns == ["doc_id", "text", "_score"]
    assert all(r["_score"] == r.doc_id for r in kept.collect())
    odd = docs.limit(2).withColumn("text", F.lit(None).cast("string"))
    assert quality.score(odd, net).select("score").distinct().count() == 1 and quality.score(docs.limit(0), net).count() == 0


def test_network_is_a_convolution_over_all_chunks():
    rng = np.random.default_rng(8)
    net = quality.fit([rng.bytes(900) for _ in range(40)], rng.integers(0, 2, 40).astype(np.float32), epochs=1)
    data = bytes(rng.integers(1, 256, 3000).astype(np.uint8))
    groups = list(quality.chunks(data))
    rows = np.concatenate(groups)
    covered = np.zeros(len(data), bool)
    for i in range(len(rows)):
        covered[i * quality.STEP : i * quality.STEP + quality.CHUNK] = True
    assert covered.all()
    one = rows[1]
    plain = np.array([sum(net.taps[j][one[p + j]] for j in range(quality.TAPS)) for p in range(quality.CHUNK - quality.TAPS + 1)])
    assert np.allclose(plain, net.responses(rows[1:2])[0], atol=1e-4)
    assert np.allclose(np.maximum(0, plain.max(axis=0) + net.offset), net.pooled(rows[1:2])[0], atol=1e-4)


@pytest.fixture(scope="module")
def language_model(spark):
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(["the river stone"] * int(rng.integers(5, 20))) if i % 2 else prose(rng, 40)) for i in range(120)] + [(500, None), (501, ""), (502, "unseen zzyzx words")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    return docs, *lm.train(docs)


def test_lm_scores_equal_brute_force(language_model):
    docs, vocab, net = language_model
    got = {r.doc_id: r for r in lm.score(docs, vocab, net).collect()}
    for r in [x for x in docs.collect() if x.doc_id in (0, 1, 500, 501, 502)]:
        tokens = lm.encode(vocab, r.text).tolist()
        total = 0.0
        for i, y in enumerate(tokens):
            z = net.hb.astype(np.float64).copy()
            for j, o in enumerate(lm.OFFSETS):
                near = tokens[i + o] if 0 <= i + o < len(tokens) else lm.VOCABULARY
                z += net.emb[j][near]
            h = np.tanh(z)
            a, b = h @ net.cw + net.cb, h @ net.tw[y // lm.SIDE] + net.tb[y // lm.SIDE]
            total += a[y // lm.SIDE] - np.log(np.exp(a).sum()) + b[y % lm.SIDE] - np.log(np.exp(b).sum())
        assert got[r.doc_id].n_tokens == len(tokens) and abs(got[r.doc_id].log_probability - total) < 1e-2 * max(1, len(tokens))
    assert got[500].log_probability == got[501].log_probability == 0


def test_lm_probabilities_sum_to_one(language_model):
    _, vocab, net = language_model
    row, at = lm.padded_row([lm.encode(vocab, "the river stone")])
    total = 0.0
    for y in range(lm.VOCABULARY):
        row2 = row.copy()
        row2[at[1]] = y  # the token itself is masked, so its context is the same
        total += np.exp(net.log_probabilities(row2, at[1:2])[0])
    assert abs(total - 1) < 1e-3


def test_lm_prefers_what_it_has_seen(language_model, spark):
    _, vocab, net = language_model
    docs = spark.createDataFrame([(1, "the river stone the river stone the river stone"), (2, "stone the the river river stone stone river the")], "doc_id bigint, text string")
    got = {r.doc_id: r.log_probability for r in lm.score(docs, vocab, net).collect()}
    assert got[1] > got[2]


def test_lm_counts_are_whole(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, None), (3, "b " * 5000)], "doc_id bigint, text string")
    assert {r.word: r.n for r in lm.word_counts(docs).collect()} == {"a": 2, "b": 5001}
    assert lm.score(docs.limit(0), *lm.train(docs.limit(0))).count() == 0


def test_lm_learns_from_every_position(spark):
    """A row of the embeddings moves only by a position that has its word in its context, so all that occur must move."""
    texts = [" ".join(f"w{i}x{k}" for k in range(1 + i % 6)) for i in range(60)]
    vocab, net = lm.train(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), fit_docs=0)
    first, unmoved = lm.Network(), []
    for t in texts:
        tokens = lm.encode(vocab, t).tolist()
        assert all(y < vocab.first for y in tokens)
        for i in range(len(tokens)):
            for j, o in enumerate(lm.OFFSETS):
                if 0 <= i + o < len(tokens) and np.array_equal(net.emb[j][tokens[i + o]], first.emb[j][tokens[i + o]]):
                    unmoved.append((t, i, o))
    assert not unmoved


@pytest.mark.parametrize("listed", [1 << 17, 300, 0])
def test_lm_tells_bucketed_words_apart(spark, monkeypatch, listed):
    """Brute force of p(bucket) * p(word in bucket), with all, some and none of the counts held by the tasks."""
    monkeypatch.setattr(lm, "LISTED", listed)
    texts = [" ".join(f"w{i}" for i in range(a, a + 200)) for a in range(0, 1600, 100)] + ["rare " * 3 + "w1 once", "x" * 100 + " y " + "x" * 100, None, "", "w1590 rare w1590"]
    rows = list(enumerate(texts)) + [(None, "rare"), (3, texts[3]), (3, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    vocab, net = lm.train(docs, fit_docs=0)
    counts = Counter(w for _, t in rows for w in lm.tokens_of(t))
    token = {w: int(lm.encode(vocab, w)[0]) for w in counts}
    bucketed = Counter()
    for w, n in counts.items():
        bucketed[token[w]] += n * (token[w] >= vocab.first)
    assert len(vocab.listed) <= listed and sum(t >= vocab.first for t in token.values()) > 600
    rows.append((77, "never w1 seen rare"))
    got = lm.score(spark.createDataFrame(rows, "doc_id bigint, text string"), vocab, net).collect()

    def plain(t):
        row, at = lm.padded_row([lm.encode(vocab, t)])
        within = [np.log(max(1, counts[w]) / (bucketed[k] + 1)) for w, k in zip(lm.tokens_of(t), lm.encode(vocab, t).tolist()) if k >= vocab.first]
        return net.log_probabilities(row, at).sum() + sum(within)

    order = lambda x: (x[0] is None, x[0] or 0, x[1], x[2])
    want = sorted(((i, len(lm.tokens_of(t)), plain(t)) for i, t in rows), key=order)
    got = sorted(((r.doc_id, r.n_tokens, r.log_probability) for r in got), key=order)
    assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want], atol=1e-3)
