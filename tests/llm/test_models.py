"""Trained operators: held-out accuracy, gradients, exact baselines, odd inputs."""

import decimal
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from webgrain.llm import language, lm_score, quality
from webgrain.llm.common import text_bytes

from .test_filters import DOCS, LOW, with_clashes
from .test_whole_corpus import loss, sequences

ODD = [(900, None), (901, ""), (902, " \n\t"), (903, "!!! 123"), (904, "x" * 200000), (905, "Été \U0001f600 漢字"), (905, "Été \U0001f600 漢字"), (None, "no id at all")]


def crc(k, n):
    return zlib.crc32(("" if k is None else str(k)).encode()) % n


def prose(rng, lang, n):
    parts = {"en": ["the", "ing", "th", "er", "and", "wh"], "fr": ["é", "eau", "le", "que", "ou", "ç"], "de": ["sch", "ü", "ung", "der", "ein", "ß"]}[lang]
    return " ".join("".join(rng.choice(parts, rng.integers(1, 4))) for _ in range(n))


# -- language ----------------------------------------------------------------------


def test_backpropagation_through_time_is_the_gradient():
    rng = np.random.default_rng(0)
    net = language.fresh(["a", "b"], hidden=3)
    for p in (net.x, net.u, net.out):
        p *= 2
    tokens = rng.integers(0, 256, (4, 6))
    tokens[1, 4:] = language._PAD
    tokens[3, 1:] = language._PAD
    labels = np.array([0, 1, 1, 0])
    _, grads = language.gradients(net, tokens, labels)
    for p, g in zip(net.parameters(), grads):
        flat, gf = p.reshape(-1), g.reshape(-1)
        for k in np.argsort(-np.abs(gf))[:4]:
            old = flat[k]
            flat[k] = old + 1e-2
            up, _ = language.gradients(net, tokens, labels)
            flat[k] = old - 1e-2
            down, _ = language.gradients(net, tokens, labels)
            flat[k] = old
            assert abs((up - down) / 2e-2 - gf[k]) < 2e-3 + 0.05 * abs(gf[k])


def plain_gru(net, text):
    """Mean probabilities of a text's bytes, one segment, one byte and one gate after the other."""
    sig = lambda v: 1 / (1 + np.exp(-v))
    hidden = net.u.shape[1]
    total, data = np.zeros(len(net.langs)), text.encode()
    for at in range(0, len(data), language.SEGMENT):
        piece = data[at : at + language.SEGMENT]
        sides = []
        for side, order in ((0, range(len(piece))), (1, range(len(piece) - 1, -1, -1))):
            h, states = np.zeros(hidden), {}
            for t in order:
                x, u = net.x[side][piece[t]].astype(float), net.u[side].astype(float)
                z = sig(x[:hidden] + h @ u[:, :hidden])
                r = sig(x[hidden : 2 * hidden] + h @ u[:, hidden : 2 * hidden])
                new = np.tanh(x[2 * hidden :] + r * (h @ u[:, 2 * hidden :]))
                h = z * h + (1 - z) * new
                states[t] = h
            sides.append(states)
        for t in range(len(piece)):
            logits = np.concatenate([sides[0][t], sides[1][t]]) @ net.out + net.bias
            e = np.exp(logits - logits.max())
            total += e / e.sum()
    return total / len(data)


def test_pooled_probabilities_are_those_of_a_plain_network():
    net = language.fresh(["a", "b", "c"])
    for p in (net.x, net.u, net.out):
        p *= 2
    net.bias[:] = [0.1, -0.3, 0.2]
    texts = ["short", "a longer text " * 30, "é" * 100, "x"]
    got = language.pooled(net, *text_bytes(pa.array(texts)))
    assert np.allclose(got, [plain_gru(net, t) for t in texts], atol=1e-4)


def test_padding_and_batches_change_nothing():
    net = language.fresh(["a", "b", "c"])
    texts = ["short", "a longer text " * 30, "", "é" * 100]
    raw, offsets = text_bytes(pa.array(texts))
    whole = language.pooled(net, raw, offsets)
    for i, t in enumerate(texts):
        one = language.pooled(net, *text_bytes(pa.array([t])))
        assert np.allclose(whole[i], one[0], atol=1e-5)
    assert np.allclose(whole.sum(axis=1), 1)


def test_languages_of_long_texts_alone_are_learnt(spark):
    rng = np.random.default_rng(6)
    docs = [(i, prose(rng, "en", 40), "en") for i in range(60)] + [(100 + i, prose(rng, "fr", 9000), "fr") for i in range(9)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)
    net = language.train(df)
    assert net.langs == ["en", "fr"] and min(len(t.encode()) for _, t, x in docs if x == "fr") > 1 << 15
    assert all(r.lang_pred == ("fr" if r.doc_id >= 100 else "en") for r in language.identify(df, net).collect())


def test_language_on_held_out_documents(spark):
    rng = np.random.default_rng(1)
    docs = [(i, prose(rng, lang, int(rng.integers(5, 80))), lang) for i, lang in enumerate(rng.choice(["en", "fr", "de"], 150).tolist())]
    docs += [(k, t, None) for k, t in ODD]
    df = with_clashes(spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3))
    net = language.train(df)
    assert net.langs == ["de", "en", "fr"]
    rows = language.identify(df, net).collect()
    assert len(rows) == len(docs)
    truth = {k: lang for k, _, lang in docs if lang}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 20 and sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.9
    assert all(r.held_out == (crc(r.doc_id, 3) == 1) and 0 <= r.score <= 1 for r in rows)
    by = {r.doc_id: r for r in rows}
    assert [by[k].lang_pred for k in (900, 901, 902, 903)] == ["und"] * 4 and by[904].lang_pred != "und"


def test_language_without_training_rows(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    net = language.train(df)
    assert [(r.lang_pred, r.score) for r in language.identify(df, net).collect()] == [("und", 0.0)]
    assert language.identify(df.limit(0), net).count() == 0
    one = language.train(spark.createDataFrame([(k, "abc", "xx") for k in range(9)], df.schema))
    assert language.identify(df, one).first().lang_pred == "xx"


# -- quality -----------------------------------------------------------------------


def graded(rng, n):
    docs, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        text = prose(rng, "en", int(rng.integers(20, 120)))
        if not good:
            text = text.upper().replace(" ", "!! ") if rng.random() < 0.5 else " | ".join(text.split())
        docs.append((i, text))
        labels.append((i, int(good)))
    return docs, labels


def test_quality_on_held_out_documents(spark):
    docs, labels = graded(np.random.default_rng(2), 400)
    df = with_clashes(spark.createDataFrame(docs + ODD, DOCS).repartition(3))
    marks = spark.createDataFrame([*labels, (3, None), (None, 1), (5, 7)], "doc_id long, quality int")
    model = quality.train(df, marks)
    assert model.rules and all(len(r) <= quality.DEPTH for r in model.rules)
    rows = quality.score(df, model).collect()
    truth = dict(labels)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 40 and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    assert len(rows) == len(docs) + len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (crc(r.doc_id, 5) == 0) for r in rows)


def test_compiled_rules_score_as_the_model_does(spark):
    docs, labels = graded(np.random.default_rng(3), 120)
    df = spark.createDataFrame(docs, DOCS)
    model = quality.train(df, spark.createDataFrame(labels, "doc_id long, quality int"))
    x = quality.statistics(*text_bytes(pa.array([t for _, t in docs])))
    want = 1 / (1 + np.exp(-(model.bias + sum(w * quality.holds(r, x) for r, w in zip(model.rules, model.weights)))))
    got = {r.doc_id: r.score for r in quality.score(df, model).collect()}
    assert np.allclose([got[k] for k, _ in docs], want)


def test_lasso_drops_rules_and_meets_its_conditions():
    rng = np.random.default_rng(4)
    a = (rng.random((500, 30)) < 0.4).astype(np.float32)
    y = (rng.random(500) < 1 / (1 + np.exp(-(3 * a[:, 0] - 2 * a[:, 1])))).astype(float)
    w, b = quality.lasso_logistic(a, y, 0.02, 3000)
    g = a.T @ (1 / (1 + np.exp(-(a @ w + b))) - y) / len(y)
    assert w[0] > 0.5 and w[1] < -0.3 and (w[2:] == 0).sum() > 20
    assert (np.abs(g[w == 0]) <= 0.021).all() and np.allclose(g[w != 0], -0.02 * np.sign(w[w != 0]), atol=1e-3)


def test_quality_without_labels(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], DOCS)
    model = quality.train(df, spark.createDataFrame([], "doc_id long, quality int"))
    assert [r.score for r in quality.score(df, model).collect()] == [0.5, 0.5]
    assert quality.score(df.limit(0), model).count() == 0


def test_statistics_of_odd_texts():
    x = quality.statistics(*text_bytes(pa.array(["", None, "AB!! cd", "a\na\nb"])))
    at = {s: i for i, s in enumerate(quality.STATISTICS)}
    assert not x[:2].any() and x[2, at["capitals"]] == 0.5 and x[2, at["mark_33"]] == 1 and x[2, at["doubled_marks"]] == 0.5
    assert abs(x[3, at["repeated_lines"]] - 1 / 3) < 1e-9 and x[2, at["capital_words"]] == 0.5


# -- language model ----------------------------------------------------------------


def tokens(text):
    return [*re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOW)), None]


def check_scores(docs, rows):
    count = Counter(t for k, text in docs if crc(k, 5) != 1 for t in tokens(text))
    total, kinds = sum(count.values()), len(count)
    want = []
    for k, text in docs:
        t = tokens(text)
        base = sum(math.log10((count[x] + 0.5) / (total + 0.5 * (kinds + 1))) for x in t)
        want.append((str(k), crc(k, 5) == 1, len(t), sum(count[x] > 0 for x in t), total, round(base, 6)))
    got = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows]
    assert sorted(got) == sorted(want)


def test_scores_and_baseline(spark, monkeypatch):
    rng = np.random.default_rng(5)
    docs = [(i, prose(rng, ["en", "fr"][i % 2], int(rng.integers(1, 150)))) for i in range(120)] + ODD
    df = with_clashes(spark.createDataFrame(docs, DOCS).repartition(3))
    rows = lm_score.score(df).collect()
    check_scores(docs, rows)
    assert all(np.isfinite(r.score) and r.score < 0 for r in rows)
    long = [r for r in rows if r.held_out and r.n_tokens > 20 and r.doc_id and r.doc_id < 900]
    assert sum(r.score for r in long) > 1.3 * sum(r.base_score for r in long)
    monkeypatch.setattr(lm_score.frequent, "__defaults__", (20,))  # most words by the join
    joined = lm_score.score(df).collect()
    check_scores(docs, joined)
    assert {r.doc_id for r in joined} == {r.doc_id for r in rows}


def test_scores_without_training_rows(spark):
    held = next(k for k in range(99) if crc(k, 5) == 1)
    (r,) = lm_score.score(spark.createDataFrame([(held, "a b")], DOCS)).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and np.isfinite(r.score)
    assert lm_score.score(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("kind,keys", [("smallint", [1, 2, 3]), ("decimal(9,1)", [decimal.Decimal("1.5"), None, decimal.Decimal("2.0")]), ("string", ["a", "b", "b"]), ("double", [0.5, 1.5, 2.5])])
def test_scores_with_keys_of_any_type(spark, kind, keys):
    df = spark.createDataFrame([(k, "some words and words") for k in keys], f"doc_id {kind}, text string")
    rows = lm_score.score(df).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(map(str, keys)) and all(r.n_tokens == 5 for r in rows)


def small_net(seed=0):
    sub = lm_score.Subwords(lm_score.rank_path())
    rng = np.random.default_rng(seed)
    counts = np.zeros(sub.size)
    some = np.flatnonzero(sub.opens)
    counts[rng.choice(some, 300)] = rng.integers(1, 50, 300)
    class_of = lm_score.classes_of(counts, lm_score.ALONE, lm_score.BANDS)
    pairs = np.zeros((lm_score.CLASSES, sub.size))
    pairs[0] = counts
    net = lm_score.fresh(pairs, counts, class_of, sub.opens, sub.end)
    net.near += rng.normal(0, 1, net.near.shape).astype(np.float32)
    return sub, net


def test_each_token_is_scored_once_with_a_proper_distribution():
    sub, net = small_net()
    assert np.allclose([(10.0 ** net.within[c])[net.class_of == k].sum() for c in (0, 5) for k in np.unique(net.class_of[sub.opens])], 1, atol=1e-4)
    rng = np.random.default_rng(1)
    kinds = np.flatnonzero(sub.opens)[:400]
    first, last = np.append(sub.end, kinds), np.append(sub.end, rng.integers(0, sub.size, len(kinds)))
    counts = np.array([1, 15, 16, 17, 70])
    tokens = np.concatenate([np.append(rng.integers(1, len(first), n - 1), 0) for n in counts])
    words = lm_score.Words(np.zeros(len(first), np.uint64), [], tokens, counts)
    got = lm_score.Scorer(net).text_scores(words, first, last, batch=3)

    def plain(text):  # one token after the other
        total, seen = 0.0, [0, *text.tolist()]
        for t, goal in enumerate(text):
            start = max(0, (t // lm_score.BLOCK - 1) * lm_score.BLOCK)
            some = np.array(seen[start : t + 1])
            e = (net.embed[net.own_first[first[some]]] + net.embed[net.own_last[last[some]]]).astype(float)
            s = (e[-1] @ net.wq) @ (e @ net.wk).T / 4 + net.near[np.arange(len(e))[::-1]]
            p = np.exp(s - s.max())
            a = (p / p.sum()) @ (e @ net.wv)
            z = np.maximum(np.concatenate([e[-1], a]) @ net.w1 + net.b1, 0) @ net.w2 + net.b2
            z -= z.max()
            kind = net.class_of[first]
            total += (z[kind[goal]] - np.log(np.exp(z).sum())) / np.log(10) + net.within[kind[seen[t]], first[goal]]
        return total

    assert np.allclose(got, [plain(t) for t in np.split(tokens, np.cumsum(counts)[:-1])], rtol=1e-3)


def test_spelling_of_known_and_unknown_words_sums_to_one():
    """Over all words of at most three ids out of a few, the rest being the mass of longer ones."""
    size, end = 6, 5
    after = np.random.default_rng(2).dirichlet(np.ones(size), 2).astype(np.float32)
    tokens, kinds = np.array([9, 0, 0, 0, 0, 3]), np.array([2, 0, 0, 0, 0, 1])
    pairs = np.array([0 * size + 1, 0 * size + end, 1 * size + end])
    times = np.array([3, 1, 2])
    spells = lm_score.Spells(tokens, kinds, np.array([0, 1, 0, 1, 0, 1]), after, pairs, times, np.bincount(pairs // size, times, size), np.bincount(pairs // size, minlength=size), end)
    share = np.array([[spells.share(np.array([a]), np.array([b]))[0] for b in range(size)] for a in range(size)])
    assert np.allclose(share.sum(axis=1), 1, atol=1e-6)
    every = [(0, *m) for n in range(3) for m in itertools.product(range(end), repeat=n)]
    spelling = lm_score.Spelling(np.array([end, *(k for w in every for k in w)]), np.array([1, *map(len, every)]))
    own, below = spells.of(spelling)
    n = np.zeros(len(every) + 1)
    n[1 + every.index((0,))], n[1 + every.index((0, 1))] = 4, 5
    got = 10.0 ** lm_score.word_logs(n, own, below)[1:]
    longer = sum(share[0, a] * share[a, b] * (1 - share[b, end]) for a in range(end) for b in range(end))
    assert abs(got.sum() + kinds[0] * longer / (tokens[0] + kinds[0]) - 1) < 1e-6


def test_gradients_are_those_of_the_loss():
    sub, net = small_net()
    rng = np.random.default_rng(3)
    pad = np.full(lm_score.BLOCK, -1)
    some = rng.choice(np.flatnonzero(sub.opens), 40)
    first, last = np.concatenate([pad, [sub.end], some, pad]), np.concatenate([pad, [sub.end], rng.choice(some, 40), pad])
    begin = np.array([lm_score.BLOCK] * 3)
    windows = (first, last, begin + np.arange(3) * lm_score.BLOCK, begin)
    _, grads = lm_score.gradients(net, *windows)
    for p, g in zip(net.weights(), grads):
        flat, gf = p.reshape(-1), g.reshape(-1)
        for k in np.argsort(-np.abs(gf))[:3]:
            old = flat[k]
            flat[k] = old + 1e-2
            up, _ = lm_score.gradients(net, *windows)
            flat[k] = old - 1e-2
            down, _ = lm_score.gradients(net, *windows)
            flat[k] = old
            assert abs((up - down) / 2e-2 - gf[k]) < 2e-3 + 0.05 * abs(gf[k])


def test_training_lowers_the_loss():
    sub, net = small_net()
    texts = sequences(["the cat sat on the mat again and again"] * 20, sub)
    before = loss(net, texts)
    lm_score.fit(net, texts, steps=150)
    assert loss(net, texts) < 0.8 * before


def test_ids_of_words_are_those_of_each_word():
    sub = lm_score.Subwords(lm_score.rank_path())
    words = [b"the", "été".encode(), b"don't", b"!!!", "\xa0".encode(), "\xa0\xa0x".encode(), b"y" * 5000, b"12ab", "é".encode() * 4000]
    alone = [sub.one(w) for w in words]
    for some in (words, words[:4], words[6:], words[:4] + words[6:]):  # whatever stands beside it
        ids, n = sub.of(some)
        assert [p.tolist() for p in np.split(ids, np.cumsum(n)[:-1])] == [alone[words.index(w)] for w in some]
    w = lm_score.words_of(*text_bytes(pa.array(["", None, "the The", " été\n"])))
    assert w.counts.tolist() == [1, 1, 3, 2]
    spelling = lm_score.Spelling.of(w, sub)
    decoded = [sub.encoding.decode(p.tolist()) for p in np.split(spelling.ids, np.cumsum(spelling.lengths)[:-1])[1:]]
    assert spelling.ids[0] == sub.end and decoded == [" the", " été"] and w.tokens.tolist() == [0, 0, 1, 1, 0, 2, 0]


def test_pairs_beyond_the_frequent_ones_count_as_exactly(spark, monkeypatch):
    """Scores don't depend on how many words and pairs of ids go to the tasks."""
    rng = np.random.default_rng(8)
    docs = [(i, prose(rng, ["en", "fr"][i % 2], int(rng.integers(1, 80)))) for i in range(60)] + ODD + [(2000, "unheard words zzxyqqv"), (2001, "zzxyqqv qqvzzx qvxzqv")]
    df = spark.createDataFrame(docs, DOCS).repartition(3).cache()
    found = {}
    for most in (lm_score.FREQUENT, 200, 20, 0):
        monkeypatch.setattr(lm_score.frequent, "__defaults__", (most,))
        found[most] = sorted(((str(r.doc_id), r.n_tokens, r.n_known, r.base_score, r.score) for r in lm_score.score(df).collect()))
    for most in (200, 20, 0):
        for a, b in zip(found[lm_score.FREQUENT], found[most], strict=True):
            assert a[:3] == b[:3] and np.allclose(a[3:], b[3:], rtol=1e-6, atol=1e-6), (most, a, b)


def test_runs_of_blocks_have_the_gradients_of_their_windows():
    _, net = small_net()
    rng = np.random.default_rng(4)
    pad, B = np.full(lm_score.BLOCK, -1), lm_score.BLOCK
    sub = lm_score.Subwords(lm_score.rank_path())
    some = rng.choice(np.flatnonzero(sub.opens), 4 * B)
    first, last = np.concatenate([pad, [sub.end], some, pad]), np.concatenate([pad, [sub.end], some[::-1], pad])
    begin = np.full(4, B)
    want = lm_score.gradients(net, first, last, begin + np.arange(4) * B, begin)
    before = [np.concatenate([np.full(B, own[sub.end]), own[ids[B : -B - 1]]]).reshape(1, 5, B) for own, ids in ((net.own_first, first), (net.own_last, last))]
    opens = np.array([[True, False, False, False]])
    got = lm_score.run_gradients(net, *before, opens, net.class_of[some].reshape(1, 4, B))
    assert abs(got[0] - want[0]) < 1e-5 and all(np.allclose(a, b, atol=1e-6) for a, b in zip(got[1], want[1]))
