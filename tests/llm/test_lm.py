import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from dialectic.llm import gru, lm
from tests.llm.helpers import docs


def test_gradient():
    rng = np.random.default_rng(0)
    p = gru.initial(rng.integers(0, 50, gru.VOCAB))
    ids, mask = rng.integers(0, gru.VOCAB, (5, 6)), rng.random((5, 6)) < 0.8
    _, grad = gru.loss_and_gradient(p, ids, mask)
    for k in gru.SHAPES:
        at = np.unravel_index(np.argmax(np.abs(grad[k])), grad[k].shape)
        e = 1e-5
        p[k][at] += e
        up = gru.loss_and_gradient(p, ids, mask)[0]
        p[k][at] -= 2 * e
        down = gru.loss_and_gradient(p, ids, mask)[0]
        p[k][at] += e
        assert grad[k][at] == pytest.approx((up - down) / (2 * e), rel=1e-4)


def test_score_is_the_sum_over_the_whole_text():
    rng = np.random.default_rng(1)
    p = gru.initial(rng.integers(0, 50, gru.VOCAB))
    lengths = np.array([3, 600, 1, 256, 257])
    ids = rng.integers(0, gru.VOCAB, lengths.sum())
    got, at = gru.score(p, ids, lengths), 0
    for n, g in zip(lengths, got):
        assert g == pytest.approx(-gru.loss_and_gradient(p, ids[None, at:at + n], np.ones((1, n)))[0], rel=1e-4)
        at += n
    every = np.zeros(gru.VOCAB)
    states = rng.normal(size=(1, gru.WIDTH))
    for i in range(gru.VOCAB):
        every[i] = gru.log_probabilities(p, states, np.array([i]))[0]
    assert np.exp(every).sum() == pytest.approx(1)


def plain(texts, ids):
    def toks(t):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x20\x09-\x0D]+", low) + [None]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i in ids]
    c = Counter(w for t, h in zip(texts, held) if not h for w in toks(t))
    n, v = sum(c.values()), len(c)
    return [(i, h, len(toks(t)), sum(c[w] > 0 for w in toks(t)), n,
             round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in toks(t)), 6)) for i, h, t in zip(ids, held, texts)]


def corpus(n, seed=0):
    rnd = random.Random(seed)
    a, b = [f"a{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    out = []
    for i in range(n):
        vocab = a if i % 2 else b
        words = [rnd.choice(vocab) if rnd.random() < .97 else f"r{rnd.randrange(10 ** 6)}" for _ in range(rnd.randint(5, 120))]
        out.append(rnd.choice([" ", "\n", "  \t"]).join(words))
    return out


@pytest.mark.parametrize("head", [1 << 16, 40, 0])
def test_base_matches_plain_counts(spark, monkeypatch, head):
    monkeypatch.setattr(lm, "frequent_words", lambda c, f=lm.frequent_words: f(c, head))
    monkeypatch.setattr(lm, "TASK_WORDS", 50)
    monkeypatch.setattr(lm, "GROUP_TOKENS", 500)
    texts = [None, "", "É é A a", "x " * 3000] + corpus(80) + ["twin row"] * 2
    ids = [None] + list(range(1, len(texts) - 1)) + [len(texts) - 2]
    d = docs(spark, texts, ids).withColumnRenamed("source", "held_out")
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))
           for r in lm.score_documents(d, rounds=1).collect()]
    assert sorted(got, key=str) == sorted(plain(texts, ids), key=str)
    assert all(r.score < 0 for r in lm.score_documents(d, rounds=1).collect())


def test_patterned_words_are_counted_apart(spark):
    from tests.llm.test_tokens import patterned
    texts, ids = [patterned(1024)[0], patterned(1024)[1], patterned(2048)[0]] * 2, list(range(6))
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))
           for r in lm.score_documents(docs(spark, texts, ids), rounds=1).collect()]
    assert sorted(got) == sorted(plain(texts, ids))


def test_model_beats_the_base_on_held_out_texts(spark):
    texts = corpus(600, 3)
    rows = lm.score_documents(docs(spark, texts)).filter("held_out").collect()
    assert len(rows) > 50
    assert sum(r.score for r in rows) > 0.97 * sum(r.base_score for r in rows)


def test_empty_and_untrained(spark):
    assert lm.score_documents(docs(spark, [])).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = lm.score_documents(docs(spark, ["a b"], [held])).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, 3, 0, 0, 0.0)


def test_training_takes_whole_texts(spark):
    """Every word and every end is trained on, also in texts without blanks."""
    texts = [" ".join(f"w{i % 50}" for i in range(1000)), "", "漢" * 500, "a b c"]
    d = spark.createDataFrame([(t,) for t in texts], "text string")
    words = lm.Vocabulary(*lm.frequent_words(lm.count_words(d.selectExpr("cast(text as binary) as text"))))
    got = sorted([r.ids for r in lm.training_texts(d, words).collect()], key=len)
    assert [len(x) for x in got] == [1, 2, 4, 1001]
    assert all(x[-1] == gru.END and gru.END not in x[:-1] and gru.OUTSIDE not in x for x in got)
    p = gru.initial(words.model_counts)
    assert gru.train(p, [np.array(x) for x in got])[1] == 1008


def test_state_is_carried_from_window_to_window():
    """Windows that continue a text give the whole text's likelihood."""
    rng = np.random.default_rng(2)
    p = gru.initial(rng.integers(0, 50, gru.VOCAB))
    ids = rng.integers(0, gru.VOCAB, 60)
    h, last, total = np.zeros((1, gru.WIDTH)), np.full(1, gru.END), 0.0
    for a in range(0, 60, gru.WINDOW):
        x = ids[None, a:a + gru.WINDOW]
        loss, *_, h = gru._pass(p, x, np.ones(x.shape, bool), h, last)
        last, total = x[:, -1], total + loss
    assert total == pytest.approx(-gru.score(p, ids, np.array([60]))[0], rel=1e-4)


def test_frequent_words_are_exactly_the_first(spark):
    rows = [(i * 2 ** 50 + 7, i, 9 if i % 2 else 100) for i in range(-3000, 3000)] + [(1, 1, 500)]
    counts = spark.createDataFrame(rows, "a long, b long, n long")
    want = sorted(rows, key=lambda r: (-r[2], r[0], r[1]))
    for limit in (0, 1, 2, 2000, 3001, 5000, 10000):
        a, b, n = lm.frequent_words(counts, limit)
        assert list(zip(a.view(np.int64).tolist(), b.view(np.int64).tolist(), n.tolist())) == want[:limit]


def test_vocabulary_sizes_the_model():
    a = np.arange(1, 20001, dtype=np.uint64)
    words = lm.Vocabulary(a, a, np.full(len(a), 3))
    assert len(words.model_counts) == 20002 and len(set(words.look(a, a)[1].tolist())) == 20000
    p = gru.initial(words.model_counts)
    assert [p[level].shape[:2] for level in gru.LEVELS] == [(1, 26), (26, 28), (26 * 28, 28)]
    states = np.zeros((1, gru.WIDTH))
    got = gru.log_probabilities(p, np.repeat(states, 20002, axis=0), np.arange(20002))
    assert np.exp(got).sum() == pytest.approx(1)


@pytest.mark.parametrize("scale", [1, 1000])
def test_nodes_of_few_rows_share_products(monkeypatch, scale):
    """A softmax node met by a few rows has no products of its own; log-softmax
    and gradients are those of every row by itself."""
    rng = np.random.default_rng(4)
    sizes = [1, 2, 33, 1, 5, 32, 100, 0, 2, 1] + [1, 2, 3] * 100
    node = np.repeat(np.arange(len(sizes)), sizes)
    n, w = len(node), rng.normal(size=(len(sizes), 7, gru.WIDTH + 1)) * scale
    states, branch = rng.normal(size=(n, gru.WIDTH + 1)), rng.integers(0, 7, n)
    calls = []
    for name in ("dot", "matmul"):
        monkeypatch.setattr(np, name, lambda *a, f=getattr(np, name), **k: (calls.append(1), f(*a, **k))[1])
    out, met, dw, ds = gru._softmax(w, states, node, branch, slope=True)
    monkeypatch.undo()
    assert len(calls) < 60
    x = np.einsum("nk,nbk->nb", states, w[node])
    x -= x.max(axis=1, keepdims=True)
    log = x - np.log(np.exp(x).sum(axis=1, keepdims=True))
    d = np.exp(log) - np.eye(7)[branch]
    grad = np.zeros_like(w)
    np.add.at(grad, node, d[:, :, None] * states[:, None])
    assert sorted(met.tolist()) == sorted(set(node.tolist()))
    np.testing.assert_allclose(out, log[np.arange(n), branch], rtol=1e-9, atol=1e-9)
    np.testing.assert_allclose(dw, grad[met], rtol=1e-9, atol=1e-9 * scale)
    np.testing.assert_allclose(ds, np.einsum("nb,nbk->nk", d, w[node]), rtol=1e-9, atol=1e-9 * scale)
