import random

import numpy as np
from pyspark.sql import functions as F

from dialectic.llm import language
from dialectic.llm.frames import id_remainder
from tests.llm.helpers import docs


def plain_marginals(scores, moves):
    e, m, n = np.exp(scores), np.exp(moves), len(scores)
    a, b = np.zeros_like(e), np.ones_like(e)
    a[0] = e[0]
    for t in range(1, n):
        a[t] = (a[t - 1] @ m) * e[t]
        a[t] /= a[t].sum()
    for t in range(n - 2, -1, -1):
        b[t] = m @ (e[t + 1] * b[t + 1])
        b[t] /= b[t].sum()
    return a * b / (a * b).sum(axis=1, keepdims=True)


def test_blocks_equal_word_by_word():
    rng = np.random.default_rng(0)
    for k in (1, 3, 4):
        size = [1, 31, 32, 33, 64, 300, 2]
        scores, moves = rng.normal(size=(sum(size), k)) * 3, rng.normal(size=(k, k))
        doc = np.repeat(np.arange(len(size)) * 2, size)
        got = language.marginals(scores, doc, moves)
        want = np.concatenate([plain_marginals(scores[doc == d], moves) for d in np.unique(doc)])
        assert np.abs(got - want).max() < 1e-9


def test_words_and_grams():
    w = language.words_of(["Ab c", "", "é1z", "abc ab"])
    assert w.doc.tolist() == [0, 0, 2, 2, 3, 3]
    assert w.whole[0] == w.whole[5] and len(set(w.whole.tolist())) == 5
    assert len(w.grams[0]) == sum((w.end - w.start) + 1)


def make(n, seed=0):
    rnd = random.Random(seed)
    parts = {"xx": ["ka", "to", "mi", "ra"], "yy": ["sch", "ung", "er", "st"], "zz": ["é", "lla", "ñ", "que"]}
    out = []
    for _ in range(n):
        lang = rnd.choice(list(parts))
        out.append((lang, " ".join("".join(rnd.choice(parts[lang]) for _ in range(rnd.randint(1, 4)))
                                   for _ in range(rnd.randint(3, 60)))))
    return out


def test_held_out_accuracy_and_code_switching(spark):
    data = make(400)
    texts = [t for _, t in data] + [None, "", "12 + 34 …", "É", "a" * 50000, data[0][1], data[0][1]]
    langs = [lang for lang, _ in data] + [None] * 7
    d = docs(spark, texts, langs=langs).withColumnRenamed("source", "_x")
    rest = id_remainder("doc_id", 5)
    out = language.identify(d, d.filter(rest != 0))
    assert out.columns == d.columns + ["_lang", "_score"]
    rows = {r.doc_id: r for r in out.withColumn("held", rest == 0).collect()}
    held = [r for r in rows.values() if r.held and r.lang]
    assert len(held) > 40 and np.mean([r._lang == r.lang for r in held]) > 0.97
    assert [rows[400 + i]._lang for i in range(3)] == ["und"] * 3 and rows[403]._lang in ("xx", "yy", "zz")
    assert rows[405]._lang == rows[406]._lang and all(0 <= r._score <= 1 for r in rows.values())
    model = language.train(data[:200])
    got = [lang for _, lang, _ in language.label_words("kato mira toka mimi kara schung stung erst ungst", model)]
    assert got == ["xx"] * 5 + ["yy"] * 4


def test_nothing_to_learn_from(spark):
    d = docs(spark, ["abc", None], langs=[None, "en"])
    assert {r._lang for r in language.identify(d, d).collect()} == {"und"}
    one = docs(spark, ["abc def", "xyz", "12"], langs=["en", None, "en"])
    assert [r._lang for r in language.identify(one, one).orderBy("doc_id").collect()] == ["en", "en", "und"]
    assert language.identify(d.limit(0), d.limit(0)).count() == 0


def test_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(language, "FIT_DOCS", 5)
    d = docs(spark, [f"text {i}" for i in range(200)], langs=["a", "a", "a", "b"] * 50)
    got = language.training_sample(d).groupBy("lang").agg(F.count("*").alias("n")).collect()
    assert {r.lang: r.n for r in got} == {"a": 5, "b": 5}


def test_sample_has_different_texts(spark, monkeypatch):
    monkeypatch.setattr(language, "FIT_DOCS", 5)
    by_hash = spark.createDataFrame([(f"text {i}",) for i in range(20)], "text string").orderBy(F.xxhash64("text"))
    first = [r.text for r in by_hash.collect()]
    d = docs(spark, first[:1] * 1000 + first, langs=["a"] * 1020)
    assert sorted(r.text for r in language.training_sample(d).collect()) == sorted(first[:5])
