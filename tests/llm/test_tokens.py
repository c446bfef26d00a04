import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from dialectic.llm import packing, repair
from dialectic.llm.wordids import Hashes, Memo, WordIds
from tests.llm.helpers import docs

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
ALPHABET = "abzAZé ÉŁñ 09²½ \n\t\r'''.,!-—…“”\xa0\x85İſßsstmdrevell日́​\x1c  "


def strange_texts(n, seed=0):
    rnd = random.Random(seed)
    fixed = ["", "'s", "don't", "DON'T", "'tis 'twas", "we'll we've they're I'd I'm 're 'l 'r'v", "  two  spaces\n\nx \n y ",
             "a'", "''s", "it''s'", "x's't", "'", "'re'", "'s 't", "<|endoftext|>", "x" * 5000, " " * 300]
    return fixed + ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


def library(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return t


@pytest.mark.parametrize("name", FILES)
def test_ids_equal_the_library(name):
    w, texts = WordIds(public_tokenizers.path(name)), strange_texts(3000)
    assert w.style
    want = [e.ids for e in library(name).encode_batch(texts, add_special_tokens=False)]
    for size in (1, 7, 1000):
        got = [x.tolist() for i in range(0, len(texts), size) for x in w.encode(texts[i:i + size])[0]]
        assert got == want
    w.style = None
    assert [x.tolist() for x in w.encode(texts[:50])[0]] == want[:50]


def patterned(n):
    """The Thue-Morse word over a, b and its complement: one polynomial hash modulo 2^64."""
    w = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return w, w.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("name", FILES)
def test_patterned_words_have_their_own_ids(name):
    w, lib = WordIds(public_tokenizers.path(name)), library(name)
    for n in (1024, 2048):
        for texts in (list(patterned(n)), [" ".join(patterned(n))]):
            assert [x.tolist() for x in w.encode(texts)[0]] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_hashes_do_not_depend_on_neighbours_or_lengths():
    h, cps = Hashes(), np.arange(3000, dtype=np.uint32) % 97
    a, b = h(cps, np.array([5, 40, 7, 9]), np.array([12, 40, 9, 2000]))
    again = Hashes()(cps[5:12], np.array([0, 2, 0]), np.array([7, 4, 0]))
    assert (a[0], b[0], a[2], b[2], a[1]) == (again[0][0], again[1][0], again[0][1], again[1][1], again[0][2])


def test_memo_grows_and_finds():
    rng, m = np.random.default_rng(0), Memo(4)
    a = rng.integers(0, 2 ** 63, 5000).astype(np.uint64)
    for i in range(0, 5000, 500):
        assert (m.find(a[i:i + 500], a[i:i + 500]) == -1).all()
        m.add(a[i:i + 500], a[i:i + 500])
    assert (m.find(a, a) == np.arange(5000)).all() and (m.find(a, a + np.uint64(1)) == -1).all()
    cps = np.array([5, 6, 7, 5, 6, 7], np.uint32)
    x, y = Hashes()(cps, np.array([0, 3, 1]), np.array([3, 6, 3]))
    assert x[0] == x[1] != x[2] and y[0] == y[1] != y[2]


def test_compression_round_trip():
    rng = np.random.default_rng(1)
    for n_docs, high, rounds in ((0, 5, 3), (1, 2, 6), (40, 6, 6), (60, 1, 6), (30, 50000, 2)):
        ids = [rng.integers(0, high, rng.integers(0, 3000)).astype(np.uint32) for _ in range(n_docs)]
        blob = repair.write_block(ids, 50257)
        b = repair.Block(blob)
        assert [x.tolist() for x in b.all()] == [x.tolist() for x in ids]
        for i, x in enumerate(ids):
            assert b.ids(i).tolist() == x.tolist()
            lo, hi = sorted(rng.integers(0, len(x) + 2, 2))
            assert b.ids(i, lo, hi).tolist() == x[lo:hi].tolist()
    same = [np.tile(np.arange(50, dtype=np.uint32), 200)]
    assert len(repair.write_block(same, 50257)) < 2 * 10000 / 4


def test_shards_keep_every_id(spark, monkeypatch):
    texts = [None, ""] + strange_texts(150, 3) + ["long text " * 4000] + ["again and again"] * 5
    ids = [None, None] + [7] * 5 + list(range(len(texts) - 7, 0, -1))
    path, lib = public_tokenizers.path(FILES[0]), library(FILES[0])
    d = docs(spark, texts, ids).withColumnRenamed("source", "shard").repartition(3)
    got = [r for r in repair.read_shards(repair.write_shards(d, path, 0)).collect()]
    assert len(got) == len(texts)
    crc = {}
    for i, t in zip(ids, texts):
        x = lib.encode(t or "", add_special_tokens=False).ids + [0]
        crc.setdefault(i, []).append((len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
    mine, at = {}, 0
    got.sort(key=lambda r: r.start)
    for r in got:
        mine.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
        assert r.start == at
        at += r.n_tokens
    assert {k: sorted(v) for k, v in mine.items()} == {k: sorted(v) for k, v in crc.items()}
    order = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert order == sorted(order)
    assert repair.read_shards(repair.write_shards(docs(spark, []), path, 0)).count() == 0


def check_pieces(got, texts, ids, lib, end, window):
    want = {}
    for i, t in zip(ids, texts):
        want.setdefault(i, []).append(lib.encode(t or "", add_special_tokens=False).ids + [end])
    pieces, seqs = {}, {}
    for r in got:
        x = np.frombuffer(r.ids, "<u4").tolist()
        assert len(x) == r.length > 0 and zlib.crc32(bytes(r.ids)) == r.ids_crc32
        pieces.setdefault(r.doc_id, []).append((r.start, x, r.doc_tokens))
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, docs_ in want.items():
        assert sum(len(x) for x in docs_) == sum(len(x) for _, x, _ in pieces[i])
        if len(docs_) == 1:
            assert sum((x for _, x, _ in sorted(pieces[i])), []) == docs_[0]
            assert {n for *_, n in pieces[i]} == {len(docs_[0])}
    assert set(pieces) == set(want)
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= window and (at == window or at & (at - 1) == 0)


def test_packing_keeps_every_id(spark, monkeypatch):
    texts = [None, ""] + strange_texts(120, 4) + ["a very long text " * 3000] + ["same words here"] * 30
    ids = [None, 1, 1] + list(range(2, len(texts) - 1))
    path, lib = public_tokenizers.path(FILES[1]), library(FILES[1])
    d = docs(spark, texts, ids).withColumnRenamed("source", "offset")
    for window in (16, 4096):
        check_pieces(packing.pack(d, path, 2, window).collect(), texts, ids, lib, 2, window)
    assert packing.pack(docs(spark, []), path, 2).count() == 0


def test_neighbours_follow_bm25():
    rnd = random.Random(2)
    texts = [[rnd.randrange(60) for _ in range(rnd.choice([0, 3, 12, 30, 90]))] for _ in range(50)]
    terms = [np.array(t, np.uint64) for t in texts]
    index, n = packing.Bm25(terms), len(texts)
    mean = sum(map(len, texts)) / n
    df = {w: sum(w in t for t in texts) for t in texts for w in t}
    used = np.zeros(n, bool)
    used[::7] = True
    for seed in range(n):
        words = [w for w in set(texts[seed]) if df[w] > 1]
        score = {}
        for d in range(n):
            if not used[d]:
                s = 0.0
                for w in words:
                    tf = texts[d].count(w)
                    s += np.log1p((n - df[w] + .5) / (df[w] + .5)) * tf * 2.2 / (
                        tf + 1.2 * (0.25 + 0.75 * len(texts[d]) / mean)) if tf else 0
                if s:
                    score[d] = s
        got = index.neighbours(seed, used, n).tolist()
        assert set(got) == set(score)
        assert np.allclose([score[d] for d in got], sorted(score.values(), reverse=True))
        few = index.neighbours(seed, used, 5).tolist()
        assert len(few) >= min(5, len(got)) and few == got[:len(few)]


def test_sequences_need_no_padding():
    for total in (0, 1, 5, 4095, 4096, 10000):
        starts = packing.sequence_starts(total)
        sizes = np.diff(np.append(starts, total))
        assert sizes.sum() == total and all(s == 4096 or s & (s - 1) == 0 for s in sizes.tolist())


def test_neighbours_are_looked_up_by_all_terms():
    """A seed with 30 terms of one neighbour still finds the others."""
    n = 10
    rare = [np.uint64(k + 1) << np.uint64(44) for k in range(30)]
    common = np.uint64(900) << np.uint64(44)
    terms = [np.array([*rare, common])] + [np.array(rare)] + [np.array([np.uint64(500 + i) << np.uint64(44)])
                                                                 for i in range(n)] + [np.array([common])] * 3
    order = packing.order_by_retrieval(np.full(len(terms), 10), packing.Bm25(terms), 50)
    assert order[:5].tolist() == [0, 1, 2 + n, 3 + n, 4 + n]


def test_terms_do_not_depend_on_how_ids_are_encoded():
    tok = WordIds(public_tokenizers.path("word_bpe_49k.json"))
    plain, emoji, greek, greek2, han, han2 = tok.encode(
        ["The Cat isn't here, 42!", "The Cat isn't here, 42! 🎉", "the ΛΌΓΟΣ cat", "λόγοσ", "漢字 a", "字漢"])[1]
    assert emoji[:len(plain)].tolist() == plain.tolist() and len(emoji) == len(plain) + 1
    assert greek[0] == plain[0] and greek[2] == plain[1] and greek[1] == greek2[0] != plain[2]
    assert set(han[:2].tolist()) == set(han2.tolist()) and len(set(han.tolist())) == 3
