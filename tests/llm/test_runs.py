import hashlib
import random
import time
import zlib
from fractions import Fraction

import pytest

from dialectic.llm import runs
from tests.llm.helpers import docs, rows


def plain_runs(words, min_words=6, min_exponent=4):
    """Every period and every stretch, one after another."""
    n, out = len(words), {}
    for q in range(1, n):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(min_words, min_exponent * q):
                out.setdefault((i, j + q - i), q)  # smaller periods come first
            i = j + 1
    return sorted((s, length, q) for (s, length), q in out.items())


def plain_digest(words):
    found = plain_runs(words)
    drop = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None,) * 3
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (len(found), *best, best[0] if best[0] is None else 1000 * best[1] // best[2],
            sha("".join(f"{s},{n},{q}\n" for s, n, q in found)),
            sha(" ".join(w for i, w in enumerate(words) if i not in drop)))


def strange_words(rnd):
    kind = rnd.randrange(4)
    if kind == 0:
        return [rnd.choice("ab") for _ in range(rnd.randint(0, 60))]
    if kind == 1:
        base = [rnd.choice("abc") for _ in range(rnd.randint(1, 6))]
        return ([rnd.choice("abc") for _ in range(rnd.randint(0, 5))] + base * rnd.randint(1, 9)
                + [rnd.choice("abc") for _ in range(rnd.randint(0, 5))])
    if kind == 2:
        base = ([rnd.choice("ab") for _ in range(rnd.randint(1, 2))] * rnd.randint(3, 6)) + ["c"]
        return base * rnd.randint(1, 5)
    return [rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 80))]


@pytest.mark.parametrize("limits", [(6, 4), (1, 3), (9, 3), (4, 5), (1, 6)])
def test_runs_equal_plain_search(limits):
    rnd = random.Random(hash(limits) % 1000)
    lists = [strange_words(rnd) for _ in range(700)] + [[], ["x"], ["x"] * 50, ["x"] * 5, ["x"] * 6]
    want = [plain_runs(w, *limits) for w in lists]
    for size in (1, 9, len(lists)):
        assert [r for i in range(0, len(lists), size) for r in runs.runs_of(lists[i:i + size], *limits)] == want


def test_suffix_order_and_common_words():
    rnd = random.Random(8)
    for least in (1, 2, 3, 5, 7):
        words = [rnd.choice([1, 2, 3]) for _ in range(80)] + [-1] + [rnd.choice([1, 2, 3]) for _ in range(40)] + [-2]
        text = [0] * 81 + [1] * 41
        s = runs.SuffixOrder(runs.np.array(words), runs.np.array(text), least)
        ends = [81, 122]
        kept = [i for i in range(122) if i + least <= ends[text[i]] and sum(
            words[i:i + least] == words[j:j + least] for j in range(122) if text[i] == text[j] and j + least <= 122) > 1]
        assert s.order.tolist() == sorted(kept, key=lambda i: (text[i], words[i:]))
        for k in range(1, len(s.order)):
            a, b = words[s.order[k - 1]:], words[s.order[k]:]
            n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert s.lcp[k] == (n if n >= least else 0)


def test_long_repetitive_texts_end():
    begun = time.time()
    n = 200_000
    assert runs.runs_of([["a"] * n]) == [[(0, n, 1)]]
    line = "this is the same line".split()
    assert runs.runs_of([line * (n // 5)]) == [[(0, n, 5)]]
    spread = [w for i in range(n // 8) for w in ["x", str(i), *line, f"y{i}"]]
    assert runs.runs_of([spread]) == [[]]
    assert time.time() - begun < 60


def test_words_are_dropped_behind_the_first_period():
    words = "a b a b a b a b c c c c c c d".split()
    found = runs.runs_of([words])[0]
    assert found == [(0, 8, 2), (8, 6, 1)]
    assert runs.without_repeats(words, found) == "a b c d".split()
    with pytest.raises(ValueError):
        runs.runs_of([words], 6, 2)


def test_rows_in_rows_out(spark):
    texts = [None, "", " \n", "a b " * 9, "a b " * 9, "é\x0bé\té é é\ré ü", "x\xa0x x\xa0x x\xa0x", "one two three"]
    d = docs(spark, texts, ids=[3, None, 2, 1, 1, None, 7, 8]).selectExpr("*", "1 as runs", "text as collapsed")
    got = sorted((i or -1, n, [tuple(x) for x in r], c) for i, n, r, c in rows(runs.periodic_runs(d)))
    assert got == sorted([(3, 0, [], ""), (-1, 0, [], ""), (2, 0, [], ""), (1, 18, [(0, 18, 2)], "a b"),
                          (1, 18, [(0, 18, 2)], "a b"), (-1, 7, [(0, 6, 1)], "é ü"), (7, 3, [], "x\xa0x x\xa0x x\xa0x"),
                          (8, 3, [], "one two three")])
    assert rows(runs.periodic_runs(docs(spark, []))) == []


def test_query_equals_plain_search(spark):
    from dialectic.llm.queries import op11_runs, with_planted_periods
    sf = "/root/testdata/sf0.001"
    rnd = random.Random(2)
    fixture = docs(spark, [None, "", "a"] + [" ".join(strange_words(rnd) * rnd.randint(1, 3)) for _ in range(150)])

    def want(r):
        words = [w.decode() for w in (r.text or "").encode().split()]
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
        return words

    planted = {r.doc_id: (r.text or "") for r in with_planted_periods(fixture).collect()}
    for r in fixture.collect():
        assert planted[r.doc_id].split() == want(r)
    got = {r[0]: tuple(r)[1:] for r in op11_runs(spark, sf).collect()}
    some = [r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert len(got) == len(some)
    for r in some:
        words = want(r)
        if len(words) < 1200:
            assert got[r.doc_id] == plain_digest(words)
