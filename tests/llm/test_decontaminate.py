import hashlib
import random
import re

from dialectic.llm import decontaminate as dc
from tests.llm.helpers import docs

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def plain(text, items):
    low = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s or "")
    w = re.findall(WORD, low(text))
    hit, ids = set(), set()
    for item, t in items:
        iw = re.findall(WORD, low(t))
        n = min(10, len(iw))
        for i in range(len(iw) - n + 1 if iw else 0):
            for j in range(len(w) - n + 1):
                if w[j:j + n] == iw[i:i + n]:
                    hit.update(range(j, j + n))
                    ids.add("" if item is None else str(item))
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


def test_matches_brute_force(spark):
    rnd = random.Random(3)
    vocab = ["ab", "ÉA", "c1", "x", "Y", "zz"]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.choice([1, 3, 9, 10, 11, 25])))) for i in range(12)]
    items += [(20, None), (21, ""), (None, "x Y zz ab ab x x x c1 c1 ab"), (3, "ab x ab x ab x ab x ab x ab"), (20, "--")]
    texts = [None, "", "...", "x"] + [
        rnd.choice([" ", "-", "\n"]).join(rnd.choice(vocab) for _ in range(rnd.randint(1, 80))) for _ in range(40)]
    texts += [f"start, {items[5][1].upper()}! end" for _ in range(2)]
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as doc_id")
    d = docs(spark, texts).withColumnRenamed("source", "item_id")
    want = {i: plain(t, items) for i, t in enumerate(texts)}
    for limit in (1 << 20, 1200, 300):
        got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)
               for r in dc.contamination(d, bench, limit).collect()}
        assert got == want
    assert [len(list(dc.benchmark_parts(bench, n))) for n in (1 << 20, 1200)] == [1, 2]
    assert len(list(dc.benchmark_parts(bench, 300))) > 5
    for limit in (1 << 20, 1200):
        kept = dc.drop_contaminated(d, bench, limit)
        assert kept.columns == d.columns
        assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, w in want.items() if not w[4])
    assert dc.contamination(d, bench.limit(0)).filter("contaminated").count() == 0
    assert dc.contamination(docs(spark, []), bench).count() == 0


def test_spans_point_into_the_original():
    text = "Intro: ONE, two; three four"
    a = dc.build_automaton([(b"one two three", ("7",))])
    ranges, ids = dc.scan(a, dc.words_of(text.encode()))
    assert [text[x:y] for x, y in dc.original_spans(text, ranges)] == ["ONE, two; three"] and ids == {"7"}


def test_parts_bound_the_nodes_of_an_automaton(spark):
    rnd = random.Random(5)
    items = [(i, " ".join(f"{rnd.randrange(10 ** 6):x}" for _ in range(300))) for i in range(60)]
    bench = spark.createDataFrame([*items, (99, items[0][1])], "item_id long, text string")
    letters = 100_000
    parts = list(dc.benchmark_parts(bench, letters))
    assert len(parts) > 5
    assert all(dc.build_automaton(p).get_stats()["nodes_count"] <= 1.2 * letters for p in parts)
    windows = [w for p in parts for w, _ in p]
    assert len(windows) == len(set(windows)) == 60 * 291
    assert {ids for p in parts for w, ids in p if w in dc.windows(dc.words_of(items[0][1].encode()))} == {("0", "99")}


def test_a_worker_builds_an_automaton_once(monkeypatch):
    built = []
    monkeypatch.setattr(dc, "build_automaton", lambda owners: built.append(owners) or len(built))

    class Shared:
        def __init__(self, key):
            self.value = (key, [(b"a", ("1",))])

    assert [dc._automaton(Shared(k)) for k in ("x", "x", "y", "y", "x")] == [1, 1, 2, 2, 3]
