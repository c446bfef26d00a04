import random

import xxhash

from dialectic.llm import simhash
from dialectic.llm.components import connected_components
from tests.llm.helpers import docs, rows


def plain_fingerprint(text, k=3):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
             .replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ")
             .split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, fps, bits):
    label = list(range(len(ids)))
    changed = True
    while changed:
        changed = False
        for i in range(len(ids)):
            for j in range(len(ids)):
                if (fps[i] ^ fps[j]).bit_count() <= bits and label[j] < label[i]:
                    label[i], changed = label[j], True
    known = {}
    for i, l in zip(ids, label):
        if i is not None:
            known[l] = min(known.get(l, i), i)
    return [known.get(l) for l in label]


def sample_texts():
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    out = [None, "", " \t\n", "One", "one two", "ONE two", "É é", "a\xa0b c d", "x " * 20000]
    for _ in range(25):
        base = [rnd.choice(words) for _ in range(rnd.randint(40, 200))]
        out.append(" ".join(base))
        for _ in range(rnd.randint(0, 6)):
            near = list(base)
            near[rnd.randrange(len(near))] = rnd.choice(words)
            out.append(" ".join(near))
    return out + out[10:14]


def test_fingerprint_matches_plain():
    for t in sample_texts():
        assert simhash.fingerprint((t or "").encode()) == plain_fingerprint(t)


def test_masks_cover_every_pair_of_bits():
    masks = simhash.covering_masks(2)
    assert len(masks) == 7
    for i in range(64):
        for j in range(64):
            assert any(not m >> i & 1 and not m >> j & 1 for m in masks)


def test_components_match_all_pairs(spark):
    texts = sample_texts()
    ids = [None] + [1000 - i for i in range(1, len(texts))]
    got = rows(simhash.near_duplicates(docs(spark, texts, ids)).select("doc_id", "fingerprint", "component_id"))
    fps = [plain_fingerprint(t) for t in texts]
    want = [(i, f"{f:016x}", c) for i, f, c in zip(ids, fps, plain_components(ids, fps, 2))]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert len({c for *_, c in want}) < len(want) - 10


def test_dense_fingerprints_link_by_bits(spark):
    rnd = random.Random(1)
    for bits in (0, 1, 2):
        base = [rnd.getrandbits(63) for _ in range(4)]
        fps = sorted({b ^ (1 << rnd.randrange(63)) ^ (1 << rnd.randrange(63)) for b in base for _ in range(40)})
        df = spark.createDataFrame([(f,) for f in fps], "fp long")
        cc = dict(rows(connected_components(simhash.links(df, bits))))
        got = [cc.get(f, f) for f in fps]
        want = plain_components(fps, fps, bits)
        assert got == want


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5), (None, 3)]
    cc = dict(rows(connected_components(spark.createDataFrame(edges, "a long, b long"))))
    assert {cc[i] for i in range(201)} == {0} and {cc[1000 + i] for i in range(300)} == {1000}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_row_of_each_group_stays(spark):
    texts = sample_texts()
    d = docs(spark, texts).withColumnRenamed("source", "_id")
    kept = simhash.drop_near_duplicates(d)
    assert kept.columns == d.columns
    fps = [plain_fingerprint(t) for t in texts]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(plain_components(range(len(texts)), fps, 2)))
    twice = docs(spark, ["a b c d", "a b c d", "e f g h"], [1, 1, None])
    assert sorted(map(str, (r.doc_id for r in simhash.drop_near_duplicates(twice).collect()))) == ["1", "None"]
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
