import zlib
from collections import Counter

import numpy as np
import pytest

from dialectic.llm import frames, ring
from tests.llm.helpers import docs


def plain_fill(position, shards, r):
    """Keys one after another in order of arrival."""
    n = len(position)
    room = [n // shards + (s < n % shards) for s in range(shards)]
    out = []
    for p in position:
        for s in r.order[np.searchsorted(r.at, p) % len(r.at)]:
            if room[s]:
                room[s] -= 1
                out.append(int(s))
                break
    return out


@pytest.mark.parametrize("n", [0, 5, 16, 333])
def test_same_as_one_key_after_another(spark, monkeypatch, n):
    monkeypatch.setattr(ring, "PARTS", 8)
    monkeypatch.setattr(ring, "STRETCH", 16)
    monkeypatch.setattr(frames, "GROUP", 2)
    ids = [None if i % 3 == 0 else i // 2 for i in range(n)]
    d = docs(spark, [None if i == 1 else "é" * (i % 7) for i in range(n)], ids).withColumnRenamed("source", "shard")
    got = ring.shard_rows(d).collect()
    assert len(got) == n
    per = Counter(r.shard for r in got)
    assert not n or max(per.get(s, 0) for s in range(16)) - min(per.get(s, 0) for s in range(16)) <= 1
    for s in per:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(per[s]))
    assert all(r.law == "rows" and r.grown_shard is None for r in got)
    assert sorted((r.size, r.text_crc32) for r in got) == sorted(
        (len(t) + 1, zlib.crc32(t)) for t in (b"" if i == 1 else ("é" * (i % 7)).encode() for i in range(n)))
    if n:
        keys = d.selectExpr("xxhash64(string(doc_id)) p").coalesce(1).collect()
        want = plain_fill([k.p for k in keys], 16, ring.Ring(16))
        assert sorted(Counter(want).items()) == sorted(per.items())
        mine = Counter((r.doc_id, r.shard) for r in got)
        assert mine == Counter(zip(ids, want))


def test_few_keys_move_when_a_shard_is_added(spark):
    a, b = ring.Ring(16), ring.Ring(17)
    p = np.random.default_rng(0).integers(-2 ** 63, 2 ** 63 - 1, 20000)
    free = np.full(17, np.iinfo(np.int64).max)
    n = np.arange(len(p))
    moved = a.place(p, n, free[:16]) != b.place(p, n, free)
    assert 0 < moved.mean() < 0.12 and set(b.place(p, n, free)[moved]) == {16}
