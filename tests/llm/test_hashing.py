import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from dialectic.llm import hashing


def plain(rows, k=10):
    good = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and None not in v
                   and all(np.isfinite(v)) and any(v)})
    good = [(i, v) for i, v in good if len(v) == 8]
    out = {}
    for q, x in good:
        if q % 100 == 0:
            out[q] = sorted((float(np.sqrt(((np.array(x) - np.array(y)) ** 2).sum())), i) for i, y in good if i != q)[:k]
    return out


def test_index_holds_the_whole_radius():
    rng = np.random.default_rng(0)
    bits = rng.random((3000, 64)) < 0.5
    bits[:1000] = bits[0] ^ (rng.random((1000, 64)) < 0.08)
    index = hashing.MultiIndex(hashing.pack_bits(bits))
    for r in (0, 3, 9, 30, 64):
        for q in (0, 5, 2000):
            got = index.within(hashing.pack_bits(bits)[q], r)
            assert got.tolist() == np.flatnonzero((bits != bits[q]).sum(axis=1) <= r).tolist()


def test_small_tables_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(hashing, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).round(1).tolist()) for i in range(330)]
    rows += [(1000 + i, [1.0] + [0.0] * 7) for i in range(40)] + [(400, [1.0] + [0.0] * 7)] * 2
    rows += [(500, None), (600, [0.0] * 8), (700, [1.0] * 7 + [None]), (800, [float("nan")] * 8), (None, [1.0] * 8),
             (900, [float("inf")] * 8), (1100, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("q", F.lit(1))
    got = {}
    for r in hashing.neighbours(df, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    want = plain(rows)
    assert set(got) == set(want)
    hits = total = 0
    for q, near in want.items():
        mine = [x[1:] for x in sorted(got[q])]
        assert [x[0] for x in sorted(got[q])] == list(range(1, len(near) + 1))
        assert mine == sorted(mine) and len({i for _, i in mine}) == len(mine)
        hits += len(set(mine) & set(near))
        total += len(near)
    assert hits / total >= 0.9
    assert sorted(got[1000])[0][1:] == (0.0, 400)
    few = df.filter("vec_id < 5")
    assert hashing.neighbours(few, F.col("vec_id") % 100 == 0).count() == 4
    assert hashing.neighbours(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_what_is_shuffled_grows_with_the_table():
    def rows(n):
        blocks = hashing.index_blocks(n, 64)
        assert n / blocks * 64 * 8 <= hashing.BLOCK_BYTES
        return n + blocks * (n // 100)
    for n in (1000, 50_000, 400_000, 1_000_000):
        assert rows(4 * n) <= 5 * rows(n)
    assert rows(77_000_000) < 4 * 77_000_000  # 188 copies of every vector with blocks of queries


def test_queries_stream_through_a_block():
    rng = np.random.default_rng(4)
    x, ids = rng.normal(size=(200, 8)), [[3 * i, 1000 + i] for i in range(200)]
    codes = hashing.fit(x)
    kind = lambda v, i, q: pa.RecordBatch.from_arrays(
        [pa.array(v.tolist(), pa.list_(pa.float64())), pa.array(i, pa.list_(pa.int64())), pa.array(q, pa.int64())],
        names=["v", "ids", "q"])
    one = kind(np.concatenate((x, x[:40])), ids + [None] * 40, [None] * 200 + list(range(40)))
    cut = [one.slice(a, 33) for a in range(0, 240, 33)] + [one.slice(0, 0)]
    whole, parts = (pa.Table.from_batches(hashing.search_stream(iter(b), codes, 5)).to_pylist() for b in ([one], cut))
    assert whole == parts and len(whole) == 200
    near = [r for r in whole if r["q"] == 7]
    assert near[0]["ids"] == [21, 1007] and near[0]["d"] == 0 and [r["d"] for r in near] == sorted(r["d"] for r in near)
    assert list(hashing.search_stream(iter([one.slice(200)]), codes, 5)) == []
    assert list(hashing.search_stream(iter([one.slice(0, 200)]), codes, 5)) == []


def test_recall_on_the_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = {(r.query_id, r.vec_id) for r in hashing.neighbours(df, F.col("vec_id") % 100 == 0).collect()}
    t = df.toPandas()
    x, ids = np.stack(t["embedding"]).astype(float), t["vec_id"].to_numpy()
    want = set()
    for i in np.flatnonzero(ids % 100 == 0):
        d = ((x - x[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        want |= {(ids[i], ids[j]) for j in np.lexsort((ids, d))[:10]}
    assert len(got) == len(want) and len(got & want) / len(want) >= 0.9
