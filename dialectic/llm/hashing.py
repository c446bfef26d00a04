"""Nearest neighbours by multi-index hashing over learned binary codes."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialectic.llm.frames import ragged, stored

#: Vectors that the rotation and the radius are learned from, taken by hash.
FIT_ROWS = 20_000
#: Queries of the sample on which the radius is learned, and the recall it has to reach.
FIT_QUERIES, TARGET_RECALL = 256, 0.97
BITS, SUBSTRING_BITS, ROTATIONS, SEED = 64, 16, 30, 11
#: Fewest vectors of an index block, blocks that a table is cut into before they
#: grow, bytes of vectors of the largest.
BLOCK_ROWS, BLOCKS, BLOCK_BYTES = 32_768, 16, 128 << 20


class Codes(NamedTuple):
    """Learned map from vectors to bits, and the search radius."""

    mean: np.ndarray
    basis: np.ndarray
    radius: int

    def bits(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.basis > 0


def pack_bits(bits: np.ndarray) -> np.ndarray:
    """[n, substrings] integers of SUBSTRING_BITS bits each."""
    n, width = bits.shape
    m = -(-width // SUBSTRING_BITS)
    wide = np.zeros((n, m * SUBSTRING_BITS), np.int64)
    wide[:, :width] = bits
    return wide.reshape(n, m, SUBSTRING_BITS) @ (1 << np.arange(SUBSTRING_BITS))


def _nearest(x: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
    d = (x ** 2).sum(1)[None] - 2 * q @ x.T
    return np.argsort(d, axis=1, kind="stable")[:, :k]


def fit(sample: np.ndarray, k: int = 10) -> Codes:
    """Principal directions, rotated so that the signs lose least (alternating
    signs and an orthogonal Procrustes step), then the smallest Hamming radius
    that holds TARGET_RECALL of the sample's own neighbours."""
    mean = sample.mean(axis=0)
    z = sample - mean
    _, _, vt = np.linalg.svd(np.cov(z.T).reshape(z.shape[1], -1) if len(z) > 1 else np.eye(z.shape[1]))
    basis = vt[:BITS].T
    v = z @ basis
    rotation = np.linalg.qr(np.random.default_rng(SEED).normal(size=(v.shape[1], v.shape[1])))[0]
    for _ in range(ROTATIONS):
        u, _, w = np.linalg.svd(np.where(v @ rotation > 0, 1.0, -1.0).T @ v)
        rotation = (u @ w).T
    codes = Codes(mean, basis @ rotation, 0)
    bits = codes.bits(sample)
    q = np.arange(min(FIT_QUERIES, len(sample)))
    near = _nearest(sample, sample[q], k + 1)
    apart = np.sort((bits[near] != bits[q][:, None]).sum(axis=2).ravel())
    radius = int(apart[min(len(apart) - 1, int(np.ceil(TARGET_RECALL * len(apart))))]) if len(apart) else 0
    return codes._replace(radius=radius)


def flips(radius: int) -> np.ndarray:
    """All masks of SUBSTRING_BITS bits with at most ``radius`` set."""
    every = np.arange(1 << SUBSTRING_BITS)
    return every[np.bitwise_count(every) <= radius]


class MultiIndex:
    """One table per substring, from its value to the codes that have it."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes
        self.rows, self.first = [], []
        for i in range(codes.shape[1]):
            self.rows.append(np.argsort(codes[:, i], kind="stable"))
            self.first.append(np.concatenate(([0], np.cumsum(np.bincount(
                codes[:, i], minlength=1 << SUBSTRING_BITS)))))
        self._flips: dict[int, np.ndarray] = {}

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """All rows within the radius: by the pigeonhole principle one of the
        substrings differs in at most radius/substrings bits."""
        m = len(code)
        share = min(radius // m, SUBSTRING_BITS)
        masks = self._flips.setdefault(share, flips(share))
        found = []
        for i in range(m):
            probe = code[i] ^ masks
            start = self.first[i][probe]
            found.append(self.rows[i][ragged(start, self.first[i][probe + 1] - start)])
        rows = np.unique(np.concatenate(found))
        return rows[np.bitwise_count(self.codes[rows] ^ code).sum(axis=1) <= radius]


def search_block(index: MultiIndex, x: np.ndarray, least: np.ndarray, q: np.ndarray, codes: Codes, k: int):
    """Per query the rows of the block's k nearest found and their distances;
    a radius with fewer than k rows is widened. Ties: smaller ``least``."""
    for i, code in enumerate(pack_bits(codes.bits(q))):
        radius, rows = codes.radius, index.within(code, codes.radius)
        while len(rows) < min(k, len(x)):
            radius += len(code)
            rows = index.within(code, radius)
        d = np.sqrt(((x[rows] - q[i]) ** 2).sum(axis=1))
        best = np.lexsort((least[rows], d))[:k]
        yield i, rows[best], d[best]


def search_stream(batches: Iterator[pa.RecordBatch], codes: Codes, k: int) -> Iterator[pa.RecordBatch]:
    """(q, d, ids) of the k nearest found in a block to each of its queries: the
    block's vectors come first and are indexed once, the queries (``q`` not null)
    then stream through, so that only the block is held."""
    vectors, ids, index = [], [], None
    for batch in batches:
        n, asks = batch.num_rows, batch.column("q").is_valid().to_numpy(zero_copy_only=False)
        if not n:
            continue
        v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
        first = int(np.argmax(asks)) if asks.any() else n
        if first:
            vectors.append(v[:first])
            ids.append(batch.column("ids").slice(0, first))
        if first == n or not vectors:
            continue
        if index is None:
            vectors, ids = [np.concatenate(vectors)], [pa.concat_arrays(ids)]
            least = ids[0].flatten().to_numpy()[np.concatenate(([0], np.cumsum(ids[0].value_lengths().to_numpy())[:-1]))]
            index = MultiIndex(pack_bits(codes.bits(vectors[0])))
        rows, dist, of = [], [], []
        for i, found, d in search_block(index, vectors[0], least, v[first:], codes, k):
            rows.append(found)
            dist.append(d)
            of.append(np.full(len(d), first + i))
        yield pa.RecordBatch.from_arrays(
            [batch.column("q").take(pa.array(np.concatenate(of))), pa.array(np.concatenate(dist)),
             ids[0].take(pa.array(np.concatenate(rows)))], names=["q", "d", "ids"])


def index_blocks(n_base: int, dim: int) -> int:
    """Blocks of an index. A vector goes to one of them, a query to all, so blocks
    are as large as memory allows once there are BLOCKS of them."""
    rows = min(max(BLOCK_ROWS, -(-n_base // BLOCKS)), max(1, BLOCK_BYTES // (8 * dim)))
    return max(1, -(-n_base // rows))


def usable(v: Column) -> Column:
    """Not null, not zero, all components finite."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(fine, F.lit(False)) & F.exists(v, lambda x: x != 0)


def neighbours(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row with ``is_query`` the k
    nearest found among all other rows, by Euclidean distance in double
    precision on the original vectors, ties to the smaller vec_id.

    Equal vectors are searched once: a vector stands for its k+1 smallest ids,
    which are all that can be among any k nearest, and equal queries share one
    search. Vectors that are null, zero or not finite, rows without id and
    vectors of another length than most take no part; repeated rows count
    once, and a row with the query's id is the query itself. Fewer than k
    other rows: all of them.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"),
                          F.col("embedding").cast("array<double>").alias("v")).filter(
        F.col("vec_id").isNotNull() & usable(F.col("v"))).distinct()
    rows = stored(rows, "mih-rows")
    size = rows.groupBy(F.size("v").alias("s")).count().orderBy(F.desc("count"), "s").first()
    if size is None:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id",
                           F.lit(0.0).alias("score")).limit(0)
    rows = rows.filter(F.size("v") == size["s"])
    order = Window.partitionBy("v").orderBy("vec_id")
    base = stored(rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1)
                  .groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "mih-vectors")
    asked = rows.filter(is_query)
    queries = stored(asked.groupBy("v").agg(F.min("vec_id").alias("q")), "mih-queries")

    n_base = base.count()
    h = F.pmod(F.xxhash64("v"), F.lit(1 << 20))
    share = min(1.0, 1.2 * FIT_ROWS / max(1, n_base))
    sample = base.withColumn("h", h).filter(F.col("h") <= int(share * (1 << 20))).orderBy("h", "ids").limit(FIT_ROWS)
    codes = fit(np.array([r["v"] for r in sample.select("v").toLocalIterator()]), k)

    blocks = index_blocks(n_base, size["s"])
    left = base.select(F.pmod(F.xxhash64("v"), F.lit(blocks)).cast("int").alias("b"), "v", "ids",
                       F.lit(None).cast("long").alias("q"))
    right = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), "v",
                           F.lit(None).cast("array<long>").alias("ids"), "q")
    both = left.unionByName(right).repartitionById(blocks, F.col("b")).sortWithinPartitions(F.col("q").isNotNull())
    found = both.select("v", "ids", "q").mapInArrow(
        lambda batches: search_stream(batches, codes, k + 1), "q long, d double, ids array<long>")
    best = Window.partitionBy("q").orderBy("d", F.col("ids")[0])
    found = found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1).select("q", "d", "ids")
    lists = stored(found.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("d", "ids"))).alias("near")), "mih-near")
    # At most (k+1)^2 ids for a query vector; each query takes its own out.
    per_query = asked.join(queries, "v").select(F.col("vec_id").alias("query_id"), "q").join(lists, "q")
    flat = F.flatten(F.transform("near", lambda s: F.transform(s.ids, lambda i: F.struct(s.d.alias("d"), i.alias("i")))))
    mine = F.slice(F.sort_array(F.filter(flat, lambda s: s.i != F.col("query_id"))), 1, k)
    return per_query.select("query_id", F.posexplode(mine).alias("p", "s")).select(
        "query_id", (F.col("p") + 1).alias("rank"), F.col("s.i").alias("vec_id"), F.col("s.d").alias("score"))
