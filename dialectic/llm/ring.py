"""Sharding by a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dialectic.llm.frames import running_sums, stored

#: Virtual nodes per shard.
VNODES = 64
#: Parts into which a span of arrivals is cut in each step of the search for
#: the row that fills a shard; one row per part and shard reaches the driver.
PARTS = 1024
#: Arrivals whose slots are numbered in one window.
STRETCH = 1 << 16


class Ring:
    """Positions of the virtual nodes and, for each arc, all shards in the
    order in which they are met clockwise."""

    def __init__(self, shards: int, vnodes: int = VNODES):
        nodes = sorted((int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big",
                                       signed=True), s) for s in range(shards) for v in range(vnodes))
        self.at = np.array([p for p, _ in nodes], np.int64)
        owner = [s for _, s in nodes]
        self.order = np.array([list(dict.fromkeys(owner[i:] + owner[:i])) for i in range(len(owner))], np.int64)

    def place(self, position: np.ndarray, arrival: np.ndarray, full_from: np.ndarray) -> np.ndarray:
        """Shard of each key: the first one clockwise that is not full when the
        key arrives. ``full_from[s]`` is the arrival number from which shard s
        takes no more."""
        order = self.order[np.searchsorted(self.at, position) % len(self.at)]
        return order[np.arange(len(order)), (full_from[order] > arrival[:, None]).argmax(axis=1)]


def _placed(rows: DataFrame, ring: Ring, full_from: np.ndarray, lo: int, width: int) -> DataFrame:
    """(shard, part) of the rows, with the rows' counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column("arrival").to_numpy()
            shard = ring.place(b.column("position").to_numpy(), n, full_from)
            key, count = np.unique(shard * PARTS + (n - lo) // width, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(count)], names=["key", "n"])

    return rows.select("position", "arrival").mapInArrow(run, "key long, n long").groupBy("key").agg(
        F.sum("n").alias("n"))


def _loads(rows: DataFrame, ring: Ring, full_from: np.ndarray, lo: int, width: int) -> np.ndarray:
    """[shard, part] counts; at most shards x PARTS rows are collected."""
    out = np.zeros((len(full_from), PARTS), np.int64)
    for r in _placed(rows, ring, full_from, lo, width).collect():
        out[r["key"] // PARTS, r["key"] % PARTS] = r["n"]
    return out


def fill_times(rows: DataFrame, total: int, capacity: np.ndarray, ring: Ring) -> np.ndarray:
    """For each shard the arrival number from which it is full.

    Which shard a key gets depends only on its place on the ring, its arrival
    number and these times. So the shards are filled one after another: count
    the arrivals of each shard by part, find the part in which the first one
    fills, and cut that part again until it holds single arrivals.
    """
    never = np.iinfo(np.int64).max
    full_from = np.where(capacity > 0, never, 0)
    while (full_from == never).sum() > 1:
        lo, span = 0, max(total, 1)
        held = np.zeros(len(capacity), np.int64)
        while True:
            width = -(-span // PARTS)
            at = rows.filter((F.col("arrival") >= lo) & (F.col("arrival") < lo + span))
            run = held[:, None] + np.cumsum(_loads(at, ring, full_from, lo, width), axis=1)
            reach = (run >= capacity[:, None]) & (full_from == never)[:, None]
            if not reach.any():
                return full_from
            part = int(reach.any(axis=0).argmax())
            if width == 1:
                full_from[reach[:, part]] = lo + part + 1
                break
            held = run[:, part - 1] if part else held
            lo, span = lo + part * width, width
    return full_from


def shard_rows(docs: DataFrame, shards: int = 16, vnodes: int = VNODES) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot,
    grown_shard (null).

    Keys (doc_id) arrive in the table's order and go clockwise to the first
    shard that still has room. Room is a bound on rows, the total shared out
    evenly, so counts differ by one at most (law ``rows``) whatever repeats:
    copies, one id or null ids overflow to the next shards like any key. A
    key moves only if its shard, or one that it passed, changes. Null
    text has size 1 and the crc of empty text. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text).alias("text_crc32"),
                       F.xxhash64(F.col("doc_id").cast("string")).alias("position"),
                       F.monotonically_increasing_id().alias("seen"))
    slim = stored(slim, "ring-keys").withColumn("block", F.shiftright("seen", 33))
    sizes = slim.groupBy("block").agg(F.count("*").alias("n"))
    # A scan task's rows are numbered without gaps, so a block's first arrival
    # number is the sum of the counts of the blocks before it.
    first = running_sums(sizes, ["n"], [], "block")
    rows = slim.join(first.select("block", F.col("n_before").alias("first")), "block").select(
        "doc_id", "size", "text_crc32", "position", "block",
        (F.col("first") + F.col("seen").bitwiseAND(F.lit((1 << 33) - 1))).alias("arrival"))
    rows = stored(rows, "ring-arrivals")
    total = rows.count()
    capacity = np.array([total // shards + (s < total % shards) for s in range(shards)], np.int64)
    ring = Ring(shards, vnodes)
    full_from = fill_times(rows, total, capacity, ring)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shard = ring.place(b.column("position").to_numpy(), b.column("arrival").to_numpy(), full_from)
            cols = {n: b.column(n) for n in ("doc_id", "size", "text_crc32", "block", "arrival")}
            cols["shard"] = pa.array(shard.astype(np.int32))
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    placed = rows.mapInArrow(run, "doc_id long, size long, text_crc32 long, block long, arrival long, shard int")
    # Slots: rows of a shard are numbered within bounded stretches of arrivals,
    # and the stretches' counts are summed.
    placed = placed.withColumn("stretch", F.floor(F.col("arrival") / STRETCH).cast("long"))
    counts = running_sums(placed.groupBy("shard", "stretch").agg(F.count("*").alias("n")), ["n"], ["shard"], "stretch")
    local = F.row_number().over(Window.partitionBy("shard", "stretch").orderBy("arrival")) - 1
    return (placed.withColumn("local", local.cast("long")).join(counts, ["shard", "stretch"])
            .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
                    (F.col("n_before") + F.col("local")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")))
