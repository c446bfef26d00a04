"""Token ids in shard files under Re-Pair grammar compression."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialectic.llm.frames import ragged, running_sums, slices, stored, texts
from dialectic.llm.wordids import word_ids

MAGIC = b"REPAIR1\n"
#: Ids of a block, which has its own rules and is read alone.
BLOCK_IDS = 1 << 20
#: Rounds of replacement, rules made in a round, uses that a rule needs.
ROUNDS, ROUND_RULES, LEAST_USES = 6, 2048, 24
_SLOT_BITS = 18
_ODD = np.uint64(0x9E3779B97F4A7C15)


def compress(ids: np.ndarray, last: np.ndarray, terminals: int, rounds: int = ROUNDS) \
        -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, last, rules): Re-Pair in rounds. Each round takes the most
    frequent pairs (one for each slot of a hash table) and replaces their
    occurrences from left to right by new symbols. ``last`` marks the last
    symbol of a document; no pair crosses it."""
    sym, rules, top = ids.astype(np.int64), [], terminals
    last = last.copy()
    for _ in range(rounds):
        if len(sym) < 2:
            break
        pair = (sym[:-1] << 32) | sym[1:]
        slot = ((pair.view(np.uint64) * _ODD) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        slot[last[:-1]] = 1 << _SLOT_BITS
        often = np.bincount(slot, minlength=(1 << _SLOT_BITS) + 1)
        often[-1] = 0
        at = np.flatnonzero(often[slot] >= LEAST_USES)
        if not len(at):
            break
        held = np.full((1 << _SLOT_BITS) + 1, -1, np.int64)
        held[slot[at]] = pair[at]
        at = at[held[slot[at]] == pair[at]]
        uses = np.bincount(slot[at], minlength=len(held))
        best = np.flatnonzero(uses >= LEAST_USES)
        best = best[np.argsort(-uses[best], kind="stable")][:ROUND_RULES]
        if not len(best):
            break
        number = np.full(len(held), -1, np.int64)
        number[best] = np.arange(len(best))
        at = at[number[slot[at]] >= 0]
        run = np.concatenate(([True], at[1:] != at[:-1] + 1))  # of pairs that overlap, every other one
        offset = at - at[run][np.cumsum(run) - 1]
        at = at[offset % 2 == 0]
        sym[at] = top + number[slot[at]]
        last[at] = last[at + 1]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        sym, last = sym[keep], last[keep]
        rules.append(np.stack([held[best] >> 32, held[best] & 0xFFFFFFFF], axis=1))
        top += len(best)
    return sym, last, np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)


def _rounds(rules: np.ndarray, terminals: int) -> Iterator[tuple[int, int]]:
    """Stretches of rules that use only symbols before the stretch."""
    ready, end = terminals, terminals + len(rules)
    while ready < end:
        later = np.flatnonzero((rules[ready - terminals:] >= ready).any(axis=1))
        stop = ready + int(later[0]) if len(later) else end
        yield ready, stop
        ready = stop


def expansions(rules: np.ndarray, terminals: int, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pool, start): symbol s expands to ``pool[start[s]:start[s]+length]``."""
    size = np.concatenate((np.ones(terminals, np.int64), lengths))
    start = np.cumsum(size) - size
    pool = np.zeros(int(size.sum()), np.int64)
    pool[:terminals] = np.arange(terminals)
    for lo, hi in _rounds(rules, terminals):
        both = rules[lo - terminals:hi - terminals].ravel()
        pool[start[lo]:start[hi] if hi < len(size) else len(pool)] = pool[ragged(start[both], size[both])]
    return pool, start


def write_block(ids: list[np.ndarray], terminals: int) -> bytes:
    """One block: header, per document its length and first symbol, the rules
    with their expansion lengths, and the symbols (2 bytes each if they fit)."""
    counts = np.array([len(x) for x in ids], np.int64)
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    last = np.zeros(len(flat), bool)
    last[np.cumsum(counts)[counts > 0] - 1] = True
    sym, last, rules = compress(flat, last, terminals)
    size = np.ones(terminals + len(rules), np.int64)
    for lo, hi in _rounds(rules, terminals):
        size[lo:hi] = size[rules[lo - terminals:hi - terminals]].sum(axis=1)
    begin = np.concatenate(([0], np.flatnonzero(last) + 1))[:-1]
    first = np.zeros(len(counts), np.int64)
    first[counts > 0] = begin
    width = 2 if terminals + len(rules) <= 1 << 16 else 4
    head = struct.pack("<8sIIIIIQ", MAGIC, width, len(ids), terminals, len(rules), len(sym), len(flat))
    parts = [head, counts.astype("<u4").tobytes(), first.astype("<u4").tobytes(), rules.astype("<u4").tobytes(),
             size[terminals:].astype("<u4").tobytes(), sym.astype(f"<u{width}").tobytes()]
    return b"".join(parts)


class Block:
    """A block read back; documents are decoded one at a time or all at once."""

    def __init__(self, blob: bytes) -> None:
        magic, width, docs, terminals, rules, symbols, self.n_ids = struct.unpack_from("<8sIIIIIQ", blob)
        if magic != MAGIC:
            raise ValueError("not a block of this format")
        at = struct.calcsize("<8sIIIIIQ")

        def take(n: int, kind: str) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(blob, kind, n, at)
            at += out.nbytes
            return out.astype(np.int64)

        self.counts, self.first = take(docs, "<u4"), take(docs, "<u4")
        rule = take(2 * rules, "<u4").reshape(-1, 2)
        self.size = np.concatenate((np.ones(terminals, np.int64), take(rules, "<u4")))
        self.pool, self.start = expansions(rule, terminals, self.size[terminals:])
        self.symbols = take(symbols, f"<u{width}")

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        return self.pool[ragged(self.start[symbols], self.size[symbols])].astype(np.uint32)

    def all(self) -> list[np.ndarray]:
        """The ids of every document."""
        return np.split(self._expand(self.symbols), np.cumsum(self.counts)[:-1]) if len(self.counts) else []

    def ids(self, doc: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids ``start`` to ``stop`` of one document; the expansion lengths say
        which symbols hold them, no others are expanded."""
        stop = int(self.counts[doc]) if stop is None else min(stop, int(self.counts[doc]))
        if stop <= start:
            return np.zeros(0, np.uint32)
        later = self.first[doc + 1:][self.counts[doc + 1:] > 0]
        mine = self.symbols[self.first[doc]:later[0] if len(later) else len(self.symbols)]
        ends = np.cumsum(self.size[mine])
        lo, hi = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop)
        skip = int(ends[lo - 1]) if lo else 0
        return self._expand(mine[lo:hi + 1])[start - skip:stop - skip]


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int, name: str = "token-shards") -> DataFrame:
    """Write the ids of ``docs`` (doc_id, text) in ascending doc_id order and
    return the written table: shard, block, doc_ids, n_ids, blob.

    Shards are ranges of (doc_id, place in the table), null ids first; a
    repeated id spreads over shards. A block holds about BLOCK_IDS ids, and at
    least one document. Null text counts as empty. An empty table gives no block.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = word_ids(tokenizer_path)
        terminals = max(tok.library.get_vocab_size(), end_id + 1)
        block, ids, names, held, shard = 0, [], [], 0, 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {"shard": pa.array([shard], pa.int32()), "block": pa.array([block], pa.int64()),
                 "doc_ids": pa.array([names], pa.list_(pa.int64())), "n_ids": pa.array([held], pa.int64()),
                 "blob": pa.array([write_block(ids, terminals)], pa.binary())})

        for batch in batches:
            for part in slices(batch, "text"):
                shard = part.column("shard")[0].as_py()
                for x, doc_id in zip(tok.encode(texts(part))[0], part.column("doc_id").to_pylist()):
                    ids.append(np.append(x, np.uint32(end_id)))
                    names.append(doc_id)
                    held += len(x) + 1
                    if held >= BLOCK_IDS:
                        yield flush()
                        block, ids, names, held = block + 1, [], [], 0
        if ids:
            yield flush()

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                       F.monotonically_increasing_id().alias("seen"))
    dealt = (slim.repartitionByRange("doc_id", "seen").withColumn("shard", F.spark_partition_id())
             .sortWithinPartitions("doc_id", "seen").drop("seen"))
    return stored(dealt.mapInArrow(run, "shard int, block long, doc_ids array<long>, n_ids long, blob binary"), name)


def read_shards(shards: DataFrame) -> DataFrame:
    """One row per document of written shards: doc_id, start (ids of all
    documents before it), n_tokens, ids_crc32."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = Block(batch.column("blob")[i].as_py())
                crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in b.all()]
                n = len(crc)
                yield pa.RecordBatch.from_pydict({
                    "place": pa.array([batch.column("place")[i].as_py()] * n, pa.int64()),
                    "doc_id": batch.column("doc_ids")[i].values, "inner": pa.array(np.cumsum(b.counts) - b.counts),
                    "n_tokens": pa.array(b.counts), "ids_crc32": pa.array(crc, pa.int64())})

    placed = shards.withColumn("place", F.shiftleft(F.col("shard").cast("long"), 32) + F.col("block"))
    before = running_sums(placed.select("place", "n_ids"), ["n_ids"], [], "place").select("place", "n_ids_before")
    rows = placed.select("place", "doc_ids", "blob").mapInArrow(
        run, "place long, doc_id long, inner long, n_tokens long, ids_crc32 long")
    return rows.join(before, "place").select(
        "doc_id", (F.col("n_ids_before") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")
