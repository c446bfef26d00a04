"""Packing documents into training sequences by lexical retrieval."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from dialectic.llm.frames import ragged, slices, texts
from dialectic.llm.wordids import word_ids

WINDOW = 4096
#: Ids of an index shard: documents are retrieved within a shard.
SHARD_IDS = 2 << 20
#: BM25.
K1, B = 1.2, 0.75


class Bm25:
    """Inverted index of the documents of one shard, impacts precomputed."""

    def __init__(self, terms: list[np.ndarray]) -> None:
        n = self.n = len(terms)
        length = np.array([len(t) for t in terms], np.float64)
        doc = np.repeat(np.arange(n), length.astype(np.int64))
        met, term = np.unique(np.concatenate(terms) if n else np.zeros(0, np.uint64), return_inverse=True)
        pair, tf = np.unique(term * n + doc, return_counts=True)
        term, self.doc = pair // max(n, 1), pair % max(n, 1)
        df = self.df = np.bincount(term, minlength=len(met))
        self.start = np.cumsum(df) - df
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * length / max(length.mean() if n else 1.0, 1e-9))
        self.impact = idf[term] * tf * (K1 + 1) / (tf + norm[self.doc])
        # Terms of each document that some other document has.
        shared = np.flatnonzero(df[term] > 1)
        at = shared[np.argsort(self.doc[shared], kind="stable")]
        self.own = term[at]
        self.own_start = np.searchsorted(self.doc[at], np.arange(n + 1))

    def neighbours(self, seed: int, used: np.ndarray, most: int) -> np.ndarray:
        """The first ``most`` unused documents that share a term with the seed,
        by falling score over all its terms (ties: first in the shard); more of
        them if those of the last score are more."""
        q = self.own[self.own_start[seed]:self.own_start[seed + 1]]
        at = ragged(self.start[q], self.df[q])
        score = np.bincount(self.doc[at], weights=self.impact[at], minlength=self.n)
        docs = np.flatnonzero((score > 0) & ~used)
        score = score[docs]
        if len(docs) > most:
            best = score >= np.partition(score, len(docs) - most)[len(docs) - most]
            docs, score = docs[best], score[best]
        return docs[np.argsort(-score, kind="stable")]


def order_by_retrieval(lengths: np.ndarray, index: Bm25, window: int = WINDOW) -> np.ndarray:
    """The documents in packing order. The document at the start of a window is
    its seed; unused neighbours of the seed, best first, fill the window greedily,
    and the one that runs over its end is the next seed. Without a seed or
    neighbours left, the next unused document starts."""
    n = len(lengths)
    used = np.zeros(n, bool)
    order, filled, fresh = [], 0, 0
    seed = -1
    while len(order) < n:
        if seed < 0:
            while used[fresh]:
                fresh += 1
            seed = fresh
            used[seed] = True
            order.append(seed)
            filled += int(lengths[seed])
        end = -(-filled // window) * window
        if filled < end:  # every document has an id, so no more of them fit
            for d in index.neighbours(seed, used, end - filled).tolist():
                used[d] = True
                order.append(d)
                filled += int(lengths[d])
                if filled >= end:
                    break
        seed = order[-1] if filled > end else -1
    return np.array(order, np.int64)


def sequence_starts(total: int, window: int = WINDOW) -> np.ndarray:
    """Full windows, then powers of two for what is left, so nothing is padded."""
    starts = list(range(0, total - total % window, window))
    at = total - total % window
    for b in range(window.bit_length() - 1, -1, -1):
        if total - at >> b & 1:
            starts.append(at)
            at += 1 << b
    return np.array(starts, np.int64)


def pack_shard(ids: list[np.ndarray], terms: list[np.ndarray], window: int = WINDOW) -> dict[str, np.ndarray]:
    """The pieces of a shard: doc (place in the shard), start, length, sequence,
    offset, and the stream of ids with each piece's place in it."""
    lengths = np.array([len(x) for x in ids], np.int64)
    order = order_by_retrieval(lengths, Bm25(terms), window)
    first = np.cumsum(lengths[order]) - lengths[order]
    total = int(lengths.sum())
    seqs = sequence_starts(total, window)
    at = np.union1d(first, seqs)
    where, seq = np.searchsorted(first, at, side="right") - 1, np.searchsorted(seqs, at, side="right") - 1
    return {"doc": order[where], "start": at - first[where], "length": np.diff(np.append(at, total)),
            "sequence": seq, "offset": at - seqs[seq], "at": at,
            "stream": np.concatenate([ids[i] for i in order]) if total else np.zeros(0, np.uint32)}


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, window: int = WINDOW, with_ids: bool = True) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text): doc_id, start, length,
    ids_crc32, doc_tokens, sequence_id, offset, and the piece's ids (binary,
    little-endian 32 bit) if asked for.

    Every scan task cuts its documents into index shards of about SHARD_IDS ids
    and packs each shard, so no row is shuffled and a lost task is simply
    read again; ``docs`` has to be a table as read, not the result of a shuffle.
    A hot source or a large group of copies is dealt like any documents. Null
    text counts as empty: its end id is one piece. Repeated rows are packed each.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = word_ids(tokenizer_path)
        number = TaskContext.get().partitionId() << 40
        ids, terms, names, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal number
            p = pack_shard(ids, terms, window)
            stream = p["stream"].astype("<u4")
            raw = [stream[a:a + n].tobytes() for a, n in zip(p["at"].tolist(), p["length"].tolist())]
            tokens = np.array([len(x) for x in ids], np.int64)
            cols = {"doc_id": pa.array([names[i] for i in p["doc"].tolist()], pa.int64()),
                    "start": pa.array(p["start"]), "length": pa.array(p["length"]),
                    "ids_crc32": pa.array([zlib.crc32(x) for x in raw], pa.int64()),
                    "doc_tokens": pa.array(tokens[p["doc"]]), "sequence_id": pa.array(number + p["sequence"]),
                    "offset": pa.array(p["offset"])}
            if with_ids:
                cols["ids"] = pa.array(raw, pa.binary())
            number += int(p["sequence"][-1]) + 1
            return pa.RecordBatch.from_pydict(cols)

        for batch in batches:
            for part in slices(batch, "text"):
                for x, t, doc_id in zip(*tok.encode(texts(part)), part.column("doc_id").to_pylist()):
                    ids.append(np.append(x, np.uint32(end_id)))
                    terms.append(t)
                    names.append(doc_id)
                    held += len(x) + 1
                    if held >= SHARD_IDS:
                        yield flush()
                        ids, terms, names, held = [], [], [], 0
        if ids:
            yield flush()

    schema = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
              "offset long" + ", ids binary" * with_ids)
    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, schema)
