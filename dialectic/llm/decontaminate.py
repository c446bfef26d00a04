"""Benchmark passages in documents by one Aho-Corasick automaton."""

from __future__ import annotations

import itertools
import re
import sys
import types
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialectic.llm.frames import free_name, slices, stored, texts

WINDOW_WORDS = 10
#: Letters of all windows (and of the ids of their items) behind one automaton,
#: and so its most nodes, of about 54 bytes each: some 220 MB. The windows of a
#: larger benchmark are dealt to several, one scan of the documents for each.
AUTOMATON_LETTERS = 4 << 20

# Normal form of a byte: A-Z lower-cased, digits, a-z and all non-ASCII bytes
# kept, everything else a space. UTF-8 keeps non-ASCII characters whole.
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
                for c in range(256))
_LOWER = {c: c + 32 for c in range(65, 91)}
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: bytes) -> list[bytes]:
    """The normalised words of a UTF-8 text."""
    return text.translate(_NORMAL).split()


def windows(words: list[bytes], size: int = WINDOW_WORDS) -> set[bytes]:
    """Joined windows of ``size`` words; a shorter, non-empty list is one."""
    if not words:
        return set()
    if len(words) < size:
        return {b" ".join(words)}
    return {b" ".join(words[i:i + size]) for i in range(len(words) - size + 1)}


def build_automaton(owners: list[tuple[bytes, tuple[str, ...]]]) -> ahocorasick.Automaton | None:
    """Automaton over different windows, each with a space on both sides; a value
    holds the number of words and the ids of the items with that window."""
    if not owners:
        return None
    a = ahocorasick.Automaton()
    for w, ids in owners:
        key = " " + w.decode("latin-1") + " "
        a.add_word(key, (len(key), w.count(b" ") + 1, ids))
    a.make_automaton()
    return a


def _merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def scan(automaton, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
    """Word intervals (start, end) of all window occurrences, overlaps joined,
    and the ids of their items."""
    text = " " + b" ".join(words).decode("latin-1") + " "
    ranges: list[tuple[int, int]] = []
    items: set[str] = set()
    before = None
    for end, (length, n, ids) in automaton.iter(text):
        if before is None:  # spaces before each character: the word that starts there
            before = np.cumsum(np.frombuffer(text.encode("latin-1"), np.uint8) == 32)
        start = int(before[end - length + 1]) - 1
        items.update(ids)
        ranges.append((start, start + n))
    return _merge(ranges), items


def original_spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character offsets in the original text of word intervals."""
    if not ranges:
        return []
    at = [m.span() for m in _WORD.finditer(text.translate(_LOWER))]
    return [(at[a][0], at[b - 1][1]) for a, b in ranges]


def benchmark_windows(benchmark: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """(w, ids): every different window of ``benchmark`` (item_id, text) and its
    items' ids as sorted strings. A null text has no words; a null id is empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                for i, t in zip(part.column("i").to_pylist(), texts(part, "t")):
                    found = sorted(windows(words_of(t), size))
                    for at in range(0, len(found), 10_000):
                        w = found[at:at + 10_000]
                        yield pa.RecordBatch.from_pydict({"w": pa.array(w, pa.binary()), "i": pa.array([i] * len(w), pa.string())})

    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"),
                             F.col("text").cast("binary").alias("t"))
    return items.mapInArrow(run, "w binary, i string").groupBy("w").agg(
        F.array_sort(F.collect_set("i")).alias("ids"))


def benchmark_parts(benchmark: DataFrame, limit: int = AUTOMATON_LETTERS) -> Iterator[list[tuple[bytes, tuple[str, ...]]]]:
    """The different windows with their items, dealt by hash to as few parts as
    hold ``limit`` letters each on average, one part at a time. An empty
    benchmark has no part."""
    found = stored(benchmark_windows(benchmark), "benchmark-windows")
    letters = F.length("w") + 2 + F.aggregate("ids", F.lit(0), lambda s, i: s + F.octet_length(i))
    total = found.agg(F.coalesce(F.sum(letters), F.lit(0)).alias("n")).first()["n"]
    parts = -(-int(total) // limit)
    for part in range(parts):
        mine = found if parts == 1 else found.filter(F.pmod(F.xxhash64("w"), F.lit(parts)) == part)
        rows = [(bytes(r["w"]), tuple(r["ids"])) for r in mine.toLocalIterator()]
        if rows:
            yield rows


def _automaton(shared) -> ahocorasick.Automaton | None:
    """The automaton of a broadcast part, built once in a worker and kept for its
    next tasks. A worker keeps one, that of the part it saw last."""
    kept = sys.modules.setdefault("_dialectic_automaton", types.ModuleType("_dialectic_automaton")).__dict__
    key, owners = shared.value
    if kept.get("key") != key:
        kept.pop("automaton", None)
        kept["key"], kept["automaton"] = key, build_automaton(owners or [])
    return kept["automaton"]


HITS = "array<struct<start:int,end:int>>"


def added_names(columns: list[str]) -> list[str]:
    """The names of the columns that ``mark`` adds to ``columns``."""
    return [free_name(columns, n) for n in ("_n_words", "_hits", "_items")]


def _scanned(docs: DataFrame, names: list[str], part: list | None, only_hits: bool) -> tuple[DataFrame, Broadcast]:
    """``docs`` with the columns ``names`` (words, hits, items) of one part, and
    the broadcast part."""
    words_name, hits_name, items_name = names
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, part))
    schema = docs.select("*", F.lit(0).cast("long").alias(words_name), F.array().cast(HITS).alias(hits_name),
                         F.array().cast("array<string>").alias(items_name)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(shared)
        struct = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for some in slices(batch, "text"):
                n_words, hits, found = [], [], []
                for t in texts(some):
                    words = words_of(t.encode())
                    ranges, ids = scan(automaton, words) if automaton and words else ([], set())
                    n_words.append(len(words))
                    hits.append([{"start": a, "end": b} for a, b in ranges])
                    found.append(sorted(ids))
                out = pa.RecordBatch.from_arrays(
                    [*some.columns, pa.array(n_words, pa.int64()), pa.array(hits, struct), pa.array(found, pa.list_(pa.string()))],
                    names=[*some.schema.names, *names])
                yield out.filter(pa.array([bool(h) for h in hits], pa.bool_())) if only_hits else out

    return docs.mapInArrow(run, schema), shared


def mark(docs: DataFrame, benchmark: DataFrame, limit: int = AUTOMATON_LETTERS) -> DataFrame:
    """The columns of ``docs`` plus ``_n_words``, ``_hits`` (intervals of words;
    ``original_spans`` maps them to the text) and ``_items`` (sorted ids);
    ``added_names`` gives their names where ``docs`` has such columns.

    A part of the benchmark is broadcast (its size is bounded) and all documents
    pass its automaton. Where there are several parts, ``docs`` is written once
    with row numbers, each part's hits are a small table written by a pass of its
    own, its broadcast is dropped after it, and the hits of a row are joined as
    intervals of words. Null text has no words; an empty benchmark hits nothing.
    """
    names = words_name, hits_name, items_name = added_names(docs.columns)
    parts = benchmark_parts(benchmark, limit)
    first, second = next(parts, None), next(parts, None)
    if second is None:
        return _scanned(docs, names, first, False)[0]
    row = free_name([*docs.columns, *names], "_row")
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "decontamination-rows")
    slim = numbered.select(row, "text")
    found = None
    for part in itertools.chain((first, second), parts):
        scanned, shared = _scanned(slim, names, part, True)
        hits = stored(scanned.select(row, hits_name, items_name), "decontamination-hits")
        shared.destroy()
        found = hits if found is None else found.unionByName(hits)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranges = [[{"start": a, "end": b} for a, b in _merge([(x["start"], x["end"]) for x in h])]
                      for h in batch.column(hits_name).to_pylist()]
            yield batch.set_column(1, hits_name, pa.array(ranges, batch.schema.field(hits_name).type))

    once = found.groupBy(row).agg(F.flatten(F.collect_list(hits_name)).alias(hits_name),
                                  F.array_sort(F.array_distinct(F.flatten(F.collect_list(items_name)))).alias(items_name))
    once = once.mapInArrow(joined, once.schema)
    counted = _scanned(numbered, names, None, False)[0].drop(hits_name, items_name)
    return counted.join(once, row, "left").select(
        *docs.columns, words_name, F.coalesce(hits_name, F.array().cast(HITS)).alias(hits_name),
        F.coalesce(items_name, F.array().cast("array<string>")).alias(items_name))


def contamination(docs: DataFrame, benchmark: DataFrame, limit: int = AUTOMATON_LETTERS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items,
    items_sha256, contaminated, and the hit word intervals."""
    marked = mark(docs.select("doc_id", "text"), benchmark, limit)
    n_hit = F.aggregate("_hits", F.lit(0).cast("long"), lambda s, x: s + (x.end - x.start))
    return marked.select(
        "doc_id", F.col("_n_words").alias("n_words"), n_hit.alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"), F.col("_hits").alias("hits"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, limit: int = AUTOMATON_LETTERS) -> DataFrame:
    """``docs`` without the documents in which a window occurs."""
    return mark(docs, benchmark, limit).filter(F.size(added_names(docs.columns)[1]) == 0).select(*docs.columns)
