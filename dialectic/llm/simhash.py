"""Near-duplicate documents by SimHash and covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from dialectic.llm.components import connected_components
from dialectic.llm.frames import free_name, slices, stored, texts

BITS = 64
HASH_SEED = 42
#: Shingles whose bits are unpacked at a time.
BLOCK = 1 << 16


def fingerprint(text: bytes, shingle_words: int = 3) -> int:
    """64-bit SimHash (unsigned) of the text's word shingles.

    A-Z are lower-cased, words are runs without ASCII white space, shingles
    keep repeats. Fewer words than a shingle: one shingle of all of them; no
    word: 0. A bit is 1 if it is set in over half of the shingles' XXH64.
    """
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle_words:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(shingle_words)))))
    ones = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_digest
    for i in range(0, len(shingles), BLOCK):
        raw = b"".join([digest(s, HASH_SEED) for s in shingles[i:i + BLOCK]])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(-1, BITS)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(shingles)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle_words: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp) per row of ``docs``; ``fp`` as signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                fps = np.array([fingerprint(t, shingle_words) for t in texts(part)], np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_hash"), pa.array(fps.view(np.int64))],
                    names=["doc_id", "text_hash", "fp"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"),
                       F.col("text").cast("binary").alias("text"))
    return slim.mapInArrow(run, "doc_id long, text_hash long, fp long")


def covering_masks(radius: int) -> list[int]:
    """2^(radius+1)-1 bit masks (signed longs): bit i gets a non-zero label of
    radius+1 bits, and mask v keeps the bits whose label has an odd overlap
    with v. Any ``radius`` positions are missed by at least one mask, so two
    fingerprints within the radius agree under some mask."""
    n = (1 << (radius + 1)) - 1
    labels = [1 + i % n for i in range(BITS)]
    masks = [sum(1 << i for i, a in enumerate(labels) if bin(a & v).count("1") % 2) for v in range(1, n + 1)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def links(fps: DataFrame, max_bits: int) -> DataFrame:
    """Edges (a, b) whose components are those of "at most ``max_bits``
    differing bits", from a table of different fingerprints ``fp``.

    Fingerprints that share a masked value with another one become candidates.
    Candidates of one table can differ only in the bits its mask drops, so each
    meets its partners at the values half way (itself and itself with one of
    those bits flipped). At most 65 fingerprints meet at a value; a star there
    replaces all pairs, however many fingerprints share a masked value.
    """
    if max_bits not in (0, 1, 2):
        raise ValueError("max_bits must be 0, 1 or 2")
    masks = covering_masks(max_bits)
    keyed = fps.select("fp", F.posexplode(F.array(
        *[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("table", "key"))
    crowded = stored(keyed.groupBy("table", "key").agg(F.count("*").alias("n")).filter("n > 1").drop("n"),
                     "simhash-crowded")
    signed = [1 << i if i < BITS - 1 else -(1 << i) for i in range(BITS)]
    flips = F.array(*[F.array(*[F.lit(x) for x in [0] + [s for i, s in enumerate(signed) if not m >> i & 1]])
                      for m in masks])
    met = (keyed.join(crowded, ["table", "key"])
           .select("fp", F.explode(flips[F.col("table")]).alias("flip"))
           .select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("at"))
           .groupBy("at").agg(F.collect_set("fp").alias("near")).filter(F.size("near") > 1))
    if max_bits == 2:
        met = met.withColumn("a", F.array_min("near"))
    else:  # half way is one of the two itself
        met = met.filter(F.array_contains("near", F.col("at"))).withColumn("a", F.col("at"))
    return (met.select("a", F.explode("near").alias("b"))
            .filter((F.col("a") != F.col("b"))
                    & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)).distinct())


def near_duplicates(docs: DataFrame, shingle_words: int = 3, max_bits: int = 2) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, fingerprint (16 hex
    digits), component_id, text_hash, and kept_id/kept_hash, which name the row
    of the component that stays (smallest id, then smallest hash).

    Equal fingerprints are collapsed before linking, so copies cost one row.
    Null or empty text has fingerprint 0. A null doc_id never names a component
    unless all ids of the component are null. Repeated rows give repeated rows.
    Other columns are not read.
    """
    fps = stored(fingerprints(docs, shingle_words), "simhash-fps")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    one = stored(fps.groupBy("fp").agg(F.min(order).alias("first")), "simhash-distinct")
    label = stored(connected_components(links(one.select("fp"), max_bits)), "simhash-labels")
    lone = one.join(label, one.fp == label.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"), F.col("root").isNull().alias("alone"))
    groups = lone.filter("not alone")
    least = stored(groups.groupBy("root").agg(F.min("first").alias("kept")), "simhash-least")
    named = (groups.join(least, "root").select("fp", "kept")
             .union(lone.filter("alone").select("fp", F.col("first").alias("kept"))))
    named = stored(named, "simhash-named")
    return fps.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("kept.doc_id").alias("component_id"), "text_hash",
        F.col("kept.doc_id").alias("kept_id"), F.col("kept.text_hash").alias("kept_hash"))


def drop_near_duplicates(docs: DataFrame, shingle_words: int = 3, max_bits: int = 2) -> DataFrame:
    """``docs`` with one row of each component left; columns as they were. Of rows
    with equal id and text, the one with the smallest hash of all columns stays."""
    found = near_duplicates(docs, shingle_words, max_bits)
    mine, key, other, whole = (free_name(docs.columns, n) for n in ("_hash", "_id", "_kept_hash", "_row"))
    kept = found.select(F.col("kept_id").alias(key), F.col("kept_hash").alias(other)).distinct()
    keyed = docs.withColumn(mine, F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = keyed.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col(key)) & (F.col(mine) == F.col(other)), "left_semi")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    plain = [F.to_json(c) if isinstance(f.dataType, MapType) else c for c, f in zip(columns, docs.schema.fields)]
    one = rows.groupBy("doc_id", mine).agg(F.min_by(F.struct(*columns), F.xxhash64(*plain)).alias(whole))
    return one.select(*[F.col(whole).getField(c).alias(c) for c in docs.columns])
