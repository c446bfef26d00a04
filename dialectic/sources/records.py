"""Records of large files that are no plain lines, read by many tasks.

A file is cut into fragments at a separator byte by the splittable text source
(line feeds; closing braces for JSON arrays). Whether a fragment's end is the
end of a record depends on what came before: an open quote, an open brace. So
the fragments of every split are first summed up for both cases, "starts
outside quotes" and "starts inside"; a running sum over the splits of a file
(one small row per split) tells each split its true state; and the second
scan finds the record ends, byte places and record numbers. A record that
is one fragment stays where it was read; only longer ones are put together
by a shuffle. Nothing depends on the whole file fitting in a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialectic.session import checkpoint_dir


@dataclass(frozen=True)
class Layout:
    """How records lie in a file.

    ``separator`` ends a fragment. ``quoted``: quotes protect separators.
    ``nested``: the separator is a closing brace, and a record ends where the
    depth of braces and brackets is back at that of the records (1 within an
    array, else 0). Otherwise each fragment outside quotes ends a record, but for
    blank ones between records.
    """

    separator: str
    quoted: bool = False
    nested: bool = False


LINES = Layout("\n")
CSV = Layout("\n", quoted=True)
JSON_VALUES = Layout("}", quoted=True, nested=True)

_SPLIT = "path string, start long"
TOTALS = f"{_SPLIT}, n long, bytes long, quotes long, depth0 long, depth1 long, array boolean"
PLACED = f"{_SPLIT}, raw binary, place long, record long, ends boolean, alone boolean"
_BLANKS = " \t\r\n\ufeff"


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _fragments(spark: SparkSession, path: str, layout: Layout) -> DataFrame:
    """Fragments in file order within their split, with their own sums: quotes,
    and braces opened less closed if they start outside (``d0``) or inside quotes."""
    f = spark.read.option("lineSep", layout.separator).text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
        F.col("_metadata.file_size").alias("file_size"), F.col("value").alias("raw"),
        F.octet_length("value").cast("long").alias("size"))
    zero = F.lit(0).cast("long")
    quotes = d0 = d1 = zero
    if layout.quoted:
        plain = F.regexp_replace("raw", r"(?s)\\.", "") if layout.nested else F.col("raw")
        quotes = _count(plain, '"').cast("long")
        if layout.nested:
            f = f.withColumn("_pieces", F.split(plain, '"', -1))
            outside = (F.filter("_pieces", lambda x, i: i % 2 == 0), F.filter("_pieces", lambda x, i: i % 2 == 1))
            d0, d1 = [(_count(o, "{[") - _count(o, "}]")).cast("long") for o in (F.array_join(x, "") for x in outside)]
    f = f.select("path", "start", "file_size", "raw", "size", quotes.alias("q"), d0.alias("d0"), d1.alias("d1"),
                 F.trim(F.translate("raw", _BLANKS, "")) == "", F.trim(F.translate("raw", _BLANKS, "")).startswith("["))
    return f.toDF("path", "start", "file_size", "raw", "size", "q", "d0", "d1", "blank", "bracket")


def _by_split(batch: pa.RecordBatch) -> Iterator[tuple[str, int, dict[str, np.ndarray], pa.RecordBatch]]:
    """The stretches of a batch that come from one split."""
    if not batch.num_rows:
        return
    paths = batch.column("path").dictionary_encode()
    starts = batch.column("start").to_numpy(zero_copy_only=False)
    new = (np.diff(paths.indices.to_numpy()) != 0) | (np.diff(starts) != 0)
    cuts = np.concatenate(([0], np.flatnonzero(new) + 1, [batch.num_rows]))
    for a, b in zip(cuts[:-1], cuts[1:]):
        part = batch.slice(a, b - a)
        numbers = {n: part.column(n).to_numpy(zero_copy_only=False) for n in part.schema.names if n not in ("path", "raw")}
        yield part.column("path")[0].as_py(), int(starts[a]), numbers, part


def _walk(v: dict[str, np.ndarray], layout: Layout, inside: int, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inside before, inside after, depth after) of consecutive fragments."""
    after = (inside + np.cumsum(v["q"])) % 2
    before = np.concatenate(([inside], after[:-1]))
    change = np.where(before == 0, v["d0"], v["d1"])
    if layout.nested:
        change = change - (after == 0)  # the separator itself closes a brace
    return before, after, depth + np.cumsum(change)


def _totals(layout: Layout):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        row: list = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (*at, *row)], names=[
                "path", "start", "n", "bytes", "quotes", "depth0", "depth1", "array"])

        for batch in batches:
            for path, start, v, _ in _by_split(batch):
                if at != (path, start):
                    if at is not None:
                        yield out()
                    at, row = (path, start), [0, 0, 0, 0, 0, bool(v["bracket"][0])]
                inside = row[2] % 2
                for k, first in ((3, inside), (4, 1 - inside)):
                    row[k] = int(_walk(v, layout, first, row[k])[2][-1])
                row[0] += len(v["q"])
                row[1] += int(v["size"].sum()) + len(v["q"])
                row[2] += int(v["q"].sum())
        if at is not None:
            yield out()

    return run


def _place(layout: Layout):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        for batch in batches:
            for path, start, v, part in _by_split(batch):
                if at != (path, start):
                    at = (path, start)
                    inside, depth, place = int(v["inside"][0]), int(v["depth"][0]), int(v["bytes_before"][0])
                    record, ended = 0, start == 0
                before, after, deep = _walk(v, layout, inside, depth)
                ends_at = place + np.cumsum(v["size"] + 1)
                closed = ends_at <= v["file_size"]
                if layout.nested:
                    ends = closed & (after == 0) & (deep == v["base"])
                else:
                    ends = (after == 0) & ~((before == 0) & v["blank"].astype(bool))
                numbers = record + np.concatenate(([0], np.cumsum(ends)[:-1]))
                alone = ends & np.concatenate(([ended], ends[:-1]))
                yield pa.RecordBatch.from_arrays([
                    part.column("path"), part.column("start"), part.column("raw").cast(pa.binary()),
                    pa.array(ends_at - v["size"] - 1), pa.array(numbers.astype(np.int64)), pa.array(ends), pa.array(alone),
                ], names=["path", "start", "raw", "place", "record", "ends", "alone"])
                inside, depth, place = int(after[-1]), int(deep[-1]), int(ends_at[-1])
                record, ended = int(record + ends.sum()), bool(ends[-1])

    return run


def read_records(spark: SparkSession, path: str, layout: Layout) -> DataFrame:
    """``path, number`` (within the file), ``row`` (over all files, in the order
    of their paths), ``place`` (byte where it begins), ``raw`` (its bytes; for ``nested``
    without what separates records) and ``whole``: false for what is left at the
    end of a file without a record end, of which only the first fragment is kept.
    """
    slim = [c for c in ("path", "start", "size", "q", "d0", "d1", "bracket")]
    fragments = _fragments(spark, path, layout)
    totals = fragments.select(*slim).mapInArrow(_totals(layout), TOTALS)
    checkpoint_dir(spark)
    totals = totals.checkpoint(eager=True)
    files = Window.partitionBy("path").orderBy("start")
    before = files.rowsBetween(Window.unboundedPreceding, -1)

    def sum_before(c: Column) -> Column:
        return F.coalesce(F.sum(c).over(before), F.lit(0)).cast("long")

    # Blank fragments may come first in a file: the first split decides.
    base = F.first("array").over(files.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).cast("long")
    states = totals.select("path", "start", sum_before(F.col("bytes")).alias("bytes_before"),
                           (sum_before(F.col("quotes")) % 2).alias("inside"), "depth0", "depth1",
                           (base if layout.nested else F.lit(0).cast("long")).alias("base"))
    states = states.select("path", "start", "bytes_before", "inside", "base", sum_before(
        F.when(F.col("inside") == 0, F.col("depth0")).otherwise(F.col("depth1"))).alias("depth"))
    # One small row per split (at most one for each 128 MB or so): broadcast.
    placed = fragments.join(F.broadcast(states), ["path", "start"]).mapInArrow(_place(layout), PLACED)
    placed = placed.checkpoint(eager=True)
    counts = placed.groupBy("path", "start").agg(F.sum(F.col("ends").cast("long")).alias("n"))
    everything = Window.orderBy("path", "start").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("path")
    counts = counts.select("path", "start", sum_before(F.col("n")).alias("_in_file"), F.sum("n").over(whole).alias("_of_file"),
                           F.coalesce(F.sum("n").over(everything), F.lit(0)).cast("long").alias("_in_all"))
    p = placed.join(F.broadcast(counts), ["path", "start"])
    p = p.select("path", (F.col("_in_file") + F.col("record")).alias("number"), (F.col("_in_all") + F.col("record")).alias("row"),
                 "place", "raw", "alone", (F.col("_in_file") + F.col("record") < F.col("_of_file")).alias("whole"))
    alone = p.where("alone").select("path", "number", "row", "place", "raw", "whole")
    several = p.where("NOT alone AND whole").groupBy("path", "number", "row").agg(
        F.min("place").alias("place"), F.sort_array(F.collect_list(F.struct("place", "raw"))).alias("_f"), F.lit(True).alias("whole"))
    glue = F.lit(bytearray(layout.separator.encode()))
    several = several.withColumn("raw", F.aggregate(
        F.slice("_f", 2, F.greatest(F.size("_f") - 1, F.lit(0))), F.element_at("_f", 1)["raw"],
        lambda acc, x: F.concat(acc, glue, x["raw"]))).drop("_f")
    left = p.where("NOT whole").groupBy("path", "number", "row").agg(
        F.min("place").alias("place"), F.min_by("raw", "place").alias("raw"), F.lit(False).alias("whole"))
    cols = ["path", "number", "row", "place", "raw", "whole"]
    return alone.unionByName(several.select(*cols)).unionByName(left.select(*cols))
