"""Reading, storing and slicing helpers shared by the operators here."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dialectic.session import scratch_dir

#: Bytes of text an Arrow worker turns into Python objects at a time.
SLICE_BYTES = 1 << 20
#: Counts that are summed in one window.
GROUP = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, by: str | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """``df`` written once as Parquet into the shared checkpoint folder (one
    folder per value of ``by``; with the writer's ``options``) and read back: the
    lineage is cut, and a lost executor re-reads files."""
    path = scratch_dir(df.sparkSession, name)
    (df.write.partitionBy(by) if by else df.write).options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_bytes(spark: SparkSession, limit: int) -> Iterator[None]:
    """What runs inside gives Python's workers batches of about ``limit`` bytes (whole
    rows, at least one); Spark and a worker hold a batch several times over. The
    session's own limit is put back."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, limit)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def free_name(taken: list[str], name: str) -> str:
    """``name``, with as many underscores in front as it takes to differ from all
    of ``taken`` (Spark's column names do not tell upper from lower case)."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def id_remainder(doc_id: str, modulus: int) -> Column:
    """``crc32(doc_id as text) mod modulus``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(modulus))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``limit`` bytes of ``column``
    (at least one row); whole rows only."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size.astype(np.int64) + 1)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def texts(part: pa.RecordBatch, column: str = "text") -> list:
    """The column's values with null as empty (``''`` or ``b''``)."""
    col = part.column(column)
    empty = b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else ""
    return [empty if x is None else x for x in col.to_pylist()]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices ``start .. start+length-1`` of every segment, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    keep = lengths > 0
    starts, lengths = starts[keep], lengths[keep]
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    out[first] = starts
    out[first[1:]] -= starts[:-1] + lengths[:-1] - 1
    return np.cumsum(out)


def running_sums(counts: DataFrame, values: list[str], keys: list[str], order: str) -> DataFrame:
    """``counts`` with ``<value>_before``: the sum over smaller ``order`` within
    ``keys``. One row per block or stretch of rows, in two levels, so that no
    window holds more than a square root of them."""
    group = F.floor(F.col(order) / GROUP).cast("long")
    c = stored(counts.withColumn("_group", group), "running-counts")
    inner = Window.partitionBy(*keys, "_group").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    outer = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("_group").rowsBetween(
        Window.unboundedPreceding, -1)
    groups = c.groupBy(*keys, "_group").agg(*[F.sum(v).alias(f"_{v}") for v in values])
    groups = groups.select(*keys, "_group", *[F.coalesce(F.sum(f"_{v}").over(outer), F.lit(0)).alias(f"_{v}")
                                              for v in values])
    local = c.select("*", *[F.coalesce(F.sum(v).over(inner), F.lit(0)).alias(f"{v}_before") for v in values])
    out = local.join(groups, [*keys, "_group"])
    for v in values:
        out = out.withColumn(f"{v}_before", F.col(f"{v}_before") + F.col(f"_{v}"))
    return out.drop("_group", *[f"_{v}" for v in values])
