"""Exact global positions and running sums without a one-partition window.

``row_number().over(Window.orderBy(k))`` moves every row into one task. The
helpers here split the order into *buckets*: a column that is monotone with
the order and has a bounded number of values. Each bucket is numbered in its
own window partition; the bucket totals (one row per bucket, bounded by
construction) get a running sum in one small task and are broadcast back.

Inputs are slim key frames (callers join wide columns back by a unique
key); they are checkpointed once, then shuffled once by bucket, plus one
shuffle of the tiny bucket table. No task ever sees more than one bucket, so
the plan scales with the cluster as long as buckets are even — true for hash-ordered keys and for ranges sampled
from the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from dialectic.session import checkpoint_dir

# Hex digits of an md5 digest used as the bucket of a hash order:
# 4 digits -> at most 65,536 bucket rows in the broadcast offset table.
HASH_BUCKET_HEX_DIGITS = 4
# Rows a range bucket aims at, and the upper bound on the number of buckets
# (rows of the broadcast offset table).
ROWS_PER_BUCKET = 1 << 18
MAX_RANGE_BUCKETS = 1 << 16
# Rows that the bounds of a selection round are taken from, and its bounds.
SAMPLE_ROWS, BOUNDS = 1 << 12, 1 << 8


def seeded_md5(seed: int | str, key: Column) -> Column:
    """``md5("<seed>|<key>")`` — a reproducible, input-order-free shuffle key.

    Same digest in Spark and DuckDB, so the order is checkable by SQL.
    """
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def md5_int32(c: Column) -> Column:
    """First 32 bits of ``md5(c)`` as a non-negative BIGINT."""
    return F.conv(F.substring(F.md5(c.cast("string")), 1, 8), 16, 10).cast("long")


def hash_bucket(digest: Column) -> Column:
    """Bucket of an md5 hex digest that is monotone with the digest order."""
    return F.conv(F.substring(digest, 1, HASH_BUCKET_HEX_DIGITS), 16, 10).cast("long")


def ordered_running_sum(
    df: DataFrame,
    order_cols: list[Column],
    bucket: Column,
    value: Column | None = None,
    out: str = "idx",
    total: str | None = None,
    partition_cols: list[str] | None = None,
    materialize: bool = True,
) -> DataFrame:
    """Add ``out`` = sum of ``value`` over all rows strictly before this row in
    the order ``(partition, bucket, *order_cols)``; with ``value`` unset the
    result is the dense 0-based position. ``order_cols`` must make the order
    total. Optional ``total`` adds the sum over the whole partition.

    ``partition_cols`` restarts the numbering per group (e.g. per prompt);
    a hot group is still split into buckets, so it never lands in one task.
    """
    part = list(partition_cols or [])
    val = F.lit(1).cast("long") if value is None else value
    d = df.withColumn("_bkt", bucket).withColumn("_val", val)
    # The input feeds two branches (bucket numbering, bucket totals). Pass
    # slim key frames only; they are written once to the shared checkpoint
    # folder so the (often aggregated) input is computed once and a lost
    # executor re-reads files instead of replaying the lineage.
    if materialize:
        checkpoint_dir(df.sparkSession)
        d = d.checkpoint(eager=True)

    # One shuffle by (group, bucket): the running sum inside each bucket and
    # the bucket total come from the same partitioning.
    w_b = Window.partitionBy(*part, "_bkt")
    w_in = w_b.orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, -1)
    local = (d.withColumn("_loc", F.coalesce(F.sum("_val").over(w_in), F.lit(0)))
              .withColumn("_bsum", F.sum("_val").over(w_b)))

    # Bucket totals: already clustered by (group, bucket), so this aggregate
    # adds no exchange and the scan/shuffle above is reused, not repeated.
    sizes = local.groupBy(*part, "_bkt").agg(F.max("_bsum").alias("_bsum"))
    w_all = Window.partitionBy(*part) if part else Window.partitionBy()
    w_prev = w_all.orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_boff", F.coalesce(F.sum("_bsum").over(w_prev), F.lit(0)))
    if total:
        offsets = offsets.withColumn(total, F.sum("_bsum").over(w_all))
    offsets = offsets.drop("_bsum")

    # Without a group key the offset table has one row per bucket (bounded by
    # construction) and is broadcast; per-group offsets scale with the groups
    # and are joined normally so AQE can choose from measured sizes.
    off = F.broadcast(offsets) if not part else offsets
    res = local.drop("_bsum").join(off, on=[*part, "_bkt"], how="inner")
    return res.withColumn(out, (F.col("_boff") + F.col("_loc")).cast("long")).drop(
        "_bkt", "_val", "_boff", "_loc")


def hash_order_index(df: DataFrame, key: Column, seed: int | str, out: str = "idx",
                     total: str | None = None, tiebreak: list[Column] | None = None) -> DataFrame:
    """Dense position of each row when rows are ordered by
    ``md5(seed|key)`` (ties broken by ``tiebreak``, default the key)."""
    digest = seeded_md5(seed, key)
    d = df.withColumn("_digest", digest)
    order = [F.col("_digest")] + (tiebreak if tiebreak is not None else [key])
    return ordered_running_sum(d, order, hash_bucket(F.col("_digest")), out=out,
                               total=total).drop("_digest")


def order_index(df: DataFrame, keys: list[str], out: str = "idx", total: str | None = None,
                value: Column | None = None, partition_cols: list[str] | None = None,
                rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Dense position (or running sum of ``value``) in ascending order of
    ``keys``, which are unique together (within the group, if grouped).

    Buckets are the ranges Spark samples from the data, so outliers and gaps
    in the keys leave them even. Pass slim key frames only.
    """
    checkpoint_dir(df.sparkSession)
    df = df.checkpoint(eager=True)
    n = min(MAX_RANGE_BUCKETS, max(1, -(-df.count() // rows_per_bucket)))
    ranged = (df.repartitionByRange(n, *(partition_cols or []), *keys)
              .withColumn("_range", F.spark_partition_id()).checkpoint(eager=True))
    return ordered_running_sum(ranged, [F.col(k) for k in keys], F.col("_range").cast("long"), value=value,
                               out=out, total=total, partition_cols=partition_cols,
                               materialize=False).drop("_range")


def int_order_index(df: DataFrame, key: str, out: str = "idx", total: str | None = None,
                    value: Column | None = None, partition_cols: list[str] | None = None) -> DataFrame:
    """``order_index`` by one column."""
    return order_index(df, [key], out=out, total=total, value=value, partition_cols=partition_cols)


def rows_at(df: DataFrame, keys: list[str], positions: list[int], out: str = "pos") -> DataFrame:
    """``(*keys, out)`` of the rows at ``positions`` in ascending order of
    ``keys``, which are unique together. As in list indexing, negative positions
    count from the end, a repeated one gives its row again and one past an end
    raises ``IndexError``; ``out`` is counted from the start.

    A distributed selection: each round cuts the rows into ranges by sampled
    bounds, counts them (one small row per task and range, rows do not move) and
    keeps the ranges that hold a position. What is left is numbered, in one window
    if it is one bucket, in buckets if the positions lie all over the order.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    rest = df.select(*keys).checkpoint(eager=True)
    n = rest.count()
    missing = sorted({p for p in positions if not -n <= p < n})
    if missing:
        raise IndexError(f"positions out of range: {missing}")
    asked = [p % n for p in positions]
    place = {p: p for p in asked}  # position -> place among the rows left
    while place and n > ROWS_PER_BUCKET:
        sample = rest.orderBy(F.xxhash64(*keys), *keys).limit(SAMPLE_ROWS).orderBy(*keys).collect()
        bounds = F.array(*[F.struct(*[F.lit(r[k]).cast(rest.schema[k].dataType).alias(k) for k in keys])
                           for r in sample[::max(1, len(sample) // BOUNDS)]])
        held = rest.withColumn("_range", F.size(F.filter(bounds, lambda b: b <= F.struct(*keys))))
        before, gone, keep, now = 0, 0, [], {}
        for r in sorted(held.groupBy("_range").count().collect()):
            inside = {p: at - gone for p, at in place.items() if before <= at < before + r["count"]}
            before += r["count"]
            if inside:
                keep.append(r["_range"])
                now.update(inside)
            else:
                gone += r["count"]
        if 2 * gone < n:
            break
        rest, n, place = held.where(F.col("_range").isin(keep)).drop("_range").checkpoint(eager=True), n - gone, now
    if n > ROWS_PER_BUCKET:
        numbered = order_index(rest, keys, out="_place")
    else:
        numbered = rest.withColumn("_place", (F.row_number().over(Window.orderBy(*keys)) - 1).cast("long"))
    wanted = spark.createDataFrame([(place[p], p) for p in asked], f"_place long, {out} long")
    return numbered.join(wanted, "_place").select(*keys, out)
