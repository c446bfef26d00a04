"""Thread records kept right while comment files arrive in any order.

Every micro-batch adds its comments to a table of those delivered so far and
rebuilds the threads that they change: those of its own OP comments, and those
written or held back earlier that *watch* one of its ids. A thread watches its
comments' ids and their parents', also a parent that has not arrived yet, so an
ancestor that comes files later (or a comment delivered again) reaches every
thread it belongs to. The rebuilt records are a new version; ``latest_threads``
reads one version per OP comment.

State is plain tables under ``<state>``: ``comments``, ``watch`` and ``records``,
one folder per batch. A batch that is replayed after a failure reads the
folders before its own and replaces its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dialectic.functions.text import strip_type_prefix
from dialectic.operators.threads import quarantined, thread_records, to_threads

WATCH = "id string, comments_id string"


def _so_far(spark: SparkSession, path: str, schema, batch_id: int, own: bool) -> DataFrame:
    """The folders of the batches up to this one (``own``) or before it."""
    df = spark.read.schema(schema).option("basePath", path).parquet(
        *[f"{path}/batch={b}" for b in range(batch_id + own)]) if batch_id + own else spark.createDataFrame([], schema)
    return df.drop("batch")


def scope(comments: DataFrame, seeds: DataFrame) -> DataFrame:
    """The comments that walks up from ``seeds`` (``comments_id``) can meet: those
    under the seeds' submissions, and under any submission that a parent
    reference crosses into. Normal data has no such crossing, and two passes over
    slim columns find that out; each further submission level is one more."""
    refs = comments.select("id", "link_id", strip_type_prefix("parent_id").alias("parent"))
    under = F.col("link_id").eqNullSafe(F.col("_link"))
    links = (refs.join(seeds.select(F.col("comments_id").alias("_seed")), F.col("id") == F.col("_seed"), "left_semi")
             .select(F.col("link_id").alias("_link")).distinct())
    while True:
        links = links.checkpoint(eager=True)
        inside = refs.join(links, under, "left_semi")
        have = inside.select(F.col("id").alias("_have")).distinct()
        outside = (inside.select(F.col("parent").alias("_wanted")).distinct()
                   .join(have, F.col("_wanted") == F.col("_have"), "left_anti"))
        crossed = (refs.join(outside, F.col("id") == F.col("_wanted"), "left_semi").join(links, under, "left_anti")
                   .select(F.col("link_id").alias("_link")).distinct().checkpoint(eager=True))
        if not crossed.limit(1).count():
            return comments.join(links, under, "left_semi")
        links = links.unionByName(crossed)


def rebuild(spark: SparkSession, batch: DataFrame, batch_id: int, submissions: DataFrame, state: str, out_dir: str,
            delta_symbols: list[str] | None) -> None:
    """One micro-batch: deliver, find the changed threads, write their new version."""
    batch.write.mode("overwrite").parquet(f"{state}/comments/batch={batch_id}")
    new = spark.read.schema(batch.schema).parquet(f"{state}/comments/batch={batch_id}")
    known = _so_far(spark, f"{state}/comments", batch.schema, batch_id, own=True)
    watch = _so_far(spark, f"{state}/watch", WATCH, batch_id, own=False)
    ids = new.select("id").where(F.col("id").isNotNull()).distinct()
    touched = watch.join(ids, "id", "left_semi").select("comments_id")
    changed = touched.unionByName(ids.withColumnRenamed("id", "comments_id")).distinct().checkpoint(eager=True)
    near = scope(known, changed)
    seeds = near.join(changed.select(F.col("comments_id").alias("_seed")), F.col("id") == F.col("_seed"), "left_semi")
    records, stuck = thread_records(near, submissions, seeds)
    path = f"{state}/records/batch={batch_id}"
    records.write.mode("overwrite").parquet(path)
    records = spark.read.schema(records.schema).parquet(path)
    member = records.select("comments_id", F.explode("comments_thread").alias("_c"))
    both = F.explode(F.array(F.col("_c.comment_id"), strip_type_prefix(F.col("_c.comment_parent_id"))))
    member.select(both.alias("id"), "comments_id").where(F.col("id").isNotNull()).distinct().write.mode(
        "overwrite").parquet(f"{state}/watch/batch={batch_id}")
    to_threads(records, delta_symbols, keep_id=True).write.mode("overwrite").parquet(f"{out_dir}/batch={batch_id}")
    quarantined(records, stuck).write.mode("overwrite").parquet(f"{out_dir}_quarantine/batch={batch_id}")


def run_thread_stream(spark: SparkSession, source_dir: str, schema: StructType, submissions: DataFrame, out_dir: str,
                      checkpoint: str, delta_symbols: list[str] | None = None, max_files_per_trigger: int | None = None,
                      available_now: bool = True, fmt: str = "parquet"):
    """Start the stream; returns the ``StreamingQuery``. Versions go to
    ``<out>/batch=<b>`` and ``<out>_quarantine/batch=<b>``, the state beside the
    progress under ``checkpoint``."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        rebuild(batch.sparkSession, batch, batch_id, submissions, f"{checkpoint}-state", out_dir, delta_symbols)

    w = reader.load(source_dir).writeStream.option("checkpointLocation", checkpoint).foreachBatch(per_batch)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def latest_threads(spark: SparkSession, out_dir: str) -> tuple[DataFrame, DataFrame]:
    """``(threads, quarantine)``: per OP comment the rows of the last batch that
    rebuilt it, wherever that put it."""
    threads, held = spark.read.parquet(out_dir), spark.read.parquet(f"{out_dir}_quarantine")
    version = (threads.select("comments_id", "batch").unionByName(held.select("comments_id", "batch"))
               .groupBy("comments_id").agg(F.max("batch").alias("batch")))
    return (threads.join(version, ["comments_id", "batch"], "left_semi").drop("batch"),
            held.join(version, ["comments_id", "batch"], "left_semi").drop("batch"))
