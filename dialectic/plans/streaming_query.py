"""Run the streams over logs and files derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialectic.operators.metrics import BATCH_KEYS
from dialectic.session import scratch_dir
from dialectic.sources.sinks import append_log
from dialectic.streaming.rollup import SAMPLE_COLS, latest_rollup, run_rollup, sequence_log
from dialectic.streaming.threads_stream import latest_threads, run_thread_stream


def finish(query) -> None:
    """Wait for an ``availableNow`` query and raise what it raised."""
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def stream_rollup_over(spark: SparkSession, scored: DataFrame, tokens: DataFrame) -> DataFrame:
    """Append ``scored`` as a per-sample log and ``tokens`` as a sequence log (one
    file set per run/type partition, as a training job would), stream both with
    an ``availableNow`` trigger, and return the last version of every key."""
    base = scratch_dir(spark, "stream-rollup")
    samples = scored.select(*BATCH_KEYS, *SAMPLE_COLS)
    sequences = sequence_log(tokens)
    append_log(samples.repartition("run_id", "type"), f"{base}/samples", partition_by=())
    append_log(sequences.repartition("run_id", "type"), f"{base}/sequences", partition_by=())
    finish(run_rollup(spark, f"{base}/samples", samples.schema, f"{base}/out", f"{base}/_checkpoint",
                      f"{base}/sequences", sequences.schema))
    return latest_rollup(spark, f"{base}/out")


def stream_threads_over(spark: SparkSession, comments: DataFrame, submissions: DataFrame,
                        delta_symbols: list[str], parts: list[F.Column]) -> DataFrame:
    """Deliver ``comments`` to a stream in files one after another, one per
    trigger: those of the first condition, of the second, ..., the others. Returns
    the last version of all thread records."""
    base = scratch_dir(spark, "stream-threads")
    src, out = f"{base}/incoming", f"{base}/threads"
    part = F.lit(len(parts))
    for i, condition in reversed(list(enumerate(parts))):
        part = F.when(condition, F.lit(i)).otherwise(part)
    for i in range(len(parts) + 1):
        comments.where(part == i).coalesce(1).write.mode("append").parquet(src)
    finish(run_thread_stream(spark, src, comments.schema, submissions, out, f"{base}/_checkpoint",
                             delta_symbols=delta_symbols, max_files_per_trigger=1))
    return latest_threads(spark, out)[0].drop("comments_id")
