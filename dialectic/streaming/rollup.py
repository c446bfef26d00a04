"""Running roll-up of all batch metrics with Structured Streaming.

Two logs grow file by file while a run trains: one row per sample (loss,
rewards, log-probs) and one row per sequence with its tokens' labels and logits
(policy and reference, chosen and rejected). Both streams are laid one under
the other and aggregated by ``(run_id, type, step)`` in one state: samples and
tokens of a key may come in any order and in different batches. There is no
event time, so the state is bounded by the number of keys, not by a watermark.

The query runs in update mode: a micro-batch hands over the keys it touched,
which become a new version of those keys alone (``<out>/batch=<b>``; a batch
that is replayed after a failure replaces its own folder). ``latest_rollup``
reads the last version of every key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dialectic.operators.metrics import BATCH_KEYS
from dialectic.operators.scoring import IGNORE_INDEX, MODELS, SIDES, finite_exp, token_nll

#: Columns that the sample log holds beside the keys.
SAMPLE_COLS = ["loss", "chosen_reward", "rejected_reward", "policy_chosen_logps", "policy_rejected_logps"]
#: Columns of the sequence log beside the keys; ``tokens`` is an array of
#: ``pos, label, logits`` in the order of ``pos``.
SEQUENCE_COLS = ["model", "side", "tokens"]


def sequence_log(tokens: DataFrame, keys: list[str] | None = None, sample: str = "sample_id") -> DataFrame:
    """Token rows ``(keys, sample, model, side, pos, label, logits)`` as the
    sequence log: one row per sequence. An array is one sequence long."""
    keys = keys or BATCH_KEYS
    return tokens.groupBy(*keys, sample, "model", "side").agg(
        F.sort_array(F.collect_list(F.struct("pos", "label", "logits"))).alias("tokens")).select(*keys, *SEQUENCE_COLS)


def _token_rows(sequences: DataFrame, keys: list[str]) -> DataFrame:
    """One row per token with the NLL of the next token's label. The shift is
    taken inside the sequence's array, so a stream needs no window for it."""
    rows = sequences.select(*keys, "model", "side", "tokens", F.posexplode("tokens").alias("_at", "_t"))
    nxt = F.coalesce(F.get("tokens", F.col("_at") + 1)["label"], F.lit(IGNORE_INDEX))
    rows = token_nll(rows.select(*keys, "model", "side", F.col("_t")["logits"].alias("logits"), nxt.alias("label")))
    return rows.select(*keys, "model", "side", "nll", F.size("logits").cast("double").alias("_n_logits"),
                       F.aggregate("logits", F.lit(0.0), lambda acc, v: acc + v).alias("_sum_logits"))


def rollup_stream(samples: DataFrame, sequences: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """All batch metrics per key (columns as the batch ``metric_rollup`` with side
    metrics), for streams or tables alike. A key without samples yet has
    ``n_samples`` 0; without ``sequences`` the side metrics are those of no token."""
    keys = keys or BATCH_KEYS
    rows = samples.select(*keys, *SAMPLE_COLS, F.lit(1).alias("_sample"))
    if sequences is not None:
        rows = rows.unionByName(_token_rows(sequences, keys), allowMissingColumns=True)
    else:
        for c, kind in (("model", "string"), ("side", "string"), ("nll", "double"), ("_n_logits", "double"),
                        ("_sum_logits", "double")):
            rows = rows.withColumn(c, F.lit(None).cast(kind))
    cr, rr = F.col("chosen_reward"), F.col("rejected_reward")

    def only(model: str, side: str, col: str) -> F.Column:
        return F.when((F.col("model") == model) & (F.col("side") == side), F.col(col))

    g = rows.groupBy(*keys).agg(
        F.count("_sample").alias("n_samples"), F.avg("loss").alias("loss"),
        F.avg(cr).alias("rewards_chosen"), F.avg(rr).alias("rewards_rejected"),
        F.avg((cr > rr).cast("double")).alias("rewards_accuracies"), F.avg(cr - rr).alias("rewards_margins"),
        F.avg("policy_chosen_logps").alias("logps_chosen"), F.avg("policy_rejected_logps").alias("logps_rejected"),
        *[F.sum(only("policy", s, "_sum_logits")).alias(f"_sum_{s}") for s in SIDES],
        *[F.sum(only("policy", s, "_n_logits")).alias(f"_n_{s}") for s in SIDES],
        *[F.avg(only(m, s, "nll")).alias(f"_{m}_{s}") for m in MODELS for s in SIDES])
    prefix = F.when(F.col("type") == "eval", F.lit("eval_")).otherwise(F.lit("")) if "type" in keys else F.lit("")
    return g.select(
        *keys, "n_samples", "loss", "rewards_chosen", "rewards_rejected", "rewards_accuracies", "rewards_margins",
        "logps_chosen", "logps_rejected", *[(F.col(f"_sum_{s}") / F.col(f"_n_{s}")).alias(f"logits_{s}") for s in SIDES],
        *[finite_exp(F.col(f"_{m}_{s}")).alias(f"perplexity_{m}_{s}") for m in MODELS for s in SIDES],
        F.col("_policy_chosen").alias("nll_loss"), prefix.alias("metric_prefix"))


def run_rollup(spark: SparkSession, samples_dir: str, samples_schema: StructType, out_dir: str, checkpoint: str,
               sequences_dir: str | None = None, sequences_schema: StructType | None = None, fmt: str = "parquet",
               available_now: bool = True, max_files_per_trigger: int | None = None):
    """Start the roll-up: file sources -> one aggregate -> versions at ``out_dir``.

    State and progress live under ``checkpoint``, so a restarted query resumes
    where it stopped. ``availableNow`` processes what exists and stops; the
    same code runs on with a processing-time trigger. Returns the ``StreamingQuery``.
    """
    def stream(path: str, schema: StructType) -> DataFrame:
        reader = spark.readStream.schema(schema).format(fmt)
        if max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
        return reader.load(path)

    sequences = stream(sequences_dir, sequences_schema) if sequences_dir else None
    changed = rollup_stream(stream(samples_dir, samples_schema), sequences)

    def sink(batch: DataFrame, epoch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_dir}/batch={epoch_id}")

    w = changed.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(sink)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def latest_rollup(spark: SparkSession, out_dir: str, keys: list[str] | None = None) -> DataFrame:
    """The last version of every key that has samples: one aggregation of the
    slim metric rows by key."""
    keys = keys or BATCH_KEYS
    versions = spark.read.parquet(out_dir)
    values = [c for c in versions.columns if c not in (*keys, "batch")]
    last = versions.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_last"))
    return last.select(*keys, "_last.*").where(F.col("n_samples") > 0)
