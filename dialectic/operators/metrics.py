"""Run tables: sample logs, metric roll-ups, loss history, trial selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialectic.functions.mathx import neg_log_sigmoid
from dialectic.operators.scoring import BETA_GRID

BATCH_KEYS = ["run_id", "type", "step"]
PRED_TEXT_COLS = ["policy_chosen_pred_text", "reference_chosen_pred_text",
                  "policy_rejected_pred_text", "reference_rejected_pred_text"]


def sample_log(scored: DataFrame, prefs: DataFrame, steps_per_epoch: int = 4,
               pred_texts: DataFrame | None = None) -> DataFrame:
    """The 16-column per-sample log behind its ``sample_id``: scores joined to
    their texts by key (``sample_id`` = ``row_id``). Predicted-text columns come from
    ``pred_texts`` (keyed by ``sample_id``) when given, else NULL."""
    p = prefs.select(F.col("row_id").alias("sample_id"), "prompt", "chosen", "rejected")
    j = scored.join(p, "sample_id", "left")
    if pred_texts is not None:
        j = j.join(pred_texts.select("sample_id", *PRED_TEXT_COLS), "sample_id", "left")
    else:
        for c in PRED_TEXT_COLS:
            j = j.withColumn(c, F.lit(None).cast("string"))
    epoch = (F.col("step").cast("double") / F.lit(float(steps_per_epoch))).alias("epoch")
    return j.select(
        "sample_id", "run_id", "type", epoch, "step", "prompt", "loss", "chosen_reward", "rejected_reward",
        F.col("policy_chosen_logps").alias("policy_logps_chosen"),
        F.col("policy_rejected_logps").alias("policy_logps_rejected"),
        "chosen", "rejected", *PRED_TEXT_COLS)


def metric_rollup(scored: DataFrame, keys: list[str] | None = None,
                  sides: DataFrame | None = None) -> DataFrame:
    """Batch means of the reward/log-prob metrics per ``(run, type, step)``,
    with the ``eval_`` prefix the tracker used for eval rows. ``sides``
    (:func:`scoring.side_metrics` with the same keys) adds mean logits,
    perplexities and the NLL."""
    keys = keys or BATCH_KEYS
    cr, rr = F.col("chosen_reward"), F.col("rejected_reward")
    g = scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.avg("loss").alias("loss"),
        F.avg(cr).alias("rewards_chosen"),
        F.avg(rr).alias("rewards_rejected"),
        F.avg((cr > rr).cast("double")).alias("rewards_accuracies"),
        F.avg(cr - rr).alias("rewards_margins"),
        F.avg("policy_chosen_logps").alias("logps_chosen"),
        F.avg("policy_rejected_logps").alias("logps_rejected"),
    )
    if sides is not None:
        g = g.join(sides, keys, "left")
    if "type" in keys:
        g = g.withColumn("metric_prefix", F.when(F.col("type") == "eval", F.lit("eval_")).otherwise(F.lit("")))
    return g


def epoch_rollup(batch_metrics: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Step -> epoch roll-up: plain mean of batch means and the
    sample-weighted mean of the loss."""
    keys = keys or ["run_id", "type"]
    return batch_metrics.groupBy(*keys).agg(
        F.avg("loss").alias("loss_mean_of_batches"),
        (F.sum(F.col("loss") * F.col("n_samples")) / F.sum("n_samples")).alias("loss_weighted"),
        F.avg("rewards_accuracies").alias("rewards_accuracies"),
        F.count(F.lit(1)).alias("n_batches"))


def reward_accuracy(scored: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Share of samples whose chosen reward beats the rejected one (strict >)."""
    keys = keys or ["run_id", "type"]
    return scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.avg((F.col("chosen_reward") > F.col("rejected_reward")).cast("double")).alias("reward_accuracy"))


def beta_sweep(pairs: DataFrame, betas: list[float] | None = None) -> DataFrame:
    """DPO loss and accuracy over fixed log-probs for each beta of a grid.

    Each row is replicated once per grid value by a generator (no join);
    the grid is a short parameter list, so work is ``len(grid) x rows``.
    """
    grid = betas or BETA_GRID
    d = pairs.select(
        (F.col("policy_chosen_logps") - F.col("reference_chosen_logps")).alias("_dc"),
        (F.col("policy_rejected_logps") - F.col("reference_rejected_logps")).alias("_dr"),
        F.explode(F.array(*[F.lit(float(b)) for b in grid])).alias("beta"))
    margin = F.col("beta") * (F.col("_dc") - F.col("_dr"))
    return d.groupBy("beta").agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.avg(neg_log_sigmoid(margin)).alias("mean_loss"),
        F.avg((margin > 0).cast("double")).alias("reward_accuracy"))


def best_beta(sweep: DataFrame) -> DataFrame:
    """Grid value with the lowest mean loss (smallest beta on ties)."""
    return sweep.agg(F.min_by(F.struct("beta", "mean_loss"),
                              F.struct("mean_loss", "beta")).alias("b")).select("b.*")


def last_eval_loss(history: DataFrame, keys: list[str] | None = None,
                   value: str = "eval_loss", pos: str = "pos") -> DataFrame:
    """Last non-null value in log order per run (``dropna().iloc[-1]``)."""
    keys = keys or ["run_id"]
    ok = F.col(value).isNotNull()
    g = history.groupBy(*keys).agg(
        F.max_by(F.when(ok, F.col(value)), F.when(ok, F.col(pos))).alias(f"last_{value}"),
        F.max(F.when(ok, F.col(pos))).alias(f"last_{value}_pos"))
    return g.where(F.col(f"last_{value}_pos").isNotNull())


def last_row(history: DataFrame, pos: str = "pos", n: int = 1) -> DataFrame:
    """Final ``n`` rows of the log (``tail``) — distributed top-k."""
    return history.orderBy(F.col(pos).desc()).limit(n)


def best_trial(trials: DataFrame) -> DataFrame:
    """Trial with the smallest value; failed trials (NULL) count as +inf;
    the lowest trial number wins ties."""
    v = F.coalesce(F.col("value"), F.lit(float("inf")))
    cols = [c for c in trials.columns]
    return trials.agg(F.min_by(F.struct(*cols), F.struct(v.alias("v"), F.col("number"))).alias("t")).select("t.*")


def study_results(trials: DataFrame) -> DataFrame:
    """All trials with the best one marked — the study document as a table
    (one row per trial, written with ``write_json_lines``); no single-row
    collection of all trials."""
    v = F.coalesce(F.col("value"), F.lit(float("inf")))
    # Scalar subquery: the winner's number is computed once and inlined.
    best_no = best_trial(trials).select("number").scalar()
    return (trials.withColumn("value", v)
                  .withColumn("best_number", best_no)
                  .withColumn("is_best", F.col("number") == F.col("best_number")))


def merged_params(defaults: dict[str, str], params: F.Column) -> F.Column:
    """``{**defaults, **params}`` as a map: the row's own entries win; a NULL map
    has none."""
    own = F.coalesce(params, F.create_map().cast("map<string,string>"))
    base = F.create_map(*[F.lit(x) for kv in sorted(defaults.items()) for x in kv]).cast("map<string,string>")
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(own, k)), own)


def params_text(params: F.Column) -> F.Column:
    """A map as ``key=value`` pairs in the order of the keys."""
    pairs = F.array_sort(F.map_entries(params))
    return F.array_join(F.transform(pairs, lambda e: F.concat_ws("=", e["key"], F.coalesce(e["value"], F.lit("")))), ",")


STUDY_PART_TRIALS = 1000


def study_document(trials: DataFrame, defaults: dict[str, str] | None = None,
                   part_trials: int = STUDY_PART_TRIALS) -> DataFrame:
    """The study document: ``best_trial`` and ``all_trials`` (number, value, params,
    run id each), every trial's ``params`` laid over ``defaults``.

    The trials stand in parts of at most ``part_trials`` by their number (which is
    unique and dense), one row per part with the best trial beside it, so that no
    row holds a study of any size. A failed trial's value is infinite; the lowest
    number wins ties, as in :func:`best_trial`.
    """
    t = trials.withColumn("params", merged_params(defaults or {}, F.col("params")))
    t = t.withColumn("value", F.coalesce(F.col("value"), F.lit(float("inf"))))
    trial = F.struct("number", "value", "params", "wandb_run_id")
    best = best_trial(t.select("number", "value", "params", "wandb_run_id"))
    best_row = best.select(F.struct("number", "value", F.map_entries("params").alias("params"), "wandb_run_id").alias("b")).scalar()
    parts = t.groupBy(F.floor(F.col("number") / part_trials).cast("long").alias("part")).agg(
        F.collect_list(trial).alias("_t"))
    ordered = F.array_sort("_t", lambda a, b: (a["number"] - b["number"]).cast("int"))
    parts = parts.select("part", ordered.alias("all_trials"), best_row.alias("_b"))
    return parts.select("part", F.struct(
        F.col("_b.number").alias("number"), F.col("_b.value").alias("value"),
        F.map_from_entries("_b.params").alias("params"), F.col("_b.wandb_run_id").alias("wandb_run_id")).alias("best_trial"),
        "all_trials")
