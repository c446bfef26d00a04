"""Preference scoring over tables of model log-probabilities.

Inputs are tables a model produced — token log-probs ``(seq, pos, label,
logp)``, per-sequence scores ``(sample, model, side, logp)`` or logit rows.
All maths is column arithmetic and grouped aggregation; nothing leaves the
JVM. Vocabulary-wide logits belong in long form, not in arrays; the array
helpers are for small vectors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from dialectic.functions.mathx import (array_argmax, array_logsumexp, array_softmax,
                                       nan_to_zero, neg_log_sigmoid, safe_div)

# --- fixed values ------------------------------------------------------------
IGNORE_INDEX = -100     # masked label (padding / prompt tokens)
DEFAULT_BETA = 0.1
BETA_GRID = [0.10, 0.15, 0.20, 0.25]
FLOAT_MAX = 3.4028234663852886e38  # largest 32-bit float
# -----------------------------------------------------------------------------

SIDES = ("chosen", "rejected")
MODELS = ("policy", "reference")


def shift_labels(tokens: DataFrame, seq: str | list[str] = "seq_id", pos: str = "pos",
                 label: str = "label") -> DataFrame:
    """Align next-token labels: the row at ``pos`` gets the label of ``pos+1``
    (the last position of a sequence gets the mask). Window per sequence, so
    each group is one sequence long."""
    w = Window.partitionBy(*([seq] if isinstance(seq, str) else seq)).orderBy(pos)
    return tokens.withColumn(label, F.coalesce(F.lead(label).over(w), F.lit(IGNORE_INDEX)))


def sequence_logp(tokens: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per-sequence sum of token log-probs over unmasked labels, and the
    token count. A fully masked sequence sums to 0.0 with 0 tokens."""
    keys = keys or ["seq_id"]
    live = F.col("label") != IGNORE_INDEX
    return tokens.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(live, F.col("logp"))), F.lit(0.0)).alias("logp_sum"),
        F.count(F.when(live, F.lit(1))).alias("n_tokens"))


def ipo_logp(seq_logps: DataFrame) -> DataFrame:
    """Length-normalised log-prob (``logp_sum / n_tokens``); NULL with no tokens."""
    return seq_logps.withColumn("logp_avg", safe_div("logp_sum", "n_tokens"))


def perplexity(tokens: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Token micro-averaged perplexity per group: ``exp(-sum(logp)/count)``
    over unmasked tokens; 0.0 when the group has no token (NaN -> 0)."""
    keys = keys or ["seq_id"]
    live = F.col("label") != IGNORE_INDEX
    g = tokens.groupBy(*keys).agg(F.sum(F.when(live, F.col("logp"))).alias("_s"),
                                  F.count(F.when(live, F.lit(1))).alias("n_tokens"))
    ppl = F.when(F.col("n_tokens") > 0, finite_exp(-F.col("_s") / F.col("n_tokens"))).otherwise(F.lit(0.0))
    return g.select(*keys, "n_tokens", ppl.alias("perplexity"))


def finite_exp(mean_nll: Column) -> Column:
    """``exp`` with NaN and NULL as 0 and overflow as the largest 32-bit float."""
    return F.least(nan_to_zero(F.exp(mean_nll)), F.lit(FLOAT_MAX))


def token_nll(logit_rows: DataFrame, logits: str = "logits", label: str = "label") -> DataFrame:
    """Cross-entropy of each logit row against its gold label:
    ``logsumexp(logits) - logits[label]``; masked labels give NULL."""
    gold = F.get(logits, F.col(label)).cast("double")
    nll = F.when(F.col(label) != IGNORE_INDEX, array_logsumexp(logits) - gold)
    return logit_rows.withColumn("nll", nll)


# Width of the bins that long logits are summed in: exp of a bin's width stays far
# inside the range of a double, and two bins apart nothing is left to add.
LOGIT_BIN = 512.0


def long_logits_summary(logits: DataFrame, keys: list[str] | None = None, token: str = "token",
                        value: str = "logit", label: str | None = None) -> DataFrame:
    """Per position of long logits ``(keys, token, logit)``: ``lse`` (log of the sum of
    exps), ``pred_id`` (the token of the greatest logit, the smallest of equal ones),
    ``n_tokens`` and, with a ``label`` column, ``gold`` (the label's logit).

    No position's vocabulary comes together anywhere: a task sums
    ``exp(x - 512 * bin)`` per bin of 512, which adds up over tasks, so a position is
    one or two rows per task before the shuffle. NULL logits are left out, minus
    infinity adds nothing (``lse`` is minus infinity if all are), NaN gives NaN.
    """
    keys = keys or ["seq_id", "pos"]
    x = F.col(value).cast("double")
    inf = F.lit(float("inf"))
    bins = F.when(x == -inf, F.lit(None)).when(F.isnan(x) | (x == inf), F.lit(0)).otherwise(F.floor(x / LOGIT_BIN)).cast("long")
    part = logits.where(x.isNotNull()).withColumn("_bin", bins).groupBy(*keys, "_bin").agg(
        F.sum(F.exp(x - F.coalesce(F.col("_bin"), F.lit(0)) * LOGIT_BIN)).alias("_sum"),
        F.max(F.struct(x.alias("x"), (-F.col(token)).alias("t"))).alias("_best"), F.count(F.lit(1)).alias("_n"),
        F.max(F.when(F.col(token) == F.col(label), x) if label else F.lit(None).cast("double")).alias("_gold"))
    g = part.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.when(F.col("_bin").isNotNull(), F.struct("_bin", "_sum"))), asc=False).alias("_bins"),
        F.max("_best").alias("_best"), F.sum("_n").alias("n_tokens"), F.max("_gold").alias("gold"))
    top, below = F.get("_bins", F.lit(0)), F.get("_bins", F.lit(1))
    rest = F.when(below["_bin"] == top["_bin"] - 1, below["_sum"] * math.exp(-LOGIT_BIN)).otherwise(0.0)
    lse = F.when(F.size("_bins") == 0, -inf).otherwise(top["_bin"] * LOGIT_BIN + F.log(top["_sum"] + rest))
    return g.select(*keys, lse.alias("lse"), (-F.col("_best.t")).cast("long").alias("pred_id"), "n_tokens",
                    *(["gold"] if label else []))


def long_token_nll(logits: DataFrame, keys: list[str] | None = None, token: str = "token", value: str = "logit",
                   label: str = "label") -> DataFrame:
    """:func:`token_nll` and argmax over vocabulary-wide long logits: one row per
    position with ``label``, ``nll`` (NULL where the label is masked or has no logit),
    ``pred_id`` and ``n_tokens``. ``label`` stands in every row of its position."""
    keys = keys or ["seq_id", "pos"]
    g = long_logits_summary(logits, [*keys, label], token, value, label)
    nll = F.when(F.col(label) != IGNORE_INDEX, F.col("lse") - F.col("gold"))
    return g.select(*keys, label, nll.alias("nll"), "pred_id", "n_tokens")


def long_softmax(logits: DataFrame, keys: list[str] | None = None, token: str = "token", value: str = "logit") -> DataFrame:
    """``(keys, token, prob)`` of long logits: every row meets its position's
    ``lse`` by an equi-join, so no array of the vocabulary is built."""
    keys = keys or ["seq_id", "pos"]
    lse = long_logits_summary(logits, keys, token, value).select(*keys, "lse")
    return logits.join(lse, keys).select(*keys, token, F.exp(F.col(value).cast("double") - F.col("lse")).alias("prob"))


def mean_nll(nll_rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Token-mean NLL (``CrossEntropyLoss(ignore_index=-100)``) per group."""
    keys = keys or []
    return nll_rows.groupBy(*keys).agg(F.avg("nll").alias("nll_loss"))


def side_metrics(tokens: DataFrame, keys: list[str] | None = None, sample: str = "sample_id") -> DataFrame:
    """One row per batch from ``(keys, sample, model, side, pos, label, logits)``.

    ``logits_<side>``: mean policy logit over all positions. ``perplexity_<model>_<side>``:
    exp of the token-mean NLL over the batch's unmasked next-token labels
    (:func:`finite_exp`; 0 without such a token). ``nll_loss``: that mean for
    the policy's chosen side, NULL without a token.
    """
    keys = keys or ["run_id", "type", "step"]
    t = token_nll(shift_labels(tokens, [*keys, sample, "model", "side"]))
    t = t.withColumn("_sum", F.aggregate("logits", F.lit(0.0), lambda acc, v: acc + v))

    def only(model: str, side: str, col: Column) -> Column:
        return F.when((F.col("model") == model) & (F.col("side") == side), col)

    aggs = [(F.sum(only("policy", s, F.col("_sum"))) / F.sum(only("policy", s, F.size("logits")))).alias(f"logits_{s}")
            for s in SIDES]
    aggs += [F.avg(only(m, s, F.col("nll"))).alias(f"_{m}_{s}") for m in MODELS for s in SIDES]
    ppl = [finite_exp(F.col(f"_{m}_{s}")).alias(f"perplexity_{m}_{s}") for m in MODELS for s in SIDES]
    return t.groupBy(*keys).agg(*aggs).select(
        *keys, *[f"logits_{s}" for s in SIDES], *ppl, F.col("_policy_chosen").alias("nll_loss"))


def predicted_texts(tokens: DataFrame, vocab: DataFrame, sample: str = "sample_id") -> DataFrame:
    """One row per sample: the text of the most likely token at every position
    but the last, per model and side (``<model>_<side>_pred_text``)."""
    seq = F.struct(sample, "model", "side")
    w = Window.partitionBy(sample, "model", "side").orderBy("pos")
    ids = (argmax_tokens(tokens.withColumn("_more", F.lead("pos").over(w).isNotNull()).where("_more"))
           .select(seq.alias("seq_id"), "pos", F.col("pred_id").alias("token_id")))
    text = decode_tokens(ids, vocab).select("seq_id.*", "text")
    return text.groupBy(sample).agg(*[
        F.max(F.when((F.col("model") == m) & (F.col("side") == s), F.col("text"))).alias(f"{m}_{s}_pred_text")
        for m in MODELS for s in SIDES])


def softmax_rows(logit_rows: DataFrame, logits: str = "logits") -> DataFrame:
    """Probability array per row."""
    return logit_rows.withColumn("probs", array_softmax(logits))


def argmax_tokens(logit_rows: DataFrame, logits: str = "logits") -> DataFrame:
    """Predicted token id per row (first maximum)."""
    return logit_rows.withColumn("pred_id", array_argmax(logits))


def decode_tokens(token_ids: DataFrame, vocab: DataFrame, seq: str = "seq_id", pos: str = "pos",
                  token: str = "token_id", vocab_max_rows: int = 1 << 20) -> DataFrame:
    """Token ids -> text per sequence via a vocabulary table.

    The vocabulary is broadcast only after its row count is checked against
    ``vocab_max_rows``; a larger table is joined by shuffle. Pieces are
    concatenated in position order; unknown ids contribute nothing; a
    sequence with no known token decodes to ''.
    """
    v = vocab.select(F.col("token_id").alias(token), "piece")
    if v.limit(vocab_max_rows + 1).count() <= vocab_max_rows:
        v = F.broadcast(v)
    j = token_ids.select(seq, pos, token).join(v, token, "left")
    g = j.groupBy(seq).agg(F.sort_array(F.collect_list(
        F.when(F.col("piece").isNotNull(), F.struct(F.col(pos).alias("p"), F.col("piece").alias("s"))))).alias("_a"))
    return g.select(seq, F.array_join(F.transform("_a", lambda x: x["s"]), "").alias("text"))


def pair_table(scores: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Long ``(keys, model, side, logp)`` -> one row per sample with the four
    log-probs, by a conditional pivot (one aggregation, partial map-side)."""
    keys = keys or ["sample_id", "run_id", "type", "step"]
    aggs = []
    for m in MODELS:
        for s in SIDES:
            cond = (F.col("model") == m) & (F.col("side") == s)
            aggs.append(F.max(F.when(cond, F.col("logp"))).alias(f"{m}_{s}_logps"))
    return scores.groupBy(*keys).agg(*aggs)


def attach_ref_scores(policy: DataFrame, reference: DataFrame,
                      keys: list[str] | None = None) -> DataFrame:
    """Attach precomputed reference scores to policy rows by key (never by
    position). Rows without a reference score keep NULL."""
    keys = keys or ["sample_id", "side"]
    r = reference.select(*keys, F.col("logp").alias("reference_logp"))
    return policy.withColumnRenamed("logp", "policy_logp").join(r, keys, "left")


def reference_scores(scores: DataFrame, tokens: DataFrame, vocab: DataFrame, sample: str = "sample_id") -> DataFrame:
    """One row per sample with the reference model's six columns: for each side
    the log-prob, the perplexity of the sample's unmasked next-token labels
    (:func:`finite_exp`; every sample is a batch of its own) and the text of
    its most likely tokens. What a sample lacks is NULL (a perplexity: 0 if it
    has tokens on the other side only).
    """
    ref = F.col("model") == "reference"

    def only(side: str, col: str) -> Column:
        return F.when(F.col("side") == side, F.col(col))

    logps = scores.where(ref).groupBy(sample).agg(
        *[F.max(only(s, "logp")).alias(f"reference_{s}_logps") for s in SIDES])
    tokens = tokens.where(ref)
    ppls = (token_nll(shift_labels(tokens, [sample, "side"])).groupBy(sample)
            .agg(*[F.avg(only(s, "nll")).alias(f"_{s}") for s in SIDES])
            .select(sample, *[finite_exp(F.col(f"_{s}")).alias(f"reference_{s}_ppls") for s in SIDES]))
    texts = predicted_texts(tokens, vocab, sample).select(
        sample, *[F.col(f"reference_{s}_pred_text").alias(f"reference_{s}_predictions_texts") for s in SIDES])
    return logps.join(ppls, sample, "full").join(texts, sample, "full")


def dpo_rewards(pairs: DataFrame, beta: float = DEFAULT_BETA) -> DataFrame:
    """Implicit rewards ``beta * (policy - reference)`` per side."""
    b = F.lit(float(beta))
    return (pairs
            .withColumn("chosen_reward", b * (F.col("policy_chosen_logps") - F.col("reference_chosen_logps")))
            .withColumn("rejected_reward", b * (F.col("policy_rejected_logps") - F.col("reference_rejected_logps"))))


def dpo_loss(pairs: DataFrame, beta: float = DEFAULT_BETA) -> DataFrame:
    """Sigmoid DPO loss ``-log sigmoid(chosen_reward - rejected_reward)``
    (stable softplus form) with rewards and the accuracy flag."""
    r = dpo_rewards(pairs, beta)
    margin = F.col("chosen_reward") - F.col("rejected_reward")
    return (r.withColumn("loss", neg_log_sigmoid(margin))
             .withColumn("reward_correct", F.col("chosen_reward") > F.col("rejected_reward")))


def rpo_loss(scored: DataFrame, batch_nll: DataFrame, alpha: float | None,
             keys: list[str] | None = None) -> DataFrame:
    """RPO: ``loss + alpha * nll`` where ``nll`` is one value per batch;
    with ``alpha`` None the loss is unchanged."""
    keys = keys or ["run_id", "type", "step"]
    if alpha is None:
        return scored.withColumn("rpo_loss", F.col("loss"))
    j = scored.join(batch_nll.select(*keys, "nll_loss"), keys, "left")
    return j.withColumn("rpo_loss", F.col("loss") + F.lit(float(alpha)) * F.col("nll_loss"))


def batch_loss(scored: DataFrame, keys: list[str] | None = None, loss: str = "loss",
               aux: str | None = None, aux_coef: float = 0.0) -> DataFrame:
    """Batch objective ``mean(loss) + coef * aux`` (aux = one value per batch)."""
    keys = keys or ["run_id", "type", "step"]
    aggs = [F.avg(loss).alias("batch_loss")]
    if aux:
        aggs.append(F.max(aux).alias("_aux"))
    g = scored.groupBy(*keys).agg(*aggs)
    if aux:
        g = g.withColumn("batch_loss", F.col("batch_loss") + F.lit(float(aux_coef)) * F.col("_aux")).drop("_aux")
    return g
