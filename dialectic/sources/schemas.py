"""Declared schemas (production reads never infer)."""

from pyspark.sql import types as T

S, L, D, B, I = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.IntegerType()


def _struct(*fields):
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


COMMENTS = _struct(
    ("author", S), ("author_created_utc", L), ("body", S), ("controversiality", I),
    ("created_utc", L), ("id", S), ("link_id", S), ("parent_id", S), ("permalink", S),
    ("retrieved_on", L), ("score", I), ("downs", I), ("ups", I),
)

SUBMISSIONS = _struct(("id", S), ("author", S), ("title", S), ("selftext", S))

OP_COMMENTS = _struct(
    ("comments_id", S), ("submission_id", S), ("submission_author", S),
    ("submission_title", S), ("submission_body", S),
)

THREAD_COMMENT = _struct(
    ("comment_id", S), ("comment_author", S), ("comment_body", S),
    ("comment_parent_id", S), ("comment_link_id", S), ("comment_created_utc", L),
)

THREAD = _struct(
    ("submission_id", S), ("submission_author", S), ("submission_title", S),
    ("submission_body", S), ("comments_thread_root_comment_id", S),
    ("comments_thread_leaf_comment_id", S), ("comments_thread_is_delta", B),
    ("comments_thread", T.ArrayType(THREAD_COMMENT)),
)

PREFERENCE_JSON = _struct(("prompt", S), ("chosen", S), ("rejected", S))
PREFERENCE = _struct(("row_id", L), ("prompt", S), ("chosen", S), ("rejected", S))

SAMPLE_LOG = _struct(
    ("run_id", S), ("type", S), ("epoch", D), ("step", L), ("prompt", S), ("loss", D),
    ("chosen_reward", D), ("rejected_reward", D), ("policy_logps_chosen", D),
    ("policy_logps_rejected", D), ("chosen", S), ("rejected", S),
    ("policy_chosen_pred_text", S), ("reference_chosen_pred_text", S),
    ("policy_rejected_pred_text", S), ("reference_rejected_pred_text", S),
)

GEN_SAMPLE = _struct(
    ("run_id", S), ("eval_sample_index", L), ("epoch", D), ("prompt", S),
    ("generated_text", S), ("chosen", S), ("rejected", S),
)

GEN_OUTPUT = _struct(
    ("wandb_run_name", S), ("wandb_run_id", S), ("checkpoint_model_path", S),
    ("checkpoint_epoch", S), ("dataset_to_gen_txt", S), ("sample_index", L),
    ("prompt", S), ("generated_text", S), ("chosen", S), ("rejected", S),
)

TOKEN_SCORES = _struct(("seq_id", L), ("pos", L), ("label", I), ("logp", D))

PAIR_SCORES = _struct(
    ("sample_id", L), ("run_id", S), ("type", S), ("step", L), ("model", S),
    ("side", S), ("logp", D),
)

HISTORY = _struct(("run_id", S), ("pos", L), ("loss", D), ("eval_loss", D))

TRIALS = T.StructType([
    T.StructField("number", L, True), T.StructField("value", D, True),
    T.StructField("params", T.MapType(S, S), True), T.StructField("wandb_run_id", S, True),
])
