"""Preference datasets: grouping, leak-free splits, templates, dedup, pairing.

Rows carry an explicit ``row_id`` (file order); every "order" of the
original (first appearance, positions, enumerate) is an order by ``row_id``
or by a seeded hash, computed with the bucketed helpers in
:mod:`dialectic.functions.ordering` — never a one-partition window.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from dialectic.functions.ordering import hash_order_index, int_order_index, md5_int32, order_index, rows_at
from dialectic.functions.text import (DEFAULT_INSTRUCTION_PREFIX, DEFAULT_TEMPLATE_PREFIX,
                                      DEFAULT_TEMPLATE_SUFFIX, instruction_text, template)

# --- fixed values ------------------------------------------------------------
DEFAULT_SEED = 42
# Group split: fraction of prompt groups for train and validation; the rest is test.
GROUP_SPLIT_RATIOS = (0.6, 0.2)
# Row split: test fraction of all rows, then validation fraction of the rest.
ROW_SPLIT_FRACTIONS = (0.2, 0.25)
# Default positions picked for sample generation.
DEFAULT_PICK_POSITIONS = [15]
# -----------------------------------------------------------------------------


def prompt_groups(prefs: DataFrame) -> DataFrame:
    """One row per distinct prompt: first row id, size, and the group's
    position in first-appearance order. Member rows stay in ``prefs``
    (never collected into a list); a hot prompt is pre-aggregated map-side."""
    g = prefs.groupBy("prompt").agg(F.min("row_id").alias("first_row_id"),
                                    F.count(F.lit(1)).alias("n_rows"))
    return int_order_index(g, "first_row_id", out="group_index")


def group_split(prefs: DataFrame, seed: int = DEFAULT_SEED,
                ratios: tuple[float, float] = GROUP_SPLIT_RATIOS) -> DataFrame:
    """Leak-free split: every row of a prompt lands in the same split.

    Distinct prompts are ranked by ``md5("<seed>|<prompt>")`` (seeded,
    reproducible, independent of input order); with G prompts the first
    ``int(0.6*G)`` go to train, the next ``int(0.2*G)`` to validation, the
    rest to test (double arithmetic, truncation, like ``int(0.6 * G)``).
    ``split_rank`` keeps the prompt's rank: a split's rows are in the order
    ``(split_rank, row_id)``, in which positions count.
    """
    train_r, val_r = ratios
    keys = prefs.select("prompt").distinct()
    keyed = keys.withColumn("_k", F.coalesce(F.col("prompt"), F.lit("")))
    ranked = hash_order_index(keyed, F.col("_k"), seed, out="_rank", total="_g",
                              tiebreak=[F.col("_k"), F.col("prompt").isNull()])
    n_train = F.floor(F.lit(float(train_r)) * F.col("_g"))
    n_val = F.floor(F.lit(float(val_r)) * F.col("_g"))
    split = (F.when(F.col("_rank") < n_train, F.lit("train"))
              .when(F.col("_rank") < n_train + n_val, F.lit("validation"))
              .otherwise(F.lit("test")))
    ks = ranked.select(F.col("prompt").alias("_p"), split.alias("split"), F.col("_rank").alias("split_rank"))
    out = prefs.join(ks, prefs["prompt"].eqNullSafe(ks["_p"]), "inner").drop("_p")
    return out


def split_counts(split_df: DataFrame) -> DataFrame:
    """Rows and prompts per split (the audit the original printed)."""
    return split_df.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct("prompt").alias("n_prompts"))


def split_leak_check(split_df: DataFrame) -> DataFrame:
    """One row: number of prompts and number of prompts found in more than
    one split (must be 0 for a leak-free split)."""
    per = split_df.groupBy("prompt").agg(F.countDistinct("split").alias("_n"))
    return per.agg(F.count(F.lit(1)).alias("n_prompts"),
                   F.coalesce(F.sum((F.col("_n") > 1).cast("long")), F.lit(0)).alias("n_leaking_prompts"))


def select_split(split_df: DataFrame, name: str) -> DataFrame:
    """Rows of one split by name (a partition filter on a partitioned table)."""
    return split_df.where(F.col("split") == F.lit(name))


def row_split(prefs: DataFrame, seed: int = DEFAULT_SEED,
              fractions: tuple[float, float] = ROW_SPLIT_FRACTIONS) -> DataFrame:
    """Row-level 60/20/20 split in two steps (may leak prompts, as the
    original did): rows ranked by ``md5("<seed>|<row_id>")``; the first
    ``ceil(0.2*N)`` are test, the next ``ceil(0.25*(N - n_test))``
    validation, the rest train."""
    test_f, val_f = fractions
    ranked = hash_order_index(prefs.select("row_id"), F.col("row_id"), seed, out="_rank", total="_n")
    n_test = F.ceil(F.lit(float(test_f)) * F.col("_n"))
    n_val = F.ceil(F.lit(float(val_f)) * (F.col("_n") - n_test))
    split = (F.when(F.col("_rank") < n_test, F.lit("test"))
              .when(F.col("_rank") < n_test + n_val, F.lit("validation"))
              .otherwise(F.lit("train")))
    return prefs.join(ranked.select("row_id", split.alias("split")), "row_id")


def template_prompts(df: DataFrame, prefix: str = DEFAULT_TEMPLATE_PREFIX,
                     suffix: str = DEFAULT_TEMPLATE_SUFFIX) -> DataFrame:
    """``prompt := prefix + prompt + suffix`` on every row (all splits at once)."""
    return df.withColumn("prompt", template("prompt", prefix, suffix))


def instruction_format(df: DataFrame, prefix: str = DEFAULT_INSTRUCTION_PREFIX,
                       out: str = "text") -> DataFrame:
    """Instruction-tuning text from prompt and chosen."""
    return df.withColumn(out, instruction_text("prompt", "chosen", prefix))


# Named preprocessing functions, looked up by name. Unknown names fail loudly.
PREPROCESSORS: dict[str, Callable[..., DataFrame]] = {
    "template_edit_dataset": template_prompts,
    "instruction_format": instruction_format,
}


def preprocess(df: DataFrame, name: str | None, **kwargs) -> DataFrame:
    """Apply a registered preprocessing function by name (``None`` = skip)."""
    if not name:
        return df
    if name not in PREPROCESSORS:
        raise KeyError(f"unknown preprocessing function {name!r}; known: {sorted(PREPROCESSORS)}")
    return df.transform(lambda d: PREPROCESSORS[name](d, **kwargs))


def _order(df: DataFrame) -> list[str]:
    """Row order of a dataset: a split lists its rows by the shuffled rank of
    their prompt, then ``row_id``; any other dataset by ``row_id``."""
    return ["split_rank", "row_id"] if "split_rank" in df.columns else ["row_id"]


def with_positions(df: DataFrame, out: str = "pos") -> DataFrame:
    """Dense 0-based position in the dataset's row order (``enumerate``):
    numbered on the slim order columns, then joined back by ``row_id``."""
    keys = _order(df)
    numbered = order_index(df.select(*keys), keys, out=out).select("row_id", out)
    return numbered if df.columns == ["row_id"] else df.join(numbered, "row_id")


def dedup_prompts(df: DataFrame, out: str = "sample_index") -> DataFrame:
    """Keep the first row (in row order) of every prompt, renumbered 0..n-1.

    The winner is found by ``min`` per prompt (reduced map-side, so
    a hot prompt costs one row per task), then the full rows are kept by a
    join on the unique ``row_id``; numbering runs on the slim winners only,
    so long texts cross one shuffle at most.
    """
    keys = _order(df)
    cols = [c for c in df.columns if c not in ("row_id", "prompt")]
    firsts = df.groupBy("prompt").agg(F.min(F.struct(*keys)).alias("f")).select("f.*")
    numbered = order_index(firsts, keys, out=out).select("row_id", out)
    return df.join(numbered, "row_id").select(out, "row_id", "prompt", *cols)


def pick_positions(df: DataFrame, positions: list[int] | None = DEFAULT_PICK_POSITIONS,
                   pos_col: str = "pos") -> DataFrame:
    """Rows at the given positions, or every row when ``positions`` is None
    (the "all" mode wins over a subset). As in list indexing, negative
    positions count from the end, a repeated position gives its row again and
    one past an end raises ``IndexError``. Rows are selected by slim keys, without
    numbering the dataset; full rows are only joined to the picked ones."""
    if positions is None:
        return df if pos_col in df.columns else with_positions(df, pos_col)
    if pos_col not in df.columns:
        keys = _order(df)
        picked = rows_at(df.select(*keys), keys, positions, pos_col).select("row_id", pos_col)
        return df.join(picked, "row_id")
    n = df.count()
    missing = sorted({p for p in positions if not -n <= p < n})
    if missing:
        raise IndexError(f"positions out of range: {missing}")
    wanted = F.array(*[F.lit(p % n).cast("long") for p in positions]).cast("array<bigint>")
    again = F.filter(wanted, lambda w: w == F.col(pos_col))
    picked = df.select("row_id", pos_col).where(F.array_contains(wanted, F.col(pos_col))).select(
        "row_id", F.explode(again).alias(pos_col))
    return df.drop(pos_col).join(picked, "row_id")


def check_positions(df: DataFrame, positions: list[int], pos_col: str = "pos") -> None:
    """Raise when a requested position does not exist (list-index semantics)."""
    found = {r[0] for r in df.where(F.col(pos_col).isin(positions)).select(pos_col).collect()}
    missing = sorted(set(positions) - found)
    if missing:
        raise IndexError(f"positions out of range: {missing}")


def head_n(df: DataFrame, n: int, pos_col: str = "pos") -> DataFrame:
    """First ``n`` rows in row order (clamps when ``n`` exceeds the size): a
    distributed top-k over slim keys, of which the ``n`` rows are numbered."""
    if pos_col in df.columns:
        return df.where(F.col(pos_col) < n)
    keys = _order(df)
    first = df.select(*keys).orderBy(*keys).limit(n)
    numbered = first.withColumn(pos_col, (F.row_number().over(Window.orderBy(*keys)) - 1).cast("long"))
    return df.join(numbered.select("row_id", pos_col), "row_id")


def stack_sides(df: DataFrame, keys: tuple[str, ...] = ("row_id", "prompt")) -> DataFrame:
    """Chosen and rejected as one long frame ``(keys, side, text)`` so both
    sides are processed by one pass; NULL texts are kept."""
    return df.unpivot(list(keys), ["chosen", "rejected"], "side", "text")


def unstack_sides(long: DataFrame, keys: tuple[str, ...], value: str) -> DataFrame:
    """Back from ``(keys, side, value)`` to ``chosen_<value>``/``rejected_<value>``."""
    return long.groupBy(*keys).agg(
        F.max(F.when(F.col("side") == "chosen", F.col(value))).alias(f"chosen_{value}"),
        F.max(F.when(F.col("side") == "rejected", F.col(value))).alias(f"rejected_{value}"))


def preference_pairs(labeled: DataFrame, seed: int = DEFAULT_SEED) -> DataFrame:
    """Pair each persuasive text (quality 1) with one non-persuasive text
    (quality 0) of the same prompt.

    Negatives of a prompt are numbered 0..n-1 by ``doc_id``; the positive
    ``d`` takes negative ``md5_32("<seed>|<d>") mod n``. An equi-join on
    ``(prompt, k)`` — no pairs are enumerated, and a hot prompt is numbered
    in buckets, not in one task. Prompts without negatives produce nothing.
    """
    neg_all = labeled.where(F.col("quality") == 0)
    neg = int_order_index(neg_all.select("prompt", "doc_id"), "doc_id", out="k", total="n_neg",
                          partition_cols=["prompt"])
    counts = neg_all.groupBy("prompt").agg(F.count(F.lit(1)).alias("n_neg"))
    pos = labeled.where(F.col("quality") == 1).select("prompt", "doc_id", "text")
    pos = pos.join(counts, "prompt").withColumn(
        "k", F.pmod(md5_int32(F.concat(F.lit(f"{seed}|"), F.col("doc_id").cast("string"))),
                    F.col("n_neg")))
    n = neg.select("prompt", "k", F.col("doc_id").alias("rejected_id"))
    texts = neg_all.select(F.col("doc_id").alias("rejected_id"), F.col("text").alias("rejected"))
    return pos.join(n, ["prompt", "k"]).join(texts, "rejected_id").select(
        "prompt", F.col("doc_id").alias("chosen_id"), F.col("text").alias("chosen"),
        "rejected_id", "rejected")
