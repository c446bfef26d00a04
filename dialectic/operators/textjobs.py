"""Text batch jobs: token truncation, sequence packing, batch generation.

Tokenization defaults to whitespace runs (a built-in expression). Generation
is the one place Python runs per batch: ``mapInPandas`` with a pluggable
generator that is built once per partition.
"""

from __future__ import annotations

import sys
from typing import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from dialectic.functions.ordering import int_order_index
from dialectic.functions.text import whitespace_tokens, zero_pad2
from dialectic.sources.readers import read_csv
from dialectic.sources.sinks import append_log

# --- fixed values ------------------------------------------------------------
MAX_PROMPT_TOKENS = 1024
MAX_TOTAL_TOKENS = 1536
MAX_GEN_TOKENS = 1500
PACK_SEQ_LENGTH = 1024
# -----------------------------------------------------------------------------


def truncate_tokens(df: DataFrame, text: str = "text", max_tokens: int = MAX_PROMPT_TOKENS,
                    keep: str = "start", out: str = "text_truncated") -> DataFrame:
    """Token counts and the text cut to ``max_tokens`` whitespace tokens
    (``keep='start'`` keeps the head, ``'end'`` the tail). The whole text is
    tokenized; rows over the limit are flagged, not dropped."""
    toks = whitespace_tokens(text)
    n = F.size(toks)
    if keep == "start":
        kept = F.slice(toks, 1, max_tokens)
    else:
        kept = F.slice(toks, F.greatest(n - max_tokens + 1, F.lit(1)), max_tokens)
    return (df.withColumn("n_tokens", n.cast("long"))
              .withColumn("n_kept", F.least(n, F.lit(max_tokens)).cast("long"))
              .withColumn("truncated", n > max_tokens)
              .withColumn(out, F.array_join(kept, " ")))


def truncate_pair(prefs: DataFrame, max_prompt: int = MAX_PROMPT_TOKENS,
                  max_length: int = MAX_TOTAL_TOKENS) -> DataFrame:
    """Preference-row truncation: prompt to ``max_prompt`` tokens (keep the
    end, nearest the answer), then each answer to the remaining budget."""
    p = whitespace_tokens("prompt")
    n_p = F.size(p)
    kept_p = F.slice(p, F.greatest(n_p - max_prompt + 1, F.lit(1)), max_prompt)
    budget = F.lit(max_length) - F.least(n_p, F.lit(max_prompt))
    out = prefs.withColumn("prompt", F.array_join(kept_p, " "))
    for side in ("chosen", "rejected"):
        out = out.withColumn(side, F.array_join(F.slice(whitespace_tokens(side), 1, budget), " "))
    return out


def pack_sequences(docs: DataFrame, key: str = "doc_id", text: str = "text",
                   seq_length: int = PACK_SEQ_LENGTH, sep_tokens: int = 1) -> DataFrame:
    """Pack documents into fixed blocks of ``seq_length`` tokens.

    Documents are laid end to end in ``key`` order, each followed by a
    separator token; block ``b`` covers token offsets ``[b*S, (b+1)*S)``; the
    short tail block is dropped. Output: one row per (block, document)
    overlap with the offsets inside the block. The running offset is a
    bucketed prefix sum (no one-task window).
    """
    d = docs.select(key, (F.size(whitespace_tokens(text)) + sep_tokens).cast("long").alias("_span"))
    d = int_order_index(d, key, out="_start", total="_total", value=F.col("_span"))
    S = F.lit(seq_length).cast("long")
    d = d.withColumn("_end", F.col("_start") + F.col("_span"))
    blocks = d.withColumn("block_id", F.explode(F.sequence(
        F.floor(F.col("_start") / S).cast("long"), F.floor((F.col("_end") - 1) / S).cast("long"))))
    blocks = blocks.where(F.col("block_id") < F.floor(F.col("_total") / S))
    base = F.col("block_id") * S
    return blocks.select(
        "block_id", key,
        (F.greatest(F.col("_start"), base) - base).alias("from_offset"),
        (F.least(F.col("_end"), base + S) - base).alias("to_offset"))


# ---------------------------------------------------------------- generation
# A generator factory takes the kwargs dict and returns a function from a list of
# prompts (token lists) to the list of whole outputs, prompt included, as a
# language model's ``generate`` gives them. It is built once per partition (model
# load happens here in a real deployment).
GeneratorFactory = Callable[[dict], Callable[[list[list[str]]], list[list[str]]]]


def _cycle(kwargs: dict) -> Callable[[list[list[str]]], list[list[str]]]:
    """Deterministic stand-in model: goes on with the prompt's own tokens, over
    and over. ``max_new_tokens``, ``max_length`` (prompt included) and ``upper``
    ("true": new tokens in upper case) are its kwargs."""
    new = int(kwargs.get("max_new_tokens", MAX_GEN_TOKENS))
    longest = int(kwargs.get("max_length", MAX_TOTAL_TOKENS))
    upper = str(kwargs.get("upper", "false")).lower() == "true"

    def run(prompts: list[list[str]]) -> list[list[str]]:
        out = []
        for p in prompts:
            n = max(0, min(new, longest - len(p))) if p else 0
            more = [p[i % len(p)] for i in range(n)]
            out.append(p + ([t.upper() for t in more] if upper else more))
        return out

    return run


GENERATORS: dict[str, GeneratorFactory] = {"cycle": _cycle}


def register_generator(name: str, factory: GeneratorFactory) -> None:
    GENERATORS[name] = factory


def generate(df: DataFrame, generator: str = "cycle", kwargs: dict | None = None, prompt: str = "prompt",
             out: str = "generated_text", max_prompt_tokens: int = MAX_PROMPT_TOKENS) -> DataFrame:
    """Add ``out``: the generator's continuation of each prompt.

    A prompt is cut to its first ``max_prompt_tokens`` tokens before the model
    sees it, and what the model gives back is cut behind the prompt. Rows are
    sorted by prompt length within their task, so that the batches a model pads
    hold prompts of like length (``mapInPandas``, generator built once per
    partition). A NULL prompt gives NULL.
    """
    if generator not in GENERATORS:
        raise KeyError(f"unknown generator {generator!r}; known: {sorted(GENERATORS)}")
    factory = GENERATORS[generator]
    kw = dict(kwargs or {})
    # Ship this module's code with the task instead of requiring the package
    # to be installed on every executor.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    schema = StructType([*df.schema.fields, StructField(out, StringType(), True)])
    tokens = F.slice(whitespace_tokens(prompt), 1, max_prompt_tokens)
    ready = df.withColumn("_tokens", tokens).sortWithinPartitions(F.size("_tokens"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fn = factory(kw)
        for b in batches:
            cut = b.pop("_tokens")
            known = [i for i, t in enumerate(cut) if t is not None]
            prompts = [list(cut.iloc[i]) for i in known]
            res = [None] * len(b)
            for i, p, whole in zip(known, prompts, fn(prompts) if prompts else []):
                res[i] = " ".join(whole[len(p):])
            b[out] = pd.Series(res, dtype=object, index=b.index)
            yield b

    return ready.mapInPandas(run, schema)


def batch_generate(prefs: DataFrame, run_name: str, run_id: str, checkpoint_path: str,
                   checkpoint_epoch: int, split_name: str, generator: str = "cycle",
                   kwargs: dict | None = None, index_col: str = "sample_index",
                   max_prompt_tokens: int = MAX_PROMPT_TOKENS) -> DataFrame:
    """The 10-column generation output over a dataset with a position column.
    Missing ``chosen``/``rejected`` columns become ''; present NULLs stay NULL."""
    df = prefs
    for c in ("chosen", "rejected"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(""))
    g = generate(df.select(index_col, "prompt", "chosen", "rejected"), generator, kwargs, max_prompt_tokens=max_prompt_tokens)
    return g.select(
        F.lit(run_name).alias("wandb_run_name"), F.lit(run_id).alias("wandb_run_id"),
        F.lit(checkpoint_path).alias("checkpoint_model_path"),
        zero_pad2(F.lit(checkpoint_epoch)).alias("checkpoint_epoch"),
        F.lit(split_name).alias("dataset_to_gen_txt"),
        F.col(index_col).cast("long").alias("sample_index"),
        "prompt", "generated_text", "chosen", "rejected")


def generated_samples(rows: DataFrame, run_id: str, epoch: float, generator: str = "cycle",
                      kwargs: dict | None = None, index_col: str = "pos",
                      max_prompt_tokens: int = MAX_PROMPT_TOKENS) -> DataFrame:
    """The 7-column generated-sample log for picked evaluation rows."""
    df = rows
    for c in ("chosen", "rejected"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(""))
    g = generate(df.select(index_col, "prompt", "chosen", "rejected"), generator, kwargs, max_prompt_tokens=max_prompt_tokens)
    return g.select(
        F.lit(run_id).alias("run_id"), F.col(index_col).cast("long").alias("eval_sample_index"),
        F.lit(float(epoch)).alias("epoch"), "prompt", "generated_text", "chosen", "rejected")


def resume(rows: DataFrame, make: Callable[[DataFrame], DataFrame], log: str, row_key: str, log_key: str,
           same: dict[str, object] | None = None, fmt: str = "csv") -> DataFrame:
    """Generate what the log at ``log`` does not hold yet, append it, and return the log.

    ``make`` turns rows into log rows. A row is held if a log row with the values
    ``same`` (run, epoch, split, ...) has its ``row_key`` as ``log_key``; only the others
    are generated, so that a job that broke off goes on where its last committed
    append ended, and a second run over the same rows generates nothing.
    """
    spark = rows.sparkSession
    schema = make(rows.limit(0)).schema

    def read() -> DataFrame:
        return read_csv(spark, log, schema) if fmt == "csv" else spark.read.schema(schema).format(fmt).load(log)

    try:
        held = read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        held = None
    todo = rows
    if held is not None:
        for name, value in (same or {}).items():
            held = held.where(F.col(name).eqNullSafe(F.lit(value)))
        todo = rows.join(held.select(F.col(log_key).cast(rows.schema[row_key].dataType).alias("_held")).distinct(),
                         rows[row_key] == F.col("_held"), "left_anti")
    append_log(make(todo), log, partition_by=(), fmt=fmt)
    return read()
