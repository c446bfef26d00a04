"""Views that map the driver's generic tables onto the engine's input schemas.

The reference ships no data; these adapters derive forum, preference, score,
history and trial tables from ``conversations``, ``documents``,
``embeddings`` and ``events`` so every catalogue query reads the given
tables and grows with them. The same views are written as SQL in
:mod:`dialectic.plans.oracle_views` for the DuckDB check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# Fixed token vocabulary used with f_token_scores (ids 0..9).
VOCAB = [(0, "a"), (1, "b"), (2, "c"), (3, "d"), (4, "e"),
         (5, "f"), (6, "g"), (7, "h"), (8, "i"), (9, "j")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def f_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.where(F.col("turn") == 0).select(
        F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("id"),
        F.col("role").alias("author"),
        F.concat(F.lit("title "), F.col("conv_id").cast("string")).alias("title"),
        F.col("text").alias("selftext"),
    )


def f_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    conv = F.col("conv_id").cast("string")
    parent_turn = F.floor(F.col("turn") / 2).cast("long").cast("string")
    return c.where(F.col("turn") > 0).select(
        F.col("role").alias("author"),
        F.col("text").alias("body"),
        (F.lit(1700000000) + F.col("conv_id") * 1000 + F.col("turn") * 60).cast("long").alias("created_utc"),
        F.concat(F.lit("c"), conv, F.lit("_"), F.col("turn").cast("string")).alias("id"),
        F.concat(F.lit("t3_s"), conv).alias("link_id"),
        F.when(F.col("turn") == 1, F.concat(F.lit("t3_s"), conv))
         .otherwise(F.concat(F.lit("t1_c"), conv, F.lit("_"), parent_turn)).alias("parent_id"),
    )


def f_faulty_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``f_comments`` where every seventh conversation lost its bodies and every
    eleventh has a first comment that names its own reply as its parent."""
    c = f_comments(spark, sf_dir)
    conv = F.regexp_extract("id", "^c([0-9]+)_", 1).cast("long")
    first = F.col("id").endswith("_1")
    return c.select(
        "author", F.when(conv % 7 != 3, F.col("body")).alias("body"), "created_utc", "id", "link_id",
        F.when(first & (conv % 11 == 5), F.concat(F.lit("t1_c"), conv.cast("string"), F.lit("_2")))
         .otherwise(F.col("parent_id")).alias("parent_id"))


def f_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One preference row per document: prompt = ``source/lang``, chosen = the
    document, rejected = the next document by id (NULL for the last)."""
    d = table(spark, sf_dir, "documents")
    nxt = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("rejected"))
    return d.join(nxt, "doc_id", "left").select(
        F.col("doc_id").alias("row_id"),
        F.concat(F.col("source"), F.lit("/"), F.col("lang")).alias("prompt"),
        F.col("text").alias("chosen"),
        F.col("rejected"),
    )


def f_pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    sample = F.floor(F.col("vec_id") / 4).cast("long")
    return e.select(
        sample.alias("sample_id"),
        F.concat(F.lit("run"), (sample % 3).cast("string")).alias("run_id"),
        F.when(sample % 5 == 0, F.lit("eval")).otherwise(F.lit("train")).alias("type"),
        F.floor(F.col("vec_id") / 32).cast("long").alias("step"),
        F.when(F.col("vec_id") % 4 < 2, F.lit("policy")).otherwise(F.lit("reference")).alias("model"),
        F.when(F.col("vec_id") % 2 == 0, F.lit("chosen")).otherwise(F.lit("rejected")).alias("side"),
        (F.col("embedding")[0].cast("double") * 10 - 20).alias("logp"),
    )


def f_token_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    gold = F.col("embedding")[F.col("label")].cast("double")
    sumexp = F.aggregate(F.transform("embedding", lambda x: F.exp(x.cast("double"))),
                         F.lit(0.0), lambda p, x: p + x)
    return e.select(
        F.floor(F.col("vec_id") / 10).cast("long").alias("seq_id"),
        (F.col("vec_id") % 10).cast("long").alias("pos"),
        F.when(F.col("label") == 0, F.lit(-100)).otherwise(F.col("label")).cast("int").alias("label"),
        (gold - F.log(sumexp)).alias("logp"),
    )


def f_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logit rows: each 64-dim embedding is one position's logits, ``label``
    the gold token id."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("embedding").alias("logits"), "label")


def f_side_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight positions of eight logits for every (sample, model, side) of
    ``f_pair_scores``; every fifth label is masked."""
    e = table(spark, sf_dir, "embeddings")
    sample = F.floor(F.col("vec_id") / 4).cast("long")
    cut = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda p: F.slice("embedding", p * 8 + 1, 8))
    rows = e.select(
        "vec_id", F.col("label").alias("base"), sample.alias("sample_id"),
        F.concat(F.lit("run"), (sample % 3).cast("string")).alias("run_id"),
        F.when(sample % 5 == 0, F.lit("eval")).otherwise(F.lit("train")).alias("type"),
        F.floor(F.col("vec_id") / 32).cast("long").alias("step"),
        F.when(F.col("vec_id") % 4 < 2, F.lit("policy")).otherwise(F.lit("reference")).alias("model"),
        F.when(F.col("vec_id") % 2 == 0, F.lit("chosen")).otherwise(F.lit("rejected")).alias("side"),
        F.posexplode(cut).alias("pos", "logits"))
    label = F.when((F.col("vec_id") + F.col("pos")) % 5 == 0, F.lit(-100)).otherwise(
        (F.col("base") + F.col("pos")) % 8).cast("int").alias("label")
    return rows.select("sample_id", "run_id", "type", "step", "model", "side", "pos", label,
                       F.col("logits").cast("array<double>").alias("logits"))


def f_vocab(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(VOCAB, "token_id int, piece string")


def f_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.concat(F.lit("run"), F.col("user_id").cast("string")).alias("run_id"),
        F.col("event_id").alias("pos"),
        F.when(F.col("event_type") == "click", F.col("value")).alias("loss"),
        F.when(F.col("event_type") == "view", F.col("value")).alias("eval_loss"),
    )


def f_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").where(F.col("event_type") == "view")
    t = ev.groupBy("user_id").agg(F.max_by("value", "event_id").alias("v"))
    return t.select(
        F.col("user_id").alias("number"),
        F.when(F.col("user_id") % 17 == 0, F.lit(None).cast("double")).otherwise(F.col("v")).alias("value"),
        F.concat(F.lit("run"), F.col("user_id").cast("string")).alias("wandb_run_id"),
    )


def f_trials_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``f_trials`` with each trial's own hyper-parameters (every fifth has none)."""
    n = F.col("number")
    own = F.when(n % 5 != 0, F.create_map(
        F.lit("beta"), F.format_string("0.%d", n % 4 + 1), F.lit("batch"), (n % 3 + 1).cast("string")))
    return f_trials(spark, sf_dir).withColumn("params", own)


def f_long_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per position and token; some logits far outside the range of exp."""
    e = table(spark, sf_dir, "embeddings")
    rows = e.select(F.floor(F.col("vec_id") / 10).cast("long").alias("seq_id"), (F.col("vec_id") % 10).cast("long").alias("pos"),
                    F.when(F.col("vec_id") % 6 == 0, F.lit(-100)).otherwise(F.col("label")).cast("int").alias("label"),
                    F.posexplode("embedding").alias("token", "_x"))
    return rows.select("seq_id", "pos", "label", "token",
                       (F.col("_x").cast("double") + F.when(F.col("pos") == 3, F.lit(2000.0)).otherwise(0.0)).alias("logit"))


def f_labeled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their quality label: the persuasive (1) / not (0)
    pool for preference pairing; prompt = ``source/lang``."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return d.join(lab, "doc_id").select(
        "doc_id", F.concat(F.col("source"), F.lit("/"), F.col("lang")).alias("prompt"),
        "text", F.col("quality").cast("int").alias("quality"))

