"""Streams over files that come in any order, across restarts."""

import glob

from pyspark.sql import functions as F

from conftest import COMMENT_SCHEMA, comments_df, submissions_df
from dialectic.operators import threads as TH
from dialectic.operators.metrics import metric_rollup
from dialectic.operators.scoring import side_metrics
from dialectic.plans.streaming_query import finish
from dialectic.streaming import rollup as R
from dialectic.streaming import threads_stream as TS

SUBS = [("s1", "op", "t", "b"), ("s2", "op2", "t2", "b2")]


def _flat(df):
    return sorted((r.submission_id, r.comments_thread_leaf_comment_id, r.comments_thread_is_delta,
                   tuple(c.comment_id for c in r.comments_thread)) for r in df.collect())


def _deliver(spark, tmp_dir, files, symbols=("yes",)):
    src, out = f"{tmp_dir}/in", f"{tmp_dir}/out"
    seen, subs = [], submissions_df(spark, SUBS)
    for rows in files:
        comments_df(spark, rows).coalesce(1).write.mode("append").parquet(src)
        seen += rows
        finish(TS.run_thread_stream(spark, src, comments_df(spark, rows).schema, subs, out, f"{tmp_dir}/ck",
                                    delta_symbols=list(symbols), max_files_per_trigger=1))
        threads, held = TS.latest_threads(spark, out)
        want, quarantine = TH.build_threads(comments_df(spark, seen), subs, list(symbols))
        assert _flat(threads) == _flat(want)
        assert sorted((r.comments_id, r.reason) for r in held.collect()) == sorted(
            (r.comments_id, r.reason) for r in quarantine.collect())
    return out


def test_late_ancestors_replace_the_thread(spark, tmp_dir):
    """After every file the versions read back equal a batch build of all files."""
    a = ("op", "leaf yes", 30, "a", "t3_s1", "t1_m")
    files = [
        [a, ("op2", "other", 5, "z", "t3_s2", "t3_s2")],
        [("v", "middle", 20, "m", "t3_s1", "t1_r")],                       # the missing parent, itself incomplete
        [("v", "root", 10, "r", "t3_s1", "t3_s1"), ("op", "no", 40, "b", "t3_s1", "t1_a")],
        [("v", "root again", 10, "r", "t3_s1", "t3_s1")],                  # the same id delivered once more
        [("v", "x", 1, "s1", "t3_s2", "t1_s1x"), ("v", "y", 2, "s1x", "t3_s1", "t1_m")],  # now the chain goes round
        [("op2", None, 50, "n", "t3_s2", "t1_z")],
    ]
    out = _deliver(spark, tmp_dir, files)
    versions = spark.read.parquet(out).groupBy("batch").agg(F.collect_set("comments_id").alias("ids"))
    got = {r.batch: sorted(r.ids) for r in versions.collect()}
    assert got[0] == ["a", "z"] and got[1] == ["a"]  # z was not rebuilt by the second file


def test_empty_file_and_replay(spark, tmp_dir):
    rows = [("op", "yes", 30, "a", "t3_s1", "t1_m"), ("v", "middle", 20, "m", "t3_s1", "t3_s1")]
    subs = submissions_df(spark, SUBS)
    empty = spark.createDataFrame([], COMMENT_SCHEMA)
    for batch_id, batch in ((0, comments_df(spark, rows[:1])), (1, empty), (2, comments_df(spark, rows[1:])),
                            (2, comments_df(spark, rows[1:]))):
        TS.rebuild(spark, batch, batch_id, subs, f"{tmp_dir}/st", f"{tmp_dir}/o", ["yes"])
    assert _flat(TS.latest_threads(spark, f"{tmp_dir}/o")[0]) == [("s1", "a", True, ("m", "a"))]


def _logs(spark, run, steps, seed=0):
    samples = spark.createDataFrame(
        [(run, "eval" if s % 2 else "train", s, 1.0 + i, 0.5 * i + s, 0.3 * s, -1.0 * i, -2.0) for s in steps for i in range(3)],
        "run_id string, type string, step long, loss double, chosen_reward double, rejected_reward double, "
        "policy_chosen_logps double, policy_rejected_logps double")
    tokens = spark.createDataFrame(
        [(run, "eval" if s % 2 else "train", s, i, m, side, p, -100 if p == 2 else (p + i) % 3, [0.1 * p, 0.2 * s, 0.3 * i + seed])
         for s in steps for i in range(3) for m in ("policy", "reference") for side in ("chosen", "rejected") for p in range(4)],
        "run_id string, type string, step long, sample_id long, model string, side string, pos int, label int, logits array<double>")
    return samples, tokens


def _same(got, want):
    rows = lambda df: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r)
                              for r in df.select(*sorted(df.columns)).collect()), key=str)
    assert rows(got) == rows(want)


def test_rollup_writes_touched_keys_only(spark, tmp_dir):
    """Tokens before samples, a key grown by a later file, others left alone."""
    s0, t0 = _logs(spark, "r0", [1, 2])
    s1, t1 = _logs(spark, "r1", [1])
    more, more_tokens = _logs(spark, "r0", [2], seed=1)
    out = f"{tmp_dir}/out"

    def run():
        finish(R.run_rollup(spark, f"{tmp_dir}/s", s0.schema, out, f"{tmp_dir}/ck", f"{tmp_dir}/t",
                            R.sequence_log(t0).schema))
        return R.latest_rollup(spark, out)

    s0.coalesce(1).write.mode("append").parquet(f"{tmp_dir}/s")
    R.sequence_log(t0.unionByName(t1)).coalesce(1).write.mode("append").parquet(f"{tmp_dir}/t")
    _same(run(), metric_rollup(s0, sides=side_metrics(t0)))  # r1 has no samples yet
    before = set(glob.glob(f"{out}/batch=*/*.parquet"))
    s1.unionByName(more).coalesce(1).write.mode("append").parquet(f"{tmp_dir}/s")
    R.sequence_log(more_tokens.withColumn("sample_id", F.col("sample_id") + 10)).coalesce(1).write.mode("append").parquet(
        f"{tmp_dir}/t")
    all_tokens = t0.unionByName(t1).unionByName(more_tokens.withColumn("sample_id", F.col("sample_id") + 10))
    _same(run(), metric_rollup(s0.unionByName(s1).unionByName(more), sides=side_metrics(all_tokens)))
    new = set(glob.glob(f"{out}/batch=*/*.parquet")) - before
    rewritten = spark.read.parquet(*new).select("run_id", "step").distinct().collect()
    assert sorted(map(tuple, rewritten)) == [("r0", 2), ("r1", 1)]


def test_rollup_of_samples_alone(spark, tmp_dir):
    s, t = _logs(spark, "r", [1])
    s.write.parquet(f"{tmp_dir}/s")
    finish(R.run_rollup(spark, f"{tmp_dir}/s", s.schema, f"{tmp_dir}/o", f"{tmp_dir}/ck"))
    _same(R.latest_rollup(spark, f"{tmp_dir}/o"), metric_rollup(s, sides=side_metrics(t.limit(0))).withColumns(
        {f"perplexity_{m}_{x}": F.lit(0.0) for m in ("policy", "reference") for x in ("chosen", "rejected")}))
