"""Property checks on the fixture tables and on generated inputs."""

import os

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dialectic.functions.ordering import int_order_index
from dialectic.operators import preferences as P
from dialectic.operators import threads as TH
from dialectic.sources import fixtures as FX

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@needs_data
def test_walk_of_node_is_one_plus_walk_of_parent(spark):
    c = FX.f_comments(spark, SF)
    w = TH.ancestor_walk(c, c.select("id"))
    sizes = w.rows.groupBy("start_id").agg(F.count(F.lit(1)).alias("n"))
    par = c.select(F.col("id").alias("start_id"), F.substring("parent_id", 4, 1 << 30).alias("pid"))
    j = (sizes.join(par, "start_id")
              .join(sizes.select(F.col("start_id").alias("pid"), F.col("n").alias("pn")), "pid", "left"))
    bad = j.where(F.col("n") != F.coalesce(F.col("pn"), F.lit(0)) + 1).count()
    assert bad == 0
    assert sizes.count() == c.count()


@needs_data
def test_clean_chain_leaf_is_the_seed(spark):
    c, s = FX.f_comments(spark, SF), FX.f_submissions(spark, SF)
    threads, quarantine = TH.build_threads(c, s)
    ops = TH.op_comments(c, s)
    j = threads.join(ops, (threads["submission_id"] == ops["submission_id"])
                     & (threads["comments_thread_leaf_comment_id"] == ops["comments_id"]), "left_anti")
    assert j.count() == 0
    assert threads.count() == ops.count() and quarantine.count() == 0


_slow = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))


@_slow
@given(st.lists(st.tuples(st.integers(-10**9, 10**9), st.integers(0, 9)), min_size=1, max_size=60,
                unique_by=lambda t: t[0]))
def test_running_sum_matches_python(spark, rows):
    df = spark.createDataFrame(rows, "k long, v long")
    got = {r.k: (r.i, r.s) for r in int_order_index(df, "k", out="i").join(
        int_order_index(df, "k", out="s", value=F.col("v")), ["k", "v"]).collect()}
    acc = 0
    for pos, (k, v) in enumerate(sorted(rows)):
        assert got[k] == (pos, acc)
        acc += v


@_slow
@given(st.lists(st.integers(0, 25), min_size=1, max_size=80))
def test_group_split_invariants(spark, groups):
    df = spark.createDataFrame([(i, f"p{g}", "c", "r") for i, g in enumerate(groups)],
                               "row_id long, prompt string, chosen string, rejected string")
    sp = P.group_split(df).collect()
    assert len(sp) == len(groups)
    per_prompt = {}
    for r in sp:
        per_prompt.setdefault(r.prompt, set()).add(r.split)
    assert all(len(v) == 1 for v in per_prompt.values())
    g = len(per_prompt)
    counts = {k: sum(1 for v in per_prompt.values() if k in v) for k in ("train", "validation", "test")}
    assert counts["train"] == int(0.6 * g) and counts["validation"] == int(0.2 * g)
