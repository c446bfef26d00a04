"""Preference data: splits, dedup, positions, pairing, JSON row order."""

import json
import math
import os

import pytest
from pyspark.sql import functions as F

from dialectic.functions import ordering
from dialectic.functions.ordering import order_index
from dialectic.operators import preferences as P
from dialectic.sources.readers import load_preferences


def _prefs(spark, prompts):
    rows = [(i, p, f"c{i}", f"r{i}") for i, p in enumerate(prompts)]
    return spark.createDataFrame(rows, "row_id long, prompt string, chosen string, rejected string")


def test_group_split_sizes_and_no_leak(spark):
    prompts = [f"p{i % 37}" for i in range(400)]
    sp = P.group_split(_prefs(spark, prompts))
    per = {r.split: r.n_prompts for r in P.split_counts(sp).collect()}
    g = 37
    assert per["train"] == int(0.6 * g)
    assert per["validation"] == int(0.2 * g)
    assert per["test"] == g - int(0.6 * g) - int(0.2 * g)
    leak = P.split_leak_check(sp).first()
    assert (leak.n_prompts, leak.n_leaking_prompts) == (37, 0)
    assert sp.count() == 400


def test_group_split_small_groups(spark):
    four = P.split_counts(P.group_split(_prefs(spark, ["a", "b", "c", "d"]))).collect()
    assert {r.split: r.n_prompts for r in four} == {"train": 2, "test": 2}
    one = P.split_counts(P.group_split(_prefs(spark, ["a", "a"]))).collect()
    assert [(r.split, r.n_rows) for r in one] == [("test", 2)]


def test_group_split_deterministic_across_partitionings(spark):
    prompts = [f"p{i % 53}" for i in range(300)]
    df = _prefs(spark, prompts)
    a = {(r.row_id, r.split) for r in P.group_split(df).collect()}
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        b = {(r.row_id, r.split) for r in P.group_split(df.repartition(5)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert a == b


def test_group_split_null_prompt_gets_a_split(spark):
    df = _prefs(spark, ["a", None, "b", None])
    sp = P.group_split(df).collect()
    assert len(sp) == 4
    assert len({r.split for r in sp if r.prompt is None}) == 1


def test_row_split_sizes(spark):
    df = _prefs(spark, [f"p{i}" for i in range(101)])
    c = {r.split: r.n_rows for r in P.split_counts(P.row_split(df)).collect()}
    n_test = math.ceil(0.2 * 101)
    n_val = math.ceil(0.25 * (101 - n_test))
    assert c == {"test": n_test, "validation": n_val, "train": 101 - n_test - n_val}


def test_dedup_keeps_first_and_is_idempotent(spark):
    df = _prefs(spark, ["b", "a", "b", "c", "a"])
    d = P.dedup_prompts(df)
    rows = sorted(d.collect(), key=lambda r: r.sample_index)
    assert [(r.sample_index, r.row_id, r.prompt) for r in rows] == [(0, 0, "b"), (1, 1, "a"), (2, 3, "c")]
    again = P.dedup_prompts(d.drop("sample_index"))
    assert sorted(again.collect()) == sorted(d.collect())


def test_positions_and_head(spark):
    df = _prefs(spark, ["x"] * 30).withColumn("row_id", F.col("row_id") * 7 + 3)
    picked = P.pick_positions(df, [0, 15]).collect()
    assert sorted(r.row_id for r in picked) == [3, 15 * 7 + 3]
    assert P.pick_positions(df, None).count() == 30
    assert P.head_n(df, 10).count() == 10
    assert P.head_n(df, 100).count() == 30
    try:
        P.check_positions(P.with_positions(df), [29, 30])
        raise AssertionError("expected IndexError")
    except IndexError:
        pass


def test_prompt_groups_first_appearance(spark):
    g = P.prompt_groups(_prefs(spark, ["b", "a", "b", "c"])).orderBy("group_index").collect()
    assert [(r.prompt, r.first_row_id, r.n_rows, r.group_index) for r in g] == [
        ("b", 0, 2, 0), ("a", 1, 1, 1), ("c", 3, 1, 2)]


def test_templates(spark):
    df = _prefs(spark, ["hello"])
    t = P.template_prompts(df, prefix="<", suffix=">").first().prompt
    assert t == "<hello>"
    txt = P.instruction_format(df, prefix="PFX").first().text
    assert txt == "### Instruction:\nPFX\n\n### Input:\nhello\n \n### Response:\nc0\n"
    try:
        P.preprocess(df, "nope")
        raise AssertionError("expected KeyError")
    except KeyError:
        pass
    assert P.preprocess(df, None) is df


def test_preference_pairs_same_prompt(spark):
    rows = [(1, "p", "pos1", 1), (2, "p", "neg2", 0), (3, "p", "neg3", 0), (4, "q", "pos4", 1),
            (5, "r", "neg5", 0), (6, "p", "pos6", 1)]
    lab = spark.createDataFrame(rows, "doc_id long, prompt string, text string, quality int")
    pairs = P.preference_pairs(lab).collect()
    assert sorted(r.chosen_id for r in pairs) == [1, 6]  # q has no negatives
    assert all(r.rejected_id in (2, 3) for r in pairs)


def test_stack_sides_keeps_nulls(spark):
    df = spark.createDataFrame([(0, "p", "c", None)], "row_id long, prompt string, chosen string, rejected string")
    st = P.stack_sides(df).collect()
    assert sorted((r.side, r.text) for r in st) == [("chosen", "c"), ("rejected", None)]
    back = P.unstack_sides(P.stack_sides(df), ("row_id",), "text").first()
    assert (back.chosen_text, back.rejected_text) == ("c", None)


def test_load_preferences_keeps_file_order(spark, tmp_dir):
    for f, rng in (("part-a.json", range(0, 50)), ("part-b.json", range(50, 120))):
        with open(os.path.join(tmp_dir, f), "w") as fh:
            for i in rng:
                fh.write(json.dumps({"prompt": f"p{i % 9}", "chosen": f"c{i}", "rejected": f"r{i}"}) + "\n")
    df = load_preferences(spark, tmp_dir)
    rows = sorted(df.collect(), key=lambda r: r.row_id)
    assert [r.row_id for r in rows] == list(range(120))
    assert [r.chosen for r in rows] == [f"c{i}" for i in range(120)]


def test_positions_follow_list_indexing(spark):
    df = spark.createDataFrame([(i, f"p{i}") for i in range(20)], "row_id long, prompt string")
    got = sorted(r.row_id for r in P.pick_positions(df, [15, 15, -1]).collect())
    assert got == [15, 15, 19]
    for bad in ([20], [-21]):
        with pytest.raises(IndexError):
            P.pick_positions(df, bad)
    assert P.pick_positions(df, []).count() == 0


@pytest.mark.parametrize("bucket", [1 << 18, 200, 5])
def test_rows_are_selected_without_numbering_all(spark, monkeypatch, bucket):
    """Any position by sampled ranges, also under one key that holds a third of the rows."""
    monkeypatch.setattr(ordering, "ROWS_PER_BUCKET", bucket)
    monkeypatch.setattr(ordering, "SAMPLE_ROWS", 64)
    monkeypatch.setattr(ordering, "BOUNDS", 16)
    rows = [(None if i == 7 else 0 if i % 3 else (i * 37) % 500, f"é{i:05d}") for i in range(3000)]
    df = spark.createDataFrame(rows, "a long, b string").repartition(5).withColumn("_range", F.lit(1))
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for positions in ([0, 1500, -1, 1500], [2999, -3000], list(range(0, 3000, 11)), []):
        got = sorted((r.pos, r.a, r.b) for r in ordering.rows_at(df, ["a", "b"], positions).collect())
        assert got == sorted(((p % 3000, *want[p]) for p in positions), key=lambda r: r[0])
    with pytest.raises(IndexError):
        ordering.rows_at(df, ["a", "b"], [3000])
    assert ordering.rows_at(df.limit(0), ["a", "b"], []).count() == 0


def test_positions_count_in_split_order(spark):
    df = spark.createDataFrame([(i, f"p{i % 7}", "c", "r") for i in range(60)],
                               "row_id long, prompt string, chosen string, rejected string")
    train = P.select_split(P.group_split(df), "train")
    want = [r.row_id for r in train.orderBy("split_rank", "row_id").collect()]
    got = [r.row_id for r in P.with_positions(train).orderBy("pos").collect()]
    assert got == want and got != sorted(got)
    assert [r.row_id for r in P.head_n(train, 5).orderBy("pos").collect()] == want[:5]


def test_range_buckets_stay_even_with_an_outlier(spark):
    df = spark.range(20_000).union(spark.createDataFrame([(1 << 60,)], "id long"))
    ranged = df.repartitionByRange(8, "id").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert max(r["count"] for r in ranged) < 2 * 20_001 / 8
    got = order_index(df, ["id"], out="i", rows_per_bucket=2_500)
    assert got.where("i <> least(id, 20000)").count() == 0 and got.count() == 20_001
