"""Thread building: the one worked example, then edge cases."""

from pyspark.sql import functions as F

from conftest import comments_df, submissions_df
from dialectic.functions.text import DELTA_SYMBOLS, contains_any
from dialectic.operators import threads as TH

GOLD_COMMENTS = [
    ("SingleMaltMouthwash", "reply", 1672602739, "j2jdomf", "t3_1003si2", "t3_1003si2"),
    ("MyFavoriteArm", "You make some good points", 1672604220, "j2jhipf", "t3_1003si2", "t1_j2jdomf"),
]
GOLD_SUBS = [("1003si2", "MyFavoriteArm", "title", "body")]


def test_golden_op_comments(spark):
    c, s = comments_df(spark, GOLD_COMMENTS), submissions_df(spark, GOLD_SUBS)
    ops = TH.op_comments(c, s).collect()
    assert [r.comments_id for r in ops] == ["j2jhipf"]
    assert ops[0].submission_id == "1003si2"


def test_golden_ancestor_walk(spark):
    c = comments_df(spark, GOLD_COMMENTS)
    seeds = spark.createDataFrame([("j2jhipf",)], "id string")
    w = TH.ancestor_walk(c, seeds)
    rows = sorted(w.rows.collect(), key=lambda r: r.created_utc)
    assert [r.id for r in rows] == ["j2jdomf", "j2jhipf"]
    assert {r.start_id for r in rows} == {"j2jhipf"}
    assert w.stuck.count() == 0


def test_golden_thread_record(spark):
    c, s = comments_df(spark, GOLD_COMMENTS), submissions_df(spark, GOLD_SUBS)
    threads, quarantine = TH.build_threads(c, s)
    (t,) = threads.collect()
    assert t.comments_thread_root_comment_id == "j2jdomf"
    assert t.comments_thread_leaf_comment_id == "j2jhipf"
    assert t.comments_thread_is_delta is False
    assert [x.comment_id for x in t.comments_thread] == ["j2jdomf", "j2jhipf"]
    assert t.comments_thread[1].comment_parent_id == "t1_j2jdomf"
    assert quarantine.count() == 0


def test_golden_descendants_and_lookup(spark):
    c = comments_df(spark, GOLD_COMMENTS)
    seeds = spark.createDataFrame([("j2jdomf",)], "id string")
    d = TH.descendant_walk(c, seeds).rows
    assert {r.id for r in d.collect()} == {"j2jdomf", "j2jhipf"}
    got = [r.id for r in TH.lookup(c, ["j2jhipf", "j2jdomf"]).collect()]
    assert got == ["j2jdomf", "j2jhipf"]  # ordered by time
    assert TH.lookup(c, "j2jhipf").count() == 1
    ids = spark.createDataFrame([("j2jhipf",), ("nope",)], "x string")
    assert TH.lookup(c, ids, order=False).count() == 1


def _chain(n, sub="s1", start=1000):
    rows = []
    for i in range(n):
        parent = f"t3_{sub}" if i == 0 else f"t1_n{i - 1}"
        rows.append(("u", f"body {i}", start + i, f"n{i}", f"t3_{sub}", parent))
    return rows


def test_deep_chain_beyond_cte_limit(spark):
    c = comments_df(spark, _chain(150))
    seeds = spark.createDataFrame([("n149",)], "id string")
    w = TH.ancestor_walk(c, seeds)
    assert w.rows.count() == 150
    assert w.rows.agg(F.max("depth")).first()[0] == 149


def test_cycle_goes_to_quarantine(spark):
    rows = [("op", "x", 1, "a", "t3_s1", "t1_b"), ("v", "y", 2, "b", "t3_s1", "t1_a")]
    c, s = comments_df(spark, rows), submissions_df(spark, [("s1", "op", "t", "b")])
    threads, quarantine = TH.build_threads(c, s, max_depth=10)
    assert threads.count() == 0
    assert [(r.comments_id, r.reason) for r in quarantine.collect()] == [("a", "depth_limit")]


def test_orphan_parent_ends_chain(spark):
    rows = [("op", "x", 1, "a", "t3_s1", "t1_missing")]
    c = comments_df(spark, rows)
    w = TH.ancestor_walk(c, spark.createDataFrame([("a",)], "id string"))
    assert [r.id for r in w.rows.collect()] == ["a"]


def test_equal_timestamps_ancestors_first(spark):
    rows = [("v", "p", 5, "zz", "t3_s1", "t3_s1"), ("op", "c", 5, "aa", "t3_s1", "t1_zz")]
    c, s = comments_df(spark, rows), submissions_df(spark, [("s1", "op", "t", "b")])
    (t,) = TH.build_threads(c, s)[0].collect()
    assert [x.comment_id for x in t.comments_thread] == ["zz", "aa"]
    assert t.comments_thread_leaf_comment_id == "aa"


def test_null_leaf_body_quarantined(spark):
    rows = [("op", None, 5, "a", "t3_s1", "t3_s1")]
    c, s = comments_df(spark, rows), submissions_df(spark, [("s1", "op", "t", "b")])
    threads, quarantine = TH.build_threads(c, s)
    assert threads.count() == 0
    assert [(r.comments_id, r.reason) for r in quarantine.collect()] == [("a", "null_leaf_body")]


def test_null_and_placeholder_authors(spark):
    rows = [(None, "x", 1, "a", "t3_s1", "t3_s1"), ("[deleted]", "y", 2, "b", "t3_s2", "t3_s2")]
    subs = [("s1", None, "t", "b"), ("s2", "[deleted]", "t", "b")]
    c, s = comments_df(spark, rows), submissions_df(spark, subs)
    assert [r.comments_id for r in TH.op_comments(c, s).collect()] == ["b"]
    assert TH.op_comments(c, s, exclude_authors=["[deleted]"]).count() == 0


def test_duplicate_ids_keep_bag_semantics(spark):
    rows = [("v", "p", 1, "p", "t3_s1", "t3_s1"), ("v", "p2", 1, "p", "t3_s1", "t3_s1"),
            ("op", "c", 2, "c", "t3_s1", "t1_p")]
    c = comments_df(spark, rows)
    w = TH.ancestor_walk(c, spark.createDataFrame([("c",)], "id string"))
    assert sorted(r.id for r in w.rows.collect()) == ["c", "p", "p"]


def test_repeated_rows_multiply_along_the_walk(spark):
    # Two rows "c" under two equal rows "p" under "q": 2, then 2*2, then 2*2*1 rows.
    rows = [("v", "top", 0, "q", "t3_s1", None), ("v", "p", 1, "p", "t3_s1", "t1_q"), ("v", "p", 1, "p", "t3_s1", "t1_q"),
            ("op", "c", 2, "c", "t3_s1", "t1_p"), ("op", "other", 3, "c", "t3_s1", "t1_p")]
    c = comments_df(spark, rows)
    up = TH.ancestor_walk(c, spark.createDataFrame([("c",)], "id string")).rows.collect()
    assert sorted((r.id, r.depth, r.body) for r in up) == (
        [("c", 0, "c"), ("c", 0, "other")] + [("p", 1, "p")] * 4 + [("q", 2, "top")] * 4)
    down = TH.descendant_walk(c, spark.createDataFrame([("q",)], "id string")).rows.collect()
    assert sorted((r.id, r.depth) for r in down) == [("c", 2)] * 4 + [("p", 1)] * 2 + [("q", 0)]


def test_repeated_rows_in_a_cycle_are_caught(spark):
    rows = [("op", "x", 1, "a", "t3_s1", "t1_b")] * 3 + [("v", "y", 2, "b", "t3_s1", "t1_a")] * 3
    w = TH.ancestor_walk(comments_df(spark, rows), spark.createDataFrame([("a",)], "id string"))
    assert w.rows.count() == 0 and [r.start_id for r in w.stuck.collect()] == ["a"]


def test_submission_id_equal_to_comment_id_follows_prefix_blindly(spark):
    # parent "t3_x" is the submission, but a comment with id "x" exists:
    # the prefix is stripped without checking, like the original.
    rows = [("v", "p", 1, "x", "t3_x", "t3_x"), ("op", "c", 2, "c", "t3_x", "t3_x")]
    c = comments_df(spark, rows)
    w = TH.ancestor_walk(c, spark.createDataFrame([("c",)], "id string"), max_depth=5)
    assert w.rows.count() == 0  # "x" is its own parent now, so the walk goes round
    assert [r.start_id for r in w.stuck.collect()] == ["c"]


def test_delta_predicate_variants(spark):
    df = spark.createDataFrame([("ok !delta",), ("x &#8710; y",), ("∆",), ("!Delta",), (None,)], "t string")
    got = [r.f for r in df.select(contains_any("t", DELTA_SYMBOLS).alias("f")).collect()]
    assert got == [True, True, False, False, None]


def test_explode_threads_order(spark):
    c = comments_df(spark, _chain(5))
    s = submissions_df(spark, [("s1", "u", "t", "b")])
    threads, _ = TH.build_threads(c, s)
    flat = TH.explode_threads(threads).where(F.col("comments_thread_leaf_comment_id") == "n4")
    assert [r.comment_id for r in flat.orderBy("pos").collect()] == ["n0", "n1", "n2", "n3", "n4"]


def _fan(n_children):
    rows = [("r", "root", 1, "r", "t3_s1", "t3_s1")]
    rows += [(f"u{i}", f"b{i}", 10 + i, f"k{i}", "t3_s1", "t1_r") for i in range(n_children)]
    rows += [(f"u{i}", f"g{i}", 100 + i, f"g{i}", "t3_s1", f"t1_k{i}") for i in range(n_children)]
    return rows


def _walk_set(w):
    return sorted((r.start_id, r.id, r.depth) for r in w.rows.collect())


def test_hot_frontier_key_same_result(spark):
    # 40 seeds converge on one ancestor "r": a hot key on the frontier side.
    c = comments_df(spark, _fan(40))
    seeds = spark.createDataFrame([(f"g{i}",) for i in range(40)], "id string")
    plain = _walk_set(TH.ancestor_walk(c, seeds))
    skew = _walk_set(TH.ancestor_walk(c, seeds, hot_key_rows=2))
    assert plain == skew and len(plain) == 120


def test_hot_parent_same_result(spark):
    # "r" has 40 direct replies: a hot key on the node side of the down walk.
    c = comments_df(spark, _fan(40))
    seeds = spark.createDataFrame([("r",), ("k3",)], "id string")
    plain = _walk_set(TH.descendant_walk(c, seeds))
    skew = _walk_set(TH.descendant_walk(c, seeds, hot_key_rows=2))
    assert plain == skew and len(plain) == 81 + 2
    assert TH.hot_keys(c.select(F.col("parent_id").alias("p")), "p", 2) == ["t1_r"]


def test_invalid_utf8_text_is_cleaned_in_records(spark):
    raw = spark.createDataFrame([("op", bytearray(b"ok \xff!delta"), 5, "a", "t3_s1", "t3_s1")],
                                "author string, b binary, created_utc long, id string, link_id string, "
                                "parent_id string")
    c = raw.select("author", F.col("b").cast("string").alias("body"), "created_utc", "id", "link_id", "parent_id")
    s = submissions_df(spark, [("s1", "op", "t", "b")])
    (t,) = TH.build_threads(c, s)[0].collect()
    assert t.comments_thread[0].comment_body == "ok !delta"
    assert t.comments_thread_is_delta is True


def test_walk_without_depth_limit(spark):
    """Long chains stay whole; a walk that goes round is caught, others are not."""
    rows = [("a", "b", i, f"n{i}", "t3_s", f"t1_n{i - 1}" if i else "t3_s") for i in range(9)]
    rows += [("a", "b", 50, "x", "t3_s", "t1_y"), ("a", "b", 51, "y", "t3_s", "t1_x"), ("a", "b", 52, "z", "t3_s", "t1_y")]
    c = comments_df(spark, rows)
    seeds = spark.createDataFrame([("n8",), ("n2",), ("x",), ("z",)], "id string")
    w = TH.ancestor_walk(c, seeds)
    got = {r[0]: r[1] for r in w.rows.groupBy("start_id").count().collect()}
    assert got == {"n8": 9, "n2": 3}
    assert sorted(r.start_id for r in w.stuck.collect()) == ["x", "z"]


def _long_chain(spark, n, first_parent):
    return spark.range(n).selectExpr(
        "'a' AS author", "'b' AS body", "id AS created_utc", "concat('n', id) AS id", "'t3_s' AS link_id",
        f"CASE WHEN id = 0 THEN '{first_parent}' ELSE concat('t1_n', id - 1) END AS parent_id")


def test_chain_of_a_hundred_thousand_in_log_rounds(spark):
    n = 100_000
    c = _long_chain(spark, n, "t3_s")
    w = TH.ancestor_walk(c, spark.createDataFrame([(f"n{n - 1}",), ("n9",)], "id string"))
    assert w.levels <= 17 and w.stuck.count() == 0
    got = w.rows.groupBy("start_id").agg(F.count("*"), F.max("depth"), F.countDistinct("id"), F.min("created_utc"))
    assert sorted(map(tuple, got.collect())) == [("n9", 10, 9, 10, 0), (f"n{n - 1}", n, n - 1, n, 0)]
    d = TH.descendant_walk(c, spark.createDataFrame([(f"n{n - 40_000}",)], "id string"))
    assert d.rows.agg(F.count("*"), F.max("depth")).first() == (40_000, 39_999)


def test_loop_below_which_a_long_chain_hangs(spark):
    """Two comments that name each other and 100,000 replies below: marked once
    for all seeds, by doubling."""
    n = 100_000
    loop = comments_df(spark, [("a", "b", -2, "x", "t3_s", "t1_y"), ("a", "b", -1, "y", "t3_s", "t1_x")])
    c = loop.unionByName(_long_chain(spark, n, "t1_y")).unionByName(comments_df(spark, _chain(5, start=1)).selectExpr(
        "author", "body", "created_utc", "concat('m', id) AS id", "link_id", "replace(parent_id, 't1_', 't1_m') AS parent_id"))
    seeds = c.select("id").where("id NOT LIKE 'n%' OR id LIKE '%99'")
    up = TH.ancestor_walk(c, seeds)
    assert up.levels <= 18
    assert up.stuck.count() == 2 + n // 100 and up.rows.count() == 1 + 2 + 3 + 4 + 5
    down = TH.descendant_walk(c, spark.createDataFrame([("x",), ("y",), ("n99990",), ("mn3",)], "id string"))
    assert sorted(r.start_id for r in down.stuck.collect()) == ["x", "y"]
    assert sorted(map(tuple, down.rows.groupBy("start_id").count().collect())) == [("mn3", 2), ("n99990", 10)]


def test_many_ways_between_two_comments_are_merged(spark):
    """Every id occurs under both ids of the level above: 2^30 paths, 31 levels."""
    rows = [("a", "b", 0, f"{s}0", "t3_s", "t3_s") for s in "pq"]
    rows += [("a", "b", i, f"{s}{i}", "t3_s", f"t1_{t}{i - 1}") for i in range(1, 31) for s in "pq" for t in "pq"]
    c = comments_df(spark, rows)
    w = TH.ancestor_walk(c, spark.createDataFrame([("p4",)], "id string"))
    got = sorted(map(tuple, w.rows.groupBy("depth").count().collect()))
    assert got == [(0, 2), (1, 4), (2, 8), (3, 16), (4, 16)]
    looped = c.unionByName(comments_df(spark, [("a", "b", 0, "p0", "t3_s", "t1_q30")]))
    assert [r.start_id for r in TH.ancestor_walk(looped, spark.createDataFrame([("q1",)], "id string")).stuck.collect()] == ["q1"]


def test_depth_bound_leaves_short_walks(spark):
    c = comments_df(spark, _chain(12))
    w = TH.ancestor_walk(c, spark.createDataFrame([("n11",), ("n4",), ("n5",)], "id string"), max_depth=4)
    assert sorted(r.start_id for r in w.stuck.collect()) == ["n11", "n5"]
    assert sorted(r.id for r in w.rows.collect()) == [f"n{i}" for i in range(5)]
