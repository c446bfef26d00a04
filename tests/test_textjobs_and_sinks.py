"""Packing, truncation, generation, sinks, streaming and ordering helpers."""

import os
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from dialectic.functions.ordering import hash_order_index, int_order_index
from dialectic.functions.text import run_key_from_dir, strip_type_prefix, utf8_clean, zero_pad2
from dialectic.operators import textjobs as T
from dialectic.operators import threads as TH
from dialectic.sources import sinks
from dialectic.sources.readers import read_sample_log
from dialectic.sources.schemas import SAMPLE_LOG


def _docs(spark, lengths):
    rows = [(i, " ".join(f"w{j}" for j in range(n))) for i, n in enumerate(lengths)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_pack_blocks_exact_and_disjoint(spark):
    lengths = [3, 10, 0, 7, 25, 4]
    S = 8
    packed = T.pack_sequences(_docs(spark, lengths), seq_length=S).collect()
    total = sum(n + 1 for n in lengths)
    blocks = {}
    for r in packed:
        blocks.setdefault(r.block_id, []).append((r.from_offset, r.to_offset))
    assert sorted(blocks) == list(range(total // S))  # tail dropped
    for spans in blocks.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] == S
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))  # contiguous, no overlap


def test_truncate_tokens(spark):
    df = spark.createDataFrame([(0, "  a b\tc  d "), (1, "")], "doc_id long, text string")
    r = {x.doc_id: x for x in T.truncate_tokens(df, max_tokens=2).collect()}
    assert (r[0].n_tokens, r[0].n_kept, r[0].truncated, r[0].text_truncated) == (4, 2, True, "a b")
    assert (r[1].n_tokens, r[1].truncated) == (0, False)
    tail = T.truncate_tokens(df, max_tokens=2, keep="end").where("doc_id = 0").first()
    assert tail.text_truncated == "c d"


def test_generation_nulls_and_missing_columns(spark):
    df = spark.createDataFrame([(0, "a b"), (1, None), (2, " ")], "sample_index long, prompt string")
    out = {r.sample_index: r for r in T.batch_generate(df, "n", "i", "p", 7, "test", kwargs={"max_new_tokens": 3}).collect()}
    assert out[0].generated_text == "a b a" and out[1].generated_text is None and out[2].generated_text == ""
    assert out[0].chosen == "" and out[0].checkpoint_epoch == "07"


def test_generation_truncates_and_obeys_its_kwargs(spark):
    df = spark.createDataFrame([(0, "a b c d e"), (1, "x")], "i long, prompt string").repartition(1)
    run = lambda **k: [r.generated_text for r in T.generate(df, **k).orderBy("i").collect()]
    assert run(kwargs={"max_length": "7"}) == ["a b", "x x x x x x"]
    assert run(kwargs={"max_length": "7"}, max_prompt_tokens=2) == ["a b a b a", "x x x x x x"]
    assert run(kwargs={"max_length": "7", "max_new_tokens": 1, "upper": "true"}) == ["A", "X"]
    assert run(kwargs={"max_length": "3"}) == ["", "x x"]


def test_second_run_generates_nothing(spark, tmp_dir):
    rows = spark.createDataFrame([(i, f"p {i}\nx") for i in range(6)], "pos long, prompt string")
    seen = spark.sparkContext.accumulator(0)

    def make(r):
        n = r.count()
        seen.add(n)
        return T.generated_samples(r, "run", 1.0, kwargs={"max_new_tokens": 2})

    for fmt in ("csv", "parquet"):
        log = os.path.join(tmp_dir, fmt)
        go = lambda r, epoch=1.0: T.resume(r, make, log, "pos", "eval_sample_index",
                                           {"run_id": "run", "epoch": epoch}, fmt)
        seen.value = 0
        assert go(rows.where("pos < 4")).count() == 4 and seen.value == 4
        out = go(rows)
        assert seen.value == 6 and sorted(r.eval_sample_index for r in out.collect()) == list(range(6))
        assert go(rows).count() == 6 and seen.value == 6
        assert {r.generated_text for r in out.where("eval_sample_index = 5").collect()} == {"p 5"}


def test_truncate_pair_leaves_the_answers_the_rest(spark):
    df = spark.createDataFrame([(0, "a b c d", "1 2 3", None), (1, None, "1 2 3 4", ""), (2, "", "1 2 3 4 5 6", "x")],
                               "i int, prompt string, chosen string, rejected string")
    got = {r.i: (r.prompt, r.chosen, r.rejected) for r in T.truncate_pair(df, 3, 5).collect()}
    assert got[0] == ("b c d", "1 2", None) and got[2] == ("", "1 2 3 4 5", "x")


def test_stored_table_is_joined_without_an_exchange(spark, tmp_dir):
    from dialectic.operators import threads as TH
    c = spark.createDataFrame([("op", "b", 1, f"c{i}", "t3_s", "t3_s") for i in range(50)],
                              "author string, body string, created_utc long, id string, link_id string, parent_id string")
    s = spark.createDataFrame([("s", "op", "t", "b")], "id string, author string, title string, selftext string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for k in range(2):  # a second run drops and creates the table anew
            ops = TH.store_op_comments(c, s, "test_op_comments", os.path.join(tmp_dir, f"ops{k}"))
            assert ops.count() == 50
        plan = TH.op_replies(ops, c)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Bucketed: true" in plan  # only the comments' side moves
        assert TH.op_replies(ops, c).count() == 50
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP TABLE test_op_comments")


def test_unknown_generator(spark):
    df = spark.createDataFrame([(0, "abc")], "sample_index long, prompt string")
    try:
        T.generate(df, "nope")
        raise AssertionError("expected KeyError")
    except KeyError:
        pass


def test_string_helpers(spark):
    df = spark.createDataFrame([("t1_abc", bytearray(b"ab\xffc"), "/x/run-2024_01-xyz/files", 7)],
                               "p string, b binary, d string, n int")
    r = df.select(strip_type_prefix("p").alias("s"), utf8_clean("b").alias("u"),
                  run_key_from_dir("d").alias("k"), zero_pad2("n").alias("z"),
                  zero_pad2(F.lit(123)).alias("z3")).first()
    assert (r.s, r.u, r.k, r.z, r.z3) == ("abc", "abc", "2024_01_xyz", "07", "123")


def test_utf8_clean_is_decode_ignore(spark):
    raws = [b"", b"a\xef\xbf\xbdb\xff", b"\xf0\xef\xbf\xbd\x01a\x01\xc3", b"\x01b\xe2\x82", b"ok \x01b \xef\xbf\xbd"]
    df = spark.createDataFrame([(i, bytearray(r)) for i, r in enumerate(raws)], "i int, b binary")
    got = {r.i: r.u for r in df.select("i", utf8_clean("b").alias("u")).collect()}
    assert got == {i: r.decode("utf-8", "ignore") for i, r in enumerate(raws)}


def test_ordered_index_matches_global_window(spark):
    rnd = random.Random(7)
    ids = rnd.sample(range(1, 10**7), 3000)
    df = spark.createDataFrame([(i, rnd.randint(0, 5)) for i in ids], "k long, v long")
    got = {r.k: (r.idx, r.run) for r in int_order_index(df, "k", out="idx").join(
        int_order_index(df, "k", out="run", value=F.col("v")), ["k", "v"]).collect()}
    w = Window.orderBy("k")
    ref = df.select("k", (F.row_number().over(w) - 1).alias("i"),
                    (F.sum("v").over(w) - F.col("v")).alias("s")).collect()
    assert all(got[r.k] == (r.i, r.s) for r in ref)
    h = hash_order_index(df, F.col("k"), 42, out="idx", total="n").collect()
    assert sorted(r.idx for r in h) == list(range(3000)) and {r.n for r in h} == {3000}


def test_grouped_running_index(spark):
    rows = [(g, i) for g in ("a", "b") for i in range(0, 200, 3)]
    df = spark.createDataFrame(rows, "g string, k long")
    got = int_order_index(df, "k", out="idx", total="n", partition_cols=["g"]).collect()
    for g in ("a", "b"):
        mine = sorted((r.k, r.idx) for r in got if r.g == g)
        assert [i for _, i in mine] == list(range(len(mine)))


def test_sinks_roundtrip(spark, tmp_dir):
    c = spark.createDataFrame([("op", "x", 1, "a", "t3_s1", "t3_s1")],
                              "author string, body string, created_utc long, id string, link_id string, "
                              "parent_id string")
    s = spark.createDataFrame([("s1", "op", "t", None)], "id string, author string, title string, selftext string")
    threads, _ = TH.build_threads(c, s)
    path = os.path.join(tmp_dir, "threads")
    sinks.write_json_lines(threads, path)
    lines = [ln for f in sorted(os.listdir(path)) if f.endswith(".json")
             for ln in open(os.path.join(path, f), encoding="utf-8")]
    assert len(lines) == 1 and '"submission_body":null' in lines[0]
    back = spark.read.schema(threads.schema).json(path).first()
    assert back.comments_thread[0].comment_id == "a"

    log = spark.createDataFrame([tuple([None] * 16)], SAMPLE_LOG).withColumn("run_id", F.lit("r1")) \
        .withColumn("type", F.lit("train")).withColumn("prompt", F.lit('say "hi",\nok'))
    lp = os.path.join(tmp_dir, "log")
    sinks.append_log(log, lp, fmt="csv")
    sinks.append_log(log, lp, fmt="csv")
    got = read_sample_log(spark, lp)
    assert got.count() == 2 and got.first().prompt == 'say "hi",\nok'


def test_run_helpers(spark):
    import datetime
    from dialectic.functions.text import parse_kwargs, run_name, run_timestamp
    df = spark.createDataFrame([(datetime.datetime(2024, 1, 2, 3, 4, 5), '{"top_k": "50", "do_sample": "true"}')],
                               "ts timestamp, kw string")
    r = df.select(run_timestamp("ts").alias("t"), run_name(F.lit("a"), F.lit("b")).alias("n"),
                  parse_kwargs("kw").alias("m")).first()
    assert r.t == "20240102_030405" and r.n == "a_b" and r.m == {"top_k": "50", "do_sample": "true"}


def test_partitions_for_scales_with_size(spark):
    from dialectic.session import partitions_for
    df = spark.range(0, 200000).selectExpr("id", "repeat('x', 100) AS s")
    base = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert partitions_for(df) >= base
    assert partitions_for(df, target_bytes=1 << 16) > base


def test_csv_keeps_text_exactly(spark, tmp_dir):
    from dialectic.sources.readers import read_csv
    df = spark.createDataFrame([(0, "  lead and trail  "), (1, 'q "x",\nnext'), (2, ""), (3, None)],
                               "id long, t string")
    path = os.path.join(tmp_dir, "csv")
    sinks.write_csv(df, path)
    back = {r.id: r.t for r in read_csv(spark, path, df.schema).collect()}
    # CSV has one empty form for '' and NULL (as Python's csv writer does);
    # both read back as NULL.
    assert back == {0: "  lead and trail  ", 1: 'q "x",\nnext', 2: None, 3: None}
