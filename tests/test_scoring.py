"""Scoring maths: properties from the metric definitions."""

import math

from pyspark.sql import functions as F

from dialectic.functions.mathx import array_argmax, array_softmax, left_pad_array, nan_to_zero
from dialectic.operators import metrics as M
from dialectic.operators import scoring as S


def _pairs(spark, rows):
    return spark.createDataFrame(
        rows, "sample_id long, run_id string, type string, step long, policy_chosen_logps double, "
              "policy_rejected_logps double, reference_chosen_logps double, reference_rejected_logps double")


def test_loss_is_ln2_when_rewards_equal(spark):
    sc = S.dpo_loss(_pairs(spark, [(0, "r", "train", 0, -5.0, -7.0, -5.0, -7.0)])).first()
    assert abs(sc.loss - math.log(2)) < 1e-12
    assert sc.reward_correct is False


def test_loss_stable_for_large_margins(spark):
    rows = [(0, "r", "train", 0, 9000.0, 0.0, 0.0, 0.0), (1, "r", "train", 0, -9000.0, 0.0, 0.0, 0.0)]
    got = {r.sample_id: r.loss for r in S.dpo_loss(_pairs(spark, rows), beta=1.0).collect()}
    assert got[0] == 0.0 and abs(got[1] - 9000.0) < 1e-9


def test_rewards_and_accuracy(spark):
    rows = [(i, "r", "train", 0, -1.0 * i, -2.0, 0.0, 0.0) for i in range(5)]
    sc = S.dpo_loss(_pairs(spark, rows), beta=0.5)
    acc = M.reward_accuracy(sc).first().reward_accuracy
    assert 0.0 <= acc <= 1.0 and abs(acc - 0.4) < 1e-12  # i=0,1 beat -2
    r = {x.sample_id: (x.chosen_reward, x.rejected_reward) for x in sc.collect()}
    assert r[3] == (-1.5, -1.0)


def test_rpo_and_batch_loss(spark):
    sc = S.dpo_loss(_pairs(spark, [(0, "r", "train", 0, -1.0, -2.0, -1.0, -2.0)]))
    nll = spark.createDataFrame([("r", "train", 0, 2.0)], "run_id string, type string, step long, nll_loss double")
    r = S.rpo_loss(sc, nll, 0.5).first()
    assert abs(r.rpo_loss - (math.log(2) + 1.0)) < 1e-12
    assert S.rpo_loss(sc, nll, None).first().rpo_loss == sc.first().loss
    b = S.batch_loss(sc.withColumn("aux", F.lit(3.0)), aux="aux", aux_coef=0.1).first()
    assert abs(b.batch_loss - (math.log(2) + 0.3)) < 1e-12


def _tokens(spark, rows):
    return spark.createDataFrame(rows, "seq_id long, pos long, label int, logp double")


def test_sequence_logp_perplexity_ipo(spark):
    rows = [(0, 0, -100, -9.0), (0, 1, 5, -1.0), (0, 2, 6, -3.0), (1, 0, -100, -1.0)]
    t = _tokens(spark, rows)
    s = {r.seq_id: (r.logp_sum, r.n_tokens) for r in S.sequence_logp(t).collect()}
    assert s == {0: (-4.0, 2), 1: (0.0, 0)}
    p = {r.seq_id: r.perplexity for r in S.perplexity(t).collect()}
    assert abs(p[0] - math.exp(2.0)) < 1e-12 and p[0] >= 1.0 and p[1] == 0.0
    i = {r.seq_id: r.logp_avg for r in S.ipo_logp(S.sequence_logp(t)).collect()}
    assert i == {0: -2.0, 1: None}


def test_shift_labels(spark):
    t = _tokens(spark, [(0, 0, 1, 0.0), (0, 1, 2, 0.0), (0, 2, 3, 0.0)])
    got = [r.label for r in S.shift_labels(t).orderBy("pos").collect()]
    assert got == [2, 3, -100]


def test_softmax_argmax_and_nll(spark):
    df = spark.createDataFrame([(0, [1.0, 3.0, 3.0, -1.0], 1)], "id int, logits array<double>, label int")
    r = df.select(array_softmax("logits").alias("p"), array_argmax("logits").alias("a")).first()
    assert abs(sum(r.p) - 1.0) < 1e-12 and r.a == 1
    nll = S.token_nll(df).first().nll
    z = sum(math.exp(x) for x in [1.0, 3.0, 3.0, -1.0])
    assert abs(nll - (math.log(z) - 3.0)) < 1e-12


def test_decode_tokens_order_and_unknown(spark):
    ids = spark.createDataFrame([(0, 1, 2), (0, 0, 1), (0, 2, 99), (1, 0, 99)], "seq_id long, pos long, token_id int")
    vocab = spark.createDataFrame([(1, "he"), (2, "llo")], "token_id int, piece string")
    got = {r.seq_id: r.text for r in S.decode_tokens(ids, vocab).collect()}
    assert got == {0: "hello", 1: ""}


def test_pair_table_and_attach(spark):
    rows = [(0, "r", "train", 0, m, s, float(i)) for i, (m, s) in enumerate(
        [("policy", "chosen"), ("policy", "rejected"), ("reference", "chosen"), ("reference", "rejected")])]
    sc = spark.createDataFrame(rows, "sample_id long, run_id string, type string, step long, model string, "
                                     "side string, logp double")
    p = S.pair_table(sc).first()
    assert (p.policy_chosen_logps, p.policy_rejected_logps, p.reference_chosen_logps,
            p.reference_rejected_logps) == (0.0, 1.0, 2.0, 3.0)
    pol = sc.where("model = 'policy'").drop("model")
    ref = sc.where("model = 'reference'").where("side = 'chosen'")
    got = {r.side: r.reference_logp for r in S.attach_ref_scores(pol, ref).collect()}
    assert got == {"chosen": 2.0, "rejected": None}


def test_beta_sweep_and_best(spark):
    rows = [(i, "r", "train", 0, -1.0, -2.0 - i, -1.5, -1.5) for i in range(10)]
    sw = M.beta_sweep(_pairs(spark, rows))
    assert sorted(r.beta for r in sw.collect()) == [0.1, 0.15, 0.2, 0.25]
    best = M.best_beta(sw).first()
    assert best.beta == 0.25  # larger beta, larger positive margins, lower loss


def test_history_and_trials(spark):
    h = spark.createDataFrame([("a", 1, 0.5, None), ("a", 2, None, 0.9), ("a", 3, 0.4, None), ("b", 1, 0.1, None)],
                              "run_id string, pos long, loss double, eval_loss double")
    got = {r.run_id: r.last_eval_loss for r in M.last_eval_loss(h).collect()}
    assert got == {"a": 0.9}  # run b has no eval loss at all
    assert M.last_row(h).first().pos == 3
    t = spark.createDataFrame([(0, None, "x"), (1, 0.3, "y"), (2, 0.3, "z"), (3, 0.7, "w")],
                              "number long, value double, wandb_run_id string")
    assert M.best_trial(t).first().number == 1
    sr = {r.number: (r.value, r.is_best) for r in M.study_results(t).collect()}
    assert sr[0] == (float("inf"), False) and sr[1] == (0.3, True) and sr[2][1] is False


def test_array_helpers(spark):
    df = spark.createDataFrame([([1, 2],)], "a array<int>")
    assert df.select(left_pad_array("a", 4, 0).alias("x")).first().x == [0, 0, 1, 2]
    assert df.select(left_pad_array("a", 1, 0).alias("x")).first().x == [1, 2]
    v = spark.createDataFrame([(float("nan"),), (None,), (2.0,)], "x double")
    assert [r.y for r in v.select(nan_to_zero("x").alias("y")).collect()] == [0.0, 0.0, 2.0]


def test_reference_scores_are_computed_once(spark, tmp_dir):
    from dialectic.sources.sinks import stored_once
    scores = spark.createDataFrame([(1, "reference", "chosen", -2.0), (1, "reference", "rejected", -3.0),
                                    (1, "policy", "chosen", 5.0), (2, "reference", "chosen", -4.0)],
                                   "sample_id long, model string, side string, logp double")
    tokens = spark.createDataFrame([(1, m, s, p, l, [0.0, 0.0]) for m in S.MODELS for s in S.SIDES
                                    for p, l in ((0, 0), (1, 1), (2, -100))],
                                   "sample_id long, model string, side string, pos long, label int, logits array<double>")
    vocab = spark.createDataFrame([(0, "a"), (1, "b")], "token_id int, piece string")
    ref = S.reference_scores(scores, tokens, vocab)
    path = f"{tmp_dir}/ref"
    inputs = [scores, tokens]
    one, two = sorted(stored_once(ref, path, inputs).collect())
    assert (one.reference_chosen_logps, one.reference_rejected_logps) == (-2.0, -3.0)
    assert abs(one.reference_chosen_ppls - 2.0) < 1e-9 and one.reference_rejected_predictions_texts == "aa"
    assert (two.reference_chosen_logps, two.reference_chosen_ppls, two.reference_chosen_predictions_texts) == (-4.0, None, None)
    # Equal inputs in another order: what is there is used. Changed ones: computed anew.
    assert stored_once(ref.where("sample_id = 1"), path, [scores.repartition(3), tokens.orderBy("pos")]).count() == 2
    changed = scores.withColumn("logp", F.col("logp") - 1)
    again = stored_once(S.reference_scores(changed, tokens, vocab), path, [changed, tokens])
    assert sorted(r.reference_chosen_logps for r in again.collect()) == [-5.0, -3.0]
    assert stored_once(ref.limit(0), path, inputs).count() == 2  # the old inputs' rows are still there
    assert stored_once(ref.limit(0), path, [scores.unionByName(scores), tokens]).count() == 0  # repeated rows count


def test_unfinished_folder_is_written_again(spark, tmp_dir):
    import glob
    import os
    from dialectic.sources.sinks import stored_once
    df = spark.range(20).repartition(4)
    path = f"{tmp_dir}/x"
    assert stored_once(df, path, [df]).count() == 20
    for f in glob.glob(f"{path}/*/rows/part-*.parquet")[:1]:
        os.remove(f)  # a part got lost: the manifest's count no longer holds
    assert stored_once(df, path, [df]).count() == 20
    for f in glob.glob(f"{path}/*/manifest/*"):
        os.remove(f)  # broke off before the manifest
    assert stored_once(df.limit(7), path, [df]).count() == 7


def test_long_logits_equal_arrays(spark):
    import math
    inf, nan = float("inf"), float("nan")
    rows = {0: [0.5, 2.0, 2.0], 1: [900.0, 1500.0, -3000.0], 2: [-2000.0, -2000.0, -2001.0], 3: [-inf, 1.0, None],
            4: [-inf, -inf, -inf], 5: [511.9, 512.1, 100.0], 6: [nan, 1.0, 2.0], 7: [1e300, 1e300, 0.0]}
    long = spark.createDataFrame([(p // 2, p, 1 if p != 5 else -100, t, x) for p, xs in rows.items() for t, x in enumerate(xs)],
                                 "seq_id long, pos long, label int, token int, logit double").repartition(7)
    got = {r.pos: r for r in S.long_token_nll(long).collect()}

    def nll(xs, label):
        xs = [x for x in xs if x is not None]
        m = max(xs)
        return m + math.log(sum(math.exp(x - m) for x in xs)) - xs[label]

    for p in (0, 1, 2, 3):
        assert abs(got[p].nll - nll(rows[p], 1)) < 1e-9
    assert [got[p].pred_id for p in (0, 1, 2, 3, 5, 7)] == [1, 1, 0, 1, 1, 0]
    assert got[3].n_tokens == 2 and got[5].nll is None and math.isnan(got[6].nll)
    prob = {(r.pos, r.token): r.prob for r in S.long_softmax(long.where("pos in (0, 2, 5)")).collect()}
    for p in (0, 2, 5):
        m = max(rows[p])
        z = sum(math.exp(x - m) for x in rows[p])
        assert all(abs(prob[p, t] - math.exp(x - m) / z) < 1e-9 for t, x in enumerate(rows[p]))
    assert S.long_token_nll(long.limit(0)).count() == 0


def test_study_document_in_parts(spark):
    t = spark.createDataFrame([(0, None, None, "a"), (1, 2.0, {"lr": "9", "x": "1"}, "b"), (2, 2.0, {}, None), (7, 5.0, {"x": None}, "d")],
                              "number long, value double, params map<string,string>, wandb_run_id string")
    doc = {r.part: r for r in M.study_document(t, {"lr": "1", "y": "2"}, part_trials=3).collect()}
    assert sorted(doc) == [0, 2]
    assert [x.number for x in doc[0].all_trials] == [0, 1, 2] and [x.number for x in doc[2].all_trials] == [7]
    assert all((r.best_trial.number, r.best_trial.params) == (1, {"lr": "9", "x": "1", "y": "2"}) for r in doc.values())
    assert doc[0].all_trials[0].params == {"lr": "1", "y": "2"} and doc[0].all_trials[0].value == float("inf")
    assert doc[2].all_trials[0].params == {"lr": "1", "y": "2", "x": None}
    text = t.select("number", M.params_text(F.col("params")).alias("p")).where("number = 1").first().p
    assert text == "lr=9,x=1"
