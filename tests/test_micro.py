"""Hand-computed micro cases (FIXTURES part C) and formula properties."""

import math

import pytest
from pyspark.sql import functions as F

from prefspark.functions import text as tx
from prefspark.functions import vec
from prefspark.operators import objectives as obj
from prefspark.operators import pairs, prep, report, runs, steps


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_w3_ties(spark):
    d = spark.createDataFrame([("p", i, f"r{i}", s) for i, s in enumerate([.5, .9, .9, .1, .1])],
                              "prompt string, resp_idx long, response string, score double")
    (r,) = pairs.preference_pairs(d).collect()
    assert (r.chosen, r.rejected) == ("r1", "r4")


def test_w3_all_equal_and_single(spark):
    d = spark.createDataFrame([("p", i, f"r{i}", .5) for i in range(3)] + [("q", 0, "only", .3)],
                              "prompt string, resp_idx long, response string, score double")
    out = {r.prompt: (r.chosen, r.rejected) for r in pairs.preference_pairs(d).collect()}
    assert out == {"p": ("r0", "r2")}


def test_f23_first_int(spark):
    d = spark.createDataFrame([("score 8/10",), ("none",), (None,)], "t string")
    assert [r[0] for r in d.select(tx.first_int_score("t")).collect()] == [.8, .5, .5]


def test_f24_helpfulness(spark):
    d = spark.createDataFrame([(" ".join(["w"] * 25),), (" ".join(["w"] * 80),), ("",)], "t string")
    got = [r[0] for r in d.select(tx.quality_metrics("t")["helpfulness"]).collect()]
    assert got == [.5, 1.0, 0.0]


def test_p1_length_filter(spark):
    texts = [" ".join(["w"] * n) for n in (9, 10, 512, 513)] + [None]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    assert sorted(r.id for r in prep.length_filter(d).collect()) == [1, 2, 4]


def test_a20_dedup_keeps_first(spark):
    d = spark.createDataFrame([(3, "a", "x"), (1, "a", "y"), (2, "b", "z")], "id long, text string, src string")
    assert sorted(rows(prep.dedup_first(d), "id", "src")) == [(1, "y"), (2, "z")]


def _tokens(spark, pol, ref, action=0, reward=1.0, target=None):
    return spark.createDataFrame(
        [(0, 0, action, pol, ref, target if target is not None else ref, reward)],
        "step long, pos long, action int, policy_logits array<double>, reference_logits array<double>, "
        "target_logits array<double>, reward double")


def test_f2_equal_logits_zero(spark):
    d = _tokens(spark, [1.0, 2.0, 3.0], [1.0, 2.0, 3.0])
    assert abs(d.select(vec.kl_divergence("policy_logits", "reference_logits")).first()[0]) < 1e-12


def test_softmax_sums_to_one_and_kl_nonnegative(spark):
    d = _tokens(spark, [0.3, -1.0, 2.5, 0.0], [1.0, 1.0, -2.0, 0.5])
    r = d.select(F.aggregate(vec.softmax("policy_logits"), F.lit(0.0), lambda a, x: a + x).alias("s"),
                 vec.kl_divergence("policy_logits", "reference_logits").alias("kl")).first()
    assert abs(r.s - 1) < 1e-12 and r.kl > 0


def test_f5_clipped_surrogate(spark):
    pol, ref = [math.log(3.0), 0.0], [0.0, 0.0]      # ratio of action 0 = 0.75 / 0.5 = 1.5
    g = obj.step_metrics(_tokens(spark, pol, ref, 0, 1.0), "ppo").first()
    assert abs(g.policy_loss - (-1.2)) < 1e-12
    g = obj.step_metrics(_tokens(spark, pol, ref, 0, -1.0), "ppo").first()
    assert abs(g.policy_loss - 1.5) < 1e-12


def test_ppo_ratio_one_is_minus_mean_reward(spark):
    g = obj.step_metrics(_tokens(spark, [0.1, 0.2], [0.1, 0.2], 1, 0.7), "ppo").first()
    assert abs(g.policy_loss + 0.7) < 1e-12 and g.clip_fraction == 0


def test_f6_weight_clamped(spark):
    pol = [10.0] + [0.0] * 19
    tgt = [0.0] * 20
    # log-prob gap at action 0 is about ln 20 = 3 -> exp(3) = 20 clamps at 10
    g = obj.step_metrics(_tokens(spark, pol, pol, 0, 1.0, tgt), "grpo_offpolicy").first()
    assert g.importance_weight == 10.0


def test_f9_f10(spark):
    d = spark.createDataFrame([(0.0, 20.0)], "m0 double, m20 double")
    r = d.select(obj.dpo_loss(F.col("m0"), 0.1, "sigmoid").alias("s"),
                 obj.dpo_loss(F.col("m20"), 0.1, "hinge").alias("h")).first()
    assert abs(r.s - math.log(2)) < 1e-12 and r.h == 0.0
    with pytest.raises(ValueError):
        obj.dpo_loss(F.col("m0"), 0.1, "kendall")


def test_f8_all_pad_is_null(spark):
    d = spark.createDataFrame(
        [(0, side, p, 0, [0.0, 1.0], [1.0, 0.0]) for side in ("chosen", "rejected") for p in range(3)],
        "pair_id long, side string, pos long, token_id int, policy_logits array<double>, "
        "reference_logits array<double>")
    r = obj.dpo_pair_table(d).first()
    assert r.chosen_logp is None and r.rejected_logp is None


def test_a15_no_predicted_positive(spark):
    d = spark.createDataFrame([(0, 1), (0, 0)], "prediction int, target int")
    r = report.classification_metrics(d).first()
    assert r.precision == 0.0 and r.f1 == 0.0 and r.accuracy == 0.5


def test_a22_balance(spark):
    d = spark.createDataFrame([("a", .7), ("a", .3), ("b", None), ("c", .1), ("c", .9)], "g string, weight double")
    got = {r.g: round(r.balance, 9) for r in pairs.objective_balance(d, ["g"]).collect()}
    assert got == {"a": 0.6, "b": 1.0, "c": 0.2}


def test_f26_weighted_reward(spark):
    d = spark.createDataFrame([(2.0,)], "r double")
    assert d.select(tx.weighted_reward("r", [.7, .3])).first()[0] == pytest.approx(1.0)


def test_a8_empty(spark):
    d = spark.createDataFrame([], "status string, duration double")
    r = report.benchmark_summary(d).first()
    assert r.total_experiments == 0 and r.success_rate == 0.0


def test_w1_w2(spark):
    d = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([1, 1, 2])],
                              "run_id long, step long, reward_mean double")
    flags = sorted(rows(steps.best_so_far(d), "step", "new_best"))
    assert flags == [(0, True), (1, False), (2, True)]
    e = spark.createDataFrame([(1, i, v) for i, v in enumerate([.1, .9, .5])],
                              "run_id long, step long, reward_mean double")
    assert sorted(r.step for r in steps.early_stop(e, .8).collect()) == [0, 1]


@pytest.mark.parametrize("name,legacy,expected", [
    ("ppo_hh_7b", False, ("ppo", "hh", "7b")),
    ("grpo_offpolicy_hh_7b", False, ("grpo_offpolicy", "hh", "7b")),
    ("grpo_offpolicy_hh_7b", True, ("grpo", "offpolicy", "hh")),
    ("ppo_experiment", False, ("unknown", "unknown", "unknown")),
    ("grpo_vix_hh_7b", False, ("grpo", "vix", "hh")),
    ("grpo_offpolicy_hh", False, ("unknown", "unknown", "unknown")),
])
def test_p6_parse(spark, name, legacy, expected):
    d = spark.createDataFrame([(name,)], "n string")
    r = d.select(runs.parse_run_name("n", legacy=legacy).alias("p")).first().p
    assert (r.algorithm, r.dataset, r.model_size) == expected


def test_nan_inf_absent_null(spark):
    d = spark.createDataFrame(
        [("ppo_hh_7b_a", {"reward_mean": float("nan")}), ("ppo_hh_7b_b", {"reward_mean": float("inf")}),
         ("ppo_hh_7b_c", {"other": 1.0}), ("ppo_hh_7b_d", {"reward_mean": None})],
        "experiment_name string, metrics map<string,double>")
    t = runs.clean_numeric(runs.results_projection(d, duration_hours=None))
    assert rows(t, "experiment_name", "reward_mean") == [("ppo_hh_7b_c", 0.0)]


def test_a1_single_row_std_null(spark):
    d = spark.createDataFrame([("a", 1.0)], "algorithm string, reward_mean double")
    assert report.reward_by(d, "algorithm").first().reward_std is None


def test_j1_grid(spark):
    a = spark.createDataFrame([(x,) for x in ["ppo", "dpo", "grpo", "grpo_offpolicy", "grpo_vi", "rlaif"]],
                              "algorithm string")
    d = spark.createDataFrame([(x,) for x in ["hh", "oasst", "ultrafeedback"]], "dataset string")
    s = spark.createDataFrame([("7b", 0)], "model_size string, epoch int")
    g = runs.experiment_grid(a, d, s)
    assert g.count() == 18 and "grpo_offpolicy_hh_7b_0" in {r.id for r in g.collect()}


def test_p8_p9_override_order(spark):
    base = spark.createDataFrame([("r", "training.batch_size", "4")], "run string, path string, value string")
    sized = runs.size_settings(spark.createDataFrame([("r", "7b")], "run string, model_size string"))
    assert sized.first().size_batch_size == 4
    over = spark.createDataFrame([("r", "training.batch_size", "2"), ("r", "new.key", "x")],
                                 "run string, path string, value string")
    out = dict(rows(runs.flatten_overrides(base, over), "path", "value"))
    assert out == {"training.batch_size": "2", "new.key": "x"}


def test_p7_missing_sections(spark):
    c = spark.createDataFrame([("ok", "model.checkpoint"), ("ok", "training.batch_size"),
                               ("bad", "training.batch_size")], "run string, path string")
    m = runs.missing_sections(c, ["model", "training"])
    assert rows(m, "run", "section") == [("bad", "model")]


def test_j8_resume(spark):
    g = spark.createDataFrame([("a",), ("b",)], "id string")
    st = spark.createDataFrame([("a", "completed"), ("b", "failed")], "id string, status string")
    assert rows(runs.resume(g, st), "id") == [("b",)]


def test_numpy_and_jvm_forms_agree(spark):
    import numpy as np
    rng = np.random.default_rng(2)
    rows = [(0, i, int(rng.integers(0, 8)), rng.normal(size=8).tolist(), rng.normal(size=8).tolist(),
             rng.normal(size=8).tolist(), 0.5) for i in range(20)]
    d = spark.createDataFrame(rows, "step long, pos long, action int, policy_logits array<double>, "
                                    "reference_logits array<double>, variational_logits array<double>, reward double")
    a = obj.with_token_metrics(d, variational="variational_logits", form="jvm").select("pos", "m.*").toPandas()
    b = obj.with_token_metrics(d, variational="variational_logits", form="numpy").select("pos", "m.*").toPandas()
    a, b = a.sort_values("pos"), b.sort_values("pos")
    for c in ("kl", "entropy", "logp", "logp_ref", "l2", "vi_kl", "abs_diff"):
        assert np.allclose(a[c].to_numpy(float), b[c].to_numpy(float)), c


def test_gae_matches_recursion(spark):
    import numpy as np
    r = [1.0, 0.5, -0.2, 2.0, 0.0]
    v = [0.3, 0.1, 0.4, 0.2, 0.5]
    d = spark.createDataFrame([(1, i, r[i], v[i]) for i in range(5)],
                              "run_id long, step long, reward_mean double, value double")
    got = {x.step: x.advantage for x in steps.gae(d).collect()}
    adv, nxt = [0.0] * 5, 0.0
    for t in range(4, -1, -1):
        vn = v[t + 1] if t + 1 < 5 else 0.0
        delta = r[t] + 0.99 * vn - v[t]
        nxt = delta + 0.99 * 0.95 * nxt
        adv[t] = nxt
    assert np.allclose([got[i] for i in range(5)], adv)


def test_grid_and_pairing_of_any_size(spark):
    a = spark.range(200).selectExpr("cast(id as string) as algorithm")
    d = spark.range(100).selectExpr("cast(id as string) as dataset")
    s = spark.range(100).selectExpr("cast(id as string) as model_size", "0 as epoch")
    assert runs.experiment_grid(a, d, s).count() == 2_000_000
    many = spark.range(50).selectExpr("cast(id as string) as g", "cast(id as double) as x")
    assert report.welch_tests(many, "g", "x").count() == 50 * 49 // 2


def test_missing_duration_is_zero_and_pivot_finds_all_datasets(spark):
    r = spark.createDataFrame([("ppo_hh_7b", None, {"reward_mean": 1.0})], "experiment_name string, duration_hours double, metrics map<string,double>")
    assert runs.results_projection(r).first().duration_hours == 0.0
    p = spark.createDataFrame([("a", "F", 1.0), ("a", "X", 3.0)], "algorithm string, dataset string, reward_mean double")
    assert report.pivot_mean(p, "algorithm", "dataset").columns == ["algorithm", "F", "X"]
    assert obj.objective("GRPO") is obj.GRPO


def test_placeholder_reward_and_argmax_predictions(spark):
    import numpy as np
    d = spark.range(4000).select(tx.compute_rewards(None, None, "id").alias("r"))
    r = np.array([x.r for x in d.collect()])
    assert abs(r.mean()) < 0.1 and abs(r.std() - 1) < 0.1
    again = [x.r for x in spark.range(4000).repartition(7).select(tx.compute_rewards(None, None, "id").alias("r"))
             .orderBy("r").collect()]
    assert np.allclose(sorted(r), again)
    v = spark.createDataFrame([([0.1, 0.9], 1), ([0.8, 0.2], 1)], "prediction array<double>, target int")
    m = report.classification_metrics(v).first()
    assert m.accuracy == 0.5 and m.precision == 1.0 and m.recall == 0.5


def test_x4_unknown_algorithm(spark):
    with pytest.raises(ValueError):
        obj.step_metrics(_tokens(spark, [0.1, 0.2], [0.1, 0.2]), "trpo")
    assert obj.objective(None) is obj.PPO


def test_numpy_form_judges_each_row_alone(spark):
    rows = [(0, [0.1, 0.2, 0.3], [0.3, 0.1, 0.2], 1, [0.5, 0.1, 0.0]), (1, [0.4, 0.2, 0.1], [0.3, 0.1, 0.2], 7, None),
            (2, [0.4, 0.2, 0.1], [0.3, 0.1, 0.2], None, [0.2, 0.2, 0.2]), (3, [0.4, 0.2], [0.3, 0.1], 0, [0.1, 0.2]),
            (4, None, None, 0, None)]
    d = spark.createDataFrame(rows, "i int, p array<double>, q array<double>, a int, v array<double>").coalesce(1)
    from prefspark.functions import vec
    args = ("p", "q", "a", "v", "v")
    one, two = (d.select("i", f(*args).alias("m")).select("i", "m.*").orderBy("i").collect()
                for f in (vec.token_metrics, vec.token_metrics_numpy))
    for x, y in zip(one, two):
        for k in vec.TOKEN_FIELDS:
            if x.i < 4:
                assert (x[k] is None) == (y[k] is None) and (x[k] is None or abs(x[k] - y[k]) < 1e-12), (x.i, k)
            else:
                assert y[k] is None


def test_null_names_only_count_overall(spark):
    from prefspark.operators import report
    d = spark.createDataFrame([("a", "x", 1.0), (None, "x", 3.0), ("a", None, 5.0)],
                              "algorithm string, dataset string, reward_mean double")
    for c in ("duration_hours", "sample_efficiency", "memory_usage_gb"):
        d = d.withColumn(c, F.lit(0.0))
    got = {(r.level, r.algorithm, r.dataset): r.experiments for r in report.summary_sets(d).collect()}
    assert got == {("overall", None, None): 3, ("algorithm", "a", None): 2, ("dataset", None, "x"): 2}
    assert [r.asDict() for r in report.pivot_mean(d, "algorithm", "dataset").collect()] == [{"algorithm": "a", "x": 1.0}]


def test_ensemble_mean_logits(spark):
    d = spark.createDataFrame([(0, 0, [1.0, 2.0]), (0, 1, [3.0, 6.0])], "pos int, pass int, logits array<double>")
    r = obj.variational_uncertainty(d).first()
    assert r.mean_logits == [2.0, 4.0] and r.uncertainty == 5.0 and r.vocab == 2


def test_dpo_applies_its_entropy_penalty(spark):
    from prefspark.operators import objectives
    pair = spark.createDataFrame([(0, 0.5, 0.25, 2.0, 2, 1.0, 2, 3.0)], "step long, chosen_log_ratio double, rejected_log_ratio double, "
                                 "kl_chosen_sum double, n_chosen long, kl_rejected_sum double, n_rejected long, entropy_sum double")
    plain, fined = (objectives.dpo_step_metrics(pair, entropy_penalty=c).first() for c in (0.0, 0.2))
    assert plain.entropy == 0.75 and abs(plain.total_loss - fined.total_loss - 0.2 * 0.75) < 1e-12
