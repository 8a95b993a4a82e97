"""Permutation, uniforms, Student-t tail, rolled-up summaries, sketches,
history offsets and the objective registry against independent results."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from prefspark.functions.special import permuted, student_t_tail, uniform
from prefspark.operators import objectives, prep, report


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 64, 1000, 4099])
def test_permutation_of_every_size(spark, n):
    got = spark.range(n).select("id", permuted(F.col("id"), F.lit(n), 7).alias("p"), permuted(F.col("id"), F.lit(n), 8).alias("q")).toPandas()
    assert sorted(got.p) == sorted(got.q) == list(range(n))
    if n >= 1000:  # shuffled, and differently for each seed
        assert abs(np.corrcoef(got.id, got.p)[0, 1]) < 0.1 and (got.p == got.q).mean() < 0.01
        assert abs((np.diff(got.sort_values("id").p) > 0).mean() - 0.5) < 0.05


def test_permutation_beyond_32_bits(spark):
    n = 10 ** 13 + 7
    got = spark.range(n - 2000, n).select(permuted(F.col("id"), F.lit(n), 3).alias("p")).toPandas().p
    assert got.is_unique and got.between(0, n - 1).all() and got.max() > n * 0.9 and got.min() < n * 0.1


def test_uniforms(spark):
    u = spark.range(5000).select(uniform(F.col("id"), 1).alias("u")).toPandas().u
    assert u.between(0, 1, inclusive="neither").all() and abs(u.mean() - 0.5) < 0.02 and abs(u.var() - 1 / 12) < 0.01


def _tail(t: float, nu: int) -> float:
    """Two-sided tail for whole degrees of freedom, by the finite sums."""
    theta = math.atan(abs(t) / math.sqrt(nu))
    s, c = math.sin(theta), math.cos(theta)
    if nu % 2:
        total, term = 0.0, c
        for k in range(1, nu - 1, 2):
            total, term = total + term, term * c * c * (k + 1) / (k + 2)
        return 1 - 2 / math.pi * (theta + s * total)
    total, term = 0.0, 1.0
    for k in range(0, nu - 1, 2):
        total, term = total + term, term * c * c * (k + 1) / (k + 2)
    return 1 - s * total


def test_student_t_tail(spark):
    cases = [(t, nu) for t in (0.0, 1e-3, 0.3, 1.0, 1.96, 2.5, 5.0, -2.0) for nu in (1, 2, 3, 4, 7, 30, 101, 1000, 20_001)]
    # known values of the distribution
    known = [(12.706204736174705, 1, 0.05), (2.2281388519862744, 10, 0.05), (2.7500, 30, 0.009999), (63.65674116287158, 1, 0.01)]
    df = spark.createDataFrame([(t, float(nu)) for t, nu in cases] + [(t, float(nu)) for t, nu, _ in known], "t double, nu double")
    got = [r[0] for r in df.select(student_t_tail(F.col("t"), F.col("nu"))).collect()]
    for (t, nu), p in zip(cases, got):
        assert p == pytest.approx(_tail(t, nu), abs=1e-9), (t, nu)
    for (*_, want), p in zip(known, got[len(cases):]):
        assert p == pytest.approx(want, abs=1e-6)
    big = spark.createDataFrame([(1.96, 1e6), (1.96, 1e9)], "t double, nu double").select(student_t_tail(F.col("t"), F.col("nu"))).collect()
    assert big[0][0] == pytest.approx(math.erfc(1.96 / math.sqrt(2)), abs=1e-6) and big[0][0] == big[1][0]


def test_summary_sets_merge_deviations(spark):
    """Large means, a null group, a group of one row and null rewards."""
    rng = np.random.default_rng(2)
    n = 600
    pdf = pd.DataFrame({"algorithm": rng.choice(["a", "b", None], n), "dataset": rng.choice(["x", "y"], n),
                        "reward_mean": 1e9 + rng.normal(0, 1, n), "duration_hours": rng.random(n), "sample_efficiency": 1.0, "memory_usage_gb": 2.0})
    pdf.loc[pdf.algorithm == "b", "reward_mean"] -= 1e9
    pdf = pd.concat([pdf, pd.DataFrame([{"algorithm": "one", "dataset": "x", "reward_mean": 3.0, "duration_hours": 1.0}])], ignore_index=True)
    df = spark.createDataFrame(pdf)
    out = report.summary_sets(df)
    got = {(r.level, r.algorithm or r.dataset): r for r in out.collect()}
    assert set(got) == {("overall", None), ("algorithm", "a"), ("algorithm", "b"), ("algorithm", "one"), ("dataset", "x"), ("dataset", "y")}
    assert got["overall", None].experiments == n + 1 and got["overall", None].n_algorithms == 3
    assert got["algorithm", "one"].reward_std is None
    for key, part in ((("algorithm", "a"), pdf[pdf.algorithm == "a"]), (("dataset", "y"), pdf[pdf.dataset == "y"]), (("overall", None), pdf)):
        assert got[key].reward_std == pytest.approx(part.reward_mean.std(), rel=1e-6)
        assert got[key].reward_mean == pytest.approx(part.reward_mean.mean(), rel=1e-12)
    assert report.summary_sets(df.limit(0)).count() == 0
    # the rows themselves are aggregated once; only cells are expanded
    plan = out._jdf.queryExecution().executedPlan().toString().splitlines()
    expand = [i for i, line in enumerate(plan) if "Expand" in line]
    assert not expand or "Generate" in "".join(plan[expand[-1]:])


def test_sketches_of_two_tables_merge(spark):
    df = spark.range(60_000).select((F.col("id") % 2).alias("g"), F.pmod(F.xxhash64("id"), F.lit(1_000_003)).cast("double").alias("v"))
    halves = [report.quantile_sketches(df.where(c), ["g"], "v") for c in ("v < 400000", "v >= 400000")]
    got = report.sketch_quantiles(halves[0].unionByName(halves[1]), ["g"], (0.1, 0.5, 0.99), ("a", "b", "c")).toPandas().set_index("g")
    pdf = df.toPandas()
    for g, part in pdf.groupby("g"):
        for name, q in (("a", 0.1), ("b", 0.5), ("c", 0.99)):
            assert abs((part.v <= got.loc[g, name]).mean() - q) < 0.01


def test_history_offsets_expand(spark):
    """Null texts, gaps in the numbering and a long conversation whose result
    stays linear."""
    rows = [(1, 0, "system", "be kind"), (1, 3, "user", "née\nx"), (1, 4, "assistant", "b"), (1, 9, "user", None), (1, 10, "assistant", "d"),
            (2, 0, "user", "q"), (2, 1, "assistant", "a"), (3, 0, "assistant", "alone")]
    rows += [(7, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(400)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    pairs = prep.conversation_pairs(turns)
    got = {(r.conv_id, r.turn): r for r in prep.with_history(pairs, prep.conversation_texts(turns)).collect()}
    for conv in (1, 2, 7):
        said = [r for r in rows if r[0] == conv]
        for i, r in enumerate(said[:-1]):
            if r[2] == "user" and said[i + 1][2] == "assistant":
                out = got.pop((conv, r[1]))
                assert out.history == "\n".join(x[3] for x in said[:i] if x[3] is not None)
                assert (out.prompt, out.response, out.history_turns) == (r[3], said[i + 1][3], i)
    assert not got
    size = pairs.where("conv_id = 7").select(F.sum(F.length("prompt") + F.length("response") + 24)).first()[0]
    assert size < 60 * 400


def test_objectives_by_name(spark):
    assert set(objectives.REGISTRY) == {"ppo", "grpo", "grpo_offpolicy", "grpo_vi", "rlaif", "dpo"}
    with pytest.raises(ValueError, match="unknown algorithm"):
        objectives.train_step("sarsa", spark.range(1))
    rows = [(1, s, p, t, [0.1 * p, 0.5, -0.2], [0.3, 0.1 * t, 0.2], 0) for s in ("chosen", "rejected") for p, t in ((0, 1), (1, 2), (2, 1))]
    pairs = spark.createDataFrame(rows, "pair_id long, side string, pos long, token_id int, policy_logits array<double>, reference_logits array<double>, step long")
    plain = objectives.train_step("dpo", pairs).first()
    fined = objectives.train_step(objectives.PairObjective(kl_penalty=0.5, entropy_penalty=0.25), pairs).first()
    assert fined.total_loss == pytest.approx(plain.total_loss + 0.5 * plain.kl_divergence - 0.25 * plain.entropy)
    lp = [np.array(r[4]) - np.log(np.exp(r[4]).sum()) for r in rows]
    assert plain.entropy == pytest.approx(np.mean([-(np.exp(x) * x).sum() for x in lp]))
