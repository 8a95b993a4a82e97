"""Checked queries: step-log analytics, trajectories and replay (S7, S9, P10,
P11, P18, W1, W2, W4-W10, W15-W17, A11, A29, A30, A32, U2, F29)."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefspark.functions.special import permuted_sql, uniform_sql
from prefspark.operators import report
from prefspark.operators import steps as st
from prefspark.plans import views as V
from prefspark.plans.registry import register
from prefspark.plans.views import with_views


def _r(expr: str, name: str) -> str:
    return f"round({expr}, 6) AS {name}"


def ssql(body: str, view: str = "v_steps") -> str:
    return with_views(body, view)


def steps(spark, sf, **kw):
    return V.v_steps(spark, sf, **kw)


# ------------------------------------------------------------------ W1
@register("w1_best_so_far", ssql(f"""
WITH p AS (SELECT *, max(reward_mean) OVER (PARTITION BY run_id ORDER BY step
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM v_steps)
SELECT run_id, step, {_r("greatest(coalesce(prev, '-inf'::DOUBLE), reward_mean)", 'best_so_far')},
       reward_mean > coalesce(prev, '-inf'::DOUBLE) AS new_best FROM p"""))
def w1_best_so_far(spark, sf):
    return st.best_so_far(steps(spark, sf)).select("run_id", "step", "best_so_far", "new_best")


# ------------------------------------------------------------------ W2
@register("w2_early_stop", ssql("""
WITH p AS (SELECT *, max(CASE WHEN reward_mean > 200 THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY step
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hit FROM v_steps)
SELECT run_id, step FROM p WHERE coalesce(hit, 0) = 0"""))
def w2_early_stop(spark, sf):
    return st.early_stop(steps(spark, sf), 200.0).select("run_id", "step")


# ------------------------------------------------------------------ P10
@register("p10_periodic_sampling", ssql("""
SELECT run_id, step, 'trainer' AS counter FROM v_steps WHERE (step + 1) % 10 = 0
UNION ALL SELECT run_id, step, 'runner' AS counter FROM v_steps WHERE step % 10 = 0"""))
def p10_periodic_sampling(spark, sf):
    s = steps(spark, sf).select("run_id", "step")
    return (st.periodic(s, 10, base=1).withColumn("counter", F.lit("trainer"))
            .unionByName(st.periodic(s, 10, base=0).withColumn("counter", F.lit("runner"))))


# ------------------------------------------------------------------ P11
@register("p11_cap_steps", ssql("SELECT run_id, step FROM v_steps WHERE step < 50"))
def p11_cap_steps(spark, sf):
    return st.cap_steps(steps(spark, sf), 50).select("run_id", "step")


# ------------------------------------------------------------------ W6
@register("w6_target_refresh", ssql("""
SELECT run_id, step, CAST(step % 10 = 0 AS INTEGER) AS target_update,
       CAST(sum(CAST(step % 10 = 0 AS INTEGER)) OVER (PARTITION BY run_id ORDER BY step
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS refresh_count FROM v_steps"""))
def w6_target_refresh(spark, sf):
    return st.target_refresh(steps(spark, sf), 10).select("run_id", "step", "target_update", "refresh_count")


# ------------------------------------------------------------------ W17
@register("w17_keep_checkpoints", ssql("""
WITH c AS (SELECT * FROM v_steps WHERE step % 10 = 0)
SELECT run_id, step, 'latest' AS rule FROM c QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY step DESC) <= 3
UNION ALL
SELECT run_id, step, 'best' AS rule FROM c
QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY reward_mean DESC, step DESC) <= 3"""))
def w17_keep_checkpoints(spark, sf):
    s = steps(spark, sf)
    a = st.keep_checkpoints(s, 3, 10).select("run_id", "step").withColumn("rule", F.lit("latest"))
    b = st.keep_checkpoints(s, 3, 10, best_only=True).select("run_id", "step").withColumn("rule", F.lit("best"))
    return a.unionByName(b)


# ------------------------------------------------------------------ A29
@register("a29_sample_efficiency", ssql("""
WITH c AS (SELECT *, sum(tokens) OVER (PARTITION BY run_id ORDER BY step
                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM v_steps_tok)
SELECT run_id, min(CASE WHEN reward_mean >= 200 THEN cum END) AS tokens_to_threshold,
       CAST(min(CASE WHEN reward_mean >= 200 THEN step END) AS DOUBLE) AS first_step FROM c GROUP BY run_id""", "v_steps_tok"))
def a29_sample_efficiency(spark, sf):
    e = st.sample_efficiency(steps(spark, sf, with_tokens=True), 200.0, tokens="tokens")
    return e.withColumn("first_step", F.col("first_step").cast("double"))


# ------------------------------------------------------------------ A30
@register("a30_convergence", ssql(f"""
WITH l AS (SELECT run_id, max(step) AS last, regr_slope(reward_mean, step) AS convergence_rate
           FROM v_steps GROUP BY run_id),
t AS (SELECT s.run_id, 1.0 / (1.0 + stddev_samp(reward_mean) / nullif(abs(avg(reward_mean)), 0)) AS stability
      FROM v_steps s JOIN l USING (run_id) WHERE step >= 0.8 * last GROUP BY s.run_id)
SELECT run_id, {_r('convergence_rate', 'convergence_rate')}, {_r('stability', 'stability')}
FROM l JOIN t USING (run_id)"""))
def a30_convergence(spark, sf):
    return st.convergence(steps(spark, sf))


# ------------------------------------------------------------------ A32
@register("a32_metric_windows", ssql(f"""
SELECT run_id, CAST(epoch(time_bucket(INTERVAL '5 minutes', ts)) AS BIGINT) AS window_start,
       {_r('avg(reward_mean)', 'mean_value')}, {_r('max(reward_mean)', 'max_value')}
FROM v_steps GROUP BY ALL"""))
def a32_metric_windows(spark, sf):
    w = st.metric_windows(steps(spark, sf), "ts", "reward_mean")
    return w.withColumn("window_start", F.unix_micros(F.col("window_start").cast("timestamp")) / 1000000) \
            .withColumn("window_start", F.col("window_start").cast("bigint"))


# ------------------------------------------------------------------ P18
@register("p18_scale_clip", ssql(f"""
SELECT run_id, step, {_r('greatest(-10.0, least(10.0, 0.1 * reward_mean))', 'reward')} FROM v_steps"""))
def p18_scale_clip(spark, sf):
    s = steps(spark, sf)
    return s.select("run_id", "step", st.scale_clip("reward_mean", 0.1).alias("reward"))


# ------------------------------------------------------------------ S7
@register("s7_melt_metrics", ssql(f"""
SELECT run_id, step, 'reward_mean' AS metric, {_r('reward_mean', 'value')} FROM v_steps
UNION ALL
SELECT run_id, step, 'reward_clipped' AS metric, {_r('greatest(-10.0, least(10.0, 0.1 * reward_mean))', 'value')}
FROM v_steps"""))
def s7_melt_metrics(spark, sf):
    s = steps(spark, sf).withColumn("reward_clipped", st.scale_clip("reward_mean", 0.1))
    return st.melt_metrics(s, ["run_id", "step"], ["reward_mean", "reward_clipped"])


# ------------------------------------------------------------------ S9
@register("s9_batches", with_views("""
SELECT id, CAST(row_number() OVER (ORDER BY id) - 1 AS BIGINT) AS idx,
       CAST(floor((row_number() OVER (ORDER BY id) - 1) / 4) AS BIGINT) AS batch_id FROM v_samples""", "v_samples"))
def s9_batches(spark, sf):
    s = V.v_samples(spark, sf).select("id")
    return st.batches(s, 4, "id")


@register("s9_batches_shuffled", with_views(f"""
WITH i AS (SELECT id, CAST(row_number() OVER (ORDER BY id) - 1 AS BIGINT) AS place, count(*) OVER () AS n FROM v_samples),
p AS (SELECT id, {permuted_sql('place', 'n', 7)} AS idx FROM i)
SELECT id, idx, idx // 4 AS batch_id FROM p""", "v_samples"))
def s9_batches_shuffled(spark, sf):
    """Shuffled batches by a keyed permutation of the positions."""
    s = V.v_samples(spark, sf).select("id")
    return st.batches(s, 4, "id", shuffle_seed=7)


# ------------------------------------------------------------------ A11
@register("a11_eval_average", ssql(f"""
WITH b AS (SELECT run_id, phase, avg(reward_mean) AS m FROM v_steps GROUP BY run_id, phase)
SELECT run_id, {_r('avg(m)', 'reward_mean')} FROM b GROUP BY run_id"""))
def a11_eval_average(spark, sf):
    return report.eval_average(steps(spark, sf), "run_id", "phase", ["reward_mean"])


# ------------------------------------------------------------------ W4
@register("w4_replay_buffer", ssql("""
SELECT run_id, step FROM v_steps QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY step DESC) <= 50"""))
def w4_replay_buffer(spark, sf):
    return st.replay_buffer(steps(spark, sf), 50).select("run_id", "step")


PERM = "(event_id * 7919) % 10007"


# ------------------------------------------------------------------ W5
@register("w5_replay_sample", ssql(f"""
SELECT run_id, step FROM v_steps
QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY {PERM}, event_id) <= 20"""))
def w5_replay_sample(spark, sf):
    """Uniform sample with a caller-given key (a fixed permutation of ids)."""
    s = steps(spark, sf)
    return st.replay_sample(s, 20, key=(F.col("event_id") * 7919) % 10007).select("run_id", "step")


@register("w5_replay_sample_hash", ssql(f"""
SELECT run_id, event_id FROM v_steps
QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY {uniform_sql('event_id')}, event_id) <= 20"""))
def w5_replay_sample_hash(spark, sf):
    """Uniform sample by the default key, a hash of the id."""
    return st.replay_sample(steps(spark, sf), 20).select("run_id", "event_id")


# ------------------------------------------------------------------ W15
@register("w15_prioritized_sample", ssql(f"""
SELECT run_id, event_id FROM v_steps
QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY -ln({uniform_sql('event_id')}) / power(abs(reward_mean) + 1e-6, 0.6), event_id) <= 20"""))
def w15_prioritized_sample(spark, sf):
    """Priority^0.6-weighted sample without replacement."""
    s = steps(spark, sf)
    return st.prioritized_sample(s, 20, F.abs(F.col("reward_mean")) + F.lit(1e-6)).select("run_id", "event_id")


# ------------------------------------------------------------------ U2
@register("u2_stack_replay", ssql(f"""
SELECT run_id, step, 'fifo' AS source FROM v_steps
QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY step DESC) <= 50
UNION ALL
SELECT run_id, step, 'uniform' AS source FROM v_steps
QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY {PERM}, event_id) <= 20"""))
def u2_stack_replay(spark, sf):
    s = steps(spark, sf)
    a = st.replay_buffer(s, 50).select("run_id", "step").withColumn("source", F.lit("fifo"))
    b = (st.replay_sample(s, 20, key=(F.col("event_id") * 7919) % 10007).select("run_id", "step")
         .withColumn("source", F.lit("uniform")))
    return a.unionByName(b)


# ------------------------------------------------------------------ W7
@register("w7_discounted_returns", ssql(f"""
SELECT a.run_id, a.step, {_r('sum(power(0.99, b.step - a.step) * b.reward_mean)', 'return')}
FROM v_steps a JOIN v_steps b ON a.run_id = b.run_id AND b.step >= a.step GROUP BY a.run_id, a.step"""))
def w7_discounted_returns(spark, sf):
    return st.discounted_returns(steps(spark, sf)).select("run_id", "step", "return")


# ------------------------------------------------------------------ W8
@register("w8_gae", ssql(f"""
WITH d AS (SELECT run_id, step, reward_mean + 0.99 * coalesce(lead(0.5 * reward_mean) OVER (PARTITION BY run_id ORDER BY step), 0)
                  - 0.5 * reward_mean AS delta FROM v_steps)
SELECT a.run_id, a.step, {_r('sum(power(0.99 * 0.95, b.step - a.step) * b.delta)', 'advantage')}
FROM d a JOIN d b ON a.run_id = b.run_id AND b.step >= a.step GROUP BY a.run_id, a.step"""))
def w8_gae(spark, sf):
    """Critic value = half the step reward (derived from the log)."""
    s = steps(spark, sf).withColumn("value", F.lit(0.5) * F.col("reward_mean"))
    return st.gae(s).select("run_id", "step", "advantage")


# ------------------------------------------------------------------ W9
@register("w9_moving_baseline", ssql(f"""
WITH b AS (SELECT *, avg(reward_mean) OVER (PARTITION BY run_id ORDER BY step
                     ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING) AS baseline FROM v_steps)
SELECT run_id, step, {_r('baseline', 'baseline')}, {_r('reward_mean - baseline', 'advantage')} FROM b"""))
def w9_moving_baseline(spark, sf):
    return st.moving_baseline(steps(spark, sf)).select("run_id", "step", "baseline", "advantage")


# ------------------------------------------------------------------ W10
@register("w10_reward_normalization", ssql(f"""
WITH s AS (SELECT run_id, avg(reward_mean) AS mu, stddev_samp(reward_mean) AS sd FROM v_steps GROUP BY run_id),
g AS (SELECT phase, avg(reward_mean) AS gmu, stddev_samp(reward_mean) AS gsd FROM v_steps GROUP BY phase)
SELECT run_id, step, {_r('(reward_mean - mu) / (coalesce(sd, 0) + 1e-8)', 'normalized')},
       {_r('0.5 * ((reward_mean - gmu) / (coalesce(gsd, 0) + 1e-8)) + 0.5 * reward_mean', 'mixed_advantage')}
FROM v_steps JOIN s USING (run_id) JOIN g USING (phase)"""))
def w10_reward_normalization(spark, sf):
    s = st.zscore(steps(spark, sf), ["run_id"])
    return st.group_relative(s, ["phase"]).select("run_id", "step", "normalized", "mixed_advantage")


# ------------------------------------------------------------------ W16
@register("w16_smoothed_weights", ssql(f"""
WITH b AS (SELECT run_id, CAST(floor(step / 10) AS BIGINT) AS bucket, avg(reward_mean) AS bucket_mean
           FROM v_steps GROUP BY ALL)
SELECT a.run_id, a.bucket, {_r('a.bucket_mean', 'bucket_mean')},
       {_r('sum(0.1 * power(0.9, a.bucket - c.bucket) * c.bucket_mean) + power(0.9, a.bucket + 1) * 0.5', 'weight')}
FROM b a JOIN b c ON a.run_id = c.run_id AND c.bucket <= a.bucket GROUP BY a.run_id, a.bucket, a.bucket_mean"""))
def w16_smoothed_weights(spark, sf):
    return st.smoothed_weights(steps(spark, sf), every=10).select("run_id", "bucket", "bucket_mean", "weight")


# ------------------------------------------------------------------ F29
@register("f29_adaptive_kl", ssql(f"""
WITH k AS (SELECT *, reward_mean / 10000 AS kl,
                  CASE WHEN reward_mean / 10000 > 0.015 THEN ln(1.5)
                       WHEN reward_mean / 10000 < 0.01 / 1.5 THEN -ln(1.5) ELSE 0 END AS inc FROM v_steps),
c AS (SELECT *, coalesce(sum(inc) OVER (PARTITION BY run_id ORDER BY step
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k)
SELECT run_id, step, {_r('0.2 * exp(before)', 'kl_coef')} FROM c"""))
def f29_adaptive_kl(spark, sf):
    """KL read from the log as reward / 10000."""
    s = steps(spark, sf).withColumn("kl", F.col("reward_mean") / 10000)
    return st.adaptive_kl(s).select("run_id", "step", "kl_coef")
