"""Checked queries: results table, reports, outcomes, grid (P3-P6, P12, P19,
P21, A1-A10, A15, A16, A19, A21, A24-A28, A31, K3-K5, W11, W12, J1, J8, J9,
U1, F27, F28, X5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefspark.functions.special import student_t_tail_sql
from prefspark.operators import report, runs
from prefspark.operators.pareto import pareto_front
from prefspark.plans import views as V
from prefspark.plans.registry import register
from prefspark.plans.views import with_views


def _r(expr: str, name: str) -> str:
    return f"round({expr}, 6) AS {name}"


def results(spark, sf, clean: bool = True):
    """v_runs as the 17-column results table (metrics through a map, so absent
    keys read 0), cleaned of NaN/inf."""
    r = V.v_runs(spark, sf)
    m = F.create_map(F.lit("reward_mean"), F.col("reward_mean"), F.lit("kl_divergence"), F.col("kl_divergence"),
                     F.lit("entropy"), F.col("entropy"), F.lit("total_steps"), F.col("total_steps").cast("double"))
    t = runs.results_projection(r.withColumn("metrics", m))
    return runs.clean_numeric(t) if clean else t


PARSE_SQL = """CASE WHEN starts_with(experiment_name, 'grpo_offpolicy_') THEN 'grpo_offpolicy'
            WHEN starts_with(experiment_name, 'grpo_vi_') THEN 'grpo_vi'
            WHEN starts_with(experiment_name, 'rlaif_') THEN 'rlaif'
            WHEN starts_with(experiment_name, 'grpo_') THEN 'grpo'
            WHEN starts_with(experiment_name, 'ppo_') THEN 'ppo'
            WHEN starts_with(experiment_name, 'dpo_') THEN 'dpo'
            ELSE split_part(experiment_name, '_', 1) END"""

RESULTS_SQL = f"""WITH rn AS (SELECT *, {PARSE_SQL} AS algo_p FROM v_runs),
rs AS (SELECT *, string_split(substr(experiment_name, length(algo_p) + 2), '_') AS rest FROM rn),
results AS (
SELECT experiment_name,
       CASE WHEN len(rest) >= 2 THEN algo_p ELSE 'unknown' END AS algorithm,
       CASE WHEN len(rest) >= 2 THEN rest[1] ELSE 'unknown' END AS dataset,
       CASE WHEN len(rest) >= 2 THEN rest[2] ELSE 'unknown' END AS model_size,
       CAST(duration_hours AS DOUBLE) AS duration_hours, reward_mean, CAST(0 AS DOUBLE) AS reward_std,
       kl_divergence, entropy, CAST(0 AS DOUBLE) AS policy_loss, CAST(0 AS DOUBLE) AS value_loss,
       CAST(0 AS DOUBLE) AS clip_fraction, CAST(0 AS DOUBLE) AS best_reward, CAST(total_steps AS BIGINT) AS total_steps,
       CAST(0 AS DOUBLE) AS sample_efficiency, CAST(0 AS DOUBLE) AS memory_usage_gb, CAST(0 AS DOUBLE) AS gpu_efficiency
FROM rs WHERE reward_mean IS NOT NULL AND NOT isnan(reward_mean) AND NOT isinf(reward_mean))"""


def rsql(body: str) -> str:
    return with_views(f"{RESULTS_SQL}\n{body}", "v_runs")


# ------------------------------------------------------------------ P5 / P4
@register("p5_results_projection", rsql("""
SELECT experiment_name, algorithm, dataset, model_size, round(duration_hours, 6) AS duration_hours,
       round(reward_mean, 6) AS reward_mean, reward_std, round(kl_divergence, 6) AS kl_divergence,
       round(entropy, 6) AS entropy, policy_loss, value_loss, clip_fraction, best_reward, total_steps,
       sample_efficiency, memory_usage_gb, gpu_efficiency FROM results"""))
def p5_results_projection(spark, sf):
    return results(spark, sf)


@register("p4_clean_metrics", rsql("""
SELECT algorithm, count(*) AS n, count(reward_mean) AS n_reward FROM results GROUP BY algorithm"""))
def p4_clean_metrics(spark, sf):
    t = results(spark, sf)
    return t.groupBy("algorithm").agg(F.count(F.lit(1)).alias("n"), F.count("reward_mean").alias("n_reward"))


# ------------------------------------------------------------------ P6
NAMED = """SELECT concat_ws('_', CASE algorithm WHEN 'A' THEN 'grpo_offpolicy' WHEN 'R' THEN 'grpo_vi' ELSE 'ppo' END,
       dataset, model_size) AS experiment_name FROM v_runs"""


@register("p6_parse_run_name", with_views(f"""
WITH named AS ({NAMED}),
rn AS (SELECT *, {PARSE_SQL} AS algo_p FROM named),
rs AS (SELECT *, string_split(substr(experiment_name, length(algo_p) + 2), '_') AS rest FROM rn)
SELECT experiment_name,
       CASE WHEN len(rest) >= 2 THEN algo_p ELSE 'unknown' END AS algorithm,
       CASE WHEN len(rest) >= 2 THEN rest[1] ELSE 'unknown' END AS dataset,
       CASE WHEN len(rest) >= 2 THEN rest[2] ELSE 'unknown' END AS model_size,
       CASE WHEN len(string_split(experiment_name, '_')) >= 3 THEN split_part(experiment_name, '_', 1) ELSE 'unknown' END AS legacy_algorithm,
       CASE WHEN len(string_split(experiment_name, '_')) >= 3 THEN split_part(experiment_name, '_', 2) ELSE 'unknown' END AS legacy_dataset
FROM rs""", "v_runs"))
def p6_parse_run_name(spark, sf):
    r = V.v_runs(spark, sf)
    algo = (F.when(F.col("algorithm") == "A", "grpo_offpolicy").when(F.col("algorithm") == "R", "grpo_vi")
             .otherwise("ppo"))
    n = r.select(F.concat_ws("_", algo, "dataset", "model_size").alias("experiment_name"))
    p = runs.parse_run_name("experiment_name")
    lg = runs.parse_run_name("experiment_name", legacy=True)
    return n.select("experiment_name", p["algorithm"].alias("algorithm"), p["dataset"].alias("dataset"),
                    p["model_size"].alias("model_size"), lg["algorithm"].alias("legacy_algorithm"),
                    lg["dataset"].alias("legacy_dataset"))


# ------------------------------------------------------------------ P3 / Q22
@register("p3_compare_select", rsql("""
SELECT experiment_name, algorithm, round(reward_mean, 6) AS reward_mean, round(kl_divergence, 6) AS kl_divergence
FROM results WHERE algorithm IN ('A', 'R')"""))
def p3_compare_select(spark, sf):
    t = results(spark, sf)
    return t.filter(F.col("algorithm").isin("A", "R")).select("experiment_name", "algorithm", "reward_mean",
                                                             "kl_divergence")


# ------------------------------------------------------------------ A1
@register("a1_reward_by_algorithm", rsql(f"""
SELECT algorithm, {_r('avg(reward_mean)', 'reward_mean')}, {_r('stddev_samp(reward_mean)', 'reward_std')}
FROM results WHERE algorithm IS NOT NULL GROUP BY algorithm"""))
def a1_reward_by_algorithm(spark, sf):
    return report.reward_by(results(spark, sf), "algorithm")


A2_COLS = ["duration_hours", "sample_efficiency", "kl_divergence", "memory_usage_gb", "gpu_efficiency"]


# ------------------------------------------------------------------ A2
@register("a2_means_by_algorithm", rsql(f"""
SELECT algorithm, {', '.join(_r(f'avg({c})', f'mean_{c}') for c in A2_COLS)}
FROM results WHERE algorithm IS NOT NULL GROUP BY algorithm"""))
def a2_means_by_algorithm(spark, sf):
    return report.means_by(results(spark, sf), "algorithm", A2_COLS)


# ------------------------------------------------------------------ A3
@register("a3_by_dataset", rsql(f"""
SELECT dataset, {_r('avg(reward_mean)', 'reward_mean')}, {_r('stddev_samp(reward_mean)', 'reward_std')},
       {_r('avg(duration_hours)', 'mean_duration_hours')}, {_r('avg(sample_efficiency)', 'mean_sample_efficiency')}
FROM results WHERE dataset IS NOT NULL GROUP BY dataset"""))
def a3_by_dataset(spark, sf):
    t = results(spark, sf)
    a = report.reward_by(t, "dataset")
    b = report.means_by(t, "dataset", ["duration_hours", "sample_efficiency"])
    return a.join(b, "dataset")


# ------------------------------------------------------------------ A4
@register("a4_pivot_reward", rsql(f"""
SELECT algorithm, {_r("avg(CASE WHEN dataset = 'F' THEN reward_mean END)", 'F')},
       {_r("avg(CASE WHEN dataset = 'O' THEN reward_mean END)", 'O')}
FROM results GROUP BY algorithm"""))
def a4_pivot_reward(spark, sf):
    return report.pivot_mean(results(spark, sf), "algorithm", "dataset")


# ------------------------------------------------------------------ A5 / A6 / A7
@register("a5_a7_summary_sets", rsql(f"""
SELECT CASE grouping(algorithm, dataset) WHEN 3 THEN 'overall' WHEN 1 THEN 'algorithm' ELSE 'dataset' END AS level,
       algorithm, dataset, count(*) AS experiments, count(DISTINCT algorithm) AS n_algorithms,
       count(DISTINCT dataset) AS n_datasets, {_r('coalesce(sum(duration_hours), 0)', 'total_hours')},
       {_r('avg(reward_mean)', 'reward_mean')}, {_r('stddev_samp(reward_mean)', 'reward_std')},
       {_r('max(reward_mean)', 'reward_max')}, {_r('min(reward_mean)', 'reward_min')},
       {_r('avg(duration_hours)', 'mean_hours')}, {_r('avg(sample_efficiency)', 'mean_sample_efficiency')},
       {_r('avg(memory_usage_gb)', 'mean_memory_usage_gb')}
FROM results GROUP BY GROUPING SETS ((), (algorithm), (dataset))"""))
def a5_a7_summary_sets(spark, sf):
    return report.summary_sets(results(spark, sf))


# ------------------------------------------------------------------ A16
@register("a16_trend_lines", rsql(f"""
, fit AS (SELECT algorithm, regr_slope(reward_mean, duration_hours) AS slope,
                 regr_intercept(reward_mean, duration_hours) AS intercept FROM results
          GROUP BY algorithm HAVING count(*) > 1)
SELECT experiment_name, r.algorithm, {_r('slope', 'slope')}, {_r('intercept', 'intercept')},
       {_r('intercept + slope * duration_hours', 'fitted')}
FROM results r JOIN fit ON r.algorithm = fit.algorithm"""))
def a16_trend_lines(spark, sf):
    t = report.trend_lines(results(spark, sf), "algorithm", "reward_mean", "duration_hours")
    return t.select("experiment_name", "algorithm", "slope", "intercept", "fitted")


# ------------------------------------------------------------------ A19 / K3
@register("a19_distinct_lists", rsql(f"""
SELECT string_agg(DISTINCT algorithm, ',' ORDER BY algorithm) AS algorithms,
       string_agg(DISTINCT dataset, ',' ORDER BY dataset) AS datasets,
       {_r('max(reward_mean)', 'best_reward')}, {_r('sum(duration_hours)', 'total_hours')}
FROM results"""))
def a19_distinct_lists(spark, sf):
    t = results(spark, sf)
    return t.agg(F.concat_ws(",", F.array_sort(F.collect_set("algorithm"))).alias("algorithms"),
                 F.concat_ws(",", F.array_sort(F.collect_set("dataset"))).alias("datasets"),
                 F.max("reward_mean").alias("best_reward"), F.sum("duration_hours").alias("total_hours"))


@register("k3_best_worst", rsql(f"""
SELECT arg_min(experiment_name, (-reward_mean, experiment_name)) AS best_experiment,
       {_r('max(reward_mean)', 'best_value')},
       arg_min(experiment_name, (reward_mean, experiment_name)) AS worst_experiment,
       {_r('min(reward_mean)', 'worst_value')}
FROM results"""))
def k3_best_worst(spark, sf):
    return report.best_worst(results(spark, sf), "experiment_name", "reward_mean")


# ------------------------------------------------------------------ A24
@register("a24_quartiles", rsql(f"""
SELECT algorithm, {_r('quantile_cont(reward_mean, 0.25)', 'q1')}, {_r('quantile_cont(reward_mean, 0.5)', 'median')},
       {_r('quantile_cont(reward_mean, 0.75)', 'q3')} FROM results GROUP BY algorithm"""))
def a24_quartiles(spark, sf):
    return report.quartiles(results(spark, sf), "algorithm", "reward_mean")


# ------------------------------------------------------------------ A25
@register("a25_confidence_interval", rsql(f"""
SELECT algorithm, {_r('avg(reward_mean)', 'mean')},
       {_r('avg(reward_mean) - 1.959963984540054 * stddev_samp(reward_mean) / sqrt(count(reward_mean))', 'ci_low')},
       {_r('avg(reward_mean) + 1.959963984540054 * stddev_samp(reward_mean) / sqrt(count(reward_mean))', 'ci_high')},
       count(reward_mean) AS n FROM results GROUP BY algorithm"""))
def a25_confidence_interval(spark, sf):
    return report.confidence_interval(results(spark, sf), "algorithm", "reward_mean")


# ------------------------------------------------------------------ A26
@register("a26_welch_t", rsql(f"""
, st AS (SELECT algorithm, count(reward_mean) AS n, avg(reward_mean) AS m, var_samp(reward_mean) AS v
         FROM results GROUP BY algorithm),
w AS (SELECT a.algorithm AS group_a, b.algorithm AS group_b, (a.m - b.m) / sqrt(a.v / a.n + b.v / b.n) AS t,
  power(a.v / a.n + b.v / b.n, 2) / (power(a.v / a.n, 2) / (a.n - 1) + power(b.v / b.n, 2) / (b.n - 1)) AS nu
  FROM st a JOIN st b ON a.algorithm < b.algorithm),
p AS (SELECT *, {student_t_tail_sql('t', 'nu')} AS p FROM w)
SELECT group_a, group_b, {_r('t', 't_stat')}, {_r('nu', 'dof')}, {_r('p', 'p_value')} FROM p"""))
def a26_welch_t(spark, sf):
    w = report.welch_tests(results(spark, sf), "algorithm", "reward_mean")
    return w.select("group_a", "group_b", "t_stat", "dof", "p_value")


# ------------------------------------------------------------------ A27
@register("a27_weighted_average", rsql(f"""
SELECT algorithm, {_r('sum(reward_mean * total_steps) / sum(total_steps)', 'wavg_reward_mean')}
FROM results GROUP BY algorithm"""))
def a27_weighted_average(spark, sf):
    return report.weighted_average(results(spark, sf), "algorithm", "reward_mean", "total_steps")


# ------------------------------------------------------------------ A28
@register("a28_under_replicated", rsql("""
, grid AS (SELECT a.algorithm, d.dataset, s.model_size FROM (SELECT DISTINCT algorithm FROM results) a,
           (SELECT DISTINCT dataset FROM results) d, (SELECT DISTINCT model_size FROM results) s),
n AS (SELECT algorithm, dataset, model_size, count(*) AS n FROM results GROUP BY ALL)
SELECT g.algorithm, g.dataset, g.model_size, coalesce(n.n, 0) AS n
FROM grid g LEFT JOIN n USING (algorithm, dataset, model_size) WHERE coalesce(n.n, 0) < 3""".replace(
    "FROM results", "FROM (SELECT algorithm, dataset, model_size || '-' || (total_steps % 499) AS model_size FROM results)")))
def a28_under_replicated(spark, sf):
    """Sizes are told apart by 499 cohorts, so some cells have few runs."""
    t = results(spark, sf).withColumn("model_size", F.concat("model_size", F.lit("-"), (F.col("total_steps") % 499).cast("string")))
    grid = runs.experiment_grid(t.select("algorithm").distinct(), t.select("dataset").distinct(),
                                t.select("model_size").distinct().withColumn("epoch", F.lit(0)))
    return report.under_replicated(grid.drop("epoch", "id"), t, ["algorithm", "dataset", "model_size"], 3)


CORR_COLS = ["reward_mean", "duration_hours", "kl_divergence", "entropy"]


# ------------------------------------------------------------------ A31
@register("a31_correlations", rsql("""
, w AS (SELECT """ + ", ".join(f"corr({a}, {b}) AS {a}__{b}" for i, a in enumerate(CORR_COLS)
                                for b in CORR_COLS[i + 1:]) + """ FROM results)
SELECT metric_a, metric_b, round(corr, 6) AS corr FROM (""" + " UNION ALL ".join(
    f"SELECT '{a}' AS metric_a, '{b}' AS metric_b, {a}__{b} AS corr FROM w"
    for i, a in enumerate(CORR_COLS) for b in CORR_COLS[i + 1:]) + ")"))
def a31_correlations(spark, sf):
    return report.correlations(results(spark, sf), CORR_COLS)


# ------------------------------------------------------------------ P19
@register("p19_consistency_violations", rsql("""
SELECT experiment_name, 'reward_out_of_range' AS rule FROM results WHERE NOT (reward_mean BETWEEN 0.0 AND 1.0)
UNION ALL
SELECT experiment_name, 'duration_out_of_range' AS rule FROM results WHERE NOT (duration_hours BETWEEN 0.1 AND 24.0)"""))
def p19_consistency_violations(spark, sf):
    v = report.consistency_violations(results(spark, sf))
    return v.select("experiment_name", "rule")


# ------------------------------------------------------------------ P21
@register("p21_existing_numeric", rsql("""
SELECT algorithm, round(reward_mean, 6) AS reward_mean, round(kl_divergence, 6) AS kl_divergence,
       round(entropy, 6) AS entropy FROM results"""))
def p21_existing_numeric(spark, sf):
    t = results(spark, sf).drop("policy_loss", "clip_fraction")
    return report.existing_numeric(t, ["reward_mean", "kl_divergence", "entropy", "policy_loss", "clip_fraction"],
                                   ["algorithm"])


# ------------------------------------------------------------------ W11
@register("w11_weighted_ranking", rsql("""
, g AS (SELECT algorithm, avg(reward_mean) AS reward_mean, avg(sample_efficiency) AS sample_efficiency,
        avg(duration_hours) AS duration_hours FROM results GROUP BY algorithm),
n AS (SELECT algorithm,
   CASE WHEN max(reward_mean) OVER () = min(reward_mean) OVER () THEN 0.0 ELSE (reward_mean - min(reward_mean) OVER ()) / (max(reward_mean) OVER () - min(reward_mean) OVER ()) END AS nr,
   CASE WHEN max(sample_efficiency) OVER () = min(sample_efficiency) OVER () THEN 0.0 ELSE (sample_efficiency - min(sample_efficiency) OVER ()) / (max(sample_efficiency) OVER () - min(sample_efficiency) OVER ()) END AS ns,
   1.0 - CASE WHEN max(duration_hours) OVER () = min(duration_hours) OVER () THEN 0.0 ELSE (duration_hours - min(duration_hours) OVER ()) / (max(duration_hours) OVER () - min(duration_hours) OVER ()) END AS nd
 FROM g)
SELECT algorithm, round(0.5 * nr + 0.3 * ns + 0.2 * nd, 6) AS score,
       rank() OVER (ORDER BY 0.5 * nr + 0.3 * ns + 0.2 * nd DESC) AS rank FROM n"""))
def w11_weighted_ranking(spark, sf):
    t = results(spark, sf)
    g = t.groupBy("algorithm").agg(*[F.avg(c).alias(c) for c in report.RANK_WEIGHTS])
    return report.weighted_ranking(g, "algorithm").select("algorithm", "score", F.col("rank").cast("bigint"))


# ------------------------------------------------------------------ W12
@register("w12_outliers", rsql(f"""
, st AS (SELECT algorithm, avg(kl_divergence) AS mu, stddev_samp(kl_divergence) AS sd FROM results GROUP BY algorithm)
SELECT experiment_name, r.algorithm, {_r('(kl_divergence - mu) / sd', 'z')}
FROM results r JOIN st USING (algorithm) WHERE abs(kl_divergence - mu) > 1.5 * sd"""))
def w12_outliers(spark, sf):
    o = report.outliers(results(spark, sf), "algorithm", "kl_divergence", k=1.5)
    return o.select("experiment_name", "algorithm", "z")


# ------------------------------------------------------------------ K4
@register("k4_pareto_front", rsql(f"""
, per AS (SELECT dataset, reward_mean, min(duration_hours) AS min_here FROM results GROUP BY dataset, reward_mean),
ab AS (SELECT *, min(min_here) OVER (PARTITION BY dataset ORDER BY reward_mean DESC
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS min_above FROM per)
SELECT experiment_name, r.dataset, {_r('r.reward_mean', 'reward_mean')}, {_r('duration_hours', 'duration_hours')}
FROM results r JOIN ab ON r.dataset = ab.dataset AND r.reward_mean = ab.reward_mean
WHERE duration_hours = min_here AND (min_above IS NULL OR duration_hours < min_above)"""))
def k4_pareto_front(spark, sf):
    r = results(spark, sf).select("experiment_name", "dataset", "reward_mean", "duration_hours")
    return pareto_front(r, "dataset", "reward_mean", "duration_hours")


_STRICTLY = "(q.{0} > p.{0} OR q.{1} > p.{1} OR q.{2} > p.{2})"


@register("k4_pareto_epsilon", rsql(f"""
, pts AS (SELECT experiment_name, dataset, reward_mean, duration_hours, kl_divergence, -duration_hours AS d, -kl_divergence AS k,
                 floor(reward_mean / e) AS b0, floor(-duration_hours / e) AS b1, floor(-kl_divergence / e) AS b2
          FROM results, (SELECT CAST(0.1 AS DOUBLE) AS e) WHERE reward_mean IS NOT NULL AND duration_hours IS NOT NULL AND kl_divergence IS NOT NULL),
boxes AS (SELECT DISTINCT dataset, b0, b1, b2 FROM pts)
SELECT experiment_name, dataset, {_r('reward_mean', 'reward_mean')}, {_r('duration_hours', 'duration_hours')}, {_r('kl_divergence', 'kl_divergence')}
FROM pts p
WHERE NOT EXISTS (SELECT 1 FROM boxes q WHERE q.dataset = p.dataset AND q.b0 >= p.b0 AND q.b1 >= p.b1 AND q.b2 >= p.b2
                  AND {_STRICTLY.format('b0', 'b1', 'b2')})
  AND NOT EXISTS (SELECT 1 FROM pts q WHERE q.dataset = p.dataset AND q.b0 = p.b0 AND q.b1 = p.b1 AND q.b2 = p.b2
                  AND q.reward_mean >= p.reward_mean AND q.d >= p.d AND q.k >= p.k AND {_STRICTLY.format('reward_mean', 'd', 'k')})"""))
def k4_pareto_epsilon(spark, sf):
    """Three objectives in boxes of 0.1."""
    r = results(spark, sf).select("experiment_name", "dataset", "reward_mean", "duration_hours", "kl_divergence")
    return pareto_front(r, "dataset", "reward_mean", ["duration_hours", "kl_divergence"], epsilon=0.1)


# ------------------------------------------------------------------ K5
@register("k5_constraint_select", with_views(f"""
WITH s AS (SELECT *, 0.7 * helpfulness + 0.3 * harmlessness AS score FROM v_responses
           WHERE helpfulness >= 0.8 - 0.05 AND harmlessness >= 0.9 - 0.05)
SELECT prompt, count(*) AS feasible, arg_max(resp_idx, (score, -resp_idx)) AS resp_idx,
       {_r('max(score)', 'score')} FROM s GROUP BY prompt""", "v_responses"))
def k5_constraint_select(spark, sf):
    r = V.v_responses(spark, sf).withColumn(
        "score", 0.7 * F.col("helpfulness") + 0.3 * F.col("harmlessness")).select(
        "prompt", "resp_idx", "helpfulness", "harmlessness", "score")
    c = report.constraint_select(r, "prompt", "score", {"helpfulness": 0.8, "harmlessness": 0.9}, 0.05,
                                 order="resp_idx")
    return c.select("prompt", "feasible", "resp_idx", "score")


# ------------------------------------------------------------------ A15 / X5
@register("a15_classification_metrics", with_views(f"""
SELECT {_r('sum(CASE WHEN prediction = target THEN 1 ELSE 0 END) / greatest(count(*), 1)', 'accuracy')},
       {_r('tp / greatest(tp + fp, 1)', 'precision')}, {_r('tp / greatest(tp + fn, 1)', 'recall')},
       {_r('CASE WHEN tp / greatest(tp + fp, 1) + tp / greatest(tp + fn, 1) = 0 THEN 0.0 ELSE 2 * (tp / greatest(tp + fp, 1)) * (tp / greatest(tp + fn, 1)) / (tp / greatest(tp + fp, 1) + tp / greatest(tp + fn, 1)) END', 'f1')}
FROM (SELECT *, sum(CASE WHEN prediction = 1 AND target = 1 THEN 1 ELSE 0 END) OVER () AS tp,
             sum(CASE WHEN prediction = 1 AND target <> 1 THEN 1 ELSE 0 END) OVER () AS fp,
             sum(CASE WHEN prediction <> 1 AND target = 1 THEN 1 ELSE 0 END) OVER () AS fn FROM v_predictions)
GROUP BY tp, fp, fn""", "v_predictions"))
def a15_classification_metrics(spark, sf):
    return report.classification_metrics(V.v_predictions(spark, sf))


@register("x5_metric_subset", with_views(f"""
SELECT {_r('sum(CASE WHEN prediction = target THEN 1 ELSE 0 END) / greatest(count(*), 1)', 'accuracy')},
       {_r('sum(CASE WHEN prediction = 1 AND target = 1 THEN 1 ELSE 0 END) / greatest(sum(CASE WHEN target = 1 THEN 1 ELSE 0 END), 1)', 'recall')}
FROM v_predictions""", "v_predictions"))
def x5_metric_subset(spark, sf):
    """Subset without precision: F1 is not produced."""
    return report.classification_metrics(V.v_predictions(spark, sf), metrics=("accuracy", "recall", "f1"))


# ------------------------------------------------------------------ outcomes
OUT_SQL = """, st AS (SELECT *, CASE WHEN timed_out THEN 'timeout' WHEN return_code = 0 THEN 'completed'
                         WHEN return_code IS NOT NULL THEN 'failed' ELSE 'error' END AS status FROM v_outcomes)"""


def osql(body: str) -> str:
    return with_views("WITH " + OUT_SQL.lstrip(", ") + "\n" + body, "v_outcomes")


def outcomes(spark, sf):
    return report.with_status(V.v_outcomes(spark, sf))


@register("p12_outcome_status", osql("SELECT id, algorithm, status FROM st"))
def p12_outcome_status(spark, sf):
    return outcomes(spark, sf).select("id", "algorithm", "status")


@register("a8_benchmark_summary", osql(f"""
SELECT count(*) AS total_experiments, count(CASE WHEN status = 'completed' THEN 1 END) AS completed,
       count(CASE WHEN status <> 'completed' OR status IS NULL THEN 1 END) AS failed,
       {_r("coalesce(count(CASE WHEN status = 'completed' THEN 1 END) / nullif(count(*), 0), 0.0)", 'success_rate')},
       {_r("coalesce(sum(CASE WHEN status = 'completed' THEN coalesce(duration, 0) END), 0.0)", 'total_duration')}
FROM st"""))
def a8_benchmark_summary(spark, sf):
    return report.benchmark_summary(outcomes(spark, sf))


@register("a9_algorithm_performance", osql(f"""
SELECT algorithm, {_r('avg(reward)', 'avg_reward')}, {_r('max(reward)', 'max_reward')},
       {_r('avg(coalesce(duration, 0))', 'avg_duration')}, {_r('sum(coalesce(duration, 0))', 'total_duration')},
       count(*) AS experiment_count
FROM (SELECT *, CASE WHEN id % 5 <> 0 THEN duration / 1000000 ELSE 0 END AS reward FROM st) WHERE status = 'completed' GROUP BY algorithm"""))
def a9_algorithm_performance(spark, sf):
    """A reward derived from the duration; every fifth run has none, which
    reads 0."""
    o = outcomes(spark, sf).withColumn("reward_mean", F.when(F.col("id") % 5 != 0, F.col("duration") / 1000000))
    return report.algorithm_performance(o)


@register("a10_records_by_algorithm", osql("""
SELECT algorithm, CAST(row_number() OVER (PARTITION BY algorithm ORDER BY id) - 1 AS BIGINT) AS position, id, status
FROM st"""))
def a10_records_by_algorithm(spark, sf):
    o = outcomes(spark, sf).select("algorithm", "id", "status")
    return runs.records_in_order(o, "algorithm", "id")


@register("a21_status_counts", osql("""
SELECT count(CASE WHEN status = 'completed' THEN 1 END) AS completed,
       count(CASE WHEN status IN ('failed', 'timeout', 'error') THEN 1 END) AS failed,
       count(CASE WHEN status = 'running' THEN 1 END) AS running, count(*) AS total FROM st"""))
def a21_status_counts(spark, sf):
    return report.status_counts(outcomes(spark, sf))


@register("u1_union_outcomes", osql("""
SELECT id, status FROM st WHERE status = 'completed'
UNION ALL SELECT id, status FROM st WHERE status <> 'completed'"""))
def u1_union_outcomes(spark, sf):
    o = outcomes(spark, sf).select("id", "status")
    return o.filter(F.col("status") == "completed").unionByName(o.filter(F.col("status") != "completed"))


@register("j8_resume_pending", osql("""
SELECT id, algorithm FROM st WHERE id NOT IN (SELECT id FROM st WHERE status = 'completed')"""))
def j8_resume_pending(spark, sf):
    o = outcomes(spark, sf)
    return runs.resume(o.select("id", "algorithm"), o.select("id", "status"))


@register("f27_duration_hours", osql(f"SELECT id, {_r('duration / 3600.0', 'duration_hours')} FROM st"))
def f27_duration_hours(spark, sf):
    o = V.v_outcomes(spark, sf)
    return o.select("id", runs.seconds_to_hours("duration").alias("duration_hours"))


@register("f28_run_folder_name", osql("SELECT id, strftime(started_at, '%Y%m%d_%H%M%S') AS folder FROM st"))
def f28_run_folder_name(spark, sf):
    o = V.v_outcomes(spark, sf)
    return o.select("id", runs.run_folder_name("started_at").alias("folder"))


@register("j1_experiment_grid", with_views("""
SELECT a.algorithm, d.dataset, s.model_size, 0 AS epoch, concat_ws('_', a.algorithm, d.dataset, s.model_size, '0') AS id
FROM (SELECT DISTINCT algorithm FROM v_outcomes) a, (SELECT DISTINCT dataset FROM v_runs) d,
     (SELECT DISTINCT model_size FROM v_runs) s""", "v_outcomes", "v_runs"))
def j1_experiment_grid(spark, sf):
    """Grid over the algorithms, datasets and sizes found in the tables."""
    a = V.v_outcomes(spark, sf).select("algorithm").distinct()
    r = V.v_runs(spark, sf)
    return runs.experiment_grid(a, r.select("dataset").distinct(),
                                r.select("model_size").distinct().withColumn("epoch", F.lit(0)))


WEIGHTS = [(0.7, 0.3), (0.5, 0.5), (0.3, 0.7)]


@register("j9_multiobjective_grid", rsql("""
, w AS (SELECT * FROM (VALUES (0.7, 0.3), (0.5, 0.5), (0.3, 0.7)) t(w_reward, w_entropy))
SELECT experiment_name, CAST(w_reward AS DOUBLE) AS w_reward, round(w_reward * reward_mean + w_entropy * entropy, 6) AS score
FROM results, w"""))
def j9_multiobjective_grid(spark, sf):
    """Every experiment under each weight vector: an ``explode`` of the three
    literal vectors (no join)."""
    t = results(spark, sf)
    vecs = F.array(*[F.struct(F.lit(a).alias("wr"), F.lit(b).alias("we")) for a, b in WEIGHTS])
    e = t.select("experiment_name", "reward_mean", "entropy", F.explode(vecs).alias("w"))
    return e.select("experiment_name", F.col("w.wr").alias("w_reward"),
                    (F.col("w.wr") * F.col("reward_mean") + F.col("w.we") * F.col("entropy")).alias("score"))


@register("p9_size_settings", with_views("""
SELECT id, model_size, CASE model_size WHEN '7b' THEN 'microsoft/DialoGPT-medium' WHEN '13b' THEN 'microsoft/DialoGPT-large'
       WHEN '30b' THEN 'microsoft/DialoGPT-xlarge' END AS size_checkpoint,
       CAST(CASE model_size WHEN '7b' THEN 4 WHEN '13b' THEN 2 WHEN '30b' THEN 1 END AS DOUBLE) AS size_batch_size
FROM (SELECT id, CASE id % 4 WHEN 0 THEN '7b' WHEN 1 THEN '13b' WHEN 2 THEN '30b' ELSE '70b' END AS model_size FROM v_outcomes)""",
                                                   "v_outcomes"))
def p9_size_settings(spark, sf):
    o = V.v_outcomes(spark, sf).select(
        "id", F.when(F.col("id") % 4 == 0, "7b").when(F.col("id") % 4 == 1, "13b")
                .when(F.col("id") % 4 == 2, "30b").otherwise("70b").alias("model_size"))
    return runs.size_settings(o).withColumn("size_batch_size", F.col("size_batch_size").cast("double"))



@register("a30_robustness_index", rsql(f"""
, per AS (SELECT algorithm, dataset, avg(reward_mean) AS s FROM results GROUP BY algorithm, dataset)
SELECT algorithm, {_r('min(s)', 'robustness_min')}, {_r('avg(s)', 'robustness_mean')} FROM per GROUP BY algorithm"""))
def a30_robustness_index(spark, sf):
    """Robustness: minimum and mean over datasets of the mean reward."""
    from prefspark.operators.steps import robustness
    return robustness(results(spark, sf), "algorithm", "dataset", "reward_mean")


# ------------------------------------------------------------------ S2 / S3 / J2 round trip
# Fixed names used to label the derived run folders.
PRIORITY_ALGORITHM = {"1-URGENT": "ppo", "2-HIGH": "dpo", "3-MEDIUM": "grpo_offpolicy",
                      "4-NOT SPECIFIED": "grpo_vi", "5-LOW": "rlaif"}
STATUS_DATASET = {"F": "hh", "O": "oasst", "P": "ultrafeedback"}


def _case(col: str, mapping: dict) -> str:
    return "CASE " + col + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + " END"


RUN_SQL = (f"concat_ws('_', {_case('o_orderpriority', PRIORITY_ALGORITHM)}, "
           f"{_case('o_orderstatus', STATUS_DATASET)}, '7b')")


@register("s2_scan_run_folders", f"""
WITH g AS (SELECT {RUN_SQL} AS experiment_name, {_case('o_orderpriority', PRIORITY_ALGORITHM)} AS algorithm,
                  {_case('o_orderstatus', STATUS_DATASET)} AS dataset, sum(o_totalprice) / 3600000.0 AS h,
                  avg(o_totalprice) / 1000000.0 AS r, max(o_totalprice) AS mx, avg(o_custkey) AS ck
           FROM orders GROUP BY ALL)
SELECT experiment_name, algorithm, dataset,
       round(h, 6) AS duration_hours, round(r, 6) AS reward_mean, CAST(0 AS DOUBLE) AS reward_std,
       round(mx / 10000000.0, 6) AS kl_divergence, round(ck / 10000.0, 6) AS entropy,
       CAST(0 AS DOUBLE) AS policy_loss, CAST(0 AS DOUBLE) AS value_loss, CAST(0 AS DOUBLE) AS clip_fraction,
       round(mx / 1000000.0, 6) AS best_reward, CAST(0 AS BIGINT) AS total_steps,
       CAST(0 AS DOUBLE) AS sample_efficiency, CAST(0 AS DOUBLE) AS memory_usage_gb,
       CAST(0 AS DOUBLE) AS gpu_efficiency, '7b' AS model_size
FROM g""")
def s2_scan_run_folders(spark, sf):
    """Per-run summary and metrics documents derived from ``orders`` are
    written as run folders, scanned back (summary + metrics merged, list
    values -> last element, final_metrics over top level, metrics.json over
    both) and projected to the results table."""
    import uuid

    from prefspark.session import checkpoint_dir
    from prefspark.sources import runfolders
    from prefspark.sources.runsource import write_run_folders
    o = V.table(spark, sf, "orders")
    algo = F.create_map(*[F.lit(x) for kv in PRIORITY_ALGORITHM.items() for x in kv])
    data = F.create_map(*[F.lit(x) for kv in STATUS_DATASET.items() for x in kv])
    run = F.concat_ws("_", algo[F.col("o_orderpriority")], data[F.col("o_orderstatus")], F.lit("7b"))
    g = o.groupBy(run.alias("run")).agg(
        (F.sum("o_totalprice") / 3600000.0).alias("h"), F.min("o_totalprice").alias("mn"),
        F.avg("o_totalprice").alias("avg"), F.max("o_totalprice").alias("mx"), F.avg("o_custkey").alias("ck"))
    docs = g.select(
        "run",
        F.to_json(F.struct(
            F.col("h").alias("experiment_duration_hours"),
            F.struct(F.array(F.col("mn") / 1e6, F.col("avg") / 1e6).alias("reward_mean"),
                     (F.lit(0.5)).alias("kl_divergence")).alias("final_metrics"),
            F.lit(0.0).alias("reward_mean"), (F.col("mx") / 1e6).alias("best_reward"),
            F.struct(F.lit("x").alias("algorithm")).alias("config"))).alias("summary"),
        F.to_json(F.struct((F.col("mx") / 1e7).alias("kl_divergence"),
                           (F.col("ck") / 1e4).alias("entropy"))).alias("metrics"))
    root = f"{checkpoint_dir(spark).rstrip('/')}/runs-{uuid.uuid4().hex}"
    write_run_folders(docs, root, {"summary": runfolders.SUMMARY, "metrics": runfolders.METRICS})
    scanned = runfolders.scan_runs(spark, root).withColumnRenamed("run", "experiment_name")
    t = runs.results_projection(scanned)
    return t


def _write_configs(spark, sf) -> str:
    """Per-run YAML configs derived from ``orders`` (runs of status P have no
    ``model`` section); returns the folder root."""
    import uuid

    from prefspark.session import checkpoint_dir
    from prefspark.sources import runfolders
    from prefspark.sources.runsource import write_run_folders
    o = V.table(spark, sf, "orders")
    algo = F.create_map(*[F.lit(x) for kv in PRIORITY_ALGORITHM.items() for x in kv])
    data = F.create_map(*[F.lit(x) for kv in STATUS_DATASET.items() for x in kv])
    g = o.groupBy(F.concat_ws("_", algo[F.col("o_orderpriority")], data[F.col("o_orderstatus")],
                              F.lit("7b")).alias("run"), F.col("o_orderstatus").alias("st")).agg(
        (F.count(F.lit(1)) % 7 + 1).alias("bs"), (F.sum("o_custkey") % 1000).alias("ck"))
    model = F.when(F.col("st") != "P", F.lit("model:\n  checkpoint: microsoft/DialoGPT-medium\n")).otherwise("")
    yaml_text = F.concat(model, F.lit("training:\n  batch_size: "), F.col("bs").cast("string"),
                         F.lit("\n  learning_rate: 1e-5\n  seed: "), F.col("ck").cast("string"), F.lit("\n"))
    root = f"{checkpoint_dir(spark).rstrip('/')}/configs-{uuid.uuid4().hex}"
    write_run_folders(g.select("run", yaml_text.alias("cfg")), root, {"cfg": runfolders.CONFIG})
    return root


CFG_SQL = f"""WITH g AS (SELECT {RUN_SQL} AS run, o_orderstatus AS st, count(*) % 7 + 1 AS bs,
                  sum(o_custkey) % 1000 AS ck FROM orders GROUP BY ALL)"""


@register("s4_scan_configs", CFG_SQL + """
SELECT run, 'model.checkpoint' AS path, 'microsoft/DialoGPT-medium' AS value, CAST(NULL AS DOUBLE) AS num
FROM g WHERE st <> 'P'
UNION ALL SELECT run, 'training.batch_size', CAST(bs AS VARCHAR), CAST(bs AS DOUBLE) FROM g
UNION ALL SELECT run, 'training.learning_rate', '1e-5', CAST(0.00001 AS DOUBLE) FROM g
UNION ALL SELECT run, 'training.seed', CAST(ck AS VARCHAR), CAST(ck AS DOUBLE) FROM g""")
def s4_scan_configs(spark, sf):
    """YAML configs scanned as files and flattened to (run, path, value, num);
    YAML 1.1 reads ``1e-5`` as a string, the numeric view casts it."""
    from prefspark.sources import runfolders
    return runfolders.scan_configs(spark, _write_configs(spark, sf))


@register("p7_missing_sections", CFG_SQL + """
SELECT run, 'model' AS section FROM g WHERE st = 'P'""")
def p7_missing_sections(spark, sf):
    """Required sections (model, training) absent from each run's config."""
    from prefspark.sources import runfolders
    cfg = runfolders.scan_configs(spark, _write_configs(spark, sf))
    return runs.missing_sections(cfg, ["model", "training"])


@register("p8_config_overrides", CFG_SQL + """
SELECT run, 'model.checkpoint' AS path, 'microsoft/DialoGPT-medium' AS value FROM g WHERE st <> 'P'
UNION ALL SELECT run, 'training.batch_size', '2' FROM g
UNION ALL SELECT run, 'training.learning_rate', '1e-5' FROM g
UNION ALL SELECT run, 'training.seed', CAST(ck AS VARCHAR) FROM g
UNION ALL SELECT run, 'experiment.tag', run FROM g""")
def p8_config_overrides(spark, sf):
    """Benchmark overrides on every run's flattened config: an existing key
    is replaced, a missing one is created (last writer wins)."""
    from prefspark.sources import runfolders
    base = runfolders.scan_configs(spark, _write_configs(spark, sf)).select("run", "path", "value")
    over = base.select("run").distinct().select(
        "run", F.explode(F.array(F.struct(F.lit("training.batch_size").alias("path"), F.lit("2").alias("value")),
                                 F.struct(F.lit("experiment.tag").alias("path"), F.col("run").alias("value"))))
        .alias("o")).select("run", "o.path", "o.value")
    return runs.flatten_overrides(base, over)


@register("a24_quartiles_approx", rsql("""
SELECT algorithm, count(reward_mean) AS n, true AS q1_within, true AS median_within, true AS q3_within
FROM results WHERE reward_mean IS NOT NULL GROUP BY algorithm"""))
def a24_quartiles_approx(spark, sf):
    """Quartiles from sketches kept per algorithm and model size, of two
    tables (one per dataset), merged; each is within 1 % of its exact rank."""
    t = results(spark, sf).select("algorithm", "dataset", "model_size", "reward_mean")
    parts = [report.quantile_sketches(t.where(c), ["algorithm", "model_size"], "reward_mean") for c in ("dataset = 'F'", "dataset is distinct from 'F'")]
    q = report.sketch_quantiles(parts[0].unionByName(parts[1]), ["algorithm"])
    at = t.where("reward_mean is not null").join(q, "algorithm")
    names = (("q1", 0.25), ("median", 0.5), ("q3", 0.75))
    ranks = at.groupBy("algorithm").agg(F.count("*").alias("n"), *[F.avg((F.col("reward_mean") < F.col(c)).cast("double")).alias(f"lo_{c}") for c, _ in names],
                                        *[F.avg((F.col("reward_mean") <= F.col(c)).cast("double")).alias(f"hi_{c}") for c, _ in names])
    return ranks.select("algorithm", "n", *[((F.col(f"lo_{c}") <= p + 0.01) & (F.col(f"hi_{c}") >= p - 0.01)).alias(f"{c}_within") for c, p in names])


# ------------------------------------------------------------------ S5 S6 S10
def _scratch(spark, name: str) -> str:
    import uuid

    from prefspark.session import checkpoint_dir
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@register("s5_csv_sink", rsql(f"""
SELECT experiment_name, algorithm, {_r('reward_mean', 'reward_mean')}, {_r('duration_hours', 'duration_hours')}, total_steps FROM results"""))
def s5_csv_sink(spark, sf):
    """The processed metrics written as CSV and read back."""
    from prefspark.sources import sinks
    out = _scratch(spark, "csv")
    sinks.write_csv(results(spark, sf).select("experiment_name", "algorithm", "reward_mean", "duration_hours", "total_steps"), out)
    return spark.read.schema("experiment_name string, algorithm string, reward_mean double, duration_hours double, total_steps long").option(
        "header", True).csv(out)


@register("s6_json_sink", osql(f"""
SELECT status, count(*) AS n, {_r('sum(duration)', 'total_duration')} FROM st GROUP BY status"""))
def s6_json_sink(spark, sf):
    """The experiments list written as JSON, read back and counted."""
    from prefspark.sources import sinks
    out = _scratch(spark, "json")
    sinks.write_json(outcomes(spark, sf).select("id", "algorithm", "status", "duration"), out)
    back = spark.read.schema("id long, algorithm string, status string, duration double").json(out)
    return back.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("duration").alias("total_duration"))


@register("s10_exports", rsql(f"""
, m AS (SELECT algorithm, avg(reward_mean) AS reward_mean, stddev_samp(reward_mean) AS reward_std FROM results GROUP BY algorithm)
SELECT unnest(['json', 'csv', 'parquet']) AS format, algorithm, {_r('reward_mean', 'reward_mean')}, {_r('reward_std', 'reward_std')} FROM m"""))
def s10_exports(spark, sf):
    """Reward per algorithm exported in every format and read back."""
    from prefspark.sources import sinks
    table = report.reward_by(results(spark, sf), "algorithm")
    schema, out = "algorithm string, reward_mean double, reward_std double", None
    for fmt in ("json", "csv", "parquet"):
        path = _scratch(spark, fmt)
        sinks.export(table, path, fmt)
        back = spark.read.schema(schema).format(fmt).option("header", True).load(path).select(F.lit(fmt).alias("format"), "algorithm", "reward_mean", "reward_std")
        out = back if out is None else out.unionByName(back)
    return out


# ------------------------------------------------------------------ J3
@register("j3_base_configs", """
WITH c AS (SELECT o_orderpriority AS algorithm, CAST(count(*) % 7 + 1 AS VARCHAR) AS value FROM orders
           WHERE o_orderpriority NOT LIKE '5%' GROUP BY 1),
g AS (SELECT DISTINCT o_orderpriority AS algorithm, o_orderstatus AS dataset FROM orders)
SELECT algorithm, dataset, 'training.batch_size' AS path, value FROM g JOIN c USING (algorithm)
UNION ALL SELECT DISTINCT algorithm, '', 'missing', '' FROM g WHERE algorithm NOT IN (SELECT algorithm FROM c)""")
def j3_base_configs(spark, sf):
    """Each experiment with its algorithm's base configuration; algorithms
    without one are listed as missing."""
    o = V.table(spark, sf, "orders")
    grid = o.select(F.col("o_orderpriority").alias("algorithm"), F.col("o_orderstatus").alias("dataset")).distinct()
    configs = o.where(~F.col("o_orderpriority").startswith("5")).groupBy(F.col("o_orderpriority").alias("algorithm")).agg(
        F.lit("training.batch_size").alias("path"), (F.count(F.lit(1)) % 7 + 1).cast("string").alias("value"))
    found, missing = runs.base_config_lookup(grid, configs)
    none = missing.select("algorithm", F.lit("").alias("dataset"), F.lit("missing").alias("path"), F.lit("").alias("value"))
    return found.select("algorithm", "dataset", "path", "value").unionByName(none)
