"""Training-log analytics over step tables (one row per run and step):
best-so-far, early stop, periodic sampling, checkpoints, sample efficiency,
convergence, returns, advantages, baselines, normalisation, replay buffers,
adaptive coefficients."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefspark.functions.special import permuted, uniform
from prefspark.plans.recurrence import (bounded_frame, discounted_prefix, discounted_suffix, frame,
                                        halo_window as frame_order)
from prefspark.plans.scan import STEP_WIDTH, Running, row_index, running
from prefspark.plans.selection import top_n

# Fixed defaults of the run configs.
GAMMA = 0.99
GAE_LAMBDA = 0.95
BASELINE_WINDOW = 100
REPLAY_BUFFER_SIZE = 10_000
TARGET_UPDATE_FREQ = 1000
PRIORITY_ALPHA = 0.6
WEIGHT_SMOOTHING = 0.9
WEIGHT_UPDATE_EVERY = 100
KL_TARGET = 0.01
KL_FACTOR = 1.5
REWARD_CLIP = (-10.0, 10.0)


def best_so_far(df: DataFrame, run: str = "run_id", step: str = "step", value: str = "reward_mean",
                out: str = "best_so_far") -> DataFrame:
    """Running best before each step (strict ``>`` starting from -inf) and a
    ``new_best`` flag; skew-safe running max."""
    r = running(df, [run], [step], {"__prev": Running("max", value, inclusive=False)},
                width=STEP_WIDTH)
    prev = F.coalesce(F.col("__prev"), F.lit(float("-inf")))
    return (r.withColumn("new_best", F.col(value) > prev)
             .withColumn(out, F.greatest(prev, F.col(value))).drop("__prev"))


def early_stop(df: DataFrame, target: float, run: str = "run_id", step: str = "step",
               value: str = "reward_mean") -> DataFrame:
    """Steps up to and including the first one with ``value > target``."""
    hit = (F.col(value) > F.lit(target)).cast("int")
    r = running(df, [run], [step], {"__hit_before": Running("max", hit, inclusive=False)},
                width=STEP_WIDTH)
    return r.filter(F.coalesce(F.col("__hit_before"), F.lit(0)) == 0).drop("__hit_before")


def periodic(df: DataFrame, every: int, step: str = "step", base: int = 0) -> DataFrame:
    """Steps where the counter is a multiple of ``every``; ``base=1`` tests the
    1-based post-increment counter (trainers), ``base=0`` the loop index."""
    return df.filter(F.pmod(F.col(step) + F.lit(base), F.lit(every)) == 0)


def cap_steps(df: DataFrame, max_steps: int, step: str = "step") -> DataFrame:
    """Stop each epoch at ``max_steps`` (keeps ``step < max_steps``)."""
    return df.filter(F.col(step) < max_steps)


def target_refresh(df: DataFrame, freq: int = TARGET_UPDATE_FREQ, run: str = "run_id",
                   step: str = "step") -> DataFrame:
    """Target-network refresh flag (``step % freq == 0``) and the running
    number of refreshes."""
    flag = (F.pmod(F.col(step), F.lit(freq)) == 0)
    d = df.withColumn("target_update", flag.cast("int"))
    return running(d, [run], [step], {"refresh_count": Running("sum", "target_update")},
                   width=STEP_WIDTH)


def keep_checkpoints(df: DataFrame, k: int, every: int, run: str = "run_id", step: str = "step",
                     best_only: bool = False, value: str = "reward_mean") -> DataFrame:
    """Checkpoint rows (every ``every`` steps) kept by the latest-K rule, or
    the best K by ``value`` with ``best_only`` (see :func:`top_n`)."""
    c = periodic(df, every, step)
    return top_n(c, [run], F.struct(value, step) if best_only else F.struct(step), k, largest=True)


def sample_efficiency(df: DataFrame, threshold: float, run: str = "run_id", step: str = "step",
                      value: str = "reward_mean", tokens: str | Column | None = None) -> DataFrame:
    """Tokens (or steps, without a token column) consumed until ``value``
    first reaches ``threshold``; NULL when it never does."""
    tok = F.lit(1) if tokens is None else (F.col(tokens) if isinstance(tokens, str) else tokens)
    r = running(df.withColumn("__tok", tok), [run], [step], {"__cum": Running("sum", "__tok")},
                width=STEP_WIDTH)
    return r.groupBy(run).agg(
        F.min(F.when(F.col(value) >= F.lit(threshold), F.col("__cum"))).alias("tokens_to_threshold"),
        F.min(F.when(F.col(value) >= F.lit(threshold), F.col(step))).alias("first_step"))


def convergence(df: DataFrame, run: str = "run_id", step: str = "step", value: str = "reward_mean",
                tail: float = 0.2) -> DataFrame:
    """Convergence rate = slope of ``value`` on ``step``; stability =
    ``1 / (1 + std/|mean|)`` over the last ``tail`` share of steps."""
    j = running(df.select(run, step, value), [run], [step], {"__last": Running("max", step, whole=True)}, width=STEP_WIDTH)
    tail_value = F.when(F.col(step) >= F.lit(1 - tail) * F.col("__last"), F.col(value))
    return j.groupBy(run).agg(
        F.regr_slope(value, step).alias("convergence_rate"),
        (F.lit(1.0) / (F.lit(1.0) + F.try_divide(F.stddev_samp(tail_value), F.abs(F.avg(tail_value))))).alias("stability"))


def robustness(per_run: DataFrame, group: str, dataset: str, score: str) -> DataFrame:
    """Minimum and mean over datasets of a per-dataset score."""
    per_ds = per_run.groupBy(group, dataset).agg(F.avg(score).alias("__s"))
    return per_ds.groupBy(group).agg(F.min("__s").alias("robustness_min"), F.avg("__s").alias("robustness_mean"))


def metric_windows(df: DataFrame, ts: str, value: str, run: str = "run_id",
                   width: str = "5 minutes") -> DataFrame:
    """Mean and max of ``value`` per run and tumbling time window."""
    return (df.groupBy(run, F.window(F.col(ts), width).alias("w"))
              .agg(F.avg(value).alias("mean_value"), F.max(value).alias("max_value"))
              .select(run, F.col("w.start").alias("window_start"), "mean_value", "max_value"))


def scale_clip(reward, scale: float = 1.0, lo: float = REWARD_CLIP[0], hi: float = REWARD_CLIP[1]) -> Column:
    r = F.col(reward) if isinstance(reward, str) else reward
    return F.greatest(F.lit(lo), F.least(F.lit(hi), F.lit(scale) * r))


def melt_metrics(df: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    """Wide step metrics to the long ``(ids.., metric, value)`` log."""
    cast = df.select(*ids, *[F.col(m).cast("double").alias(m) for m in metrics])
    return cast.unpivot(ids, metrics, "metric", "value")


def batches(df: DataFrame, batch_size: int, order: str = "id", shuffle_seed: int | None = None) -> DataFrame:
    """Global 0-based row index in ``order`` (skew-safe, no single-partition
    window) and ``batch_id = idx // batch_size``; the last partial batch is
    kept.  With a seed the index goes through a keyed permutation of the
    table's positions: the same shuffle whenever and wherever it runs."""
    out = running(df, [], [order], {"idx": Running("count", inclusive=False), "__n": Running("count", whole=True)})
    idx = F.coalesce("idx", F.lit(0)).cast("bigint")
    out = out.withColumn("idx", idx if shuffle_seed is None else permuted(idx, F.col("__n"), shuffle_seed)).drop("__n")
    return out.withColumn("batch_id", F.floor(F.col("idx") / batch_size).cast("bigint"))


# ---------------------------------------------------------- trajectories
def discounted_returns(df: DataFrame, run: str = "run_id", idx: str = "step", reward: str = "reward_mean",
                       gamma: float = GAMMA, out: str = "return") -> DataFrame:
    """``G_t = r_t + gamma * G_{t+1}`` for every step (bounded-memory chunks)."""
    return discounted_suffix(df, [run], idx, reward, gamma, out)


def gae(df: DataFrame, run: str = "run_id", idx: str = "step", reward: str = "reward_mean",
        value: str = "value", gamma: float = GAMMA, lam: float = GAE_LAMBDA,
        out: str = "advantage") -> DataFrame:
    """Generalised advantage estimation: ``delta_t = r_t + gamma V_{t+1} - V_t``
    (``V`` after the last step is 0), ``A_t = delta_t + gamma lam A_{t+1}``."""
    d = bounded_frame(df, [run], idx, 0, 1, {"__vnext": F.lead(value).over(frame_order([run], idx))})
    d = d.withColumn("__delta", F.col(reward) + F.lit(gamma) * F.coalesce("__vnext", F.lit(0.0)) - F.col(value))
    return discounted_suffix(d, [run], idx, "__delta", gamma * lam, out).drop("__vnext", "__delta")


def moving_baseline(df: DataFrame, run: str = "run_id", idx: str = "step", reward: str = "reward_mean",
                    window: int = BASELINE_WINDOW) -> DataFrame:
    """Mean of the previous ``window`` rewards (NULL at the first step) and
    ``advantage = reward - baseline``."""
    f = frame([run], idx, -window, -1)
    d = bounded_frame(df, [run], idx, window, 0, {"baseline": F.avg(reward).over(f)})
    return d.withColumn("advantage", F.col(reward) - F.col("baseline"))


def zscore(df: DataFrame, group: list[str], value: str = "reward_mean", out: str = "normalized",
           eps: float = 1e-8) -> DataFrame:
    """``(x - mean) / (std_samp + eps)`` within each group (aggregate + join)."""
    st = df.groupBy(*group).agg(F.avg(value).alias("__mu"), F.stddev_samp(value).alias("__sd"))
    return (df.join(st, group)
              .withColumn(out, (F.col(value) - F.col("__mu")) / (F.coalesce("__sd", F.lit(0.0)) + F.lit(eps)))
              .drop("__mu", "__sd"))


def group_relative(df: DataFrame, group: list[str], value: str = "reward_mean", weight: float = 0.5,
                   out: str = "mixed_advantage") -> DataFrame:
    """``weight * zscore_within_group + (1 - weight) * raw``."""
    z = zscore(df, group, value, "__z")
    return z.withColumn(out, F.lit(weight) * F.col("__z") + F.lit(1 - weight) * F.col(value)).drop("__z")


def smoothed_weights(df: DataFrame, run: str = "run_id", step: str = "step", signal: str = "reward_mean",
                     every: int = WEIGHT_UPDATE_EVERY, smoothing: float = WEIGHT_SMOOTHING,
                     initial: float = 0.5) -> DataFrame:
    """Adaptive objective weight updated every ``every`` steps:
    ``w_b = s * w_{b-1} + (1 - s) * mean(signal in bucket b)``, ``w_{-1} = initial``."""
    b = (df.groupBy(run, F.floor(F.col(step) / every).cast("bigint").alias("bucket"))
           .agg(F.avg(signal).alias("bucket_mean")))
    e = discounted_prefix(b.withColumn("__x", F.lit(1 - smoothing) * F.col("bucket_mean")),
                          [run], "bucket", "__x", smoothing, "__ema")
    return e.withColumn(
        "weight", F.col("__ema") + F.pow(F.lit(smoothing), F.col("bucket") + 1) * F.lit(initial)
    ).drop("__x", "__ema")


def adaptive_kl(df: DataFrame, run: str = "run_id", step: str = "step", kl: str = "kl",
                target: float = KL_TARGET, factor: float = KL_FACTOR, initial: float = 0.2) -> DataFrame:
    """Adaptive KL coefficient: after each step multiply by ``factor`` when
    KL > 1.5 target, divide when KL < target / 1.5.  A running sum of log
    factors (skew-safe), so no ordered fold is needed."""
    lf = math.log(factor)
    inc = (F.when(F.col(kl) > F.lit(1.5 * target), F.lit(lf))
            .when(F.col(kl) < F.lit(target / 1.5), F.lit(-lf)).otherwise(F.lit(0.0)))
    r = running(df.withColumn("__inc", inc), [run], [step],
                {"__before": Running("sum", "__inc", inclusive=False)}, width=STEP_WIDTH)
    return (r.withColumn("kl_coef", F.lit(initial) * F.exp(F.coalesce("__before", F.lit(0.0))))
             .withColumn("kl_coef_next", F.lit(initial) * F.exp(F.coalesce("__before", F.lit(0.0)) + F.col("__inc")))
             .drop("__before", "__inc"))


# ---------------------------------------------------------- replay
def replay_buffer(df: DataFrame, size: int = REPLAY_BUFFER_SIZE, run: str = "run_id",
                  step: str = "step") -> DataFrame:
    """FIFO buffer: the latest ``size`` experiences per run."""
    return top_n(df, [run], F.struct(step), size, largest=True)


def replay_sample(df: DataFrame, n: int, run: str = "run_id", key: Column | None = None,
                  id_col: str = "event_id", seed: int = 0) -> DataFrame:
    """Uniform sample without replacement of ``n`` per run (all rows when the
    buffer is smaller): the ``n`` smallest of a hash-derived uniform."""
    k = key if key is not None else uniform(F.col(id_col), seed)
    return top_n(df, [run], F.struct(k, F.col(id_col)), n)


def prioritized_sample(df: DataFrame, n: int, priority: str | Column, run: str = "run_id",
                       id_col: str = "event_id", alpha: float = PRIORITY_ALPHA, seed: int = 0) -> DataFrame:
    """Weighted sample without replacement, P proportional to priority^alpha:
    the ``n`` smallest ``-ln(u) / p^alpha`` per run, ``u`` uniform from a hash."""
    p = F.col(priority) if isinstance(priority, str) else priority
    key = -F.log(uniform(F.col(id_col), seed)) / F.pow(p, F.lit(alpha))
    return top_n(df, [run], F.struct(key, F.col(id_col)), n)
