"""Report aggregates over the results table and run outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefspark.functions.special import student_t_tail
from prefspark.operators.runs import classify_outcome
from prefspark.plans.scan import Running, running

Z95 = 1.959963984540054   # two-sided 95% normal quantile
# Ranking weights (reward, sample efficiency, duration).
RANK_WEIGHTS = {"reward_mean": 0.5, "sample_efficiency": 0.3, "duration_hours": 0.2}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def reward_by(df: DataFrame, key: str) -> DataFrame:
    """Mean and sample std of ``reward_mean`` per key (NULL keys dropped)."""
    return (df.filter(F.col(key).isNotNull()).groupBy(key)
              .agg(F.avg("reward_mean").alias("reward_mean"), F.stddev_samp("reward_mean").alias("reward_std")))


def means_by(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """One pass: mean of each column per key."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(
        *[F.avg(c).alias(f"mean_{c}") for c in cols])


def pivot_mean(df: DataFrame, row: str, col: str, values: list[str] | None = None,
               value: str = "reward_mean") -> DataFrame:
    """Row x column pivot of the mean; one column for each distinct value
    unless ``values`` names them (which saves the job that finds them)."""
    return df.filter(F.col(row).isNotNull() & F.col(col).isNotNull()).groupBy(row).pivot(col, values).agg(F.avg(value))


def summary_sets(df: DataFrame) -> DataFrame:
    """Overall, per-algorithm and per-dataset summaries; NULL keys count in
    the overall summary only.

    The rows are aggregated once, per (algorithm, dataset); the levels are
    rolled up from these few cells.  Standard deviations are merged from each
    cell's count, mean and sum of squared differences."""
    means = ["duration_hours", "sample_efficiency", "memory_usage_gb"]
    cells = df.groupBy("algorithm", "dataset").agg(
        F.count("*").alias("n"), F.count("reward_mean").alias("r_n"), F.avg("reward_mean").alias("r_mean"),
        (F.var_pop("reward_mean") * F.count("reward_mean")).alias("r_m2"), F.max("reward_mean").alias("r_max"),
        F.min("reward_mean").alias("r_min"), *[F.sum(c).alias(f"s_{c}") for c in means], *[F.count(c).alias(f"n_{c}") for c in means])
    none = F.lit(None).cast("string")

    def level(name, algorithm, dataset):
        return F.struct(F.lit(name).alias("level"), algorithm.alias("a"), dataset.alias("d"))
    levels = F.array(level("overall", none, none), level("algorithm", F.col("algorithm").cast("string"), none),
                     level("dataset", none, F.col("dataset").cast("string")))
    rows = cells.select("*", F.explode(levels).alias("l")).where("l.level = 'overall' or l.a is not null or l.d is not null")
    # the level's mean beside each of its cells
    whole = Window.partitionBy("l")
    mean = F.sum(F.col("r_n") * F.col("r_mean")).over(whole) / F.sum("r_n").over(whole)
    rows = rows.withColumn("r_m2", F.col("r_m2") + F.col("r_n") * (F.col("r_mean") - mean) * (F.col("r_mean") - mean))
    n = F.sum("r_n")

    def average(c):
        return F.try_divide(F.sum(f"s_{c}"), F.sum(f"n_{c}").cast("double"))
    out = rows.groupBy("l").agg(
        F.sum("n").alias("experiments"), F.count_distinct("algorithm").alias("n_algorithms"), F.count_distinct("dataset").alias("n_datasets"),
        F.coalesce(F.sum("s_duration_hours"), F.lit(0.0)).alias("total_hours"),
        F.try_divide(F.sum(F.col("r_n") * F.col("r_mean")), n.cast("double")).alias("reward_mean"),
        F.when(n > 1, F.sqrt(F.sum("r_m2") / (n - 1))).alias("reward_std"),
        F.max("r_max").alias("reward_max"), F.min("r_min").alias("reward_min"), average("duration_hours").alias("mean_hours"),
        average("sample_efficiency").alias("mean_sample_efficiency"), average("memory_usage_gb").alias("mean_memory_usage_gb"))
    return out.select("l.level", F.col("l.a").alias("algorithm"), F.col("l.d").alias("dataset"), *out.columns[1:])


def benchmark_summary(outcomes: DataFrame, status: str = "status", duration: str = "duration") -> DataFrame:
    """Totals, completed, failed (everything not completed), success rate (0
    when empty), total duration over completed runs only."""
    done = F.col(status) == "completed"
    return outcomes.agg(
        F.count(F.lit(1)).alias("total_experiments"),
        F.count(F.when(done, 1)).alias("completed"),
        F.count(F.when(~done | F.col(status).isNull(), 1)).alias("failed"),
        F.coalesce(F.try_divide(F.count(F.when(done, 1)).cast("double"), F.count(F.lit(1)).cast("double")),
                   F.lit(0.0)).alias("success_rate"),
        F.coalesce(F.sum(F.when(done, F.coalesce(F.col(duration), F.lit(0.0)))), F.lit(0.0))
        .alias("total_duration"))


def algorithm_performance(outcomes: DataFrame, reward: str | None = "reward_mean",
                          duration: str = "duration", algorithm: str = "algorithm") -> DataFrame:
    """Per algorithm over completed runs: mean/max reward (missing -> 0),
    mean/total duration, count."""
    r = F.coalesce(F.col(reward), F.lit(0.0)) if reward else F.lit(0.0)
    d = F.coalesce(F.col(duration), F.lit(0.0))
    return (outcomes.filter(F.col("status") == "completed").groupBy(algorithm)
            .agg(F.avg(r).alias("avg_reward"), F.max(r).alias("max_reward"),
                 F.avg(d).alias("avg_duration"), F.sum(d).alias("total_duration"),
                 F.count(F.lit(1)).alias("experiment_count")))


def status_counts(outcomes: DataFrame, status: str = "status") -> DataFrame:
    """Tracking state: completed / failed / running / total counts."""
    return outcomes.agg(
        F.count(F.when(F.col(status) == "completed", 1)).alias("completed"),
        F.count(F.when(F.col(status).isin("failed", "timeout", "error"), 1)).alias("failed"),
        F.count(F.when(F.col(status) == "running", 1)).alias("running"),
        F.count(F.lit(1)).alias("total"))


def with_status(outcomes: DataFrame) -> DataFrame:
    return outcomes.withColumn("status", classify_outcome())


def eval_average(rows: DataFrame, run: str, batch: str, metrics: list[str]) -> DataFrame:
    """Mean over batches of per-batch means (unweighted by batch size)."""
    per = rows.groupBy(run, batch).agg(*[F.avg(m).alias(m) for m in metrics])
    return per.groupBy(run).agg(*[F.avg(m).alias(m) for m in metrics])


def classification_metrics(df: DataFrame, pred: str = "prediction", target: str = "target",
                           metrics=("accuracy", "precision", "recall", "f1"),
                           group: list[str] | None = None) -> DataFrame:
    """Accuracy, precision, recall, F1 with denominators floored at 1; F1 is 0
    when precision + recall is 0 and only produced with both present."""
    if df.schema[pred].dataType.typeName() == "array":
        from prefspark.functions.vec import argmax0       # score vectors -> labels
        df = df.withColumn(pred, argmax0(pred))
    p, t = F.col(pred), F.col(target)
    tp = F.sum(F.when((p == 1) & (t == 1), 1).otherwise(0))
    fp = F.sum(F.when((p == 1) & (t != 1), 1).otherwise(0))
    fn = F.sum(F.when((p != 1) & (t == 1), 1).otherwise(0))
    n = F.count(F.lit(1))
    correct = F.sum(F.when(p == t, 1).otherwise(0))
    base = (df.groupBy(*group) if group else df.groupBy()).agg(
        tp.alias("__tp"), fp.alias("__fp"), fn.alias("__fn"), n.alias("__n"), correct.alias("__ok"))
    cols = list(group or [])
    prec = F.col("__tp") / F.greatest(F.col("__tp") + F.col("__fp"), F.lit(1))
    rec = F.col("__tp") / F.greatest(F.col("__tp") + F.col("__fn"), F.lit(1))
    out = {"accuracy": F.col("__ok") / F.greatest(F.col("__n"), F.lit(1)), "precision": prec, "recall": rec}
    want = list(metrics)
    sel = [out[m].cast("double").alias(m) for m in want if m in out]
    if "f1" in want and "precision" in want and "recall" in want:
        sel.append(F.when(prec + rec == 0, F.lit(0.0)).otherwise(2 * prec * rec / (prec + rec)).alias("f1"))
    return base.select(*cols, *sel)


def trend_lines(df: DataFrame, group: str, y: str, x: str) -> DataFrame:
    """Least-squares line of ``y`` on ``x`` per group with more than one row,
    and the fitted value for every row (constant ``x`` gives NULL)."""
    fit = (df.groupBy(group).agg(F.regr_slope(y, x).alias("slope"),
                                 F.regr_intercept(y, x).alias("intercept"),
                                 F.count(F.lit(1)).alias("__n"))
             .filter(F.col("__n") > 1).drop("__n"))
    return df.join(fit, on=group, how="inner").withColumn(
        "fitted", F.col("intercept") + F.col("slope") * F.col(x))


def quartiles(df: DataFrame, group: str, value: str, exact: bool = True,
              qs: tuple = (0.25, 0.5, 0.75), names: tuple = ("q1", "median", "q3")) -> DataFrame:
    """Continuous quantiles per group (``percentile_cont`` semantics:
    interpolate between the values at ``floor`` and ``ceil`` of ``(n-1)q``).

    Exact form without holding a group in one task: counts per distinct
    value, a skew-safe running count over the values, and only the values
    covering the needed positions are kept and interpolated.  ``exact=False``
    reads them from a sketch per group (see :func:`quantile_sketches`).
    """
    if not exact:
        return sketch_quantiles(quantile_sketches(df, [group], value), [group], qs, names)
    # counts per distinct value (partial aggregation: ties collapse map-side),
    # then the number of smaller values by a skew-safe running sum
    counts = (df.filter(F.col(value).isNotNull()).groupBy(group, value)
                .agg(F.count(F.lit(1)).alias("__c")))
    j = running(counts, [group], [value], {"__below": Running("sum", "__c", inclusive=False), "__n": Running("sum", "__c", whole=True)})
    j = j.withColumn("__below", F.coalesce("__below", F.lit(0)))

    def covers(pos: Column) -> Column:          # value occupies positions [below, below + c)
        return (F.col("__below") <= pos) & (pos < F.col("__below") + F.col("__c"))

    wanted = F.lit(False)
    for q in qs:
        h = (F.col("__n") - 1) * F.lit(q)
        wanted = wanted | covers(F.floor(h)) | covers(F.ceil(h))
    picked = j.filter(wanted)
    aggs = []
    for q, name in zip(qs, names):
        h = (F.col("__n") - 1) * F.lit(q)
        lo = F.max(F.when(covers(F.floor(h)), F.col(value)))
        hi = F.max(F.when(covers(F.ceil(h)), F.col(value)))
        frac = F.max(h - F.floor(h))
        aggs.append((lo + frac * (hi - lo)).alias(name))
    return picked.groupBy(group).agg(*aggs)


#: size of a quantile sketch: rank error about 0.2 %
SKETCH_K = 1600


def quantile_sketches(df: DataFrame, keys: list[str], value: str, k: int = SKETCH_K) -> DataFrame:
    """(keys, sketch): a mergeable KLL sketch of ``value`` per group, of
    bounded size however many rows it has seen.  Sketches of several tables,
    days or runs can be stored and merged later."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch"))


def sketch_quantiles(sketches: DataFrame, keys: list[str], qs: tuple = (0.25, 0.5, 0.75),
                     names: tuple = ("q1", "median", "q3")) -> DataFrame:
    """Approximate quantiles of the merged ``sketches`` of each group."""
    merged = sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    return merged.select(*keys, *[F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias(n) for q, n in zip(qs, names)])


def confidence_interval(df: DataFrame, group: str, value: str, z: float = Z95) -> DataFrame:
    """Normal 95% interval of the mean per group."""
    half = F.lit(z) * F.stddev_samp(value) / F.sqrt(F.count(value))
    return df.groupBy(group).agg(F.avg(value).alias("mean"), (F.avg(value) - half).alias("ci_low"),
                                 (F.avg(value) + half).alias("ci_high"), F.count(value).alias("n"))


def welch_tests(df: DataFrame, group: str, value: str) -> DataFrame:
    """Welch t statistic and degrees of freedom for every pair of groups
    (a < b), with the two-sided p-value of Student's t.

    Works on one aggregated row per group; one row per pair of groups is the
    result itself.
    """
    st = df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"),
                               F.var_samp(value).alias("v"))
    a, b = st.alias("a"), st.alias("b")
    pairs = a.join(b, F.col(f"a.{group}") < F.col(f"b.{group}"))
    se2 = F.col("a.v") / F.col("a.n") + F.col("b.v") / F.col("b.n")
    t = (F.col("a.m") - F.col("b.m")) / F.sqrt(se2)
    df_ = (se2 * se2) / ((F.col("a.v") / F.col("a.n")) ** 2 / (F.col("a.n") - 1)
                         + (F.col("b.v") / F.col("b.n")) ** 2 / (F.col("b.n") - 1))
    return pairs.select(F.col(f"a.{group}").alias("group_a"), F.col(f"b.{group}").alias("group_b"),
                        t.alias("t_stat"), df_.alias("dof")).withColumn("p_value", student_t_tail(F.col("t_stat"), F.col("dof")))


def weighted_average(df: DataFrame, group: str, value: str, weight: str) -> DataFrame:
    return df.groupBy(group).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias(f"wavg_{value}"))


def under_replicated(counts_grid: DataFrame, runs: DataFrame, keys: list[str], minimum: int = 3) -> DataFrame:
    """Grid cells with fewer than ``minimum`` experiments (zero counts kept)."""
    n = runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return (counts_grid.join(n, on=keys, how="left")
                       .withColumn("n", F.coalesce("n", F.lit(0)))
                       .filter(F.col("n") < minimum))


def correlations(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlation of every pair of columns in one aggregate (long form)."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    wide = df.agg(*[F.corr(a, b).alias(f"{a}__{b}") for a, b in pairs])
    stacked = ", ".join(f"'{a}', '{b}', `{a}__{b}`" for a, b in pairs)
    return wide.selectExpr(f"stack({len(pairs)}, {stacked}) AS (metric_a, metric_b, corr)")


def best_worst(df: DataFrame, name: str, value: str) -> DataFrame:
    """Best and worst experiment by ``value`` (ties -> smallest name)."""
    return df.agg(
        F.min_by(F.col(name), F.struct((-F.col(value)).alias("v"), F.col(name).alias("n")))
        .alias("best_experiment"),
        F.max(value).alias("best_value"),
        F.min_by(F.col(name), F.struct(F.col(value).alias("v"), F.col(name).alias("n")))
        .alias("worst_experiment"),
        F.min(value).alias("worst_value"))


def consistency_violations(df: DataFrame, reward: str = "reward_mean", hours: str = "duration_hours",
                           reward_range=(0.0, 1.0), hours_range=(0.1, 24.0)) -> DataFrame:
    """Rows breaking a consistency rule, one row per (row, rule)."""
    rules = F.array(
        F.when(~F.col(reward).between(*reward_range), F.lit("reward_out_of_range")),
        F.when(~F.col(hours).between(*hours_range), F.lit("duration_out_of_range")))
    return df.withColumn("rule", F.explode(F.filter(rules, lambda r: r.isNotNull())))


def existing_numeric(df: DataFrame, wanted: list[str], keep: list[str]) -> DataFrame:
    """``keep`` plus the wanted numeric columns that exist."""
    numeric = {f.name for f in df.schema.fields
               if f.dataType.typeName() in ("double", "float", "integer", "long", "short")}
    return df.select(*keep, *[c for c in wanted if c in numeric])


def weighted_ranking(per_group: DataFrame, group: str, weights: dict[str, float] = RANK_WEIGHTS,
                     invert=("duration_hours",)) -> DataFrame:
    """Min-max normalise each metric over the groups (duration inverted),
    weighted sum, dense rank.  Runs on one aggregated row per group."""
    w_all = Window.partitionBy()
    score = F.lit(0.0)
    out = per_group
    for c, w in weights.items():
        lo, hi = F.min(c).over(w_all), F.max(c).over(w_all)
        norm = F.when(hi == lo, F.lit(0.0)).otherwise((F.col(c) - lo) / (hi - lo))
        if c in invert:
            norm = F.lit(1.0) - norm
        out = out.withColumn(f"norm_{c}", norm)
        score = score + F.lit(w) * F.col(f"norm_{c}")
    out = out.withColumn("score", score)
    return out.withColumn("rank", F.rank().over(Window.orderBy(F.col("score").desc())))


def outliers(df: DataFrame, group: str, value: str, k: float = 3.0) -> DataFrame:
    """Rows more than ``k`` sample standard deviations from their group mean.

    Group statistics come from one aggregate joined back (not a window), so a
    hot group is aggregated partially before the shuffle."""
    st = df.groupBy(group).agg(F.avg(value).alias("__mu"), F.stddev_samp(value).alias("__sd"))
    j = df.join(st, on=group)
    return (j.filter(F.abs(F.col(value) - F.col("__mu")) > F.lit(k) * F.col("__sd"))
             .withColumn("z", (F.col(value) - F.col("__mu")) / F.col("__sd")).drop("__mu", "__sd"))


def constraint_select(df: DataFrame, group: str, score: str, constraints: dict[str, float],
                      tolerance: float = 0.05, order: str | None = None) -> DataFrame:
    """Per group, the best-scoring row among those meeting every target minus
    the tolerance (ties -> smallest ``order``)."""
    ok = F.lit(True)
    for c, target in constraints.items():
        ok = ok & (F.col(c) >= F.lit(target - tolerance))
    key = F.struct(F.col(score).alias("s"), (-F.col(order)).alias("o")) if order else F.col(score)
    cols = [c for c in df.columns if c != group]
    return (df.filter(ok).groupBy(group)
              .agg(F.max_by(F.struct(*cols), key).alias("__b"), F.count(F.lit(1)).alias("feasible"))
              .select(group, "feasible", *[F.col(f"__b.{c}").alias(c) for c in cols]))
