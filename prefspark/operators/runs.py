"""Experiment tables: results projection, name parsing, outcomes, grid,
config overrides and resume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefspark.plans.scan import row_index

# Algorithm names known to the benchmark grid, and the 17
# columns of the results table with the metric keys they read.
KNOWN_ALGORITHMS = ["ppo", "dpo", "grpo", "grpo_offpolicy", "grpo_vi", "rlaif"]
RESULT_METRICS = ["reward_mean", "reward_std", "kl_divergence", "entropy", "policy_loss",
                  "value_loss", "clip_fraction", "best_reward", "total_steps",
                  "sample_efficiency", "memory_usage_gb", "gpu_efficiency"]
RESULT_COLUMNS = ["experiment_name", "algorithm", "dataset", "model_size", "duration_hours",
                  *RESULT_METRICS]
# Size-dependent settings applied before overrides
# (model size -> model checkpoint, training batch size).
SIZE_RULES = {"7b": ("microsoft/DialoGPT-medium", 4),
              "13b": ("microsoft/DialoGPT-large", 2),
              "30b": ("microsoft/DialoGPT-xlarge", 1)}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def nan_to_null(c) -> Column:
    """NaN and +-inf become NULL (pandas skips NaN in aggregates; Spark does not).
    One comparison: NaN and infinities both fail ``|x| < inf``."""
    x = _c(c)
    return F.when(F.abs(x) < F.lit(float("inf")), x)


def clean_numeric(df: DataFrame, required: str = "reward_mean") -> DataFrame:
    """NaN/inf -> NULL in every floating column, then drop rows whose
    ``required`` value is NULL."""
    out = df.select(*[nan_to_null(f.name).alias(f.name)
                      if f.dataType.typeName() in ("double", "float") else F.col(f.name)
                      for f in df.schema.fields])
    return out.filter(F.col(required).isNotNull())


def parse_run_name(name, config_algorithm=None, config_dataset=None, config_size=None,
                   legacy: bool = False) -> Column:
    """Struct (algorithm, dataset, model_size) parsed from ``algo_dataset_size``.

    The algorithm is the longest known name that prefixes the run name
    followed by ``_`` (so ``grpo_offpolicy_hh_7b`` keeps its underscore);
    otherwise the first ``_`` part.  Names without two more parts fall back to
    the config values, then ``'unknown'``.  ``legacy=True`` always splits on
    ``_``.  Only prefix tests and one single-character split per row.
    """
    n = _c(name)
    fallback = [F.coalesce(_c(c) if c is not None else F.lit(None).cast("string"), F.lit("unknown"))
                for c in (config_algorithm, config_dataset, config_size)]
    first = F.instr(n, "_") - 1
    if legacy:
        alen = first
    else:
        alen = first
        for a in sorted(KNOWN_ALGORITHMS, key=len):      # longest applied last, wins
            alen = F.when(n.startswith(a + "_"), F.lit(len(a))).otherwise(alen)
    rest = F.split(F.substring(n, alen + 2, 1 << 30), "_", 3)
    ok = (alen > 0) & (F.size(rest) >= 2) & (F.length(F.get(rest, 0)) > 0) & (F.length(F.get(rest, 1)) > 0)
    parts = [F.substring(n, 1, alen), F.get(rest, 0), F.get(rest, 1)]
    return F.struct(*[F.when(ok, p).otherwise(f).alias(k) for p, f, k in
                      zip(parts, fallback, ("algorithm", "dataset", "model_size"))])


def metric_value(metrics, key: str) -> Column:
    """Scalar or list-valued metric: a list contributes its last element.
    Missing key -> 0; explicit NULL stays NULL."""
    m = _c(metrics)
    return F.when(F.map_contains_key(m, key), m.getItem(key)).otherwise(F.lit(0.0))


def results_projection(df: DataFrame, name: str = "experiment_name", metrics: str = "metrics",
                       duration_hours: str | None = "duration_hours") -> DataFrame:
    """The 17-column results table from a run name and a ``map<string,double>``
    of metrics.  A key that is absent reads 0 (so does a missing duration); a
    key that is present but NULL stays NULL.  Columns ``config_algorithm`` and
    ``config_dataset``, if there, name what the run name doesn't."""
    fallback = [c if c in df.columns else None for c in ("config_algorithm", "config_dataset")]
    parsed = parse_run_name(name, *fallback)
    cols = [F.col(name).alias("experiment_name"), parsed["algorithm"].alias("algorithm"),
            parsed["dataset"].alias("dataset"), parsed["model_size"].alias("model_size"),
            (F.coalesce(F.col(duration_hours), F.lit(0.0)) if duration_hours else metric_value(metrics, "duration_hours"))
            .cast("double").alias("duration_hours")]
    for k in RESULT_METRICS:
        v = metric_value(metrics, k)
        cols.append((v.cast("bigint") if k == "total_steps" else v.cast("double")).alias(k))
    return df.select(*cols)


def classify_outcome(return_code="return_code", timed_out="timed_out", error=None) -> Column:
    """completed / failed / timeout / error."""
    st = (F.when(_c(timed_out), "timeout")
           .when(_c(return_code) == 0, "completed")
           .when(_c(return_code).isNotNull(), "failed")
           .otherwise("error"))
    if error is not None:
        st = F.when(_c(error).isNotNull(), "error").otherwise(st)
    return st


def seconds_to_hours(seconds) -> Column:
    return _c(seconds) / F.lit(3600.0)


def run_folder_name(ts, prefix: str | None = None) -> Column:
    """``yyyyMMdd_HHmmss`` folder name (optionally ``prefix_`` first)."""
    s = F.date_format(_c(ts), "yyyyMMdd_HHmmss")
    return F.concat(F.lit(prefix + "_"), s) if prefix else s


def experiment_grid(algorithms: DataFrame, datasets: DataFrame, sizes: DataFrame,
                    epoch: str = "epoch") -> DataFrame:
    """Every algorithm x dataset x size with id ``algo_dataset_size_epoch``.

    The three inputs are configuration lists (a handful of rows each); the
    product is the grid by definition.
    """
    g = algorithms.crossJoin(datasets).crossJoin(sizes)
    return g.withColumn("id", F.concat_ws("_", "algorithm", "dataset", "model_size", F.col(epoch).cast("string")))


def resume(grid: DataFrame, state: DataFrame, key: str = "id", done: str = "completed") -> DataFrame:
    """Experiments not yet completed: anti join with the completed state."""
    finished = state.filter(F.col("status") == done).select(key)
    return grid.join(finished, on=key, how="left_anti")


def flatten_overrides(base: DataFrame, overrides: DataFrame, keys=("run", "path")) -> DataFrame:
    """Dotted-key overrides on flattened ``(run, path, value)`` rows; created if
    absent, the override wins."""
    k = list(keys)
    b = base.dropna(subset=k).withColumnRenamed("value", "__base")
    o = overrides.withColumnRenamed("value", "__over")
    return (b.join(o, on=k, how="full_outer")
             .select(*k, F.coalesce("__over", "__base").alias("value")))


def missing_sections(config_paths: DataFrame, required: list[str], run: str = "run",
                     path: str = "path") -> DataFrame:
    """Required top-level sections absent from each run's flattened config."""
    present = config_paths.select(run, F.split(path, r"\.").getItem(0).alias("section")).distinct()
    wanted = (config_paths.select(run).distinct()
              .withColumn("section", F.explode(F.array(*[F.lit(r) for r in required]))))
    return wanted.join(present, on=[run, "section"], how="left_anti")


def size_settings(df: DataFrame, size: str = "model_size") -> DataFrame:
    """Attach the size rule (checkpoint, batch size); unknown sizes keep NULLs."""
    ck = F.create_map(*[x for k, (c, _) in SIZE_RULES.items() for x in (F.lit(k), F.lit(c))])
    bs = F.create_map(*[x for k, (_, b) in SIZE_RULES.items() for x in (F.lit(k), F.lit(b))])
    return (df.withColumn("size_checkpoint", ck[F.col(size)])
              .withColumn("size_batch_size", bs[F.col(size)]))


def records_in_order(df: DataFrame, group: str, order: str, name: str = "position") -> DataFrame:
    """Long form of "records per group sorted by ``order``": each row with its
    0-based position (skew-safe, never one array per group)."""
    return row_index(df, [group], [order], name)


def base_config_lookup(grid: DataFrame, configs: DataFrame, algorithm: str = "algorithm"
                       ) -> tuple[DataFrame, DataFrame]:
    """Attach each experiment's base configuration rows (``(algorithm, path,
    value)``); returns (configured experiments, algorithms without a config).
    A missing config is reported as rows instead of aborting the grid."""
    have = configs.select(algorithm).distinct()
    missing = grid.select(algorithm).distinct().join(have, algorithm, "left_anti")
    return grid.join(configs, algorithm, "inner"), missing
