"""Run folders: ``<root>/<run>/experiment_summary.json``, ``metrics.json`` and
``config.yaml``, each optional.  Read as whole documents by the data source of
:mod:`prefspark.sources.runsource`, and merged by run name."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefspark.sources.runsource import read_run_folders

SUMMARY = "experiment_summary.json"
METRICS = "metrics.json"
CONFIG = "config.yaml"


def _metric_map(doc: Column, nested: str | None = None) -> Column:
    """``map<string,double>`` of the numeric entries of a JSON object; a list
    value contributes its last element; explicit nulls stay NULL."""
    obj = F.from_json(doc if nested is None else F.get_json_object(doc, f"$.{nested}"),
                      "map<string,string>")

    def value(v):
        arr = F.from_json(v, "array<double>")
        return F.when(F.trim(v).startswith("["), F.element_at(arr, -1)).otherwise(v.try_cast("double"))
    return F.transform_values(obj, lambda k, v: value(v))


def _merged(a: Column, b: Column) -> Column:
    """Both maps' entries; those of ``b`` win."""
    return F.map_zip_with(a, b, lambda k, va, vb: F.when(F.map_contains_key(b, k), vb).otherwise(va))


def scan_runs(spark: SparkSession, root: str) -> DataFrame:
    """Merge summary, metrics and config per run (grouped by the run's name;
    each file may be absent).

    Metrics: the summary's top level, then its ``final_metrics``, then
    ``metrics.json`` (whose own ``final_metrics`` replaces the summary's);
    later sources win.  ``config.yaml`` replaces a config inside the others.
    """
    found = read_run_folders(spark, root, [SUMMARY, METRICS])

    def doc(name):
        return F.first(F.when(F.col("file") == name, F.decode("content", "utf-8")), ignorenulls=True)
    docs = found.groupBy("run").agg(doc(SUMMARY).alias("summary_doc"), doc(METRICS).alias("metrics_doc"))
    c = scan_configs(spark, root).groupBy("run").agg(
        F.max(F.when(F.col("path") == "algorithm", F.col("value"))).alias("yaml_algorithm"),
        F.max(F.when(F.col("path") == "dataset.name", F.col("value"))).alias("yaml_dataset"),
        F.lit(True).alias("has_yaml"))
    j = docs.join(c, "run", "full_outer")
    empty = F.create_map().cast("map<string,double>")
    top = F.coalesce(_metric_map(F.col("summary_doc")), empty)
    later = _metric_map(F.col("metrics_doc"), "final_metrics")
    fin = F.coalesce(later, _metric_map(F.col("summary_doc"), "final_metrics"), empty)
    met = F.coalesce(_metric_map(F.col("metrics_doc")), empty)
    top, met = (F.map_filter(x, lambda k, v: k != "final_metrics") for x in (top, met))

    def newest(path):
        return F.coalesce(F.get_json_object("metrics_doc", path), F.get_json_object("summary_doc", path))
    metrics = empty
    for later_map in (top, fin, met, F.coalesce(later, empty)):
        metrics = _merged(metrics, later_map)
    return j.select(
        "run", newest("$.experiment_duration_hours").try_cast("double").alias("duration_hours"),
        F.when(F.col("has_yaml"), F.col("yaml_algorithm")).otherwise(newest("$.config.algorithm")).alias("config_algorithm"),
        F.when(F.col("has_yaml"), F.col("yaml_dataset")).otherwise(newest("$.config.dataset.name")).alias("config_dataset"),
        metrics.alias("metrics"))


# ------------------------------------------------------------------ YAML
def _flatten(obj, prefix=""):
    """Dotted paths of the leaves of a nested mapping."""
    if isinstance(obj, dict):
        for k, v in obj.items():
            yield from _flatten(v, f"{prefix}{k}.")
    elif prefix:
        yield prefix[:-1], obj


def _as_text(v) -> str | None:
    if v is None:
        return None
    if isinstance(v, bool):
        return "true" if v else "false"
    return str(v)


def _as_double(v) -> float | None:
    # YAML 1.1 reads "1e-5" as a string: numeric-looking strings count
    if isinstance(v, bool) or v is None:
        return None
    try:
        return float(v)
    except (TypeError, ValueError):
        return None


CONFIG_SCHEMA = T.StructType([T.StructField("run", T.StringType()), T.StructField("path", T.StringType()),
                              T.StructField("value", T.StringType()),
                              T.StructField("num", T.DoubleType())])


def scan_configs(spark: SparkSession, root: str, fname: str = CONFIG) -> DataFrame:
    """Flattened ``(run, path, value, num)`` rows of every run's YAML config
    (read and parsed inside the tasks).  A broken or empty config gives one
    row with a NULL path."""
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml
        for b in batches:
            rows = []
            for run, content in zip(b["run"], b["content"]):
                try:
                    doc = yaml.safe_load(bytes(content).decode("utf-8")) or {}
                except (yaml.YAMLError, UnicodeDecodeError):
                    doc = {}
                leaves = list(_flatten(doc)) or [(None, None)]
                rows += [(run, path, _as_text(v), _as_double(v)) for path, v in leaves]
            yield pd.DataFrame(rows, columns=["run", "path", "value", "num"])

    return read_run_folders(spark, root, [fname]).mapInPandas(parse, CONFIG_SCHEMA)


def save_config_rows(df: DataFrame, out: str) -> None:
    """Write flattened config rows, one folder per run (Parquet)."""
    df.write.mode("overwrite").partitionBy("run").parquet(out)
