"""Sinks: CSV / JSON / Parquet writers for results, reports and metric logs.

All writers take a folder on shared storage and let Spark write one file
per task; partitioned writes make later reads prune by run or algorithm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from prefspark.operators.steps import melt_metrics


def write_csv(df: DataFrame, out: str, mode: str = "overwrite") -> None:
    """Processed metrics as CSV with a header."""
    df.write.mode(mode).option("header", True).csv(out)


def write_json(df: DataFrame, out: str, mode: str = "overwrite") -> None:
    """JSON-lines result (summary, report, experiment list, tracking state)."""
    df.write.mode(mode).json(out)


def write_table(df: DataFrame, out: str, partition_by: list[str] | None = None,
                mode: str = "overwrite") -> None:
    """Parquet table, optionally partitioned (e.g. by run or algorithm).

    Rows are first dealt by the partition columns, so a folder gets few files
    instead of one from every task; a hot one is split by size."""
    if not partition_by:
        df.write.mode(mode).parquet(out)
        return
    cols = ", ".join(f"`{c}`" for c in partition_by)
    dealt = df.sparkSession.sql(f"SELECT /*+ REBALANCE({cols}) */ * FROM {{df}}", df=df)
    dealt.write.mode(mode).partitionBy(*partition_by).parquet(out)


def append_metric_log(steps: DataFrame, out: str, ids: list[str], metrics: list[str],
                      partition_by: str = "run_id") -> None:
    """Melt step metrics to ``(ids.., metric, value)`` and append them to a
    Parquet log partitioned by run."""
    write_table(melt_metrics(steps, ids, metrics), out, [partition_by], mode="append")


def export(df: DataFrame, out: str, fmt: str) -> None:
    """Results export in one of the supported formats (json, csv, parquet)."""
    if fmt == "json":
        write_json(df, out)
    elif fmt == "csv":
        write_csv(df, out)
    elif fmt == "parquet":
        write_table(df, out)
    else:
        raise ValueError(f"unsupported export format {fmt!r} (json, csv, parquet)")


def save_generations(df: DataFrame, out: str, run: str = "run_id") -> None:
    """Append generated samples to a Parquet table partitioned by run."""
    write_table(df, out, [run], mode="append")
