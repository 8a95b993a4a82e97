"""Structured Streaming over step-metric logs.

Every stream has a batch twin in :mod:`prefspark.operators` and is tested
against it with ``trigger(availableNow=True)``.  State lives in Spark's
state store (native aggregates) or in Parquet tables under the shared
checkpoint folder (``foreachBatch`` carry-in); no extra server or port.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefspark.plans.scan import STEP_WIDTH, Running, running
from prefspark.plans.selection import top_n
from prefspark.session import checkpoint_dir, stream_checkpoint

STEP_SCHEMA = T.StructType([
    T.StructField("run_id", T.LongType()), T.StructField("step", T.LongType()),
    T.StructField("ts", T.TimestampType()), T.StructField("phase", T.StringType()),
    T.StructField("reward_mean", T.DoubleType()), T.StructField("event_id", T.LongType()),
])

WATERMARK = "10 minutes"
WINDOW = "5 minutes"
TRIGGER = "10 seconds"
#: rows of the state store that hold all replay buffers of a stream (fixed for
#: the life of a checkpoint)
STATE_BUCKETS = 1024
#: a running stream reports this often
PROGRESS_SECONDS = 300.0


def read_steps(spark: SparkSession, path: str, schema: T.StructType = STEP_SCHEMA,
               fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    """Streaming read of a step-log folder (explicit schema, no inference)."""
    r = spark.readStream.schema(schema).format(fmt)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(path)


def windowed_metrics(steps: DataFrame, ts: str = "ts", run: str = "run_id", value: str = "reward_mean",
                     width: str = WINDOW, watermark: str = WATERMARK) -> DataFrame:
    """Per run and tumbling window: mean, max and count of ``value``; rows
    later than the watermark are dropped."""
    s = steps.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
    return (s.groupBy(F.window(ts, width).alias("w"), run)
             .agg(F.avg(value).alias("mean_value"), F.max(value).alias("max_value"),
                  F.count(F.lit(1)).alias("n"))
             .select(run, F.col("w.start").alias("window_start"), "mean_value", "max_value", "n"))


def running_best(steps: DataFrame, target: float, run: str = "run_id", step: str = "step",
                 value: str = "reward_mean") -> DataFrame:
    """Native streaming aggregate (update mode): best value so far and the
    first step whose value exceeds ``target``."""
    return steps.groupBy(run).agg(
        F.max(value).alias("best"),
        F.min(F.when(F.col(value) > F.lit(target), F.col(step))).alias("first_target_step"),
        F.count(F.lit(1)).alias("steps"))


def alerts(steps: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """Stateless threshold alerts: one row per (row, metric over threshold)."""
    conds = [F.when(F.col(m) > F.lit(t), F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"),
                                                  F.lit(float(t)).alias("threshold")))
             for m, t in thresholds.items()]
    return (steps.withColumn("__a", F.explode(F.filter(F.array(*conds), lambda x: x.isNotNull())))
                 .select("*", "__a.*").drop("__a"))


def dedup_stream(df: DataFrame, key: list[str], ts: str = "ts", watermark: str | None = None) -> DataFrame:
    """Drop repeated keys: over the whole stream (state holds every distinct
    key), or with a ``watermark`` those seen within its delay."""
    if watermark is None:
        return df.dropDuplicates(key)
    return (df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
              .dropDuplicatesWithinWatermark(key))


def latest_status(events: DataFrame, key: str = "id", status: str = "status", ts: str = "ts", tie: list[str] | None = None) -> DataFrame:
    """Latest status per experiment (native aggregate, update mode); equal
    times go by the columns ``tie``."""
    return events.groupBy(key).agg(F.max_by(status, F.struct(ts, *(tie or []))).alias(status), F.max(ts).alias("updated_at"))


def replay_state(steps: DataFrame, size: int, run: str = "run_id", order: tuple[str, ...] = ("step", "event_id"),
                 buckets: int = STATE_BUCKETS) -> DataFrame:
    """Replay buffer as stream state: per run the ``size`` rows that are last
    in ``order`` (integer columns, a null is least).  Update mode: (run, buffer)
    of the runs that a batch touched, ``buffer`` from the last row down.

    Runs are dealt by hash into ``buckets`` (rows without run: one of their
    own), and a bucket's buffers are one packed row of the state store, so
    Python is called and state moved once per bucket and batch, not per run."""
    kind = steps.schema[run].dataType.simpleString()
    arrays = [f"__last{i}" for i in range(len(order))]

    def keep(key, batches, state):
        if state.exists:  # the runs, then their rows in order of run
            runs, counts, packed = state.get
            runs = pa.ipc.open_stream(runs).read_pandas()[run]
            runs = runs.repeat(np.frombuffer(counts, np.int64))
            held = np.frombuffer(packed, np.int64).reshape(len(order), -1)
        else:
            runs, held = None, np.zeros((len(order), 0), np.int64)
        touched = np.zeros(0, bool)
        for pdf in batches:  # a bucket's rows come in bounded pieces
            rows = np.concatenate([held, pdf[list(order)].to_numpy(np.int64).T], axis=1)
            runs = pdf[run] if runs is None else pd.concat([runs, pdf[run]], ignore_index=True)
            # codes in order of appearance: those of the held runs stay
            code, names = (np.zeros(len(runs), np.int64), runs.iloc[:1]) if key[0] < 0 else pd.factorize(runs)
            hit = np.zeros(len(names), bool)
            hit[:len(touched)] = touched
            hit[code[held.shape[1]:]] = True
            touched = hit
            by = np.lexsort([*rows[::-1], -code])[::-1]  # run by run, from the last row down
            ends = np.cumsum(np.bincount(code, minlength=len(names)))
            first = np.concatenate([[0], ends[:-1]])
            by = by[np.arange(len(by)) - first[code[by]] < size]
            held, runs = rows[:, by], runs.iloc[by]
        counts = np.bincount(code[by], minlength=len(names))
        sink = pa.BufferOutputStream()
        table = pa.table({run: pa.array(names, from_pandas=True)})
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        state.update((sink.getvalue().to_pybytes(), counts.astype(np.int64).tobytes(), held.tobytes()))
        at = np.concatenate([[0], np.cumsum(counts)])
        some = np.flatnonzero(touched)
        yield pd.DataFrame({run: pd.Series([None] * len(some), dtype=object) if key[0] < 0 else pd.Series(names[some])}
                           | {a: [held[i, at[r]:at[r + 1]] for r in some] for i, a in enumerate(arrays)})
    least = F.lit(-2 ** 63).cast("bigint")
    rows = steps.select(run, *[F.coalesce(F.col(c).cast("bigint"), least).alias(c) for c in order],
                        F.when(F.col(run).isNull(), -1).otherwise(F.pmod(F.xxhash64(run), F.lit(buckets))).cast("int").alias("__bucket"))
    kept = rows.groupBy("__bucket").applyInPandasWithState(
        keep, f"{run} {kind}, " + ", ".join(f"{a} array<bigint>" for a in arrays), "runs binary, counts binary, held binary", "update", "NoTimeout")
    fields = ", ".join(f"{c}: bigint" for c in order)
    return kept.select(run, F.arrays_zip(*arrays).cast(f"array<struct<{fields}>>").alias("buffer"))


# ----------------------------------------------------------- foreachBatch state
class ParquetState:
    """Carry-in between micro-batches as Parquet tables under the shared
    checkpoint folder, one folder per batch id (``v-<batch id>``).

    Batch ``n`` reads the newest version older than ``n`` and overwrites its
    own version, so a retried batch (after a lost executor or a restarted
    driver) reads the same input and writes the same output: the state is
    exactly-once without holding anything in driver memory.
    """

    def __init__(self, spark: SparkSession, name: str, schema: T.StructType | str):
        self.spark = spark
        self.base = f"{checkpoint_dir(spark).rstrip('/')}/state/{name}"
        self.schema = schema

    def _versions(self) -> list[int]:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.base)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        out = []
        for st in fs.listStatus(path):
            n = st.getPath().getName()
            if n.startswith("v-") and fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
                out.append(int(n[2:]))
        return sorted(out)

    def read(self, before: int | None = None) -> DataFrame:
        """Newest committed version (older than batch ``before`` if given)."""
        vs = [v for v in self._versions() if before is None or v < before]
        if not vs:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.base}/v-{vs[-1]:012d}")

    def write(self, df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.base}/v-{batch_id:012d}")


def new_best_batch(batch: DataFrame, carry: DataFrame, run: str = "run_id", step: str = "step",
                   value: str = "reward_mean", tie: list[str] | None = None,
                   width: float | None = STEP_WIDTH) -> tuple[DataFrame, DataFrame]:
    """Per-step ``new_best`` flags for one micro-batch given the stored best
    per run; returns (flags, new carry).  Runs are windowed independently;
    equal steps go by the columns ``tie``.  ``width`` cuts a hot run by step
    index; None, for steps that aren't indexes, by the batch's range."""
    b = batch.join(carry.withColumnRenamed("best", "__carry"), run, "left")
    # skew-safe running max within the batch (a hot run is not one task)
    r = running(b, [run], [step, *(tie or [])], {"__prev": Running("max", value, inclusive=False)}, width=width)
    prev = F.greatest(F.coalesce(F.col("__prev"), F.lit(float("-inf"))),
                      F.coalesce(F.col("__carry"), F.lit(float("-inf"))))
    flags = r.withColumn("new_best", F.col(value) > prev).drop("__carry", "__prev")
    new_carry = (flags.groupBy(run).agg(F.max(value).alias("__m"))
                 .join(carry, run, "full_outer")
                 .select(run, F.greatest("__m", "best").alias("best")))
    return flags, new_carry


def replay_batch(batch: DataFrame, buffer: DataFrame, size: int, run: str = "run_id",
                 step: str = "step", tie: list[str] | None = None) -> DataFrame:
    """New replay buffer after one micro-batch: latest ``size`` per run of the
    stored buffer plus the batch (bounded state: at most ``size`` rows per run)."""
    u = buffer.unionByName(batch.select(*buffer.columns))
    return top_n(u, [run], F.struct(step, *(tie or [])), size, largest=True)


def _start(df: DataFrame, name: str, sink_path: str | None, mode: str, foreach_batch, **trigger):
    spark = df.sparkSession
    ckpt = stream_checkpoint(spark, f"{name}-{uuid.uuid4().hex}")
    w = df.writeStream.option("checkpointLocation", ckpt).outputMode(mode).trigger(**trigger)
    if foreach_batch is not None:
        return w.foreachBatch(foreach_batch).start(), sink_path
    sink_path = sink_path or f"{checkpoint_dir(spark).rstrip('/')}/sinks/{name}-{uuid.uuid4().hex}"
    return w.format("parquet").option("path", sink_path).start(), sink_path


def run_available(df: DataFrame, name: str, sink_path: str | None = None, mode: str = "append",
                  foreach_batch=None) -> str:
    """Run a stream over everything available now (``availableNow``) into a
    Parquet sink (or a ``foreachBatch`` function); returns the sink path."""
    q, sink_path = _start(df, name, sink_path, mode, foreach_batch, availableNow=True)
    q.awaitTermination()
    return sink_path or ""


@dataclass(frozen=True)
class Progress:
    """What a running stream reports: the last batch, the rows it read, the
    rows in its state and its watermark."""

    batch_id: int
    input_rows: int
    state_rows: int
    watermark: str | None


def progress_of(query) -> Progress | None:
    """The stream's last batch, None before the first."""
    p = query.lastProgress
    if p is None:
        return None
    p = json.loads(p.json) if hasattr(p, "json") and not isinstance(p, dict) else p
    return Progress(p["batchId"], sum(s["numInputRows"] for s in p["sources"]), sum(o["numRowsTotal"] for o in p.get("stateOperators", [])),
                    (p.get("eventTime") or {}).get("watermark"))


def run_triggered(df: DataFrame, name: str, sink_path: str | None = None, mode: str = "append", foreach_batch=None,
                  trigger: str = TRIGGER, every: float = PROGRESS_SECONDS, report=None, until=None) -> str:
    """Run a stream for long: a micro-batch every ``trigger``, and every
    ``every`` seconds a :class:`Progress` to ``report``; the stream stops when
    ``until`` of one is true (by default it runs on).  A failed stream raises."""
    q, sink_path = _start(df, name, sink_path, mode, foreach_batch, processingTime=trigger)
    try:
        while not q.awaitTermination(every):
            now = progress_of(q)
            if now is not None:
                if report is not None:
                    report(now)
                if until is not None and until(now):
                    break
    finally:
        q.stop()
    return sink_path or ""


def run_upsert(df: DataFrame, name: str, keys: list[str], mode: str = "update") -> DataFrame:
    """Run an aggregate stream in update mode over everything available;
    each micro-batch's rows are appended with the batch id and the latest
    version per key is returned (an upsert read)."""
    spark = df.sparkSession
    out = f"{checkpoint_dir(spark).rstrip('/')}/sinks/{name}-{uuid.uuid4().hex}"
    written = []

    def write(batch: DataFrame, batch_id: int) -> None:
        written.append(batch_id)
        batch.withColumn("__batch", F.lit(batch_id)).write.mode("append").parquet(out)

    run_available(df, name, mode=mode, foreach_batch=write)
    if not written:
        return spark.createDataFrame([], df.schema)
    res = spark.read.parquet(out)
    cols = [c for c in res.columns if c not in keys and c != "__batch"]
    latest = res.groupBy(*keys).agg(F.max_by(F.struct(*cols), "__batch").alias("__v"))
    return latest.select(*keys, *[F.col(f"__v.{c}").alias(c) for c in cols])
