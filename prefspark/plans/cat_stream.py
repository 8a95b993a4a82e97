"""Checked queries: Structured Streaming over the events log (T1-T6, P20).

Each query streams the whole ``events`` table with ``trigger(availableNow)``
into a sink under the shared checkpoint folder and returns the sink's
contents; update-mode aggregates are upserted per micro-batch (the latest
batch wins per key).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefspark.plans.registry import register
from prefspark.session import checkpoint_dir
from prefspark.streaming import metrics as sm


def _events_stream(spark, sf) -> DataFrame:
    path = f"{sf.rstrip('/')}/events.parquet"
    schema = spark.read.parquet(path).schema
    # file streams watch a folder: the table folder, filtered to this file
    s = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf.rstrip("/"))
    return s.select(F.col("user_id").alias("run_id"), F.col("ts").cast("timestamp").alias("ts"),
                    F.col("event_type").alias("phase"), F.col("value").alias("reward_mean"), "event_id")


def _upsert_sink(df: DataFrame, name: str, keys: list[str], mode: str = "update") -> DataFrame:
    return sm.run_upsert(df, name, keys, mode)


EPOCH_WINDOW = "CAST(epoch(time_bucket(INTERVAL '5 minutes', ts)) AS BIGINT)"


@register("t1_windowed_metrics_stream", f"""
SELECT user_id AS run_id, {EPOCH_WINDOW} AS window_start, round(avg(value), 6) AS mean_value,
       round(max(value), 6) AS max_value, count(*) AS n
FROM events GROUP BY ALL""")
def t1_windowed_metrics_stream(spark, sf):
    w = sm.windowed_metrics(_events_stream(spark, sf))
    r = _upsert_sink(w, "t1", ["run_id", "window_start"])
    return r.withColumn("window_start", (F.unix_micros("window_start") / 1000000).cast("bigint"))


@register("t2_running_best_stream", """
SELECT user_id AS run_id, round(max(value), 6) AS best,
       CAST(floor(epoch(min(CASE WHEN value > 200 THEN ts END))) AS DOUBLE) AS first_target_ts, count(*) AS steps
FROM events GROUP BY user_id""")
def t2_running_best_stream(spark, sf):
    s = _events_stream(spark, sf)
    agg = sm.running_best(s.withColumn("step", F.unix_micros("ts")), 200.0)
    r = _upsert_sink(agg, "t2", ["run_id"])
    first = F.floor(F.col("first_target_step") / 1000000).cast("double")
    return r.select("run_id", "best", first.alias("first_target_ts"), "steps")


@register("t3_replay_buffer_stream", """
SELECT user_id AS run_id, event_id FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 50""")
def t3_replay_buffer_stream(spark, sf):
    """Bounded replay state carried between micro-batches in a Parquet table."""
    s = _events_stream(spark, sf).withColumn("step", F.unix_micros("ts"))
    state = sm.ParquetState(spark, f"t3-{uuid.uuid4().hex}", s.select("run_id", "step", "event_id").schema)

    def step(batch: DataFrame, batch_id: int) -> None:
        b = batch.select("run_id", "step", "event_id")
        state.write(sm.replay_batch(b, state.read(before=batch_id), 50, tie=["event_id"]), batch_id)

    sm.run_available(s, "t3", foreach_batch=step)
    return state.read().select("run_id", "event_id")


#: parts of the event log that arrive in order of time, and the rows held back
#: until after them
PARTS, HELD_BACK = 4, 97


def _arriving(spark, sf) -> DataFrame:
    """Stream over the whole event log in ``PARTS + 1`` batches: ``PARTS`` spans
    of time one after the other, then every ``HELD_BACK``-th event, late.

    A batch takes a fixed number of files in order of their time, so each part
    is written as that many, the last ones empty where its rows fill fewer:
    a part is one batch, however large the log is."""
    e = spark.read.parquet(f"{sf.rstrip('/')}/events.parquet").select(
        F.col("user_id").alias("run_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("phase"),
        F.col("value").alias("reward_mean"), "event_id")
    at = F.unix_micros("ts")
    first, last = e.agg(F.min(at), F.max(at)).first()
    part = F.when(F.col("event_id") % HELD_BACK == 0, PARTS).otherwise(F.least(F.floor((at - F.lit(first)) * PARTS / F.lit(max(1, last - first))), F.lit(PARTS - 1)))
    path = f"{checkpoint_dir(spark).rstrip('/')}/arriving-{uuid.uuid4().hex}"
    files = max(1, spark.sparkContext.defaultParallelism)
    jvm = spark._jvm
    folder, spare = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}-empty"))
    spark.createDataFrame([], e.schema).write.parquet(spare.toString())
    conf = spark._jsc.hadoopConfiguration()
    fs = folder.getFileSystem(conf)

    def written(at) -> list:
        return [f.getPath() for f in fs.listStatus(at) if f.getPath().getName().startswith("part-")]
    for k in range(PARTS + 1):  # one write each, so the files' times are in this order
        e.where(part == k).coalesce(files).write.mode("append").parquet(path)
        for i in range(files * (k + 1) - len(written(folder))):
            to = jvm.org.apache.hadoop.fs.Path(folder, f"part-{k}-empty-{i}.parquet")
            jvm.org.apache.hadoop.fs.FileUtil.copy(fs, written(spare)[0], fs, to, False, conf)
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", files).parquet(path)


_PARTED = f"""
WITH b AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events),
p AS (SELECT user_id AS run_id, ts, value, event_id, epoch_us(ts) AS us,
  CASE WHEN event_id % {HELD_BACK} = 0 THEN {PARTS} ELSE least(floor((epoch_us(ts) - lo) * {PARTS} / greatest(1, hi - lo)), {PARTS - 1}) END AS part
  FROM events, b)"""


@register("t1_late_rows_stream", _PARTED + f""",
w AS (SELECT max(us) FILTER (WHERE part < {PARTS - 1}) - 600000000 AS mark FROM p),
k AS (SELECT p.*, us // 300000000 * 300 AS window_start FROM p, w WHERE part < {PARTS} OR (us // 300000000 + 1) * 300000000 > mark)
SELECT run_id, CAST(window_start AS BIGINT) AS window_start, round(avg(value), 6) AS mean_value, round(max(value), 6) AS max_value, count(*) AS n
FROM k GROUP BY 1, 2""")
def t1_late_rows_stream(spark, sf):
    """Windowed metrics over several batches; of the rows that come last,
    those of windows that the watermark had passed before the last batch but
    one are dropped."""
    r = _upsert_sink(sm.windowed_metrics(_arriving(spark, sf)), "t1-late", ["run_id", "window_start"])
    return r.withColumn("window_start", (F.unix_micros("window_start") / 1000000).cast("bigint"))


@register("t3_replay_state_stream", """
SELECT user_id AS run_id, event_id FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 50""")
def t3_replay_state_stream(spark, sf):
    """The replay buffer as stream state, over several batches of which the
    last holds older rows."""
    s = _arriving(spark, sf).withColumn("step", F.unix_micros("ts"))
    r = _upsert_sink(sm.replay_state(s, 50), "t3-state", ["run_id"])
    return r.select("run_id", F.explode("buffer").alias("b")).select("run_id", "b.event_id")


@register("t4_live_status_stream", """
WITH l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY user_id)
SELECT status, count(*) AS runs FROM l GROUP BY status""")
def t4_live_status_stream(spark, sf):
    s = _events_stream(spark, sf)
    latest = sm.latest_status(s.withColumnRenamed("phase", "status"), "run_id", tie=["event_id"])
    r = _upsert_sink(latest, "t4", ["run_id"])
    return r.groupBy("status").agg(F.count(F.lit(1)).alias("runs"))


@register("t5_threshold_alerts_stream", """
SELECT user_id AS run_id, event_id, 'reward_mean' AS metric, round(value, 6) AS value,
       CAST(400.0 AS DOUBLE) AS threshold FROM events WHERE value > 400""")
def t5_threshold_alerts_stream(spark, sf):
    s = _events_stream(spark, sf)
    a = sm.alerts(s, {"reward_mean": 400.0}).select("run_id", "event_id", "metric", "value", "threshold")
    out = sm.run_available(a, "t5")
    return spark.read.parquet(out)


@register("t6_dedup_stream", """
SELECT DISTINCT user_id AS run_id, event_type AS phase FROM events""")
def t6_dedup_stream(spark, sf):
    s = _events_stream(spark, sf)
    d = sm.dedup_stream(s, ["run_id", "phase"]).select("run_id", "phase")
    out = sm.run_available(d, "t6")
    return spark.read.parquet(out)


@register("p20_resource_alerts", """
SELECT user_id AS run_id, event_id, round(value / 500.0, 6) AS gpu_memory_share
FROM events WHERE value / 500.0 > 0.9""")
def p20_resource_alerts(spark, sf):
    """Batch twin of the alert stream: GPU-memory share (value / 500) above .9."""
    e = spark.read.parquet(f"{sf.rstrip('/')}/events.parquet")
    s = e.select(F.col("user_id").alias("run_id"), "event_id",
                 (F.col("value") / 500.0).alias("gpu_memory_share"))
    return sm.alerts(s, {"gpu_memory_share": 0.9}).select("run_id", "event_id", "gpu_memory_share")


@register("t2_new_best_flags_stream", """
SELECT user_id AS run_id, event_id,
       value > coalesce(max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '-inf'::DOUBLE) AS new_best
FROM events""")
def t2_new_best_flags_stream(spark, sf):
    """Per-step "new best" flags over the event stream: each micro-batch runs
    the batch operator with the stored best per run as carry-in (restart-safe
    Parquet state keyed by batch id); flagged rows are appended to a sink."""
    s = _events_stream(spark, sf).withColumn("step", F.unix_micros("ts"))
    state = sm.ParquetState(spark, f"t2b-{uuid.uuid4().hex}", "run_id long, best double")
    out = f"{checkpoint_dir(spark).rstrip('/')}/sinks/t2b-{uuid.uuid4().hex}"

    def step(batch: DataFrame, batch_id: int) -> None:
        flags, carry = sm.new_best_batch(batch, state.read(before=batch_id), tie=["event_id"], width=None)
        # one folder per batch id: a retried batch overwrites its own output
        flags.select("run_id", "event_id", "new_best").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        state.write(carry, batch_id)

    sm.run_available(s, "t2b", foreach_batch=step)
    return spark.read.parquet(out).select("run_id", "event_id", "new_best")
