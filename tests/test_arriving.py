"""Streams over several batches: parts as batches, replay state in buckets."""

import os
import sys
from collections import defaultdict

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as E  # noqa: E402
from prefspark.plans import cat_stream  # noqa: E402
from prefspark.streaming import metrics as sm  # noqa: E402

ROWS, FILES = 20_000, 6


def events(spark, folder):
    """A log in several files, each over the whole time."""
    spark.range(ROWS).selectExpr(
        "id AS event_id", "timestamp_micros(1700000000000000 + id * 1000000) AS ts", "IF(id % 50 = 0, NULL, id * 7 % 90) AS user_id",
        "'train' AS event_type", "id % 13 / 2D AS value", "'' AS props").repartition(FILES).write.parquet(f"{folder}/events.parquet")


def last(rows, size):
    """run -> its last rows by (step, event_id), down."""
    out = defaultdict(list)
    for run, *order in rows:
        out[run].append(tuple(order))
    return {run: sorted(r, reverse=True)[:size] for run, r in out.items()}


def test_each_part_is_one_batch(spark, scratch):
    events(spark, scratch)
    got = []
    sm.run_available(cat_stream._arriving(spark, scratch), "parts", foreach_batch=lambda b, i: got.append(sorted(r[0] for r in b.select("event_id").collect())))
    late = [i for i in range(ROWS) if i % cat_stream.HELD_BACK == 0]
    assert len(got) == cat_stream.PARTS + 1 and got[-1] == late
    assert sorted(sum(got, [])) == list(range(ROWS))
    assert all(a[-1] < b[0] for a, b in zip(got[:-2], got[1:-1]))


def test_parts_without_rows_are_batches_too(spark, scratch):
    spark.range(3).selectExpr("id * 97 AS event_id", "timestamp_micros(id) AS ts", "id AS user_id", "'train' AS event_type", "1D AS value",
                              "'' AS props").write.parquet(f"{scratch}/events.parquet")
    got = []
    sm.run_available(cat_stream._arriving(spark, scratch), "parts-few", foreach_batch=lambda b, i: got.append(b.count()))
    assert sum(got) == 3 and got[-1] == 3


def test_replay_state_query_on_several_files(spark, scratch):
    events(spark, scratch)
    got = E.queries()["t3_replay_state_stream"](spark, scratch).collect()
    want = last([(None if i % 50 == 0 else i * 7 % 90, i, i) for i in range(ROWS)], 50)
    assert sorted((str(r["run_id"]), r["event_id"]) for r in got) == sorted((str(run), e) for run, rows in want.items() for _, e in rows)


def test_replay_state_calls_python_per_bucket(spark, scratch):
    """Runs by name (one null), repeated rows, null order; the state holds one
    row per bucket."""
    rows = [(None if i % 11 == 0 else f"run {i % 40}", i * 37 % 101 if i % 9 else None, i // 2) for i in range(3000)]
    path = f"{scratch}/steps"
    for k in range(3):
        spark.createDataFrame(rows[k::3], "run_id string, step long, event_id long").coalesce(1).write.mode("append").parquet(path)
    s = sm.read_steps(spark, path, spark.read.parquet(path).schema, max_files=1)
    r = sm.run_upsert(sm.replay_state(s, 7, buckets=4), "buckets", ["run_id"]).collect()
    least = -2 ** 63
    want = last([(run, least if step is None else step, e) for run, step, e in rows], 7)
    assert {x["run_id"]: [tuple(b) for b in x["buffer"]] for x in r} == want
    assert sm.replay_state(s, 7, buckets=4).schema["buffer"].dataType.elementType.names == ["step", "event_id"]
    sizes = []
    w = sm.replay_state(s, 7, buckets=4).writeStream.outputMode("update").foreachBatch(lambda b, i: sizes.append(b.count()))
    q = w.option("checkpointLocation", f"{scratch}/ckpt").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sm.progress_of(q).state_rows <= 5 < max(sizes)
