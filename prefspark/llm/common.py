"""Helpers shared by the training-data operators: the shared folder, saved
intermediate tables, Arrow text buffers and packed numpy columns."""

from __future__ import annotations

import ctypes
import functools
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: text processed at once inside a task, in bytes (one longer text goes alone)
SLICE_BYTES = 4 << 20
#: Arrow batches between the JVM and Python workers, if the session sets none
BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Unset on a cluster it is an error; a local session gets a scratch folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "local")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="prefspark-llm-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts
    the lineage with files that outlive executors, and gives the planner
    measured sizes."""
    spark = df.sparkSession
    for name_, value in BATCH.items():
        if spark.conf.get(name_, None) is None:
            spark.conf.set(name_, value)
    path = f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release() -> None:
    """Give freed memory of this Python worker back to the system; workers
    live on from task to task and would keep their peak."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: nothing to give back by hand


#: caches that a Python worker keeps from task to task
_worker_caches = []


def worker_cache(fn):
    """Keep the last result of ``fn`` in the Python worker for the tasks of
    its module; it is dropped when a task of another module begins there."""
    cached = functools.lru_cache(maxsize=1)(fn)
    _worker_caches.append(cached)
    return cached


def task(fn):
    """For generators that run in tasks: release memory when they end, and
    before they begin what other modules' tasks have kept."""
    @functools.wraps(fn)
    def run(batches, *args):
        old = [c for c in _worker_caches if c.__module__ != fn.__module__ and c.cache_info().currsize]
        for cached in old:
            cached.cache_clear()
        if old:
            release()
        yield from fn(batches, *args)
        release()
    return run


def text_buffers(col) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets of an Arrow string column (no copies of
    the text; null reads as empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary())
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset:col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Row ranges of at most ``limit`` bytes of text (one row at least)."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def by_bucket(bucket: np.ndarray):
    """(bucket, row indexes) of each bucket present, rows in their order."""
    order = np.argsort(bucket.astype(np.int16) if len(bucket) and bucket.max() < 32768 else bucket, kind="stable")
    keys, first = np.unique(bucket[order], return_index=True)
    for i, key in enumerate(keys):
        yield int(key), order[first[i]:first[i + 1] if i + 1 < len(keys) else len(order)]


def joined(blobs, dtype) -> np.ndarray:
    """One array from many packed ones."""
    return np.frombuffer(b"".join(blobs), dtype)


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def record_batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def sample_rows(labelled: DataFrame, by: str, per_value: int, key: str = "doc_id") -> DataFrame:
    """(key, <by>) of at most ``per_value`` distinct keys of each value of
    ``by``, those with the smallest hashes; nulls are left out.

    The number of distinct keys of a value is estimated by a sketch (standard
    error 2 %), and keys beyond twice the hash bound that it gives are dropped
    where they are read, so a value that holds most rows sends about
    ``2 per_value`` keys on, however often each is repeated."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    rows = labelled.select(key, by).where(F.col(key).isNotNull() & F.col(by).isNotNull()).withColumn("_h", F.xxhash64(key))
    # saved, so the join below knows its size: one row per value
    counts = saved(rows.groupBy(by).agg(F.approx_count_distinct(key, 0.02).alias("_c")), "sample-counts")
    bound = F.lit(-2.0 ** 63) + F.lit(2.0 ** 64) * (F.lit(2.0 * per_value + 50) / F.col("_c"))
    near = rows.join(counts, by).where((F.col("_c") <= 4 * per_value) | (F.col("_h").cast("double") <= bound)).select(key, by, "_h").distinct()
    ranked = near.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy("_h", key)))
    return saved(ranked.where(F.col("_n") <= per_value).select(key, by), "sample")


def one_text(rows: DataFrame, by: list[str], text_col: str = "text") -> DataFrame:
    """One text for each combination of ``by``: the one with the smallest
    hash.  A partial aggregate, so keys repeated often keep one text a task."""
    from pyspark.sql import functions as F
    best = F.min(F.struct(F.xxhash64(text_col).alias("h"), F.col(text_col).alias("t")))
    return rows.groupBy(*by).agg(best.alias("_b")).select(*by, F.col("_b.t").alias(text_col))
