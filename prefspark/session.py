"""Spark session defaults and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job in this package assumes.  AQE re-plans joins and
# coalesces shuffle partitions at runtime; skew-join splitting handles hot
# keys (a run or prompt holding a large share of all rows).
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # map_concat with later-file-wins semantics (run-folder merge)
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # Whole-stage methods above 8 KB of bytecode are never JIT-compiled by
    # HotSpot; split such stages instead of running them interpreted (wide
    # projections such as the 17-column results table were 4x slower).
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

# Runtime SQL settings applied to a caller's existing session when unset.
RUNTIME_DEFAULTS = {
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Batches to Python workers by size (2 MB): 10,000 rows of long texts would be
    # hundreds of megabytes in a worker, several times over as objects.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(2 << 20),
}


def tune(spark: SparkSession) -> None:
    """Apply :data:`RUNTIME_DEFAULTS` to a session the caller built, without
    overriding values the caller set explicitly."""
    for k, v in RUNTIME_DEFAULTS.items():
        if spark.conf.get(k, None) in (None, "65535"):
            spark.conf.set(k, v)


def build_session(master: str | None = None, app: str = "prefspark",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Return a session with the package defaults.

    ``master`` is only set when given (on a cluster the launcher sets it).
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder is set by the cluster configuration and is
    shared by all executors; unset, it is an error there.  A local session
    gets a fresh scratch folder.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect clients have no SparkContext
        sc = None
    if sc is not None and sc.getCheckpointDir():
        return sc.getCheckpointDir()
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf and sc is not None:
        conf = sc.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        if sc is None or not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        conf = tempfile.mkdtemp(prefix="prefspark-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        try:
            spark.conf.set("spark.checkpoint.dir", conf)
        except Exception:  # noqa: BLE001 - some sessions refuse core settings at runtime
            pass
    if sc is None:
        return conf
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def stream_checkpoint(spark: SparkSession, name: str) -> str:
    """Checkpoint location for a streaming query, below the shared folder."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/streams/{name}"


def ship_package(spark: SparkSession) -> str:
    """Send this package to the executors' Python workers, for sessions that
    don't start in the repository's folder.  Returns the archive's path."""
    import shutil

    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    made = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="prefspark-"), "prefspark"), "zip", here, "prefspark")
    spark.sparkContext.addPyFile(made)
    return made
