"""Skew-safe ordered running aggregates (a segmented prefix scan).

A plain ``agg(..) OVER (PARTITION BY run ORDER BY step ROWS UNBOUNDED
PRECEDING)`` puts every row of a run into one task.  When one run holds a
large share of all rows that task is the whole job.  Here the rows, in the
order of (group, order columns), are cut into chunks that are windowed in
parallel; a small table of per-(chunk, group) totals supplies the carry-in
from earlier chunks of the same group.  Only associative aggregates (count,
sum, max, min) are allowed.

Chunks are equi-depth: their bounds are every k-th key of a uniform sample of
the whole keys, so neither an outlier, nor a text key, nor ties in the first
order column, nor a hot group makes a chunk much larger than the mean.  A
group that is not split has one total, so there are at most
``#chunks + #groups`` of them.  Step indexes take fixed-width chunks instead,
which need no sample.

The chunk is computed from the data (not from partition ids), so the local
windows and the totals agree however Spark plans or re-runs the two branches.
Sample and totals read the key and value columns only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_CHUNK = "__chunk"
_KEY = "__key"


@dataclass(frozen=True)
class Running:
    """One running aggregate: ``fn`` over ``col``; ``inclusive`` = frame ends at
    the current row, otherwise at the row before it.  ``whole`` = the
    aggregate of the whole group on every row."""

    fn: str  # "count" | "sum" | "max" | "min"
    col: str | Column | None = None
    inclusive: bool = True
    whole: bool = False


_AGG = {"count": F.count, "sum": F.sum, "max": F.max, "min": F.min}


def _combine(fn: str, carry: Column, local: Column) -> Column:
    if fn in ("count", "sum"):
        return F.when(carry.isNull(), local).when(local.isNull(), carry).otherwise(carry + local)
    if fn == "max":
        return F.greatest(carry, local)
    return F.least(carry, local)


#: bounds are drawn from this many sampled keys per chunk: a chunk then holds
#: 64 of them on average, give or take 8
SAMPLED_PER_CHUNK = 64
#: chunks at most; their bounds are one array in every task
MAX_CHUNKS = 1024


def sampled_rows(df: DataFrame, cols: list[str], n: int) -> DataFrame:
    """The ``n`` rows (``cols``, ``__u``) with the smallest hash ``__u`` in
    [0, 1); all if there are fewer.

    A task can tell from its own number and its row number that a hash is too
    large to be among the ``n`` smallest of a table of equal tasks, so tasks
    send few rows: ``n / (task + 1)`` (8 at least) times a logarithm."""
    u = F.shiftrightunsigned(F.xxhash64(*cols), 1) / F.lit(2.0 ** 63)
    rows = df.select(*cols, F.monotonically_increasing_id().alias("__at"), u.alias("__u"))
    row, part = F.col("__at").bitwiseAND((1 << 33) - 1) + 1, F.shiftright("__at", 33) + 1
    few = rows.where(F.col("__u") * row < F.greatest(F.lit(8.0), F.lit(float(n)) / part))
    return few.orderBy("__u").limit(n).drop("__at")


def splitters(df: DataFrame, key: Column, n: int) -> DataFrame:
    """One row, one array: ``n - 1`` keys that cut the rows into ``n`` parts
    of about equal size."""
    picked = f"transform(sequence(1, {n - 1}), i -> get(keys, int(i * bigint(size(keys)) / {n})))"
    few = sampled_rows(df.select(key.alias("__k")), ["__k"], SAMPLED_PER_CHUNK * n)
    return few.agg(F.sort_array(F.collect_list("__k")).alias("keys")).select(F.expr(picked).alias("bounds"))


def with_chunk(df: DataFrame, key: Column, n: int, name: str = _CHUNK) -> DataFrame:
    """Add the number of splitters up to the row's key: 0 to ``n - 1``, rising
    with the key."""
    n = min(n, MAX_CHUNKS)
    if n <= 1:
        return df.withColumn(name, F.lit(0))
    steps = F.array(*[F.lit(1 << k) for k in range((n - 1).bit_length() - 1, -1, -1)])

    def search(bounds):  # binary search, one bit of the answer a step
        def step(lo, s):
            return F.when((lo + s <= F.size(bounds)) & (F.get(bounds, lo + s - 1) <= key), lo + s).otherwise(lo)
        return F.aggregate(steps, F.lit(0), step)
    found = df.withColumn("__bounds", splitters(df, key, n).scalar())
    return found.withColumn(name, F.transform(F.array("__bounds"), search)[0]).drop("__bounds")


def running(df: DataFrame, by: list[str], order: list[str], out: dict[str, Running],
            chunks: int | None = None, width: float | None = None) -> DataFrame:
    """Add one column per entry of ``out`` holding the running aggregate.

    ``by + order`` must identify a row uniquely (ties would make the row
    order, and so the result, arbitrary).  Nulls of an order column come
    first.  ``width`` cuts the first order column, a step index, in fixed
    steps; otherwise there are ``chunks`` equi-depth chunks."""
    spark = df.sparkSession
    n = chunks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if width is not None:
        keyed = df.withColumn(_CHUNK, F.coalesce(F.floor(F.col(order[0]) / F.lit(float(width))).cast("long"), F.lit(-1)))
    else:
        keyed = with_chunk(df, F.struct(*by, *order), n)
    # a struct of the group columns: in a join, NULL equals NULL inside it
    keyed = keyed.withColumn(_KEY, F.struct(*by)) if by else keyed
    key = [_KEY] if by else []
    vals = {name: (F.lit(1) if r.col is None else F.col(r.col) if isinstance(r.col, str) else r.col) for name, r in out.items()}

    # Per-chunk totals of each group, then carry = total of earlier chunks.
    totals = keyed.groupBy(_CHUNK, *key).agg(*[_AGG[r.fn](vals[name]).alias(f"__tot_{name}") for name, r in out.items()])
    w_all = Window.partitionBy(*key)
    w_prev = w_all.orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carries = totals.select(_CHUNK, *key, *[
        _AGG["sum" if r.fn == "count" else r.fn](f"__tot_{name}").over(w_all if r.whole else w_prev).alias(f"__carry_{name}")
        for name, r in out.items()])

    w_loc = Window.partitionBy(_CHUNK, *key).orderBy(*order)
    local = keyed.withColumns({
        f"__loc_{name}": _AGG[r.fn](vals[name]).over(w_loc.rowsBetween(Window.unboundedPreceding, 0 if r.inclusive else -1))
        for name, r in out.items() if not r.whole})

    joined = local.join(carries, on=[_CHUNK, *key], how="left")
    keep = [F.col(f"`{c}`") for c in df.columns if c not in out]
    return joined.select(*keep, *[
        (F.col(f"__carry_{name}") if r.whole else _combine(r.fn, F.col(f"__carry_{name}"), F.col(f"__loc_{name}"))).alias(name)
        for name, r in out.items()])


def row_index(df: DataFrame, by: list[str], order: list[str], name: str = "idx",
              chunks: int | None = None, width: float | None = None,
            range_from: DataFrame | None = None) -> DataFrame:
    """0-based position of each row within its group in ``order``; the
    skew-safe equal of ``row_number() OVER (PARTITION BY by ORDER BY order) - 1``."""
    res = running(df, by, order, {name: Running("count")}, chunks, width)
    return res.withColumn(name, (F.col(name) - 1).cast("bigint"))


# Fixed chunk width for 0-based step indexes: a group of up to 65,536 steps is
# one chunk (one totals row); longer groups are split every 65,536 steps.
STEP_WIDTH = 1 << 16
