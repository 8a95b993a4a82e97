"""Bounded-memory windows and decaying linear recurrences over long groups.

Rows of a group (a run, a trajectory) carry a 0-based position ``idx``
(see :func:`prefspark.plans.scan.row_index`).  They are cut into chunks of
``chunk`` positions; each chunk also receives copies of up to ``before``
preceding and ``after`` following rows of its group (the halo).  A window
partitioned by ``(group, chunk)`` then sees every neighbour a home row needs,
while no task ever holds more than ``chunk + before + after`` rows of one
group, however large the group is.

Decaying recurrences ``y_t = x_t + a * y_{t+1}`` (returns, GAE) and
``y_t = x_t + a * y_{t-1}`` (exponential smoothing), ``0 <= a <= 1``, use no
halo: each chunk has one weighted total, the same recurrence over the totals
(decay ``a^chunk``) gives the value that enters each chunk, and that value is
one more row of the chunk's window.  No term is left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefspark.plans.scan import STEP_WIDTH, Running, running

_C = "__hchunk"
_HOME = "__home"
_BASE = "__hbase"

# a chunk's decay stays above exp(-RANGE), so weights keep their precision
RANGE = 200.0
# exp(-GONE) times any double is zero
GONE = 1500.0


def with_halo(df: DataFrame, idx: str, chunk: int, before: int = 0, after: int = 0) -> DataFrame:
    """Home rows plus halo copies, with ``__hchunk`` (chunk id), ``__home``
    (True for the row's own chunk) and ``__hbase`` (first position the chunk
    can see)."""
    if before > chunk or after > chunk:
        raise ValueError("halo wider than the chunk")
    i = F.col(idx)
    home = df.withColumns({_C: F.floor(i / chunk), _HOME: F.lit(True)})
    parts = [home]
    if before:
        parts.append(home.filter(F.pmod(i, F.lit(chunk)) >= chunk - before)
                     .withColumns({_C: F.col(_C) + 1, _HOME: F.lit(False)}))
    if after:
        parts.append(home.filter((F.pmod(i, F.lit(chunk)) < after) & (F.col(_C) > 0))
                     .withColumns({_C: F.col(_C) - 1, _HOME: F.lit(False)}))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn(_BASE, F.col(_C) * chunk - before)


def halo_window(by: list[str], idx: str) -> Window:
    return Window.partitionBy(*by, _C).orderBy(idx)


def home_rows(df: DataFrame) -> DataFrame:
    return df.filter(F.col(_HOME)).drop(_C, _HOME, _BASE)


def _entering(totals: DataFrame, by: list[str], rate: float, out: str, step: int) -> DataFrame:
    """``(by.., __hchunk, out)``: the value that enters each chunk, from the
    weighted total ``__x`` of every chunk; ``rate`` is -ln of a chunk's decay
    and ``step`` the way the values move (-1: to earlier chunks)."""
    if rate < 1:
        y = _discounted(totals.withColumnRenamed(_C, "__at"), by, "__at", F.col("__x"), rate, out, 100_000, step)
        return y.select(*by, (F.col("__at") + step).alias(_C), out)
    # few chunks away a total has decayed to zero: send it to each of the others
    away = F.explode(F.sequence(F.lit(0), F.lit(int(GONE / rate))))
    half = F.exp(F.col("__i") * F.lit(-rate / 2))  # twice: the whole weight may be below the least double
    sent = totals.select("*", away.alias("__i")).withColumns(
        {_C: F.col(_C) + F.lit(step) * (F.col("__i") + 1), "__x": F.col("__x") * half * half})
    return sent.groupBy(*by, _C).agg(F.sum("__x").alias(out))


def _discounted(df: DataFrame, by: list[str], idx: str, x: Column, rate: float, out: str,
                chunk: int, step: int) -> DataFrame:
    """``out_t = sum_k exp(-rate |k-t|) x_k`` over ``k >= t`` (``step`` -1) or
    ``k <= t`` (``step`` 1) within each group."""
    c = max(1, min(chunk, int(RANGE / rate))) if rate else chunk
    if rate == 0:
        # a plain running sum
        order = F.col(idx) * F.lit(step)
        return running(df.withColumns({"__x": x, "__order": order}), by, ["__order"],
                       {out: Running("sum", "__x")}, width=STEP_WIDTH).drop("__x", "__order")
    # distance from the chunk's last row to be summed, counted so that
    # larger means further from the rows still to come
    place = F.pmod(F.col(idx), F.lit(c))
    rel = place if step < 0 else F.lit(c - 1) - place
    rows = df.withColumns({"__x": x, _C: F.floor(F.col(idx) / c), "__rel": rel.cast("double"), _HOME: F.lit(True)})
    weight = F.exp(F.col("__rel") * F.lit(-rate))
    totals = rows.groupBy(*by, _C).agg(F.sum(F.col("__x") * weight).alias("__x"))
    carry = _entering(totals, by, rate * c, "__x_in", step).select(
        *by, _C, F.col("__x_in").alias("__x"), F.lit(float(c)).alias("__rel"), F.lit(False).alias(_HOME))
    both = rows.unionByName(carry, allowMissingColumns=True)
    # descending: the smallest terms are added first
    w = (Window.partitionBy(*by, _C).orderBy(F.col("__rel").desc())
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    y = both.withColumn(out, F.sum(F.col("__x") * weight).over(w) / weight)
    return y.filter(F.col(_HOME)).drop("__x", "__rel", _C, _HOME)


def _recurrence(df, by, idx, x, decay, out, chunk, step) -> DataFrame:
    if not 0 <= decay <= 1:
        raise ValueError("decay must be in [0, 1]")
    xv = (F.col(x) if isinstance(x, str) else x).cast("double")
    if decay == 0:
        return df.withColumn(out, xv)
    return _discounted(df, by, idx, xv, -math.log(decay), out, chunk, step)


def discounted_suffix(df: DataFrame, by: list[str], idx: str, x: str | Column, decay: float,
                      out: str, chunk: int = 100_000) -> DataFrame:
    """``out_t = sum_{k >= t} decay^(k-t) x_k`` within each group (returns,
    GAE advantages)."""
    return _recurrence(df, by, idx, x, decay, out, chunk, -1)


def discounted_prefix(df: DataFrame, by: list[str], idx: str, x: str | Column, decay: float,
                      out: str, chunk: int = 100_000) -> DataFrame:
    """``out_t = sum_{j <= t} decay^(t-j) x_j`` within each group
    (exponential smoothing)."""
    return _recurrence(df, by, idx, x, decay, out, chunk, 1)


def bounded_frame(df: DataFrame, by: list[str], idx: str, before: int, after: int,
                  cols: dict[str, Column], chunk: int = 100_000) -> DataFrame:
    """Evaluate window expressions whose frames stay within ``before`` rows
    back and ``after`` rows ahead (``cols``: name -> expression built with
    :func:`frame`), with bounded memory per task."""
    c = max(chunk, before, after)
    return home_rows(with_halo(df, idx, c, before, after).withColumns(cols))


def frame(by: list[str], idx: str, start: int, end: int) -> Window:
    """Row frame ``[start, end]`` relative to the current row, for use inside
    :func:`bounded_frame`."""
    return halo_window(by, idx).rowsBetween(start, end)
