"""Registry of checked queries: a Spark builder and (optionally) DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefspark.session import tune

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}

DIGITS = 6
# Nudge applied before rounding in both engines: values that sit exactly on a
# rounding tie (two-decimal data averaged over 32 or 64 rows) differ between
# engines only in their last bits; adding sign(x) * min(|x| * 1e-13, 1e-10)
# moves both copies to the same side of the tie and stays far below the
# rounding unit (1e-6) at every magnitude.
NUDGE_REL = 1e-13
NUDGE_ABS = 1e-10


def register(name: str, sql: str | None = None):
    """Decorator: register ``fn(spark, sf_dir) -> DataFrame`` under ``name``.

    Double columns of the result are rounded to 6 places (the oracle SQL
    rounds the same columns), because the two engines sum in different orders.
    """
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
            tune(spark)
            return round_doubles(fn(spark, sf_dir))

        wrapped.__name__ = fn.__name__
        wrapped.__doc__ = fn.__doc__
        QUERIES[name] = wrapped
        if sql is not None:
            ORACLE[name] = nudge_rounding(sql)
        return wrapped
    return deco


def round_half_away(x, digits: int = DIGITS):
    """Round the binary value: scale, round half away from zero, unscale.

    Spark's ``round`` goes through the decimal string of the double, so values
    with exactly seven decimals (prices / 100000) can round the other way than
    in SQL engines that round the binary value; this form gives the same
    result as those (after the shared nudge, see :data:`NUDGE_REL`).  NaN and infinities
    pass through.
    """
    m = 10.0 ** digits
    a = F.abs(x)
    y = (a + F.least(a * F.lit(NUDGE_REL), F.lit(NUDGE_ABS))) * F.lit(m)
    # NaN and infinities fail the range test and pass through unchanged
    return F.when(y < F.lit(4.5e15), F.signum(x) * F.floor(y + F.lit(0.5)).cast("double") / F.lit(m)).otherwise(x)


def round_doubles(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(round_half_away(F.col(f"`{f.name}`").cast("double"), digits).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def nudge_rounding(sql: str) -> str:
    """Rewrite ``round(E, d)`` in oracle SQL to round the nudged value (the
    oracle strings hold no parentheses inside quoted literals)."""
    out, i, key = [], 0, "round("
    while True:
        j = sql.find(key, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        if j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_"):
            out.append(sql[i:j + len(key)])
            i = j + len(key)
            continue
        depth, k = 1, j + len(key)
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        inner = sql[j + len(key):k - 1]
        comma = inner.rfind(",")
        expr, digits = inner[:comma], inner[comma + 1:].strip()
        out.append(sql[i:j])
        e = f"({nudge_rounding(expr)})"
        out.append(f"round({e} + sign({e}) * least(abs({e}) * {NUDGE_REL!r}, {NUDGE_ABS!r}), {digits})")
        i = k
