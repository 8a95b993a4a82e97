"""Vector math over logit arrays: log-softmax, KL, entropy, L2 and gathers.

Two interchangeable forms:

* JVM form (default): Spark higher-order functions.  Lambda bodies get no
  common-subexpression elimination, so every intermediate (max, log-sum-exp,
  the log-prob array itself) is bound once with :func:`let` and referenced
  through the lambda variable; never nest raw lambdas over an un-bound array.
* numpy form: one Arrow-batched ``pandas_udf`` that stacks the batch into a
  matrix; better for large vocabularies (thousands of entries per row).

Both return the same per-token struct (see :data:`TOKEN_FIELDS`).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: smoothing added to each probability before renormalising (KL).
KL_EPS = 1e-8


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` as a lambda variable."""
    return F.transform(F.array(value), body)[0]


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)


def as_double(arr) -> Column:
    return _c(arr).cast("array<double>")


def log_softmax_of(x: Column) -> Column:
    """Log-softmax of a bound ``array<double>`` (subtracts the max first)."""
    return let(F.array_max(x), lambda m: let(
        F.log(_sum(F.transform(x, lambda v: F.exp(v - m)))) + m,
        lambda lse: F.transform(x, lambda v: v - lse)))


def log_softmax(logits) -> Column:
    return let(as_double(logits), log_softmax_of)


def softmax(logits) -> Column:
    return F.transform(log_softmax(logits), lambda v: F.exp(v))


def _smoothed(lp: Column) -> Column:
    """softmax(lp) + eps, renormalised (lp is already a log-softmax)."""
    return let(F.transform(lp, lambda v: F.exp(v) + F.lit(KL_EPS)),
               lambda p: let(_sum(p), lambda s: F.transform(p, lambda v: v / s)))


def kl_of(lp: Column, lq: Column) -> Column:
    """KL(p || q) for bound log-prob arrays, with the eps smoothing."""
    return let(_smoothed(lp), lambda p: let(_smoothed(lq), lambda q: _sum(
        F.zip_with(p, q, lambda a, b: a * (F.log(a) - F.log(b))))))


def entropy_of(lp: Column) -> Column:
    return -_sum(F.transform(lp, lambda v: F.exp(v) * v))


def l2_of(lp: Column, lq: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(lp, lq, lambda a, b: (a - b) * (a - b))))


def abs_diff_sum_of(lp: Column, lq: Column) -> Column:
    return _sum(F.zip_with(lp, lq, lambda a, b: F.abs(a - b)))


def gather(arr: Column, idx0: Column) -> Column:
    """Element at a 0-based index (NULL when out of range)."""
    return F.try_element_at(arr, idx0.cast("int") + 1)


def kl_divergence(p_logits, q_logits) -> Column:
    """Per-row KL(softmax(p) || softmax(q))."""
    return let(log_softmax(p_logits), lambda lp: let(log_softmax(q_logits), lambda lq: kl_of(lp, lq)))


def entropy(logits) -> Column:
    return let(log_softmax(logits), entropy_of)


def argmax0(arr) -> Column:
    """0-based position of the first maximum."""
    return let(_c(arr), lambda a: F.array_position(a, F.array_max(a)) - 1)


TOKEN_FIELDS = ["kl", "entropy", "logp", "logp_ref", "l2", "logp_target", "vi_kl", "abs_diff", "vocab"]


def token_metrics(policy, reference, action, target=None, variational=None) -> Column:
    """Struct of per-position quantities used by every objective:

    ``kl`` KL(policy||reference), ``entropy`` of the policy, ``logp`` /
    ``logp_ref`` / ``logp_target`` log-prob of the taken action, ``l2`` L2
    norm of the log-prob difference, ``vi_kl`` KL(policy||variational),
    ``abs_diff`` sum of |policy - variational| log-probs and ``vocab`` size.
    Each log-softmax is evaluated once.
    """
    a = _c(action)
    null = F.lit(None).cast("double")

    def with_lp(lp):
        def with_lq(lq):
            def finish(lt, lv):
                return F.struct(
                    kl_of(lp, lq).alias("kl"), entropy_of(lp).alias("entropy"),
                    gather(lp, a).alias("logp"), gather(lq, a).alias("logp_ref"),
                    l2_of(lp, lq).alias("l2"),
                    (gather(lt, a) if lt is not None else null).alias("logp_target"),
                    (kl_of(lp, lv) if lv is not None else null).alias("vi_kl"),
                    (abs_diff_sum_of(lp, lv) if lv is not None else null).alias("abs_diff"),
                    F.size(lp).alias("vocab"))
            if target is not None and variational is not None:
                return let(log_softmax(target), lambda lt: let(log_softmax(variational),
                                                               lambda lv: finish(lt, lv)))
            if target is not None:
                return let(log_softmax(target), lambda lt: finish(lt, None))
            if variational is not None:
                return let(log_softmax(variational), lambda lv: finish(None, lv))
            return finish(None, None)
        return let(log_softmax(reference), with_lq)
    return let(log_softmax(policy), with_lp)


# ------------------------------------------------------------------ numpy form
def _stack(s: pd.Series, size: int) -> np.ndarray:
    """One matrix row per array; NaN for NULL."""
    out = np.full((len(s), size), np.nan)
    for i in np.flatnonzero(s.notna().to_numpy()):
        out[i] = s.iloc[i]
    return out


def _np_log_softmax(x: np.ndarray) -> np.ndarray:
    m = x.max(axis=1, keepdims=True)
    return x - (np.log(np.exp(x - m).sum(axis=1, keepdims=True)) + m)


def _np_smoothed(lp: np.ndarray) -> np.ndarray:
    p = np.exp(lp) + KL_EPS
    return p / p.sum(axis=1, keepdims=True)


def _np_kl(lp, lq):
    p, q = _np_smoothed(lp), _np_smoothed(lq)
    return (p * (np.log(p) - np.log(q))).sum(axis=1)


_NP_SCHEMA = T.StructType(
    [T.StructField(k, T.DoubleType()) for k in TOKEN_FIELDS[:-1]]
    + [T.StructField("vocab", T.IntegerType())])


@F.pandas_udf(_NP_SCHEMA)
def _np_token_metrics(policy: pd.Series, reference: pd.Series, action: pd.Series,
                      target: pd.Series, variational: pd.Series) -> pd.DataFrame:
    width = policy.map(len, na_action="ignore").fillna(0).astype(int)
    out = pd.DataFrame(np.nan, index=policy.index, columns=TOKEN_FIELDS)
    for size in width.unique():  # rows of one vocabulary at a time; 0: no policy
        at = width.index[width == size]
        if size:
            out.loc[at] = _np_rows(int(size), *(x.loc[at] for x in (policy, reference, action, target, variational)))
    out["vocab"] = width.where(width > 0).astype("Int32")
    return out


def _np_rows(size: int, policy, reference, action, target, variational) -> np.ndarray:
    """Token metrics of rows with ``size`` logits; NaN where an input is NULL
    or the action is no position."""
    lp, lq, lt, lv = (_np_log_softmax(_stack(x, size)) for x in (policy, reference, target, variational))
    act = action.to_numpy(dtype=np.float64, na_value=np.nan)
    known = (act >= 0) & (act < size)
    place = np.where(known, act, 0).astype(np.int64)
    rows = np.arange(len(place))

    def taken(m):
        return np.where(known, m[rows, place], np.nan)
    return np.column_stack([
        _np_kl(lp, lq), -(np.exp(lp) * lp).sum(axis=1), taken(lp), taken(lq),
        np.sqrt(((lp - lq) ** 2).sum(axis=1)), taken(lt), _np_kl(lp, lv),
        np.abs(lp - lv).sum(axis=1), np.full(len(rows), size)])


def token_metrics_numpy(policy, reference, action, target=None, variational=None) -> Column:
    """numpy twin of :func:`token_metrics` (Arrow batches, one matrix per batch)."""
    none = F.lit(None).cast("array<float>")
    return _np_token_metrics(_c(policy), _c(reference), _c(action),
                             _c(target) if target is not None else none,
                             _c(variational) if variational is not None else none)


def token_metrics_any(form: str, *args, **kw) -> Column:
    if form == "numpy":
        return token_metrics_numpy(*args, **kw)
    if form == "jvm":
        return token_metrics(*args, **kw)
    raise ValueError(f"unknown vector form {form!r}")
