"""DuckDB SQL for the oracle side of the vector math, staged as CTEs so each
intermediate array is computed once (the same rule as ``let`` in Spark)."""

from __future__ import annotations


def token_ctes(src: str, arrays: dict[str, str], out: str = "tm") -> str:
    """CTE text (no leading WITH) adding ``lp_<name>`` log-softmax arrays and
    ``pp_<name>`` smoothed, renormalised probability arrays for each
    ``name -> array column`` of ``src``.  The last CTE is called ``out``."""
    n = list(arrays)
    c0 = ", ".join(f"CAST({col} AS DOUBLE[]) AS x_{k}" for k, col in arrays.items())
    c1 = ", ".join(f"list_max(x_{k}) AS m_{k}" for k in n)
    c2 = ", ".join(f"ln(list_sum(list_transform(x_{k}, lambda v: exp(v - m_{k})))) + m_{k} AS lse_{k}" for k in n)
    c3 = ", ".join(f"list_transform(x_{k}, lambda v: v - lse_{k}) AS lp_{k}" for k in n)
    c4 = ", ".join(f"list_transform(lp_{k}, lambda v: exp(v) + 1e-8) AS pr_{k}" for k in n)
    c5 = ", ".join(f"list_sum(pr_{k}) AS s_{k}" for k in n)
    c6 = ", ".join(f"list_transform(pr_{k}, lambda v: v / s_{k}) AS pp_{k}" for k in n)
    return (f"{out}0 AS (SELECT *, {c0} FROM {src}),\n"
            f"{out}1 AS (SELECT *, {c1} FROM {out}0),\n"
            f"{out}2 AS (SELECT *, {c2} FROM {out}1),\n"
            f"{out}3 AS (SELECT *, {c3} FROM {out}2),\n"
            f"{out}4 AS (SELECT *, {c4} FROM {out}3),\n"
            f"{out}5 AS (SELECT *, {c5} FROM {out}4),\n"
            f"{out} AS (SELECT *, {c6} FROM {out}5)")


def kl(a: str, b: str) -> str:
    return f"list_sum(list_transform(pp_{a}, lambda u, i: u * (ln(u) - ln(pp_{b}[i]))))"


def entropy(a: str) -> str:
    return f"(-list_sum(list_transform(lp_{a}, lambda v: exp(v) * v)))"


def l2(a: str, b: str) -> str:
    return f"sqrt(list_sum(list_transform(lp_{a}, lambda u, i: (u - lp_{b}[i]) * (u - lp_{b}[i]))))"


def abs_diff(a: str, b: str) -> str:
    return f"list_sum(list_transform(lp_{a}, lambda u, i: abs(u - lp_{b}[i])))"


def gather(a: str, idx0: str) -> str:
    return f"lp_{a}[{idx0} + 1]"
