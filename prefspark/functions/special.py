"""Numeric column functions that Spark lacks: a keyed permutation of
0 .. n-1, portable uniforms and the Student-t tail."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: modulus of the rounds' mixing, a prime below 2^31: products stay below 2^62
PRIME = 2_147_483_647
MULTIPLIERS = (48_271, 69_621)
ROUNDS = 32
#: terms of the continued fraction, enough to a million degrees of freedom
TERMS = 1500
MOST_DOF = 1e6
#: steps up before the asymptotic series of the gamma ratio
SHIFT = 60


def round_keys(seed: int, rounds: int = ROUNDS) -> list[int]:
    """One 60-bit key a round."""
    return [int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:15], 16) for i in range(rounds)]


def permuted(index: Column, n: Column, seed: int, rounds: int = ROUNDS) -> Column:
    """Place of ``index`` in a keyed permutation of ``0 .. n-1``, for every
    ``n`` and without a sort: swap-or-not rounds.  A round pairs ``x`` with
    ``k - x`` modulo ``n`` and swaps the two when a hash bit of the larger one
    says so, which undoes itself."""
    keys = F.array(*[F.lit(k) for k in round_keys(seed, rounds)])

    def swap(x, k):
        other = F.pmod(k - x, n)
        high = F.greatest(x, other)
        mixed = F.pmod((F.pmod(high, F.lit(PRIME)) + F.pmod(k, F.lit(PRIME))) * F.lit(MULTIPLIERS[0]), F.lit(PRIME))
        mixed = F.pmod((mixed + F.floor(mixed / 65536)) * F.lit(MULTIPLIERS[1]), F.lit(PRIME))
        return F.when(F.pmod(F.floor(mixed / 1024), F.lit(2)) == 1, other).otherwise(x)
    return F.aggregate(keys, index.cast("long"), lambda x, k: swap(x, k).cast("long"))


def permuted_sql(index: str, n: str, seed: int, rounds: int = ROUNDS) -> str:
    """The same in DuckDB SQL."""
    other = f"((k - x) % {n} + {n}) % {n}"
    first = f"((greatest(x, {other}) % {PRIME} + k % {PRIME}) * {MULTIPLIERS[0]}) % {PRIME}"
    second = f"(({first} + ({first}) // 65536) * {MULTIPLIERS[1]}) % {PRIME}"
    keys = ", ".join(map(str, round_keys(seed, rounds)))
    return (f"list_reduce([CAST({index} AS BIGINT), {keys}], "
            f"lambda x, k: CASE WHEN ({second}) // 1024 % 2 = 1 THEN {other} ELSE x END)")


def uniform(key: Column, seed: int = 0) -> Column:
    """Uniform in (0, 1) from the first 13 hex digits of an md5, so that any
    engine draws the same."""
    digits = F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{seed}"))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def uniform_sql(key: str, seed: int = 0) -> str:
    return f"((CAST(CAST('0x' || substr(md5(CAST({key} AS VARCHAR) || ':{seed}'), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / {float(1 << 52)!r})"


def _log_beta_half(a: Column) -> Column:
    """ln B(a, 1/2) by ln(Gamma(a + 1/2) / Gamma(a)): an asymptotic series
    after SHIFT steps up."""
    up = a + SHIFT
    series = F.log(up) / 2 - 1 / (8 * up) + 1 / (192 * up * up * up) - 1 / (640 * F.pow(up, F.lit(5)))
    steps = F.aggregate(F.sequence(F.lit(0), F.lit(SHIFT - 1)), F.lit(0.0), lambda s, i: s + F.log1p(F.lit(0.5) / (a + i)))
    return F.lit(0.5 * math.log(math.pi)) - (series - steps)


def _fraction(x: Column, a: Column, b: Column) -> Column:
    """The continued fraction of the incomplete beta function, from its last
    term."""
    def term(f, k):
        m = F.floor(k / 2)
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return F.lit(1.0) + F.when(k % 2 == 0, even).otherwise(odd) / f
    return F.aggregate(F.sequence(F.lit(TERMS), F.lit(1), F.lit(-1)), F.lit(1.0), term)


def student_t_tail(t: Column, dof: Column) -> Column:
    """Two-sided p-value of Student's t: the regularised incomplete beta
    function ``I_x(dof/2, 1/2)`` at ``x = dof / (dof + t^2)``.  Within 1e-9 up
    to a million degrees of freedom, which larger ones count as (2e-7)."""
    nu = F.least(dof, F.lit(MOST_DOF))
    a, b = nu / 2, F.lit(0.5)
    x, rest = nu / (nu + t * t), t * t / (nu + t * t)
    front = F.exp(a * F.log(x) + b * F.log(rest) - _log_beta_half(a))
    lower = front / a / _fraction(x, a, b)
    upper = F.lit(1.0) - front / b / _fraction(rest, b, a)
    p = F.when(x < (a + 1) / (a + b + 2), lower).otherwise(upper)
    return F.when(t == 0, F.lit(1.0)).otherwise(p)


def student_t_tail_sql(t: str, dof: str) -> str:
    """The same in DuckDB SQL."""
    a, t2 = f"(least({dof}, {MOST_DOF!r}) / 2)", f"(({t}) * ({t}))"
    nu = f"least({dof}, {MOST_DOF!r})"
    x, rest = f"({nu} / ({nu} + {t2}))", f"({t2} / ({nu} + {t2}))"
    up = f"({a} + {SHIFT})"
    series = f"(ln({up}) / 2 - 1 / (8 * {up}) + 1 / (192 * power({up}, 3)) - 1 / (640 * power({up}, 5)))"
    steps = f"list_sum(list_transform(range({SHIFT}), lambda i: ln(1 + 0.5 / ({a} + i))))"
    front = f"exp({a} * ln({x}) + 0.5 * ln({rest}) - ({0.5 * math.log(math.pi)!r} - ({series} - {steps})))"

    def fraction(z, p, q):
        m = "(CAST(k AS BIGINT) // 2)"
        even = f"({m} * ({q} - {m}) * {z} / (({p} + 2 * {m} - 1) * ({p} + 2 * {m})))"
        odd = f"(-({p} + {m}) * ({p} + {q} + {m}) * {z} / (({p} + 2 * {m}) * ({p} + 2 * {m} + 1)))"
        return (f"list_reduce(list_prepend(CAST(1 AS DOUBLE), list_transform(range({TERMS}, 0, -1), lambda i: CAST(i AS DOUBLE))), "
                f"lambda f, k: 1.0 + CASE WHEN CAST(k AS BIGINT) % 2 = 0 THEN {even} ELSE {odd} END / f)")
    half = "CAST(0.5 AS DOUBLE)"
    return (f"CASE WHEN {t} = 0 THEN 1.0 WHEN {x} < ({a} + 1) / ({a} + 2.5) THEN {front} / {a} / {fraction(x, a, half)} "
            f"ELSE 1.0 - {front} / 0.5 / {fraction(rest, half, a)} END")
