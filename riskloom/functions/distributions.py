"""Tail probabilities for finished test statistics: a handful of rows per report."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Steps after which a continued fraction counts as not converging, and the change at which it has converged.
MOST_STEPS, CONVERGED = 100_000, 4e-15
#: Degrees of freedom from which Student's t is read off the normal tail; the two forms agree to ten digits there.
NORMAL_DOF = 1e6


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction (modified Lentz); raises if that does not converge."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_inc(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    f, c, d = 1.0, 1.0, 0.0
    for i in range(MOST_STEPS):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 + num * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + num / (c if abs(c) > tiny else tiny)
        f *= c * d
        if abs(1.0 - c * d) < CONVERGED:
            return front * (f - 1.0)
    raise ArithmeticError(f"no convergence of the incomplete beta at a={a}, b={b}, x={x}")


def gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma: series below a + 1, continued fraction above."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1.0 - total * scale
    b = x + 1 - a
    c, d = 1e300, 1.0 / b
    h = d
    for i in range(1, MOST_STEPS):
        an = -i * (i - a)
        b += 2
        d = 1.0 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1.0) < CONVERGED:
            return h * scale
    raise ArithmeticError(f"no convergence of the incomplete gamma at a={a}, x={x}")


def t_two_sided(t: float, dof: float) -> float:
    """Two-sided p of Student's t.

    From ``NORMAL_DOF`` on, t becomes a normal deviate (Wallace's form, with an error of the order of 1 / dof^2), since
    the beta function's terms cancel there and leave fewer digits the more rows there are.
    """
    if dof >= NORMAL_DOF:
        z = (8.0 * dof + 1.0) / (8.0 * dof + 3.0) * math.sqrt(dof * math.log1p(t * t / dof))
        return math.erfc(z / math.sqrt(2.0))
    return beta_inc(dof / 2.0, 0.5, dof / (dof + t * t))


def _mapped(fn, *columns: pd.Series) -> pd.Series:
    return pd.Series([None if any(pd.isna(v) for v in row) else fn(*row) for row in zip(*columns)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def _t_p(t: pd.Series, dof: pd.Series) -> pd.Series:
    return _mapped(lambda x, d: t_two_sided(x, d) if d > 0 else float("nan"), t, dof)


@F.pandas_udf(T.DoubleType())
def _chi2_p(x: pd.Series, dof: pd.Series) -> pd.Series:
    return _mapped(lambda v, d: gamma_q(d / 2.0, v / 2.0) if d > 0 else 1.0, x, dof)


@F.pandas_udf(T.DoubleType())
def _normal_p(z: pd.Series) -> pd.Series:
    return _mapped(lambda v: math.erfc(abs(v) / math.sqrt(2.0)), z)


def t_p_value(t: Column, dof: Column) -> Column:
    """Two-sided p of Student's t."""
    return _t_p(t.cast("double"), dof.cast("double"))


def chi2_p_value(x: Column, dof: Column) -> Column:
    return _chi2_p(x.cast("double"), dof.cast("double"))


def normal_p_value(z: Column) -> Column:
    """Two-sided p of the standard normal."""
    return _normal_p(z.cast("double"))
