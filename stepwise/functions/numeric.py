"""Numerically stable scalar formulas as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Largest argument for which exp() of a double stays finite.
EXP_CAP = 709.78


def safe_ratio(num: Column, den: Column) -> Column:
    """``num / den`` as double, 0.0 when the denominator is zero or null.

    ANSI mode turns ``x / 0`` into an error, hence ``try_divide``.
    """
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def harmonic(a: Column, b: Column) -> Column:
    """2ab / (a + b), 0.0 when a + b is zero."""
    return safe_ratio(2.0 * a * b, a + b)


def softplus(z: Column) -> Column:
    """log(1 + e^z) without overflow."""
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))


def log_sigmoid(z: Column) -> Column:
    """log(sigmoid(z)) = -softplus(-z), stable for large |z|."""
    return -(F.greatest(-z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))))


def sigmoid(z: Column) -> Column:
    """1 / (1 + e^-z) evaluated on the side that cannot overflow."""
    e = F.exp(-F.abs(z))
    return F.when(z >= 0, 1.0 / (1.0 + e)).otherwise(e / (1.0 + e))


def relu(z: Column) -> Column:
    return F.greatest(z, F.lit(0.0))


def capped_exp(z: Column) -> Column:
    """exp(min(z, 709.78)): finite for every finite input."""
    return F.exp(F.least(z, F.lit(EXP_CAP)))


def round_half_away(c: Column, places: int = 6) -> Column:
    """``round(x * 10^p) / 10^p`` on the binary value, halves away from zero.

    Spark's ``round`` rounds the shortest decimal string of a double, so a
    value printed as ``4.1546875`` goes up while its binary value sits just
    below the half; report columns use this arithmetic form instead, which
    gives bitwise-identical results in other engines that round the same way.
    """
    x = c.cast("double")
    scale = float(10 ** places)
    v = x * scale
    r = F.signum(v) * F.floor(F.abs(v) + 0.5).cast("double") / scale
    ok = ~F.isnan(x) & (F.abs(v) < F.lit(1e15))
    return F.when(ok, r).otherwise(x)


def r6(c: Column) -> Column:
    """Round a double to 6 places for reports and cross-engine comparison.

    Rounding to 9 places first absorbs last-bit noise from summation order,
    so the second rounding cannot fall on different sides of a tie.
    """
    return round_half_away(round_half_away(c, 9), 6)
