"""Two-sided p-value of Student's t for any positive degrees of freedom, as a native expression."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Nodes of the quadrature: s from -REACH to REACH in steps of 1 / PER_UNIT.
REACH = 4
PER_UNIT = 16


def _tail(start: Column, nu: Column) -> Column:
    """The integral of (1 + u² / nu) ^ (-(nu + 1) / 2) from ``start`` to infinity, with u = start + exp(pi / 2 · sinh s): both
    ends fall off double-exponentially, so equal steps of s converge for heavy and for light tails."""

    def term(k: Column) -> Column:
        s = k / PER_UNIT
        step = F.exp(math.pi / 2 * F.sinh(s))
        u = start + step
        return F.exp(-(nu + 1) / 2 * F.log1p(u * u / nu)) * step * F.cosh(s)

    places = F.sequence(F.lit(-REACH * PER_UNIT), F.lit(REACH * PER_UNIT))
    return F.aggregate(places, F.lit(0.0), lambda total, k: total + term(k))


def t_p_value(t: Column, dof: Column) -> Column:
    """P(|T| >= |t|), the tail of the density over the whole of it: one formula for all t and degrees of freedom."""
    nu = dof.cast("double")
    p = _tail(F.abs(t), nu) / _tail(F.lit(0.0), nu)
    return F.when(nu >= 1, F.least(F.lit(1.0), p))
