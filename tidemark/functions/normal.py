"""The normal distribution function, which Spark lacks, as SQL that other engines read too."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the double-precision rational approximation of Hart as given by West (2005).
NUMERATOR = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
DENOMINATOR = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def phi_sql(x: str) -> str:
    """SQL for the standard normal distribution function of a SQL expression."""
    a = f"abs({x})"

    def horner(c: tuple[float, ...]) -> str:
        out = f"CAST({c[0]!r} AS DOUBLE)"
        for k in c[1:]:
            out = f"({out} * {a} + CAST({k!r} AS DOUBLE))"
        return out

    tail = f"({a} + 0.65e0)"
    for k in (4, 3, 2, 1):
        tail = f"({a} + {k}e0 / {tail})"
    small = f"(CASE WHEN {a} > 37e0 THEN 0e0 WHEN {a} < 7.07106781186547e0 THEN exp(-({x}) * ({x}) / 2e0) * {horner(NUMERATOR)} / {horner(DENOMINATOR)} ELSE exp(-({x}) * ({x}) / 2e0) / {tail} / 2.506628274631e0 END)"
    return f"(CASE WHEN {x} IS NULL THEN NULL WHEN {x} > 0e0 THEN 1e0 - {small} ELSE {small} END)"


def phi(name: str) -> Column:
    """The standard normal distribution function of a column."""
    return F.expr(phi_sql(f"`{name}`"))


def phi_value(x: float) -> float:
    return NormalDist().cdf(x)


def phi_inverse(p: float) -> float:
    return NormalDist().inv_cdf(p)
