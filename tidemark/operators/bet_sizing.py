"""Bet sizes from probabilities and forecasts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.normal import phi
from tidemark.operators.series import SERIES


def prob_bet_size(df: DataFrame, prob: str = "prob", side: str | None = None, num_classes: int = 2) -> DataFrame:
    """`bet`: 2 Phi(z) - 1 with z = (p - 1/k) / sqrt(p (1 - p)), times the side; certain outcomes give -1 and 1."""
    if num_classes < 2 or (num_classes > 2 and side is None):
        raise ValueError("num_classes must be at least 2, and a side is needed above 2")
    p = F.col(prob)
    z = F.when((p > 0) & (p < 1), (p - 1.0 / num_classes) / F.sqrt(p * (1 - p)))
    m = F.when(p >= 1, F.lit(1.0)).when(p <= 0, F.lit(-1.0)).otherwise(2 * phi("__z") - 1)
    out = df.withColumn("__z", z).withColumn("bet", m).drop("__z")
    return out.withColumn("bet", F.col("bet") * F.col(side)) if side else out


def sigmoid_bet_size(w: float | Column, x: Column) -> Column:
    """x / sqrt(w + x^2); infinite divergences give -1 and 1."""
    w = F.lit(float(w)) if isinstance(w, (int, float)) else w
    return F.when(F.abs(x) == float("inf"), F.signum(x)).otherwise(x / F.hypot(F.sqrt(w), x))


def calibrate_sigmoid_width(x: float, m_star: float) -> float:
    """The width at which a divergence x has bet size m_star."""
    if not 0 < abs(m_star) < 1 or x == 0 or (x > 0) != (m_star > 0):
        raise ValueError("m_star must lie between 0 and 1 in size, with the sign of x")
    return x * x * (m_star**-2 - 1)


def target_position(w: float | Column, forecast: Column, market_price: Column, max_position: int) -> Column:
    """Whole units, cut towards zero."""
    return (sigmoid_bet_size(w, forecast - market_price) * F.lit(max_position)).cast("int")


def limit_price(target: Column, current: Column, forecast: Column, w: float | Column, max_position: int) -> Column:
    """Mean of the break-even prices of the unit fills from current to target; NULL for no order or a target at the cap."""
    w = F.lit(float(w)) if isinstance(w, (int, float)) else w
    step = F.signum((target - current).cast("double")).cast("int")
    fills = F.sequence(current + step, target, step)

    def price(p: Column) -> Column:
        m = p / F.lit(float(max_position))
        return forecast - m * F.sqrt(w / (1 - m * m))

    total = F.aggregate(F.transform(fills, price), F.lit(0.0), lambda a, b: a + b)
    return F.when((target != current) & (F.abs(target) < max_position), total / F.abs(target - current))


def average_active_signals(signals: DataFrame, grid: DataFrame | None = None) -> DataFrame:
    """(series_id, ts, signal): the mean of the signals (series_id, t0, t1, signal) active at each time of the grid (their starts, if none is given); 0 where none is; NULL while a NULL signal is active.

    Starts and ends are put on the grid's time line as steps up and down and summed.
    """
    times = (grid if grid is not None else signals.select(SERIES, F.col("t0").alias("ts"))).select(SERIES, "ts").distinct()
    value, known = F.coalesce("signal", F.lit(0.0)), F.when(F.col("signal").isNull(), 0).otherwise(1)
    none = F.lit(0)
    # at equal times: starts count (order 0), then the grid looks (1), then ends leave (2)
    up = signals.select(SERIES, F.col("t0").alias("ts"), F.lit(0).alias("o"), value.alias("v"), known.alias("n"), (1 - known).alias("u"))
    down = signals.select(SERIES, F.col("t1").alias("ts"), F.lit(2).alias("o"), (-value).alias("v"), (-known).alias("n"), (known - 1).alias("u"))
    look = times.select(SERIES, "ts", F.lit(1).alias("o"), F.lit(0.0).alias("v"), none.alias("n"), none.alias("u"))
    w = Window.partitionBy(SERIES).orderBy("ts", "o").rowsBetween(Window.unboundedPreceding, 0)
    s = up.unionByName(down).unionByName(look).select(SERIES, "ts", "o", F.sum("v").over(w).alias("v"), F.sum("n").over(w).alias("n"), F.sum("u").over(w).alias("u"))
    return s.filter("o = 1").select(SERIES, "ts", F.when(F.col("u") > 0, None).when(F.col("n") > 0, F.col("v") / F.col("n")).otherwise(0.0).alias("signal"))


def discretize_signal(signal: Column, step: float) -> Column:
    """To multiples of step (halves to even), within -1 and 1."""
    if not 0 < step <= 1:
        raise ValueError("step must lie in (0, 1]")
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.rint(signal / step) * step))


def inverse_price(forecast: float, w: float, m: float) -> float:
    """The price at which the bet size is m."""
    return forecast - m * math.sqrt(w / (1 - m * m))
