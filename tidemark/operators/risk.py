"""Strategy risk and optimal trading rules."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.normal import phi
from tidemark.operators.series import SERIES, by_series


def _col(x: float | Column) -> Column:
    return F.lit(float(x)) if isinstance(x, (int, float)) else x


def binomial_sharpe(p: float | Column, freq: float | Column, pt: float | Column = 1.0, sl: float | Column = -1.0) -> Column:
    """Annual Sharpe ratio of bets that win pt with chance p and else sl."""
    p, freq, pt, sl = map(_col, (p, freq, pt, sl))
    return ((pt - sl) * p + sl) / ((pt - sl) * F.sqrt(p * (1 - p))) * F.sqrt(freq)


def implied_precision(sl: float | Column, pt: float | Column, freq: float | Column, target_sharpe: float | Column) -> Column:
    """The chance of winning at which the Sharpe ratio is the target."""
    sl, pt, n, t = map(_col, (sl, pt, freq, target_sharpe))
    d = pt - sl
    a, b, c = (n + t * t) * d * d, (2 * n * sl - t * t * d) * d, n * sl * sl
    root = F.sqrt(F.greatest(F.lit(0.0), b * b - 4 * a * c))
    return F.when(t >= 0, (-b + root) / (2 * a)).otherwise((-b - root) / (2 * a))


def implied_frequency(sl: float | Column, pt: float | Column, p: float | Column, target_sharpe: float | Column) -> Column:
    """Bets a year at which the Sharpe ratio is the target; NULL where its sign cannot be reached."""
    sl, pt, p, t = map(_col, (sl, pt, p, target_sharpe))
    mean = (pt - sl) * p + sl
    f = F.pow(t * (pt - sl), F.lit(2.0)) * p * (1 - p) / (mean * mean)
    return F.when((mean != 0) & (F.signum(mean) == F.signum(t)), f)


def probability_of_failure(returns: DataFrame, freq: float, target_sharpe: float, value: str = "ret") -> DataFrame:
    """(series_id, p, threshold, p_failure): the chance that the share of gains is below what the target needs; p (1 - p) is the scale."""
    r = F.col(value)
    g = returns.groupBy(SERIES).agg(F.avg((r > 0).cast("double")).alias("p"), F.avg(F.when(r > 0, r)).alias("up"), F.avg(F.when(r <= 0, r)).alias("down"))
    g = g.withColumn("threshold", implied_precision(F.col("down"), F.col("up"), freq, target_sharpe))
    g = g.withColumn("__z", (F.col("threshold") - F.col("p")) / (F.col("p") * (1 - F.col("p"))))
    return g.select(SERIES, "p", "threshold", phi("__z").alias("p_failure"))


def mixture_returns(spark: SparkSession, mu1: float, mu2: float, sigma1: float, sigma2: float, prob1: float, n_obs: int, seed: int | None = None) -> DataFrame:
    """(pos, ret): a shuffled mixture of two normal samples, made in a task: one stream of random numbers has one reader."""

    def draw(_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(seed)
        n1 = int(n_obs * prob1)
        x = np.concatenate([rng.normal(mu1, sigma1, n1), rng.normal(mu2, sigma2, n_obs - n1)])
        rng.shuffle(x)
        for at in range(0, n_obs, 100_000):
            part = x[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(part))), pa.array(part)], ["pos", "ret"])

    return spark.range(0, 1, 1, 1).mapInArrow(draw, "pos long, ret double")


def ou_half_life(phi_: float | Column) -> Column:
    return F.lit(-math.log(2.0)) / F.log(_col(phi_))


def ou_phi(half_life: float | Column) -> Column:
    return F.pow(F.lit(2.0), -1 / _col(half_life))


def fit_ou(prices: DataFrame, forecast: float | Column, value: str = "price") -> DataFrame:
    """(series_id, phi, sigma, half_life, n_obs): regression through the origin around the forecast, sigma from sample residuals.

    half_life is infinite for phi of 1 or more, and NULL for 0 or less.
    """
    f = _col(forecast)
    w = by_series(prices)
    x = prices.select(SERIES, (F.lag(value).over(w) - f).alias("x"), (F.col(value) - f).alias("y")).filter("x IS NOT NULL")
    slope = x.groupBy(SERIES).agg((F.sum(F.col("x") * F.col("y")) / F.sum(F.col("x") * F.col("x"))).alias("phi"), F.count("*").alias("n_obs"))
    rest = x.join(slope.select(SERIES, "phi"), SERIES).groupBy(SERIES).agg(F.stddev_samp(F.col("y") - F.col("phi") * F.col("x")).alias("sigma"))
    life = F.when(F.col("phi") >= 1, F.lit(float("inf"))).when(F.col("phi") > 0, ou_half_life(F.col("phi")))
    return slope.join(rest, SERIES).select(SERIES, "phi", "sigma", life.alias("half_life"), "n_obs")


def pair_seed(seed: int, pair: int) -> int:
    """Depends on the seed and the pair's number only."""
    return int(np.random.SeedSequence(seed, spawn_key=(pair,)).generate_state(1, dtype=np.uint32)[0])


def ou_exits(phi_: float, forecast: float, sigma: float, start: float, pt: float, sl: float, max_hp: int, n_iter: int, normals) -> np.ndarray:
    """Profit at exit of each path: above pt, below -sl, or after max_hp steps. normals(n): n draws.

    All paths step together; those that have left draw no more.
    """
    out = np.empty(n_iter)
    live, p = np.arange(n_iter), np.full(n_iter, float(start))
    for hp in range(1, max_hp + 2):
        p = (1.0 - phi_) * forecast + phi_ * p + sigma * normals(len(p))
        profit = p - start
        done = (profit > pt) | (profit < -sl) | (hp > max_hp)
        out[live[done]] = profit[done]
        live, p = live[~done], p[~done]
        if not len(live):
            break
    return out


def otr_grid(spark: SparkSession, forecast: float, half_life: float, sigma: float = 1.0, profit_taking: Sequence[float] | None = None, stop_loss: Sequence[float] | None = None, n_iter: int = 100_000, max_hp: int = 100, seed: int = 0, start: float = 0.0) -> DataFrame:
    """(pair, pt, sl, mean, std, sharpe) of the exits of simulated mean-reverting prices for each pair of barriers; a task per pair."""
    pts = [0.5 * k for k in range(21)] if profit_taking is None else list(profit_taking)
    sls = [0.5 * k for k in range(21)] if stop_loss is None else list(stop_loss)
    rows = [(k, float(a), float(b)) for k, (a, b) in enumerate((a, b) for a in pts for b in sls)]
    phi_ = 2.0 ** (-1.0 / half_life)
    pairs = spark.createDataFrame(rows, "pair int, pt double, sl double").repartition(min(len(rows), 4 * spark.sparkContext.defaultParallelism), "pair")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, pt, sl in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                rng = np.random.Generator(np.random.MT19937(pair_seed(seed, k)))
                x = ou_exits(phi_, forecast, sigma, start, pt, sl, max_hp, n_iter, rng.standard_normal)
                m, s = float(x.mean()), float(x.std())
                out.append((m, s, m / s if s > 0 else None))
            cols = list(zip(*out, strict=True)) if out else [()] * 3
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.float64()) for c in cols)], ["pair", "pt", "sl", "mean", "std", "sharpe"])

    return pairs.mapInArrow(run, "pair int, pt double, sl double, mean double, std double, sharpe double")
