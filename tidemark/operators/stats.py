"""Backtest statistics, overfitting probability and the trial registry."""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Callable, Mapping

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.normal import phi, phi_inverse, phi_value
from tidemark.operators.series import SERIES, by_series, fold, micros

EULER_GAMMA = 0.5772156649015329
DAY_US = 86_400_000_000


def _sharpe(x: str, periods: float) -> Column:
    mean, sd = F.avg(x), F.stddev_samp(x)
    flat = F.max(x) == F.min(x)
    return F.when(flat & (F.max(x) == 0), F.lit(0.0)).when(~flat & (F.count(x) > 1), mean / sd * math.sqrt(periods))


def sharpe_ratio(returns: DataFrame, periods_per_year: float = 252.0, *, annualize: bool = True, value: str = "ret") -> DataFrame:
    """`sharpe` per series: mean over sample deviation; NULLs left out; 0 if all are zero, NULL if all are alike."""
    return returns.groupBy(SERIES).agg(_sharpe(value, periods_per_year if annualize else 1.0).alias("sharpe"))


def probabilistic_sharpe(sr: Column, benchmark: float | Column, n: Column, skew: Column, kurtosis: Column) -> Column:
    """z value whose normal probability is the probabilistic Sharpe ratio."""
    b = F.lit(float(benchmark)) if isinstance(benchmark, (int, float)) else benchmark
    return (sr - b) * F.sqrt(n - 1) / F.sqrt(1 - skew * sr + (kurtosis - 1) / 4 * sr * sr)


def probabilistic_sharpe_ratio(returns: DataFrame, benchmark: float = 0.0, value: str = "ret") -> DataFrame:
    """`psr` per series, with population skewness and kurtosis of its returns; Sharpe ratios are per period."""
    g = returns.groupBy(SERIES).agg(_sharpe(value, 1.0).alias("sr"), F.count(value).alias("n"), F.skewness(value).alias("skew"), (F.kurtosis(value) + 3).alias("kurt"))
    g = g.withColumn("__z", probabilistic_sharpe(F.col("sr"), benchmark, F.col("n"), F.col("skew"), F.col("kurt")))
    return g.withColumn("psr", phi("__z")).drop("__z")


def psr_value(sr: float, benchmark: float, n: int, skew: float = 0.0, kurt: float = 3.0) -> float:
    return phi_value((sr - benchmark) * math.sqrt(n - 1) / math.sqrt(1 - skew * sr + (kurt - 1) / 4 * sr * sr))


def expected_max_sharpe(n_trials: int, var_sr: float) -> float:
    """What the best of n unskilled trials is expected to show."""
    if n_trials < 1 or var_sr < 0:
        raise ValueError("n_trials must be at least 1 and var_sr at least 0")
    if n_trials == 1:
        return 0.0
    g = EULER_GAMMA
    return math.sqrt(var_sr) * ((1 - g) * phi_inverse(1 - 1 / n_trials) + g * phi_inverse(1 - 1 / (n_trials * math.e)))


def deflated_sharpe(sr_hat: float, n_trials: int, var_sr: float, n_obs: int, skew: float = 0.0, kurt: float = 3.0) -> dict[str, float]:
    star = expected_max_sharpe(n_trials, var_sr)
    return {"dsr": psr_value(sr_hat, star, n_obs, skew, kurt), "sr_star": star, "sr_hat": sr_hat}


def deflated_sharpe_ratio(sr_hat: float, n_trials: int, var_sr: float, n_obs: int, skew: float = 0.0, kurt: float = 3.0) -> float:
    return deflated_sharpe(sr_hat, n_trials, var_sr, n_obs, skew, kurt)["dsr"]


def track_record(sr_hat: Column | str, sr_benchmark: Column | str, skew: Column | str, kurt: Column | str, prob: float = 0.95) -> Column:
    """`min_track_record_length` of columns; NULL where the ratio isn't above the benchmark."""
    if not 0.5 <= prob < 1:
        raise ValueError("prob must be in [0.5, 1)")
    sr, low, skew, kurt = (F.col(c) if isinstance(c, str) else c for c in (sr_hat, sr_benchmark, skew, kurt))
    length = 1 + (1 - skew * sr + (kurt - 1) / 4 * sr * sr) * F.pow(F.lit(phi_inverse(prob)) / (sr - low), F.lit(2.0))
    return F.when(sr > low, length)


def min_track_record_length(sr_hat: float, sr_benchmark: float, skew: float = 0.0, kurt: float = 3.0, prob: float = 0.95) -> float:
    """Observations for the probabilistic Sharpe ratio to reach `prob`."""
    if not 0.5 <= prob < 1 or sr_hat <= sr_benchmark:
        raise ValueError("prob must be in [0.5, 1) and sr_hat above sr_benchmark")
    return 1 + (1 - skew * sr_hat + (kurt - 1) / 4 * sr_hat**2) * (phi_inverse(prob) / (sr_hat - sr_benchmark)) ** 2


def bet_timing(positions: DataFrame, value: str = "position") -> DataFrame:
    """Rows at which a bet ends: flat after not flat (a flat first row counts), a change of sign, and the last row."""
    w = by_series(positions)
    p, before = F.col(value), F.lag(value).over(w)
    ends = ((p == 0) & (before.isNull() | (before != 0))) | (F.signum(p) * F.signum(before) < 0) | F.lead(value).over(w).isNull() & (F.row_number().over(w) == F.count("*").over(Window.partitionBy(SERIES)))
    return positions.withColumn("__e", F.coalesce(ends, F.lit(False))).filter("__e").drop("__e")


def holding_period(positions: DataFrame, value: str = "position") -> DataFrame:
    """`holding_days` per series: average time closed size was held; additions move the entry time to the weighted mean; NULL if nothing closed."""

    def begin():
        entry = weighted = closed = 0.0
        last = first = None

        def run(data):
            nonlocal entry, weighted, closed, last, first
            if data is None:
                return [(weighted / closed if closed > 0 else None,)]
            for us, p in zip(data["__us"], data[value], strict=True):
                if last is None:
                    first, last = us, p
                    continue
                t, d = (us - first) / DAY_US, p - last
                if last == 0 or d == 0 or (d > 0) == (last > 0):
                    if p != 0:
                        entry = (entry * last + t * d) / p
                elif p != 0 and (p > 0) != (last > 0):
                    weighted += (t - entry) * abs(last)
                    closed += abs(last)
                    entry = t
                else:
                    weighted += (t - entry) * abs(d)
                    closed += abs(d)
                last = p
            return []

        return run

    return fold(positions.withColumn("__us", micros("ts")), begin, f"{SERIES} {positions.schema[SERIES].dataType.simpleString()}, holding_days double", ["__us", value], ["ts"])


def _hhi(x: Column, n: Column, total: Column, squares: Column) -> Column:
    return F.when((n > 2) & (total != 0), (squares / (total * total) - 1 / n) / (1 - 1 / n))


def hhi_concentration(returns: DataFrame, value: str = "ret") -> DataFrame:
    """`hhi` per series: 0 for even shares, 1 for one; NULL with two values or fewer."""
    x = F.col(value)
    return returns.groupBy(SERIES).agg(_hhi(x, F.count(x), F.sum(x), F.sum(x * x)).alias("hhi"))


def return_concentration(returns: DataFrame, value: str = "ret") -> DataFrame:
    """Concentration of gains, of losses, and of counts per calendar month (months without returns count as 0)."""
    x = F.col(value)
    up, down = F.when(x >= 0, x), F.when(x < 0, x)
    sides = returns.groupBy(SERIES).agg(_hhi(up, F.count(up), F.sum(up), F.sum(up * up)).alias("positive"), _hhi(down, F.count(down), F.sum(down), F.sum(down * down)).alias("negative"), F.date_trunc("month", F.min("ts")).alias("__a"), F.date_trunc("month", F.max("ts")).alias("__b"))
    months = returns.groupBy(SERIES, F.date_trunc("month", "ts").alias("__m")).count()
    every = sides.select(SERIES, F.explode(F.sequence(F.col("__a").cast("date"), F.col("__b").cast("date"), F.expr("INTERVAL 1 MONTH"))).alias("__d"))
    c = every.join(months.withColumn("__d", F.col("__m").cast("date")).drop("__m"), [SERIES, "__d"], "left").withColumn("__c", F.coalesce("count", F.lit(0)).cast("double"))
    time = c.groupBy(SERIES).agg(_hhi(F.col("__c"), F.count("__c"), F.sum("__c"), F.sum(F.col("__c") * F.col("__c"))).alias("time"))
    return sides.drop("__a", "__b").join(time, SERIES)


def drawdown_time_under_water(pnl: DataFrame, dollars: bool = False, value: str = "pnl") -> DataFrame:
    """(series_id, hwm_ts, dd, tuw): each high-water mark that a drawdown follows; tuw in years to the next such mark, NULL for the last."""
    w = by_series(pnl)
    x = pnl.withColumn("__h", F.max(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = x.groupBy(SERIES, "__h").agg(F.min("ts").alias("hwm_ts"), F.min(value).alias("__m")).filter(F.col("__h") > F.col("__m"))
    dd = F.col("__h") - F.col("__m") if dollars else 1 - F.col("__m") / F.col("__h")
    nxt = F.lead(micros("hwm_ts")).over(Window.partitionBy(SERIES).orderBy("hwm_ts"))
    return runs.select(SERIES, "hwm_ts", dd.alias("dd"), ((nxt - micros("hwm_ts")) / (365.25 * DAY_US)).alias("tuw"))


def _split_table(spark: SparkSession, s: int) -> DataFrame:
    rows = [(k, b, b in set(c)) for k, c in enumerate(itertools.combinations(range(s), s // 2)) for b in range(s)]
    return spark.createDataFrame(rows, "split_id int, block int, train boolean")


def cscv(performance: DataFrame, n_partitions: int = 16, performance_fn: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(split_id, best_trial, rank, n_trials, logit) for all ways to split S blocks of time in halves.

    performance: (t, trial_id, ret), t from 0.  Blocks are summed up once; each
    split merges block sums, so the returns are read once however many splits
    there are.  With performance_fn, it scores (time, trial) matrices instead.
    """
    s = n_partitions
    if s < 2 or s % 2:
        raise ValueError("n_partitions must be even and at least 2")
    spark = performance.sparkSession
    size = performance.agg((F.max("t") + 1).alias("n")).first()["n"]
    if size % s:
        raise ValueError("the number of times must be a multiple of n_partitions")
    x = performance.withColumn("block", F.floor(F.col("t") / F.lit(size // s)).cast("int"))
    if performance_fn is not None:
        return _cscv_callable(x, _split_table(spark, s), performance_fn)
    blocks = x.groupBy("trial_id", "block").agg(F.count("*").alias("n"), F.avg("ret").alias("m"), F.var_pop("ret").alias("v"), F.min("ret").alias("lo"), F.max("ret").alias("hi"))
    halves = blocks.join(F.broadcast(_split_table(spark, s)), "block").groupBy("split_id", "trial_id", "train")
    n, mean = F.sum("n"), F.sum(F.col("n") * F.col("m")) / F.sum("n")
    # between-block part by means, within-block part by variances: no difference of large squares
    merged = halves.agg(n.alias("n"), mean.alias("mean"), F.collect_list(F.struct("n", "m", "v")).alias("parts"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    square = F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["n"] * (p["v"] + (p["m"] - F.col("mean")) * (p["m"] - F.col("mean"))))
    inf = F.lit(float("inf"))
    sr = F.when(F.col("lo") == F.col("hi"), F.when(F.col("lo") == 0, F.lit(0.0)).otherwise(F.signum("lo") * inf)).otherwise(F.col("mean") / F.sqrt(square / (F.col("n") - 1)))
    scored = merged.select("split_id", "trial_id", "train", sr.alias("sr"))
    both = scored.groupBy("split_id", "trial_id").agg(F.max(F.when(F.col("train"), F.col("sr"))).alias("inside"), F.max(F.when(~F.col("train"), F.col("sr"))).alias("outside"))
    best = F.max_by(F.struct("trial_id", "outside"), F.struct(F.col("inside"), -F.col("trial_id")))
    won = both.groupBy("split_id").agg(best.alias("b"), F.collect_list("outside").alias("all"), F.count("*").alias("n_trials"))
    rank = F.size(F.filter("all", lambda v: v <= F.col("b.outside")))
    return won.select("split_id", F.col("b.trial_id").alias("best_trial"), rank.cast("long").alias("rank"), "n_trials").withColumn("__o", F.col("rank") / (F.col("n_trials") + 1)).withColumn("logit", F.log(F.col("__o") / (1 - F.col("__o")))).drop("__o")


def _cscv_callable(x: DataFrame, splits: DataFrame, fn: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    def score(pdf):
        import pandas as pd

        wide = {k: g.pivot(index="t", columns="trial_id", values="ret").sort_index() for k, g in pdf.groupby("train")}
        inside, outside = (np.asarray(fn(wide[k].to_numpy()), dtype=float).ravel() for k in (True, False))
        best = int(np.argmax(inside))
        rank, n = int((outside <= outside[best]).sum()), len(outside)
        o = rank / (n + 1.0)
        return pd.DataFrame({"split_id": [int(pdf["split_id"].iloc[0])], "best_trial": [wide[True].columns[best]], "rank": [rank], "n_trials": [n], "logit": [math.log(o / (1 - o))]})

    kind = x.schema["trial_id"].dataType.simpleString()
    return x.join(F.broadcast(splits), "block").groupBy("split_id").applyInPandas(score, f"split_id int, best_trial {kind}, rank long, n_trials long, logit double")


def probability_of_backtest_overfitting(performance: DataFrame, n_partitions: int = 16, performance_fn: Callable | None = None) -> DataFrame:
    """(pbo, n_splits, mean_logit): the share of splits whose winner inside ranks in the lower half outside."""
    c = cscv(performance, n_partitions, performance_fn)
    return c.agg(F.avg((F.col("logit") <= 0).cast("double")).alias("pbo"), F.count("*").alias("n_splits"), F.avg("logit").alias("mean_logit"))


class TrialRegistry:
    """Trials (name, typed parameters, returns) in order of record; kept as a table with `to_df`."""

    def __init__(self):
        self._rows: list[tuple[str, dict, list[float]]] = []

    def record(self, name: str, params: Mapping[str, str | int | float | bool | None], returns) -> None:
        name, returns = name.strip(), [float(r) for r in returns]
        if not name or any(n == name for n, _, _ in self._rows):
            raise ValueError("a trial needs a name of its own")
        if not returns or not all(map(math.isfinite, returns)):
            raise ValueError("returns must be finite and not empty")
        for k, v in params.items():
            if not isinstance(k, str) or not (v is None or isinstance(v, (str, int, float, bool))):
                raise ValueError(f"parameter {k!r} has no plain value")
        self._rows.append((name, dict(params), returns))

    def __len__(self) -> int:
        return len(self._rows)

    def to_df(self, spark: SparkSession) -> DataFrame:
        """(trial_id, name, params map<string, struct<type, value>>, returns)."""
        rows = [(k, n, {p: (type(v).__name__, None if v is None else repr(v) if not isinstance(v, str) else v) for p, v in ps.items()}, r) for k, (n, ps, r) in enumerate(self._rows)]
        return spark.createDataFrame(rows, "trial_id int, name string, params map<string,struct<type:string,value:string>>, returns array<double>")

    def to_json(self) -> str:
        return json.dumps({"format": 1, "trials": [{"name": n, "params": p, "returns": r} for n, p, r in self._rows]}, allow_nan=False)

    @classmethod
    def from_json(cls, text: str) -> TrialRegistry:
        data = json.loads(text)
        if data.get("format") != 1:
            raise ValueError("unknown format")
        out = cls()
        for t in data["trials"]:
            out.record(t["name"], t["params"], t["returns"])
        return out

    def performance_matrix(self, spark: SparkSession) -> DataFrame:
        return performance_matrix(self.to_df(spark))

    def pbo(self, spark: SparkSession, n_partitions: int = 16) -> DataFrame:
        return probability_of_backtest_overfitting(self.performance_matrix(spark), n_partitions)

    def deflated_sharpe(self, spark: SparkSession) -> DataFrame:
        return registry_deflated_sharpe(self.performance_matrix(spark))


def performance_matrix(trials: DataFrame) -> DataFrame:
    """(t, trial_id, ret) from trials with arrays of returns."""
    return trials.select("trial_id", F.posexplode("returns").alias("t", "ret")).select(F.col("t").cast("long"), "trial_id", "ret")


def registry_deflated_sharpe(performance: DataFrame) -> DataFrame:
    """Deflated Sharpe ratio of the best trial (the first on a tie) given the variance of all trials' Sharpe ratios."""
    g = performance.groupBy("trial_id").agg(_sharpe("ret", 1.0).alias("sr"), F.count("*").alias("n"), F.skewness("ret").alias("skew"), (F.kurtosis("ret") + 3).alias("kurt"))
    won = g.agg(F.max_by(F.struct("trial_id", "sr", "n", "skew", "kurt"), F.struct("sr", -F.col("trial_id"))).alias("b"), F.var_samp("sr").alias("var_sr"), F.count("*").alias("n_trials")).select("b.*", "var_sr", "n_trials")
    row = won.first()
    star = expected_max_sharpe(row["n_trials"], row["var_sr"] or 0.0)
    out = won.withColumn("sr_star", F.lit(star)).withColumn("__z", probabilistic_sharpe(F.col("sr"), star, F.col("n"), F.col("skew"), F.col("kurt")))
    return out.withColumn("dsr", phi("__z")).drop("__z")
