"""Bars and event sampling over tick tables.

Ticks: series_id, ts, seq, price and, where a bar needs it, volume.  Bars have
open, high, low, close, volume, dollar_value, ticks, and the closing tick's ts
and seq.  A last bar that has not closed is dropped, but for time bars.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.microstructure import tick_rule
from tidemark.operators.series import SERIES, by_series, fold, order_of, with_long_pos, with_pos

KINDS = ("tick", "volume", "dollar")


def _volume(df: DataFrame) -> DataFrame:
    return df if "volume" in df.columns else df.withColumn("volume", F.lit(None).cast("double"))


def _ohlcv(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    at = F.struct(*order_of(df))
    return df.groupBy(SERIES, *keys).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"),
        F.sum("volume").alias("volume"), F.sum(F.col("price") * F.col("volume")).alias("dollar_value"), F.count("*").alias("ticks"), F.max(at).alias("__at"),
    )


def _closed(bars: DataFrame, order: Sequence[str]) -> DataFrame:
    return bars.select(SERIES, "bar_id", *(F.col(f"__at.{c}").alias(f"bar_{c}") for c in order), "open", "high", "low", "close", "volume", "dollar_value", "ticks")


def time_bars(ticks: DataFrame, freq: str = "1 minute") -> DataFrame:
    """Calendar bars: intervals closed and labelled on the right; empty ones have no row; the last may be open.

    Sums are combined before the shuffle, so a long series is no hot key.
    """
    ticks = _volume(ticks)
    window = F.window(F.col("ts") - F.expr("INTERVAL '0.000001' SECOND"), freq)
    bars = _ohlcv(ticks.withColumn("bar_ts", window["end"].cast(ticks.schema["ts"].dataType)), ["bar_ts"])
    return bars.drop("__at")


def tick_bars(ticks: DataFrame, threshold: int, bucket: str | None = None) -> DataFrame:
    """A bar every `threshold` ticks.

    With a bucket ("day", "hour"), ticks are numbered bucket by bucket, so that no task holds a whole series.
    """
    if threshold != int(threshold) or threshold < 1:
        raise ValueError("threshold must be a positive integer")
    ticks = (with_long_pos(_volume(ticks), name="__pos", bucket=bucket) if bucket else with_pos(_volume(ticks), name="__pos")).withColumn("bar_id", F.floor(F.col("__pos") / F.lit(int(threshold))).cast("long")).drop("__pos")
    return _closed(_ohlcv(ticks, ["bar_id"]).filter(F.col("ticks") == int(threshold)), order_of(ticks))


def _by_fold(ticks: DataFrame, step, columns: Sequence[str]) -> DataFrame:
    """Bars whose ends a sequential rule finds: one sorted pass makes the bars themselves, so ticks are shuffled once."""
    ticks = _volume(ticks)
    order = order_of(ticks)
    types = ", ".join(f"bar_{c} {ticks.schema[c].dataType.simpleString()}" for c in order)
    schema = f"{SERIES} {ticks.schema[SERIES].dataType.simpleString()}, bar_id long, {types}, open double, high double, low double, close double, volume double, dollar_value double, ticks long"

    def begin():
        rule, bar, number = step(), None, 0

        def run(data):
            nonlocal bar, number
            if data is None:
                return []
            out = []
            for row in zip(*(data[c] for c in (*order, "price", "volume", *columns)), strict=True):
                at, p, v = row[: len(order)], row[len(order)], row[len(order) + 1]
                if bar is None:
                    bar = [p, p, p, p, None, None, 0]
                bar[1], bar[2], bar[3] = max(bar[1], p), min(bar[2], p), p
                if v is not None:
                    bar[4] = v if bar[4] is None else bar[4] + v
                    bar[5] = p * v if bar[5] is None else bar[5] + p * v
                bar[6] += 1
                if rule(*row[len(order) :]):
                    out.append((number, *at, *bar))
                    number, bar = number + 1, None
            return out

        return run

    return fold(ticks, begin, schema, [*order, "price", "volume", *columns])


def volume_bars(ticks: DataFrame, threshold: float) -> DataFrame:
    """A bar closes when the volume since the last close reaches `threshold`; what is over it is dropped."""
    return _by_fold(ticks, lambda: _Since(threshold, lambda p, v: v), [])


def dollar_bars(ticks: DataFrame, threshold: float) -> DataFrame:
    """As volume bars, on price times volume."""
    return _by_fold(ticks, lambda: _Since(threshold, lambda p, v: p * v), [])


class _Since:
    def __init__(self, threshold: float, value):
        if not threshold > 0:
            raise ValueError("threshold must be positive")
        self.threshold, self.value, self.total = threshold, value, 0.0

    def __call__(self, price: float, volume: float, *_) -> bool:
        self.total += self.value(price, volume)
        if self.total >= self.threshold:
            self.total = 0.0
            return True
        return False


def _magnitude(kind: str) -> Column:
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    return {"tick": F.lit(1.0), "volume": F.col("volume"), "dollar": F.col("price") * F.col("volume")}[kind]


def _alpha(span: float) -> float:
    if not span >= 1:
        raise ValueError("span must be at least 1")
    return 2.0 / (span + 1.0)


def _first_mean(ticks: DataFrame, columns: Sequence[str], init: int) -> DataFrame:
    """Means of the first `init` rows of each series, on each row."""
    w = by_series(ticks)
    ticks = ticks.withColumn("__n", F.row_number().over(w))
    whole = Window.partitionBy(SERIES)
    for c in columns:
        ticks = ticks.withColumn(f"{c}0", F.avg(F.when(F.col("__n") <= init, F.col(c))).over(whole))
    return ticks.drop("__n")


class _Imbalance:
    """Close where the signed sum reaches expected length times expected size; expectations move at closes."""

    def __init__(self, init: int, a_bars: float, a_ticks: float):
        self.length, self.a, self.b = float(init), a_bars, a_ticks
        self.mean = self.limit = None
        self.moving = 0.0
        self.sum, self.n = 0.0, 0

    def __call__(self, price, volume, s, s0) -> bool:
        if self.mean is None:
            self.mean = self.moving = s0
            self.limit = self.length * abs(s0)
        self.sum += s
        self.n += 1
        self.moving = self.b * s + (1.0 - self.b) * self.moving
        if abs(self.sum) < self.limit:
            return False
        self.length = self.a * self.n + (1.0 - self.a) * self.length
        self.mean = self.moving
        self.limit = self.length * abs(self.mean)
        self.sum, self.n = 0.0, 0
        return True


class _Runs:
    """Close where the larger of bought and sold sums reaches expected length times the larger expectation."""

    def __init__(self, init: int, a_bars: float, a_ticks: float):
        self.length, self.a, self.b = float(init), a_bars, a_ticks
        self.limit = None
        self.buy = self.sell = 0.0
        self.bought = self.sold = 0.0
        self.n = 0

    def __call__(self, price, volume, buy, sell, buy0, sell0) -> bool:
        if self.limit is None:
            self.buy, self.sell = buy0, sell0
            self.limit = self.length * max(buy0, sell0)
        self.bought += buy
        self.sold += sell
        self.n += 1
        self.buy = self.b * buy + (1.0 - self.b) * self.buy
        self.sell = self.b * sell + (1.0 - self.b) * self.sell
        if max(self.bought, self.sold) < self.limit:
            return False
        self.length = self.a * self.n + (1.0 - self.a) * self.length
        self.limit = self.length * max(self.buy, self.sell)
        self.bought = self.sold = 0.0
        self.n = 0
        return True


def imbalance_bars(ticks: DataFrame, kind: str = "tick", *, init_T: int = 100, span_bars: float = 20, span_ticks: float = 1000, b0: float = 1.0) -> DataFrame:
    """Tick, volume or dollar imbalance bars.

    Expected length starts at init_T and the expected signed size at the mean of
    the first init_T ticks; both are exponential averages updated when a bar closes.
    """
    a, b = _alpha(span_bars), _alpha(span_ticks)
    signed = tick_rule(_volume(ticks), b0).withColumn("s", F.col("sign") * _magnitude(kind))
    return _by_fold(_first_mean(signed, ["s"], init_T), lambda: _Imbalance(init_T, a, b), ["s", "s0"])


def run_bars(ticks: DataFrame, kind: str = "tick", *, init_T: int = 100, span_bars: float = 20, span_ticks: float = 1000, b0: float = 1.0) -> DataFrame:
    """Tick, volume or dollar runs bars."""
    a, b = _alpha(span_bars), _alpha(span_ticks)
    signed = tick_rule(_volume(ticks), b0)
    signed = signed.withColumn("buy", F.when(F.col("sign") > 0, _magnitude(kind)).otherwise(0.0)).withColumn("sell", F.when(F.col("sign") < 0, _magnitude(kind)).otherwise(0.0))
    return _by_fold(_first_mean(signed, ["buy", "sell"], init_T), lambda: _Runs(init_T, a, b), ["buy", "sell", "buy0", "sell0"])


def cusum_filter(df: DataFrame, threshold: float, value: str = "price", *, is_returns: bool = False) -> DataFrame:
    """Events where the sum of moves up passes `threshold` or that of moves down passes -threshold; that side starts anew.

    With levels the first row of a series is never an event.
    """
    if not threshold > 0:
        raise ValueError("threshold must be positive")
    order = order_of(df)
    types = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in order)

    def begin():
        up = down = 0.0
        last = None

        def run(data):
            nonlocal up, down, last
            if data is None:
                return []
            out = []
            for *at, x in zip(*(data[c] for c in (*order, value)), strict=True):
                move = x if is_returns else 0.0 if last is None else x - last
                last = x
                up, down = max(0.0, up + move), min(0.0, down + move)
                if down < -threshold:
                    down = 0.0
                    out.append((*at, -1))
                elif up > threshold:
                    up = 0.0
                    out.append((*at, 1))
            return out

        return run

    return fold(df, begin, f"{SERIES} {df.schema[SERIES].dataType.simpleString()}, {types}, side int", [*order, value])


def repeated_naive_times(df: DataFrame) -> DataFrame:
    """Times of a series that come again after other times, as clocks set back give; none in a sound table."""
    w = by_series(df, ["seq"])
    run = F.sum(F.when(F.lag("ts").over(w) != F.col("ts"), 1).otherwise(0)).over(w)
    return df.withColumn("__run", run).groupBy(SERIES, "ts").agg(F.countDistinct("__run").alias("runs")).filter("runs > 1")
