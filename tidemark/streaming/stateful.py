"""Streaming forms of the sequential operators.

State per series is what the batch operator carries; it is kept as bytes in the
state store.  Rows of a micro-batch are put in order of (ts, seq) per series;
rows that come later than their successors' batch are taken as they come.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions.normal import phi_value
from tidemark.operators.bars import _alpha, _Imbalance, _Runs, _Since
from tidemark.operators.series import SERIES

BAR = "bar_id long, bar_ts timestamp_ntz, bar_seq long, open double, high double, low double, close double, volume double, dollar_value double, ticks long"


def stream_time_bars(ticks: DataFrame, freq: str = "1 minute", delay: str = "1 minute") -> DataFrame:
    """Time bars in append mode: a bar comes out when the watermark has passed its end, so none is open."""
    # a moment earlier, so that windows are closed on the right; the watermark goes with this column
    stream = ticks.withColumn("__at", F.col("ts").cast("timestamp") - F.expr("INTERVAL '0.000001' SECOND")).withWatermark("__at", delay)
    if "volume" not in stream.columns:
        stream = stream.withColumn("volume", F.lit(None).cast("double"))
    at = F.struct("ts", "seq")
    window = F.window("__at", freq)
    bars = stream.groupBy(SERIES, window.alias("w")).agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("volume").alias("volume"), F.sum(F.col("price") * F.col("volume")).alias("dollar_value"), F.count("*").alias("ticks"))
    return bars.select(SERIES, F.col("w.end").alias("bar_ts"), "open", "high", "low", "close", "volume", "dollar_value", "ticks")


def stateful(df: DataFrame, begin: Callable[[], Any], schema: str) -> DataFrame:
    """begin() gives a fresh state with step(row) -> list of result tuples; it lives across micro-batches."""
    kind = df.schema[SERIES].dataType.simpleString()
    names = [c.split()[0] for c in schema.split(", ")]

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine = cloudpickle.loads(state.get[0]) if state.exists else begin()
        rows = pd.concat(list(frames)).sort_values(["ts", "seq"])
        out = [(key[0], *r) for row in rows.itertuples(index=False) for r in machine.step(row)]
        state.update((cloudpickle.dumps(machine),))
        yield pd.DataFrame(out, columns=[SERIES, *names])

    return df.groupBy(SERIES).applyInPandasWithState(run, f"{SERIES} {kind}, {schema}", "state binary", "append", GroupStateTimeout.NoTimeout)


class _Sign:
    def __init__(self, b0: float = 1.0):
        self.sign, self.last = b0, None

    def next(self, price: float) -> float:
        if self.last is not None and price != self.last:
            self.sign = 1.0 if price > self.last else -1.0
        self.last = price
        return self.sign


class _TickRule(_Sign):
    def step(self, row) -> list[tuple]:
        return [(row.ts, row.seq, row.price, self.next(row.price))]


class _Cusum:
    def __init__(self, threshold: float):
        self.threshold, self.up, self.down, self.last = threshold, 0.0, 0.0, None

    def step(self, row) -> list[tuple]:
        move = 0.0 if self.last is None else row.price - self.last
        self.last = row.price
        self.up, self.down = max(0.0, self.up + move), min(0.0, self.down + move)
        if self.down < -self.threshold:
            self.down = 0.0
            return [(row.ts, row.seq, -1)]
        if self.up > self.threshold:
            self.up = 0.0
            return [(row.ts, row.seq, 1)]
        return []


class _Bars:
    """Bars closed by a rule; with `init`, the first ticks wait until the rule's starting means are known."""

    def __init__(self, rule, values: Callable[[float, float, float], tuple], init: int = 0):
        self.rule, self.values, self.init = rule, values, init
        self.sign, self.waiting, self.means, self.bar, self.number = _Sign(), [], None, None, 0

    def step(self, row) -> list[tuple]:
        volume = float(row.volume) if hasattr(row, "volume") and row.volume == row.volume else 0.0
        tick = (row.ts, row.seq, row.price, volume, self.values(self.sign.next(row.price), row.price, volume))
        if self.init and self.means is None:
            self.waiting.append(tick)
            if len(self.waiting) < self.init:
                return []
            n = len(self.waiting)
            self.means = tuple(sum(t[4][k] for t in self.waiting) / n for k in range(len(tick[4])))
            ticks, self.waiting = self.waiting, []
        else:
            ticks = [tick]
        return [r for t in ticks for r in self._add(t)]

    def _add(self, tick) -> list[tuple]:
        ts, seq, p, v, values = tick
        if self.bar is None:
            self.bar = [p, p, p, p, 0.0, 0.0, 0]
        b = self.bar
        b[1], b[2], b[3] = max(b[1], p), min(b[2], p), p
        b[4], b[5], b[6] = b[4] + v, b[5] + p * v, b[6] + 1
        if not self.rule(p, v, *values, *(self.means or ())):
            return []
        self.bar, self.number = None, self.number + 1
        return [(self.number - 1, ts, seq, *b)]


class _Vpin:
    """Buckets of equal volume with shares bought by bulk classification, and a ring of the last imbalances."""

    def __init__(self, bucket: float, window: int):
        self.bucket, self.window = bucket, window
        self.last, self.n, self.mean, self.m2 = None, 0, 0.0, 0.0
        self.fill = self.buy = self.sell = 0.0
        self.ring: list[float] = []
        self.number = 0

    def step(self, row) -> list[tuple]:
        share = 0.5
        if self.last is not None:
            d = row.price - self.last
            sd = (self.m2 / (self.n - 1)) ** 0.5 if self.n > 1 else None
            if sd:
                share = phi_value(d / sd)
            elif sd == 0 and d:
                share = 1.0 if d > 0 else 0.0
            self.n += 1
            step = d - self.mean
            self.mean += step / self.n
            self.m2 += step * (d - self.mean)
        self.last = row.price
        left, out = float(row.volume), []
        while left > 0:
            part = min(left, self.bucket - self.fill)
            self.fill, self.buy, self.sell, left = self.fill + part, self.buy + part * share, self.sell + part * (1 - share), left - part
            if self.fill >= self.bucket * (1 - 1e-12):
                self.ring = [*self.ring, abs(self.buy - self.sell)][-self.window :]
                full = len(self.ring) == self.window
                out.append((self.number, self.buy, self.sell, sum(self.ring) / (self.window * self.bucket) if full else None))
                self.number, self.fill, self.buy, self.sell = self.number + 1, 0.0, 0.0, 0.0
        return out


class _Holding:
    """Average time that closed size was held, as it stands after each row that closes some."""

    def __init__(self):
        self.entry = self.weighted = self.closed = 0.0
        self.first = self.last = None

    def step(self, row) -> list[tuple]:
        p = float(row.position)
        if self.last is None:
            self.first, self.last = row.ts, p
            return []
        t, last = (row.ts - self.first) / pd.Timedelta(days=1), self.last
        d, before = p - last, self.closed
        if last == 0 or d == 0 or (d > 0) == (last > 0):
            if p != 0:
                self.entry = (self.entry * last + t * d) / p
        else:
            flip = p != 0 and (p > 0) != (last > 0)
            size = abs(last) if flip else abs(d)
            self.weighted += (t - self.entry) * size
            self.closed += size
            self.entry = t if flip else self.entry
        self.last = p
        return [(row.ts, self.weighted / self.closed)] if self.closed > before else []


def _size(kind: str, p: float, v: float) -> float:
    return 1.0 if kind == "tick" else v if kind == "volume" else p * v


def stream_tick_rule(ticks: DataFrame, b0: float = 1.0) -> DataFrame:
    return stateful(ticks, lambda: _TickRule(b0), "ts timestamp_ntz, seq long, price double, sign double")


def stream_cusum(ticks: DataFrame, threshold: float) -> DataFrame:
    return stateful(ticks, lambda: _Cusum(threshold), "ts timestamp_ntz, seq long, side int")


def stream_volume_bars(ticks: DataFrame, threshold: float) -> DataFrame:
    return stateful(ticks, lambda: _Bars(_Since(threshold, lambda p, v: v), lambda s, p, v: ()), BAR)


def stream_dollar_bars(ticks: DataFrame, threshold: float) -> DataFrame:
    return stateful(ticks, lambda: _Bars(_Since(threshold, lambda p, v: p * v), lambda s, p, v: ()), BAR)


def stream_imbalance_bars(ticks: DataFrame, kind: str = "tick", init_T: int = 100, span_bars: float = 20, span_ticks: float = 1000) -> DataFrame:
    a, b = _alpha(span_bars), _alpha(span_ticks)
    return stateful(ticks, lambda: _Bars(_Imbalance(init_T, a, b), lambda s, p, v: (s * _size(kind, p, v),), init_T), BAR)


def stream_run_bars(ticks: DataFrame, kind: str = "tick", init_T: int = 100, span_bars: float = 20, span_ticks: float = 1000) -> DataFrame:
    a, b = _alpha(span_bars), _alpha(span_ticks)
    return stateful(ticks, lambda: _Bars(_Runs(init_T, a, b), lambda s, p, v: (_size(kind, p, v) if s > 0 else 0.0, _size(kind, p, v) if s < 0 else 0.0), init_T), BAR)




def stream_vpin(ticks: DataFrame, bucket_volume: float, n_window: int) -> DataFrame:
    return stateful(ticks, lambda: _Vpin(bucket_volume, n_window), "bucket long, buy double, sell double, vpin double")


def stream_holding_period(positions: DataFrame) -> DataFrame:
    """positions: series_id, ts, seq, position."""
    return stateful(positions, _Holding, "ts timestamp_ntz, holding_days double")
