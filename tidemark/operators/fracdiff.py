"""Fractional differentiation."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.series import SERIES, by_series, per_series, with_pos

MAX_WIDTH = 10_000_000
#: Weights up to which the window sum is written out as lags.
_LAGS = 64


def get_weights(d: float, size: int) -> list[float]:
    """Weights by lag: 1, and each next one times -(d - k + 1) / k."""
    if size < 1:
        raise ValueError("size must be at least 1")
    out = [1.0]
    for k in range(1, size):
        out.append(-out[-1] * (d - k + 1) / k)
    return out


def get_weights_ffd(d: float, thres: float = 1e-5) -> list[float]:
    """Weights by lag until the first below `thres` in size, which is left out."""
    if not d > -1 or not thres > 0:
        raise ValueError("d must be above -1 and thres above 0")
    out = [1.0]
    for k in range(1, MAX_WIDTH):
        w = -out[-1] * (d - k + 1) / k
        if abs(w) < thres:
            return out
        out.append(w)
    raise ValueError("more weights than the limit; raise thres")


def frac_diff_ffd(df: DataFrame, d: float, thres: float = 1e-5, value: str = "value", name: str = "fd") -> DataFrame:
    """Fixed-width differences of forward-filled values; NULL for the first rows that lack a full window and where the input is NULL."""
    w = get_weights_ffd(d, thres)
    order = by_series(df)
    x = df.withColumn("__x", F.last(value, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    if len(w) <= _LAGS:
        total = sum((F.lag("__x", k).over(order) if k else F.col("__x")) * F.lit(c) for k, c in enumerate(w))
    else:
        # the window as an array, multiplied with the weights from the oldest on
        frame = F.collect_list("__x").over(order.rowsBetween(-(len(w) - 1), 0))
        total = F.when(F.size(frame) == len(w), F.aggregate(F.zip_with(frame, F.lit(list(reversed(w))), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))
    return x.withColumn(name, F.when(F.col(value).isNotNull(), total)).drop("__x")


def _convolved(y: np.ndarray, w: np.ndarray, direct: int = 8192) -> np.ndarray:
    """The first len(y) values of the convolution; by Fourier transforms beyond `direct` values, where n squared products are too many."""
    n = len(y)
    if n <= direct:
        return np.convolve(y, w)[:n]
    size = 1 << (2 * n - 1).bit_length()
    # the first value is taken out, so that rounding follows the changes and not the level
    rest = np.fft.irfft(np.fft.rfft(y - y[0], size) * np.fft.rfft(w, size), size)[:n]
    return rest + y[0] * np.cumsum(w)


def frac_diff(df: DataFrame, d: float, thres: float = 0.01, value: str = "value", name: str = "fd") -> DataFrame:
    """Differences over the whole past, from the first row on whose share of weights left out is at most `thres`; leading NULLs are skipped.

    A series' rows meet in one task, where a convolution does it.
    """
    kind = df.schema[SERIES].dataType.simpleString()

    def run(data: dict) -> list[tuple]:
        x = np.array(data[value], dtype=float)
        pos = data["pos"].tolist()
        ok = np.flatnonzero(~np.isnan(x))
        out: list[float | None] = [None] * len(x)
        if len(ok):
            at = ok[0]
            y = x[at:].copy()
            for k in np.flatnonzero(np.isnan(y)):
                y[k] = y[k - 1]
            w = np.array(get_weights(d, len(y)))
            loss = np.cumsum(np.abs(w))
            loss = loss / loss[-1]
            # weights beyond a row's past are lost at that row: n - 1 - t of them are the farthest
            first = int(np.searchsorted(-(1 - loss), -thres, side="left"))
            got = _convolved(y, w)
            for t in range(first, len(y)):
                if not np.isnan(x[at + t]):
                    out[at + t] = float(got[t])
        return list(zip(pos, out, strict=True))

    numbered = with_pos(df, name="pos") if "pos" not in df.columns else df
    got = per_series(numbered.select(SERIES, "pos", value), run, f"{SERIES} {kind}, pos long, {name} double", ["pos", value], ["pos"])
    return numbered.join(got, [SERIES, "pos"])


def find_min_d(df: DataFrame, adf_test: Callable[[np.ndarray], float], adf_pvalue: float = 0.05, d_grid: Sequence[float] | None = None, thres: float = 0.01, value: str = "value") -> DataFrame:
    """(series_id, d, p_value, corr): the least d of the grid whose fixed-width difference passes the test; a task per series and d.

    adf_test: values -> p value.  corr is that of the difference with the levels.
    """
    grid = [float(x) for x in (np.linspace(0, 1, 11) if d_grid is None else d_grid)]
    kind = df.schema[SERIES].dataType.simpleString()
    keyed = with_pos(df).select(SERIES, "pos", value, F.explode(F.lit(grid)).alias("d"))

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("pos")
        d = float(pdf["d"].iloc[0])
        x = pdf[value].ffill().to_numpy(float)
        w = np.array(get_weights_ffd(d, thres))
        y = np.convolve(x, w)[len(w) - 1 : len(x)]
        ok = ~np.isnan(y)
        p = float(adf_test(y[ok])) if ok.sum() > 2 else float("nan")
        c = float(np.corrcoef(x[len(w) - 1 :][ok], y[ok])[0, 1]) if ok.sum() > 2 else float("nan")
        return pd.DataFrame({SERIES: [pdf[SERIES].iloc[0]], "d": [d], "p_value": [p], "corr": [c]})

    tried = keyed.groupBy(SERIES, "d").applyInPandas(run, f"{SERIES} {kind}, d double, p_value double, corr double")
    best = F.min(F.when(F.col("p_value") < adf_pvalue, F.struct("d", "p_value", "corr")))
    return tried.groupBy(SERIES).agg(best.alias("b")).select(SERIES, "b.*")
