"""Structural breaks: CUSUM tests, explosiveness, trend and break regressions.

Tests over all (start, end) windows of a series compute prefix sums of the
regressors' products once, so a window's moments are two differences; end points
are dealt to tasks with the series broadcast to each (`all_windows`).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.series import SERIES, by_series, per_series, with_pos

CSW_B = 4.6
DETERMINISTIC = {"nc": 0, "c": 1, "ct": 2, "ctt": 3}


def cusum_test(df: DataFrame, value: str = "value", exog: Sequence[str] = ()) -> DataFrame:
    """`residual`, `statistic` and `z`: recursive residuals, their sum over sigma, and that over sqrt of their number.

    Without exog the design is a constant, and the residual is a window
    expression; with exog the recursion runs in one task per series.
    """
    if exog:
        return _cusum_exog(df, value, list(exog))
    w = by_series(df)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    n = F.count(value).over(before)
    x = df.withColumn("residual", F.when(n >= 1, (F.col(value) - F.avg(value).over(before)) / F.sqrt(1 + 1 / n)))
    every = Window.partitionBy(SERIES)
    sigma = F.sqrt(F.avg(F.col("residual") * F.col("residual")).over(every))
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    s = F.sum("residual").over(so_far) / F.nullif(sigma, F.lit(0.0))
    x = x.withColumn("statistic", F.when(F.col("residual").isNotNull(), s))
    return x.withColumn("z", F.col("statistic") / F.sqrt(F.count("residual").over(so_far)))


def _cusum_exog(df: DataFrame, value: str, exog: list[str]) -> DataFrame:
    numbered = df if "pos" in df.columns else with_pos(df)
    kind = df.schema[SERIES].dataType.simpleString()

    def run(data: dict) -> list[tuple]:
        y = np.asarray(data[value], dtype=float)
        x = np.column_stack([np.asarray(data[c], dtype=float) for c in exog])
        n, p = x.shape
        if n - p < 2:
            raise ValueError("need at least two recursive residuals")
        inverse = np.linalg.inv(x[:p].T @ x[:p])
        beta = inverse @ (x[:p].T @ y[:p])
        res = np.full(n, np.nan)
        for t in range(p, n):
            k = inverse @ x[t]
            f = 1 + x[t] @ k
            e = y[t] - x[t] @ beta
            res[t] = e / math.sqrt(f)
            beta = beta + k * e / f
            inverse = inverse - np.outer(k, k) / f
        sigma = math.sqrt(np.mean(res[p:] ** 2))
        s = np.full(n, np.nan)
        s[p:] = np.cumsum(res[p:]) / sigma
        z = s / np.sqrt(np.maximum(np.arange(n) - p + 1, 1))
        return [(int(k), None if np.isnan(a) else float(a), None if np.isnan(b) else float(b), None if np.isnan(c) else float(c)) for k, a, b, c in zip(data["pos"], res, s, z, strict=True)]

    got = per_series(numbered.select(SERIES, "pos", value, *exog), run, f"{SERIES} {kind}, pos long, residual double, statistic double, z double", ["pos", value, *exog], ["pos"])
    return numbered.join(got, [SERIES, "pos"])


def csw_critical_value(lag: Column, b: float = CSW_B) -> Column:
    return F.sqrt(F.lit(float(b)) + F.log(lag))


def chu_stinchcombe_white(df: DataFrame, reference: int | None = None, b: float = CSW_B, value: str = "value") -> DataFrame:
    """`statistic`, `reference`, `critical` and `reject` at each position: the level against a fixed earlier one, or the largest over all earlier ones (the first on a tie).

    All pairs of a series' positions are looked at without making rows of them:
    each task takes end points and the series as an array.
    """
    x = df if "pos" in df.columns else with_pos(df)
    w = Window.partitionBy(SERIES).orderBy("pos")
    d = F.col(value) - F.lag(value).over(w)
    x = x.withColumn("__d2", d * d)
    x = x.withColumn("__s", F.sqrt(F.sum("__d2").over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.col("pos")))
    if reference is not None:
        ref = F.max(F.when(F.col("pos") == reference, F.col(value))).over(Window.partitionBy(SERIES))
        lag = F.col("pos") - reference
        stat = F.when((lag > 0) & (F.col("__s") > 0), (F.col(value) - ref) / (F.col("__s") * F.sqrt(lag)))
        out = x.withColumn("statistic", stat).withColumn("reference", F.when(lag > 0, F.lit(reference).cast("long"))).withColumn("critical", F.when(lag > 0, csw_critical_value(lag, b)))
        return out.withColumn("reject", F.coalesce(F.col("statistic") > F.col("critical"), F.lit(False))).drop("__d2", "__s")
    kind = df.schema[SERIES].dataType.simpleString()

    def sup(y: np.ndarray, ends: np.ndarray) -> list[tuple]:
        sigma = np.sqrt(np.cumsum(np.concatenate(([0.0], np.diff(y) ** 2))) / np.maximum(np.arange(len(y)), 1))
        out = []
        for t in ends.tolist():
            if t < 1 or sigma[t] == 0:
                out.append((t, None, None))
                continue
            s = (y[t] - y[:t]) / (sigma[t] * np.sqrt(t - np.arange(t)))
            k = int(np.argmax(s))
            out.append((t, float(s[k]), k))
        return out

    got = all_windows(x, sup, f"{SERIES} {kind}, pos long, statistic double, reference long", value)
    got = got.withColumn("critical", csw_critical_value(F.col("pos") - F.col("reference"), b)).withColumn("reject", F.coalesce(F.col("statistic") > F.col("critical"), F.lit(False)))
    return x.drop("__d2", "__s").join(got, [SERIES, "pos"])


def all_windows(df: DataFrame, fn: Callable[[np.ndarray, np.ndarray], list[tuple]], schema: str, value: str = "value", per_task: int = 64) -> DataFrame:
    """fn(series, end positions) for tasks of end positions: end points of one series are spread over tasks, each with the whole series as an array.

    Late end points have longer pasts; dealing them by remainder evens that out.
    """
    x = df if "pos" in df.columns else with_pos(df)
    arrays = x.groupBy(SERIES).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.col(value).cast("double").alias("v")))), lambda s: s["v"]).alias("y"))
    dealt = arrays.withColumn("parts", F.ceil(F.size("y") / F.lit(per_task)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.repartition(SERIES, "part")
    names = [c.strip().split()[0] for c in schema.split(",")]
    from tidemark.operators.series import _arrow

    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, y, parts, part in zip(*(batch.column(c).to_pylist() for c in (SERIES, "y", "parts", "part")), strict=True):
                a = np.array(y, dtype=float)
                rows = [(key, *r) for r in fn(a, np.arange(part, len(a), parts))]
                cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type, from_pandas=True) for c, f in zip(cols, arrow, strict=True)], names)

    return dealt.select(SERIES, "y", "parts", "part").mapInArrow(run, schema)


def _design(y: np.ndarray, lag: int, det: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the Dickey-Fuller regression for t = lag + 1 ..: level before, lagged changes, constant and trends; and the changes."""
    d = np.diff(y)
    t = np.arange(lag + 1, len(y))
    cols = [y[t - 1]] + [d[t - 1 - k] for k in range(1, lag + 1)]
    trend = (t - lag - 1).astype(float)
    cols += [np.ones(len(t)), trend, trend**2][:det]
    return np.column_stack(cols) if len(t) else np.zeros((0, 1 + lag + det)), d[t - 1]


def _tau(gram: np.ndarray, xy: np.ndarray, yy: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """t values of coefficient k for a stack of regressions given their moments; NaN where singular or without a degree of freedom."""
    p = gram.shape[-1]
    out = np.full(len(rows), np.nan)
    scale = np.sqrt(np.maximum(np.diagonal(gram, axis1=1, axis2=2), 0))
    ok = (rows > p) & (scale > 0).all(axis=1)
    if not ok.any():
        return out
    s = scale[ok]
    g = gram[ok] / (s[:, :, None] * s[:, None, :])  # unit diagonal
    fine = np.linalg.det(g) > 1e-14
    where = np.flatnonzero(ok)[fine]
    g, s = g[fine], s[fine]
    inverse = np.linalg.inv(g)
    b = np.einsum("nij,nj->ni", inverse, xy[where] / s)
    ssr = yy[where] - np.einsum("ni,ni->n", b, xy[where] / s)
    var = np.maximum(ssr, 0) / (rows[where] - p) * inverse[:, k, k]
    with np.errstate(divide="ignore", invalid="ignore"):
        out[where] = np.where(var > 0, b[:, k] / np.sqrt(np.where(var > 0, var, 1)), np.where(b[:, k] == 0, 0.0, np.sign(b[:, k]) * np.inf))
    return out


def _prepared(y: np.ndarray, det: int) -> np.ndarray:
    m = np.abs(y).max() if len(y) else 0.0
    y = y / m if m > 1e100 or 0 < m < 1e-100 else y
    return y - y.mean() if det >= 1 and len(y) else y


def window_taus(y: np.ndarray, ends: np.ndarray, min_length: int, lag: int, constant: str) -> Iterator[tuple[int, np.ndarray]]:
    """(end, statistics of all windows of at least min_length levels that end there, by start).

    Moments of a window are differences of prefix sums; those of its lagged
    regressors are the same rows, as a window starts lag + 1 rows late.
    """
    det = DETERMINISTIC[constant]
    y = _prepared(y, det)
    x, d = _design(y, lag, det)
    z = np.column_stack([x, d])
    q = z.shape[1]
    sums = np.zeros((len(z) + 1, q, q))
    np.cumsum(np.einsum("ni,nj->nij", z, z), axis=0, out=sums[1:])
    for e in ends.tolist():
        starts = np.arange(0, e - min_length + 2)
        if e < min_length - 1 or not len(starts):
            continue
        last = e - lag  # rows before this one end at or before e
        m = sums[last] - sums[starts]
        yield e, _tau(m[:, :-1, :-1], m[:, :-1, -1], m[:, -1, -1], (last - starts).astype(float), 0)


def _need(min_length: int, lag: int, constant: str) -> None:
    if constant not in DETERMINISTIC:
        raise ValueError(f"constant must be one of {sorted(DETERMINISTIC)}")
    if lag < 0 or min_length < 2 * lag + DETERMINISTIC[constant] + 3:
        raise ValueError("min_length is too small for the lags and constant")


def adf_tau(y: np.ndarray, lag: int, constant: str = "c") -> float:
    """The statistic of one array; NaN where there are too few values."""
    if constant not in DETERMINISTIC or lag < 0:
        raise ValueError("lag must be at least 0 and constant known")
    y = np.asarray(y, dtype=float)
    if len(y) < 2 * lag + DETERMINISTIC[constant] + 3:
        return float("nan")
    return float(next(window_taus(y, np.array([len(y) - 1]), len(y), lag, constant))[1][0])


def adf_stat(df: DataFrame, lag: int, constant: str = "c", value: str = "value") -> DataFrame:
    """`tau` of each series as a whole."""
    if constant not in DETERMINISTIC or lag < 0:
        raise ValueError("lag must be at least 0 and constant known")
    kind = df.schema[SERIES].dataType.simpleString()

    def run(data: dict) -> list[tuple]:
        tau = adf_tau(data[value], lag, constant)
        return [(None if np.isnan(tau) else tau,)]

    return per_series(df, run, f"{SERIES} {kind}, tau double", [value])


def sadf(df: DataFrame, min_length: int, lags: int = 1, constant: str = "c", value: str = "value") -> DataFrame:
    """(series_id, pos, sadf): the largest statistic over all starts; from position min_length - 1 on."""
    _need(min_length, lags, constant)
    kind = df.schema[SERIES].dataType.simpleString()

    def run(y: np.ndarray, ends: np.ndarray) -> list[tuple]:
        return [(e, float(np.nanmax(t))) for e, t in window_taus(y, ends, min_length, lags, constant) if not np.isnan(t).all()]

    return all_windows(df, run, f"{SERIES} {kind}, pos long, sadf double", value)


def qadf(df: DataFrame, min_length: int, lag: int, q: float = 0.95, constant: str = "c", v: float | None = None, value: str = "value") -> DataFrame:
    """(series_id, pos, qadf, dispersion): the q quantile of the statistics, and the difference of those at q + v and q - v."""
    _need(min_length, lag, constant)
    kind = df.schema[SERIES].dataType.simpleString()

    def run(y: np.ndarray, ends: np.ndarray) -> list[tuple]:
        out = []
        for e, t in window_taus(y, ends, min_length, lag, constant):
            t = t[~np.isnan(t)]
            if len(t):
                out.append((e, float(np.quantile(t, q)), float(np.quantile(t, q + v) - np.quantile(t, q - v)) if v is not None else None))
        return out

    return all_windows(df, run, f"{SERIES} {kind}, pos long, qadf double, dispersion double", value)


def cadf(df: DataFrame, min_length: int, lag: int, q: float = 0.95, constant: str = "c", value: str = "value") -> DataFrame:
    """(series_id, pos, cadf): the mean of the statistics at or above their q quantile."""
    _need(min_length, lag, constant)
    kind = df.schema[SERIES].dataType.simpleString()

    def run(y: np.ndarray, ends: np.ndarray) -> list[tuple]:
        out = []
        for e, t in window_taus(y, ends, min_length, lag, constant):
            t = t[~np.isnan(t)]
            if len(t):
                out.append((e, float(t[t >= np.quantile(t, q)].mean())))
        return out

    return all_windows(df, run, f"{SERIES} {kind}, pos long, cadf double", value)


def sadf_null_quantiles(spark: SparkSession, n_obs: int, min_length: int, lags: int = 1, constant: str = "c", quantiles: Sequence[float] = (0.9, 0.95, 0.99), n_sim: int = 1000, seed: int | None = None) -> DataFrame:
    """(pos, quantile, value): critical values by simulated random walks; pos NULL stands for the largest over all positions.

    A walk's draws are a slice of the one stream of default_rng(seed), so they do
    not depend on the number of tasks; a task skips ahead to its first walk.
    """
    _need(min_length, lags, constant)
    if constant == "nc":
        raise ValueError("without a constant the null depends on the starting level")
    seed = int(np.random.SeedSequence().entropy % 2**63) if seed is None else seed
    n_parts = max(1, min(n_sim, 2 * spark.sparkContext.defaultParallelism))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng, at = np.random.default_rng(seed), 0
        for batch in batches:
            rows = []
            for i in batch.column(0).to_pylist():
                for _ in range(i - at):
                    rng.standard_normal(n_obs)
                at = i + 1
                walk = np.cumsum(rng.standard_normal(n_obs))
                rows += [(i, e, float(np.nanmax(t))) for e, t in window_taus(walk, np.arange(n_obs), min_length, lags, constant)]
            a, b, c = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], ["sim", "pos", "sadf"])

    got = spark.range(0, n_sim, 1, n_parts).mapInArrow(run, "sim long, pos long, sadf double")
    top = got.groupBy("sim").agg(F.max("sadf").alias("sadf")).select(F.lit(None).cast("long").alias("pos"), "sadf")
    levels = [float(q) for q in quantiles]
    by_pos = got.select("pos", "sadf").unionByName(top).groupBy("pos").agg(F.percentile("sadf", F.array(*(F.lit(q) for q in levels))).alias("v"))
    return by_pos.select("pos", F.explode(F.arrays_zip(F.array(*(F.lit(q) for q in levels)).alias("quantile"), F.col("v").alias("value"))).alias("z")).select("pos", "z.quantile", "z.value")


SMT_KINDS = ("poly1", "poly2", "exp", "power")


def smt(df: DataFrame, min_length: int, kind: str = "poly1", phi: float = 0.0, value: str = "value") -> DataFrame:
    """(series_id, pos, smt): the largest |t| of the trend term over all starts, over (end - start) ** phi."""
    if kind not in SMT_KINDS or not 0 <= phi <= 1 or min_length < (4 if kind.startswith("poly") else 3):
        raise ValueError("kind, phi or min_length is out of range")
    key = df.schema[SERIES].dataType.simpleString()
    quad = kind.startswith("poly")

    def run(y: np.ndarray, ends: np.ndarray) -> list[tuple]:
        v = y if kind == "poly1" else np.log(y)
        v = v - v.mean()
        base = np.arange(1, len(y) + 1, dtype=float)
        base = np.log(base) if kind == "power" else base
        out = []
        for e in ends.tolist():
            if e < min_length - 1:
                continue
            best = None
            starts = np.arange(0, e - min_length + 2)
            # centred on the end of the longest window, so that prefix sums of powers stay small
            b = base[: e + 1] - base[: e + 1].mean()
            z = np.column_stack([np.ones(e + 1), b, b * b][: 3 if quad else 2] + [v[: e + 1]])
            # suffix sums: windows that end here differ in their starts only
            back = np.cumsum(np.einsum("ni,nj->nij", z, z)[::-1], axis=0)[::-1]
            m = back[starts]
            t = np.abs(_tau(m[:, :-1, :-1], m[:, :-1, -1], m[:, -1, -1], (e - starts + 1).astype(float), 2 if quad else 1)) / (e - starts).astype(float) ** phi
            if not np.isnan(t).all():
                best = float(np.nanmax(t))
            out.append((e, best))
        return out

    return all_windows(df, run, f"{SERIES} {key}, pos long, smt double", value)


def dfc_path(df: DataFrame, value: str = "value") -> DataFrame:
    """(series_id, brk, dfc): the Dickey-Fuller t value with the level counting from break position `brk` on, for all of them.

    Sums over t >= brk are running sums from the end, so one window does all breaks.
    """
    x = df if "pos" in df.columns else with_pos(df)
    w = Window.partitionBy(SERIES).orderBy("pos")
    x = x.withColumn("__x", F.lag(value).over(w)).withColumn("__d", F.col(value) - F.col("__x")).filter("__x IS NOT NULL")
    tail = w.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy(SERIES)
    x = x.select(SERIES, F.col("pos").alias("brk"), F.sum(F.col("__x") * F.col("__x")).over(tail).alias("sxx"), F.sum(F.col("__x") * F.col("__d")).over(tail).alias("sxy"), F.sum(F.col("__d") * F.col("__d")).over(every).alias("sdd"), F.count("*").over(every).alias("n1"))
    delta = F.col("sxy") / F.col("sxx")
    ssr = F.greatest(F.lit(0.0), F.col("sdd") - F.col("sxy") * F.col("sxy") / F.col("sxx"))
    var = ssr / (F.col("n1") - 1) / F.col("sxx")
    t = F.when(F.col("sxx") == 0, None).when(var > 0, delta / F.sqrt(var)).otherwise(F.when(delta == 0, F.lit(0.0)).otherwise(F.signum(delta) * float("inf")))
    return x.select(SERIES, "brk", (F.col("n1") + 1).alias("n"), t.alias("dfc"))


def chow_dfc(df: DataFrame, tau: float, value: str = "value") -> DataFrame:
    """(series_id, brk, dfc) for the break at fraction tau."""
    if not 0 < tau < 1:
        raise ValueError("tau must lie in (0, 1)")
    return dfc_path(df, value).filter(F.col("brk") == F.greatest(F.ceil(F.round(F.lit(tau) * F.col("n"), 9)), F.lit(1))).select(SERIES, "brk", "dfc")


def sdfc(df: DataFrame, tau0: float = 0.15, value: str = "value") -> DataFrame:
    """(series_id, sdfc, brk): the largest over breaks in [tau0, 1 - tau0], the first on a tie."""
    if not 0 < tau0 < 0.5:
        raise ValueError("tau0 must lie in (0, 0.5)")
    lo, hi = F.greatest(F.ceil(F.round(F.lit(tau0) * F.col("n"), 9)), F.lit(1)), F.least(F.ceil(F.round(F.lit(1 - tau0) * F.col("n"), 9)), F.col("n") - 1)
    p = dfc_path(df, value).filter((F.col("brk") >= lo) & (F.col("brk") <= hi) & F.col("dfc").isNotNull())
    return p.groupBy(SERIES).agg(F.max("dfc").alias("sdfc"), F.max_by("brk", F.struct("dfc", -F.col("brk"))).alias("brk"))

