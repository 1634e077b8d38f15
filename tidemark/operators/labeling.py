"""Labels for events: volatility targets, triple barrier, bins, trend scanning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.series import SERIES, asof, by_series, fold, micros, with_pos


def returns_vs_day_before(close: DataFrame, price: str = "price") -> DataFrame:
    """`ret`: against the last bar strictly before a day ago; NULL where there is none."""
    t = close.withColumn("__us", micros("ts"))
    w = Window.partitionBy(SERIES).orderBy("__us").rangeBetween(Window.unboundedPreceding, -86_400_000_001)
    return t.withColumn("ret", F.col(price) / F.last(price).over(w) - 1).drop("__us")


def get_daily_vol(close: DataFrame, span: int = 100, price: str = "price") -> DataFrame:
    """`daily_vol`: exponentially weighted, bias-corrected standard deviation of returns against a day before; NULL before two returns."""
    a = 1 - 2.0 / (span + 1.0)

    def begin():
        w = w2 = mean = cov = 0.0
        n = 0

        def run(data):
            nonlocal w, w2, mean, cov, n
            out = []
            if data is None:
                return out
            for ts, p, r in zip(data["ts"], data[price], data["ret"], strict=True):
                vol = None
                if r is not None:
                    # weights decay, then the new return joins with weight 1
                    w_old = w * a
                    w, w2, n = w_old + 1.0, w2 * a * a + 1.0, n + 1
                    d = r - mean
                    mean += d / w
                    cov = (w_old * (cov + (d / w) ** 2) + (r - mean) ** 2) / w
                    if n > 1:
                        vol = (cov * w * w / (w * w - w2)) ** 0.5
                out.append((ts, p, r, vol))
            return out

        return run

    kind = close.schema["ts"].dataType.simpleString()
    return fold(returns_vs_day_before(close, price), begin, f"{SERIES} {close.schema[SERIES].dataType.simpleString()}, ts {kind}, {price} double, ret double, daily_vol double", ["ts", price, "ret"], ["ts"])


def add_vertical_barrier(events: DataFrame, close: DataFrame, num_days: float = 0, event_ts: str = "t0") -> DataFrame:
    """`t1`: the first bar at or after the event's time plus num_days; NULL past the last bar."""
    e = events.withColumn("__at", (F.col(event_ts) + F.make_dt_interval(secs=F.lit(float(num_days) * 86400.0).cast("decimal(18,6)"))).cast(close.schema["ts"].dataType))
    return asof(e, close.select(SERIES, "ts", F.col("ts").alias("t1")), "__at", ["t1"], forward=True).drop("__at")


def get_events(close: DataFrame, events: DataFrame, pt: float, sl: float, min_ret: float = 0.0, price: str = "price", max_bars: int | None = None) -> DataFrame:
    """First barrier that each event's path touches.

    events: series_id, t0, trgt, and if wanted vertical (a time or NULL) and side
    (-1 or 1; without it both widths use `pt`).  Events without a target above
    min_ret are dropped.  The path is the bars after t0 up to the vertical
    barrier; a touch is strict; the stop wins a tie with the profit, and both win
    against a vertical barrier at the same time.  Result: series_id, t0, t1,
    trgt, side, barrier (pt, sl, vertical or none).

    A range join on positions within a series: events meet the bars of blocks of
    `_BLOCK` positions that their path covers, so it is an equi-join.
    """
    bars = with_pos(close.select(SERIES, "ts", F.col(price).alias("__p")), ["ts"])
    e = events.filter(F.col("trgt").isNotNull() & (F.col("trgt") > min_ret))
    has_side = "side" in events.columns
    e = e.withColumn("side", F.col("side").cast("double") if has_side else F.lit(1.0))
    if "vertical" not in events.columns:
        e = e.withColumn("vertical", F.lit(None).cast(close.schema["ts"].dataType))
    e = e.select(SERIES, "t0", "trgt", "side", "vertical")
    start = e.join(bars.select(SERIES, F.col("ts").alias("t0"), F.col("pos").alias("__s"), F.col("__p").alias("__p0")), [SERIES, "t0"])
    ends = asof(start.filter("vertical IS NOT NULL"), bars.select(SERIES, "ts", F.col("pos").alias("__e")), "vertical", ["__e"])
    last = bars.groupBy(SERIES).agg(F.max("pos").alias("__e"))
    start = ends.unionByName(start.filter("vertical IS NULL").join(last, SERIES).select(ends.columns))
    blocks = F.sequence(F.floor((F.col("__s") + 1) / _BLOCK), F.greatest(F.floor((F.col("__s") + 1) / _BLOCK), F.floor(F.col("__e") / _BLOCK)))
    wide = start.withColumn("__block", F.explode(blocks))
    path = wide.join(bars.withColumn("__block", F.floor(F.col("pos") / _BLOCK)).withColumnRenamed("ts", "__t"), [SERIES, "__block"]).filter("pos > __s AND pos <= __e")
    r = (F.col("__p") / F.col("__p0") - 1) * F.col("side")
    up = float(pt)
    down = float(sl) if has_side else float(pt)
    hit_up = (r > up * F.col("trgt")) if up > 0 else F.lit(False)
    hit_down = (r < -down * F.col("trgt")) if down > 0 else F.lit(False)
    touch = path.groupBy(SERIES, "t0").agg(F.min(F.when(hit_up, F.struct("pos", "__t"))).alias("__u"), F.min(F.when(hit_down, F.struct("pos", "__t"))).alias("__d"))
    out = start.join(touch, [SERIES, "t0"], "left")
    first_down = F.col("__d").isNotNull() & (F.col("__u").isNull() | (F.col("__d.pos") <= F.col("__u.pos")))
    barrier = F.when(first_down, "sl").when(F.col("__u").isNotNull(), "pt").when(F.col("vertical").isNotNull(), "vertical").otherwise("none")
    t1 = F.when(first_down, F.col("__d.__t")).when(F.col("__u").isNotNull(), F.col("__u.__t")).otherwise(F.col("vertical"))
    return out.select(SERIES, "t0", t1.alias("t1"), "trgt", (F.col("side") if has_side else F.lit(None).cast("double")).alias("side"), barrier.alias("barrier"))


#: Bars in a block of the event-to-path join.
_BLOCK = 256


def get_bins(events: DataFrame, close: DataFrame, meta: bool = False, price: str = "price") -> DataFrame:
    """`ret` and `bin` of each closed event: from the first bar at or after t0 to the last at or before t1.

    meta: the return is times the side, and bin is 1 if it is positive, else 0.  Events that end after the last bar are dropped.
    """
    bars = close.select(SERIES, "ts", F.col(price).alias("__p"))
    last = bars.groupBy(SERIES).agg(F.max("ts").alias("__last"))
    e = events.filter("t1 IS NOT NULL").join(last, SERIES).filter("t1 <= __last").drop("__last")
    e = asof(e, bars, "t0", ["__p"], forward=True).withColumnRenamed("__p", "__p0")
    e = asof(e, bars, "t1", ["__p"])
    ret = F.col("__p") / F.col("__p0") - 1
    ret = ret * F.col("side") if meta else ret
    e = e.withColumn("ret", ret)
    label = F.when(F.col("ret") > 0, 1).otherwise(0) if meta else F.signum("ret")
    return e.select(SERIES, "t0", "t1", "ret", label.cast("long").alias("bin"))


def meta_labels(events: DataFrame, close: DataFrame, side: DataFrame, price: str = "price") -> DataFrame:
    """get_bins with meta, with a primary model's side (series_id, t0, side of -1 or 1)."""
    bad = side.filter(~F.col("side").isin(-1, 1)).limit(1).count()
    if bad:
        raise ValueError("side must be -1 or 1")
    return get_bins(events.drop("side").join(side.select(SERIES, "t0", F.col("side").cast("double")), [SERIES, "t0"]), close, True, price)


def drop_labels(bins: DataFrame, min_pct: float = 0.05, label: str = "bin") -> DataFrame:
    """Without the rarest classes: one at a time goes while its share is below min_pct and three or more are left."""
    count = {r[0]: r[1] for r in bins.groupBy(label).count().collect()}  # a row per class
    gone = []
    while len(count) >= 3:
        total = sum(count.values())
        rare = min(count, key=lambda k: (count[k], str(k)))
        if count[rare] / total >= min_pct:
            break
        gone.append(rare)
        del count[rare]
    return bins.filter(~F.col(label).isin(gone)) if gone else bins


def _trend_t(window: int, y: str, w) -> Column:
    """t value of the slope of y over the next `window` rows, NULL where they don't fit."""
    frame = w.rowsBetween(0, window - 1)
    k = F.col("__k")
    sxx = window * (window * window - 1.0) / 12.0
    b = F.covar_pop(k, F.col(y)).over(frame) * window / sxx
    sse = F.var_pop(F.col(y)).over(frame) * window - b * b * sxx
    s2 = F.greatest(sse, F.lit(0.0)) / (window - 2)
    t = F.when(s2 <= 0, F.when(b == 0, F.lit(0.0)).otherwise(F.signum(b) * float("inf"))).otherwise(b / F.sqrt(s2 / sxx))
    return F.when(F.count(y).over(frame) == window, t)


def trend_scanning_labels(close: DataFrame, window_sizes: Sequence[int], t_threshold: float = 1.96, price: str = "price") -> DataFrame:
    """For each bar the forward window whose log-price slope has the largest |t| (the shortest on a tie), and the slope's sign if |t| > t_threshold."""
    sizes = sorted({int(x) for x in window_sizes})
    if not sizes or sizes[0] < 3:
        raise ValueError("window sizes must be integers of at least 3")
    w = by_series(close)
    c = close.withColumn("__k", F.row_number().over(w).cast("double")).withColumn("__y", F.log(price))
    for n in sizes:
        c = c.withColumn(f"__t{n}", _trend_t(n, "__y", w))
    best = F.array_max(F.array(*(F.when(F.col(f"__t{n}").isNotNull(), F.struct(F.abs(F.col(f"__t{n}")).alias("a"), F.lit(-n).alias("n"), F.col(f"__t{n}").alias("t"))) for n in sizes)))
    c = c.withColumn("__b", best)
    label = F.when(F.col("__b").isNull(), None).when(F.col("__b.a") > t_threshold, F.when(F.col("__b.t") > 0, 1).otherwise(-1)).otherwise(0)
    out = c.withColumn("t_value", F.col("__b.t")).withColumn("window", (-F.col("__b.n")).cast("long")).withColumn("bin", label.cast("long"))
    return out.drop("__k", "__y", "__b", *(f"__t{n}" for n in sizes))
