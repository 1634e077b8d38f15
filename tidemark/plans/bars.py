"""Queries over ticks: bars, events, microstructure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.normal import phi_sql
from tidemark.operators import bars as B
from tidemark.operators import microstructure as M
from tidemark.sources.tables import DAILY, TICKS, daily, ticks


def _r(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if c in columns else F.col(c) for c in df.columns))


BAR = ("series_id", "bar_id", "bar_ts", "open", "high", "low", "close", "volume", "dollar_value", "ticks")
BAR_SQL = "CAST(bar_id AS BIGINT) AS bar_id, max(ts) AS bar_ts, arg_min(price, ts) AS open, max(price) AS high, min(price) AS low, arg_max(price, ts) AS close, sum(volume) AS volume, round(sum(price * volume), 4) AS dollar_value, CAST(count(*) AS BIGINT) AS ticks"


def _bars(df: DataFrame) -> DataFrame:
    return _r(df.select(*BAR), "dollar_value", digits=4)


def time_bars(spark: SparkSession, d: str) -> DataFrame:
    return _r(B.time_bars(ticks(spark, d), "1 hour"), "dollar_value", digits=4)


TIME_BARS = f"""WITH {TICKS} SELECT series_id, date_trunc('hour', ts - INTERVAL 1 MICROSECOND) + INTERVAL 1 HOUR AS bar_ts, arg_min(price, ts) AS open, max(price) AS high, min(price) AS low,
arg_max(price, ts) AS close, sum(volume) AS volume, round(sum(price * volume), 4) AS dollar_value, CAST(count(*) AS BIGINT) AS ticks FROM ticks GROUP BY 1, 2"""


def tick_bars(spark: SparkSession, d: str) -> DataFrame:
    return _bars(B.tick_bars(ticks(spark, d), 50, bucket="day"))


TICK_BARS = f"""WITH {TICKS}, n AS (SELECT *, (row_number() OVER (PARTITION BY series_id ORDER BY ts, seq) - 1) // 50 AS bar_id FROM ticks)
SELECT series_id, {BAR_SQL} FROM n GROUP BY series_id, bar_id HAVING count(*) = 50"""


def fold_sql(value: str, threshold: str, source: str = TICKS) -> str:
    """Bars that close when the sum of `value` since the last close reaches a threshold."""
    return f"""WITH RECURSIVE {source}, n AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts, seq) AS k, {value} AS v FROM ticks),
f AS (SELECT series_id, k, v AS acc, 0 AS bar_id, v >= {threshold} AS done FROM n WHERE k = 1
UNION ALL SELECT n.series_id, n.k, CASE WHEN f.done THEN n.v ELSE f.acc + n.v END, CASE WHEN f.done THEN f.bar_id + 1 ELSE f.bar_id END,
CASE WHEN f.done THEN n.v ELSE f.acc + n.v END >= {threshold} FROM f JOIN n ON n.series_id = f.series_id AND n.k = f.k + 1)
SELECT n.series_id, {BAR_SQL} FROM n JOIN f ON n.series_id = f.series_id AND n.k = f.k GROUP BY n.series_id, bar_id HAVING bool_or(done)"""


def volume_bars(spark: SparkSession, d: str) -> DataFrame:
    return _bars(B.volume_bars(ticks(spark, d), 2000.0))


def dollar_bars(spark: SparkSession, d: str) -> DataFrame:
    return _bars(B.dollar_bars(ticks(spark, d), 100_000.0))


SIGNED = f"""{TICKS}, moves AS (SELECT *, sign(price - lag(price) OVER (PARTITION BY series_id ORDER BY ts, seq)) AS dp FROM ticks),
signs AS (SELECT *, CAST(coalesce(last_value(nullif(dp, 0) IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts, seq), 1) AS DOUBLE) AS sgn FROM moves)"""


def tick_rule(spark: SparkSession, d: str) -> DataFrame:
    return M.tick_rule(ticks(spark, d)).select("series_id", "seq", "sign")


TICK_RULE = f"WITH {SIGNED} SELECT series_id, seq, sgn AS sign FROM signs"


def imbalance_sql(mag: str, init: int = 100, bars: float = 20, ticks_: float = 1000) -> str:
    a, b = f"CAST({2 / (bars + 1)!r} AS DOUBLE)", f"CAST({2 / (ticks_ + 1)!r} AS DOUBLE)"
    return f"""WITH RECURSIVE {SIGNED}, n0 AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts, seq) AS k, sgn * {mag} AS s FROM signs),
n AS (SELECT *, avg(s) FILTER (WHERE k <= {init}) OVER (PARTITION BY series_id) AS s0 FROM n0),
f AS (SELECT series_id, k, s AS theta, 1 AS len, CAST({init} AS DOUBLE) AS et, {b} * s + (1 - {b}) * s0 AS mv, {init} * abs(s0) AS thr, abs(s) >= {init} * abs(s0) AS done, 0 AS bar_id FROM n WHERE k = 1
UNION ALL SELECT g.series_id, g.k, g.theta, g.len, g.et, g.mv, g.thr, abs(g.theta) >= g.thr, g.bar_id FROM (
SELECT n.series_id, n.k, CASE WHEN f.done THEN n.s ELSE f.theta + n.s END AS theta, CASE WHEN f.done THEN 1 ELSE f.len + 1 END AS len,
CASE WHEN f.done THEN {a} * f.len + (1 - {a}) * f.et ELSE f.et END AS et, {b} * n.s + (1 - {b}) * f.mv AS mv,
CASE WHEN f.done THEN ({a} * f.len + (1 - {a}) * f.et) * abs(f.mv) ELSE f.thr END AS thr, CASE WHEN f.done THEN f.bar_id + 1 ELSE f.bar_id END AS bar_id
FROM f JOIN n ON n.series_id = f.series_id AND n.k = f.k + 1) g)
SELECT n.series_id, {BAR_SQL} FROM n JOIN f ON n.series_id = f.series_id AND n.k = f.k GROUP BY n.series_id, bar_id HAVING bool_or(done)"""


def runs_sql(mag: str, init: int = 100, bars: float = 20, ticks_: float = 1000) -> str:
    a, b = f"CAST({2 / (bars + 1)!r} AS DOUBLE)", f"CAST({2 / (ticks_ + 1)!r} AS DOUBLE)"
    return f"""WITH RECURSIVE {SIGNED}, n0 AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts, seq) AS k, CASE WHEN sgn > 0 THEN CAST({mag} AS DOUBLE) ELSE 0 END AS bu, CASE WHEN sgn < 0 THEN CAST({mag} AS DOUBLE) ELSE 0 END AS se FROM signs),
n AS (SELECT *, avg(bu) FILTER (WHERE k <= {init}) OVER (PARTITION BY series_id) AS b0, avg(se) FILTER (WHERE k <= {init}) OVER (PARTITION BY series_id) AS s0 FROM n0),
f AS (SELECT series_id, k, bu AS rb, se AS rs, 1 AS len, CAST({init} AS DOUBLE) AS et, {b} * bu + (1 - {b}) * b0 AS mb, {b} * se + (1 - {b}) * s0 AS ms, {init} * greatest(b0, s0) AS thr, greatest(bu, se) >= {init} * greatest(b0, s0) AS done, 0 AS bar_id FROM n WHERE k = 1
UNION ALL SELECT g.series_id, g.k, g.rb, g.rs, g.len, g.et, g.mb, g.ms, g.thr, greatest(g.rb, g.rs) >= g.thr, g.bar_id FROM (
SELECT n.series_id, n.k, CASE WHEN f.done THEN n.bu ELSE f.rb + n.bu END AS rb, CASE WHEN f.done THEN n.se ELSE f.rs + n.se END AS rs, CASE WHEN f.done THEN 1 ELSE f.len + 1 END AS len,
CASE WHEN f.done THEN {a} * f.len + (1 - {a}) * f.et ELSE f.et END AS et, {b} * n.bu + (1 - {b}) * f.mb AS mb, {b} * n.se + (1 - {b}) * f.ms AS ms,
CASE WHEN f.done THEN ({a} * f.len + (1 - {a}) * f.et) * greatest(f.mb, f.ms) ELSE f.thr END AS thr, CASE WHEN f.done THEN f.bar_id + 1 ELSE f.bar_id END AS bar_id
FROM f JOIN n ON n.series_id = f.series_id AND n.k = f.k + 1) g)
SELECT n.series_id, {BAR_SQL} FROM n JOIN f ON n.series_id = f.series_id AND n.k = f.k GROUP BY n.series_id, bar_id HAVING bool_or(done)"""


def tick_imbalance_bars(spark: SparkSession, d: str) -> DataFrame:
    return _bars(B.imbalance_bars(ticks(spark, d), "tick"))


def volume_imbalance_bars(spark: SparkSession, d: str) -> DataFrame:
    return _bars(B.imbalance_bars(ticks(spark, d), "volume"))


def tick_run_bars(spark: SparkSession, d: str) -> DataFrame:
    return _bars(B.run_bars(ticks(spark, d), "tick"))


def volume_run_bars(spark: SparkSession, d: str) -> DataFrame:
    return _bars(B.run_bars(ticks(spark, d), "volume"))


def dollar_imbalance_bars(spark: SparkSession, d: str) -> DataFrame:
    return _bars(B.imbalance_bars(ticks(spark, d), "dollar"))


def dollar_run_bars(spark: SparkSession, d: str) -> DataFrame:
    return _bars(B.run_bars(ticks(spark, d), "dollar"))


def cusum_filter(spark: SparkSession, d: str) -> DataFrame:
    return B.cusum_filter(ticks(spark, d), 300.0).select("series_id", "ts", "seq", "side")


CUSUM = f"""WITH RECURSIVE {TICKS}, n AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts, seq) AS k, price - lag(price) OVER (PARTITION BY series_id ORDER BY ts, seq) AS dx FROM ticks),
f AS (SELECT series_id, k, CAST(0 AS DOUBLE) AS up, CAST(0 AS DOUBLE) AS down, 0 AS side FROM n WHERE k = 1
UNION ALL SELECT g.series_id, g.k, CASE WHEN g.d >= -300 AND g.u > 300 THEN 0 ELSE g.u END, CASE WHEN g.d < -300 THEN 0 ELSE g.d END, CASE WHEN g.d < -300 THEN -1 WHEN g.u > 300 THEN 1 ELSE 0 END FROM (
SELECT n.series_id, n.k, greatest(0, f.up + n.dx) AS u, least(0, f.down + n.dx) AS d FROM f JOIN n ON n.series_id = f.series_id AND n.k = f.k + 1) g)
SELECT n.series_id, n.ts, n.seq, f.side FROM n JOIN f ON n.series_id = f.series_id AND n.k = f.k WHERE f.side <> 0"""


def repeated_times(spark: SparkSession, d: str) -> DataFrame:
    return B.repeated_naive_times(ticks(spark, d).withColumn("ts", F.date_trunc("hour", "ts").cast("timestamp_ntz"))).select("series_id", "ts", F.col("runs").cast("long"))


REPEATED = f"""WITH {TICKS}, h AS (SELECT series_id, seq, date_trunc('hour', ts) AS ts FROM ticks), c AS (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY series_id ORDER BY seq) <> ts THEN 1 ELSE 0 END AS x FROM h),
r AS (SELECT *, sum(x) OVER (PARTITION BY series_id ORDER BY seq) AS run FROM c) SELECT series_id, ts, CAST(count(DISTINCT run) AS BIGINT) AS runs FROM r GROUP BY 1, 2 HAVING count(DISTINCT run) > 1"""


def roll_measure(spark: SparkSession, d: str) -> DataFrame:
    return _r(M.roll_measure(ticks(spark, d)), "roll")


ROLL = f"""WITH {TICKS}, a AS (SELECT series_id, ts, seq, price - lag(price) OVER (PARTITION BY series_id ORDER BY ts, seq) AS x FROM ticks), b AS (SELECT *, lag(x) OVER (PARTITION BY series_id ORDER BY ts, seq) AS y FROM a)
SELECT series_id, round(2 * sqrt(greatest(0, -covar_pop(x, y))), 6) AS roll FROM b WHERE y IS NOT NULL GROUP BY series_id"""


def high_low(spark: SparkSession, d: str) -> DataFrame:
    x = M.becker_parkinson_volatility(M.corwin_schultz_spread(daily(spark, d), 3), 3)
    return _r(x.select("series_id", "ts", "spread", "volatility"), "spread", "volatility")


HIGH_LOW = f"""WITH {DAILY}, a AS (SELECT series_id, ts, high, low, pow(ln(high / low), 2) AS h FROM daily),
b AS (SELECT *, h + lag(h) OVER w AS two, greatest(high, lag(high) OVER w) AS hi, least(low, lag(low) OVER w) AS lo, lag(high) OVER w AS ph FROM a WINDOW w AS (PARTITION BY series_id ORDER BY ts)),
c AS (SELECT series_id, ts, CASE WHEN count(two) OVER w = 3 THEN avg(two) OVER w END AS beta, CASE WHEN ph IS NOT NULL THEN pow(ln(hi / lo), 2) END AS gamma FROM b WINDOW w AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
e AS (SELECT *, greatest(0, (sqrt(2) - 1) * sqrt(beta) / (3 - 2 * sqrt(2)) - sqrt(gamma / (3 - 2 * sqrt(2)))) AS al FROM c)
SELECT series_id, ts, CASE WHEN beta IS NOT NULL AND gamma IS NOT NULL THEN round(2 * (exp(al) - 1) / (1 + exp(al)), 6) END AS spread,
CASE WHEN beta IS NOT NULL AND gamma IS NOT NULL THEN round(greatest(0, (pow(2, -0.5) - 1) * sqrt(beta) / (sqrt(8 / pi()) * (3 - 2 * sqrt(2))) + sqrt(gamma / (8 / pi() * (3 - 2 * sqrt(2))))), 6) END AS volatility FROM e"""


def origin_sql(source: str, x: str, y: str, name: str, rel: str) -> str:
    return f"""WITH {source}, p AS (SELECT series_id, {x} AS x, {y} AS y FROM {rel}), q AS (SELECT * FROM p WHERE x IS NOT NULL AND y IS NOT NULL),
s AS (SELECT series_id, count(*) AS n, sum(x * x) AS sxx, sum(x * y) / sum(x * x) AS b FROM q GROUP BY 1), r AS (SELECT q.series_id, sum(pow(y - b * x, 2)) AS ssr FROM q JOIN s USING (series_id) GROUP BY 1)
SELECT series_id, round(b, 8) AS {name}, round(b / sqrt(ssr / (n - 1) / sxx), 6) AS t_value, CAST(n AS BIGINT) AS n FROM s JOIN r USING (series_id)"""


def kyle_lambda(spark: SparkSession, d: str) -> DataFrame:
    t = M.tick_rule(ticks(spark, d)).withColumn("signed_volume", F.col("sign") * F.col("volume"))
    return _r(_r(M.kyle_lambda(t), "kyle_lambda", digits=8), "t_value")


KYLE = origin_sql(SIGNED, "sgn * volume", "price - lag(price) OVER (PARTITION BY series_id ORDER BY ts, seq)", "kyle_lambda", "signs")


def amihud(spark: SparkSession, d: str) -> DataFrame:
    b = B.tick_bars(ticks(spark, d), 20)
    from pyspark.sql import Window

    b = b.withColumn("ret", M.log_change("close", Window.partitionBy("series_id").orderBy("bar_id")))
    one, two = M.amihud_illiquidity(b), M.amihud_illiquidity(b, method="ratio").withColumnRenamed("amihud", "ratio")
    return _r(one.join(two, "series_id"), "amihud", "ratio", digits=10)


AMIHUD = f"""WITH {TICKS}, n AS (SELECT *, (row_number() OVER (PARTITION BY series_id ORDER BY ts, seq) - 1) // 20 AS bar_id FROM ticks), b AS (SELECT series_id, {BAR_SQL.replace("round(sum(price * volume), 4)", "sum(price * volume)")} FROM n GROUP BY series_id, bar_id HAVING count(*) = 20),
r AS (SELECT series_id, ln(close) - lag(ln(close)) OVER (PARTITION BY series_id ORDER BY bar_id) AS r, dollar_value AS v FROM b)
SELECT series_id, round(sum(abs(r) * v) / sum(v * v), 10) AS amihud, round(avg(abs(r) / v), 10) AS ratio FROM r WHERE r IS NOT NULL GROUP BY 1"""


def hasbrouck(spark: SparkSession, d: str) -> DataFrame:
    t = M.tick_rule(ticks(spark, d))
    from tidemark.operators.series import with_pos

    t = with_pos(t).withColumn("bar_id", F.floor(F.col("pos") / 20).cast("long"))
    flow = M.signed_root_dollar_volume(t)
    close = B.tick_bars(ticks(spark, d), 20).select("series_id", "bar_id", "close")
    return _r(_r(M.hasbrouck_lambda(close.join(flow, ["series_id", "bar_id"])), "hasbrouck_lambda", digits=8), "t_value")


HASBROUCK = origin_sql(f"""{SIGNED}, n AS (SELECT *, (row_number() OVER (PARTITION BY series_id ORDER BY ts, seq) - 1) // 20 AS bar_id FROM signs),
b AS (SELECT series_id, bar_id, arg_max(price, ts) AS close, sum(sgn * sqrt(price) * sqrt(volume)) AS f FROM n GROUP BY 1, 2 HAVING count(*) = 20)""", "f", "ln(close) - lag(ln(close)) OVER (PARTITION BY series_id ORDER BY bar_id)", "hasbrouck_lambda", "b")


def bulk_volume(spark: SparkSession, d: str) -> DataFrame:
    return _r(M.bulk_volume_classification(ticks(spark, d)).select("series_id", "seq", "buy_share"), "buy_share")


BVC = f"""{TICKS}, a AS (SELECT *, price - lag(price) OVER (PARTITION BY series_id ORDER BY ts, seq) AS dp FROM ticks),
b AS (SELECT *, CASE WHEN count(dp) OVER w >= 2 THEN stddev_samp(dp) OVER w END AS sd FROM a WINDOW w AS (PARTITION BY series_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, CASE WHEN sd > 0 THEN dp / sd END AS z FROM b), shares AS (SELECT series_id, ts, seq, price, volume, coalesce({phi_sql("z")}, CASE WHEN sd = 0 THEN CASE WHEN dp > 0 THEN 1 WHEN dp < 0 THEN 0 END END, 0.5) AS share FROM c)"""
BULK = f"WITH {BVC} SELECT series_id, seq, round(share, 6) AS buy_share FROM shares"


def vpin(spark: SparkSession, d: str) -> DataFrame:
    return _r(M.vpin(ticks(spark, d), 1000.0, 10), "buy", "sell", "vpin", digits=5)


VPIN = f"""WITH {BVC}, i AS (SELECT *, sum(volume) OVER (PARTITION BY series_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS hi FROM shares WHERE volume > 0),
j AS (SELECT *, hi - volume AS lo, floor(max(hi) OVER (PARTITION BY series_id) / 1000 + 1e-12) AS nb FROM i),
e AS (SELECT *, unnest(range(CAST(floor(lo / 1000) AS BIGINT), CAST(greatest(floor(lo / 1000), ceil(hi / 1000) - 1) AS BIGINT) + 1)) AS bucket FROM j),
g AS (SELECT series_id, bucket, sum((least(hi, (bucket + 1) * 1000) - greatest(lo, bucket * 1000)) * share) AS buy, sum((least(hi, (bucket + 1) * 1000) - greatest(lo, bucket * 1000)) * (1 - share)) AS sell FROM e WHERE bucket < nb GROUP BY 1, 2)
SELECT series_id, bucket, round(buy, 5) AS buy, round(sell, 5) AS sell, CASE WHEN count(*) OVER w = 10 THEN round(sum(abs(buy - sell)) OVER w / 10000, 5) END AS vpin FROM g WINDOW w AS (PARTITION BY series_id ORDER BY bucket ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"""

QUERIES = {
    "time_bars": time_bars, "tick_bars": tick_bars, "volume_bars": volume_bars, "dollar_bars": dollar_bars, "tick_imbalance_bars": tick_imbalance_bars, "volume_imbalance_bars": volume_imbalance_bars,
    "tick_run_bars": tick_run_bars, "volume_run_bars": volume_run_bars, "dollar_imbalance_bars": dollar_imbalance_bars, "dollar_run_bars": dollar_run_bars, "cusum_filter": cusum_filter, "repeated_naive_times": repeated_times, "tick_rule": tick_rule, "roll_measure": roll_measure,
    "corwin_schultz_becker_parkinson": high_low, "kyle_lambda": kyle_lambda, "amihud_illiquidity": amihud, "hasbrouck_lambda": hasbrouck, "bulk_volume_classification": bulk_volume, "vpin": vpin,
}
SQL = {
    "time_bars": TIME_BARS, "tick_bars": TICK_BARS, "volume_bars": fold_sql("volume", "2000"), "dollar_bars": fold_sql("price * volume", "100000"), "tick_imbalance_bars": imbalance_sql("1"), "volume_imbalance_bars": imbalance_sql("volume"),
    "tick_run_bars": runs_sql("1"), "volume_run_bars": runs_sql("volume"), "dollar_imbalance_bars": imbalance_sql("(price * volume)"), "dollar_run_bars": runs_sql("(price * volume)"), "cusum_filter": CUSUM, "repeated_naive_times": REPEATED, "tick_rule": TICK_RULE, "roll_measure": ROLL,
    "corwin_schultz_becker_parkinson": HIGH_LOW, "kyle_lambda": KYLE, "amihud_illiquidity": AMIHUD, "hasbrouck_lambda": HASBROUCK, "bulk_volume_classification": BULK, "vpin": VPIN,
}
