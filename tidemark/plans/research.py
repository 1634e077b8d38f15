"""Queries over returns, positions, messages and matrices: statistics, risk, sizing, portfolios, breaks, entropy, models."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.normal import phi_sql
from tidemark.operators import bet_sizing as Z
from tidemark.operators import breaks as K
from tidemark.operators import cv as C
from tidemark.operators import entropy as E
from tidemark.operators import fracdiff as D
from tidemark.operators import models as U
from tidemark.operators import montecarlo as G
from tidemark.operators import parallel as P
from tidemark.operators import portfolio as H
from tidemark.operators import risk as R
from tidemark.operators import stats as S
from tidemark.operators.series import with_pos
from tidemark.plans.bars import _r
from tidemark.sources.tables import DAILY, DAYS, LABELS, MESSAGES, PERFORMANCE, PERFORMANCE_ALL, POSITIONS, RETURNS, daily, days, labels, messages, performance, positions, returns, table


def sharpe(spark: SparkSession, d: str) -> DataFrame:
    return _r(S.sharpe_ratio(returns(spark, d)), "sharpe")


SHARPE = f"WITH {RETURNS} SELECT series_id, round(avg(ret) / stddev_samp(ret) * sqrt(252), 6) AS sharpe FROM returns GROUP BY 1"


def psr(spark: SparkSession, d: str) -> DataFrame:
    return _r(S.probabilistic_sharpe_ratio(returns(spark, d), 0.01), "sr", "skew", "kurt", "psr")


MOMENTS = "m AS (SELECT series_id, avg(ret) AS a, stddev_samp(ret) AS sd, stddev_pop(ret) AS sp, count(*) AS n FROM returns GROUP BY 1), h AS (SELECT m.series_id, any_value(a) / any_value(sd) AS sr, any_value(n) AS n, avg(pow(ret - a, 3)) / any_value(pow(sp, 3)) AS skew, avg(pow(ret - a, 4)) / any_value(pow(sp, 4)) AS kurt FROM returns r JOIN m USING (series_id) GROUP BY 1)"
PSR = f"WITH {RETURNS}, {MOMENTS}, z AS (SELECT *, (sr - 0.01) * sqrt(n - 1) / sqrt(1 - skew * sr + (kurt - 1) / 4 * sr * sr) AS z FROM h) SELECT series_id, round(sr, 6) AS sr, CAST(n AS BIGINT) AS n, round(skew, 6) AS skew, round(kurt, 6) AS kurt, round({phi_sql('z')}, 6) AS psr FROM z"


def bet_timing(spark: SparkSession, d: str) -> DataFrame:
    return S.bet_timing(positions(spark, d)).select("series_id", "ts")


BET_TIMING = f"""WITH {POSITIONS}, p AS (SELECT *, lag(position) OVER (PARTITION BY series_id ORDER BY ts) AS b, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS k FROM positions)
SELECT series_id, ts FROM p WHERE (position = 0 AND (b IS NULL OR b <> 0)) OR sign(position) * sign(b) < 0 OR k = 1"""


def holding_period(spark: SparkSession, d: str) -> DataFrame:
    return _r(S.holding_period(positions(spark, d)), "holding_days")


HOLDING = f"""WITH RECURSIVE {POSITIONS}, p AS (SELECT *, epoch_us(ts) / 86400000000 - epoch_us(min(ts) OVER (PARTITION BY series_id)) / 86400000000 AS t, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS k FROM positions),
f AS (SELECT series_id, k, position AS last, CAST(0 AS DOUBLE) AS en, CAST(0 AS DOUBLE) AS w, CAST(0 AS DOUBLE) AS c FROM p WHERE k = 1
UNION ALL SELECT p.series_id, p.k, p.position,
CASE WHEN last = 0 OR p.position - last = 0 OR (p.position - last > 0) = (last > 0) THEN CASE WHEN p.position <> 0 THEN (en * last + t * (p.position - last)) / p.position ELSE en END WHEN p.position <> 0 AND (p.position > 0) <> (last > 0) THEN t ELSE en END,
CASE WHEN last = 0 OR p.position - last = 0 OR (p.position - last > 0) = (last > 0) THEN w WHEN p.position <> 0 AND (p.position > 0) <> (last > 0) THEN w + (t - en) * abs(last) ELSE w + (t - en) * abs(p.position - last) END,
CASE WHEN last = 0 OR p.position - last = 0 OR (p.position - last > 0) = (last > 0) THEN c WHEN p.position <> 0 AND (p.position > 0) <> (last > 0) THEN c + abs(last) ELSE c + abs(p.position - last) END
FROM f JOIN p ON p.series_id = f.series_id AND p.k = f.k + 1)
SELECT series_id, round(arg_max(CASE WHEN c > 0 THEN w / c END, k), 6) AS holding_days FROM f GROUP BY 1"""


def concentration(spark: SparkSession, d: str) -> DataFrame:
    r = returns(spark, d)
    return _r(S.return_concentration(r).join(S.hhi_concentration(r), "series_id"), "positive", "negative", "time", "hhi", digits=8)


def _hhi(x: str) -> str:
    return f"CASE WHEN count({x}) > 2 AND sum({x}) <> 0 THEN round((sum({x} * {x}) / pow(sum({x}), 2) - 1.0 / count({x})) / (1 - 1.0 / count({x})), 8) END"


CONCENTRATION = f"""WITH {RETURNS}, s AS (SELECT series_id, CASE WHEN ret >= 0 THEN ret END AS up, CASE WHEN ret < 0 THEN ret END AS down, ret, ts FROM returns), a AS (SELECT series_id, {_hhi("up")} AS positive, {_hhi("down")} AS negative, {_hhi("ret")} AS hhi FROM s GROUP BY 1),
b AS (SELECT series_id, unnest(generate_series(date_trunc('month', min(ts)), date_trunc('month', max(ts)), INTERVAL 1 MONTH)) AS m FROM returns GROUP BY 1), c AS (SELECT b.series_id, b.m, CAST(count(r.ts) AS DOUBLE) AS n FROM b LEFT JOIN returns r ON r.series_id = b.series_id AND date_trunc('month', r.ts) = b.m GROUP BY 1, 2),
e AS (SELECT series_id, {_hhi("n")} AS time FROM c GROUP BY 1) SELECT a.series_id, positive, negative, time, hhi FROM a JOIN e USING (series_id)"""


def drawdown(spark: SparkSession, d: str) -> DataFrame:
    return _r(S.drawdown_time_under_water(daily(spark, d).withColumnRenamed("price", "pnl")), "dd", "tuw")


DRAWDOWN = f"""WITH {DAILY}, h AS (SELECT *, max(price) OVER (PARTITION BY series_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS h FROM daily), r AS (SELECT series_id, h, min(ts) AS hwm_ts, min(price) AS m FROM h GROUP BY 1, 2 HAVING min(price) < h)
SELECT series_id, hwm_ts, round(1 - m / h, 6) AS dd, round((epoch_us(lead(hwm_ts) OVER (PARTITION BY series_id ORDER BY hwm_ts)) - epoch_us(hwm_ts)) / (365.25 * 86400000000), 6) AS tuw FROM r"""


def cscv(spark: SparkSession, d: str) -> DataFrame:
    return _r(S.cscv(performance(spark, d), 8).select("split_id", "best_trial", "rank", "n_trials", "logit"), "logit")


CSCV = PERFORMANCE + """, bl AS (SELECT trial_id, t // (n // 8) AS b, ret FROM performance, shared), sp AS (SELECT CAST(row_number() OVER (ORDER BY a, b, c, d) - 1 AS INTEGER) AS split_id, [a, b, c, d] AS l FROM (SELECT unnest(range(8)) AS a), (SELECT unnest(range(8)) AS b), (SELECT unnest(range(8)) AS c), (SELECT unnest(range(8)) AS d) WHERE a < b AND b < c AND c < d),
sc AS (SELECT split_id, trial_id, avg(ret) FILTER (WHERE list_contains(l, b)) / stddev_samp(ret) FILTER (WHERE list_contains(l, b)) AS i, avg(ret) FILTER (WHERE NOT list_contains(l, b)) / stddev_samp(ret) FILTER (WHERE NOT list_contains(l, b)) AS o FROM sp, bl GROUP BY 1, 2),
w AS (SELECT split_id, arg_max(trial_id, i) AS best_trial, arg_max(o, i) AS bo FROM sc GROUP BY 1), rk AS (SELECT w.split_id, any_value(best_trial) AS best_trial, count(*) FILTER (WHERE o <= bo) AS rank, count(*) AS n_trials FROM w JOIN sc USING (split_id) GROUP BY 1),
cs AS (SELECT *, ln((rank / (n_trials + 1.0)) / (1 - rank / (n_trials + 1.0))) AS logit FROM rk)"""


def pbo(spark: SparkSession, d: str) -> DataFrame:
    return _r(S.probability_of_backtest_overfitting(performance(spark, d), 8), "pbo", "mean_logit")


def deflated(spark: SparkSession, d: str) -> DataFrame:
    return _r(S.registry_deflated_sharpe(performance(spark, d, 1)).select("trial_id", "sr", "n", "skew", "kurt", "var_sr", "n_trials", "sr_star", "dsr"), "sr", "skew", "kurt", "var_sr", "sr_star", "dsr", digits=7)


_q = [S.phi_inverse(1 - 1 / 5), S.phi_inverse(1 - 1 / (5 * math.e))]
DEFLATED = f"""WITH {PERFORMANCE_ALL}, m AS (SELECT trial_id, avg(ret) AS a, stddev_samp(ret) AS sd, stddev_pop(ret) AS sp, count(*) AS n FROM performance GROUP BY 1), h AS (SELECT trial_id, any_value(a) / any_value(sd) AS sr, any_value(n) AS n, avg(pow(ret - a, 3)) / any_value(pow(sp, 3)) AS skew, avg(pow(ret - a, 4)) / any_value(pow(sp, 4)) AS kurt FROM performance JOIN m USING (trial_id) GROUP BY 1),
v AS (SELECT var_samp(sr) AS var_sr, count(*) AS n_trials FROM h), b AS (SELECT h.*, var_sr, n_trials, sqrt(var_sr) * ((1 - {S.EULER_GAMMA!r}) * CAST({_q[0]!r} AS DOUBLE) + {S.EULER_GAMMA!r} * CAST({_q[1]!r} AS DOUBLE)) AS sr_star FROM h, v ORDER BY sr DESC, trial_id LIMIT 1),
z AS (SELECT *, (sr - sr_star) * sqrt(n - 1) / sqrt(1 - skew * sr + (kurt - 1) / 4 * sr * sr) AS z FROM b)
SELECT trial_id, round(sr, 7) AS sr, CAST(n AS BIGINT) AS n, round(skew, 7) AS skew, round(kurt, 7) AS kurt, round(var_sr, 7) AS var_sr, CAST(n_trials AS BIGINT) AS n_trials, round(sr_star, 7) AS sr_star, round({phi_sql('z')}, 7) AS dsr FROM z"""


def performance_matrix(spark: SparkSession, d: str) -> DataFrame:
    p = performance(spark, d, 1)
    trials = p.groupBy("trial_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "ret"))), lambda s: s["ret"]).alias("returns"))
    return _r(S.performance_matrix(trials), "ret", digits=9)


def binomial(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", (F.col("value") / 500 * 0.8 + 0.1).alias("p"))
    out = e.select("event_id", R.binomial_sharpe(F.col("p"), 52, 2.0, -1.0).alias("sharpe"), R.implied_precision(-1.0, 2.0, 52, F.col("p") * 3).alias("precision"), R.implied_frequency(-1.0, 2.0, F.col("p"), 2.0).alias("frequency"), R.ou_half_life(F.col("p")).alias("half_life"), R.ou_phi(F.col("p") * 10).alias("phi"))
    return _r(out, "sharpe", "precision", "frequency", "half_life", "phi")


BINOMIAL = """WITH e AS (SELECT event_id, value / 500 * 0.8 + 0.1 AS p FROM events)
SELECT event_id, round((3 * p - 1) / (3 * sqrt(p * (1 - p))) * sqrt(52), 6) AS sharpe, round((-((-104 - 27 * p * p) * 3) + sqrt(greatest(0, pow((-104 - 27 * p * p) * 3, 2) - 4 * (52 + 9 * p * p) * 9 * 52))) / (2 * (52 + 9 * p * p) * 9), 6) AS precision,
CASE WHEN 3 * p - 1 > 0 THEN round(36 * p * (1 - p) / pow(3 * p - 1, 2), 6) END AS frequency, round(-ln(2) / ln(p), 6) AS half_life, round(pow(2, -1 / (p * 10)), 6) AS phi FROM e"""


def failure(spark: SparkSession, d: str) -> DataFrame:
    return _r(R.probability_of_failure(returns(spark, d), 260, 2.0), "p", "threshold", "p_failure")


FAILURE = f"""WITH {RETURNS}, g AS (SELECT series_id, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS p, avg(ret) FILTER (WHERE ret > 0) AS pt, avg(ret) FILTER (WHERE ret <= 0) AS sl FROM returns GROUP BY 1),
a AS (SELECT *, (260 + 4) * pow(pt - sl, 2) AS a, (520 * sl - 4 * (pt - sl)) * (pt - sl) AS b, 260 * sl * sl AS c FROM g), t AS (SELECT *, (-b + sqrt(greatest(0, b * b - 4 * a * c))) / (2 * a) AS th FROM a), z AS (SELECT *, (th - p) / (p * (1 - p)) AS z FROM t)
SELECT series_id, round(p, 6) AS p, round(th, 6) AS threshold, round({phi_sql('z')}, 6) AS p_failure FROM z"""


def fit_ou(spark: SparkSession, d: str) -> DataFrame:
    return _r(R.fit_ou(daily(spark, d), 150_000.0).select("series_id", "phi", "sigma", "half_life", "n_obs"), "phi", "sigma", "half_life")


FIT_OU = f"""WITH {DAILY}, p AS (SELECT series_id, lag(price) OVER (PARTITION BY series_id ORDER BY ts) - 150000 AS x, price - 150000 AS y FROM daily), q AS (SELECT * FROM p WHERE x IS NOT NULL), s AS (SELECT series_id, sum(x * y) / sum(x * x) AS phi, count(*) AS n FROM q GROUP BY 1),
r AS (SELECT q.series_id, stddev_samp(y - phi * x) AS sigma FROM q JOIN s USING (series_id) GROUP BY 1) SELECT series_id, round(phi, 6) AS phi, round(sigma, 6) AS sigma, CASE WHEN phi >= 1 THEN 'Infinity'::DOUBLE WHEN phi > 0 THEN round(-ln(2) / ln(phi), 6) END AS half_life, CAST(n AS BIGINT) AS n_obs FROM s JOIN r USING (series_id)"""


def otr(spark: SparkSession, d: str) -> DataFrame:
    return R.otr_grid(spark, 0.0, 5.0, 1.0, [1.0, 5.0], [1.0, 5.0], 5000, 100, 1)


def sizing(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "value", (F.col("value") / 500).alias("prob"), F.when(F.col("event_id") % 2 == 0, 1.0).otherwise(-1.0).alias("side"))
    e = Z.prob_bet_size(e, "prob", "side", 3)
    x = F.col("value") - 250
    out = e.select("event_id", "bet", Z.sigmoid_bet_size(1e4, x).alias("sigmoid"), Z.target_position(1e4, F.col("value"), F.lit(250.0), 100).alias("target"), Z.discretize_signal(F.col("bet"), 0.1).alias("discrete"), Z.limit_price((F.col("event_id") % 19 - 9).cast("int"), (F.col("event_id") % 7 - 3).cast("int"), F.lit(115.0), 10.8, 10).alias("limit_price"))
    return _r(out, "bet", "sigmoid", "discrete", "limit_price")


SIZING = f"""WITH e AS (SELECT event_id, value, value / 500 AS p, CAST(CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS DOUBLE) AS side FROM events), z AS (SELECT *, (p - CAST(1 AS DOUBLE) / 3) / sqrt(p * (1 - p)) AS z FROM e), b AS (SELECT *, (2 * {phi_sql('z')} - 1) * side AS bet, (value - 250) / sqrt(10000 + pow(value - 250, 2)) AS s, CAST(event_id % 19 - 9 AS INTEGER) AS t, CAST(event_id % 7 - 3 AS INTEGER) AS c FROM z),
f AS (SELECT event_id, avg(115 - (k / 10.0) * sqrt(10.8 / (1 - (k / 10.0) * (k / 10.0)))) AS lp FROM (SELECT event_id, unnest(CASE WHEN t > c THEN range(c + 1, t + 1) ELSE range(t, c) END) AS k FROM b WHERE t <> c) GROUP BY 1)
SELECT b.event_id, round(bet, 6) AS bet, round(s, 6) AS sigmoid, CAST(trunc(s * 100) AS INTEGER) AS target, round(greatest(-1, least(1, round_even(bet / 0.1, 0) * 0.1)), 6) AS discrete, round(lp, 6) AS limit_price FROM b LEFT JOIN f USING (event_id)"""


def active_signals(spark: SparkSession, d: str) -> DataFrame:
    s = labels(spark, d).select("series_id", "t0", "t1", (F.col("trgt") * F.col("side")).alias("signal"))
    return _r(Z.average_active_signals(s, days(spark, d)), "signal")


ACTIVE = f"WITH {LABELS} SELECT d.series_id, d.ts, round(coalesce(avg(l.trgt * l.side), 0), 6) AS signal FROM days d LEFT JOIN labels l ON d.ts BETWEEN l.t0 AND l.t1 GROUP BY 1, 2"

def _wide(spark: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    """embeddings as columns x0 ..., and their names."""
    e = table(spark, d, "embeddings")
    n = e.agg(F.max(F.size("embedding"))).first()[0] or 0
    return e.select("vec_id", "label", *(F.col("embedding")[k].cast("double").alias(f"x{k}") for k in range(n))), [f"x{k}" for k in range(n)]


def _moments(spark: SparkSession, d: str, kind: str = "cov") -> DataFrame:
    return H.pair_moments(*_wide(spark, d), kind)


def correlations(spark: SparkSession, d: str) -> DataFrame:
    c = _moments(spark, d, "corr")
    return _r(H.correlation_distance(c), "v")


CORR = "WITH dims AS (SELECT unnest(range((SELECT max(len(embedding)) FROM embeddings))) AS k), cells AS (SELECT 0 AS matrix_id, CAST(a.k AS INTEGER) AS i, CAST(b.k AS INTEGER) AS j, corr(CAST(embedding[a.k + 1] AS DOUBLE), CAST(embedding[b.k + 1] AS DOUBLE)) AS v FROM embeddings, dims a, dims b GROUP BY 1, 2, 3), dist AS (SELECT matrix_id, i, j, CASE WHEN i = j THEN 0 ELSE sqrt(greatest(0, 0.5 * (1 - v))) END AS v FROM cells)"
CORRELATIONS = f"{CORR} SELECT matrix_id, i, j, round(v, 6) AS v FROM dist"


def distances(spark: SparkSession, d: str) -> DataFrame:
    c = _moments(spark, d, "corr")
    return _r(H.distance_of_distances(H.correlation_distance(c)), "v", digits=5)


DISTANCES = f"{CORR} SELECT 0 AS matrix_id, a.j AS i, b.j AS j, round(sqrt(sum(pow(a.v - b.v, 2))), 5) AS v FROM dist a JOIN dist b USING (i) GROUP BY a.j, b.j"


def hrp(spark: SparkSession, d: str) -> DataFrame:
    return _r(H.hrp_weights(_moments(spark, d)), "weight")


def onc(spark: SparkSession, d: str) -> DataFrame:
    return H.onc(_moments(spark, d, "corr"), 4)


def silhouette(spark: SparkSession, d: str) -> DataFrame:
    c = H.correlation_distance(_moments(spark, d, "corr"))
    lab = c.select("matrix_id", "i").distinct().withColumn("label", F.col("i") % 2)
    return _r(H.silhouette_scores(c, lab), "silhouette")


SILHOUETTE = f"{CORR}, p AS (SELECT i, j % 2 AS g, avg(v) AS m FROM dist WHERE i <> j GROUP BY 1, 2), s AS (SELECT i, max(m) FILTER (WHERE g = i % 2) AS a, min(m) FILTER (WHERE g <> i % 2) AS b FROM p GROUP BY 1) SELECT 0 AS matrix_id, i, round((b - a) / greatest(a, b), 6) AS silhouette FROM s"


def _levels(spark: SparkSession, d: str) -> DataFrame:
    return with_pos(days(spark, d)).select("series_id", "pos", F.log("price").alias("value"))


LEVELS = DAYS + ", lev AS (SELECT CAST(row_number() OVER (ORDER BY ts) - 1 AS BIGINT) AS pos, ln(price) AS y FROM days)"


def cusum(spark: SparkSession, d: str) -> DataFrame:
    return _r(K.cusum_test(_levels(spark, d)).select("series_id", "pos", "residual", "statistic", "z"), "residual", "statistic", "z")


CUSUM = f"""WITH {LEVELS}, a AS (SELECT pos, CASE WHEN pos > 0 THEN (y - avg(y) OVER w) / sqrt(1 + 1.0 / pos) END AS r FROM lev WINDOW w AS (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), s AS (SELECT *, sum(r) OVER (ORDER BY pos) / (SELECT sqrt(avg(r * r)) FROM a) AS s FROM a)
SELECT 'all' AS series_id, pos, round(r, 6) AS residual, round(s, 6) AS statistic, round(s / sqrt(nullif(pos, 0)), 6) AS z FROM s"""


def csw(spark: SparkSession, d: str) -> DataFrame:
    return _r(K.chu_stinchcombe_white(_levels(spark, d)).select("series_id", "pos", "statistic", "reference", "critical", "reject"), "statistic", "critical")


_SG = "sg AS (SELECT pos, y, sqrt(sum(d * d) OVER (ORDER BY pos) / nullif(pos, 0)) AS s FROM (SELECT pos, y, y - lag(y) OVER (ORDER BY pos) AS d FROM lev))"
CSW = f"""WITH {LEVELS}, {_SG}, p AS (SELECT a.pos, b.pos AS n, (a.y - b.y) / (a.s * sqrt(a.pos - b.pos)) AS v FROM sg a JOIN sg b ON b.pos < a.pos), m AS (SELECT pos, max(v) AS v, arg_max(n, v) AS n FROM p GROUP BY 1)
SELECT 'all' AS series_id, pos, round(v, 6) AS statistic, n AS reference, round(sqrt(4.6 + ln(pos - n)), 6) AS critical, v > sqrt(4.6 + ln(pos - n)) AS reject FROM m UNION ALL SELECT 'all', 0, NULL, NULL, NULL, false"""


def csw_fixed(spark: SparkSession, d: str) -> DataFrame:
    return _r(K.chu_stinchcombe_white(_levels(spark, d), 10).select("series_id", "pos", "statistic", "critical", "reject"), "statistic", "critical")


CSW_FIXED = f"""WITH {LEVELS}, {_SG}, p AS (SELECT pos, CASE WHEN pos > 10 THEN (y - (SELECT y FROM lev WHERE pos = 10)) / (s * sqrt(pos - 10)) END AS v, CASE WHEN pos > 10 THEN sqrt(4.6 + ln(pos - 10)) END AS c FROM sg)
SELECT 'all' AS series_id, pos, round(v, 6) AS statistic, round(c, 6) AS critical, coalesce(v > c, false) AS reject FROM p"""


def adf(spark: SparkSession, d: str) -> DataFrame:
    return _r(K.adf_stat(_levels(spark, d), 0, "c"), "tau")


_DF = "WITH " + LEVELS + ", x AS (SELECT pos, lag(y) OVER (ORDER BY pos) AS x, y - lag(y) OVER (ORDER BY pos) AS d FROM lev)"
_TAU = "regr_slope(d, x) / sqrt((regr_syy(d, x) - regr_slope(d, x) * regr_sxy(d, x)) / (count(*) - 2) / regr_sxx(d, x))"
ADF = f"{_DF} SELECT 'all' AS series_id, round({_TAU}, 6) AS tau FROM x WHERE x IS NOT NULL"


def sadf(spark: SparkSession, d: str) -> DataFrame:
    return _r(K.sadf(_levels(spark, d), 20, 0, "c"), "sadf", digits=5)


# moments of windows are differences of prefix sums of centred values
_PAIRS = f"""WITH {LEVELS}, ctr AS (SELECT pos, y - avg(y) OVER () AS y FROM lev), x AS (SELECT pos, lag(y) OVER (ORDER BY pos) AS x, y - lag(y) OVER (ORDER BY pos) AS d FROM ctr),
ps AS (SELECT pos, coalesce(sum(x) OVER w, 0) AS a, coalesce(sum(x * x) OVER w, 0) AS b, coalesce(sum(d) OVER w, 0) AS c, coalesce(sum(d * d) OVER w, 0) AS e, coalesce(sum(x * d) OVER w, 0) AS f FROM x WINDOW w AS (ORDER BY pos)),
m AS (SELECT q.pos AS e, p.pos AS s, CAST(q.pos - p.pos AS DOUBLE) AS n, q.a - p.a AS a, q.b - p.b AS b, q.c - p.c AS c, q.e - p.e AS g, q.f - p.f AS f FROM ps q JOIN ps p ON p.pos <= q.pos - 19),
w AS (SELECT e, s, (f - a * c / n) / (b - a * a / n) / sqrt((g - c * c / n - pow(f - a * c / n, 2) / (b - a * a / n)) / (n - 2) / (b - a * a / n)) AS tau FROM m)"""
SADF = f"{_PAIRS} SELECT 'all' AS series_id, e AS pos, round(max(tau), 5) AS sadf FROM w GROUP BY e"


def qadf(spark: SparkSession, d: str) -> DataFrame:
    x = _levels(spark, d)
    return _r(K.qadf(x, 20, 0, 0.9, "c", 0.05).join(K.cadf(x, 20, 0, 0.9), ["series_id", "pos"]), "qadf", "dispersion", "cadf", digits=5)


QADF = f"{_PAIRS}, q AS (SELECT e, quantile_cont(tau, 0.9) AS q, quantile_cont(tau, 0.95) AS hi, quantile_cont(tau, 0.85) AS lo FROM w GROUP BY 1) SELECT 'all' AS series_id, w.e AS pos, round(any_value(q), 5) AS qadf, round(any_value(hi) - any_value(lo), 5) AS dispersion, round(avg(tau) FILTER (WHERE tau >= q - 1e-12), 5) AS cadf FROM w JOIN q USING (e) GROUP BY w.e"


def sadf_null(spark: SparkSession, d: str) -> DataFrame:
    return K.sadf_null_quantiles(spark, 60, 20, 0, "c", (0.9, 0.95), 64, 3)


def smt(spark: SparkSession, d: str) -> DataFrame:
    x = _levels(spark, d).withColumn("value", F.exp("value"))
    return _r(K.smt(x, 20, "exp", 0.5), "smt", digits=4)


SMT = f"""WITH {LEVELS}, ctr AS (SELECT pos, y - avg(y) OVER () AS y, CAST(pos AS DOUBLE) AS t FROM lev), ps AS (SELECT pos, sum(y) OVER w AS a, sum(y * y) OVER w AS b, sum(t * y) OVER w AS f, y, t FROM ctr WINDOW w AS (ORDER BY pos)),
m AS (SELECT q.pos AS e, p.pos AS s, CAST(q.pos - p.pos + 1 AS DOUBLE) AS n, q.a - p.a + p.y AS a, q.b - p.b + p.y * p.y AS b, q.f - p.f + p.t * p.y AS f, (q.t + p.t) / 2 AS mt FROM ps q JOIN ps p ON p.pos <= q.pos - 19),
z AS (SELECT e, s, n, f - mt * a AS sxy, n * (n * n - 1) / 12 AS sxx, b - a * a / n AS syy FROM m)
SELECT 'all' AS series_id, e AS pos, round(max(abs(sxy / sxx) / sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx) / sqrt(e - s)), 4) AS smt FROM z GROUP BY e"""


def smt_poly(spark: SparkSession, d: str) -> DataFrame:
    return _r(K.smt(_levels(spark, d), 20, "poly1"), "smt", digits=5)


# sums of decimals are exact, so differences of sums from the start lose nothing
SMT_POLY1 = f"""WITH {LEVELS}, c AS (SELECT pos, CAST(y - avg(y) OVER () AS DECIMAL(24, 15)) AS y, CAST(pos AS DECIMAL(6, 0)) AS t FROM lev),
ps AS (SELECT pos, coalesce(sum(y) OVER w, 0) AS a, coalesce(sum(y * t) OVER w, 0) AS f, coalesce(sum(y * t * t) OVER w, 0) AS g, coalesce(sum(CAST(CAST(y AS DOUBLE) * CAST(y AS DOUBLE) AS DECIMAL(24, 15))) OVER w, 0) AS b FROM c WINDOW w AS (ORDER BY pos ROWS UNBOUNDED PRECEDING)),
m AS (SELECT q.pos AS e, CAST(q.pos - coalesce(p.pos, -1) AS DOUBLE) AS n, (q.pos + coalesce(p.pos, -1) + 1) AS twice, q.a - coalesce(p.a, 0) AS a, q.f - coalesce(p.f, 0) AS f, q.g - coalesce(p.g, 0) AS g, q.b - coalesce(p.b, 0) AS b FROM ps q JOIN (SELECT * FROM ps UNION ALL SELECT -1, 0, 0, 0, 0) p ON p.pos <= q.pos - 20),
z AS (SELECT e, n, CAST(f - CAST(twice AS DECIMAL(6, 0)) * a / 2 AS DOUBLE) AS s1, CAST(g - CAST(twice AS DECIMAL(6, 0)) * f AS DOUBLE) + CAST(CAST(twice AS DECIMAL(6, 0)) * CAST(twice AS DECIMAL(6, 0)) * a AS DOUBLE) / 4 - (n * n - 1) / 12 * CAST(a AS DOUBLE) AS s2, CAST(b AS DOUBLE) - CAST(a AS DOUBLE) * CAST(a AS DOUBLE) / n AS syy, n * (n * n - 1) / 12 AS q1, n * (n * n - 1) * (n * n - 4) / 180 AS q2 FROM m)
SELECT 'all' AS series_id, e AS pos, round(max(abs(s2 / q2) / sqrt((syy - s1 * s1 / q1 - s2 * s2 / q2) / (n - 3) / q2)), 5) AS smt FROM z GROUP BY e"""


def chow(spark: SparkSession, d: str) -> DataFrame:
    x = _levels(spark, d)
    return _r(K.chow_dfc(x, 0.4).withColumnRenamed("brk", "at").join(K.sdfc(x), "series_id").select("series_id", "at", "dfc", "sdfc", "brk"), "dfc", "sdfc", digits=5)


CHOW = f"""{_DF}, b AS (SELECT p.pos AS brk, sum(x.x * x.x) FILTER (WHERE x.pos >= p.pos) AS sxx, sum(x.x * x.d) FILTER (WHERE x.pos >= p.pos) AS sxy, sum(x.d * x.d) AS sdd FROM lev p, x WHERE x.x IS NOT NULL AND p.pos > 0 GROUP BY 1), f AS (SELECT brk, (sxy / sxx) / sqrt((sdd - sxy * sxy / sxx) / (n - 2) / sxx) AS f, n FROM b, (SELECT count(*) AS n FROM lev))
SELECT 'all' AS series_id, CAST(any_value(ceil(round(0.4 * n, 9))) AS BIGINT) AS at, round(max(f) FILTER (WHERE brk = ceil(round(0.4 * n, 9))), 5) AS dfc, round(max(f) FILTER (WHERE brk BETWEEN ceil(round(0.15 * n, 9)) AND ceil(round(0.85 * n, 9))), 5) AS sdfc, arg_max(brk, f) FILTER (WHERE brk BETWEEN ceil(round(0.15 * n, 9)) AND ceil(round(0.85 * n, 9))) AS brk FROM f"""


def plug_in(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d)
    return _r(E.plug_in_entropy(m, 1).withColumnRenamed("entropy", "one").join(E.plug_in_entropy(m, 3).withColumnRenamed("entropy", "three"), "series_id"), "one", "three")


PLUG_IN = f"""WITH {MESSAGES}, a AS (SELECT series_id, symbol AS w FROM messages), b AS (SELECT series_id, symbol || '|' || lead(symbol) OVER v || '|' || lead(symbol, 2) OVER v AS w FROM messages WINDOW v AS (PARTITION BY series_id ORDER BY ts, seq)),
ca AS (SELECT series_id, w, count(*) AS c FROM a GROUP BY 1, 2), cb AS (SELECT series_id, w, count(*) AS c FROM b WHERE w IS NOT NULL GROUP BY 1, 2), ea AS (SELECT series_id, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS h FROM ca GROUP BY 1), eb AS (SELECT series_id, (log2(sum(c)) - sum(c * log2(c)) / sum(c)) / 3 AS h FROM cb GROUP BY 1)
SELECT series_id, round(ea.h, 6) AS one, round(eb.h, 6) AS three FROM ea JOIN eb USING (series_id)"""


def lempel_ziv(spark: SparkSession, d: str) -> DataFrame:
    return _r(E.lempel_ziv_entropy(messages(spark, d)), "entropy")


def lempel_ziv_parse(spark: SparkSession, d: str) -> DataFrame:
    return E.lempel_ziv_parse(messages(spark, d))


def konto(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d)
    return _r(E.kontoyiannis_entropy(m).join(E.kontoyiannis_entropy(m, 100).withColumnRenamed("entropy", "sliding"), "series_id"), "entropy", "sliding")


def encodings(spark: SparkSession, d: str) -> DataFrame:
    r = returns(spark, d).withColumn("ret", F.round("ret", 6))
    q = E.encode_quantile(r, 10).withColumnRenamed("code", "quantile")
    s = E.encode_sigma(r, 0.25).select("series_id", "ts", F.col("code").alias("sigma"))
    return q.join(s, ["series_id", "ts"]).join(E.encode_binary(r).select("series_id", "ts", F.col("code").alias("binary")), ["series_id", "ts"]).select("series_id", "ts", "quantile", "sigma", "binary")


ENCODINGS = f"""WITH {RETURNS}, r AS (SELECT series_id, ts, round(ret, 6) AS ret FROM returns), e AS (SELECT series_id, quantile_cont(ret, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q, min(ret) AS lo, max(ret) AS hi FROM r GROUP BY 1)
SELECT r.series_id, r.ts, CAST(len(list_filter(q, lambda x: x <= ret)) AS BIGINT) AS quantile, CAST(least(floor((ret - lo) / 0.25 + 1e-9), floor((hi - lo) / 0.25 + 1e-9)) AS BIGINT) AS sigma, CAST(CASE WHEN ret > 0 THEN 1 ELSE 0 END AS BIGINT) AS "binary" FROM r JOIN e USING (series_id) WHERE ret <> 0"""


def mdi(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("tree"), F.posexplode("embedding").alias("feature", "v")).withColumn("v", F.when(F.col("tree") % 3 == F.col("feature") % 3, 0.0).otherwise(F.abs(F.col("v").cast("double"))))
    return _r(U.mdi_from_matrix(v), "mean", "se")


MDI = "WITH v AS (SELECT vec_id AS tree, f AS feature, abs(CAST(embedding[f + 1] AS DOUBLE)) AS v FROM embeddings, (SELECT unnest(range((SELECT max(len(embedding)) FROM embeddings))) AS f) WHERE vec_id % 3 <> f % 3), g AS (SELECT feature, avg(v) AS m, stddev_samp(v) / sqrt(count(v)) AS s FROM v WHERE v <> 0 GROUP BY 1) SELECT CAST(feature AS INTEGER) AS feature, round(m / sum(m) OVER (), 6) AS mean, round(s / sum(m) OVER (), 6) AS se FROM g"


def _data(spark: SparkSession, d: str) -> tuple[dict, DataFrame, list[str]]:
    wide, cols = _wide(spark, d)
    wide = wide.withColumnRenamed("vec_id", "pos").withColumn("label", F.when(F.col("x0") + F.col("x1") > 0, 1).otherwise(0))
    samples = wide.select(F.lit("all").alias("series_id"), "pos", F.col("pos").alias("end_pos"))
    return U.training_arrays(wide, cols, "label"), C.purged_kfold(samples, 4), cols


def mda(spark: SparkSession, d: str) -> DataFrame:
    data, splits, cols = _data(spark, d)
    return U.mda(spark, U.NearestCentroid, data, splits, cols, n_repeats=2)


def sfi(spark: SparkSession, d: str) -> DataFrame:
    data, splits, cols = _data(spark, d)
    return _r(U.sfi(spark, U.NearestCentroid, data, splits, cols), "mean", "se")


# rows by fold, and class means of each fold's training rows, by column f
_FOLDS = """v AS (SELECT vec_id AS pos, f, CAST(embedding[f + 1] AS DOUBLE) AS x FROM embeddings, (SELECT unnest(range((SELECT max(len(embedding)) FROM embeddings))) AS f)),
g AS (SELECT pos, CASE WHEN sum(x) FILTER (WHERE f < 2) > 0 THEN 1 ELSE 0 END AS y, least(pos // ((SELECT count(*) FROM embeddings) // 4), 3) AS k FROM v GROUP BY pos),
d AS (SELECT v.f, v.pos, g.y, g.k, v.x FROM v JOIN g USING (pos)),
t AS (SELECT o.k, d.f, avg(x) FILTER (WHERE y = 0) AS c0, avg(x) FILTER (WHERE y = 1) AS c1, avg(x) AS m FROM d JOIN (SELECT unnest(range(4)) AS k) o ON d.k <> o.k GROUP BY 1, 2)"""
SFI = f"""WITH {_FOLDS},
z AS (SELECT d.f, d.k, d.pos, d.y, pow(x - c0, 2) AS a, pow(x - c1, 2) AS b FROM d JOIN t USING (f, k)),
p AS (SELECT f, k, pos, y, CASE WHEN b < a THEN 1 ELSE 0 END AS guess FROM z UNION ALL SELECT NULL, k, pos, y, CASE WHEN sum(b) < sum(a) THEN 1 ELSE 0 END FROM z GROUP BY k, pos, y),
s AS (SELECT f, k, avg(CASE WHEN guess = y THEN 1.0 ELSE 0.0 END) AS score FROM p GROUP BY f, k)
SELECT CASE WHEN f IS NOT NULL THEN concat('x', f) END AS feature, round(avg(score), 6) AS mean, round(stddev_samp(score) / 2, 6) AS se FROM s GROUP BY f"""
SHRINKS = (0.0, 0.03, 0.1, 0.3)


def grid_search(spark: SparkSession, d: str) -> DataFrame:
    data, splits, _ = _data(spark, d)
    return _r(U.grid_search(spark, U.NearestCentroid, {"shrink": list(SHRINKS)}, data, splits).results, "mean", "std")


GRID_SEARCH = f"""WITH {_FOLDS}, c AS (SELECT unnest([{", ".join(map(str, SHRINKS))}]) AS shrink, unnest(range({len(SHRINKS)})) AS cand_id),
u AS (SELECT cand_id, k, f, m + sign(c0 - m) * greatest(abs(c0 - m) - shrink, 0) AS c0, m + sign(c1 - m) * greatest(abs(c1 - m) - shrink, 0) AS c1 FROM t, c),
z AS (SELECT cand_id, d.k, d.pos, d.y, CASE WHEN sum(pow(x - c1, 2)) < sum(pow(x - c0, 2)) THEN 1 ELSE 0 END AS guess FROM d JOIN u USING (f, k) GROUP BY 1, 2, 3, 4),
s AS (SELECT cand_id, k, avg(CASE WHEN guess = y THEN 1.0 ELSE 0.0 END) AS score FROM z GROUP BY 1, 2)
SELECT CAST(cand_id AS INTEGER) AS cand_id, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std FROM s GROUP BY 1"""


def bagging(spark: SparkSession, d: str) -> DataFrame:
    data, _, cols = _data(spark, d)
    n = len(data["y"])
    m = U.SequentialBootstrapBagging(n_estimators=5, seed=3).fit(spark, data, np.arange(n), np.minimum(np.arange(n) + 5, n - 1))
    return m.transform(_wide(spark, d)[0], cols).select("vec_id", "prediction")


def orthogonal(spark: SparkSession, d: str) -> DataFrame:
    wide, cols = _wide(spark, d)
    return U.orthogonal_features(wide, cols, 0.9).drop(*cols)


#: Dickey and Fuller's table of the t value with a constant, long series: quantiles and their probabilities.
DF_QUANTILES = (-3.43, -3.12, -2.86, -2.57, -0.44, -0.07, 0.23, 0.60)
DF_PROBABILITIES = (0.01, 0.025, 0.05, 0.10, 0.90, 0.95, 0.975, 0.99)


def dickey_fuller_p(x: np.ndarray) -> float:
    """Between the table's points along straight lines, and its ends beyond them."""
    tau = K.adf_tau(x, 0, "c")
    return float(np.interp(tau, DF_QUANTILES, DF_PROBABILITIES))


def min_d(spark: SparkSession, d: str) -> DataFrame:
    return _r(D.find_min_d(daily(spark, d).withColumn("value", F.log("price")), dickey_fuller_p, 0.05, [0.0, 0.5, 1.0]), "p_value", "corr")


_LINES = list(zip(DF_QUANTILES, DF_QUANTILES[1:], DF_PROBABILITIES, DF_PROBABILITIES[1:], strict=False))
_P_VALUE = f"CASE WHEN tau <= {DF_QUANTILES[0]} THEN {DF_PROBABILITIES[0]} " + " ".join(f"WHEN tau <= {b} THEN {p} + (tau - ({a})) * {(q - p) / (b - a)!r}" for a, b, p, q in _LINES) + f" ELSE {DF_PROBABILITIES[-1]} END"
MIN_D = f"""WITH RECURSIVE {DAILY}, grid AS (SELECT CAST(unnest([0.0, 0.5, 1.0]) AS DOUBLE) AS d),
w AS (SELECT d, CAST(0 AS BIGINT) AS k, CAST(1 AS DOUBLE) AS w FROM grid UNION ALL SELECT d, k + 1, -w * (d - k) / (k + 1) FROM w WHERE abs(-w * (d - k) / (k + 1)) >= 0.01),
long AS (SELECT d, max(k) AS last FROM w GROUP BY d),
x AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS pos, ln(price) AS x FROM daily),
y AS (SELECT a.series_id, w.d, a.pos, any_value(a.x) AS x, sum(w.w * b.x) AS y FROM x a JOIN w ON w.k <= a.pos JOIN x b ON b.series_id = a.series_id AND b.pos = a.pos - w.k JOIN long l ON l.d = w.d AND a.pos >= l.last GROUP BY 1, 2, 3),
z AS (SELECT series_id, d, x, y, lag(y) OVER v AS before, y - lag(y) OVER v AS change FROM y WINDOW v AS (PARTITION BY series_id, d ORDER BY pos)),
r AS (SELECT series_id, d, corr(x, y) AS corr, regr_slope(change, before) / sqrt((regr_syy(change, before) - regr_slope(change, before) * regr_sxy(change, before)) / (regr_count(change, before) - 2) / regr_sxx(change, before)) AS tau FROM z GROUP BY 1, 2),
p AS (SELECT series_id, d, corr, {_P_VALUE} AS p_value FROM r)
SELECT s.series_id, b.d, round(b.p_value, 6) AS p_value, round(b.corr, 6) AS corr FROM (SELECT DISTINCT series_id FROM p) s LEFT JOIN (SELECT series_id, min(d) AS d, arg_min(p_value, d) AS p_value, arg_min(corr, d) AS corr FROM p WHERE p_value < 0.05 GROUP BY 1) b USING (series_id)"""


def bootstrap_mc(spark: SparkSession, d: str) -> DataFrame:
    return G.bootstrap_uniqueness_mc(spark, n_iter=500)


def random_t1(spark: SparkSession, d: str) -> DataFrame:
    return G.random_t1(spark, 50, 100, 5, 1)


def mixture(spark: SparkSession, d: str) -> DataFrame:
    return R.mixture_returns(spark, 0.05, -0.1, 0.05, 0.1, 0.75, 2600, 0)


def molecules(spark: SparkSession, d: str) -> DataFrame:
    x = with_pos(days(spark, d)).select("pos", "price")
    return _r(P.mp_pandas_obj(x, lambda p: p.assign(price=np.sqrt(p["price"])), "pos long, price double", 7, False), "price")


MOLECULES = f"WITH {DAYS} SELECT CAST(row_number() OVER (ORDER BY ts) - 1 AS BIGINT) AS pos, round(sqrt(price), 6) AS price FROM days"

LZ = f"""WITH RECURSIVE {MESSAGES}, n AS (SELECT series_id, symbol, row_number() OVER (PARTITION BY series_id ORDER BY ts, seq) AS k, count(*) OVER (PARTITION BY series_id) AS total FROM messages),
f AS (SELECT series_id, k, [symbol] AS done, CAST([] AS VARCHAR[]) AS phrase, [symbol] AS known FROM n WHERE k = 1
UNION ALL SELECT g.series_id, g.k, CASE WHEN g.seen THEN NULL ELSE g.p END, CASE WHEN g.seen THEN g.p ELSE CAST([] AS VARCHAR[]) END, CASE WHEN g.seen THEN g.known ELSE list_append(g.known, array_to_string(g.p, '|')) END FROM (
SELECT n.series_id, n.k, list_append(f.phrase, n.symbol) AS p, f.known, list_contains(f.known, array_to_string(list_append(f.phrase, n.symbol), '|')) AS seen FROM f JOIN n ON n.series_id = f.series_id AND n.k = f.k + 1) g),
parsed AS (SELECT series_id, CAST(row_number() OVER (PARTITION BY series_id ORDER BY k) - 1 AS BIGINT) AS phrase_no, done AS phrase FROM f WHERE done IS NOT NULL)"""
LZ_ENTROPY = f"{LZ} SELECT series_id, round(count(*) * log2(count(*)) / (SELECT max(total) FROM n WHERE n.series_id = parsed.series_id), 6) AS entropy FROM parsed GROUP BY series_id"
KONTO = f"""WITH {MESSAGES}, t AS (SELECT series_id, string_agg(CASE symbol WHEN 'click' THEN 'c' WHEN 'view' THEN 'v' WHEN 'purchase' THEN 'p' WHEN 'error' THEN 'e' ELSE 'o' END, '' ORDER BY ts, seq) AS t FROM messages GROUP BY 1),
c AS (SELECT series_id, t, unnest(range(1, length(t) // 2 + 1)) AS i FROM t), l AS (SELECT series_id, t, i, unnest(range(1, 41)) AS l FROM c), m AS (SELECT series_id, i, coalesce(max(l) FILTER (WHERE l <= i AND i + l <= length(t) AND contains(substr(t, 1, i + l - 1), substr(t, i + 1, l))), 0) + 1 AS x FROM l GROUP BY 1, 2),
d AS (SELECT series_id, t, unnest(range(100, length(t) - 99)) AS i FROM t WHERE length(t) >= 200), dl AS (SELECT series_id, t, i, unnest(range(1, 41)) AS l FROM d), dm AS (SELECT series_id, i, coalesce(max(l) FILTER (WHERE i + l <= length(t) AND contains(substr(t, i - 99, 100 + l - 1), substr(t, i + 1, l))), 0) + 1 AS x FROM dl GROUP BY 1, 2),
a AS (SELECT series_id, avg(log2(i + 1.0) / x) AS h FROM m GROUP BY 1), b AS (SELECT series_id, avg(log2(101.0) / x) AS h FROM dm GROUP BY 1) SELECT series_id, round(a.h, 6) AS entropy, round(b.h, 6) AS sliding FROM a JOIN b USING (series_id)"""

QUERIES = {
    "sharpe_ratio": sharpe, "probabilistic_sharpe_ratio": psr, "bet_timing": bet_timing, "holding_period": holding_period, "return_concentration": concentration, "drawdown_time_under_water": drawdown, "cscv_logits": cscv, "pbo": pbo, "deflated_sharpe": deflated, "performance_matrix": performance_matrix,
    "binomial_risk": binomial, "probability_of_failure": failure, "fit_ou": fit_ou, "otr_grid": otr, "mixture_returns": mixture, "bet_sizing": sizing, "average_active_signals": active_signals, "correlation_distance": correlations, "distance_of_distances": distances, "hrp_weights": hrp, "onc": onc, "silhouette_scores": silhouette,
    "cusum_test": cusum, "chu_stinchcombe_white": csw, "chu_stinchcombe_white_fixed": csw_fixed, "adf_stat": adf, "sadf": sadf, "qadf_cadf": qadf, "sadf_null_quantiles": sadf_null, "smt_exp": smt, "smt_poly1": smt_poly, "chow_dfc_sdfc": chow, "plug_in_entropy": plug_in, "lempel_ziv_entropy": lempel_ziv, "lempel_ziv_parse": lempel_ziv_parse, "kontoyiannis_entropy": konto, "encodings": encodings,
    "mdi_from_matrix": mdi, "mda": mda, "sfi": sfi, "grid_search": grid_search, "sequential_bootstrap_bagging": bagging, "orthogonal_features": orthogonal, "find_min_d": min_d, "bootstrap_uniqueness_mc": bootstrap_mc, "random_t1": random_t1, "mp_pandas_obj": molecules,
}
SQL = {
    "sharpe_ratio": SHARPE, "probabilistic_sharpe_ratio": PSR, "bet_timing": BET_TIMING, "holding_period": HOLDING, "return_concentration": CONCENTRATION, "drawdown_time_under_water": DRAWDOWN, "cscv_logits": f"WITH {CSCV} SELECT split_id, best_trial, CAST(rank AS BIGINT) AS rank, CAST(n_trials AS BIGINT) AS n_trials, round(logit, 6) AS logit FROM cs",
    "pbo": f"WITH {CSCV} SELECT round(avg(CASE WHEN logit <= 0 THEN 1.0 ELSE 0.0 END), 6) AS pbo, CAST(count(*) AS BIGINT) AS n_splits, round(avg(logit), 6) AS mean_logit FROM cs", "deflated_sharpe": DEFLATED, "performance_matrix": f"WITH {PERFORMANCE_ALL} SELECT t, trial_id, round(ret, 9) AS ret FROM performance",
    "binomial_risk": BINOMIAL, "probability_of_failure": FAILURE, "fit_ou": FIT_OU, "bet_sizing": SIZING, "average_active_signals": ACTIVE, "correlation_distance": CORRELATIONS, "distance_of_distances": DISTANCES, "silhouette_scores": SILHOUETTE, "cusum_test": CUSUM, "chu_stinchcombe_white": CSW, "chu_stinchcombe_white_fixed": CSW_FIXED,
    "adf_stat": ADF, "sadf": SADF, "qadf_cadf": QADF, "smt_exp": SMT, "smt_poly1": SMT_POLY1, "sfi": SFI, "grid_search": GRID_SEARCH, "find_min_d": MIN_D, "chow_dfc_sdfc": CHOW, "plug_in_entropy": PLUG_IN, "lempel_ziv_parse": f"{LZ} SELECT * FROM parsed", "lempel_ziv_entropy": LZ_ENTROPY, "kontoyiannis_entropy": KONTO, "encodings": ENCODINGS, "mdi_from_matrix": MDI, "mp_pandas_obj": MOLECULES,
}
