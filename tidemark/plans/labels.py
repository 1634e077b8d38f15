"""Queries over daily prices: labels, weights, cross-validation, fractional differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import cv as C
from tidemark.operators import fracdiff as D
from tidemark.operators import labeling as L
from tidemark.operators import weights as W
from tidemark.operators.series import asof, with_pos
from tidemark.plans.bars import _r
from tidemark.sources.tables import DAILY, DAYS, LABELS, daily, days, labels


def daily_vol(spark: SparkSession, d: str) -> DataFrame:
    return _r(L.get_daily_vol(daily(spark, d), 100).select("series_id", "ts", "daily_vol"), "daily_vol")


_A = f"CAST({1 - 2 / 101!r} AS DOUBLE)"
DAILY_VOL = f"""WITH RECURSIVE {DAILY}, p AS (SELECT a.series_id, a.ts, a.price, (SELECT arg_max(b.price, b.ts) FROM daily b WHERE b.series_id = a.series_id AND b.ts < a.ts - INTERVAL 1 DAY) AS before FROM daily a),
q AS (SELECT *, price / before - 1 AS r, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS k FROM p WHERE before IS NOT NULL),
f AS (SELECT series_id, k, r AS mean, CAST(1 AS DOUBLE) AS w, CAST(1 AS DOUBLE) AS w2, CAST(0 AS DOUBLE) AS c FROM q WHERE k = 1
UNION ALL SELECT g.series_id, g.k, g.m, g.w, g.w2, (g.wo * (g.c + pow(g.dd / g.w, 2)) + pow(g.r - g.m, 2)) / g.w FROM (
SELECT q.series_id, q.k, q.r, f.w * {_A} AS wo, f.w * {_A} + 1 AS w, f.w2 * {_A} * {_A} + 1 AS w2, f.c, q.r - f.mean AS dd, f.mean + (q.r - f.mean) / (f.w * {_A} + 1) AS m FROM f JOIN q ON q.series_id = f.series_id AND q.k = f.k + 1) g)
SELECT p.series_id, p.ts, CASE WHEN f.k > 1 THEN round(sqrt(f.c * f.w * f.w / (f.w * f.w - f.w2)), 6) END AS daily_vol FROM p LEFT JOIN q ON p.series_id = q.series_id AND p.ts = q.ts LEFT JOIN f ON q.series_id = f.series_id AND q.k = f.k"""


def vertical_barrier(spark: SparkSession, d: str) -> DataFrame:
    e = labels(spark, d).select("series_id", "t0")
    return L.add_vertical_barrier(e, days(spark, d), 10)


VERTICAL = f"WITH {LABELS} SELECT l.series_id, l.t0, (SELECT min(ts) FROM days WHERE ts >= l.t0 + INTERVAL 10 DAY) AS t1 FROM labels l"


def _events(spark: SparkSession, d: str) -> DataFrame:
    e = labels(spark, d).select("series_id", "t0", "trgt", "side", F.col("t1").alias("vertical"))
    return L.get_events(days(spark, d), e, 1.5, 1.0, 0.025)


def triple_barrier(spark: SparkSession, d: str) -> DataFrame:
    return _r(_events(spark, d), "trgt")


EVENTS_SQL = f"""{LABELS}, ev AS (SELECT * FROM labels WHERE trgt > 0.025), path AS (SELECT e.t0, d.ts, (d.price / s.price - 1) * e.side AS r, e.trgt FROM ev e JOIN days s ON s.ts = e.t0 JOIN days d ON d.ts > e.t0 AND d.ts <= e.t1),
hit AS (SELECT t0, min(ts) FILTER (WHERE r > 1.5 * trgt) AS up, min(ts) FILTER (WHERE r < -1.0 * trgt) AS down FROM path GROUP BY t0),
events2 AS (SELECT e.series_id, e.t0, CASE WHEN down IS NOT NULL AND (up IS NULL OR down <= up) THEN down WHEN up IS NOT NULL THEN up ELSE e.t1 END AS t1, e.trgt, e.side,
CASE WHEN down IS NOT NULL AND (up IS NULL OR down <= up) THEN 'sl' WHEN up IS NOT NULL THEN 'pt' ELSE 'vertical' END AS barrier FROM ev e LEFT JOIN hit USING (t0))"""
TRIPLE = f"WITH {EVENTS_SQL} SELECT series_id, t0, t1, round(trgt, 6) AS trgt, side, barrier FROM events2"


def bins(spark: SparkSession, d: str) -> DataFrame:
    return _r(L.get_bins(_events(spark, d), days(spark, d)), "ret")


BINS_SQL = f"""{EVENTS_SQL}, bins AS (SELECT e.series_id, e.t0, e.t1, e.side, (SELECT arg_max(price, ts) FROM days WHERE ts <= e.t1) / (SELECT arg_min(price, ts) FROM days WHERE ts >= e.t0) - 1 AS ret
FROM events2 e WHERE e.t1 <= (SELECT max(ts) FROM days))"""
BINS = f"WITH {BINS_SQL} SELECT series_id, t0, t1, round(ret, 6) AS ret, CAST(sign(ret) AS BIGINT) AS bin FROM bins"


def meta_labels(spark: SparkSession, d: str) -> DataFrame:
    return _r(L.meta_labels(_events(spark, d), days(spark, d), labels(spark, d)), "ret")


META = f"WITH {BINS_SQL} SELECT series_id, t0, t1, round(ret * side, 6) AS ret, CAST(CASE WHEN ret * side > 0 THEN 1 ELSE 0 END AS BIGINT) AS bin FROM bins"


def drop_labels(spark: SparkSession, d: str) -> DataFrame:
    """Rare event types go."""
    e = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("bin"))
    return L.drop_labels(e, 0.26).groupBy("bin").agg(F.count("*").alias("n"))


DROP = """WITH RECURSIVE c AS (SELECT concat(l_returnflag, l_linestatus) AS bin, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT bin, n, row_number() OVER (ORDER BY n, bin) AS k, sum(n) OVER (ORDER BY n DESC, bin DESC ROWS UNBOUNDED PRECEDING) AS left_n, count(*) OVER () AS m FROM c),
g AS (SELECT 1 AS k, (SELECT n * 1.0 / left_n < 0.26 AND m >= 3 FROM r WHERE k = 1) AS gone UNION ALL SELECT g.k + 1, (SELECT n * 1.0 / left_n < 0.26 AND m - g.k >= 3 FROM r WHERE r.k = g.k + 1) FROM g WHERE g.gone AND g.k < (SELECT max(m) FROM r))
SELECT bin, CAST(n AS BIGINT) AS n FROM r WHERE k NOT IN (SELECT k FROM g WHERE gone)"""


def trend_scanning(spark: SparkSession, d: str) -> DataFrame:
    x = L.trend_scanning_labels(daily(spark, d), [5, 10, 20], 3.0)
    return _r(x.select("series_id", "ts", "t_value", "window", "bin"), "t_value", digits=4)


def _trend(n: int) -> str:
    sxx = n * (n * n - 1) / 12
    f = f"OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)"
    return f"CASE WHEN count(*) {f} = {n} THEN covar_pop(y, k) {f} * {n} / {sxx} END AS b{n}, var_pop(y) {f} * {n} AS v{n}"


def _trend_t(n: int) -> str:
    sxx = n * (n * n - 1) / 12
    return f"b{n} / sqrt(greatest(v{n} - b{n} * b{n} * {sxx}, 0) / {n - 2} / {sxx}) AS t{n}"


TREND = f"""WITH {DAILY}, a AS (SELECT series_id, ts, ln(price) AS y, CAST(row_number() OVER (PARTITION BY series_id ORDER BY ts) AS DOUBLE) AS k FROM daily), b AS (SELECT series_id, ts, {_trend(5)}, {_trend(10)}, {_trend(20)} FROM a),
c AS (SELECT series_id, ts, {_trend_t(5)}, {_trend_t(10)}, {_trend_t(20)} FROM b), e AS (SELECT series_id, ts, CASE WHEN t5 IS NULL THEN NULL WHEN abs(t5) >= coalesce(abs(t10), -1) AND abs(t5) >= coalesce(abs(t20), -1) THEN 5 WHEN abs(t10) >= coalesce(abs(t20), -1) THEN 10 ELSE 20 END AS w, t5, t10, t20 FROM c),
g AS (SELECT series_id, ts, w, CASE w WHEN 5 THEN t5 WHEN 10 THEN t10 WHEN 20 THEN t20 END AS t FROM e)
SELECT series_id, ts, round(t, 4) AS t_value, CAST(w AS BIGINT) AS "window", CAST(CASE WHEN t IS NULL THEN NULL WHEN abs(t) > 3 THEN CASE WHEN t > 0 THEN 1 ELSE -1 END ELSE 0 END AS BIGINT) AS bin FROM g"""


def _spans(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    grid = W.bar_grid(days(spark, d), ["price"])
    return grid, W.label_spans(grid, labels(spark, d).select("series_id", "label_id", "t0", "t1"))


SPANS = LABELS + """, spans AS (SELECT l.series_id, l.label_id, l.t0, (SELECT min(pos) FROM numbered WHERE ts >= l.t0) AS s, (SELECT max(pos) FROM numbered WHERE ts <= l.t1) AS e FROM labels l),
conc AS (SELECT n.pos, n.ts, n.price, CAST(count(s.s) AS BIGINT) AS c FROM numbered n LEFT JOIN spans s ON n.pos BETWEEN s.s AND s.e GROUP BY 1, 2, 3)"""


def label_spans(spark: SparkSession, d: str) -> DataFrame:
    return _spans(spark, d)[1].select("series_id", "label_id", "start_pos", "end_pos")


def num_co_events(spark: SparkSession, d: str) -> DataFrame:
    return W.num_co_events(*_spans(spark, d)).select("series_id", "ts", "co_events")


def average_uniqueness(spark: SparkSession, d: str) -> DataFrame:
    return _r(W.average_uniqueness(*_spans(spark, d)).select("series_id", "label_id", "uniqueness"), "uniqueness")


UNIQ = "uniq AS (SELECT s.series_id, s.label_id, s.t0, avg(1.0 / c.c) AS u FROM spans s JOIN conc c ON c.pos BETWEEN s.s AND s.e GROUP BY 1, 2, 3)"


def sample_uniqueness(spark: SparkSession, d: str) -> DataFrame:
    """Of the sample in which every third label is drawn twice."""
    s = _spans(spark, d)[1]
    draws = s.select("series_id", F.lit(0).alias("draw_id"), "label_id").unionByName(s.filter("label_id % 3 = 0").select("series_id", F.lit(0).alias("draw_id"), "label_id"))
    return _r(W.sample_average_uniqueness(s, draws), "uniqueness")


SAMPLE = f"""WITH {SPANS}, dr AS (SELECT *, row_number() OVER () AS k FROM (SELECT * FROM spans UNION ALL SELECT * FROM spans WHERE label_id % 3 = 0)), c2 AS (SELECT n.pos, count(*) AS c FROM numbered n JOIN dr ON n.pos BETWEEN dr.s AND dr.e GROUP BY 1),
u AS (SELECT dr.k, avg(1.0 / c2.c) AS u FROM dr JOIN c2 ON c2.pos BETWEEN dr.s AND dr.e GROUP BY 1) SELECT 'all' AS series_id, 0 AS draw_id, round(avg(u), 6) AS uniqueness FROM u"""


def indicator(spark: SparkSession, d: str) -> DataFrame:
    return W.indicator_matrix(_spans(spark, d)[1])


def weight_by_return(spark: SparkSession, d: str) -> DataFrame:
    return _r(W.sample_weight_by_return(*_spans(spark, d)).select("series_id", "label_id", "w"), "w")


BY_RETURN = f"""WITH {SPANS}, r AS (SELECT pos, c, CASE WHEN c > 0 THEN coalesce(ln(price) - lag(ln(price)) OVER (ORDER BY pos), 0) / c ELSE 0 END AS v FROM conc), a AS (SELECT s.series_id, s.label_id, abs(sum(r.v)) AS w FROM spans s JOIN r ON r.pos BETWEEN s.s AND s.e GROUP BY 1, 2)
SELECT series_id, label_id, round(w * count(*) OVER () / sum(w) OVER (), 6) AS w FROM a"""


def time_decay(spark: SparkSession, d: str) -> DataFrame:
    u = W.average_uniqueness(*_spans(spark, d))
    return _r(W.time_decay(u, 0.5).withColumnRenamed("decay", "half").join(W.time_decay(u, -0.3).select("series_id", "label_id", F.col("decay").alias("clipped")), ["series_id", "label_id"]).select("series_id", "label_id", "half", "clipped"), "half", "clipped")


DECAY = f"""WITH {SPANS}, {UNIQ}, c AS (SELECT *, sum(u) OVER (ORDER BY t0 ROWS UNBOUNDED PRECEDING) AS x, sum(u) OVER () AS t FROM uniq)
SELECT series_id, label_id, round(greatest(0, 1 - 0.5 / t * t + 0.5 / t * x), 6) AS half, round(greatest(0, 1 - 1 / (0.7 * t) * t + 1 / (0.7 * t) * x), 6) AS clipped FROM c"""


def sequential_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return W.sequential_bootstrap(_spans(spark, d)[1], None, 7, 4)


def frac_diff_ffd(spark: SparkSession, d: str) -> DataFrame:
    return _r(D.frac_diff_ffd(daily(spark, d).withColumn("value", F.log("price")), 0.4, 0.01).select("series_id", "ts", "fd"), "fd")


def _ffd(d: float, thres: float) -> str:
    w = D.get_weights_ffd(d, thres)
    return " + ".join(f"CAST({c!r} AS DOUBLE) * lag(y, {k}) OVER (PARTITION BY series_id ORDER BY ts)" for k, c in enumerate(w))


FFD = f"WITH {DAILY}, l AS (SELECT series_id, ts, ln(price) AS y FROM daily) SELECT series_id, ts, round({_ffd(0.4, 0.01)}, 6) AS fd FROM l"


def frac_diff_ffd_wide(spark: SparkSession, d: str) -> DataFrame:
    return _r(D.frac_diff_ffd(days(spark, d).withColumn("value", F.log("price")), 0.4, 1e-3).select("series_id", "ts", "fd"), "fd")


FFD_WIDE = f"""WITH {DAYS}, l AS (SELECT series_id, ts, ln(price) AS y, row_number() OVER (ORDER BY ts) AS k FROM days), w AS (SELECT unnest(range({len(D.get_weights_ffd(0.4, 1e-3))})) AS j, unnest([{", ".join(f"CAST({x!r} AS DOUBLE)" for x in D.get_weights_ffd(0.4, 1e-3))}]) AS c)
SELECT a.series_id, a.ts, CASE WHEN count(*) = {len(D.get_weights_ffd(0.4, 1e-3))} THEN round(sum(w.c * b.y), 6) END AS fd FROM l a JOIN w ON true LEFT JOIN l b ON b.k = a.k - w.j WHERE b.k IS NOT NULL OR a.k - w.j < 1 GROUP BY a.series_id, a.ts, a.k""".replace("count(*) =", "count(b.k) =")


def frac_diff(spark: SparkSession, d: str) -> DataFrame:
    x = with_pos(days(spark, d).withColumn("value", F.log("price")))
    return _r(D.frac_diff(x, 0.5, 0.3).select("series_id", "pos", "fd"), "fd")


FRAC = f"""WITH RECURSIVE {DAYS}, l AS (SELECT series_id, ln(price) AS y, CAST(row_number() OVER (ORDER BY ts) - 1 AS BIGINT) AS k FROM days), w AS (SELECT CAST(0 AS BIGINT) AS j, CAST(1 AS DOUBLE) AS c UNION ALL SELECT j + 1, -c * (0.5 - (j + 1) + 1) / (j + 1) FROM w WHERE j + 1 < (SELECT count(*) FROM l)),
lam AS (SELECT j, 1 - sum(abs(c)) OVER (ORDER BY j) / sum(abs(c)) OVER () AS x FROM w), first AS (SELECT min(j) AS f FROM lam WHERE x <= 0.3), s AS (SELECT a.series_id, a.k, sum(w.c * b.y) AS v FROM l a JOIN l b ON b.k <= a.k JOIN w ON w.j = a.k - b.k GROUP BY 1, 2)
SELECT s.series_id, s.k AS pos, CASE WHEN s.k >= f THEN round(v, 6) END AS fd FROM s, first"""


def weights_table(spark: SparkSession, d: str) -> DataFrame:
    return _r(spark.createDataFrame([(k, w) for k, w in enumerate(D.get_weights(0.35, 50))], "k long, w double"), "w", digits=9)


WEIGHTS = "WITH RECURSIVE w AS (SELECT CAST(0 AS BIGINT) AS k, CAST(1 AS DOUBLE) AS w UNION ALL SELECT k + 1, -w * (0.35 - (k + 1) + 1) / (k + 1) FROM w WHERE k < 49) SELECT k, round(w, 9) AS w FROM w"


def _samples(spark: SparkSession, d: str) -> DataFrame:
    return C.end_positions(C.make_t1(days(spark, d).select("series_id", "ts"), 7))


SAMPLES = DAYS + ", n AS (SELECT ts, CAST(row_number() OVER (ORDER BY ts) - 1 AS BIGINT) AS pos, count(*) OVER () AS n FROM days), samples AS (SELECT ts, pos, least(pos + 7, n - 1) AS e, CAST(least(pos // (n // 6), 5) AS INTEGER) AS g, n FROM n)"


def make_t1(spark: SparkSession, d: str) -> DataFrame:
    return _samples(spark, d).select("series_id", "ts", "t1", "pos", "end_pos")


MAKE_T1 = f"WITH {SAMPLES} SELECT 'all' AS series_id, s.ts, t.ts AS t1, s.pos, CAST(s.e AS BIGINT) AS end_pos FROM samples s JOIN samples t ON t.pos = s.e"


def cpcv(spark: SparkSession, d: str) -> DataFrame:
    return C.combinatorial_purged_cv(_samples(spark, d), 6, 2, 0.01)


CPCV = f"""WITH {SAMPLES}, combos AS (SELECT CAST(row_number() OVER (ORDER BY a, b) - 1 AS INTEGER) AS split_id, a, b FROM (SELECT unnest(range(6)) AS a), (SELECT unnest(range(6)) AS b) WHERE a < b), tg AS (SELECT split_id, unnest([a, b]) AS g FROM combos),
isl AS (SELECT *, g - row_number() OVER (PARTITION BY split_id ORDER BY g) AS i FROM tg), bl AS (SELECT split_id, i, min(g) AS g0, max(g) AS g1 FROM isl GROUP BY 1, 2),
ed AS (SELECT split_id, i, min(pos) AS b0, max(pos) AS b1, max(e) AS e1, max(ceil(round(0.01 * n, 9))) AS emb FROM bl JOIN samples ON g BETWEEN g0 AND g1 GROUP BY 1, 2),
x AS (SELECT s.pos, ed.split_id, bool_or(s.pos BETWEEN b0 AND b1) AS t, bool_or((s.e >= b0 AND s.pos <= e1) OR (s.pos > e1 AND s.pos <= e1 + emb)) AS o FROM samples s, ed GROUP BY 1, 2)
SELECT 'all' AS series_id, split_id, pos, CASE WHEN t THEN 'test' WHEN o THEN 'dropped' ELSE 'train' END AS role FROM x"""


def purged_kfold(spark: SparkSession, d: str) -> DataFrame:
    return C.purged_kfold(_samples(spark, d), 6, 0.01)


KFOLD = f"""WITH {SAMPLES}, ed AS (SELECT g AS split_id, min(pos) AS b0, max(pos) AS b1, max(e) AS e1, max(ceil(round(0.01 * n, 9))) AS emb FROM samples GROUP BY 1)
SELECT 'all' AS series_id, split_id, pos, CASE WHEN pos BETWEEN b0 AND b1 THEN 'test' WHEN (e >= b0 AND pos <= e1) OR (pos > e1 AND pos <= e1 + emb) THEN 'dropped' ELSE 'train' END AS role FROM samples, ed"""


def paths(spark: SparkSession, d: str) -> DataFrame:
    return C.build_paths(spark, 6, 2).select(F.col("path").cast("long"), "grp", "split_id")


PATHS = "WITH combos AS (SELECT CAST(row_number() OVER (ORDER BY a, b) - 1 AS INTEGER) AS split_id, a, b FROM (SELECT unnest(range(6)) AS a), (SELECT unnest(range(6)) AS b) WHERE a < b), tg AS (SELECT split_id, CAST(unnest([a, b]) AS INTEGER) AS grp FROM combos) SELECT CAST(row_number() OVER (PARTITION BY grp ORDER BY split_id) - 1 AS BIGINT) AS path, grp, split_id FROM tg"


def path_frame(spark: SparkSession, d: str) -> DataFrame:
    """Predictions split_id * 10000 + pos, put together along the paths."""
    s = _samples(spark, d)
    tested = C.combinatorial_purged_cv(s, 6, 2).filter("role = 'test'").select("series_id", "split_id", "pos", (F.col("split_id") * 10000 + F.col("pos")).cast("double").alias("prediction"))
    return C.paths_to_frame(C.combine_paths(s, tested, 6, 2), 6, 2)


PATH_FRAME = f"""WITH {SAMPLES}, pt AS ({PATHS}) SELECT 'all' AS series_id, s.pos, {", ".join(f"max(CAST(split_id * 10000 + s.pos AS DOUBLE)) FILTER (WHERE path = {p}) AS path_{p}" for p in range(5))} FROM samples s JOIN pt ON pt.grp = s.g GROUP BY s.pos"""


def asof_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The last daily price before each event's day of the same weekday rank: a backward lookup."""
    left = labels(spark, d).select("series_id", "t1")
    return _r(asof(left, days(spark, d).select("series_id", "ts", "price"), "t1", ["price"], strict=True), "price")


ASOF = f"WITH {LABELS} SELECT l.series_id, l.t1, round((SELECT arg_max(price, ts) FROM days WHERE ts < l.t1), 6) AS price FROM labels l"

QUERIES = {
    "get_daily_vol": daily_vol, "add_vertical_barrier": vertical_barrier, "triple_barrier_events": triple_barrier, "get_bins": bins, "meta_labels": meta_labels, "drop_labels": drop_labels, "trend_scanning_labels": trend_scanning,
    "label_spans": label_spans, "num_co_events": num_co_events, "average_uniqueness": average_uniqueness, "sample_average_uniqueness": sample_uniqueness, "indicator_matrix": indicator, "sample_weight_by_return": weight_by_return, "time_decay": time_decay,
    "sequential_bootstrap": sequential_bootstrap, "frac_diff_ffd": frac_diff_ffd, "frac_diff_ffd_wide": frac_diff_ffd_wide, "frac_diff": frac_diff, "get_weights": weights_table, "make_t1": make_t1, "combinatorial_purged_cv": cpcv, "purged_kfold": purged_kfold, "cpcv_paths": paths, "cpcv_path_frame": path_frame, "asof_join": asof_lookup,
}
SQL = {
    "get_daily_vol": DAILY_VOL, "add_vertical_barrier": VERTICAL, "triple_barrier_events": TRIPLE, "get_bins": BINS, "meta_labels": META, "drop_labels": DROP, "trend_scanning_labels": TREND,
    "label_spans": f"WITH {SPANS} SELECT series_id, label_id, s AS start_pos, e AS end_pos FROM spans", "num_co_events": f"WITH {SPANS} SELECT 'all' AS series_id, ts, c AS co_events FROM conc", "average_uniqueness": f"WITH {SPANS}, {UNIQ} SELECT series_id, label_id, round(u, 6) AS uniqueness FROM uniq",
    "sample_average_uniqueness": SAMPLE, "indicator_matrix": f"WITH {SPANS} SELECT s.series_id, n.pos, s.label_id FROM spans s JOIN numbered n ON n.pos BETWEEN s.s AND s.e", "sample_weight_by_return": BY_RETURN, "time_decay": DECAY,
    "frac_diff_ffd": FFD, "frac_diff_ffd_wide": FFD_WIDE, "frac_diff": FRAC, "get_weights": WEIGHTS, "make_t1": MAKE_T1, "combinatorial_purged_cv": CPCV, "purged_kfold": KFOLD, "cpcv_paths": PATHS, "cpcv_path_frame": PATH_FRAME, "asof_join": ASOF,
}
