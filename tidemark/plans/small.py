"""Queries for operators that give parameters, bounds and small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.normal import phi_inverse
from tidemark.operators import bet_sizing as Z
from tidemark.operators import breaks as K
from tidemark.operators import cv as C
from tidemark.operators import fracdiff as D
from tidemark.operators import parallel as P
from tidemark.operators import stats as S
from tidemark.operators.series import with_long_pos
from tidemark.plans.bars import _r
from tidemark.sources.tables import DAYS, RETURNS, TICKS, days, returns, ticks


def weights_ffd(spark: SparkSession, d: str) -> DataFrame:
    return _r(spark.createDataFrame(list(enumerate(D.get_weights_ffd(0.6, 1e-3))), "k long, w double"), "w", digits=9)


WEIGHTS_FFD = "WITH RECURSIVE w AS (SELECT CAST(0 AS BIGINT) AS k, CAST(1 AS DOUBLE) AS w UNION ALL SELECT k + 1, -w * (0.6 - (k + 1) + 1) / (k + 1) FROM w WHERE abs(-w * (0.6 - (k + 1) + 1) / (k + 1)) >= 0.001) SELECT k, round(w, 9) AS w FROM w"


def critical(spark: SparkSession, d: str) -> DataFrame:
    """For each day's number as the lag."""
    w = days(spark, d).groupBy().agg(F.count("*").alias("n")).select(F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("lag"))
    return _r(w.withColumn("critical", K.csw_critical_value(F.col("lag"))), "critical")


CRITICAL = f"WITH {DAYS}, n AS (SELECT unnest(range(1, count(*) + 1)) AS lag FROM days) SELECT lag, round(sqrt(4.6 + ln(lag)), 6) AS critical FROM n"


def track_record(spark: SparkSession, d: str) -> DataFrame:
    """Least track record of each series against a Sharpe ratio a tenth below its own."""
    psr = S.probabilistic_sharpe_ratio(returns(spark, d))
    return _r(psr.select("series_id", S.track_record("sr", F.col("sr") - 0.1, "skew", "kurt").alias("length")), "length", digits=4)


TRACK_RECORD = f"""WITH {RETURNS}, m AS (SELECT series_id, avg(ret) AS a, stddev_samp(ret) AS sd, stddev_pop(ret) AS sp FROM returns GROUP BY 1), h AS (SELECT m.series_id, any_value(a) / any_value(sd) AS sr, avg(pow(ret - a, 3)) / any_value(pow(sp, 3)) AS skew, avg(pow(ret - a, 4)) / any_value(pow(sp, 4)) AS kurt FROM returns r JOIN m USING (series_id) GROUP BY 1)
SELECT series_id, round(1 + (1 - skew * sr + (kurt - 1) / 4 * sr * sr) * pow(CAST({phi_inverse(0.95)!r} AS DOUBLE) / 0.1, 2), 4) AS length FROM h"""


def chunk_bounds(spark: SparkSession, d: str) -> DataFrame:
    n = days(spark, d).count()
    return spark.createDataFrame([(k, b) for k, b in enumerate(P.lin_parts(n, 7))], "part long, bound long")


CHUNK_BOUNDS = f"WITH {DAYS}, n AS (SELECT count(*) AS n FROM days) SELECT k AS part, CAST(ceil(round(k * n / 7.0, 9)) AS BIGINT) AS bound FROM n, (SELECT unnest(range(8)) AS k)"


def sigmoid_width(spark: SparkSession, d: str) -> DataFrame:
    return _r(spark.createDataFrame([(k, Z.calibrate_sigmoid_width(float(k), 0.95)) for k in range(1, 101)], "x long, w double"), "w")


SIGMOID_WIDTH = "SELECT x, round(x * x * (pow(0.95, -2) - 1), 6) AS w FROM (SELECT unnest(range(1, 101)) AS x)"


def test_blocks(spark: SparkSession, d: str) -> DataFrame:
    return C.contiguous_blocks(C.split_table(spark, 8, 3)).select("split_id", "first", "last")


TEST_BLOCKS = "WITH c AS (SELECT CAST(row_number() OVER (ORDER BY a, b, c) - 1 AS INTEGER) AS split_id, a, b, c FROM (SELECT unnest(range(8)) AS a), (SELECT unnest(range(8)) AS b), (SELECT unnest(range(8)) AS c) WHERE a < b AND b < c), g AS (SELECT split_id, unnest([a, b, c]) AS g FROM c), i AS (SELECT *, g - row_number() OVER (PARTITION BY split_id ORDER BY g) AS i FROM g) SELECT split_id, CAST(min(g) AS INTEGER) AS first, CAST(max(g) AS INTEGER) AS last FROM i GROUP BY split_id, i"


def groups(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of seven contiguous groups of all days; the last takes what is left over."""
    x = days(spark, d).select(F.row_number().over(Window.partitionBy("series_id").orderBy("ts")).alias("k"), F.count("*").over(Window.partitionBy("series_id")).alias("n"))
    return x.withColumn("grp", C.group_of(F.col("k") - 1, F.col("n"), 7)).groupBy("grp").agg(F.count("*").alias("size"))


GROUPS = f"WITH {DAYS}, n AS (SELECT row_number() OVER (ORDER BY ts) - 1 AS k, count(*) OVER () AS n FROM days) SELECT CAST(least(k // (n // 7), 6) AS INTEGER) AS grp, CAST(count(*) AS BIGINT) AS size FROM n GROUP BY 1"


def long_positions(spark: SparkSession, d: str) -> DataFrame:
    """Positions of ticks numbered day by day."""
    return with_long_pos(ticks(spark, d)).select("series_id", "seq", "pos")


LONG_POSITIONS = f"WITH {TICKS} SELECT series_id, seq, CAST(row_number() OVER (PARTITION BY series_id ORDER BY ts, seq) - 1 AS BIGINT) AS pos FROM ticks"

QUERIES = {"get_weights_ffd": weights_ffd, "csw_critical_value": critical, "min_track_record_length": track_record, "lin_parts": chunk_bounds, "calibrate_sigmoid_width": sigmoid_width, "contiguous_blocks": test_blocks, "group_labels": groups, "long_positions": long_positions}
SQL = {"get_weights_ffd": WEIGHTS_FFD, "csw_critical_value": CRITICAL, "min_track_record_length": TRACK_RECORD, "lin_parts": CHUNK_BOUNDS, "calibrate_sigmoid_width": SIGMOID_WIDTH, "contiguous_blocks": TEST_BLOCKS, "group_labels": GROUPS, "long_positions": LONG_POSITIONS}
