"""The shapes the operators take, from the Parquet tables of a folder.

Each reader has the SQL of the same rows beside it, for use as a common table
expression.  Prices are whole cents divided by a count, so that every engine
gets the same doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_id (event type), ts, seq, price, volume."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("series_id"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("price"), (F.col("event_id") % 100 + 1).cast("double").alias("volume"))


TICKS = "ticks AS (SELECT event_type AS series_id, ts, event_id AS seq, value AS price, CAST(event_id % 100 + 1 AS DOUBLE) AS volume FROM events)"


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_id (order priority), ts (day), price, high, low, volume (orders)."""
    o = table(spark, sf_dir, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    return o.groupBy(F.col("o_orderpriority").alias("series_id"), F.col("o_orderdate").alias("ts")).agg(
        (F.sum(cents).cast("double") / 100 / F.count("*")).alias("price"), F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"), F.count("*").cast("double").alias("volume")
    )


DAILY = "daily AS (SELECT o_orderpriority AS series_id, o_orderdate AS ts, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100 / count(*) AS price, max(o_totalprice) AS high, min(o_totalprice) AS low, CAST(count(*) AS DOUBLE) AS volume FROM orders GROUP BY 1, 2)"


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series of all orders by day: series_id, ts, price, high, low."""
    o = table(spark, sf_dir, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    return o.groupBy(F.lit("all").alias("series_id"), F.col("o_orderdate").alias("ts")).agg((F.sum(cents).cast("double") / 100 / F.count("*")).alias("price"), F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"))


DAYS = "days AS (SELECT 'all' AS series_id, o_orderdate AS ts, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100 / count(*) AS price, max(o_totalprice) AS high, min(o_totalprice) AS low FROM orders GROUP BY 2)"


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_id, ts, ret: changes of the daily price."""
    w = Window.partitionBy("series_id").orderBy("ts")
    d = daily(spark, sf_dir)
    return d.select("series_id", "ts", (F.col("price") / F.lag("price").over(w) - 1).alias("ret")).filter("ret IS NOT NULL")


RETURNS = DAILY + ", returns AS (SELECT * FROM (SELECT series_id, ts, price / lag(price) OVER (PARTITION BY series_id ORDER BY ts) - 1 AS ret FROM daily) WHERE ret IS NOT NULL)"


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_id, ts, position: the sign of the five-day change of the daily price, 0 on the first five."""
    w = Window.partitionBy("series_id").orderBy("ts")
    return daily(spark, sf_dir).select("series_id", "ts", F.coalesce(F.signum(F.col("price") - F.lag("price", 5).over(w)), F.lit(0.0)).alias("position"))


POSITIONS = DAILY + ", positions AS (SELECT series_id, ts, CAST(coalesce(sign(price - lag(price, 5) OVER (PARTITION BY series_id ORDER BY ts)), 0) AS DOUBLE) AS position FROM daily)"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_id (one message per user id modulo 4), ts, seq, symbol (event type)."""
    e = table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("m"), F.col("user_id") % 4).alias("series_id"), "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("symbol"))


MESSAGES = "messages AS (SELECT concat('m', user_id % 4) AS series_id, ts, event_id AS seq, event_type AS symbol FROM events)"


def performance(spark: SparkSession, sf_dir: str, multiple: int = 8) -> DataFrame:
    """t, trial_id, ret: daily returns of each order priority, over the largest multiple of `multiple` days that all have; block splits need one, other statistics take all days (1)."""
    w = Window.partitionBy("series_id").orderBy("ts")
    r = returns(spark, sf_dir).select((F.row_number().over(w) - 1).cast("long").alias("t"), F.substring("series_id", 1, 1).cast("int").alias("trial_id"), "ret")
    shared = r.groupBy("trial_id").count().agg(F.min("count").alias("n")).select((F.col("n") - F.col("n") % multiple).alias("n"))
    return r.crossJoin(F.broadcast(shared)).filter("t < n").drop("n")


PERFORMANCE = RETURNS + ", numbered_returns AS (SELECT CAST(row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS BIGINT) AS t, CAST(substr(series_id, 1, 1) AS INTEGER) AS trial_id, ret FROM returns), shared AS (SELECT min(c) - min(c) % 8 AS n FROM (SELECT count(*) AS c FROM numbered_returns GROUP BY trial_id)), performance AS (SELECT t, trial_id, ret FROM numbered_returns, shared WHERE t < n)"


#: The same over all common days.
PERFORMANCE_ALL = PERFORMANCE.replace("min(c) - min(c) % 8", "min(c)")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_id, label_id, t0, t1, trgt, side: each day of the one daily series starts a label of 15 days."""
    w = Window.partitionBy("series_id").orderBy("ts")
    d = days(spark, sf_dir).withColumn("pos", F.row_number().over(w) - 1)
    return d.select("series_id", F.col("pos").cast("long").alias("label_id"), F.col("ts").alias("t0"), (F.col("ts") + F.expr("INTERVAL 15 DAY")).alias("t1"), (F.lit(0.02) + F.col("pos") % 7 * 0.01).alias("trgt"), F.when(F.col("pos") % 3 == 0, -1.0).otherwise(1.0).alias("side"))


LABELS = DAYS + ", numbered AS (SELECT *, CAST(row_number() OVER (ORDER BY ts) - 1 AS BIGINT) AS pos FROM days), labels AS (SELECT series_id, pos AS label_id, ts AS t0, ts + INTERVAL 15 DAY AS t1, CAST(0.02 AS DOUBLE) + pos % 7 * CAST(0.01 AS DOUBLE) AS trgt, CAST(CASE WHEN pos % 3 = 0 THEN -1 ELSE 1 END AS DOUBLE) AS side FROM numbered)"
