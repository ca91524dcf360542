"""Scene-shaped tables that Spark derives from the given tables, and the same in SQL.

Every row of the source table appears, so the work grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnscope.plans.registry import load


def products(spark: SparkSession, sf: str) -> DataFrame:
    """One product name per order: platform, tile, sensing, baseline, orbit, generation."""
    o = load(spark, sf, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    df = o.select(
        k.alias("k"),
        c.alias("c"),
        F.col("o_orderstatus").alias("st"),
        F.col("o_totalprice").alias("price"),
        F.expr("substr('ABCD', cast(o_orderkey % 4 as int) + 1, 1)").alias("letter"),
        F.concat((c % 25 + 1).cast("string"), F.lit("SGJ")).alias("short_tile"),
        F.expr("o_orderdate + make_dt_interval(0, 0, 0, cast(o_orderkey * 7919 % 86400 as int))").alias(
            "sensing_ts"
        ),
        F.lpad((200 + k % 12).cast("string"), 4, "0").alias("baseline4"),
        F.lpad((k % 143 + 1).cast("string"), 3, "0").alias("orbit3"),
    )
    df = df.withColumns(
        {
            "platform": F.concat(F.lit("S2"), F.col("letter")),
            "tile": F.lpad("short_tile", 5, "0"),
            "sensing": F.date_format("sensing_ts", "yyyyMMdd'T'HHmmss"),
            "generation_ts": F.expr("sensing_ts + make_dt_interval(0, cast(k % 97 as int), 0, 0)"),
        }
    )
    df = df.withColumn("generation", F.date_format("generation_ts", "yyyyMMdd'T'HHmmss"))
    return df.withColumn(
        "product",
        F.concat(
            "platform", F.lit("_MSIAQR_"), "sensing", F.lit("_N"), "baseline4", F.lit("_R"),
            "orbit3", F.lit("_T"), "tile", F.lit("_"), "generation",
        ),
    )


PRODUCTS = """products0 AS (
  SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS st, o_totalprice AS price,
    substr('ABCD', CAST(o_orderkey % 4 AS INT) + 1, 1) AS letter,
    CAST(o_custkey % 25 + 1 AS VARCHAR) || 'SGJ' AS short_tile,
    o_orderdate + to_seconds(CAST(o_orderkey * 7919 % 86400 AS BIGINT)) AS sensing_ts,
    lpad(CAST(200 + o_orderkey % 12 AS VARCHAR), 4, '0') AS baseline4,
    lpad(CAST(o_orderkey % 143 + 1 AS VARCHAR), 3, '0') AS orbit3
  FROM orders),
products1 AS (
  SELECT *, 'S2' || letter AS platform, lpad(short_tile, 5, '0') AS tile,
    strftime(sensing_ts, '%Y%m%dT%H%M%S') AS sensing,
    sensing_ts + to_hours(CAST(k % 97 AS BIGINT)) AS generation_ts
  FROM products0),
products AS (
  SELECT *, strftime(generation_ts, '%Y%m%dT%H%M%S') AS generation,
    platform || '_MSIAQR_' || sensing || '_N' || baseline4 || '_R' || orbit3 || '_T' || tile
      || '_' || strftime(generation_ts, '%Y%m%dT%H%M%S') AS product
  FROM products1)"""


def acquisitions(spark: SparkSession, sf: str) -> DataFrame:
    """Catalog rows per order with the archives that list them: reference holds all, the
    primary those of status O or P, the fallback those of status F above a price."""
    o = load(spark, sf, "orders")
    letter = F.expr("substr('abc', cast(o_orderkey % 3 as int) + 1, 1)")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return o.select(
        F.concat(F.lit("T"), F.lpad((F.col("o_custkey") % 25).cast("string"), 2, "0")).alias("tile"),
        F.date_format("o_orderdate", "yyyy-MM").alias("month"),
        F.concat(day, F.lit("/"), letter).alias("key"),
        F.lit(True).alias("in_reference"),
        F.col("o_orderstatus").isin("O", "P").alias("in_primary"),
        ((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 250000)).alias("in_fallback"),
        F.col("o_orderkey").alias("item"),
        F.substring("o_orderpriority", 1, 1).alias("baseline"),
        (F.col("o_orderkey") % 2 == 0).alias("offset_applied"),
        (F.floor(F.col("o_totalprice")) % 101).cast("bigint").alias("cover"),
        F.col("o_orderdate").alias("sensed"),
    )


ACQUISITIONS = """acquisitions AS (
  SELECT 'T' || lpad(CAST(o_custkey % 25 AS VARCHAR), 2, '0') AS tile,
    strftime(o_orderdate, '%Y-%m') AS month,
    strftime(o_orderdate, '%Y-%m-%d') || '/' || substr('abc', CAST(o_orderkey % 3 AS INT) + 1, 1) AS key,
    TRUE AS in_reference, o_orderstatus IN ('O', 'P') AS in_primary,
    (o_orderstatus = 'F' AND o_totalprice > 250000) AS in_fallback,
    o_orderkey AS item, substr(o_orderpriority, 1, 1) AS baseline,
    o_orderkey % 2 = 0 AS offset_applied,
    CAST(floor(o_totalprice) AS BIGINT) % 101 AS cover, o_orderdate AS sensed
  FROM orders),
spine AS (
  SELECT t.tile, strftime(m, '%Y-%m') AS month
  FROM (SELECT DISTINCT tile FROM acquisitions) t,
    (SELECT unnest(generate_series(date_trunc('month', (SELECT min(sensed) FROM acquisitions)),
       date_trunc('month', (SELECT max(sensed) FROM acquisitions)), INTERVAL 1 MONTH)) AS m))"""
