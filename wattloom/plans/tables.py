"""The given tables seen as load series. Each view is one lazy plan over the parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.types import StructType

from wattloom.params import Params

# Series by supplier are a few hundred days long; the cuts below keep every operator busy.
SUPPLIER = Params(min_len=300, train_frac=0.7, backcast=72, forecast=24, block_strides=16,
                  order_span_seconds=366 * 86400)
# Weekly-sized windows of the default width on the same series.
SUPPLIER_WIDE = Params(min_len=400, block_strides=8, order_span_seconds=366 * 86400)
NATION = Params(order_span_seconds=366 * 86400, block_strides=16)
HOURLY = Params(min_len=200, backcast=72, forecast=24, order_span_seconds=512 * 3600, block_strides=8)


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables. Its schema is read once, so building a plan starts no job."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def daily(spark: SparkSession, sf_dir: str, level: str = "supplier") -> DataFrame:
    """Shipped quantity per day. ``level`` supplier: one series per supplier; nation: per nation."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", "l_shipdate")
    su = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    na = table(spark, sf_dir, "nation")
    re = table(spark, sf_dir, "region")
    ts = F.col("l_shipdate").cast("date").cast("timestamp_ntz").alias("ts")
    names = (
        su.join(na, F.col("s_nationkey") == F.col("n_nationkey")).join(re, F.col("n_regionkey") == F.col("r_regionkey"))
        .select("s_suppkey", F.col("r_name").alias("grp"), F.col("s_name" if level == "supplier" else "n_name").alias("building"))
    )
    if level == "supplier":
        # a supplier has one name of its own, so summing by key is final and names are looked up after
        per = li.groupBy("l_suppkey", ts).agg(F.sum("l_quantity").alias("energy"))
        return per.join(names, F.col("l_suppkey") == F.col("s_suppkey")).select("grp", "building", "ts", "energy")
    # days of a nation collapse before the shuffle
    return li.join(names, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("grp", "building", ts).agg(
        F.sum("l_quantity").alias("energy")
    )


DAILY_SQL = """
daily AS (
  SELECT r_name AS grp, {building} AS building, date_trunc('day', l_shipdate)::TIMESTAMP AS ts,
         sum(l_quantity) AS energy
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY 1, 2, 3)"""


def daily_sql(level: str = "supplier") -> str:
    return DAILY_SQL.format(building="s_name" if level == "supplier" else "n_name")


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings with duplicates and missing values: events by type, cut to the hour."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.lit("events").alias("grp"),
        F.col("event_type").alias("building"),
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"),
        F.when(F.col("event_id") % 97 != 0, F.col("value")).alias("energy"),
        F.col("event_id").alias("ord"),
    )


RAW_EVENTS_SQL = """
raw_events AS (
  SELECT 'events' AS grp, event_type AS building, date_trunc('hour', ts)::TIMESTAMP AS ts,
         CASE WHEN event_id % 97 <> 0 THEN value END AS energy, event_id AS ord
  FROM events)"""


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly load per event type, missing hours absent."""
    ev = table(spark, sf_dir, "events")
    return ev.groupBy(
        F.lit("events").alias("grp"), F.col("event_type").alias("building"),
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"),
    ).agg(F.sum("value").alias("energy"))


HOURLY_SQL = """
hourly AS (
  SELECT 'events' AS grp, event_type AS building, date_trunc('hour', ts)::TIMESTAMP AS ts, sum(value) AS energy
  FROM events GROUP BY 1, 2, 3)"""


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly load per event type and user: many sparse series; their number grows with the data."""
    ev = table(spark, sf_dir, "events")
    return ev.groupBy(
        F.col("event_type").alias("grp"), F.concat(F.lit("user_"), F.col("user_id")).alias("building"),
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"),
    ).agg(F.sum("value").alias("energy"))


USERS_SQL = """
users AS (
  SELECT event_type AS grp, 'user_' || user_id AS building, date_trunc('hour', ts)::TIMESTAMP AS ts,
         sum(value) AS energy
  FROM events GROUP BY 1, 2, 3)"""


def indexed_sql(source: str, min_len: int = 0) -> str:
    """CTE ``series``: trimmed and numbered rows of a source CTE that has no duplicates."""
    return f"""
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY grp, building ORDER BY ts NULLS LAST) - 1 AS rn FROM {source}),
ends AS (
  SELECT grp, building, min(rn) FILTER (WHERE energy IS NOT NULL) AS lo,
         max(rn) FILTER (WHERE energy IS NOT NULL) AS hi
  FROM numbered GROUP BY grp, building),
series AS (
  SELECT grp, building, ts, energy, rn - lo AS t, hi - lo + 1 AS n
  FROM numbered JOIN ends USING (grp, building)
  WHERE rn BETWEEN lo AND hi AND hi - lo + 1 >= {min_len})"""
