"""Views of the driver's tables as scans, points and results.

``points``: suppliers are frames, and a line item is a return. ``results``: users are recordings, events are scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The order of returns in a frame; rows that tie in it are equal in every column.
POINT_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, ring, x, y, z) without an order of returns: no shuffle."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("frame"), F.col("l_linenumber").alias("ring"), (F.col("l_extendedprice") / 1000).alias("x"), ((F.col("l_discount") - 0.05) * 40).alias("y"), (F.col("l_quantity") / 10).alias("z"),
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, point_id, ring, x, y, z): ``point_id`` numbers the returns of a frame in decoded order."""
    # Numbered first and named after, so each column is shuffled once and what follows by frame finds it dealt by frame.
    ordered = table(spark, sf_dir, "lineitem").withColumn("point_id", F.row_number().over(W.partitionBy("l_suppkey").orderBy(*POINT_ORDER)).cast("long"))
    return ordered.select(
        F.col("l_suppkey").alias("frame"), "point_id", F.col("l_linenumber").alias("ring"),
        (F.col("l_extendedprice") / 1000).alias("x"), ((F.col("l_discount") - 0.05) * 40).alias("y"), (F.col("l_quantity") / 10).alias("z"),
    )


def micros(df: DataFrame, col: str) -> Column:
    """Microseconds since 1970 of a timestamp column, with or without a time zone."""
    if dict(df.dtypes)[col] == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{col}`)")
    return F.unix_micros(F.col(col))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(bag, frame, ns, status, value, k): one row per scan of a recording."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("bag"), F.col("event_id").alias("frame"), (micros(e, "ts") * 1000).alias("ns"), F.col("event_type").alias("status"), "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


#: The same views in SQL.
POINTS_SQL = f"""p AS (SELECT l_suppkey AS frame, row_number() OVER (PARTITION BY l_suppkey ORDER BY {', '.join(POINT_ORDER)}) AS point_id,
  l_linenumber AS ring, l_extendedprice / 1000 AS x, (l_discount - 0.05) * 40 AS y, l_quantity / 10 AS z FROM lineitem)"""
RESULTS_SQL = """r AS (SELECT user_id AS bag, event_id AS frame, epoch_us(ts) * 1000 AS ns, event_type AS status, value,
  json_extract_string(props, '$.k')::INTEGER AS k FROM events)"""
