"""Panels from tables: daily bars of events and of shipments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bar per day and event type: open and close are the values at the first and last (ts, event_id), volume counts."""
    at = F.struct("ts", "event_id")
    return (
        table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("date"), F.col("event_type").alias("ticker"))
        .agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))
    )


def _ship(lines: DataFrame, date, ticker) -> DataFrame:
    p = F.col("l_extendedprice") / F.col("l_quantity")
    return lines.groupBy(date.alias("date"), ticker.alias("ticker")).agg(
        F.avg(p).alias("close"), F.max(p).alias("high"), F.min(p).alias("low"), F.percentile(p, F.lit(0.5)).alias("open"), F.sum("l_quantity").alias("volume")
    )


def ship_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ship(table(spark, sf_dir, "lineitem"), F.to_date("l_shipdate"), F.col("l_returnflag"))


def _located(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))


def ship_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _located(spark, sf_dir).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return _ship(lines, F.to_date("l_shipdate"), F.col("r_name"))


def ship_nation_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ship(_located(spark, sf_dir), F.to_date(F.date_trunc("week", F.col("l_shipdate"))), F.col("n_name"))


def read_panel_csv(spark: SparkSession, path: str, schema: str = "date date, ticker string, close double", date_format: str = "yyyy-MM-dd") -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("dateFormat", date_format).csv(path)


def wide_to_long(df: DataFrame, value_col: str = "ret", date_col: str = "date") -> DataFrame:
    return df.unpivot(date_col, [c for c in df.columns if c != date_col], "ticker", value_col)
