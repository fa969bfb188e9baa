"""Cleaned views of the test tables, and the same in SQL, for the reference operators' queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aforetime.functions.months import month_index
from aforetime.functions.numbers import bare
from aforetime.plans.problems import MONTH_SQL
from aforetime.sources.tables import table


def month_date(index):
    """First day of a month index."""
    return F.make_date(F.floor(index / 12).cast("int"), index % 12 + 1, F.lit(1))


def finite(column: str):
    """The column's finite values, else null."""
    return F.when(F.abs(F.col(column)) < float("inf"), F.col(column))


def panel(spark: SparkSession, folder: str) -> DataFrame:
    """One row per panel, series and month: the row with the highest row_id, its value where it is a finite reading."""
    reading = F.lower(bare(F.col("is_missing"))).isin("0", "false")
    index = month_index(F.col("origin_month"))
    rows = table(spark, folder, "panel_rows").select(
        "panel_id", "series_id", month_date(index).alias("month"), "row_id", "origin_timestamp",
        month_date(month_index(F.col("observation_period"))).alias("observed_month"),
        F.when(reading, finite("transformed_value")).alias("value"), "missing_reason",
    )
    columns = ["row_id", "origin_timestamp", "observed_month", "value", "missing_reason"]
    return (
        rows.groupBy("panel_id", "series_id", "month")
        .agg(F.max_by(F.struct(*columns), "row_id").alias("r"))
        .select("panel_id", "series_id", "month", *[F.col(f"r.{c}").alias(c) for c in columns])
    )


PANEL_SQL = f"""panel AS (
  SELECT panel_id, series_id, CAST({MONTH_SQL.format("origin_month")} || '-01' AS DATE) AS month, row_id, origin_timestamp,
         CAST({MONTH_SQL.format("observation_period")} || '-01' AS DATE) AS observed_month,
         CASE WHEN lower(trim(is_missing)) IN ('0', 'false') AND isfinite(transformed_value) THEN transformed_value END AS value,
         missing_reason
  FROM panel_rows
  QUALIFY row_number() OVER (PARTITION BY panel_id, series_id, month ORDER BY row_id DESC) = 1)"""


def versions(spark: SparkSession, folder: str) -> DataFrame:
    """Versioned values with dates, a delete flag and finite values only."""
    return table(spark, folder, "versioned_value").select(
        "row_id", "ref_area", "series_id", F.to_date(F.concat("period", F.lit("-01"))).alias("period"),
        finite("value").alias("value"), "usable_at",
        (F.lower(bare(F.coalesce("action", F.lit("")))) == "delete").alias("is_delete"),
    )


VERSIONS_SQL = """versions AS (
  SELECT row_id, ref_area, series_id, CAST(period || '-01' AS DATE) AS period,
         CASE WHEN isfinite(value) THEN value END AS value, usable_at,
         lower(trim(coalesce(action, ''))) = 'delete' AS is_delete
  FROM versioned_value
  QUALIFY row_number() OVER (PARTITION BY ref_area, series_id, period, usable_at ORDER BY row_id DESC) = 1)"""


def monthly_prices(spark: SparkSession, folder: str) -> DataFrame:
    """(month, series, value): mean order price in thousands per priority and month, cut to whole cents."""
    return (
        table(spark, folder, "orders")
        .groupBy(
            F.to_date(F.date_trunc("month", "o_orderdate")).alias("month"), F.col("o_orderpriority").alias("series")
        )
        .agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"), F.count("*").alias("n"))
        .select("month", "series", (F.floor(F.col("cents") / F.col("n")) / 100_000).alias("value"))
    )


PRICES_SQL = """prices AS (
  SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_orderpriority AS series,
         floor(sum(CAST(round(o_totalprice * 100) AS BIGINT)) / count(*)) / 100000 AS value
  FROM orders GROUP BY ALL)"""
