"""Decision and publication clocks as Column functions (wall-clock times of a named zone)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_instant(day: Column, hour: Column | int, minute: Column | int, second: Column | int, zone: str) -> Column:
    """The instant at a local time of a day, across clock changes."""
    parts = [x if isinstance(x, Column) else F.lit(x) for x in (hour, minute, second)]
    return F.make_timestamp(F.year(day), F.month(day), F.dayofmonth(day), *parts, F.lit(zone))


def decision_instant(day: Column, change: str, before: tuple[int, int], after: tuple[int, int], zone: str) -> Column:
    """A daily decision time that moved from `before` to `after` (hour, minute) on the day `change`."""
    late = day >= F.lit(change).cast("date")
    return local_instant(
        day, F.when(late, after[0]).otherwise(before[0]), F.when(late, after[1]).otherwise(before[1]), 0, zone
    )


def next_business_day(day: Column) -> Column:
    """The next day that is neither Saturday nor Sunday."""
    return F.date_add(day, F.when(F.dayofweek(day) == 6, 3).when(F.dayofweek(day) == 7, 2).otherwise(1))


def month_calendar(spark: SparkSession, first: str, last: str, zone: str, *, month_end: bool = False) -> DataFrame:
    """(month, cutoff) per month: its first or last day at 23:59:59 local."""
    months = spark.range(1).select(
        F.explode(
            F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 1 month"))
        ).alias("month")
    )
    day = F.last_day("month") if month_end else F.col("month")
    return months.withColumn("cutoff", local_instant(day, 23, 59, 59, zone))


def release_instant(day: Column, variant: Column, zone: str) -> Column:
    """When a release of a day becomes usable: just after ten local time (`registered`), or as the next day begins (`next_day`)."""
    registered = local_instant(day, 10, 0, 1, zone)
    return F.when(variant == "registered", registered).when(variant == "next_day", local_instant(F.date_add(day, 1), 0, 0, 0, zone))
