"""Panels: spines with explicit missing cells, comparison, amendment and audit.

Null-safe comparisons throughout: two nulls are equal. Empty tables give
audits with zero counts and otherwise no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class AuditFailed(RuntimeError):
    """A panel broke a rule; nothing was published."""


def panel_on_spine(spine: DataFrame, observed: DataFrame, keys: Sequence[str], *, value: str, reason: str) -> DataFrame:
    """One row per spine key, explicit about what is missing."""
    joined = spine.join(observed, list(keys), "left")
    return joined.withColumn("is_missing", F.col(value).isNull()).withColumn(
        "missing_reason", F.when(F.col(value).isNull(), F.lit(reason))
    )


def stale_after(panel: DataFrame, *, period: str, origin: str, value: str, months: int) -> DataFrame:
    """Values older than `months` become missing."""
    old = F.months_between(F.col(origin), F.col(period)) > months
    return panel.withColumn("is_stale", F.coalesce(old, F.lit(False))).withColumn(
        value, F.when(~F.col("is_stale"), F.col(value))
    )


def compare(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Full outer comparison: keys, side (both, left, right) and a boolean `<column>_changed` each."""
    a = left.select(*keys, *[F.col(c).alias(f"_l_{c}") for c in columns], F.lit(1).alias("_l"))
    b = right.select(*keys, *[F.col(c).alias(f"_r_{c}") for c in columns], F.lit(1).alias("_r"))
    joined = a.join(b, list(keys), "full_outer")
    side = F.when(F.col("_l").isNull(), "right").when(F.col("_r").isNull(), "left").otherwise("both")
    return joined.select(
        *keys,
        side.alias("side"),
        *[(~F.col(f"_l_{c}").eqNullSafe(F.col(f"_r_{c}"))).alias(f"{c}_changed") for c in columns],
    )


def amend(base: DataFrame, update: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """base with `columns` replaced where update has the key; all other rows as they were."""
    new = update.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_hit"))
    joined = base.join(new, list(keys), "left")
    replaced = {c: F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in columns}
    return joined.withColumns(replaced).withColumn(
        "is_amended", F.coalesce("_hit", F.lit(False))
    ).select(*base.columns, "is_amended")


def audit(
    panel: DataFrame, keys: Sequence[str], *, value: str, known: str | None = None, origin: str | None = None
) -> DataFrame:
    """One row: rows, keys, duplicate keys, missing values, non-finite values and point-in-time violations."""
    per_key = panel.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count(F.when(F.col(value).isNull(), 1)).alias("missing"),
        F.count(F.when(F.isnan(value) | (F.abs(value) == float("inf")), 1)).alias("odd"),
        (F.count(F.when(F.col(known) >= F.col(origin), 1)) if known and origin else F.lit(0)).alias("leaks"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return per_key.agg(
        total("n").alias("n_rows"),
        F.count("*").alias("n_keys"),
        total(F.when(F.col("n") > 1, 1).otherwise(0)).alias("duplicate_keys"),
        total("missing").alias("missing_values"),
        total("odd").alias("non_finite_values"),
        total("leaks").alias("point_in_time_violations"),
    )


def require(audited: DataFrame, rules: dict[str, int]) -> None:
    """Raise AuditFailed if a count of a one-row audit is above its limit."""
    row = audited.first()
    broken = {c: row[c] for c, most in rules.items() if row[c] > most}
    if broken:
        raise AuditFailed(f"limits exceeded: {broken}")


def publish(panel: DataFrame, path: str, audited: DataFrame, rules: dict[str, int]) -> None:
    """Write the panel if its audit passes; never over an existing one."""
    require(audited, rules)
    panel.write.mode("errorifexists").parquet(path)


def complete_months(panel: DataFrame, group: Sequence[str], month: str, observed: str) -> DataFrame:
    """(group, n_months, n_complete, first_complete): months in which every row of the group is observed."""
    by_month = panel.groupBy(*group, month).agg(F.bool_and(observed).alias("_all"))
    return by_month.groupBy(*group).agg(
        F.count("*").alias("n_months"),
        F.count(F.when(F.col("_all"), 1)).alias("n_complete"),
        F.min(F.when(F.col("_all"), F.col(month))).alias("first_complete"),
    )


def chronological_thirds(panel: DataFrame, group: Sequence[str], order: str) -> DataFrame:
    """Adds `third` (0, 1, 2) by order within the group."""
    return panel.withColumn("third", F.ntile(3).over(Window.partitionBy(*group).orderBy(order)) - 1)
