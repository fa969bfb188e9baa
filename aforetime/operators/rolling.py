"""Expanding and rolling histories that never include the current row.

The windows of histories are per series and ordered by time, so a series is one
task; series are rows per period, a few hundred each. Episodes and sessions run
over raw events, of which one group may hold any share: they are cut by running
sums in blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from aforetime.storage import neighbour, ordered_blocks, running_sums, written

MIN_SCALE = 1e-8
MIN_VARIANCE = 0.05


def history_window(group: Sequence[str], order: str, length: int | None = None) -> WindowSpec:
    """All earlier rows, or the `length` last ones."""
    start = Window.unboundedPreceding if length is None else -length
    return Window.partitionBy(*group).orderBy(order).rowsBetween(start, -1)


def standardised(value: Column, window: WindowSpec, least: int) -> Column:
    """Value against the mean and population deviation of its history; null before `least` observations.

    A history that doesn't vary is scaled by one.
    """
    scale = F.stddev_pop(value).over(window)
    z = (value - F.avg(value).over(window)) / F.when(scale < MIN_SCALE, 1.0).otherwise(scale)
    return F.when(F.count(value).over(window) >= least, z)


def gaussian_log_score(value: Column, window: WindowSpec, least: int) -> Column:
    """Log density of the value under the normal distribution of its history (variance floored)."""
    mean, variance = F.avg(value).over(window), F.greatest(F.var_pop(value).over(window), F.lit(MIN_VARIANCE))
    score = -0.5 * (F.log(2 * F.pi() * variance) + (value - mean) ** 2 / variance)
    return F.when(F.count(value).over(window) >= least, score)


def future_any(flag: Column, group: Sequence[str], order: str, horizon: int) -> Column:
    """Whether the flag is set in the next `horizon` rows; null where they don't all exist."""
    ahead = Window.partitionBy(*group).orderBy(order)
    any_ahead = F.max(flag.cast("int")).over(ahead.rowsBetween(1, horizon)) == 1
    return F.when(F.lead(F.lit(1), horizon).over(ahead).isNotNull(), any_ahead)


def lag_one_coefficient(
    panel: DataFrame, group: Sequence[str], order: str, value: str, limit: float = 0.98
) -> DataFrame:
    """(group, phi, n_pairs): autoregression of order one without intercept, clipped."""
    w = Window.partitionBy(*group).orderBy(order)
    pairs = panel.withColumn("_lag", F.lag(value).over(w)).where(F.col(value).isNotNull() & F.col("_lag").isNotNull())
    phi = F.sum(F.col(value) * F.col("_lag")) / F.sum(F.col("_lag") ** 2)
    return pairs.groupBy(*group).agg(
        F.greatest(F.least(phi, F.lit(limit)), F.lit(-limit)).alias("phi"), F.count("*").alias("n_pairs")
    )


def breach_episodes(
    panel: DataFrame, group: Sequence[str], order: str, breach: str, *, onset: int = 3, recovery: int = 3
) -> DataFrame:
    """Episodes of persistent breaches: (group, episode, first, last, n_breaches, is_open).

    An episode starts with the first of `onset` consecutive breaches and ends
    before the first run of `recovery` stable rows. Runs of stable rows that
    long separate segments; a segment's first long breach run opens its
    episode. Null flags count as stable.
    """
    keys = list(group)
    one = F.lit(1).cast("bigint")
    flagged = panel.select(*keys, order, F.coalesce(breach, F.lit(False)).alias("_b")).withColumns(
        {"_one": one, "_hit": F.col("_b").cast("bigint")}
    )
    numbered = running_sums(flagged, keys, [order], {"_i": "_one", "_upto": "_hit"}, "breaches")
    # constant along a run: the rows of the other kind so far
    run = F.when(F.col("_b"), F.col("_i") - F.col("_upto")).otherwise(F.col("_upto"))
    runs = numbered.groupBy(*keys, "_b", run.alias("_run")).agg(
        F.count("*").alias("_size"), F.min("_i").alias("_at"), F.max("_i").alias("_end"),
        F.min(order).alias("first"), F.max(order).alias("last"),
    )
    runs = written(runs, "runs")  # sorting by ranges reads its input twice
    separates = (~F.col("_b") & (F.col("_size") >= recovery)).cast("bigint")
    segments = written(running_sums(runs.withColumn("_sep", separates), keys, ["_at"], {"_segment": "_sep"}, "segments"), "segments")
    opens = (F.col("_b") & (F.col("_size") >= onset)).cast("bigint")
    cut = segments.where("_sep = 0").withColumn("_opens", opens)
    inside = running_sums(cut, [*keys, "_segment"], ["_at"], {"_opened": "_opens"}, "episodes").where("_opened > 0")
    found = written(inside.groupBy(*keys, "_segment").agg(
        F.min("first").alias("first"), F.max("last").alias("last"),
        F.sum(F.when(F.col("_b"), F.col("_size")).otherwise(0)).alias("n_breaches"), F.max("_end").alias("_end"),
    ), "found")
    counted = running_sums(found.withColumn("_one", one), keys, ["first"], {"episode": "_one"}, "numbers")
    sizes = segments.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.max("_end").alias("_n"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return counted.join(sizes, same).select(
        *keys, "episode", "first", "last", "n_breaches", (F.col("_end") == F.col("_n")).alias("is_open")
    )


def sessions(rows: DataFrame, group: Sequence[str], at: str, gap: str) -> DataFrame:
    """(group, session, first, last, n): rows of a group that follow each other in less than the interval `gap`.

    Rows without time or with a null in the group are left out.
    """
    keys = list(group)
    blocks = ordered_blocks(rows.select(*keys, at).dropna().groupBy(*keys, at).agg(F.count("*").alias("_n")), [*keys, at], "sessions")
    before = neighbour(blocks, keys, [at], [at], after=False, name="_before")
    fresh = F.col("_before").isNull() | (F.col(at) >= F.col(f"_before.{at}") + F.expr(f"interval {gap}"))
    marked = before.select(*keys, at, "_n", fresh.cast("bigint").alias("_fresh"))
    return running_sums(marked, keys, [at], {"session": "_fresh"}, "sessions").groupBy(*keys, "session").agg(
        F.min(at).alias("first"), F.max(at).alias("last"), F.sum("_n").alias("n")
    )
