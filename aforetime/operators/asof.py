"""As-of joins: what was known strictly before a decision time.

Versions are turned into validity intervals once (`lead` per key and period);
a decision then matches at most one interval per period by an equi-join on the
key and a range predicate. Deletes end an interval and open none. Equality of
a version's instant and the decision is no knowledge.

Null instants never match, null keys match nothing. Of several versions at one
instant the highest tie breaker holds. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aforetime.storage import neighbour, ordered_blocks


def validity_intervals(
    versions: DataFrame, keys: Sequence[str], *, at: str, tie: str, deleted: Column | None = None
) -> DataFrame:
    """versions with `known_from` and `known_to` (null while current); deletes only end intervals."""
    columns = [c for c in versions.columns if c not in (*keys, at)]
    held = (
        versions.where(F.col(at).isNotNull())
        .withColumn("_deleted", deleted if deleted is not None else F.lit(False))
        .groupBy(*keys, at)
        .agg(F.max_by(F.struct(*columns, "_deleted"), F.coalesce(tie, F.lit(-1))).alias("_row"))
    )
    until = F.lead(at).over(Window.partitionBy(*keys).orderBy(at))
    return (
        held.withColumn("known_to", until)
        .where(~F.col("_row._deleted"))
        .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in columns], F.col(at).alias("known_from"), "known_to")
    )


def as_of(decisions: DataFrame, intervals: DataFrame, on: Sequence[str], decision: str) -> DataFrame:
    """Every (decision row, interval row) pair that was current strictly before the decision.

    The result holds a row for every period that a decision knew, and the join
    meets only as many more as a period has versions. For the newest value
    alone use `known.as_known` or `step_function`, which pair nothing.
    """
    known = (F.col("known_from") < F.col(decision)) & (
        F.col("known_to").isNull() | (F.col(decision) <= F.col("known_to"))
    )
    return decisions.join(intervals, list(on)).where(known)


def level_versions(intervals: DataFrame, keys: Sequence[str], period: str, value: str) -> DataFrame:
    """(keys, period, at, value, tie): the values of intervals as changes for `known.as_known`, withdrawn by a null at their end."""
    held = intervals.where(F.col(value).isNotNull())
    starts = held.select(*keys, period, F.col("known_from").alias("at"), F.col(value).alias("value"), F.unix_micros("known_from").alias("tie"))
    ends = held.where(F.col("known_to").isNotNull()).select(
        *keys, period, F.col("known_to").alias("at"), F.lit(None).cast("double").alias("value"), F.lit(-(2**62)).cast("bigint").alias("tie")
    )
    return starts.unionByName(ends)


def change_versions(
    intervals: DataFrame, keys: Sequence[str], period: str, value: str, *, months: int = 12, log: bool = False
) -> DataFrame:
    """(keys, period, at, change, tie): versions of each period's change over `months`, for `known.as_known`.

    The change is in percent, or 100·log ratio, and known while both ends are:
    from the later of their instants (which is also its tie breaker) until the
    first of them is replaced, where it is withdrawn by a null. Periods whose
    base is missing or zero (for logs: an end not positive) have no change, so
    the newest one that an event knows walks back by itself. Versions are
    paired per key and period, not per key.
    """
    keys = list(keys)
    held = intervals.select(*keys, period, F.col(value).alias("_v"), "known_from", "known_to").where(F.col("_v").isNotNull())
    base = held.select(
        *keys, F.add_months(period, months).alias(period), F.col("_v").alias("_b"), F.col("known_from").alias("_bf"),
        F.col("known_to").alias("_bt"),
    )
    # least and greatest pass over nulls, which mean no end
    both = held.join(base, [*keys, period]).select(
        *keys, period, "_v", "_b", F.greatest("known_from", "_bf").alias("_from"), F.least("known_to", "_bt").alias("_to")
    ).where(F.col("_to").isNull() | (F.col("_from") < F.col("_to")))
    if log:
        both, change = both.where("_v > 0 and _b > 0"), 100 * F.log(F.col("_v") / F.col("_b"))
    else:
        both, change = both.where("_b <> 0"), 100 * (F.col("_v") / F.col("_b") - 1)
    starts = both.select(*keys, period, F.col("_from").alias("at"), change.alias("change"), F.unix_micros("_from").alias("tie"))
    ends = both.where(F.col("_to").isNotNull()).select(
        *keys, period, F.col("_to").alias("at"), F.lit(None).cast("double").alias("change"), F.lit(-(2**62)).cast("bigint").alias("tie")
    )
    return starts.unionByName(ends)


def step_function(
    decisions: DataFrame, steps: DataFrame, on: Sequence[str], *, decision: str, effective: str, inclusive: bool = False,
    unmatched: bool = False,
) -> DataFrame:
    """Decisions with the last step effective strictly before each (`inclusive`: or at it).

    Both are sorted together by key and time in blocks and the last step is
    carried forward, so a key may hold any share of the rows. `unmatched` keeps
    decisions without step. Decisions with a null key or time match nothing.
    """
    on = list(on)
    others = [c for c in steps.columns if c not in on]
    keys = [f"_k{i}" for i in range(len(on))]

    def side(df: DataFrame, time: str, rank: int, **parts: Column) -> DataFrame:
        return df.select(
            *[F.col(c).alias(k) for c, k in zip(on, keys, strict=True)], F.col(time).alias("_at"), F.lit(rank).alias("_rank"),
            F.xxhash64(*df.columns).alias("_tie"), *[p.alias(n) for n, p in parts.items()],
        )

    d, s = F.struct(*decisions.columns), F.struct(*others)
    after, before = (1, 0) if inclusive else (0, 1)
    both = side(decisions, decision, after, _d=d).unionByName(side(steps, effective, before, _s=s), allowMissingColumns=True)
    complete = both.dropna(subset=[*keys, "_at"])
    blocks = ordered_blocks(complete, [*keys, "_at", "_rank", "_tie"], "steps")
    found = neighbour(
        blocks, keys, ["_at", "_rank", "_tie"], ["_s"], after=False, name="_step", among=F.col("_s").isNotNull()
    ).where(F.col("_d").isNotNull())
    if not unmatched:
        return found.where(F.col("_step").isNotNull()).select("_d.*", *[F.col(f"_step._s.{c}").alias(c) for c in others])
    out = found.select("_d.*", *[F.col(f"_step._s.{c}").alias(c) for c in others])
    whole = F.col(decision).isNotNull()
    for c in on:
        whole = whole & F.col(c).isNotNull()
    left = decisions.where(~whole).select("*", *[F.lit(None).cast(steps.schema[c].dataType).alias(c) for c in others])
    return out.unionByName(left)


def tie_conflicts(versions: DataFrame, keys: Sequence[str], at: str, value: str) -> DataFrame:
    """Keys and instants at which several versions disagree."""
    return (
        versions.groupBy(*keys, at)
        .agg(F.count_distinct(value).alias("n_values"), F.count("*").alias("n_rows"))
        .where("n_values > 1")
    )
