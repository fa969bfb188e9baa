"""Attributes as known at event time.

Events and attribute changes are unioned, sorted by entity and time, and the
last known attributes are carried forward. At one instant events come before
changes (a change must be known strictly before the event), changes by their
tie breaker.

An attribute value belongs to a period and is revised or withdrawn; what is
carried forward is the current value of every period, and an event takes the
newest period that has one.

Defined results
---------------
* Events without a time, and events or changes with a null in an entity key,
  match nothing; changes without a time were never known.
* A null or NaN value withdraws the period's value. A change without period is
  left out.
* Repeated rows: the highest tie breaker at an instant holds.
* An event for which nothing is known gives no row; an event given twice gives
  two rows. Empty tables give no rows. Further columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aforetime.storage import BLOCK, block_count, ordered_blocks

EVENT, CHANGE = 0, 1


def _carried(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """For entities that span blocks: each later block's opening state, one row per period known by then."""
    spans = (
        blocks.groupBy(BLOCK)
        .agg(F.min(F.struct(*keys)).alias("lo"), F.max(F.struct(*keys)).alias("hi"))
        .select(BLOCK, F.explode(F.array_distinct(F.array("lo", "hi"))).alias("k"))
        .groupBy("k")
        .agg(F.count("*").alias("n"), F.max(BLOCK).alias("last_blk"))
        .where("n > 1")  # at most one such entity begins in a block
        .select("k.*", "last_blk")
    )
    latest = (
        blocks.where(F.col("kind") == CHANGE)
        .join(F.broadcast(spans), keys)
        .groupBy(*keys, "period", BLOCK, "last_blk")
        .agg(F.max_by(F.struct("ref", "value"), F.struct("at", "tie")).alias("s"))
    )
    until = F.lead(BLOCK).over(Window.partitionBy(*keys, "period").orderBy(BLOCK))
    return (
        latest.withColumn("until", F.coalesce(until, F.col("last_blk")))
        .where(F.col("until") > F.col(BLOCK))
        .select(
            *keys,
            "period",
            F.lit(-(2**62)).alias("at"),
            F.lit(CHANGE).alias("kind"),
            F.lit(0).cast("bigint").alias("tie"),
            F.col("s.ref").alias("ref"),
            F.lit(None).cast("string").alias("event"),
            F.col("s.value").alias("value"),
            F.explode(F.sequence(F.col(BLOCK) + 1, F.col("until"))).alias(BLOCK),
        )
    )


def _carry_forward(keys: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        entity: tuple | None = None
        held: dict[int, tuple[int, float]] = {}
        newest: list[int] = []
        for batch in batches:
            out: list[tuple[str, int, int, float]] = []
            columns = [batch[c].tolist() for c in [BLOCK, *keys]]
            for *key, kind, period, ref, event, value in zip(
                *columns, *(batch[c].tolist() for c in ("kind", "period", "ref", "event", "value")), strict=True
            ):
                if (now := tuple(key)) != entity:
                    entity, held, newest = now, {}, []
                if kind == CHANGE:
                    period = int(period)
                    if value == value and value is not None:
                        if period not in held:
                            heapq.heappush(newest, -period)
                        held[period] = (int(ref), value)
                    elif period in held:
                        del held[period]
                else:
                    while newest and -newest[0] not in held:
                        heapq.heappop(newest)
                    if newest:
                        out.append((event, -newest[0], *held[-newest[0]]))
            yield pd.DataFrame(out, columns=["event", "period", "ref", "value"])

    return run


def as_known(
    events: DataFrame,
    changes: DataFrame,
    keys: Sequence[str],
    *,
    event_id: str,
    event_time: str,
    change_time: str,
    period: str,
    value: str,
    tie: str = "row_id",
) -> DataFrame:
    """(event id, tie breaker, period, value) of the attribute row that each event may use.

    `event_id` is a string column, `period` a date column and `tie` a bigint.
    """
    keys = list(keys)
    key_columns = [F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]
    names = [f"k{i}" for i in range(len(keys))]
    left = events.select(
        *key_columns,
        F.lit(None).cast("int").alias("period"),
        F.unix_micros(event_time).alias("at"),
        F.lit(EVENT).alias("kind"),
        F.xxhash64(event_id).alias("tie"),
        F.lit(None).cast("bigint").alias("ref"),
        F.col(event_id).alias("event"),
        F.lit(None).cast("double").alias("value"),
    )
    right = changes.where(F.col(period).isNotNull()).select(
        *key_columns,
        F.unix_date(period).alias("period"),
        F.unix_micros(change_time).alias("at"),
        F.lit(CHANGE).alias("kind"),
        F.col(tie).alias("tie"),
        F.col(tie).alias("ref"),
        F.lit(None).cast("string").alias("event"),
        F.col(value).cast("double").alias("value"),
    )
    both = left.unionByName(right).dropna(subset=["at", *names])
    order = ["at", "kind", "tie"]
    blocks = ordered_blocks(both, [*names, *order], "known")
    opened = blocks.unionByName(_carried(blocks, names))
    # a block is a task of its own
    sorted_rows = opened.repartitionById(block_count(both), BLOCK).sortWithinPartitions(BLOCK, *names, *order)
    found = sorted_rows.mapInPandas(
        _carry_forward(names), "event string, period int, ref bigint, value double"
    )
    return found.select(
        F.col("event").alias(event_id),
        F.col("ref").alias(tie),
        F.date_from_unix_date("period").alias(period),
        F.col("value").alias(value),
    )
