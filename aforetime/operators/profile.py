"""Column-level data quality profile of a table that is loaded again and again.

The cells are unpivoted and counted per (column, load, value), so that a value
shared by many rows is one row; the counts are range-sorted by column and
value. Prefix counts of the blocks give exact quantiles, and the loads' merged
cumulative curves the exact Kolmogorov–Smirnov distance between a load and the
one before it, along with the largest change of a single value's share.

Numeric columns are profiled three times: as text, as `column#number` and as
`column#magnitude` (absolute numbers).

Defined results
---------------
* Null and empty (or blank) cells are empty; they count for the empty share
  only. Where a column has no other cells its shares, quantiles and distances
  are null or 0.
* Quantiles are nearest-rank. A load's predecessor is the next lower load that
  occurs; the first load has no changes. Rows without load are left out.
* Repeated rows count as often as they occur. An empty table gives no rows.
  Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aforetime.functions.numbers import bare, finite_number
from aforetime.storage import BLOCK, ordered_blocks, shuffle_parts, small_side

QUANTILES = (0.25, 0.5, 0.75)
NUMBER, MAGNITUDE = "#number", "#magnitude"


def violations(rows: DataFrame, key: str, rules: dict[str, Column], *keep: str) -> DataFrame:
    """(key, column_name) of every cell that breaks its column's rule.

    A rule is true for a cell of the right form; null counts as broken.
    """
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(c)) for c, ok in rules.items()]))
    return rows.select(key, *keep, F.explode(broken).alias("column_name"))


def value_counts(rows: DataFrame, load: str, columns: Sequence[str], numeric: Sequence[str]) -> DataFrame:
    """(column_name, load, cell, num, n): how often a load holds a value; empty cells as one null value."""
    parts: list[tuple[Column, Column, Column]] = []
    for c in columns:
        parts.append((F.lit(c), F.col(c), F.lit(None).cast("double")))
        if c in numeric:
            parts.append((F.lit(c + NUMBER), F.lit(None).cast("string"), F.col(f"_{c}")))
            parts.append((F.lit(c + MAGNITUDE), F.lit(None).cast("string"), F.abs(F.col(f"_{c}"))))
    typed = rows.where(F.col(load).isNotNull()).select(
        F.col(load).alias("load"),
        *[F.when(bare(F.col(c)) != "", F.col(c)).alias(c) for c in columns],
        *[finite_number(F.col(c)).alias(f"_{c}") for c in numeric],
    )
    stacked = typed.select(
        "load", F.stack(F.lit(len(parts)), *[x for p in parts for x in p]).alias("column_name", "cell", "num")
    )
    return stacked.groupBy("column_name", "load", "cell", "num").agg(F.count("*").alias("n"))


def _curves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per block, column and load: change of the cumulative curves and the quantiles that fall into the block."""

    def segment(frame: pd.DataFrame) -> Iterator[tuple]:
        block, column = int(frame[BLOCK].iat[0]), frame["column_name"].iat[0]
        value = frame["vid"].to_numpy() - frame["vid"].iat[0]
        load, share = frame["load_no"].to_numpy(), frame["share"].to_numpy(dtype=float)
        n, before, whole = (frame[c].to_numpy(dtype=np.int64) for c in ("n", "n_before", "filled"))
        num = frame["num"].to_numpy(dtype=float)
        by_load = np.argsort(load, kind="stable")
        loads, starts = np.unique(load[by_load], return_index=True)
        rows_of = dict(zip(loads.tolist(), np.split(by_load, starts[1:]), strict=True))
        width = int(value[-1]) + 1

        def weights(at: int) -> np.ndarray:
            rows = rows_of.get(at)
            return np.zeros(width) if rows is None else np.bincount(value[rows], share[rows], width)

        for now in sorted({*rows_of, *(x + 1 for x in rows_of)} - {0}):
            change = weights(now) - weights(now - 1)
            running = np.cumsum(change)
            yield block, column, now, running[-1], running.max(), running.min(), np.abs(change).max(), None, None
        if column.endswith((NUMBER, MAGNITUDE)):
            for at, rows in rows_of.items():
                reached = before[rows[0]] + np.cumsum(n[rows])
                for q in QUANTILES:
                    target = max(1, int(np.ceil(q * whole[rows[0]])))
                    if before[rows[0]] < target <= reached[-1]:
                        yield block, column, at, None, None, None, None, q, num[rows[np.searchsorted(reached, target)]]

    names = ["blk", "column_name", "load_no", "total", "high", "low", "jump", "q", "value"]
    pending: list[pd.DataFrame] = []

    def flush() -> pd.DataFrame:
        whole = pd.concat(pending, ignore_index=True)
        cut = np.flatnonzero(
            (whole[BLOCK].diff() != 0) | (whole["column_name"] != whole["column_name"].shift())
        ).tolist()
        parts = zip(cut, [*cut[1:], len(whole)], strict=True)
        return pd.DataFrame([row for a, b in parts for row in segment(whole.iloc[a:b])], columns=names)

    for batch in batches:
        if not len(batch):
            continue
        if pending and batch[BLOCK].iat[0] != pending[-1][BLOCK].iat[-1]:
            yield flush()
            pending = []
        pending.append(batch)
        first, last = batch[BLOCK].iat[0], batch[BLOCK].iat[-1]
        if first != last:  # all blocks but the last are whole
            tail = batch[batch[BLOCK] == last]
            pending[-1] = batch[batch[BLOCK] != last]
            yield flush()
            pending = [tail]
    if pending:
        yield flush()


def column_profile(rows: DataFrame, load: str, columns: Sequence[str], numeric: Sequence[str] = ()) -> DataFrame:
    """One row per load and column: counts, empty share, distincts, extremes, quantiles and changes since the load before.

    `numeric` names the columns (of text) that are profiled as numbers too;
    all `columns` are text.
    """
    counts = value_counts(rows, load, columns, numeric)
    order = ["column_name", "num", "cell"]
    blocks = ordered_blocks(counts, order, "profile")
    filled = F.col("cell").isNotNull() | F.col("num").isNotNull()
    # one row per column and load from here on, whatever the number of cells
    totals = blocks.groupBy("column_name", "load").agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(filled, F.col("n"))), F.lit(0)).alias("filled"),
        F.count(F.when(filled, 1)).alias("n_distinct"),
        F.min("cell").alias("min_text"),
        F.max("cell").alias("max_text"),
        F.min("num").alias("min_number"),
        F.max("num").alias("max_number"),
    )
    totals = totals.withColumn("load_no", F.dense_rank().over(Window.partitionBy("column_name").orderBy("load")) - 1)
    per_block = blocks.where(filled).groupBy(BLOCK, "column_name", "load").agg(F.sum("n").alias("n_block"))
    earlier = Window.partitionBy("column_name", "load").orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    prefix = per_block.select(
        BLOCK, "column_name", "load", F.coalesce(F.sum("n_block").over(earlier), F.lit(0)).alias("n_before")
    ).join(totals.select("column_name", "load", "load_no", "filled"), ["column_name", "load"])
    # a column begins in one block, so blocks and columns bound the rows of the prefix table per load
    n_loads = rows.select(load).distinct().count()
    most = (shuffle_parts(rows.sparkSession) + len(columns) + 2 * len(numeric)) * n_loads
    placed = (
        blocks.where(filled)
        .withColumn("vid", F.dense_rank().over(Window.partitionBy(BLOCK).orderBy(*order)))
        .join(small_side(prefix, most), [BLOCK, "column_name", "load"])
        .select(
            BLOCK, "column_name", "vid", "num", "load_no", "n", "n_before", "filled",
            (F.col("n") / F.col("filled")).alias("share")
        )
    )
    curves = placed.mapInPandas(
        _curves,
        "blk int, column_name string, load_no int, total double, high double, low double, jump double, q double, value double",
    )
    at_block = Window.partitionBy("column_name", "load_no", F.col("q").isNull()).orderBy("blk")
    offset = F.coalesce(F.sum("total").over(at_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    summed = (
        curves.withColumn("offset", offset)
        .groupBy("column_name", "load_no")
        .agg(
            F.max(
                F.greatest(F.abs(F.col("offset") + F.col("high")), F.abs(F.col("offset") + F.col("low")))
            ).alias("ks_distance"),
            F.max("jump").alias("value_share_change"),
            *[F.max(F.when(F.col("q") == q, F.col("value"))).alias(f"q{round(q * 100)}") for q in QUANTILES],
        )
    )
    ordered = Window.partitionBy("column_name").orderBy("load_no")
    empty = 1 - F.col("filled") / F.col("n_rows")
    upper_before = F.lag("q75").over(ordered)
    return (
        totals.join(summed, ["column_name", "load_no"], "left")
        .withColumn("empty_share", empty)
        .withColumn("empty_share_change", F.abs(F.col("empty_share") - F.lag("empty_share").over(ordered)))
        .withColumn("q75_before", upper_before)
        .select(
            F.col("load").alias(load), "column_name", "n_rows", "empty_share", "empty_share_change", "n_distinct",
            "min_text", "max_text", "min_number", "max_number", *[f"q{round(q * 100)}" for q in QUANTILES], "q75_before",
            F.when(F.col("load_no") > 0, F.coalesce("value_share_change", F.lit(0.0))).alias("value_share_change"),
            F.when(F.col("load_no") > 0, F.coalesce("ks_distance", F.lit(0.0))).alias("ks_distance"),
        )
    )


def changed_loads(
    profile: DataFrame, load: str, *, share: float = 0.2, times: float = 10.0
) -> DataFrame:
    """(load, column_name) where a column changed: its empty share or a value's share by more than `share`,
    or the upper quartile of its absolute numbers more than `times`-fold."""
    low, high = F.least("q75", "q75_before"), F.greatest("q75", "q75_before")
    moved = (
        F.col("column_name").endswith(MAGNITUDE) & F.col("q75").isNotNull() & F.col("q75_before").isNotNull() & (high > low * times)
    )
    text = ~F.col("column_name").contains("#")
    changed = (text & ((F.col("empty_share_change") > share) | (F.col("value_share_change") > share))) | moved
    return profile.where(changed).select(load, F.split("column_name", "#")[0].alias("column_name")).distinct()
