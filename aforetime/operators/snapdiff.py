"""What changed between consecutive full snapshots.

Snapshots are range-partitioned and sorted by key with the same bounds; within
a range each snapshot is merged with the one before by two pointers, and the
differences are emitted as typed changes.

Defined results
---------------
* Of several rows of a key in a snapshot the one with the highest row_id holds.
* Values are compared as numbers; null, blank and text that is no finite
  decimal number are missing and equal each other.
* Null key parts are values like any other; rows without snapshot number
  belong to no snapshot. The first snapshot gives no rows, a snapshot's
  predecessor is the next lower number that occurs. An empty table gives no
  rows. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aforetime.storage import block_count

ADDED, REMOVED, CHANGED = "added", "removed", "changed"


def _merge(old: list[tuple], new: list[tuple]) -> Iterator[tuple[tuple, str]]:
    """Two pointers over (key, value) lists sorted by key."""
    i = j = 0
    while i < len(old) and j < len(new):
        a, b = old[i], new[j]
        if a[0] == b[0]:
            if a[1] != b[1]:
                yield a[0], CHANGED
            i += 1
            j += 1
        elif a[0] < b[0]:
            yield a[0], REMOVED
            i += 1
        else:
            yield b[0], ADDED
            j += 1
    yield from ((a[0], REMOVED) for a in old[i:])
    yield from ((b[0], ADDED) for b in new[j:])


def _merge_range(names: list[str], snapshots: list[int], schema: pa.Schema):
    following = dict(zip(snapshots, snapshots[1:], strict=False))

    def rows_of(at: int, pairs: Iterator[tuple[tuple, str]]) -> Iterator[pa.RecordBatch]:
        found = list(pairs)
        if found:
            columns = [[None if k[c] == "0" else k[c][1:] for k, _ in found] for c in range(len(names))]
            yield pa.record_batch([[at] * len(found), *columns, [kind for _, kind in found]], schema=schema)

    def step(before: int | None, old: list[tuple], now: int, new: list[tuple]) -> Iterator[pa.RecordBatch]:
        if before is None:
            if now != snapshots[0]:
                yield from rows_of(now, _merge([], new))
        elif following[before] == now:
            yield from rows_of(now, _merge(old, new))
        else:
            yield from rows_of(following[before], _merge(old, []))
            yield from rows_of(now, _merge([], new))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: int | None = None
        now: int | None = None
        old: list[tuple] = []
        new: list[tuple] = []
        for batch in batches:
            at, *keys, value = (batch.column(i).to_pylist() for i in range(len(names) + 2))
            for snapshot, key, number in zip(at, zip(*keys, strict=True), value, strict=True):
                if snapshot != now:
                    if now is not None:
                        yield from step(before, old, now, new)
                        before, old, new = now, new, []
                    now = snapshot
                new.append((key, number))
        if now is not None:
            yield from step(before, old, now, new)
            if now in following:
                yield from rows_of(following[now], _merge(new, []))

    return run


def snapshot_changes(
    rows: DataFrame, snapshot: str, keys: dict[str, Column], value: Column, *, tie: str = "row_id"
) -> DataFrame:
    """(snapshot, key columns, change_kind) of every key that differs from the snapshot before.

    `keys` gives each key column's name and its clean form, `value` is a number
    or a struct of the columns to compare (nulls in it equal each other).
    """
    names = list(keys)
    marked = [
        F.coalesce(F.concat(F.lit("1"), c.cast("string")), F.lit("0")).alias(f"k{i}") for i,
        c in enumerate(keys.values())
    ]
    columns = [f"k{i}" for i in range(len(names))]
    clean = (
        rows.where(F.col(snapshot).isNotNull())
        .select(
            F.col(snapshot).cast("int").alias("at"), *marked, value.alias("value"),
            F.coalesce(F.col(tie), F.lit(-1)).alias("tie")
        )
        .groupBy("at", *columns)
        .agg(F.max_by("value", "tie").alias("value"))
    )
    # one number per snapshot, however many rows each has
    snapshots = [r[0] for r in rows.select(F.col(snapshot).cast("int")).distinct().collect() if r[0] is not None]
    schema = pa.schema([("at", pa.int32()), *[(c, pa.string()) for c in columns], ("change_kind", pa.string())])
    ranges = clean.repartitionByRange(block_count(rows), *columns).sortWithinPartitions("at", *columns)
    found = ranges.select("at", *columns, "value").mapInArrow(
        _merge_range(names, sorted(snapshots), schema), ", ".join(
            ["at int", *[f"{c} string" for c in columns], "change_kind string"]
        )
    )
    return found.select(
        F.col("at").alias(snapshot), *[F.col(c).alias(n) for c, n in zip(columns, names, strict=True)], "change_kind"
    )
