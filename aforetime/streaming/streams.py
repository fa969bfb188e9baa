"""Streaming twins: latest versions, late-aware monthly levels and breach episodes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unrepeated(versions: DataFrame, keys: list[str], at: str, lateness: str) -> DataFrame:
    """A stream without repeated deliveries of a (keys, instant); state older than the lateness is dropped."""
    return versions.withWatermark(at, lateness).dropDuplicatesWithinWatermark([*keys, at])


def windowed_levels(
    readings: DataFrame, keys: list[str], at: str, value: str, *, window: str, lateness: str
) -> DataFrame:
    """Count, mean and last value per key and time window, with late data up to the lateness."""
    w = F.window(at, window)
    return readings.withWatermark(at, lateness).groupBy(*keys, w.alias("w")).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), F.max_by(value, at).alias("last_value")
    )


def breach_alerts(
    flags: DataFrame, key: str, at: str, breach: str, *, onset: int = 3, recovery: int = 3, lateness: str = "1 day",
    idle_days: int = 60,
) -> DataFrame:
    """(key, at, alert) when `onset` breaches in a row open an episode and `recovery` stable readings in a row close it.

    Readings of a micro-batch are ordered by time. A reading that isn't newer
    than the key's last judged one comes too late and is left out. State per
    key is two counters, a flag and an instant; it is dropped when the
    watermark has passed a key's last reading by `idle_days`.
    """

    def step(group: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        bad, good, is_open, last = state.get if state.exists else (0, 0, False, -(2**62))
        rows = pd.concat(list(batches), ignore_index=True).sort_values(at, kind="stable")
        out = []
        for moment, flag in zip(rows[at], rows[breach].fillna(False), strict=True):
            now = moment.value // 1000
            if now <= last:
                continue
            last = now
            bad, good = (bad + 1, 0) if flag else (0, good + 1)
            if not is_open and bad >= onset:
                is_open = True
                out.append((group[0], moment, "opened"))
            elif is_open and good >= recovery:
                is_open = False
                out.append((group[0], moment, "closed"))
        state.update((bad, good, is_open, last))
        state.setTimeoutTimestamp(max(last // 1000, state.getCurrentWatermarkMs()) + idle_days * 86_400_000)
        yield pd.DataFrame(out, columns=[key, at, "alert"])

    kind = flags.schema[key].dataType.simpleString()
    return flags.where(F.col(at).isNotNull()).withWatermark(at, lateness).groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, {at} timestamp, alert string", "bad int, good int, is_open boolean, last bigint", "append",
        "EventTimeTimeout",
    )
