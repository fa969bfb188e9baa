"""Implausible spikes, stuck values and impossible readings, per source.

Every source is decomposed robustly into a trend (running median), a seasonal
figure (medians by calendar month) and a residual. Residuals beyond the limits
of the generalised extreme Studentised deviate test are candidates; a candidate
is a spike if it is off its neighbouring readings by more than twice the
largest move that the source normally makes and the readings are back at the
old level at most two readings later. Runs of equal readings and the range of
the series are checked separately.

Defined results
---------------
* Null values are no readings. NaN, infinite and out-of-range values are cases
  of the range check and no neighbours of other readings. A series without
  entry in the registry, or with a null bound, has no bound on that side.
* Equal values (at twelve digits) of one period are one reading; all rows that
  hold a reading share its verdict, so duplicates of a case are cases.
* Rows without a readable period are only range-checked. Null source parts are
  values like any other. An empty table gives no rows. Further columns are
  ignored.
* A source is judged whole, whatever its size. Those with more than
  HOT_READINGS distinct readings are judged by Spark (`large_sources`), the
  others whole in a task; both ways give the same rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aforetime.functions.numbers import bare, twelve_digits
from aforetime.groups import whole_groups
from aforetime.storage import small_side, written

HOT_READINGS = 50_000
TREND_WINDOW = 7
ALPHA = 0.05
#: With fewer readings the test isn't made; all are candidates.
FEWEST = 8
#: How many readings before and after a period are looked through for two neighbours.
REACH = 8
#: How many times the largest normal move a spike is away from its neighbours.
MOVES = 2.0
#: A move this many times the next largest one is no normal move (a change of level).
LONE_MOVE = 2.2
LONE_MOVES_AT_MOST = 2
STUCK_RUN = 8
STUCK_REPEATS = 0.2
RANGE, SPIKE, STUCK = "range", "spike", "stuck"


def limit_of(n: int, i: int, alpha: float) -> float:
    """Critical value of the generalised ESD test for the i-th of n readings.

    Student's t comes from the Cornish–Fisher expansion.
    """
    z, df = NormalDist().inv_cdf(1 - alpha / (2 * (n - i + 1))), n - i - 1
    t = z + (z**3 + z) / (4 * df) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * df**2)
    t += (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / (384 * df**3)
    return (n - i) * t / ((n - i - 1 + t * t) * (n - i + 1)) ** 0.5


@lru_cache(maxsize=1024)
def _few_limits(n: int, alpha: float) -> tuple[float, ...]:
    return tuple(limit_of(n, i, alpha) for i in range(1, n // 4 + 1))


def _limits(n: int, alpha: float) -> Iterator[float]:
    """Critical values for 1 … n/4 outliers; those of small sources are kept."""
    return iter(_few_limits(n, alpha)) if n <= 1000 else (limit_of(n, i, alpha) for i in range(1, n // 4 + 1))


def decompose(month: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Robust trend, seasonal figure and residual of readings in order."""
    n, half = len(value), TREND_WINDOW // 2
    padded = np.pad(value, half, mode="reflect" if n > half else "edge")
    trend = np.median(np.lib.stride_tricks.sliding_window_view(padded, TREND_WINDOW), axis=1)
    loose = value - trend
    season = month % 12
    order = np.lexsort((loose, season))
    count = np.bincount(season, minlength=12)
    first = np.cumsum(count) - count
    ranked = loose[order]
    low, high = np.minimum(first + np.maximum(count - 1, 0) // 2, n - 1), np.minimum(first + count // 2, n - 1)
    figure = np.where(count >= 3, (ranked[low] + ranked[high]) / 2, 0.0)
    seasonal = figure[season]
    seasonal = seasonal - np.median(seasonal)
    return trend, seasonal, loose - seasonal


def extreme_deviates(residual: np.ndarray, alpha: float = ALPHA) -> np.ndarray:
    """Mask of the outliers that the generalised ESD test finds among at most a quarter of the residuals.

    What is left after each removal is a stretch of the sorted residuals; its
    sums are accumulated outward from the middle, so removed spikes leave no
    rounding behind.
    """
    n = len(residual)
    flagged = np.zeros(n, bool)
    if n < FEWEST:
        return ~flagged  # too few for the test: all are candidates
    order = np.argsort(residual, kind="stable")
    centred = residual[order] - residual[order[n // 2]]
    middle = n // 2
    up, down = centred[middle:], centred[:middle][::-1]
    sums = [[0.0, *np.cumsum(x**k).tolist()] for x in (up, down) for k in (1, 2)]
    up1, up2, down1, down2 = sums
    line = centred.tolist()
    low, high, found = 0, n, (0, n)
    for limit in _limits(n, alpha):
        m = high - low
        mean = (up1[high - middle] + down1[middle - low]) / m
        square = (up2[high - middle] + down2[middle - low]) / m - mean * mean
        spread = (max(square, 0.0) * m / (m - 1)) ** 0.5
        from_low, from_high = mean - line[low], line[high - 1] - mean
        if from_low > from_high:
            low += 1
        else:
            high -= 1
        if max(from_low, from_high) > limit * spread:
            found = (low, high)
        if spread == 0:
            break
        if not low < middle < high:
            break
    flagged[order[: found[0]]] = True
    flagged[order[found[1] :]] = True
    return flagged


def largest_normal_move(value: np.ndarray) -> float:
    """The largest step between consecutive readings, without lone steps far above all others."""
    steps = np.sort(np.abs(np.diff(value)))[::-1]
    if not len(steps):
        return np.inf
    at = 0
    while at < LONE_MOVES_AT_MOST and at + 1 < len(steps) and steps[at] > LONE_MOVE * steps[at + 1] > 0:
        at += 1
    return float(steps[at])


def _limit(value: np.ndarray, spike: np.ndarray) -> float:
    """How far off its neighbours a spike is at least; where a source never moves, its own level."""
    usual = value[~spike]
    move = largest_normal_move(usual)
    return MOVES * move if move > 0 else float(abs(np.median(usual)))


def _start(value: np.ndarray, candidate: np.ndarray) -> np.ndarray:
    """The readings left out of the first estimate of normal moves.

    With too few readings for the test, the one whose absence calms the source most.
    """
    if len(value) >= FEWEST or len(value) < 3:
        return candidate.copy()
    rest = [np.abs(np.diff(np.delete(value, i))).max() for i in range(len(value))]
    return np.arange(len(value)) == int(np.argmin(rest))


def _spikes_in_order(value: np.ndarray, candidate: np.ndarray) -> np.ndarray:
    """Single or double readings off both neighbours, which are level with each other."""
    spike = _start(value, candidate)
    line, at = value.tolist(), np.flatnonzero(candidate).tolist()
    chosen = set(at)
    for _ in range(20):
        limit = _limit(value, spike)
        now = np.zeros(len(value), bool)
        for i in at:
            for end in (i + 1, i + 2) if i + 1 in chosen else (i + 1,):
                if i == 0 or end >= len(line):
                    continue
                before, after = line[i - 1], line[end]
                off = min(min(abs(x - before), abs(x - after)) for x in line[i:end])
                if off > limit and abs(after - before) <= min(limit, off):
                    now[i:end] = True
        if (now == spike).all():
            break
        spike = now
    return spike


def _spikes_among_versions(period: np.ndarray, value: np.ndarray, candidate: np.ndarray) -> np.ndarray:
    """Readings off all other readings of their period and the nearest ones before and after it."""
    spike = _start(value, candidate)
    at = np.flatnonzero(candidate).tolist()
    # readings are sorted by period; those of a period are one stretch
    new = np.flatnonzero(np.diff(period, prepend=period[0] - 1))
    place = np.searchsorted(new, np.arange(len(value)), side="right") - 1
    edges = [*new.tolist(), len(value)]
    line, places = value.tolist(), place.tolist()
    last = len(edges) - 2
    first_limit = _limit(value, spike)
    near: list[float] = []
    known = -1
    for i in at:  # a candidate level with most of its neighbours is none
        if places[i] != known:
            known = places[i]
            near = sorted(line[edges[max(0, known - 2)] : edges[min(last, known + 2) + 1]])
        own, others = bisect_left(near, line[i]), len(near) - 1
        middle = [near[k + (k >= own)] for k in ((others - 1) // 2, others // 2)] if others else []
        spike[i] = not middle or abs((middle[0] + middle[1]) / 2 - line[i]) > first_limit
    for _ in range(20):
        limit = _limit(value, spike)
        off = spike.tolist()
        now = np.zeros(len(value), bool)
        usual: list[float] = []
        known = -1
        for i in at:
            begin, end = edges[places[i]], edges[places[i] + 1]
            if places[i] != known:
                known = places[i]
                usual = sorted(line[j] for j in range(begin, end) if not off[j])
            # the nearest values on both sides stand for all of the period; its own isn't among them
            own = bisect_left(usual, line[i])
            same = [*usual[max(0, own - 1) : own], *usual[own + (not off[i]) : own + (not off[i]) + 1]]
            before = [line[j] for j in range(max(0, begin - REACH), begin) if not off[j]][-2:]
            after = [line[j] for j in range(end, min(len(line), end + REACH)) if not off[j]][:2]
            around = [*same, *before, *after]
            n_same = len(usual) - (not off[i])
            if n_same + len(before) + len(after) >= 2 and (same or (before and after)):
                now[i] = min(abs(x - line[i]) for x in around) > limit
        if (now == spike).all():
            break
        spike = now
    return spike


def _decimals_over_one(value: np.ndarray) -> bool:
    """Whether most values have more than one decimal."""
    return bool(np.mean(np.abs(value * 10 - np.round(value * 10)) > 1e-6 * np.maximum(1, np.abs(value))) > 0.5)


def many_decimals(value: Column) -> Column:
    """Whether a value has more than one decimal."""
    return F.abs(value * 10 - F.rint(value * 10)) > 1e-6 * F.greatest(F.lit(1.0), F.abs(value))


def _stuck(value: np.ndarray) -> np.ndarray:
    """Runs of equal readings in a source that seldom repeats itself otherwise."""
    out = np.zeros(len(value), bool)
    if len(value) < STUCK_RUN or not _decimals_over_one(value):
        return out
    same = np.concatenate([[False], np.abs(np.diff(value)) <= 1e-11 * np.abs(value[1:])])
    begins = np.flatnonzero(~same)
    ends = np.append(begins[1:], len(value))
    for a, b in zip(begins, ends, strict=True):
        if b - a < STUCK_RUN:
            continue
        others = len(value) - (b - a)
        repeats = same.sum() - (b - a - 1)
        if others == 0 or repeats < STUCK_REPEATS * others:
            out[a:b] = True
    return out


def _judge(versions: bool, names: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, starts in whole_groups(batches, names):
            values = frame["value"].to_numpy(dtype=float)
            periods = frame["period"].to_numpy(dtype=np.int64)
            kind = np.full(len(frame), "", dtype=object)
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(frame)], strict=True):
                value, period = values[a:b], periods[a:b]
                candidate = extreme_deviates(decompose(period, value)[2])
                if versions:
                    kind[a:b][_spikes_among_versions(period, value, candidate)] = SPIKE
                else:
                    kind[a:b][_stuck(value)] = STUCK
                    kind[a:b][_spikes_in_order(value, candidate)] = SPIKE
            own = kind != ""
            if own.any():
                yield frame.loc[own, [*names, "period", "digits"]].assign(kind=kind[own])

    return run


def implausible(
    rows: DataFrame,
    source: Sequence[str],
    *,
    period: Column,
    value: str,
    order: str,
    series: str,
    registry: DataFrame,
    versions: bool = False,
    row_id: str = "row_id",
) -> DataFrame:
    """(row_id, kind) of the rows whose value is implausible; a row may be a case of several kinds.

    `period` is a month index. With `versions` a period has many readings
    (revisions) and neighbours are those of the same and adjoining periods;
    else a period has one reading. `registry` holds series_id, min_possible and
    max_possible, one row per series.
    """
    source = list(source)
    names = [f"k{i}" for i in range(len(source))]
    bounds = registry.groupBy(F.upper(bare(F.col("series_id"))).alias("_series")).agg(
        F.min("min_possible").alias("_low"), F.max("max_possible").alias("_high")
    )
    typed = rows.where(F.col(value).isNotNull()).select(
        F.col(row_id).alias("row_id"),
        *[F.col(c).alias(n) for c, n in zip(source, names, strict=True)],
        F.upper(bare(F.col(series))).alias("_series"),
        period.alias("period"),
        F.unix_micros(order).alias("at") if order else F.lit(0).cast("bigint").alias("at"),
        F.col(value).cast("double").alias("value"),
    )
    typed = typed.join(bounds, "_series", "left")
    v = F.col("value")
    # NaN compares above every number
    bad = F.isnan(v) | (F.abs(v) == float("inf")) | (v < F.col("_low")) | (v > F.col("_high"))
    typed = typed.withColumn("bad", F.coalesce(bad, F.lit(False))).withColumn("digits", twelve_digits(v))
    out_of_range = typed.where("bad").select("row_id", F.lit(RANGE).alias("kind"))
    within = typed.where(~F.col("bad") & F.col("period").isNotNull())
    readings = written(
        within.groupBy(*names, "period", "digits").agg(
            F.min("at").alias("at"), F.min_by("value", "row_id").alias("value")
        ),
        "readings",
    )
    sizes = readings.groupBy(*names).agg(F.count("*").alias("n_readings"))
    large = sizes.where(F.col("n_readings") > HOT_READINGS).select(*names)
    hot = large.count()  # at most one source per HOT_READINGS readings
    types = ", ".join(f"{n} {readings.schema[n].dataType.simpleString()}" for n in names)
    inner = ["period", "at", "digits"]

    def matches(other: DataFrame) -> list[Column]:
        return [readings[n].eqNullSafe(other[n]) for n in names]

    usual = readings.join(small_side(large, hot), matches(large), "left_anti") if hot else readings
    ready = usual.repartition(*names).sortWithinPartitions(*names, *inner).select(*names, *inner, "value")
    found = ready.mapInPandas(_judge(versions, names), f"{types}, period int, digits string, kind string")
    if hot:
        from aforetime.operators import large_sources

        # one row per large source
        numbered = written(
            large.withColumn("source_no", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*names))), "sources"
        )
        big = readings.join(small_side(numbered, hot), matches(numbered)).select("source_no", *inner, "value")
        cases = large_sources.judge(big, versions=versions).join(small_side(numbered, hot), "source_no")
        found = found.unionByName(cases.select(*names, "period", "digits", "kind"))
    same = [within[c].eqNullSafe(found[c]) for c in [*names, "period", "digits"]]
    held = within.join(found, same).select(within["row_id"], found["kind"])
    return out_of_range.unionByName(held)
