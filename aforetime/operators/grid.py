"""Irregular readings onto a regular monthly grid.

Each source gets one cell per month from its first to its last reading. A cell
says whether it holds a fresh reading and, if not, which kind of gap it is. A
Kalman smoother with a continuous-time local trend (integrated Wiener process,
real month lengths as time steps) gives every cell a level and its standard
deviation; only fresh finite readings are observed by it, and of those not the
ones that a robust gate finds far off their neighbours.

Defined results
---------------
* A reading is a row whose flag is 0 or false (any case, outer blanks ignored)
  and whose value is not null; NaN and infinite values are readings, but the
  smoother doesn't see them.
* `absent`: no row for the month; `missing`: rows but no reading; `stale`: a
  reading whose observation month isn't later than the latest one of earlier
  cells. A reading without a readable observation month is never stale.
* Of several readings of a month the highest row_id gives the value, the
  latest observation month counts. Rows without a readable month have no cell.
* Null source parts are values like any other. A source without readings and
  an empty table give no cells. Further columns are ignored.
* With one observation the level is that value; its deviation is null where
  fewer than three observations leave the noise unknown.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aforetime.functions.months import month_index, month_text
from aforetime.functions.numbers import bare

#: Signal-to-noise ratios (trend variance per year cubed over noise variance) among which the likelihood chooses.
RATIOS = (1e-3, 1e-1, 1e1, 1e3, 1e5)
PADDED_CELLS = 400_000
#: A reading this many robust deviations off the median of its four neighbours isn't observed.
GATE = 12.0


def _gated(y: np.ndarray) -> np.ndarray:
    """y with NaN for readings far off their neighbours."""
    at = np.flatnonzero(~np.isnan(y))
    if len(at) < 8:
        return y
    v = y[at]
    around = np.stack([np.roll(v, k) for k in (2, 1, -1, -2)])
    around[:, :2], around[:, -2:] = v[[[2], [3], [4], [1]]], v[[[-2], [-3], [-4], [-5]]]
    off = np.abs(v - np.median(around, axis=0))
    usual = np.median(off)
    out = y.copy()
    if usual > 0:
        out[at[off > GATE * 1.4826 * usual]] = np.nan
    return out


def _smooth(
    time: np.ndarray, y: np.ndarray, ratio: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Filter and smoother of many padded series at once; time, y: (series, steps), y NaN where unobserved.

    Returns level, its variance in units of the noise variance, the noise
    variance and the log likelihood with the noise variance concentrated out.
    """
    n, steps = y.shape
    seen = ~np.isnan(y)
    mean = np.zeros((steps, n, 2))
    cov = np.zeros((steps, n, 3))  # level, level–slope, slope
    ahead_mean, ahead_cov = np.zeros_like(mean), np.zeros_like(cov)
    first = np.where(seen.any(1), seen.argmax(1), 0)
    level, slope = np.nan_to_num(y[np.arange(n), first]), np.zeros(n)
    p00, p01, p11 = np.full(n, 1e6), np.zeros(n), np.full(n, 1e6)
    sum_square, log_det, count = np.zeros(n), np.zeros(n), np.zeros(n)
    dts = np.diff(time, axis=1, prepend=time[:, :1])
    for k in range(steps):
        dt = dts[:, k]
        level = level + dt * slope
        p00 = p00 + dt * (2 * p01 + dt * p11) + ratio * dt**3 / 3
        p01 = p01 + dt * p11 + ratio * dt**2 / 2
        p11 = p11 + ratio * dt
        ahead_mean[k, :, 0], ahead_mean[k, :, 1] = level, slope
        ahead_cov[k, :, 0], ahead_cov[k, :, 1], ahead_cov[k, :, 2] = p00, p01, p11
        on = seen[:, k]
        spread = p00 + 1
        miss = np.where(on, np.nan_to_num(y[:, k]) - level, 0)
        g0, g1 = np.where(on, p00 / spread, 0), np.where(on, p01 / spread, 0)
        usable = on & (spread < 1e5)  # the diffuse start says nothing of the noise
        sum_square += np.where(usable, miss**2 / spread, 0)
        log_det += np.where(usable, np.log(spread), 0)
        count += usable
        level, slope = level + g0 * miss, slope + g1 * miss
        p00, p01, p11 = p00 - g0 * p00, p01 - g0 * p01, p11 - g1 * p01
        mean[k, :, 0], mean[k, :, 1] = level, slope
        cov[k, :, 0], cov[k, :, 1], cov[k, :, 2] = p00, p01, p11
    noise = sum_square / np.maximum(count, 1)
    likelihood = -0.5 * (count * np.log(np.maximum(noise, 1e-30)) + log_det)
    for k in range(steps - 2, -1, -1):
        dt = dts[:, k + 1]
        a00, a01, a11 = ahead_cov[k + 1].T
        det = np.maximum(a00 * a11 - a01**2, 1e-300)
        c00, c01, c11 = cov[k].T
        # cross covariance of the state now and one step ahead
        x00, x01, x10, x11 = c00 + dt * c01, c01, c01 + dt * c11, c11
        g00, g01 = (x00 * a11 - x01 * a01) / det, (x01 * a00 - x00 * a01) / det
        g10, g11 = (x10 * a11 - x11 * a01) / det, (x11 * a00 - x10 * a01) / det
        d0, d1 = mean[k + 1, :, 0] - ahead_mean[k + 1, :, 0], mean[k + 1, :, 1] - ahead_mean[k + 1, :, 1]
        mean[k, :, 0] += g00 * d0 + g01 * d1
        mean[k, :, 1] += g10 * d0 + g11 * d1
        e00, e01, e11 = (cov[k + 1] - ahead_cov[k + 1]).T
        cov[k, :, 0] += g00 * (g00 * e00 + g01 * e01) + g01 * (g00 * e01 + g01 * e11)
        cov[k, :, 1] += g10 * (g00 * e00 + g01 * e01) + g11 * (g00 * e01 + g01 * e11)
        cov[k, :, 2] += g10 * (g10 * e00 + g11 * e01) + g11 * (g10 * e01 + g11 * e11)
    return mean[:, :, 0].T, np.maximum(cov[:, :, 0].T, 0), np.where(count > 0, noise, np.nan), likelihood


def smooth_sources(time: list[np.ndarray], value: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Level and standard deviation at each source's grid times; value is NaN where nothing was observed."""
    levels: list[np.ndarray] = [np.empty(0)] * len(time)
    deviations = list(levels)
    value = [_gated(v) for v in value]
    by_length = sorted(range(len(time)), key=lambda i: len(time[i]))
    while by_length:
        width = len(time[by_length[-1]])
        take = max(1, PADDED_CELLS // max(1, width))
        chunk, by_length = by_length[-take:], by_length[:-take]
        t = np.array([np.pad(time[i], (0, width - len(time[i])), mode="edge") for i in chunk])
        y = np.array([np.pad(value[i], (0, width - len(value[i])), constant_values=np.nan) for i in chunk])
        seen = ~np.isnan(y)
        n = np.maximum(seen.sum(1), 1)
        centre = np.where(seen, y, 0).sum(1) / n
        scale = np.sqrt(np.where(seen, (y - centre[:, None]) ** 2, 0).sum(1) / n)
        scale = np.where(scale > 0, scale, 1)
        z = (y - centre[:, None]) / scale[:, None]
        best: list[np.ndarray] | None = None
        for ratio in RATIOS:
            now = list(_smooth(t, z, np.full(len(chunk), ratio)))
            if best is None:
                best = now
                continue
            better = now[3] > best[3]
            best = [np.where(better if b.ndim == 1 else better[:, None], x, b) for x, b in zip(now, best, strict=True)]
        level = best[0] * scale[:, None] + centre[:, None]
        deviation = np.sqrt(best[1] * best[2][:, None]) * scale[:, None]
        for row, i in enumerate(chunk):
            levels[i] = level[row, : len(time[i])]
            deviations[i] = deviation[row, : len(time[i])]
    return levels, deviations


def _smooth_batches(names: list[str]):
    def finish(frame: pd.DataFrame) -> pd.DataFrame:
        starts = np.flatnonzero(frame["month"].eq(frame["first_month"]).to_numpy())
        cuts = [*starts.tolist(), len(frame)]
        days = (frame["month"].to_numpy().astype(np.int64) - 1970 * 12).astype("M8[M]").astype("M8[D]").astype(np.int64)
        seen = frame["observed"].to_numpy(dtype=float)
        parts = [slice(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
        levels, deviations = smooth_sources([days[p] / 365.25 for p in parts], [seen[p] for p in parts])
        frame = frame.assign(filled=np.concatenate(levels), filled_sd=np.concatenate(deviations))
        return frame[[*names, "month", "value", "gap", "filled", "filled_sd"]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # rows come sorted by source and month; the last source of a batch may go on in the next
        open_rows: list[pd.DataFrame] = []
        for batch in batches:
            starts = np.flatnonzero(batch["month"].eq(batch["first_month"]).to_numpy())
            if not len(starts):
                open_rows.append(batch)
                continue
            whole = pd.concat([*open_rows, batch.iloc[: starts[-1]]], ignore_index=True)
            if len(whole):
                yield finish(whole)
            open_rows = [batch.iloc[starts[-1] :]]
        if open_rows and len(last := pd.concat(open_rows, ignore_index=True)):
            yield finish(last)

    return run


def regular_grid(
    rows: DataFrame,
    source: Sequence[str],
    *,
    month: str = "origin_month",
    observed_month: str = "observation_period",
    value: str = "transformed_value",
    missing_flag: str = "is_missing",
    tie: str = "row_id",
) -> DataFrame:
    """One row per source and month: source columns, month (YYYY-MM), value, gap, filled, filled_sd.

    Rows are aggregated to months first, so a source has no more rows than
    months, whatever the number of readings.
    """
    source = list(source)
    names = [f"s{i}" for i in range(len(source))]
    reading = F.lower(bare(F.col(missing_flag).cast("string"))).isin("0", "false") & F.col(value).isNotNull()
    cells = (
        rows.select(
            *[F.col(c).alias(n) for c, n in zip(source, names, strict=True)],
            month_index(F.col(month)).alias("month"),
            reading.alias("reading"),
            F.when(reading, F.col(value)).alias("value"),
            F.when(reading, month_index(F.col(observed_month))).alias("seen_month"),
            F.coalesce(F.col(tie), F.lit(-1)).alias("tie"),
        )
        .where(F.col("month").isNotNull())
        .groupBy(*names, "month")
        .agg(
            F.bool_or("reading").alias("reading"),
            F.max_by(F.when(F.col("reading"), F.struct("value")), F.when(F.col("reading"), F.col("tie"))).alias("held"),
            F.max("seen_month").alias("seen_month"),
        )
    )
    whole = Window.partitionBy(*names)
    ordered = whole.orderBy("month")
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    reading_month = F.when(F.col("reading"), F.col("month"))
    placed = (
        cells.withColumn("first_month", F.min(reading_month).over(whole))
        .withColumn("last_month", F.max(reading_month).over(whole))
        .withColumn("seen_before", F.max("seen_month").over(earlier))
        .where(F.col("month").between(F.col("first_month"), F.col("last_month")))
        .withColumn("next_month", F.coalesce(F.lead("month").over(ordered), F.col("month") + 1))
    )
    own = F.col("at") == F.col("month")
    gap: Column = (
        F.when(~own, "absent")
        .when(~F.col("reading"), "missing")
        .when(F.col("seen_month") <= F.col("seen_before"), "stale")
    )
    value_now = F.when(own, F.col("held.value"))
    fresh = F.when(gap.isNull() & (F.abs(value_now) < float("inf")), value_now)
    grid = (
        placed.withColumn("at", F.explode(F.sequence("month", F.col("next_month") - 1)))
        .select(*names, "at", "first_month", value_now.alias("value"), gap.alias("gap"), fresh.alias("observed"))
        .withColumnRenamed("at", "month")
        .sortWithinPartitions(*names, "month")
    )
    types = ", ".join(f"{n} {rows.schema[c].dataType.simpleString()}" for c, n in zip(source, names, strict=True))
    filled = grid.mapInPandas(
        _smooth_batches(names), f"{types}, month int, value double, gap string, filled double, filled_sd double"
    )
    return filled.select(
        *[F.col(n).alias(c) for c, n in zip(source, names, strict=True)],
        month_text(F.col("month")).alias(month),
        F.col("value").alias(value),
        "gap",
        F.nanvl("filled", F.lit(None).cast("double")).alias("filled"),
        F.nanvl("filled_sd", F.lit(None).cast("double")).alias("filled_sd"),
    )
