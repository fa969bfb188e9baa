"""Small numeric fits, one group of rows at a time.

Spark partitions the work by group (a source or a panel, at most a few hundred
months each); the functions here see one group's matrix. They return a status
instead of raising, so that one ill-posed group doesn't end a job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aforetime.groups import whole_groups

OK, TOO_FEW, FLAT = "ok", "too_few", "flat"
#: Bootstrap replicates drawn at once.
DRAWS = 50


def per_group(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], fit: Callable[[pd.DataFrame], list[tuple]], fields: str
) -> DataFrame:
    """Rows (keys, fields) that `fit` gives for each group, whose rows come in order.

    The groups of a partition are cut from sorted batches, without a shuffle
    per fit or a pandas call per row.
    """
    keys = list(keys)
    key_types = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    names = [f.split()[0] for f in fields.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, starts in whole_groups(batches, keys):
            out = []
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(frame)], strict=True):
                key = tuple(frame[k].iat[a] for k in keys)
                out.extend((*key, *found) for found in fit(frame.iloc[a:b]))
            if out:
                yield pd.DataFrame(out, columns=[*keys, *names])

    ready = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    return ready.mapInPandas(run, f"{key_types}, {fields}")


def best_split_1d(value: np.ndarray, k: int) -> tuple[float, list[float]]:
    """Exact one-dimensional k-means: least within-cluster sum of squares and the ascending centres.

    Dynamic programming over the sorted values; squares come from prefix sums.
    Of equal splits the one that cuts earliest holds.
    """
    x = np.sort(value) - np.median(value)
    n = len(x)
    s1, s2 = np.concatenate([[0], np.cumsum(x)]), np.concatenate([[0], np.cumsum(x * x)])

    def spread(i: np.ndarray, j: int) -> np.ndarray:
        m = j - i
        return np.maximum(s2[j] - s2[i] - (s1[j] - s1[i]) ** 2 / m, 0)

    cost = np.full((k + 1, n + 1), np.inf)
    cut = np.zeros((k + 1, n + 1), dtype=int)
    cost[0, 0] = 0
    for c in range(1, k + 1):
        for j in range(c, n + 1):
            i = np.arange(c - 1, j)
            total = cost[c - 1, i] + spread(i, j)
            at = int(total.argmin())
            cost[c, j], cut[c, j] = total[at], i[at]
    centres, j = [], n
    for c in range(k, 0, -1):
        i = cut[c, j]
        centres.append(float((s1[j] - s1[i]) / (j - i) + np.median(value)))
        j = i
    return float(cost[k, n]), centres[::-1]


def gaussian_hmm(
    value: np.ndarray, states: int = 2, steps: int = 40
) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[float]]:
    """Expectation maximisation of a Gaussian hidden Markov chain with pseudo-counts: means, variances, transitions, log likelihoods.

    Starts from quantile bins; NaN values are integrated out.
    """
    seen = ~np.isnan(value)
    x = np.where(seen, value, 0.0)
    floor = max(1e-6, 1e-3 * float(np.var(value[seen])))
    edges = np.quantile(value[seen], np.linspace(0, 1, states + 1))
    group = np.clip(np.searchsorted(edges[1:-1], value[seen], side="right"), 0, states - 1)
    mean = np.array([value[seen][group == k].mean() if (group == k).any() else edges[k] for k in range(states)])
    variance = np.full(states, max(floor, float(np.var(value[seen]))))
    start, move = np.full(states, 1 / states), np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9)
    trace: list[float] = []
    for _ in range(steps):
        emit = np.where(seen[:, None], -0.5 * (np.log(2 * np.pi * variance) + (x[:, None] - mean) ** 2 / variance), 0.0)
        top = emit.max(1, keepdims=True)
        likely = np.exp(emit - top)
        forward, scale = np.zeros_like(likely), np.zeros(len(x))
        for t in range(len(x)):
            now = likely[t] * (start if t == 0 else forward[t - 1] @ move)
            scale[t] = now.sum()
            forward[t] = now / scale[t]
        backward = np.ones_like(likely)
        for t in range(len(x) - 2, -1, -1):
            backward[t] = move @ (likely[t + 1] * backward[t + 1]) / scale[t + 1]
        trace.append(float(np.log(scale).sum() + top.sum()))
        weight = forward * backward
        weight /= weight.sum(1, keepdims=True)
        pairs = np.einsum("ti,ij,tj->ij", forward[:-1], move, (likely * backward)[1:] / scale[1:, None])
        held = weight * seen[:, None]
        mean = (held * x[:, None]).sum(0) / np.maximum(held.sum(0), 1e-12)
        variance = np.maximum((held * (x[:, None] - mean) ** 2).sum(0) / np.maximum(held.sum(0), 1e-12), floor)
        move = pairs + 1e-3
        move /= move.sum(1, keepdims=True)
        start = (weight[0] + 1e-3) / (weight[0] + 1e-3).sum()
        if len(trace) > 1 and trace[-1] - trace[-2] < 1e-6 * abs(trace[-2]):
            break
    order = np.argsort(mean)
    return mean[order], variance[order], move[np.ix_(order, order)], trace


def ragged_components(matrix: np.ndarray, rank: int, steps: int = 200) -> tuple[np.ndarray, float]:
    """Principal components of a matrix with gaps, by repeated completion: completed matrix and mean squared error of what is observed."""
    seen = ~np.isnan(matrix)
    centre = np.nanmean(matrix, axis=0)
    scale = np.nanstd(matrix, axis=0)
    z = (matrix - centre) / np.where(scale > 1e-12, scale, 1)
    full = np.where(seen, z, 0.0)
    error = np.inf
    for _ in range(steps):
        u, s, v = np.linalg.svd(full, full_matrices=False)
        low = (u[:, :rank] * s[:rank]) @ v[:rank]
        new = float(((z - low)[seen] ** 2).mean())
        full = np.where(seen, z, low)
        if error - new <= 1e-8 * max(new, 1e-12):
            break
        error = new
    return full, new


def choose_rank(matrix: np.ndarray, most: int) -> tuple[int, float]:
    """The rank that minimises the information criterion of factor models; ties go to the smaller."""
    t, n = matrix.shape
    penalty = (n + t) / (n * t) * np.log(n * t / (n + t))
    fits = [(np.log(max(ragged_components(matrix, k)[1], 1e-12)) + k * penalty, k) for k in range(1, most + 1)]
    best = min(fits)
    return best[1], float(best[0])


def subspace_distance(left: np.ndarray, right: np.ndarray) -> tuple[float, float]:
    """(smallest principal cosine, projector distance) of two column spaces with orthonormal bases of equal rank."""
    cosines = np.clip(np.linalg.svd(left.T @ right, compute_uv=False), 0, 1)
    return float(cosines.min()), float(np.sqrt(np.mean(1 - cosines**2)))


def leading_space(moment: np.ndarray, rank: int) -> np.ndarray:
    """Orthonormal basis of the leading eigenvectors of a symmetric matrix."""
    values, vectors = np.linalg.eigh(moment)
    return vectors[:, np.argsort(values)[::-1][:rank]]


def change_points(value: np.ndarray, limit: float = 4.0, least: int = 12) -> np.ndarray:
    """Causal segment number of each value: a new segment begins where a value is `limit` deviations off the running segment."""
    segment = np.zeros(len(value), dtype=int)
    n, mean, square, now = 0, 0.0, 0.0, 0
    for i, x in enumerate(value.tolist()):
        if n >= least and abs(x - mean) > limit * max((square / (n - 1)) ** 0.5, 1e-9):
            n, mean, square, now = 0, 0.0, 0.0, now + 1
        n += 1
        step = x - mean
        mean += step / n
        square += step * (x - mean)
        segment[i] = now
    return segment


def _resampled(x: np.ndarray, draws: int, block: int, seed: list[int], circular: bool = True) -> np.ndarray:
    """Resamples of x, one a row, made of blocks; blocks run on from the end to the start, or end where x does."""
    last = len(x) if circular else max(1, len(x) - block + 1)
    starts = np.random.default_rng(seed).integers(0, last, (draws, -(-len(x) // block)))
    places = (starts[:, :, None] + np.arange(block)).reshape(draws, -1)[:, : len(x)]
    return x[places % len(x)]


def _upper_decile(rows: np.ndarray) -> np.ndarray:
    """The interpolated 0.9 quantile of each row."""
    at = 0.9 * (rows.shape[1] - 1)
    low, high = int(at), min(int(at) + 1, rows.shape[1] - 1)
    ranked = np.partition(rows, (low, high), axis=1)
    return ranked[:, low] + (ranked[:, high] - ranked[:, low]) * (at - low)


def block_intervals(
    values: DataFrame, keys: Sequence[str], array: str, *, replicates: int, blocks: Sequence[int], seed: int,
    level: float = 0.95, circular: bool = True,
) -> DataFrame:
    """(keys, block, n_draws, mean_low, mean_high, p90_low, p90_high): bootstrap intervals of each group's mean and upper decile.

    `array` holds a group's values in order, a row per group and block length
    is a unit of work. Only the ends of the intervals leave it, the replicates
    don't. Empty arrays give no rows; the draws depend on the key alone.
    """
    keys = list(keys)
    ends = [(1 - level) / 2, (1 + level) / 2]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for x, block, mix in zip(batch["_x"], batch["block"], batch["_mix"], strict=True):
                x = np.asarray(x, dtype=float)
                means, deciles = np.empty(replicates), np.empty(replicates)
                for first in range(0, replicates, DRAWS):
                    last = min(first + DRAWS, replicates)
                    picked = _resampled(x, last - first, block, [seed + int(block), first, int(mix) & 0x7FFFFFFF], circular)
                    means[first:last], deciles[first:last] = picked.mean(1), _upper_decile(picked)
                rows.append((replicates, *np.quantile(means, ends), *np.quantile(deciles, ends)))
            found = pd.DataFrame(rows, columns=["n_draws", "mean_low", "mean_high", "p90_low", "p90_high"])
            yield pd.concat([batch[[*keys, "block"]].reset_index(drop=True), found], axis=1)

    plan = values.where(F.size(array) > 0).select(
        *keys, F.col(array).alias("_x"), F.xxhash64(*keys).alias("_mix"), F.explode(F.array(*map(F.lit, blocks))).alias("block")
    )
    # a row costs far more than its bytes suggest
    cores = values.sparkSession.sparkContext.defaultParallelism
    types = ", ".join(f"{k} {values.schema[k].dataType.simpleString()}" for k in keys)
    return plan.repartition(4 * cores).mapInPandas(
        run, f"{types}, block int, n_draws bigint, mean_low double, mean_high double, p90_low double, p90_high double"
    )


def block_means(
    values: DataFrame, keys: Sequence[str], array: str, *, replicates: int, block: int, seed: int
) -> DataFrame:
    """(keys, replicate, mean, p90) of circular moving-block resamples.

    `array` holds a group's values in order. Chunks of DRAWS replicates are
    rows, so that they spread over tasks; a chunk's seed depends only on its
    number and the group's key.
    """
    keys = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            for row, x in enumerate(batch["_x"]):
                x = np.asarray(x, dtype=float)
                first = int(batch["_chunk"].iat[row]) * DRAWS
                draws = min(DRAWS, replicates - first)
                picked = _resampled(x, draws, block, [seed, first, int(batch["_mix"].iat[row]) & 0x7FFFFFFF])
                part = pd.DataFrame({k: [batch[k].iat[row]] * draws for k in keys})
                parts.append(
                    part.assign(
                        replicate=np.arange(first, first + draws, dtype=np.int32),
                        mean=picked.mean(1),
                        p90=np.quantile(picked, 0.9, axis=1),
                    )
                )
            if parts:
                yield pd.concat(parts, ignore_index=True)

    chunks = F.sequence(F.lit(0), F.lit((replicates - 1) // DRAWS))
    plan = values.where(F.size(array) > 0).select(
        *keys, F.col(array).alias("_x"), F.xxhash64(*keys).alias("_mix"), F.explode(chunks).alias("_chunk")
    )
    types = ", ".join(f"{k} {values.schema[k].dataType.simpleString()}" for k in keys)
    return plan.mapInPandas(run, f"{types}, replicate int, mean double, p90 double")


def factor_filter(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """One common factor of a ragged matrix: filtered mean, variance and persistence.

    The loading is the first component (largest entry positive), the factor an
    autoregression of order one; each month updates it with the columns seen.
    """
    full, error = ragged_components(matrix, 1)
    _, _, v = np.linalg.svd(full, full_matrices=False)
    loading = v[0] * np.sign(v[0][np.abs(v[0]).argmax()])
    score = full @ loading
    phi = float(np.clip(score[1:] @ score[:-1] / max(score[:-1] @ score[:-1], 1e-12), -0.98, 0.98))
    shock = max(float(np.mean((score[1:] - phi * score[:-1]) ** 2)), 1e-6)
    noise = max(error, 1e-6)
    seen = ~np.isnan(matrix)
    mean, variance = 0.0, shock / (1 - phi**2)
    means, variances = np.empty(len(matrix)), np.empty(len(matrix))
    for t in range(len(matrix)):
        if t:
            mean, variance = phi * mean, phi**2 * variance + shock
        w = loading[seen[t]]
        precision = 1 / variance + w @ w / noise
        mean = (mean / variance + w @ full[t, seen[t]] / noise) / precision
        variance = 1 / precision
        means[t], variances[t] = mean, variance
    return means, variances, phi


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise; points on edges are left out."""
    ordered = np.unique(points, axis=0)
    if len(ordered) < 3:
        return ordered

    def half(line: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for p in line:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    return np.array([*half(ordered)[:-1], *half(ordered[::-1])[:-1]])


def hull_corners(rows: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """(key, corners as array of x and y) per group: hulls of batches first, then one hull of their corners."""

    def corners(frame: pd.DataFrame) -> np.ndarray:
        return hull(frame[[x, y]].to_numpy(dtype=float))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for group, part in batch.groupby(key, dropna=False):
                found = corners(part)
                yield pd.DataFrame({key: group, x: found[:, 0], y: found[:, 1]})

    def final(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({key: [part[key].iat[0]], "corners": [corners(part).tolist()]})

    kind = rows.schema[key].dataType.simpleString()
    some = rows.select(key, x, y).dropna().mapInPandas(partial, f"{key} {kind}, {x} double, {y} double")
    return some.groupBy(key).applyInPandas(final, f"{key} {kind}, corners array<array<double>>")


def inside_hull(corners: str, x: str, y: str, tolerance: float = 1e-12):
    """Whether a point lies in a convex polygon given counter-clockwise."""
    after = F.concat(F.slice(corners, 2, F.size(corners)), F.slice(corners, 1, 1))
    turn = F.zip_with(
        corners, after, lambda a, b: (b[0] - a[0]) * (F.col(y) - a[1]) - (b[1] - a[1]) * (F.col(x) - a[0])
    )
    return F.array_min(turn) >= -tolerance


def spline_basis(at: np.ndarray, inner: np.ndarray, low: float, high: float, degree: int = 3) -> np.ndarray:
    """B-spline basis by the Cox–de Boor recursion; the right end is closed."""
    knots = np.concatenate([np.full(degree + 1, low), inner, np.full(degree + 1, high)])
    at = np.minimum(at, np.nextafter(high, low))
    basis = ((knots[:-1] <= at[:, None]) & (at[:, None] < knots[1:])).astype(float)
    for d in range(1, degree + 1):
        left, right = knots[d:-1] - knots[: -d - 1], knots[d + 1 :] - knots[1:-d]
        with np.errstate(divide="ignore", invalid="ignore"):
            a = np.where(left > 0, (at[:, None] - knots[: -d - 1]) / left, 0)
            b = np.where(right > 0, (knots[d + 1 :] - at[:, None]) / right, 0)
        basis = a * basis[:, :-1] + b * basis[:, 1:]
    return basis


def penalty_by_forward_folds(at: np.ndarray, value: np.ndarray, penalties: Sequence[float], folds: int = 4) -> tuple[float, float]:
    """(penalty, mean squared error) of a cubic curve whose roughness penalty predicts the next stretch best.

    Each fold is fitted on everything before it; ties go to the earlier penalty.
    """
    low, high = float(at.min()), float(at.max())
    basis = spline_basis(at, np.quantile(at, np.linspace(0, 1, 6)[1:-1]), low, high)
    rough = np.diff(np.eye(basis.shape[1]), 2, axis=0)
    cuts = np.linspace(0, len(at), folds + 2).astype(int)[1:]
    losses = []
    for penalty in penalties:
        errors = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            left = basis[:a].T @ basis[:a] + penalty * rough.T @ rough + 1e-9 * np.eye(basis.shape[1])
            fitted = np.linalg.solve(left, basis[:a].T @ value[:a])
            errors.append((basis[a:b] @ fitted - value[a:b]) ** 2)
        losses.append(float(np.concatenate(errors).mean()))
    best = int(np.argmin(losses))
    return float(penalties[best]), losses[best]
