"""Spikes and stuck runs of sources of any size, judged whole by Spark.

The same verdicts as `spikes` gives a source that fits in a task, number for
number. Readings get positions; what needs neighbours (trend, moves off them)
runs in chunks of positions with a halo on both sides, what concerns the whole
source (medians, sums of the sorted residuals, largest moves) comes from value
counts, running sums and one row per source or block. Only the two outlying
tails of the sorted residuals pass one after the other through the ESD test,
as a sorted stream of which nothing is kept.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aforetime.groups import whole_groups
from aforetime.operators import spikes
from aforetime.storage import BLOCK, neighbour, ordered_blocks, running_sums, small_side, written

#: Readings of a chunk, without its halo.
CHUNK = 20_000
ROUNDS = 20
SOURCE = "source_no"
_CORE = "source_no int, chunk bigint, period int, at bigint, digits string, value double, pos bigint, n bigint"


def _chunks(placed: DataFrame, halo: int, columns: Sequence[str]) -> DataFrame:
    """Rows with the chunks they belong to, or lie within `halo` positions of, in order."""
    number = lambda shift: F.floor((F.col("pos") - 1 + shift) / CHUNK)
    spread = placed.select(*columns, F.explode(F.array_distinct(F.array(number(-halo), number(0), number(halo)))).alias("chunk"))
    return spread.where("chunk >= 0").repartition(SOURCE, "chunk").sortWithinPartitions(SOURCE, "chunk", "pos")


def _per_chunk(placed: DataFrame, halo: int, columns: Sequence[str], judge, schema: str) -> DataFrame:
    """`judge(frame, core)` on every chunk with its halo; `core` marks the chunk's own rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, starts in whole_groups(batches, [SOURCE, "chunk"]):
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(frame)], strict=True):
                part = frame.iloc[a:b]
                core = (part["pos"].to_numpy() - 1) // CHUNK == part["chunk"].iat[0]
                if core.any():
                    yield judge(part, core)

    return _chunks(placed, halo, columns).mapInPandas(run, schema)


def _medians(df: DataFrame, group: list[str], column: str, label: str) -> DataFrame:
    """(group, n, median) of a column, exact, from running counts of its values."""
    counts = df.groupBy(*group, column).agg(F.count("*").alias("_n"))
    upto = running_sums(counts, group, [column], {"_upto": "_n"}, label)
    sizes = upto.groupBy(*group).agg(F.max("_upto").alias("n"))
    holds = lambda rank: (F.col("_upto") - F.col("_n") <= rank) & (rank < F.col("_upto"))
    pick = lambda rank: F.max(F.when(holds(rank), F.col(column)))
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    return upto.join(small_side(sizes), group).groupBy(*group).agg(
        F.max("n").alias("n"), ((pick(low) + pick(high)) / 2).alias("median")
    )


def _loose(placed: DataFrame) -> DataFrame:
    """Every reading without its trend."""
    half = spikes.TREND_WINDOW // 2

    def judge(part: pd.DataFrame, core: np.ndarray) -> pd.DataFrame:
        value, pos = part["value"].to_numpy(), part["pos"].to_numpy()
        left, right = half * (pos[0] == 1), half * (pos[-1] == part["n"].iat[0])
        padded = np.pad(value, (left, right), mode="reflect")
        wide = np.lib.stride_tricks.sliding_window_view(padded, spikes.TREND_WINDOW)
        trend = np.full(len(value), np.nan)
        trend[half - left : half - left + len(wide)] = np.median(wide, axis=1)
        return part[core].assign(loose=(value - trend)[core])

    columns = [c for c in placed.columns if c != "chunk"]
    return _per_chunk(placed, half, columns, lambda p, c: judge(p, c)[[*columns, "loose"]], ", ".join(
        [*[f"{c} {placed.schema[c].dataType.simpleString()}" for c in columns], "loose double"]
    ))


def _residuals(placed: DataFrame) -> DataFrame:
    """placed with `residual`: the reading without trend and seasonal figure."""
    loose = written(_loose(placed).withColumn("season", F.pmod("period", F.lit(12))), "loose")
    by_season = _medians(loose, [SOURCE, "season"], "loose", "seasons")
    figure = written(
        by_season.select(SOURCE, "season", "n", F.when(F.col("n") >= 3, F.col("median")).otherwise(0.0).alias("figure")), "figures"
    )
    # twelve rows a source: their median, weighted by readings
    upto = F.sum("n").over(Window.partitionBy(SOURCE).orderBy("figure", "season"))
    total = F.sum("n").over(Window.partitionBy(SOURCE))
    ranked = figure.withColumn("_upto", upto).withColumn("_all", total)
    pick = lambda rank: F.max(F.when((F.col("_upto") - F.col("n") <= rank) & (rank < F.col("_upto")), F.col("figure")))
    middle = ranked.groupBy(SOURCE).agg(
        ((pick(F.floor((F.col("_all") - 1) / 2)) + pick(F.floor(F.col("_all") / 2))) / 2).alias("middle")
    )
    seasonal = figure.join(middle, SOURCE).select(SOURCE, "season", (F.col("figure") - F.col("middle")).alias("seasonal"))
    return loose.join(small_side(seasonal), [SOURCE, "season"]).select(
        *placed.columns, (F.col("loose") - F.col("seasonal")).alias("residual")
    )


def _tail_counts(alpha: float):
    """Numbers of outliers at the low and the high end, from the tails in descending distance from the middle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: _Removal | None = None
        for batch in batches:
            columns = ("source_no", "n", "rank", "x", "s1", "s2")
            for source, n, rank, x, s1, s2 in zip(*(batch[c].tolist() for c in columns), strict=True):
                if state is None or state.source != source:
                    if state is not None:
                        yield state.result()
                    state = _Removal(source, n, alpha)
                state.take(rank, x, s1, s2)
        if state is not None:
            yield state.result()

    return run


class _Removal:
    """The generalised ESD test on two tails that arrive outermost rows first.

    A row waits until the one that competes with it has come; rows of both
    tails come in order of their distance from the middle, so few wait.
    """

    def __init__(self, source: int, n: int, alpha: float):
        self.source, self.n = source, n
        self.limits = spikes._limits(n, alpha)
        self.low: list[tuple] = []
        self.high: list[tuple] = []
        self.gone = [0, 0]
        self.found = (0, 0)
        self.done = False

    def take(self, rank: int, x: float, s1: float, s2: float) -> None:
        if self.done:
            return
        if rank <= self.n // 2:
            heapq.heappush(self.low, (rank, x, s1, s2))
        else:
            heapq.heappush(self.high, (-rank, x, s1, s2))
        while self.low and self.high and not self.done:
            self.step()

    def step(self) -> None:
        limit = next(self.limits, None)
        if limit is None:
            self.done = True
            return
        (_, x_low, l1, l2), (_, x_high, h1, h2) = self.low[0], self.high[0]
        m = self.n - sum(self.gone)
        mean = (h1 + l1) / m
        square = (h2 + l2) / m - mean * mean
        spread = (max(square, 0.0) * m / (m - 1)) ** 0.5
        from_low, from_high = mean - x_low, x_high - mean
        if from_low > from_high:
            heapq.heappop(self.low)
            self.gone[0] += 1
        else:
            heapq.heappop(self.high)
            self.gone[1] += 1
        if max(from_low, from_high) > limit * spread:
            self.found = tuple(self.gone)
        middle = self.n // 2
        if spread == 0 or not self.gone[0] < middle < self.n - self.gone[1]:
            self.done = True

    def result(self) -> pd.DataFrame:
        return pd.DataFrame([(self.source, *self.found)], columns=["source_no", "n_low", "n_high"])


def _tails(residuals: DataFrame) -> DataFrame:
    """(source, n, rank, x, s1, s2): the sorted residuals that may decide the test, with sums from the middle outward.

    Ranks run from 1 in the order of residual and position; x is the distance
    from the middle residual, s1 and s2 are the sums of x and x² between the
    middle and the row, itself included.
    """
    ranked = written(running_sums(residuals.withColumn("one", F.lit(1)), [SOURCE], ["residual", "pos"], {"rank": "one"}, "ranks"), "ranks")
    centre = ranked.where(F.col("rank") == F.floor(F.col("n") / 2) + 1).select(SOURCE, F.col("residual").alias("_c"))
    x = F.col("residual") - F.col("_c")
    low = F.col("rank") <= F.floor(F.col("n") / 2)
    sided = ranked.join(small_side(centre), SOURCE).select(
        SOURCE, "n", "rank", "pos", x.alias("x"), (x * x).alias("xx"), low.alias("low"),
        F.when(low, -F.col("rank")).otherwise(F.col("rank")).alias("_out"),
    )
    return running_sums(sided, [SOURCE, "low"], ["_out"], {"s1": "x", "s2": "xx"}, "tails")


def _far_out(tails: DataFrame, alpha: float) -> DataFrame:
    """The rows of `_tails` that can be outliers, or be removed before one.

    Whatever is removed, three quarters of the readings stay, and with them one
    of five stretches of eleven sixteenths. The smallest spread and the least
    and largest mean that such a rest may have bound the rows that can exceed
    the smallest limit.
    """
    at = lambda k: F.floor(F.col("n") * k / 16)
    marks = [*range(17)]
    # sums up to the k-th sixteenth, counted from the middle: negative below it
    signed = lambda c: F.when(F.col("low"), -F.col(c)).otherwise(F.col(c))
    below = {f"{c}_{k}": F.max(F.when(F.col("rank") == at(k) + F.when(F.col("low"), 1).otherwise(0), signed(c))) for k in marks for c in ("s1", "s2")}
    sums = tails.groupBy(SOURCE).agg(F.max("n").alias("n"), F.max(F.when(F.col("low"), F.lit(1)).otherwise(0)).alias("_l"), *[v.alias(k) for k, v in below.items()])

    def bounds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = []
            for r in frame.to_dict("records"):
                n = int(r["n"])
                edge = [n * k // 16 for k in marks]
                s1, s2 = ([0.0 if r[f"{c}_{k}"] is None or np.isnan(r[f"{c}_{k}"]) else r[f"{c}_{k}"] for k in marks] for c in ("s1", "s2"))
                squares = []
                for k in range(6):
                    m, a, b = edge[k + 11] - edge[k], s1[k + 11] - s1[k], s2[k + 11] - s2[k]
                    squares.append(max(0.0, b - a * a / m))
                # means of the lowest and of the highest three quarters
                least, most = (s1[12] - s1[0]) / edge[12], (s1[16] - s1[4]) / (n - edge[4])
                reach = min(squares) ** 0.5 / (n - 1) ** 0.5 * spikes.limit_of(n, n // 4, alpha) * 0.999
                rows.append((r["source_no"], most - reach, least + reach))
            yield pd.DataFrame(rows, columns=["source_no", "below", "above"])

    limits = sums.mapInPandas(bounds, "source_no int, below double, above double")
    far = (F.col("x") < F.col("below")) | (F.col("x") > F.col("above"))
    return tails.join(small_side(limits), SOURCE).where(far)


def _candidates(placed: DataFrame) -> DataFrame:
    """placed with `candidate`: outliers of the generalised ESD test on the residuals."""
    residuals = written(_residuals(placed), "residuals")
    tails = written(_tails(residuals), "tails")
    far = _far_out(tails, spikes.ALPHA)
    stream = far.repartition(SOURCE).sortWithinPartitions(F.col(SOURCE), F.abs("x").desc(), "rank")
    counts = written(
        stream.select(SOURCE, "n", "rank", "x", "s1", "s2").mapInPandas(_tail_counts(spikes.ALPHA), "source_no int, n_low bigint, n_high bigint"),
        "outliers",
    )
    out = (F.col("rank") <= F.col("n_low")) | (F.col("rank") > F.col("n") - F.col("n_high"))
    flagged = tails.join(small_side(counts), SOURCE).where(out).select(SOURCE, "pos", F.lit(True).alias("candidate"))
    joined = placed.join(flagged, [SOURCE, "pos"], "left")
    return joined.select(*placed.columns, F.coalesce("candidate", F.lit(False)).alias("candidate"))


def _limits(usual: DataFrame) -> DataFrame:
    """(source, limit): how far off its neighbours a spike is at least, from the usual readings in blocks of positions."""
    before = neighbour(usual, [SOURCE], ["pos"], ["value"], after=False, name="_before")
    steps = before.select(SOURCE, BLOCK, "pos", "value", F.abs(F.col("value") - F.col("_before.value")).alias("step"))
    most = spikes.LONE_MOVES_AT_MOST + 1

    def top(df: DataFrame, *group: str) -> DataFrame:
        return df.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("step")))).where(F.col("_r") <= most)

    largest = top(top(steps.where("step is not null").select(SOURCE, BLOCK, "step"), SOURCE, BLOCK), SOURCE)
    ranked = [F.max(F.when(F.col("_r") == i + 1, F.col("step"))).alias(f"m{i}") for i in range(most)]
    move = F.col(f"m{most - 1}")
    for i in reversed(range(most - 1)):
        here, following = F.col(f"m{i}"), F.col(f"m{i + 1}")
        lone = (here > spikes.LONE_MOVE * following) & (following > 0)
        move = F.when(F.coalesce(lone, F.lit(False)), move).otherwise(here)
    level = usual.groupBy(SOURCE).agg(F.min(F.abs("value")).alias("level"))  # used where all usual readings are equal
    joined = level.join(largest.groupBy(SOURCE).agg(*ranked), SOURCE, "left")
    limit = F.when(move.isNull(), float("inf")).when(move > 0, spikes.MOVES * move).otherwise(F.col("level"))
    return joined.select(SOURCE, limit.alias("limit"))


def _settle(blocks: DataFrame, spike_under, start: DataFrame) -> DataFrame:
    """The spikes (source, pos) when limits and spikes agree with each other.

    `start` are the readings left out of the first limits; `spike_under(spikes,
    limits)` gives the spikes under new limits.
    """
    spikes_now = written(start.select(SOURCE, "pos"), "spikes")
    for _ in range(ROUNDS):
        usual = blocks.join(spikes_now, [SOURCE, "pos"], "left_anti")
        limits = written(_limits(usual), "limits")
        found = written(spike_under(spikes_now, limits).select(SOURCE, "pos"), "spikes")
        moved = found.exceptAll(spikes_now).unionByName(spikes_now.exceptAll(found)).limit(1).count()
        spikes_now = found
        if not moved:
            break
    return spikes_now


def _spikes_in_order(blocks: DataFrame) -> DataFrame:
    """Single or double readings off both neighbours, which are level with each other."""

    def judge(part: pd.DataFrame, core: np.ndarray) -> pd.DataFrame:
        x, chosen = part["value"].to_numpy(), part["candidate"].to_numpy(dtype=bool)
        n = len(x)
        out = {name: np.full(n, np.nan) for name in ("off0", "gap0", "off1", "gap1", "off2", "gap2")}
        if n > 2:
            before, after = x[:-2], x[2:]
            out["off0"][1:-1] = np.minimum(np.abs(x[1:-1] - before), np.abs(x[1:-1] - after))
            out["gap0"][1:-1] = np.abs(after - before)
        if n > 3:
            before, after = x[:-3], x[3:]
            pair = np.full(n - 3, np.inf)
            for own in (x[1:-2], x[2:-1]):
                pair = np.minimum(pair, np.minimum(np.abs(own - before), np.abs(own - after)))
            pair[~(chosen[1:-2] & chosen[2:-1])] = np.nan
            gap = np.abs(after - before)
            out["off1"][1:-2], out["gap1"][1:-2] = pair, gap  # first of two
            out["off2"][2:-1], out["gap2"][2:-1] = pair, gap  # second of two
        own = core & chosen
        return part.loc[own, [SOURCE, "pos"]].assign(**{k: v[own] for k, v in out.items()})

    names = [f"{w}{i}" for i in range(3) for w in ("off", "gap")]
    columns = [SOURCE, "pos", "value", "candidate"]
    schema = ", ".join(["source_no int", "pos bigint", *[f"{c} double" for c in names]])
    moves = written(_per_chunk(blocks, 3, columns, lambda p, c: judge(p, c)[[SOURCE, "pos", *names]], schema), "moves")

    def spike_under(_: DataFrame, limits: DataFrame) -> DataFrame:
        holds = F.lit(False)
        for i in range(3):
            off, gap = F.col(f"off{i}"), F.col(f"gap{i}")
            one = ~F.isnan(off) & (off > F.col("limit")) & (gap <= F.least("limit", off))
            holds = holds | one
        return moves.join(small_side(limits), SOURCE).where(holds)

    return _settle(blocks, spike_under, blocks.where("candidate"))


def _level_with_most(blocks: DataFrame, limits: DataFrame) -> DataFrame:
    """Candidates (source, pos) near the middle of the other readings of their period and two periods around."""
    periods = running_sums(
        blocks.select(SOURCE, "period").distinct().withColumn("one", F.lit(1)), [SOURCE], ["period"], {"place": "one"}, "places"
    ).select(SOURCE, "period", "place")
    placed = written(blocks.join(periods, [SOURCE, "period"]).select(SOURCE, "pos", "place", "value", "candidate"), "placed")
    around = placed.select(SOURCE, F.explode(F.sequence(F.col("place") - 2, F.col("place") + 2)).alias("place"), "value")
    counts = around.groupBy(SOURCE, "place", "value").agg(F.count("*").alias("_n"))
    upto = written(running_sums(counts, [SOURCE, "place"], ["value"], {"_upto": "_n"}, "around"), "around")
    sizes = upto.groupBy(SOURCE, "place").agg((F.max("_upto") - 1).alias("others"))
    holds = lambda rank: (F.col("_upto") - F.col("_n") <= rank) & (rank < F.col("_upto"))
    low, high = F.floor((F.col("others") - 1) / 2), F.floor(F.col("others") / 2)
    ranks = {"l0": low, "l1": low + 1, "h0": high, "h1": high + 1}
    near = upto.join(sizes, [SOURCE, "place"]).groupBy(SOURCE, "place").agg(
        F.max("others").alias("others"), *[F.max(F.when(holds(r), F.col("value"))).alias(name) for name, r in ranks.items()]
    )
    # without the reading itself, ranks from its own on move up by one
    other = lambda c: F.when(F.col(f"{c}0") >= F.col("value"), F.col(f"{c}1")).otherwise(F.col(f"{c}0"))
    middle = (other("l") + other("h")) / 2
    judged = placed.where("candidate").join(near, [SOURCE, "place"]).join(small_side(limits), SOURCE)
    return judged.where((F.col("others") > 0) & (F.abs(middle - F.col("value")) <= F.col("limit"))).select(SOURCE, "pos")


def _spikes_among_versions(blocks: DataFrame) -> DataFrame:
    """Readings off all other readings of their period and the nearest ones before and after it."""
    first = written(_limits(blocks.where("not candidate")), "limits")
    chosen = blocks.where("candidate")
    start = chosen.join(_level_with_most(blocks, first), [SOURCE, "pos"], "left_anti")
    by_value = ordered_blocks(
        blocks.select(SOURCE, "period", "value", "pos", "candidate"), [SOURCE, "period", "value", "pos"], "by-value"
    )
    columns = [SOURCE, "pos", "period", "value", "spike"]

    def judge(part: pd.DataFrame, core: np.ndarray) -> pd.DataFrame:
        period, value, spike = part["period"].to_numpy(), part["value"].to_numpy(), part["spike"].to_numpy(dtype=bool)
        # the chunk's halo holds the row before its first and after its last one, unless the source ends there
        change = period[1:] != period[:-1]
        begins = np.flatnonzero(np.concatenate([[part["pos"].iat[0] == 1], change]) & core)
        ends = np.flatnonzero(np.concatenate([change, [True]]) & core)
        rows = []
        for i in begins.tolist():
            near = [v for v, s in zip(value[max(0, i - spikes.REACH) : i], spike[max(0, i - spikes.REACH) : i], strict=True) if not s]
            rows.append((part["source_no"].iat[0], int(period[i]), near[-2:], None))
        for i in ends.tolist():
            near = [v for v, s in zip(value[i + 1 : i + 1 + spikes.REACH], spike[i + 1 : i + 1 + spikes.REACH], strict=True) if not s]
            rows.append((part["source_no"].iat[0], int(period[i]), None, near[:2]))
        return pd.DataFrame(rows, columns=[SOURCE, "period", "before", "after"])

    def spike_under(now: DataFrame, limits: DataFrame) -> DataFrame:
        marked = now.withColumn("spike", F.lit(True))
        known = lambda df: df.join(marked, [SOURCE, "pos"], "left").withColumn("spike", F.coalesce("spike", F.lit(False)))
        beside = _per_chunk(
            known(blocks), spikes.REACH + 1, columns, judge, "source_no int, period int, before array<double>, after array<double>"
        ).groupBy(SOURCE, "period").agg(F.first("before", True).alias("before"), F.first("after", True).alias("after"))
        # written once: its neighbours in both directions and its counts are read from it
        ranked = written(known(by_value), "ranked")
        usual = ~F.col("spike")
        keys, order = [SOURCE, "period"], ["value", "pos"]
        near = neighbour(ranked, keys, order, ["value"], after=False, name="_low", among=usual)
        near = neighbour(near, keys, order, ["value"], after=True, name="_high", among=usual)
        counts = ranked.groupBy(*keys).agg(F.count(F.when(usual, 1)).alias("n_usual"))
        all_known = near.where("candidate").join(counts, keys).join(beside, keys).join(small_side(limits), SOURCE)
        same = F.filter(F.array("_low.value", "_high.value"), lambda v: v.isNotNull())
        around = F.concat(same, "before", "after")
        n_same = F.col("n_usual") - usual.cast("int")
        enough = (n_same + F.size("before") + F.size("after") >= 2) & ((F.size(same) > 0) | ((F.size("before") > 0) & (F.size("after") > 0)))
        least = F.array_min(F.transform(around, lambda v: F.abs(v - F.col("value"))))
        return all_known.where(enough & (least > F.col("limit")))

    return _settle(blocks, spike_under, start)


def _stuck(blocks: DataFrame) -> DataFrame:
    """(source, pos) of runs of equal readings in sources that seldom repeat themselves otherwise."""
    before = neighbour(blocks, [SOURCE], ["pos"], ["value"], after=False, name="_before")
    value = F.col("value")
    same = F.coalesce(F.abs(value - F.col("_before.value")) <= 1e-11 * F.abs(value), F.lit(False))
    fresh = before.select(SOURCE, "pos", (~same).cast("int").alias("fresh"), spikes.many_decimals(value).cast("double").alias("fine"))
    runs = written(running_sums(fresh, [SOURCE], ["pos"], {"run": "fresh"}, "runs"), "runs")
    whole = runs.groupBy(SOURCE).agg(
        F.count("*").alias("n"), F.sum(1 - F.col("fresh")).alias("repeats"), F.avg("fine").alias("fine_share")
    )
    sized = runs.groupBy(SOURCE, "run").agg(F.count("*").alias("length")).where(F.col("length") >= spikes.STUCK_RUN)
    others = F.col("n") - F.col("length")
    kept = sized.join(small_side(whole), SOURCE).where(
        (F.col("fine_share") > 0.5)
        & ((others == 0) | (F.col("repeats") - F.col("length") + 1 < spikes.STUCK_REPEATS * others))
    )
    return runs.join(kept.select(SOURCE, "run"), [SOURCE, "run"]).select(SOURCE, "pos")


def judge(readings: DataFrame, *, versions: bool) -> DataFrame:
    """(source_no, period, digits, kind) of the implausible readings.

    `readings` has source_no int, period int, at bigint, digits string and
    value double, one row per reading; all sources have many.
    """
    order = ["period", "at", "digits"]
    sizes = readings.groupBy(SOURCE).agg(F.count("*").alias("n"))
    counted = running_sums(readings.withColumn("one", F.lit(1)), [SOURCE], order, {"pos": "one"}, "positions")
    placed = written(
        counted.join(small_side(sizes), SOURCE).select(SOURCE, *order, "value", F.col("pos").cast("bigint").alias("pos"), "n"), "placed"
    )
    blocks = ordered_blocks(_candidates(placed), [SOURCE, "pos"], "in-order")
    found = (_spikes_among_versions if versions else _spikes_in_order)(blocks).withColumn("kind", F.lit(spikes.SPIKE))
    if not versions:
        # a reading is a spike before it is stuck
        found = found.unionByName(
            _stuck(blocks).join(found, [SOURCE, "pos"], "left_anti").withColumn("kind", F.lit(spikes.STUCK))
        )
    return placed.join(found, [SOURCE, "pos"]).select(SOURCE, "period", "digits", "kind")
