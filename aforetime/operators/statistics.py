"""Aggregates over pairs, weights, ranks and thresholds. Nulls are left out of every statistic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aforetime.storage import running_sums, small_side, written


def effective_size(weight: Column) -> Column:
    """(Σw)² / Σw², 0 where there is no weight."""
    return F.coalesce(F.pow(F.sum(weight), 2) / F.nullif(F.sum(weight * weight), F.lit(0.0)), F.lit(0.0))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Σwx / Σw over rows with a value."""
    used = F.when(value.isNotNull(), weight)
    return F.sum(used * value) / F.nullif(F.sum(used), F.lit(0.0))


def average_ranks(df: DataFrame, group: Sequence[str], column: str, name: str) -> DataFrame:
    """df with the 1-based rank of a column within its group, ties averaged.

    Values are counted first and their counts summed in blocks, so a group may
    hold most of all rows.
    """
    counts = df.groupBy(*group, column).agg(F.count("*").alias("_n"))
    upto = running_sums(counts, group, [column], {"_upto": "_n"}, "ranks")
    ranks = upto.select(*group, column, (F.col("_upto") - (F.col("_n") - 1) / 2.0).alias(name))
    return df.join(ranks, [*group, column])


def rank_correlation(pairs: DataFrame, group: Sequence[str], left: str, right: str) -> DataFrame:
    """(group, n, pearson, spearman) of two columns; null where one doesn't vary. Rows with a null group are left out."""
    both = pairs.where(F.col(left).isNotNull() & F.col(right).isNotNull()).dropna(subset=list(group))
    ranked = average_ranks(average_ranks(both, group, left, "_l"), group, right, "_r")
    varies = (F.stddev_pop(left) > 0) & (F.stddev_pop(right) > 0)
    return ranked.groupBy(*group).agg(
        F.count("*").alias("n"),
        F.when(varies, F.corr(left, right)).alias("pearson"),
        F.when(varies, F.corr("_l", "_r")).alias("spearman"),
    )


def sign_disagreement(left: Column, right: Column, material: float) -> list[Column]:
    """Counts of opposite signs, and of those where both sides are at least `material`."""
    opposite = F.signum(left) * F.signum(right) < 0
    return [
        F.count(F.when(opposite, 1)).alias("n_disagree"),
        F.count(F.when(opposite & (F.least(F.abs(left), F.abs(right)) >= material), 1)).alias("n_substantive"),
    ]


def gram(wide: DataFrame, columns: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Long second-moment matrix (group, i, j, moment): Σ xᵢxⱼ / rows, nulls as 0, all pairs in one pass."""
    pairs = [(a, b) for k, a in enumerate(columns) for b in list(columns)[k:]]
    x = {c: F.coalesce(c, F.lit(0.0)) for c in columns}
    sums = wide.groupBy(*group).agg(*[(F.sum(x[a] * x[b]) / F.count("*")).alias(f"{a}|{b}") for a, b in pairs])
    cells = F.array(
        *[F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), F.col(f"`{a}|{b}`").alias("moment")) for a, b in pairs]
    )
    return sums.select(*group, F.explode(cells).alias("m")).select(*group, "m.i", "m.j", "m.moment")


def kernel_sizes(observations: DataFrame, group: Sequence[str], at: str, bandwidth: float) -> DataFrame:
    """(group, at, n, effective_size): how many observations lie around each month of a group under a Gaussian kernel.

    `at` is a month index. Observations are counted per month first, so a group
    meets itself once per pair of months, however many observations it has.
    Rows with a null group or month are left out.
    """
    keys = list(group)
    counts = written(observations.dropna(subset=[*keys, at]).groupBy(*keys, at).agg(F.count("*").alias("_n")), "months")
    around = counts.select(*keys, F.col(at).alias("_at"), F.col("_n").alias("_m"))
    weight = F.exp(-0.5 * F.pow((F.col("_at") - F.col(at)) / bandwidth, 2))
    summed = counts.join(around, keys).groupBy(*keys, at).agg(
        F.max("_n").alias("n"), F.sum(F.col("_m") * weight).alias("_w"), F.sum(F.col("_m") * weight * weight).alias("_ww")
    )
    return summed.select(*keys, at, "n", (F.col("_w") ** 2 / F.col("_ww")).alias("effective_size"))


def quantiles(df: DataFrame, group: Sequence[str], column: str, wanted: dict[str, float]) -> DataFrame:
    """(group, a column per wanted quantile): exact, interpolated between neighbours, nulls left out.

    Values are counted first and their counts summed in blocks, so a group may
    hold most of all rows. Rows with a null group are left out.
    """
    keys = list(group)
    counts = df.where(F.col(column).isNotNull()).dropna(subset=keys).groupBy(*keys, column).agg(F.count("*").alias("_n"))
    upto = written(running_sums(counts, keys, [column], {"_upto": "_n"}, "quantiles"), "quantiles")
    sizes = upto.groupBy(*keys).agg((F.max("_upto") - 1).alias("_last"))
    holds = lambda rank: (F.col("_upto") - F.col("_n") <= rank) & (rank < F.col("_upto"))
    ranks = {name: q * F.col("_last") for name, q in wanted.items()}
    ends = {
        f"{name}_{end}": F.max(F.when(holds(cut(rank)), F.col(column)))
        for name, rank in ranks.items() for end, cut in (("low", F.floor), ("high", F.ceil))
    }
    found = upto.join(small_side(sizes), keys).groupBy(*keys).agg(F.max("_last").alias("_last"), *[e.alias(n) for n, e in ends.items()])
    between = lambda n: F.col(f"{n}_low") + (F.col(f"{n}_high") - F.col(f"{n}_low")) * (ranks[n] - F.floor(ranks[n]))
    return found.select(*keys, *[between(n).alias(n) for n in wanted])


def policy_metrics(
    scored: DataFrame, thresholds: DataFrame, *, score: str, harm: str, cost: float, group: Sequence[str]
) -> DataFrame:
    """Per threshold: coverage, false authorisations, selective risk and mean loss of authorising below it.

    Scores are aggregated to distinct values first and thresholds met by running
    sums, so the work is linear in rows, not rows times thresholds.
    """
    keys = list(group)
    per_score = scored.where(F.col(score).isNotNull()).groupBy(*keys, score).agg(
        F.count("*").alias("_n"), F.sum(F.col(harm).cast("bigint")).alias("_bad")
    )
    cuts = thresholds.select(
        *keys, F.col("threshold").alias(score), F.lit(0).cast("bigint").alias("_n"),
        F.lit(0).cast("bigint").alias("_bad"), F.lit(True).alias("_cut")
    )
    line = per_score.withColumn("_cut", F.lit(False)).unionByName(cuts)
    # at equal scores the threshold comes after the scores it admits
    sums = running_sums(
        line.groupBy(*keys, score, "_cut").agg(F.sum("_n").alias("_n"), F.sum("_bad").alias("_bad")), keys,
        [score, "_cut"], {"a": "_n", "bad": "_bad"}, "policy"
    )
    totals = per_score.groupBy(*keys).agg(F.sum("_n").alias("n"))
    summed = sums.where("_cut").join(small_side(totals), keys)
    return summed.select(
        *keys,
        F.col(score).alias("threshold"),
        (F.col("a") / F.col("n")).alias("coverage"),
        F.col("bad").alias("false_authorisations"),
        (F.col("bad") / F.nullif("a", F.lit(0))).alias("selective_risk"),
        ((F.col("bad") + cost * (F.col("n") - F.col("a"))) / F.col("n")).alias("mean_loss"),
    )
