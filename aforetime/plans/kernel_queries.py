"""Per-group fits, geometry and resampling over the test tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aforetime.operators import kernels
from aforetime.operators.kernels import FLAT, OK, TOO_FEW
from aforetime.plans.registry import Registry
from aforetime.plans.views import PANEL_SQL, panel
from aforetime.sources.tables import table

R = Registry()
SOURCE = ["panel_id", "series_id"]


def _observed(spark: SparkSession, folder: str) -> DataFrame:
    return panel(spark, folder).where(F.col("value").isNotNull()).select(*SOURCE, "month", "value")


@R.query()
def exact_1d_kmeans(spark: SparkSession, folder: str) -> DataFrame:
    """Two exact levels of every source."""

    def fit(rows: pd.DataFrame) -> list[tuple]:
        x = rows["value"].to_numpy(dtype=float)
        if len(x) < 4:
            return [(TOO_FEW, None, None, None)]
        loss, centres = kernels.best_split_1d(x, 2)
        return [(OK, loss, centres[0], centres[1])]

    return kernels.per_group(
        _observed(spark, folder), SOURCE, ["month"], fit, "status string, loss double, low double, high double"
    )


@R.query()
def hmm_states(spark: SparkSession, folder: str) -> DataFrame:
    """A two-state Gaussian chain per source."""

    def fit(rows: pd.DataFrame) -> list[tuple]:
        x = rows["value"].to_numpy(dtype=float)
        if len(x) < 36:
            return [(TOO_FEW, None, None, None, None, None)]
        if np.ptp(x) == 0:
            return [(FLAT, None, None, None, None, None)]
        centre, scale = np.median(x), x.std()
        mean, _, move, trace = kernels.gaussian_hmm((x - centre) / scale)
        levels = mean * scale + centre
        return [(OK, float(levels[0]), float(levels[1]), float(move[0, 0]), float(move[1, 1]), trace[-1])]

    fields = "status string, low double, high double, stay_low double, stay_high double, log_likelihood double"
    return kernels.per_group(_observed(spark, folder), SOURCE, ["month"], fit, fields)


@R.query()
def change_point_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Causal segments of every source."""

    def fit(rows: pd.DataFrame) -> list[tuple]:
        segment = kernels.change_points(rows["value"].to_numpy(dtype=float))
        return list(zip(rows["month"].tolist(), segment.tolist(), strict=True))

    return kernels.per_group(_observed(spark, folder), SOURCE, ["month"], fit, "month date, segment int")


@R.query()
def em_pca_rank(spark: SparkSession, folder: str) -> DataFrame:
    """Number of common components of every panel, from its ragged month × series matrix."""

    def fit(rows: pd.DataFrame) -> list[tuple]:
        matrix = rows.pivot(index="month", columns="series_id", values="value").to_numpy(dtype=float)
        matrix = matrix[:, np.isfinite(matrix).sum(0) >= 24]
        matrix = matrix[np.isfinite(matrix).any(1)]
        if matrix.shape[1] < 3 or len(matrix) < 36:
            return [(TOO_FEW, None, None)]
        rank, criterion = kernels.choose_rank(matrix, min(3, matrix.shape[1] - 1))
        return [(OK, rank, criterion)]

    return kernels.per_group(
        _observed(spark, folder), ["panel_id"], ["month", "series_id"], fit,
        "status string, rank int, criterion double"
    )


#: Months of the recent histories that are compared with the whole one.
GEOMETRY_MONTHS = (36, 96, 120, 144)


def _moments(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Expanding and recent moments of all pairs of each panel's series, a row per month and window; the series by number.

    The moments are those of the pairs (1, 1), (1, 2) … (k, k) in order.
    """
    whole = Window.partitionBy(*SOURCE)
    cells = panel(spark, folder)
    z = (F.col("value") - F.avg("value").over(whole)) / F.greatest(F.stddev_pop("value").over(whole), F.lit(1e-8))
    cells = cells.withColumn("z", F.coalesce(z, F.lit(0.0)))
    # one row per series
    series = cells.select(*SOURCE).distinct().withColumn(
        "k", F.row_number().over(Window.partitionBy("panel_id").orderBy("series_id"))
    )
    sizes = series.groupBy("panel_id").agg(F.max("k").alias("n_series"))
    numbered = cells.alias("c").join(
        series.alias("s"), F.col("c.panel_id").eqNullSafe(F.col("s.panel_id")) & F.col("c.series_id").eqNullSafe(F.col("s.series_id"))
    ).select("c.panel_id", "month", "k", "z")
    monthly = numbered.groupBy("panel_id", "month").agg(F.map_from_entries(F.collect_list(F.struct("k", "z"))).alias("z"))
    monthly = monthly.alias("m").join(sizes.alias("s"), F.col("m.panel_id").eqNullSafe(F.col("s.panel_id"))).select("m.*", "n_series")

    def of(k):
        return F.coalesce(F.element_at("z", k), F.lit(0.0))

    def products(i):
        return F.transform(
            F.sequence(i, "n_series"), lambda j: F.struct(i.alias("i"), j.alias("j"), (of(i) * of(j)).alias("product"))
        )

    pairs = monthly.select(
        "panel_id", "month", F.explode(F.flatten(F.transform(F.sequence(F.lit(1), "n_series"), products))).alias("p")
    ).select("panel_id", "month", "p.*")
    line = Window.partitionBy("panel_id", "i", "j").orderBy("month")
    expanding = F.avg("product").over(line.rowsBetween(Window.unboundedPreceding, 0))
    recent = [
        F.struct(F.lit(w).alias("months"), F.avg("product").over(line.rowsBetween(1 - w, 0)).alias("recent")) for w in GEOMETRY_MONTHS
    ]
    found = pairs.select(
        "panel_id", "month", "i", "j", F.row_number().over(line).alias("n"), expanding.alias("expanding"), F.array(*recent).alias("w")
    ).select("*", F.explode("w").alias("r")).where(F.col("n") > F.col("r.months"))
    moments = found.groupBy("panel_id", "month", F.col("r.months").alias("months")).agg(
        F.array_sort(F.collect_list(F.struct("i", "j", "expanding", "r.recent"))).alias("p")
    )
    return moments.select("panel_id", "month", "months", F.col("p.expanding").alias("expanding"), F.col("p.recent").alias("recent")), series


@R.query()
def gram_geometry(spark: SparkSession, folder: str) -> DataFrame:
    """How far the leading plane of the last months is turned from that of the whole history.

    A row per panel, month, window and left-out series; `omitted` is null and
    `variant` "full" where none is left out.
    """
    moments, series = _moments(spark, folder)

    def geometry(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for length, part in batch.groupby(batch["expanding"].map(len)):
                size = int((2 * length) ** 0.5)
                rows, columns = np.triu_indices(size)
                matrices = np.zeros((2, len(part), size, size))
                for matrix, sums in zip(matrices, (part["expanding"], part["recent"]), strict=True):
                    matrix[:, rows, columns] = matrix[:, columns, rows] = np.stack(sums.to_list())
                for omitted in range(size + 1 if size > 1 else 1):
                    kept = np.flatnonzero(np.arange(1, size + 1) != omitted)
                    left, right = np.linalg.eigh(matrices[:, :, kept[:, None], kept])[1][..., -2:]
                    cosines = np.clip(np.linalg.svd(left.transpose(0, 2, 1) @ right, compute_uv=False), 0, 1)
                    yield part[["panel_id", "month", "months"]].assign(
                        k=omitted, smallest_cosine=cosines.min(1), projector_distance=np.sqrt(np.mean(1 - cosines**2, 1))
                    )

    kind = moments.schema["panel_id"].dataType.simpleString()
    found = moments.mapInPandas(
        geometry, f"panel_id {kind}, month date, months int, k int, smallest_cosine double, projector_distance double"
    ).alias("g")
    named = found.join(
        series.alias("s"), F.col("g.panel_id").eqNullSafe(F.col("s.panel_id")) & (F.col("g.k") == F.col("s.k")), "left"
    )
    return named.select(
        "g.panel_id", "month", "months", F.when(F.col("g.k") == 0, "full").otherwise("omit").alias("variant"),
        F.col("s.series_id").alias("omitted"), "smallest_cosine", "projector_distance"
    )


@R.query()
def geometry_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles and breach rates of the geometry per panel, window and left-out series, and whether it fails on both counts."""
    g = gram_geometry(spark, folder)
    breach = (F.col("smallest_cosine") < 0.9) & (F.col("projector_distance") > 0.35)
    return g.groupBy("panel_id", "months", "variant", "omitted").agg(
        F.count("*").alias("n_months"),
        F.percentile("smallest_cosine", 0.1).alias("p10_cosine"),
        F.percentile("projector_distance", 0.9).alias("p90_distance"),
        F.avg(breach.cast("int")).alias("breach_rate"),
    ).withColumn("fails", (F.col("p10_cosine") < 0.9) & (F.col("p90_distance") > 0.35))


#: Replicates, and months of a block, of the bootstrap intervals.
BOOTSTRAP_DRAWS = 1_999
BOOTSTRAP_BLOCKS = (12, 24, 36)


@R.query()
def block_bootstrap_ci(spark: SparkSession, folder: str) -> DataFrame:
    """95 % block-bootstrap intervals of every source's mean and upper decile, a row per block length."""
    listed = _observed(spark, folder).groupBy(*SOURCE).agg(
        F.array_sort(F.collect_list(F.struct("month", "value"))).alias("cells")
    )
    listed = listed.select(*SOURCE, F.transform("cells", lambda c: c["value"]).alias("x"))
    return kernels.block_intervals(listed, SOURCE, "x", replicates=BOOTSTRAP_DRAWS, blocks=BOOTSTRAP_BLOCKS, seed=20_231)


@R.query("""WITH s AS (SELECT l_shipmode AS g, x, y, avg(x) OVER w AS mx, avg(y) OVER w AS my, count(*) OVER w AS n FROM (
    SELECT l_returnflag || l_linestatus AS l_shipmode, l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem) WINDOW w AS (PARTITION BY l_shipmode)),
b AS (SELECT g, sum((x - mx) * (y - my)) / sum((x - mx) ** 2) AS slope, sum((x - mx) ** 2) AS sxx FROM s GROUP BY ALL)
SELECT s.g AS grp, any_value(n) AS n, round(any_value(slope), 7) AS slope,
  round(sqrt(sum((x - mx) ** 2 * (y - my - slope * (x - mx)) ** 2 / (1 - 1.0 / n - (x - mx) ** 2 / sxx) ** 2)) / any_value(sxx), 7) AS hc3_error
FROM s JOIN b ON b.g = s.g GROUP BY ALL""")
def ols_hc3(spark: SparkSession, folder: str) -> DataFrame:
    """Slope of price on quantity per flag and status with leverage-robust errors; two aggregations, no per-group matrix."""
    rows = table(spark, folder, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("grp"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y")
    )
    means = rows.groupBy("grp").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.count("*").alias("n"))
    centred = rows.join(means, "grp").select(
        "grp", "n", (F.col("x") - F.col("mx")).alias("dx"), (F.col("y") - F.col("my")).alias("dy")
    )
    slopes = centred.groupBy("grp").agg(
        (F.sum(F.col("dx") * F.col("dy")) / F.sum(F.col("dx") ** 2)).alias("slope"),
        F.sum(F.col("dx") ** 2).alias("sxx")
    )
    left = 1 - 1 / F.col("n") - F.col("dx") ** 2 / F.col("sxx")
    part = F.col("dx") ** 2 * (F.col("dy") - F.col("slope") * F.col("dx")) ** 2 / left**2
    return centred.join(slopes, "grp").groupBy("grp").agg(
        F.max("n").alias("n"), F.round(F.max("slope"), 7).alias("slope"), F.round(F.sqrt(F.sum(part)) / F.max("sxx"), 7).alias("hc3_error")
    )


@R.query(f"""WITH {PANEL_SQL}
SELECT panel_id, series_id, count(*) AS n, round(sum(exp(-0.5 * ((datediff('month', DATE '2010-01-01', month)) / 24.0) ** 2)) ** 2
  / sum(exp(-0.5 * ((datediff('month', DATE '2010-01-01', month)) / 24.0) ** 2) ** 2), 6) AS effective_size
FROM panel WHERE value IS NOT NULL GROUP BY ALL""")
def kernel_effective_size(spark: SparkSession, folder: str) -> DataFrame:
    """Effective number of readings around a month under a Gaussian kernel of two years."""
    away = F.months_between("month", F.lit("2010-01-01").cast("date"))
    weight = F.exp(-0.5 * F.pow(away / 24.0, 2))
    return _observed(spark, folder).groupBy(*SOURCE).agg(
        F.count("*").alias("n"), F.round(F.pow(F.sum(weight), 2) / F.sum(weight * weight), 6).alias("effective_size")
    )


# What the scan for secrets looks for.
SECRET_PATTERNS = {
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "bearer_token": r"[Bb]earer [A-Za-z0-9._-]{20,}",
    "assigned_password": r"(?i)(password|passwd|secret|token|api_key)\s*[=:]\s*['\"][^'\"\s]{6,}['\"]",
    "mail_address": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]{2,}",
    "home_path": r"/(home|Users)/[A-Za-z0-9_.-]+",
}


@R.query(
    "SELECT source, " + ", ".join(
        f"count(*) FILTER (regexp_matches(text, '{p.replace(chr(39), chr(39) * 2)}')) AS {n}" for n,
        p in SECRET_PATTERNS.items()
    ) + ", count(*) AS n_documents FROM documents GROUP BY ALL"
)
def secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Documents per source that show each pattern."""
    hits = [F.count(F.when(F.col("text").rlike(p), 1)).alias(n) for n, p in SECRET_PATTERNS.items()]
    return table(spark, folder, "documents").groupBy("source").agg(*hits, F.count("*").alias("n_documents"))


@R.query("""WITH tokens AS (SELECT DISTINCT sha256 AS token FROM retrieval_record WHERE sha256 IS NOT NULL AND sha256 <> ''),
chars AS (SELECT token, unnest(string_split(token, '')) AS c FROM tokens),
freq AS (SELECT token, c, count(*) AS n FROM chars GROUP BY ALL)
SELECT token, CAST(sum(n) AS BIGINT) AS n_chars, round(-sum(n * log2(n / length(token))) / any_value(length(token)), 6) AS entropy FROM freq GROUP BY ALL""")
def token_entropy(spark: SparkSession, folder: str) -> DataFrame:
    """Bits per character of each distinct content hash."""
    tokens = table(spark, folder, "retrieval_record").where(F.length("sha256") > 0).select(F.col("sha256").alias("token")).distinct()
    chars = tokens.select("token", F.explode(F.split("token", "")).alias("c")).where(F.col("c") != "")
    freq = chars.groupBy("token", "c").agg(F.count("*").alias("n"))
    return freq.groupBy("token").agg(
        F.sum("n").alias("n_chars"), F.round(
            -F.sum(F.col("n") * F.log2(F.col("n") / F.length("token"))) / F.max(F.length("token")), 6
        ).alias("entropy")
    )


def _matrix(rows: pd.DataFrame) -> tuple[np.ndarray, list]:
    """Month × series matrix of the series with two years of readings, and its months."""
    wide = rows.pivot(index="month", columns="series_id", values="value")
    wide = wide.loc[:, wide.notna().sum() >= 24]
    return wide.to_numpy(dtype=float), wide.index.tolist()


@R.query()
def dynamic_factor(spark: SparkSession, folder: str) -> DataFrame:
    """The filtered common factor of every panel with its deviation."""

    def fit(rows: pd.DataFrame) -> list[tuple]:
        matrix, months = _matrix(rows)
        if matrix.shape[1] < 3 or len(matrix) < 36:
            return []
        means, variances, phi = kernels.factor_filter(matrix)
        return list(zip(months, means.tolist(), np.sqrt(variances).tolist(), [phi] * len(months), strict=True))

    fields = "month date, factor double, factor_sd double, phi double"
    return kernels.per_group(_observed(spark, folder), ["panel_id"], ["month", "series_id"], fit, fields)


@R.query()
def joint_support_hull(spark: SparkSession, folder: str) -> DataFrame:
    """Lines inside the convex hull of the small lines of their flag, in price and quantity per discount."""
    rows = table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("state"), F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("y"), "l_tax"
    )
    corners = kernels.hull_corners(rows.where("l_tax <= 0.02"), "state", "x", "y")
    inside = kernels.inside_hull("corners", "x", "y")
    return rows.join(corners, "state").groupBy("state").agg(
        F.count("*").alias("n"), F.count(F.when(inside, 1)).alias("n_supported"), F.max(F.size("corners")).alias("n_corners")
    )


@R.query()
def spline_penalty_cv(spark: SparkSession, folder: str) -> DataFrame:
    """The roughness penalty that predicts each source's next stretch best."""

    def fit(rows: pd.DataFrame) -> list[tuple]:
        x = rows["value"].to_numpy(dtype=float)
        if len(x) < 48:
            return [(TOO_FEW, None, None)]
        if np.ptp(x) == 0:
            return [(FLAT, None, None)]
        at = np.array([m.year * 12 + m.month for m in rows["month"]], dtype=float)
        z = (x - np.median(x)) / x.std()
        return [(OK, *kernels.penalty_by_forward_folds((at - at[0]) / 12, z, (0.01, 0.1, 1.0, 10.0, 100.0)))]

    return kernels.per_group(_observed(spark, folder), SOURCE, ["month"], fit, "status string, penalty double, loss double")
