"""Histories, scores, episodes and other ordered operators over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aforetime.operators import rolling
from aforetime.plans.registry import Registry
from aforetime.plans.views import PANEL_SQL, PRICES_SQL, monthly_prices, panel
from aforetime.sources.tables import table

R = Registry()
SOURCE = ["panel_id", "series_id"]

_HISTORY_SQL = f"""{PANEL_SQL},
scaled AS (SELECT *, value / greatest(1, max(abs(value)) OVER (PARTITION BY panel_id, series_id)) AS x FROM panel WHERE value IS NOT NULL),
h AS (SELECT *, avg(x) OVER w AS m, stddev_pop(x) OVER w AS s, count(x) OVER w AS n, var_pop(x) OVER w AS v FROM scaled
      WINDOW w AS (PARTITION BY panel_id, series_id ORDER BY month ROWS BETWEEN :frame PRECEDING AND 1 PRECEDING))"""


def _scaled(spark: SparkSession, folder: str) -> DataFrame:
    cells = panel(spark, folder).where(F.col("value").isNotNull())
    largest = F.max(F.abs("value")).over(Window.partitionBy(*SOURCE))
    return cells.withColumn("x", F.col("value") / F.greatest(F.lit(1.0), largest))


def _standard_sql(frame: str) -> str:
    return f"""WITH {_HISTORY_SQL.replace(":frame", frame)}
SELECT panel_id, series_id, month, CASE WHEN n >= 24 AND s >= 1e-6 THEN round((x - m) / s, 5) END AS z FROM h"""


def _standard(spark: SparkSession, folder: str, length: int | None) -> DataFrame:
    window = rolling.history_window(SOURCE, "month", length)
    z = rolling.standardised(F.col("x"), window, 24)
    steady = F.stddev_pop("x").over(window) >= 1e-6
    return _scaled(spark, folder).select(*SOURCE, "month", F.when(steady, F.round(z, 5)).alias("z"))


@R.query(_standard_sql("UNBOUNDED"))
def expanding_standardize(spark: SparkSession, folder: str) -> DataFrame:
    """Each reading against all earlier ones of its source."""
    return _standard(spark, folder, None)


@R.query(_standard_sql("36"))
def rolling_standardize(spark: SparkSession, folder: str) -> DataFrame:
    """Each reading against the 36 before it."""
    return _standard(spark, folder, 36)


@R.query(f"""WITH {_HISTORY_SQL.replace(":frame", "UNBOUNDED")}
SELECT panel_id, month, count(*) AS n_series, round(sum(-0.5 * (ln(2 * pi() * greatest(v, 0.05)) + (x - m) ** 2 / greatest(v, 0.05))), 6) AS log_score
FROM h WHERE n >= 24 GROUP BY ALL""")
def diag_gaussian_score(spark: SparkSession, folder: str) -> DataFrame:
    """Log density of a panel's month under the independent normals of its histories."""
    score = rolling.gaussian_log_score(F.col("x"), rolling.history_window(SOURCE, "month"), 24)
    scored = _scaled(spark, folder).withColumn("score", score).where(F.col("score").isNotNull())
    return scored.groupBy("panel_id", "month").agg(
        F.count("*").alias("n_series"), F.round(F.sum("score"), 6).alias("log_score")
    )


_BREACH_SQL = f"""{PANEL_SQL},
flags AS (SELECT panel_id, series_id, month, value IS NULL AS breach FROM panel)"""


def _breaches(spark: SparkSession, folder: str) -> DataFrame:
    return panel(spark, folder).select(*SOURCE, "month", F.col("value").isNull().alias("breach"))


@R.query(f"""WITH {_BREACH_SQL}
SELECT panel_id, series_id, month, max(breach::INT) OVER (PARTITION BY panel_id, series_id ORDER BY month ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) = 1 AS any_ahead
FROM flags QUALIFY lead(1, 3) OVER (PARTITION BY panel_id, series_id ORDER BY month) IS NOT NULL""")
def future_any_breach(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a cell is missing in the next three rows; the last three rows have no answer."""
    ahead = rolling.future_any(F.col("breach"), SOURCE, "month", 3)
    return _breaches(spark, folder).select(
        *SOURCE, "month", ahead.alias("any_ahead")
    ).where(F.col("any_ahead").isNotNull())


@R.query("""WITH flags AS (SELECT user_id, ts, value > 60 AS b, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events),
runs AS (SELECT *, i - row_number() OVER (PARTITION BY user_id, b ORDER BY ts) AS run FROM flags),
sized AS (SELECT *, count(*) OVER (PARTITION BY user_id, b, run) AS size, min(i) OVER (PARTITION BY user_id, b, run) AS begins FROM runs),
cut AS (SELECT *, sum(CASE WHEN NOT b AND size >= 3 AND i = begins THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS seg FROM sized),
inside AS (SELECT *, min(CASE WHEN b AND size >= 2 THEN i END) OVER (PARTITION BY user_id, seg) AS opens FROM cut WHERE NOT (NOT b AND size >= 3)),
whole AS (SELECT user_id, max(i) AS n FROM flags GROUP BY ALL),
found AS (SELECT user_id, seg, min(ts) AS lo, max(ts) AS hi, count(*) FILTER (b) AS n_breaches, max(i) AS e FROM inside WHERE i >= opens GROUP BY ALL)
SELECT f.user_id, row_number() OVER (PARTITION BY f.user_id ORDER BY lo) AS episode, epoch_us(lo) AS first_us, epoch_us(hi) AS last_us, n_breaches, e = n AS is_open
FROM found f JOIN whole w ON w.user_id = f.user_id""")
def breach_episodes(spark: SparkSession, folder: str) -> DataFrame:
    """Episodes of high values per user: two in a row open one, three low ones close it."""
    rows = table(spark, folder, "events").select(
        "user_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("value") > 60).alias("breach")
    )
    found = rolling.breach_episodes(rows, ["user_id"], "ts", "breach", onset=2, recovery=3)
    return found.select(
        "user_id", F.col("episode").cast("bigint").alias("episode"), F.unix_micros("first").alias("first_us"),
        F.unix_micros("last").alias("last_us"), "n_breaches", "is_open",
    )


@R.query(f"""WITH {PRICES_SQL}, centred AS (SELECT *, value - avg(value) OVER (PARTITION BY series) AS x FROM prices),
pairs AS (SELECT series, x, lag(x) OVER (PARTITION BY series ORDER BY month) AS y FROM centred)
SELECT series, round(greatest(least(sum(x * y) / sum(y * y), 0.98), -0.98), 6) AS phi, count(*) AS n_pairs FROM pairs WHERE y IS NOT NULL GROUP BY ALL""")
def lagged_factor_ar1(spark: SparkSession, folder: str) -> DataFrame:
    """Persistence of the monthly price series."""
    centred = monthly_prices(spark, folder).withColumn(
        "x", F.col("value") - F.avg("value").over(Window.partitionBy("series"))
    )
    found = rolling.lag_one_coefficient(centred, ["series"], "month", "x")
    return found.select("series", F.round("phi", 6).alias("phi"), "n_pairs")


@R.query(f"""WITH {PANEL_SQL}
SELECT panel_id, series_id, month, last_value(value IGNORE NULLS) OVER (PARTITION BY panel_id, series_id ORDER BY month) AS filled,
       value IS NULL AS was_missing FROM panel""")
def forward_fill(spark: SparkSession, folder: str) -> DataFrame:
    """The last observed value carried into missing cells."""
    w = Window.partitionBy(*SOURCE).orderBy("month")
    return panel(spark, folder).select(
        *SOURCE, "month", F.last("value", ignorenulls=True).over(w).alias("filled"), F.col("value").isNull().alias("was_missing")
    )


@R.query(f"""WITH {PRICES_SQL}, numbered AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY month) - 1 AS i, count(*) OVER (PARTITION BY series) AS n FROM prices)
SELECT a.series, a.month, a.value, b.value AS rotated, c.value AS reversed FROM numbered a
JOIN numbered b ON b.series = a.series AND b.i = (a.i + 23) % a.n JOIN numbered c ON c.series = a.series AND c.i = a.n - 1 - a.i""")
def negative_controls(spark: SparkSession, folder: str) -> DataFrame:
    """Series with their own values rotated by 23 rows and reversed in time, by self-joins on the row number."""
    whole = Window.partitionBy("series")
    numbered = (
        monthly_prices(spark, folder)
        .withColumn("i", F.row_number().over(whole.orderBy("month")) - 1)
        .withColumn("n", F.count("*").over(whole))
    )
    rotated = numbered.select("series", F.pmod(F.col("i") - 23, F.col("n")).alias("i"), F.col("value").alias("rotated"))
    mirrored = numbered.select("series", (F.col("n") - 1 - F.col("i")).alias("i"), F.col("value").alias("reversed"))
    return numbered.join(rotated, ["series", "i"]).join(mirrored, ["series", "i"]).select(
        "series", "month", "value", "rotated", "reversed"
    )


@R.query("""SELECT user_id, count(*) AS n_sessions, max(n) AS longest FROM (
  SELECT user_id, s, count(*) AS n FROM (
    SELECT *, sum(CASE WHEN gap IS NULL OR gap >= INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS s
    FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events)) GROUP BY ALL) GROUP BY ALL""")
def activity_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions separated by six hours of silence."""
    return rolling.sessions(table(spark, folder, "events"), ["user_id"], "ts", "6 hours").groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.max("n").alias("longest"))


@R.query(f"""WITH {PRICES_SQL}, q AS (SELECT month, series, row_number() OVER (PARTITION BY series ORDER BY month) AS t, value FROM prices),
m AS (SELECT series, avg(t) AS mt, stddev_pop(t) AS st, avg(value) AS mv, stddev_pop(value) AS sv FROM q GROUP BY ALL)
SELECT q.series, q.month, round((t - mt) / st, 6) AS d, round((value - mv) / sv, 6) AS s, round((t - mt) / st * (t - mt) / st, 6) AS dd,
       round((t - mt) / st * (value - mv) / sv, 6) AS ds, round((value - mv) / sv * (value - mv) / sv, 6) AS ss
FROM q JOIN m ON m.series = q.series""")
def quadratic_design(spark: SparkSession, folder: str) -> DataFrame:
    """Scaled time and level with their squares and product, per series."""
    whole = Window.partitionBy("series")
    q = monthly_prices(spark, folder).withColumn("t", F.row_number().over(whole.orderBy("month")).cast("double"))
    d = (F.col("t") - F.avg("t").over(whole)) / F.stddev_pop("t").over(whole)
    s = (F.col("value") - F.avg("value").over(whole)) / F.stddev_pop("value").over(whole)
    typed = q.select("series", "month", d.alias("d"), s.alias("s"))
    d, s = F.col("d"), F.col("s")
    return typed.select(
        "series", "month",
        *[F.round(e, 6).alias(n) for e, n in ((d, "d"), (s, "s"), (d * d, "dd"), (d * s, "ds"), (s * s, "ss"))]
    )
