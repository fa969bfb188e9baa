"""As-of, release and comparison joins over the test tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aforetime.functions.clocks import decision_instant, next_business_day
from aforetime.functions.numbers import bare, finite_number
from aforetime.functions.months import clean_month
from aforetime.operators import asof, known, panels, statistics
from aforetime.plans.problems import MONTH_SQL
from aforetime.plans.registry import Registry
from aforetime.plans.views import PANEL_SQL, VERSIONS_SQL, panel, versions
from aforetime.sources.tables import table
from aforetime.storage import written

R = Registry()
KEYS = ["ref_area", "source_series_id"]

_VINTAGE_SQL = """vintages AS (
  SELECT *, lead(first_usable_timestamp) OVER (PARTITION BY ref_area, source_series_id, observation_period
                                               ORDER BY first_usable_timestamp) AS known_to
  FROM (SELECT * FROM vintage_value
        QUALIFY row_number() OVER (PARTITION BY ref_area, source_series_id, observation_period, first_usable_timestamp
                                   ORDER BY row_id DESC) = 1)),
known AS (
  SELECT e.event_id, v.observation_period, v.value, v.first_usable_timestamp AS known_from
  FROM event_cutoff e JOIN vintages v USING (ref_area, source_series_id)
  WHERE v.value IS NOT NULL AND v.first_usable_timestamp < e.state_cutoff_timestamp
    AND (v.known_to IS NULL OR e.state_cutoff_timestamp <= v.known_to))"""


def vintage_intervals(spark: SparkSession, folder: str) -> DataFrame:
    """Vintage values with the time each was the current one of its period."""
    return asof.validity_intervals(
        table(spark, folder, "vintage_value").select(
            "row_id", *KEYS, "observation_period", "value", "first_usable_timestamp"
        ),
        [*KEYS, "observation_period"],
        at="first_usable_timestamp",
        tie="row_id",
        deleted=F.col("value").isNull(),
    )


def known_at_events(spark: SparkSession, folder: str) -> DataFrame:
    """(event_id, observation_period, value, known_from): all periods each event knew."""
    intervals = vintage_intervals(spark, folder)
    events = table(spark, folder, "event_cutoff").select("event_id", *KEYS, "state_cutoff_timestamp")
    return asof.as_of(events, intervals, KEYS, "state_cutoff_timestamp").select(
        "event_id", "observation_period", "value", "known_from"
    )


@R.query(
    f"WITH {_VINTAGE_SQL} SELECT event_id, observation_period, value, epoch_us(known_from) AS known_from_us FROM known"
)
def asof_interval_form(spark: SparkSession, folder: str) -> DataFrame:
    return known_at_events(spark, folder).select(
        "event_id", "observation_period", "value", F.unix_micros("known_from").alias("known_from_us")
    )


@R.query(f"""WITH {_VINTAGE_SQL}
SELECT event_id, count(*) AS n_periods, min(observation_period) AS first_period, max(observation_period) AS last_period,
       round(sum(value), 4) AS sum_value
FROM known GROUP BY event_id""")
def asof_known_periods(spark: SparkSession, folder: str) -> DataFrame:
    return known_at_events(spark, folder).groupBy("event_id").agg(
        F.count("*").alias("n_periods"),
        F.min("observation_period").alias("first_period"),
        F.max("observation_period").alias("last_period"),
        F.round(F.sum("value"), 4).alias("sum_value"),
    )


def _change_sql(change: str, condition: str) -> str:
    return f"""WITH {_VINTAGE_SQL}
SELECT a.event_id, a.observation_period, round({change}, 8) AS change,
       epoch_us(greatest(a.known_from, b.known_from)) AS known_at_us
FROM known a JOIN known b ON b.event_id = a.event_id
  AND b.observation_period = CAST(a.observation_period - INTERVAL 12 MONTH AS DATE)
WHERE {condition}
QUALIFY row_number() OVER (PARTITION BY a.event_id ORDER BY a.observation_period DESC) = 1"""


def _yearly(spark: SparkSession, folder: str, log: bool) -> DataFrame:
    # written, since sorting by ranges reads its input twice and a join reads it from two sides
    intervals = written(vintage_intervals(spark, folder), "intervals")
    changes = written(asof.change_versions(intervals, KEYS, "observation_period", "value", log=log), "changes")
    found = known.as_known(
        table(spark, folder, "event_cutoff"), changes, KEYS, event_id="event_id", event_time="state_cutoff_timestamp",
        change_time="at", period="observation_period", value="change", tie="tie",
    )
    return found.select(
        "event_id", "observation_period", F.round("change", 8).alias("change"), F.col("tie").alias("known_at_us")
    )


@R.query(_change_sql("100 * (a.value / b.value - 1)", "b.value <> 0"))
def yoy_pct_walkback(spark: SparkSession, folder: str) -> DataFrame:
    return _yearly(spark, folder, log=False)


@R.query(_change_sql("100 * ln(a.value / b.value)", "a.value > 0 AND b.value > 0"))
def yoy_log_walkback(spark: SparkSession, folder: str) -> DataFrame:
    return _yearly(spark, folder, log=True)


@R.query(f"""WITH {VERSIONS_SQL},
spans AS (SELECT *, lead(usable_at) OVER (PARTITION BY ref_area, series_id, period ORDER BY usable_at) AS known_to FROM versions),
origins AS (SELECT CAST(unnest(generate_series(CAST(date_trunc('year', make_timestamp(epoch_us(min(usable_at)))) + INTERVAL 1 YEAR AS DATE),
                                               CAST(date_trunc('year', make_timestamp(epoch_us(max(usable_at)))) + INTERVAL 1 YEAR AS DATE), INTERVAL 1 YEAR)) AS DATE) AS origin
            FROM versions)
SELECT o.origin, s.ref_area, s.series_id, count(*) AS n_periods, max(s.period) AS last_period, round(sum(s.value), 4) AS sum_value
FROM spans s JOIN origins o ON epoch_us(s.usable_at) < epoch_us(CAST(o.origin AS TIMESTAMP))
  AND (s.known_to IS NULL OR epoch_us(CAST(o.origin AS TIMESTAMP)) <= epoch_us(s.known_to))
WHERE NOT s.is_delete GROUP BY ALL""")
def asof_versioned_delete(spark: SparkSession, folder: str) -> DataFrame:
    """What each source looked like at the start of every year, deletes respected."""
    keys = ["ref_area", "series_id", "period"]
    spans = asof.validity_intervals(
        versions(spark, folder), keys, at="usable_at", tie="row_id", deleted=F.col("is_delete")
    )
    ends = table(spark, folder, "versioned_value").agg(F.year(F.min("usable_at")), F.year(F.max("usable_at"))).first()
    first, last = (date(year + 1, 1, 1) if year else None for year in ends)
    years = F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 1 year"))
    # a version meets the year starts inside its interval, no join is needed
    origin = F.explode(
        F.filter(
            years,
            lambda d: (F.col("known_from") < d.cast("timestamp")) & (
                F.col("known_to").isNull() | (d.cast("timestamp") <= F.col("known_to"))
            )
        )
    )
    return spans.withColumn("origin", origin).groupBy("origin", "ref_area", "series_id").agg(
        F.count("*").alias("n_periods"), F.max("period").alias("last_period"), F.round(F.sum("value"), 4).alias("sum_value")
    )


@R.query("""SELECT ref_area, source_series_id, observation_period, epoch_us(first_usable_timestamp) AS known_us,
       count(DISTINCT value) AS n_values, count(*) AS n_rows
FROM vintage_value GROUP BY ALL HAVING count(DISTINCT value) > 1""")
def asof_tie_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    found = asof.tie_conflicts(
        table(spark, folder, "vintage_value"), [*KEYS, "observation_period"], "first_usable_timestamp", "value"
    )
    return found.select(
        *KEYS, "observation_period", F.unix_micros("first_usable_timestamp").alias("known_us"), "n_values", "n_rows"
    )


_STEPS_SQL = f"""{PANEL_SQL},
rates AS (SELECT panel_id, month, value FROM panel WHERE series_id = 'MM_POLICY_RATE' AND value IS NOT NULL),
steps AS (
  SELECT panel_id, month AS effective, value AS rate FROM rates
  QUALIFY value IS DISTINCT FROM lag(value) OVER (PARTITION BY panel_id ORDER BY month)),
spans AS (SELECT *, lead(effective) OVER (PARTITION BY panel_id ORDER BY effective) AS until FROM steps)"""


def _rate_steps(spark: SparkSession, folder: str) -> DataFrame:
    rates = panel(spark, folder).where((F.col("series_id") == "MM_POLICY_RATE") & F.col("value").isNotNull())
    before = F.lag("value").over(Window.partitionBy("panel_id").orderBy("month"))
    return rates.withColumn("_before", before).where(~F.col("value").eqNullSafe(F.col("_before"))).select(
        "panel_id", F.col("month").alias("effective"), F.col("value").alias("rate")
    )


@R.query(f"""WITH {_STEPS_SQL}
SELECT p.panel_id, p.series_id, p.month, s.effective, s.rate
FROM panel p JOIN spans s ON s.panel_id = p.panel_id AND s.effective < p.month AND (s.until IS NULL OR p.month <= s.until)""")
def asof_step_function(spark: SparkSession, folder: str) -> DataFrame:
    """The policy rate in force strictly before each panel month."""
    decisions = panel(spark, folder).select("panel_id", "series_id", "month")
    return asof.step_function(
        decisions, _rate_steps(spark, folder), ["panel_id"], decision="month", effective="effective"
    )


@R.query(f"""WITH {_STEPS_SQL}
SELECT r.panel_id, count(*) AS n_months, count(*) FILTER (r.value IS DISTINCT FROM s.rate) AS n_conflicts
FROM rates r LEFT JOIN spans s ON s.panel_id = r.panel_id AND s.effective <= r.month AND (s.until IS NULL OR r.month < s.until)
GROUP BY ALL""")
def step_function_validation(spark: SparkSession, folder: str) -> DataFrame:
    """Each observed rate against the step in force on its month (inclusive)."""
    rates = panel(spark, folder).where((F.col("series_id") == "MM_POLICY_RATE") & F.col("value").isNotNull())
    held = asof.step_function(
        rates, _rate_steps(spark, folder), ["panel_id"], decision="month", effective="effective", inclusive=True, unmatched=True
    )
    return held.groupBy("panel_id").agg(
        F.count("*").alias("n_months"),
        F.count(F.when(~F.col("value").eqNullSafe(F.col("rate")), 1)).alias("n_conflicts"),
    )


@R.query(f"""WITH {PANEL_SQL}
SELECT a.panel_id, a.series_id, a.month, round(a.value - b.value, 6) AS spread
FROM panel a JOIN panel b ON b.panel_id = a.panel_id AND b.month = a.month AND b.series_id = 'MM_POLICY_RATE'
WHERE a.series_id LIKE 'MIR%' AND a.value IS NOT NULL AND b.value IS NOT NULL""")
def spread_same_period(spark: SparkSession, folder: str) -> DataFrame:
    """Lending rates over the policy rate of the same panel and month."""
    cells = panel(spark, folder).where(F.col("value").isNotNull())
    base = cells.where(F.col("series_id") == "MM_POLICY_RATE").select("panel_id", "month", F.col("value").alias("base"))
    return (
        cells.where(F.col("series_id").startswith("MIR"))
        .join(base, ["panel_id", "month"])
        .select("panel_id", "series_id", "month", F.round(F.col("value") - F.col("base"), 6).alias("spread"))
    )


@R.query("""WITH daily AS (
  SELECT event_type, CAST(ts AS DATE) AS day, arg_max(value, ts) AS value FROM events GROUP BY ALL)
SELECT d.event_type, d.day, round(100 * ln(d.value / p.value), 8) AS log_change
FROM daily d JOIN daily p ON p.event_type = d.event_type AND p.day = CAST(d.day - INTERVAL 1 DAY AS DATE)
WHERE d.value > 0 AND p.value > 0""")
def end_of_period_log_change(spark: SparkSession, folder: str) -> DataFrame:
    """Log change of each type's last value of a day."""
    daily = table(spark, folder, "events").groupBy(
        "event_type", F.to_date("ts").alias("day")
    ).agg(F.max_by("value", "ts").alias("value"))
    before = daily.select("event_type", F.date_add("day", 1).alias("day"), F.col("value").alias("before"))
    both = daily.join(before, ["event_type", "day"]).where((F.col("value") > 0) & (F.col("before") > 0))
    return both.select(
        "event_type", "day", F.round(100 * F.log(F.col("value") / F.col("before")), 8).alias("log_change")
    )


@R.query("""WITH daily AS (
  SELECT event_type, CAST(ts AS DATE) AS day, round(avg(value), 6) AS level FROM events GROUP BY ALL),
published AS (
  SELECT *, CAST(day AS TIMESTAMP) + INTERVAL 12 HOUR + INTERVAL 1 DAY * (CASE dayofweek(day) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END) AS usable
  FROM daily),
decisions AS (SELECT event_type, day AS decision_day, CAST(day AS TIMESTAMP) + INTERVAL 14 HOUR AS decision FROM daily)
SELECT d.event_type, d.decision_day, p.day AS known_day, p.level
FROM decisions d JOIN published p ON p.event_type = d.event_type AND p.day < d.decision_day AND p.usable < d.decision
QUALIFY row_number() OVER (PARTITION BY d.event_type, d.decision_day ORDER BY p.day DESC) = 1""")
def asof_daily_publication_lag(spark: SparkSession, folder: str) -> DataFrame:
    """The newest daily level that was published before each decision; publication is the next business day at noon."""
    daily = table(spark, folder, "events").groupBy(
        "event_type", F.to_date("ts").alias("day")
    ).agg(F.round(F.avg("value"), 6).alias("level"))
    noon = F.timestamp_micros(
        F.unix_date(next_business_day(F.col("day"))).cast("bigint") * 86_400_000_000 + 12 * 3_600_000_000
    )
    published = daily.withColumn("usable", noon)
    decisions = daily.select(
        "event_type", F.col("day").alias("decision_day"),
        F.timestamp_micros(F.unix_date("day").cast("bigint") * 86_400_000_000 + 14 * 3_600_000_000).alias("decision"),
    )
    # publication keeps the order of days, so the newest published day is a step function of the publication time
    newest = published.groupBy("event_type", "usable").agg(F.max_by(F.struct("day", "level"), "day").alias("p"))
    steps = newest.select("event_type", "usable", F.col("p.day").alias("known_day"), F.col("p.level").alias("level"))
    found = asof.step_function(decisions, steps, ["event_type"], decision="decision", effective="usable")
    return found.where(F.col("known_day") < F.col("decision_day")).select(
        "event_type", "decision_day", "known_day", "level"
    )


@R.query("""SELECT event_id, epoch_us(event_timestamp) AS event_us,
  epoch_us((CAST(event_date AS TIMESTAMP) + CASE WHEN event_date >= DATE '2022-07-21' THEN INTERVAL '14 hours 15 minutes'
            ELSE INTERVAL '13 hours 45 minutes' END) AT TIME ZONE 'Europe/Berlin') AS decision_us
FROM event_cutoff WHERE event_date IS NOT NULL""")
def calendar_cutoffs_dst(spark: SparkSession, folder: str) -> DataFrame:
    """Decision instants of event dates in local time, across clock changes and the change of the hour."""
    events = table(spark, folder, "event_cutoff").where(F.col("event_date").isNotNull())
    decision = decision_instant(F.col("event_date"), "2022-07-21", (13, 45), (14, 15), "Europe/Berlin")
    return events.select(
        "event_id", F.unix_micros("event_timestamp").alias("event_us"), F.unix_micros(decision).alias("decision_us")
    )


_SNAPSHOT_SQL = f"""clean AS (
  SELECT snapshot_no, panel_id, upper(trim(series_id)) AS series_id, {MONTH_SQL.format("origin_month")} AS origin_month, row_id,
         missing_reason, CASE WHEN regexp_full_match(trim(transformed_value), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?')
              THEN CAST(trim(transformed_value) AS DOUBLE) END AS num
  FROM panel_snapshot WHERE snapshot_no IN (SELECT min(snapshot_no) FROM panel_snapshot UNION SELECT max(snapshot_no) FROM panel_snapshot)
  QUALIFY row_number() OVER (PARTITION BY snapshot_no, panel_id, upper(trim(series_id)), {MONTH_SQL.format("origin_month")} ORDER BY row_id DESC) = 1),
old AS (SELECT * FROM clean WHERE snapshot_no = (SELECT min(snapshot_no) FROM clean)),
new AS (SELECT * FROM clean WHERE snapshot_no = (SELECT max(snapshot_no) FROM clean))"""


def _snapshot_ends(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, folder, "panel_snapshot")
    first, last = rows.agg(F.min("snapshot_no"), F.max("snapshot_no")).first()
    clean = (
        rows.where(F.col("snapshot_no").isin(first, last))
        .select(
            "snapshot_no", "panel_id", F.upper(bare(F.col("series_id"))).alias("series_id"),
            clean_month(F.col("origin_month")).alias("origin_month"), "row_id", "missing_reason",
            finite_number(F.col("transformed_value")).alias("num")
        )
        .groupBy("snapshot_no", "panel_id", "series_id", "origin_month")
        .agg(F.max_by(F.struct("missing_reason", "num"), "row_id").alias("r"))
        .select("snapshot_no", "panel_id", "series_id", "origin_month", "r.missing_reason", "r.num")
    )
    return tuple(clean.where(F.col("snapshot_no") == n).drop("snapshot_no") for n in (first, last))


@R.query(f"""WITH {_SNAPSHOT_SQL}
SELECT coalesce(o.series_id, n.series_id) AS series_id, count(*) FILTER (n.series_id IS NULL) AS n_removed,
       count(*) FILTER (o.series_id IS NULL) AS n_added,
       count(*) FILTER (o.series_id IS NOT NULL AND n.series_id IS NOT NULL AND o.num IS DISTINCT FROM n.num) AS n_value_changed,
       count(*) FILTER (o.series_id IS NOT NULL AND n.series_id IS NOT NULL AND o.missing_reason IS DISTINCT FROM n.missing_reason) AS n_reason_changed
FROM old o FULL JOIN new n ON n.panel_id = o.panel_id AND n.series_id = o.series_id AND n.origin_month = o.origin_month
GROUP BY 1""")
def panel_scenario_diff(spark: SparkSession, folder: str) -> DataFrame:
    """The first against the last full snapshot, per series."""
    old, new = _snapshot_ends(spark, folder)
    keys = ["panel_id", "series_id", "origin_month"]
    both = F.col("side") == "both"
    return panels.compare(old, new, keys, ["num", "missing_reason"]).groupBy("series_id").agg(
        F.count(F.when(F.col("side") == "left", 1)).alias("n_removed"),
        F.count(F.when(F.col("side") == "right", 1)).alias("n_added"),
        F.count(F.when(both & F.col("num_changed"), 1)).alias("n_value_changed"),
        F.count(F.when(both & F.col("missing_reason_changed"), 1)).alias("n_reason_changed"),
    )


@R.query(f"""WITH {_SNAPSHOT_SQL},
a AS (SELECT panel_id, series_id, count(num) AS n FROM old GROUP BY ALL), b AS (SELECT panel_id, series_id, count(num) AS n FROM new GROUP BY ALL)
SELECT coalesce(a.panel_id, b.panel_id) AS panel_id, coalesce(a.series_id, b.series_id) AS series_id,
       coalesce(b.n, 0) - coalesce(a.n, 0) AS coverage_delta
FROM a FULL JOIN b ON a.panel_id = b.panel_id AND a.series_id = b.series_id""")
def panel_coverage_delta(spark: SparkSession, folder: str) -> DataFrame:
    old, new = _snapshot_ends(spark, folder)
    keys = ["panel_id", "series_id"]
    counted = [d.groupBy(*keys).agg(F.count("num").alias(f"n{i}")) for i, d in enumerate((old, new))]
    joined = counted[0].join(counted[1], keys, "full_outer")
    return joined.select(*keys, (F.coalesce("n1", F.lit(0)) - F.coalesce("n0", F.lit(0))).alias("coverage_delta"))


@R.query(f"""WITH {_SNAPSHOT_SQL}
SELECT o.panel_id, o.series_id, o.origin_month, CASE WHEN n.series_id IS NOT NULL THEN n.num ELSE o.num END AS num,
       n.series_id IS NOT NULL AS is_amended
FROM old o LEFT JOIN new n ON n.series_id = 'MM_POLICY_RATE' AND n.panel_id = o.panel_id AND n.series_id = o.series_id AND n.origin_month = o.origin_month""")
def panel_amend_series(spark: SparkSession, folder: str) -> DataFrame:
    """The first snapshot with one series taken from the last; all other rows as they were."""
    old, new = _snapshot_ends(spark, folder)
    keys = ["panel_id", "series_id", "origin_month"]
    return panels.amend(
        old.select(*keys, "num"), new.where(F.col("series_id") == "MM_POLICY_RATE").select(*keys, "num"), keys,
        ["num"]
    )


_REVISED_SQL = f"""WITH {VERSIONS_SQL},
ends AS (SELECT ref_area, series_id, period, arg_min(value, usable_at) AS first_value, arg_max(value, usable_at) AS last_value, count(*) AS n
         FROM versions WHERE NOT is_delete AND value IS NOT NULL GROUP BY ALL)"""


def _revised(spark: SparkSession, folder: str) -> DataFrame:
    held = asof.validity_intervals(
        versions(spark, folder), ["ref_area", "series_id", "period"], at="usable_at", tie="row_id",
        deleted=F.col("is_delete")
    )
    return held.where(F.col("value").isNotNull()).groupBy("ref_area", "series_id", "period").agg(
        F.min_by("value", "known_from").alias("first_value"), F.max_by("value", "known_from").alias("last_value"), F.count("*").alias("n")
    )


@R.query(_REVISED_SQL + """
SELECT series_id, count(*) AS n_periods, round(avg(last_value - first_value), 4) AS mean_revision,
       round(quantile_cont(abs(last_value - first_value), 0.5), 4) AS median_abs, round(quantile_cont(abs(last_value - first_value), 0.9), 4) AS p90_abs,
       round(max(abs(last_value - first_value)), 4) AS max_abs
FROM ends GROUP BY ALL""")
def value_revision_summary(spark: SparkSession, folder: str) -> DataFrame:
    """How far the last version of a value is from its first."""
    change = F.col("last_value") - F.col("first_value")
    moved = written(_revised(spark, folder).select("series_id", change.alias("change"), F.abs(change).alias("size")), "revisions")
    quantiles = statistics.quantiles(moved, ["series_id"], "size", {"median_abs": 0.5, "p90_abs": 0.9})
    return moved.groupBy("series_id").agg(
        F.count("*").alias("n_periods"),
        F.round(F.avg("change"), 4).alias("mean_revision"),
        F.round(F.max("size"), 4).alias("max_abs"),
    ).join(quantiles, "series_id").withColumns({c: F.round(c, 4) for c in ("median_abs", "p90_abs")})


@R.query(_REVISED_SQL + """
SELECT ref_area, series_id, count(*) AS n_periods,
       count(*) FILTER (abs(last_value - first_value) > greatest(2e-9 * greatest(abs(last_value), abs(first_value)), 2e-10)) AS n_apart
FROM ends GROUP BY ALL""")
def reconciliation_isclose(spark: SparkSession, folder: str) -> DataFrame:
    """Periods whose first and last value differ beyond a relative and an absolute tolerance."""
    a, b = F.col("last_value"), F.col("first_value")
    apart = F.abs(a - b) > F.greatest(2e-9 * F.greatest(F.abs(a), F.abs(b)), F.lit(2e-10))
    return _revised(spark, folder).groupBy("ref_area", "series_id").agg(
        F.count("*").alias("n_periods"), F.count(F.when(apart, 1)).alias("n_apart")
    )


@R.query(_REVISED_SQL + """
SELECT a.ref_area, a.series_id, a.period, round(100 * (a.last_value / b.last_value - 1), 6) AS latest_change,
       round(100 * (a.first_value / b.first_value - 1), 6) AS first_change
FROM ends a JOIN ends b ON b.ref_area = a.ref_area AND b.series_id = a.series_id AND b.period = CAST(a.period - INTERVAL 12 MONTH AS DATE)
WHERE b.last_value <> 0 AND b.first_value <> 0""")
def matched_period_vintage_join(spark: SparkSession, folder: str) -> DataFrame:
    """Yearly change of the latest and of the first published values, matched by period."""
    ends = _revised(spark, folder)
    keys = ["ref_area", "series_id", "period"]
    base = ends.select(
        "ref_area", "series_id", F.add_months("period", 12).alias("period"), F.col("first_value").alias("f0"),
        F.col("last_value").alias("l0")
    )
    both = ends.join(base, keys).where((F.col("f0") != 0) & (F.col("l0") != 0))
    return both.select(
        *keys,
        F.round(100 * (F.col("last_value") / F.col("l0") - 1), 6).alias("latest_change"),
        F.round(100 * (F.col("first_value") / F.col("f0") - 1), 6).alias("first_change"),
    )


@R.query(f"""WITH {PANEL_SQL},
releases AS (SELECT series_id, observed_month, min(month) AS release_month FROM panel WHERE value IS NOT NULL AND observed_month IS NOT NULL GROUP BY ALL)
SELECT p.panel_id, p.series_id, p.month, p.observed_month, r.release_month, datediff('month', r.release_month, p.month) AS months_after
FROM panel p JOIN releases r ON r.series_id = p.series_id AND r.observed_month = p.observed_month WHERE p.value IS NOT NULL""")
def release_calendar_join(spark: SparkSession, folder: str) -> DataFrame:
    """Each reading with the first month in which any panel had its observation."""
    readings = panel(spark, folder).where(F.col("value").isNotNull() & F.col("observed_month").isNotNull())
    calendar = readings.groupBy("series_id", "observed_month").agg(F.min("month").alias("release_month"))
    after = F.months_between("month", "release_month").cast("bigint")
    return readings.join(calendar, ["series_id", "observed_month"]).select(
        "panel_id", "series_id", "month", "observed_month", "release_month", after.alias("months_after")
    )
