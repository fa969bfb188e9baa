"""As-of panels built from versions, their audit and timing variants, and gates over panels and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aforetime.functions.clocks import local_instant, release_instant
from aforetime.operators import asof, known, panels, rolling, statistics
from aforetime.plans.problems import MISSING_REASONS
from aforetime.plans.registry import Registry
from aforetime.plans.rolling_queries import _HISTORY_SQL, SOURCE, _scaled
from aforetime.plans.views import PANEL_SQL, PRICES_SQL, VERSIONS_SQL, monthly_prices, panel, versions
from aforetime.sources.tables import table
from aforetime.storage import small_side, written

R = Registry()
KEYS = ["ref_area", "series_id"]
ZONE = "Europe/Berlin"
#: Units whose series enter a panel as yearly log change; all others enter as they are.
CHANGE_UNITS = ("EUR_MN", "INDEX")
STALE_MONTHS = 3
UNMAPPED, LOOKBACK, NEVER = MISSING_REASONS
# Timing classes of series.
REPLAY, LAGGED, FORWARD, INELIGIBLE = "A_REPLAY_ELIGIBLE", "B_RELEASE_LAG_ELIGIBLE", "C_BUILD_FORWARD_ONLY", "D_INELIGIBLE"
#: Versions within so many days of their period show that a series was dated as it came out.
PROMPT_DAYS = 7


def _members_sql(source: str) -> str:
    """Decisions (source and month) of every member, from the cleaned versions."""
    return f"""members AS (SELECT DISTINCT ref_area, series_id FROM {source}),
ends AS (SELECT ref_area, CAST(date_trunc('month', make_timestamp(epoch_us(min(usable_at)))) AS DATE) AS lo,
                CAST(date_trunc('month', make_timestamp(epoch_us(max(usable_at)))) AS DATE) AS hi FROM {source} GROUP BY ref_area),
decided AS (
  SELECT *, epoch_us((CAST(origin AS TIMESTAMP) + INTERVAL '13 hours 45 minutes') AT TIME ZONE '{ZONE}') AS cutoff_us
  FROM (SELECT m.ref_area, m.series_id, CAST(unnest(generate_series(e.lo, e.hi, INTERVAL 1 MONTH)) AS DATE) AS origin
        FROM members m JOIN ends e ON e.ref_area = m.ref_area))"""


def _signals_sql(source: str) -> str:
    units = ", ".join(f"'{u}'" for u in CHANGE_UNITS)
    current = "epoch_us({0}.usable_at) < d.cutoff_us AND ({0}.known_to IS NULL OR d.cutoff_us <= epoch_us({0}.known_to))"
    return f"""spans AS (SELECT *, lead(usable_at) OVER (PARTITION BY ref_area, series_id, period ORDER BY usable_at) AS known_to FROM {source}),
held AS (SELECT * FROM spans WHERE NOT is_delete AND value IS NOT NULL),
rules AS (SELECT series_id, bool_or(unit IN ({units})) AS change FROM series_registry GROUP BY ALL),
levels AS (
  SELECT d.*, h.period, h.value, epoch_us(h.usable_at) AS known_at_us FROM decided d
  JOIN held h ON h.ref_area = d.ref_area AND h.series_id = d.series_id AND {current.format("h")}
  QUALIFY row_number() OVER (PARTITION BY d.ref_area, d.series_id, d.origin ORDER BY h.period DESC) = 1),
changes AS (
  SELECT d.*, a.period, 100 * ln(a.value / b.value) AS value, epoch_us(greatest(a.usable_at, b.usable_at)) AS known_at_us FROM decided d
  JOIN held a ON a.ref_area = d.ref_area AND a.series_id = d.series_id AND a.value > 0 AND {current.format("a")}
  JOIN held b ON b.ref_area = d.ref_area AND b.series_id = d.series_id AND b.value > 0 AND {current.format("b")}
    AND b.period = CAST(a.period - INTERVAL 12 MONTH AS DATE)
  QUALIFY row_number() OVER (PARTITION BY d.ref_area, d.series_id, d.origin ORDER BY a.period DESC) = 1),
signals AS (SELECT c.* FROM changes c JOIN rules r ON r.series_id = c.series_id AND r.change
            UNION ALL SELECT l.* FROM levels l LEFT JOIN rules r ON r.series_id = l.series_id WHERE NOT coalesce(r.change, false)),
state AS (
  SELECT d.ref_area, d.series_id, d.origin, d.cutoff_us, s.period, s.known_at_us,
         CASE WHEN datediff('month', s.period, d.origin) <= {STALE_MONTHS} THEN round(s.value, 6) END AS value,
         CASE WHEN l.origin IS NULL THEN '{NEVER}' WHEN s.origin IS NULL THEN '{LOOKBACK}'
              WHEN datediff('month', s.period, d.origin) > {STALE_MONTHS} THEN '{UNMAPPED}' END AS missing_reason
  FROM decided d LEFT JOIN levels l USING (ref_area, series_id, origin) LEFT JOIN signals s USING (ref_area, series_id, origin))"""


def _decisions(rows: DataFrame) -> DataFrame:
    """(ref_area, series_id, origin, cutoff, decision): one per member and month of its area."""
    ends = rows.groupBy("ref_area").agg(
        F.trunc(F.min("usable_at"), "month").alias("lo"), F.trunc(F.max("usable_at"), "month").alias("hi")
    )
    spine = rows.select(*KEYS).distinct().join(ends, "ref_area").select(
        *KEYS, F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias("origin")
    )
    return spine.withColumn("cutoff", local_instant(F.col("origin"), 13, 45, 0, ZONE)).withColumn(
        "decision", F.concat_ws("|", *KEYS, "origin")
    )


def build_panel(spark: SparkSession, folder: str, rows: DataFrame) -> DataFrame:
    """One row per decision: the signal of its series known strictly before the cutoff, or why there is none.

    Levels and yearly changes are carried forward per source; nothing is joined
    on the source alone.
    """
    decided = written(_decisions(rows), "decisions")
    intervals = written(
        asof.validity_intervals(rows, [*KEYS, "period"], at="usable_at", tie="row_id", deleted=F.col("is_delete")), "intervals"
    )
    rules = table(spark, folder, "series_registry").groupBy("series_id").agg(F.bool_or(F.col("unit").isin(*CHANGE_UNITS)).alias("change"))
    ruled = intervals.join(small_side(rules), "series_id", "left").withColumn("change", F.coalesce("change", F.lit(False)))
    levels = asof.level_versions(intervals, KEYS, "period", "value")
    changes = asof.change_versions(ruled.where("change"), KEYS, "period", "value", log=True).withColumnRenamed("change", "value")
    plain = asof.level_versions(ruled.where("not change"), KEYS, "period", "value")

    def newest(what: DataFrame) -> DataFrame:
        return known.as_known(
            decided, what, KEYS, event_id="decision", event_time="cutoff", change_time="at", period="period", value="value", tie="tie"
        )

    level = newest(levels).select("decision", F.lit(True).alias("_level"))
    signal = newest(changes.unionByName(plain)).select("decision", "period", "value", F.col("tie").alias("known_at_us"))
    cells = decided.join(level, "decision", "left").join(signal, "decision", "left")
    stale = F.months_between(F.trunc("origin", "month"), F.trunc("period", "month")) > STALE_MONTHS
    reason = (
        F.when(F.col("_level").isNull(), NEVER).when(F.col("period").isNull(), LOOKBACK).when(stale, UNMAPPED)
    )
    return cells.select(
        *KEYS, "origin", F.unix_micros("cutoff").alias("cutoff_us"), "period", "known_at_us",
        F.when(~stale, F.round("value", 6)).alias("value"), reason.alias("missing_reason"),
    )


_STATE_SQL = f"{VERSIONS_SQL}, {_members_sql('versions')}, {_signals_sql('versions')}"


@R.query(f"WITH {_STATE_SQL} SELECT * FROM state")
def state_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Monthly as-of panel of all sources: signal, knowledge time and missing reason of every cell."""
    return build_panel(spark, folder, versions(spark, folder))


@R.query(f"""WITH {_STATE_SQL}
SELECT series_id, count(*) AS n_cells, count(*) FILTER (missing_reason IS NOT NULL) AS n_missing,
       round(count(*) FILTER (missing_reason IS NULL) / count(*), 8) AS coverage, count(*) FILTER (missing_reason = '{NEVER}') AS n_never,
       count(*) FILTER (missing_reason = '{LOOKBACK}') AS n_lookback, count(*) FILTER (missing_reason = '{UNMAPPED}') AS n_stale,
       count(*) FILTER (known_at_us >= cutoff_us) AS n_violations
FROM state GROUP BY ALL""")
def state_panel_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Coverage, missing cells by reason and point-in-time violations of the as-of panel, per series."""
    reason = F.col("missing_reason")
    return state_panel(spark, folder).groupBy("series_id").agg(
        F.count("*").alias("n_cells"), F.count(reason).alias("n_missing"),
        F.round(F.count(F.when(reason.isNull(), 1)) / F.count("*"), 8).alias("coverage"),
        *[F.count(F.when(reason == r, 1)).alias(n) for r, n in ((NEVER, "n_never"), (LOOKBACK, "n_lookback"), (UNMAPPED, "n_stale"))],
        F.count(F.when(F.col("known_at_us") >= F.col("cutoff_us"), 1)).alias("n_violations"),
    )


def publish_state_panel(spark: SparkSession, folder: str, path: str) -> None:
    """Write the as-of panel to a new path, if no cell knew too much and none is given twice."""
    cells = written(state_panel(spark, folder), "state-panel")
    audited = panels.audit(cells, [*KEYS, "origin"], value="value", known="known_at_us", origin="cutoff_us")
    panels.publish(cells, path, audited, {"duplicate_keys": 0, "point_in_time_violations": 0, "non_finite_values": 0})


_NEXT_DAY_SQL = f"""{VERSIONS_SQL},
delayed AS (
  SELECT * EXCLUDE (usable_at, own), (CAST(CAST(own AT TIME ZONE '{ZONE}' AS DATE) + INTERVAL 1 DAY AS TIMESTAMP)) AT TIME ZONE '{ZONE}' AS usable_at
  FROM (SELECT *, usable_at AS own FROM versions WHERE usable_at IS NOT NULL)
  QUALIFY row_number() OVER (PARTITION BY ref_area, series_id, period, CAST(own AT TIME ZONE '{ZONE}' AS DATE) ORDER BY own DESC, row_id DESC) = 1)"""


def _next_day(rows: DataFrame) -> DataFrame:
    """Versions that become usable as the next local day begins; the last one of a day holds."""
    day = F.to_date(F.from_utc_timestamp("usable_at", ZONE))
    later = release_instant(F.col("day"), F.lit("next_day"), ZONE)
    held = rows.where(F.col("usable_at").isNotNull()).withColumn("day", day).groupBy(*KEYS, "period", "day").agg(
        F.max_by(F.struct("row_id", "value", "is_delete"), F.struct("usable_at", "row_id")).alias("r")
    )
    return held.select("r.row_id", *KEYS, "period", "r.value", later.alias("usable_at"), "r.is_delete")


@R.query(f"""WITH a AS (WITH {_STATE_SQL} SELECT * FROM state),
b AS (WITH {_NEXT_DAY_SQL}, {_members_sql('delayed')}, {_signals_sql('delayed')} SELECT * FROM state)
SELECT coalesce(a.series_id, b.series_id) AS series_id, count(a.origin) AS n_registered, count(b.origin) AS n_next_day,
       count(*) FILTER (a.origin IS NOT NULL AND b.origin IS NOT NULL AND a.value IS DISTINCT FROM b.value) AS n_value_changed,
       count(*) FILTER (a.origin IS NOT NULL AND b.origin IS NOT NULL AND a.missing_reason IS DISTINCT FROM b.missing_reason) AS n_reason_changed,
       count(b.value) - count(a.value) AS coverage_delta
FROM a FULL JOIN b ON b.ref_area = a.ref_area AND b.series_id = a.series_id AND b.origin = a.origin GROUP BY 1""")
def state_panel_timing_variants(spark: SparkSession, folder: str) -> DataFrame:
    """The as-of panel under the registered clock against one in which releases count from the next day on."""
    rows = versions(spark, folder)
    own, later = build_panel(spark, folder, rows), build_panel(spark, folder, _next_day(rows))
    keys = [*KEYS, "origin"]
    a = own.select(*keys, F.col("value").alias("va"), F.col("missing_reason").alias("ra"), F.lit(1).alias("a"))
    b = later.select(*keys, F.col("value").alias("vb"), F.col("missing_reason").alias("rb"), F.lit(1).alias("b"))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    return a.join(b, keys, "full_outer").groupBy("series_id").agg(
        F.count("a").alias("n_registered"), F.count("b").alias("n_next_day"),
        F.count(F.when(both & ~F.col("va").eqNullSafe(F.col("vb")), 1)).alias("n_value_changed"),
        F.count(F.when(both & ~F.col("ra").eqNullSafe(F.col("rb")), 1)).alias("n_reason_changed"),
        (F.count("vb") - F.count("va")).alias("coverage_delta"),
    )


@R.query("""WITH rows AS (
  SELECT v.series_id, CAST(v.period || '-01' AS DATE) AS start, CAST(make_timestamp(epoch_us(v.usable_at)) AS DATE) AS day FROM versioned_value v),
expected AS (SELECT series_id, min(timing_class) AS expected FROM series_registry GROUP BY ALL)
SELECT r.series_id, any_value(e.expected) AS expected, count(*) AS n_rows, count(day) AS n_dated, max(datediff('day', start, day)) AS largest_delay,
       CASE WHEN any_value(e.expected) IN ('C_BUILD_FORWARD_ONLY', 'D_INELIGIBLE', 'B_RELEASE_LAG_ELIGIBLE') THEN any_value(e.expected)
            WHEN any_value(e.expected) = 'A_REPLAY_ELIGIBLE' THEN CASE WHEN count(day) = count(*) THEN 'A_REPLAY_ELIGIBLE' ELSE 'D_INELIGIBLE' END
            WHEN max(datediff('day', start, day)) <= 7 THEN 'A_REPLAY_ELIGIBLE' ELSE 'B_RELEASE_LAG_ELIGIBLE' END AS observed
FROM rows r LEFT JOIN expected e ON e.series_id = r.series_id GROUP BY r.series_id""")
def timing_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the clocks of a series' versions bear out its expected timing class."""
    rows = table(spark, folder, "versioned_value").select(
        "series_id", F.to_date(F.concat("period", F.lit("-01"))).alias("start"), F.to_date("usable_at").alias("day")
    )
    expected = table(spark, folder, "series_registry").groupBy("series_id").agg(F.min("timing_class").alias("expected"))
    delay = F.max(F.datediff("day", "start")).cast("bigint")
    counted = rows.groupBy("series_id").agg(F.count("*").alias("n_rows"), F.count("day").alias("n_dated"), delay.alias("largest_delay"))
    e = F.col("expected")
    observed = (
        F.when(e.isin(FORWARD, INELIGIBLE, LAGGED), e)
        .when(e == REPLAY, F.when(F.col("n_dated") == F.col("n_rows"), e).otherwise(INELIGIBLE))
        .when(F.col("largest_delay") <= PROMPT_DAYS, REPLAY)
        .otherwise(LAGGED)
    )
    return counted.join(small_side(expected), "series_id", "left").withColumn("observed", observed)


# text before the month counts: plain ISO times with an offset, which both engines read
_PLAIN = r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}[+-][0-9]{2}:[0-9]{2}"


@R.query(f"""WITH rows AS (
  SELECT series_id, transformed_value, origin_timestamp, CASE WHEN regexp_full_match(usable_timestamp, '{_PLAIN}')
         THEN epoch_us(try_cast(usable_timestamp AS TIMESTAMPTZ)) END AS known_us FROM panel_rows)
SELECT series_id, count(*) AS n_rows, count(*) FILTER (transformed_value IS NULL) AS n_missing,
       round(count(transformed_value) / count(*), 8) AS coverage, count(known_us) AS n_plain,
       count(*) FILTER (known_us >= epoch_us(origin_timestamp)) AS n_violations
FROM rows GROUP BY ALL""")
def panel_series_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Per series: missing cells, coverage and rows whose plainly written knowledge time isn't before their origin."""
    text = F.col("usable_timestamp")
    plain = F.unix_micros(F.try_to_timestamp(F.when(text.rlike(f"^{_PLAIN}$"), text)))
    rows = table(spark, folder, "panel_rows").withColumn("known_us", plain)
    return rows.groupBy("series_id").agg(
        F.count("*").alias("n_rows"), F.count(F.when(F.col("transformed_value").isNull(), 1)).alias("n_missing"),
        F.round(F.count("transformed_value") / F.count("*"), 8).alias("coverage"), F.count("known_us").alias("n_plain"),
        F.count(F.when(F.col("known_us") >= F.unix_micros("origin_timestamp"), 1)).alias("n_violations"),
    )


def _scores_sql(name: str, frame: str) -> str:
    return f"""{name} AS (SELECT panel_id, month, n_series, log_score FROM (WITH {_HISTORY_SQL.replace(":frame", frame)}
  SELECT panel_id, month, count(*) AS n_series, sum(-0.5 * (ln(2 * pi() * greatest(v, 0.05)) + (x - m) ** 2 / greatest(v, 0.05))) AS log_score
  FROM h WHERE n >= 24 GROUP BY ALL))"""


def _scores(spark: SparkSession, folder: str, length: int | None) -> DataFrame:
    score = rolling.gaussian_log_score(F.col("x"), rolling.history_window(SOURCE, "month", length), 24)
    scored = _scaled(spark, folder).withColumn("score", score).where(F.col("score").isNotNull())
    return scored.groupBy("panel_id", "month").agg(F.count("*").alias("n_series"), F.sum("score").alias("log_score"))


_PAIRED_SQL = f"""WITH {_scores_sql("e", "UNBOUNDED")}, {_scores_sql("r", "36")},
paired AS (SELECT e.panel_id, e.month, e.log_score AS expanding, r.log_score AS rolling FROM e JOIN r ON r.panel_id = e.panel_id AND r.month = e.month)"""


def _paired(spark: SparkSession, folder: str) -> DataFrame:
    """Months that both histories score, with both scores."""
    e = _scores(spark, folder, None).select("panel_id", "month", F.col("log_score").alias("expanding"))
    r = _scores(spark, folder, 36).select("panel_id", "month", F.col("log_score").alias("rolling"))
    return e.join(r, ["panel_id", "month"])


@R.query(f"""{_PAIRED_SQL}
SELECT panel_id, count(*) AS n_months, round(sum(expanding), 5) AS expanding_score, round(sum(rolling), 5) AS rolling_score,
       round(avg(CASE WHEN expanding > rolling + 1e-9 THEN 1.0 ELSE 0.0 END), 8) AS expanding_better, count(*) >= 24 AS enough,
       count(*) >= 24 AND abs(sum(expanding) - sum(rolling)) <= 0.1 * count(*) AS passes
FROM paired GROUP BY ALL""")
def variant_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of two history variants on the months that both have, with gates."""
    enough = F.count("*") >= 24
    near = F.abs(F.sum("expanding") - F.sum("rolling")) <= 0.1 * F.count("*")
    return _paired(spark, folder).groupBy("panel_id").agg(
        F.count("*").alias("n_months"), F.round(F.sum("expanding"), 5).alias("expanding_score"), F.round(F.sum("rolling"), 5).alias("rolling_score"),
        F.round(F.avg(F.when(F.col("expanding") > F.col("rolling") + 1e-9, 1.0).otherwise(0.0)), 8).alias("expanding_better"),
        enough.alias("enough"), (enough & near).alias("passes"),
    )


@R.query(f"""{_PAIRED_SQL}, totals AS (
  SELECT panel_id, 1 AS place, 'expanding' AS variant, round(sum(expanding), 5) AS score FROM paired GROUP BY ALL
  UNION ALL SELECT panel_id, 2, 'rolling', round(sum(rolling), 5) FROM paired GROUP BY ALL)
SELECT panel_id, variant, score FROM totals QUALIFY row_number() OVER (PARTITION BY panel_id ORDER BY score DESC, place) = 1""")
def best_variant(spark: SparkSession, folder: str) -> DataFrame:
    """The variant with the highest total score per panel; the first listed wins a tie."""
    totals = _paired(spark, folder).groupBy("panel_id").agg(
        F.round(F.sum("expanding"), 5).alias("a"), F.round(F.sum("rolling"), 5).alias("b")
    )
    first = F.col("a") >= F.col("b")
    return totals.select("panel_id", F.when(first, "expanding").otherwise("rolling").alias("variant"), F.greatest("a", "b").alias("score"))


_Z_SQL = f"""WITH e AS (WITH {_HISTORY_SQL.replace(":frame", "UNBOUNDED")} SELECT panel_id, series_id, month, round((x - m) / s, 5) AS z FROM h WHERE n >= 24 AND s >= 1e-6),
r AS (WITH {_HISTORY_SQL.replace(":frame", "36")} SELECT panel_id, series_id, month, round((x - m) / s, 5) AS z FROM h WHERE n >= 24 AND s >= 1e-6),
z AS (SELECT e.panel_id, e.series_id, e.z AS a, r.z AS b FROM e JOIN r ON r.panel_id = e.panel_id AND r.series_id = e.series_id AND r.month = e.month),
g AS (SELECT series_id, count(*) AS n, round(corr(a, b), 6) AS pearson, round(avg(CASE WHEN sign(a) * sign(b) < 0 THEN 1.0 ELSE 0.0 END), 6) AS disagreement,
             round(avg(abs(a - b)), 6) AS distance FROM z GROUP BY ALL HAVING count(*) > 1)"""


@R.query(f"""{_Z_SQL}
SELECT *, pearson >= 0.9 AS correlated, disagreement <= 0.1 AS same_sign, distance <= 0.5 AS near,
       pearson >= 0.9 AND disagreement <= 0.1 AND distance <= 0.5 AS stable,
       round(greatest((0.9 - pearson) / 0.9, (distance - 0.5) / 0.5), 6) AS risk,
       round(greatest((0.9 - pearson) / 0.9, (distance - 0.5) / 0.5), 6) <= 0 AS authorised
FROM g""")
def factor_stability(spark: SparkSession, folder: str) -> DataFrame:
    """Expanding against rolling standardised readings per series: agreement, gates, risk score and the rule that follows."""

    def z(length: int | None, name: str) -> DataFrame:
        window = rolling.history_window(SOURCE, "month", length)
        value = F.when(F.stddev_pop("x").over(window) >= 1e-6, F.round(rolling.standardised(F.col("x"), window, 24), 5))
        return _scaled(spark, folder).select(*SOURCE, "month", value.alias(name)).where(F.col(name).isNotNull())

    a, b = F.col("a"), F.col("b")
    found = z(None, "a").join(z(36, "b"), [*SOURCE, "month"]).groupBy("series_id").agg(
        F.count("*").alias("n"), F.round(F.corr(a, b), 6).alias("pearson"),
        F.round(F.avg(F.when(F.signum(a) * F.signum(b) < 0, 1.0).otherwise(0.0)), 6).alias("disagreement"),
        F.round(F.avg(F.abs(a - b)), 6).alias("distance"),
    ).where("n > 1")
    correlated, same, near = F.col("pearson") >= 0.9, F.col("disagreement") <= 0.1, F.col("distance") <= 0.5
    risk = F.round(F.greatest((0.9 - F.col("pearson")) / 0.9, (F.col("distance") - 0.5) / 0.5), 6)
    return found.select(
        "*", correlated.alias("correlated"), same.alias("same_sign"), near.alias("near"), (correlated & same & near).alias("stable"),
        risk.alias("risk"), (risk <= 0).alias("authorised"),
    )


@R.query(f"""WITH {PANEL_SQL}
SELECT panel_id, series_id, count(value) AS n, round(count(value) / count(*), 8) AS coverage, round(avg(value) + 1e-9, 4) AS mean,
       round(stddev_samp(value), 4) AS deviation, count(value) / count(*) >= 0.8 AND count(value) >= 24 AND coalesce(stddev_samp(value) > 1e-6, false) AS usable
FROM panel GROUP BY ALL""")
def observed_moments(spark: SparkSession, folder: str) -> DataFrame:
    """Mean and sample deviation of every source, and whether enough of it is observed to be standardised."""
    value, share = F.col("value"), F.count("value") / F.count("*")
    usable = (share >= 0.8) & (F.count(value) >= 24) & F.coalesce(F.stddev_samp(value) > 1e-6, F.lit(False))
    return panel(spark, folder).groupBy(*SOURCE).agg(
        F.count(value).alias("n"), F.round(share, 8).alias("coverage"), F.round(F.avg(value) + 1e-9, 4).alias("mean"),  # shifted, so that halves don't hang on the order of sums
        F.round(F.stddev_samp(value), 4).alias("deviation"), usable.alias("usable"),
    )


@R.query("""WITH w AS (SELECT l_shipmode, l_discount * 10 AS w FROM lineitem)
SELECT l_shipmode, round(least(sum(w) ** 2 / nullif(sum(w * w), 0), sum(1 - w) ** 2 / nullif(sum((1 - w) * (1 - w)), 0)), 5) AS least_effective_size,
       round(var_pop(w) * count(*), 5) AS information FROM w GROUP BY ALL""".replace("l_shipmode", "l_returnflag"))
def two_sided_support(spark: SparkSession, folder: str) -> DataFrame:
    """The smaller effective size of a soft state and its complement, and the information of their contrast."""
    rows = table(spark, folder, "lineitem").select("l_returnflag", (F.col("l_discount") * 10).alias("w"))
    w = F.col("w")
    both = F.least(statistics.effective_size(w), statistics.effective_size(1 - w))
    return rows.groupBy("l_returnflag").agg(
        F.round(both, 5).alias("least_effective_size"), F.round(F.var_pop(w) * F.count("*"), 5).alias("information")
    )


@R.query("""WITH m AS (SELECT o_orderpriority AS state, year(o_orderdate) * 12 + month(o_orderdate) - 1 AS month, count(*) AS n FROM orders GROUP BY ALL)
SELECT a.state, a.month, any_value(a.n) AS n, round(sum(b.n * exp(-0.5 * ((b.month - a.month) / 6.0) ** 2)) ** 2
       / sum(b.n * exp(-0.5 * ((b.month - a.month) / 6.0) ** 2) ** 2), 5) AS effective_size
FROM m a JOIN m b ON b.state = a.state GROUP BY a.state, a.month""")
def kernel_local_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Effective number of orders around each month of each priority under a kernel of half a year."""
    rows = table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("state"), (F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1).cast("bigint").alias("month")
    )
    return statistics.kernel_sizes(rows, ["state"], "month", 6.0).withColumn("effective_size", F.round("effective_size", 5))


def posterior(observed: Column, prevalence: Column, error: float) -> Column:
    """Chance of the true state given an observed one that is wrong with probability `error` either way."""
    right, wrong = prevalence * (1 - error), (1 - prevalence) * error
    missed, other = prevalence * error, (1 - prevalence) * (1 - error)
    return F.when(observed, right / (right + wrong)).otherwise(missed / (missed + other))


@R.query("""WITH s AS (SELECT l_returnflag, l_linestatus = 'F' AS observed FROM lineitem),
p AS (SELECT l_returnflag, avg(CASE WHEN observed THEN 1.0 ELSE 0.0 END) AS prevalence FROM s GROUP BY ALL)
SELECT s.l_returnflag, s.observed, count(*) AS n, round(any_value(CASE WHEN observed THEN p.prevalence * 0.9 / (p.prevalence * 0.9 + (1 - p.prevalence) * 0.1)
       ELSE p.prevalence * 0.1 / (p.prevalence * 0.1 + (1 - p.prevalence) * 0.9) END), 8) AS probability
FROM s JOIN p ON p.l_returnflag = s.l_returnflag GROUP BY ALL""")
def posterior_state(spark: SparkSession, folder: str) -> DataFrame:
    """Chance of a closed line per flag, given that one is reported and reports err in a tenth of cases."""
    counts = table(spark, folder, "lineitem").groupBy("l_returnflag", (F.col("l_linestatus") == "F").alias("observed")).agg(F.count("*").alias("n"))
    whole = Window.partitionBy("l_returnflag")  # two counts a flag
    prevalence = F.sum(F.when(F.col("observed"), F.col("n")).otherwise(0)).over(whole) / F.sum("n").over(whole)
    return counts.select("l_returnflag", "observed", "n", F.round(posterior(F.col("observed"), prevalence, 0.1), 8).alias("probability"))


def decimal_text(value: Column) -> Column:
    """A decimal in plain notation without trailing zeros."""
    text = value.cast("string")
    return F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def canonical(value: Column) -> Column:
    """Values nearer to zero than 1e-12 as zero, others at twelve significant digits."""
    return F.when(F.abs(value) < 1e-12, 0.0).otherwise(F.format_string("%.11e", value).cast("double"))


@R.query("""SELECT p_partkey, regexp_replace(CAST(CAST(p_retailprice AS DECIMAL(18, 4)) AS VARCHAR), '\\.?0+$', '') AS price,
       CASE WHEN abs(p_retailprice / 1e15 - 1e-12) < 1e-12 THEN 0.0 ELSE CAST(printf('%.11e', p_retailprice / 1e15 - 1e-12) AS DOUBLE) END AS tiny
FROM part""")
def canonical_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Prices as canonical decimal texts, and numbers about the size that counts as zero."""
    price = F.col("p_retailprice")
    return table(spark, folder, "part").select(
        "p_partkey", decimal_text(price.cast("decimal(18,4)")).alias("price"), canonical(price / 1e15 - 1e-12).alias("tiny")
    )


@R.query("""WITH n AS (SELECT o_orderpriority AS state, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n FROM orders GROUP BY ALL),
p AS (SELECT month, state, n / sum(n) OVER (PARTITION BY month) AS p FROM n)
SELECT month, count(*) AS n_states, abs(sum(p) - 1) <= 1e-10 AS sums_to_one, count(*) FILTER (p < 0 OR p > 1) AS n_outside FROM p GROUP BY ALL""")
def probability_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the state probabilities of every month add up to one and none lies outside of [0, 1]."""
    month = F.to_date(F.date_trunc("month", "o_orderdate"))
    counts = table(spark, folder, "orders").groupBy(month.alias("month"), F.col("o_orderpriority").alias("state")).agg(F.count("*").alias("n"))
    shares = counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("month")))  # one row a state and month
    return shares.groupBy("month").agg(
        F.count("*").alias("n_states"), (F.abs(F.sum("p") - 1) <= 1e-10).alias("sums_to_one"),
        F.count(F.when((F.col("p") < 0) | (F.col("p") > 1), 1)).alias("n_outside"),
    )


@R.query("""WITH m AS (SELECT l_shipinstruct AS state, avg(l_discount) - avg(l_tax) AS slack FROM lineitem GROUP BY ALL)
SELECT state, row_number() OVER (ORDER BY slack, state) - 1 AS place FROM m""".replace("l_shipinstruct", "l_returnflag || l_linestatus"))
def semantic_order(spark: SparkSession, folder: str) -> DataFrame:
    """States in the order of one mean less another, numbered from zero."""
    slack = table(spark, folder, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("state")).agg(
        (F.avg("l_discount") - F.avg("l_tax")).alias("slack")
    )
    # a handful of states
    ordered = slack.agg(F.array_sort(F.collect_list(F.struct("slack", "state"))).alias("s")).select(F.posexplode("s").alias("place", "s"))
    return ordered.select("s.state", F.col("place").cast("bigint").alias("place"))


@R.query(f"""WITH {PRICES_SQL}, q AS (SELECT month, series, row_number() OVER (PARTITION BY series ORDER BY month) AS t, value FROM prices),
m AS (SELECT series, avg(t) AS mt, stddev_pop(t) AS st, avg(value) AS mv, var_pop(value) AS vv FROM q GROUP BY ALL),
x AS (SELECT q.series, q.month, (t - mt) / st AS d, (1 - mt) / st AS b, (value - mv) / sqrt(vv) AS s, mv / sqrt(vv) AS ms FROM q JOIN m ON m.series = q.series)
SELECT series, month, round(d - b, 6) AS dose, round(d * d - b * b, 6) AS dose_squared, round((d - b) * s, 6) AS dose_by_state,
       round(0.5 * (d - b) - 0.1 * (d * d - b * b) + 0.25 * (d - b) * s, 6) AS contrast, round((d - b) * ms, 5) AS expected_by_state,
       round(ms * ms + 1, 4) AS expected_square, round(0.5 * (d - b) - 0.1 * (d * d - b * b) + 0.25 * (d - b) * ms, 5) AS expected_contrast FROM x""")
def dose_contrast(spark: SparkSession, folder: str) -> DataFrame:
    """Quadratic design of a dose against the first one, at the state and at its expected moments, with the contrasts' values."""
    whole = Window.partitionBy("series")
    q = monthly_prices(spark, folder).withColumn("t", F.row_number().over(whole.orderBy("month")).cast("double"))
    mean, scale = F.avg("t").over(whole), F.stddev_pop("t").over(whole)
    level, spread = F.avg("value").over(whole), F.stddev_pop("value").over(whole)
    x = q.select(
        "series", "month", ((F.col("t") - mean) / scale).alias("d"), ((1 - mean) / scale).alias("b"),
        ((F.col("value") - level) / spread).alias("s"), (level / spread).alias("ms"),
    )
    dose, squared = F.col("d") - F.col("b"), F.col("d") ** 2 - F.col("b") ** 2
    value = lambda state: 0.5 * dose - 0.1 * squared + 0.25 * dose * F.col(state)
    return x.select(
        "series", "month", F.round(dose, 6).alias("dose"), F.round(squared, 6).alias("dose_squared"), F.round(dose * F.col("s"), 6).alias("dose_by_state"),
        F.round(value("s"), 6).alias("contrast"), F.round(dose * F.col("ms"), 5).alias("expected_by_state"),
        # the second moment of a state is its squared mean and its variance, here one scale squared
        F.round(F.col("ms") ** 2 + 1, 4).alias("expected_square"), F.round(value("ms"), 5).alias("expected_contrast"),
    )


_TOKENS_SQL = "tokens AS (SELECT DISTINCT unnest(string_split(coalesce(registered_source_url, '') || ' ' || coalesce(sha256, '') || ' ' || coalesce(final_url, ''), ' ')) AS token FROM retrieval_record)"


@R.query(f"""WITH {_TOKENS_SQL},
kept AS (SELECT token FROM tokens WHERE token <> '' AND NOT regexp_full_match(token, '[0-9a-fA-F]+') AND length(token) - length(replace(token, '/', '')) < 4
  AND regexp_matches(token, '[0-9]')
  AND CAST(regexp_matches(token, '[A-Z]') AS INT) + CAST(regexp_matches(token, '[a-z]') AS INT) + 1 + CAST(regexp_matches(token, '[_+/=-]') AS INT) >= 3),
chars AS (SELECT token, c, count(*) AS n FROM (SELECT token, unnest(string_split(token, '')) AS c FROM kept) GROUP BY ALL),
h AS (SELECT token, round(-sum(n / length(token) * log2(n / length(token))), 6) AS entropy FROM chars GROUP BY ALL)
SELECT token, entropy, entropy >= 4.5 AS suspicious FROM h""")
def high_entropy_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of mixed characters that are neither hashes nor long paths, and whether they look like secrets."""
    text = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("registered_source_url", "sha256", "final_url")])
    tokens = table(spark, folder, "retrieval_record").select(F.explode(F.split(text, " ")).alias("token")).distinct()
    token = F.col("token")
    classes = F.lit(1)
    for pattern in ("[A-Z]", "[a-z]", "[_+/=-]"):
        classes = classes + token.rlike(pattern).cast("int")
    slashes = F.length(token) - F.length(F.replace(token, F.lit("/"), F.lit("")))
    kept = tokens.where(
        (token != "") & ~token.rlike("^[0-9a-fA-F]+$") & (slashes < 4) & token.rlike("[0-9]") & (classes >= 3)
    )
    chars = kept.select("token", F.explode(F.split("token", "")).alias("c")).where("c <> ''").groupBy("token", "c").agg(F.count("*").alias("n"))
    share = F.col("n") / F.length("token")
    found = chars.groupBy("token").agg(F.round(-F.sum(share * F.log2(share)), 6).alias("entropy"))
    return found.withColumn("suspicious", F.col("entropy") >= 4.5)
