"""Panel audits, coverage, supports, statistics and policies over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aforetime.operators import panels, statistics
from aforetime.plans.registry import Registry
from aforetime.plans.views import PANEL_SQL, PRICES_SQL, monthly_prices, panel
from aforetime.sources.tables import table
from aforetime.storage import written

R = Registry()
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@R.query(f"""WITH {PANEL_SQL}
SELECT series_id, count(*) AS n_cells, count(*) FILTER (value IS NULL) AS n_missing,
       round(100.0 * count(value) / count(*), 6) AS coverage_pct, min(CASE WHEN value IS NOT NULL THEN month END) AS first_observed
FROM panel GROUP BY ALL""")
def panel_missing_by_series(spark: SparkSession, folder: str) -> DataFrame:
    return panel(spark, folder).groupBy("series_id").agg(
        F.count("*").alias("n_cells"),
        F.count(F.when(F.col("value").isNull(), 1)).alias("n_missing"),
        F.round(100 * F.count("value") / F.count("*"), 6).alias("coverage_pct"),
        F.min(F.when(F.col("value").isNotNull(), F.col("month"))).alias("first_observed"),
    )


@R.query(f"""WITH {PANEL_SQL}
SELECT panel_id, coalesce(missing_reason, 'none') AS missing_reason, value IS NULL AS is_missing, count(*) AS n FROM panel GROUP BY ALL""")
def panel_reason_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return panel(spark, folder).groupBy(
        "panel_id", F.coalesce("missing_reason", F.lit("none")).alias("missing_reason"), F.col("value").isNull().alias("is_missing")
    ).agg(F.count("*").alias("n"))


@R.query(f"""WITH {PANEL_SQL}, by_month AS (SELECT panel_id, month, bool_and(value IS NOT NULL) AS whole FROM panel GROUP BY ALL)
SELECT panel_id, count(*) AS n_months, count(*) FILTER (whole) AS n_complete, min(CASE WHEN whole THEN month END) AS first_complete
FROM by_month GROUP BY ALL""")
def panel_fully_observed(spark: SparkSession, folder: str) -> DataFrame:
    cells = panel(spark, folder).withColumn("observed", F.col("value").isNotNull())
    return panels.complete_months(cells, ["panel_id"], "month", "observed")


@R.query("""WITH per_key AS (
  SELECT panel_id, series_id, origin_timestamp, count(*) AS n, count(*) FILTER (transformed_value IS NULL) AS missing,
         count(*) FILTER (NOT isfinite(transformed_value)) AS odd, count(*) FILTER (loaded_at <= origin_timestamp) AS leaks
  FROM panel_rows GROUP BY ALL)
SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_keys, CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS duplicate_keys,
       CAST(sum(missing) AS BIGINT) AS missing_values, CAST(sum(odd) AS BIGINT) AS non_finite_values,
       CAST(sum(leaks) AS BIGINT) AS point_in_time_violations FROM per_key""")
def panel_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Whole-panel integrity counts; a row loaded before its own origin is a violation."""
    return panels.audit(
        table(spark, folder, "panel_rows"), ["panel_id", "series_id", "origin_timestamp"],
        value="transformed_value", known="origin_timestamp", origin="loaded_at",
    )


@R.query("""SELECT panel_id, series_id, origin_month, count(*) AS n_rows, count(DISTINCT transformed_value) AS n_values
FROM panel_rows GROUP BY ALL HAVING count(*) > 1""")
def duplicate_key_guard(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "panel_rows")
        .groupBy("panel_id", "series_id", "origin_month")
        .agg(F.count("*").alias("n_rows"), F.count_distinct("transformed_value").alias("n_values"))
        .where("n_rows > 1")
    )


@R.query(f"""WITH {PANEL_SQL},
ends AS (SELECT panel_id, min(month) AS lo, max(month) AS hi FROM panel GROUP BY ALL),
members AS (SELECT DISTINCT panel_id, series_id FROM panel),
spine AS (SELECT m.panel_id, m.series_id, CAST(unnest(generate_series(e.lo, e.hi, INTERVAL 1 MONTH)) AS DATE) AS month FROM members m JOIN ends e USING (panel_id))
SELECT s.panel_id, s.series_id, s.month, p.value IS NULL AS is_missing,
       CASE WHEN p.value IS NULL THEN coalesce(p.missing_reason, 'no_explicit_release_mapped_observation') END AS missing_reason
FROM spine s LEFT JOIN panel p USING (panel_id, series_id, month)""")
def panel_spine_missing_reason(spark: SparkSession, folder: str) -> DataFrame:
    """A full month × series spine per panel with explicit missing cells."""
    cells = panel(spark, folder)
    ends = cells.groupBy("panel_id").agg(F.min("month").alias("lo"), F.max("month").alias("hi"))
    members = cells.select("panel_id", "series_id").distinct()
    months = F.explode(F.sequence("lo", "hi", F.expr("interval 1 month")))
    spine = members.join(ends, "panel_id").select("panel_id", "series_id", months.alias("month"))
    observed = cells.select("panel_id", "series_id", "month", "value", F.col("missing_reason").alias("own_reason"))
    joined = panels.panel_on_spine(
        spine, observed, ["panel_id", "series_id", "month"], value="value", reason="no_explicit_release_mapped_observation"
    )
    reason = F.when(F.col("is_missing"), F.coalesce("own_reason", "missing_reason"))
    return joined.select("panel_id", "series_id", "month", "is_missing", reason.alias("missing_reason"))


@R.query(f"""WITH {PANEL_SQL}
SELECT panel_id, series_id, month, datediff('month', observed_month, month) AS age,
       coalesce(datediff('month', observed_month, month) > 2, false) AS is_stale,
       CASE WHEN NOT coalesce(datediff('month', observed_month, month) > 2, false) THEN value END AS value
FROM panel WHERE value IS NOT NULL""")
def panel_staleness_cap(spark: SparkSession, folder: str) -> DataFrame:
    """Readings older than two months become missing."""
    cells = panel(spark, folder).where(F.col("value").isNotNull())
    capped = panels.stale_after(cells, period="observed_month", origin="month", value="value", months=2)
    age = F.months_between("month", "observed_month").cast("bigint")
    return capped.select("panel_id", "series_id", "month", age.alias("age"), "is_stale", "value")


@R.query(f"""WITH {PANEL_SQL}, thirds AS (SELECT *, ntile(3) OVER (PARTITION BY panel_id, series_id ORDER BY month) - 1 AS third FROM panel)
SELECT panel_id, series_id, third, count(*) AS n_cells, count(value) AS n_observed, min(month) AS first_month FROM thirds GROUP BY ALL""")
def panel_chronological_thirds(spark: SparkSession, folder: str) -> DataFrame:
    cut = panels.chronological_thirds(panel(spark, folder), ["panel_id", "series_id"], "month")
    return cut.groupBy("panel_id", "series_id", F.col("third").cast("bigint").alias("third")).agg(
        F.count("*").alias("n_cells"), F.count("value").alias("n_observed"), F.min("month").alias("first_month")
    )


@R.query("""SELECT l_returnflag AS state, ntile AS block, count(*) AS n, round(sum(w) * sum(w) / sum(w * w), 6) AS effective_size
FROM (SELECT l_returnflag, l_quantity / 50 AS w, ntile FROM (SELECT *, year(l_shipdate) AS ntile FROM lineitem))
GROUP BY GROUPING SETS ((l_returnflag), (l_returnflag, ntile))""")
def state_support_grouping_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and effective sample size by state, and by state and year, in one pass."""
    rows = table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("state"), F.year("l_shipdate").cast("bigint").alias("block"), (F.col("l_quantity") / 50).alias("w")
    )
    sets = rows.groupingSets([[F.col("state")], [F.col("state"), F.col("block")]], F.col("state"), F.col("block"))
    return sets.agg(F.count("*").alias("n"), F.round(statistics.effective_size(F.col("w")), 6).alias("effective_size")).select(
        "state", "block", "n", "effective_size"
    )


@R.query("""WITH g AS (SELECT l_linestatus AS state, l_returnflag AS feature, sum(l_quantity * l_discount) / sum(l_quantity) AS m FROM lineitem WHERE l_discount IS NOT NULL GROUP BY ALL),
t AS (SELECT l_returnflag AS feature, sum(l_quantity * l_discount) / sum(l_quantity) AS m FROM lineitem GROUP BY ALL)
SELECT s.state, t.feature, round(coalesce(g.m, t.m), 8) AS profile FROM (VALUES ('F'), ('O')) s(state)
CROSS JOIN t LEFT JOIN g ON g.state = s.state AND g.feature = t.feature""")
def state_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """Weighted mean per state and feature; a feature unseen in a state takes its global mean."""
    rows = table(spark, folder, "lineitem").select(
        F.col("l_linestatus").alias("state"), F.col("l_returnflag").alias("feature"), F.col("l_quantity").alias("w"), F.col("l_discount").alias("x")
    )
    mean = statistics.weighted_mean(F.col("x"), F.col("w"))
    own = rows.groupBy("feature").pivot("state", ["F", "O"]).agg(mean)
    both = own.join(rows.groupBy("feature").agg(mean.alias("overall")), "feature")
    long = both.unpivot(["feature", "overall"], ["F", "O"], "state", "own")
    return long.select("state", "feature", F.round(F.coalesce("own", "overall"), 8).alias("profile"))


@R.query("""SELECT event_type, count(*) AS n, round(corr(value, user_id), 8) AS pearson, round(corr(rv, ru), 8) AS spearman FROM (
  SELECT *, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS rv,
         rank() OVER (PARTITION BY event_type ORDER BY user_id) + (count(*) OVER (PARTITION BY event_type, user_id) - 1) / 2.0 AS ru FROM events)
GROUP BY ALL""")
def pearson_spearman(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select("event_type", "value", F.col("user_id").cast("double").alias("user"))
    found = statistics.rank_correlation(rows, ["event_type"], "value", "user")
    return found.select(
        "event_type", "n", F.round("pearson", 8).alias("pearson"), F.round("spearman", 8).alias("spearman")
    )


_CHANGES_SQL = f"""{PANEL_SQL},
changes AS (SELECT *, value - lag(value) OVER (PARTITION BY panel_id, series_id ORDER BY month) AS move FROM panel WHERE value IS NOT NULL)"""


def _changes(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("panel_id", "series_id").orderBy("month")
    return panel(spark, folder).where(F.col("value").isNotNull()).withColumn(
        "move", F.col("value") - F.lag("value").over(w)
    )


@R.query(f"""WITH {_CHANGES_SQL}
SELECT series_id, count(*) AS n_moves, round(quantile_cont(abs(move), 0.1), 6) AS p10, round(quantile_cont(abs(move), 0.5), 6) AS p50,
       round(quantile_cont(abs(move), 0.9), 6) AS p90, round(max(abs(move)), 4) AS largest
FROM changes WHERE move IS NOT NULL GROUP BY ALL""")
def drift_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles of absolute moves per series."""
    moves = written(_changes(spark, folder).where(F.col("move").isNotNull()).select("series_id", F.abs("move").alias("move")), "moves")
    quantiles = statistics.quantiles(moves, ["series_id"], "move", {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    summed = moves.groupBy("series_id").agg(F.count("*").alias("n_moves"), F.round(F.max("move"), 4).alias("largest"))
    return summed.join(quantiles, "series_id").withColumns({c: F.round(c, 6) for c in ("p10", "p50", "p90")})


@R.query(f"""WITH {_CHANGES_SQL},
pairs AS (SELECT a.panel_id, a.series_id, a.month, a.move AS l, b.move AS r FROM changes a JOIN changes b
          ON b.panel_id = a.panel_id AND b.month = a.month AND b.series_id = 'MM_POLICY_RATE' WHERE a.series_id <> 'MM_POLICY_RATE')
SELECT series_id, count(*) AS n, count(*) FILTER (sign(l) * sign(r) < 0) AS n_disagree,
       count(*) FILTER (sign(l) * sign(r) < 0 AND least(abs(l), abs(r)) >= 0.25) AS n_substantive FROM pairs GROUP BY ALL""")
def sign_materiality(spark: SparkSession, folder: str) -> DataFrame:
    """Months in which a series moved against the policy rate, and where that was material."""
    moves = _changes(spark, folder)
    base = moves.where(F.col("series_id") == "MM_POLICY_RATE").select("panel_id", "month", F.col("move").alias("r"))
    pairs = moves.where(F.col("series_id") != "MM_POLICY_RATE").join(base, ["panel_id", "month"])
    return pairs.groupBy("series_id").agg(
        F.count("*").alias("n"), *statistics.sign_disagreement(F.col("move"), F.col("r"), 0.25)
    )


def _wide_prices(spark: SparkSession, folder: str) -> DataFrame:
    return monthly_prices(spark, folder).groupBy("month").pivot("series", list(PRIORITIES)).agg(F.first("value"))


@R.query(f"""WITH {PRICES_SQL}, months AS (SELECT count(DISTINCT month) AS n FROM prices)
SELECT a.series AS i, b.series AS j, round(sum(a.value * b.value) / any_value(n), 4) AS moment
FROM prices a JOIN prices b ON b.month = a.month AND a.series <= b.series CROSS JOIN months GROUP BY ALL""")
def gram_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """Second moments of the monthly price series, gaps as zeros."""
    found = statistics.gram(_wide_prices(spark, folder), PRIORITIES)
    return found.select("i", "j", F.round("moment", 4).alias("moment"))


@R.query(f"""WITH {PRICES_SQL}
SELECT month, max(value) FILTER (series = '1-URGENT') AS urgent, max(value) FILTER (series = '2-HIGH') AS high,
       max(value) FILTER (series = '3-MEDIUM') AS medium, max(value) FILTER (series = '4-NOT SPECIFIED') AS unspecified,
       max(value) FILTER (series = '5-LOW') AS low FROM prices GROUP BY ALL""")
def monthly_matrix(spark: SparkSession, folder: str) -> DataFrame:
    names = dict(zip(PRIORITIES, ("urgent", "high", "medium", "unspecified", "low"), strict=True))
    return _wide_prices(spark, folder).withColumnsRenamed(names)


@R.query(f"""WITH {PRICES_SQL}, cut AS (SELECT *, month < DATE '1998-06-01' AS early FROM prices),
m AS (SELECT series, avg(value) FILTER (early) AS a, avg(value) FILTER (NOT early) AS b, stddev_pop(value) FILTER (early) AS sa,
      stddev_pop(value) FILTER (NOT early) AS sb, count(*) FILTER (early) AS na, count(*) FILTER (NOT early) AS nb FROM cut GROUP BY ALL)
SELECT series, na AS n_early, nb AS n_late, round((b - a) / sqrt((sa * sa + sb * sb) / 2), 6) AS location_shift, round(ln(sb / sa), 6) AS log_scale_ratio FROM m""")
def standardization_drift(spark: SparkSession, folder: str) -> DataFrame:
    """Shift in level and scale between two windows."""
    early = F.col("month") < F.lit("1998-06-01").cast("date")
    a, b = F.when(early, F.col("value")), F.when(~early, F.col("value"))
    m = monthly_prices(spark, folder).groupBy("series").agg(
        F.count(a).alias("n_early"), F.count(b).alias("n_late"), F.avg(a).alias("a"), F.avg(b).alias("b"), F.stddev_pop(a).alias("sa"), F.stddev_pop(b).alias("sb")
    )
    pooled = F.sqrt((F.col("sa") ** 2 + F.col("sb") ** 2) / 2)
    return m.select(
        "series", "n_early", "n_late", F.round((F.col("b") - F.col("a")) / pooled, 6).alias("location_shift"), F.round(F.log(F.col("sb") / F.col("sa")), 6).alias("log_scale_ratio")
    )


_SCORED_SQL = "scored AS (SELECT l_linestatus AS grp, l_discount * 100 AS score, l_returnflag = 'R' AS harm FROM lineitem)"


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        F.col("l_linestatus").alias("grp"), (F.col("l_discount") * 100).alias("score"), (F.col("l_returnflag") == "R").alias("harm")
    )


@R.query(f"""WITH {_SCORED_SQL}, cuts AS (SELECT DISTINCT grp, score AS threshold FROM scored),
n AS (SELECT grp, count(*) AS n FROM scored GROUP BY ALL)
SELECT c.grp, round(c.threshold, 6) AS threshold, round(count(*) / any_value(n.n), 8) AS coverage, count(*) FILTER (s.harm) AS false_authorisations,
       round(count(*) FILTER (s.harm) / count(*), 8) AS selective_risk,
       round((count(*) FILTER (s.harm) + 0.25 * (any_value(n.n) - count(*))) / any_value(n.n), 8) AS mean_loss
FROM cuts c JOIN scored s ON s.grp = c.grp AND s.score <= c.threshold JOIN n ON n.grp = c.grp GROUP BY ALL""")
def policy_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Coverage, risk and loss of every threshold, by running sums over distinct scores."""
    scored = _scored(spark, folder)
    cuts = scored.select("grp", F.col("score").alias("threshold")).distinct()
    found = statistics.policy_metrics(scored, cuts, score="score", harm="harm", cost=0.25, group=["grp"])
    return found.select(
        "grp", F.round("threshold", 6).alias("threshold"), F.round("coverage", 8).alias("coverage"),
        "false_authorisations", F.round("selective_risk", 8).alias("selective_risk"),
        F.round("mean_loss", 8).alias("mean_loss")
    )


@R.query(f"""WITH {_SCORED_SQL}, cuts AS (SELECT DISTINCT grp, score AS threshold FROM scored),
n AS (SELECT grp, count(*) AS n FROM scored GROUP BY ALL),
m AS (SELECT c.grp, c.threshold, round((count(*) FILTER (s.harm) + 0.25 * (any_value(n.n) - count(*))) / any_value(n.n), 8) AS mean_loss
      FROM cuts c JOIN scored s ON s.grp = c.grp AND s.score <= c.threshold JOIN n ON n.grp = c.grp GROUP BY ALL)
SELECT grp, round(threshold, 6) AS threshold, mean_loss FROM m QUALIFY row_number() OVER (PARTITION BY grp ORDER BY mean_loss, threshold) = 1""")
def threshold_selection(spark: SparkSession, folder: str) -> DataFrame:
    """The threshold of least loss; ties go to the lower one."""
    return policy_metrics(spark, folder).groupBy("grp").agg(
        F.min_by(F.struct("threshold", "mean_loss"), F.struct("mean_loss", "threshold")).alias("b")
    ).select("grp", "b.threshold", "b.mean_loss")


@R.query(f"""WITH {PANEL_SQL}, content AS (
  SELECT panel_id, series_id, sha256(string_agg(strftime(month, '%Y-%m') || '=' || coalesce(printf('%.11e', value), ''), '|' ORDER BY month)) AS hash
  FROM panel GROUP BY ALL)
SELECT hash, min(panel_id || '/' || series_id) AS representative, count(*) AS n_members FROM content GROUP BY ALL""")
def scenario_dedup_hash(spark: SparkSession, folder: str) -> DataFrame:
    """Sources of equal content, by hash of their ordered cells."""
    value = F.coalesce(F.format_string("%.11e", F.col("value")), F.lit(""))
    cell = F.struct("month", F.when(F.col("value").isNull(), "").otherwise(value).alias("v"))
    listed = panel(spark, folder).groupBy("panel_id", "series_id").agg(
        F.array_sort(F.collect_list(cell)).alias("cells")
    )
    text = F.array_join(
        F.transform("cells", lambda c: F.concat(F.date_format(c["month"], "yyyy-MM"), F.lit("="), c["v"])), "|"
    )
    hashed = listed.withColumn("hash", F.sha2(text, 256))
    return hashed.groupBy("hash").agg(
        F.min(F.concat("panel_id", F.lit("/"), "series_id")).alias("representative"), F.count("*").alias("n_members")
    )


@R.query(
    """SELECT r.channel, r.series_id, round(r.sign / sqrt(count(*) OVER (PARTITION BY r.channel)), 10) AS weight FROM series_registry r"""
)
def channel_map(spark: SparkSession, folder: str) -> DataFrame:
    """Signed equal weights of a channel's series."""
    size = F.count("*").over(Window.partitionBy("channel"))
    return table(spark, folder, "series_registry").select(
        "channel", "series_id", F.round(F.col("sign") / F.sqrt(size), 10).alias("weight")
    )


@R.query("""SELECT full_series_key, count(*) AS n_rows, count(DISTINCT pilot_id) AS n_pilots, min(earliest_observation_period) AS first_period,
       max(latest_observation_period) AS last_period, CAST(sum(reading_count) AS BIGINT) AS n_readings,
       array_to_string(list_sort(list_distinct(flatten(list(units)))), ';') AS units,
       array_to_string(list_sort(list_distinct(list(observed_timing_class))), ';') AS timing_classes
FROM series_audit GROUP BY ALL""")
def series_profile_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Value-free profile of the audited series."""
    return table(spark, folder, "series_audit").groupBy("full_series_key").agg(
        F.count("*").alias("n_rows"),
        F.count_distinct("pilot_id").alias("n_pilots"),
        F.min("earliest_observation_period").alias("first_period"),
        F.max("latest_observation_period").alias("last_period"),
        F.sum("reading_count").alias("n_readings"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("units")))), ";").alias("units"),
        F.array_join(F.array_sort(F.collect_set("observed_timing_class")), ";").alias("timing_classes"),
    )


@R.query("""SELECT a.observed_timing_class AS timing_class, count(DISTINCT a.full_series_key) AS n_series,
       count(DISTINCT a.full_series_key) FILTER (r.series_id IS NULL) AS n_unregistered
FROM series_audit a LEFT JOIN series_registry r ON r.series_id = a.full_series_key GROUP BY ALL""")
def source_feasibility_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Audited series per timing class, and those the registry doesn't know."""
    registry = table(spark, folder, "series_registry").select("series_id", F.lit(True).alias("known"))
    joined = table(spark, folder, "series_audit").join(registry, F.col("full_series_key") == F.col("series_id"), "left")
    return joined.groupBy(F.col("observed_timing_class").alias("timing_class")).agg(
        F.count_distinct("full_series_key").alias("n_series"),
        F.count_distinct(F.when(F.col("known").isNull(), F.col("full_series_key"))).alias("n_unregistered"),
    )


@R.query("""SELECT item_type, content_type, count(*) AS n_rows, count(DISTINCT sha256) AS n_contents, CAST(sum(response_bytes) AS BIGINT) AS n_bytes,
       count(*) FILTER (final_url IS DISTINCT FROM registered_source_url) AS n_redirected, count(*) FILTER (attempt_count > 1) AS n_retried
FROM retrieval_record GROUP BY ALL""")
def retrieval_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """What was retrieved, redirected and retried, by kind."""
    return table(spark, folder, "retrieval_record").groupBy("item_type", "content_type").agg(
        F.count("*").alias("n_rows"), F.count_distinct("sha256").alias("n_contents"), F.sum("response_bytes").alias("n_bytes"),
        F.count(F.when(~F.col("final_url").eqNullSafe(F.col("registered_source_url")), 1)).alias("n_redirected"),
        F.count(F.when(F.col("attempt_count") > 1, 1)).alias("n_retried"),
    )


@R.query("""SELECT c_mktsegment AS segment, c_custkey AS customer, total AS leverage FROM (
  SELECT c.c_mktsegment, c.c_custkey, round(sum(o.o_totalprice), 2) AS total FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY total DESC, c_custkey) <= 10""")
def top_leverage(spark: SparkSession, folder: str) -> DataFrame:
    """The ten largest contributors per segment (a top-k report)."""
    totals = (
        table(spark, folder, "customer").join(
            table(spark, folder, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total")),
            F.col("c_custkey") == F.col("o_custkey")
        )
        .select(
            F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("customer"),
            F.round("total", 2).alias("leverage")
        )
    )
    w = Window.partitionBy("segment").orderBy(F.desc("leverage"), "customer")
    return totals.withColumn("_n", F.row_number().over(w)).where("_n <= 10").drop("_n")


@R.query("""WITH a AS (SELECT DISTINCT panel_id, origin_month FROM panel_rows WHERE missing_reason IS NOT NULL),
b AS (SELECT DISTINCT panel_id, origin_month FROM panel_rows WHERE lower(is_missing) IN ('1', 'true')),
i AS (SELECT panel_id, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) GROUP BY ALL),
u AS (SELECT panel_id, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) GROUP BY ALL)
SELECT u.panel_id, coalesce(i.n, 0) AS n_both, u.n AS n_either, round(coalesce(i.n, 0) / u.n, 8) AS jaccard FROM u LEFT JOIN i USING (panel_id)""")
def breach_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Overlap of the months with a missing reason and the months with a missing flag."""
    rows = table(spark, folder, "panel_rows").groupBy("panel_id", "origin_month").agg(
        F.bool_or(F.col("missing_reason").isNotNull()).alias("a"), F.bool_or(
            F.coalesce(F.lower("is_missing").isin("1", "true"), F.lit(False))
        ).alias("b")
    )
    both, either = F.count(F.when(F.col("a") & F.col("b"), 1)), F.count("*")
    return rows.where("a or b").groupBy("panel_id").agg(
        both.alias("n_both"), either.alias("n_either"), F.round(both / either, 8).alias("jaccard")
    )


@R.query("""WITH hull AS (SELECT l_returnflag AS g, min(l_discount) AS dl, max(l_discount) AS dh, min(l_tax) AS tl, max(l_tax) AS th
  FROM lineitem WHERE l_quantity <= 5 GROUP BY ALL)
SELECT l_returnflag AS state, count(*) AS n, count(*) FILTER (l_discount BETWEEN dl AND dh AND l_tax BETWEEN tl AND th) AS n_supported
FROM lineitem JOIN hull ON g = l_returnflag GROUP BY ALL""")
def joint_support_rectangle(spark: SparkSession, folder: str) -> DataFrame:
    """Lines inside the margins that the small lines of their flag span."""
    rows = table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("state"), "l_quantity", "l_discount", "l_tax"
    )
    margins = rows.where("l_quantity <= 5").groupBy("state").agg(
        *[f(c).alias(f"{n}_{c}") for c in ("l_discount", "l_tax") for f, n in ((F.min, "lo"), (F.max, "hi"))]
    )
    inside = F.col("l_discount").between(
        F.col("lo_l_discount"), F.col("hi_l_discount")
    ) & F.col("l_tax").between(F.col("lo_l_tax"), F.col("hi_l_tax"))
    return rows.join(margins, "state").groupBy("state").agg(
        F.count("*").alias("n"), F.count(F.when(inside, 1)).alias("n_supported")
    )
