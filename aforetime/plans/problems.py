"""The numbered problems' queries over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aforetime.functions.months import clean_month, month_index
from aforetime.functions.numbers import bare, finite_number
from aforetime.functions.timetext import instant_us
from aforetime.operators import grid, history, known, profile, snapdiff, spikes
from aforetime.sources.tables import table
from aforetime.storage import small_side

VERSION_KEYS = ("ref_area", "series_id", "period")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every version of versioned_value with its validity period."""
    rows = history.history(table(spark, folder, "versioned_value"), VERSION_KEYS)
    return rows.select(
        *VERSION_KEYS,
        F.unix_micros("valid_from").alias("valid_from_us"),
        F.coalesce(F.unix_micros("valid_to"), F.lit(-1)).alias("valid_to_us"),
    )


def p2_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Implausible rows of both tables with the kind of case."""
    registry = table(spark, folder, "series_registry")
    panel = spikes.implausible(
        table(spark, folder, "panel_rows"),
        ("panel_id", "series_id"),
        period=month_index(F.col("origin_month")),
        value="transformed_value",
        order="origin_timestamp",
        series="series_id",
        registry=registry,
    )
    versions = spikes.implausible(
        table(spark, folder, "versioned_value"),
        ("ref_area", "series_id"),
        period=month_index(F.col("period")),
        value="value",
        order="usable_at",
        series="series_id",
        registry=registry,
        versions=True,
    )
    return panel.withColumn("table_name", F.lit("panel_rows")).unionByName(
        versions.withColumn("table_name", F.lit("versioned_value"))
    )


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """The rows that hold jumps, frozen stretches or impossible numbers."""
    return p2_cases(spark, folder).select("table_name", "row_id").distinct()


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The UTC instant of every time text that names one."""
    texts = {
        "panel_rows": "usable_timestamp",
        "retrieval_record": "retrieved_at_utc",
        "series_audit": "earliest_valid_from",
    }
    parts = [
        table(spark, folder, name).select(
            F.lit(name).alias("table_name"),
            "row_id",
            instant_us(F.col(column), F.col("clock_zone"), F.col("locale_tag")).alias("instant_us"),
        )
        for name, column in texts.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).where(F.col("instant_us").isNotNull())


# The columns of a panel row.
PANEL_COLUMNS = (
    "panel_id", "origin_month", "origin_timestamp", "series_id", "observation_period", "usable_timestamp",
    "transformed_value", "is_missing", "missing_reason", "source_response_sha256",
)
# The reasons that a missing cell may give.
MISSING_REASONS = (
    "no_explicit_release_mapped_observation",
    "insufficient_transformation_lookback",
    "no_strictly_prior_observation",
)

def snapshot_cell_violations(spark: SparkSession, folder: str) -> DataFrame:
    """(row_id, snapshot_no, column_name) of the snapshot cells that break their column's form."""
    registry = (
        table(spark, folder, "series_registry")
        .groupBy(F.upper(bare(F.col("series_id"))).alias("_series"))
        .agg(
            F.min("min_possible").alias("_low"), F.max("max_possible").alias("_high"),
            F.collect_set("series_id").alias("_names")
        )
    )
    rows = table(spark, folder, "panel_snapshot").withColumn("_series", F.upper(bare(F.col("series_id"))))
    rows = rows.join(small_side(registry), "_series", "left")
    value, reason = F.col("transformed_value"), F.col("missing_reason")
    number = finite_number(value)
    blank = value.isNull() | (bare(value) == "")
    inside = F.coalesce(number >= F.col("_low"), F.lit(True)) & F.coalesce(number <= F.col("_high"), F.lit(True))
    stamp = F.col("usable_timestamp")
    day = F.substring(stamp, 9, 2).cast("int")
    year, month = F.substring(stamp, 1, 4).cast("int"), F.substring(stamp, 6, 2).cast("int")
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    month_days = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    time_form = r"^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9][+-](0[0-9]|1[0-4]):[0-5][0-9]$"
    rules = {
        "origin_month": F.col("origin_month").rlike(r"^[0-9]{4}-(0[1-9]|1[0-2])$"),
        "series_id": F.array_contains("_names", F.col("series_id")),
        "observation_period": F.col("observation_period").isNull()
        | F.col("observation_period").rlike(r"^[0-9]{4}-(0[1-9]|1[0-2])(-[0-9]{2})?$"),
        "usable_timestamp": stamp.isNull() | F.when(stamp.rlike(time_form), (year > 0) & (day <= month_days)),
        "transformed_value": blank | F.when(number.isNotNull(), inside),
        "is_missing": F.col("is_missing") == F.when(blank, "1").otherwise("0"),
        "missing_reason": F.when(blank, reason.isin(*MISSING_REASONS)).otherwise(reason.isNull()),
        "source_response_sha256": F.col("source_response_sha256").rlike("^[0-9a-f]{64}$"),
    }
    return profile.violations(rows, "row_id", rules, "snapshot_no")


def p4_profile(spark: SparkSession, folder: str) -> DataFrame:
    """The profile of every PanelRow column per snapshot."""
    return profile.column_profile(
        table(spark, folder, "panel_snapshot"), "snapshot_no", PANEL_COLUMNS, numeric=("transformed_value",)
    )


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Cells that break their column's form, and the loads at which a column changed."""
    cells = snapshot_cell_violations(spark, folder).select(
        F.lit("cell").alias("scope"), F.col("row_id").alias("case_key"), "column_name"
    )
    loads = profile.changed_loads(p4_profile(spark, folder), "snapshot_no").select(
        F.lit("load").alias("scope"), F.col("snapshot_no").cast("bigint").alias("case_key"), "column_name"
    )
    return cells.unionByName(loads)


def p5_as_of(spark: SparkSession, folder: str) -> DataFrame:
    """The vintage row that each event may use."""
    return known.as_known(
        table(spark, folder, "event_cutoff"),
        table(spark, folder, "vintage_value"),
        ("ref_area", "source_series_id"),
        event_id="event_id",
        event_time="state_cutoff_timestamp",
        change_time="first_usable_timestamp",
        period="observation_period",
        value="value",
    ).select("event_id", "row_id", "observation_period", "value")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The vintage row of each event, and the panel rows whose value was not yet known at their origin."""
    as_of = p5_as_of(spark, folder).select(F.lit("as_of").alias("case_kind"), "event_id", "row_id")
    known_at = instant_us(F.col("usable_timestamp"), F.col("clock_zone"), F.col("locale_tag"))
    leaks = (
        table(spark, folder, "panel_rows")
        .withColumn("known_us", known_at)
        .where(F.col("known_us") >= F.unix_micros("origin_timestamp"))
        .select(F.lit("leak").alias("case_kind"), F.lit("").alias("event_id"), "row_id")
    )
    return as_of.unionByName(leaks)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Keys added, removed or changed from one full snapshot to the next."""
    return snapdiff.snapshot_changes(
        table(spark, folder, "panel_snapshot"),
        "snapshot_no",
        {
            "panel_id": F.col("panel_id"),
            "series_id": F.upper(bare(F.col("series_id"))),
            "origin_month": F.coalesce(clean_month(F.col("origin_month")), bare(F.col("origin_month"))),
        },
        finite_number(F.col("transformed_value")),
    )


def p7_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Every source's monthly series with smoothed values and gap kinds."""
    return grid.regular_grid(table(spark, folder, "panel_rows"), ("panel_id", "series_id"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """The cells without a fresh reading."""
    return p7_grid(spark, folder).where(F.col("gap").isNotNull()).select("panel_id", "series_id", "origin_month", "gap")


P1_SQL = """
WITH at_instant AS (
  SELECT ref_area, series_id, period, usable_at, row_id,
         CASE WHEN lower(trim(coalesce(action, ''))) = 'delete' THEN 'deleted'
              WHEN value IS NULL OR isnan(value) THEN 'missing'
              ELSE printf('%.11e', CASE WHEN value = 0 THEN 0.0 ELSE value END) END AS state
  FROM versioned_value
  WHERE usable_at IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY ref_area, series_id, period, usable_at ORDER BY row_id DESC) = 1),
changes AS (
  SELECT * FROM at_instant
  QUALIFY state IS DISTINCT FROM lag(state) OVER (PARTITION BY ref_area, series_id, period ORDER BY usable_at)),
spans AS (
  SELECT *, lead(usable_at) OVER (PARTITION BY ref_area, series_id, period ORDER BY usable_at) AS until FROM changes)
SELECT ref_area, series_id, period, epoch_us(usable_at) AS valid_from_us, coalesce(epoch_us(until), -1) AS valid_to_us
FROM spans WHERE state <> 'deleted'
"""

P5_SQL = """
WITH latest AS (
  SELECT e.event_id, v.row_id, v.observation_period, v.value
  FROM event_cutoff e JOIN vintage_value v
    ON v.ref_area = e.ref_area AND v.source_series_id = e.source_series_id
   AND v.first_usable_timestamp < e.state_cutoff_timestamp
  QUALIFY row_number() OVER (PARTITION BY e.event_id, v.observation_period
                             ORDER BY v.first_usable_timestamp DESC, v.row_id DESC) = 1)
SELECT event_id, row_id, observation_period, value FROM latest
WHERE value IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY observation_period DESC) = 1
"""

MONTH_SQL = """CASE
  WHEN regexp_full_match({0}, '[0-9]{{4}}-(0[1-9]|1[0-2])') THEN {0}
  WHEN regexp_full_match({0}, '[0-9]{{4}}[-/]?[0-9]{{1,2}}([-/]?[0-9]{{1,2}})?')
    THEN regexp_extract({0}, '^([0-9]{{4}})', 1) || '-' || lpad(regexp_extract({0}, '^[0-9]{{4}}[-/]?([0-9]{{1,2}})', 1), 2, '0')
  WHEN regexp_full_match({0}, 'month-[0-9]{{4}}-[0-9]{{2}}') THEN right({0}, 7)
  WHEN regexp_full_match({0}, '[0-9]{{1,2}}[-/][0-9]{{4}}')
    THEN right({0}, 4) || '-' || lpad(regexp_extract({0}, '^([0-9]{{1,2}})', 1), 2, '0')
  WHEN regexp_full_match({0}, '[A-Z][a-z]{{2}}-[0-9]{{4}}')
    THEN right({0}, 4) || '-' || lpad(cast((strpos('JanFebMarAprMayJunJulAugSepOctNovDec', left({0}, 3)) + 2) // 3 AS VARCHAR), 2, '0')
  END"""

P6_SQL = f"""
WITH clean AS (
  SELECT snapshot_no, panel_id, upper(trim(series_id)) AS series_id, {MONTH_SQL.format("origin_month")} AS origin_month,
         row_id,
         CASE WHEN regexp_full_match(trim(transformed_value), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?')
              THEN CAST(trim(transformed_value) AS DOUBLE) END AS num
  FROM panel_snapshot),
held AS (
  SELECT * FROM clean
  QUALIFY row_number() OVER (PARTITION BY snapshot_no, panel_id, series_id, origin_month ORDER BY row_id DESC) = 1),
pairs AS (SELECT snapshot_no AS new_no, lag(snapshot_no) OVER (ORDER BY snapshot_no) AS old_no
          FROM (SELECT DISTINCT snapshot_no FROM panel_snapshot)),
new_rows AS (SELECT p.new_no, h.* FROM pairs p JOIN held h ON h.snapshot_no = p.new_no WHERE p.old_no IS NOT NULL),
old_rows AS (SELECT p.new_no, h.* FROM pairs p JOIN held h ON h.snapshot_no = p.old_no)
SELECT coalesce(n.new_no, o.new_no) AS snapshot_no, coalesce(n.panel_id, o.panel_id) AS panel_id,
       coalesce(n.series_id, o.series_id) AS series_id, coalesce(n.origin_month, o.origin_month) AS origin_month,
       CASE WHEN o.new_no IS NULL THEN 'added' WHEN n.new_no IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM new_rows n FULL JOIN old_rows o
  ON n.new_no = o.new_no AND n.panel_id = o.panel_id AND n.series_id = o.series_id AND n.origin_month = o.origin_month
WHERE o.new_no IS NULL OR n.new_no IS NULL OR n.num IS DISTINCT FROM o.num
"""

P7_SQL = f"""
WITH typed AS (
  SELECT panel_id, series_id, {MONTH_SQL.format("origin_month")} AS origin_month,
         {MONTH_SQL.format("observation_period")} AS seen_month,
         lower(is_missing) IN ('0', 'false') AND transformed_value IS NOT NULL AS reading
  FROM panel_rows),
cells AS (
  SELECT panel_id, series_id, CAST(origin_month || '-01' AS DATE) AS origin, bool_or(reading) AS reading,
         max(CASE WHEN reading THEN seen_month END) AS seen_month
  FROM typed GROUP BY ALL),
ends AS (
  SELECT panel_id, series_id, min(origin) AS lo, max(origin) AS hi FROM cells WHERE reading GROUP BY ALL),
months AS (
  SELECT panel_id, series_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS origin FROM ends),
judged AS (
  SELECT m.panel_id, m.series_id, m.origin,
         CASE WHEN c.origin IS NULL THEN 'absent' WHEN NOT c.reading THEN 'missing'
              WHEN c.seen_month <= max(c.seen_month) OVER (PARTITION BY m.panel_id, m.series_id ORDER BY m.origin
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 'stale' END AS gap
  FROM months m LEFT JOIN cells c ON c.panel_id = m.panel_id AND c.series_id = m.series_id AND c.origin = m.origin)
SELECT panel_id, series_id, strftime(origin, '%Y-%m') AS origin_month, gap FROM judged WHERE gap IS NOT NULL
"""

_REASON_LIST = ", ".join(f"'{r}'" for r in MISSING_REASONS)
_LOAD_PARTS = "\n  UNION ALL ".join(
    f"SELECT snapshot_no AS s, '{c}' AS column_name, CASE WHEN trim({c}) <> '' THEN {c} END AS cell FROM panel_snapshot"
    for c in PANEL_COLUMNS
)
P4_SQL = f"""
WITH registry AS (
  SELECT upper(trim(series_id)) AS k, min(min_possible) AS lo, max(max_possible) AS hi, list(series_id) AS names
  FROM series_registry GROUP BY 1),
typed AS (
  SELECT p.*, r.lo, r.hi, r.names,
         (transformed_value IS NULL OR trim(transformed_value) = '') AS blank,
         CASE WHEN regexp_full_match(trim(transformed_value), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?')
              THEN CAST(trim(transformed_value) AS DOUBLE) END AS num
  FROM panel_snapshot p LEFT JOIN registry r ON r.k = upper(trim(p.series_id))),
judged AS (
  SELECT row_id, unnest([
    CASE WHEN NOT coalesce(regexp_full_match(origin_month, '[0-9]{{4}}-(0[1-9]|1[0-2])'), false) THEN 'origin_month' END,
    CASE WHEN NOT coalesce(list_contains(names, series_id), false) THEN 'series_id' END,
    CASE WHEN NOT regexp_full_match(observation_period, '[0-9]{{4}}-(0[1-9]|1[0-2])(-[0-9]{{2}})?') THEN 'observation_period' END,
    CASE WHEN usable_timestamp IS NOT NULL AND NOT (
           regexp_full_match(usable_timestamp, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9][+-](0[0-9]|1[0-4]):[0-5][0-9]')
           AND try_cast(left(usable_timestamp, 10) AS DATE) IS NOT NULL) THEN 'usable_timestamp' END,
    CASE WHEN NOT blank AND (num IS NULL OR num < lo OR num > hi) THEN 'transformed_value' END,
    CASE WHEN is_missing IS DISTINCT FROM (CASE WHEN blank THEN '1' ELSE '0' END) THEN 'is_missing' END,
    CASE WHEN CASE WHEN blank THEN coalesce(missing_reason NOT IN ({_REASON_LIST}), true)
                   ELSE missing_reason IS NOT NULL END THEN 'missing_reason' END,
    CASE WHEN NOT coalesce(regexp_full_match(source_response_sha256, '[0-9a-f]{{64}}'), false) THEN 'source_response_sha256' END
  ]) AS column_name FROM typed),
cells AS ({_LOAD_PARTS}),
loads AS (SELECT s, lag(s) OVER (ORDER BY s) AS before FROM (SELECT DISTINCT s FROM cells)),
filled AS (SELECT s, column_name, count(cell) AS n, 1 - count(cell) / count(*) AS empty_share FROM cells GROUP BY ALL),
share AS (SELECT c.s, c.column_name, c.cell, count(*) / any_value(f.n) AS share
          FROM cells c JOIN filled f USING (s, column_name) WHERE c.cell IS NOT NULL GROUP BY ALL),
signed AS (
  SELECT l.s, x.column_name, x.cell, x.share AS d FROM loads l JOIN share x ON x.s = l.s WHERE l.before IS NOT NULL
  UNION ALL SELECT l.s, x.column_name, x.cell, -x.share FROM loads l JOIN share x ON x.s = l.before),
texts AS (SELECT DISTINCT s, column_name FROM (SELECT s, column_name, cell, abs(sum(d)) AS d FROM signed GROUP BY ALL) WHERE d > 0.2),
empties AS (SELECT l.s, a.column_name FROM loads l JOIN filled a ON a.s = l.s
            JOIN filled b ON b.s = l.before AND b.column_name = a.column_name WHERE abs(a.empty_share - b.empty_share) > 0.2),
quartile AS (SELECT snapshot_no AS s, quantile_disc(abs(num), 0.75) AS q FROM typed WHERE num IS NOT NULL GROUP BY ALL),
moved AS (SELECT l.s, 'transformed_value' AS column_name FROM loads l JOIN quartile a ON a.s = l.s JOIN quartile b ON b.s = l.before
          WHERE greatest(a.q, b.q) > 10 * least(a.q, b.q))
SELECT 'cell' AS scope, row_id AS case_key, column_name FROM judged WHERE column_name IS NOT NULL
UNION ALL
SELECT 'load', CAST(s AS BIGINT), column_name FROM (SELECT * FROM texts UNION SELECT * FROM empties UNION SELECT * FROM moved)
"""

_CELLS = "\n  UNION ALL ".join(
    [
        f"SELECT snapshot_no AS s, '{c}' AS column_name, CASE WHEN trim({c}) <> '' THEN {c} END AS cell, CAST(NULL AS DOUBLE) AS num FROM panel_snapshot"
        for c in PANEL_COLUMNS
    ]
    + [f"SELECT snapshot_no, 'transformed_value#{kind}', NULL, {number} FROM numbers" for kind, number in (("number", "num"), ("magnitude", "abs(num)"))]
)
P4_PROFILE_SQL = f"""
WITH numbers AS (
  SELECT snapshot_no,
         CASE WHEN regexp_full_match(trim(transformed_value), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?')
              THEN CAST(trim(transformed_value) AS DOUBLE) END AS num
  FROM panel_snapshot),
cells AS ({_CELLS}),
filled AS (
  SELECT s, column_name, count(*) AS n_rows, count(cell) + count(num) AS n_filled,
         count(DISTINCT cell) + count(DISTINCT num) AS n_distinct,
         min(cell) AS min_text, max(cell) AS max_text, min(num) AS min_number, max(num) AS max_number
  FROM cells GROUP BY ALL),
quartiles AS (SELECT s, column_name, quantile_disc(num, [0.25, 0.5, 0.75]) AS q FROM cells WHERE num IS NOT NULL GROUP BY ALL),
loads AS (SELECT s, lag(s) OVER (ORDER BY s) AS before FROM (SELECT DISTINCT s FROM cells)),
shares AS (
  SELECT c.s, c.column_name, c.cell, c.num, count(*) / any_value(f.n_filled) AS share
  FROM cells c JOIN filled f USING (s, column_name) WHERE c.cell IS NOT NULL OR c.num IS NOT NULL GROUP BY ALL),
signed AS (
  SELECT l.s, x.column_name, x.cell, x.num, x.share AS d FROM loads l JOIN shares x ON x.s = l.s WHERE l.before IS NOT NULL
  UNION ALL SELECT l.s, x.column_name, x.cell, x.num, -x.share FROM loads l JOIN shares x ON x.s = l.before),
jumps AS (SELECT s, column_name, cell, num, sum(d) AS d FROM signed GROUP BY ALL),
curves AS (SELECT *, sum(d) OVER (PARTITION BY s, column_name ORDER BY num, cell) AS gap FROM jumps),
moves AS (SELECT s, column_name, max(abs(gap)) AS ks, max(abs(d)) AS jump FROM curves GROUP BY ALL)
SELECT f.s AS snapshot_no, f.column_name, f.n_rows, 1 - f.n_filled / f.n_rows AS empty_share,
       abs(f.n_filled / f.n_rows - b.n_filled / b.n_rows) AS empty_share_change, f.n_distinct,
       f.min_text, f.max_text, f.min_number, f.max_number, q.q[1] AS q25, q.q[2] AS q50, q.q[3] AS q75, p.q[3] AS q75_before,
       CASE WHEN l.before IS NOT NULL THEN coalesce(m.jump, 0) END AS value_share_change,
       CASE WHEN l.before IS NOT NULL THEN coalesce(m.ks, 0) END AS ks_distance
FROM filled f JOIN loads l ON l.s = f.s
LEFT JOIN filled b ON b.s = l.before AND b.column_name = f.column_name
LEFT JOIN quartiles q ON q.s = f.s AND q.column_name = f.column_name
LEFT JOIN quartiles p ON p.s = l.before AND p.column_name = f.column_name
LEFT JOIN moves m ON m.s = f.s AND m.column_name = f.column_name
"""

QUERIES = {
    "p1_found": p1_found,
    "p2_cases": p2_cases,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_profile": p4_profile,
    "p5_as_of": p5_as_of,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p7_found": p7_found,
    "p7_grid": p7_grid,
}
ORACLES = {"p1_found": P1_SQL, "p4_found": P4_SQL, "p4_profile": P4_PROFILE_SQL, "p5_as_of": P5_SQL, "p6_found": P6_SQL, "p7_found": P7_SQL}
