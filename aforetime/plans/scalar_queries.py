"""Scalar functions, gates and set operators over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aforetime.plans.registry import Registry
from aforetime.plans.views import PANEL_SQL, panel
from aforetime.sources.tables import table

R = Registry()
TOLERANCE = 1e-12


@R.query("""SELECT d.source, l.label, count(*) AS n_labels, count(*) FILTER (epoch_us(l.labelled_at) <= epoch_us(d.collected_at)) AS n_matured
FROM review_label l JOIN documents d ON d.doc_id = l.doc_id GROUP BY ALL""")
def label_maturity(spark: SparkSession, folder: str) -> DataFrame:
    """Labels known by the time their document was collected (equality counts)."""
    labels = table(spark, folder, "review_label").select("doc_id", "label", "labelled_at")
    documents = table(spark, folder, "documents").select("doc_id", "source", "collected_at")
    mature = F.unix_micros(F.col("labelled_at").cast("timestamp")) <= F.unix_micros(F.col("collected_at").cast("timestamp"))
    return labels.join(documents, "doc_id").groupBy("source", "label").agg(
        F.count("*").alias("n_labels"), F.count(F.when(mature, 1)).alias("n_matured")
    )


@R.query(f"""WITH {PANEL_SQL},
rates AS (SELECT year(month) AS year, CASE WHEN value < -1e-12 THEN 'negative' WHEN value > 1e-12 THEN 'positive' ELSE 'zero' END AS regime, value
          FROM panel WHERE series_id LIKE 'M%' AND value IS NOT NULL),
spine AS (SELECT y.year, r.regime FROM (SELECT DISTINCT year FROM rates) y CROSS JOIN (VALUES ('negative'), ('zero'), ('positive')) r(regime))
SELECT s.year, s.regime, count(r.value) AS n, round(coalesce(sum(r.value), 0), 4) AS total
FROM spine s LEFT JOIN rates r ON r.year = s.year AND r.regime = s.regime GROUP BY ALL""")
def rate_regime_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Readings of rates per year and sign, empty groups included."""
    sign = F.when(F.col("value") < -TOLERANCE, "negative").when(F.col("value") > TOLERANCE, "positive").otherwise("zero")
    rates = (
        panel(spark, folder).where(F.col("series_id").startswith("M") & F.col("value").isNotNull())
        .groupBy(F.year("month").cast("bigint").alias("year"), sign.alias("regime"))
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    )
    regimes = F.explode(F.array(F.lit("negative"), F.lit("zero"), F.lit("positive")))
    spine = rates.select("year").distinct().select("year", regimes.alias("regime"))
    return spine.join(rates, ["year", "regime"], "left").select(
        "year", "regime", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("total", F.lit(0.0)), 4).alias("total")
    )


@R.query("""SELECT regexp_extract(final_url, '^https://([^/]+)/', 1) AS host, count(*) AS n,
       count(*) FILTER (NOT coalesce(regexp_matches(final_url, '^https://data\\.example\\.invalid/.+'), false)) AS n_refused
FROM retrieval_record GROUP BY ALL""")
def url_allow_list(spark: SparkSession, folder: str) -> DataFrame:
    """Retrieved addresses per host, and those that the allow-list (HTTPS, host, non-root path) refuses."""
    rows = table(spark, folder, "retrieval_record")
    allowed = F.coalesce(F.col("final_url").rlike(r"^https://data\.example\.invalid/.+"), F.lit(False))
    host = F.regexp_extract("final_url", "^https://([^/]+)/", 1)
    return rows.groupBy(host.alias("host")).agg(
        F.count("*").alias("n"), F.count(F.when(~allowed, 1)).alias("n_refused")
    )


@R.query("""WITH g AS (SELECT l_orderkey, max(l_extendedprice / 1e4) AS m FROM lineitem GROUP BY ALL),
s AS (SELECT l.l_orderkey, any_value(g.m) + ln(sum(exp(l_extendedprice / 1e4 - g.m))) AS log_total, count(*) AS n
      FROM lineitem l JOIN g ON g.l_orderkey = l.l_orderkey GROUP BY ALL)
SELECT l_orderkey, n, round(log_total, 9) AS log_total FROM s""")
def log_sum_exp(spark: SparkSession, folder: str) -> DataFrame:
    """Stable log of summed exponentials per order, on the order's array of lines."""
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        F.collect_list(F.col("l_extendedprice") / 1e4).alias("x")
    )
    top = F.array_max("x")
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + F.exp(v - top))
    return lines.select(
        "l_orderkey", F.size("x").cast("bigint").alias("n"), F.round(top + F.log(total), 9).alias("log_total")
    )


@R.query("""WITH p AS (SELECT o_orderpriority AS grp, o_orderstatus AS state, count(*) AS n FROM orders GROUP BY ALL),
q AS (SELECT *, n / sum(n) OVER (PARTITION BY grp) AS p FROM p)
SELECT grp, count(*) AS n_states, round(-sum(greatest(p, 1e-15) * ln(greatest(p, 1e-15))), 9) AS entropy FROM q GROUP BY ALL""")
def state_entropy(spark: SparkSession, folder: str) -> DataFrame:
    """Entropy of order states per priority."""
    counts = table(spark, folder, "orders").groupBy(
        F.col("o_orderpriority").alias("grp"), "o_orderstatus"
    ).agg(F.count("*").alias("n"))
    p = F.greatest(F.col("n") / F.sum("n").over(Window.partitionBy("grp")), F.lit(1e-15))
    return counts.withColumn("p", p).groupBy("grp").agg(
        F.count("*").alias("n_states"), F.round(-F.sum(F.col("p") * F.log("p")), 9).alias("entropy")
    )


@R.query("""WITH c AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY ALL), s AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY ALL)
SELECT n.n_nationkey AS nation, c.k IS NULL AS no_customer, s.k IS NULL AS no_supplier FROM nation n LEFT JOIN c ON c.k = n.n_nationkey LEFT JOIN s ON s.k = n.n_nationkey""")
def referential_guards(spark: SparkSession, folder: str) -> DataFrame:
    """Nations that no customer or no supplier refers to."""
    nations = table(spark, folder, "nation").select(F.col("n_nationkey").alias("nation"))
    customers = table(spark, folder, "customer").select(F.col("c_nationkey").alias("nation")).distinct().withColumn("c", F.lit(True))
    suppliers = table(spark, folder, "supplier").select(F.col("s_nationkey").alias("nation")).distinct().withColumn("s", F.lit(True))
    return nations.join(customers, "nation", "left").join(suppliers, "nation", "left").select(
        "nation", F.col("c").isNull().alias("no_customer"), F.col("s").isNull().alias("no_supplier")
    )


@R.query("""WITH a AS (SELECT DISTINCT ref_area, period FROM versioned_value WHERE value IS NOT NULL), b AS (SELECT DISTINCT ref_area, period FROM versioned_value WHERE lower(trim(action)) = 'delete')
SELECT ref_area, count(*) FILTER (b_area IS NOT NULL) AS n_common, count(*) FILTER (b_area IS NULL) AS n_never_deleted
FROM (SELECT a.ref_area, a.period, b.ref_area AS b_area FROM a LEFT JOIN b ON b.ref_area = a.ref_area AND b.period = a.period) GROUP BY ALL""")
def period_set_operations(spark: SparkSession, folder: str) -> DataFrame:
    """Periods that were ever deleted and those that never were, per area: one aggregation instead of two set operators."""
    rows = table(spark, folder, "versioned_value").groupBy("ref_area", "period").agg(
        F.bool_or(F.col("value").isNotNull()).alias("a"), F.bool_or(
            F.coalesce(F.lower(F.trim("action")) == "delete", F.lit(False))
        ).alias("b")
    )
    return rows.where("a").groupBy("ref_area").agg(
        F.count(F.when(F.col("b"), 1)).alias("n_common"), F.count(F.when(~F.col("b"), 1)).alias("n_never_deleted")
    )


@R.query(f"""WITH {PANEL_SQL},
s AS (SELECT panel_id, series_id, max(month) AS last_month, bool_or(month >= DATE '2015-01-01') AS recent, count(value) AS n FROM panel GROUP BY ALL)
SELECT panel_id, count(*) FILTER (n >= 60 AND recent) AS n_retained, count(DISTINCT r.channel) FILTER (n >= 60 AND recent) AS n_channels,
       count(*) FILTER (n >= 60 AND recent) >= 5 AND count(DISTINCT r.channel) FILTER (n >= 60 AND recent) >= 3 AS passes
FROM s JOIN series_registry r ON r.series_id = s.series_id GROUP BY ALL""")
def pilot_panel_gates(spark: SparkSession, folder: str) -> DataFrame:
    """Series with enough recent readings and their channels per panel, and whether the panel passes."""
    series = panel(spark, folder).groupBy("panel_id", "series_id").agg(
        F.bool_or(F.col("month") >= F.lit("2015-01-01").cast("date")).alias("recent"), F.count("value").alias("n")
    )
    kept = series.join(
        table(spark, folder, "series_registry").select("series_id", "channel"), "series_id"
    ).withColumn("kept", (F.col("n") >= 60) & F.col("recent"))
    found = kept.groupBy("panel_id").agg(
        F.count(F.when(F.col("kept"), 1)).alias("n_retained"), F.count_distinct(F.when(F.col("kept"), F.col("channel"))).alias("n_channels")
    )
    return found.withColumn("passes", (F.col("n_retained") >= 5) & (F.col("n_channels") >= 3))
