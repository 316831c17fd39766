"""Weather rollups and table profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridpulse.functions.columns import zfill
from gridpulse.functions.weather import CODE_FLAGS
from gridpulse.operators import rollups as R
from gridpulse.plans.bindings import DAILY, LABELS, daily_panel, error_snapshots, events, rounded
from gridpulse.plans.catalog import query, table
from gridpulse.plans.queries_columns import _FLAG_SQL, _K


@query("agg1_occurrence_labels", f"WITH {LABELS} SELECT fips_code, date, max_customers_affected, outage_occurred FROM lab")
def _(spark, sf):
    return R.occurrence_labels(error_snapshots(spark, sf), min_customers=50)


def hourly(spark, sf):
    """Each event is one hourly reading of its user; some readings are null."""
    v, k = F.col("value"), F.col("code")
    return events(spark, sf).select(
        zfill("user_id", 5).alias("fips_code"), F.col("ts").alias("time"), (k - 30).cast("double").alias("temperature_2m"),
        v.alias("precipitation"), F.when(k % 4 != 0, v / 10).alias("snowfall"), F.when(k % 6 != 0, v / 1000).alias("snow_depth"),
        F.when(k % 5 != 0, v / 5).alias("wind_speed_10m"), (v / 3).alias("wind_gusts_10m"), k.alias("weather_code"))


HOURLY = f"""hr AS (SELECT lpad(CAST(user_id AS VARCHAR), 5, '0') AS fips_code, ts AS time, k - 30.0::DOUBLE AS temperature_2m,
  value AS precipitation, CASE WHEN k % 4 <> 0 THEN value / 10 END AS snowfall,
  CASE WHEN k % 6 <> 0 THEN value / 1000 END AS snow_depth, CASE WHEN k % 5 <> 0 THEN value / 5 END AS wind_speed_10m,
  value / 3 AS wind_gusts_10m, k, {_FLAG_SQL} FROM {_K})"""
_MAXF = ", ".join(f"max({f}) AS {f}" for f in CODE_FLAGS)


def daily_sql(live: bool) -> str:
    z = (lambda c: f"coalesce({c}, 0)") if live else (lambda c: c)
    cm, m = (10, 1000) if live else (1, 1)
    return (f"WITH {HOURLY} SELECT fips_code, CAST(time AS DATE) AS date, max(temperature_2m) AS tmax_c, min(temperature_2m) AS tmin_c, "
            f"round(coalesce(sum(precipitation), 0), 6) AS prcp_mm, round(coalesce(sum({z('snowfall')}), 0) * {cm}, 6) AS snow_mm, "
            f"round(max({z('snow_depth')}) * {m}, 6) AS snwd_mm, round(avg({z('wind_speed_10m')}) / 3.6, 6) AS awnd_ms, "
            f"round(max(wind_gusts_10m) / 3.6, 6) AS wsfg_ms, {_MAXF} FROM hr GROUP BY 1, 2")


@query("agg8_hourly_to_daily_archive", daily_sql(False))
def _(spark, sf):
    return rounded(R.hourly_to_daily(hourly(spark, sf)), 6)


@query("agg8_hourly_to_daily_live", daily_sql(True))
def _(spark, sf):
    return rounded(R.hourly_to_daily(hourly(spark, sf), preset="live"), 6)


ELEMENTS = {"click": "prcp_mm", "view": "tmax_c", "purchase": "awnd_ms", "error": "wt_thunder", "signup": "wt_fog"}
SCALES = {"click": 0.1, "view": 1.0, "purchase": 0.1, "error": 1.0}


def observations(spark, sf):
    return events(spark, sf).select(
        F.col("user_id").alias("station_id"), F.to_date("ts").alias("date"), F.col("event_type").alias("element"),
        F.when(F.col("code") % 23 == 0, "bad").otherwise(F.col("value").cast("string")).alias("value"),
        F.when(F.col("code") % 10 == 0, "G").when(F.col("code") % 10 == 1, F.lit(None).cast("string")).otherwise(" ").alias("q_flag"))


OBS = f"""obs AS (SELECT user_id AS station_id, CAST(ts AS DATE) AS date, event_type AS element,
  CASE WHEN k % 23 <> 0 THEN value END AS value, k % 10 = 0 AS bad FROM {_K})"""


@query("flt5_quality_filter", f"WITH {OBS} SELECT station_id, date, element, round(value * CASE element WHEN 'click' THEN 0.1::DOUBLE "
       "WHEN 'purchase' THEN 0.1::DOUBLE ELSE 1.0::DOUBLE END, 6) AS value FROM obs WHERE NOT bad AND value IS NOT NULL AND element <> 'signup'")
def _(spark, sf):
    known = spark.createDataFrame(list(SCALES.items()), "element string, scale double")
    return rounded(R.quality_filter(observations(spark, sf), known), 6)


_PIV = ", ".join(
    (f"CAST(trunc(coalesce(avg(value) FILTER (element = '{e}'), 0)) AS INT) AS {n}" if n.startswith("wt_") else
     f"round(avg(value) FILTER (element = '{e}'), 6) AS {n}") for e, n in ELEMENTS.items())
WIDE = "wide AS (SELECT station_id, date, " + _PIV + " FROM (SELECT user_id AS station_id, CAST(ts AS DATE) AS date, event_type AS element, value FROM events) GROUP BY 1, 2)"


def wide(spark, sf):
    long = events(spark, sf).select(F.col("user_id").alias("station_id"), F.to_date("ts").alias("date"),
                                    F.col("event_type").alias("element"), "value")
    return R.pivot_elements(long, ELEMENTS)


@query("agg9_pivot_elements", f"WITH {WIDE} SELECT * FROM wide")
def _(spark, sf):
    return rounded(wide(spark, sf), 6)


@query("agg11_county_day_rollup", f"WITH {WIDE} SELECT station_id % 20 AS fips_code, date, round(avg(prcp_mm), 9) AS prcp_mm, "
       "round(avg(tmax_c), 9) AS tmax_c, round(avg(awnd_ms), 9) AS awnd_ms, max(wt_thunder) AS wt_thunder, max(wt_fog) AS wt_fog FROM wide GROUP BY 1, 2")
def _(spark, sf):
    w = rounded(wide(spark, sf), 6).withColumn("fips_code", F.col("station_id") % 20)
    return rounded(R.entity_day_rollup(w), 9)


@query("agg15_coverage", f"WITH {DAILY} SELECT count(*) AS rows, count(DISTINCT fips_code) AS entities, "
       "round(count(*) / (count(DISTINCT fips_code) * 31) * 100, 6) AS coverage_percent FROM daily")
def _(spark, sf):
    return rounded(R.coverage(daily_panel(spark, sf), "2024-01-01", "2024-01-31"), 6)


@query("agg12_profile",
       "WITH x AS (SELECT date_trunc('day', ts)::TIMESTAMP AS day, nullif(event_type, 'view') AS kind, user_id FROM events), "
       "g AS (SELECT *, count(*) AS n FROM x GROUP BY day, kind, user_id) SELECT CAST(sum(n) AS BIGINT) AS num_records, 3 AS num_columns, "
       "CAST(sum(n) - count(*) AS BIGINT) AS duplicate_rows, min(day) AS first_time, max(day) AS last_time, "
       "CAST(coalesce(sum(n) FILTER (day IS NULL), 0) AS BIGINT) AS missing_day, CAST(coalesce(sum(n) FILTER (kind IS NULL), 0) AS BIGINT) AS missing_kind, "
       "CAST(coalesce(sum(n) FILTER (user_id IS NULL), 0) AS BIGINT) AS missing_user_id FROM g")
def _(spark, sf):
    e = table(spark, sf, "events").select(F.to_date("ts").cast("timestamp_ntz").alias("day"),
                                          F.expr("nullif(event_type, 'view')").alias("kind"), "user_id")
    return R.profile(e)


@query("agg12_missing_by_column", "SELECT 'kind' AS \"column\", count(*) - count(nullif(event_type, 'view')) AS missing, "
       "round((count(*) - count(nullif(event_type, 'view'))) / count(*) * 100, 6) AS percent FROM events "
       "UNION ALL SELECT 'value', count(*) - count(value), round((count(*) - count(value)) / count(*) * 100, 6) FROM events")
def _(spark, sf):
    e = table(spark, sf, "events").select(F.expr("nullif(event_type, 'view')").alias("kind"), "value")
    return rounded(R.missing_by_column(e), 6)


@query("agg13_class_balance", f"WITH {LABELS} SELECT count(*) AS total, CAST(sum(outage_occurred) AS BIGINT) AS positives, "
       "CAST(count(*) - sum(outage_occurred) AS BIGINT) AS negatives, round(sum(outage_occurred) / count(*) * 100, 6) AS positive_percent FROM lab")
def _(spark, sf):
    return rounded(R.class_balance(R.occurrence_labels(error_snapshots(spark, sf), min_customers=50)), 6)


@query("agg16_load_summary", "SELECT count(*) AS records, count(DISTINCT user_id) AS entities, count(DISTINCT event_type) AS event_types, "
       "min(CAST(ts AS DATE)) AS first_date, max(CAST(ts AS DATE)) AS last_date, CAST(min(year(ts)) AS INT) AS first_year, CAST(max(year(ts)) AS INT) AS last_year FROM events")
def _(spark, sf):
    return R.load_summary(events(spark, sf).withColumn("date", F.to_date("ts")), "user_id", "event_type", "date")


@query("agg17_value_counts", "SELECT p_type, count(*) AS n, (SELECT greatest(count(DISTINCT p_type) - 15, 0) FROM part) AS more_values "
       "FROM part GROUP BY p_type ORDER BY n DESC, p_type LIMIT 15")
def _(spark, sf):
    return R.value_counts(table(spark, sf, "part"), "p_type")


@query("agg18_nonzero_report", "SELECT * FROM (SELECT 'l_discount' AS \"column\", count(*) FILTER (l_discount > 0) AS nonzero, "
       "round(count(*) FILTER (l_discount > 0) / count(*) * 100, 6) AS percent FROM lineitem UNION ALL SELECT 'l_tax', count(*) FILTER (l_tax > 0), "
       "round(count(*) FILTER (l_tax > 0) / count(*) * 100, 6) FROM lineitem)")
def _(spark, sf):
    return rounded(R.nonzero_report(table(spark, sf, "lineitem"), ["l_discount", "l_tax"]), 6)


def _describe_sql(c, t):
    return (f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, "
            f"round(min({c}), 6) AS min, round(max({c}), 6) AS max, round(quantile_cont({c}, 0.25), 6) AS p25, "
            f"round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.75), 6) AS p75 FROM {t}")


@query("agg19_describe", " UNION ALL ".join(_describe_sql(c, "lineitem") for c in ("l_quantity", "l_extendedprice", "l_tax")))
def _(spark, sf):
    return rounded(R.describe(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"]), 6)


@query("agg21_lineage_by_source", "WITH c AS (SELECT 'customer' AS source, 'c_custkey' AS f, count(c_custkey) AS n FROM customer "
       "UNION ALL SELECT 'customer', 'c_acctbal', count(c_acctbal) FROM customer UNION ALL SELECT 'events', 'event_id', count(event_id) FROM events "
       "UNION ALL SELECT 'events', 'value', count(value) FROM events UNION ALL SELECT 'events', 'never_set', count(CASE WHEN value < 0 THEN 1 END) FROM events) "
       "SELECT source, count(*) AS feature_count, string_agg(f, ' ' ORDER BY f) AS features FROM c WHERE n > 0 GROUP BY source")
def _(spark, sf):
    never = F.when(F.col("value") < 0, 1).alias("never_set")
    out = R.feature_lineage({
        "events": table(spark, sf, "events").select("event_id", "value", never),
        "customer": table(spark, sf, "customer").select("c_custkey", "c_acctbal")})
    return out.select("source", "feature_count", F.concat_ws(" ", "features").alias("features"))


@query("set1_union_years", "SELECT event_id, value AS sum_value, NULL::DOUBLE AS customers_out FROM events WHERE day(ts) <= 15 "
       "UNION ALL SELECT event_id, NULL, value FROM events WHERE day(ts) > 15")
def _(spark, sf):
    e = table(spark, sf, "events")
    return R.union_years([e.where(F.dayofmonth("ts") <= 15).select("event_id", F.col("value").alias("sum_value")),
                          e.where(F.dayofmonth("ts") > 15).select("event_id", F.col("value").alias("customers_out"))])
