"""The shared tables seen as outage data, in Spark and as SQL text for the checks.

Snapshots are ``events``: entity = user, value above 20 counts as customers out, a reading is
expected every 360 minutes. Storm context, magnitude and weather derive from the event's columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpulse.functions.columns import zfill
from gridpulse.operators.sessions import sessionize
from gridpulse.plans.catalog import table

SNAPSHOT_MINUTES = 360
LONG_MINUTES = 720
LARGE = 100
EVENT_TYPES = ["None", "click", "error", "purchase", "signup"]
SESSION_OPTIONS = dict(snapshot_minutes=SNAPSHOT_MINUTES, tiebreak=["event_id"], bucket_minutes=1440)


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn(
        "code", F.regexp_extract("props", "([0-9]+)", 1).cast("int"))


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    code = F.col("code")
    return events(spark, sf).select(
        "event_id", zfill("user_id", 5).alias("fips_code"),
        F.concat(F.lit("county "), (F.col("user_id") % 20).cast("string")).alias("county"),
        F.lit("virginia").alias("state"), F.col("ts").alias("run_start_time"),
        F.when(F.col("value") > 20, F.col("value")).otherwise(0.0).alias("customers_affected"),
        F.expr("nullif(event_type, 'view')").alias("event_type"),
        F.when(F.col("event_type").isin("error", "signup"), F.col("value") / 10).alias("magnitude"),
        F.when(code % 3 != 0, code / 2).alias("prcp_mm"), (code - 40).cast("double").alias("tmax_c"),
        (code % 10 == 0).cast("int").alias("wt_fog"))


SNAP = """snap AS (
  SELECT event_id, lpad(CAST(user_id AS VARCHAR), 5, '0') AS fips_code,
    'county ' || CAST(user_id % 20 AS VARCHAR) AS county, 'virginia' AS state, ts AS run_start_time,
    CASE WHEN value > 20 THEN value ELSE 0 END AS customers_affected,
    nullif(event_type, 'view') AS event_type,
    CASE WHEN event_type IN ('error', 'signup') THEN value / 10 END AS magnitude,
    CASE WHEN k % 3 <> 0 THEN k / 2.0 END AS prcp_mm, CAST(k - 40 AS DOUBLE) AS tmax_c,
    CAST(k % 10 = 0 AS INT) AS wt_fog
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events))"""


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    return sessionize(snapshots(spark, sf), **SESSION_OPTIONS)


def sess_sql(source: str = "snap", minutes: int = SNAPSHOT_MINUTES, order: str = "event_id") -> str:
    """SQL for sessions of ``source``; follows the definition row by row, without time buckets."""
    return f"""lagged AS (
  SELECT *, customers_affected > 0 AS is_on,
    lag(customers_affected > 0) OVER w AS prev_on, lag(run_start_time) OVER w AS prev_ts
  FROM {source} WHERE run_start_time IS NOT NULL
  WINDOW w AS (PARTITION BY fips_code ORDER BY run_start_time, {order})),
flagged AS (
  SELECT *, CASE WHEN prev_on IS NULL OR prev_on <> is_on
    OR epoch_us(run_start_time) - epoch_us(prev_ts) > {2 * minutes * 60_000_000} THEN 1 ELSE 0 END AS starts
  FROM lagged),
blocks AS (
  SELECT *, CAST(sum(starts) OVER (PARTITION BY fips_code ORDER BY run_start_time, {order}
    ROWS UNBOUNDED PRECEDING) AS BIGINT) AS block FROM flagged),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY fips_code, block ORDER BY run_start_time, {order}) AS rn
  FROM blocks WHERE is_on),
raw_sess AS (
  SELECT fips_code, block, min(run_start_time) AS start_time, max(run_start_time) AS end_time,
    max(customers_affected) AS peak_customers_affected,
    max(CASE WHEN rn = 1 THEN customers_affected END) AS initial_customers_affected,
    max(CASE WHEN rn = 2 THEN customers_affected END) AS second_value,
    count(*) AS snapshot_count, arg_min(county, rn) AS county, arg_min(state, rn) AS state,
    arg_min(event_type, rn) AS event_type, arg_min(prcp_mm, rn) AS prcp_mm,
    arg_min(tmax_c, rn) AS tmax_c, arg_min(wt_fog, rn) AS wt_fog,
    max(magnitude) AS raw_magnitude, count(event_type) AS weather_event_count
  FROM ranked GROUP BY fips_code, block),
sess AS (
  SELECT fips_code, start_time, end_time, peak_customers_affected, initial_customers_affected,
    snapshot_count, county, state, event_type, prcp_mm, tmax_c, wt_fog, weather_event_count,
    coalesce(raw_magnitude, 0) AS max_magnitude, CAST(raw_magnitude IS NULL AS INT) AS magnitude_missing,
    CAST(weather_event_count > 0 AS INT) AS has_weather_event,
    (epoch_us(end_time) - epoch_us(start_time)) / 60000000.0 + {minutes} AS duration_minutes,
    coalesce(second_value, initial_customers_affected) - initial_customers_affected
      AS delta_customers_affected_15m,
    (coalesce(second_value, initial_customers_affected) - initial_customers_affected)
      / greatest(initial_customers_affected, 1) AS pct_growth_15m
  FROM raw_sess)"""


SESS = f"{SNAP},\n{sess_sql()}"
GOOD = "good AS (SELECT * FROM sess WHERE duration_minutes > 0 AND duration_minutes <= 10080)"
STATS = f"""stats AS (
  SELECT fips_code, quantile_cont(duration_minutes, 0.5) AS county_median_duration,
    avg(CAST(duration_minutes >= {LONG_MINUTES} AS INT)) AS county_long_rate,
    quantile_cont(peak_customers_affected, 0.5) AS county_median_scope,
    avg(CAST(peak_customers_affected >= {LARGE} AS INT)) AS county_large_outage_rate,
    greatest(max(peak_customers_affected), 1) AS county_max_customers
  FROM good GROUP BY fips_code)"""


def daily_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Entity-day weather: readings from the day's values and codes."""
    e = events(spark, sf).select(
        zfill("user_id", 5).alias("fips_code"), F.to_date("ts").alias("date"), "value", "code")
    return e.groupBy("fips_code", "date").agg(
        F.round(F.sum("value") / 4, 4).alias("prcp_mm"), F.max("code").cast("double").alias("snow_mm"),
        (F.max("code") - 50).cast("double").alias("tmax_c"), (F.min("code") - 60).cast("double").alias("tmin_c"),
        F.round(F.max("value") / 20, 4).alias("awnd_ms"), F.round(F.max("value") / 6, 4).alias("wsfg_ms"),
        F.max((F.col("code") % 7 == 0).cast("int")).alias("wt_thunder"),
        F.max((F.col("code") % 5 == 0).cast("int")).alias("wt_snow"),
        F.max((F.col("code") % 11 == 0).cast("int")).alias("wt_ice"),
        F.max((F.col("code") % 13 == 0).cast("int")).alias("wt_blowing_snow"))


DAILY = """daily AS (
  SELECT lpad(CAST(user_id AS VARCHAR), 5, '0') AS fips_code, CAST(ts AS DATE) AS date,
    round(sum(value) / 4, 4) AS prcp_mm, CAST(max(k) AS DOUBLE) AS snow_mm,
    CAST(max(k) - 50 AS DOUBLE) AS tmax_c, CAST(min(k) - 60 AS DOUBLE) AS tmin_c,
    round(max(value) / 20, 4) AS awnd_ms, round(max(value) / 6, 4) AS wsfg_ms,
    max(CAST(k % 7 = 0 AS INT)) AS wt_thunder, max(CAST(k % 5 = 0 AS INT)) AS wt_snow,
    max(CAST(k % 11 = 0 AS INT)) AS wt_ice, max(CAST(k % 13 = 0 AS INT)) AS wt_blowing_snow
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events)
  GROUP BY 1, 2)"""


def error_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).where("event_type = 'error'").select(
        zfill("user_id", 5).alias("fips_code"), F.col("ts").alias("run_start_time"),
        F.col("value").alias("customers_affected"))


ERRS = """errs AS (
  SELECT lpad(CAST(user_id AS VARCHAR), 5, '0') AS fips_code, ts AS run_start_time,
    value AS customers_affected FROM events WHERE event_type = 'error')"""
LABELS = f"""{ERRS}, lab AS (
  SELECT fips_code, CAST(run_start_time AS DATE) AS date, max(customers_affected) AS max_customers_affected,
    CAST(max(customers_affected) >= 50 AS INT) AS outage_occurred FROM errs GROUP BY 1, 2)"""


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """All floating columns rounded, since sums depend on the order of their terms."""
    return df.select(*[
        F.round(f"`{f.name}`", digits).alias(f.name) if f.dataType.typeName() in ("double", "float")
        else F.col(f"`{f.name}`") for f in df.schema])
