"""Polls, anomalies, forecast days, published predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridpulse.functions.columns import zfill
from gridpulse.functions.weather import CODE_FLAGS
from gridpulse.operators import live as L
from gridpulse.operators import rollups as R
from gridpulse.operators import sessions as S
from gridpulse.plans.bindings import (DAILY, GOOD, LARGE, LONG_MINUTES, SESS, STATS, daily_panel, events, rounded, sessions)
from gridpulse.plans.catalog import query, table
from gridpulse.session import cut_lineage


def raw_polls(spark, sf):
    return events(spark, sf).select(
        F.datediff("ts", F.lit("2024-01-01")).cast("long").alias("poll_no"), zfill("user_id", 5).alias("fips_code"),
        (F.col("event_id") % 2).alias("provider"), F.col("value").alias("cust_a"))


def polls(spark, sf):
    return L.sum_providers(raw_polls(spark, sf), ["poll_no", "fips_code"])


POLL = """poll AS (SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS poll_no,
  lpad(CAST(user_id AS VARCHAR), 5, '0') AS fips_code, sum(value) AS customers FROM events GROUP BY 1, 2),
delta AS (SELECT p.poll_no, p.fips_code, p.customers, p.customers - coalesce(q.customers, p.customers) AS delta,
  (p.customers - coalesce(q.customers, p.customers)) / greatest(coalesce(q.customers, p.customers), 1.0) AS pct_growth
  FROM poll p LEFT JOIN poll q ON q.fips_code = p.fips_code AND q.poll_no = p.poll_no - 1)"""


@query("agg10_sum_providers", f"WITH {POLL} SELECT poll_no, fips_code, round(customers, 6) AS customers FROM poll")
def _(spark, sf):
    return rounded(polls(spark, sf), 6)


@query("win5_poll_delta", f"WITH {POLL} SELECT poll_no, fips_code, round(customers, 6) AS customers, round(delta, 6) AS delta, round(pct_growth, 6) AS pct_growth FROM delta")
def _(spark, sf):
    return rounded(L.poll_delta(polls(spark, sf)), 6)


@query("agg20_live_totals", f"WITH {POLL} SELECT poll_no, count(DISTINCT fips_code) AS counties_affected, round(sum(customers), 4) AS customers_total FROM poll GROUP BY poll_no")
def _(spark, sf):
    return rounded(L.live_totals(polls(spark, sf), ["poll_no"]), 4)


@query("jn12_attach_live", f"WITH {POLL}, {DAILY} SELECT daily.fips_code, date, round(coalesce(customers, 0), 6) AS initial_customers_affected, "
       "round(coalesce(delta, 0), 6) AS delta_customers_affected_15m, round(coalesce(pct_growth, 0), 6) AS pct_growth_15m "
       "FROM daily LEFT JOIN delta ON delta.fips_code = daily.fips_code AND poll_no = date_diff('day', DATE '2024-01-02', date)")
def _(spark, sf):
    d = daily_panel(spark, sf).select("fips_code", "date", F.datediff("date", F.lit("2024-01-02")).cast("long").alias("poll_no"))
    out = L.attach_live(d, L.poll_delta(polls(spark, sf)), ["fips_code", "poll_no"])
    return rounded(out.drop("poll_no"), 6)


# -- anomalies ----------------------------------------------------------------------------------

_Z = " OR ".join(f"abs({c} - avg({c}) OVER w) / nullif(stddev_samp({c}) OVER w, 0) > {{z}}" for c in
                 ("prcp_mm", "tmax_c", "tmin_c", "awnd_ms", "snow_mm"))


@query("win6_cross_section_zscore", f"WITH {DAILY} SELECT fips_code, date, coalesce({_Z.format(z=2.5)}, false) AS zscore_flag FROM daily WINDOW w AS (PARTITION BY date)")
def _(spark, sf):
    return L.cross_section_zscore(daily_panel(spark, sf), "date", limit=2.5).select("fips_code", "date", "zscore_flag")


@query("win7_statistical_anomaly", f"WITH {DAILY} SELECT fips_code, date, coalesce({_Z.format(z=4.0)}, false) OR prcp_mm > 500 OR tmax_c > 60 "
       "OR tmin_c < -40 OR awnd_ms > 25 OR wsfg_ms > 80 OR awnd_ms < 0 OR wsfg_ms < 0 AS stat_anomaly FROM daily WINDOW w AS (PARTITION BY date)")
def _(spark, sf):
    return L.statistical_anomaly(daily_panel(spark, sf), "date").select("fips_code", "date", "stat_anomaly")


# -- forecast days ------------------------------------------------------------------------------

def hourly_arrays(spark, sf):
    """Per user three days of 24 hourly readings: the largest value of its events of that hour, null if none.

    Codes modulo 72 name the hours, so every user yields arrays of 72 entries from all its events.
    """
    e = events(spark, sf).withColumn("code", F.col("code") % 72)
    cells = e.groupBy("user_id", "code").agg(F.round(F.max("value"), 2).alias("v"))
    m = cells.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("code", "v"))).alias("m"))
    hours = F.sequence(F.lit(0), F.lit(71))

    def series(scale: float):
        return F.transform(hours, lambda h: F.try_element_at(F.col("m"), h) * scale)

    codes = F.transform(hours, lambda h: F.floor(F.try_element_at(F.col("m"), h) / 5).cast("double"))
    days = F.array(*[F.lit(f"2024-02-0{i}") for i in (1, 2, 3)])
    return m.select(
        zfill("user_id", 5).alias("fips_code"),
        F.struct(series(1.0).alias("precipitation"), series(0.1).alias("snowfall"), series(0.001).alias("snow_depth"),
                 series(0.213371).alias("windspeed_10m"), series(0.313373).alias("windgusts_10m"), codes.alias("weathercode")).alias("hourly"),
        F.struct(days.alias("time"),
                 F.array(*[F.try_element_at("m", F.lit(i)) for i in range(3)]).alias("temperature_2m_max"),
                 F.array(*[F.try_element_at("m", F.lit(i + 3)) for i in range(3)]).alias("temperature_2m_min")).alias("daily"))


_F = {f: " OR ".join(f"c = {x}" for x in codes) for f, codes in CODE_FLAGS.items()}
FORECAST = f"""cells AS (SELECT user_id, k, max(value) AS v FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 72 AS k FROM events)
  GROUP BY 1, 2),
users AS (SELECT DISTINCT user_id FROM cells),
grid AS (SELECT users.user_id, h.h, coalesce(v, 0) AS v, CAST(floor(coalesce(v, 0) / 5) AS INT) AS c
  FROM users CROSS JOIN (SELECT unnest(range(0, 72)) AS h) h LEFT JOIN cells ON cells.user_id = users.user_id AND cells.k = h.h),
fdays AS (SELECT lpad(CAST(user_id AS VARCHAR), 5, '0') AS fips_code, DATE '2024-02-01' + CAST(h // 24 AS INT) AS date,
  round(sum(v), 3) AS prcp_mm, round(sum(v) * 0.1 * 10, 3) AS snow_mm, round(max(v) * 0.001 * 1000, 3) AS snwd_mm,
  round(sum(v * 0.213371::DOUBLE / 3.6) / 24, 3) AS awnd_ms, round(max(v) * 0.313373::DOUBLE / 3.6, 3) AS wsfg_ms,
  max(CASE WHEN h = h // 24 + 0 THEN 0 END) AS unused, max(CAST(c >= 95 AS INT)) AS has_weather_event,
  round(greatest(sum(v), sum(v * 0.213371::DOUBLE / 3.6) / 24), 3) AS max_magnitude,
  {', '.join(f'max(CAST({rule} AS INT)) AS {f}' for f, rule in _F.items())}
  FROM grid GROUP BY 1, 2)"""


@query("win10_forecast_day_slice", f"WITH {FORECAST}, tops AS (SELECT lpad(CAST(user_id AS VARCHAR), 5, '0') AS fips_code, h, v FROM grid WHERE h < 6) "
       "SELECT f.fips_code, f.date, prcp_mm, snow_mm, snwd_mm, awnd_ms, wsfg_ms, a.v AS tmax_c, b.v AS tmin_c, has_weather_event, max_magnitude, "
       f"0 AS magnitude_missing, {', '.join(CODE_FLAGS)}, 2024 AS year, 2 AS month, CAST(day(f.date) AS INT) AS day, 12 AS hour, "
       "CAST(isodow(f.date) - 1 AS INT) AS dayofweek, CAST(dayofyear(f.date) AS INT) AS dayofyear, CAST(isodow(f.date) >= 6 AS INT) AS is_weekend "
       "FROM fdays f JOIN tops a ON a.fips_code = f.fips_code AND a.h = day(f.date) - 1 JOIN tops b ON b.fips_code = f.fips_code AND b.h = day(f.date) + 2")
def _(spark, sf):
    return L.forecast_days(hourly_arrays(spark, sf))


@query("agg8_live_day", f"WITH {FORECAST.replace('DATE ' + chr(39) + '2024-02-01' + chr(39) + ' + CAST(h // 24 AS INT)', 'DATE ' + chr(39) + '2024-02-01' + chr(39)).replace('/ 24, 3)', '/ 72, 3)')} "
       "SELECT fips_code, prcp_mm, snwd_mm, awnd_ms, wsfg_ms, has_weather_event, max_magnitude, wt_thunder, wt_rain FROM fdays")
def _(spark, sf):
    raw = hourly_arrays(spark, sf).withColumn("now", F.lit("2024-02-01 10:00:00").cast("timestamp_ntz"))
    return L.live_day(raw).select("fips_code", "prcp_mm", "snwd_mm", "awnd_ms", "wsfg_ms", "has_weather_event", "max_magnitude", "wt_thunder", "wt_rain")


# -- predictions --------------------------------------------------------------------------------

def scored(spark, sf):
    """Sessions with fixed formulas standing in for model outputs."""
    good = cut_lineage(S.valid_durations(sessions(spark, sf)), "events")
    stats = S.entity_stats(good, long_minutes=LONG_MINUTES, large=LARGE)
    full = S.add_history(good, stats)
    return full.withColumns({
        "occ_pred": (F.col("snapshot_count") > 1).cast("int"), "occ_prob": F.col("snapshot_count") / 13.0,
        "scope_pred": F.col("peak_customers_affected") * 0.7713377, "dur_pred": F.col("duration_minutes") * 0.9,
        "anomaly_flag": F.col("snapshot_count") > 4, "ae_error": F.col("tmax_c") / 7.0})


SCORED = f"""{SESS}, {GOOD}, {STATS}, scored AS (SELECT good.*, stats.* EXCLUDE (fips_code), CAST(snapshot_count > 1 AS INT) AS occ_pred,
  snapshot_count / 13.0 AS occ_prob, peak_customers_affected * 0.7713377::DOUBLE AS scope_pred, duration_minutes * 0.9::DOUBLE AS dur_pred,
  snapshot_count > 4 AS anomaly_flag, tmax_c / 7.0::DOUBLE AS ae_error FROM good JOIN stats USING (fips_code)),
records AS (SELECT fips_code, start_time, sig AS occurrence, CASE WHEN sig THEN rs ELSE 0 END AS scope, CASE WHEN sig THEN rd ELSE 0 END AS duration,
  round(occ_prob, 4) AS occ_prob, anomaly_flag, round(ae_error, 4) AS ae_error
  FROM (SELECT *, occ_pred = 1 AND rs >= 50 AS sig FROM (SELECT *, CASE WHEN occ_pred = 1 THEN round(scope_pred, 1) ELSE 0 END AS rs,
    CASE WHEN occ_pred = 1 THEN round(dur_pred / 60.0, 2) ELSE 0 END AS rd FROM scored)))"""
KEYS = ["fips_code", "start_time"]


def records(spark, sf):
    return L.prediction_records(scored(spark, sf), KEYS)


@query("prj16_prediction_record", f"WITH {SCORED} SELECT * FROM records")
def _(spark, sf):
    return records(spark, sf)


@query("flt12_significant_only", f"WITH {SCORED} SELECT fips_code, start_time FROM records WHERE occurrence AND scope >= 50")
def _(spark, sf):
    return L.significant_only(records(spark, sf)).select(*KEYS)


@query("flt10_scope_sanity", f"WITH {SCORED} SELECT fips_code, start_time FROM scored WHERE county_median_scope > 0 AND scope_pred > county_median_scope * 2")
def _(spark, sf):
    return L.scope_sanity(scored(spark, sf).withColumn("county_max_customers", F.col("county_median_scope"))).select(*KEYS)


@query("prj19_active_flag_labels", f"WITH {DAILY} SELECT fips_code, date, concat_ws('|', CASE WHEN wt_thunder = 1 THEN '⛈ Thunderstorm' END, CASE WHEN wt_snow = 1 THEN '❄ Snow' END, "
       "CASE WHEN wt_ice = 1 THEN '🧊 Ice' END, CASE WHEN wt_blowing_snow = 1 THEN '💨 Blowing Snow' END) AS active FROM daily")
def _(spark, sf):
    return L.active_flag_labels(daily_panel(spark, sf)).select("fips_code", "date", F.concat_ws("|", "active_flags").alias("active"))


@query("prj19_labelled_weather", f"WITH {DAILY} SELECT fips_code, 'Max Temp' AS label, tmax_c AS value, '°C' AS unit FROM daily UNION ALL "
       "SELECT fips_code, 'Min Temp', tmin_c, '°C' FROM daily UNION ALL SELECT fips_code, 'Snowfall', snow_mm, 'mm' FROM daily")
def _(spark, sf):
    d = daily_panel(spark, sf).select("fips_code", "tmax_c", "tmin_c", "snow_mm")
    return L.labelled_weather(d)


@query("top2_outage_first_listing", f"WITH {SCORED} SELECT fips_code, start_time, occurrence FROM records")
def _(spark, sf):
    r = records(spark, sf).withColumn("name", F.concat("fips_code", F.col("start_time").cast("string")))
    return L.outage_first_listing(r).select(*KEYS, "occurrence")


@query("top7_sorted_dates", f"WITH {DAILY} SELECT DISTINCT date FROM daily ORDER BY date")
def _(spark, sf):
    return L.sorted_dates(daily_panel(spark, sf))


@query("top5_head_preview", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 7")
def _(spark, sf):
    return L.head_preview(table(spark, sf, "events"), [F.desc("value"), "event_id"], 7).select("event_id", "value")


@query("str6_latest_cache", f"WITH {SCORED} SELECT fips_code, start_time AS run_ts, arg.occurrence AS occurrence, arg.scope AS scope FROM "
       "(SELECT fips_code, max(start_time) AS start_time, arg_max(records, start_time) AS arg FROM records GROUP BY fips_code)")
def _(spark, sf):
    r = records(spark, sf).withColumnRenamed("start_time", "run_ts")
    return L.latest_cache(r).select("fips_code", "run_ts", "occurrence", "scope")


@query("agg24_status_summary", f"WITH {SCORED} SELECT count(*) AS counties_cached, max(start_time) AS last_updated, count(*) FILTER (occurrence) AS outages_predicted FROM records")
def _(spark, sf):
    return R.status_summary(records(spark, sf), "start_time")


# -- contributions on given numbers -------------------------------------------------------------

def given_contributions(spark, sf):
    """Fixed stand-ins for contributions: the embedding entries of each vector."""
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", "label", F.posexplode("embedding").alias("i", "x")).select(
        "vec_id", "label", F.concat(F.lit("f"), F.col("i").cast("string")).alias("name"), F.col("x").cast("double").alias("shap"))


CONTRIB = """con AS (SELECT vec_id, label, 'f' || CAST(i - 1 AS VARCHAR) AS name, CAST(embedding[i] AS DOUBLE) AS shap
  FROM embeddings, (SELECT unnest(range(1, 65)) AS i))"""


@query("top4_top_contributions", f"WITH {CONTRIB} SELECT vec_id, name, shap, CAST(p AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(shap) DESC, name) AS p FROM con) WHERE p <= 3")
def _(spark, sf):
    return L.top_contributions(given_contributions(spark, sf), ["vec_id"], 3).select("vec_id", "name", "shap", "place")


@query("ml14_global_importance", f"WITH {CONTRIB} SELECT label, name, round(avg(abs(shap)), 8) AS mean_abs_shap FROM con GROUP BY 1, 2")
def _(spark, sf):
    return rounded(L.global_importance(given_contributions(spark, sf), ["label"]), 8)


@query("top6_sorted_importance", f"WITH {CONTRIB} SELECT name, round(avg(abs(shap)), 8) AS mean_abs_shap FROM con GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def _(spark, sf):
    return rounded(L.sorted_importance(L.global_importance(given_contributions(spark, sf)), 5), 8)
