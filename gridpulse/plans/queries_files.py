"""File formats and raw JSON: tables rendered to each format in the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpulse.functions.columns import zfill

from gridpulse.plans import jobs
from gridpulse.plans.bindings import DAILY, GOOD, LARGE, LONG_MINUTES, SESS, STATS, daily_panel, events, rounded, sessions
from gridpulse.plans.catalog import query, table
from gridpulse.plans.queries_joins import NEAR, PTS, points, centroids
from gridpulse.plans.queries_live import FORECAST, hourly_arrays
from gridpulse.session import scratch_path
from gridpulse.sources import readers as S
from gridpulse.sources import writers as W


def land(df: DataFrame, name: str, sep: str = ",", header: bool = True, gz: bool = False) -> str:
    path = scratch_path(df.sparkSession, name)
    writer = df.write.option("sep", sep).option("header", header)
    (writer.option("compression", "gzip") if gz else writer).csv(path)
    return path


def land_text(df: DataFrame, name: str) -> str:
    path = scratch_path(df.sparkSession, name)
    df.write.text(path)
    return path


# -- snapshots ----------------------------------------------------------------------------------

def landed_snapshots(spark, sf) -> list[str]:
    """Two yearly layouts: an early one with ``customers_out``, a later one with ``sum``."""
    e = events(spark, sf)
    ts = F.when(F.col("code") % 17 == 0, "not a time").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    base = e.select(
        "event_id", F.col("user_id").cast("string").alias("fips_code"), F.lit("c").alias("county"),
        F.when(F.col("user_id") % 3 == 0, "VIRGINIA").when(F.col("user_id") % 3 == 1, "Virginia").otherwise("Ohio").alias("state"),
        ts.alias("run_start_time"), F.when(F.col("code") % 19 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("n"))
    old = base.where("event_id % 2 = 0").withColumnRenamed("n", "customers_out")
    new = base.where("event_id % 2 = 1").withColumnRenamed("n", "sum")
    return [land(old, "early"), land(new, "late")]


_SNAPF = """f AS (SELECT event_id, user_id, CASE WHEN user_id % 3 = 0 THEN 'VIRGINIA' WHEN user_id % 3 = 1 THEN 'Virginia' ELSE 'Ohio' END AS state,
  CASE WHEN k % 17 <> 0 THEN date_trunc('second', ts)::TIMESTAMP END AS run_start_time, CASE WHEN k % 19 <> 0 THEN value END AS v
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events))"""


@query("src1_load_snapshots", f"WITH {_SNAPF} SELECT CAST(event_id AS VARCHAR) AS event_id, lpad(CAST(user_id AS VARCHAR), 5, '0') AS fips_code, state, run_start_time, "
       "CAST(trunc(coalesce(v, 0)) AS BIGINT) AS customers_affected FROM f WHERE lower(state) = 'virginia'")
def _(spark, sf):
    return S.load_snapshots(spark, landed_snapshots(spark, sf)).select(
        "event_id", "fips_code", "state", "run_start_time", "customers_affected")


@query("src2_load_snapshots_strict", f"WITH {_SNAPF} SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS fips_code, run_start_time FROM f WHERE run_start_time IS NOT NULL")
def _(spark, sf):
    return S.load_snapshots_strict(spark, landed_snapshots(spark, sf)).select("event_id", "fips_code", "run_start_time")


@query("src12_scan_snapshots_bulk", f"WITH {_SNAPF} SELECT CAST(year(run_start_time) AS INT) AS year, count(*) AS kept FROM f WHERE state = 'Virginia' GROUP BY 1")
def _(spark, sf):
    return S.kept_per_year(S.scan_snapshots_bulk(spark, landed_snapshots(spark, sf)))


@query("flt1_state_filter", f"WITH {_SNAPF} SELECT event_id, lower(state) = 'virginia' AS any_case, state = 'Virginia' AS exact FROM f")
def _(spark, sf):
    e = events(spark, sf).withColumn("state", F.when(F.col("user_id") % 3 == 0, "VIRGINIA").when(
        F.col("user_id") % 3 == 1, "Virginia").otherwise("Ohio"))
    return e.select("event_id", S.in_state("state", "virginia").alias("any_case"), S.in_state("state", "Virginia", exact=True).alias("exact"))


# -- storm events -------------------------------------------------------------------------------

def storm_rows(spark, sf) -> DataFrame:
    k = F.col("o_orderkey")
    d = F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (k % 24).cast("int"))
    begin = F.when(k % 3 == 0, F.upper(F.date_format(d, "dd-MMM-yy HH:mm:ss"))).when(
        k % 3 == 1, F.date_format(d, "MM/dd/yyyy HH:mm")).otherwise(F.date_format(d, "yyyy-MM-dd HH:mm:ss"))
    return table(spark, sf, "orders").select(
        k.alias("EVENT_ID"), begin.alias("BEGIN_DATE_TIME"), F.when(k % 5 == 0, "junk").otherwise(begin).alias("END_DATE_TIME"),
        F.col("o_orderpriority").alias("EVENT_TYPE"), (k % 60).alias("STATE_FIPS"), (F.col("o_custkey") % 7).alias("CZ_FIPS"),
        F.when(k % 7 == 0, "Z").otherwise("C").alias("CZ_TYPE"),
        F.when(k % 2 == 0, "VIRGINIA").otherwise("OHIO").alias("STATE"), F.year("o_orderdate").alias("YEAR"))


def zones(spark, sf) -> DataFrame:
    return table(spark, sf, "nation").select(zfill(F.col("n_regionkey"), 3).alias("zone"), zfill(F.col("n_nationkey") + 51000, 5).alias("fips_code"))


_ST = """st AS (SELECT o_orderkey, o_orderdate + to_hours(CAST(o_orderkey % 24 AS INT)) AS b, o_orderpriority AS event_type,
  lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') || lpad(CAST(o_custkey % 7 AS VARCHAR), 3, '0') AS code,
  lpad(CAST(o_custkey % 7 AS VARCHAR), 3, '0') AS cz, o_orderkey % 7 = 0 AS is_zone FROM orders),
zn AS (SELECT lpad(CAST(n_regionkey AS VARCHAR), 3, '0') AS zone, CAST(n_nationkey + 51000 AS VARCHAR) AS zcode FROM nation)"""


@query("src3_load_interval_events", f"WITH {_ST}, x AS (SELECT o_orderkey, b, event_type, code AS fips_code FROM st WHERE NOT is_zone UNION ALL "
       "SELECT o_orderkey, b, event_type, zcode FROM st JOIN zn ON cz = zone WHERE is_zone) SELECT CAST(o_orderkey AS VARCHAR) AS event_id, b AS begin_date, "
       "CASE WHEN o_orderkey % 5 <> 0 THEN b END AS end_date, event_type, fips_code FROM x")
def _(spark, sf):
    path = land(storm_rows(spark, sf), "storms", gz=True)
    return S.load_interval_events(spark, path, zones(spark, sf)).select("event_id", "begin_date", "end_date", "event_type", "fips_code")


@query("src3_load_search_export", f"WITH {_ST} SELECT CAST(o_orderkey AS VARCHAR) AS event_id, b AS begin_date, CASE WHEN o_orderkey % 2 = 0 THEN '51' || cz END AS fips_code FROM st")
def _(spark, sf):
    s = storm_rows(spark, sf)
    export = s.select("EVENT_ID", F.col("BEGIN_DATE_TIME").alias("BEGIN_DATE"), "EVENT_TYPE", "CZ_FIPS",
                      F.when(F.col("STATE") == "VIRGINIA", "VA").otherwise("OH").alias("STATE_ABBR"))
    return S.load_interval_events(spark, land(export, "export")).select("event_id", "begin_date", "fips_code")


@query("src4_load_intervals_simple", f"WITH {_ST} SELECT CAST(o_orderkey AS VARCHAR) AS \"EVENT_ID\", b AS event_start, CASE WHEN o_orderkey % 5 <> 0 THEN b END AS event_end FROM st")
def _(spark, sf):
    return S.load_intervals_simple(spark, land(storm_rows(spark, sf), "storms")).select("EVENT_ID", "event_start", "event_end")


@query("src11_scan_interval_events_bulk", "SELECT CAST(o_orderkey AS VARCHAR) AS \"EVENT_ID\", CAST(CAST(year(o_orderdate) AS INT) AS VARCHAR) AS \"YEAR\" FROM orders WHERE o_orderkey % 2 = 0")
def _(spark, sf):
    s = storm_rows(spark, sf)
    early, late = land(s.where("YEAR < 1998"), "early", gz=True), land(s.where("YEAR >= 1998").drop("CZ_TYPE"), "late", gz=True)
    return S.scan_interval_events_bulk(spark, [early, late]).select("EVENT_ID", "YEAR")


# -- geography, stations, statistics ------------------------------------------------------------

@query("src5_load_zone_county", "SELECT lpad(CAST(s_nationkey AS VARCHAR), 3, '0') AS zone, CAST(51000 + s_suppkey AS VARCHAR) AS fips_code, "
       "'zone ' || CAST(s_nationkey AS VARCHAR) AS zone_name, s_name AS county_name FROM supplier WHERE s_suppkey % 2 = 0")
def _(spark, sf):
    k = F.col("s_suppkey")
    blank = F.lit("x")
    rows = table(spark, sf, "supplier").select(
        F.when(k % 2 == 0, "VA").otherwise("NC").alias("a"), zfill("s_nationkey", 3).alias("b"), blank.alias("c"),
        F.concat(F.lit("zone "), F.col("s_nationkey").cast("string")).alias("d"), blank.alias("e"), F.col("s_name").alias("f"),
        (k + 51000).cast("string").alias("g"), blank.alias("h"), blank.alias("i"), F.lit("1.0").alias("j"), F.lit("2.0").alias("k"))
    cache = scratch_path(spark, "zonecache")
    return S.load_zone_county(spark, land(rows, "zones", sep="|", header=False), cache=cache)


@query("src6_load_daily_weather", f"WITH {DAILY} SELECT fips_code, date, prcp_mm, tmax_c, wt_thunder FROM daily")
def _(spark, sf):
    path = land(daily_panel(spark, sf), "daily")
    return S.load_daily_weather(spark, path).select("fips_code", "date", "prcp_mm", "tmax_c", "wt_thunder")


@query("src7_load_entity_stats", f"WITH {SESS}, {GOOD}, {STATS} SELECT fips_code, round(county_median_duration, 9) AS county_median_duration, "
       "round(county_max_customers, 9) AS county_max_customers FROM stats")
def _(spark, sf):
    from gridpulse.operators.sessions import entity_stats, valid_durations
    stats = entity_stats(valid_durations(sessions(spark, sf)), long_minutes=LONG_MINUTES, large=LARGE)
    found = S.load_entity_stats(spark, land(stats, "stats"))
    absent = S.load_entity_stats(spark, scratch_path(spark, "nowhere"))
    return rounded(found.unionByName(absent).select("fips_code", "county_median_duration", "county_max_customers"))


@query("src8_load_centroids", f"WITH {PTS} SELECT CAST(vec_id AS VARCHAR) AS fips, 'p' || CAST(label AS VARCHAR) AS county_name, round(lat, 6) AS latitude, round(lon, 6) AS longitude FROM pts WHERE vec_id % 2 = 1")
def _(spark, sf):
    p = points(spark, sf)
    rows = p.select(F.when(F.col("vec_id") % 2 == 1, "VA").otherwise("NC").alias("USPS"), F.col("vec_id").cast("string").alias("GEOID"),
                    F.concat(F.lit("p"), F.col("label").cast("string")).alias("NAME"), F.round("lat", 6).alias("INTPTLAT"),
                    F.round("lon", 6).alias("INTPTLONG          "))
    return S.load_centroids(spark, land(rows, "gaz", sep="\t"))


@query("src9_parse_station_list", "SELECT 'ST' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS station_id, CAST(30 + s_nationkey AS DOUBLE) + 0.25::DOUBLE AS lat, "
       "-80.5::DOUBLE AS lon, 'VA' AS state, s_name AS name FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey % 7 <> 0 AND s_suppkey % 11 <> 0")
def _(spark, sf):
    k = F.col("s_suppkey")
    lat = F.when(k % 7 == 0, "  ?????").otherwise(F.format_string("%7s", F.concat((F.col("s_nationkey") + 30).cast("string"), F.lit(".25"))))
    line = F.concat(F.lit("ST"), zfill(k, 9), F.lit("  "), lat, F.lit("  -80.5000"), F.lit("  100.0 "),
                    F.when(k % 2 == 0, "VA").otherwise("NC"), F.lit(" "), F.rpad("s_name", 30, " "))
    lines = table(spark, sf, "supplier").select(F.when(k % 11 == 0, "too short").otherwise(line).alias("value"))
    return S.load_station_list(spark, land_text(lines, "stations"))


_OBSF = """o AS (SELECT 'S' || CAST(user_id AS VARCHAR) AS station_id, strftime(ts, '%Y%m%d') AS date, CASE event_type WHEN 'click' THEN 'PRCP'
    WHEN 'view' THEN 'TMAX' WHEN 'error' THEN 'WT03' WHEN 'purchase' THEN 'SNOW' ELSE 'XXXX' END AS element,
  CASE WHEN k % 23 <> 0 THEN CAST(floor(value) AS DOUBLE) END AS value, k % 10 = 0 AS bad, user_id
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events)),
kept AS (SELECT station_id, date, element, round(value * CASE WHEN element IN ('PRCP', 'TMAX') THEN 0.1::DOUBLE ELSE 1.0::DOUBLE END, 6) AS value, user_id FROM o
  WHERE NOT bad AND value IS NOT NULL AND element <> 'XXXX' AND user_id IN (SELECT user_id FROM events WHERE value > 300))"""


def landed_observations(spark, sf) -> str:
    e = events(spark, sf)
    element = (F.when(F.col("event_type") == "click", "PRCP").when(F.col("event_type") == "view", "TMAX")
               .when(F.col("event_type") == "error", "WT03").when(F.col("event_type") == "purchase", "SNOW").otherwise("XXXX"))
    rows = e.select(
        F.concat(F.lit("S"), F.col("user_id").cast("string")).alias("station_id"), F.date_format("ts", "yyyyMMdd").alias("date"),
        element.alias("element"), F.when(F.col("code") % 23 == 0, "").otherwise(F.floor("value").cast("string")).alias("value"),
        F.lit(None).cast("string").alias("m"), F.when(F.col("code") % 10 == 0, "G").otherwise("").alias("q"),
        F.lit("7").alias("s"), F.lit(None).cast("string").alias("t"))
    return land(rows, "obs", header=False, gz=True)


def station_list(spark, sf) -> DataFrame:
    """Stations are users, placed at the embedding whose id equals the user's modulo the vector count."""
    e = events(spark, sf).where("value > 300").select("user_id").distinct()
    return e.join(points(spark, sf), F.col("user_id") == F.col("vec_id")).select(
        F.concat(F.lit("S"), F.col("user_id").cast("string")).alias("station_id"), F.lit("n").alias("name"), "lat", "lon")


def known_stations(spark, sf) -> DataFrame:
    return events(spark, sf).where("value > 300").select(
        F.concat(F.lit("S"), F.col("user_id").cast("string")).alias("station_id")).distinct()


@query("src10_scan_station_obs", f"WITH {_OBSF} SELECT station_id, date, element, value FROM kept")
def _(spark, sf):
    obs = S.scan_station_obs(spark, landed_observations(spark, sf), known_stations(spark, sf), partitions=8)
    return rounded(obs, 6)


@query("pip5_station_weather_job", f"WITH {NEAR}, {_OBSF}, wide AS (SELECT station_id, date, user_id, avg(value) FILTER (element = 'PRCP') AS prcp_mm, "
       "avg(value) FILTER (element = 'TMAX') AS tmax_c, CAST(trunc(coalesce(avg(value) FILTER (element = 'WT03'), 0)) AS INT) AS wt_thunder FROM kept GROUP BY 1, 2, 3) "
       "SELECT CAST(nearest_label AS VARCHAR) AS fips_code, CAST(strptime(date, '%Y%m%d') AS DATE) AS date, round(avg(prcp_mm), 6) AS prcp_mm, round(avg(tmax_c), 6) AS tmax_c, max(wt_thunder) AS wt_thunder "
       "FROM wide JOIN near ON near.vec_id = wide.user_id GROUP BY 1, 2")
def _(spark, sf):
    obs = rounded(S.scan_station_obs(spark, landed_observations(spark, sf), known_stations(spark, sf)), 6)
    counties = centroids(spark, sf).select(F.col("label").cast("string").alias("fips_code"), "latitude", "longitude")
    out = jobs.station_weather_job(station_list(spark, sf), counties, obs, {"PRCP": "prcp_mm", "TMAX": "tmax_c", "WT03": "wt_thunder"},
                                   path=scratch_path(spark, "daily"))
    return rounded(out, 6)


# -- listings -----------------------------------------------------------------------------------

def listing(spark, sf) -> DataFrame:
    stamp = F.date_format(F.to_date("o_orderdate"), "yyyyMMdd")
    year = F.year("o_orderdate").cast("string")
    return table(spark, sf, "orders").select(
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("StormEvents_details-ftp_v1.0_d"), year, F.lit("_c"), stamp, F.lit(".csv.gz")))
        .when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("eaglei_outages_"), F.when(F.col("o_orderkey") % 2 == 0, year).otherwise("x" ), F.lit(".csv")))
        .otherwise(F.concat(F.lit("readme_"), stamp)).alias("name"))


@query("src13_latest_file_per_year", "SELECT CAST(year(o_orderdate) AS INT) AS year, max('StormEvents_details-ftp_v1.0_d' || CAST(year(o_orderdate) AS VARCHAR) || '_c' || strftime(o_orderdate, '%Y%m%d') || '.csv.gz') AS file "
       "FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1")
def _(spark, sf):
    return S.latest_file_per_year(listing(spark, sf))


@query("src14_catalog_files", "SELECT 'eaglei_outages_' || CAST(year(o_orderdate) AS VARCHAR) || '.csv' AS name, CAST(year(o_orderdate) AS INT) AS year FROM orders WHERE o_orderkey % 3 = 1 AND o_orderkey % 2 = 0")
def _(spark, sf):
    return S.catalog_files(listing(spark, sf))


# -- raw JSON -----------------------------------------------------------------------------------

def weather_json(spark, sf) -> DataFrame:
    """API-shaped responses, landed as text; every seventh one is an error without ``hourly``."""
    h = hourly_arrays(spark, sf)
    hours = F.transform(F.sequence(F.lit(0), F.lit(71)), lambda i: F.date_format(
        F.lit("2024-02-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), i), "yyyy-MM-dd'T'HH:mm"))
    temps = F.transform("hourly.precipitation", lambda v: v / 10)
    full = h.withColumn("hourly", F.struct(hours.alias("time"), temps.alias("temperature_2m"), *[
        F.col(f"hourly.{n}").alias(n) for n in ("precipitation", "snowfall", "snow_depth", "windspeed_10m", "windgusts_10m", "weathercode")]))
    body = F.when(F.col("fips_code").cast("int") % 7 == 0, '{"error": true}').otherwise(
        F.to_json(F.struct("hourly", "daily"), {"ignoreNullFields": "false"}))
    return full.select("fips_code", body.alias("body"))


_HOURS = f"""{FORECAST}, hours AS (SELECT lpad(CAST(g.user_id AS VARCHAR), 5, '0') AS fips_code, h, TIMESTAMP '2024-02-01' + to_hours(CAST(h AS INT)) AS time,
  cells.v AS v, g.c FROM grid g LEFT JOIN cells ON cells.user_id = g.user_id AND cells.k = g.h WHERE g.user_id % 7 <> 0)"""


@query("src15_ingest_hourly_weather_json", f"WITH {_HOURS} SELECT fips_code, time, v AS precipitation, round(v * 0.213371::DOUBLE, 6) AS wind_speed_10m, "
       "CASE WHEN v IS NOT NULL THEN CAST(c AS DOUBLE) END AS weather_code FROM hours")
def _(spark, sf):
    hours = S.explode_hours(S.parse_weather_json(weather_json(spark, sf)))
    return hours.select("fips_code", "time", "precipitation", F.round("wind_speed_10m", 6).alias("wind_speed_10m"), "weather_code")


_FL = ", ".join(f"CAST(c IN {codes if len(codes) > 1 else f'({codes[0]})'} AS INT) AS {f}" for f, codes in
                (("wt_fog", (45, 48)), ("wt_rain", (61, 63, 65, 80, 81, 82)), ("wt_ice", (66, 67))))


@query("pip12_hourly_features", f"WITH {_HOURS}, tops AS (SELECT lpad(CAST(user_id AS VARCHAR), 5, '0') AS fips_code, v FROM cells WHERE k = 0) SELECT hours.fips_code, time, coalesce(hours.v, 0) AS prcp_mm, "
       "round(coalesce(hours.v * 0.213371::DOUBLE, 0) / 3.6, 3) AS awnd_ms, round(coalesce(hours.v * 0.001::DOUBLE, 0) * 1000, 6) AS snwd_mm, tops.v AS tmax_c, "
       f"CAST(c >= 95 AS INT) AS has_weather_event, {_FL}, CAST(hour(time) AS INT) AS hour, CAST(isodow(time) - 1 AS INT) AS dayofweek, "
       "greatest(coalesce(hours.v, 0), round(coalesce(hours.v * 0.213371::DOUBLE, 0) / 3.6, 3)) AS max_magnitude FROM hours LEFT JOIN tops ON tops.fips_code = hours.fips_code")
def _(spark, sf):
    out = jobs.hourly_features_job(weather_json(spark, sf))
    return out.select("fips_code", "time", "prcp_mm", "awnd_ms", F.round("snwd_mm", 6).alias("snwd_mm"), "tmax_c", "has_weather_event",
                      "wt_fog", "wt_rain", "wt_ice", "hour", "dayofweek", "max_magnitude")


def _daily_archive(where: str) -> str:
    return (f"WITH {_HOURS} SELECT fips_code, CAST(time AS DATE) AS date, round(max(v / 10), 6) AS tmax_c, round(coalesce(sum(v), 0), 6) AS prcp_mm, "
            f"round(avg(v * 0.213371::DOUBLE) / 3.6, 6) AS awnd_ms, max(CAST(v IS NOT NULL AND c IN (61, 63, 65, 80, 81, 82) AS INT)) AS wt_rain FROM hours WHERE {where} GROUP BY 1, 2")


@query("pip6_historical_weather_job", _daily_archive("CAST(fips_code AS INT) NOT IN (SELECT user_id FROM events WHERE value > 450)"))
def _(spark, sf):
    raw = weather_json(spark, sf)
    done = events(spark, sf).where("value > 450").select(zfill("user_id", 5).alias("fips_code"))
    out = jobs.historical_weather_job(raw, path=scratch_path(spark, "history"), done=done)
    return rounded(out.select("fips_code", "date", "tmax_c", "prcp_mm", "awnd_ms", "wt_rain"), 6)


@query("snk2_append_resumable", _daily_archive("true"))
def _(spark, sf):
    raw = weather_json(spark, sf)
    path = scratch_path(spark, "history")
    early = events(spark, sf).where("value > 450").select(zfill("user_id", 5).alias("fips_code")).distinct()
    first = jobs.historical_weather_job(raw.join(early, "fips_code", "left_semi"))
    W.append_resumable(first, path)
    everything = jobs.historical_weather_job(raw)
    W.append_resumable(everything, path)
    return rounded(spark.read.parquet(path).select("fips_code", "date", "tmax_c", "prcp_mm", "awnd_ms", "wt_rain"), 6)


@query("src16_ingest_live_polls_json", "SELECT event_id, 'PLACE ' || CAST(user_id AS VARCHAR) AS title, CASE WHEN event_id % 3 = 0 THEN 0.0::DOUBLE ELSE value END AS cust_a, "
       "CAST(event_id AS DOUBLE) AS cust_s, 2.0::DOUBLE AS n_out FROM events UNION ALL SELECT event_id, '', 0.0, NULL, NULL FROM events WHERE event_id % 2 = 0")
def _(spark, sf):
    e = events(spark, sf)
    cust = F.when(F.col("event_id") % 3 == 0, F.lit('"<5"')).otherwise(F.concat(F.lit('{"val": '), F.col("value").cast("string"), F.lit("}")))
    rec = F.concat(F.lit('{"title": "PLACE '), F.col("user_id").cast("string"), F.lit('", "desc": {"cust_a": '), cust,
                   F.lit(', "cust_s": '), F.col("event_id").cast("string"), F.lit(', "n_out": 2}}'))
    body = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"file_data": ['), rec, F.lit(', {"desc": {}}]}'))).otherwise(
        F.concat(F.lit("["), rec, F.lit("]")))
    return S.parse_poll_json(e.select("event_id", body.alias("body")), keep=["event_id"])


@query("src17_load_regions", "SELECT '51' || lpad(CAST(s_suppkey AS VARCHAR), 3, '0') AS \"GEOID\", s_name AS \"NAME\", '51' AS \"STATEFP\" FROM supplier")
def _(spark, sf):
    feature = '{"type": "Feature", "properties": {"GEOID": "%s%03d", "NAME": "%s", "STATEFP": "%s"}}'
    body = F.format_string('{"type": "FeatureCollection", "features": [' + feature + ", " + feature + "]}",
                           F.lit("51"), "s_suppkey", "s_name", F.lit("51"), F.lit("37"), "s_suppkey", "s_name", F.lit("37"))
    return S.parse_regions(table(spark, sf, "supplier").select(body.alias("body")))


@query("src18_parse_header_array_json", "SELECT c_name AS name, '51' AS state, lpad(CAST(c_nationkey AS VARCHAR), 3, '0') AS county FROM customer")
def _(spark, sf):
    body = F.format_string('[["NAME", "state", "county"], ["%s", "51", "%03d"]]', "c_name", "c_nationkey")
    return S.parse_header_array_json(table(spark, sf, "customer").select(body.alias("body")))


# -- sinks --------------------------------------------------------------------------------------

@query("snk1_write_table", f"WITH {DAILY} SELECT fips_code, date, prcp_mm, wt_snow, CAST(month(date) AS INT) AS month FROM daily")
def _(spark, sf):
    d = daily_panel(spark, sf).select("fips_code", "date", "prcp_mm", "wt_snow", F.month("date").alias("month"))
    return spark.read.parquet(W.write_table(d, scratch_path(spark, "table"), partition_by=["month"]))


@query("snk1_write_csv", f"WITH {DAILY} SELECT fips_code, date, prcp_mm, wt_snow FROM daily")
def _(spark, sf):
    d = daily_panel(spark, sf).select("fips_code", "date", "prcp_mm", "wt_snow")
    return S.load_daily_weather(spark, W.write_table(d, scratch_path(spark, "table"), fmt="csv"))


@query("snk4_publish_predictions", f"WITH {DAILY} SELECT fips_code, date, prcp_mm * 2 AS prcp_mm FROM daily")
def _(spark, sf):
    d, path = daily_panel(spark, sf).select("fips_code", "date", "prcp_mm"), scratch_path(spark, "published")
    W.publish_predictions(d, path, "2024-01-01 00:00:00")
    W.publish_predictions(d, path, "2024-01-01 00:15:00")
    W.publish_predictions(d.withColumn("prcp_mm", F.col("prcp_mm") * 2), path, "2024-01-01 00:15:00")
    return W.read_latest(spark, path).drop("run_ts")


@query("snk5_write_hourly_features", f"WITH {_HOURS} SELECT fips_code, count(*) AS hours, round(sum(coalesce(v, 0)), 4) AS prcp_mm FROM hours GROUP BY 1")
def _(spark, sf):
    path = W.write_hourly_features(jobs.hourly_features_job(weather_json(spark, sf)), scratch_path(spark, "hourly"))
    back = S.read_delimited(spark, path)
    return rounded(back.groupBy("fips_code").agg(F.count(F.lit(1)).alias("hours"), F.sum(F.col("prcp_mm").cast("double")).alias("prcp_mm")), 4)
