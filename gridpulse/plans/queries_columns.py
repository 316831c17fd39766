"""Scalar helpers, encodings and bands on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridpulse.functions import columns as C
from gridpulse.functions import weather as W
from gridpulse.plans.bindings import DAILY, SESS, SNAP, daily_panel, events, sessions, snapshots
from gridpulse.plans.catalog import query, table


@query("fn1_zfill", "SELECT c_custkey, lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS short_code, "
       "CASE WHEN length(CAST(c_custkey * 100 AS VARCHAR)) >= 5 THEN CAST(c_custkey * 100 AS VARCHAR) "
       "ELSE lpad(CAST(c_custkey * 100 AS VARCHAR), 5, '0') END AS long_code FROM customer")
def _(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", C.zfill("c_nationkey", 2).alias("short_code"),
        C.zfill(F.col("c_custkey") * 100, 5).alias("long_code"))


@query("fn2_text_cleaning", "SELECT doc_id, md5(trim(replace(lower(text), ', virginia', ''))) AS cleaned, "
       "upper(source) AS loud, ends_with(text, '.') AS full_stop FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(C.clean_text("text", ", virginia").cast("binary")).alias("cleaned"),
        F.upper("source").alias("loud"), F.endswith("text", F.lit(".")).alias("full_stop"))


@query("fn3_fixed_width", "SELECT c_custkey, trim(substring(c_name, 1, 8)) AS head, "
       "trim(substring(c_name, 10, 9)) AS number FROM customer")
def _(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", C.fixed_width("c_name", 0, 8).alias("head"), C.fixed_width("c_name", 9, 18).alias("number"))


@query("fn4_number_in_name", "SELECT p_partkey, TRY_CAST(regexp_extract(p_brand, '#(\\d+)', 1) AS INT) AS brand_no, "
       "TRY_CAST(regexp_extract(p_name, 'x(\\d+)x', 1) AS INT) AS no_match FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", C.number_in_name("p_brand", r"#(\d+)").alias("brand_no"),
        C.number_in_name("p_name", r"x(\d+)x").alias("no_match"))


@query("fn5_to_number", "SELECT event_id, TRY_CAST(CASE WHEN event_id % 5 = 0 THEN event_type ELSE CAST(value AS VARCHAR) END "
       "AS DOUBLE) AS number, CAST(trunc(coalesce(TRY_CAST(CASE WHEN event_id % 5 = 0 THEN event_type ELSE "
       "CAST(value AS VARCHAR) END AS DOUBLE), 0)) AS BIGINT) AS whole FROM events")
def _(spark, sf):
    text = F.when(F.col("event_id") % 5 == 0, F.col("event_type")).otherwise(F.col("value").cast("string"))
    return table(spark, sf, "events").select(
        "event_id", C.to_number(text).alias("number"), C.to_count(text).alias("whole"))


@query("fn6_parse_time", "SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE date_trunc('second', ts) END AS parsed, "
       "CAST(ts AS DATE) AS compact FROM events")
def _(spark, sf):
    ts, kind = F.col("ts"), F.col("event_id") % 4
    text = (F.when(kind == 0, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
            .when(kind == 1, F.date_format(ts, "dd-MMM-yy HH:mm:ss"))
            .when(kind == 2, F.date_format(ts, "MM/dd/yyyy HH:mm:ss")).otherwise("never"))
    return table(spark, sf, "events").select(
        "event_id", C.parse_timestamp(text, ["dd-MMM-yy HH:mm:ss", "MM/dd/yyyy HH:mm:ss"]).alias("parsed"),
        C.parse_date(F.date_format(ts, "yyyyMMdd"), "yyyyMMdd").alias("compact"))


@query("fn7_truncate_to_date", "SELECT event_id, CAST(ts AS DATE) AS date FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", C.to_day("ts").alias("date"))


@query("fn8_minutes_between", "SELECT event_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 60000000.0 "
       "AS minutes FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", C.minutes_between(
        F.lit("2024-01-01").cast("timestamp_ntz"), "ts").alias("minutes"))


@query("fn9_date_range", "SELECT o_orderkey, o_orderkey % 5 - 1 AS extra_days, greatest(o_orderkey % 5, 0) AS n_days, "
       "CASE WHEN o_orderkey % 5 >= 1 THEN CAST(o_orderdate + to_days(CAST(o_orderkey % 5 - 1 AS INT)) AS DATE) END AS last_day FROM orders")
def _(spark, sf):
    o = table(spark, sf, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    extra = F.col("o_orderkey") % 5 - 1
    end = F.col("o_orderdate") + F.make_dt_interval(extra.cast("int"))
    steps = C.daily_steps("o_orderdate", end)
    return o.select("o_orderkey", extra.alias("extra_days"), F.size(steps).cast("long").alias("n_days"),
                    F.to_date(F.array_max(steps)).alias("last_day"))


@query("fn10_clip", "SELECT event_id, greatest(value, 50) AS low, least(value, 100) AS high, "
       "least(greatest(value, 50), 100) AS both FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", C.clip("value", 50.0).alias("low"), C.clip("value", high=100.0).alias("high"),
        C.clip("value", 50.0, 100.0).alias("both"))


_HAV = ("2 * 6371.0 * asin(sqrt(pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) "
        "* pow(sin(radians({d} - {c}) / 2), 2)))")


@query("fn11_haversine", "SELECT vec_id, round(" + _HAV.format(
    a="90.0 * CAST(embedding[1] AS DOUBLE)", b="37.5", c="180.0 * CAST(embedding[2] AS DOUBLE)", d="-78.5") + ", 6) AS km FROM embeddings")
def _(spark, sf):
    e = F.col("embedding")
    return table(spark, sf, "embeddings").select("vec_id", F.round(C.haversine_km(
        F.lit(90.0) * e[0].cast("double"), F.lit(180.0) * e[1].cast("double"), F.lit(37.5), F.lit(-78.5)), 6).alias("km"))


@query("fn12_math", "SELECT event_id, round(ln(1 + value), 8) AS log1p, round(exp(least(value, 20)) - 1, 2) AS expm1, "
       "round(sqrt(abs(value - 100)), 8) AS root, round(1 / (1 + exp(-(value - 100) / 50)), 8) AS sig FROM events")
def _(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select(
        "event_id", F.round(C.log_target("value"), 8).alias("log1p"), F.round(C.exp_prediction("value"), 2).alias("expm1"),
        F.round(F.sqrt(F.abs(v - 100)), 8).alias("root"), F.round(C.sigmoid((v - 100) / 50), 8).alias("sig"))


@query("fn13_first_known", f"WITH {SNAP} SELECT event_id, coalesce(magnitude, prcp_mm, 0.0) AS v FROM snap")
def _(spark, sf):
    return snapshots(spark, sf).select("event_id", C.first_known("magnitude", "prcp_mm", 0.0).alias("v"))


@query("fn14_code_sets", "SELECT user_id, CAST(max(CAST(k IN (95, 96, 99) AS INT)) AS INT) AS thunder, "
       "max(CAST(k >= 95 AS INT)) AS severe FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k "
       "FROM events) GROUP BY user_id")
def _(spark, sf):
    codes = events(spark, sf).groupBy("user_id").agg(
        F.collect_set("code").alias("codes"), F.max(C.in_codes("code", (95, 96, 99))).alias("thunder"))
    return codes.select("user_id", "thunder", C.any_at_least("codes", 95).cast("int").alias("severe"))


@query("fn15_array_measures", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total, "
       "round(CAST(list_max(embedding) AS DOUBLE), 6) AS top, "
       "round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) / len(embedding), 6) AS mean FROM embeddings")
def _(spark, sf):
    v = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf, "embeddings").select(
        "vec_id", F.round(C.array_total(v), 6).alias("total"), F.round(F.array_max(v), 6).alias("top"),
        F.round(C.array_mean(v), 6).alias("mean"))


@query("fn16_json_default", "SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k, -1.0::DOUBLE AS other FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", C.json_number("props", "$.k").alias("k"), C.json_number("props", "$.other.val", -1.0).alias("other"))


@query("fn17_map_lookup", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' END AS status FROM orders")
def _(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", C.lookup("o_orderstatus", {"F": "filled", "O": "open"}).alias("status"))


# -- projections --------------------------------------------------------------------------------

_K = "(SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events)"
_FLAG_SQL = ", ".join(f"CAST(k IN {codes if len(codes) > 1 else f'({codes[0]})'} AS INT) AS {name}"
                      for name, codes in (("wt_fog", (45, 48)), ("wt_thunder", (95, 96, 99)),
                                          ("wt_snow", (71, 73, 75, 77, 85, 86)), ("wt_freezing_rain", (66, 67)),
                                          ("wt_ice", (66, 67)), ("wt_blowing_snow", (77,)),
                                          ("wt_drizzle", (51, 53, 55)), ("wt_rain", (61, 63, 65, 80, 81, 82))))


@query("prj10_weather_code_flags", f"SELECT event_id, {_FLAG_SQL} FROM {_K}")
def _(spark, sf):
    return events(spark, sf).select("event_id", *W.code_flags("code"))


FLAG_RULES_SQL = {
    "Thunderstorm Wind": "wt_thunder = 1 AND wsfg_ms > 13", "Lightning": "wt_thunder = 1",
    "Hail": "wt_thunder = 1 AND wsfg_ms > 18", "High Wind": "wsfg_ms > 25",
    "Strong Wind": "awnd_ms > 13 AND wsfg_ms <= 25", "Dense Fog": "false", "Heavy Rain": "prcp_mm > 25",
    "Flash Flood": "prcp_mm > 50", "Flood": "prcp_mm > 30", "Heavy Snow": "wt_snow = 1 AND snow_mm > 100",
    "Blizzard": "wt_blowing_snow = 1 AND awnd_ms > 15", "Winter Storm": "snow_mm > 50 AND tmin_c < 0",
    "Winter Weather": "wt_snow = 1 AND snow_mm <= 100", "Ice Storm": "wt_ice = 1",
    "Frost/Freeze": "tmin_c < 0 AND prcp_mm = 0", "Cold/Wind Chill": "tmin_c < -10",
    "Excessive Heat": "tmax_c > 38", "Extreme Cold/Wind Chill": "tmin_c < -20", "Heat": "tmax_c > 32",
    "Tropical Storm": "wsfg_ms > 33 AND prcp_mm > 25",
}
_FLAG_COLS = ", ".join(f'CAST({rule} AS INT) AS "event_{name}"' for name, rule in FLAG_RULES_SQL.items())
_NEVER = ", ".join(f'0 AS "event_{n}"' for n in (
    "Avalanche", "Coastal Flood", "Debris Flow", "Drought", "Funnel Cloud", "Rip Current", "Tornado", "Wildfire"))
_NONE = "CAST(NOT (" + " OR ".join(f"({r})" for r in FLAG_RULES_SQL.values()) + ') AS INT) AS "event_None"'


@query("prj11_event_flags", f"WITH {DAILY} SELECT fips_code, date, {_FLAG_COLS}, {_NEVER}, {_NONE} FROM daily")
def _(spark, sf):
    d = daily_panel(spark, sf)
    return W.add_event_flags(d).select("fips_code", "date", *[F.col(f"`{c}`") for c in W.event_flags(d)])


@query("prj12_unit_convert", f"SELECT event_id, round(coalesce(v, 0) / 3.6, 3) AS ms, round(coalesce(v, 0) * 10, 3) AS mm_from_cm, "
       f"round(coalesce(v, 0) * 1000, 3) AS mm_from_m FROM (SELECT event_id, CASE WHEN k % 9 <> 0 THEN value END AS v FROM {_K})")
def _(spark, sf):
    v = F.when(F.col("code") % 9 != 0, F.col("value"))
    return events(spark, sf).select(
        "event_id", F.round(W.to_ms(v), 3).alias("ms"), F.round(W.cm_to_mm(v), 3).alias("mm_from_cm"),
        F.round(W.m_to_mm(v), 3).alias("mm_from_m"))


@query("prj13_severe_proxy", f"SELECT user_id, max(CAST(k >= 95 AS INT)) AS has_weather_event, "
       f"round(greatest(max(value), max(k) * 3.0), 3) AS max_magnitude, 1 AS magnitude_missing FROM {_K} GROUP BY user_id")
def _(spark, sf):
    g = events(spark, sf).groupBy("user_id").agg(
        F.collect_set("code").alias("codes"), F.max("value").alias("p"), (F.max("code") * 3.0).alias("w"))
    return g.select("user_id", *W.severe_proxy("codes", "p", "w", filled=True))


@query("prj17_severity_band", f"WITH {SESS} SELECT fips_code, start_time, CASE WHEN NOT has THEN 'None' WHEN n > 5000 THEN 'Severe' "
       "WHEN n > 1000 THEN 'Moderate' ELSE 'Minor' END AS band, CASE WHEN NOT has THEN 'none' WHEN n > 5000 THEN 'red' "
       "WHEN n > 1000 THEN 'orange' ELSE 'yellow' END AS colour FROM (SELECT *, peak_customers_affected * 20 AS n, "
       "snapshot_count > 1 AS has FROM sess)")
def _(spark, sf):
    s = sessions(spark, sf)
    n, has = F.col("peak_customers_affected") * 20, F.col("snapshot_count") > 1
    return s.select("fips_code", "start_time", W.severity_band(n, has).alias("band"),
                    W.severity_colour(n, has).alias("colour"))


@query("prj18_probability_band", "SELECT event_id, CASE WHEN floor(value / 490 * 100 + 0.5) >= 70 THEN 'high' "
       "WHEN floor(value / 490 * 100 + 0.5) >= 40 THEN 'medium' ELSE 'low' END AS band FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", W.probability_band(F.col("value") / 490).alias("band"))


@query("prj23_log_scale", f"WITH {SESS} SELECT fips_code, start_time, round(ln(1 + duration_minutes), 8) AS log_y, "
       "round(exp(greatest(least(ln(1 + duration_minutes) * 3, 20), -20)) - 1, 2) AS back FROM sess")
def _(spark, sf):
    log_y = C.log_target("duration_minutes")
    return sessions(spark, sf).select("fips_code", "start_time", F.round(log_y, 8).alias("log_y"),
                                      F.round(C.exp_prediction(log_y * 3), 2).alias("back"))


@query("prj26_display_name", "SELECT s_suppkey, s_name || CASE WHEN s_suppkey * 37 % 1000 >= 500 THEN ' City' ELSE ' County' END AS shown FROM supplier")
def _(spark, sf):
    s = table(spark, sf, "supplier")
    code = F.concat(F.lit("51"), C.zfill(F.col("s_suppkey") * 37 % 1000, 3))
    return s.select("s_suppkey", W.display_name("s_name", code).alias("shown"))


@query("flt9_physical_bounds", f"WITH {DAILY} SELECT fips_code, date FROM daily WHERE prcp_mm > 500 OR tmax_c > 60 OR tmin_c < -40 "
       "OR awnd_ms > 25 OR wsfg_ms > 80 OR awnd_ms < 0 OR wsfg_ms < 0")
def _(spark, sf):
    return daily_panel(spark, sf).where(W.outside_physical_bounds()).select("fips_code", "date")
