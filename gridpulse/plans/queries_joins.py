"""Relational joins on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridpulse.functions.columns import zfill
from gridpulse.operators import joins as J
from gridpulse.operators import live as L
from gridpulse.operators import rollups as R
from gridpulse.plans.bindings import (DAILY, LABELS, daily_panel, error_snapshots, events, rounded)
from gridpulse.plans.catalog import query, table

# -- intervals ----------------------------------------------------------------------------------


def ship_snapshots(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_suppkey") % 100).cast("string").alias("fips_code"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("run_start_time"))


def order_intervals(spark, sf):
    k = F.col("o_orderkey")
    begin = F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (k % 24).cast("int"))
    end = begin + F.make_dt_interval((k % 12).cast("int"), (k % 7).cast("int"))
    return table(spark, sf, "orders").select(
        "o_orderkey", (F.col("o_custkey") % 100).cast("string").alias("fips_code"), begin.alias("begin_date"),
        F.when(k % 13 == 0, F.lit(None).cast("timestamp_ntz"))
        .when(k % 17 == 0, begin - F.make_dt_interval(F.lit(1))).otherwise(end).alias("end_date"),
        F.col("o_orderpriority").alias("event_type"), (k % 3).cast("double").alias("magnitude"))


IVS = """ivs AS (
  SELECT o_orderkey, fips_code, b AS begin_date, CASE WHEN o_orderkey % 13 = 0 THEN NULL
      WHEN o_orderkey % 17 = 0 THEN b - INTERVAL 1 DAY
      ELSE b + to_days(CAST(o_orderkey % 12 AS INT)) + to_hours(CAST(o_orderkey % 7 AS INT)) END AS end_date,
    event_type, magnitude
  FROM (SELECT o_orderkey, CAST(o_custkey % 100 AS VARCHAR) AS fips_code,
    o_orderdate + to_hours(CAST(o_orderkey % 24 AS INT)) AS b,
    o_orderpriority AS event_type, CAST(o_orderkey % 3 AS DOUBLE) AS magnitude FROM orders)),
steps AS (
  SELECT fips_code, event_type, magnitude, CAST(begin_date + to_days(CAST(s.i AS INT)) AS DATE) AS date
  FROM ivs JOIN (SELECT unnest(range(0, 8)) AS i) s
    ON begin_date + to_days(CAST(s.i AS INT)) <= least(coalesce(end_date, begin_date), begin_date + INTERVAL 7 DAY)
  GROUP BY ALL),
ships AS (SELECT l_orderkey, l_linenumber, CAST(l_suppkey % 100 AS VARCHAR) AS fips_code,
  l_shipdate AS run_start_time FROM lineitem),
matched AS (SELECT ships.*, steps.event_type, steps.magnitude FROM ships LEFT JOIN steps
  ON ships.fips_code = steps.fips_code AND CAST(ships.run_start_time AS DATE) = steps.date)"""


@query("jn1_interval_join", f"WITH {IVS} SELECT l_orderkey, l_linenumber, fips_code, run_start_time, event_type, magnitude FROM matched")
def _(spark, sf):
    return J.interval_join(ship_snapshots(spark, sf), order_intervals(spark, sf))


@query("jn1_interval_join_calendar_days", f"""WITH {IVS}, touched AS (
  SELECT DISTINCT fips_code, event_type, magnitude, CAST(begin_date AS DATE) + CAST(s.i AS INT) AS date
  FROM ivs JOIN (SELECT unnest(range(0, 9)) AS i) s ON CAST(begin_date AS DATE) + CAST(s.i AS INT)
    <= CAST(least(coalesce(end_date, begin_date), begin_date + INTERVAL 7 DAY) AS DATE)
  WHERE coalesce(end_date, begin_date) >= CAST(begin_date AS DATE))
SELECT l_orderkey, l_linenumber, touched.event_type, touched.magnitude FROM ships LEFT JOIN touched
  ON ships.fips_code = touched.fips_code AND CAST(ships.run_start_time AS DATE) = touched.date""")
def _(spark, sf):
    return J.interval_join(ship_snapshots(spark, sf), order_intervals(spark, sf), calendar_days=True).select(
        "l_orderkey", "l_linenumber", "event_type", "magnitude")


@query("set3_distinct_days", f"WITH {IVS} SELECT fips_code, date, event_type, magnitude FROM steps")
def _(spark, sf):
    return J.expand_intervals(order_intervals(spark, sf))


@query("agg14_match_rate", f"WITH {IVS} SELECT count(*) AS total, count(event_type) AS matched, "
       "round(count(event_type) / count(*) * 100, 6) AS matched_percent FROM matched")
def _(spark, sf):
    return rounded(R.match_rate(J.interval_join(ship_snapshots(spark, sf), order_intervals(spark, sf)), "event_type"), 6)


# -- zones --------------------------------------------------------------------------------------


def zone_map(spark, sf):
    return table(spark, sf, "nation").select(
        zfill("n_regionkey", 3).alias("zone"), zfill("n_nationkey", 5).alias("fips_code"))


def zone_events(spark, sf):
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        "s_suppkey", F.when(k % 7 == 0, F.lit(None).cast("string")).when(k % 3 == 0, "z").otherwise("C").alias("cz_type"),
        zfill(F.when(k % 11 == 0, 9).otherwise(F.col("s_nationkey") % 5), 3).alias("cz_fips"),
        zfill("s_nationkey", 5).alias("fips_code"))


ZONES = """zm AS (SELECT lpad(CAST(n_regionkey AS VARCHAR), 3, '0') AS zone,
    lpad(CAST(n_nationkey AS VARCHAR), 5, '0') AS code FROM nation),
ze AS (SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN NULL WHEN s_suppkey % 3 = 0 THEN 'z' ELSE 'C' END AS cz_type,
    lpad(CAST(CASE WHEN s_suppkey % 11 = 0 THEN 9 ELSE s_nationkey % 5 END AS VARCHAR), 3, '0') AS cz_fips,
    lpad(CAST(s_nationkey AS VARCHAR), 5, '0') AS fips_code FROM supplier)"""


for _name in ("jn2_expand_zones", "set2_union_county_and_zone"):
    @query(_name, f"WITH {ZONES} SELECT * FROM ze WHERE cz_type IS NULL OR upper(cz_type) <> 'Z' UNION ALL "
           "SELECT s_suppkey, cz_type, cz_fips, code FROM ze JOIN zm ON zone = cz_fips WHERE upper(cz_type) = 'Z'")
    def _(spark, sf):
        return J.expand_zones(zone_events(spark, sf), zone_map(spark, sf))


@query("agg22_zone_lists", f"WITH {ZONES} SELECT zone, string_agg(code, ' ' ORDER BY code) AS codes FROM zm GROUP BY zone")
def _(spark, sf):
    return J.zone_lists(zone_map(spark, sf)).select("zone", F.concat_ws(" ", "fips_codes").alias("codes"))


# -- daily panels -------------------------------------------------------------------------------


def user_snapshots(spark, sf):
    return events(spark, sf).select(
        "event_id", zfill("user_id", 5).alias("fips_code"), F.col("ts").alias("run_start_time"), "value")


USNAP = """usnap AS (SELECT event_id, lpad(CAST(user_id AS VARCHAR), 5, '0') AS fips_code,
  ts AS run_start_time, value FROM events)"""


@query("jn3_join_daily_weather", f"WITH {DAILY}, {USNAP}, part AS (SELECT * REPLACE (date + 1 AS date) FROM daily) "
       "SELECT event_id, prcp_mm, tmax_c, wt_thunder FROM usnap LEFT JOIN part ON usnap.fips_code = part.fips_code "
       "AND CAST(run_start_time AS DATE) = part.date")
def _(spark, sf):
    # The weather of the day before: a day after one without readings finds none.
    daily = daily_panel(spark, sf).withColumn("date", F.date_add("date", 1))
    return J.join_daily(user_snapshots(spark, sf), daily).select("event_id", "prcp_mm", "tmax_c", "wt_thunder")


@query("jn4_label_panel", f"WITH {DAILY}, {LABELS} SELECT daily.fips_code, daily.date, prcp_mm, "
       "coalesce(outage_occurred, 0) AS outage_occurred, CAST(trunc(coalesce(max_customers_affected, 0)) AS BIGINT) AS max_customers_affected "
       "FROM daily LEFT JOIN lab ON daily.fips_code = lab.fips_code AND daily.date = lab.date")
def _(spark, sf):
    labels = R.occurrence_labels(error_snapshots(spark, sf), min_customers=50)
    return J.label_panel(daily_panel(spark, sf), labels).select(
        "fips_code", "date", "prcp_mm", "outage_occurred", "max_customers_affected")


SIGN = """sig AS (SELECT ts AS event_start, ts + to_microseconds(CAST(round(value * 60000000) AS BIGINT)) AS event_end
  FROM events WHERE event_type = 'signup')"""


@query("jn6_interval_flag", f"WITH {SIGN} SELECT event_id, CAST(EXISTS (SELECT 1 FROM sig WHERE ts >= event_start AND ts <= event_end) AS INT) "
       "AS storm_event, CAST(value > 100 AS INT) AS outage_occurred FROM events WHERE event_type <> 'signup'")
def _(spark, sf):
    e = table(spark, sf, "events")
    length = F.round(F.col("value") * 60_000_000).cast("long")
    spans = e.where("event_type = 'signup'").select(
        F.col("ts").alias("event_start"),
        F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + length).alias("event_end"))
    rows = e.where("event_type <> 'signup'").select(
        "event_id", F.col("ts").alias("run_start_time"), (F.col("value") - 100).alias("customers_out"))
    return J.interval_flag(rows, spans).select("event_id", "storm_event", "outage_occurred")


@query("jn7_join_on_date", f"WITH dd AS (SELECT CAST(ts AS DATE) AS date, event_type AS station, max(value) AS prcp_mm FROM events GROUP BY 1, 2), {USNAP} "
       "SELECT event_id, station, prcp_mm FROM usnap LEFT JOIN dd ON CAST(run_start_time AS DATE) = date")
def _(spark, sf):
    # One station per event type, so a day has up to five rows.
    daily = events(spark, sf).groupBy(F.to_date("ts").alias("date"), F.col("event_type").alias("station")).agg(
        F.max("value").alias("prcp_mm"))
    return J.join_on_date(user_snapshots(spark, sf), daily).select("event_id", "station", "prcp_mm")


# -- nearest ------------------------------------------------------------------------------------


def points(spark, sf):
    e = F.col("embedding")
    return table(spark, sf, "embeddings").select(
        "vec_id", "label", (F.lit(90.0) * e[0].cast("double")).alias("lat"), (F.lit(180.0) * e[1].cast("double")).alias("lon"))


def centroids(spark, sf):
    return points(spark, sf).groupBy("label").agg(
        F.round(F.avg("lat"), 6).alias("latitude"), F.round(F.avg("lon"), 6).alias("longitude"))


def hav(a, b, c, d):
    return (f"12742.0 * asin(sqrt(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) "
            f"* pow(sin(radians({d} - {b}) / 2), 2)))")


PTS = """pts AS (SELECT vec_id, label, 90.0 * CAST(embedding[1] AS DOUBLE) AS lat, 180.0 * CAST(embedding[2] AS DOUBLE) AS lon
  FROM embeddings),
cen AS (SELECT label, round(avg(lat), 6) AS latitude, round(avg(lon), 6) AS longitude FROM pts GROUP BY label)"""
NEAR = f"""{PTS}, pairs AS (SELECT vec_id, cen.label AS c, {hav('lat', 'lon', 'latitude', 'longitude')} AS d FROM pts, cen),
near AS (SELECT vec_id, arg_min(c, d) AS nearest_label, min(d) AS dist FROM pairs GROUP BY vec_id)"""


@query("jn8_nearest_centroid", f"WITH {NEAR} SELECT vec_id, nearest_label, round(dist, 5) AS dist_km FROM near")
def _(spark, sf):
    near = J.nearest(points(spark, sf), centroids(spark, sf), "vec_id", "label", center_lat="latitude", center_lon="longitude")
    return near.select("vec_id", "nearest_label", F.round("dist_km", 5).alias("dist_km"))


@query("win9_nearest_rank", f"WITH {NEAR} SELECT vec_id, nearest_label FROM near")
def _(spark, sf):
    # A small limit takes the way of many centers.
    near = J.nearest(points(spark, sf), centroids(spark, sf), "vec_id", "label", center_lat="latitude",
                     center_lon="longitude", few=3, shard=2)
    return near.select("vec_id", "nearest_label")


@query("agg23_max_station_distance", f"WITH {NEAR} SELECT count(*) AS stations, count(DISTINCT nearest_label) AS counties, "
       "round(max(dist), 1) AS max_dist_km FROM near")
def _(spark, sf):
    stations = points(spark, sf).select(F.col("vec_id").alias("station_id"), F.lit("s").alias("name"), "lat", "lon")
    counties = centroids(spark, sf).withColumnRenamed("label", "fips_code")
    return R.max_station_distance(J.map_stations(stations, counties))


FILL = f"""{PTS}, geo AS (SELECT vec_id AS fips_code, lat AS latitude, lon AS longitude FROM pts),
ok AS (SELECT g.*, round(latitude * 2, 3) AS prcp_mm, CAST(fips_code % 2 AS INT) AS wt_fog FROM geo g JOIN embeddings ON vec_id = fips_code WHERE embedding[3] < 0.1),
cand AS (SELECT f.fips_code, o.fips_code AS src, {hav('f.latitude', 'f.longitude', 'o.latitude', 'o.longitude')} AS d
  FROM geo f JOIN ok o ON f.fips_code NOT IN (SELECT fips_code FROM ok)),
best AS (SELECT fips_code, arg_min(src, d) AS src FROM cand GROUP BY fips_code),
filled AS (SELECT fips_code, prcp_mm, wt_fog, 0 AS magnitude_missing FROM ok UNION ALL
  SELECT best.fips_code, prcp_mm, wt_fog, 1 FROM best JOIN ok ON ok.fips_code = best.src)"""


def _geo(spark, sf):
    return points(spark, sf).select(F.col("vec_id").alias("fips_code"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"))


def _ok_rows(spark, sf):
    """Entities whose fetch succeeded: the third embedding entry is below 0.1."""
    succeeded = table(spark, sf, "embeddings").where(F.get("embedding", F.lit(2)) < 0.1).select(F.col("vec_id").alias("fips_code"))
    return _geo(spark, sf).join(succeeded, "fips_code").select(
        "fips_code", F.round(F.col("latitude") * 2, 3).alias("prcp_mm"), (F.col("fips_code") % 2).cast("int").alias("wt_fog"))


for _name in ("jn9_fill_from_nearest", "set4_union_filled"):
    @query(_name, f"WITH {FILL} SELECT * FROM filled")
    def _(spark, sf):
        return J.fill_from_nearest(_ok_rows(spark, sf), _geo(spark, sf), ["prcp_mm", "wt_fog"])


@query("set5_missing_entities", "SELECT vec_id AS fips_code FROM embeddings WHERE embedding[3] >= 0.1")
def _(spark, sf):
    return J.missing_entities(_geo(spark, sf), _ok_rows(spark, sf)).select("fips_code")


# -- stations, done entities --------------------------------------------------------------------


def station_days(spark, sf):
    return events(spark, sf).groupBy(F.col("user_id").alias("station_id"), F.to_date("ts").alias("date")).agg(
        F.round(F.avg("value"), 6).alias("prcp_mm"))


@query("jn13_station_to_entity", "SELECT user_id AS station_id, CAST(ts AS DATE) AS date, round(avg(value), 6) AS prcp_mm, "
       "any_value(CASE WHEN user_id IN (SELECT user_id FROM events WHERE value > 400) THEN user_id % 20 END) AS fips_code FROM events GROUP BY 1, 2")
def _(spark, sf):
    mapping = events(spark, sf).where("value > 400").select(
        F.col("user_id").alias("station_id"), (F.col("user_id") % 20).alias("fips_code")).distinct()
    return R.station_to_entity(station_days(spark, sf), mapping)


@query("jn14_station_membership", "SELECT event_id FROM events WHERE user_id IN (SELECT user_id FROM events WHERE value > 400)")
def _(spark, sf):
    from gridpulse.sources.readers import station_members
    listed = events(spark, sf).where("value > 400").select(F.col("user_id").alias("station_id"))
    return station_members(events(spark, sf).withColumnRenamed("user_id", "station_id"), listed).select("event_id")


@query("jn15_skip_done", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def _(spark, sf):
    done = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return J.skip_done(table(spark, sf, "customer"), done, "c_custkey").select("c_custkey")


# -- names --------------------------------------------------------------------------------------


def geo_names(spark, sf):
    """Nation and region names; a suffix by key parity makes some aliases collide."""
    n = table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("ord"), zfill("n_nationkey", 5).alias("fips"),
        F.concat(F.lit("Place "), (F.col("n_nationkey") % 9).cast("string"),
                 F.when(F.col("n_nationkey") % 2 == 0, " City").when(F.col("n_nationkey") % 3 == 0, " County").otherwise(""),
                 F.lit(", Virginia ")).alias("county_name"))
    r = table(spark, sf, "region").select(
        (F.col("r_regionkey") + 100).alias("ord"), zfill(F.col("r_regionkey") + 100, 5).alias("fips"),
        F.concat("r_name", F.lit(" County")).alias("county_name"))
    return n.unionByName(r)


ALIAS = """geo AS (
  SELECT n_nationkey AS ord, lpad(CAST(n_nationkey AS VARCHAR), 5, '0') AS fips, 'Place ' || CAST(n_nationkey % 9 AS VARCHAR)
    || CASE WHEN n_nationkey % 2 = 0 THEN ' City' WHEN n_nationkey % 3 = 0 THEN ' County' ELSE '' END || ', Virginia ' AS county_name
  FROM nation UNION ALL
  SELECT r_regionkey + 100, lpad(CAST(r_regionkey + 100 AS VARCHAR), 5, '0'), r_name || ' County' FROM region),
raws AS (SELECT *, trim(replace(lower(county_name), ', virginia', '')) AS raw FROM geo),
each_alias AS (SELECT raw AS alias, * FROM raws UNION ALL
  SELECT trim(regexp_replace(raw, ' (county|city)$', '')), * FROM raws WHERE regexp_matches(raw, ' (county|city)$')),
aliases AS (SELECT alias, coalesce(arg_max(fips, ord) FILTER (contains(raw, 'county')), arg_min(fips, ord)) AS fips_code
  FROM each_alias GROUP BY alias)"""


@query("win8_alias_priority", f"WITH {ALIAS} SELECT * FROM aliases")
def _(spark, sf):
    return L.alias_table(geo_names(spark, sf))


def titled_polls(spark, sf):
    """One poll record per event: the title is one of the place names or an unknown one."""
    e = events(spark, sf)
    place = F.concat(F.lit("PLACE "), (F.col("code") % 12).cast("string"))
    return e.select("event_id", (F.col("event_id") % 2).alias("provider"), place.alias("title"),
                    (F.col("value") - 20).alias("cust_a"))


POLLS = """tp AS (SELECT event_id, event_id % 2 AS provider, value - 20 AS cust_a,
  'PLACE ' || CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 12 AS VARCHAR) AS title FROM events),
res AS (SELECT tp.*, fips_code FROM tp LEFT JOIN aliases ON lower(title) = alias)"""


@query("jn11_resolve_name", f"WITH {ALIAS}, {POLLS} SELECT event_id, title, fips_code FROM res")
def _(spark, sf):
    return L.resolve_names(titled_polls(spark, sf), L.alias_table(geo_names(spark, sf))).select("event_id", "title", "fips_code")


@query("jn11_unknown_names", f"WITH {ALIAS}, {POLLS} SELECT title, count(*) AS n FROM res WHERE fips_code IS NULL GROUP BY title")
def _(spark, sf):
    return L.unknown_names(titled_polls(spark, sf), L.alias_table(geo_names(spark, sf)))


@query("flt11_positive_live", f"WITH {ALIAS}, {POLLS} SELECT event_id, fips_code FROM res WHERE cust_a > 0 AND fips_code IS NOT NULL")
def _(spark, sf):
    resolved = L.resolve_names(titled_polls(spark, sf), L.alias_table(geo_names(spark, sf)))
    return L.positive_live(resolved).select("event_id", "fips_code")


@query("win11_duplicate_poll_names", f"WITH {ALIAS}, {POLLS} SELECT provider, title, fips_code, count(*) AS records, round(sum(cust_a), 4) AS total "
       "FROM res WHERE cust_a > 0 AND fips_code IS NOT NULL GROUP BY ALL HAVING count(*) > 1")
def _(spark, sf):
    resolved = L.resolve_names(titled_polls(spark, sf), L.alias_table(geo_names(spark, sf)))
    return rounded(L.duplicate_poll_names(resolved), 4)
