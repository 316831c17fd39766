"""Sessions, per-entity windows, entity history, event features."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridpulse.operators import features as X
from gridpulse.operators import sessions as S
from gridpulse.plans.bindings import (EVENT_TYPES, GOOD, LARGE, LONG_MINUTES, SESS, SESSION_OPTIONS, SNAP, SNAPSHOT_MINUTES,
                                      STATS, rounded, sess_sql, sessions, snapshots)
from gridpulse.plans.catalog import query, table
from gridpulse.session import cut_lineage

KEY = ["fips_code", "start_time"]


def good_sessions(spark, sf):
    return S.valid_durations(sessions(spark, sf))


@query("ops1_sessionize", f"WITH {SESS} SELECT fips_code, start_time, end_time, duration_minutes, peak_customers_affected, "
       "initial_customers_affected, round(delta_customers_affected_15m, 6) AS delta, round(pct_growth_15m, 6) AS pct, "
       "CAST(snapshot_count AS BIGINT) AS snapshot_count, county, state FROM sess")
def _(spark, sf):
    return sessions(spark, sf).select(
        "fips_code", "start_time", "end_time", "duration_minutes", "peak_customers_affected",
        "initial_customers_affected", F.round("delta_customers_affected_15m", 6).alias("delta"),
        F.round("pct_growth_15m", 6).alias("pct"), "snapshot_count", "county", "state")


# Three entities own all shipments: buckets are cut by row count instead of by width.
_SHIP = """snap AS (SELECT l_orderkey * 10 + l_linenumber AS event_id, CAST(l_suppkey % 3 AS VARCHAR) AS fips_code,
  l_shipdate AS run_start_time, CASE WHEN l_quantity > 3 THEN l_quantity ELSE 0 END AS customers_affected,
  'c' AS county, 's' AS state, nullif(l_returnflag, 'N') AS event_type, l_tax AS magnitude,
  l_discount AS prcp_mm, l_tax AS tmax_c, CAST(l_linenumber = 1 AS INT) AS wt_fog, l_partkey, l_extendedprice FROM lineitem)"""


@query("ops1_sessionize_few_entities", f"WITH {_SHIP}, {sess_sql(order='event_id, l_partkey, l_extendedprice')} SELECT fips_code, start_time, "
       "end_time, duration_minutes, peak_customers_affected, initial_customers_affected, "
       "delta_customers_affected_15m AS delta, CAST(snapshot_count AS BIGINT) AS snapshot_count, event_type, prcp_mm, wt_fog FROM sess")
def _(spark, sf):
    li = table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("event_id"),
        (F.col("l_suppkey") % 3).cast("string").alias("fips_code"), F.col("l_shipdate").alias("run_start_time"),
        F.when(F.col("l_quantity") > 3, F.col("l_quantity")).otherwise(0.0).alias("customers_affected"),
        F.expr("nullif(l_returnflag, 'N')").alias("event_type"), F.col("l_tax").alias("magnitude"),
        F.col("l_discount").alias("prcp_mm"), (F.col("l_linenumber") == 1).cast("int").alias("wt_fog"), "l_partkey", "l_extendedprice")
    out = S.sessionize(li, snapshot_minutes=SNAPSHOT_MINUTES, 
                        tiebreak=["event_id", "l_partkey", "l_extendedprice"], bucket_rows=2000)
    return out.select("fips_code", F.col("start_time").cast("timestamp_ntz").alias("start_time"),
                      F.col("end_time").cast("timestamp_ntz").alias("end_time"), "duration_minutes",
                      "peak_customers_affected", "initial_customers_affected",
                      F.col("delta_customers_affected_15m").alias("delta"), "snapshot_count", "event_type", "prcp_mm", "wt_fog")


@query("win1_gap_to_previous", f"WITH {SNAP} SELECT event_id, (epoch_us(run_start_time) - epoch_us(lag(run_start_time) OVER "
       "(PARTITION BY fips_code ORDER BY run_start_time, event_id))) / 60000000.0 AS gap_minutes FROM snap")
def _(spark, sf):
    return S.gap_to_previous(snapshots(spark, sf), tiebreak=["event_id"]).select("event_id", "gap_minutes")


_BLOCKS = sess_sql().split(",\nranked AS")[0]


@query("win2_island_id", f"WITH {SNAP}, {_BLOCKS} SELECT event_id, is_on AS is_outage, block FROM blocks")
def _(spark, sf):
    return S.island_ids(snapshots(spark, sf), snapshot_minutes=SNAPSHOT_MINUTES, tiebreak=["event_id"], bucket_rows=50).select("event_id", "is_outage", "block")


@query("win3_first_and_second", f"WITH {SESS} SELECT fips_code, start_time, initial_customers_affected, "
       "round(initial_customers_affected + delta_customers_affected_15m, 6) AS second_customers_affected FROM sess")
def _(spark, sf):
    return sessions(spark, sf).select(*KEY, "initial_customers_affected", F.round(
        F.col("initial_customers_affected") + F.col("delta_customers_affected_15m"), 6).alias("second_customers_affected"))


@query("win4_first_known", f"WITH {SESS} SELECT fips_code, start_time, event_type, prcp_mm, tmax_c, wt_fog FROM sess")
def _(spark, sf):
    return sessions(spark, sf).select(*KEY, "event_type", "prcp_mm", "tmax_c", "wt_fog")


@query("agg2_event_aggregate", f"WITH {SESS} SELECT fips_code, start_time, end_time, peak_customers_affected, event_type, "
       "max_magnitude, county FROM sess")
def _(spark, sf):
    return sessions(spark, sf).select(*KEY, "end_time", "peak_customers_affected", "event_type", "max_magnitude", "county")


@query("agg3_weather_event_count", f"WITH {SESS} SELECT fips_code, start_time, weather_event_count, has_weather_event FROM sess")
def _(spark, sf):
    return sessions(spark, sf).select(*KEY, "weather_event_count", "has_weather_event")


@query("agg4_magnitude_summary", f"WITH {SESS} SELECT fips_code, start_time, max_magnitude, magnitude_missing FROM sess")
def _(spark, sf):
    return sessions(spark, sf).select(*KEY, "max_magnitude", "magnitude_missing")


_HISTORY = f"WITH {SESS}, {GOOD}, {STATS} SELECT fips_code, "


def _r(*names):
    return ", ".join(f"round({n}, 9) AS {n}" for n in names)


DUR_COLS = ("county_median_duration", "county_long_rate")
SCOPE_COLS = ("county_median_scope", "county_large_outage_rate", "county_max_customers")


@query("agg5_duration_history", _HISTORY + _r(*DUR_COLS) + " FROM stats")
def _(spark, sf):
    return rounded(S.duration_history(good_sessions(spark, sf), long_minutes=LONG_MINUTES))


@query("agg6_scope_history", _HISTORY + _r(*SCOPE_COLS) + " FROM stats")
def _(spark, sf):
    return rounded(S.scope_history(good_sessions(spark, sf), large=LARGE))


@query("agg7_entity_stats", _HISTORY + _r(*DUR_COLS, *SCOPE_COLS) + " FROM stats")
def _(spark, sf):
    return rounded(S.entity_stats(good_sessions(spark, sf), long_minutes=LONG_MINUTES, large=LARGE))


@query("pip4_entity_stats_job", _HISTORY + _r(*DUR_COLS, *SCOPE_COLS) + " FROM stats")
def _(spark, sf):
    from gridpulse.plans.jobs import entity_stats_job
    return rounded(entity_stats_job(snapshots(spark, sf), path=None, long_minutes=LONG_MINUTES, large=LARGE, **SESSION_OPTIONS))


@query("flt2_valid_durations", f"WITH {SESS} SELECT fips_code, start_time FROM sess WHERE duration_minutes > 400 AND duration_minutes <= 2000")
def _(spark, sf):
    return S.valid_durations(sessions(spark, sf), 400, 2000).select(*KEY)


@query("flt2_duration_rejects", f"WITH {SESS} SELECT count(*) FILTER (duration_minutes > 0 AND duration_minutes <= 2000) AS kept, "
       "count(*) FILTER (NOT (duration_minutes > 0 AND duration_minutes <= 2000)) AS removed, "
       "count(*) FILTER (duration_minutes <= 0) AS non_positive, count(*) FILTER (duration_minutes > 2000) AS too_long, "
       "count(*) FILTER (duration_minutes IS NULL) AS unknown FROM sess")
def _(spark, sf):
    return S.duration_rejects(sessions(spark, sf), 0, 2000)


@query("flt3_valid_scopes", f"WITH {SESS} SELECT fips_code, start_time FROM sess WHERE peak_customers_affected > 60")
def _(spark, sf):
    return S.valid_scopes(sessions(spark, sf), 60).select(*KEY)


@query("flt4_outage_rows", f"WITH {SNAP} SELECT event_id FROM snap WHERE customers_affected > 0")
def _(spark, sf):
    return S.outage_rows(snapshots(spark, sf)).select("event_id")


@query("prj1_temporal_features", f"WITH {SNAP} SELECT event_id, CAST(year(run_start_time) AS INT) AS year, CAST(month(run_start_time) AS INT) AS month, "
       "CAST(day(run_start_time) AS INT) AS day, CAST(hour(run_start_time) AS INT) AS hour, "
       "CAST(isodow(run_start_time) - 1 AS INT) AS dayofweek FROM snap")
def _(spark, sf):
    return X.temporal_features(snapshots(spark, sf)).select("event_id", "year", "month", "day", "hour", "dayofweek")


@query("prj3_duration_category", f"WITH {SESS} SELECT fips_code, start_time, duration_minutes < {LONG_MINUTES} AS is_short_outage FROM sess")
def _(spark, sf):
    return S.duration_category(sessions(spark, sf), LONG_MINUTES).select(*KEY, "is_short_outage")


@query("prj4_scope_category", f"WITH {SESS} SELECT fips_code, start_time, peak_customers_affected < {LARGE} AS is_small_outage FROM sess")
def _(spark, sf):
    return S.scope_category(sessions(spark, sf), LARGE).select(*KEY, "is_small_outage")


HOT_SQL = ", ".join(f"CAST(coalesce(event_type, 'None') = '{t}' AS INT) AS event_{t}" for t in EVENT_TYPES)


@query("prj5_one_hot", f"WITH {SESS} SELECT fips_code, start_time, {HOT_SQL} FROM sess")
def _(spark, sf):
    return X.one_hot(sessions(spark, sf), "event_type", EVENT_TYPES).select(*KEY, *[f"event_{t}" for t in EVENT_TYPES])


@query("prj14_impact_density", f"WITH {SESS}, {GOOD}, {STATS} SELECT fips_code, start_time, "
       "round(initial_customers_affected / greatest(county_max_customers, 1), 9) AS trained, "
       "round(least(initial_customers_affected * 3 / greatest(county_max_customers, 1), 1.0), 9) AS capped "
       "FROM good JOIN stats USING (fips_code)")
def _(spark, sf):
    good = cut_lineage(good_sessions(spark, sf), "events")
    full = S.add_history(good, S.scope_history(good, large=LARGE))
    trained = X.impact_density(full).withColumnRenamed("initial_impact_density", "trained")
    tripled = trained.withColumn("initial_customers_affected", F.col("initial_customers_affected") * 3)
    return rounded(X.impact_density(tripled, cap=1.0).select(
        *KEY, "trained", F.col("initial_impact_density").alias("capped")))


@query("prj15_growth_features", f"WITH {SNAP} SELECT event_id, round(coalesce(magnitude, customers_affected) - customers_affected, 6) AS delta, "
       "round((coalesce(magnitude, customers_affected) - customers_affected) / greatest(customers_affected, 1), 6) AS pct FROM snap")
def _(spark, sf):
    return X.growth_features(snapshots(spark, sf), "customers_affected", "magnitude").select(
        "event_id", F.round("delta_customers_affected_15m", 6).alias("delta"), F.round("pct_growth_15m", 6).alias("pct"))


@query("jn5_join_entity_stats", f"WITH {SESS}, {GOOD}, {STATS}, part_stats AS (SELECT * REPLACE (lpad(CAST(CAST(fips_code AS INT) + 7 AS VARCHAR), 5, '0') AS fips_code) FROM stats) "
       "SELECT fips_code, start_time, " + ", ".join(f"round(coalesce({c}, 0), 9) AS {c}" for c in (*DUR_COLS, *SCOPE_COLS)) +
       " FROM sess LEFT JOIN part_stats USING (fips_code)")
def _(spark, sf):
    from gridpulse.operators.joins import join_stats
    s = cut_lineage(sessions(spark, sf), "events")
    stats = S.entity_stats(S.valid_durations(s), long_minutes=LONG_MINUTES, large=LARGE)
    # Statistics of the entity seven numbers on, as unpadded text: the first ones find none.
    stats = stats.withColumn("fips_code", (F.col("fips_code").cast("int") + 7).cast("string"))
    return rounded(join_stats(s, stats).select(*KEY, *DUR_COLS, *SCOPE_COLS))


@query("jn16_block_self_joins", f"WITH {SESS} SELECT fips_code, start_time, initial_customers_affected, "
       "round(pct_growth_15m, 6) AS pct_growth_15m, weather_event_count FROM sess")
def _(spark, sf):
    return sessions(spark, sf).select(*KEY, "initial_customers_affected", F.round("pct_growth_15m", 6).alias(
        "pct_growth_15m"), "weather_event_count")


@query("top1_sort_entity_time", f"WITH {SNAP} SELECT event_id, row_number() OVER (PARTITION BY fips_code ORDER BY run_start_time, event_id) AS place FROM snap")
def _(spark, sf):
    rows = snapshots(spark, sf).select("event_id", "fips_code", "run_start_time")
    return S.entity_time_places(rows, tiebreak=["event_id"]).select("event_id", "place")


# -- matrices -----------------------------------------------------------------------------------

def _feature_sql(cols, target, source, filters="true"):
    numbers = ", ".join(f'round(coalesce(CAST({expr} AS DOUBLE), 0), 9) AS "{name}"' for name, expr in cols.items())
    return (f"WITH {SESS}, {GOOD}, {STATS} SELECT fips_code AS key_fips_code, start_time, {numbers}, "
            f"round(CAST({target} AS DOUBLE), 9) AS label FROM {source} JOIN stats USING (fips_code) WHERE {filters}")


_TIME = {"fips_code": "fips_code", "year": "year(start_time)", "month": "month(start_time)", "day": "day(start_time)",
         "hour": "hour(start_time)", "dayofweek": "isodow(start_time) - 1"}
_DYN = {c: c for c in ("initial_customers_affected", "delta_customers_affected_15m", "pct_growth_15m")}
_WX = {c: c for c in ("has_weather_event", "max_magnitude", "prcp_mm", "tmax_c")}
_HOT = {f"event_{t}": f"CAST(coalesce(event_type, 'None') = '{t}' AS INT)" for t in EVENT_TYPES}
DURATION_SQL = _feature_sql({**_TIME, **{c: c for c in DUR_COLS}, **_DYN, **_WX, "wt_fog": "wt_fog", **_HOT},
                            "duration_minutes", "good")
_SCOPE_STATS = STATS.replace("FROM good", "FROM sess WHERE peak_customers_affected > 0")
SCOPE_SQL = _feature_sql(
    {**_TIME, **{c: c for c in SCOPE_COLS}, **_DYN,
     "initial_impact_density": "initial_customers_affected / greatest(county_max_customers, 1)", **_WX, **_HOT},
    "peak_customers_affected", "sess").replace(STATS, _SCOPE_STATS)


@query("pip1_duration_features", DURATION_SQL)
def _(spark, sf):
    return rounded(X.duration_features(sessions(spark, sf), EVENT_TYPES, LONG_MINUTES))


@query("pip2_scope_features", SCOPE_SQL)
def _(spark, sf):
    return rounded(X.scope_features(sessions(spark, sf), EVENT_TYPES, LARGE))


@query("prj6_feature_matrix", f"WITH {SESS} SELECT fips_code AS key_fips_code, start_time, CAST(fips_code AS DOUBLE) AS fips_code, "
       "CAST(month(start_time) AS DOUBLE) AS month, initial_customers_affected, coalesce(prcp_mm, 0.0) AS prcp_mm, "
       "CAST(has_weather_event AS DOUBLE) AS event_storm, duration_minutes AS label FROM sess "
       "WHERE initial_customers_affected IS NOT NULL AND snapshot_count > 1")
def _(spark, sf):
    s = X.temporal_features(sessions(spark, sf), "start_time").withColumns({
        "event_storm": F.col("has_weather_event"),
        "initial_customers_affected": F.when(F.col("snapshot_count") > 1, F.col("initial_customers_affected"))})
    return X.feature_matrix(s, ["fips_code", "month", "initial_customers_affected", "prcp_mm", "not_there"],
                            "duration_minutes", keys=["fips_code", "start_time"])


@query("prj20_drop_features", DURATION_SQL.replace('round(coalesce(CAST(year(start_time) AS DOUBLE), 0), 9) AS "year", ', "")
       .replace("round(coalesce(CAST(initial_customers_affected AS DOUBLE), 0), 9) AS \"initial_customers_affected\", ", "")
       .replace("round(coalesce(CAST(delta_customers_affected_15m AS DOUBLE), 0), 9) AS \"delta_customers_affected_15m\", ", "")
       .replace("round(coalesce(CAST(pct_growth_15m AS DOUBLE), 0), 9) AS \"pct_growth_15m\", ", ""))
def _(spark, sf):
    return rounded(X.drop_features(X.duration_features(sessions(spark, sf), EVENT_TYPES, LONG_MINUTES), generalise=True))


@query("prj24_sample_weights", f"WITH {SESS} SELECT fips_code, start_time, CASE WHEN duration_minutes >= {LONG_MINUTES} THEN 2.5::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM sess")
def _(spark, sf):
    return X.sample_weights(sessions(spark, sf), "duration_minutes", LONG_MINUTES, 2.5).select(*KEY, "weight")


@query("flt8_valid_targets", f"WITH {SESS} SELECT fips_code, start_time FROM sess WHERE snapshot_count % 3 <> 0 AND delta_customers_affected_15m >= 0")
def _(spark, sf):
    y = F.when(F.col("snapshot_count") % 3 == 0, F.lit(float("inf"))).otherwise(F.col("delta_customers_affected_15m"))
    return X.valid_targets(sessions(spark, sf).withColumn("y", y), "y").select(*KEY)


@query("flt6_temporal_split", "SELECT o_orderkey, CASE WHEN year(o_orderdate) < 1999 THEN 'train' ELSE 'test' END AS part "
       "FROM orders WHERE year(o_orderdate) <= 1999")
def _(spark, sf):
    o = table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    train, test = X.temporal_split(o, 1999)
    return train.select("o_orderkey", F.lit("train").alias("part")).unionByName(
        test.select("o_orderkey", F.lit("test").alias("part")))


@query("flt7_random_split")
def _(spark, sf):
    train, test = X.random_split(sessions(spark, sf), KEY)
    return train.select(*KEY, F.lit("train").alias("part")).unionByName(test.select(*KEY, F.lit("test").alias("part")))


@query("flt7_stratified_split")
def _(spark, sf):
    train, test = X.random_split(table(spark, sf, "labels"), ["doc_id"], label="quality")
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
