"""Panels, scaling, alignment and the occurrence feature set."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridpulse.operators import features as X
from gridpulse.operators import rollups as R
from gridpulse.operators.joins import label_panel
from gridpulse.plans.bindings import DAILY, LABELS, daily_panel, error_snapshots, rounded
from gridpulse.plans.catalog import query, table

_CAL = ("CAST(year({d}) AS {t}) AS year, CAST(month({d}) AS {t}) AS month, CAST(day({d}) AS {t}) AS day, "
        "CAST(isodow({d}) - 1 AS {t}) AS dayofweek")


@query("prj2_day_features", f"WITH {DAILY} SELECT fips_code, date, " + _CAL.format(d="date", t="INT") +
       ", CAST(dayofyear(date) AS INT) AS dayofyear, CAST(isodow(date) >= 6 AS INT) AS is_weekend FROM daily")
def _(spark, sf):
    return X.day_features(daily_panel(spark, sf)).select(
        "fips_code", "date", "year", "month", "day", "dayofweek", "dayofyear", "is_weekend")


def panel(spark, sf):
    labels = R.occurrence_labels(error_snapshots(spark, sf), min_customers=50)
    return label_panel(daily_panel(spark, sf), labels)


_WX = ("prcp_mm", "snow_mm", "tmax_c", "tmin_c", "awnd_ms", "wt_thunder", "wt_ice", "wt_blowing_snow", "wt_snow")
PANEL = f"""{DAILY}, {LABELS}, panel AS (SELECT daily.*, coalesce(outage_occurred, 0) AS outage_occurred
  FROM daily LEFT JOIN lab ON daily.fips_code = lab.fips_code AND daily.date = lab.date)"""
OCC_SQL = (f"WITH {PANEL} SELECT fips_code, date, " + _CAL.format(d="date", t="DOUBLE") + ", " +
           ", ".join(f"CAST(coalesce({c}, 0) AS DOUBLE) AS {c}" for c in _WX) +
           ", CAST(outage_occurred AS DOUBLE) AS label FROM panel")


@query("pip3_occurrence_features", OCC_SQL)
def _(spark, sf):
    return X.occurrence_features(panel(spark, sf), check=False)


@query("prj7_occurrence_matrix", f"WITH {PANEL} SELECT fips_code, date, CAST(coalesce(snow_mm, 0) AS DOUBLE) AS snow_mm, "
       "CAST(kind = 'wet' AS DOUBLE) AS event_wet, CAST(kind IS NULL AS DOUBLE) AS \"event_None\", CAST(wt_snow AS DOUBLE) AS storm_event, "
       "CAST(outage_occurred AS DOUBLE) AS label FROM (SELECT *, CASE WHEN prcp_mm > 30 THEN 'wet' WHEN prcp_mm > 20 THEN 'damp' END AS kind FROM panel) "
       .replace("CAST(kind = 'wet' AS DOUBLE)", "CAST(coalesce(kind = 'wet', false) AS INT)::DOUBLE")
       .replace("CAST(kind IS NULL AS DOUBLE)", "CAST(kind IS NULL AS INT)::DOUBLE"))
def _(spark, sf):
    p = panel(spark, sf).withColumns({
        "storm_event": F.col("wt_snow"),
        "event_type": F.when(F.col("prcp_mm") > 30, "wet").when(F.col("prcp_mm") > 20, "damp")})
    return X.occurrence_feature_matrix(p, ["snow_mm"], include_temporal=False, categories=["wet", "None"], keys=["fips_code", "date"])


@query("prj8_binary_target_check", "SELECT count(*) AS rows, count(*) FILTER (toxic + (doc_id % 50 = 0)::INT NOT IN (0, 1)) AS bad_values, "
       "count(*) FILTER (toxic IS NULL) AS nulls FROM labels")
def _(spark, sf):
    t = table(spark, sf, "labels").withColumn("t", F.col("toxic") + (F.col("doc_id") % 50 == 0).cast("int"))
    return X.binary_target_report(t, "t")


@query("prj9_align_features", f"WITH {DAILY} SELECT fips_code, date, prcp_mm, 0 AS missing_one, wt_ice FROM daily")
def _(spark, sf):
    return X.align_features(daily_panel(spark, sf), ["prcp_mm", "missing_one", "wt_ice"], keys=["fips_code", "date"])


@query("prj21_zscore_normalise", f"WITH {DAILY} SELECT fips_code, date, round((prcp_mm - avg(prcp_mm) OVER ()) / stddev_pop(prcp_mm) OVER (), 6) AS prcp_mm, "
       "round((tmax_c - avg(tmax_c) OVER ()) / stddev_pop(tmax_c) OVER (), 6) AS tmax_c FROM daily")
def _(spark, sf):
    return rounded(X.zscore_normalise(daily_panel(spark, sf), ["prcp_mm", "tmax_c"]).select("fips_code", "date", "prcp_mm", "tmax_c"), 6)


@query("prj21_scaling_stats", f"WITH {DAILY} SELECT 'prcp_mm' AS \"column\", round(avg(prcp_mm), 6) AS mean, round(stddev_pop(prcp_mm), 6) AS std FROM daily "
       "UNION ALL SELECT 'wt_ice', round(avg(wt_ice), 6), round(stddev_pop(wt_ice), 6) FROM daily UNION ALL SELECT 'flat', 7.0, 1.0 FROM (SELECT count(*) c FROM daily)")
def _(spark, sf):
    return rounded(X.scaling_stats(daily_panel(spark, sf).withColumn("flat", F.lit(7.0)), ["prcp_mm", "wt_ice", "flat"]), 6)


@query("prj22_zero_weather_rows", f"WITH {DAILY}, d AS (SELECT * FROM daily WHERE date = (SELECT max(date) FROM daily)), e AS (SELECT DISTINCT fips_code FROM daily) "
       "SELECT e.fips_code, coalesce(prcp_mm, 0.0) AS prcp_mm, coalesce(wt_ice, 0) AS wt_ice, CAST(d.fips_code IS NULL AS INT) AS magnitude_missing "
       "FROM e LEFT JOIN d ON e.fips_code = d.fips_code")
def _(spark, sf):
    daily = daily_panel(spark, sf)
    day = daily.where(F.col("date") == daily.agg(F.max("date")).scalar()).select("fips_code", "prcp_mm", "wt_ice")
    return X.zero_weather_rows(daily.select("fips_code").distinct(), day)


@query("prj25_pin_feature", f"WITH {DAILY} SELECT fips_code, date, 2021 AS year FROM daily")
def _(spark, sf):
    return X.pin_feature(X.day_features(daily_panel(spark, sf))).select("fips_code", "date", "year")


@query("snk3_export_sample")
def _(spark, sf):
    return X.export_sample(X.occurrence_features(panel(spark, sf), check=False), ["fips_code", "date"])


@query("prj5_one_hot_sparse", "WITH c AS (SELECT p_type, dense_rank() OVER (ORDER BY p_type) - 1 AS i, (SELECT count(DISTINCT p_type) FROM part) AS n FROM part "
       "WHERE p_type NOT LIKE 'PROMO%' GROUP BY p_type), w AS (SELECT count(*) AS n FROM c) SELECT p_partkey, w.n + 1 AS width, "
       "coalesce(c.i, w.n) AS place, 1.0::DOUBLE AS total FROM part CROSS JOIN w LEFT JOIN c ON c.p_type = part.p_type")
def _(spark, sf):
    from pyspark.ml.functions import vector_to_array
    # Categories without the promotional ones: their rows get the place of unknown categories.
    part = table(spark, sf, "part").select("p_partkey", "p_type")
    known = X.category_index(part.where("p_type NOT LIKE 'PROMO%'"), "p_type")
    values = vector_to_array("v")
    return X.one_hot_vector(part, known, "p_type", "v").select(
        "p_partkey", F.size(values).cast("long").alias("width"), (F.array_position(values, F.lit(1.0)) - 1).alias("place"),
        F.aggregate(values, F.lit(0.0), lambda a, b: a + b).alias("total"))
