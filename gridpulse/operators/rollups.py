"""Aggregations: labels, weather rollups, profiles and reports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridpulse.functions.columns import parse_date, require_columns, to_number
from gridpulse.functions.skew import group_quantiles, spread_join
from gridpulse.functions.weather import CODE_FLAGS, KMH_PER_MS, code_flags

# Station element, unit factor, output column.
ELEMENTS = {
    "PRCP": (0.1, "prcp_mm"), "SNOW": (1.0, "snow_mm"), "SNWD": (1.0, "snwd_mm"),
    "TMAX": (0.1, "tmax_c"), "TMIN": (0.1, "tmin_c"), "AWND": (0.1, "awnd_ms"),
    "WSF2": (0.1, "wsf2_ms"), "WSF5": (0.1, "wsf5_ms"), "WSFG": (0.1, "wsfg_ms"),
    "WT01": (1.0, "wt_fog"), "WT02": (1.0, "wt_heavy_fog"), "WT03": (1.0, "wt_thunder"),
    "WT04": (1.0, "wt_ice_pellets"), "WT06": (1.0, "wt_ice"), "WT08": (1.0, "wt_haze"),
    "WT09": (1.0, "wt_blowing_snow"), "WT14": (1.0, "wt_drizzle"), "WT16": (1.0, "wt_rain"),
    "WT17": (1.0, "wt_freezing_rain"), "WT18": (1.0, "wt_snow"),
}


def occurrence_labels(snapshots: DataFrame, entity: str = "fips_code", ts: str = "run_start_time",
                      value: str = "customers_affected", min_customers: float = 100) -> DataFrame:
    require_columns(snapshots, [entity, ts, value])
    daily = (snapshots.where(F.col(ts).isNotNull() & F.col(entity).isNotNull()).groupBy(entity, F.to_date(ts).alias("date"))
             .agg(F.max(value).alias("max_customers_affected")))
    return daily.withColumn(
        "outage_occurred",
        F.coalesce(F.col("max_customers_affected") >= min_customers, F.lit(False)).cast("int"))


def hourly_to_daily(hourly: DataFrame, entity: str = "fips_code", time: str = "time",
                    preset: str = "archive", null_as_zero: bool | None = None) -> DataFrame:
    """Hourly readings to entity-days.

    ``archive`` keeps snow in its source units and skips null hours in the wind mean; ``live``
    converts cm and m to mm and counts null hours as 0.
    """
    if preset not in ("archive", "live"):
        raise ValueError(preset)
    live = preset == "live"
    zero = live if null_as_zero is None else null_as_zero
    snow, depth = (10.0, 1000.0) if live else (1.0, 1.0)

    def reading(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0.0)) if zero else F.col(name)

    flagged = hourly.select("*", *code_flags("weather_code"))
    return flagged.groupBy(entity, F.to_date(time).alias("date")).agg(
        F.max("temperature_2m").alias("tmax_c"), F.min("temperature_2m").alias("tmin_c"),
        F.coalesce(F.sum(reading("precipitation")), F.lit(0.0)).alias("prcp_mm"),
        (F.coalesce(F.sum(reading("snowfall")), F.lit(0.0)) * snow).alias("snow_mm"),
        (F.max(reading("snow_depth")) * depth).alias("snwd_mm"),
        (F.avg(reading("wind_speed_10m")) / KMH_PER_MS).alias("awnd_ms"),
        (F.max(reading("wind_gusts_10m")) / KMH_PER_MS).alias("wsfg_ms"),
        *[F.max(f).alias(f) for f in CODE_FLAGS])


def pivot_elements(long: DataFrame, elements: dict[str, str], station: str = "station_id",
                   date: str = "date", element: str = "element", value: str = "value") -> DataFrame:
    """Long to wide, mean per (station, date, element); flag columns ``wt_*`` become whole numbers."""
    wide = long.groupBy(station, date).pivot(element, list(elements)).agg(F.avg(value))
    cols = []
    for code, name in elements.items():
        flag = F.coalesce(F.col(f"`{code}`"), F.lit(0.0)).cast("int")
        cols.append((flag if name.startswith("wt_") else F.col(f"`{code}`")).alias(name))
    return wide.select(station, date, *cols)


def entity_day_rollup(station_days: DataFrame, entity: str = "fips_code", date: str = "date",
                      skip: Sequence[str] = ("station_id",)) -> DataFrame:
    """Stations to entities: means of readings, maxima of flags."""
    names = [c for c in station_days.columns if c not in (entity, date, *skip)]
    return station_days.where(F.col(entity).isNotNull()).groupBy(entity, date).agg(
        *[(F.max(c) if c.startswith("wt_") else F.avg(c)).alias(c) for c in names])


def station_to_entity(station_days: DataFrame, station_map: DataFrame) -> DataFrame:
    return spread_join(station_days, station_map.select("station_id", "fips_code"), ["station_id"])


def quality_filter(obs: DataFrame, elements: DataFrame | None = None) -> DataFrame:
    """Blank quality flag, known element, usable value; values are scaled to real units."""
    if elements is None:
        scale = F.create_map(*[F.lit(x) for k, (f, _) in ELEMENTS.items() for x in (k, f)])
        scaled = obs.withColumn("_scale", F.try_element_at(scale, F.col("element")))
    else:
        scaled = spread_join(obs, elements.select("element", F.col("scale").alias("_scale")), ["element"])
    kept = scaled.where((F.trim(F.coalesce("q_flag", F.lit(""))) == "") & F.col("_scale").isNotNull())
    kept = kept.withColumn("value", to_number("value") * F.col("_scale"))
    return kept.where(F.col("value").isNotNull()).select("station_id", "date", "element", "value")


# -- profiles -----------------------------------------------------------------------------------

def profile(df: DataFrame, time_column: str | None = None) -> DataFrame:
    """One row: rows, columns, whole-row duplicates, time range, nulls per column."""
    if time_column is None:
        stamps = [f.name for f in df.schema if f.dataType.typeName().startswith("timestamp")]
        time_column = stamps[0] if stamps else None
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    nulls = [F.sum(F.when(F.col(c).isNull(), F.col("_n")).otherwise(0)).alias(f"missing_{c}")
             for c in df.columns]
    span = ([F.min(time_column).alias("first_time"), F.max(time_column).alias("last_time")]
            if time_column else [])
    return groups.agg(
        F.sum("_n").alias("num_records"), F.lit(len(df.columns)).alias("num_columns"),
        (F.sum("_n") - F.count(F.lit(1))).alias("duplicate_rows"), *span, *nulls)


def missing_by_column(df: DataFrame) -> DataFrame:
    """One row per column: null count and percentage."""
    counts = df.agg(F.count(F.lit(1)).alias("_all"),
                    *[F.count_if(F.col(c).isNull()).alias(f"_m{i}") for i, c in enumerate(df.columns)])
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"_m{i}").alias("missing"))
        for i, c in enumerate(df.columns)]))
    return counts.select("_all", pairs.alias("p")).select(
        "p.column", "p.missing", (F.col("p.missing") / F.col("_all") * 100).alias("percent"))


def class_balance(df: DataFrame, label: str = "outage_occurred") -> DataFrame:
    require_columns(df, [label])
    positive = F.coalesce(F.sum(label), F.lit(0)).cast("long")
    total = F.count(F.lit(1))
    return df.agg(total.alias("total"), positive.alias("positives"), (total - positive).alias("negatives"),
                  (positive / total * 100).alias("positive_percent"))


def match_rate(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"), F.count(column).alias("matched"),
                  (F.count(column) / F.count(F.lit(1)) * 100).alias("matched_percent"))


def coverage(df: DataFrame, start: str, end: str, entity: str = "fips_code") -> DataFrame:
    """Rows as a share of all possible entity-days."""
    days = F.datediff(F.lit(end).cast("date"), F.lit(start).cast("date")) + 1
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(entity).alias("entities"),
                  (F.count(F.lit(1)) / (F.count_distinct(entity) * days) * 100).alias("coverage_percent"))


def load_summary(df: DataFrame, entity: str, kind: str, date: str) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("records"), F.count_distinct(entity).alias("entities"),
        F.count_distinct(kind).alias("event_types"), F.min(date).alias("first_date"),
        F.max(date).alias("last_date"), F.min(F.year(date)).alias("first_year"),
        F.max(F.year(date)).alias("last_year"))


def value_counts(df: DataFrame, column: str, top: int = 15) -> DataFrame:
    """The most frequent values, ties by value, each with how many further values exist."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    kinds = counts.agg(F.count(F.lit(1))).scalar()
    return (counts.orderBy(F.desc("n"), column).limit(top)
            .withColumn("more_values", F.greatest(kinds - F.lit(top), F.lit(0))))


def nonzero_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    counts = df.agg(F.count(F.lit(1)).alias("_all"),
                    *[F.count_if(F.col(c) > 0).alias(f"_m{i}") for i, c in enumerate(columns)])
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"_m{i}").alias("nonzero")) for i, c in enumerate(columns)]))
    return counts.select("_all", pairs.alias("p")).select(
        "p.column", "p.nonzero", (F.col("p.nonzero") / F.col("_all") * 100).alias("percent"))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, sample std, min, exact quartiles, max: one row per column."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]))
    long = df.select(pairs.alias("p")).select("p.*")
    basic = long.groupBy("column").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    quartiles = group_quantiles(long, ["column"], "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return basic.join(quartiles, "column")


def feature_lineage(tables: dict[str, DataFrame]) -> DataFrame:
    """Which usable features each source delivers: column names with at least one value."""
    frames = [missing_by_column(df).withColumn("source", F.lit(name))
              .withColumn("usable", F.coalesce(F.col("percent") < 100, F.lit(False)))
              for name, df in tables.items()]
    listed = reduce(DataFrame.unionByName, frames).where("usable")
    return listed.groupBy("source").agg(
        F.count(F.lit(1)).alias("feature_count"),
        F.sort_array(F.collect_list("column")).alias("features"))


def max_station_distance(station_map: DataFrame) -> DataFrame:
    return station_map.agg(F.count(F.lit(1)).alias("stations"),
                           F.count_distinct("fips_code").alias("counties"),
                           F.max("dist_km").alias("max_dist_km"))


def status_summary(predictions: DataFrame, stamp: str = "run_ts") -> DataFrame:
    return predictions.agg(F.count(F.lit(1)).alias("counties_cached"), F.max(stamp).alias("last_updated"),
                           F.count_if("occurrence").alias("outages_predicted"))


def union_years(frames: Sequence[DataFrame]) -> DataFrame:
    """Bag union by name; columns a year lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def parse_compact_dates(df: DataFrame, date: str = "date") -> DataFrame:
    return df.withColumn(date, parse_date(date, "yyyyMMdd"))
