"""Live polls, name resolution, anomalies, forecast days and published predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridpulse.functions.columns import array_mean, array_total, clean_text, weekday, zero_nulls
from gridpulse.functions.skew import spread_join
from gridpulse.functions.weather import (KMH_PER_MS, MM_PER_CM, MM_PER_M, code_flags_any,
                                         outside_physical_bounds, severe_proxy)

# Columns the cross-section check looks at, and weather shown next to a prediction.
ZSCORE_COLUMNS = ("prcp_mm", "tmax_c", "tmin_c", "awnd_ms", "snow_mm")
MIN_SCOPE_CUSTOMERS = 50.0
FLAG_LABELS = {
    "wt_thunder": "⛈ Thunderstorm", "wt_fog": "🌫 Fog", "wt_snow": "❄ Snow",
    "wt_freezing_rain": "🌨 Freezing Rain", "wt_ice": "🧊 Ice", "wt_blowing_snow": "💨 Blowing Snow",
    "wt_rain": "🌧 Rain", "wt_drizzle": "🌦 Drizzle",
}
WEATHER_LABELS = {
    "tmax_c": ("Max Temp", "°C"), "tmin_c": ("Min Temp", "°C"), "awnd_ms": ("Avg Wind", "m/s"),
    "wsfg_ms": ("Wind Gusts", "m/s"), "prcp_mm": ("Precipitation", "mm"), "snow_mm": ("Snowfall", "mm"),
    "snwd_mm": ("Snow Depth", "mm"),
}


# -- names --------------------------------------------------------------------------------------

def alias_table(geo: DataFrame, name: str = "county_name", code: str = "fips", order: str = "ord",
                drop_phrase: str = ", virginia") -> DataFrame:
    """alias -> code. A name also goes without one trailing " county" or " city".

    When several names share an alias, the last one that contains "county" wins, else the first.
    """
    raw = clean_text(name, drop_phrase)
    named = geo.select(F.col(code).alias("_code"), F.col(order).alias("_ord"), raw.alias("_raw"))
    short = F.when(F.endswith("_raw", F.lit(" county")), F.expr("trim(substr(_raw, 1, length(_raw) - 7))")
                   ).when(F.endswith("_raw", F.lit(" city")), F.expr("trim(substr(_raw, 1, length(_raw) - 5))"))
    each = named.select("*", F.explode(F.array_compact(F.array(F.col("_raw"), short))).alias("alias"))
    is_county = F.contains("_raw", F.lit("county")).cast("int")
    rank = F.struct(is_county, F.when(is_county == 1, F.col("_ord")).otherwise(-F.col("_ord")))
    return each.groupBy("alias").agg(F.max_by("_code", rank).alias("fips_code"))


def resolve_names(polls: DataFrame, aliases: DataFrame, title: str = "title") -> DataFrame:
    """Adds ``fips_code``; names nobody knows stay with null."""
    keyed = polls.withColumn("alias", F.lower(title))
    return spread_join(keyed, aliases, ["alias"]).drop("alias")


def unknown_names(polls: DataFrame, aliases: DataFrame, title: str = "title") -> DataFrame:
    """Distinct unknown names with how often they came."""
    names = polls.groupBy(title).agg(F.count(F.lit(1)).alias("n")).withColumn("alias", F.lower(title))
    return names.join(aliases.select("alias"), "alias", "left_anti").drop("alias")


def duplicate_poll_names(resolved: DataFrame, provider: str = "provider", title: str = "title",
                         value: str = "cust_a") -> DataFrame:
    """Names a provider reports more than once for the same code, with the amount that is added up."""
    return (resolved.where(F.col("fips_code").isNotNull() & (F.col(value) > 0))
            .groupBy(provider, title, "fips_code")
            .agg(F.count(F.lit(1)).alias("records"), F.sum(value).alias("total"))
            .where(F.col("records") > 1))


# -- polls --------------------------------------------------------------------------------------

def positive_live(resolved: DataFrame, value: str = "cust_a") -> DataFrame:
    """Records with customers out whose name has a numeric code."""
    return resolved.where((F.col(value) > 0) & F.col("fips_code").rlike("^[0-9]+$"))


def sum_providers(polls: DataFrame, keys: Sequence[str] = ("fips_code",), value: str = "cust_a") -> DataFrame:
    return polls.groupBy(*keys).agg(F.sum(value).alias("customers"))


def poll_delta(polls: DataFrame, poll: str = "poll_no", entity: str = "fips_code",
               value: str = "customers", known: DataFrame | None = None) -> DataFrame:
    """Change against the immediately preceding poll; an entity absent there changes by 0.

    One row per (poll, entity) goes in, so the previous poll is an equi join on unique keys. ``known`` holds the polls
    to compare with, by default ``polls`` itself.
    """
    before = (polls if known is None else known).select((F.col(poll) + 1).alias(poll), entity, F.col(value).alias("_prev"))
    joined = polls.join(before, [poll, entity], "left")
    prev = F.coalesce("_prev", F.col(value))
    return joined.withColumns({
        "delta": F.col(value) - prev,
        "pct_growth": (F.col(value) - prev) / F.greatest(prev, F.lit(1.0))}).drop("_prev")


def live_totals(polls: DataFrame, by: Sequence[str] = (), value: str = "customers") -> DataFrame:
    """Affected entities and customers, of one poll or per poll."""
    return polls.groupBy(*by).agg(F.count_distinct("fips_code").alias("counties_affected"),
                     F.coalesce(F.sum(value), F.lit(0.0)).alias("customers_total"))


def attach_live(events: DataFrame, live: DataFrame, keys: Sequence[str] = ("fips_code",)) -> DataFrame:
    """Adds the live features, 0 where nothing was polled."""
    renamed = live.select(
        *keys, F.col("customers").alias("initial_customers_affected"),
        F.col("delta").alias("delta_customers_affected_15m"), F.col("pct_growth").alias("pct_growth_15m"))
    out = spread_join(events, renamed, keys)
    return out.fillna(0.0, [c for c in renamed.columns if c not in keys])


# -- anomalies ----------------------------------------------------------------------------------

def cross_section_zscore(rows: DataFrame, run: str | None, columns: Sequence[str] = ZSCORE_COLUMNS,
                         limit: float = 4.0, name: str = "zscore_flag") -> DataFrame:
    """Flags rows further than ``limit`` sample deviations from their run's mean in any column.

    Without ``run`` all rows are one run, whose moments need no join.
    """
    moments = [f for c in columns for f in (F.avg(c).alias(f"_m_{c}"), F.stddev_samp(c).alias(f"_s_{c}"))]
    if run is None:
        one = rows.agg(*moments)
        held = rows.withColumn("_moments", one.select(F.struct(*one.columns)).scalar())
        joined = held.withColumns({c: F.col("_moments")[c] for c in one.columns}).drop("_moments")
    else:
        joined = spread_join(rows, rows.groupBy(run).agg(*moments), [run])
    far = F.lit(False)
    for c in columns:
        std = F.col(f"_s_{c}")
        z = F.abs(F.col(c) - F.col(f"_m_{c}")) / F.when(std > 0, std)
        far = far | F.coalesce(z > limit, F.lit(False))
    return joined.withColumn(name, far).drop(*[f"_{k}_{c}" for c in columns for k in "ms"])


def statistical_anomaly(rows: DataFrame, run: str | None, limit: float = 4.0) -> DataFrame:
    """Physically impossible or far from the run's other entities."""
    flagged = cross_section_zscore(rows, run, limit=limit, name="_z")
    bad = F.coalesce(outside_physical_bounds(), F.lit(False))
    return flagged.withColumn("stat_anomaly", bad | F.col("_z")).drop("_z")


# -- hourly arrays ------------------------------------------------------------------------------

HOURLY = ("precipitation", "snowfall", "snow_depth", "windspeed_10m", "windgusts_10m", "weathercode")


def _day_row(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Weather features from one day's arrays ``h_*`` plus ``tmax`` and ``tmin``."""
    values = {n: zero_nulls(f"h_{n}") for n in HOURLY}
    codes = F.transform(values["weathercode"], lambda c: c.cast("int"))
    day = df.select(
        *keys, codes.alias("_codes"),
        array_total(values["precipitation"]).alias("_prcp"),
        (array_total(F.transform(values["snowfall"], lambda v: v * MM_PER_CM))).alias("_snow"),
        (F.coalesce(F.array_max(values["snow_depth"]), F.lit(0.0)) * MM_PER_M).alias("_snwd"),
        array_mean(F.transform(values["windspeed_10m"], lambda v: v / KMH_PER_MS)).alias("_wind"),
        (F.coalesce(F.array_max(values["windgusts_10m"]), F.lit(0.0)) / KMH_PER_MS).alias("_gust"),
        F.coalesce("tmax", F.lit(0.0)).alias("tmax_c"), F.coalesce("tmin", F.lit(0.0)).alias("tmin_c"))
    return day.select(
        *keys, F.round("_prcp", 3).alias("prcp_mm"), F.round("_snow", 3).alias("snow_mm"),
        F.round("_snwd", 3).alias("snwd_mm"), "tmax_c", "tmin_c", F.round("_wind", 3).alias("awnd_ms"),
        F.round("_gust", 3).alias("wsfg_ms"), *severe_proxy("_codes", "_prcp", "_wind"),
        *code_flags_any("_codes"))


def calendar_columns(df: DataFrame, date: str, hour: Column) -> DataFrame:
    return df.withColumns({
        "year": F.year(date), "month": F.month(date), "day": F.dayofmonth(date), "hour": hour,
        "dayofweek": weekday(date), "dayofyear": F.dayofyear(date),
        "is_weekend": (weekday(date) >= 5).cast("int")})


def live_day(raw: DataFrame, entity: str = "fips_code") -> DataFrame:
    """Current weather: all hours of the response are one day, max and min from the daily arrays."""
    flat = raw.where(F.col("hourly").isNotNull()).select(
        entity, F.col("now"), *[F.col(f"hourly.{n}").alias(f"h_{n}") for n in HOURLY],
        F.get("daily.temperature_2m_max", F.lit(0)).alias("tmax"),
        F.get("daily.temperature_2m_min", F.lit(0)).alias("tmin"))
    return calendar_columns(_day_row(flat, [entity, "now"]), "now", F.hour("now"))


def forecast_days(raw: DataFrame, entity: str = "fips_code") -> DataFrame:
    """One row per forecast day: hours ``[24 i, 24 i + 24)``; the hour column is fixed at noon."""
    days = raw.where(F.col("hourly").isNotNull()).select(
        entity, "hourly", "daily", F.posexplode("daily.time").alias("_i", "date"))
    flat = days.select(
        entity, F.col("date").cast("date").alias("date"),
        *[F.slice(f"hourly.{n}", F.col("_i") * 24 + 1, F.lit(24)).alias(f"h_{n}") for n in HOURLY],
        F.get("daily.temperature_2m_max", F.col("_i")).alias("tmax"),
        F.get("daily.temperature_2m_min", F.col("_i")).alias("tmin"))
    return calendar_columns(_day_row(flat, [entity, "date"]), "date", F.lit(12))


# -- published predictions ----------------------------------------------------------------------

def prediction_records(scored: DataFrame, keys: Sequence[str] = ("fips_code",),
                       min_scope: float = MIN_SCOPE_CUSTOMERS) -> DataFrame:
    """Rounded records; predictions under ``min_scope`` customers are withdrawn, probability stays.

    Input: ``occ_pred`` 0/1, ``occ_prob``, ``scope_pred`` customers, ``dur_pred`` minutes, and
    optionally ``anomaly_flag`` and ``ae_error``.
    """
    occurs = F.coalesce(F.col("occ_pred") == 1, F.lit(False))
    scope = F.when(occurs, F.round("scope_pred", 1)).otherwise(0.0)
    hours = F.when(occurs, F.round(F.col("dur_pred") / 60.0, 2)).otherwise(0.0)
    shown = occurs & F.coalesce(scope >= min_scope, F.lit(False))
    extra = []
    if "anomaly_flag" in scored.columns:
        extra = [F.coalesce("anomaly_flag", F.lit(False)).alias("anomaly_flag"),
                 F.coalesce(F.round("ae_error", 4), F.lit(0.0)).alias("ae_error")]
    return scored.select(
        *keys, shown.alias("occurrence"), F.when(shown, scope).otherwise(0.0).alias("scope"),
        F.when(shown, hours).otherwise(0.0).alias("duration"), F.round("occ_prob", 4).alias("occ_prob"),
        *extra)


def significant_only(records: DataFrame, min_scope: float = MIN_SCOPE_CUSTOMERS) -> DataFrame:
    return records.where(F.col("occurrence") & (F.col("scope") >= min_scope))


def scope_sanity(scored: DataFrame, factor: float = 2.0) -> DataFrame:
    """Predictions above ``factor`` times the entity's historical maximum."""
    top = F.col("county_max_customers")
    return scored.where((top > 0) & (F.col("scope_pred") > top * factor))


def active_flag_labels(rows: DataFrame, name: str = "active_flags") -> DataFrame:
    shown = F.array_compact(F.array(*[
        F.when(F.col(c) == 1, F.lit(label)) for c, label in FLAG_LABELS.items() if c in rows.columns]))
    return rows.withColumn(name, shown)


def labelled_weather(rows: DataFrame, key: str = "fips_code") -> DataFrame:
    """Long form of the shown weather: label, value to one decimal, unit."""
    parts = [F.struct(F.lit(label).alias("label"), F.round(c, 1).alias("value"), F.lit(unit).alias("unit"))
             for c, (label, unit) in WEATHER_LABELS.items() if c in rows.columns]
    return rows.select(key, F.explode(F.array(*parts)).alias("w")).select(key, "w.*")


def outage_first_listing(records: DataFrame, name: str = "name") -> DataFrame:
    return records.orderBy(F.desc("occurrence"), F.lower(name), name)


def sorted_dates(forecast: DataFrame, date: str = "date") -> DataFrame:
    return forecast.select(date).distinct().orderBy(date)


def head_preview(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    return df.orderBy(*order).limit(n)


def latest_cache(records: DataFrame, keys: Sequence[str] = ("fips_code",), stamp: str = "run_ts") -> DataFrame:
    """Newest record per key, found by a map-side combined maximum."""
    rest = [c for c in records.columns if c not in (*keys, stamp)]
    newest = records.groupBy(*keys).agg(
        F.max(stamp).alias(stamp), F.max_by(F.struct(*rest), stamp).alias("_r"))
    return newest.select(*keys, stamp, "_r.*")


def top_contributions(contributions: DataFrame, keys: Sequence[str] = ("fips_code", "model"),
                      n: int = 10) -> DataFrame:
    """The ``n`` largest contributions by absolute value per key; ties by name."""
    rest = [c for c in contributions.columns if c not in keys]
    size = F.coalesce(-F.abs("shap"), F.lit(float("inf")))
    order = F.struct(size.alias("_size"), F.col("name").alias("_name"), F.struct(*rest).alias("_row"))
    # A key has one row per feature, so its list is as long as the model is wide.
    ranked = contributions.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list(order)), 1, n).alias("_top"))
    placed = ranked.select(*keys, F.posexplode("_top").alias("_at", "_t"))
    return placed.select(*[F.col(c) if c in keys else F.col("_t._row")[c].alias(c) for c in contributions.columns],
                         (F.col("_at") + 1).alias("place"))


def global_importance(contributions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean absolute contribution per feature."""
    return contributions.groupBy(*keys, "name").agg(F.avg(F.abs("shap")).alias("mean_abs_shap"))


def sorted_importance(importance: DataFrame, n: int | None = None,
                      by: str = "mean_abs_shap") -> DataFrame:
    ordered = importance.orderBy(F.desc(by), "name")
    return ordered if n is None else ordered.limit(n)
