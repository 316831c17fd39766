"""Composite jobs: sources or snapshots in, finished tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpulse.operators import rollups as R
from gridpulse.operators.joins import map_stations, skip_done
from gridpulse.operators.sessions import entity_stats, sessionize, valid_durations
from gridpulse.sources.readers import explode_hours, hourly_features, parse_weather_json
from gridpulse.sources.writers import append_resumable, write_table


def entity_stats_job(snapshots: DataFrame, path: str | None = None, long_minutes: float = 240,
                     large: float = 500, **session_options) -> DataFrame:
    """Snapshots to the entity history table; written when ``path`` is given."""
    events = valid_durations(sessionize(snapshots, **session_options))
    stats = entity_stats(events, long_minutes=long_minutes, large=large)
    if path:
        write_table(stats, path)
        return stats.sparkSession.read.schema(stats.schema).parquet(path)
    return stats


def station_weather_job(stations: DataFrame, counties: DataFrame, observations: DataFrame,
                        elements: dict[str, str] | None = None, path: str | None = None) -> DataFrame:
    """Stations to nearest county, long observations to wide, wide to county-days."""
    elements = elements or {code: name for code, (_, name) in R.ELEMENTS.items()}
    near = map_stations(stations, counties)
    wide = R.pivot_elements(observations, elements)
    daily = R.parse_compact_dates(R.entity_day_rollup(R.station_to_entity(wide, near)))
    if path:
        write_table(daily, path)
        return daily.sparkSession.read.schema(daily.schema).parquet(path)
    return daily


def historical_weather_job(raw: DataFrame, path: str | None = None, done: DataFrame | None = None) -> DataFrame:
    """Archive responses to entity-days, entities already done left out; appended to ``path``."""
    todo = raw if done is None else skip_done(raw, done)
    daily = R.hourly_to_daily(explode_hours(parse_weather_json(todo)), preset="archive")
    return append_resumable(daily, path) if path else daily


def hourly_features_job(raw: DataFrame) -> DataFrame:
    return hourly_features(parse_weather_json(raw))


def occurrence_panel(snapshots: DataFrame, daily: DataFrame, min_customers: float = 100) -> DataFrame:
    """Entity-day weather with labels from snapshots."""
    from gridpulse.operators.joins import label_panel
    return label_panel(daily, R.occurrence_labels(snapshots, min_customers=min_customers))


def count_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"))
