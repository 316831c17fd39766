"""Turning snapshots into events: gap-and-flag sessions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridpulse.functions.columns import micros, minutes_between, require_columns, to_number
from gridpulse.functions.skew import group_quantiles, numbered, spread_join, time_buckets, time_carry
from gridpulse.functions.weather import CODE_FLAGS

# Columns whose first known value inside an event is kept when the input has them.
CARRIED = ("county", "state", "prcp_mm", "tmax_c", "tmin_c", "awnd_ms", "wsfg_ms", *CODE_FLAGS)

DAY_OF_SNAPSHOTS = 96


def _ties(df: DataFrame, tiebreak: Sequence[str] | None, known: Sequence[str]) -> list[str]:
    """What orders rows of equal time: the given columns, else all others that have an order."""
    if tiebreak is not None:
        return list(tiebreak)
    return [f.name for f in df.schema if f.name not in known and not re.search(
        "map<|variant|interval", f.dataType.simpleString())]


def gap_to_previous(df: DataFrame, entity: str = "fips_code", ts: str = "run_start_time",
                    tiebreak: Sequence[str] | None = None, bucket_minutes: float = 1440,
                    bucket_rows: int | None = None, name: str = "gap_minutes") -> DataFrame:
    """Minutes since the entity's previous row, null on its first row. Rows without entity or time go."""
    tiebreak = _ties(df, tiebreak, [entity, ts])
    rows = df.where(F.col(ts).isNotNull() & F.col(entity).isNotNull()).withColumn("_us", micros(ts))
    rows = time_buckets(rows, entity, bucket_minutes, bucket_rows)
    rows = time_carry(rows, entity, tiebreak, [ts])
    return rows.withColumn(name, minutes_between(f"prev_{ts}", ts)).drop(
        f"prev_{ts}", "_us", "_bucket")


def island_ids(df: DataFrame, entity: str = "fips_code", ts: str = "run_start_time",
               value: str = "customers_affected", tiebreak: Sequence[str] | None = None,
               snapshot_minutes: float = 15, gap_multiplier: float = 2,
               bucket_minutes: float | None = None, bucket_rows: int | None = None,
               name: str = "block") -> DataFrame:
    """Number each entity's runs of equal on/off state, broken by long gaps, from 1."""
    limit = gap_multiplier * snapshot_minutes
    tiebreak = _ties(df, tiebreak, [entity, ts])
    rows = df.where(F.col(ts).isNotNull() & F.col(entity).isNotNull()).withColumns({
        "is_outage": F.coalesce(F.col(value) > 0, F.lit(False)), "_us": micros(ts)})
    rows = time_buckets(rows, entity, bucket_minutes or DAY_OF_SNAPSHOTS * snapshot_minutes, bucket_rows)
    rows = time_carry(rows, entity, tiebreak, [ts, "is_outage"])
    rows = rows.withColumn("_start", (
        F.col("prev_is_outage").isNull() | (F.col("prev_is_outage") != F.col("is_outage"))
        | (minutes_between(f"prev_{ts}", ts) > limit)).cast("long"))
    starts = rows.groupBy(entity, "_bucket").agg(F.sum("_start").alias("_n"))
    offsets = starts.select(entity, "_bucket", F.coalesce(F.sum("_n").over(
        Window.partitionBy(entity).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(entity, "_bucket").orderBy("_us", *tiebreak)
    numbered = rows.withColumn(name, F.sum("_start").over(
        inside.rowsBetween(Window.unboundedPreceding, 0)))
    joined = numbered.join(offsets, [entity, "_bucket"])
    return joined.withColumn(name, F.col(name) + F.col("_offset")).drop(
        "_offset", "_start", "_us", "_bucket", f"prev_{ts}", "prev_is_outage")


def sessionize(df: DataFrame, entity: str = "fips_code", ts: str = "run_start_time",
               value: str = "customers_affected", snapshot_minutes: float = 15,
               gap_multiplier: float = 2, tiebreak: Sequence[str] | None = None,
               carried: Sequence[str] | None = None, event_type: str = "event_type",
               magnitude: str = "magnitude", bucket_minutes: float | None = None,
              bucket_rows: int | None = None) -> DataFrame:
    """Snapshots to events with early-growth features.

    An event is a maximal run of an entity's rows with ``value > 0`` in which no step from one row
    to the next is longer than ``gap_multiplier * snapshot_minutes``.

    Runs are cut first inside (entity, time bucket). Runs that do not touch a bucket edge are whole
    events already; only edge runs, at most two per bucket, are chained per entity. An entity with
    very many rows is thus sorted by as many tasks as it has buckets.

    Buckets are ``bucket_minutes`` wide, by default 96 expected snapshots. When rows may come far more
    often than expected, pass ``bucket_rows``: an entity's buckets with more rows than that are then cut finer,
    at the price of one extra pass over entity and time.
    """
    runs = snapshot_runs(df, entity, ts, value, snapshot_minutes, gap_multiplier, tiebreak, carried, event_type,
                         magnitude, bucket_minutes, bucket_rows)
    blocks = chain_runs(runs, entity, snapshot_minutes, gap_multiplier)
    return finish_events(blocks.where("_on"), entity, snapshot_minutes, event_type)


# Columns of a run; any further ones are carried values whose first known one counts.
RUN_COLUMNS = ("_bucket", "_run", "_on", "_last_run", "_first_us", "_last_us", "_t0", "_t1", "_peak", "_v1",
               "_v2", "_rows", "_types", "_size")


def _first_known(column: str, order: str) -> Column:
    return F.expr(f"min_by(`{column}`, {order}) filter (where `{column}` is not null)").alias(column)


def snapshot_runs(df: DataFrame, entity: str = "fips_code", ts: str = "run_start_time",
                  value: str = "customers_affected", snapshot_minutes: float = 15,
                  gap_multiplier: float = 2, tiebreak: Sequence[str] | None = None,
                  carried: Sequence[str] | None = None, event_type: str = "event_type",
                  magnitude: str = "magnitude", bucket_minutes: float | None = None,
                  bucket_rows: int | None = None) -> DataFrame:
    """Runs of equal state inside each (entity, time bucket), summed up. One shuffle of the rows.

    Off runs stay only at bucket edges, where they decide what the neighbour bucket continues. Rows of equal time
    are ordered by ``tiebreak``, by default all columns that an event takes a value from, so the result does not
    depend on the order of the input. Rows without entity or time are in no run.
    """
    require_columns(df, [entity, ts, value])
    gap_us = F.lit(int(gap_multiplier * snapshot_minutes * 60_000_000))
    has_type, has_size = event_type in df.columns, magnitude in df.columns
    first_of = [c for c in (CARRIED if carried is None else carried) if c in df.columns]
    if has_type:
        first_of.append(event_type)
    if tiebreak is None:
        tiebreak = [value, *first_of, *([magnitude] if has_size else [])]
    ties = [f"_tie{i}" for i in range(len(tiebreak))]
    rows = df.where(F.col(ts).isNotNull() & F.col(entity).isNotNull()).select(
        F.col(entity), F.col(ts).alias("_ts"), F.col(value).alias("_v"), micros(ts).alias("_us"),
        F.coalesce(F.col(value) > 0, F.lit(False)).alias("_on"),
        *[F.col(t).alias(name) for t, name in zip(tiebreak, ties)], *[F.col(c) for c in first_of],
        *([to_number(magnitude).alias("_size")] if has_size else []))
    rows = time_buckets(rows, entity, bucket_minutes or DAY_OF_SNAPSHOTS * snapshot_minutes, bucket_rows)
    inside = Window.partitionBy(entity, "_bucket").orderBy("_us", *ties)
    rows = rows.withColumns({
        "_start": F.when(
            F.lag("_on").over(inside).isNull() | (F.lag("_on").over(inside) != F.col("_on"))
            | (F.col("_us") - F.lag("_us").over(inside) > gap_us), 1).otherwise(0),
        "_seq": F.row_number().over(inside)})
    rows = rows.withColumns({
        "_run": F.sum("_start").over(inside.rowsBetween(Window.unboundedPreceding, 0)),
        "_runs": F.sum("_start").over(Window.partitionBy(entity, "_bucket")),
        "_next": F.when(F.lead("_start").over(inside) == 0, F.lead("_v").over(inside))})
    runs = rows.groupBy(entity, "_bucket", "_run").agg(
        F.max("_on").alias("_on"),
        (F.max("_runs") == F.col("_run")).alias("_last_run"),
        F.min("_us").alias("_first_us"), F.max("_us").alias("_last_us"),
        F.min("_ts").alias("_t0"), F.max("_ts").alias("_t1"),
        F.max("_v").alias("_peak"),
        F.max(F.when(F.col("_start") == 1, F.col("_v"))).alias("_v1"),
        F.max(F.when(F.col("_start") == 1, F.col("_next"))).alias("_v2"),
        F.count(F.lit(1)).alias("_rows"),
        *[_first_known(c, "_seq") for c in first_of],
        *([F.count(event_type).alias("_types")] if has_type else []),
        *([F.max("_size").alias("_size")] if has_size else []))
    return runs.where(F.col("_on") | (F.col("_run") == 1) | F.col("_last_run"))


def chain_runs(runs: DataFrame, entity: str = "fips_code", snapshot_minutes: float = 15,
               gap_multiplier: float = 2) -> DataFrame:
    """Runs joined across bucket edges to blocks. Inner runs pass through; one shuffle of the runs.

    ``_open`` marks the entity's last block, which later rows may continue.
    """
    gap_us = F.lit(int(gap_multiplier * snapshot_minutes * 60_000_000))
    first_of = [c for c in runs.columns if c not in (entity, *RUN_COLUMNS)]
    edge = (F.col("_run") == 1) | F.col("_last_run")
    lanes = runs.withColumn("_lane", F.when(~edge, F.col("_bucket")))
    chain = Window.partitionBy(entity, "_lane").orderBy("_bucket", "_run")
    before = F.lag("_bucket").over(chain)
    lanes = lanes.withColumn("_start", F.when(
        before.isNull() | (before == F.col("_bucket")) | (F.lag("_on").over(chain) != F.col("_on"))
        | (F.col("_first_us") - F.lag("_last_us").over(chain) > gap_us), 1).otherwise(0))
    lanes = lanes.withColumns({
        "_block": F.sum("_start").over(chain.rowsBetween(Window.unboundedPreceding, 0)),
        "_blocks": F.sum("_start").over(Window.partitionBy(entity, "_lane")),
        "_v2": F.coalesce("_v2", F.when(F.lead("_start").over(chain) == 0, F.lead("_v1").over(chain)))})
    return lanes.groupBy(entity, "_lane", "_block").agg(
        F.max("_on").alias("_on"), F.min("_first_us").alias("_first_us"), F.max("_last_us").alias("_last_us"),
        F.min("_t0").alias("_t0"), F.max("_t1").alias("_t1"), F.max("_peak").alias("_peak"),
        F.min_by("_v1", "_bucket").alias("_v1"), F.min_by("_v2", "_bucket").alias("_v2"),
        F.sum("_rows").alias("_rows"), F.max("_bucket").alias("_bucket"),
        (F.col("_lane").isNull() & (F.max("_blocks") == F.col("_block"))).alias("_open"),
        *[_first_known(c, "_bucket") for c in first_of],
        *([F.sum("_types").alias("_types")] if "_types" in runs.columns else []),
        *([F.max("_size").alias("_size")] if "_size" in runs.columns else [])).drop("_lane", "_block")


def finish_events(blocks: DataFrame, entity: str = "fips_code", snapshot_minutes: float = 15,
                  event_type: str = "event_type", also: Sequence[str] = ()) -> DataFrame:
    """Blocks to events: duration, growth and weather columns under their final names."""
    first_of = [c for c in blocks.columns if c not in (entity, "_open", *RUN_COLUMNS, event_type, *also)]
    initial = F.col("_v1")
    delta = F.coalesce(F.col("_v2"), initial) - initial
    cols = [F.col(entity), F.col("_t0").alias("start_time"), F.col("_t1").alias("end_time"),
            F.col("_peak").alias("peak_customers_affected"), initial.alias("initial_customers_affected"),
            F.col("_rows").alias("snapshot_count"), *first_of]
    if event_type in blocks.columns:
        cols += [F.col(event_type), F.col("_types").alias("weather_event_count"),
                 (F.col("_types") > 0).cast("int").alias("has_weather_event")]
    if "_size" in blocks.columns:
        cols += [F.coalesce(F.col("_size"), F.lit(0.0)).alias("max_magnitude"),
                 F.col("_size").isNull().cast("int").alias("magnitude_missing")]
    return blocks.select(
        *cols, ((F.col("_last_us") - F.col("_first_us")) / F.lit(60_000_000.0) + F.lit(snapshot_minutes)).alias("duration_minutes"),
        delta.alias("delta_customers_affected_15m"),
        (delta / F.greatest(initial, F.lit(1))).cast("double").alias("pct_growth_15m"), *also)


def outage_rows(df: DataFrame, value: str = "customers_affected") -> DataFrame:
    """Readings with customers out; unknown counts are none."""
    require_columns(df, [value])
    return df.where(F.col(value) > 0)


def entity_time_places(df: DataFrame, entity: str = "fips_code", ts: str = "run_start_time",
                       tiebreak: Sequence[str] | None = None, name: str = "place") -> DataFrame:
    """Each row's place in its entity's order of time. Rows of an entity are sorted in as many tasks as they need."""
    return numbered(df, [entity], [ts, *_ties(df, tiebreak, [entity, ts])], name)


def sort_entity_time(df: DataFrame, entity: str = "fips_code", ts: str = "run_start_time",
                     tiebreak: Sequence[str] | None = None) -> DataFrame:
    """Rows by entity and time, equal ones by ``tiebreak`` (by default all other columns that have an order)."""
    return df.orderBy(entity, ts, *_ties(df, tiebreak, [entity, ts]))


def valid_durations(events: DataFrame, low: float = 0, high: float = 10080) -> DataFrame:
    require_columns(events, ["duration_minutes"])
    return events.where((F.col("duration_minutes") > low) & (F.col("duration_minutes") <= high))


def duration_rejects(events: DataFrame, low: float = 0, high: float = 10080) -> DataFrame:
    """Counts behind ``valid_durations``: kept, removed, not above zero, too long, unknown."""
    d = F.col("duration_minutes")
    kept = F.count_if((d > low) & (d <= high))
    return events.agg(
        kept.alias("kept"), (F.count(F.lit(1)) - kept).alias("removed"),
        F.count_if(d <= 0).alias("non_positive"), F.count_if(d > high).alias("too_long"),
        F.count_if(d.isNull()).alias("unknown"))


def valid_scopes(events: DataFrame, low: float = 0) -> DataFrame:
    require_columns(events, ["peak_customers_affected"])
    return events.where(F.col("peak_customers_affected") > low)


def duration_category(events: DataFrame, threshold: float = 240) -> DataFrame:
    require_columns(events, ["duration_minutes"])
    return events.withColumn("is_short_outage", F.col("duration_minutes") < threshold)


def scope_category(events: DataFrame, threshold: float = 500) -> DataFrame:
    require_columns(events, ["peak_customers_affected"])
    return events.withColumn("is_small_outage", F.col("peak_customers_affected") < threshold)


# -- entity history -----------------------------------------------------------------------------

def duration_history(events: DataFrame, entity: str = "fips_code", long_minutes: float = 240) -> DataFrame:
    return group_quantiles(events, [entity], "duration_minutes", {"county_median_duration": 0.5},
                           {"county_long_rate": F.col("_v") >= long_minutes})


def scope_history(events: DataFrame, entity: str = "fips_code", large: float = 500) -> DataFrame:
    found = group_quantiles(events, [entity], "peak_customers_affected", {"county_median_scope": 0.5},
                            {"county_large_outage_rate": F.col("_v") >= large}, "county_max_customers")
    return found.withColumn("county_max_customers", F.greatest("county_max_customers", F.lit(1)))


def entity_stats(events: DataFrame, entity: str = "fips_code", long_minutes: float = 240,
                 large: float = 500) -> DataFrame:
    """The five history features per entity, over the events given, in one pass over them."""
    measures = events.select(entity, F.expr(
        "stack(2, 'd', double(duration_minutes), 'p', double(peak_customers_affected))"
        " as (_measure, _value)"))
    is_d = F.col("_measure") == "d"
    found = group_quantiles(
        measures, [entity, "_measure"], "_value", {"_median": 0.5},
        {"_rate": F.col("_v") >= F.when(is_d, long_minutes).otherwise(large)}, "_max")
    return found.groupBy(entity).agg(
        F.max(F.when(is_d, F.col("_median"))).alias("county_median_duration"),
        F.max(F.when(is_d, F.col("_rate"))).alias("county_long_rate"),
        F.max(F.when(~is_d, F.col("_median"))).alias("county_median_scope"),
        F.max(F.when(~is_d, F.col("_rate"))).alias("county_large_outage_rate"),
        F.greatest(F.max(F.when(~is_d, F.col("_max"))), F.lit(1.0)).alias("county_max_customers"))


def add_history(events: DataFrame, history: DataFrame, entity: str = "fips_code",
                fill: float | None = None) -> DataFrame:
    out = spread_join(events, history, [entity])
    if fill is None:
        return out
    return out.fillna(fill, [c for c in history.columns if c != entity])
