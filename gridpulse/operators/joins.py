"""Relational joins: interval expansion, zones, daily panels, interval flags, nearest neighbour."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from gridpulse.functions.columns import EARTH_RADIUS_KM, micros, require_columns, zfill
from gridpulse.functions.skew import running_totals, spread_join
from gridpulse.session import cut_lineage


def expand_intervals(intervals: DataFrame, entity: str = "fips_code", begin: str = "begin_date",
                     end: str = "end_date", keep: Sequence[str] = ("event_type", "magnitude"),
                     cap_days: int = 7, calendar_days: bool = False) -> DataFrame:
    """One row per (entity, date, kept columns) an interval reaches, duplicates removed.

    Days are counted in 24-hour steps from the begin time, so 23:00 to 01:00 reaches one day only;
    ``calendar_days`` counts every date touched instead. Ends are capped at ``cap_days``.
    """
    require_columns(intervals, [entity, begin])
    kept = [c for c in keep if c in intervals.columns]
    start = F.col(begin).cast("timestamp_ntz")
    stop = F.coalesce(F.col(end).cast("timestamp_ntz"), start) if end in intervals.columns else start
    stop = F.least(stop, start + F.make_dt_interval(F.lit(cap_days)))
    if calendar_days:
        start, stop = start.cast("date"), stop.cast("date")
    spans = intervals.select(entity, *kept, start.alias("_b"), stop.alias("_e")).where(
        F.col("_e") >= F.col("_b"))
    days = F.explode(F.expr("sequence(_b, _e, interval 1 day)"))
    return (spans.select(entity, *kept, days.alias("_d"))
            .select(entity, F.col("_d").cast("date").alias("date"), *kept).distinct())


def interval_join(snapshots: DataFrame, intervals: DataFrame, entity: str = "fips_code",
                  ts: str = "run_start_time", **options) -> DataFrame:
    """Left join of snapshots with every interval row that reaches their day (fans out)."""
    require_columns(snapshots, [entity, ts])
    require_columns(intervals, [entity, options.get("begin", "begin_date"), "event_type"])
    days = expand_intervals(intervals, entity, **options)
    dated = snapshots.withColumn("date", F.to_date(ts))
    return spread_join(dated, days, [entity, "date"]).drop("date")


def expand_zones(events: DataFrame, zone_map: DataFrame, zone: str = "cz_fips",
                 kind: str = "cz_type", code: str = "fips_code") -> DataFrame:
    """Zone rows get one copy per mapped county (unmapped zones go); other rows stay as they are."""
    if kind not in events.columns:
        return events
    is_zone = F.coalesce(F.upper(kind) == "Z", F.lit(False))
    counties = zone_map.select(F.col("zone").alias(zone), F.col("fips_code").alias("_code")).distinct()
    mapped = spread_join(events.where(is_zone), counties, [zone], "inner")
    mapped = mapped.drop(code).withColumnRenamed("_code", code)
    return events.where(~is_zone).unionByName(mapped.select(*events.columns))


def zone_lists(zone_map: DataFrame) -> DataFrame:
    """Zone to its sorted list of county codes (a dimension: a zone holds few counties)."""
    pairs = zone_map.select("zone", "fips_code").distinct()
    return pairs.groupBy("zone").agg(F.sort_array(F.collect_list("fips_code")).alias("fips_codes"))


def join_daily(snapshots: DataFrame, daily: DataFrame, entity: str = "fips_code",
               ts: str = "run_start_time") -> DataFrame:
    """Each snapshot gets its entity-day's weather, null when the day is missing."""
    require_columns(snapshots, [entity, ts])
    dated = snapshots.withColumn("date", F.to_date(ts))
    return spread_join(dated, daily, [entity, "date"]).drop("date")


def join_on_date(snapshots: DataFrame, daily: DataFrame, ts: str = "run_start_time") -> DataFrame:
    """Join on the date alone; fans out over all entities of the day."""
    return spread_join(snapshots.withColumn("date", F.to_date(ts)), daily, ["date"])


def label_panel(daily: DataFrame, labels: DataFrame, entity: str = "fips_code") -> DataFrame:
    """Every weather day with its label; days without outage rows count as 0. Unique keys, no salt."""
    for c in (entity, "date"):
        require_columns(daily, [c])
        require_columns(labels, [c])
    keep = labels.select(entity, "date", "outage_occurred", "max_customers_affected")
    joined = daily.join(keep, [entity, "date"], "left")
    return joined.withColumns({
        "outage_occurred": F.coalesce("outage_occurred", F.lit(0)).cast("int"),
        "max_customers_affected": F.coalesce("max_customers_affected", F.lit(0)).cast("long")})


def join_stats(rows: DataFrame, stats: DataFrame, entity: str = "fips_code", pad: int = 5,
               fill: float | None = 0.0) -> DataFrame:
    """Left join of the entity history, both keys zero-padded, gaps filled."""
    left = rows.withColumn(entity, zfill(entity, pad))
    right = stats.withColumn(entity, zfill(entity, pad))
    out = spread_join(left, right, [entity])
    names = [c for c in stats.columns if c != entity]
    return out if fill is None else out.fillna(fill, names)


def covered_stretches(intervals: DataFrame, begin: str = "event_start", end: str = "event_end") -> DataFrame:
    """(_from, _to) in microseconds, inclusive, apart from each other: what the intervals cover together, in pieces."""
    spans = intervals.select(micros(begin).alias("_from"), micros(end).alias("_to")).where("_to >= _from")
    line = running_totals(spans.groupBy("_from").agg(F.max("_to").alias("_to")), "_from", ["_to"], how="max")
    # An interval adds what lies behind the furthest end before it.
    new = line.select(F.greatest("_from", F.col("before__to") + 1).alias("_from"), "_to")
    return new.where("_to >= _from")


def interval_flag(rows: DataFrame, intervals: DataFrame, ts: str = "run_start_time",
                  begin: str = "event_start", end: str = "event_end", value: str = "customers_out") -> DataFrame:
    """``storm_event`` = does any interval, whatever its entity, hold the row's time (inclusive).

    The stretches that intervals cover together are stored once and cut at the edges of time cells, as many cells as
    there are stretches; a row looks into its own cell. Rows and intervals are each read once.
    """
    stretches = cut_lineage(covered_stretches(intervals, begin, end), "stretches")
    size = stretches.agg(F.count(F.lit(1)).alias("n"), F.min("_from").alias("a"), F.max("_to").alias("b")).first()
    width = max(1, (size.b - size.a) // size.n + 1) if size.n else 1
    cells = stretches.withColumn("_cell", F.explode(F.expr(f"sequence(_from div {width}, _to div {width})")))
    us = rows.withColumn("_us", micros(ts)).withColumn("_at", F.expr(f"_us div {width}"))
    marked = us.join(cells, F.expr("_at = _cell AND _us BETWEEN _from AND _to"), "left")
    return marked.withColumns({
        "storm_event": F.col("_cell").isNotNull().cast("int"),
        "outage_occurred": F.coalesce(F.col(value) > 0, F.lit(False)).cast("int")}).drop("_us", "_at", "_cell", "_from", "_to")


# -- nearest neighbour --------------------------------------------------------------------------

FEW_CENTERS = 4096          # centers that travel with the plan at most
SHARD = 512                 # centers of a shard, until there are ``SHARDS``
SHARDS = 4096
PART = 50_000               # places that meet a shard's centers in one task
BLOCK = 1 << 20             # distances held at a time


def nearest(points: DataFrame, centers: DataFrame, point_id: str, center_id: str,
            lat: str = "lat", lon: str = "lon", center_lat: str = "lat", center_lon: str = "lon",
            few: int = FEW_CENTERS, shard: int = SHARD) -> DataFrame:
    """Adds the closest center's id and ``dist_km`` to each point; equal distances: lowest id; null without a place.

    Up to ``few`` centers go to the points, which then stay where they are. More are dealt to shards along a curve
    that keeps neighbours together. What travels is a box around each shard, at most ``SHARDS`` of them: a place meets
    the shards that, by their boxes, may hold its nearest center, in an equi join whose hot shards are split. Boxes are
    drawn around points of the unit sphere, which knows neither poles nor date line. Both ways are exact. Different
    places are looked up once; points are not identified, so repeated and null ids keep their own result.
    """
    places = centers.select(F.col(center_id).alias("_id"), F.col(center_lat).cast("double").alias("_lat"),
                            F.col(center_lon).cast("double").alias("_lon")).where("_lat = _lat AND _lon = _lon AND NOT isnan(_lat) AND NOT isnan(_lon)")
    kind = places.schema["_id"].dataType
    some = places.limit(few + 1).toArrow()
    if some.num_rows <= few:
        found = _nearest_of_few(points, some, kind, lat, lon)
    else:
        found = _nearest_by_shards(points, places, kind, lat, lon, shard)
    return found.withColumnsRenamed({"_best_id": f"nearest_{center_id}", "_best_km": "dist_km"})


def _unit(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Points of the unit sphere, one row each."""
    a, b = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)], axis=1)


def _by_id(table: pa.Table) -> pa.Table:
    """Centers in the order of their ids, null first, so that the first of equal distances is the one to take."""
    ids = table.column("_id").to_pylist()
    return table.take(pa.array(sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i])), pa.int64()))


def _closest(lat: np.ndarray, lon: np.ndarray, centers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(row of the nearest center, kilometres) of each place."""
    c_lat, c_lon = (np.radians(centers.column(c).to_numpy()) for c in ("_lat", "_lon"))
    cos_c, best, far = np.cos(c_lat), np.empty(len(lat), np.int64), np.empty(len(lat))
    step = max(1, BLOCK // max(1, len(c_lat)))
    for at in range(0, len(lat), step):
        a, b = np.radians(lat[at:at + step, None]), np.radians(lon[at:at + step, None])
        h = np.sin((c_lat - a) / 2) ** 2 + np.cos(a) * cos_c * np.sin((c_lon - b) / 2) ** 2
        best[at:at + step] = h.argmin(1)
        far[at:at + step] = 2 * EARTH_RADIUS_KM * np.arcsin(np.sqrt(np.minimum(h.min(1), 1.0)))
    return best, far


def _nearest_of_few(points: DataFrame, centers: pa.Table, kind, lat: str, lon: str) -> DataFrame:
    held = points.select("*", F.col(lat).cast("double").alias("_best_lat"), F.col(lon).cast("double").alias("_best_lon"))
    shape = points.withColumns({"_best_id": F.lit(None).cast(kind), "_best_km": F.lit(None).cast("double")}).schema
    wire, centers = to_arrow_schema(shape), _by_id(centers)

    def run(batches):
        for batch in batches:
            own_lat, own_lon = (np.asarray(batch.column(i - 2).to_numpy(zero_copy_only=False), float) for i in (0, 1))
            known = ~(np.isnan(own_lat) | np.isnan(own_lon)) & (centers.num_rows > 0)
            rows, far = np.full(batch.num_rows, -1), np.full(batch.num_rows, np.nan)
            if known.any():
                rows[known], far[known] = _closest(own_lat[known], own_lon[known], centers)
            at = pa.array(rows, pa.int64(), mask=~known)
            ids = centers.column("_id").combine_chunks().take(at)
            columns = [*batch.columns[:-2], ids, pa.array(far, pa.float64(), mask=~known)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, wire)], schema=wire)

    return held.mapInArrow(run, shape)


def _curve(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Place along a curve through a grid of half-degree-thousandths: interleaved bits of the two coordinates."""
    out = np.zeros(len(lat), np.int64)
    y, x = (np.clip((v + shift) / span * (1 << 24), 0, (1 << 24) - 1).astype(np.int64)
            for v, shift, span in ((lat, 90, 180), (lon % 360, 0, 360)))
    for bit in range(24):
        out |= (y >> bit & 1) << (2 * bit + 1) | (x >> bit & 1) << (2 * bit)
    return out


def _nearest_by_shards(points: DataFrame, centers: DataFrame, kind, lat: str, lon: str, shard: int) -> DataFrame:
    def numbered(cuts: np.ndarray | None):
        def run(batches):
            for batch in batches:
                a, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_lat", "_lon"))
                curve = _curve(a, b)
                number = curve if cuts is None else np.searchsorted(cuts, curve, side="right")
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(number, pa.int64()), *map(pa.array, _unit(a, b).T)],
                                                 names=[*batch.schema.names, "_shard", "_x", "_y", "_z"])
        return run

    shape = centers.withColumns({"_shard": F.lit(0).cast("long"), **{c: F.lit(0.0) for c in ("_x", "_y", "_z")}}).schema
    curve = centers.mapInArrow(numbered(None), shape)
    count = centers.count()
    number = min(SHARDS, max(1, count // shard))
    shares = ",".join(repr(i / number) + "D" for i in range(1, number))
    cuts = curve.agg(F.expr(f"percentile_approx(_shard, array({shares}), {4 * number})")).first()[0] if number > 1 else []
    dealt = cut_lineage(centers.mapInArrow(numbered(np.unique(np.array(cuts, np.int64))), shape), "centers")
    boxes = dealt.groupBy("_shard").agg(*[f(c).alias(f"{n}{c}") for c in ("_x", "_y", "_z") for n, f in (("low", F.min), ("high", F.max))],
                                        F.min_by(F.struct("_x", "_y", "_z"), F.xxhash64("_lat", "_lon")).alias("_one")).collect()
    numbers = np.array([r["_shard"] for r in boxes])
    low, high = (np.array([[r[f"{n}{c}"] for c in ("_x", "_y", "_z")] for r in boxes]) for n in ("low", "high"))
    one = np.array([list(r["_one"]) for r in boxes])

    def candidates(batches):
        for batch in batches:
            a, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_lat", "_lon"))
            place, out = _unit(a, b), []
            for at in range(0, len(place), max(1, BLOCK // len(numbers) // 4)):
                some = place[at:at + max(1, BLOCK // len(numbers) // 4), None, :]
                least = (np.maximum(np.maximum(low - some, some - high), 0.0) ** 2).sum(2)
                reach = ((one - some) ** 2).sum(2).min(1)
                who, where = np.nonzero(least <= reach[:, None] * (1 + 1e-9) + 1e-18)
                out.append((who + at, numbers[where]))
            who = np.concatenate([w for w, _ in out]) if out else np.empty(0, np.int64)
            where = np.concatenate([s for _, s in out]) if out else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([c.take(pa.array(who)) for c in batch.columns] + [pa.array(where, pa.int64())],
                                             names=[*batch.schema.names, "_shard"])

    asked = points.select(F.col(lat).cast("double").alias("_lat"), F.col(lon).cast("double").alias("_lon")).where(
        "_lat IS NOT NULL AND _lon IS NOT NULL AND NOT isnan(_lat) AND NOT isnan(_lon)").distinct()
    asked = cut_lineage(asked.mapInArrow(candidates, "_lat double, _lon double, _shard long"), "nearest-asked")
    # A shard that many places ask for is repeated: its places are dealt to parts.
    parts = asked.groupBy("_shard").agg(F.ceil(F.count(F.lit(1)) / PART).cast("long").alias("_parts"))
    salted = spread_join(asked, parts, ["_shard"], "inner").withColumn(
        "_part", F.pmod(F.xxhash64("_lat", "_lon"), F.col("_parts"))).drop("_parts")
    repeated = dealt.join(parts, "_shard").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
    result = asked.select("_lat", "_lon").withColumns({"_best_id": F.lit(None).cast(kind), "_best_km": F.lit(0.0)}).schema
    wire = to_arrow_schema(result)

    def meet(here: pa.Table, there: pa.Table) -> pa.Table:
        if not here.num_rows or not there.num_rows:
            return wire.empty_table()
        there = _by_id(there)
        rows, far = _closest(here.column("_lat").to_numpy(), here.column("_lon").to_numpy(), there)
        return pa.table([here.column("_lat"), here.column("_lon"), there.column("_id").take(pa.array(rows)), pa.array(far)],
                        names=wire.names).cast(wire)

    keys = ["_shard", "_part"]
    met = salted.groupBy(*keys).cogroup(repeated.select(*keys, "_id", "_lat", "_lon").groupBy(*keys)).applyInArrow(meet, result)
    best = met.groupBy("_lat", "_lon").agg(F.min(F.struct("_best_km", "_best_id")).alias("_best"))
    held = points.withColumns({"_lat": F.col(lat).cast("double"), "_lon": F.col(lon).cast("double")})
    return spread_join(held, best, ["_lat", "_lon"]).select(
        *points.columns, F.col("_best._best_id").alias("_best_id"), F.col("_best._best_km").alias("_best_km"))


def map_stations(stations: DataFrame, counties: DataFrame) -> DataFrame:
    """Station to nearest county, distance to one decimal."""
    near = nearest(stations, counties, "station_id", "fips_code", "lat", "lon", "latitude", "longitude")
    return near.select("station_id", F.col("name").alias("station_name"),
                       F.col("nearest_fips_code").alias("fips_code"),
                       F.round("dist_km", 1).alias("dist_km"))


def missing_entities(entities: DataFrame, rows: DataFrame, entity: str = "fips_code") -> DataFrame:
    return spread_join(entities, rows.select(entity).distinct(), [entity], "left_anti")


def fill_from_nearest(rows: DataFrame, geo: DataFrame, columns: Sequence[str],
                      entity: str = "fips_code", day: str | None = None) -> DataFrame:
    """Entities without a row copy the nearest entity's values and are marked as filled.

    With no row at all every entity gets zeros. ``day`` keeps one row per entity and day.
    """
    have = rows.select(entity).distinct()
    known = geo.join(have, entity, "left_semi")
    failed = geo.join(have, entity, "left_anti")
    source = nearest(failed, known, entity, entity, "latitude", "longitude", "latitude", "longitude")
    source = source.select(F.col(entity).alias("_target"), F.col(f"nearest_{entity}").alias(entity))
    extra = [day] if day else []
    values = rows.select(entity, *extra, *columns)
    # Many targets may copy from one entity: such a join is split by its targets.
    copied = spread_join(source, values, [entity]).select(
        F.col("_target").alias(entity), *extra,
        *[F.coalesce(c, F.lit(0)).cast(values.schema[c].dataType).alias(c) for c in columns],
        F.lit(1).alias("magnitude_missing"))
    return values.withColumn("magnitude_missing", F.lit(0)).unionByName(copied)


def skip_done(entities: DataFrame, target: DataFrame, key: str = "fips_code") -> DataFrame:
    """Entities the target does not hold yet."""
    return spread_join(entities, target.select(key).distinct(), [key], "left_anti")
