"""Readers: explicit schemas, no inference, filters that Spark can push into the scan."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridpulse.functions.columns import (fixed_width, json_number, lookup, number_in_name, parse_date,
                                         parse_timestamp, require_columns, to_count, zfill)
from gridpulse.functions.skew import spread_join
from gridpulse.functions.weather import cm_to_mm, code_flags, m_to_mm, to_ms
from gridpulse.operators.joins import expand_zones
from gridpulse.operators.rollups import quality_filter, union_years
from gridpulse.session import open_store

Paths = str | Sequence[str]

# File layouts.
ZONE_COLUMNS = ("state_abbr", "zone", "cwa", "zone_name", "state_zone", "county_name", "fips_code",
                "timezone", "fe_area", "lat", "lon")
OBS_COLUMNS = ("station_id", "date", "element", "value", "m_flag", "q_flag", "s_flag", "obs_time")
STATS_COLUMNS = ("county_median_duration", "county_long_rate", "county_median_scope",
                 "county_large_outage_rate", "county_max_customers")
DATE_FORMATS = ("dd-MMM-yy HH:mm:ss", "MM/dd/yyyy HH:mm", "MM/dd/yyyy", "M/d/yyyy H:mm")
STATE_CODES = {"VA": "51"}
NAME_PATTERN = r"StormEvents_details-ftp_v1\.0_d(\d{4})_c\d+\.csv\.gz"


def _strings(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def files_by_header(spark: SparkSession, paths: Sequence[str]) -> dict[str, list[str]]:
    """Header line to the files that begin with it. Files, folders and globs; only first lines are read here.

    Spark lists the files, tasks read a first line each, and files come back grouped by it: no call per file.
    """
    try:
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths)).select("path")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return {}
        raise
    names = ["header", "path"]

    def first_lines(batches):
        for batch in batches:
            found = [(line, path) for path in batch.column(0).to_pylist() if (line := _first_line(path)) is not None]
            yield pa.RecordBatch.from_pydict({n: pa.array([f[i] for f in found], pa.string()) for i, n in enumerate(names)})

    tasks = max(1, min(spark.sparkContext.defaultParallelism * 4, 512))
    rows = listed.repartition(tasks, "path").mapInArrow(first_lines, "header string, path string")
    layouts = rows.groupBy("header").agg(F.sort_array(F.collect_list("path")).alias("files"))
    return {r.header: r.files for r in layouts.orderBy(F.get("files", F.lit(0))).collect()}


def _first_line(path: str) -> str | None:
    """The first line of a text file, compressed or not; None if it is empty."""
    store, place = open_store(path)
    held = b""
    with store.open_input_stream(place, compression="detect") as stream:
        while b"\n" not in held and (more := stream.read(1 << 16)):
            held += more
    return held.split(b"\n")[0].rstrip(b"\r").decode("utf-8", "replace") if held else None


def read_delimited(spark: SparkSession, paths: Paths, sep: str = ",") -> DataFrame:
    """Header files with all columns as text, each read by its own header.

    Files with the same header are one scan; columns of the others line up by name, missing ones are null.
    """
    many = [paths] if isinstance(paths, str) else list(paths)
    reader = spark.read.option("header", True).option("sep", sep).option("inferSchema", False)
    layouts = files_by_header(spark, many)
    return union_years([reader.csv(files) for files in layouts.values()]) if layouts else reader.csv(many)


def in_state(column: str, spelling: str, exact: bool = False) -> Column:
    return F.col(column) == spelling if exact else F.lower(column) == spelling.lower()


def normalise_snapshots(raw: DataFrame, state: str | None = "virginia", drop_null_ts: bool = False) -> DataFrame:
    """Customer count from ``customers_out`` or ``sum``, padded code, parsed time, one state."""
    require_columns(raw, ["fips_code", "county", "state", "run_start_time"])
    counts = [F.col(c).cast("string") for c in ("customers_out", "sum", "customers_affected")
              if c in raw.columns]
    rows = raw if state is None else raw.where(in_state("state", state))
    gone = [c for c in ("customers_out", "sum", "customers_affected") if c in raw.columns]
    out = rows.withColumns({
        "_count": to_count(F.coalesce(*counts)) if counts else F.lit(0).cast("long"),
        "run_start_time": parse_timestamp("run_start_time"), "fips_code": zfill("fips_code", 5),
    }).drop(*gone).withColumnRenamed("_count", "customers_affected")
    return out.where(F.col("run_start_time").isNotNull()) if drop_null_ts else out


def load_snapshots(spark: SparkSession, paths: Paths, state: str | None = "virginia") -> DataFrame:
    return normalise_snapshots(read_delimited(spark, paths), state)


def load_snapshots_strict(spark: SparkSession, paths: Paths) -> DataFrame:
    """Rows with an unusable time are dropped; codes and states stay as they come."""
    raw = read_delimited(spark, paths).withColumn("run_start_time", parse_timestamp("run_start_time"))
    return raw.where(F.col("run_start_time").isNotNull())


def normalise_intervals(raw: DataFrame, zone_map: DataFrame | None = None) -> DataFrame:
    """Both storm-event layouts to begin, end, type, county code; zones expanded to counties."""
    df = raw.toDF(*[c.lower() for c in raw.columns])
    for old, new, unless in (("begin_date_time", "begin_date", "begin_date"),
                             ("end_date_time", "end_date", "end_date"),
                             ("state_fips", "state_fips_code", "state_abbr")):
        if old in df.columns and unless not in df.columns:
            df = df.withColumnRenamed(old, new)
    require_columns(df, ["begin_date", "event_type", "cz_fips"])
    for c in ("begin_date", "end_date"):
        if c in df.columns:
            df = df.withColumn(c, parse_timestamp(c, DATE_FORMATS))
    df = df.withColumn("cz_fips", zfill("cz_fips", 3))
    if "state_fips_code" in df.columns:
        prefix = zfill("state_fips_code", 2)
    elif "state_abbr" in df.columns:
        prefix = lookup("state_abbr", STATE_CODES)
    else:
        raise ValueError("need state_fips or state_abbr to build the county code")
    df = df.withColumn("fips_code", F.concat(prefix, F.col("cz_fips")))
    return df if zone_map is None else expand_zones(df, zone_map)


def load_interval_events(spark: SparkSession, paths: Paths, zone_map: DataFrame | None = None) -> DataFrame:
    return normalise_intervals(read_delimited(spark, paths), zone_map)


def load_intervals_simple(spark: SparkSession, path: Paths) -> DataFrame:
    raw = read_delimited(spark, path)
    names = {c.lower(): c for c in raw.columns}
    return raw.withColumnsRenamed({names["begin_date_time"]: "event_start", names["end_date_time"]: "event_end"}
                                  ).withColumns({c: parse_timestamp(c, DATE_FORMATS)
                                                 for c in ("event_start", "event_end")})


def load_zone_county(spark: SparkSession, path: Paths, state: str = "VA", cache: str | None = None) -> DataFrame:
    """Pipe-delimited, no header, all text; ``cache`` stores the result as Parquet."""
    raw = spark.read.schema(_strings(ZONE_COLUMNS)).option("sep", "|").csv(path)
    out = raw.where(F.col("state_abbr") == state).select("zone", "fips_code", "zone_name", "county_name")
    if cache:
        out.write.mode("overwrite").parquet(cache)
        return spark.read.schema(out.schema).parquet(cache)
    return out


def load_daily_weather(spark: SparkSession, path: Paths) -> DataFrame:
    """Entity-day weather: code as text, date only, flags whole, readings as numbers."""
    raw = read_delimited(spark, path)
    cols = []
    for c in raw.columns:
        if c == "fips_code":
            cols.append(F.col(c))
        elif c == "date":
            cols.append(parse_date(c).alias(c))
        else:
            cols.append(F.col(c).try_cast("double").cast("int" if c.startswith("wt_") else "double").alias(c))
    return raw.select(*cols)


def load_entity_stats(spark: SparkSession, path: Paths) -> DataFrame:
    """The history table; an empty one with the same columns when the file does not exist."""
    schema = T.StructType([T.StructField("fips_code", T.StringType()),
                           *[T.StructField(c, T.DoubleType()) for c in STATS_COLUMNS]])
    try:
        return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], schema)


def load_centroids(spark: SparkSession, path: Paths, state: str = "VA") -> DataFrame:
    """Tab-separated with padded header names."""
    raw = read_delimited(spark, path, "\t")
    named = raw.toDF(*[c.strip() for c in raw.columns])
    return named.where(F.trim("USPS") == state).select(
        F.col("GEOID").alias("fips"), F.col("NAME").alias("county_name"),
        F.trim("INTPTLAT").try_cast("double").alias("latitude"),
        F.trim("INTPTLONG").try_cast("double").alias("longitude"))


def parse_station_list(lines: DataFrame, state: str = "VA", line: str = "value") -> DataFrame:
    """Fixed-width station list; short lines, other states and bad coordinates are skipped."""
    return lines.where(F.length(line) >= 40).select(
        fixed_width(line, 0, 11).alias("station_id"),
        fixed_width(line, 12, 20).try_cast("double").alias("lat"),
        fixed_width(line, 21, 30).try_cast("double").alias("lon"),
        fixed_width(line, 38, 40).alias("state"), fixed_width(line, 41, 71).alias("name"),
    ).where((F.col("state") == state) & F.col("lat").isNotNull() & F.col("lon").isNotNull())


def load_station_list(spark: SparkSession, path: Paths, state: str = "VA") -> DataFrame:
    return parse_station_list(spark.read.text(path), state)


def scan_station_obs(spark: SparkSession, paths: Paths, stations: DataFrame | None = None,
                     partitions: int | None = None) -> DataFrame:
    """Long observations, scaled, quality-checked, limited to known stations.

    A gz file cannot be split: pass ``partitions`` to spread its rows right after the scan.
    """
    obs = spark.read.schema(_strings(OBS_COLUMNS)).csv(paths)
    obs = obs.where(F.col("station_id").isNotNull() & F.col("element").isNotNull())
    if partitions:
        obs = obs.repartition(partitions)
    if stations is not None:
        obs = station_members(obs, stations)
    return quality_filter(obs)


def station_members(obs: DataFrame, stations: DataFrame) -> DataFrame:
    """Observations of listed stations only."""
    return spread_join(obs, stations.select("station_id").distinct(), ["station_id"], "left_semi")


def scan_interval_events_bulk(spark: SparkSession, paths: Paths, state: str = "VIRGINIA") -> DataFrame:
    raw = read_delimited(spark, paths)
    return raw.where(F.upper("STATE") == state) if "STATE" in raw.columns else raw


def scan_snapshots_bulk(spark: SparkSession, paths: Paths, state: str = "Virginia") -> DataFrame:
    return read_delimited(spark, paths).where(in_state("state", state, exact=True))


def kept_per_year(snapshots: DataFrame, ts: str = "run_start_time") -> DataFrame:
    return snapshots.groupBy(F.year(parse_timestamp(ts)).alias("year")).agg(F.count(F.lit(1)).alias("kept"))


def latest_file_per_year(listing: DataFrame, name: str = "name", pattern: str = NAME_PATTERN) -> DataFrame:
    """The last matching file name in sort order for each year."""
    found = F.regexp_extract(name, f"({pattern})", 1)
    return (listing.select(found.alias("file"), number_in_name(found, pattern).alias("year"))
            .where(F.col("year").isNotNull()).groupBy("year").agg(F.max("file").alias("file")))


def catalog_files(listing: DataFrame, name: str = "name", prefix: str = "eaglei_outages_",
                  suffix: str = ".csv") -> DataFrame:
    """Yearly snapshot files; names without a usable year are skipped."""
    middle = F.expr(f"substr(`{name}`, {len(prefix) + 1}, length(`{name}`) - {len(prefix) + len(suffix)})")
    return listing.where(F.startswith(name, F.lit(prefix)) & F.endswith(name, F.lit(suffix))).select(
        F.col(name), middle.try_cast("int").alias("year")).where(F.col("year").isNotNull())


# -- raw JSON ------------------------------------------------------------------------------------

_DOUBLES = "array<double>"
HOURLY_SCHEMA = (
    "hourly struct<time:array<string>,temperature_2m:array<double>,precipitation:array<double>,"
    "snowfall:array<double>,snow_depth:array<double>,windspeed_10m:array<double>,"
    "windgusts_10m:array<double>,weathercode:array<double>>, "
    "daily struct<time:array<string>,temperature_2m_max:array<double>,temperature_2m_min:array<double>>"
)


def parse_weather_json(raw: DataFrame, body: str = "body", keep: Sequence[str] = ("fips_code",)) -> DataFrame:
    """Parallel arrays ``hourly`` and ``daily``; responses without ``hourly`` are dropped."""
    parsed = raw.select(*keep, F.from_json(body, HOURLY_SCHEMA).alias("_j"))
    return parsed.select(*keep, "_j.hourly", "_j.daily").where(F.col("hourly").isNotNull())


def explode_hours(parsed: DataFrame, keep: Sequence[str] = ("fips_code",)) -> DataFrame:
    """One row per hour, named as the archive rollup expects."""
    zipped = F.arrays_zip(*[F.col(f"hourly.{n}") for n in (
        "time", "temperature_2m", "precipitation", "snowfall", "snow_depth", "windspeed_10m",
        "windgusts_10m", "weathercode")])
    hours = parsed.select(*keep, F.explode(zipped).alias("h"))
    return hours.select(
        *keep, parse_timestamp("h.time").alias("time"), "h.temperature_2m", "h.precipitation",
        "h.snowfall", "h.snow_depth", F.col("h.windspeed_10m").alias("wind_speed_10m"),
        F.col("h.windgusts_10m").alias("wind_gusts_10m"), F.col("h.weathercode").alias("weather_code"))


def hourly_features(parsed: DataFrame, keep: Sequence[str] = ("fips_code",)) -> DataFrame:
    """Model-ready row per entity-hour: converted units, flags, severity proxy."""
    from gridpulse.operators.features import temporal_features
    tops = parsed.select(*keep, "hourly", F.get("daily.temperature_2m_max", F.lit(0)).alias("tmax_c"),
                         F.get("daily.temperature_2m_min", F.lit(0)).alias("tmin_c"))
    hours = explode_hours(tops, [*keep, "tmax_c", "tmin_c"])
    code = F.coalesce(F.col("weather_code").cast("int"), F.lit(0))
    rows = hours.select(
        *keep, "time", F.coalesce("precipitation", F.lit(0.0)).alias("prcp_mm"),
        cm_to_mm("snowfall").alias("snow_mm"), m_to_mm("snow_depth").alias("snwd_mm"), "tmax_c", "tmin_c",
        F.round(to_ms("wind_speed_10m"), 3).alias("awnd_ms"),
        F.round(to_ms("wind_gusts_10m"), 3).alias("wsfg_ms"),
        (code >= 95).cast("int").alias("has_weather_event"), F.lit(0).alias("magnitude_missing"),
        *code_flags(code))
    rows = rows.withColumn("max_magnitude", F.greatest("prcp_mm", "awnd_ms"))
    return temporal_features(rows, "time")


def parse_poll_json(raw: DataFrame, body: str = "body", keep: Sequence[str] = ("provider",)) -> DataFrame:
    """Poll records from ``file_data`` or a top-level array; a ``cust_a`` that is no object counts 0."""
    records = F.coalesce(F.get_json_object(body, "$.file_data"), F.col(body))
    # Each element stays text, so the two shapes of cust_a need no common type.
    each = raw.select(*keep, F.explode(F.from_json(records, "array<string>")).alias("_r"))
    return each.select(
        *keep, F.coalesce(F.get_json_object("_r", "$.title"), F.lit("")).alias("title"),
        json_number("_r", "$.desc.cust_a.val").alias("cust_a"),
        F.get_json_object("_r", "$.desc.cust_s").try_cast("double").alias("cust_s"),
        F.get_json_object("_r", "$.desc.n_out").try_cast("double").alias("n_out"))


def parse_regions(raw: DataFrame, body: str = "body", state: str = "51") -> DataFrame:
    """Region properties of a feature collection, one state."""
    schema = "features array<struct<properties:struct<GEOID:string,NAME:string,STATEFP:string>>>"
    each = raw.select(F.explode(F.from_json(body, schema)["features"]["properties"]).alias("p"))
    return each.select("p.*").where(F.col("STATEFP") == state)


def parse_header_array_json(raw: DataFrame, body: str = "body") -> DataFrame:
    """Array of arrays whose first row is the header: name, state, county."""
    each = raw.select(F.posexplode(F.from_json(body, "array<array<string>>")).alias("_pos", "_row"))
    return each.where("_pos > 0").select(*[
        F.get("_row", F.lit(i)).alias(n) for i, n in enumerate(("name", "state", "county"))])
