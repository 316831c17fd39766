"""Column helpers: text, numbers, time, geometry, arrays. All JVM built-ins."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")


# -- text ---------------------------------------------------------------------------------------

def zfill(c: Column | str, width: int) -> Column:
    """Left-pad with zeros; longer values stay whole (plain ``lpad`` would cut them)."""
    text = as_column(c).cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit("0"))


def clean_text(c: Column | str, remove: str | None = None) -> Column:
    """Lower-case, drop an optional fixed phrase, trim."""
    text = F.lower(as_column(c))
    if remove:
        text = F.replace(text, F.lit(remove), F.lit(""))
    return F.trim(text)


def fixed_width(c: Column | str, start: int, end: int) -> Column:
    """Trimmed characters ``[start, end)``, counted from zero."""
    return F.trim(F.substring(as_column(c), start + 1, end - start))


def number_in_name(c: Column | str, pattern: str, group: int = 1) -> Column:
    """A number captured from a file name; null when the name does not match."""
    return F.regexp_extract(as_column(c), pattern, group).try_cast("int")


# -- numbers ------------------------------------------------------------------------------------

def to_number(c: Column | str) -> Column:
    """Number or null; NaN counts as null."""
    value = as_column(c).try_cast("double")
    return F.when(~F.isnan(value), value)


def to_count(c: Column | str) -> Column:
    """Whole number, decimals cut off, unusable values 0."""
    return F.coalesce(to_number(c), F.lit(0.0)).cast("long")


def first_known(*candidates: Column | str | float) -> Column:
    """The first value that is neither null nor NaN; plain numbers may end the list."""
    def usable(c) -> Column:
        if not isinstance(c, (str, Column)):
            return F.lit(c)
        value = as_column(c)
        return F.when(~F.isnan(value.try_cast("double")) | value.try_cast("double").isNull(), value)

    return F.coalesce(*map(usable, candidates))


def clip(c: Column | str, low: float | None = None, high: float | None = None) -> Column:
    value = as_column(c)
    if low is not None:
        value = F.greatest(value, F.lit(low))
    if high is not None:
        value = F.least(value, F.lit(high))
    return value


def log_target(c: Column | str) -> Column:
    return F.log1p(as_column(c))


def exp_prediction(c: Column | str, bound: float = 20.0) -> Column:
    """Back from the log scale, with the exponent clipped first."""
    return F.expm1(clip(c, -bound, bound))


def sigmoid(c: Column | str) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-as_column(c)))


def safe_ratio(num: Column, den: Column, empty: float = 0.0) -> Column:
    return F.when(den != 0, num / den).otherwise(F.lit(empty))


# -- time ---------------------------------------------------------------------------------------

def parse_timestamp(c: Column | str, formats: Sequence[str] = ()) -> Column:
    """First format that fits, else ISO; null when nothing fits. The result has no time zone."""
    text = as_column(c).cast("string")

    def attempt(fmt: str) -> Column:
        found = F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz")
        if re.search("(?<!y)yy(?!y)", fmt):  # two-digit years from 69 on belong to the 1900s
            return F.when(F.year(found) >= 2069, found - F.make_ym_interval(F.lit(100))).otherwise(found)
        return found

    return F.coalesce(*map(attempt, formats), text.try_cast("timestamp_ntz"))


def parse_date(c: Column | str, fmt: str | None = None) -> Column:
    text = as_column(c).cast("string")
    if fmt:
        return F.try_to_timestamp(text, F.lit(fmt)).cast("date")
    return text.try_cast("date")


def micros(c: Column | str) -> Column:
    """Microseconds since 1970 on the clock that the timestamp shows, whatever the session's time zone.

    Through a time zone, hours that its clocks skip or repeat would change distances.
    """
    spark = SparkSession.getActiveSession()
    if spark is None or spark.conf.get("spark.sql.session.timeZone") in ("UTC", "Etc/UTC", "GMT", "Z"):
        return F.unix_micros(as_column(c).cast("timestamp"))
    since = as_column(c).cast("timestamp_ntz") - F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    return (since.cast("decimal(20,6)") * 1_000_000).cast("long")


def minutes_between(start: Column | str, end: Column | str) -> Column:
    return (micros(end) - micros(start)) / F.lit(60_000_000.0)


def to_day(c: Column | str) -> Column:
    """The date a timestamp shows on its clock."""
    return as_column(c).cast("timestamp_ntz").cast("date")


def weekday(c: Column | str) -> Column:
    """Monday = 0."""
    return F.weekday(as_column(c))


def daily_steps(begin: Column | str, end: Column | str) -> Column:
    """Timestamps from ``begin`` in 24-hour steps, none later than ``end``; empty if end < begin."""
    b, e = as_column(begin), as_column(end)
    return F.when(e >= b, F.sequence(b, e, F.expr("interval 1 day"))).otherwise(
        F.array().cast("array<timestamp>")
    )


# -- geometry -----------------------------------------------------------------------------------

def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = map(as_column, (lat1, lon1, lat2, lon2))
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(chord, F.lit(1.0))))


# -- arrays, maps, json -------------------------------------------------------------------------

def in_codes(c: Column | str, codes: Sequence[int]) -> Column:
    return F.coalesce(as_column(c).isin(*codes), F.lit(False)).cast("int")


def any_at_least(c: Column | str, limit: float) -> Column:
    return F.coalesce(F.exists(as_column(c), lambda x: x >= F.lit(limit)), F.lit(False))


def zero_nulls(c: Column | str) -> Column:
    return F.transform(as_column(c), lambda x: F.coalesce(x, F.lit(0.0)))


def array_total(c: Column | str) -> Column:
    return F.aggregate(as_column(c), F.lit(0.0), lambda acc, x: acc + x)


def array_mean(c: Column | str) -> Column:
    values = as_column(c)
    return array_total(values) / F.greatest(F.size(values), F.lit(1))


def json_number(c: Column | str, path: str, default: float = 0.0) -> Column:
    return F.coalesce(F.get_json_object(as_column(c), path).try_cast("double"), F.lit(default))


def lookup(c: Column | str, table: Mapping[str, str]) -> Column:
    """Value from a fixed map; null for unknown keys."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), as_column(c))
