"""Weather codes, unit conversion, event flags, prediction bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridpulse.functions.columns import any_at_least, as_column, in_codes

# WMO weather codes behind each daily flag.
CODE_FLAGS = {
    "wt_fog": (45, 48),
    "wt_thunder": (95, 96, 99),
    "wt_snow": (71, 73, 75, 77, 85, 86),
    "wt_freezing_rain": (66, 67),
    "wt_ice": (66, 67),
    "wt_blowing_snow": (77,),
    "wt_drizzle": (51, 53, 55),
    "wt_rain": (61, 63, 65, 80, 81, 82),
}
SEVERE_CODE = 95

# Event types that weather readings alone never signal.
UNSIGNALLED_EVENTS = (
    "Avalanche", "Coastal Flood", "Debris Flow", "Drought", "Funnel Cloud", "Rip Current", "Tornado",
    "Wildfire",
)

KMH_PER_MS = 3.6
MM_PER_CM = 10.0
MM_PER_M = 1000.0

WEATHER_COLUMNS = (
    "prcp_mm", "snow_mm", "snwd_mm", "tmax_c", "tmin_c", "awnd_ms", "wsfg_ms", *CODE_FLAGS,
)


def code_flags(code: Column | str) -> list[Column]:
    """One 0/1 column per weather flag from a code column."""
    return [in_codes(code, codes).alias(name) for name, codes in CODE_FLAGS.items()]


def code_flags_any(codes_array: Column | str) -> list[Column]:
    """One 0/1 column per flag: does any code of the array belong to it."""
    arr = as_column(codes_array)
    return [
        F.arrays_overlap(arr, F.array(*[F.lit(c) for c in codes])).cast("int").alias(name)
        for name, codes in CODE_FLAGS.items()
    ]


def to_ms(kmh: Column | str) -> Column:
    return F.coalesce(as_column(kmh), F.lit(0.0)) / F.lit(KMH_PER_MS)


def cm_to_mm(cm: Column | str) -> Column:
    return F.coalesce(as_column(cm), F.lit(0.0)) * F.lit(MM_PER_CM)


def m_to_mm(m: Column | str) -> Column:
    return F.coalesce(as_column(m), F.lit(0.0)) * F.lit(MM_PER_M)


def severe_proxy(codes_array: Column | str, prcp: Column | str, wind: Column | str,
                 filled: bool = False) -> list[Column]:
    return [
        any_at_least(codes_array, SEVERE_CODE).cast("int").alias("has_weather_event"),
        F.round(F.greatest(as_column(prcp), as_column(wind)), 3).alias("max_magnitude"),
        F.lit(int(filled)).alias("magnitude_missing"),
    ]


def event_flags(df: DataFrame) -> dict[str, Column]:
    """Event-type flags from daily weather; columns the frame lacks count as 0."""

    def reading(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)) if name in df.columns else F.lit(0)

    prcp, snow, depth = reading("prcp_mm"), reading("snow_mm"), reading("snwd_mm")
    wind, gust = reading("awnd_ms"), reading("wsfg_ms")
    cold, hot = reading("tmin_c"), reading("tmax_c")
    thunder, fog, snowing = (reading(f"wt_{n}") != 0 for n in ("thunder", "fog", "snow"))
    drifting, glaze = reading("wt_blowing_snow") != 0, reading("wt_ice") != 0
    freezing = reading("wt_freezing_rain") != 0
    rules = {
        "Thunderstorm Wind": thunder & (gust > 13),
        "Lightning": thunder,
        "Hail": thunder & (gust > 18),
        "High Wind": gust > 25,
        "Strong Wind": (wind > 13) & (gust <= 25),
        "Dense Fog": fog,
        "Heavy Rain": prcp > 25,
        "Flash Flood": prcp > 50,
        "Flood": prcp > 30,
        "Heavy Snow": snowing & (snow > 100),
        "Blizzard": drifting & (wind > 15),
        "Winter Storm": ((snow > 50) | (depth > 50)) & (cold < 0),
        "Winter Weather": snowing & (snow <= 100),
        "Ice Storm": glaze | freezing,
        "Frost/Freeze": (cold < 0) & (prcp == 0),
        "Cold/Wind Chill": cold < -10,
        "Excessive Heat": hot > 38,
        "Extreme Cold/Wind Chill": cold < -20,
        "Heat": hot > 32,
        "Tropical Storm": (gust > 33) & (prcp > 25),
    }
    flags = {f"event_{name}": rule.cast("int") for name, rule in rules.items()}
    nothing = ~F.coalesce(*[F.when(rule, F.lit(True)) for rule in rules.values()], F.lit(False))
    flags.update({f"event_{name}": F.lit(0) for name in UNSIGNALLED_EVENTS})
    flags["event_None"] = nothing.cast("int")
    return flags


def add_event_flags(df: DataFrame) -> DataFrame:
    return df.withColumns(event_flags(df))


def outside_physical_bounds() -> Column:
    """Readings no weather station can deliver."""
    return (
        (F.col("prcp_mm") > 500) | (F.col("tmax_c") > 60) | (F.col("tmin_c") < -40)
        | (F.col("awnd_ms") > 25) | (F.col("wsfg_ms") > 80)
        | (F.col("awnd_ms") < 0) | (F.col("wsfg_ms") < 0)
    )


def severity_band(customers: Column | str, occurred: Column | str) -> Column:
    n = as_column(customers)
    return (
        F.when(~F.coalesce(as_column(occurred), F.lit(False)), "None").when(n > 5000, "Severe").when(n > 1000, "Moderate")
        .otherwise("Minor")
    )


def severity_colour(customers: Column | str, occurred: Column | str) -> Column:
    n = as_column(customers)
    return (
        F.when(~F.coalesce(as_column(occurred), F.lit(False)), "none").when(n > 5000, "red").when(n > 1000, "orange")
        .otherwise("yellow")
    )


def probability_band(p: Column | str) -> Column:
    percent = F.floor(as_column(p) * 100 + 0.5)
    return F.when(percent >= 70, "high").when(percent >= 40, "medium").otherwise("low")


def display_name(name: Column | str, code: Column | str) -> Column:
    """County name with its suffix: three-digit codes from 500 up are cities."""
    suffix = F.when(F.substr(as_column(code), F.lit(3)).try_cast("int") >= 500, " City")
    return F.concat(as_column(name), F.coalesce(suffix, F.lit(" County")))
