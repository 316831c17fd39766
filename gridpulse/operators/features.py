"""Feature matrices: calendar columns, encodings, alignment, splits, scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridpulse.functions.columns import clip, require_columns, to_number, weekday
from gridpulse.functions.skew import group_quantiles, numbered, spread_join
from gridpulse.session import cut_lineage

# Default feature lists of the three models, in model order.
DURATION_FEATURES = (
    "fips_code", "year", "month", "day", "hour", "dayofweek", "county_median_duration",
    "county_long_rate", "initial_customers_affected", "delta_customers_affected_15m",
    "pct_growth_15m", "has_weather_event", "max_magnitude", "prcp_mm", "tmax_c", "tmin_c", "awnd_ms",
    "wsfg_ms", "wt_fog", "wt_thunder", "wt_snow", "wt_freezing_rain", "wt_ice", "wt_blowing_snow",
)
SCOPE_FEATURES = (
    "fips_code", "year", "month", "day", "hour", "dayofweek", "county_median_scope",
    "county_large_outage_rate", "county_max_customers", "initial_customers_affected",
    "delta_customers_affected_15m", "pct_growth_15m", "initial_impact_density", "has_weather_event",
    "max_magnitude", "prcp_mm", "snow_mm", "snwd_mm", "tmax_c", "tmin_c", "awnd_ms", "wsfg_ms",
    "wt_thunder", "wt_ice", "wt_blowing_snow", "wt_freezing_rain", "wt_snow",
)
OCCURRENCE_FEATURES = (
    "year", "month", "day", "dayofweek", "prcp_mm", "snow_mm", "snwd_mm", "tmax_c", "tmin_c",
    "awnd_ms", "wt_fog", "wt_thunder", "wt_ice", "wt_blowing_snow", "wt_freezing_rain", "wt_snow",
    "county_median_duration", "county_long_rate", "county_median_scope", "county_large_outage_rate",
    "county_max_customers",
)
CORE_FEATURES = (
    "fips_code", "month", "hour", "dayofweek", "initial_customers_affected",
    "delta_customers_affected_15m", "pct_growth_15m",
)
# Features left out of training.
RARE_EVENTS = (
    "event_Avalanche", "event_Coastal Flood", "event_Debris Flow", "event_Drought",
    "event_Funnel Cloud", "event_Rip Current", "event_Tornado", "event_Wildfire",
)
GROWTH_FEATURES = (
    "initial_customers_affected", "delta_customers_affected_15m", "pct_growth_15m",
    "initial_impact_density",
)


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def temporal_features(df: DataFrame, ts: str = "run_start_time") -> DataFrame:
    require_columns(df, [ts])
    return df.withColumns({
        "year": F.year(ts), "month": F.month(ts), "day": F.dayofmonth(ts), "hour": F.hour(ts),
        "dayofweek": weekday(ts)})


def day_features(df: DataFrame, date: str = "date") -> DataFrame:
    require_columns(df, [date])
    return df.withColumns({
        "year": F.year(date), "month": F.month(date), "day": F.dayofmonth(date),
        "dayofweek": weekday(date), "dayofyear": F.dayofyear(date),
        "is_weekend": (weekday(date) >= 5).cast("int")})


def categories_of(df: DataFrame, column: str, limit: int | None = None) -> list[str]:
    """The category list to fit one-hot columns on: every category becomes a column, so all come to the driver.

    A caller that wants a column of free text refused passes ``limit``, the most categories it accepts.
    """
    found = df.select(F.coalesce(column, F.lit("None")).alias("c")).distinct()
    found = (found if limit is None else found.limit(limit + 1)).collect()
    if limit is not None and len(found) > limit:
        raise ValueError(f"{column} has more than {limit} categories")
    return sorted(r.c for r in found)


def one_hot(df: DataFrame, column: str = "event_type", categories: Sequence[str] = (),
            prefix: str = "event", drop: bool = True) -> DataFrame:
    """0/1 columns ``<prefix>_<category>``; null counts as the category "None"."""
    value = F.coalesce(F.col(column), F.lit("None"))
    out = df.withColumns({f"{prefix}_{c}": (value == c).cast("int") for c in categories})
    return out.drop(column) if drop else out


def category_index(df: DataFrame, column: str = "event_type") -> DataFrame:
    """(category, index, rows): every category with its place (from 0) in the order of names; null counts as "None".

    However many categories there are, none comes to the driver.
    """
    counts = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("None")).alias("category")).agg(F.count(F.lit(1)).alias("rows"))
    placed = numbered(counts, [], ["category"], "index")
    return placed.select("category", (F.col("index") - 1).alias("index"), "rows")


def one_hot_vector(df: DataFrame, categories: DataFrame, column: str = "event_type", name: str = "event_vector",
                   drop: bool = True) -> DataFrame:
    """One sparse vector per row instead of a column per category: 1 at the category's index, at the last place for
    categories that are not in ``categories`` (a ``category_index``)."""
    from pyspark.ml.feature import OneHotEncoder
    known = categories.select(F.col("category").alias("_category"), F.col("index").cast("double").alias("_index"))
    width = categories.count()
    held = df.withColumn("_category", F.coalesce(F.col(column).cast("string"), F.lit("None")))
    placed = spread_join(held, known, ["_category"]).withColumn("_index", F.coalesce("_index", F.lit(float(width))))
    # The encoder takes its size from the largest index it is shown.
    shown = df.sparkSession.createDataFrame([(float(width),)], "_index double")
    encoder = OneHotEncoder(inputCols=["_index"], outputCols=[name], dropLast=False).fit(shown)
    out = encoder.transform(placed).drop("_index", "_category")
    return out.drop(column) if drop else out


def impact_density(df: DataFrame, cap: float | None = None) -> DataFrame:
    ratio = F.col("initial_customers_affected") / F.greatest("county_max_customers", F.lit(1))
    return df.withColumn("initial_impact_density", ratio if cap is None else clip(ratio, high=cap))


def growth_features(df: DataFrame, initial: str = "initial_customers_affected",
                    second: str = "second_customers_affected") -> DataFrame:
    delta = F.coalesce(second, initial) - F.col(initial)
    return df.withColumns({
        "delta_customers_affected_15m": delta,
        "pct_growth_15m": delta / F.greatest(F.col(initial), F.lit(1))})


def feature_matrix(df: DataFrame, features: Sequence[str] = DURATION_FEATURES,
                   target: str = "duration_minutes", core: Sequence[str] = CORE_FEATURES,
                   keys: Sequence[str] = ()) -> DataFrame:
    """Numeric features and ``label``: present listed columns, then all ``event_*`` columns.

    Rows that lack a core feature or the target go, other gaps become 0. ``keys`` are kept first.
    """
    require_columns(df, [target])
    base = [c for c in features if c in df.columns]
    events = [c for c in df.columns if c.startswith("event_") and c != "event_type"]
    names = list(dict.fromkeys([*base, *events]))
    cols = [F.col(k).alias(f"key_{k}" if k in names else k) for k in keys]
    cols += [to_number(quoted(c)).alias(c) for c in names]
    numeric = df.select(*cols, to_number(quoted(target)).alias("label"))
    must = [c for c in base if c in core] + ["label"]
    present = numeric.where(" and ".join(f"`{c}` is not null" for c in must))
    return present.withColumns({c: F.coalesce(quoted(c), F.lit(0.0)) for c in names})


def occurrence_feature_matrix(df: DataFrame, features: Sequence[str] = OCCURRENCE_FEATURES,
                              target: str = "outage_occurred", include_temporal: bool = True,
                              include_storm: bool = True, include_event_dummies: bool = True,
                              categories: Sequence[str] = (), keys: Sequence[str] = ()) -> DataFrame:
    """As ``feature_matrix`` for entity-days; gaps are filled before the core check."""
    require_columns(df, [target])
    if include_temporal:
        df = day_features(df)
    names = list(features)
    if include_storm:
        names += [c for c in ("storm_event", "has_weather_event") if c in df.columns]
    if include_event_dummies and "event_type" in df.columns:
        df = one_hot(df, "event_type", categories, drop=False)
        names += [f"event_{c}" for c in categories]
    names = [c for c in names if c in df.columns]
    core = [c for c in ("fips_code", target) if c in df.columns and c not in names]
    present = df.where(" and ".join(f"`{c}` is not null" for c in core)) if core else df
    return present.select(
        *[F.col(k).alias(f"key_{k}" if k in names else k) for k in keys],
        *[F.coalesce(to_number(quoted(c)), F.lit(0.0)).alias(c) for c in names],
        to_number(quoted(target)).alias("label"))


def binary_target_report(df: DataFrame, target: str = "outage_occurred") -> DataFrame:
    t = F.col(target)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(~t.isin(0, 1)).alias("bad_values"),
                  F.count_if(t.isNull()).alias("nulls"))


def require_binary_target(df: DataFrame, target: str = "outage_occurred") -> DataFrame:
    """Raises when a target value is neither 0 nor 1; runs one aggregate."""
    require_columns(df, [target])
    if binary_target_report(df, target).first().bad_values:
        raise ValueError(f"{target} must hold only 0 and 1")
    return df


def align_features(df: DataFrame, names: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Exactly ``names`` in order; what the frame lacks is 0."""
    return df.select(*keys, *[
        quoted(c) if c in df.columns else F.lit(0).alias(c) for c in names if c not in keys])


def drop_features(df: DataFrame, generalise: bool = False, extra: Sequence[str] = ()) -> DataFrame:
    gone = ["year", *RARE_EVENTS, *(GROWTH_FEATURES if generalise else ()), *extra]
    return df.drop(*[c for c in gone if c in df.columns])


def scaling_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: mean and population deviation, a deviation of 0 replaced by 1."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), quoted(c).cast("double").alias("value"))
                                for c in columns]))
    stats = df.select(pairs.alias("p")).groupBy("p.column").agg(
        F.avg("p.value").alias("mean"), F.stddev_pop("p.value").alias("std"))
    return stats.withColumn("std", F.when(F.col("std") == 0, 1.0).otherwise(F.col("std")))


def zscore_normalise(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    stats = df.agg(F.struct(*[
        F.struct(F.avg(quoted(c)).alias("m"), F.stddev_pop(quoted(c)).alias("s")).alias(f"c{i}")
        for i, c in enumerate(columns)])).scalar()
    out = df.withColumn("_stats", stats)
    scaled = {}
    for i, c in enumerate(columns):
        mean, std = F.col(f"_stats.c{i}.m"), F.col(f"_stats.c{i}.s")
        scaled[c] = (quoted(c) - mean) / F.when(std == 0, 1.0).otherwise(std)
    return out.withColumns(scaled).drop("_stats")


def zero_weather_rows(entities: DataFrame, rows: DataFrame, entity: str = "fips_code") -> DataFrame:
    """Every entity once; those without weather get zeros and are marked as missing."""
    names = [c for c in rows.columns if c not in (entity, "magnitude_missing")]
    joined = entities.select(entity).join(rows.withColumn("_has", F.lit(True)), entity, "left")
    missing = F.when(F.col("_has").isNull(), 1)
    if "magnitude_missing" in rows.columns:
        missing = missing.otherwise(F.col("magnitude_missing"))
    else:
        missing = missing.otherwise(0)
    return joined.select(entity, *[F.coalesce(c, F.lit(0)).alias(c) for c in names],
                         missing.alias("magnitude_missing"))


def sample_weights(df: DataFrame, target: str, threshold: float, weight: float) -> DataFrame:
    return df.withColumn("weight", F.when(F.col(target) >= threshold, float(weight)).otherwise(1.0))


def pin_feature(df: DataFrame, name: str = "year", value: float = 2021) -> DataFrame:
    return df.withColumn(name, F.lit(value)) if name in df.columns else df


def valid_targets(df: DataFrame, target: str) -> DataFrame:
    y = F.col(target).cast("double")
    return df.where(y.isNotNull() & ~F.isnan(y) & (y >= 0) & (y < float("inf")))


def temporal_split(df: DataFrame, test_year: int = 2022, year: str = "year") -> tuple[DataFrame, DataFrame]:
    """Years before ``test_year`` train, that year tests, later years are in neither."""
    return df.where(F.col(year) < test_year), df.where(F.col(year) == test_year)


def split_share(keys: Sequence[str], seed: int = 42) -> Column:
    """A fixed pseudo-random number in [0, 1) per key."""
    return F.pmod(F.xxhash64(F.lit(seed), *[quoted(k) for k in keys]), F.lit(1 << 30)) / float(1 << 30)


def random_split(df: DataFrame, keys: Sequence[str], test_share: float = 0.2, seed: int = 42,
                 label: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(train, test) by key hash; with ``label`` the share holds within every label value."""
    marked = df.withColumn("_u", split_share(keys, seed))
    if label is None:
        cut = F.lit(1.0 - test_share)
    else:
        cuts = group_quantiles(marked, [label], "_u", {"_cut": 1.0 - test_share})
        # One row per label value: the labels are a handful of classes.
        found = cuts.agg(F.map_from_entries(F.collect_list(F.struct(
            F.col(label).cast("string"), F.col("_cut"))))).scalar()
        marked = marked.withColumn("_cuts", found)
        cut = F.try_element_at(F.col("_cuts"), F.col(label).cast("string"))
    marked = marked.withColumn("_test", F.coalesce(F.col("_u") > cut, F.lit(False)))
    extra = [c for c in ("_u", "_cuts", "_test") if c in marked.columns]
    return marked.where(~F.col("_test")).drop(*extra), marked.where("_test").drop(*extra)


def export_sample(df: DataFrame, keys: Sequence[str], n: int = 100, seed: int = 42) -> DataFrame:
    """``n`` rows chosen by key hash: the same rows on every run."""
    return df.orderBy(F.xxhash64(F.lit(seed), *[quoted(k) for k in keys]), *[quoted(k) for k in keys]).limit(n)


# -- composite feature sets ---------------------------------------------------------------------

def duration_features(events: DataFrame, categories: Sequence[str] = (), long_minutes: float = 240,
                      stats_until=None, keys: Sequence[str] = ("fips_code", "start_time"),
                      materialise: bool = True) -> DataFrame:
    """Sessionised events to the duration matrix. History covers all events given, or those that
    start before ``stats_until``.

    The events feed both the history and the matrix, so they are stored once in the shared folder;
    pass ``materialise=False`` for a frame that already is a table.
    """
    from gridpulse.operators.sessions import (add_history, duration_category, duration_history,
                                              valid_durations)
    good = valid_durations(events)
    good = duration_category(cut_lineage(good, "events") if materialise else good, long_minutes)
    past = good if stats_until is None else good.where(F.col("start_time") < F.lit(stats_until))
    full = add_history(good, duration_history(past, long_minutes=long_minutes))
    if "event_type" in full.columns:
        full = one_hot(full, "event_type", categories)
    return feature_matrix(temporal_features(full, "start_time"), DURATION_FEATURES,
                          "duration_minutes", keys=keys)


def scope_features(events: DataFrame, categories: Sequence[str] = (), large: float = 500,
                   stats_until=None, keys: Sequence[str] = ("fips_code", "start_time"),
                   materialise: bool = True) -> DataFrame:
    """As ``duration_features`` for the number of customers affected."""
    from gridpulse.operators.sessions import add_history, scope_category, scope_history, valid_scopes
    good = valid_scopes(events)
    good = scope_category(cut_lineage(good, "events") if materialise else good, large)
    past = good if stats_until is None else good.where(F.col("start_time") < F.lit(stats_until))
    full = impact_density(add_history(good, scope_history(past, large=large)))
    if "event_type" in full.columns:
        full = one_hot(full, "event_type", categories)
    return feature_matrix(temporal_features(full, "start_time"), SCOPE_FEATURES,
                          "peak_customers_affected", keys=keys)


def occurrence_features(panel: DataFrame, check: bool = True,
                        keys: Sequence[str] = ("fips_code", "date"), **options) -> DataFrame:
    """Entity-day panel to the occurrence matrix. ``check`` verifies the target first."""
    if check:
        require_binary_target(panel)
    return occurrence_feature_matrix(panel, keys=keys, **options)
