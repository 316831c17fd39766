"""Building blocks that stay even when one key owns a large share of the rows.

* ``spread_join``: an equi join that is split where a key turns out to be hot.
* ``in_ranges``: rows sorted over all tasks and stored with the number of their range. A key with many rows lies in
  many ranges, and ranges follow the number of rows.
* ``running_totals`` / ``group_quantiles``: exact ranks built from range totals plus sorts inside ranges.
* ``time_buckets`` / ``time_carry``: per-entity lag and running counts over time buckets; only one summary row
  per (entity, bucket) is ordered per entity.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridpulse.session import cut_lineage

FINER = 16                   # a crowded time bucket is cut into as many, until none is crowded


def spread_join(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Equi join that keeps rows of ``big`` only (inner, left, left_semi, left_anti).

    Each side is read once. Spark broadcasts ``small`` if its measured size is under the session's limit. If not,
    both are shuffled, and partitions of ``big`` that turn out larger than others (in bytes as written) are split by the
    tasks that wrote them, with ``small``'s partition read by each part: so the rows of one key go to as many tasks
    as their share asks for. ``build_session`` allows this also where a later step needs another shuffle.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"spread_join cannot do {how}")
    return big.join(small, list(on), how)


salted_join = spread_join


def in_ranges(df: DataFrame, by: Sequence[str], name: str = "ranges") -> DataFrame:
    """``df`` stored in the order of ``by``, with ``_range``: later ranges hold greater values.

    Ranges are cut by a sample of the rows. There are at most ``spark.sql.shuffle.partitions``; small neighbours are
    merged up to the session's advisory partition size. Results of the blocks below do not depend on the cuts.
    """
    return cut_lineage(df.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()), name)


def running_totals(df: DataFrame, order: str, columns: Sequence[str], keys: Sequence[str] = (),
                   descending: bool = False, how: str = "sum") -> DataFrame:
    """Inclusive running sums (or maxima) ``cum_<c>``, those without the own row ``before_<c>`` (null on the first), and
    overall ``all_<c>`` along ``order``.

    ``df`` must hold one row per (keys, order value): aggregate ties first.
    """
    keys = list(keys)
    fold = {"sum": F.sum, "max": F.max}[how]
    stored = in_ranges(df, [*keys, order], "running")
    totals = stored.groupBy(*keys, "_range").agg(*[fold(c).alias(f"_t_{c}") for c in columns])
    by_range = F.desc("_range") if descending else F.asc("_range")
    # One row per range in which a key has rows.
    lane = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    earlier = lane.orderBy(by_range).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *keys, "_range", *[fold(f"_t_{c}").over(earlier).alias(f"_b_{c}") for c in columns],
        *[fold(f"_t_{c}").over(lane).alias(f"all_{c}") for c in columns])
    inside = Window.partitionBy(*keys, "_range").orderBy(F.desc(order) if descending else F.asc(order))
    upto, before = (inside.rowsBetween(Window.unboundedPreceding, n) for n in (0, -1))
    within = stored.withColumns({f"cum_{c}": fold(c).over(upto) for c in columns} | {
        f"before_{c}": fold(c).over(before) for c in columns})
    joined = within.join(carry, [*keys, "_range"])

    def merged(own: str, c: str) -> Column:
        here, prior = F.col(own), F.col(f"_b_{c}")
        return F.greatest(here, prior) if how == "max" else F.coalesce(here + prior, here, prior)

    return joined.withColumns({f"{n}_{c}": merged(f"{n}_{c}", c) for c in columns for n in ("cum", "before")}).drop(
        "_range", *[f"_b_{c}" for c in columns])


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "place") -> DataFrame:
    """Add each row's place (from 1) among the rows of its keys along ``order``; a key's rows are sorted by many tasks."""
    keys, order = list(keys), list(order)
    stored = in_ranges(df, [*keys, *order], "numbered")
    counts = stored.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    lane = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("_range")
    before = counts.select(*keys, "_range", (F.sum("_n").over(lane) - F.col("_n")).alias("_before"))
    local = stored.withColumn(name, F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order)))
    joined = local.join(before, [*keys, "_range"]) if not keys else local.alias("l").join(
        before.alias("b"), reduce(Column.__and__, [F.col(f"l.`{k}`").eqNullSafe(F.col(f"b.`{k}`")) for k in [*keys, "_range"]])).select("l.*", "_before")
    return joined.withColumn(name, (F.col(name) + F.col("_before")).cast("long")).select(*df.columns, name)


def group_quantiles(df: DataFrame, keys: Sequence[str], value: str, quantiles: dict[str, float],
                    shares: dict[str, Column] | None = None, maximum: str | None = None) -> DataFrame:
    """Exact, linearly interpolated quantiles per key: ``{output column: share}``.

    Values are counted first (map-side combine), range totals locate the wanted ranks, and only the
    ranges that hold one are sorted. ``shares`` are fractions of rows that meet a condition on
    ``_v`` and ``maximum`` names the largest value; both come from the same counts. Nulls do not
    count.
    """
    keys, shares = list(keys), shares or {}
    known = F.col(value).isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    counts = (df.where(known).groupBy(*keys, F.col(value).alias("_v"))
              .agg(F.count(F.lit(1)).alias("_n")))
    stored = in_ranges(counts, [*keys, "_v"], "quantiles")
    lane = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    totals = stored.groupBy(*keys, "_range").agg(
        F.sum("_n").alias("_t"), F.max("_v").alias("_top"),
        *[F.sum(F.when(test, F.col("_n")).otherwise(0)).alias(f"_s_{n}") for n, test in shares.items()])
    marks = totals.select(
        *keys, "_range", "_t",
        (F.sum("_t").over(lane.orderBy("_range")) - F.col("_t")).alias("_before"),
        F.sum("_t").over(lane).alias("_all"), F.max("_top").over(lane).alias("_max"),
        *[(F.sum(f"_s_{n}").over(lane) / F.sum("_t").over(lane)).alias(n) for n in shares])
    ranks = []
    for i, share in enumerate(quantiles.values()):
        spot = F.lit(float(share)) * (F.col("_all") - 1)
        ranks += [F.floor(spot).alias(f"_lo{i}"), F.ceil(spot).alias(f"_hi{i}")]
    marks = marks.select("*", *ranks)
    names = [f"_{side}{i}" for i in range(len(quantiles)) for side in ("lo", "hi")]
    holds = F.lit(False)
    for n in names:
        holds = holds | ((F.col(n) >= F.col("_before")) & (F.col(n) < F.col("_before") + F.col("_t")))
    picked = stored.join(marks.where(holds).drop("_t"), [*keys, "_range"])
    inside = Window.partitionBy(*keys, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = picked.withColumn("_end", F.sum("_n").over(inside) + F.col("_before"))
    at = [F.max(F.when((F.col(n) < F.col("_end")) & (F.col(n) >= F.col("_end") - F.col("_n")),
                       F.col("_v"))).alias(f"_v{n}") for n in names]
    flat = ranked.groupBy(*keys).agg(
        F.max("_all").alias("_all"), F.max("_max").alias("_max"), *at,
        *[F.max(n).alias(n) for n in shares])
    out = []
    for i, (label, share) in enumerate(quantiles.items()):
        spot = F.lit(float(share)) * (F.col("_all") - 1)
        lo, hi = F.col(f"_v_lo{i}").cast("double"), F.col(f"_v_hi{i}").cast("double")
        out.append((lo + (hi - lo) * (spot - F.floor(spot))).alias(label))
    tail = [F.col("_max").alias(maximum)] if maximum else []
    return flat.select(*keys, *out, *shares, *tail)


def time_buckets(df: DataFrame, entity: str, bucket_minutes: float, bucket_rows: int | None = None) -> DataFrame:
    """Add ``_bucket``, the start of the row's time bucket, from the microsecond column ``_us``.

    Buckets are ``bucket_minutes`` wide. With ``bucket_rows`` an entity's buckets with more rows are cut finer,
    and finer again, until none has more (or all its rows have one time): one further pass over entity and time.
    """
    width = int(bucket_minutes * 60_000_000)
    started = df.withColumn("_bucket", _start(width))
    leaves = _crowded(started, entity, width, bucket_rows) if bucket_rows else None
    if leaves is None:
        return started
    joined = spread_join(started, leaves, [entity, "_bucket"])
    finer = F.element_at(F.filter("_leaves", lambda s: s <= F.col("_us")), -1)
    return joined.withColumn("_bucket", F.coalesce(finer, F.col("_bucket"))).drop("_leaves")


def _start(width: int) -> Column:
    return F.expr(f"_us div {width} * {width}")


def _crowded(df: DataFrame, entity: str, width: int, most: int) -> DataFrame | None:
    """(entity, _bucket, _leaves): the starts of the parts of every bucket with more than ``most`` rows; None if none has."""
    times = df.groupBy(entity, "_bucket", "_us").agg(F.count(F.lit(1)).alias("_n"))
    full = times.groupBy(entity, "_bucket").agg(F.sum("_n").alias("_all")).where(F.col("_all") > most).drop("_all")
    held = cut_lineage(times.join(full, [entity, "_bucket"], "left_semi"), "crowded")
    if held.isEmpty():
        return None
    leaves = []
    while width > 1 and (not leaves or not held.isEmpty()):
        width = max(1, width // FINER)
        held = held.withColumn("_part", _start(width))
        sized = held.groupBy(entity, "_bucket", "_part").agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_times"))
        leaves.append(sized.select(entity, "_bucket", "_part"))
        again = sized.where((F.col("_all") > most) & (F.col("_times") > 1)).select(entity, "_bucket", "_part")
        held = cut_lineage(held.join(again, [entity, "_bucket", "_part"], "left_semi").drop("_part"), "crowded")
    # A part that was cut again is a leaf too: its start is that of its first part, or of nothing.
    found = reduce(DataFrame.unionByName, leaves).distinct()
    return found.groupBy(entity, "_bucket").agg(F.sort_array(F.collect_list("_part")).alias("_leaves"))


def time_carry(df: DataFrame, entity: str, tiebreak: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """Add ``prev_<c>`` (value on the entity's previous row) for each column in ``carry``.

    Rows, with ``_us`` and ``_bucket``, are sorted inside (entity, bucket). The last row of each
    bucket is handed to the next non-empty one through a summary of one row per (entity, bucket).
    """
    order = ["_us", *tiebreak]
    inside = Window.partitionBy(entity, "_bucket").orderBy(*order)
    packed = F.struct(*[F.col(c).alias(c) for c in carry])
    last = df.groupBy(entity, "_bucket").agg(F.max_by(packed, F.struct(*order)).alias("_last"))
    handed = last.select(entity, "_bucket", F.lag("_last").over(
        Window.partitionBy(entity).orderBy("_bucket")).alias("_handed"))
    local = df.withColumn("_prev", F.lag(packed).over(inside))
    joined = local.join(handed, [entity, "_bucket"], "left")
    prev = F.coalesce(F.col("_prev"), F.col("_handed"))
    return joined.withColumn("_prev", prev).withColumns(
        {f"prev_{c}": F.col("_prev").getField(c) for c in carry}).drop("_prev", "_handed")
