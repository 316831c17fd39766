"""Streams over the tables, drained once; results must equal the batch operators'."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from gridpulse.plans.bindings import SESS, SESSION_OPTIONS, SNAPSHOT_MINUTES, rounded, snapshots
from gridpulse.plans.catalog import query
from gridpulse.plans.queries_live import POLL, polls
from gridpulse.plans.queries_rollups import daily_sql, hourly
from gridpulse.session import scratch_path
from gridpulse.streaming import jobs as J


LATE_MINUTES = 2880


def replayed(df, name: str, order: str, run, read, parts: int = 3, late_minutes: float = 0):
    """Rows arrive in ``parts`` slices; the stream is stopped and resumed in between, from its checkpoint.

    Slices follow the time in ``order``, each row up to ``late_minutes`` late by a hash of the row. Returns
    ``read(spark, target)``.
    """
    spark = df.sparkSession
    source, target, progress = (scratch_path(spark, f"{name}-{what}") for what in ("in", "out", "progress"))
    moment = F.col(order) if order == "poll_no" else F.unix_micros(F.col(order).cast("timestamp"))
    if late_minutes:
        moment = moment + F.pmod(F.xxhash64(*df.columns), F.lit(int(late_minutes * 60_000_000)))
    cuts = []
    if parts > 1:
        shares = [i / parts for i in range(1, parts)]
        cuts = df.agg(F.percentile_approx(moment, shares, 1000)).first()[0]
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = df if low is None else df.where(moment > low)
        part = part if high is None else part.where(moment <= high)
        part.write.mode("append").parquet(source)
        run(J.file_stream(spark, source, df.schema), progress, target).awaitTermination()
    return read(spark, target)


def versions(build, mode: str, keys: list[str]):
    """How to run a stream whose rows update a current table, and how to read that."""
    def run(stream, progress, target):
        return J.start(build(stream), progress, J.current_writer(target, keys, every=2), mode=mode)

    return run, partial(J.read_current, keys=keys)


@query("str3_poll_delta_state", f"WITH {POLL} SELECT poll_no, fips_code, round(customers, 6) AS customers, round(delta, 6) AS delta, round(pct_growth, 6) AS pct_growth FROM delta")
def _(spark, sf):
    state = scratch_path(spark, "polls-state")

    def run(stream, progress, target):
        return J.poll_delta_stream(stream, progress, target, state, every=None)

    out = replayed(polls(spark, sf), "polls", "poll_no", run, lambda spark, target: spark.read.parquet(target).drop("batch"))
    return rounded(out.select("poll_no", "fips_code", "customers", "delta", "pct_growth"), 6)


@query("str4_session_stream", f"WITH {SESS} SELECT fips_code, start_time, end_time, peak_customers_affected, initial_customers_affected, "
       "CAST(snapshot_count AS BIGINT) AS snapshot_count, round(delta_customers_affected_15m, 6) AS delta_customers_affected_15m, duration_minutes, event_type, weather_event_count, max_magnitude, prcp_mm FROM sess")
def _(spark, sf):
    state = scratch_path(spark, "sessions-state")

    def run(stream, progress, target):
        return J.session_stream(stream, progress, target, state, every=None, late_minutes=LATE_MINUTES, **SESSION_OPTIONS)

    def read(spark, target):
        return J.read_sessions(spark, target, state, **SESSION_OPTIONS)

    # Rows come in disorder, up to as late as the stream allows.
    out = replayed(snapshots(spark, sf), "sessions", "run_start_time", run, read, late_minutes=LATE_MINUTES)
    return out.select(
        "fips_code", "start_time", "end_time", "peak_customers_affected", "initial_customers_affected", "snapshot_count",
        F.round("delta_customers_affected_15m", 6).alias("delta_customers_affected_15m"), "duration_minutes",
        "event_type", "weather_event_count", "max_magnitude", "prcp_mm")


@query("str4_session_window", """WITH e AS (SELECT lpad(CAST(user_id AS VARCHAR), 5, '0') AS fips_code, ts, value FROM events WHERE value > 20),
  g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 43200000000 THEN 0 ELSE 1 END AS s FROM e WINDOW w AS (PARTITION BY fips_code ORDER BY ts)),
  b AS (SELECT *, sum(s) OVER (PARTITION BY fips_code ORDER BY ts ROWS UNBOUNDED PRECEDING) AS block FROM g)
  SELECT fips_code, min(ts) AS start_time, max(ts) AS end_time, max(value) AS peak_customers_affected, count(*) AS snapshot_count,
  (epoch_us(max(ts)) - epoch_us(min(ts))) / 60000000.0 + 360 AS duration_minutes FROM b GROUP BY fips_code, block""")
def _(spark, sf):
    rows = snapshots(spark, sf).select("fips_code", "run_start_time", "customers_affected")
    # A window is written once the watermark has passed it; a last row far ahead, of no entity of the table, passes all.
    end = rows.agg(F.max("run_start_time").alias("run_start_time")).select(
        F.lit(None).cast("string").alias("fips_code"), (F.col("run_start_time") + F.expr("INTERVAL 9 DAYS")).alias("run_start_time"),
        F.lit(1.0).alias("customers_affected"))
    build = partial(J.session_window_stream, gap_minutes=720, snapshot_minutes=SNAPSHOT_MINUTES, late=f"{LATE_MINUTES} minutes")
    run, read = versions(build, "append", ["fips_code", "start_time"])
    out = replayed(rows.unionByName(end), "windows", "run_start_time", run, read, parts=4, late_minutes=LATE_MINUTES).where("fips_code IS NOT NULL")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start_time", "end_time")})


@query("str5_daily_tumbling_weather", daily_sql(False))
def _(spark, sf):
    return rounded(replayed(hourly(spark, sf), "daily", "time", *versions(J.daily_weather_stream, "update", ["fips_code", "date"])), 6)
