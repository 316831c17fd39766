"""Hand-made cases for rules that ordinary data rarely touches, and brute-force comparisons."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from gridpulse.functions import columns as C
from gridpulse.functions import skew as K
from gridpulse.operators import features as X
from gridpulse.operators import joins as J
from gridpulse.operators import live as L
from gridpulse.operators import metrics as M
from gridpulse.operators import rollups as R
from gridpulse.operators import sessions as S
from gridpulse.sources import readers, writers

T0 = dt.datetime(2022, 1, 1)


def snaps(spark, rows):
    """rows: (entity, minutes, customers)"""
    data = [(e, T0 + dt.timedelta(minutes=m), float(v)) for e, m, v in rows]
    return spark.createDataFrame(data, "fips_code string, run_start_time timestamp_ntz, customers_affected double")


def events(spark, rows, **options):
    out = S.sessionize(snaps(spark, rows), **options).orderBy("fips_code", "start_time").collect()
    return [(r.fips_code, int((r.start_time - T0).total_seconds() / 60), r.duration_minutes) for r in out]


# -- sessions -----------------------------------------------------------------------------------

def test_gap_of_exactly_twice_the_interval_does_not_split(spark):
    assert events(spark, [("a", 0, 5), ("a", 30, 5)]) == [("a", 0, 45.0)]
    assert events(spark, [("a", 0, 5), ("a", 31, 5)]) == [("a", 0, 15.0), ("a", 31, 15.0)]


def test_zero_reading_splits(spark):
    assert events(spark, [("a", 0, 5), ("a", 15, 0), ("a", 30, 5)]) == [("a", 0, 15.0), ("a", 30, 15.0)]


def test_gap_counts_off_rows_too(spark):
    # The step from the off row is short, so only the state change separates the runs.
    assert events(spark, [("a", 0, 5), ("a", 20, 0), ("a", 45, 7)]) == [("a", 0, 15.0), ("a", 45, 15.0)]


def test_event_crossing_many_buckets_stays_whole(spark):
    rows = [("a", 15 * i, 3 + i) for i in range(400)]
    assert events(spark, rows, bucket_minutes=60) == [("a", 0, 15.0 * 400)]
    got = S.sessionize(snaps(spark, rows), bucket_minutes=60).first()
    assert (got.initial_customers_affected, got.delta_customers_affected_15m, got.snapshot_count) == (3.0, 1.0, 400)


def test_second_row_may_lie_in_the_next_bucket(spark):
    got = S.sessionize(snaps(spark, [("a", 45, 4), ("a", 60, 9), ("a", 75, 1)]), bucket_minutes=60).first()
    assert (got.delta_customers_affected_15m, got.peak_customers_affected, got.snapshot_count) == (5.0, 9.0, 3)


def test_null_times_are_dropped(spark):
    df = snaps(spark, [("a", 0, 5)]).unionAll(spark.createDataFrame(
        [("a", None, 9.0)], "fips_code string, run_start_time timestamp_ntz, customers_affected double"))
    assert S.sessionize(df).first().peak_customers_affected == 5.0


def brute_sessions(rows):
    out, current = [], {}
    last = {}
    for e, m, v in sorted(rows):
        split = e not in last or m - last[e][0] > 30 or (last[e][1] > 0) != (v > 0)
        if v > 0:
            if split or e not in current:
                current[e] = [e, m, m]
                out.append(current[e])
            current[e][2] = m
        else:
            current.pop(e, None)
        last[e] = (m, v)
    return sorted((e, a, float(b - a + 15)) for e, a, b in out)


@pytest.mark.parametrize("options", [{"bucket_minutes": 45}, {"bucket_minutes": 1440}, {"bucket_rows": 3}, {"bucket_rows": 1, "bucket_minutes": 200_000}])
def test_hot_entity_matches_row_loop(spark, options):
    rng = random.Random(3)
    rows, seen = [], set()
    for _ in range(900):
        e = "hot" if rng.random() < 0.6 else f"e{rng.randrange(6)}"
        m = rng.randrange(0, 9000)
        if (e, m) not in seen:
            seen.add((e, m))
            rows.append((e, m, rng.choice([0, 0, 1, 2, 50])))
    assert events(spark, rows, **options) == brute_sessions(rows)


def test_blocks_do_not_overlap_and_cover_all_on_rows(spark):
    rng = random.Random(4)
    rows = [(f"e{i % 3}", 10 * i + rng.randrange(5), rng.choice([0, 4, 8])) for i in range(300)]
    found = S.sessionize(snaps(spark, rows), bucket_minutes=120)
    assert found.agg(F.sum("snapshot_count")).first()[0] == sum(v > 0 for _, _, v in rows)
    per = {}
    for r in found.orderBy("fips_code", "start_time").collect():
        assert per.get(r.fips_code, T0 - dt.timedelta(days=1)) < r.start_time
        per[r.fips_code] = r.end_time


# -- skew blocks --------------------------------------------------------------------------------

def test_group_quantiles_match_sorting(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.7 else rng.choice("abc"), rng.choice([rng.random() * 10, 5.0, None])) for _ in range(800)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r for r in K.group_quantiles(df, ["k"], "v", {"m": 0.5, "q": 0.9}, {"big": F.col("_v") >= 5}, "top").collect()}
    for k in "hot a b c".split():
        vals = sorted(v for key, v in rows if key == k and v is not None)
        spot = 0.9 * (len(vals) - 1)
        low = int(spot)
        q = vals[low] + (vals[min(low + 1, len(vals) - 1)] - vals[low]) * (spot - low)
        assert got[k].m == pytest.approx(statistics.median(vals))
        assert got[k].q == pytest.approx(q)
        assert got[k].big == pytest.approx(sum(v >= 5 for v in vals) / len(vals))
        assert got[k].top == max(vals)


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_match_loop(spark, descending):
    rng = random.Random(6)
    rows = [(x, rng.randrange(10)) for x in rng.sample(range(5000), 500)]
    got = {r.x: r.cum_n for r in K.running_totals(
        spark.createDataFrame(rows, "x long, n long"), "x", ["n"], descending=descending).collect()}
    total = 0
    for x, n in sorted(rows, reverse=descending):
        total += n
        assert got[x] == total


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_spread_join_equals_plain_join(spark, how):
    rng = random.Random(7)
    big = spark.createDataFrame([(1 if rng.random() < 0.6 else rng.randrange(2, 400), i) for i in range(700)], "k int, i int")
    small = spark.createDataFrame([(k, c) for k in range(0, 300) for c in range(k % 3)], "k long, c int")
    a = big.join(small, ["k"], how)
    b = K.spread_join(big, small, ["k"], how)
    assert sorted(map(str, a.select(*sorted(a.columns)).collect())) == sorted(map(str, b.select(*sorted(a.columns)).collect()))


HOT_SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "2k"}


@pytest.fixture
def small_limits(spark):
    """Limits a thousand times smaller, so that small tables are dealt as large ones are."""
    before = {k: spark.conf.get(k) for k in HOT_SETTINGS}
    for k, v in HOT_SETTINGS.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_rows_of_a_hot_key_are_split(spark, small_limits, how):
    """4,000 rows of one key among 8,000: the one shuffled partition that holds them is read in parts."""
    hot = spark.range(0, 4000, numPartitions=16).selectExpr("7L AS k", "sha2(string(id), 256) AS t")
    rest = spark.range(0, 4000, numPartitions=16).selectExpr("id + 100 AS k", "sha2(string(id), 256) AS t")
    small = spark.range(0, 3000).selectExpr("id AS k", "id * 2 AS v")
    joined = K.spread_join(hot.unionByName(rest), small, ["k"], how)
    partitions = joined.groupBy(F.spark_partition_id().alias("p")).agg(F.count_if(F.col("k") == 7).alias("hot"), F.max("t")).collect()
    want = {"left": 4000, "inner": 4000, "left_semi": 4000, "left_anti": 0}[how]
    held = [r.hot for r in partitions if r.hot]
    assert sum(held) == want and (want == 0 or len(held) >= 4)


def test_ranges_follow_the_rows(spark, small_limits):
    sizes = []
    for rows in (500, 4000):
        df = spark.range(rows).selectExpr("pmod(xxhash64(id), 100000) AS x", "1L AS n").groupBy("x").agg(F.sum("n").alias("n"))
        per = [r["count"] for r in K.in_ranges(df, ["x"]).groupBy("_range").count().collect()]
        sizes.append(per)
    assert len(sizes[1]) > len(sizes[0]) and max(sizes[1]) < 2.5 * sum(sizes[1]) / len(sizes[1])


def test_a_burst_is_cut_into_finer_buckets(spark):
    rows = [("a", i / 60, 1 + i % 5) for i in range(3000)] + [("b", 10 * i, 1) for i in range(50)]
    df = snaps(spark, rows).withColumn("_us", F.unix_micros(F.col("run_start_time").cast("timestamp")))
    cut = K.time_buckets(df, "fips_code", 1440, 100)
    per = {(r.fips_code, r._bucket): r["count"] for r in cut.groupBy("fips_code", "_bucket").count().collect()}
    assert sum(per.values()) == len(rows) and len([k for k in per if k[0] == "a"]) > 20
    assert max(n for (k, _), n in per.items() if k == "a") <= 100 and sum(1 for k, _ in per if k == "b") == 1
    assert not cut.where("_bucket > _us").count()
    plain, fine = (S.sessionize(snaps(spark, rows), bucket_rows=n).drop("bucket") for n in (None, 100))
    assert sorted(map(str, plain.collect())) == sorted(map(str, fine.collect()))


# -- joins --------------------------------------------------------------------------------------

def storm(spark, begin, end):
    return spark.createDataFrame([("a", begin, end, "Hail", 1.0)],
                                 "fips_code string, begin_date timestamp_ntz, end_date timestamp_ntz, event_type string, magnitude double")


def dates(df):
    return sorted(str(r.date) for r in df.collect())


def test_interval_steps_are_24_hours(spark):
    s = storm(spark, dt.datetime(2022, 1, 1, 23), dt.datetime(2022, 1, 2, 1))
    assert dates(J.expand_intervals(s)) == ["2022-01-01"]
    assert dates(J.expand_intervals(s, calendar_days=True)) == ["2022-01-01", "2022-01-02"]


def test_interval_caps_and_guards(spark):
    long = storm(spark, dt.datetime(2022, 1, 1), dt.datetime(2022, 3, 1))
    assert len(dates(J.expand_intervals(long))) == 8
    assert dates(J.expand_intervals(storm(spark, dt.datetime(2022, 1, 5), dt.datetime(2022, 1, 4)))) == []
    assert dates(J.expand_intervals(storm(spark, dt.datetime(2022, 1, 5, 9), None))) == ["2022-01-05"]


def test_interval_flag_is_inclusive_and_matches_loop(spark):
    rng = random.Random(8)
    spans = [(T0 + dt.timedelta(minutes=b), T0 + dt.timedelta(minutes=b + rng.randrange(0, 60))) for b in rng.sample(range(3000), 40)]
    times = [T0 + dt.timedelta(minutes=m) for m in rng.sample(range(3100), 300)] + [s for s, _ in spans] + [e for _, e in spans] + [None]
    rows = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(times)], "i int, run_start_time timestamp_ntz, customers_out double")
    iv = spark.createDataFrame(spans, "event_start timestamp_ntz, event_end timestamp_ntz")
    got = {r.i: r.storm_event for r in J.interval_flag(rows, iv).collect()}
    for i, t in enumerate(times):
        assert got[i] == int(t is not None and any(s <= t <= e for s, e in spans))


def test_unmapped_zones_drop_and_null_types_stay(spark):
    ev = spark.createDataFrame([(1, "Z", "001", "x"), (2, "z", "009", "x"), (3, None, "001", "51001"), (4, "C", "001", "51002")],
                               "id int, cz_type string, cz_fips string, fips_code string")
    zm = spark.createDataFrame([("001", "51149"), ("001", "51670"), ("001", "51149")], "zone string, fips_code string")
    got = sorted((r.id, r.fips_code) for r in J.expand_zones(ev, zm).collect())
    assert got == [(1, "51149"), (1, "51670"), (3, "51001"), (4, "51002")]


def test_fill_without_any_success_gives_zeros(spark):
    geo = spark.createDataFrame([("a", 37.0, -78.0), ("b", 38.0, -77.0)], "fips_code string, latitude double, longitude double")
    none = spark.createDataFrame([], "fips_code string, prcp_mm double, wt_fog int")
    got = sorted(tuple(r) for r in J.fill_from_nearest(none, geo, ["prcp_mm", "wt_fog"]).collect())
    assert got == [("a", 0.0, 0, 1), ("b", 0.0, 0, 1)]


def great_circle(a, b, c, d):
    import math
    a, b, c, d = map(math.radians, (a, b, c, d))
    return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2)))


@pytest.mark.parametrize("few", [4096, 0])
def test_nearest_breaks_ties_by_id(spark, few):
    p = spark.createDataFrame([("p", 0.0, 0.0)], "pid string, lat double, lon double")
    c = spark.createDataFrame([("d", 0.0, 1.0), ("b", 0.0, -1.0), ("c", 1.0, 0.0), ("z", 5.0, 5.0)], "cid string, lat double, lon double")
    r = J.nearest(p, c, "pid", "cid", few=few, shard=1).first()
    assert r.nearest_cid == "b" and r.dist_km == pytest.approx(111.19, abs=0.01)


def test_nearest_by_shards_is_exact_everywhere(spark, monkeypatch):
    """Clusters, poles and the date line; a place that half of the points share; more parts than one per shard."""
    rng = random.Random(9)
    centers = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(150)]
    centers += [(200 + i, 37.5 + rng.gauss(0, 0.01), -77.4 + rng.gauss(0, 0.01)) for i in range(150)]
    centers += [(400, 90.0, 0.0), (401, -90.0, 50.0), (402, 10.0, 179.999), (403, 10.0, -179.5), (404, None, 1.0), (405, float("nan"), 1.0)]
    points = [(rng.randrange(9), rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(200)]
    points += [(0, 37.6, -77.3)] * 200 + [(1, 89.9, 170.0), (2, -89.99, -20.0), (3, 10.0, 180.0), (4, 10.0, -180.0), (5, None, 3.0), (None, 37.5, -77.4)]
    df = spark.createDataFrame(points, "pid int, lat double, lon double")
    cf = spark.createDataFrame(centers, "cid int, lat double, lon double")
    monkeypatch.setattr(J, "PART", 40)
    known = [c for c in centers if c[1] is not None and c[1] == c[1]]
    for few, shard in ((10, 4), (10, 100), (4096, 1)):
        found = J.nearest(df, cf, "pid", "cid", few=few, shard=shard).collect()
        assert len(found) == len(points)
        for r in found:
            if r.lat is None:
                assert r.nearest_cid is None and r.dist_km is None
                continue
            best = min(great_circle(r.lat, r.lon, c[1], c[2]) for c in known)
            own = next(c for c in known if c[0] == r.nearest_cid)
            assert r.dist_km == pytest.approx(best, abs=1e-6) and great_circle(r.lat, r.lon, own[1], own[2]) == pytest.approx(best, abs=1e-6)



# -- polls, names -------------------------------------------------------------------------------

def test_missing_poll_resets_history(spark):
    p = spark.createDataFrame([(1, "a", 10.0), (2, "a", 15.0), (4, "a", 40.0), (5, "a", 0.5)], "poll_no long, fips_code string, customers double")
    got = {r.poll_no: (r.delta, r.pct_growth) for r in L.poll_delta(p).collect()}
    assert got == {1: (0.0, 0.0), 2: (5.0, 0.5), 4: (0.0, 0.0), 5: (-39.5, -39.5 / 40)}


def test_county_wins_an_alias_over_city(spark):
    geo = spark.createDataFrame([(1, "51600", "Fairfax city, Virginia"), (2, "51059", "Fairfax County, Virginia"),
                                 (3, "51700", "Norfolk city"), (4, "51701", "Norfolk city")], "ord int, fips string, county_name string")
    got = {r.alias: r.fips_code for r in L.alias_table(geo).collect()}
    assert got == {"fairfax": "51059", "fairfax county": "51059", "fairfax city": "51600", "norfolk": "51700", "norfolk city": "51700"}


# -- columns ------------------------------------------------------------------------------------

def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_padding_keeps_long_values_and_two_digit_years_pivot(spark):
    r = one(spark, a=C.zfill(F.lit("51001"), 3), b=C.zfill(F.lit("7"), 3),
            c=C.parse_timestamp(F.lit("28-APR-95 14:45:00"), ["dd-MMM-yy HH:mm:ss"]),
            d=C.parse_timestamp(F.lit("28-APR-22 14:45:00"), ["dd-MMM-yy HH:mm:ss"]), e=C.parse_timestamp(F.lit("junk"), ["MM/dd/yyyy"]))
    assert (r.a, r.b, r.e) == ("51001", "007", None)
    assert (r.c, r.d) == (dt.datetime(1995, 4, 28, 14, 45), dt.datetime(2022, 4, 28, 14, 45))


def test_clipped_exponent_and_counts(spark):
    r = one(spark, a=C.exp_prediction(F.lit(1000.0)), b=C.to_count(F.lit("12.9")), c=C.to_count(F.lit("")), d=C.to_number(F.lit("NaN")))
    assert r.a == pytest.approx(485165194.4097903) and (r.b, r.c, r.d) == (12, 0, None)


# -- metrics ------------------------------------------------------------------------------------

def test_empty_class_counts_as_zero(spark):
    df = spark.createDataFrame([(10.0, 12.0), (20.0, 500.0)], "label double, prediction double")
    r = M.tolerance_accuracy_abs(df).first()
    assert (r.short_outage_accuracy, r.long_outage_accuracy, r.long_outage_count, r.overall_accuracy) == (50.0, 0.0, 0, 50.0)


def test_auc_and_average_precision_with_ties(spark):
    rng = random.Random(9)
    rows = [(rng.randrange(2), rng.randrange(8) / 8) for _ in range(200)]
    df = spark.createDataFrame(rows, "label int, score double")
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    ap, tp, fp = 0.0, 0, 0
    for s in sorted(set(pos + neg), reverse=True):
        gain = pos.count(s)
        tp, fp = tp + gain, fp + neg.count(s)
        ap += gain / len(pos) * tp / (tp + fp)
    assert M.roc_auc(df).first().roc_auc == pytest.approx(auc)
    assert M.average_precision(df).first().average_precision == pytest.approx(ap)


def test_threshold_defaults_when_nothing_scores(spark):
    df = spark.createDataFrame([(0, 0.01), (0, 0.02)], "label int, score double")
    assert M.tune_threshold_f2(df).first().threshold == 0.5
    assert M.tune_threshold_balanced(df).first().threshold == 0.5


# -- features and files -------------------------------------------------------------------------

def test_stratified_split_keeps_shares_and_loses_nothing(spark):
    df = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(2000)], "id long, y int")
    train, test = X.random_split(df, ["id"], 0.2, label="y")
    assert train.count() + test.count() == 2000 and train.join(test, "id").count() == 0
    assert test.where("y = 1").count() == 40


def test_target_check_raises(spark):
    with pytest.raises(ValueError):
        X.require_binary_target(spark.createDataFrame([(2,)], "outage_occurred int"))
    with pytest.raises(ValueError):
        C.require_columns(spark.range(1), ["nope"])


def test_history_can_stop_before_the_test_period(spark):
    ev = S.sessionize(snaps(spark, [("51001", 0, 5), ("51001", 600, 5), ("51001", 615, 5), ("51001", 630, 5)]))
    got = X.duration_features(ev, stats_until=T0 + dt.timedelta(minutes=300)).collect()
    assert [r.county_median_duration for r in got] == [15.0, 15.0]


def test_missing_statistics_file_gives_empty_table(spark, tmp_path):
    df = readers.load_entity_stats(spark, str(tmp_path / "none.csv"))
    assert df.count() == 0 and "county_max_customers" in df.columns


def test_resumable_append_skips_done_entities(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "fips_code string, v int")
    writers.append_resumable(rows.where("v = 1"), path)
    writers.append_resumable(rows.withColumn("v", F.col("v") * 10), path)
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 20)]


def test_profile_counts_duplicates_and_nulls(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    r = R.profile(df).first()
    assert (r.num_records, r.duplicate_rows, r.missing_a, r.missing_b) == (3, 1, 0, 2)
