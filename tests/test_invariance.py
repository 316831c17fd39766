"""Results that must not depend on the session's time zone, the order of rows, null keys, layouts of files or counts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridpulse import session
from gridpulse.functions.columns import minutes_between
from gridpulse.operators import features, joins, rollups, sessions
from gridpulse.sources import readers, writers

SNAP = "fips_code string, run_start_time timestamp_ntz, customers_affected long, event_type string"


@pytest.fixture
def new_york(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    yield
    spark.conf.set("spark.sql.session.timeZone", before)


def test_minutes_do_not_skip_with_clocks(spark, new_york):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2022-03-13 01:30:00' AS a, TIMESTAMP_NTZ'2022-03-13 03:00:00.5' AS b")
    assert df.select(minutes_between("a", "b")).first()[0] == pytest.approx(90 + 0.5 / 60)


def test_sessions_in_another_zone(spark, new_york):
    day = dt.datetime(2022, 3, 13)
    rows = [("a", day + dt.timedelta(minutes=15 * i), 5 + i, None) for i in range(16)]
    events = sessions.sessionize(spark.createDataFrame(rows, SNAP)).collect()
    assert len(events) == 1 and events[0].duration_minutes == 15 * 16


def test_tied_rows_in_any_order(spark):
    at = dt.datetime(2022, 5, 1)
    rows = [("a", at, 5, "Hail"), ("a", at, 5, "Flood"), ("a", at, 9, "Flood"), ("a", at + dt.timedelta(minutes=15), 7, None)]
    found = [sessions.sessionize(spark.createDataFrame(r, SNAP)).drop("bucket").collect() for r in (rows, rows[::-1], rows[1:] + rows[:1])]
    assert found[0] == found[1] == found[2]
    gaps = [sorted(map(tuple, sessions.gap_to_previous(spark.createDataFrame(r, SNAP)).collect()), key=str) for r in (rows, rows[::-1])]
    assert gaps[0] == gaps[1]


def test_null_entities_form_no_group(spark):
    at = dt.datetime(2022, 5, 1)
    df = spark.createDataFrame([(None, at, 500, None), ("a", at, 500, None), ("a", None, 5, None)], SNAP)
    assert [r.fips_code for r in sessions.sessionize(df).collect()] == ["a"]
    assert [r.fips_code for r in rollups.occurrence_labels(df).collect()] == ["a"]
    assert sessions.island_ids(df).count() == sessions.gap_to_previous(df).count() == 1


def test_nearest_for_any_number_of_centers(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (1, 10.0, 10.0), (None, 10.0, 10.0), (2, None, 1.0), (1, 0.0, 0.0)],
                                   "pid int, lat double, lon double")
    centers = spark.createDataFrame([(i, float(i), float(i)) for i in range(12)] + [(99, None, None)], "cid int, lat double, lon double")
    got = [sorted(map(tuple, joins.nearest(points, centers, "pid", "cid", few=n, shard=k).collect()), key=str) for n, k in ((4096, 1), (5, 1), (3, 4), (0, 100))]
    assert got[0] == got[1] == got[2] == got[3] and len(got[0]) == 5
    assert sorted(str(r[3]) for r in got[0]) == ["0", "0", "10", "10", "None"]


def test_any_number_of_categories(spark):
    df = spark.range(1500).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("event_type"))
    assert len(features.categories_of(df, "event_type")) == 1500
    with pytest.raises(ValueError):
        features.categories_of(df, "event_type", limit=1000)


def test_each_file_by_its_own_header(spark, tmp_path):
    (tmp_path / "old").mkdir()
    (tmp_path / "a_2015.csv").write_text("fips_code,county,state,sum,run_start_time\n51001,A,Virginia,7,2015-01-01 00:00:00\n")
    (tmp_path / "b_2014.csv").write_text("run_start_time,customers_out,state,county,fips_code\n2014-01-01 00:15:00,9,Virginia,B,51003\n")
    (tmp_path / "c_2016.csv").write_text("fips_code,county,state,sum,run_start_time\n51005,C,Virginia,3,2016-01-01 00:00:00\n")
    want = [("51001", 7), ("51003", 9), ("51005", 3)]
    listed = [str(p) for p in sorted(tmp_path.glob("*.csv"))]
    for paths in (listed, f"{tmp_path}/*.csv", str(tmp_path)):
        rows = readers.load_snapshots(spark, paths).where("run_start_time IS NOT NULL").collect()
        assert sorted((r.fips_code, r.customers_affected) for r in rows) == want
    assert readers.read_delimited(spark, f"{tmp_path}/*.csv")._jdf.queryExecution().logical().toString().count("Relation") == 2


def test_an_empty_rerun_replaces_its_run(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0)], "fips_code string, scope double")
    for n, frame in ((1, df), (2, df), (2, df.limit(0))):
        writers.publish_predictions(frame, str(tmp_path / "p"), f"{n:03d}")
    assert [str(r.run_ts) for r in spark.read.parquet(str(tmp_path / "p")).collect()] == ["1"]


def test_a_poll_without_records_clears_its_partition(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "poll_no int, fips_code string, scope double")
    name = F.lpad(F.col("poll_no").cast("string"), 3, "0")
    for rows in (df, df.where("poll_no = 1")):
        writers.publish_runs(rows, str(tmp_path / "p"), name, df.select("poll_no"))
    assert [(r.run_ts, r.scope) for r in spark.read.parquet(str(tmp_path / "p")).collect()] == [(1, 1.0)]


def test_stage_tables_can_be_removed(spark, tmp_path):
    stored = session.cut_lineage(spark.range(3), "probe")
    path = session._MADE[-1]
    assert stored.count() == 3
    session.drop_path(spark, path)
    assert path not in session._MADE
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def _stream(spark, tmp_path, batches, **options):
    """Each list of rows arrives as one file, and the stream is stopped and resumed in between."""
    from gridpulse.streaming import jobs
    source, target, state, progress = (str(tmp_path / n) for n in ("in", "out", "state", "progress"))
    for rows in batches:
        df = spark.createDataFrame(rows, SNAP).coalesce(1)
        df.write.mode("append").parquet(source)
        stream = jobs.file_stream(spark, source, df.schema)
        jobs.session_stream(stream, progress, target, state, every=None, **options).awaitTermination()
    return jobs.read_sessions(spark, target, state), target, tmp_path / "state"


def test_rows_within_the_lateness_are_chained(spark, tmp_path):
    import random
    rng, day = random.Random(4), dt.datetime(2022, 5, 1)
    rows = [(e, day + dt.timedelta(minutes=15 * i), rng.choice([0, 3, 8, 9]), None) for e in "abc" for i in range(rng.randrange(300), 400)]
    late = sorted(rows, key=lambda r: r[1] + dt.timedelta(minutes=rng.uniform(0, 600)))
    batches = [late[i:i + 80] for i in range(0, len(late), 80)]
    found, target, state = _stream(spark, tmp_path, batches, late_minutes=600)
    want = sessions.sessionize(spark.createDataFrame(rows, SNAP))
    columns = [c for c in want.columns if c in found.columns]
    assert sorted(map(str, found.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))
    assert found.where("closed").count() > 10 and found.where("NOT closed").count() > 0
    assert spark.read.schema(SNAP).parquet(f"{target}_late").count() == 0
    # However many batches came, state is kept for the last two, and of rows only the last hours.
    assert sorted(p.name for p in state.glob("batch=*")) == [f"batch={n}" for n in (len(batches) - 2, len(batches) - 1)]
    kept = spark.read.parquet(f"{state}/batch={len(batches) - 1}/rows")
    assert kept.count() < len(rows) / 4 and spark.read.parquet(f"{state}/batch={len(batches) - 1}/runs").count() <= 3


def test_later_rows_are_set_aside_and_change_nothing(spark, tmp_path):
    day = dt.datetime(2022, 5, 1)
    found, target, _ = _stream(spark, tmp_path, [
        [("a", day + dt.timedelta(hours=10), 5, None), ("b", day, 3, None)],
        [("a", day + dt.timedelta(hours=2), 7, None), ("b", day + dt.timedelta(hours=9, minutes=15), 4, None)],
        [("b", day + dt.timedelta(hours=9, minutes=30), 4, None), (None, day, 1, None)]], late_minutes=60)
    assert sorted((r.fips_code, r.duration_minutes) for r in found.collect()) == [("a", 15), ("b", 15), ("b", 30)]
    assert [(r.fips_code, r.customers_affected) for r in spark.read.parquet(f"{target}_late").collect()] == [("a", 7)]


def test_current_tables_keep_a_fixed_number_of_folders(spark, tmp_path):
    from gridpulse.streaming import jobs
    target, want, seen = str(tmp_path / "current"), {}, []
    write = jobs.current_writer(target, ["k"], every=3)
    for n in range(11):
        rows = [(k, n) for k in range(n % 4 + 1)]
        want |= dict(rows)
        write(spark.createDataFrame(rows, "k long, v long"), n)
        write(spark.createDataFrame(rows, "k long, v long"), n)           # a rerun of the batch
        seen.append(len(list((tmp_path / "current").iterdir())))
        assert {r.k: r.v for r in jobs.read_current(spark, target, ["k"]).collect()} == want
    assert max(seen) <= 8


def test_headers_are_read_in_tasks(spark, tmp_path):
    import gzip
    for n in range(60):
        (tmp_path / f"f{n:02d}.csv").write_text(f"a,b{n % 2}\r\n{n},x\n")
    (tmp_path / "z.csv.gz").write_bytes(gzip.compress(b"a,b0\n99,y\n"))
    (tmp_path / "_skipped.csv").write_text("no\n")
    (tmp_path / "empty.csv").write_text("")
    found = readers.files_by_header(spark, [str(tmp_path)])
    assert {h: len(f) for h, f in found.items()} == {"a,b0": 31, "a,b1": 30}
    assert readers.read_delimited(spark, str(tmp_path)).count() == 61
    assert readers.files_by_header(spark, [f"{tmp_path}/nothing*.csv"]) == {}
