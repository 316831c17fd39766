"""Plans worth keeping: shuffle counts, pruned scans, pushed filters."""

import re

from conftest import SF_DIR

import __spark_entry__ as entry

QUERIES = entry.queries()


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_sessions_shuffle_twice(spark):
    plan = plan_of(QUERIES["ops1_sessionize"](spark, SF_DIR))
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 2


def test_scan_reads_needed_columns_only(spark):
    plan = plan_of(QUERIES["agg1_occurrence_labels"](spark, SF_DIR))
    schema = re.search(r"ReadSchema: (\S+)", plan).group(1)
    assert "props" not in schema and "EqualTo(event_type,error)" in plan


def test_history_scans_the_snapshots_once(spark):
    df = QUERIES["agg7_entity_stats"](spark, SF_DIR)
    df.collect()
    plan = plan_of(df)
    # What is left to run reads the counted values, which are stored in the order of entity and value.
    assert "events.parquet" not in plan and len(re.findall(r"percentile\(", plan)) == 0
    assert len(re.findall(r"Exchange hashpartitioning", plan.split("== Initial Plan ==")[0])) <= 5


def test_one_hot_and_filters_need_no_extra_shuffle(spark):
    plan = plan_of(QUERIES["prj5_one_hot"](spark, SF_DIR))
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 2


def scans(df, table: str) -> int:
    df.collect()
    plan = plan_of(df)
    final = plan.split("== Initial Plan ==")[0]
    return len(re.findall(rf"(?:FileScan|Scan) parquet .*?{table}\.parquet", final))


def test_joins_read_their_big_side_once(spark):
    assert scans(QUERIES["jn1_interval_join"](spark, SF_DIR), "lineitem") == 1
    assert scans(QUERIES["jn6_interval_flag"](spark, SF_DIR), "events") == 1      # the intervals are a stage table by then
    for name in ("jn8_nearest_centroid", "win9_nearest_rank"):
        assert "Subquery" not in plan_of(QUERIES[name](spark, SF_DIR))
