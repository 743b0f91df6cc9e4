import re

import pytest
from pyspark.sql import functions as F

from fleetpulse.operators import asof, history as H, ranking, series
from fleetpulse.operators import rows as R
from fleetpulse.operators.rollups import cpu_totals, latest_cpu_pct, summarise
from fleetpulse.schemas import SAMPLES
from fleetpulse.sources import history_store


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, derived, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("samples"))
    derived.write.mode("overwrite").parquet(path)
    return spark.read.schema(SAMPLES).parquet(path)


@pytest.fixture
def no_broadcast(spark):
    """Plans as they are when no side is small enough to broadcast."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def exchanges(plan):
    return re.findall(r"Exchange (\w+\([^)]*\))", plan)


def test_rows_need_one_exchange_when_keys_are_small(stored):
    plan = plan_of(R.executor_rows(stored, split=None))
    assert [re.sub(r"#\d+", "", e) for e in exchanges(plan)] == ["hashpartitioning(app_id, executor_id, 4)"]


def test_rows_are_shuffled_once_by_segment(stored, no_broadcast):
    plan = plan_of(R.executor_rows(stored))
    assert "SortMergeJoin" in plan
    row_side = plan[: plan.index("partial_max_by")]
    # one exchange of the sample rows; the other two move the summaries, one row per segment
    assert len([e for e in exchanges(row_side) if "_segment" in e]) == 3
    # the rows are sorted once, for the window; the join uses that order
    assert len(re.findall(r"Sort \[[^\]]*poll_seq", plan)) == 1
    assert "Batched: true" in plan and "is_active" in re.findall(r"PushedFilters: \[([^\]]*)\]", plan)[0]


def test_no_plan_pairs_rows_freely(stored, no_broadcast):
    polls = stored.select("app_id", "executor_id", "poll_seq")
    ends = stored.select("app_id", "executor_id", "poll_seq", F.col("cpu_time_ms").alias("cpu_ns"))
    history = H.to_history(R.executor_rows(stored))
    frames = [
        R.change_directions(stored),
        asof.cpu_time_as_of(polls, ends),
        series.live_grid(stored),
        series.stacked_bands(series.live_grid(stored)),
        H.history_grid(H.bounded(history, 2 * 10**12)),
        ranking.last_polls(stored, 120),
        ranking.top_offenders(R.executor_rows(stored)),
    ]
    for frame in frames:
        plan = plan_of(frame)
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
        assert "SinglePartition" not in plan


def test_group_limits_run_before_the_shuffle(stored):
    for frame in (ranking.top_offenders(R.executor_rows(stored, split=None)), ranking.last_polls(stored, 120)):
        plan = plan_of(frame)
        assert "Partial" in "".join(re.findall(r"WindowGroupLimit.*", plan))


def test_aggregates_hash_and_combine_before_the_shuffle(stored):
    ends = stored.select("app_id", "executor_id", F.col("cpu_time_ms").alias("cpu_ns"))
    published = stored.select("app_id", "executor_id", F.col("poll_seq").alias("sample_seq"), F.col("os_cpu_pct").alias("cpu_pct"))
    for frame in (cpu_totals(ends), latest_cpu_pct(published), summarise(R.executor_rows(stored, split=None))):
        plan = plan_of(frame)
        assert "partial_" in plan and "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


def test_global_top_rows_need_no_full_sort(stored):
    assert "TakeOrderedAndProject" in plan_of(ranking.top_rows(R.executor_rows(stored, split=None), "heap_pct", 3))


def test_range_filter_reaches_the_scan(spark, stored, tmp_path):
    path = str(tmp_path / "h")
    history_store.append(H.to_history(R.executor_rows(stored, split=None)), path)
    view = H.in_range(history_store.read(spark, path, apps=["app-1"], since_ms=10**12), 10**12, 5).select("executor", "heapMB")
    plan = plan_of(view)
    assert "GreaterThanOrEqual(timeMs" in plan
    assert re.search(r"PartitionFilters: \[[^\]]*bucket[^\]]*day", plan)
    assert re.search(r"ReadSchema: struct<appId:string,executor:string,heapMB:double,timeMs:bigint,version:bigint>", plan)
