import math

import pytest
from pyspark.sql import functions as F

from fleetpulse.operators import ranking, rollups, selection
from fleetpulse.operators import rows as R
from conftest import SPLITS
from fleetpulse.plans.views import live_summary, live_table


def test_cpu_totals_divide_after_summing(spark):
    ends = [("a", "1", 600_000), ("a", "1", 600_000), ("a", "1", None), ("a", None, 5_000_000), ("a", "2", 0), ("b", "1", 999_999)]
    df = spark.createDataFrame(ends, "app_id string, executor_id string, cpu_ns bigint")
    assert {(r.app_id, r.executor_id): r.cpu_time_ms for r in rollups.cpu_totals(df).collect()} == {("a", "1"): 1, ("b", "1"): 0}


def test_latest_cpu(spark):
    df = spark.createDataFrame(
        [("a", "1", 5, 10.0), ("a", "1", 7, 20.0), ("a", "1", 6, 30.0), ("a", "1", 8, None), ("a", None, 9, 1.0)],
        "app_id string, executor_id string, sample_seq bigint, cpu_pct double",
    )
    assert [tuple(r) for r in rollups.latest_cpu_pct(df).collect()] == [("a", "1", 20.0)]


def test_summary_averages_skip_nulls_and_sums_do_not_stay_null(samples):
    mb = 1048576
    table = samples(
        {"poll_seq": 1, "total_gc_ms": 0},
        {"poll_seq": 2, "total_gc_ms": 600, "peak_jvm_heap": 400 * mb, "max_memory": 300 * mb, "active_tasks": 2},
        {"poll_seq": 2, "executor_id": "2", "failed_tasks": 3, "rss": 7 * mb, "on_heap_unified": 2 * mb},
        {"poll_seq": 2, "executor_id": "3", "is_active": False, "failed_tasks": 9},
    )
    row = live_summary(table).first()
    assert (row.executors, row.unhealthy, row.active_tasks, row.failed_tasks) == (2, 2, 2, 3)
    assert (row.avg_heap_pct, row.max_heap_pct, row.avg_gc_delta_ms) == (50, 50, 600)
    assert (row.total_memory_mb, row.disk_used_mb, row.max_on_heap_unified_mb) == (7, 0, 2)
    assert len(row) == 16


def test_live_table_filters(samples, spark):
    table = samples({"poll_seq": 1}, {"poll_seq": 2, "failed_tasks": 1}, {"poll_seq": 2, "executor_id": "2"})
    selected = spark.createDataFrame([("app", "2")], "app_id string, executor_id string")
    ids = lambda df: sorted(r.executor_id for r in df.collect())
    assert ids(live_table(table)) == ["1", "2"]
    assert ids(live_table(table, only_unhealthy=True)) == ["1"]
    assert ids(live_table(table, selected=selected)) == ["2"]
    assert ids(live_table(table, selected=selected, only_unhealthy=True)) == []


def test_no_rows_once_all_executors_are_dead(samples):
    assert live_table(samples({"poll_seq": 1}, {"poll_seq": 2, "is_active": False})).count() == 0


def test_status_states(samples):
    rows = R.executor_rows(samples({"poll_seq": 1, "peak_jvm_heap": 5, "active_tasks": 2}, {"poll_seq": 1, "executor_id": "2", "failed_tasks": 4}))
    one = lambda *a, **k: rollups.status(rows, *a, **k).first()
    shown = one(F.lit(True))
    assert (shown.state, shown.level) == ("ok", "warn")
    assert shown.message == "Shown executors: 2 | unhealthy: 1 | heap available for 1 | active tasks: 2 | failed tasks: 4."
    assert one(F.col("executor_id") == "1").level == "normal"
    dead = rollups.status(rows, F.lit(True), samples=samples({"poll_seq": 1}, {"poll_seq": 1, "app_id": "dead", "is_active": False}))
    assert {r.app_id: r.message for r in dead.collect()}["dead"] == "No active executors found."
    assert one(F.lit(False), only_unhealthy=True).message == "No unhealthy executors with current filters."
    assert one(F.lit(False), mode="selected").message.startswith("No executors selected")
    no_heap = rollups.status(rows.withColumn("heap_bytes", F.lit(None).cast("bigint")), F.lit(True)).first()
    assert (no_heap.state, no_heap.level) == ("no_heap", "warn")


def test_rss_warning(samples):
    table = samples({"poll_seq": 1}, {"poll_seq": 2, "rss": 5}, {"poll_seq": 3}, {"poll_seq": 1, "app_id": "none"})
    rows = R.executor_rows(table)
    found = {r.app_id: (r.rss_available, r.rss_warning) for r in rollups.rss_availability(rows).collect()}
    assert found == {"app": (True, False), "none": (False, True)}
    assert not any(r.rss_warning for r in rollups.rss_availability(rows, "estimated").collect())
    for split in SPLITS:
        seen = rollups.rss_availability_by_poll(rows, split).filter("app_id = 'app'").collect()
        assert {r.poll_seq: r.rss_available for r in seen} == {1: False, 2: True, 3: True}


def test_peak_source_flag(samples):
    rows = R.executor_rows(samples({"poll_seq": 1, "cur_jvm_heap": 5}, {"poll_seq": 1, "app_id": "b", "peak_jvm_heap": 5}))
    assert {r.app_id: r.uses_peak_source for r in rollups.peak_source_used(rows).collect()} == {"app": False, "b": True}


def _nice(value):
    if value is None or not math.isfinite(value) or value <= 0:
        return 1
    power = 10.0 ** math.floor(math.log(value) / math.log(10))
    return next((s for s in rollups.NICE_STEPS if value / power <= s), 10) * power


def test_nice_ceiling(evaluate):
    values = [None, 0.0, -5.0, float("nan"), float("inf"), 1.0, 1.1, 1.21, 99.0, 100.0, 1000.0, 1100.0, 1201.0, 0.07, 8.5, 12345.0]
    assert evaluate(rollups.nice_ceiling, [(v,) for v in values], "v double") == [_nice(v) for v in values]
    assert [_nice(v) for v in (1100, 1201, 99)] == [1200, 1500, 100]


def test_axis_scale(spark):
    df = spark.createDataFrame([("a", "cpu", 50.0), ("a", "cpu", 100.0), ("a", "gc", None)], "app_id string, chart string, value double")
    assert {r.chart: r.axis_max for r in rollups.axis_scale(df).collect()} == {"cpu": 120, "gc": 1}


def test_latest_non_null(spark):
    df = spark.createDataFrame(
        [("a", "1", 1, 1.0, None), ("a", "1", 2, 2.0, None), ("a", "1", 3, None, None)],
        "app_id string, executor_id string, poll_seq bigint, x double, y double",
    )
    assert tuple(rollups.latest_non_null(df, ["x", "y"]).first()) == ("a", "1", 2.0, None)


def test_top_offenders(samples):
    table = samples(*[{"poll_seq": 1, "executor_id": e, "active_tasks": n, "rss": None} for e, n in (("10", 8), ("9", 8), ("1", 8), ("2", 16), ("3", None))])
    found = ranking.top_offenders(R.executor_rows(table)).filter("metric = 'saturation_pct'").orderBy("rank").collect()
    assert [(r.executor_id, r.value) for r in found] == [("2", 400), ("1", 200), ("9", 200)]
    assert ranking.top_offenders(R.executor_rows(table)).filter("metric = 'total_memory_mb'").count() == 0
    assert len(ranking.OFFENDER_METRICS) == 7


@pytest.mark.parametrize(
    "key, direction, expected",
    [
        ("saturation_pct", "desc", ["9", "10", "1", "2"]),
        ("saturation_pct", "asc", ["1", "9", "10", "2"]),
        ("saturation_pct", None, ["9", "10", "1", "2"]),
        ("executor_id", None, ["1", "2", "9", "10"]),
        ("host", "desc", ["9", "10", "2", "1"]),
        ("host", None, ["1", "2", "10", "9"]),
    ],
)
def test_table_sort(samples, key, direction, expected):
    data = [("10", 8, "b2"), ("9", 8, "b10"), ("1", 4, ""), ("2", None, "")]
    table = samples(*[{"poll_seq": 1, "executor_id": e, "active_tasks": a} for e, a, _ in data])
    hosts = F.create_map(*[F.lit(x) for e, _, h in data for x in (e, h)])
    rows = R.executor_rows(table).withColumn("host", hosts[F.col("executor_id")])
    found = [r.executor_id for r in ranking.sort_rows(rows, key, direction).collect()]
    if key == "host":  # empty names are last in both directions, ordered by id
        expected = [e for e in expected if e in ("9", "10")] + ["1", "2"]
    assert found == expected
    with pytest.raises(ValueError):
        ranking.sort_rows(rows, key, "up")


def test_top_rows(samples):
    table = samples(*[{"poll_seq": 1, "executor_id": str(i), "total_shuffle_read": i % 3} for i in range(1, 8)])
    assert [r.executor_id for r in ranking.top_rows(R.executor_rows(table), "shuffle_read_mb", 3).collect()] == ["2", "5", "1"]


def test_selection(spark, samples):
    rows = samples({"poll_seq": 1}, {"poll_seq": 1, "executor_id": "2"}, {"poll_seq": 1, "app_id": "b"})
    pick = lambda *ids: spark.createDataFrame(list(ids), "app_id string, executor_id string")
    found = selection.apply_selection(rows, pick(("app", "2"), ("app", "2"))).collect()
    assert [(r.app_id, r.executor_id) for r in found] == [("app", "2")]
    assert selection.apply_selection(rows, pick(("app", "2")), "all").count() == 3
    with pytest.raises(ValueError):
        selection.apply_selection(rows, pick(("app", "2")), "none")
    state = {r.app_id: tuple(r)[1:] for r in selection.selection_state(rows, pick(("app", "2"), ("app", "77"), ("b", "1"), ("c", "1"))).collect()}
    assert state == {"app": (2, 2, 1, "some"), "b": (1, 1, 1, "all"), "c": (1, 0, 0, "none")}


def test_series_order_starts_with_the_driver(spark):
    ids = [("10", "m"), ("2", "m"), ("driver", "m"), ("abc", "m"), ("1", "k")]
    df = spark.createDataFrame(ids, "executor_id string, metric string")
    assert [r.executor_id for r in ranking.sort_series(df, ["metric"]).collect()] == ["1", "driver", "2", "10", "abc"]
