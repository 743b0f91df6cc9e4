import pytest

from fleetpulse import Settings
from fleetpulse.operators import asof, rows as R
from fleetpulse.operators.ordered import Split
from fleetpulse.schemas import PROCESS_CPU

from conftest import SPLITS


def by_poll(df, *columns):
    return {r.poll_seq: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}


@pytest.mark.parametrize("split", SPLITS)
def test_gc_delta_baseline_skips_nulls_and_follows_resets(samples, split):
    values = [None, 100, 150, None, 200, 50, 60, 60]
    table = samples(*[{"poll_seq": i + 1, "total_gc_ms": v} for i, v in enumerate(values)])
    found = by_poll(R.with_deltas(table, split), "gc_delta_ms")
    # first reading, null reading and reset give null; the lower value is the next baseline
    assert found == {1: None, 2: None, 3: 50, 4: None, 5: 50, 6: None, 7: 10, 8: 0}


@pytest.mark.parametrize("split", SPLITS)
def test_cpu_cascade_branches(samples, split):
    table = samples(
        {"poll_seq": 1, "wall_ms": 0, "cpu_time_ms": 0, "total_duration_ms": 0},
        {"poll_seq": 2, "wall_ms": 100, "cpu_time_ms": 10, "total_duration_ms": 10},
        {"poll_seq": 3, "wall_ms": 1100, "cpu_time_ms": 2010, "total_duration_ms": 9999},
        {"poll_seq": 4, "wall_ms": 2100, "cpu_time_ms": 2010, "total_duration_ms": 9999},
        {"poll_seq": 5, "wall_ms": 3100, "cpu_time_ms": 2010, "total_duration_ms": 10999, "active_tasks": 2},
        {"poll_seq": 6, "wall_ms": 4100, "cpu_time_ms": 1, "total_duration_ms": 1, "active_tasks": 2},
        {"poll_seq": 7, "wall_ms": 5100, "cpu_time_ms": None, "total_duration_ms": 401, "os_cpu_pct": 12.5},
        {"poll_seq": 8, "wall_ms": 6100, "cpu_time_ms": 50, "total_duration_ms": 801},
        {"poll_seq": 9, "wall_ms": 7100, "cpu_time_ms": 50, "total_duration_ms": None, "active_tasks": None},
        {"poll_seq": 10, "wall_ms": 8100, "cpu_time_ms": 90, "max_tasks": 0, "total_cores": 0},
    )
    found = by_poll(R.with_deltas(table, split), "cpu_pct", "cpu_source")
    assert found == {
        1: (None, "wait"),
        2: (None, "wait"),
        3: (50.0, "TaskCpuTime"),
        4: (0.0, "TaskCpuTime"),
        5: (25.0, "totalDuration"),
        6: (None, "-"),
        7: (12.5, "OS"),
        8: (10.0, "totalDuration"),
        9: (0.0, "TaskCpuTime"),
        10: (None, "-"),
    }


@pytest.mark.parametrize("split", SPLITS)
def test_previous_sample_survives_gaps_but_only_while_active(samples, split):
    table = samples(
        {"poll_seq": 1, "wall_ms": 0, "cpu_time_ms": 0, "total_duration_ms": 0},
        {"poll_seq": 2, "wall_ms": 1000, "cpu_time_ms": 800, "is_active": False},
        {"poll_seq": 9, "wall_ms": 10000, "cpu_time_ms": 4000, "total_duration_ms": 0},
    )
    found = by_poll(R.executor_rows(table, split=split), "cpu_pct")
    assert found == {1: None, 9: 10.0}


def test_rows_are_per_application(samples):
    table = samples(
        {"poll_seq": 1, "total_gc_ms": 10}, {"poll_seq": 2, "total_gc_ms": 30, "app_id": "other"}, {"poll_seq": 3, "total_gc_ms": 15}
    )
    found = {(r.app_id, r.poll_seq): r.gc_delta_ms for r in R.executor_rows(table).collect()}
    assert found == {("app", 1): None, ("other", 2): None, ("app", 3): 5}


def test_flat_row(samples):
    mb = 1048576
    table = samples(
        {
            "poll_seq": 1,
            "host_port": "h:1",
            "max_memory": 300 * mb,
            "peak_jvm_heap": 400 * mb,
            "peak_jvm_off_heap": 20 * mb,
            "rss": 500 * mb,
            "total_gc_ms": 1500,
            "total_duration_ms": 30000,
            "active_tasks": 6,
            "total_shuffle_read": None,
            "rdd_blocks": 3,
        }
    )
    row = R.executor_rows(table).first()
    assert (row.host, row.heap_mb, row.heap_max_mb) == ("h:1", 400, 800)
    assert (row.heap_pct, row.total_memory_mb, row.total_memory_source, row.native_other_mb) == (50, 500, "rss", 80)
    assert (row.gc_seconds, row.gc_pct, row.saturation_pct, row.shuffle_read_mb) == (1.5, 5, 150, 0)
    assert row.off_heap_unified_mb is None and row.disk_used_mb is None and row.is_unhealthy is False
    estimated = R.executor_rows(table, Settings(memory_mode="estimated", warn_pct=50)).first()
    assert (estimated.total_memory_mb, estimated.total_memory_source) == (420, "estimated")
    assert estimated.native_other_mb is None and estimated.is_unhealthy is True
    assert len(R.executor_rows(table).columns) == 37 + 3  # application, poll and wall time beside the 37 row fields


def test_saturation_threshold_is_separate(samples):
    table = samples({"poll_seq": 1, "active_tasks": 15}, {"poll_seq": 2, "active_tasks": 16})
    assert by_poll(R.executor_rows(table), "is_unhealthy") == {1: False, 2: True}
    assert by_poll(R.executor_rows(table, Settings(sat_warn_pct=500)), "is_unhealthy") == {1: False, 2: False}


@pytest.mark.parametrize("split", SPLITS)
def test_change_needs_the_adjacent_poll(samples, split):
    mb = 1048576
    polls = [(10, 1), (11, 2), (13, 3), (20, 3), (21, 1)]
    mine = [{"poll_seq": p, "rss": v * mb} for p, v in polls]
    other = [{"poll_seq": 12, "executor_id": "2", "is_active": False}]
    found = by_poll(R.change_directions(samples(*mine, *other), split=split), "total_memory_mb", "heap_mb")
    # poll 12 exists, so 13 does not follow 11 directly; 20 follows 13
    assert found == {10: (None, None), 11: ("up", None), 13: (None, None), 20: (None, None), 21: ("down", None)}


def test_change_with_polls_that_are_numbered_already(samples):
    table = samples(*[{"poll_seq": p, "active_tasks": a} for p, a in ((1, 1), (2, 2), (4, 1), (5, 1))])
    found = by_poll(R.change_directions(table, ordinal="poll_seq"), "active_tasks")
    assert found == {1: None, 2: "up", 4: None, 5: None}


def test_change_metrics_are_complete(samples):
    found = R.change_directions(samples({"poll_seq": 1}))
    assert len(R.CHANGE_METRICS) == 27 and set(R.CHANGE_METRICS) <= set(found.columns)


PROCESS = [
    # seq, wall, cpu, expected
    (1, 0, None, None),
    (2, 100, 50, None),
    (3, 200, 90, 40 * 100.0 / (100 * 2)),
    (4, 300, None, None),
    (5, 400, 130, 40 * 100.0 / (100 * 2)),  # CPU spans two intervals, wall only one
    (6, 400, 140, None),
    (7, 500, 100, -40 * 100.0 / (100 * 2)),
    (8, 600, -1, None),
    (9, 700, 110, 10 * 100.0 / (100 * 2)),
]


@pytest.mark.parametrize("split", SPLITS)
def test_process_cpu_baselines_differ(spark, split):
    table = spark.createDataFrame([("a", "1", s, w, c, 2) for s, w, c, _ in PROCESS], PROCESS_CPU)
    found = {r.sample_seq: r.cpu_pct for r in R.process_cpu_pct(table, split).collect()}
    assert found == {s: e for s, _, _, e in PROCESS}


@pytest.mark.parametrize("split", SPLITS)
def test_cpu_time_as_of_poll(spark, split):
    polls = spark.createDataFrame([("a", "1", p) for p in (1, 3, 5, 9)] + [("a", "2", 5)], "app_id string, executor_id string, poll_seq bigint")
    ends = [("a", "1", 2, 1_500_000), ("a", "1", 2, 600_000), ("a", "1", 3, 400_000), ("a", "1", 9, 1_000_000), ("a", "1", 10, 5_000_000)]
    ends += [("a", None, 1, 9_000_000), ("a", "1", 1, None), ("a", "1", 1, -4), ("a", "3", 1, 7_000_000)]
    task_ends = spark.createDataFrame(ends, "app_id string, executor_id string, poll_seq bigint, cpu_ns bigint")
    found = {(r.executor_id, r.poll_seq): r.cpu_time_ms for r in asof.cpu_time_as_of(polls, task_ends, split=split).collect()}
    # events at the poll's own time count; nanoseconds are summed before the division
    assert found == {("1", 1): 0, ("1", 3): 2, ("1", 5): 2, ("1", 9): 3, ("2", 5): 0}


@pytest.mark.parametrize("split", SPLITS)
def test_process_cpu_as_of_poll(spark, split):
    polls = spark.createDataFrame([("a", "1", p) for p in (1, 3, 90)] + [("a", "2", 5)], "app_id string, executor_id string, poll_seq bigint")
    published = [("a", "1", 2, 1, 10.0), ("a", "1", 2, 2, 20.0), ("a", "1", 3, 3, None), ("a", "1", 95, 4, 50.0)]
    samples = spark.createDataFrame(published, "app_id string, executor_id string, poll_seq bigint, sample_seq bigint, cpu_pct double")
    found = {(r.executor_id, r.poll_seq): r.os_cpu_pct for r in asof.process_cpu_as_of(polls, samples, split=split).collect()}
    assert found == {("1", 1): None, ("1", 3): 20.0, ("1", 90): 20.0, ("2", 5): None}


def test_splits_agree_on_derived_data(derived):
    keys = ["app_id", "executor_id", "poll_seq"]
    plain = R.executor_rows(derived, split=None).orderBy(*keys).collect()
    assert plain == R.executor_rows(derived, split=Split(40, 25)).orderBy(*keys).collect()
    assert len(plain) > 900
