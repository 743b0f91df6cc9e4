import pytest
from pyspark.sql import functions as F

from fleetpulse.operators import series
from fleetpulse.operators.rollups import latest_non_null

from conftest import SPLITS

MB = 1048576
GRID = "app_id string, executor_id string, poll_ord bigint, heap double, overhead double, off_heap double, total double, rss double, gc_delta double, saturation double, cpu double"


def grid(spark, rows, executor="1"):
    """Grid rows from (heap, overhead, off_heap, rss)."""
    full = [("a", executor, i + 1, h, o, f, None if h is o is f is None else (h or 0) + (o or 0) + (f or 0), r, None, None, None) for i, (h, o, f, r) in enumerate(rows)]
    return spark.createDataFrame(full, GRID)


def bands(df, *args, **kwargs):
    found = {}
    for r in series.stacked_bands(df, *args, **kwargs).orderBy("poll_ord").collect():
        found.setdefault(r.series, []).append((r.base, r.upper))
    return found


def test_points_are_rounded_and_clipped(samples):
    table = samples(
        {"poll_seq": 1, "wall_ms": 0, "cpu_time_ms": 0, "total_gc_ms": 1},
        {"poll_seq": 2, "wall_ms": 1000, "cpu_time_ms": 90000, "peak_jvm_heap": 1234567, "total_gc_ms": 8, "active_tasks": 1, "max_tasks": 3},
    )
    row = series.series_points(table).filter("poll_seq = 2").first()
    assert (row.heap, row.total, row.gc_delta, row.saturation, row.cpu, row.rss) == (1.18, 1.18, 7.0, 33.33, 200.0, None)


@pytest.mark.parametrize("split", SPLITS)
def test_live_grid_fills_gaps_and_keeps_known_executors(samples, split):
    table = samples(
        {"poll_seq": 1, "executor_id": "old", "rss": MB},
        {"poll_seq": 2, "rss": MB},
        {"poll_seq": 5, "rss": 2 * MB},
        {"poll_seq": 9, "executor_id": "new", "rss": 3 * MB},
        {"poll_seq": 9, "executor_id": "dead", "rss": 9 * MB, "is_active": False},
    )
    found = {(r.executor_id, r.poll_ord): r.rss for r in series.live_grid(table, 3, split).collect()}
    assert found == {
        **{("old", i): None for i in (1, 2, 3)},
        **{("1", 1): 1, ("1", 2): 2, ("1", 3): None},
        **{("new", 1): None, ("new", 2): None, ("new", 3): 3},
    }


def test_bands_stack_by_latest_value(spark):
    df = grid(spark, [(1.0, 5.0, None, 10.0), (10.0, 2.0, 3.0, 12.0), (None, None, 4.0, None)])
    found = bands(df)
    # latest: heap 10, off-heap 4, overhead 2
    assert found["H"] == [(0, 1), (0, 10), (0, None)]
    assert found["F"] == [(1, None), (10, 13), (0, 4)]
    assert found["O"] == [(1, 6), (13, 15), (4, None)]
    # a gap only at the first poll; at the second RSS is below the sum, at the third it is missing
    assert found["N"] == [(6, 10), (15, 15), (4, None)]
    assert found["T(rss)"] == [(None, 10), (None, 12), (None, None)]


def test_equal_latest_values_keep_the_band_order(spark):
    found = bands(grid(spark, [(2.0, 2.0, 2.0, None)]))
    assert (found["H"], found["O"], found["F"]) == ([(0, 2)], [(2, 4)], [(4, 6)])
    assert "N" not in found and "T(rss)" not in found


def test_bands_follow_the_choice_and_the_mode(spark):
    df = grid(spark, [(4.0, 1.0, None, 9.0)])
    assert set(bands(df, [])) == {"H"}
    assert bands(df, ["native_other"]) == {"N": [(0, 4)]}  # the gap is taken against all counters, shown or not
    assert bands(df, ["heap", "total", "native_other"], mode="estimated") == {"H": [(0, 4)], "T": [(None, 5)]}
    with pytest.raises(ValueError):
        series.stacked_bands(df, ["other"])


def test_legend(spark):
    df = grid(spark, [(1.04, 2.0, None, 9.0), (None, 3.25, None, None)]).unionByName(grid(spark, [(8.0, 1.0, 1.0, 9.0)], "2"))
    latest = latest_non_null(df, series.SERIES, order="poll_ord")
    text = lambda **k: {r.executor_id: r.label for r in series.legend(latest, **k).collect()}
    assert text() == {"1": "H 1.0 | O 3.3 | F - | N 4.7 | T(rss) 9.0", "2": "H 8.0 | O 1.0 | F 1.0 | T(rss) 9.0"}
    assert text(mode="estimated")["2"] == "H 8.0 | O 1.0 | F 1.0 | T 10.0"
    assert text(metrics=["overhead"])["1"] == "O 3.3"


@pytest.mark.parametrize("points, x, expected", [(5, 0.0, 1), (5, 1.0, 5), (5, 0.125, 2), (5, 0.12, 1), (5, 7.0, 5), (5, -1.0, 1), (1, 0.9, 1)])
def test_nearest_point(spark, points, x, expected):
    rows = [(float(i), 2.0, None, None) for i in range(1, points + 1)]
    executor = "long-executor-name"
    stacked = series.stacked_bands(grid(spark, rows, executor), ["heap", "overhead"])
    axis = spark.createDataFrame([("a", points)], "app_id string, points bigint")
    probe = spark.createDataFrame([("a", x)], "app_id string, x double")
    found = {r.label: (r.poll_ord, r.value) for r in series.nearest_points(stacked, axis, probe).collect()}
    assert found == {"tor-name (H)": (expected, float(expected)), "tor-name (O)": (expected, 2.0)}


def test_unpivot_defaults_to_heap(spark):
    df = grid(spark, [(1.0, 2.0, None, 4.0)]).withColumn("native_other", F.lit(None).cast("double"))
    rows = series.unpivot_metrics(df, ["executor_id"], ["total", "overhead"]).collect()
    assert [(r.metric, r.value) for r in rows] == [("overhead", 2), ("total", 3)]
    assert [r.metric for r in series.unpivot_metrics(df, ["executor_id"]).collect()] == ["heap"]


def test_visible_series_need_a_value(spark):
    df = grid(spark, [(1.0, None, None, None), (2.0, None, None, 4.0)])
    assert {(r.metric, r.points) for r in series.visible_series(df).collect()} == {("heap", 2), ("total", 2), ("rss", 1)}
