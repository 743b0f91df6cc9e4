import math
import random
import struct
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from fleetpulse import Settings
from fleetpulse.functions import health, memory, numbers, tasks, text


def test_text_to_number(evaluate):
    rows = [("12",), (" 1.5e2 ",), ("",), ("abc",), ("NaN",), ("Infinity",), ("1d",), ("-.5",), ("1e999",), (None,)]
    assert evaluate(numbers.text_to_number, rows, "v string") == [12, 150, 0, None, None, None, None, -0.5, None, None]


def test_finite(evaluate):
    rows = [(1.5,), (float("nan"),), (float("inf"),), (float("-inf"),), (None,)]
    assert evaluate(numbers.finite, rows, "v double") == [1.5, None, None, None, None]


def test_mb_and_percent(evaluate):
    assert evaluate(numbers.mb, [(1572864,), (None,)], "v bigint") == [1.5, None]
    rows = [(1.0, 4.0), (3.0, 0.0), (1.0, -1.0), (None, 4.0), (1.0, None), (12.0, 4.0)]
    assert evaluate(numbers.percent, rows, "a double, b double") == [25, None, None, None, None, 300]


def _exact(value: float, digits: int) -> float:
    return float(Decimal(value).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def test_fixed_rounds_by_the_exact_value(evaluate):
    rng = random.Random(7)
    ties = [1.005, 2.675, 0.125, 0.375, 1.25, 8.345, 0.5, 1.5, 2.5, 0.045, 1e15 + 0.3, 0.0, -1.005, -0.125]
    values = ties + [rng.uniform(0, 1000) for _ in range(500)] + [rng.randrange(2**36) / 1048576 for _ in range(500)]
    values += [rng.randrange(10**6) / 1000 for _ in range(500)]
    for digits in (0, 1, 2):
        found = evaluate(lambda v: numbers.fixed(v, digits), [(v,) for v in values], "v double")
        expected = [math.copysign(_exact(abs(v), digits), v) for v in values]
        assert found == expected
    assert evaluate(lambda v: numbers.fixed(v, 2), [(None,)], "v double") == [None]


def test_plain_number_text(evaluate):
    cases = {
        1.0: "1",
        0.0: "0",
        12.5: "12.5",
        1e7: "10000000",
        12345678.25: "12345678.25",
        123456789012.0: "123456789012",
        1.5e20: "150000000000000000000",
        1e21: "1e+21",
        1e22: "1e+22",
        0.001: "0.001",
        0.00012: "0.00012",
        0.000001: "0.000001",
        1.5e-7: "1.5e-7",
        -3.0: "-3",
        -12345678.5: "-12345678.5",
        -0.00025: "-0.00025",
    }
    assert evaluate(numbers.plain_number_text, [(v,) for v in cases], "v double") == list(cases.values())


def test_heap_reading(evaluate):
    rows = [(5, 3), (0, 3), (None, 3), (0, 0), (None, None), (-1, 2)]
    kind = "p bigint, c bigint"
    assert evaluate(memory.heap_bytes, rows, kind) == [5, 3, 3, None, None, 2]
    peak, current = memory.PEAK_HEAP, memory.CURRENT_HEAP
    assert evaluate(memory.heap_source, rows, kind) == [peak, current, current, "-", "-", current]


def test_heap_reading_compat_takes_zero(evaluate):
    rows = [(5, 0, 1), (5, None, 1), (None, None, 0), (None, None, None)]
    kind = "p bigint, c bigint, s bigint"
    assert evaluate(memory.heap_bytes_compat, rows, kind) == [0, 5, 0, None]
    labels = evaluate(memory.heap_source_compat, rows, kind)
    assert labels == [memory.CURRENT_HEAP, memory.PEAK_HEAP_COMPAT, memory.STORAGE_HEAP, "-"]


def test_heap_limit(evaluate):
    rows = [(600,), (0,), (-5,), (None,)]
    limit = lambda fraction: lambda v: memory.heap_limit_bytes(v, fraction, 100)
    assert evaluate(limit(0.6), rows, "v bigint") == [600 / 0.6 + 100, 0, 0, 0]
    assert evaluate(limit(1.0), rows, "v bigint") == [600, 0, 0, 0]
    assert evaluate(limit(0.0), rows, "v bigint") == [600, 0, 0, 0]


def test_total_memory_modes(evaluate):
    rows = [(1.0, 2.0, 3.0, 9.0), (1.0, None, None, None), (None, None, None, 9.0), (None, None, None, None)]
    kind = "h double, o double, f double, r double"
    assert evaluate(memory.estimated_total, [r[:3] for r in rows], "h double, o double, f double") == [6, 1, None, None]
    assert evaluate(lambda *c: memory.total_memory("rss", *c), rows, kind) == [9, None, 9, None]
    assert evaluate(lambda *c: memory.total_memory("estimated", *c), rows, kind) == [6, 1, None, None]
    assert evaluate(lambda h, o, f, r: memory.total_memory_source("rss", r), rows, kind) == ["rss", None, "rss", None]
    assert set(evaluate(lambda h, o, f, r: memory.total_memory_source("estimated", r), rows, kind)) == {"estimated"}
    recorded = lambda h, o, f, r: memory.recorded_total(memory.total_memory("rss", h, o, f, r), h, o, f)
    assert evaluate(recorded, rows, kind) == [9, 1, 9, None]
    with pytest.raises(ValueError):
        memory.total_memory("other", *[F.lit(1.0)] * 4)
    with pytest.raises(ValueError):
        Settings(memory_mode="other")


def test_native_other(evaluate):
    rows = [(1.0, None, 2.0, 9.0, "rss"), (5.0, 5.0, 5.0, 9.0, "rss"), (1.0, 1.0, 1.0, 3.0, "estimated"), (1.0, 1.0, 1.0, None, "rss")]
    kind = "h double, o double, f double, t double, s string"
    assert evaluate(memory.native_other, rows, kind) == [6, 0, None, None]


def test_task_figures(evaluate):
    rows = [(8, 4), (0, 4), (None, 4), (0, 0), (None, None)]
    assert evaluate(tasks.task_capacity, rows, "m bigint, c bigint") == [8, 4, 4, None, None]
    assert evaluate(tasks.saturation_pct, [(6, 4), (None, 4), (1, None)], "a bigint, c bigint") == [150, None, None]
    assert evaluate(tasks.gc_seconds, [(1500,), (None,)], "v bigint") == [1.5, None]
    assert evaluate(tasks.gc_pct, [(5, 50), (5, 0), (None, 5)], "g bigint, d bigint") == [10, None, None]
    rows = [("1", 5), ("1", 0), ("1", None), (None, 5)]
    assert evaluate(tasks.counted_cpu_ns, rows, "e string, c bigint") == [True, False, False, False]
    assert evaluate(lambda c: tasks.chart_cpu_pct(c, 200.0), [(250.0,), (5.0,), (None,)], "v double") == [200, 5, None]


def test_unhealthy_terms(evaluate):
    fine = (84.9, 499, 9.9, 399.0, 0)
    rows = [fine, (85.0, *fine[1:]), (*fine[:1], 500, *fine[2:]), (*fine[:2], 10.0, *fine[3:])]
    rows += [(*fine[:3], 400.0, 0), (*fine[:4], 1), (None,) * 5]
    check = lambda h, g, p, s, f: health.is_unhealthy(h, g, p, s, f, 85, 400)
    found = evaluate(check, rows, "h double, g bigint, p double, s double, f bigint")
    assert found == [False, True, True, True, True, True, False]


def test_severity_bounds(evaluate):
    rows = [(1999.9,), (2000.0,), (500.0,), (499.9,), (None,)]
    found = evaluate(lambda v: health.severity(v, danger=2000, warn=500), rows, "v double")
    assert found == ["warn", "danger", "warn", "normal", "normal"]


def test_names(evaluate):
    rows = [("a:1", "a"), ("", "a"), (None, "a"), ("", ""), (None, None)]
    assert evaluate(text.host_label, rows, "p string, h string") == ["a:1", "a", "a", "-", "-"]
    assert evaluate(text.short_id, [("12345678",), ("x-123456789",)], "v string") == ["12345678", "23456789"]


def test_natural_key_orders_by_value(spark):
    names = ["exec-10", "Exec-9", "exec-09b", "driver", "2", "10", "1", "n" + "9" * 25, "n1" + "0" * 25, "007"]
    df = spark.createDataFrame([(n,) for n in names], "v string")
    ordered = [r.v for r in df.orderBy(text.natural_key(F.col("v")), "v").collect()]
    assert ordered == ["1", "2", "007", "10", "driver", "Exec-9", "exec-09b", "exec-10", "n" + "9" * 25, "n1" + "0" * 25]


def test_display_text(evaluate):
    assert evaluate(text.int_text, [(2.5,), (-2.5,), (None,)], "v double") == ["3", "-2", "-"]
    assert evaluate(text.mb_text, [(1.25,), (0.05,), (None,)], "v double") == ["1.3", "0.1", "-"]
    assert evaluate(text.bytes_as_mb_text, [(1572864,), (None,)], "v bigint") == ["1.5", "-"]
    assert evaluate(text.pct_text, [(12.345,), (None,)], "v double") == ["12.3%", "-"]
    assert evaluate(text.seconds_text, [(3.0,)], "v double") == ["3.0"]
    rows = [(999,), (1000,), (1005,), (2675,), (None,)]
    assert evaluate(text.gc_delta_text, rows, "v bigint") == ["999 ms", "1.00 s", "1.00 s", "2.67 s", "wait…"]


def test_csv_field(evaluate):
    rows = [("plain",), ("a;b",), ("a,b",), ('say "x"',), ("two\nlines",), ("",), (None,)]
    expected = ["plain", '"a;b"', '"a,b"', '"say ""x"""', '"two\nlines"', "", ""]
    assert evaluate(text.csv_field, rows, "v string") == expected


def test_number_text_round_trips(evaluate):
    rng = random.Random(3)
    values = [rng.uniform(0, 10 ** rng.randint(-9, 15)) for _ in range(500)]
    found = evaluate(numbers.plain_number_text, [(v,) for v in values], "v double")
    assert [struct.pack("d", float(t)) for t in found] == [struct.pack("d", v) for v in values]
    assert not [t for t, v in zip(found, values) if "e" in t and 1e-6 <= v < 1e21]
