"""Task capacity, saturation and garbage-collection shares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetpulse.functions.numbers import percent, when_positive


def task_capacity(max_tasks: Column, total_cores: Column) -> Column:
    return F.coalesce(when_positive(max_tasks), when_positive(total_cores))


def saturation_pct(active_tasks: Column, capacity: Column) -> Column:
    return percent(active_tasks, capacity)


def gc_seconds(gc_ms: Column) -> Column:
    return gc_ms / F.lit(1000.0)


def gc_pct(gc_ms: Column, duration_ms: Column) -> Column:
    return percent(gc_ms, duration_ms)


def counted_cpu_ns(executor_id: Column, cpu_ns: Column) -> Column:
    """True for task ends that add to an executor's CPU counter; missing metrics count as 0."""
    return executor_id.isNotNull() & (F.coalesce(cpu_ns, F.lit(0)) > 0)


def chart_cpu_pct(cpu_pct: Column, clip: float) -> Column:
    """Clipped value for the chart series; rows and history keep the full value."""
    return F.when(cpu_pct.isNotNull(), F.least(cpu_pct, F.lit(clip)))
