"""Heap readings, heap limits and total-memory resolution.

Inputs named `heap`, `overhead`, `off_heap` and `rss` are megabytes unless a name says bytes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetpulse.functions.numbers import percent, when_positive
from fleetpulse.settings import MEMORY_MODES

# Source labels.
PEAK_HEAP = "peakMemoryMetrics.JVMHeapMemory"
CURRENT_HEAP = "executorMetrics.JVMHeapMemory"
PEAK_HEAP_COMPAT = "peakMemoryMetrics.JVMHeapMemory (peak — monotono)"
STORAGE_HEAP = "memoryMetrics.usedOnHeapStorageMemory"
NO_SOURCE = "-"


def heap_bytes(peak: Column, current: Column) -> Column:
    """Positive peak reading, else positive current reading, else null."""
    return F.coalesce(when_positive(peak), when_positive(current))


def heap_source(peak: Column, current: Column) -> Column:
    return F.when(peak > 0, PEAK_HEAP).when(current > 0, CURRENT_HEAP).otherwise(NO_SOURCE)


def heap_bytes_compat(peak: Column, current: Column, storage: Column) -> Column:
    """Compatibility order: current, then peak, then storage memory; a zero counts as a reading."""
    return F.coalesce(current, peak, storage)


def heap_source_compat(peak: Column, current: Column, storage: Column) -> Column:
    return (
        F.when(current.isNotNull(), CURRENT_HEAP)
        .when(peak.isNotNull(), PEAK_HEAP_COMPAT)
        .when(storage.isNotNull(), STORAGE_HEAP)
        .otherwise(NO_SOURCE)
    )


def heap_limit_bytes(managed_max: Column, fraction: float | Column, reserved_bytes: int | Column) -> Column:
    """JVM heap limit estimated from the unified memory pool; 0 when the pool size is unknown."""
    share = fraction if isinstance(fraction, Column) else F.lit(float(fraction))
    reserved = reserved_bytes if isinstance(reserved_bytes, Column) else F.lit(int(reserved_bytes))
    size = managed_max.cast("double")
    return (
        F.when((size > 0) & (share > 0) & (share < 1), size / share + reserved)
        .when(size > 0, size)
        .otherwise(F.lit(0.0))
    )


def estimated_total(heap: Column, overhead: Column, off_heap: Column) -> Column:
    """Sum of the known parts; null only when none is known."""
    zero = F.lit(0.0)
    return F.when(
        F.coalesce(heap, overhead, off_heap).isNotNull(),
        F.coalesce(heap, zero) + F.coalesce(overhead, zero) + F.coalesce(off_heap, zero),
    )


def total_memory(mode: str, heap: Column, overhead: Column, off_heap: Column, rss: Column) -> Column:
    """RSS mode never falls back to the estimate: a missing RSS reading stays a visible gap."""
    _check(mode)
    return rss if mode == "rss" else estimated_total(heap, overhead, off_heap)


def total_memory_source(mode: str, rss: Column) -> Column:
    _check(mode)
    return F.when(rss.isNotNull(), F.lit("rss")) if mode == "rss" else F.lit("estimated")


def recorded_total(total: Column, heap: Column, overhead: Column, off_heap: Column) -> Column:
    """What history keeps: the resolved total, else the estimate (the source label is left as it is)."""
    return F.coalesce(total, estimated_total(heap, overhead, off_heap))


def native_other(heap: Column, overhead: Column, off_heap: Column, total: Column, source: Column) -> Column:
    """Part of the RSS that no counter explains, never negative; null unless the total is an RSS reading."""
    zero = F.lit(0.0)
    known = F.coalesce(heap, zero) + F.coalesce(overhead, zero) + F.coalesce(off_heap, zero)
    return F.when((source == "rss") & total.isNotNull(), F.greatest(total - known, zero))


def share_of_total(value: Column, total: Column) -> Column:
    return percent(value, total)


def _check(mode: str) -> None:
    if mode not in MEMORY_MODES:
        raise ValueError(f"memory mode must be one of {MEMORY_MODES}, got {mode!r}")
