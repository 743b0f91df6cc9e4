"""From executor samples to derived rows: counter deltas, CPU cascade and the flat row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.functions import health, memory, tasks, text
from fleetpulse.functions.numbers import mb, percent
from fleetpulse.operators.ordered import (
    ADJACENT_WIDTH,
    SPLIT,
    Split,
    ordered_scan,
    with_poll_ordinal,
    with_previous_adjacent,
)
from fleetpulse.schemas import EXECUTOR
from fleetpulse.settings import MIN_CPU_ELAPSED_MS, Settings

# Fixed value: the metrics whose change since the preceding poll is shown.
CHANGE_METRICS = [
    "heap_mb",
    "heap_max_mb",
    "heap_pct",
    "jvm_off_heap_mb",
    "jvm_off_heap_pct",
    "off_heap_unified_mb",
    "off_heap_unified_pct",
    "total_memory_mb",
    "native_other_mb",
    "native_other_pct",
    "gc_seconds",
    "gc_delta_ms",
    "active_tasks",
    "max_tasks",
    "saturation_pct",
    "cpu_pct",
    "failed_tasks",
    "shuffle_read_mb",
    "shuffle_write_mb",
    "rdd_blocks",
    "disk_used_mb",
    "memory_used_mb",
    "on_heap_storage_mb",
    "total_on_heap_capacity_mb",
    "on_heap_exec_mb",
    "on_heap_storage_peak_mb",
    "on_heap_unified_mb",
]

ROW_KEYS = ["app_id", "poll_seq", "wall_ms", "executor_id"]


def active_only(samples: DataFrame) -> DataFrame:
    """Live executors; a dead executor's frozen last values must not look current."""
    return samples.filter("is_active")


def gc_delta(current: Column, baseline: Column) -> Column:
    """Increase over the newest earlier reading; null without one and after a counter reset."""
    delta = current - baseline
    return F.when(delta >= 0, delta)


def cpu_cascade(
    os_pct: Column,
    capacity: Column,
    elapsed_ms: Column,
    cpu_delta_ms: Column,
    duration_delta_ms: Column,
    active_tasks: Column,
) -> tuple[Column, Column]:
    """CPU utilisation and the source it came from.

    An OS reading wins. Otherwise the CPU time of finished tasks is used, where a zero increase only counts as idle
    while no task is active, and the task wall time is the last resort.
    """
    core_ms = elapsed_ms * capacity
    too_early = elapsed_ms.isNull() | (elapsed_ms <= MIN_CPU_ELAPSED_MS)
    idle = (cpu_delta_ms == 0) & (F.coalesce(active_tasks, F.lit(0)) == 0)
    from_cpu = (cpu_delta_ms > 0) | idle
    hundred = F.lit(100.0)
    pct = (
        F.when(os_pct.isNotNull(), os_pct)
        .when(capacity.isNull() | too_early, F.lit(None).cast("double"))
        .when(from_cpu, cpu_delta_ms / core_ms * hundred)
        .when(duration_delta_ms >= 0, duration_delta_ms / core_ms * hundred)
    )
    source = (
        F.when(os_pct.isNotNull(), "OS")
        .when(capacity.isNull(), "-")
        .when(too_early, "wait")
        .when(from_cpu, "TaskCpuTime")
        .when(duration_delta_ms >= 0, "totalDuration")
        .otherwise("-")
    )
    return pct, source


def with_deltas(active: DataFrame, split: Split | None = SPLIT) -> DataFrame:
    """Add `gc_delta_ms`, `cpu_pct` and `cpu_source` to active samples.

    The two baselines differ on purpose: garbage collection compares with the newest non-null reading, CPU with the
    executor's preceding active sample whatever it held. Both come out of one scan.
    """
    scanned = ordered_scan(
        active,
        EXECUTOR,
        "poll_seq",
        previous={
            "_prev_wall_ms": F.col("wall_ms"),
            "_prev_cpu_ms": F.col("cpu_time_ms"),
            "_prev_duration_ms": F.col("total_duration_ms"),
        },
        last_before={"_prev_gc_ms": F.col("total_gc_ms")},
        split=split,
    )
    pct, source = cpu_cascade(
        F.col("os_cpu_pct"),
        tasks.task_capacity(F.col("max_tasks"), F.col("total_cores")),
        F.col("wall_ms") - F.col("_prev_wall_ms"),
        F.col("cpu_time_ms") - F.col("_prev_cpu_ms"),
        F.col("total_duration_ms") - F.col("_prev_duration_ms"),
        F.col("active_tasks"),
    )
    return scanned.select(
        *active.columns,
        gc_delta(F.col("total_gc_ms"), F.col("_prev_gc_ms")).alias("gc_delta_ms"),
        pct.alias("cpu_pct"),
        source.alias("cpu_source"),
    )


def flatten(samples: DataFrame, settings: Settings = Settings(), keep: Sequence[str] = ()) -> DataFrame:
    """One flat derived row per sample; needs the columns `with_deltas` adds. `keep` names further input columns."""
    col = F.col
    heap = memory.heap_bytes(col("peak_jvm_heap"), col("cur_jvm_heap"))
    limit = memory.heap_limit_bytes(col("max_memory"), settings.memory_fraction, settings.reserved_bytes)
    capacity = tasks.task_capacity(col("max_tasks"), col("total_cores"))
    heap_mb, overhead_mb = mb(heap), mb(col("peak_jvm_off_heap"))
    off_heap_mb, rss_mb = mb(col("peak_off_heap_unified")), mb(col("rss"))
    total = memory.total_memory(settings.memory_mode, heap_mb, overhead_mb, off_heap_mb, rss_mb)
    source = memory.total_memory_source(settings.memory_mode, rss_mb)
    zero = F.lit(0)
    rows = samples.select(
        "app_id",
        "poll_seq",
        "wall_ms",
        "executor_id",
        text.host_label(col("host_port"), col("host")).alias("host"),
        heap.alias("heap_bytes"),
        heap_mb.alias("heap_mb"),
        limit.alias("heap_max_bytes"),
        mb(limit).alias("heap_max_mb"),
        percent(heap, limit).alias("heap_pct"),
        overhead_mb.alias("jvm_off_heap_mb"),
        off_heap_mb.alias("off_heap_unified_mb"),
        rss_mb.alias("rss_mb"),
        total.alias("total_memory_mb"),
        source.alias("total_memory_source"),
        memory.native_other(heap_mb, overhead_mb, off_heap_mb, total, source).alias("native_other_mb"),
        tasks.gc_seconds(col("total_gc_ms")).alias("gc_seconds"),
        tasks.gc_pct(col("total_gc_ms"), col("total_duration_ms")).alias("gc_pct"),
        "gc_delta_ms",
        "active_tasks",
        capacity.alias("max_tasks"),
        tasks.saturation_pct(col("active_tasks"), capacity).alias("saturation_pct"),
        "cpu_pct",
        "cpu_source",
        "failed_tasks",
        mb(F.coalesce(col("total_shuffle_read"), zero)).alias("shuffle_read_mb"),
        mb(F.coalesce(col("total_shuffle_write"), zero)).alias("shuffle_write_mb"),
        "rdd_blocks",
        col("disk_used").alias("disk_used_bytes"),
        mb(col("disk_used")).alias("disk_used_mb"),
        col("memory_used").alias("memory_used_bytes"),
        mb(col("memory_used")).alias("memory_used_mb"),
        col("used_on_heap_storage").alias("on_heap_storage_bytes"),
        mb(col("used_on_heap_storage")).alias("on_heap_storage_mb"),
        mb(col("total_on_heap_storage")).alias("total_on_heap_capacity_mb"),
        mb(col("on_heap_exec")).alias("on_heap_exec_mb"),
        mb(col("on_heap_storage_peak")).alias("on_heap_storage_peak_mb"),
        mb(col("on_heap_unified")).alias("on_heap_unified_mb"),
        memory.heap_source(col("peak_jvm_heap"), col("cur_jvm_heap")).alias("metric_source"),
        *keep,
    )
    return with_health(rows, settings)


def with_health(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    unhealthy = health.is_unhealthy(
        F.col("heap_pct"),
        F.col("gc_delta_ms"),
        F.col("gc_pct"),
        F.col("saturation_pct"),
        F.col("failed_tasks"),
        settings.warn_pct,
        settings.sat_warn_pct,
    )
    return rows.withColumn("is_unhealthy", unhealthy)


def executor_rows(
    samples: DataFrame,
    settings: Settings = Settings(),
    split: Split | None = SPLIT,
    keep: Sequence[str] = (),
) -> DataFrame:
    """The hub table: live samples with deltas, flattened."""
    return flatten(with_deltas(active_only(samples), split), settings, keep)


def with_total_shares(rows: DataFrame) -> DataFrame:
    total = F.col("total_memory_mb")
    return rows.withColumns(
        {
            "jvm_off_heap_pct": memory.share_of_total(F.col("jvm_off_heap_mb"), total),
            "off_heap_unified_pct": memory.share_of_total(F.col("off_heap_unified_mb"), total),
            "native_other_pct": memory.share_of_total(F.col("native_other_mb"), total),
        }
    )


def change_directions(
    samples: DataFrame,
    settings: Settings = Settings(),
    split: Split | None = SPLIT,
    ordinal: str | None = None,
) -> DataFrame:
    """`up`, `down` or null per metric against the directly preceding poll.

    Poll adjacency is judged on every poll of the application, including those at which an executor was dead. Where a
    column already numbers the polls of an application without gaps, name it as `ordinal` to save numbering them.
    """
    numbered = with_poll_ordinal(samples, split) if ordinal is None else samples.withColumn("poll_ord", F.col(ordinal))
    rows = with_total_shares(executor_rows(numbered, settings, split, keep=["poll_ord"]))
    paired = with_previous_adjacent(
        rows,
        EXECUTOR,
        "poll_ord",
        {f"_prev_{m}": F.col(m) for m in CHANGE_METRICS},
        None if split is None else ADJACENT_WIDTH,
    )
    return paired.select(*ROW_KEYS, *[change(F.col(f"_prev_{m}"), F.col(m)).alias(m) for m in CHANGE_METRICS])


def change(before: Column, now: Column) -> Column:
    return F.when(now > before, "up").when(now < before, "down")


def process_cpu_pct(samples: DataFrame, split: Split | None = SPLIT) -> DataFrame:
    """CPU percentage from cumulative process CPU time.

    The wall baseline moves with every sample, the CPU baseline only with samples that have a reading (a negative
    reading means unavailable). After an unavailable sample the CPU increase therefore spans more time than the wall
    increase; a negative increase is reported as it is.
    """
    reading = F.when(F.col("cpu_ns") >= 0, F.col("cpu_ns"))
    scanned = ordered_scan(
        samples,
        EXECUTOR,
        "sample_seq",
        previous={"_prev_wall_ns": F.col("wall_ns")},
        last_before={"_prev_cpu_ns": reading},
        split=split,
    )
    wall = F.col("wall_ns") - F.col("_prev_wall_ns")
    used = reading - F.col("_prev_cpu_ns")
    pct = F.when(wall > 0, used.cast("double") * F.lit(100.0) / (wall.cast("double") * F.col("cores")))
    return scanned.select(*samples.columns, pct.alias("cpu_pct"))
