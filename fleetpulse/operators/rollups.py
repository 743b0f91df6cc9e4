"""Aggregations. Every one is a partial + final aggregate, so a hot key is reduced before it is exchanged."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.functions.memory import PEAK_HEAP
from fleetpulse.functions.tasks import counted_cpu_ns
from fleetpulse.operators.asof import NS_PER_MS
from fleetpulse.operators.ordered import SPLIT, Split, ordered_scan
from fleetpulse.schemas import EXECUTOR
from fleetpulse.settings import MEMORY_MODES

# Fixed value: leading digits an axis maximum may have.
NICE_STEPS = [1, 1.2, 1.5, 2, 2.5, 3, 4, 5, 6, 8, 10]


# Status texts.
NOTHING_SELECTED = "No executors selected for charts with current filters."
NOTHING_UNHEALTHY = "No unhealthy executors with current filters."
NOTHING_ACTIVE = "No active executors found."
NO_HEAP_METRIC = "Executors found but heap metric is not available from the REST API (check executorMetrics)."
STATUS = "Shown executors: %d | unhealthy: %d | heap available for %d | active tasks: %d | failed tasks: %d."


def cpu_totals(task_ends: DataFrame) -> DataFrame:
    """CPU milliseconds per executor; nanoseconds are summed first and divided once."""
    return (
        task_ends.filter(counted_cpu_ns(F.col("executor_id"), F.col("cpu_ns")))
        .groupBy(*EXECUTOR)
        .agg(F.sum("cpu_ns").alias("cpu_ns"))
        .select(*EXECUTOR, F.expr(f"cpu_ns div {NS_PER_MS}L").alias("cpu_time_ms"))
    )


def latest_cpu_pct(cpu_samples: DataFrame) -> DataFrame:
    """Newest published CPU percentage per executor."""
    published = cpu_samples.filter(F.col("executor_id").isNotNull() & F.col("cpu_pct").isNotNull())
    return published.groupBy(*EXECUTOR).agg(F.max_by("cpu_pct", "sample_seq").alias("cpu_pct"))


def _sum_or_zero(column: str) -> Column:
    return F.coalesce(F.sum(column), F.lit(0))


def summarise(rows: DataFrame, group: Sequence[str] = ("app_id",)) -> DataFrame:
    """The fifteen summary figures per group; averages skip missing values, sums count them as 0."""
    return rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("executors"),
        F.count_if(F.col("is_unhealthy")).alias("unhealthy"),
        F.avg("heap_pct").alias("avg_heap_pct"),
        F.max("heap_pct").alias("max_heap_pct"),
        _sum_or_zero("active_tasks").alias("active_tasks"),
        _sum_or_zero("failed_tasks").alias("failed_tasks"),
        F.avg("gc_delta_ms").alias("avg_gc_delta_ms"),
        _sum_or_zero("shuffle_read_mb").alias("shuffle_read_mb"),
        _sum_or_zero("shuffle_write_mb").alias("shuffle_write_mb"),
        _sum_or_zero("disk_used_mb").alias("disk_used_mb"),
        _sum_or_zero("memory_used_mb").alias("memory_used_mb"),
        _sum_or_zero("jvm_off_heap_mb").alias("jvm_off_heap_mb"),
        _sum_or_zero("off_heap_unified_mb").alias("off_heap_unified_mb"),
        _sum_or_zero("total_memory_mb").alias("total_memory_mb"),
        F.max("on_heap_unified_mb").alias("max_on_heap_unified_mb"),
    )


def status(
    rows: DataFrame,
    shown: Column,
    mode: str = "all",
    only_unhealthy: bool = False,
    group: Sequence[str] = ("app_id",),
    samples: DataFrame | None = None,
) -> DataFrame:
    """Status line per group. `rows` are all live rows; `shown` tells which of them pass the filters.

    The heap count covers all live rows, the other figures only the shown ones. Groups without live rows appear if all
    `samples` are given.
    """
    figures = rows.withColumn("_shown", shown).groupBy(*group).agg(
        F.count(F.lit(1)).alias("_live"),
        F.count_if("_shown").alias("shown"),
        F.count_if(F.col("_shown") & F.col("is_unhealthy")).alias("unhealthy"),
        F.count_if(F.col("heap_bytes").isNotNull()).alias("with_heap"),
        F.coalesce(F.sum(F.when(F.col("_shown"), F.col("active_tasks"))), F.lit(0)).alias("active_tasks"),
        F.coalesce(F.sum(F.when(F.col("_shown"), F.col("failed_tasks"))), F.lit(0)).alias("failed_tasks"),
    )
    if samples is not None:
        figures = samples.select(*group).distinct().join(figures, list(group), "left").na.fill(0)
    filtered = NOTHING_SELECTED if mode == "selected" else NOTHING_UNHEALTHY if only_unhealthy else NOTHING_ACTIVE
    nothing = F.when(F.col("_live") == 0, NOTHING_ACTIVE).otherwise(filtered)
    ok = F.format_string(STATUS, "shown", "unhealthy", "with_heap", "active_tasks", "failed_tasks")
    empty, heapless = F.col("shown") == 0, F.col("with_heap") == 0
    return figures.withColumns(
        {
            "state": F.when(empty, "empty").when(heapless, "no_heap").otherwise("ok"),
            "level": F.when(empty, "danger").when(heapless | (F.col("unhealthy") > 0), "warn").otherwise("normal"),
            "message": F.when(empty, nothing).when(heapless, NO_HEAP_METRIC).otherwise(ok),
        }
    ).drop("_live")


def rss_availability(rows: DataFrame, mode: str = "rss") -> DataFrame:
    """Per application: has any RSS reading ever arrived, and should its absence be warned about."""
    if mode not in MEMORY_MODES:
        raise ValueError(f"memory mode must be one of {MEMORY_MODES}, got {mode!r}")
    seen = rows.groupBy("app_id").agg(F.bool_or(F.col("rss_mb").isNotNull()).alias("rss_available"))
    return seen.withColumn("rss_warning", F.lit(mode == "rss") & ~F.col("rss_available"))


def rss_availability_by_poll(rows: DataFrame, split: Split | None = SPLIT, samples: DataFrame | None = None) -> DataFrame:
    """The same flag as it stood at each poll, of all `samples` if given; once set it stays set."""
    seen = rows.select("app_id", "poll_seq", F.col("rss_mb").isNotNull().cast("int").alias("_has"))
    if samples is not None:
        seen = seen.unionByName(samples.select("app_id", "poll_seq", F.lit(0).alias("_has")))
    per_poll = seen.groupBy("app_id", "poll_seq").agg(F.max("_has").alias("_any"))
    scanned = ordered_scan(per_poll, ["app_id"], "poll_seq", running_max={"_seen": F.col("_any")}, split=split)
    return scanned.select("app_id", "poll_seq", (F.col("_seen") == 1).alias("rss_available"))


def peak_source_used(rows: DataFrame, group: Sequence[str] = ("app_id",)) -> DataFrame:
    """True when any heap figure of the group comes from the peak metrics."""
    used = F.bool_or(F.col("metric_source").contains(PEAK_HEAP.split(".")[0]))
    return rows.groupBy(*group).agg(used.alias("uses_peak_source"))


def record_count(samples: DataFrame) -> DataFrame:
    """Live records per poll; 0 where no executor was live."""
    return samples.groupBy("app_id", "poll_seq").agg(F.count_if("is_active").alias("records"))


def nice_ceiling(value: Column) -> Column:
    """Smallest of the nice steps times a power of ten that is not below `value`; 1 without a positive finite value."""
    power = F.pow(F.lit(10.0), F.floor(F.ln(value) / F.ln(F.lit(10.0))))
    fraction = value / power
    step = F.lit(10.0)
    for candidate in reversed(NICE_STEPS):
        step = F.when(fraction <= F.lit(float(candidate)), F.lit(float(candidate))).otherwise(step)
    usable = (value > 0) & ~F.isnan(value) & (value != F.lit(float("inf")))
    return F.when(usable, step * power).otherwise(F.lit(1.0))


def axis_scale(points: DataFrame, group: Sequence[str] = ("app_id", "chart"), value: str = "value") -> DataFrame:
    """Axis maximum per chart: a tenth of headroom, rounded up to a nice step."""
    peaks = points.groupBy(*group).agg(F.max(value).alias("max_value"))
    return peaks.withColumn("axis_max", nice_ceiling(F.col("max_value") * F.lit(1.1)))


def latest_non_null(points: DataFrame, columns: Sequence[str], order: str = "poll_seq") -> DataFrame:
    """Last non-null value of each column per executor."""
    newest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns]
    return points.groupBy(*EXECUTOR).agg(*newest)
