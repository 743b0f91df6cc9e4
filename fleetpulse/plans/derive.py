"""Executor telemetry derived from an `events` table.

Event rows are read as finished tasks of a fleet: an application is a slice of 150 users split three ways, an executor
is one of eight per application, and a poll is an hour, numbered from the start of 2024. The number of applications therefore grows with
the users of the table. All arithmetic is on integers so that any engine derives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetpulse.operators.ordered import SEGMENT, SPLIT, Split, ordered_scan
from fleetpulse.schemas import EXECUTOR

# Constants of the derivation.
USERS_PER_SLICE = 150
START_MS = 1704067200000
POLL_MS = 5000
NS_PER_VALUE = 20000000
MANAGED_BYTES = 629145600
STORAGE_BYTES = 314572800
MB = 1048576


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _long(text: str):
    return F.expr(f"CAST({text} AS BIGINT)")


def app_id():
    return F.expr(f"concat('app-', CAST(user_id % 3 + 3 * (user_id div {USERS_PER_SLICE}) AS STRING))")


def executor_id():
    return F.expr("CASE WHEN user_id % 8 = 0 THEN 'driver' ELSE CAST(user_id % 8 AS STRING) END")


def poll_seq():
    return _long("datediff(ts, DATE'2024-01-01') * 24 + hour(ts) + 1")


def task_ends(events: DataFrame) -> DataFrame:
    weight = F.expr(
        "CASE WHEN event_type = 'error' AND user_id % 8 = 6 THEN 24 WHEN event_type = 'error' THEN 6 ELSE 1 END"
    )
    return events.withColumn("k", _long("regexp_extract(props, '([0-9]+)', 1)")).select(
        F.col("event_id").alias("task_id"),
        app_id().alias("app_id"),
        F.when(F.col("event_id") % 97 != 0, executor_id()).alias("executor_id"),
        poll_seq().alias("poll_seq"),
        F.when(F.col("event_type") != "signup", _long(f"floor(value * {NS_PER_VALUE})")).alias("cpu_ns"),
        _long("floor(value * 40)").alias("duration_ms"),
        (F.col("k") * weight).cast("bigint").alias("gc_ms"),
        "k",
        F.expr("CASE WHEN event_type = 'error' AND user_id % 16 = 5 THEN 1 ELSE 0 END").alias("failed"),
        "value",
    )


def executor_samples(events: DataFrame) -> DataFrame:
    """One row per (application, executor, poll that saw a task); counters restart once on executor 3."""
    restarted = F.when((F.col("executor_id") == "3") & (F.col("poll_seq") >= 400), 1).otherwise(0)
    cells = (
        task_ends(events)
        .filter("executor_id IS NOT NULL")
        .groupBy(*EXECUTOR, "poll_seq", restarted.alias("incarnation"))
        .agg(
            F.count(F.lit(1)).alias("n_tasks"),
            F.max("k").alias("k"),
            F.max("value").alias("vmax"),
            F.sum("cpu_ns").alias("cpu_ns"),
            F.sum("duration_ms").alias("duration_ms"),
            F.sum("gc_ms").alias("gc_ms"),
            F.sum("failed").alias("failed"),
        )
    )
    # An executor has one cell for each hour at most (8,784 a year), so plain windows per executor are safe.
    # Placing them by executor here serves this window and those of later operators with one exchange.
    cells = cells.repartition(*EXECUTOR)
    w = Window.partitionBy(*EXECUTOR, "incarnation").orderBy("poll_seq").rowsBetween(Window.unboundedPreceding, 0)
    cum = cells.withColumns(
        {
            "c_cpu": F.sum("cpu_ns").over(w),
            "c_dur": F.sum("duration_ms").over(w),
            "c_gc": F.sum("gc_ms").over(w),
            "c_failed": F.sum("failed").over(w),
            "c_k": F.sum("k").over(w),
            "c_peak": F.max("vmax").over(w),
        }
    )
    columns = {
        "wall_ms": f"{START_MS} + poll_seq * {POLL_MS} - CASE WHEN poll_seq % 50 = 0 THEN 4950 ELSE 0 END",
        "max_memory": f"CASE WHEN executor_id = '7' THEN 0 ELSE {MANAGED_BYTES} END",
        "max_tasks": "CASE WHEN executor_id = '4' OR (executor_id = 'driver' AND app_id = 'app-2') THEN 0 ELSE 4 END",
        "total_cores": "CASE WHEN executor_id = 'driver' AND app_id = 'app-2' THEN 0 ELSE 4 END",
        "active_tasks": "CASE WHEN k % 4 = 0 THEN 0 ELSE k % 21 END",
        "failed_tasks": "c_failed",
        "total_duration_ms": "c_dur",
        "total_gc_ms": "CASE WHEN poll_seq % 11 <> 0 THEN c_gc END",
        "cpu_time_ms": "floor(coalesce(c_cpu, 0) / 1000000)",
        "peak_jvm_heap": "CASE WHEN executor_id NOT IN ('5', '6') THEN floor(c_peak * 2800000) END",
        "cur_jvm_heap": "CASE WHEN executor_id <> '6' THEN floor(vmax * 2800000) END",
        "peak_jvm_off_heap": f"CASE WHEN k % 7 <> 0 THEN k * {MB} END",
        "peak_off_heap_unified": f"CASE WHEN k % 5 <> 0 THEN n_tasks * {MB} END",
        "on_heap_exec": f"CASE WHEN k % 6 <> 0 THEN k * {MB // 2} END",
        "on_heap_storage_peak": f"k * {MB // 4}",
        "on_heap_unified": f"CASE WHEN k % 6 <> 0 THEN k * {MB * 3 // 4} END",
        "rss": f"CASE WHEN poll_seq % 4 <> 0 THEN floor(c_peak * 3000000) + k * {MB // 2} END",
        "used_on_heap_storage": f"CASE WHEN executor_id <> '7' THEN k * {MB // 8} END",
        "total_on_heap_storage": f"CASE WHEN executor_id <> '7' THEN {STORAGE_BYTES} END",
        "rdd_blocks": "k % 10",
        "disk_used": f"CASE WHEN k % 9 <> 0 THEN k * {MB // 16} END",
        "memory_used": f"k * {MB // 8}",
        "total_shuffle_read": "c_dur * 1024",
        "total_shuffle_write": "CASE WHEN executor_id <> 'driver' THEN c_k * 4096 END",
    }
    return cum.select(
        "app_id",
        "poll_seq",
        "executor_id",
        F.expr("CASE WHEN executor_id = '6' THEN '' ELSE concat('host-', executor_id, ':7077') END").alias("host_port"),
        F.expr(
            "CASE WHEN executor_id = '6' AND app_id = 'app-1' THEN NULL ELSE concat('host-', executor_id) END"
        ).alias("host"),
        F.expr("NOT (executor_id = '2' AND poll_seq > 600)").alias("is_active"),
        F.expr("CASE WHEN executor_id = '1' AND poll_seq % 3 <> 0 THEN CAST(k AS DOUBLE) END").alias("os_cpu_pct"),
        *[_long(text).alias(name) for name, text in columns.items()],
    )


def process_readings(events: DataFrame) -> DataFrame:
    """CPU use per OS reading, one reading per event."""
    return events.select(
        app_id().alias("app_id"),
        executor_id().alias("executor_id"),
        poll_seq().alias("poll_seq"),
        F.col("event_id").alias("sample_seq"),
        _long("floor(event_id / 8) * 2000000000").alias("wall_ns"),
        _long(f"floor(value * {NS_PER_VALUE})").alias("used_ns"),
        F.lit(4).alias("cores"),
    )


def process_cpu(readings: DataFrame, split: Split | None = SPLIT) -> DataFrame:
    """OS readings with a cumulative CPU time that is unavailable on every thirteenth."""
    scanned = ordered_scan(readings, EXECUTOR, "sample_seq", running_sum={"_total_ns": F.col("used_ns")}, split=split)
    return scanned.select(
        *EXECUTOR,
        "poll_seq",
        "sample_seq",
        "wall_ns",
        F.when(F.col("sample_seq") % 13 != 0, F.col("_total_ns")).alias("cpu_ns"),
        "cores",
        *[c for c in readings.columns if c == SEGMENT],
    )
