"""Fixed schemas of the tables this library reads and writes; none is inferred.

Fixed values: the JSON field names, and the names and order of the history columns.
"""

from __future__ import annotations

from pyspark.sql import types as T

EXECUTOR = ["app_id", "executor_id"]


_TYPES = {
    "string": T.StringType(),
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
}


def _struct(columns: str, **nested: T.StructType) -> T.StructType:
    """Struct from `name type` pairs; a type in capitals names one of the nested structs. Needs no session."""
    pairs = [pair.rsplit(" ", 1) for pair in (part.strip() for part in columns.split(","))]
    return T.StructType([T.StructField(name, nested.get(kind) or _TYPES[kind]) for name, kind in pairs])


# One row per (app, executor, poll).
SAMPLES = _struct("""
    app_id string, poll_seq bigint, wall_ms bigint, executor_id string, host_port string, host string,
    is_active boolean, max_memory bigint, max_tasks bigint, total_cores bigint, active_tasks bigint,
    failed_tasks bigint, total_duration_ms bigint, total_gc_ms bigint, cpu_time_ms bigint, os_cpu_pct double,
    peak_jvm_heap bigint, cur_jvm_heap bigint, peak_jvm_off_heap bigint, peak_off_heap_unified bigint,
    on_heap_exec bigint, on_heap_storage_peak bigint, on_heap_unified bigint, rss bigint,
    used_on_heap_storage bigint, total_on_heap_storage bigint, rdd_blocks bigint, disk_used bigint,
    memory_used bigint, total_shuffle_read bigint, total_shuffle_write bigint
""")

# The same row in the nested form of the executors endpoint. Beside the endpoint's own fields it carries the
# identity of the poll (appId, pollSeq, wallMs), because one table holds many applications.
SNAPSHOT_JSON = _struct(
    """
    appId string, pollSeq bigint, wallMs bigint, id string, hostPort string, host string, isActive boolean,
    maxMemory bigint, maxTasks bigint, totalCores bigint, activeTasks bigint, failedTasks bigint,
    totalDuration bigint, totalGCTime bigint, totalShuffleRead bigint, totalShuffleWrite bigint,
    rddBlocks bigint, diskUsed bigint, memoryUsed bigint,
    peakMemoryMetrics PEAK, executorMetrics CURRENT, memoryMetrics STORAGE, cpuTimeMs bigint, osCpuLoadPct double
    """,
    PEAK=_struct("""
        JVMHeapMemory bigint, JVMOffHeapMemory bigint, OffHeapUnifiedMemory bigint, OnHeapExecutionMemory bigint,
        OnHeapStorageMemory bigint, OnHeapUnifiedMemory bigint, ProcessTreeJVMRSSMemory bigint
    """),
    CURRENT=_struct("JVMHeapMemory bigint"),
    STORAGE=_struct("usedOnHeapStorageMemory bigint, totalOnHeapStorageMemory bigint"),
)

# Task-end lines of a Spark event log; only the fields that are read.
TASK_END_JSON = _struct(
    "Event string, Task Info INFO, Task Metrics METRICS",
    INFO=_struct("Task ID bigint, Executor ID string, Finish Time bigint"),
    METRICS=_struct("Executor CPU Time bigint"),
)

# One published per-executor CPU percentage.
PROCESS_SAMPLE_JSON = _struct("appId string, executorId string, sampleSeq bigint, cpuPct double")

# Raw OS readings from which the percentage is derived.
PROCESS_CPU = _struct(
    "app_id string, executor_id string, sample_seq bigint, wall_ns bigint, cpu_ns bigint, cores int"
)

# Recorded history. The first 32 columns are the exported ones, in export order; `pollSeq` and `ingestSeq` give
# identity and insertion order, `timeMs` is the parsed `timeIso` (null when it cannot be parsed), kept as a number
# so that time predicates reach the Parquet scan.
HISTORY = _struct("""
    appId string, timeLabel string, timeIso string, executor string, host string, heapMB double, heapMaxMB double,
    heapPct double, gcTimeSeconds double, gcDeltaMs bigint, activeTasks bigint, maxTasks bigint,
    saturationPct double, cpuPct double, failedTasks bigint, jvmOffHeapMB double, offHeapUnifiedMB double,
    rssMB double, totalMemoryMB double, totalMemorySource string, nativeOtherMB double, onHeapExecMB double,
    onHeapStoragePeakMB double, onHeapUnifiedMB double, onHeapStorageMB double, totalOnHeapCapacityMB double,
    rddBlocks bigint, diskUsedMB double, memoryUsedMB double, shuffleReadMB double, shuffleWriteMB double,
    metricSource string, pollSeq bigint, ingestSeq bigint, timeMs bigint
""")
HISTORY_CSV_COLUMNS = HISTORY.fieldNames()[:32]
