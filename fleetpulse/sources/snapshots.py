"""Executor snapshots in their nested JSON form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetpulse.schemas import SAMPLES, SNAPSHOT_JSON

# Fixed value: nested JSON path of every sample column.
_JSON_PATH = {
    "app_id": "appId",
    "poll_seq": "pollSeq",
    "wall_ms": "wallMs",
    "executor_id": "id",
    "host_port": "hostPort",
    "host": "host",
    "is_active": "isActive",
    "max_memory": "maxMemory",
    "max_tasks": "maxTasks",
    "total_cores": "totalCores",
    "active_tasks": "activeTasks",
    "failed_tasks": "failedTasks",
    "total_duration_ms": "totalDuration",
    "total_gc_ms": "totalGCTime",
    "cpu_time_ms": "cpuTimeMs",
    "os_cpu_pct": "osCpuLoadPct",
    "peak_jvm_heap": "peakMemoryMetrics.JVMHeapMemory",
    "cur_jvm_heap": "executorMetrics.JVMHeapMemory",
    "peak_jvm_off_heap": "peakMemoryMetrics.JVMOffHeapMemory",
    "peak_off_heap_unified": "peakMemoryMetrics.OffHeapUnifiedMemory",
    "on_heap_exec": "peakMemoryMetrics.OnHeapExecutionMemory",
    "on_heap_storage_peak": "peakMemoryMetrics.OnHeapStorageMemory",
    "on_heap_unified": "peakMemoryMetrics.OnHeapUnifiedMemory",
    "rss": "peakMemoryMetrics.ProcessTreeJVMRSSMemory",
    "used_on_heap_storage": "memoryMetrics.usedOnHeapStorageMemory",
    "total_on_heap_storage": "memoryMetrics.totalOnHeapStorageMemory",
    "rdd_blocks": "rddBlocks",
    "disk_used": "diskUsed",
    "memory_used": "memoryUsed",
    "total_shuffle_read": "totalShuffleRead",
    "total_shuffle_write": "totalShuffleWrite",
}
_SAMPLE_OF_PATH = {path: name for name, path in _JSON_PATH.items()}


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Samples from a directory of JSON lines, one executor per line, active and dead alike."""
    return to_samples(spark.read.schema(SNAPSHOT_JSON).json(path))


def stream_snapshots(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(SNAPSHOT_JSON)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return to_samples(reader.json(path))


def parse_payloads(payloads: DataFrame, column: str = "value") -> DataFrame:
    """Samples from rows that each hold one whole endpoint response, a JSON array of executors."""
    parsed = F.from_json(F.col(column), T.ArrayType(SNAPSHOT_JSON))
    return to_samples(payloads.select(F.inline(parsed)))


def to_samples(snapshots: DataFrame) -> DataFrame:
    """Flat samples from nested snapshots; a missing object or field becomes null."""
    return snapshots.select(
        *[F.col(_JSON_PATH[f.name]).cast(f.dataType).alias(f.name) for f in SAMPLES.fields]
    )


def to_snapshots(samples: DataFrame) -> DataFrame:
    """Nested snapshots from flat samples, the counterpart of `to_samples`."""
    return samples.select(*[_nested(f, ()).alias(f.name) for f in SNAPSHOT_JSON.fields])


def _nested(field: T.StructField, parents: tuple[str, ...]) -> Column:
    path = (*parents, field.name)
    if isinstance(field.dataType, T.StructType):
        members = [_nested(f, path).alias(f.name) for f in field.dataType.fields]
        known = F.coalesce(*[_nested(f, path).cast("string") for f in field.dataType.fields]).isNotNull()
        return F.when(known, F.struct(*members))
    return F.col(_SAMPLE_OF_PATH[".".join(path)])


def enriched_json(samples: DataFrame) -> DataFrame:
    """One JSON text per executor: the snapshot fields with `cpuTimeMs` and `osCpuLoadPct` beside them.

    Absent values are left out, and an executor without finished tasks has `cpuTimeMs` 0.
    """
    counted = samples.withColumn("cpu_time_ms", F.coalesce("cpu_time_ms", F.lit(0)))
    return to_snapshots(counted).select(
        F.col("appId").alias("app_id"),
        F.col("pollSeq").alias("poll_seq"),
        F.col("id").alias("executor_id"),
        F.to_json(F.struct("*"), {"ignoreNullFields": "true"}).alias("value"),
    )


def write_snapshots(samples: DataFrame, path: str, mode: str = "append") -> None:
    """Write the enriched snapshots as JSON lines."""
    enriched_json(samples).select("value").write.mode(mode).text(path)
