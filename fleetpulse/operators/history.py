"""Recorded history: record form, retention, range view and its derived rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.functions import memory
from fleetpulse.functions.numbers import percent
from fleetpulse.operators.joins import spread_join
from fleetpulse.operators.ordered import ordered_scan
from fleetpulse.operators.ranking import newest_rows, top_per_group
from fleetpulse.operators.rows import with_health
from fleetpulse.operators.series import SERIES
from fleetpulse.schemas import HISTORY
from fleetpulse.settings import PERSIST_MAX_ROWS, RETENTION_MS, Settings

HISTORY_EXECUTOR = ["appId", "executor"]

# Fixed value: recorded column for each series of the range view.
_SERIES_SOURCE = {
    "heap": "heapMB",
    "overhead": "jvmOffHeapMB",
    "off_heap": "offHeapUnifiedMB",
    "total": "totalMemoryMB",
    "rss": "rssMB",
    "gc_delta": "gcDeltaMs",
    "saturation": "saturationPct",
    "cpu": "cpuPct",
}


def iso_time(wall_ms: Column) -> Column:
    """UTC time text with milliseconds, e.g. 2024-01-01T00:00:05.000Z, whatever the session time zone."""
    epoch = F.lit("1970-01-01T00:00:00").cast("timestamp_ntz")
    seconds = F.timestamp_add("SECOND", F.floor(wall_ms / F.lit(1000)), epoch).cast("string")
    millis = F.lpad(F.pmod(wall_ms, F.lit(1000)).cast("string"), 3, "0")
    return F.concat(F.replace(seconds, F.lit(" "), F.lit("T")), F.lit("."), millis, F.lit("Z"))


def time_ms(time_iso: Column) -> Column:
    """Epoch milliseconds of a recorded time; null when it cannot be parsed."""
    return F.unix_millis(F.try_to_timestamp(time_iso))


def to_history(rows: DataFrame) -> DataFrame:
    """Recorded form of derived rows: the 32 exported columns, poll number, insertion order and parsed time.

    Rows of one poll are recorded together, so insertion order is the poll and then the executor; it is a number
    derived from both and needs no global sort.
    """
    col = F.col
    iso = iso_time(col("wall_ms"))
    total = memory.recorded_total(
        col("total_memory_mb"), col("heap_mb"), col("jvm_off_heap_mb"), col("off_heap_unified_mb")
    )
    return rows.select(
        col("app_id").alias("appId"),
        F.substring(iso, 12, 8).alias("timeLabel"),
        iso.alias("timeIso"),
        col("executor_id").alias("executor"),
        "host",
        col("heap_mb").alias("heapMB"),
        col("heap_max_mb").alias("heapMaxMB"),
        col("heap_pct").alias("heapPct"),
        col("gc_seconds").alias("gcTimeSeconds"),
        col("gc_delta_ms").alias("gcDeltaMs"),
        col("active_tasks").alias("activeTasks"),
        col("max_tasks").alias("maxTasks"),
        col("saturation_pct").alias("saturationPct"),
        col("cpu_pct").alias("cpuPct"),
        col("failed_tasks").alias("failedTasks"),
        col("jvm_off_heap_mb").alias("jvmOffHeapMB"),
        col("off_heap_unified_mb").alias("offHeapUnifiedMB"),
        col("rss_mb").alias("rssMB"),
        total.alias("totalMemoryMB"),
        col("total_memory_source").alias("totalMemorySource"),
        col("native_other_mb").alias("nativeOtherMB"),
        col("on_heap_exec_mb").alias("onHeapExecMB"),
        col("on_heap_storage_peak_mb").alias("onHeapStoragePeakMB"),
        col("on_heap_unified_mb").alias("onHeapUnifiedMB"),
        col("on_heap_storage_mb").alias("onHeapStorageMB"),
        col("total_on_heap_capacity_mb").alias("totalOnHeapCapacityMB"),
        col("rdd_blocks").alias("rddBlocks"),
        col("disk_used_mb").alias("diskUsedMB"),
        col("memory_used_mb").alias("memoryUsedMB"),
        col("shuffle_read_mb").alias("shuffleReadMB"),
        col("shuffle_write_mb").alias("shuffleWriteMB"),
        col("metric_source").alias("metricSource"),
        col("poll_seq").alias("pollSeq"),
        ingest_number(col("poll_seq"), col("executor_id")).alias("ingestSeq"),
        col("wall_ms").alias("timeMs"),
    )


# Fixed value: executor ids up to this number keep their own position inside a poll's insertion numbers.
_EXECUTORS_PER_POLL = 1 << 24

# Insertion numbers ranked in one task: the rows of 16 polls.
_RANKED_TOGETHER = 16 * _EXECUTORS_PER_POLL


def ingest_number(poll_seq: Column, executor_id: Column) -> Column:
    """Insertion number of a recorded row: all rows of a poll come before those of the next.

    Numbered executors follow the driver in id order. Ids that are no plain number are placed by a hash, so two of
    them may share a number; readers that need a total order add the id.
    """
    number = executor_id.try_cast("bigint")
    hashed = F.pmod(F.xxhash64(executor_id), F.lit(_EXECUTORS_PER_POLL - 1)) + 1
    within = (
        F.when(executor_id == "driver", F.lit(0).cast("bigint"))
        .when((number >= 0) & (number < _EXECUTORS_PER_POLL - 1), number + 1)
        .otherwise(hashed)
    )
    return poll_seq * F.lit(_EXECUTORS_PER_POLL) + within


def record_once(rows: DataFrame, recording: bool = True) -> DataFrame:
    """One row per (application, poll, executor) however often a poll was rendered; nothing before the first poll."""
    started = rows.filter((F.col("poll_seq") > 0) & F.lit(recording))
    return started.dropDuplicates(["app_id", "poll_seq", "executor_id"])


def within_retention(history: DataFrame, now_ms: int, max_age_ms: int = RETENTION_MS) -> DataFrame:
    """Rows not older than the retention age; rows whose time cannot be parsed are kept."""
    return history.filter(F.col("timeMs").isNull() | (F.col("timeMs") >= F.lit(now_ms - max_age_ms)))


def bounded(
    history: DataFrame, now_ms: int, max_rows: int | None = None, max_age_ms: int | None = None
) -> DataFrame:
    """Retention by age first, then the newest `max_rows` rows of each application in insertion order.

    None sets no bound; `HISTORY_MAX_ROWS` and `RETENTION_MS` are the bounds of a session's own memory.
    """
    kept = history if max_age_ms is None else within_retention(history, now_ms, max_age_ms)
    return kept if max_rows is None else _newest(kept, max_rows)


def bounded_by_own_clock(
    history: DataFrame, max_rows: int | None = None, max_age_ms: int | None = None
) -> DataFrame:
    """The same bounds where the present of each application is the newest time it has recorded itself."""
    kept = history
    if max_age_ms is not None:
        clocks = history.groupBy(F.col("appId").alias("_app")).agg(F.max("timeMs").alias("_now"))
        dated = spread_join(history, clocks.withColumnRenamed("_app", "appId"), ["appId"], spread=["executor", "pollSeq"])
        fresh = F.col("timeMs").isNull() | (F.col("timeMs") >= F.col("_now") - F.lit(max_age_ms))
        kept = dated.filter(fresh).select(*history.columns)
    return kept if max_rows is None else _newest(kept, max_rows)


def persisted_tail(history: DataFrame, max_rows: int = PERSIST_MAX_ROWS) -> DataFrame:
    """The bounded tail that is persisted; the full history is not touched."""
    return _newest(history, max_rows)


def _newest(history: DataFrame, max_rows: int) -> DataFrame:
    return newest_rows(history, ["appId"], "ingestSeq", max_rows, ties=["executor"], width=_RANKED_TOGETHER)


def in_range(history: DataFrame, now_ms: int, minutes: float | None = None) -> DataFrame:
    """Rows of the last `minutes`; unparsable times are dropped. None or infinity keeps everything."""
    if minutes is None or minutes == float("inf"):
        return history
    return history.filter(F.col("timeMs") >= F.lit(now_ms - int(minutes * 60000)))


def last_samples(history: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Newest sample per executor, re-derived under the current settings.

    Times compare as text and the first recorded row wins on equal times. The GC share is not recorded, so it is null
    and takes no part in the health predicate.
    """
    newest = top_per_group(history, HISTORY_EXECUTOR, [F.desc("timeIso"), F.asc("ingestSeq")], 1)
    heap, overhead, off_heap = F.col("heapMB"), F.col("jvmOffHeapMB"), F.col("offHeapUnifiedMB")
    total = memory.total_memory(settings.memory_mode, heap, overhead, off_heap, F.col("rssMB"))
    source = memory.total_memory_source(settings.memory_mode, F.col("rssMB"))
    rows = newest.select(
        F.col("appId").alias("app_id"),
        F.col("executor").alias("executor_id"),
        F.col("pollSeq").alias("poll_seq"),
        F.col("timeMs").alias("wall_ms"),
        "host",
        (heap * F.lit(1048576.0)).alias("heap_bytes"),
        heap.alias("heap_mb"),
        F.coalesce(F.col("heapMaxMB") * F.lit(1048576.0), F.lit(0.0)).alias("heap_max_bytes"),
        F.col("heapMaxMB").alias("heap_max_mb"),
        percent(heap, F.col("heapMaxMB")).alias("heap_pct"),
        overhead.alias("jvm_off_heap_mb"),
        off_heap.alias("off_heap_unified_mb"),
        F.col("rssMB").alias("rss_mb"),
        total.alias("total_memory_mb"),
        source.alias("total_memory_source"),
        memory.native_other(heap, overhead, off_heap, total, source).alias("native_other_mb"),
        F.col("gcTimeSeconds").alias("gc_seconds"),
        F.lit(None).cast("double").alias("gc_pct"),
        F.col("gcDeltaMs").alias("gc_delta_ms"),
        F.col("activeTasks").alias("active_tasks"),
        F.col("maxTasks").alias("max_tasks"),
        F.col("saturationPct").alias("saturation_pct"),
        F.col("cpuPct").alias("cpu_pct"),
        F.col("failedTasks").alias("failed_tasks"),
        F.col("shuffleReadMB").alias("shuffle_read_mb"),
        F.col("shuffleWriteMB").alias("shuffle_write_mb"),
        F.col("rddBlocks").alias("rdd_blocks"),
        F.col("diskUsedMB").alias("disk_used_mb"),
        F.col("memoryUsedMB").alias("memory_used_mb"),
        F.col("onHeapStorageMB").alias("on_heap_storage_mb"),
        F.col("totalOnHeapCapacityMB").alias("total_on_heap_capacity_mb"),
        F.col("onHeapExecMB").alias("on_heap_exec_mb"),
        F.col("onHeapStoragePeakMB").alias("on_heap_storage_peak_mb"),
        F.col("onHeapUnifiedMB").alias("on_heap_unified_mb"),
        F.col("metricSource").alias("metric_source"),
    )
    return with_health(rows, settings)


def range_info(history: DataFrame, in_view: DataFrame) -> DataFrame:
    """Per application: distinct sample times and executors in view, and rows in the whole history."""
    view = in_view.groupBy("appId").agg(
        F.count_distinct("timeIso").alias("samples"), F.count_distinct("executor").alias("executors")
    )
    total = history.groupBy("appId").agg(F.count(F.lit(1)).alias("total_rows"))
    zero = F.lit(0)
    return total.join(view, "appId", "left").select(
        "appId",
        F.coalesce("samples", zero).alias("samples"),
        F.coalesce("executors", zero).alias("executors"),
        "total_rows",
    )


def history_grid(in_view: DataFrame) -> DataFrame:
    """Gap-filled series of a range view: executors by the distinct times of their application.

    Rows of one (executor, time) are merged value by value, the last recorded non-null one winning. Distinct times are
    numbered by an ordered scan, so an application may have any number of them; unparsable times come last.
    """
    estimate = memory.estimated_total(F.col("heapMB"), F.col("jvmOffHeapMB"), F.col("offHeapUnifiedMB"))
    values = in_view.withColumn("totalMemoryMB", F.coalesce(F.col("totalMemoryMB"), estimate))
    merged = values.groupBy(*HISTORY_EXECUTOR, "timeIso").agg(
        *[
            F.max_by(F.col(source).cast("double"), F.when(F.col(source).isNotNull(), F.col("ingestSeq"))).alias(name)
            for name, source in _SERIES_SOURCE.items()
        ]
    )
    at = F.coalesce(F.min("timeMs"), F.lit((1 << 62)))
    axis = in_view.groupBy("appId", "timeIso").agg(F.min_by("timeLabel", "ingestSeq").alias("timeLabel"), at.alias("_at"))
    one = F.lit(1).cast("bigint")
    scanned = ordered_scan(axis, ["appId"], "_at", running_sum={"position": one}, ties=["timeIso"])
    numbered = scanned.withColumn("position", F.col("position").cast("int")).drop("_at")
    length = numbered.groupBy("appId").agg(F.max("position").alias("_points"))
    grid = (
        spread_join(in_view.select(*HISTORY_EXECUTOR).distinct(), length, ["appId"], spread=["executor"])
        .select(*HISTORY_EXECUTOR, F.explode(F.sequence(F.lit(1), F.col("_points"))).alias("position"))
        .join(numbered, ["appId", "position"])
    )
    return grid.join(merged, [*HISTORY_EXECUTOR, "timeIso"], "left").select(
        *HISTORY_EXECUTOR, "position", "timeIso", "timeLabel", *SERIES
    )


def without_apps(history: DataFrame, apps: DataFrame) -> DataFrame:
    """History with the given applications removed."""
    return spread_join(history, apps.select("appId").distinct(), ["appId"], "left_anti", spread=["executor", "pollSeq"])


def only_apps(history: DataFrame, apps: DataFrame) -> DataFrame:
    """History of the given (still live) applications."""
    return spread_join(history, apps.select("appId").distinct(), ["appId"], "left_semi", spread=["executor", "pollSeq"])


def conform(df: DataFrame) -> DataFrame:
    """Columns of the history table in their fixed order and types."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in HISTORY.fields])
