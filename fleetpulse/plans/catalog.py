"""The registered queries, one per operator, over telemetry derived from the events table."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetpulse.functions import health, memory, numbers, tasks, text
from fleetpulse.operators import asof, ranking, rollups, rows as R, selection, series
from fleetpulse.operators import history as H
from fleetpulse.operators.joins import spread_join
from fleetpulse.operators.ordered import SEGMENT, SPLIT, Split, ordered_scan, poll_ordinals, with_segments
from fleetpulse.plans import derive, views
from fleetpulse.plans.views import live_summary, live_table
from fleetpulse.schemas import EXECUTOR, SAMPLES
from fleetpulse.settings import HISTORY_MAX_ROWS, RETENTION_MS, Settings
from fleetpulse.sources import csv_export, events as event_sources, history_store, snapshots
from fleetpulse.sources.shared import work_dir
from fleetpulse.streaming import counters, deltas, recording

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

ROW = ["app_id", "executor_id", "poll_seq"]
NOW_MS = derive.START_MS + 900 * derive.POLL_MS
RANGE_MINUTES = 30
ROW_CAP = 1000
SMALL_CAP = 500
MAX_AGE_MS = 30 * 60 * 1000

# The derived samples of an executor, and the polls of an application, are at most the hours of a month
# (8,784 a year), whatever the number of events. Plain windows over them are safe and save the second pass
# that keys of unknown size need. Queries over events themselves keep the default, which splits hot keys.
PER_KEY = None

# Cuts almost every key of the test tables, so that queries cover the cut path too.
SMALL_SPLIT = Split(max_rows=40, segment_rows=16)


def query(name: str):
    def register(build: Query) -> Query:
        QUERIES[name] = build
        return build

    return register


def samples_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.executor_samples(derive.read_events(spark, sf_dir))


def task_ends_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.task_ends(derive.read_events(spark, sf_dir))


def rows_of(spark: SparkSession, sf_dir: str, settings: Settings = Settings()) -> DataFrame:
    return R.executor_rows(samples_of(spark, sf_dir), settings, PER_KEY)


def process_cpu_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.process_cpu(derive.process_readings(derive.read_events(spark, sf_dir)))


def published_of(spark: SparkSession, sf_dir: str, split: Split = SPLIT) -> DataFrame:
    """CPU percentages; the two scans run over the same executors and axis, so they share one placement of the rows."""
    readings = derive.process_readings(derive.read_events(spark, sf_dir))
    placed = with_segments(readings, EXECUTOR, "sample_seq", split)
    return R.process_cpu_pct(derive.process_cpu(placed)).drop(SEGMENT)


def latest_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live_table(samples_of(spark, sf_dir), split=PER_KEY)


def history_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded rows in which some times of executor 5 cannot be parsed."""
    recorded = H.to_history(rows_of(spark, sf_dir))
    damaged = (F.col("executor") == "5") & (F.col("pollSeq") % 37 == 0)
    return recorded.withColumns(
        {
            "timeIso": F.when(damaged, "n/a").otherwise(F.col("timeIso")),
            "timeMs": F.when(~damaged, F.col("timeMs")),
        }
    )


def in_view_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.in_range(history_of(spark, sf_dir), NOW_MS, RANGE_MINUTES)


def grid_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.live_grid(samples_of(spark, sf_dir), split=PER_KEY)


def selected_of(samples: DataFrame) -> DataFrame:
    """Side table: the driver of every application and the odd executors of every second one."""
    app = F.regexp_extract("app_id", "([0-9]+)", 1).cast("bigint")
    number = F.col("executor_id").try_cast("bigint")
    return (
        samples.select(*EXECUTOR).distinct().filter((F.col("executor_id") == "driver") | ((app % 2 == 0) & (number % 2 == 1)))
    )


def live_apps_of(history: DataFrame) -> DataFrame:
    """Side table: every third application is gone."""
    number = F.regexp_extract("appId", "([0-9]+)", 1).cast("bigint")
    return history.select("appId").distinct().filter(number % 3 != 1)


# ---------------------------------------------------------------- entry


@query("live_summary")
def _(spark, sf_dir):
    summary = live_summary(samples_of(spark, sf_dir), split=PER_KEY)
    return summary.withColumns(
        {c: F.round(c, 4) for c in ["avg_heap_pct", "avg_gc_delta_ms"]}
    )


# ---------------------------------------------------------------- sources and sinks


@query("s01_snapshot_payloads")
def _(spark, sf_dir):
    """Whole responses, one for each poll of an application with all its executors, written to files and read back."""
    lines = snapshots.enriched_json(samples_of(spark, sf_dir))
    every = F.array_join(F.array_sort(F.collect_list("value")), ",")
    payloads = lines.groupBy("app_id", "poll_seq").agg(F.concat(F.lit("["), every, F.lit("]")).alias("value"))
    path = work_dir(spark, "payloads")
    payloads.select("value").write.text(path)
    return snapshots.parse_payloads(spark.read.text(path))


@query("s01_snapshot_files")
def _(spark, sf_dir):
    path = work_dir(spark, "snapshots")
    snapshots.write_snapshots(samples_of(spark, sf_dir), path)
    return snapshots.read_snapshots(spark, path)


@query("s02_task_end_log")
def _(spark, sf_dir):
    ends = task_ends_of(spark, sf_dir)
    kind = F.when(F.col("task_id") % 10 == 3, "SparkListenerTaskStart").otherwise(event_sources.TASK_END)
    info = F.struct(F.col("task_id").alias("Task ID"), F.col("executor_id").alias("Executor ID"))
    metrics = F.struct(F.col("cpu_ns").alias("Executor CPU Time"))
    line = F.struct(kind.alias("Event"), info.alias("Task Info"), metrics.alias("Task Metrics"))
    lines = ends.select("app_id", F.to_json(line).alias("value"))
    return event_sources.parse_event_log(lines).select("app_id", "executor_id", "task_id", "cpu_ns")


def _messages(spark, sf_dir):
    readings = derive.read_events(spark, sf_dir).select(
        derive.app_id().alias("appId"),
        derive.executor_id().alias("executorId"),
        F.col("event_id").alias("sampleSeq"),
        F.col("value").alias("cpuPct"),
    )
    body = (
        F.when(F.col("sampleSeq") % 17 == 0, "not a message")
        .when(F.col("sampleSeq") % 19 == 0, '{"kind": "other"}')
        .otherwise(F.to_json(F.struct("*")))
    )
    return readings.select(body.alias("value"))


@query("s03_process_samples")
def _(spark, sf_dir):
    return event_sources.parse_process_samples(_messages(spark, sf_dir))


@query("s04_enriched_json")
def _(spark, sf_dir):
    return snapshots.enriched_json(samples_of(spark, sf_dir))


@query("s05_history_records")
def _(spark, sf_dir):
    return H.conform(history_of(spark, sf_dir))


@query("s06_history_restore")
def _(spark, sf_dir):
    return H.bounded(history_of(spark, sf_dir), NOW_MS, HISTORY_MAX_ROWS, RETENTION_MS)


@query("s07_persisted_tail")
def _(spark, sf_dir):
    return H.persisted_tail(history_of(spark, sf_dir)).select("appId", "executor", "pollSeq", "heapMB")


@query("s08_history_reset")
def _(spark, sf_dir):
    history = history_of(spark, sf_dir)
    apps = live_apps_of(history)
    return H.without_apps(history, apps).select("appId", "executor", "pollSeq", "heapMB")


@query("s09_purge_stale_apps")
def _(spark, sf_dir):
    history = history_of(spark, sf_dir)
    return H.only_apps(history, live_apps_of(history)).select("appId", "executor", "pollSeq", "heapMB")


def stored_history(spark: SparkSession, sf_dir: str) -> str:
    """The history in a store of its own, appended in two parts."""
    path, history = work_dir(spark, "history-store"), history_of(spark, sf_dir)
    for early in (F.col("pollSeq") < 300, F.col("pollSeq") >= 300):
        history_store.append(history.filter(early), path)
    return path


@query("s05_store_append_and_read")
def _(spark, sf_dir):
    return history_store.read(spark, stored_history(spark, sf_dir))


@query("s06_store_restore")
def _(spark, sf_dir):
    return history_store.restore(spark, stored_history(spark, sf_dir), NOW_MS, RETENTION_MS, HISTORY_MAX_ROWS)


@query("s07_store_tail")
def _(spark, sf_dir):
    path, tail = stored_history(spark, sf_dir), work_dir(spark, "history-tail")
    history_store.persist_tail(history_store.read(spark, path), tail)
    return history_store.read(spark, tail).select("appId", "executor", "pollSeq", "heapMB")


@query("s08_store_reset")
def _(spark, sf_dir):
    path = stored_history(spark, sf_dir)
    live = live_apps_of(history_store.read(spark, path))
    history_store.reset(spark, path, live)
    return history_store.read(spark, path).select("appId", "executor", "pollSeq", "heapMB")


@query("s09_store_purge")
def _(spark, sf_dir):
    path = stored_history(spark, sf_dir)
    live = live_apps_of(history_store.read(spark, path))
    history_store.purge_stale(spark, path, live)
    history_store.compact(spark, path)
    return history_store.read(spark, path).select("appId", "executor", "pollSeq", "heapMB")


@query("s10_csv_documents")
def _(spark, sf_dir):
    return csv_export.csv_documents(history_of(spark, sf_dir), NOW_MS)


@query("s10_csv_lines")
def _(spark, sf_dir):
    return csv_export.csv_lines(history_of(spark, sf_dir))


@query("s11_model_parameters")
def _(spark, sf_dir):
    """Heap limits under a memory fraction configured per application; a fraction of 1 means no scaling."""
    samples = samples_of(spark, sf_dir)
    number = F.regexp_extract("app_id", "([0-9]+)", 1).cast("bigint")
    config = samples.select("app_id").distinct().select(
        "app_id",
        F.when(number % 3 == 0, 0.6).when(number % 3 == 1, 0.75).otherwise(1.0).alias("memory_fraction"),
    )
    joined = spread_join(samples, config, ["app_id"], "left", spread=["executor_id", "poll_seq"])
    limit = memory.heap_limit_bytes(F.col("max_memory"), F.col("memory_fraction"), Settings().reserved_bytes)
    return joined.select(*ROW, limit.alias("heap_max_bytes"))


# ---------------------------------------------------------------- projections


@query("p01_to_number")
def _(spark, sf_dir):
    raw = F.expr(
        "CASE event_id % 8 WHEN 0 THEN 'NaN' WHEN 1 THEN 'Infinity' WHEN 2 THEN 'abc' WHEN 3 THEN '' "
        "WHEN 4 THEN concat(' ', event_id, ' ') WHEN 5 THEN concat(event_id, 'e2') WHEN 6 THEN concat('-', event_id, '.5') "
        "ELSE concat(event_id, 'd') END"
    )
    readings = derive.read_events(spark, sf_dir).withColumn("raw", raw)
    ratio = F.try_divide(F.col("value"), F.col("value") - F.col("value"))
    return readings.select(
        "event_id",
        numbers.text_to_number(F.col("raw")).alias("number"),
        numbers.finite(F.when(F.col("event_id") % 3 == 0, F.lit(float("inf"))).otherwise(F.col("value"))).alias("finite"),
        numbers.finite(ratio).alias("undefined"),
    )


@query("p02_to_mb")
def _(spark, sf_dir):
    samples = samples_of(spark, sf_dir)
    return samples.select(*ROW, numbers.mb(F.col("rss")).alias("rss_mb"), numbers.mb(F.col("total_shuffle_read")).alias("read_mb"))


@query("p03_executor_rows")
def _(spark, sf_dir):
    return rows_of(spark, sf_dir)


@query("p04_host_label")
def _(spark, sf_dir):
    samples = samples_of(spark, sf_dir)
    return samples.select(*ROW, text.host_label(F.col("host_port"), F.col("host")).alias("host"))


@query("p05_heap_reading")
def _(spark, sf_dir):
    peak, current = F.col("peak_jvm_heap"), F.col("cur_jvm_heap")
    return samples_of(spark, sf_dir).select(
        *ROW, memory.heap_bytes(peak, current).alias("heap_bytes"), memory.heap_source(peak, current).alias("source")
    )


@query("p06_heap_reading_compat")
def _(spark, sf_dir):
    args = [F.col("peak_jvm_heap"), F.col("cur_jvm_heap"), F.col("used_on_heap_storage")]
    return samples_of(spark, sf_dir).select(
        *ROW,
        memory.heap_bytes_compat(*args).alias("heap_bytes"),
        memory.heap_source_compat(*args).alias("source"),
        args[0].alias("peak_bytes"),
    )


@query("p07_heap_limit")
def _(spark, sf_dir):
    limits = {
        "scaled": memory.heap_limit_bytes(F.col("max_memory"), 0.6, Settings().reserved_bytes),
        "unscaled": memory.heap_limit_bytes(F.col("max_memory"), 1.0, Settings().reserved_bytes),
    }
    return samples_of(spark, sf_dir).select(*ROW, *[v.alias(k) for k, v in limits.items()])


def _row_columns(name: str, *columns: str) -> None:
    """Register a projection of the derived rows."""
    QUERIES[name] = lambda spark, sf_dir: rows_of(spark, sf_dir).select(*ROW, *columns)


_row_columns("p08_heap_pct", "heap_pct")
_row_columns("p09_task_capacity", "max_tasks")
_row_columns("p10_saturation_pct", "saturation_pct")
_row_columns("p11_gc_seconds", "gc_seconds")
_row_columns("p12_gc_pct", "gc_pct")


@query("p13_estimated_total")
def _(spark, sf_dir):
    total = memory.estimated_total(F.col("heap_mb"), F.col("jvm_off_heap_mb"), F.col("off_heap_unified_mb"))
    return rows_of(spark, sf_dir).select(*ROW, total.alias("estimated_mb"))


@query("p14_total_by_mode")
def _(spark, sf_dir):
    args = [F.col("heap_mb"), F.col("jvm_off_heap_mb"), F.col("off_heap_unified_mb"), F.col("rss_mb")]
    return rows_of(spark, sf_dir).select(
        *ROW,
        memory.total_memory("rss", *args).alias("rss_total"),
        memory.total_memory_source("rss", args[-1]).alias("rss_source"),
        memory.total_memory("estimated", *args).alias("estimated_total"),
        memory.total_memory_source("estimated", args[-1]).alias("estimated_source"),
    )


@query("p15_recorded_total")
def _(spark, sf_dir):
    total = memory.recorded_total(
        F.col("total_memory_mb"), F.col("heap_mb"), F.col("jvm_off_heap_mb"), F.col("off_heap_unified_mb")
    )
    return rows_of(spark, sf_dir).select(*ROW, total.alias("recorded_mb"), "total_memory_source")


_row_columns("p16_native_other", "native_other_mb")


@query("p17_share_of_total")
def _(spark, sf_dir):
    shares = R.with_total_shares(rows_of(spark, sf_dir))
    return shares.select(*ROW, "jvm_off_heap_pct", "off_heap_unified_pct", "native_other_pct")


_row_columns(
    "p18_other_mb_columns",
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
)


@query("p19_chart_cpu_clip")
def _(spark, sf_dir):
    return rows_of(spark, sf_dir).select(*ROW, tasks.chart_cpu_pct(F.col("cpu_pct"), 20.0).alias("clipped"), "cpu_pct")


@query("p20_series_rounding")
def _(spark, sf_dir):
    return series.series_points(samples_of(spark, sf_dir), PER_KEY)


@query("p21_display_text")
def _(spark, sf_dir):
    return rows_of(spark, sf_dir).select(
        *ROW,
        text.int_text(F.col("rdd_blocks")).alias("rdd_text"),
        text.mb_text(F.col("heap_mb")).alias("heap_text"),
        text.bytes_as_mb_text(F.col("disk_used_bytes")).alias("disk_text"),
        text.pct_text(F.col("saturation_pct")).alias("saturation_text"),
        text.seconds_text(F.col("gc_seconds")).alias("gc_text"),
        text.gc_delta_text(F.col("gc_delta_ms")).alias("gc_delta_text"),
        text.with_source(text.pct_text(F.col("cpu_pct")), F.col("cpu_source")).alias("cpu_text"),
        text.with_source(text.mb_text(F.col("total_memory_mb")), F.col("total_memory_source")).alias("total_text"),
    )


@query("p22_natural_key")
def _(spark, sf_dir):
    name = F.expr("concat('Exec-', user_id % 137, '_Node', lpad(CAST(event_id AS STRING), 9, '0'))")
    return derive.read_events(spark, sf_dir).select("event_id", text.natural_key(name).alias("sort_key"))


@query("p23_metric_unpivot")
def _(spark, sf_dir):
    points = series.series_points(samples_of(spark, sf_dir), PER_KEY).withColumn("native_other", F.lit(None).cast("double"))
    chosen = series.unpivot_metrics(points, ROW, ["overhead", "total"])
    return chosen.unionByName(series.unpivot_metrics(points, ROW))


@query("p24_legend")
def _(spark, sf_dir):
    grid = grid_of(spark, sf_dir)
    latest = rollups.latest_non_null(grid, series.SERIES, order="poll_ord")
    rss = series.legend(latest, mode="rss").withColumn("mode", F.lit("rss"))
    return rss.unionByName(series.legend(latest, mode="estimated").withColumn("mode", F.lit("estimated")))


# ---------------------------------------------------------------- filters and classes


@query("f01_live_only")
def _(spark, sf_dir):
    return R.active_only(samples_of(spark, sf_dir)).select(*ROW)


_row_columns("f02_unhealthy_flag", "is_unhealthy")


@query("f03_only_unhealthy")
def _(spark, sf_dir):
    return rows_of(spark, sf_dir).filter("is_unhealthy").select(*ROW)


@query("f04_view_range")
def _(spark, sf_dir):
    return H.in_range(history_of(spark, sf_dir), NOW_MS, RANGE_MINUTES).select("appId", "executor", "pollSeq")


@query("f05_selected_rows")
def _(spark, sf_dir):
    samples = samples_of(spark, sf_dir)
    rows = R.executor_rows(samples, split=PER_KEY)
    return selection.apply_selection(rows, selected_of(samples)).select(*ROW, "heap_mb")


@query("f06_cell_severity")
def _(spark, sf_dir):
    classes = health.cell_severities(85, 400)
    return rows_of(spark, sf_dir).withColumns(classes).select(*ROW, *classes)


@query("f07_card_severity")
def _(spark, sf_dir):
    classes = health.card_severities()
    cards = rollups.summarise(rows_of(spark, sf_dir), ["app_id", "poll_seq"])
    return cards.withColumns(classes).select("app_id", "poll_seq", *classes)


@query("f08_counted_task_ends")
def _(spark, sf_dir):
    ends = task_ends_of(spark, sf_dir)
    return ends.filter(tasks.counted_cpu_ns(F.col("executor_id"), F.col("cpu_ns"))).select("task_id", *EXECUTOR, "cpu_ns")


# ---------------------------------------------------------------- joins


@query("j01_cpu_time_as_of_poll")
def _(spark, sf_dir):
    polls = samples_of(spark, sf_dir).select(*ROW)
    return asof.cpu_time_as_of(polls, task_ends_of(spark, sf_dir))


@query("j01_cpu_time_as_of_poll_cut_keys")
def _(spark, sf_dir):
    polls = samples_of(spark, sf_dir).select(*ROW)
    return asof.cpu_time_as_of(polls, task_ends_of(spark, sf_dir), split=SMALL_SPLIT)


@query("j01_cpu_time_total")
def _(spark, sf_dir):
    polls = ranking.latest_poll(samples_of(spark, sf_dir)).select(*ROW)
    return asof.attach_cpu_totals(polls, rollups.cpu_totals(task_ends_of(spark, sf_dir)))


@query("j02_process_cpu_as_of_poll")
def _(spark, sf_dir):
    polls = samples_of(spark, sf_dir).select(*ROW)
    published = published_of(spark, sf_dir)
    return asof.process_cpu_as_of(polls, published)


@query("l01_enriched_rows")
def _(spark, sf_dir):
    """From bare samples, task ends and process readings to derived rows: both counters feed the CPU cascade."""
    samples = asof.enriched(samples_of(spark, sf_dir), task_ends_of(spark, sf_dir), published_of(spark, sf_dir))
    return R.executor_rows(samples, split=PER_KEY).select(*ROW, "cpu_source", F.round("cpu_pct", 6).alias("cpu_pct"), "is_unhealthy")


@query("j03_selected_semi_join")
def _(spark, sf_dir):
    samples = samples_of(spark, sf_dir)
    return selection.apply_selection(samples, selected_of(samples)).select(*ROW)


@query("j04_gap_filled_grid")
def _(spark, sf_dir):
    samples = samples_of(spark, sf_dir)
    polls = samples.select("app_id", "poll_seq").distinct()
    return series.gap_filled(series.series_points(samples, PER_KEY), polls, R.active_only(samples), split=PER_KEY)


@query("j05_history_grid")
def _(spark, sf_dir):
    return H.history_grid(in_view_of(spark, sf_dir))


@query("j06_live_app_semi_join")
def _(spark, sf_dir):
    history = history_of(spark, sf_dir)
    return H.only_apps(history, live_apps_of(history)).groupBy("appId").agg(F.count(F.lit(1)).alias("rows_kept"))


@query("j07_nearest_points")
def _(spark, sf_dir):
    grid = grid_of(spark, sf_dir)
    length = grid.groupBy("app_id").agg(F.max("poll_ord").alias("points"))
    probes = length.select("app_id", F.explode(F.array(*[F.lit(x) for x in (0.0, 0.13, 0.5, 0.77, 1.0)])).alias("x"))
    return series.nearest_points(series.stacked_bands(grid), length, probes)


# ---------------------------------------------------------------- aggregations


@query("d01_cpu_totals")
def _(spark, sf_dir):
    return rollups.cpu_totals(task_ends_of(spark, sf_dir))


@query("d02_latest_process_cpu")
def _(spark, sf_dir):
    return rollups.latest_cpu_pct(published_of(spark, sf_dir))


@query("d03_summary_cards")
def _(spark, sf_dir):
    cards = rollups.summarise(rows_of(spark, sf_dir), ["app_id", "poll_seq"])
    return cards.withColumns({c: F.round(c, 4) for c in ["avg_heap_pct", "avg_gc_delta_ms"]})


@query("d04_status_line")
def _(spark, sf_dir):
    samples = samples_of(spark, sf_dir)
    rows = R.executor_rows(samples, Settings(), PER_KEY)
    group = ["app_id", "poll_seq"]
    return rollups.status(rows, F.col("is_unhealthy"), only_unhealthy=True, group=group, samples=samples)


@query("d05_top_offenders")
def _(spark, sf_dir):
    return ranking.top_offenders(rows_of(spark, sf_dir), ["app_id", "poll_seq"])


@query("d06_rss_availability")
def _(spark, sf_dir):
    return rollups.rss_availability(rows_of(spark, sf_dir))


@query("d06_rss_availability_by_poll")
def _(spark, sf_dir):
    samples = samples_of(spark, sf_dir)
    return rollups.rss_availability_by_poll(R.executor_rows(samples, Settings(), PER_KEY), PER_KEY, samples)


@query("d07_peak_source_flag")
def _(spark, sf_dir):
    return rollups.peak_source_used(rows_of(spark, sf_dir), ["app_id", "poll_seq"])


@query("d08_last_samples")
def _(spark, sf_dir):
    return H.last_samples(in_view_of(spark, sf_dir), Settings(memory_mode="estimated"))


@query("d09_range_info")
def _(spark, sf_dir):
    history = history_of(spark, sf_dir)
    return H.range_info(history, H.in_range(history, NOW_MS, RANGE_MINUTES))


def range_summary_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return views.range_summary(history_of(spark, sf_dir), NOW_MS, RANGE_MINUTES, Settings(memory_mode="estimated"))


@query("v01_range_table")
def _(spark, sf_dir):
    estimated = Settings(memory_mode="estimated")
    table = views.range_table(history_of(spark, sf_dir), NOW_MS, RANGE_MINUTES, estimated, only_unhealthy=True)
    return table.select(*ROW, "host", "heap_pct", "total_memory_mb", "gc_delta_ms", "failed_tasks")


@query("v02_range_summary")
def _(spark, sf_dir):
    summary, _offenders = range_summary_of(spark, sf_dir)
    return summary.withColumns({c: F.round(c, 4) for c in ["avg_heap_pct", "avg_gc_delta_ms"]})


@query("v03_range_offenders")
def _(spark, sf_dir):
    _summary, offenders = range_summary_of(spark, sf_dir)
    return offenders


@query("v04_range_label")
def _(spark, sf_dir):
    return views.range_info(history_of(spark, sf_dir), NOW_MS, RANGE_MINUTES)


@query("d10_selection_state")
def _(spark, sf_dir):
    samples = samples_of(spark, sf_dir)
    return selection.selection_state(live_table(samples, split=PER_KEY), selected_of(samples))


@query("d11_record_count")
def _(spark, sf_dir):
    return rollups.record_count(samples_of(spark, sf_dir))


@query("d12_axis_scale")
def _(spark, sf_dir):
    grid = grid_of(spark, sf_dir)
    return rollups.axis_scale(series.chart_values(grid, series.stacked_bands(grid)))


# ---------------------------------------------------------------- windows


_row_columns("x01_gc_delta", "gc_delta_ms")


@query("x02_previous_poll_state")
def _(spark, sf_dir):
    active = R.active_only(samples_of(spark, sf_dir))
    before = {f"prev_{c}": F.col(c) for c in ["wall_ms", "cpu_time_ms", "total_duration_ms"]}
    return ordered_scan(active, EXECUTOR, "poll_seq", previous=before, split=PER_KEY).select(*ROW, *before)


_row_columns("x03_cpu_cascade", "cpu_pct", "cpu_source")


@query("x04_process_cpu_pct")
def _(spark, sf_dir):
    return published_of(spark, sf_dir)


@query("x03_cpu_cascade_cut_keys")
def _(spark, sf_dir):
    return R.executor_rows(samples_of(spark, sf_dir), split=SMALL_SPLIT).select(*ROW, "cpu_pct", "cpu_source")


@query("x04_process_cpu_pct_cut_keys")
def _(spark, sf_dir):
    return published_of(spark, sf_dir, SMALL_SPLIT)


@query("x05_change_direction")
def _(spark, sf_dir):
    return R.change_directions(samples_of(spark, sf_dir), split=PER_KEY)


@query("x06_latest_non_null")
def _(spark, sf_dir):
    return rollups.latest_non_null(series.series_points(samples_of(spark, sf_dir), PER_KEY), series.SERIES)


@query("x07_live_window")
def _(spark, sf_dir):
    return ranking.last_polls(samples_of(spark, sf_dir), 120).select(*ROW)


@query("x08_stacked_bands")
def _(spark, sf_dir):
    return series.stacked_bands(grid_of(spark, sf_dir))


@query("x08_stacked_bands_estimated")
def _(spark, sf_dir):
    return series.stacked_bands(grid_of(spark, sf_dir), ["heap", "off_heap", "total"], mode="estimated")


@query("x09_poll_ordinal")
def _(spark, sf_dir):
    return poll_ordinals(samples_of(spark, sf_dir), PER_KEY)


# ---------------------------------------------------------------- order, retention, sets


@query("o01_table_sort")
def _(spark, sf_dir):
    """Positions under several keys and both directions, with empty values and text among them."""
    latest, found = latest_of(spark, sf_dir), []
    for key, direction in (("heap_pct", None), ("heap_pct", "asc"), ("gc_delta_ms", "asc"), ("rss_mb", "desc"), ("host", None)):
        placed = ranking.row_positions(latest, ["app_id"], key, direction)
        name = f"{key} {direction or ranking.default_direction(key)}"
        found.append(placed.select(*ROW, "position", F.lit(name).alias("sorted_by")))
    return reduce(DataFrame.unionByName, found)


@query("o02_visible_series")
def _(spark, sf_dir):
    return ranking.series_positions(series.visible_series(grid_of(spark, sf_dir)), ["app_id", "metric"])


@query("o03_top_rows")
def _(spark, sf_dir):
    return ranking.top_rows(latest_of(spark, sf_dir), "shuffle_read_mb", 3).select(*ROW, "shuffle_read_mb")


@query("r01_age_retention")
def _(spark, sf_dir):
    parsed = history_of(spark, sf_dir).withColumn("timeMs", H.time_ms(F.col("timeIso")))
    return H.within_retention(parsed, NOW_MS).select("appId", "executor", "pollSeq", "timeIso")


@query("r02_row_cap")
def _(spark, sf_dir):
    return H.bounded(history_of(spark, sf_dir), NOW_MS, ROW_CAP, RETENTION_MS).select("appId", "executor", "pollSeq")


@query("u01_series_union")
def _(spark, sf_dir):
    return series.series_items(series.stacked_bands(grid_of(spark, sf_dir)))


@query("u02_record_once")
def _(spark, sf_dir):
    rows = rows_of(spark, sf_dir)
    rendered = rows.withColumn("render", F.explode(F.sequence(F.lit(1), 1 + F.col("poll_seq") % 3))).drop("render")
    return H.record_once(rendered).select(*ROW, "heap_mb")




# ---------------------------------------------------------------- streams


STEPS = ((0, 250), (250, 500), (500, None))


def in_steps(
    spark: SparkSession, sf_dir: str, root: str, start: Callable[[DataFrame], StreamingQuery]
) -> None:
    """Feed the derived samples to a stream in three steps, cut by poll so that every executor spans them.

    Each step appends its samples to the stream's folder and runs the query to the end of what is there; the next
    step starts it again from its checkpoint.
    """
    samples = samples_of(spark, sf_dir).select(*SAMPLES.fieldNames())
    for low, high in STEPS:
        part = samples.filter(F.col("poll_seq") >= low)
        part = part if high is None else part.filter(F.col("poll_seq") < high)
        part.write.mode("append").parquet(f"{root}/samples")
        start(spark.readStream.schema(SAMPLES).parquet(f"{root}/samples")).awaitTermination()


def rows_in_steps(spark: SparkSession, sf_dir: str, purpose: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    root = work_dir(spark, purpose)
    in_steps(
        spark,
        sf_dir,
        root,
        lambda stream: counters.write_rows(build(stream), f"{root}/out", f"{root}/checkpoint", availableNow=True),
    )
    return spark.read.parquet(f"{root}/out")


def in_parts(table: DataFrame, number: str, root: str, start: Callable[[DataFrame], StreamingQuery]) -> None:
    """Feed a table to a stream in three parts, each a run from the checkpoint; parts follow `number` in runs of 100."""
    spark = table.sparkSession
    for part in range(3):
        rows = table.filter(F.call_function("div", F.col(number), F.lit(100).cast("bigint")) % 3 == part)
        rows.write.mode("append").parquet(f"{root}/in")
        start(spark.readStream.schema(table.schema).parquet(f"{root}/in")).awaitTermination()


def current_values(table: DataFrame, purpose: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    spark = table.sparkSession
    root = work_dir(spark, purpose)
    in_parts(
        table,
        "event_id",
        root,
        lambda stream: counters.write_updates(build(stream), f"{root}/out", f"{root}/checkpoint", availableNow=True),
    )
    return counters.read_updates(spark, f"{root}/out", EXECUTOR)


@query("t01_snapshot_stream")
def _(spark, sf_dir):
    def build(stream):
        return counters.stateless_rows(stream).select(*ROW, "heap_pct", "saturation_pct")

    return rows_in_steps(spark, sf_dir, "snapshot-stream", build)


@query("t02_running_cpu_totals")
def _(spark, sf_dir):
    def build(stream):
        return counters.running_cpu_totals(derive.task_ends(stream))

    return current_values(derive.read_events(spark, sf_dir), "cpu-totals", build)


@query("t03_latest_process_cpu")
def _(spark, sf_dir):
    def build(stream):
        published = stream.select(
            derive.app_id().alias("app_id"),
            derive.executor_id().alias("executor_id"),
            F.col("event_id").alias("sample_seq"),
            F.col("value").alias("cpu_pct"),
        )
        return counters.running_latest_cpu(published)

    return current_values(derive.read_events(spark, sf_dir), "latest-cpu", build)


@query("t04_stateful_deltas")
def _(spark, sf_dir):
    def build(stream):
        return deltas.stream_deltas(stream).select(*ROW, "gc_delta_ms", "cpu_pct", "cpu_source")

    return rows_in_steps(spark, sf_dir, "stateful-deltas", build)


@query("t04_stateful_process_cpu")
def _(spark, sf_dir):
    root = work_dir(spark, "process-cpu")
    readings = process_cpu_of(spark, sf_dir)
    readings.write.parquet(f"{root}/readings")
    readings = spark.read.parquet(f"{root}/readings")
    newest = readings.agg(F.max("sample_seq")).first()[0] or 0
    for low, high in ((0, newest // 3), (newest // 3, newest // 2), (newest // 2, newest + 1)):
        part = readings.filter((F.col("sample_seq") >= low) & (F.col("sample_seq") < high))
        part.write.mode("append").parquet(f"{root}/in")
        found = deltas.stream_process_cpu(spark.readStream.schema(readings.schema).parquet(f"{root}/in"))
        counters.write_rows(found, f"{root}/out", f"{root}/checkpoint", availableNow=True).awaitTermination()
    return spark.read.parquet(f"{root}/out")


@query("t05_recorded_once")
def _(spark, sf_dir):
    def build(stream):
        renders = F.explode(F.sequence(F.lit(1), 1 + F.col("poll_seq") % 3))
        return recording.recorded_once(stream.withColumn("render", renders)).select(*ROW, "rss")

    return rows_in_steps(spark, sf_dir, "recorded-once", build)


@query("t06_bounded_history")
def _(spark, sf_dir):
    root = work_dir(spark, "bounded-history")
    in_steps(
        spark,
        sf_dir,
        root,
        lambda stream: recording.record_stream(
            H.to_history(deltas.live_rows(stream)),
            f"{root}/history",
            f"{root}/checkpoint",
            trigger={"availableNow": True},
        ),
    )
    stored = history_store.restore_by_own_clock(spark, f"{root}/history", SMALL_CAP, MAX_AGE_MS)
    return stored.select("appId", "executor", "pollSeq", "gcDeltaMs", "heapMB")


@query("t07_unhealthy_alerts")
def _(spark, sf_dir):
    def build(stream):
        return deltas.unhealthy_alerts(stream).select(*ROW, "heap_pct", "gc_delta_ms", "failed_tasks")

    return rows_in_steps(spark, sf_dir, "alerts", build)
