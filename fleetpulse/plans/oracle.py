"""SQL equivalents of the registered queries.

They are written from the definitions, with plain windows, correlated joins and integer arithmetic, and share no
expression with the Spark side, so that equal results mean something.
"""

from __future__ import annotations

from fleetpulse.schemas import HISTORY_CSV_COLUMNS

NOW_MS = 1704067200000 + 900 * 5000

TASK_ENDS = """task_ends AS (
  SELECT event_id AS task_id,
    concat('app-', CAST(user_id % 3 + 3 * CAST(floor(user_id / 150) AS BIGINT) AS VARCHAR)) AS app_id,
    CASE WHEN event_id % 97 = 0 THEN NULL WHEN user_id % 8 = 0 THEN 'driver' ELSE CAST(user_id % 8 AS VARCHAR) END AS executor_id,
    CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) * 24 + hour(ts) + 1 AS BIGINT) AS poll_seq,
    CASE WHEN event_type = 'signup' THEN NULL ELSE CAST(floor(value * 20000000) AS BIGINT) END AS cpu_ns,
    CAST(floor(value * 40) AS BIGINT) AS duration_ms,
    CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) * (CASE WHEN event_type = 'error' AND user_id % 8 = 6 THEN 24 WHEN event_type = 'error' THEN 6 ELSE 1 END) AS BIGINT) AS gc_ms,
    CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
    CASE WHEN event_type = 'error' AND user_id % 16 = 5 THEN 1 ELSE 0 END AS failed,
    value
  FROM events)"""

SAMPLES = (
    TASK_ENDS
    + """,
cells AS (
  SELECT app_id, executor_id, poll_seq,
    CASE WHEN executor_id = '3' AND poll_seq >= 400 THEN 1 ELSE 0 END AS incarnation,
    count(*) AS n_tasks, max(k) AS k, max(value) AS vmax,
    sum(cpu_ns) AS cpu_ns, sum(duration_ms) AS duration_ms, sum(gc_ms) AS gc_ms, sum(failed) AS failed
  FROM task_ends WHERE executor_id IS NOT NULL
  GROUP BY app_id, executor_id, poll_seq),
cum AS (
  SELECT *, sum(cpu_ns) OVER w AS c_cpu, sum(duration_ms) OVER w AS c_dur, sum(gc_ms) OVER w AS c_gc,
    sum(failed) OVER w AS c_failed, sum(k) OVER w AS c_k, max(vmax) OVER w AS c_peak
  FROM cells
  WINDOW w AS (PARTITION BY app_id, executor_id, incarnation ORDER BY poll_seq ROWS UNBOUNDED PRECEDING)),
executor_samples AS (
SELECT app_id, poll_seq,
  CAST(1704067200000 + poll_seq * 5000 - CASE WHEN poll_seq % 50 = 0 THEN 4950 ELSE 0 END AS BIGINT) AS wall_ms,
  executor_id,
  CASE WHEN executor_id = '6' THEN '' ELSE concat('host-', executor_id, ':7077') END AS host_port,
  CASE WHEN executor_id = '6' AND app_id = 'app-1' THEN NULL ELSE concat('host-', executor_id) END AS host,
  NOT (executor_id = '2' AND poll_seq > 600) AS is_active,
  CAST(CASE WHEN executor_id = '7' THEN 0 ELSE 629145600 END AS BIGINT) AS max_memory,
  CAST(CASE WHEN executor_id = '4' OR (executor_id = 'driver' AND app_id = 'app-2') THEN 0 ELSE 4 END AS BIGINT) AS max_tasks,
  CAST(CASE WHEN executor_id = 'driver' AND app_id = 'app-2' THEN 0 ELSE 4 END AS BIGINT) AS total_cores,
  CAST(CASE WHEN k % 4 = 0 THEN 0 ELSE k % 21 END AS BIGINT) AS active_tasks,
  CAST(c_failed AS BIGINT) AS failed_tasks,
  CAST(c_dur AS BIGINT) AS total_duration_ms,
  CASE WHEN poll_seq % 11 = 0 THEN NULL ELSE CAST(c_gc AS BIGINT) END AS total_gc_ms,
  CAST(floor(coalesce(c_cpu, 0) / 1000000) AS BIGINT) AS cpu_time_ms,
  CASE WHEN executor_id = '1' AND poll_seq % 3 <> 0 THEN CAST(k AS DOUBLE) ELSE NULL END AS os_cpu_pct,
  CASE WHEN executor_id IN ('5', '6') THEN NULL ELSE CAST(floor(c_peak * 2800000) AS BIGINT) END AS peak_jvm_heap,
  CASE WHEN executor_id = '6' THEN NULL ELSE CAST(floor(vmax * 2800000) AS BIGINT) END AS cur_jvm_heap,
  CASE WHEN k % 7 = 0 THEN NULL ELSE CAST(k * 1048576 AS BIGINT) END AS peak_jvm_off_heap,
  CASE WHEN k % 5 = 0 THEN NULL ELSE CAST(n_tasks * 1048576 AS BIGINT) END AS peak_off_heap_unified,
  CASE WHEN k % 6 = 0 THEN NULL ELSE CAST(k * 524288 AS BIGINT) END AS on_heap_exec,
  CAST(k * 262144 AS BIGINT) AS on_heap_storage_peak,
  CASE WHEN k % 6 = 0 THEN NULL ELSE CAST(k * 786432 AS BIGINT) END AS on_heap_unified,
  CASE WHEN poll_seq % 4 = 0 THEN NULL ELSE CAST(floor(c_peak * 3000000) + k * 524288 AS BIGINT) END AS rss,
  CASE WHEN executor_id = '7' THEN NULL ELSE CAST(k * 131072 AS BIGINT) END AS used_on_heap_storage,
  CASE WHEN executor_id = '7' THEN NULL ELSE CAST(314572800 AS BIGINT) END AS total_on_heap_storage,
  CAST(k % 10 AS BIGINT) AS rdd_blocks,
  CASE WHEN k % 9 = 0 THEN NULL ELSE CAST(k * 65536 AS BIGINT) END AS disk_used,
  CAST(k * 131072 AS BIGINT) AS memory_used,
  CAST(c_dur * 1024 AS BIGINT) AS total_shuffle_read,
  CASE WHEN executor_id = 'driver' THEN NULL ELSE CAST(c_k * 4096 AS BIGINT) END AS total_shuffle_write
FROM cum)"""
)

PROCESS_CPU = """process_cpu AS (
  SELECT app_id, executor_id, poll_seq, sample_seq, wall_ns,
    CASE WHEN sample_seq % 13 = 0 THEN NULL ELSE CAST(sum(used_ns) OVER (
      PARTITION BY app_id, executor_id ORDER BY sample_seq ROWS UNBOUNDED PRECEDING) AS BIGINT) END AS cpu_ns,
    4 AS cores
  FROM (SELECT concat('app-', CAST(user_id % 3 + 3 * CAST(floor(user_id / 150) AS BIGINT) AS VARCHAR)) AS app_id,
      CASE WHEN user_id % 8 = 0 THEN 'driver' ELSE CAST(user_id % 8 AS VARCHAR) END AS executor_id,
      CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) * 24 + hour(ts) + 1 AS BIGINT) AS poll_seq, event_id AS sample_seq,
      CAST(floor(event_id / 8) * 2000000000 AS BIGINT) AS wall_ns, CAST(floor(value * 20000000) AS BIGINT) AS used_ns
    FROM events)),
published AS (
  SELECT * EXCLUDE (prev_wall, prev_cpu),
    CASE WHEN wall_ns > prev_wall THEN CAST(cpu_ns - prev_cpu AS DOUBLE) * 1e2 / (CAST(wall_ns - prev_wall AS DOUBLE) * cores) END AS cpu_pct
  FROM (SELECT *, lag(wall_ns) OVER w AS prev_wall,
      last_value(cpu_ns IGNORE NULLS) OVER (PARTITION BY app_id, executor_id ORDER BY sample_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_cpu
    FROM process_cpu WINDOW w AS (PARTITION BY app_id, executor_id ORDER BY sample_seq)))"""

ROWS = (
    SAMPLES
    + """,
baselines AS (
  SELECT *, lag(wall_ms) OVER w AS prev_wall, lag(cpu_time_ms) OVER w AS prev_cpu, lag(total_duration_ms) OVER w AS prev_dur,
    last_value(total_gc_ms IGNORE NULLS) OVER (PARTITION BY app_id, executor_id ORDER BY poll_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_gc,
    CASE WHEN max_tasks > 0 THEN max_tasks WHEN total_cores > 0 THEN total_cores END AS capacity,
    CASE WHEN peak_jvm_heap > 0 THEN peak_jvm_heap WHEN cur_jvm_heap > 0 THEN cur_jvm_heap END AS heap
  FROM executor_samples WHERE is_active
  WINDOW w AS (PARTITION BY app_id, executor_id ORDER BY poll_seq)),
branches AS (
  SELECT *, CASE WHEN os_cpu_pct IS NOT NULL THEN 'OS' WHEN capacity IS NULL THEN '-'
      WHEN prev_wall IS NULL OR wall_ms - prev_wall <= 100 THEN 'wait'
      WHEN cpu_time_ms - prev_cpu > 0 OR (cpu_time_ms = prev_cpu AND coalesce(active_tasks, 0) = 0) THEN 'TaskCpuTime'
      WHEN total_duration_ms >= prev_dur THEN 'totalDuration' ELSE '-' END AS cpu_source,
    CASE WHEN max_memory > 0 THEN CAST(max_memory AS DOUBLE) / 6e-1 + 314572800 ELSE 0e0 END AS heap_limit
  FROM baselines),
executor_rows AS (
  SELECT *,
    (coalesce(heap_pct >= 85, false) OR coalesce(gc_delta_ms >= 500, false) OR coalesce(gc_pct >= 10, false)
      OR coalesce(saturation_pct >= 400, false) OR coalesce(failed_tasks > 0, false)) AS is_unhealthy
  FROM (SELECT app_id, poll_seq, wall_ms, executor_id,
    CASE WHEN host_port <> '' THEN host_port WHEN host <> '' THEN host ELSE '-' END AS host,
    heap AS heap_bytes, heap / 1048576e0 AS heap_mb, heap_limit AS heap_max_bytes, heap_limit / 1048576e0 AS heap_max_mb,
    CASE WHEN heap_limit > 0 THEN heap * 1e2 / heap_limit END AS heap_pct,
    peak_jvm_off_heap / 1048576e0 AS jvm_off_heap_mb, peak_off_heap_unified / 1048576e0 AS off_heap_unified_mb,
    rss / 1048576e0 AS rss_mb, rss / 1048576e0 AS total_memory_mb,
    CASE WHEN rss IS NOT NULL THEN 'rss' END AS total_memory_source,
    CASE WHEN rss IS NOT NULL THEN greatest(rss - coalesce(heap, 0) - coalesce(peak_jvm_off_heap, 0) - coalesce(peak_off_heap_unified, 0), 0) / 1048576e0 END AS native_other_mb,
    total_gc_ms / 1e3 AS gc_seconds,
    CASE WHEN total_duration_ms > 0 THEN total_gc_ms * 1e2 / total_duration_ms END AS gc_pct,
    CASE WHEN total_gc_ms >= prev_gc THEN total_gc_ms - prev_gc END AS gc_delta_ms,
    active_tasks, capacity AS max_tasks, active_tasks * 1e2 / capacity AS saturation_pct,
    CASE cpu_source WHEN 'OS' THEN os_cpu_pct
      WHEN 'TaskCpuTime' THEN CAST(cpu_time_ms - prev_cpu AS DOUBLE) / ((wall_ms - prev_wall) * capacity) * 1e2
      WHEN 'totalDuration' THEN CAST(total_duration_ms - prev_dur AS DOUBLE) / ((wall_ms - prev_wall) * capacity) * 1e2 END AS cpu_pct,
    cpu_source, failed_tasks,
    coalesce(total_shuffle_read, 0) / 1048576e0 AS shuffle_read_mb, coalesce(total_shuffle_write, 0) / 1048576e0 AS shuffle_write_mb,
    rdd_blocks, disk_used AS disk_used_bytes, disk_used / 1048576e0 AS disk_used_mb,
    memory_used AS memory_used_bytes, memory_used / 1048576e0 AS memory_used_mb,
    used_on_heap_storage AS on_heap_storage_bytes, used_on_heap_storage / 1048576e0 AS on_heap_storage_mb,
    total_on_heap_storage / 1048576e0 AS total_on_heap_capacity_mb, on_heap_exec / 1048576e0 AS on_heap_exec_mb,
    on_heap_storage_peak / 1048576e0 AS on_heap_storage_peak_mb, on_heap_unified / 1048576e0 AS on_heap_unified_mb,
    CASE WHEN peak_jvm_heap > 0 THEN 'peakMemoryMetrics.JVMHeapMemory' WHEN cur_jvm_heap > 0 THEN 'executorMetrics.JVMHeapMemory' ELSE '-' END AS metric_source
  FROM branches))"""
)

_ESTIMATE = """CASE WHEN heap_mb IS NOT NULL OR jvm_off_heap_mb IS NOT NULL OR off_heap_unified_mb IS NOT NULL
  THEN coalesce(heap_mb, 0) + coalesce(jvm_off_heap_mb, 0) + coalesce(off_heap_unified_mb, 0) END"""

HISTORY = (
    ROWS
    + f""",
history AS (
  SELECT * REPLACE (CASE WHEN executor = '5' AND "pollSeq" % 37 = 0 THEN 'n/a' ELSE "timeIso" END AS "timeIso"),
    CASE WHEN executor = '5' AND "pollSeq" % 37 = 0 THEN NULL ELSE wall END AS "timeMs"
  FROM (SELECT app_id AS "appId", strftime(make_timestamp(wall_ms * 1000), '%H:%M:%S') AS "timeLabel",
    strftime(make_timestamp(wall_ms * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS "timeIso", executor_id AS executor, host,
    heap_mb AS "heapMB", heap_max_mb AS "heapMaxMB", heap_pct AS "heapPct", gc_seconds AS "gcTimeSeconds",
    gc_delta_ms AS "gcDeltaMs", active_tasks AS "activeTasks", max_tasks AS "maxTasks", saturation_pct AS "saturationPct",
    cpu_pct AS "cpuPct", failed_tasks AS "failedTasks", jvm_off_heap_mb AS "jvmOffHeapMB",
    off_heap_unified_mb AS "offHeapUnifiedMB", rss_mb AS "rssMB", coalesce(total_memory_mb, {_ESTIMATE}) AS "totalMemoryMB",
    total_memory_source AS "totalMemorySource", native_other_mb AS "nativeOtherMB", on_heap_exec_mb AS "onHeapExecMB",
    on_heap_storage_peak_mb AS "onHeapStoragePeakMB", on_heap_unified_mb AS "onHeapUnifiedMB",
    on_heap_storage_mb AS "onHeapStorageMB", total_on_heap_capacity_mb AS "totalOnHeapCapacityMB", rdd_blocks AS "rddBlocks",
    disk_used_mb AS "diskUsedMB", memory_used_mb AS "memoryUsedMB", shuffle_read_mb AS "shuffleReadMB",
    shuffle_write_mb AS "shuffleWriteMB", metric_source AS "metricSource", poll_seq AS "pollSeq",
    poll_seq * 16777216 + CASE WHEN executor_id = 'driver' THEN 0 ELSE CAST(executor_id AS BIGINT) + 1 END AS "ingestSeq",
    wall_ms AS wall
  FROM executor_rows))"""
)

KEPT = (
    HISTORY
    + f""",
kept AS (
  SELECT * EXCLUDE (wall) FROM history WHERE "timeMs" IS NULL OR "timeMs" >= {NOW_MS} - 3600000
  QUALIFY row_number() OVER (PARTITION BY "appId" ORDER BY "ingestSeq" DESC) <= 20000),
in_view AS (SELECT * FROM kept WHERE "timeMs" >= {NOW_MS} - 1800000)"""
)

VIEW = (
    HISTORY
    + f""",
in_view AS (SELECT * EXCLUDE (wall) FROM history WHERE "timeMs" >= {NOW_MS} - 1800000)"""
)

SELECTED = """selected AS (
  SELECT DISTINCT app_id, executor_id FROM executor_samples
  WHERE executor_id = 'driver' OR (CAST(substr(app_id, 5) AS BIGINT) % 2 = 0 AND TRY_CAST(executor_id AS BIGINT) % 2 = 1))"""


def _fixed(value: str, digits: int) -> str:
    """Decimal rounding by exact value: the product's rounding error is recovered with split factors."""
    scale = f"1e{digits}"
    high = f"(({value}) * 134217729e0 - (({value}) * 134217729e0 - ({value})))"
    product = f"(({value}) * {scale})"
    error = f"(({high} * {scale} - {product}) + (({value}) - {high}) * {scale})"
    return (
        f"((floor({product}) + CASE WHEN ({product} - floor({product}) - 5e-1) + {error} >= 0 THEN 1 ELSE 0 END) / {scale})"
    )


def _fixed_mb(byte_count: str, digits: int = 2) -> str:
    """Megabytes rounded with integer arithmetic on the bytes."""
    return f"(({byte_count}) * {10**digits} + 524288) // 1048576 / 1e{digits}"


POINTS = (
    ROWS
    + f""",
points AS (
  SELECT app_id, executor_id, poll_seq, {_fixed_mb("heap_bytes")} AS heap,
    {_fixed_mb("peak_jvm_off_heap")} AS overhead, {_fixed_mb("peak_off_heap_unified")} AS off_heap,
    CASE WHEN coalesce(heap_bytes, peak_jvm_off_heap, peak_off_heap_unified) IS NOT NULL THEN
      {_fixed_mb("coalesce(heap_bytes, 0) + coalesce(peak_jvm_off_heap, 0) + coalesce(peak_off_heap_unified, 0)")} END AS total,
    {_fixed_mb("rss")} AS rss, CAST(gc_delta_ms AS DOUBLE) AS gc_delta,
    {_fixed("saturation_pct", 2)} AS saturation, {_fixed("CASE WHEN cpu_pct > 200 THEN 2e2 ELSE cpu_pct END", 2)} AS cpu
  FROM executor_rows JOIN (SELECT app_id, executor_id, poll_seq, peak_jvm_off_heap, peak_off_heap_unified, rss
    FROM executor_samples) USING (app_id, executor_id, poll_seq))"""
)

GRID = (
    POINTS
    + """,
axis AS (
  SELECT app_id, poll_seq, row_number() OVER (PARTITION BY app_id ORDER BY poll_seq) AS poll_ord
  FROM (SELECT DISTINCT app_id, poll_seq FROM executor_samples
    QUALIFY dense_rank() OVER (PARTITION BY app_id ORDER BY poll_seq DESC) <= 120)),
grid AS (
  SELECT app_id, executor_id, poll_ord, heap, overhead, off_heap, total, rss, gc_delta, saturation, cpu
  FROM axis JOIN (SELECT DISTINCT app_id, executor_id FROM points) USING (app_id)
    LEFT JOIN points USING (app_id, executor_id, poll_seq))"""
)

LATEST_POINT = """latest AS (
  SELECT app_id, executor_id, {0} FROM grid GROUP BY app_id, executor_id)""".format(
    ", ".join(
        f"arg_max({c}, poll_ord) FILTER (WHERE {c} IS NOT NULL) AS {c}"
        for c in ["heap", "overhead", "off_heap", "total", "rss", "gc_delta", "saturation", "cpu"]
    )
)


def _bands(metrics: list[tuple[str, str, int]], mode: str, native: bool) -> str:
    """Stacked bands by ranking the long form and summing upwards."""
    tall = " UNION ALL ".join(
        f"SELECT app_id, executor_id, poll_ord, '{suffix}' AS series, {i} AS i, {name} AS value FROM grid"
        for name, suffix, i in metrics
    )
    total, label = ("rss", "T(rss)") if mode == "rss" else ("total", "T")
    native_rows = ""
    if native:
        native_rows = """
  UNION ALL
  SELECT app_id, executor_id, poll_ord, 'N', height,
    CASE WHEN gap > 0 THEN height + gap WHEN rss IS NOT NULL THEN height END
  FROM (SELECT *, max(coalesce(gap > 0, false)) OVER (PARTITION BY app_id, executor_id) AS any_gap
    FROM (SELECT *, rss - (coalesce(heap, 0) + coalesce(overhead, 0) + coalesce(off_heap, 0)) AS gap
      FROM grid JOIN (SELECT app_id, executor_id, poll_ord, max(running) AS height FROM stacked GROUP BY ALL)
        USING (app_id, executor_id, poll_ord)))
  WHERE any_gap"""
    return (
        GRID
        + f""",
tall AS ({tall}),
ranked AS (
  SELECT tall.*, latest FROM tall JOIN (
    SELECT app_id, executor_id, series, arg_max(value, poll_ord) FILTER (WHERE value IS NOT NULL) AS latest
    FROM tall GROUP BY ALL) USING (app_id, executor_id, series)),
stacked AS (
  SELECT *, coalesce(sum(value) OVER (PARTITION BY app_id, executor_id, poll_ord
    ORDER BY latest DESC NULLS LAST, i ROWS UNBOUNDED PRECEDING), 0) AS running,
    coalesce(sum(value) OVER (PARTITION BY app_id, executor_id, poll_ord
    ORDER BY latest DESC NULLS LAST, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM ranked),
bands AS (
  SELECT app_id, executor_id, poll_ord, series, base,
    CASE WHEN value IS NOT NULL THEN running END AS upper FROM stacked WHERE latest IS NOT NULL{native_rows}
  UNION ALL
  SELECT app_id, executor_id, poll_ord, '{label}', NULL, {total} FROM grid
  WHERE (app_id, executor_id) IN (SELECT (app_id, executor_id) FROM grid WHERE {total} IS NOT NULL))"""
    )


ALL_BANDS = _bands([("heap", "H", 0), ("overhead", "O", 1), ("off_heap", "F", 2)], "rss", True)
SOME_BANDS = _bands([("heap", "H", 0), ("off_heap", "F", 2)], "estimated", False)

ORACLE_SQL: dict[str, str] = {}


def _add(name: str, ctes: str, select: str) -> None:
    ORACLE_SQL[name] = f"WITH {ctes}\n{select}"


def _rows(name: str, *columns: str) -> None:
    _add(name, ROWS, f"SELECT app_id, executor_id, poll_seq, {', '.join(columns)} FROM executor_rows")


_CARDS = """count(*) AS executors, CAST(count_if(is_unhealthy) AS BIGINT) AS unhealthy, round(avg(heap_pct), 4) AS avg_heap_pct,
  max(heap_pct) AS max_heap_pct, CAST(coalesce(sum(active_tasks), 0) AS BIGINT) AS active_tasks,
  CAST(coalesce(sum(failed_tasks), 0) AS BIGINT) AS failed_tasks, round(avg(gc_delta_ms), 4) AS avg_gc_delta_ms,
  coalesce(sum(shuffle_read_mb), 0) AS shuffle_read_mb, coalesce(sum(shuffle_write_mb), 0) AS shuffle_write_mb,
  coalesce(sum(disk_used_mb), 0) AS disk_used_mb, coalesce(sum(memory_used_mb), 0) AS memory_used_mb,
  coalesce(sum(jvm_off_heap_mb), 0) AS jvm_off_heap_mb, coalesce(sum(off_heap_unified_mb), 0) AS off_heap_unified_mb,
  coalesce(sum(total_memory_mb), 0) AS total_memory_mb, max(on_heap_unified_mb) AS max_on_heap_unified_mb"""

_LATEST = "(app_id, poll_seq) IN (SELECT (app_id, max(poll_seq)) FROM executor_samples GROUP BY app_id)"

_add("live_summary", ROWS, f"SELECT app_id, {_CARDS} FROM executor_rows WHERE {_LATEST} GROUP BY app_id")

# Sources and sinks.
_add("s01_snapshot_payloads", SAMPLES, "SELECT * FROM executor_samples")
_add(
    "s02_task_end_log",
    TASK_ENDS,
    "SELECT app_id, executor_id, task_id, cpu_ns FROM task_ends WHERE task_id % 10 <> 3",
)
ORACLE_SQL["s03_process_samples"] = """
SELECT concat('app-', user_id % 3 + 3 * (user_id // 150)) AS app_id,
  CASE WHEN user_id % 8 = 0 THEN 'driver' ELSE CAST(user_id % 8 AS VARCHAR) END AS executor_id,
  event_id AS sample_seq, value AS cpu_pct FROM events WHERE event_id % 17 <> 0 AND event_id % 19 <> 0"""

_JSON_FIELDS = [
    ("appId", "app_id", True),
    ("pollSeq", "poll_seq", False),
    ("wallMs", "wall_ms", False),
    ("id", "executor_id", True),
    ("hostPort", "host_port", True),
    ("host", "host", True),
    ("isActive", "is_active", False),
    ("maxMemory", "max_memory", False),
    ("maxTasks", "max_tasks", False),
    ("totalCores", "total_cores", False),
    ("activeTasks", "active_tasks", False),
    ("failedTasks", "failed_tasks", False),
    ("totalDuration", "total_duration_ms", False),
    ("totalGCTime", "total_gc_ms", False),
    ("totalShuffleRead", "total_shuffle_read", False),
    ("totalShuffleWrite", "total_shuffle_write", False),
    ("rddBlocks", "rdd_blocks", False),
    ("diskUsed", "disk_used", False),
    ("memoryUsed", "memory_used", False),
]
_JSON_BAGS = {
    "peakMemoryMetrics": {
        "JVMHeapMemory": "peak_jvm_heap",
        "JVMOffHeapMemory": "peak_jvm_off_heap",
        "OffHeapUnifiedMemory": "peak_off_heap_unified",
        "OnHeapExecutionMemory": "on_heap_exec",
        "OnHeapStorageMemory": "on_heap_storage_peak",
        "OnHeapUnifiedMemory": "on_heap_unified",
        "ProcessTreeJVMRSSMemory": "rss",
    },
    "executorMetrics": {"JVMHeapMemory": "cur_jvm_heap"},
    "memoryMetrics": {
        "usedOnHeapStorageMemory": "used_on_heap_storage",
        "totalOnHeapStorageMemory": "total_on_heap_storage",
    },
}


def _json_member(name: str, column: str, quoted: bool) -> str:
    value = f"'\"' || {column} || '\"'" if quoted else f"CAST({column} AS VARCHAR)"
    return f"'\"{name}\":' || {value}"


def _json_object(members: list[str]) -> str:
    return "'{' || concat_ws(',', " + ", ".join(members) + ") || '}'"


_members = [_json_member(*field) for field in _JSON_FIELDS]
for _bag, _fields in _JSON_BAGS.items():
    _object = _json_object([_json_member(n, c, False) for n, c in _fields.items()])
    _members.append(
        f"CASE WHEN coalesce({', '.join(_fields.values())}) IS NOT NULL THEN '\"{_bag}\":' || {_object} END"
    )
_members += [_json_member("cpuTimeMs", "coalesce(cpu_time_ms, 0)", False), _json_member("osCpuLoadPct", "os_cpu_pct", False)]
_add(
    "s04_enriched_json",
    SAMPLES,
    f"SELECT app_id, poll_seq, executor_id, {_json_object(_members)} AS value FROM executor_samples",
)
_add("s05_history_records", HISTORY, "SELECT * EXCLUDE (wall) FROM history")
_add("s06_history_restore", KEPT, "SELECT * FROM kept")
_add(
    "s07_persisted_tail",
    HISTORY,
    """SELECT "appId", executor, "pollSeq", "heapMB" FROM history
QUALIFY row_number() OVER (PARTITION BY "appId" ORDER BY "ingestSeq" DESC) <= 500""",
)
_GONE = """CAST(substr("appId", 5) AS BIGINT) % 3 = 1"""
_add("s08_history_reset", HISTORY, f"""SELECT "appId", executor, "pollSeq", "heapMB" FROM history WHERE {_GONE}""")
_add("s09_purge_stale_apps", HISTORY, f"""SELECT "appId", executor, "pollSeq", "heapMB" FROM history WHERE NOT {_GONE}""")

_DOUBLES = set(
    "heapMB heapMaxMB heapPct gcTimeSeconds saturationPct cpuPct jvmOffHeapMB offHeapUnifiedMB rssMB totalMemoryMB "
    "nativeOtherMB onHeapExecMB onHeapStoragePeakMB onHeapUnifiedMB onHeapStorageMB totalOnHeapCapacityMB diskUsedMB "
    "memoryUsedMB shuffleReadMB shuffleWriteMB".split()
)


def _csv(column: str) -> str:
    body = f'CAST("{column}" AS VARCHAR)'
    if column in _DOUBLES:
        body = f"regexp_replace({body}, '\\.0$', '')"
    quoted = f"'\"' || replace({body}, '\"', '\"\"') || '\"'"
    return f"coalesce(CASE WHEN regexp_matches({body}, '[\"\\n;,]') THEN {quoted} ELSE {body} END, '')"


_add(
    "s10_csv_lines",
    HISTORY,
    'SELECT "appId", "ingestSeq", executor, ' + " || ';' || ".join(_csv(c) for c in HISTORY_CSV_COLUMNS) + " AS line FROM history",
)
_add(
    "s11_model_parameters",
    SAMPLES,
    """SELECT app_id, executor_id, poll_seq, CASE WHEN max_memory <= 0 THEN 0e0
  WHEN CAST(substr(app_id, 5) AS BIGINT) % 3 = 0 THEN max_memory / 6e-1 + 314572800
  WHEN CAST(substr(app_id, 5) AS BIGINT) % 3 = 1 THEN max_memory / 75e-2 + 314572800
  ELSE CAST(max_memory AS DOUBLE) END AS heap_max_bytes FROM executor_samples""",
)

# Projections.
ORACLE_SQL["p01_to_number"] = """
SELECT event_id, CASE event_id % 8 WHEN 3 THEN 0e0 WHEN 4 THEN CAST(event_id AS DOUBLE) WHEN 5 THEN event_id * 1e2
  WHEN 6 THEN -(event_id + 5e-1) END AS number,
  CASE WHEN event_id % 3 <> 0 THEN value END AS finite, CAST(NULL AS DOUBLE) AS undefined FROM events"""
_add(
    "p02_to_mb",
    SAMPLES,
    """SELECT app_id, executor_id, poll_seq, rss / 1048576e0 AS rss_mb, total_shuffle_read / 1048576e0 AS read_mb
FROM executor_samples""",
)
_add("p03_executor_rows", ROWS, "SELECT * FROM executor_rows")
_add(
    "p04_host_label",
    SAMPLES,
    """SELECT app_id, executor_id, poll_seq, CASE WHEN executor_id <> '6' THEN host_port WHEN app_id = 'app-1' THEN '-'
  ELSE 'host-6' END AS host FROM executor_samples""",
)
_add(
    "p05_heap_reading",
    SAMPLES,
    """SELECT app_id, executor_id, poll_seq, CASE WHEN peak_jvm_heap > 0 THEN peak_jvm_heap WHEN cur_jvm_heap > 0 THEN cur_jvm_heap END AS heap_bytes,
  CASE WHEN peak_jvm_heap > 0 THEN 'peakMemoryMetrics.JVMHeapMemory' WHEN cur_jvm_heap > 0 THEN 'executorMetrics.JVMHeapMemory' ELSE '-' END AS source
FROM executor_samples""",
)
_add(
    "p06_heap_reading_compat",
    SAMPLES,
    """SELECT app_id, executor_id, poll_seq, coalesce(cur_jvm_heap, peak_jvm_heap, used_on_heap_storage) AS heap_bytes,
  CASE WHEN cur_jvm_heap IS NOT NULL THEN 'executorMetrics.JVMHeapMemory'
    WHEN peak_jvm_heap IS NOT NULL THEN 'peakMemoryMetrics.JVMHeapMemory (peak — monotono)'
    WHEN used_on_heap_storage IS NOT NULL THEN 'memoryMetrics.usedOnHeapStorageMemory' ELSE '-' END AS source,
  peak_jvm_heap AS peak_bytes FROM executor_samples""",
)
_add(
    "p07_heap_limit",
    SAMPLES,
    """SELECT app_id, executor_id, poll_seq, CASE WHEN max_memory > 0 THEN max_memory / 6e-1 + 314572800 ELSE 0e0 END AS scaled,
  CAST(greatest(max_memory, 0) AS DOUBLE) AS unscaled FROM executor_samples""",
)
_rows("p08_heap_pct", "heap_pct")
_rows("p09_task_capacity", "max_tasks")
_rows("p10_saturation_pct", "saturation_pct")
_rows("p11_gc_seconds", "gc_seconds")
_rows("p12_gc_pct", "gc_pct")
_rows("p13_estimated_total", f"{_ESTIMATE} AS estimated_mb")
_rows(
    "p14_total_by_mode",
    "rss_mb AS rss_total",
    "CASE WHEN rss_mb IS NOT NULL THEN 'rss' END AS rss_source",
    f"{_ESTIMATE} AS estimated_total",
    "'estimated' AS estimated_source",
)
_rows("p15_recorded_total", f"coalesce(rss_mb, {_ESTIMATE}) AS recorded_mb", "total_memory_source")
_rows("p16_native_other", "native_other_mb")


def _share(column: str) -> str:
    return f"CASE WHEN total_memory_mb > 0 THEN {column} * 1e2 / total_memory_mb END"


_SHARES = {
    "jvm_off_heap_pct": _share("jvm_off_heap_mb"),
    "off_heap_unified_pct": _share("off_heap_unified_mb"),
    "native_other_pct": _share("native_other_mb"),
}
_rows("p17_share_of_total", *[f"{sql} AS {name}" for name, sql in _SHARES.items()])
_rows(
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
_rows("p19_chart_cpu_clip", "CASE WHEN cpu_pct > 20 THEN 2e1 ELSE cpu_pct END AS clipped", "cpu_pct")
_add("p20_series_rounding", POINTS, "SELECT * FROM points")


def _one_decimal(scaled: str) -> str:
    """Text with one decimal of a whole number of tenths."""
    return f"CAST(({scaled}) // 10 AS VARCHAR) || '.' || CAST(({scaled}) % 10 AS VARCHAR)"


_rows(
    "p21_display_text",
    "CAST(rdd_blocks AS VARCHAR) AS rdd_text",
    f"coalesce({_one_decimal('(heap_bytes * 10 + 524288) // 1048576')}, '-') AS heap_text",
    f"coalesce({_one_decimal('(disk_used_bytes * 10 + 524288) // 1048576')}, '-') AS disk_text",
    f"coalesce({_one_decimal('(active_tasks * 2000 + max_tasks) // (max_tasks * 2)')} || '%', '-') AS saturation_text",
    f"coalesce(printf('%.1f', {_fixed('gc_seconds', 1)}), '-') AS gc_text",
    "CASE WHEN gc_delta_ms IS NULL THEN 'wait…' WHEN gc_delta_ms < 1000 THEN CAST(gc_delta_ms AS VARCHAR) || ' ms' "
    f"ELSE printf('%.2f', {_fixed('gc_delta_ms / 1e3', 2)}) || ' s' END AS gc_delta_text",
    f"coalesce(printf('%.1f', {_fixed('cpu_pct', 1)}) || '%', '-') || "
    "CASE cpu_source WHEN 'OS' THEN ' (OS)' WHEN 'totalDuration' THEN ' (est.)' ELSE '' END AS cpu_text",
    f"coalesce(printf('%.1f', {_fixed('total_memory_mb', 1)}), '-') || "
    "CASE WHEN total_memory_source = 'rss' THEN ' (rss)' ELSE '' END AS total_text",
)
ORACLE_SQL["p22_natural_key"] = """
SELECT event_id, concat('exec-', lpad(CAST(length(a) AS VARCHAR), 4, '0'), a, '_node', lpad(CAST(length(b) AS VARCHAR), 4, '0'), b) AS sort_key
FROM (SELECT event_id, CAST(user_id % 137 AS VARCHAR) AS a, CAST(event_id AS VARCHAR) AS b FROM events)"""
_add(
    "p23_metric_unpivot",
    POINTS,
    """SELECT app_id, executor_id, poll_seq, 'overhead' AS metric, overhead AS value FROM points
UNION ALL SELECT app_id, executor_id, poll_seq, 'total', total FROM points
UNION ALL SELECT app_id, executor_id, poll_seq, 'heap', heap FROM points""",
)


def _mb_label(value: str) -> str:
    return f"coalesce(printf('%.1f', {_fixed(value, 1)}), '-')"


_HOF = f"'H ' || {_mb_label('heap')} || ' | O ' || {_mb_label('overhead')} || ' | F ' || {_mb_label('off_heap')}"
_GAP = "(rss - (coalesce(heap, 0) + coalesce(overhead, 0) + coalesce(off_heap, 0)))"
_add(
    "p24_legend",
    GRID + ",\n" + LATEST_POINT,
    f"""SELECT app_id, executor_id, {_HOF} || CASE WHEN {_GAP} > 0 THEN ' | N ' || {_mb_label(_GAP)} ELSE '' END
  || ' | T(rss) ' || {_mb_label('rss')} AS label, 'rss' AS mode FROM latest
UNION ALL SELECT app_id, executor_id, {_HOF} || ' | T ' || {_mb_label('total')}, 'estimated' FROM latest""",
)

# Filters and classes.
_add("f01_live_only", SAMPLES, "SELECT app_id, executor_id, poll_seq FROM executor_samples WHERE is_active")
_rows("f02_unhealthy_flag", "is_unhealthy")
_add("f03_only_unhealthy", ROWS, "SELECT app_id, executor_id, poll_seq FROM executor_rows WHERE is_unhealthy")
_add(
    "f04_view_range",
    HISTORY,
    f"""SELECT "appId", executor, "pollSeq" FROM history
WHERE TRY_CAST("timeIso" AS TIMESTAMPTZ) >= to_timestamp(({NOW_MS} - 1800000) / 1000)""",
)
_add(
    "f05_selected_rows",
    ROWS + ",\n" + SELECTED,
    "SELECT app_id, executor_id, poll_seq, heap_mb FROM executor_rows JOIN selected USING (app_id, executor_id)",
)
_rows(
    "f06_cell_severity",
    "CASE WHEN heap_pct >= 85 THEN 'danger' ELSE 'normal' END AS heap_severity",
    "CASE WHEN gc_delta_ms >= 2000 THEN 'danger' WHEN gc_delta_ms >= 500 THEN 'warn' ELSE 'normal' END AS gc_severity",
    "CASE WHEN saturation_pct >= 400 THEN 'danger' WHEN saturation_pct >= 300 THEN 'warn' ELSE 'normal' END AS saturation_severity",
    "CASE WHEN cpu_pct >= 50 THEN 'danger' WHEN cpu_pct >= 20 THEN 'warn' ELSE 'normal' END AS cpu_severity",
    "CASE WHEN failed_tasks > 0 THEN 'danger' ELSE 'normal' END AS failed_severity",
)
_add(
    "f07_card_severity",
    ROWS,
    """SELECT app_id, poll_seq, CASE WHEN count_if(is_unhealthy) > 0 THEN 'warn' ELSE 'normal' END AS unhealthy_severity,
  CASE WHEN avg(heap_pct) >= 85 THEN 'warn' ELSE 'normal' END AS avg_heap_severity,
  CASE WHEN max(heap_pct) >= 90 THEN 'danger' WHEN max(heap_pct) >= 85 THEN 'warn' ELSE 'normal' END AS max_heap_severity,
  CASE WHEN sum(failed_tasks) > 0 THEN 'danger' ELSE 'normal' END AS failed_severity,
  CASE WHEN avg(gc_delta_ms) >= 2000 THEN 'danger' WHEN avg(gc_delta_ms) >= 500 THEN 'warn' ELSE 'normal' END AS gc_severity
FROM executor_rows GROUP BY app_id, poll_seq""",
)
_add(
    "f08_counted_task_ends",
    TASK_ENDS,
    "SELECT task_id, app_id, executor_id, cpu_ns FROM task_ends WHERE executor_id IS NOT NULL AND cpu_ns > 0",
)

# Joins.
_add(
    "j01_cpu_time_as_of_poll",
    SAMPLES
    + """,
per_poll AS (SELECT app_id, executor_id, poll_seq, sum(cpu_ns) AS ns FROM task_ends
  WHERE executor_id IS NOT NULL AND cpu_ns > 0 GROUP BY ALL)""",
    """SELECT p.app_id, p.executor_id, p.poll_seq, CAST(coalesce(sum(e.ns), 0) // 1000000 AS BIGINT) AS cpu_time_ms
FROM executor_samples p LEFT JOIN per_poll e ON e.app_id = p.app_id AND e.executor_id = p.executor_id AND e.poll_seq <= p.poll_seq
GROUP BY p.app_id, p.executor_id, p.poll_seq""",
)
_TOTALS = """SELECT app_id, executor_id, CAST(sum(cpu_ns) // 1000000 AS BIGINT) AS cpu_time_ms FROM task_ends
  WHERE executor_id IS NOT NULL AND cpu_ns > 0 GROUP BY app_id, executor_id"""
_add(
    "j01_cpu_time_total",
    SAMPLES,
    f"""SELECT s.app_id, s.executor_id, s.poll_seq, coalesce(t.cpu_time_ms, 0) AS cpu_time_ms
FROM executor_samples s LEFT JOIN ({_TOTALS}) t USING (app_id, executor_id)
WHERE (s.app_id, s.poll_seq) IN (SELECT (app_id, max(poll_seq)) FROM executor_samples GROUP BY app_id)""",
)
_add(
    "j02_process_cpu_as_of_poll",
    SAMPLES + ",\n" + PROCESS_CPU,
    """SELECT p.app_id, p.executor_id, p.poll_seq, arg_max(e.cpu_pct, e.sample_seq) AS os_cpu_pct
FROM executor_samples p LEFT JOIN published e ON e.app_id = p.app_id AND e.executor_id = p.executor_id
  AND e.poll_seq <= p.poll_seq AND e.cpu_pct IS NOT NULL
GROUP BY p.app_id, p.executor_id, p.poll_seq""",
)
_add(
    "l01_enriched_rows",
    SAMPLES.replace("executor_samples AS (", "bare_samples AS (")
    + ",\n"
    + PROCESS_CPU
    + """,
per_poll AS (SELECT app_id, executor_id, poll_seq, sum(cpu_ns) AS ns FROM task_ends
  WHERE executor_id IS NOT NULL AND cpu_ns > 0 GROUP BY ALL),
task_cpu AS (SELECT p.app_id, p.executor_id, p.poll_seq, CAST(coalesce(sum(e.ns), 0) // 1000000 AS BIGINT) AS ms
  FROM bare_samples p LEFT JOIN per_poll e ON e.app_id = p.app_id AND e.executor_id = p.executor_id AND e.poll_seq <= p.poll_seq
  GROUP BY ALL),
os_cpu AS (SELECT p.app_id, p.executor_id, p.poll_seq, arg_max(e.cpu_pct, e.sample_seq) AS pct
  FROM bare_samples p LEFT JOIN published e ON e.app_id = p.app_id AND e.executor_id = p.executor_id
    AND e.poll_seq <= p.poll_seq AND e.cpu_pct IS NOT NULL GROUP BY ALL),
executor_samples AS (SELECT b.* REPLACE (t.ms AS cpu_time_ms, o.pct AS os_cpu_pct)
  FROM bare_samples b JOIN task_cpu t USING (app_id, executor_id, poll_seq) JOIN os_cpu o USING (app_id, executor_id, poll_seq))"""
    + ROWS[len(SAMPLES) :],
    "SELECT app_id, executor_id, poll_seq, cpu_source, round(cpu_pct, 6) AS cpu_pct, is_unhealthy FROM executor_rows",
)
_add(
    "j03_selected_semi_join",
    SAMPLES + ",\n" + SELECTED,
    """SELECT app_id, executor_id, poll_seq FROM executor_samples
WHERE (app_id, executor_id) IN (SELECT (app_id, executor_id) FROM selected)""",
)
_add(
    "j04_gap_filled_grid",
    POINTS
    + """,
axis AS (SELECT app_id, poll_seq, row_number() OVER (PARTITION BY app_id ORDER BY poll_seq) AS poll_ord
  FROM (SELECT DISTINCT app_id, poll_seq FROM executor_samples))""",
    """SELECT app_id, executor_id, poll_ord, heap, overhead, off_heap, total, rss, gc_delta, saturation, cpu
FROM axis JOIN (SELECT DISTINCT app_id, executor_id FROM points) USING (app_id)
  LEFT JOIN points USING (app_id, executor_id, poll_seq)""",
)
_add(
    "j05_history_grid",
    VIEW
    + """,
axis AS (SELECT "appId", "timeIso", arg_min("timeLabel", "ingestSeq") AS "timeLabel",
  CAST(row_number() OVER (PARTITION BY "appId" ORDER BY "timeIso") AS INTEGER) AS position FROM in_view GROUP BY "appId", "timeIso")""",
    f"""SELECT "appId", executor, position, "timeIso", "timeLabel", v."heapMB" AS heap, v."jvmOffHeapMB" AS overhead,
  v."offHeapUnifiedMB" AS off_heap, v."totalMemoryMB" AS total, v."rssMB" AS rss,
  CAST(v."gcDeltaMs" AS DOUBLE) AS gc_delta, v."saturationPct" AS saturation, v."cpuPct" AS cpu
FROM axis JOIN (SELECT DISTINCT "appId", executor FROM in_view) USING ("appId")
  LEFT JOIN (SELECT * EXCLUDE ("timeLabel") FROM in_view) v USING ("appId", executor, "timeIso")""",
)
_add(
    "j06_live_app_semi_join",
    HISTORY,
    f"""SELECT "appId", count(*) AS rows_kept FROM history WHERE NOT {_GONE} GROUP BY "appId" """,
)
_add(
    "j07_nearest_points",
    ALL_BANDS,
    """SELECT app_id, executor_id, series, x, poll_ord,
  CASE WHEN length(executor_id) > 8 THEN right(executor_id, 8) ELSE executor_id END || ' (' || series || ')' AS label,
  upper - coalesce(base, 0) AS value
FROM bands JOIN (SELECT app_id, x, CAST(greatest(0, least(n - 1, floor(x * (n - 1) + 5e-1))) AS BIGINT) + 1 AS poll_ord
  FROM (SELECT app_id, count(*) AS n FROM axis GROUP BY app_id), (SELECT unnest([0e0, 13e-2, 5e-1, 77e-2, 1e0]) AS x))
  USING (app_id, poll_ord) WHERE upper IS NOT NULL""",
)

# Aggregations.
_add("d01_cpu_totals", TASK_ENDS, _TOTALS)
_add(
    "d02_latest_process_cpu",
    PROCESS_CPU,
    """SELECT app_id, executor_id, cpu_pct FROM published WHERE cpu_pct IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY app_id, executor_id ORDER BY sample_seq DESC) = 1""",
)
_add("d03_summary_cards", ROWS, f"SELECT app_id, poll_seq, {_CARDS} FROM executor_rows GROUP BY app_id, poll_seq")
_add(
    "d04_status_line",
    ROWS,
    """SELECT * EXCLUDE (live), CASE WHEN shown = 0 THEN 'empty' WHEN with_heap = 0 THEN 'no_heap' ELSE 'ok' END AS state,
  CASE WHEN shown = 0 THEN 'danger' WHEN with_heap = 0 OR unhealthy > 0 THEN 'warn' ELSE 'normal' END AS level,
  CASE WHEN live = 0 THEN 'No active executors found.' WHEN shown = 0 THEN 'No unhealthy executors with current filters.'
    WHEN with_heap = 0 THEN 'Executors found but heap metric is not available from the REST API (check executorMetrics).'
    ELSE printf('Shown executors: %d | unhealthy: %d | heap available for %d | active tasks: %d | failed tasks: %d.',
      shown, unhealthy, with_heap, active_tasks, failed_tasks) END AS message
FROM (SELECT app_id, poll_seq, count(r.wall_ms) AS live, count(*) FILTER (WHERE is_unhealthy) AS shown, count(*) FILTER (WHERE is_unhealthy) AS unhealthy,
    count(heap_bytes) AS with_heap, CAST(coalesce(sum(active_tasks) FILTER (WHERE is_unhealthy), 0) AS BIGINT) AS active_tasks,
    CAST(coalesce(sum(failed_tasks) FILTER (WHERE is_unhealthy), 0) AS BIGINT) AS failed_tasks
  FROM (SELECT DISTINCT app_id, poll_seq FROM executor_samples) LEFT JOIN executor_rows r USING (app_id, poll_seq)
  GROUP BY app_id, poll_seq)""",
)
_OFFENDERS = ["heap_pct", "total_memory_mb", "gc_delta_ms", "saturation_pct", "jvm_off_heap_mb", "on_heap_unified_mb", "shuffle_read_mb"]
_add(
    "d05_top_offenders",
    ROWS,
    "SELECT app_id, poll_seq, executor_id, host, metric, value, CAST(rank AS INTEGER) AS rank FROM ("
    + "\nUNION ALL ".join(
        f"SELECT app_id, poll_seq, executor_id, host, '{m}' AS metric, CAST({m} AS DOUBLE) AS value, "
        f"row_number() OVER (PARTITION BY app_id, poll_seq ORDER BY {m} DESC, executor_id) AS rank "
        f"FROM executor_rows WHERE {m} IS NOT NULL"
        for m in _OFFENDERS
    )
    + ") WHERE rank <= 3",
)
_add(
    "d06_rss_availability",
    ROWS,
    """SELECT app_id, count(rss_mb) > 0 AS rss_available, count(rss_mb) = 0 AS rss_warning FROM executor_rows GROUP BY app_id""",
)
_add(
    "d06_rss_availability_by_poll",
    ROWS,
    """SELECT p.app_id, p.poll_seq, coalesce(p.poll_seq >= f.first_seen, false) AS rss_available
FROM (SELECT DISTINCT app_id, poll_seq FROM executor_samples) p
  LEFT JOIN (SELECT app_id, min(poll_seq) AS first_seen FROM executor_rows WHERE rss_mb IS NOT NULL GROUP BY app_id) f USING (app_id)""",
)
_add(
    "d07_peak_source_flag",
    ROWS,
    """SELECT app_id, poll_seq, count_if(metric_source LIKE '%peakMemoryMetrics%') > 0 AS uses_peak_source
FROM executor_rows GROUP BY app_id, poll_seq""",
)
_add(
    "d08_last_samples",
    VIEW,
    f"""SELECT *, (coalesce(heap_pct >= 85, false) OR coalesce(gc_delta_ms >= 500, false)
    OR coalesce(saturation_pct >= 400, false) OR coalesce(failed_tasks > 0, false)) AS is_unhealthy
FROM (SELECT "appId" AS app_id, executor AS executor_id, "pollSeq" AS poll_seq, "timeMs" AS wall_ms, host,
    "heapMB" * 1048576 AS heap_bytes, "heapMB" AS heap_mb, coalesce("heapMaxMB" * 1048576, 0) AS heap_max_bytes,
    "heapMaxMB" AS heap_max_mb, CASE WHEN "heapMaxMB" > 0 THEN "heapMB" * 1e2 / "heapMaxMB" END AS heap_pct,
    "jvmOffHeapMB" AS jvm_off_heap_mb, "offHeapUnifiedMB" AS off_heap_unified_mb, "rssMB" AS rss_mb,
    CASE WHEN coalesce("heapMB", "jvmOffHeapMB", "offHeapUnifiedMB") IS NOT NULL THEN
      coalesce("heapMB", 0) + coalesce("jvmOffHeapMB", 0) + coalesce("offHeapUnifiedMB", 0) END AS total_memory_mb,
    'estimated' AS total_memory_source, CAST(NULL AS DOUBLE) AS native_other_mb, "gcTimeSeconds" AS gc_seconds,
    CAST(NULL AS DOUBLE) AS gc_pct, "gcDeltaMs" AS gc_delta_ms, "activeTasks" AS active_tasks, "maxTasks" AS max_tasks,
    "saturationPct" AS saturation_pct, "cpuPct" AS cpu_pct, "failedTasks" AS failed_tasks,
    "shuffleReadMB" AS shuffle_read_mb, "shuffleWriteMB" AS shuffle_write_mb, "rddBlocks" AS rdd_blocks,
    "diskUsedMB" AS disk_used_mb, "memoryUsedMB" AS memory_used_mb, "onHeapStorageMB" AS on_heap_storage_mb,
    "totalOnHeapCapacityMB" AS total_on_heap_capacity_mb, "onHeapExecMB" AS on_heap_exec_mb,
    "onHeapStoragePeakMB" AS on_heap_storage_peak_mb, "onHeapUnifiedMB" AS on_heap_unified_mb, "metricSource" AS metric_source
  FROM in_view QUALIFY row_number() OVER (PARTITION BY "appId", executor ORDER BY "timeIso" DESC, "ingestSeq") = 1)""",
)
_add(
    "d09_range_info",
    VIEW,
    """SELECT "appId", coalesce(samples, 0) AS samples, coalesce(executors, 0) AS executors, total_rows
FROM (SELECT "appId", count(*) AS total_rows FROM history GROUP BY "appId")
  LEFT JOIN (SELECT "appId", count(DISTINCT "timeIso") AS samples, count(DISTINCT executor) AS executors FROM in_view GROUP BY "appId")
  USING ("appId")""",
)
_add(
    "d10_selection_state",
    ROWS + ",\n" + SELECTED,
    f"""SELECT *, CASE WHEN selected_visible = 0 THEN 'none' WHEN selected_visible = visible_count THEN 'all' ELSE 'some' END AS state
FROM (SELECT app_id, count(s.executor_id) AS selected_count, count(v.executor_id) AS visible_count,
    CAST(count_if(s.executor_id IS NOT NULL AND v.executor_id IS NOT NULL) AS BIGINT) AS selected_visible
  FROM selected s FULL JOIN (SELECT app_id, executor_id FROM executor_rows WHERE {_LATEST}) v USING (app_id, executor_id)
  GROUP BY app_id)""",
)
_add(
    "d11_record_count",
    SAMPLES,
    "SELECT app_id, poll_seq, count(*) FILTER (WHERE is_active) AS records FROM executor_samples GROUP BY app_id, poll_seq",
)
_add(
    "d12_axis_scale",
    ALL_BANDS,
    """SELECT app_id, chart, max_value, CASE WHEN top > 0 THEN power * list_filter([1e0, 12e-1, 15e-1, 2e0, 25e-1, 3e0, 4e0, 5e0, 6e0, 8e0, 1e1],
    lambda s: top / power <= s)[1] ELSE 1e0 END AS axis_max
FROM (SELECT *, CASE WHEN top > 0 THEN pow(1e1, floor(ln(top) / ln(1e1))) END AS power
  FROM (SELECT app_id, chart, max(value) AS max_value, max(value) * 11e-1 AS top
    FROM (SELECT app_id, 'gc' AS chart, gc_delta AS value FROM grid UNION ALL SELECT app_id, 'saturation', saturation FROM grid
      UNION ALL SELECT app_id, 'cpu', cpu FROM grid UNION ALL SELECT app_id, 'memory', upper FROM bands)
    WHERE value IS NOT NULL GROUP BY app_id, chart))""",
)

# Windows.
_rows("x01_gc_delta", "gc_delta_ms")
_add(
    "x02_previous_poll_state",
    ROWS,
    """SELECT app_id, executor_id, poll_seq, prev_wall AS prev_wall_ms, prev_cpu AS prev_cpu_time_ms, prev_dur AS prev_total_duration_ms
FROM baselines""",
)
_rows("x03_cpu_cascade", "cpu_pct", "cpu_source")
_add(
    "x04_process_cpu_pct",
    PROCESS_CPU,
    "SELECT app_id, executor_id, poll_seq, sample_seq, wall_ns, cpu_ns, cores, cpu_pct FROM published",
)
_CHANGES = [
    "heap_mb", "heap_max_mb", "heap_pct", "jvm_off_heap_mb", "jvm_off_heap_pct", "off_heap_unified_mb",
    "off_heap_unified_pct", "total_memory_mb", "native_other_mb", "native_other_pct", "gc_seconds", "gc_delta_ms",
    "active_tasks", "max_tasks", "saturation_pct", "cpu_pct", "failed_tasks", "shuffle_read_mb", "shuffle_write_mb",
    "rdd_blocks", "disk_used_mb", "memory_used_mb", "on_heap_storage_mb", "total_on_heap_capacity_mb",
    "on_heap_exec_mb", "on_heap_storage_peak_mb", "on_heap_unified_mb",
]
_add(
    "x05_change_direction",
    ROWS
    + f""",
shares AS (SELECT *, {', '.join(f'{sql} AS {name}' for name, sql in _SHARES.items())} FROM executor_rows),
poll_axis AS (SELECT app_id, poll_seq, lag(poll_seq) OVER (PARTITION BY app_id ORDER BY poll_seq) AS before_seq
  FROM (SELECT DISTINCT app_id, poll_seq FROM executor_samples))""",
    "SELECT c.app_id, c.poll_seq, c.wall_ms, c.executor_id, "
    + ", ".join(f"CASE WHEN c.{m} > p.{m} THEN 'up' WHEN c.{m} < p.{m} THEN 'down' END AS {m}" for m in _CHANGES)
    + """ FROM shares c JOIN poll_axis a USING (app_id, poll_seq)
  LEFT JOIN shares p ON p.app_id = c.app_id AND p.executor_id = c.executor_id AND p.poll_seq = a.before_seq""",
)
_add(
    "x06_latest_non_null",
    POINTS,
    "SELECT app_id, executor_id, "
    + ", ".join(
        f"arg_max({c}, poll_seq) FILTER (WHERE {c} IS NOT NULL) AS {c}"
        for c in ["heap", "overhead", "off_heap", "total", "rss", "gc_delta", "saturation", "cpu"]
    )
    + " FROM points GROUP BY app_id, executor_id",
)
_add(
    "x07_live_window",
    SAMPLES,
    """SELECT app_id, executor_id, poll_seq FROM executor_samples
QUALIFY dense_rank() OVER (PARTITION BY app_id ORDER BY poll_seq DESC) <= 120""",
)
_add("x08_stacked_bands", ALL_BANDS, "SELECT * FROM bands")
_add("x08_stacked_bands_estimated", SOME_BANDS, "SELECT * FROM bands")
_add(
    "x09_poll_ordinal",
    SAMPLES,
    """SELECT DISTINCT app_id, poll_seq, dense_rank() OVER (PARTITION BY app_id ORDER BY poll_seq) AS poll_ord
FROM executor_samples""",
)

# Order, retention and sets.
_SORTS = {"heap_pct desc": "heap_pct DESC", "heap_pct asc": "heap_pct", "gc_delta_ms asc": "gc_delta_ms", "rss_mb desc": "rss_mb DESC", "host asc": "host"}
_add(
    "o01_table_sort",
    ROWS,
    "\nUNION ALL ".join(
        f"""SELECT app_id, executor_id, poll_seq, '{name}' AS sorted_by,
  CAST(row_number() OVER (PARTITION BY app_id ORDER BY {order} NULLS LAST, executor_id) AS INTEGER) AS position
FROM executor_rows WHERE {_LATEST}"""
        for name, order in _SORTS.items()
    ),
)
_add(
    "o02_visible_series",
    GRID,
    "\nUNION ALL ".join(
        f"""SELECT app_id, executor_id, '{c}' AS metric, count({c}) AS points,
  CAST(row_number() OVER (PARTITION BY app_id ORDER BY executor_id <> 'driver', executor_id) AS INTEGER) AS position
FROM grid GROUP BY app_id, executor_id HAVING count({c}) > 0"""
        for c in ["heap", "overhead", "off_heap", "total", "rss", "gc_delta", "saturation", "cpu"]
    ),
)
_add(
    "o03_top_rows",
    ROWS,
    f"""SELECT app_id, executor_id, poll_seq, shuffle_read_mb FROM executor_rows WHERE {_LATEST}
ORDER BY shuffle_read_mb DESC, executor_id, app_id LIMIT 3""",
)
_add(
    "r01_age_retention",
    HISTORY,
    f"""SELECT "appId", executor, "pollSeq", "timeIso" FROM history
WHERE "timeIso" = 'n/a' OR TRY_CAST("timeIso" AS TIMESTAMPTZ) >= to_timestamp(({NOW_MS} - 3600000) / 1000)""",
)
_add(
    "r02_row_cap",
    HISTORY,
    f"""SELECT "appId", executor, "pollSeq" FROM history WHERE "timeMs" IS NULL OR "timeMs" >= {NOW_MS} - 3600000
QUALIFY row_number() OVER (PARTITION BY "appId" ORDER BY "ingestSeq" DESC) <= 1000""",
)
_add("u01_series_union", ALL_BANDS, "SELECT DISTINCT app_id, executor_id, series FROM bands")
_rows("u02_record_once", "heap_mb")

# Streams: the same results as one batch over everything.
_rows(
    "t01_snapshot_stream",
    "heap_pct",
    "saturation_pct",
)
_add("t02_running_cpu_totals", TASK_ENDS, _TOTALS)
ORACLE_SQL["t03_latest_process_cpu"] = """
SELECT concat('app-', user_id % 3 + 3 * (user_id // 150)) AS app_id,
  CASE WHEN user_id % 8 = 0 THEN 'driver' ELSE CAST(user_id % 8 AS VARCHAR) END AS executor_id,
  arg_max(value, event_id) AS cpu_pct FROM events GROUP BY ALL"""
_rows("t04_stateful_deltas", "gc_delta_ms", "cpu_pct", "cpu_source")
_add(
    "t04_stateful_process_cpu",
    PROCESS_CPU,
    "SELECT app_id, executor_id, sample_seq, wall_ns, cpu_ns, cores, cpu_pct FROM published",
)
_add("t05_recorded_once", SAMPLES, "SELECT app_id, executor_id, poll_seq, rss FROM executor_samples")
_add(
    "t06_bounded_history",
    ROWS,
    """SELECT app_id AS "appId", executor_id AS executor, poll_seq AS "pollSeq", gc_delta_ms AS "gcDeltaMs", heap_mb AS "heapMB"
FROM executor_rows JOIN (SELECT app_id, max(wall_ms) AS newest FROM executor_rows GROUP BY app_id) USING (app_id)
WHERE wall_ms >= newest - 1800000
QUALIFY row_number() OVER (PARTITION BY app_id ORDER BY poll_seq DESC, executor_id = 'driver', executor_id DESC) <= 500""",
)
_add(
    "t07_unhealthy_alerts",
    ROWS,
    "SELECT app_id, executor_id, poll_seq, heap_pct, gc_delta_ms, failed_tasks FROM executor_rows WHERE is_unhealthy",
)

# The same results through a store that is written and read.
for _name, _stored in (
    ("s01_snapshot_payloads", "s01_snapshot_files"),
    ("s05_history_records", "s05_store_append_and_read"),
    ("s06_history_restore", "s06_store_restore"),
    ("s07_persisted_tail", "s07_store_tail"),
    ("s08_history_reset", "s08_store_reset"),
    ("s09_purge_stale_apps", "s09_store_purge"),
):
    ORACLE_SQL[_stored] = ORACLE_SQL[_name]
ORACLE_SQL["s10_csv_documents"] = f"""SELECT "appId", '{";".join(HISTORY_CSV_COLUMNS)}' || chr(10) ||
  string_agg(line, chr(10) ORDER BY "ingestSeq", executor) AS document
FROM ({ORACLE_SQL["s10_csv_lines"]}) GROUP BY "appId" """

# The range view over the last samples of a history.
_IN_RANGE, _LAST = ORACLE_SQL["d08_last_samples"].split("\nSELECT *, ", 1)
_LAST = f"{_IN_RANGE},\nlast_samples AS (SELECT *, {_LAST})"
ORACLE_SQL["v01_range_table"] = f"""{_LAST}
SELECT app_id, executor_id, poll_seq, host, heap_pct, total_memory_mb, gc_delta_ms, failed_tasks FROM last_samples WHERE is_unhealthy"""
ORACLE_SQL["v02_range_summary"] = f"""{_LAST}
SELECT app_id, {_CARDS} FROM last_samples GROUP BY app_id"""
ORACLE_SQL["v03_range_offenders"] = f"{_LAST}\n" + "\nUNION ALL ".join(
    f"""SELECT app_id, executor_id, host, '{m}' AS metric, CAST({m} AS DOUBLE) AS value,
  CAST(row_number() OVER (PARTITION BY app_id ORDER BY {m} DESC, executor_id) AS INTEGER) AS rank
FROM last_samples WHERE {m} IS NOT NULL QUALIFY rank <= 3"""
    for m in _OFFENDERS
)
ORACLE_SQL["v04_range_label"] = ORACLE_SQL["d09_range_info"].replace(
    "total_rows\nFROM (SELECT", "total_rows, 'last 30m' AS label\nFROM (SELECT", 1
)

# The same results where keys are cut into segments.
for _name in ("x03_cpu_cascade", "x04_process_cpu_pct", "j01_cpu_time_as_of_poll"):
    ORACLE_SQL[f"{_name}_cut_keys"] = ORACLE_SQL[_name]
