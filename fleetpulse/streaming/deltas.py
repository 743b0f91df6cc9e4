"""Counter deltas across micro-batches.

The window functions the batch form uses do not exist on streams, so the baselines live in keyed state. Each call gets
one executor's new samples of one micro-batch; its size is bounded by the source's rate limit. A sample older than the
newest one seen in an earlier batch keeps its own values and has no deltas, as its neighbours are gone; a repeat of the
newest one is ignored. The watermark follows the processing clock (time of the batch), as one executor's clock that runs
ahead would drop the samples of all others: no sample is too late. State counts as gone once an executor's own next sample is more than `idle_ms` after its newest one, so that a
replay drops the same state; state of executors that stay silent for `idle_ms` of processing time is removed.
"""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fleetpulse.functions.tasks import task_capacity
from fleetpulse.operators.rows import active_only, flatten
from fleetpulse.schemas import EXECUTOR
from fleetpulse.settings import MIN_CPU_ELAPSED_MS, Settings

# PySpark itself joins an empty frame to the state of every new key, which pandas warns about once per key.
warnings.filterwarnings("ignore", message="The behavior of DataFrame concatenation with empty", category=FutureWarning)

IDLE_MS = 24 * 60 * 60 * 1000
SLACK = "1 hour"  # by which the processing clock may be set back between batches

_SAMPLE_STATE = "poll_seq bigint, wall_ms double, cpu_ms double, duration_ms double, gc_ms double"
_PROCESS_STATE = "sample_seq bigint, wall_ns bigint, cpu_ns bigint, at_ms double"


def stream_deltas(samples: DataFrame, idle_ms: int = IDLE_MS) -> DataFrame:
    """Streaming counterpart of `with_deltas` on the live samples of a stream."""
    fields = samples.schema.fields
    # Nullable longs reach pandas as doubles anyway; milliseconds and byte counts are exact there up to 2^53.
    as_double = [
        F.col(f.name).cast("double").alias(f.name) if _is_long(f) and f.name != "poll_seq" else F.col(f.name)
        for f in fields
    ]
    live = active_only(samples).select(
        *as_double,
        task_capacity(F.col("max_tasks"), F.col("total_cores")).cast("double").alias("_capacity"),
        F.current_timestamp().alias("_ts"),
        F.unix_millis(F.current_timestamp()).cast("double").alias("_now_ms"),
    )
    output = T.StructType([live.schema[f.name] for f in fields])
    output = output.add("gc_delta_ms", "double").add("cpu_pct", "double").add("cpu_source", "string")
    columns = [f.name for f in output.fields]

    def advance(key, frames, state: GroupState):
        rows, seen, old = _new_rows(frames, state, "poll_seq")
        if len(old):
            old["gc_delta_ms"] = np.nan
            old["cpu_pct"] = old["os_cpu_pct"].astype("float64")
            old["cpu_source"] = np.where(old["cpu_pct"].notna(), "OS", np.where(old["_capacity"].isna(), "-", "wait"))
            yield old[columns]
        if not len(rows):
            return
        if seen and rows["wall_ms"].iloc[0] - seen[1] > idle_ms:
            seen = None
        start = seen or (None, np.nan, np.nan, np.nan, np.nan)
        rows = _with_cpu(rows, start)
        gc = rows["total_gc_ms"].to_numpy(dtype="float64")
        carried = _carried(gc, start[4])
        delta = gc - carried[:-1]
        rows["gc_delta_ms"] = np.where(delta >= 0, delta, np.nan)
        newest = rows.iloc[-1]
        state.update(
            (
                int(newest["poll_seq"]),
                float(newest["wall_ms"]),
                float(newest["cpu_time_ms"]),
                float(newest["total_duration_ms"]),
                float(carried[-1]),
            )
        )
        state.setTimeoutTimestamp(int(newest["_now_ms"]) + idle_ms)
        yield rows[columns]

    result = live.withWatermark("_ts", SLACK).groupBy(*EXECUTOR).applyInPandasWithState(
        advance, output, _SAMPLE_STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
    return result.select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields],
        F.col("gc_delta_ms").cast("bigint").alias("gc_delta_ms"),
        "cpu_pct",
        "cpu_source",
    )


def stream_process_cpu(samples: DataFrame, event_time_ms: str | None = None, idle_ms: int = IDLE_MS) -> DataFrame:
    """Streaming counterpart of `process_cpu_pct`; nanoseconds stay integers, -1 stands for an unavailable reading.

    `wall_ns` has its own origin in every process, so it cannot serve as event time. With `event_time_ms`, a column of
    epoch milliseconds, state of silent executors expires; without it state is kept.
    """
    columns = ["app_id", "executor_id", "sample_seq", "wall_ns", "cpu_ns", "cores"]
    reading = F.coalesce("cpu_ns", F.lit(-1)).alias("cpu_ns")
    prepared = samples.select("app_id", "executor_id", "sample_seq", "wall_ns", reading, "cores")
    output = T.StructType([*prepared.schema.fields, T.StructField("cpu_pct", T.DoubleType())])
    timeout = GroupStateTimeout.NoTimeout
    if event_time_ms is not None:
        at = F.col(event_time_ms).cast("double").alias("_at_ms")
        prepared = samples.select(
            "app_id", "executor_id", "sample_seq", "wall_ns", reading, "cores", at,
            F.current_timestamp().alias("_ts"), F.unix_millis(F.current_timestamp()).cast("double").alias("_now_ms"),
        ).withWatermark("_ts", SLACK)
        timeout = GroupStateTimeout.EventTimeTimeout

    def advance(key, frames, state: GroupState):
        rows, seen, old = _new_rows(frames, state, "sample_seq")
        if len(old):
            old["cpu_pct"] = np.nan
            yield old[[*columns, "cpu_pct"]]
        if not len(rows):
            return
        if event_time_ms is not None and seen and rows["_at_ms"].iloc[0] - seen[3] > idle_ms:
            seen = None
        # Position 0 is what the state holds; without one its reading is unavailable.
        wall = np.concatenate([[seen[1] if seen else 0], rows["wall_ns"].to_numpy(dtype="int64")])
        cpu = np.concatenate([[seen[2] if seen else -1], rows["cpu_ns"].to_numpy(dtype="int64")])
        known = np.maximum.accumulate(np.where(cpu >= 0, np.arange(cpu.size), 0))
        before = cpu[known[:-1]]
        passed = wall[1:] - wall[:-1]
        usable = (cpu[1:] >= 0) & (before >= 0) & (passed > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            share = (cpu[1:] - before).astype("float64") * 100.0 / (passed.astype("float64") * rows["cores"].to_numpy())
        rows["cpu_pct"] = np.where(usable, share, np.nan)
        at_ms = float("nan") if event_time_ms is None else float(rows["_at_ms"].max())
        state.update((int(rows["sample_seq"].iloc[-1]), int(wall[-1]), int(cpu[known[-1]]), at_ms))
        if event_time_ms is not None:
            state.setTimeoutTimestamp(int(rows["_now_ms"].max()) + idle_ms)
        yield rows[[*columns, "cpu_pct"]]

    result = prepared.groupBy(*EXECUTOR).applyInPandasWithState(advance, output, _PROCESS_STATE, "append", timeout)
    return result.withColumn("cpu_ns", F.when(F.col("cpu_ns") >= 0, F.col("cpu_ns")))


def live_rows(samples: DataFrame, settings: Settings = Settings(), idle_ms: int = IDLE_MS) -> DataFrame:
    """Derived rows of a sample stream, deltas included."""
    return flatten(stream_deltas(samples, idle_ms), settings)


def unhealthy_alerts(samples: DataFrame, settings: Settings = Settings(), idle_ms: int = IDLE_MS) -> DataFrame:
    """Unhealthy rows as they appear."""
    return live_rows(samples, settings, idle_ms).filter("is_unhealthy")


def _is_long(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.LongType)


def _new_rows(frames, state: GroupState, order: str):
    """The key's unseen rows in order, its state, and rows older than it; no rows when the state timed out."""
    if state.hasTimedOut:
        state.remove()
        return (), None, ()
    rows = pd.concat(list(frames), ignore_index=True).drop_duplicates(order).sort_values(order, ignore_index=True)
    seen = state.get if state.exists else None
    if seen is None:
        return rows, None, ()
    return rows[rows[order] > seen[0]].reset_index(drop=True), seen, rows[rows[order] < seen[0]].copy()


def _carried(values: np.ndarray, start: float) -> np.ndarray:
    """Newest known value before each position and, as the last element, after all of them."""
    return pd.Series(np.concatenate([[start], values])).ffill().to_numpy()


def _before(values: np.ndarray, start: float) -> np.ndarray:
    return np.concatenate([[start], values[:-1]])


def _with_cpu(rows: pd.DataFrame, start: tuple) -> pd.DataFrame:
    """CPU cascade on ordered rows; NaN compares false throughout, as null does in the batch form."""
    number = {
        c: rows[c].to_numpy(dtype="float64")
        for c in ["os_cpu_pct", "_capacity", "wall_ms", "cpu_time_ms", "total_duration_ms", "active_tasks"]
    }
    elapsed = number["wall_ms"] - _before(number["wall_ms"], start[1])
    cpu = number["cpu_time_ms"] - _before(number["cpu_time_ms"], start[2])
    duration = number["total_duration_ms"] - _before(number["total_duration_ms"], start[3])
    idle = (cpu == 0) & (np.nan_to_num(number["active_tasks"]) == 0)
    core_ms = elapsed * number["_capacity"]
    branches = [
        ~np.isnan(number["os_cpu_pct"]),
        np.isnan(number["_capacity"]),
        ~(elapsed > MIN_CPU_ELAPSED_MS),
        (cpu > 0) | idle,
        duration >= 0,
    ]
    with np.errstate(divide="ignore", invalid="ignore"):
        values = [number["os_cpu_pct"], np.nan, np.nan, cpu / core_ms * 100.0, duration / core_ms * 100.0]
    rows["cpu_pct"] = np.select(branches, values, np.nan)
    rows["cpu_source"] = np.select(branches, ["OS", "-", "wait", "TaskCpuTime", "totalDuration"], "-")
    return rows
