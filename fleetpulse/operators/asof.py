"""Backward as-of joins by union and ordered scan.

A range join would compare every poll with every earlier event of its executor. Here both sides share one axis: events
are first reduced to one row per (executor, time), then polls and events are ordered together, events first on ties,
and each poll takes the running value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.functions.tasks import counted_cpu_ns
from fleetpulse.operators.ordered import SPLIT, Split, ordered_scan
from fleetpulse.schemas import EXECUTOR

NS_PER_MS = 1000000


def cpu_time_as_of(
    polls: DataFrame,
    task_ends: DataFrame,
    poll_time: str = "poll_seq",
    event_time: str = "poll_seq",
    split: Split | None = SPLIT,
) -> DataFrame:
    """Add `cpu_time_ms`: CPU milliseconds of the tasks finished up to each poll, 0 when there are none."""
    events = (
        task_ends.filter(counted_cpu_ns(F.col("executor_id"), F.col("cpu_ns")))
        .groupBy(*EXECUTOR, F.col(event_time).alias("_time"))
        .agg(F.sum("cpu_ns").alias("_cpu_ns"))
    )
    merged = _one_axis(polls, events, poll_time)
    scanned = ordered_scan(
        merged, EXECUTOR, "_position", running_sum={"_total_ns": F.col("_cpu_ns")}, split=split
    )
    total_ms = F.expr(f"coalesce(_total_ns, 0L) div {NS_PER_MS}L")
    return _polls_only(scanned, polls, {"cpu_time_ms": total_ms})


def process_cpu_as_of(
    polls: DataFrame,
    cpu_samples: DataFrame,
    poll_time: str = "poll_seq",
    sample_time: str = "poll_seq",
    sample_seq: str = "sample_seq",
    split: Split | None = SPLIT,
) -> DataFrame:
    """Add `os_cpu_pct`: the newest published CPU percentage at or before each poll, however old; null when none."""
    events = (
        cpu_samples.filter(F.col("executor_id").isNotNull() & F.col("cpu_pct").isNotNull())
        .groupBy(*EXECUTOR, F.col(sample_time).alias("_time"))
        .agg(F.max_by("cpu_pct", sample_seq).alias("_pct"))
    )
    merged = _one_axis(polls, events, poll_time)
    scanned = ordered_scan(
        merged, EXECUTOR, "_position", last_up_to={"_latest_pct": F.col("_pct")}, split=split
    )
    return _polls_only(scanned, polls, {"os_cpu_pct": F.col("_latest_pct")})


def attach_cpu_totals(polls: DataFrame, totals: DataFrame) -> DataFrame:
    """Plain variant: attach one final `cpu_time_ms` per executor, 0 when it has none."""
    return polls.join(totals, EXECUTOR, "left").withColumn("cpu_time_ms", F.coalesce("cpu_time_ms", F.lit(0)))


def enriched(
    samples: DataFrame, task_ends: DataFrame, cpu_samples: DataFrame, split: Split | None = SPLIT
) -> DataFrame:
    """Samples with `cpu_time_ms` and `os_cpu_pct` as they stood at each poll; both replace what the samples hold."""
    bare = samples.drop("cpu_time_ms", "os_cpu_pct")
    return process_cpu_as_of(cpu_time_as_of(bare, task_ends, split=split), cpu_samples, split=split)


def _one_axis(polls: DataFrame, events: DataFrame, poll_time: str) -> DataFrame:
    """Both sides on one integer axis; an event's position is even and a poll's is the odd one behind it."""
    marked = polls.withColumn("_position", F.col(poll_time) * 2 + 1)
    placed = events.withColumn("_position", F.col("_time") * 2).drop("_time")
    return marked.unionByName(placed, allowMissingColumns=True)


def _polls_only(scanned: DataFrame, polls: DataFrame, added: dict[str, Column]) -> DataFrame:
    payload = [c for c in polls.columns if c not in added]
    return scanned.filter("_position % 2 <> 0").select(*payload, *[v.alias(a) for a, v in added.items()])
