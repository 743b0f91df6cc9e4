"""End-to-end views: the live view of an application fleet and the range view over its history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.operators import history as H
from fleetpulse.operators.ordered import SPLIT, Split
from fleetpulse.operators.ranking import latest_poll, sort_rows, top_offenders
from fleetpulse.operators.rollups import summarise
from fleetpulse.operators.rows import executor_rows
from fleetpulse.operators.selection import apply_selection
from fleetpulse.settings import Settings


def live_table(
    samples: DataFrame,
    settings: Settings = Settings(),
    selected: DataFrame | None = None,
    only_unhealthy: bool = False,
    split: Split | None = SPLIT,
) -> DataFrame:
    """Live rows of each application's newest poll that pass the unhealthy filter and the selection.

    An application whose executors were all dead at its newest poll has no rows.
    """
    rows = latest_poll(executor_rows(samples, settings, split), polls=samples)
    if only_unhealthy:
        rows = rows.filter("is_unhealthy")
    return rows if selected is None else apply_selection(rows, selected)


def live_summary(samples: DataFrame, settings: Settings = Settings(), **filters) -> DataFrame:
    """Summary figures per application at its newest poll."""
    return summarise(live_table(samples, settings, **filters))


def range_table(
    history: DataFrame,
    now_ms: int,
    minutes: float | None = None,
    settings: Settings = Settings(),
    only_unhealthy: bool = False,
) -> DataFrame:
    """Last sample per executor inside the range of a history, in table order. The whole history is read; bound it first
    with `history.bounded` where that is wanted."""
    rows = H.last_samples(H.in_range(history, now_ms, minutes), settings)
    return sort_rows(rows.filter("is_unhealthy") if only_unhealthy else rows)


def range_summary(history: DataFrame, now_ms: int, minutes: float | None = None, settings: Settings = Settings()):
    """Summary and top offenders of a range view."""
    rows = H.last_samples(H.in_range(history, now_ms, minutes), settings)
    return summarise(rows), top_offenders(rows)


def range_info(history: DataFrame, now_ms: int, minutes: float | None = None) -> DataFrame:
    label = "full history" if minutes is None or minutes == float("inf") else f"last {minutes:g}m"
    return H.range_info(history, H.in_range(history, now_ms, minutes)).withColumn("label", F.lit(label))
