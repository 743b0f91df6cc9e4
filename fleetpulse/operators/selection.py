"""Executor selection: filter, side table and tri-state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.operators.joins import spread_join
from fleetpulse.schemas import EXECUTOR

MODES = ("all", "selected")


def apply_selection(
    rows: DataFrame, selected: DataFrame, mode: str = "selected", on: Sequence[str] = EXECUTOR
) -> DataFrame:
    """Rows of the selected executors; mode `all` keeps every row. `selected` is a table of ids, not a driver list."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, got {mode!r}")
    if mode == "all":
        return rows
    return spread_join(rows, selected.select(*on).distinct(), on, "left_semi", spread=["poll_seq", *on])


def selection_state(visible: DataFrame, selected: DataFrame) -> DataFrame:
    """Per application: selected and visible counts and whether all, some or none of the visible rows are selected.

    `visible` holds one row per executor. Selected executors that are not visible still count as selected, and an
    application with nothing visible has the state `none`.
    """
    marks = selected.select(*EXECUTOR).distinct().withColumn("_selected", F.lit(1))
    seen = visible.select(*EXECUTOR).withColumn("_visible", F.lit(1))
    counts = (
        seen.join(marks, EXECUTOR, "full")
        .groupBy("app_id")
        .agg(
            F.count("_selected").alias("selected_count"),
            F.count("_visible").alias("visible_count"),
            F.count_if(F.col("_selected").isNotNull() & F.col("_visible").isNotNull()).alias("selected_visible"),
        )
    )
    both = F.col("selected_visible")
    state = F.when(both == 0, "none").when(both == F.col("visible_count"), "all").otherwise("some")
    return counts.withColumn("state", state)
