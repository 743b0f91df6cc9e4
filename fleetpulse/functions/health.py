"""Health predicate and severity classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetpulse.settings import (
    CARD_HEAP_DANGER_PCT,
    CARD_HEAP_WARN_PCT,
    CPU_DANGER_PCT,
    CPU_WARN_PCT,
    GC_DANGER_MS,
    GC_PCT_UNHEALTHY,
    GC_WARN_MS,
    SATURATION_WARN_SHARE,
)


def _holds(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def is_unhealthy(
    heap_pct: Column,
    gc_delta_ms: Column,
    gc_pct: Column,
    saturation_pct: Column,
    failed_tasks: Column,
    warn_pct: float,
    sat_warn_pct: float,
) -> Column:
    """Any threshold reached; a value that was not measured never counts."""
    return (
        _holds(heap_pct >= F.lit(float(warn_pct)))
        | _holds(gc_delta_ms >= GC_WARN_MS)
        | _holds(gc_pct >= F.lit(GC_PCT_UNHEALTHY))
        | _holds(saturation_pct >= F.lit(float(sat_warn_pct)))
        | _holds(failed_tasks > 0)
    )


def severity(value: Column, danger: float | None = None, warn: float | None = None) -> Column:
    """`danger`, `warn` or `normal` by inclusive lower bounds; null is `normal`."""
    result = F.lit("normal")
    if warn is not None:
        result = F.when(value >= F.lit(float(warn)), "warn").otherwise(result)
    if danger is not None:
        result = F.when(value >= F.lit(float(danger)), "danger").otherwise(result)
    return result


def cell_severities(warn_pct: float, sat_warn_pct: float) -> dict[str, Column]:
    """Severity of the coloured cells of one executor row."""
    return {
        "heap_severity": severity(F.col("heap_pct"), danger=warn_pct),
        "gc_severity": severity(F.col("gc_delta_ms"), danger=GC_DANGER_MS, warn=GC_WARN_MS),
        "saturation_severity": severity(
            F.col("saturation_pct"), danger=sat_warn_pct, warn=sat_warn_pct * SATURATION_WARN_SHARE
        ),
        "cpu_severity": severity(F.col("cpu_pct"), danger=CPU_DANGER_PCT, warn=CPU_WARN_PCT),
        "failed_severity": F.when(F.col("failed_tasks") > 0, "danger").otherwise("normal"),
    }


def card_severities() -> dict[str, Column]:
    """Severity of the summary cards; these bounds are fixed and do not follow the user thresholds."""
    return {
        "unhealthy_severity": F.when(F.col("unhealthy") > 0, "warn").otherwise("normal"),
        "avg_heap_severity": severity(F.col("avg_heap_pct"), warn=CARD_HEAP_WARN_PCT),
        "max_heap_severity": severity(F.col("max_heap_pct"), danger=CARD_HEAP_DANGER_PCT, warn=CARD_HEAP_WARN_PCT),
        "failed_severity": F.when(F.col("failed_tasks") > 0, "danger").otherwise("normal"),
        "gc_severity": severity(F.col("avg_gc_delta_ms"), danger=GC_DANGER_MS, warn=GC_WARN_MS),
    }
