"""User parameters of the health model and the fixed limits of the views."""

from __future__ import annotations

from dataclasses import dataclass

# Limits and steps that results must agree on.
DEFAULT_WARN_PCT = 85.0
DEFAULT_SAT_WARN_PCT = 400.0
DEFAULT_MEMORY_FRACTION = 0.6
RESERVED_BYTES = 300 * 1024 * 1024
LIVE_WINDOW_POINTS = 120
RETENTION_MS = 60 * 60 * 1000
HISTORY_MAX_ROWS = 20000
PERSIST_MAX_ROWS = 500
MIN_CPU_ELAPSED_MS = 100
SERIES_CPU_CLIP = 200.0
GC_WARN_MS = 500
GC_DANGER_MS = 2000
GC_PCT_UNHEALTHY = 10.0
TOP_OFFENDERS = 3
CPU_WARN_PCT = 20.0
CPU_DANGER_PCT = 50.0
SATURATION_WARN_SHARE = 0.75  # of the danger threshold
CARD_HEAP_WARN_PCT = 85.0
CARD_HEAP_DANGER_PCT = 90.0

MEMORY_MODES = ("rss", "estimated")


@dataclass(frozen=True)
class Settings:
    """Thresholds and the memory model used when rows are derived."""

    warn_pct: float = DEFAULT_WARN_PCT
    sat_warn_pct: float = DEFAULT_SAT_WARN_PCT
    memory_fraction: float = DEFAULT_MEMORY_FRACTION
    reserved_bytes: int = RESERVED_BYTES
    memory_mode: str = "rss"

    def __post_init__(self):
        if self.memory_mode not in MEMORY_MODES:
            raise ValueError(f"memory_mode must be one of {MEMORY_MODES}, got {self.memory_mode!r}")
