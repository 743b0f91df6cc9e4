"""Executor-telemetry analytics for fleets of Spark applications."""

from fleetpulse.settings import Settings

__all__ = ["Settings"]
