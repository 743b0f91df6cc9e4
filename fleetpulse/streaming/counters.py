"""Running per-executor aggregates and stateless rows on streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetpulse.operators.rollups import cpu_totals, latest_cpu_pct
from fleetpulse.operators.rows import active_only, flatten
from fleetpulse.settings import Settings

POLL_TRIGGER = {"processingTime": "5 seconds"}
BATCH = "_batch"


def stateless_rows(samples: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Derived rows without the columns that need earlier samples, which stay null, and without the unhealthy flag, which
    needs one of them; `deltas.live_rows` has both."""
    blank = active_only(samples).withColumns(
        {
            "gc_delta_ms": F.lit(None).cast("bigint"),
            "cpu_pct": F.lit(None).cast("double"),
            "cpu_source": F.lit("-"),
        }
    )
    return flatten(blank, settings).drop("is_unhealthy")


def running_cpu_totals(task_ends: DataFrame) -> DataFrame:
    """CPU milliseconds per executor, kept up to date; start it in update mode."""
    return cpu_totals(task_ends)


def running_latest_cpu(cpu_samples: DataFrame) -> DataFrame:
    """Newest CPU percentage per executor, kept up to date; start it in update mode."""
    return latest_cpu_pct(cpu_samples)


def write_updates(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write the changed keys of every micro-batch to its own directory.

    A batch that is run again after a failure overwrites its own directory, so a retry adds nothing twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")

    return (
        stream.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or POLL_TRIGGER))
        .start()
    )


def read_updates(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Current value per key: the one of its newest batch."""
    updates = spark.read.parquet(path)
    values = [c for c in updates.columns if c not in (*keys, BATCH)]
    return updates.groupBy(*keys).agg(*[F.max_by(c, BATCH).alias(c) for c in values])


def write_rows(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append rows to Parquet; the file sink's log makes each batch visible once."""
    return (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or POLL_TRIGGER))
        .start()
    )
