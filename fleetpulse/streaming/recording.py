"""Once-only recording on streams, and recording into the stored history."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetpulse.schemas import HISTORY
from fleetpulse.sources import history_store
from fleetpulse.streaming.counters import POLL_TRIGGER

RECORD_KEYS = ["app_id", "poll_seq", "executor_id"]
HISTORY_KEYS = ["appId", "pollSeq", "executor"]


def recorded_once(samples: DataFrame, remembered: str = "1 hour") -> DataFrame:
    """Each (application, poll, executor) once, however late by its own clock.

    The watermark follows the processing clock (time of the batch), so that no application's clock decides about the samples
    of another. A key is remembered for `remembered` of that time; a repeat that comes later passes, and a store that
    `record_new` fills ignores it, as it holds the row.
    """
    timed = samples.filter("poll_seq > 0").withColumn("_ts", F.current_timestamp())
    return timed.withWatermark("_ts", remembered).dropDuplicatesWithinWatermark(RECORD_KEYS).drop("_ts")


def record_new(path: str) -> Callable[[DataFrame, int], None]:
    """A `foreachBatch` function that appends the rows of a batch that the history does not hold yet.

    A batch writes only its own rows; stored rows win over repeats, and of repeats within a batch the first recorded one does.
    Only buckets of the batch's applications and days of its rows are read, three columns of them. A batch that is run again
    finds its rows stored. Bounds are applied by `history_store.restore_by_own_clock`, or for good by `compact`.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # Of repeats the first recorded one is kept, then the one whose values are known: null is less than any value.
        values = [v for v in HISTORY.fieldNames() if v not in HISTORY_KEYS]
        best = F.max(F.struct((-F.col("ingestSeq")).alias("recorded"), *values)).alias("row")
        rows = batch.groupBy(*HISTORY_KEYS).agg(best).select(*HISTORY_KEYS, *(F.col(f"row.{v}").alias(v) for v in values))
        rows = history_store.conform(rows).persist()
        try:
            if rows.isEmpty():  # a batch that only drops old state; the stored rows need not be read
                return
            places = rows.select(history_store.bucket_of(F.col("appId")).alias("bucket"), history_store.day_of(F.col("timeMs")).alias("day"))
            stored = history_store.versioned(spark, path).join(F.broadcast(places.distinct()), ["bucket", "day"], "left_semi")
            history_store.append(rows.join(stored.select(*HISTORY_KEYS), HISTORY_KEYS, "left_anti"), path)
        finally:
            rows.unpersist()

    return merge


def record_stream(history: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Record a stream of history rows into the store."""
    return (
        history.writeStream.outputMode("append")
        .foreachBatch(record_new(path))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or POLL_TRIGGER))
        .start()
    )
