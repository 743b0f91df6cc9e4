"""History as an append-only Parquet store with tombstones and compaction.

Rows lie under `rows`, in partitions of (bucket, generation, day): applications fall into BUCKETS buckets by hash, and days
come from `timeMs`. Every write has a version. Dropping applications appends one short row each to `tombstones`: what was
written up to that version is gone for readers, who join tombstones away; later rows of the application count again. No write
replaces or deletes a file, so a failed one changes nothing. `compact` rewrites the buckets that have tombstones as a new
generation, makes that current with one row in `generations`, and empties the old one.

A store has one writer at a time; its clock gives the versions.
"""

from __future__ import annotations

import time
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegerType, LongType, StringType, StructField, StructType

from fleetpulse.operators.history import bounded, bounded_by_own_clock, conform, ingest_number, persisted_tail, time_ms
from fleetpulse.schemas import HISTORY
from fleetpulse.settings import PERSIST_MAX_ROWS

BUCKETS = 64
DAY_MS = 86_400_000
GENERATIONS = StructType([StructField("bucket", IntegerType()), StructField("generation", LongType())])
ROWS = StructType([*HISTORY.fields, StructField("version", LongType()), *GENERATIONS.fields, StructField("day", DateType())])
TOMBSTONES = StructType([StructField("appId", StringType()), StructField("upTo", LongType()), *GENERATIONS.fields])

_last_version = 0


def next_version() -> int:
    """Microseconds of the writer's clock, each number once."""
    global _last_version
    _last_version = max(_last_version + 1, time.time_ns() // 1000)
    return _last_version


def bucket_of(app: Column) -> Column:
    return F.pmod(F.xxhash64(app), F.lit(BUCKETS)).cast("int")


def day_of(ms: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / DAY_MS).cast("int"))


def _table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A table of the store, or an empty one when nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def generations(spark: SparkSession, path: str) -> dict[int, int]:
    """Current generation of the buckets that were compacted; at most BUCKETS rows are collected."""
    newest = _table(spark, f"{path}/generations", GENERATIONS).groupBy("bucket").agg(F.max("generation").alias("generation"))
    return {row.bucket: row.generation for row in newest.collect()}


def _generation(known: dict[int, int], bucket: Column) -> Column:
    """Generation of a bucket as a column of literals, which prunes partitions."""
    out = F.lit(0).cast("bigint")
    for number, generation in known.items():
        out = F.when(bucket == number, F.lit(generation).cast("bigint")).otherwise(out)
    return out


def _current(spark: SparkSession, path: str, table: str, schema: StructType) -> DataFrame:
    own = _generation(generations(spark, path), F.col("bucket"))
    return _table(spark, f"{path}/{table}", schema).filter(F.col("generation") == own)


def _laid_out(rows: DataFrame) -> DataFrame:
    """Rows so placed that few tasks write to one partition of the store and a hot application is split over several.

    A rebalance needs adaptive execution, which streams with state turn off for their batches; there ranges of sampled keys
    do the same.
    """
    if rows.sparkSession.conf.get("spark.sql.adaptive.enabled") == "true":
        return rows.hint("rebalance", "bucket", "day")
    return rows.repartitionByRange("bucket", "day", "appId", "executor", "pollSeq")


def append(history: DataFrame, path: str, version: int | None = None) -> None:
    """Append recorded rows in files that are neither many nor of one task for a hot application."""
    known = generations(history.sparkSession, path)
    rows = conform(history).withColumns(
        {"version": F.lit(version or next_version()).cast("bigint"), "bucket": bucket_of(F.col("appId")), "day": day_of(F.col("timeMs"))}
    )
    rows = rows.withColumn("generation", _generation(known, F.col("bucket"))).select(*ROWS.fieldNames())
    _laid_out(rows).write.mode("append").partitionBy("bucket", "generation", "day").parquet(f"{path}/rows")


def _bury(apps: DataFrame, path: str, up_to: int) -> None:
    """Tombstones for every version of (appId) up to the given one."""
    known = generations(apps.sparkSession, path)
    rows = apps.select("appId").distinct().select("appId", F.lit(up_to).cast("bigint").alias("upTo"), bucket_of(F.col("appId")).alias("bucket"))
    rows = rows.withColumn("generation", _generation(known, F.col("bucket")))
    rows.coalesce(1).write.mode("append").partitionBy("bucket", "generation").parquet(f"{path}/tombstones")


def versioned(spark: SparkSession, path: str) -> DataFrame:
    """Rows that no tombstone covers, with their version and place. Tombstones are one row for each dropped application."""
    rows = _current(spark, path, "rows", ROWS)
    dropped = _current(spark, path, "tombstones", TOMBSTONES).groupBy(F.col("appId").alias("_app")).agg(F.max("upTo").alias("_upTo"))
    gone = rows["appId"].eqNullSafe(F.col("_app")) & (rows["version"] <= F.col("_upTo"))
    return rows.join(dropped, gone, "left_anti")


def read(spark: SparkSession, path: str, apps: Iterable[str] | None = None, since_ms: int | None = None) -> DataFrame:
    """The stored history, or an empty one when nothing was stored yet.

    Given names of applications prune buckets, a given time prunes days.
    """
    rows = versioned(spark, path)
    if apps is not None:
        names = list(apps)
        buckets = [row[0] for row in spark.createDataFrame([(n,) for n in names], "name string").select(bucket_of(F.col("name"))).distinct().collect()]
        rows = rows.filter(F.col("appId").isin(names) & F.col("bucket").isin(buckets))
    if since_ms is not None:
        rows = rows.filter((F.col("timeMs") >= since_ms) & (F.col("day") >= day_of(F.lit(since_ms))))
    return conform(rows)


def replace_apps(history: DataFrame, path: str) -> None:
    """Replace the rows of exactly those applications that `history` holds: the new rows first, then tombstones for the old."""
    spark, version = history.sparkSession, next_version()
    append(history, path, version)
    written = _current(spark, path, "rows", ROWS).filter(F.col("version") == version)
    _bury(written.select("appId"), path, version - 1)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """History kept as JSON lines; lines that do not hold a record are dropped.

    Persisted lines have the recorded columns only: the time follows from `timeIso`, and the insertion number from its
    second and the executor, as rows of a poll are recorded together.
    """
    rows = spark.read.schema(HISTORY).option("mode", "DROPMALFORMED").json(path)
    at = F.coalesce("timeMs", time_ms(F.col("timeIso")))
    recorded = ingest_number(F.call_function("div", at, F.lit(1000).cast("bigint")), F.col("executor"))
    known = rows.filter("appId is not null and executor is not null")
    return known.withColumns({"timeMs": at, "ingestSeq": F.coalesce("ingestSeq", recorded)})


def restore(
    spark: SparkSession, path: str, now_ms: int, max_age_ms: int | None = None, max_rows: int | None = None
) -> DataFrame:
    """Stored history with the given retention rules applied again."""
    since = None if max_age_ms is None else now_ms - max_age_ms
    stored = versioned(spark, path)
    # Rows without a time are kept by the age rule, so days are pruned only beside them.
    recent = stored if since is None else stored.filter(F.col("day").isNull() | (F.col("day") >= day_of(F.lit(since))))
    return bounded(conform(recent), now_ms, max_rows, max_age_ms)


def restore_by_own_clock(spark: SparkSession, path: str, max_rows: int | None = None, max_age_ms: int | None = None) -> DataFrame:
    """Stored history within bounds where the present of each application is its own newest time."""
    return bounded_by_own_clock(read(spark, path), max_rows, max_age_ms)


def persist_tail(history: DataFrame, path: str, max_rows: int = PERSIST_MAX_ROWS) -> None:
    """Write the newest rows of each application to their own place, instead of all that was there."""
    spark, version = history.sparkSession, next_version()
    append(persisted_tail(history, max_rows), path, version)
    older = _current(spark, path, "rows", ROWS).filter(F.col("version") < version)
    _bury(older.select("appId"), path, version - 1)


def stored_apps(spark: SparkSession, path: str) -> DataFrame:
    """Applications (appId) that have rows; only that column and the versions are read."""
    return versioned(spark, path).select("appId").distinct()


def _named(spark: SparkSession, apps: DataFrame | Iterable[str]) -> DataFrame:
    return apps.select("appId") if isinstance(apps, DataFrame) else spark.createDataFrame([(a,) for a in apps], "appId string")


def reset(spark: SparkSession, path: str, apps: DataFrame | Iterable[str]) -> None:
    """Drop what is stored of the given applications; what is recorded from now on is kept."""
    # The version comes first: `apps` may be read from rows that are being written.
    version = next_version()
    _bury(_named(spark, apps), path, version)


def purge_stale(spark: SparkSession, path: str, live_apps: DataFrame | Iterable[str]) -> None:
    """Drop the history of every application that is not live."""
    version = next_version()
    live = _named(spark, live_apps).withColumnRenamed("appId", "_live").distinct()
    stale = stored_apps(spark, path).join(live, F.col("appId").eqNullSafe(F.col("_live")), "left_anti")
    _bury(stale, path, version)


def compact(spark: SparkSession, path: str, max_rows: int | None = None, max_age_ms: int | None = None) -> list[int]:
    """Rewrite buckets without the rows that tombstones, or the given bounds by each application's own clock, leave out.

    Without bounds only buckets with tombstones are rewritten, else all. Returns the rewritten buckets.
    """
    table, schema = ("rows", ROWS) if max_rows is not None or max_age_ms is not None else ("tombstones", TOMBSTONES)
    buckets = sorted(row.bucket for row in _current(spark, path, table, schema).select("bucket").distinct().collect())
    if not buckets:
        return []
    before, generation = generations(spark, path), next_version()
    live = versioned(spark, path).filter(F.col("bucket").isin(buckets))
    kept = bounded_by_own_clock(live, max_rows, max_age_ms).withColumn("generation", F.lit(generation).cast("bigint")).select(*ROWS.fieldNames())
    _laid_out(kept).write.mode("append").partitionBy("bucket", "generation", "day").parquet(f"{path}/rows")
    now = spark.createDataFrame([(b, generation) for b in buckets], GENERATIONS)
    now.coalesce(1).write.mode("append").parquet(f"{path}/generations")
    # From here on readers use the new generation; the old one is overwritten with nothing. Its tombstones, a row for each
    # dropped application, are never read again.
    nothing = spark.createDataFrame([], ROWS).drop("bucket", "generation")
    for bucket in buckets:
        old = f"{path}/rows/bucket={bucket}/generation={before.get(bucket, 0)}"
        nothing.write.mode("overwrite").partitionBy("day").parquet(old)
    return buckets
