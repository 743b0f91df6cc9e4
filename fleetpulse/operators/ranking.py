"""Top rows per group, bounded newest rows and sorting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.functions.text import natural_key
from fleetpulse.operators.joins import spread_join
from fleetpulse.operators.ordered import SEGMENT, segment_of
from fleetpulse.settings import TOP_OFFENDERS

# Fixed value: the seven offender sections and the row column each one ranks.
OFFENDER_METRICS = [
    "heap_pct",
    "total_memory_mb",
    "gc_delta_ms",
    "saturation_pct",
    "jvm_off_heap_mb",
    "on_heap_unified_mb",
    "shuffle_read_mb",
]

NATURAL = "_natural"

# Up to this many rows per group Spark limits groups before the shuffle (spark.sql.optimizer.windowGroupLimitThreshold).
GROUP_LIMIT = 1000

# Fixed value: sortable table columns that hold text; all others sort as numbers.
TEXT_SORT_KEYS = ("executor_id", "host", "metric_source", "total_memory_source", "cpu_source")


def top_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str | None = None
) -> DataFrame:
    """First `n` rows of each group.

    Spark turns the bounded row number into a group limit that runs before the shuffle as well, so at most `n` rows
    per group and map task are exchanged, however large a group is. That holds up to
    `spark.sql.optimizer.windowGroupLimitThreshold` (1000); use `newest_rows` for larger bounds.
    """
    name = rank or "_rank"
    window = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= n)
    return ranked if rank else ranked.drop(name)


def newest_rows(
    df: DataFrame, keys: Sequence[str], order: str, n: int, ties: Sequence[str] = (), width: int = 65536
) -> DataFrame:
    """The `n` rows of each key with the largest `order` (then `ties`), for any `n` and any key size.

    Null keys form a group like any other, and rows with a null `order` are the oldest of their key.
    Rows are counted per (key, segment of the order axis), the counts tell how many newer rows each segment has, and
    only segments that still have room are ranked; a segment is ranked on its own task.
    """
    keys = list(keys)
    columns = df.columns
    df = df.withColumn(SEGMENT, segment_of(F.coalesce(F.col(order), F.lit(-(1 << 63))), width))
    newer = Window.partitionBy(*keys).orderBy(F.desc(SEGMENT)).rowsBetween(Window.unboundedPreceding, -1)
    room = (
        df.groupBy(*keys, SEGMENT)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_room", F.lit(n) - F.coalesce(F.sum("_rows").over(newer), F.lit(0)))
        .filter(F.col("_room") > 0)
        .drop("_rows")
    )
    window = Window.partitionBy(*keys, SEGMENT).orderBy(F.desc_nulls_last(order), *[F.desc(t) for t in ties])
    room = room.toDF(*[f"_room_{k}" for k in keys], "_room_segment", "_room")
    same = F.col(SEGMENT) == F.col("_room_segment")
    for key in keys:
        same &= F.col(key).eqNullSafe(F.col(f"_room_{key}"))
    return (
        df.join(room, same)
        .withColumn("_rank", F.row_number().over(window))
        .filter(F.col("_rank") <= F.col("_room"))
        .select(*columns)
    )


def latest_poll(
    df: DataFrame, polls: DataFrame | None = None, key: str = "app_id", order: str = "poll_seq"
) -> DataFrame:
    """Rows of each application's last poll; the last one in `polls` where that is given."""
    newest = (df if polls is None else polls).groupBy(key).agg(F.max(order).alias(order))
    return df.join(newest, [key, order], "left_semi")


def last_polls(df: DataFrame, points: int, key: str = "app_id", order: str = "poll_seq") -> DataFrame:
    """Rows of each application's last `points` polls; the axis belongs to the application, not to its executors."""
    polls = df.select(key, order).distinct()
    small = points <= GROUP_LIMIT
    newest = top_per_group(polls, [key], [F.desc(order)], points) if small else newest_rows(polls, [key], order, points)
    oldest = newest.groupBy(key).agg(F.min(order).alias("_oldest"))
    return (
        spread_join(df, oldest, [key], spread=[order])
        .filter(F.col(order) >= F.col("_oldest"))
        .drop("_oldest")
    )


def top_offenders(rows: DataFrame, group: Sequence[str] = ("app_id",), limit: int = TOP_OFFENDERS) -> DataFrame:
    """Highest executors per offender metric; rows without a value are left out, ties go by natural id."""
    # The natural key is computed once per row, not once per comparison of the sort.
    wide = rows.select(
        *group,
        "executor_id",
        "host",
        natural_key(F.col("executor_id")).alias(NATURAL),
        *[F.col(m).cast("double").alias(m) for m in OFFENDER_METRICS],
    )
    kept = [*group, "executor_id", "host", NATURAL]
    tall = wide.unpivot(kept, OFFENDER_METRICS, "metric", "value").filter(F.col("value").isNotNull())
    order = [F.desc("value"), F.col(NATURAL), F.col("executor_id")]
    return top_per_group(tall, [*group, "metric"], order, limit, rank="rank").drop(NATURAL)


def default_direction(key: str) -> str:
    """Direction of a column that is sorted for the first time."""
    return "asc" if key in ("executor_id", "host") else "desc"


def _table_order(rows: DataFrame, key: str, direction: str | None) -> tuple[DataFrame, list[Column]]:
    direction = direction or default_direction(key)
    if direction not in ("asc", "desc"):
        raise ValueError(f"direction must be 'asc' or 'desc', got {direction!r}")
    value = natural_key(F.nullif(F.col(key), F.lit(""))) if key in TEXT_SORT_KEYS else F.col(key)
    keyed = rows.withColumns({"_value": value, NATURAL: natural_key(F.col("executor_id"))})
    first = F.col("_value").asc_nulls_last() if direction == "asc" else F.col("_value").desc_nulls_last()
    return keyed, [first, F.col(NATURAL), F.col("executor_id")]


def sort_rows(rows: DataFrame, key: str = "heap_pct", direction: str | None = None) -> DataFrame:
    """Table order: empty values last in both directions, text in natural order, ties by id."""
    keyed, order = _table_order(rows, key, direction)
    return keyed.orderBy(*order).drop("_value", NATURAL)


def row_positions(
    rows: DataFrame, within: Sequence[str], key: str = "heap_pct", direction: str | None = None
) -> DataFrame:
    """`position` of each row in the table order of its `within` group, the executors of one table."""
    keyed, order = _table_order(rows, key, direction)
    position = F.row_number().over(Window.partitionBy(*within).orderBy(*order))
    return keyed.withColumn("position", position).drop("_value", NATURAL)


def sort_series(found: DataFrame, within: Sequence[str]) -> DataFrame:
    """Order of chart series inside each `within` group: the driver first, then natural order."""
    keyed = found.withColumn(NATURAL, natural_key(F.col("executor_id")))
    return keyed.orderBy(*within, F.col("executor_id") != "driver", NATURAL, "executor_id").drop(NATURAL)


def series_positions(found: DataFrame, within: Sequence[str]) -> DataFrame:
    """`position` of each series in that order, counted in each `within` group."""
    keyed = found.withColumn(NATURAL, natural_key(F.col("executor_id")))
    window = Window.partitionBy(*within).orderBy(F.col("executor_id") != "driver", NATURAL, "executor_id")
    return keyed.withColumn("position", F.row_number().over(window)).drop(NATURAL)


def top_rows(rows: DataFrame, metric: str, limit: int) -> DataFrame:
    """Highest rows of one metric over the whole input."""
    keyed = rows.filter(F.col(metric).isNotNull()).withColumn(NATURAL, natural_key(F.col("executor_id")))
    return keyed.orderBy(F.desc(metric), NATURAL, "executor_id", "app_id").limit(limit).drop(NATURAL)
