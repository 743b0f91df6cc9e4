"""Ordered computations over keys of any size.

A plain window sorts all rows of a key in one task, which is right for most keys and fatal for a key that holds a
third of the table. Keys with more than `Split.max_rows` rows are therefore cut into segments of their order axis, of
about `Split.segment_rows` rows each however unevenly they lie on it; all other keys stay whole. Each segment is
summarised to one row, the summaries of a key are scanned in order to find what a segment inherits from the ones before
it, and rows are windowed inside their segment only. Rows are shuffled once, on (keys, segment); the inherited values arrive by an equi-join on the
same columns, so the row side needs no second exchange and no second sort.

A key has at most `MAX_SEGMENTS` segments, enough to keep a cluster busy; beyond 2 * 10^9 rows its segments grow instead of
their number, so that a row never carries more than 16 KB of bounds through the join that places it. The bounds of all
cut keys are broadcast: about one number for every `segment_rows` rows of the input at most, 8 MB for 10^12 rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENT = "_segment"
ADJACENT_WIDTH = 65536
SAMPLES_PER_SEGMENT = 64
MAX_SEGMENTS = 2048

_LOWEST = -(1 << 63)

_BEFORE = (Window.unboundedPreceding, -1)
_UP_TO = (Window.unboundedPreceding, Window.currentRow)


@dataclass(frozen=True)
class Split:
    """From which size on a key is cut, and about how many rows its segments have."""

    max_rows: int = 1 << 22
    segment_rows: int = 1 << 20


SPLIT = Split()


def hot_keys(df: DataFrame, keys: Sequence[str], order: str, split: Split = SPLIT) -> DataFrame:
    """Keys to cut: (keys, `_bounds`), the ascending first positions of a key's segments; the first one is open below.

    Segments have equal depth wherever the rows lie on the axis. One partially aggregated pass over the key and order
    columns counts all rows of each key and, exactly, those of every sampled position. Positions are sampled by their
    hash, so that a repeated task samples the same ones; at least `SAMPLES_PER_SEGMENT` lie in a segment on average, which
    keeps segments well under twice their target (all positions are taken where the target is that small). Rows of one
    position are never parted.
    """
    step = max(1, split.segment_rows // SAMPLES_PER_SEGMENT)
    depth = max(1, split.segment_rows // step)
    taken = F.pmod(F.xxhash64(*keys, order), F.lit(step)) == 0
    counted = df.groupBy(*keys, F.when(taken, F.col(order)).cast("bigint").alias("_at")).agg(F.count(F.lit(1)).alias("_rows"))
    # Positions that were not sampled are one row per key, in front of all others (nulls first), and count as none.
    sampled = F.when(F.col("_at").isNotNull(), F.col("_rows"))
    of_key = Window.partitionBy(*keys)
    before = F.coalesce(F.sum(sampled).over(of_key.orderBy("_at").rowsBetween(*_BEFORE)), F.lit(0))
    target = F.greatest(F.lit(depth), F.ceil(F.sum(sampled).over(of_key) / F.lit(MAX_SEGMENTS)))
    cut = (
        counted.select(*keys, "_at", before.alias("_before"), target.alias("_target"), F.sum("_rows").over(of_key).alias("_total"))
        .filter((F.col("_total") > split.max_rows) & F.col("_at").isNotNull())
        .groupBy(*keys, segment_of(F.col("_before"), F.col("_target")).alias("_nth"))
        .agg(F.min("_at").alias("_at"))
    )
    first = F.when(F.col("_nth") > 0, F.col("_at")).otherwise(F.lit(_LOWEST))
    return cut.groupBy(*keys).agg(F.sort_array(F.collect_list(first)).alias("_bounds"))


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    *,
    previous: Mapping[str, Column] | None = None,
    last_before: Mapping[str, Column] | None = None,
    last_up_to: Mapping[str, Column] | None = None,
    running_sum: Mapping[str, Column] | None = None,
    running_max: Mapping[str, Column] | None = None,
    ties: Sequence[str] = (),
    split: Split | None = SPLIT,
) -> DataFrame:
    """Add ordered columns to `df`; `order` must be an integer column without nulls.

    previous      value on the row just before (null there stays null)
    last_before   newest non-null value strictly before the row
    last_up_to    newest non-null value up to and including the row
    running_sum   sum up to and including the row, nulls skipped
    running_max   maximum up to and including the row, nulls skipped

    `ties` orders rows of equal `order`. `split=None` uses plain windows, for keys of proven small size. When several
    scans run over the same keys and axis, `with_segments` places the rows first; the scans then share one exchange and
    one sort.
    """
    previous, last_before, last_up_to = dict(previous or {}), dict(last_before or {}), dict(last_up_to or {})
    running_sum, running_max = dict(running_sum or {}), dict(running_max or {})
    keys = list(keys)

    if split is None:
        rows, row_window = df, Window.partitionBy(*keys).orderBy(order, *ties)
    else:
        rows = df if SEGMENT in df.columns else with_segments(df, keys, order, split)
        row_window = Window.partitionBy(*keys, SEGMENT).orderBy(order, *ties)
    before, up_to = row_window.rowsBetween(*_BEFORE), row_window.rowsBetween(*_UP_TO)

    local = {alias: F.lag(value).over(row_window) for alias, value in previous.items()}
    local |= {alias: F.last(value, ignorenulls=True).over(before) for alias, value in last_before.items()}
    local |= {alias: F.last(value, ignorenulls=True).over(up_to) for alias, value in last_up_to.items()}
    local |= {alias: F.sum(value).over(up_to) for alias, value in running_sum.items()}
    local |= {alias: F.max(value).over(up_to) for alias, value in running_max.items()}
    if split is None:
        return rows.select(*df.columns, *[value.alias(alias) for alias, value in local.items()])

    # The filter is on a partitioning column, so Spark moves it below the windows of an earlier scan: only rows of cut
    # keys are read for the summaries.
    cut = rows.filter(F.col(SEGMENT) > 0)
    inherited = _inherited(cut, keys, order, ties, previous, {**last_before, **last_up_to}, running_sum, running_max)
    windowed = rows.withColumns({**local, "_row": F.row_number().over(row_window)})
    joined = windowed.join(inherited, [*keys, SEGMENT], "left")

    merged = {a: F.when(F.col("_row") == 1, F.col(_in(a))).otherwise(F.col(a)) for a in previous}
    merged |= {a: F.coalesce(F.col(a), F.col(_in(a))) for a in [*last_before, *last_up_to]}
    merged |= {a: F.coalesce(F.col(a) + F.col(_in(a)), F.col(a), F.col(_in(a))) for a in running_sum}
    merged |= {a: F.greatest(F.col(a), F.col(_in(a))) for a in running_max}
    return joined.select(*df.columns, *[value.alias(alias) for alias, value in merged.items()])


def with_segments(df: DataFrame, keys: Sequence[str], order: str, split: Split = SPLIT) -> DataFrame:
    """Add the segment of each row: 1 and up along the axis of a cut key, 0 for all rows of a key that stays whole."""
    placed = df.join(F.broadcast(hot_keys(df, keys, order, split)), list(keys), "left")
    # Binary search for the number of bounds up to the row; beyond their end `get` is null and the step is not taken.
    steps = F.array(*[F.lit(MAX_SEGMENTS >> i) for i in range(MAX_SEGMENTS.bit_length())])
    further = lambda reached, step: F.get("_bounds", reached + step - 1) <= F.col(order)
    search = F.aggregate(steps, F.lit(0), lambda n, step: F.when(further(n, step), n + step).otherwise(n))
    return placed.withColumn(SEGMENT, F.when(F.col("_bounds").isNotNull(), search).otherwise(F.lit(0))).drop("_bounds")


def segment_of(order: Column, width: int | Column) -> Column:
    """Integer division, which stays exact for numbers that a double cannot hold."""
    length = width if isinstance(width, Column) else F.lit(width).cast("bigint")
    return F.call_function("div", order.cast("bigint"), length)


def _in(alias: str) -> str:
    return f"_in_{alias}"


def _inherited(df, keys, order, ties, previous, last, sums, maxima) -> DataFrame:
    """What each segment takes over from all earlier segments of its key."""
    # A single long order keeps the aggregation buffers fixed-width, which keeps it a hash aggregate.
    position = F.struct(order, *ties) if ties else F.col(order)
    summary = {a: F.max_by(v, position) for a, v in previous.items()}
    summary |= {a: F.max_by(v, F.when(v.isNotNull(), position)) for a, v in last.items()}
    summary |= {a: F.sum(v) for a, v in sums.items()}
    summary |= {a: F.max(v) for a, v in maxima.items()}
    segments = df.groupBy(*keys, SEGMENT).agg(*[v.alias(a) for a, v in summary.items()])

    window = Window.partitionBy(*keys).orderBy(SEGMENT)
    earlier = window.rowsBetween(*_BEFORE)
    taken = {a: F.lag(a).over(window) for a in previous}
    taken |= {a: F.last(a, ignorenulls=True).over(earlier) for a in last}
    taken |= {a: F.sum(a).over(earlier) for a in sums}
    taken |= {a: F.max(a).over(earlier) for a in maxima}
    return segments.select(*keys, SEGMENT, *[v.alias(_in(a)) for a, v in taken.items()])


def with_previous_adjacent(
    df: DataFrame, keys: Sequence[str], ordinal: str, previous: Mapping[str, Column], width: int | None = ADJACENT_WIDTH
) -> DataFrame:
    """Values of the key's row at exactly `ordinal - 1`, null when the key has no such row; ordinals are unique per key.

    Only the direct neighbour matters, so each segment's last position is copied into the next segment (one row in
    `width`) instead of being joined back; the copies are dropped again after the window.
    """
    if width is None:
        rows, group = df.withColumn("_copy", F.lit(False)), list(keys)
    else:
        home = segment_of(F.col(ordinal), width)
        follower = segment_of(F.col(ordinal) + 1, width)
        rows = (
            df.withColumn("_home", home)
            .withColumn(SEGMENT, F.explode(F.array_distinct(F.array(home, follower))))
            .withColumn("_copy", F.col(SEGMENT) != F.col("_home"))
        )
        group = [*keys, SEGMENT]
    window = Window.partitionBy(*group).orderBy(ordinal)
    adjacent = F.lag(ordinal).over(window) == F.col(ordinal) - 1
    found = {alias: F.when(adjacent, F.lag(value).over(window)) for alias, value in previous.items()}
    return rows.withColumns(found).filter(~F.col("_copy")).select(*df.columns, *previous)


def poll_ordinals(
    df: DataFrame, split: Split | None = SPLIT, key: str = "app_id", order: str = "poll_seq"
) -> DataFrame:
    """Dense poll number per application, computed on the distinct polls only."""
    polls = df.select(key, order).distinct()
    return ordered_scan(polls, [key], order, running_sum={"poll_ord": F.lit(1).cast("bigint")}, split=split)


def with_poll_ordinal(df: DataFrame, split: Split | None = SPLIT) -> DataFrame:
    return df.join(poll_ordinals(df, split), ["app_id", "poll_seq"])
