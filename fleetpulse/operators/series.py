"""Chart series: gap-filled grid, stacked memory bands, legend text and point lookup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.functions import memory
from fleetpulse.functions.numbers import fixed, mb
from fleetpulse.functions.tasks import chart_cpu_pct, saturation_pct, task_capacity
from fleetpulse.functions.text import mb_text, short_id
from fleetpulse.operators.joins import spread_join
from fleetpulse.operators.ordered import SPLIT, Split, poll_ordinals
from fleetpulse.operators.ranking import last_polls
from fleetpulse.operators.rows import active_only, with_deltas
from fleetpulse.schemas import EXECUTOR
from fleetpulse.settings import LIVE_WINDOW_POINTS, SERIES_CPU_CLIP

# Fixed value: the eight series kept per executor.
SERIES = ["heap", "overhead", "off_heap", "total", "rss", "gc_delta", "saturation", "cpu"]

# Fixed value: memory metrics that can be charted; heap is charted when none is chosen.
MEMORY_METRICS = ["heap", "overhead", "off_heap", "total", "native_other"]
DEFAULT_MEMORY_METRICS = ("heap",)

_BANDS = [("heap", "H"), ("overhead", "O"), ("off_heap", "F")]


def series_points(samples: DataFrame, split: Split | None = SPLIT) -> DataFrame:
    """Chart values per live sample, rounded for display."""
    live = with_deltas(active_only(samples), split)
    capacity = task_capacity(F.col("max_tasks"), F.col("total_cores"))
    raw = live.select(
        *EXECUTOR,
        "poll_seq",
        mb(memory.heap_bytes(F.col("peak_jvm_heap"), F.col("cur_jvm_heap"))).alias("heap"),
        mb(F.col("peak_jvm_off_heap")).alias("overhead"),
        mb(F.col("peak_off_heap_unified")).alias("off_heap"),
        mb(F.col("rss")).alias("rss"),
        F.col("gc_delta_ms").cast("double").alias("gc_delta"),
        saturation_pct(F.col("active_tasks"), capacity).alias("saturation"),
        chart_cpu_pct(F.col("cpu_pct"), SERIES_CPU_CLIP).alias("cpu"),
    ).withColumn("total", memory.estimated_total(F.col("heap"), F.col("overhead"), F.col("off_heap")))
    digits = {name: 1 if name == "gc_delta" else 2 for name in SERIES}
    return raw.select(*EXECUTOR, "poll_seq", *[fixed(F.col(name), digits[name]).alias(name) for name in SERIES])


def gap_filled(
    points: DataFrame,
    polls: DataFrame,
    executors: DataFrame | None = None,
    columns: Sequence[str] = SERIES,
    split: Split | None = SPLIT,
) -> DataFrame:
    """One row per (executor, poll of its application), null where the executor has no sample.

    `polls` holds the poll axis (app_id, poll_seq); points off the axis are dropped. Axis positions are consecutive
    numbers, so each executor produces its own positions from the application's point count, and the samples arrive
    by an equi-join. `executors` defaults to those that have a point.
    """
    axis = poll_ordinals(polls, split)
    length = axis.groupBy("app_id").agg(F.max("poll_ord").alias("_points"))
    known = (points if executors is None else executors).select(*EXECUTOR).distinct()
    grid = spread_join(known, length, ["app_id"], spread=["executor_id"]).select(
        *EXECUTOR, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_points"))).alias("poll_ord")
    )
    placed = points.join(axis, ["app_id", "poll_seq"]).select(*EXECUTOR, "poll_ord", *columns)
    return grid.join(placed, [*EXECUTOR, "poll_ord"], "left")


def live_grid(
    samples: DataFrame, max_points: int = LIVE_WINDOW_POINTS, split: Split | None = SPLIT
) -> DataFrame:
    """Gap-filled series over each application's last `max_points` polls.

    Executors whose samples all lie before the window stay known and get an all-null series.
    """
    window = last_polls(samples.select("app_id", "poll_seq").distinct(), max_points)
    return gap_filled(series_points(samples, split), window, active_only(samples), split=split)


def memory_metric_choice(metrics: Sequence[str] = ()) -> list[str]:
    unknown = set(metrics) - set(MEMORY_METRICS)
    if unknown:
        raise ValueError(f"unknown memory metrics: {sorted(unknown)}")
    return [m for m in MEMORY_METRICS if m in metrics] or list(DEFAULT_MEMORY_METRICS)


def unpivot_metrics(rows: DataFrame, ids: Sequence[str], metrics: Sequence[str] = ()) -> DataFrame:
    """Long form of the chosen memory metrics; heap alone when none is chosen."""
    return rows.unpivot(list(ids), memory_metric_choice(metrics), "metric", "value")


def visible_series(points: DataFrame, columns: Sequence[str] = SERIES) -> DataFrame:
    """(executor, metric) pairs with at least one value."""
    counts = points.groupBy(*EXECUTOR).agg(*[F.count(c).alias(c) for c in columns])
    return counts.unpivot(EXECUTOR, list(columns), "metric", "points").filter("points > 0")


def stacked_bands(
    grid: DataFrame, metrics: Sequence[str] = MEMORY_METRICS, mode: str = "rss"
) -> DataFrame:
    """Memory chart series as rows (executor, poll_ord, series, base, upper).

    The heap, overhead and off-heap bands are stacked by their latest value, largest at the bottom, with a missing
    value leaving the running height as it is. In RSS mode the unexplained part follows as band N, and the total is a
    line. With three bands the height below a band is a sum over the bands ranked before it, so no window over the
    long form is needed; the latest values come from one window per executor, whose rows the poll axis bounds.
    """
    chosen = memory_metric_choice(metrics)
    whole = Window.partitionBy(*EXECUTOR).orderBy("poll_ord").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    total = "rss" if mode == "rss" else "total"
    col, zero = F.col, F.lit(0.0)
    bands = [(name, suffix) for name, suffix in _BANDS if name in chosen]
    wanted = {f"_latest_{name}": F.last(name, ignorenulls=True).over(whole) for name, _ in bands}
    gap = col("rss") - (F.coalesce("heap", zero) + F.coalesce("overhead", zero) + F.coalesce("off_heap", zero))
    wanted["_any_gap"] = F.max(F.coalesce(gap > 0, F.lit(False))).over(whole)
    wanted["_any_total"] = F.max(col(total).isNotNull()).over(whole)
    rows = grid.withColumns(wanted)

    def below(name: str) -> Column:
        """Known heights of the bands ranked before `name`."""
        height, passed = zero, False
        for other, _ in bands:
            if other == name:
                passed = True
                continue
            mine, theirs = col(f"_latest_{name}"), col(f"_latest_{other}")
            earlier = (theirs > mine) if passed else (theirs >= mine)
            height = height + F.when(earlier & col(other).isNotNull(), col(other)).otherwise(zero)
        return height

    def row(suffix: str, emit: Column, base: Column, upper: Column) -> Column:
        return F.when(emit, F.struct(F.lit(suffix).alias("series"), base.alias("base"), upper.alias("upper")))

    items = [
        row(suffix, col(f"_latest_{name}").isNotNull(), below(name), below(name) + col(name)) for name, suffix in bands
    ]
    stack = _stack_height(bands)
    if mode == "rss" and "native_other" in chosen:
        height = F.when(gap > 0, stack + gap).when(col("rss").isNotNull(), stack)
        items.append(row("N", col("_any_gap"), stack, height))
    if "total" in chosen:
        no_base = F.lit(None).cast("double")
        items.append(row("T(rss)" if mode == "rss" else "T", col("_any_total"), no_base, col(total)))
    return (
        rows.select(*EXECUTOR, "poll_ord", F.explode(F.array_compact(F.array(*items))).alias("item"))
        .select(*EXECUTOR, "poll_ord", "item.*")
    )


def _stack_height(bands: Sequence[tuple[str, str]]) -> Column:
    """Height of all bands at one poll, added in rank order as the bands are."""
    zero = F.lit(0.0)
    if not bands:
        return zero
    ranked = F.sort_array(
        F.array(
            *[
                F.struct(
                    -F.coalesce(F.col(f"_latest_{name}"), F.lit(float("-inf"))),
                    F.lit(i),
                    F.coalesce(F.col(name), zero).alias("height"),
                )
                for i, (name, _) in enumerate(bands)
            ]
        )
    )
    return F.aggregate(ranked, zero, lambda height, band: height + band["height"])


def series_items(bands: DataFrame) -> DataFrame:
    """Distinct series of each executor."""
    return bands.select(*EXECUTOR, "series").distinct()


def legend(latest: DataFrame, metrics: Sequence[str] = MEMORY_METRICS, mode: str = "rss") -> DataFrame:
    """Legend text per executor from the latest value of each series (`latest` has one row per executor)."""
    chosen = memory_metric_choice(metrics)
    rss_mode = mode == "rss"
    zero = F.lit(0.0)
    total = F.col("rss" if rss_mode else "total")
    parts = [F.concat(F.lit(f"{suffix} "), mb_text(F.col(name))) for name, suffix in _BANDS if name in chosen]
    if "native_other" in chosen and rss_mode:
        known = F.coalesce("heap", zero) + F.coalesce("overhead", zero) + F.coalesce("off_heap", zero)
        gap = total - known
        parts.append(F.when(gap > 0, F.concat(F.lit("N "), mb_text(gap))))
    if "total" in chosen:
        parts.append(F.concat(F.lit("T(rss) " if rss_mode else "T "), mb_text(total)))
    return latest.select(*EXECUTOR, F.concat_ws(" | ", *parts).alias("label"))


def nearest_points(bands: DataFrame, axis_points: DataFrame, probes: DataFrame) -> DataFrame:
    """Series values at positions `x` in [0, 1] of each application's axis.

    `axis_points` is (app_id, points), `probes` is (app_id, x). The nearest axis position is computed from the point
    count, so the lookup is an equi-join on (app_id, poll_ord).
    """
    last = F.col("points") - 1
    index = F.when(last <= 0, F.lit(0).cast("bigint")).otherwise(
        F.greatest(F.lit(0).cast("bigint"), F.least(last, F.floor(F.col("x") * last + F.lit(0.5))))
    )
    sized = spread_join(probes, axis_points, ["app_id"], spread=["x"])
    located = sized.select("app_id", "x", (index + 1).alias("poll_ord"))
    label = F.concat(short_id(F.col("executor_id")), F.lit(" ("), F.col("series"), F.lit(")"))
    value = F.col("upper") - F.coalesce("base", F.lit(0.0))
    return (
        bands.filter(F.col("upper").isNotNull())
        .join(located, ["app_id", "poll_ord"])
        .select("app_id", "executor_id", "series", "x", "poll_ord", label.alias("label"), value.alias("value"))
    )


def chart_values(grid: DataFrame, bands: DataFrame) -> DataFrame:
    """Values drawn in each of the four charts, as (app_id, chart, value)."""
    names = {"gc_delta": "gc", "saturation": "saturation", "cpu": "cpu"}
    plain = grid.select("app_id", *[F.col(c).alias(n) for c, n in names.items()])
    lines = plain.unpivot(["app_id"], list(names.values()), "chart", "value")
    stacked = bands.select("app_id", F.lit("memory").alias("chart"), F.col("upper").alias("value"))
    return lines.unionByName(stacked).filter(F.col("value").isNotNull())
