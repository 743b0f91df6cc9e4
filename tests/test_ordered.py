import random

import pytest
from pyspark.sql import functions as F

from fleetpulse.operators.joins import spread_join
from fleetpulse.operators.ordered import MAX_SEGMENTS, SEGMENT, SPLIT, Split, hot_keys, ordered_scan, poll_ordinals, with_previous_adjacent, with_segments
from fleetpulse.operators.ranking import last_polls, newest_rows, top_per_group


from conftest import SPLITS


@pytest.fixture(scope="module")
def data():
    """A hot key with most rows, some small keys, gaps in the order, and nulls."""
    rng = random.Random(11)
    rows = []
    for key, count in (("hot", 400), ("b", 40), ("c", 1), ("d", 7)):
        for order in sorted(rng.sample(range(-200, 2000), count)):
            rows.append((key, order, rng.choice([None, rng.randrange(100)])))
    rng.shuffle(rows)
    return rows


def expected_scan(rows):
    result = {}
    for key in {r[0] for r in rows}:
        prev = last = total = peak = None
        for _, order, value in sorted(r for r in rows if r[0] == key):
            before = last
            if value is not None:
                last, total, peak = value, (total or 0) + value, value if peak is None else max(peak, value)
            result[key, order] = (prev, before, last, total, peak)
            prev = value
    return result


@pytest.mark.parametrize("split", [None, Split(0, 1), Split(0, 7), Split(30, 10), Split(100, 300), SPLIT])
def test_scan_equals_a_loop(spark, data, split):
    df = spark.createDataFrame(data, "k string, o bigint, v bigint")
    v = F.col("v")
    found = ordered_scan(
        df,
        ["k"],
        "o",
        previous={"p": v},
        last_before={"lb": v},
        last_up_to={"lu": v},
        running_sum={"s": v},
        running_max={"m": v},
        split=split,
    )
    assert found.columns == ["k", "o", "v", "p", "lb", "lu", "s", "m"]
    assert {(r.k, r.o): tuple(r)[3:] for r in found.collect()} == expected_scan(data)


def test_only_large_keys_are_cut(spark, data):
    df = spark.createDataFrame(data, "k string, o bigint, v bigint")
    found = {r.k: r["_bounds"] for r in hot_keys(df, ["k"], "o", Split(39, 10)).collect()}
    mine = {k: sorted(r[1] for r in data if r[0] == k) for k in ("hot", "b")}
    # targets this small take every position, so the depths are exact
    assert found == {k: [-(2**63), *o[10::10]] for k, o in mine.items()}
    assert hot_keys(df, ["k"], "o").count() == 0


@pytest.mark.parametrize("shape", ["one far outlier", "dense ends", "growing gaps", "repeated positions"])
@pytest.mark.parametrize("target", [50, 640, 2000])
def test_segments_have_equal_depth_on_uneven_axes(spark, shape, target):
    n = 20_000  # a third of all rows in one key
    order = {
        "one far outlier": F.when(F.col("id") == n - 1, F.lit(1 << 60)).otherwise(F.col("id")),
        "dense ends": F.when(F.col("id") < n // 2, F.col("id")).otherwise(F.col("id") + (1 << 50)),
        "growing gaps": F.col("id") * F.col("id") * F.col("id") - (1 << 40),
        "repeated positions": F.expr("id div 5") - 7,
    }[shape]
    hot = spark.range(n).select(F.lit("hot").alias("k"), order.alias("o"))
    small = spark.range(2 * n).select(F.format_string("small %d", F.col("id") % 80).alias("k"), F.col("id").alias("o"))
    sizes = with_segments(hot.unionByName(small), ["k"], "o", Split(1000, target)).groupBy("k", SEGMENT).count().collect()
    cut = [r["count"] for r in sizes if r.k == "hot"]
    assert sum(cut) == n and max(cut) < 2 * target and len(cut) < 2 * n / target + 1
    assert {r[SEGMENT] for r in sizes if r.k == "hot"} == set(range(1, len(cut) + 1))
    assert all(r[SEGMENT] == 0 for r in sizes if r.k != "hot")


def test_a_key_has_a_bounded_number_of_segments(spark):
    sizes = with_segments(spark.range(20_000).withColumn("k", F.lit(1)), ["k"], "id", Split(5, 2)).groupBy(SEGMENT).count().collect()
    assert 1024 < len(sizes) <= MAX_SEGMENTS and max(r["count"] for r in sizes) == -(-20_000 // MAX_SEGMENTS)


def test_rows_of_one_position_stay_together(spark):
    df = spark.createDataFrame([("k", o, v) for o in (1, 2, 3) for v in range(40)], "k string, o bigint, v bigint")
    found = with_segments(df, ["k"], "o", Split(10, 10)).groupBy("o").agg(F.collect_set(SEGMENT).alias("s")).collect()
    assert {r.o: r.s for r in found} == {1: [1], 2: [2], 3: [3]}


def test_scan_over_an_axis_with_an_outlier(spark):
    rows = [("k", o, o) for o in (*range(60), 2**62, -(2**62))]
    df = spark.createDataFrame(rows, "k string, o bigint, v bigint")
    found = ordered_scan(df, ["k"], "o", previous={"p": F.col("v")}, running_max={"m": F.col("v")}, split=Split(5, 4)).collect()
    axis = sorted(r[1] for r in rows)
    assert {r.o: (r.p, r.m) for r in found} == {o: (None if i == 0 else axis[i - 1], o) for i, o in enumerate(axis)}


def test_scan_takes_null_keys(spark):
    rows = [(None, 1, 5), (None, 2, 6)] + [("k", i, i) for i in range(9)]
    df = spark.createDataFrame(rows, "k string, o bigint, v bigint")
    found = ordered_scan(df, ["k"], "o", running_sum={"s": F.col("v")}, split=Split(1, 2))
    assert {(r.k, r.o): r.s for r in found.collect()} == {(None, 1): 5, (None, 2): 11, **{("k", i): i * (i + 1) // 2 for i in range(9)}}


@pytest.mark.parametrize("split", [Split(0, 5), Split(20, 9), SPLIT])
def test_scans_share_one_placement(spark, data, split):
    df = spark.createDataFrame(data, "k string, o bigint, v bigint")
    placed = with_segments(df, ["k"], "o", split)
    first = ordered_scan(placed, ["k"], "o", running_sum={"s": F.col("v")})
    both = ordered_scan(first, ["k"], "o", previous={"p": F.col("s")})
    sums = {key: value[3] for key, value in expected_scan(data).items()}
    last = {}
    for key in sorted(sums):
        last[key] = (sums[key], last.get(key[0]))
        last[key[0]] = sums[key]
    assert {(r.k, r.o): (r.s, r.p) for r in both.collect()} == {k: v for k, v in last.items() if isinstance(k, tuple)}
    row_side = both._jdf.queryExecution().executedPlan().toString().split("_in_p")[0]
    assert row_side.count("Exchange hashpartitioning") <= 1


@pytest.mark.parametrize("split", [Split(0, 1), Split(0, 5), SPLIT])
def test_scan_with_ties(spark, split):
    rows = [("k", t, side, t * 10 if side == 0 else None) for t in range(12) for side in (0, 1)]
    df = spark.createDataFrame(rows, "k string, o bigint, side int, v bigint")
    found = ordered_scan(
        df, ["k"], "o", previous={"p": F.col("side")}, last_up_to={"l": F.col("v")}, ties=["side"], split=split
    )
    seen = {(r.o, r.side): (r.p, r.l) for r in found.collect()}
    assert all(seen[t, 1] == (0, t * 10) for t in range(12))
    assert all(seen[t, 0] == (None if t == 0 else 1, t * 10) for t in range(12))


@pytest.mark.parametrize("width", [None, 1, 4, 1000])
def test_adjacent_only(spark, width):
    rows = [("k", o, o * 2) for o in (1, 2, 3, 5, 8, 9, 12)] + [("j", 4, 1), ("j", 5, 2)]
    df = spark.createDataFrame(rows, "k string, o bigint, v bigint")
    found = with_previous_adjacent(df, ["k"], "o", {"p": F.col("v")}, width)
    seen = {(r.k, r.o): r.p for r in found.collect()}
    expected = {("k", o): (o - 1) * 2 if o in (2, 3, 9) else None for o in (1, 2, 3, 5, 8, 9, 12)}
    assert seen == {**expected, ("j", 4): None, ("j", 5): 1}


@pytest.mark.parametrize("split", SPLITS)
def test_poll_ordinals_are_dense(spark, split):
    polls = {"a": [3, 9, 10, 40], "b": [1, 2]}
    rows = [(app, p, e) for app, ps in polls.items() for p in ps for e in ("1", "2")]
    df = spark.createDataFrame(rows, "app_id string, poll_seq bigint, executor_id string")
    found = {(r.app_id, r.poll_seq): r.poll_ord for r in poll_ordinals(df, split).collect()}
    assert found == {(app, p): i + 1 for app, ps in polls.items() for i, p in enumerate(ps)}


@pytest.mark.parametrize("n", [1, 5, 37, 1000])
@pytest.mark.parametrize("width", [1, 16, 5000])
def test_newest_rows(spark, data, n, width):
    df = spark.createDataFrame(data, "k string, o bigint, v bigint")
    found = {(r.k, r.o) for r in newest_rows(df, ["k"], "o", n, width=width).collect()}
    expected = set()
    for key in {r[0] for r in data}:
        expected |= {(key, o) for o in sorted((r[1] for r in data if r[0] == key), reverse=True)[:n]}
    assert found == expected


def test_newest_rows_keeps_null_keys_and_null_orders(spark):
    df = spark.createDataFrame([(None, 5), ("k", None), ("k", 1)], "k string, o bigint")
    assert newest_rows(df, ["k"], "o", 10).count() == 3
    assert {(r.k, r.o) for r in newest_rows(df, ["k"], "o", 1).collect()} == {(None, 5), ("k", 1)}


def test_newest_rows_breaks_ties(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 1, "b"), ("k", 0, "c")], "k string, o bigint, t string")
    assert [r.t for r in newest_rows(df, ["k"], "o", 1, ties=["t"]).collect()] == ["b"]


def test_top_per_group(spark, data):
    df = spark.createDataFrame(data, "k string, o bigint, v bigint")
    found = top_per_group(df, ["k"], [F.desc_nulls_last("v"), F.asc("o")], 3, rank="r").collect()
    for key in {r[0] for r in data}:
        mine = sorted((r for r in data if r[0] == key), key=lambda r: (-(r[2] if r[2] is not None else -1), r[1]))[:3]
        assert [(r.o, r.r) for r in sorted(found, key=lambda r: r.r) if r.k == key] == [(m[1], i + 1) for i, m in enumerate(mine)]


def test_last_polls_use_the_application_axis(spark):
    rows = [("a", p, "1") for p in (1, 2, 3, 4)] + [("a", p, "2") for p in (1, 2)] + [("b", 1, "1")]
    df = spark.createDataFrame(rows, "app_id string, poll_seq bigint, executor_id string")
    found = {tuple(r) for r in last_polls(df, 3).select("app_id", "poll_seq", "executor_id").collect()}
    assert found == {("a", 2, "1"), ("a", 3, "1"), ("a", 4, "1"), ("a", 2, "2"), ("b", 1, "1")}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("broadcast_limit", ["-1", "10485760"])
def test_spread_join_equals_a_plain_join(spark, data, how, broadcast_limit):
    left = spark.createDataFrame(data, "k string, o bigint, v bigint")
    right = spark.createDataFrame([("hot", 1), ("c", 2), ("x", 3)], "k string, w int")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast_limit)
    try:
        found = spread_join(left, right, ["k"], how, spread=["o"]).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    plain = left.join(right, ["k"], how)
    assert sorted(map(str, found)) == sorted(map(str, plain.collect()))
    with pytest.raises(ValueError):
        spread_join(left, right, ["k"], "full")
