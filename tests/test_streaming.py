import pytest
from pyspark.sql import functions as F

from fleetpulse.operators import history as H
from fleetpulse.operators import rollups
from fleetpulse.operators import rows as R
from fleetpulse.schemas import EXECUTOR, PROCESS_CPU, SAMPLES
from fleetpulse.sources import history_store, snapshots
from fleetpulse.streaming import counters, deltas, recording

from test_rows import PROCESS

KEYS = ["app_id", "executor_id", "poll_seq"]
CUTS = [(0, 200), (200, 201), (201, 500), (500, 10**9)]


class Feed:
    """Feeds parts of a table to a stream, one run per part, restarting from the checkpoint each time."""

    def __init__(self, spark, root, schema):
        self.spark, self.root, self.schema = spark, str(root), schema

    def step(self, part, start):
        part.write.mode("append").parquet(f"{self.root}/in")
        start(self.spark.readStream.schema(self.schema).parquet(f"{self.root}/in")).awaitTermination()

    def rows(self, parts, build):
        for part in parts:
            self.step(part, lambda s: counters.write_rows(build(s), f"{self.root}/out", f"{self.root}/cp", availableNow=True))
        return self.spark.read.parquet(f"{self.root}/out")

    def updates(self, parts, build, keys):
        for part in parts:
            self.step(part, lambda s: counters.write_updates(build(s), f"{self.root}/out", f"{self.root}/cp", availableNow=True))
        return counters.read_updates(self.spark, f"{self.root}/out", keys)


def same(a, b):
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    order = lambda df: sorted(df.select(*columns).collect(), key=str)
    assert order(a) == order(b)


def cuts(table):
    return [table.filter(F.col("poll_seq").between(low, high - 1)) for low, high in CUTS]


def test_stream_deltas_equal_the_batch(spark, derived, tmp_path):
    found = Feed(spark, tmp_path, SAMPLES).rows(cuts(derived), deltas.live_rows)
    same(found, R.executor_rows(derived))


def test_unhealthy_alerts(spark, derived, tmp_path):
    found = Feed(spark, tmp_path, SAMPLES).rows(cuts(derived), lambda s: deltas.unhealthy_alerts(s).select(*KEYS))
    same(found, R.executor_rows(derived).filter("is_unhealthy").select(*KEYS))


def test_old_samples_have_no_deltas_and_repeats_are_ignored(spark, samples, tmp_path):
    row = lambda poll, gc: {"poll_seq": poll, "total_gc_ms": gc}
    parts = [samples(row(2, 20), row(1, 10)), samples(row(2, 99), row(1, 98), row(3, 50), row(3, 50)), samples(row(5, None)), samples(row(6, 55))]
    found = Feed(spark, tmp_path, SAMPLES).rows(parts, lambda s: deltas.stream_deltas(s).select("poll_seq", "gc_delta_ms"))
    assert sorted(tuple(r) for r in found.collect() if r.gc_delta_ms is not None) == [(2, 10), (3, 30), (6, 5)]
    # poll 1 comes once more after poll 2 was seen; the repeats of polls 2 and 3 do not
    assert sorted(r.poll_seq for r in found.collect()) == [1, 1, 2, 3, 5, 6]


def test_idle_state_expires(spark, samples, tmp_path):
    hour = 3_600_000
    row = lambda poll, gc, e="1": {"poll_seq": poll, "total_gc_ms": gc, "wall_ms": poll * hour, "executor_id": e}
    parts = [samples(row(1, 10)), samples(row(40, 1, "2")), samples(row(41, 1, "2")), samples(row(42, 30))]
    build = lambda s: deltas.stream_deltas(s, idle_ms=10 * hour).select("executor_id", "poll_seq", "gc_delta_ms")
    found = {(r.executor_id, r.poll_seq): r.gc_delta_ms for r in Feed(spark, tmp_path, SAMPLES).rows(parts, build).collect()}
    assert found == {("1", 1): None, ("2", 40): None, ("2", 41): 0, ("1", 42): None}


def test_clocks_hours_apart_lose_no_samples(spark, samples, tmp_path):
    hour = 3_600_000
    row = lambda app, poll, at, gc: {"app_id": app, "poll_seq": poll, "wall_ms": at * hour, "total_gc_ms": gc}
    parts = [samples(row("a", p, 100 + p, 10 * p), row("b", p, p, 7 * p)) for p in (1, 2, 3)] + [samples(row("b", 1, 1, 7))]
    build = lambda s: deltas.stream_deltas(s).select("app_id", "poll_seq", "gc_delta_ms")
    found = sorted(((r.app_id, r.poll_seq, r.gc_delta_ms) for r in Feed(spark, tmp_path, SAMPLES).rows(parts, build).collect()), key=str)
    late = ("b", 1, None)
    assert found == sorted([("a", 1, None), ("a", 2, 10), ("a", 3, 10), late, ("b", 2, 7), ("b", 3, 7), late], key=str)


def test_process_samples_of_clocks_hours_apart(spark, tmp_path):
    hour = 3_600_000
    rows = [(a, "1", n, n * 10**9, n * 10**8, 1, (at + n) * hour) for n in (1, 2, 3) for a, at in (("a", 100), ("b", 0))]
    table = spark.createDataFrame(rows, "app_id string, executor_id string, sample_seq long, wall_ns long, cpu_ns long, cores int, at_ms long")
    parts = [table.filter(f"sample_seq = {n}") for n in (1, 2, 3)]
    found = Feed(spark, tmp_path, table.schema).rows(parts, lambda s: deltas.stream_process_cpu(s, "at_ms"))
    assert sorted((r.app_id, r.sample_seq, r.cpu_pct) for r in found.filter("sample_seq > 1").collect()) == [(a, n, 10.0) for a in "ab" for n in (2, 3)]


@pytest.mark.parametrize("timed", [False, True])
def test_process_cpu_stream(spark, tmp_path, timed):
    table = spark.createDataFrame([("a", "1", s, w, c, 2) for s, w, c, _ in PROCESS], PROCESS_CPU)
    table = table.withColumn("at_ms", F.lit(10**12) + F.col("sample_seq") * 1000)
    parts = [table.filter(f"sample_seq between {low} and {high}") for low, high in ((1, 2), (3, 4), (5, 9))]
    build = lambda s: deltas.stream_process_cpu(s, "at_ms" if timed else None)
    found = Feed(spark, tmp_path, table.schema).rows(parts, build)
    same(found, R.process_cpu_pct(table.drop("at_ms")).withColumn("cpu_ns", F.when(F.col("cpu_ns") >= 0, F.col("cpu_ns"))))


def test_running_totals_and_latest(spark, tmp_path):
    ends = spark.createDataFrame(
        [("a", "1", i, 400_000) for i in range(10)] + [("a", "2", 3, 5_000_000), ("a", None, 4, 9), ("a", "2", 9, None)],
        "app_id string, executor_id string, n bigint, cpu_ns bigint",
    )
    parts = [ends.filter("n < 4"), ends.filter("n >= 4")]
    found = Feed(spark, tmp_path / "t", ends.schema).updates(parts, counters.running_cpu_totals, EXECUTOR)
    same(found, rollups.cpu_totals(ends))
    published = spark.createDataFrame(
        [("a", "1", 5, 1.0), ("a", "2", 1, 2.0), ("a", "1", 3, 3.0), ("a", "2", 9, 4.0)],
        "app_id string, executor_id string, sample_seq bigint, cpu_pct double",
    )
    parts = [published.filter("cpu_pct < 3"), published.filter("cpu_pct >= 3")]
    found = Feed(spark, tmp_path / "l", published.schema).updates(parts, counters.running_latest_cpu, EXECUTOR)
    assert {(r.executor_id, r.cpu_pct) for r in found.collect()} == {("1", 1.0), ("2", 4.0)}


def test_snapshot_stream(spark, derived, tmp_path):
    path, root = str(tmp_path / "json"), str(tmp_path)
    snapshots.write_snapshots(derived, path)
    stream = counters.stateless_rows(snapshots.stream_snapshots(spark, path, max_files=1)).select(*KEYS, "heap_pct")
    counters.write_rows(stream, f"{root}/out", f"{root}/cp", availableNow=True).awaitTermination()
    same(spark.read.parquet(f"{root}/out"), R.executor_rows(derived).select(*KEYS, "heap_pct"))


def test_recorded_once(spark, samples, tmp_path):
    first = samples({"poll_seq": 0}, {"poll_seq": 1}, {"poll_seq": 1}, {"poll_seq": 1, "executor_id": "2"})
    late = {"poll_seq": 2, "wall_ms": 1}
    parts = [first, samples({"poll_seq": 1}, {"poll_seq": 900, "wall_ms": 4_000_000}), samples({"poll_seq": 901, "wall_ms": 4_000_001}, late)]
    found = Feed(spark, tmp_path, SAMPLES).rows(parts, lambda s: recording.recorded_once(s).select("poll_seq", "executor_id"))
    # the repeats of poll 1 are dropped; the sample that is over an hour old when it first comes is kept
    assert sorted(tuple(r) for r in found.collect()) == [(1, "1"), (1, "2"), (2, "1"), (900, "1"), (901, "1")]


def test_recording_once_with_clocks_days_apart(spark, samples, tmp_path):
    day = 24 * 3_600_000
    row = lambda app, poll, start: {"app_id": app, "poll_seq": poll, "wall_ms": start + poll * 5000}
    step = lambda *polls: samples(*(row(app, poll, start) for poll in polls for app, start in (("ahead", 9 * day), ("behind", 0))))
    found = Feed(spark, tmp_path, SAMPLES).rows([step(1, 2), step(2, 4), step(3, 1)], lambda s: recording.recorded_once(s).select("app_id", "poll_seq"))
    assert sorted(tuple(r) for r in found.collect()) == [(app, poll) for app in ("ahead", "behind") for poll in (1, 2, 3, 4)]


def test_bounded_history_stream(spark, derived, tmp_path):
    feed, root = Feed(spark, tmp_path, SAMPLES), str(tmp_path)
    bounds = {"max_rows": 150, "max_age_ms": 40 * 60 * 1000}

    def start(stream):
        recorded = H.to_history(deltas.live_rows(stream))
        return recording.record_stream(recorded, f"{root}/history", f"{root}/cp", {"availableNow": True})

    for part in cuts(derived):
        feed.step(part, start)
    history = H.to_history(R.executor_rows(derived))
    expected = H.conform(H.bounded_by_own_clock(history, **bounds))
    same(history_store.restore_by_own_clock(spark, f"{root}/history", **bounds), expected)
    history_store.compact(spark, f"{root}/history", **bounds)
    same(history_store.read(spark, f"{root}/history"), expected)


def test_clocks_of_applications_are_their_own(spark, samples, tmp_path):
    day = 24 * 3_600_000
    rows = R.executor_rows(samples({"poll_seq": 1, "wall_ms": 0}, {"poll_seq": 1, "wall_ms": 0, "app_id": "b"}))
    more = R.executor_rows(samples({"poll_seq": 2, "wall_ms": 11 * day}, {"poll_seq": 2, "wall_ms": 5000, "app_id": "b"}))
    merge = recording.record_new(f"{tmp_path}/history")
    merge(H.to_history(rows), 0)
    merge(H.to_history(more), 1)
    stored = history_store.restore_by_own_clock(spark, f"{tmp_path}/history", max_age_ms=3_600_000)
    assert sorted((r.appId, r.pollSeq) for r in stored.collect()) == [("app", 2), ("b", 1), ("b", 2)]


def test_a_batch_that_died_while_writing_loses_nothing(spark, samples, tmp_path, monkeypatch):
    first, second = (H.to_history(R.executor_rows(samples({"poll_seq": p}))) for p in (1, 2))
    path = f"{tmp_path}/history"
    recording.record_new(path)(first, 0)

    def die(rows, path):
        raise RuntimeError("executor lost")

    with monkeypatch.context() as patched:
        patched.setattr(history_store, "append", die)
        with pytest.raises(RuntimeError):
            recording.record_new(path)(second, 1)
    recording.record_new(path)(second, 1)
    assert sorted(r.pollSeq for r in history_store.read(spark, path).collect()) == [1, 2]


def test_a_repeated_batch_changes_nothing_and_stored_rows_win(spark, derived, tmp_path):
    batch, path = H.to_history(R.executor_rows(derived.filter("poll_seq < 300"))), f"{tmp_path}/history"
    merge = recording.record_new(path)
    merge(batch, 0)
    before = history_store.read(spark, path)
    rows = sorted(map(tuple, before.collect()), key=str)
    merge(batch.unionByName(batch), 0)
    merge(batch.withColumns({"gcDeltaMs": F.lit(None).cast("bigint"), "heapMB": F.lit(-1.0)}), 1)
    assert rows == sorted(map(tuple, history_store.read(spark, path).collect()), key=str)
    assert len(rows) == batch.select("appId", "pollSeq", "executor").distinct().count()


def test_batches_without_adaptive_execution_write_few_files(spark, samples, tmp_path, monkeypatch):
    # Streams with state turn adaptive execution off, and with it the rebalance hint.
    rows = samples(*({"app_id": f"a{i % 40}", "executor_id": str(i % 3), "poll_seq": 1 + i // 40} for i in range(1200)))
    batch, path = H.to_history(R.executor_rows(rows)), f"{tmp_path}/history"
    kept = {name: spark.conf.get(name) for name in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        recording.record_new(path)(batch, 0)
    finally:
        for name, value in kept.items():
            spark.conf.set(name, value)
    stored = history_store.versioned(spark, path)
    places = stored.select("bucket", "day").distinct().count()
    assert len(list((tmp_path / "history").rglob("*.parquet"))) <= places + 16
    assert stored.count() == 1200
    # A batch without rows, as streams run to drop old state, reads nothing of the store.
    monkeypatch.setattr(history_store, "versioned", None)
    recording.record_new(path)(batch.filter("false"), 1)
