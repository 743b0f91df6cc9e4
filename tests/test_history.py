import json
import os

import pytest
from pyspark.sql import functions as F

from fleetpulse import Settings
from fleetpulse.operators import history as H
from fleetpulse.operators.rows import executor_rows
from fleetpulse.plans.views import range_info, range_summary, range_table
from fleetpulse.schemas import HISTORY, HISTORY_CSV_COLUMNS
from fleetpulse.sources import csv_export, history_store

NOW = 10_000_000_000


@pytest.fixture(scope="module")
def history(spark):
    def build(*rows):
        complete = []
        for i, row in enumerate(rows):
            row = {"appId": "app", "executor": "1", "pollSeq": i, "ingestSeq": i, "host": "h", **row}
            if "timeMs" in row and "timeIso" not in row:
                row["timeIso"] = f"t{row['timeMs']:015d}"
            complete.append(tuple(row.get(f.name) for f in HISTORY.fields))
        return spark.createDataFrame(complete, HISTORY)

    return build


def seqs(df):
    return sorted(r.ingestSeq for r in df.collect())


def test_record_has_the_exported_columns_in_order(samples):
    table = samples({"poll_seq": 2, "wall_ms": 1704067205007, "peak_jvm_heap": 1048576, "cur_jvm_heap": 5, "executor_id": "driver"})
    recorded = H.to_history(executor_rows(table))
    assert recorded.columns == HISTORY.fieldNames() and len(HISTORY_CSV_COLUMNS) == 32
    assert len(set(HISTORY_CSV_COLUMNS)) == 32
    row = recorded.first()
    assert (row.timeIso, row.timeLabel, row.timeMs) == ("2024-01-01T00:00:05.007Z", "00:00:05", 1704067205007)
    # no RSS: the recorded total falls back to the estimate while its source stays empty
    assert (row.totalMemoryMB, row.totalMemorySource) == (1, None)
    assert recorded.select(H.time_ms(F.col("timeIso"))).first()[0] == 1704067205007


def test_insertion_order_follows_polls(spark):
    names = ["driver", "0", "7", "16777214", "16777215", "exec-a", "-3"]
    df = spark.createDataFrame([(n, p) for p in (1, 2) for n in names], "e string, p bigint")
    found = {(r.p, r.e): r.n for r in df.withColumn("n", H.ingest_number(F.col("p"), F.col("e"))).collect()}
    assert max(v for (p, _), v in found.items() if p == 1) < min(v for (p, _), v in found.items() if p == 2)
    assert found[1, "driver"] < found[1, "0"] < found[1, "7"]


def test_unparsable_time_is_null(evaluate):
    assert evaluate(H.time_ms, [("garbage",), ("",), (None,), ("1970-01-01T00:00:00.005Z",)], "v string") == [None, None, None, 5]


def test_record_once(samples):
    rows = executor_rows(samples({"poll_seq": 0}, {"poll_seq": 1}, {"poll_seq": 1}, {"poll_seq": 1, "executor_id": "2"}))
    assert sorted((r.poll_seq, r.executor_id) for r in H.record_once(rows).collect()) == [(1, "1"), (1, "2")]
    assert H.record_once(rows, recording=False).count() == 0


def test_retention_keeps_unparsable_and_range_drops_it(history):
    df = history({"timeMs": NOW}, {"timeMs": NOW - 3_600_000}, {"timeMs": NOW - 3_600_001}, {"timeIso": "n/a"})
    assert seqs(H.within_retention(df, NOW)) == [0, 1, 3]
    assert seqs(H.in_range(df, NOW, 60)) == [0, 1]
    assert seqs(H.in_range(df, NOW, 5)) == [0]
    assert seqs(H.in_range(df, NOW, None)) == seqs(H.in_range(df, NOW, float("inf"))) == [0, 1, 2, 3]


def test_row_cap_comes_after_age(history):
    rows = [{"timeMs": NOW - 3_700_000} for _ in range(5)] + [{"timeMs": NOW} for _ in range(3)]
    rows += [{"timeMs": NOW - 3_700_000, "ingestSeq": 100 + i} for i in range(5)]
    df = history(*rows, *[{"timeMs": NOW, "appId": "other", "ingestSeq": i} for i in range(2)])
    found = H.bounded(df, NOW, max_rows=2, max_age_ms=3_600_000).collect()
    assert sorted((r.appId, r.ingestSeq) for r in found) == [("app", 6), ("app", 7), ("other", 0), ("other", 1)]


def test_last_sample_first_recorded_wins_and_is_rederived(history):
    df = history(
        {"timeIso": "b", "heapMB": 80.0, "heapMaxMB": 100.0, "rssMB": 100.0, "jvmOffHeapMB": 5.0},
        {"timeIso": "b", "heapMB": 99.0, "heapMaxMB": 100.0},
        {"timeIso": "a", "heapMB": 98.0, "heapMaxMB": 100.0},
        {"timeIso": "a", "executor": "2", "gcDeltaMs": 500},
    )
    rows = {r.executor_id: r for r in H.last_samples(df).collect()}
    assert (rows["1"].heap_pct, rows["1"].total_memory_mb, rows["1"].native_other_mb) == (80, 100, 15)
    assert rows["1"].gc_pct is None and not rows["1"].is_unhealthy
    assert rows["2"].is_unhealthy and rows["2"].heap_max_bytes == 0 and rows["2"].total_memory_source is None
    estimated = {r.executor_id: r for r in H.last_samples(df, Settings(memory_mode="estimated", warn_pct=80)).collect()}
    assert (estimated["1"].total_memory_mb, estimated["1"].native_other_mb, estimated["1"].is_unhealthy) == (85, None, True)


def test_history_grid_merges_values(history):
    df = history(
        {"timeIso": "t1", "timeLabel": "l1", "heapMB": 1.0, "rssMB": 5.0},
        {"timeIso": "t1", "timeLabel": "x", "heapMB": 2.0, "jvmOffHeapMB": 1.0, "totalMemoryMB": None},
        {"timeIso": "t0", "timeLabel": "l0", "heapMB": 3.0, "executor": "2"},
    )
    found = {(r.executor, r.position): r for r in H.history_grid(df).collect()}
    assert set(found) == {("1", 1), ("1", 2), ("2", 1), ("2", 2)}
    row = found["1", 2]
    assert (row.timeLabel, row.heap, row.overhead, row.rss, row.total) == ("l1", 2, 1, 5, 3)
    assert found["1", 1].heap is None and found["2", 1].heap == 3 and found["2", 2].total is None


def test_range_info_and_views(history):
    df = history(
        {"timeMs": NOW, "failedTasks": 1},
        {"timeMs": NOW - 120_000, "executor": "2"},
        {"timeMs": NOW - 900_000, "executor": "3"},
        {"timeMs": NOW - 900_000, "appId": "quiet"},
    )
    info = {r.appId: tuple(r)[1:] for r in range_info(df, NOW, 5).collect()}
    assert info == {"app": (2, 2, 3, "last 5m"), "quiet": (0, 0, 1, "last 5m")}
    assert {r.label for r in range_info(df, NOW).collect()} == {"full history"}
    assert [r.executor_id for r in range_table(df, NOW, 5, only_unhealthy=True).collect()] == ["1"]
    summary, offenders = range_summary(df, NOW)
    assert {r.app_id: r.executors for r in summary.collect()} == {"app": 3, "quiet": 1}
    assert {r.metric for r in offenders.collect()} <= {"shuffle_read_mb"}


def test_apps_can_be_removed_or_kept(history, spark):
    df = history({"appId": "a"}, {"appId": "b"}, {"appId": "c"})
    apps = spark.createDataFrame([("a",), ("z",), ("a",)], "appId string")
    assert sorted(r.appId for r in H.without_apps(df, apps).collect()) == ["b", "c"]
    assert [r.appId for r in H.only_apps(df, apps).collect()] == ["a"]


def test_store_round_trip(history, spark, tmp_path):
    path = str(tmp_path / "history")
    assert history_store.read(spark, path).count() == 0 and history_store.stored_apps(spark, path).count() == 0
    history_store.append(history({"appId": "a", "timeMs": NOW, "heapMB": 1.5}, {"appId": "b/1", "timeMs": 5}), path)
    history_store.append(history({"appId": "a", "timeMs": NOW, "ingestSeq": 9}), path)
    stored = history_store.read(spark, path)
    assert stored.columns == HISTORY.fieldNames() and stored.count() == 3
    assert seqs(history_store.restore(spark, path, NOW, max_age_ms=3_600_000)) == [0, 9]
    assert seqs(history_store.restore(spark, path, NOW)) == [0, 1, 9]
    history_store.persist_tail(stored, str(tmp_path / "tail"), 1)
    assert seqs(history_store.read(spark, str(tmp_path / "tail"))) == [1, 9]
    assert history_store.read(spark, path).count() == 3  # persisting never changes the history
    history_store.replace_apps(history({"appId": "a", "ingestSeq": 50}), path)
    assert seqs(history_store.read(spark, path)) == [1, 50]
    history_store.purge_stale(spark, path, ["b/1", "x"])
    assert [r.appId for r in history_store.stored_apps(spark, path).collect()] == ["b/1"]
    history_store.reset(spark, path, ["b/1"])
    assert history_store.read(spark, path).count() == 0
    # Recording goes on after a reset.
    history_store.append(history({"appId": "b/1", "ingestSeq": 60}), path)
    assert seqs(history_store.read(spark, path)) == [60]


def test_compaction_drops_rows_and_files_but_no_live_row(history, spark, tmp_path):
    path = str(tmp_path / "history")
    apps = [f"app {i}/é" for i in range(30)] + [None]
    for part in range(3):
        history_store.append(history(*({"appId": a, "timeMs": NOW - part * 86_400_000, "ingestSeq": part} for a in apps)), path)
    history_store.reset(spark, path, spark.createDataFrame([(a,) for a in apps[:10]] + [(None,)], "appId string"))
    history_store.append(history({"appId": apps[0], "timeMs": NOW, "ingestSeq": 9}), path)
    rows = lambda: sorted(map(str, history_store.read(spark, path).collect()))
    before, files = rows(), len(list(tmp_path.rglob("rows/**/part-*")))
    assert len(before) == 61
    done = history_store.compact(spark, path)
    assert rows() == before and done and history_store.compact(spark, path) == []
    stored = spark.read.schema(history_store.ROWS).parquet(f"{path}/rows").filter("appId is null or appId in ('app 1/é')")
    assert stored.count() == 0 and len(list(tmp_path.rglob("rows/**/part-*"))) < files
    # Writes after a compaction, another one, and bounds made final.
    history_store.append(history({"appId": apps[3], "timeMs": NOW, "ingestSeq": 12}), path)
    history_store.reset(spark, path, [apps[20]])
    assert len(rows()) == 59
    history_store.compact(spark, path)
    assert len(rows()) == 59
    history_store.compact(spark, path, max_rows=1)
    assert len(rows()) == 21


def test_reading_some_applications_and_days(history, spark, tmp_path):
    path = str(tmp_path / "history")
    history_store.append(history(*({"appId": f"a{i}", "timeMs": NOW - i * 86_400_000, "ingestSeq": i} for i in range(12))), path)
    assert seqs(history_store.read(spark, path, apps=["a3", "a5", "x"])) == [3, 5]
    assert seqs(history_store.read(spark, path, since_ms=NOW - 4 * 86_400_000)) == [0, 1, 2, 3, 4]


def test_bad_json_history_is_dropped(spark, tmp_path):
    path = tmp_path / "h.json"
    path.write_text('not json\n{"appId": "a", "executor": "1", "heapMB": 2.5}\n[1, 2]\n{"appId": "a"}\n')
    rows = history_store.read_json(spark, str(path)).collect()
    assert [(r.appId, r.executor, r.heapMB) for r in rows] == [("a", "1", 2.5)]


def test_json_history_gets_time_and_order_from_its_records(spark, tmp_path):
    path = tmp_path / "h.json"
    record = '{"appId": "a", "executor": "%s", "timeIso": "2024-01-01T00:00:0%d.500Z"}'
    path.write_text("\n".join(record % r for r in (("1", 5), ("driver", 5), ("1", 0))))
    rows = history_store.read_json(spark, str(path))
    assert sorted(r.timeMs - 1704067200000 for r in rows.collect()) == [500, 5500, 5500]
    assert [r.executor for r in H.persisted_tail(rows, 1).collect()] == ["1"]
    assert H.bounded(rows, 1704067205000, max_age_ms=1000).count() == 2
    assert H.in_range(rows, 1704067205000, 1).count() == 3


def test_csv_document(history):
    df = history(
        {"timeMs": NOW, "host": 'a;"b"', "heapMB": 1.0, "heapPct": 12.25, "shuffleReadMB": 1e7},
        {"timeMs": NOW, "host": "plain", "maxTasks": 4},
    )
    lines = csv_export.csv_documents(df, NOW).first().document.split("\n")
    assert lines[0] == ";".join(HISTORY_CSV_COLUMNS) and len(lines) == 3
    first = lines[1].split(";")
    assert lines[1].startswith('app;;t000010000000000;1;"a;""b""";1;;12.25;;')
    assert first[-3:] == ["10000000", "", ""]
    assert lines[2] == f"app;;t000010000000000;1;plain;;;;;;;4{';' * 20}"


def test_csv_files_follow_insertion_order(history, tmp_path):
    path = str(tmp_path / "csv")
    rows = [{"timeMs": NOW, "ingestSeq": 99 - i, "pollSeq": 99 - i, "heapMB": float(99 - i)} for i in range(100)]
    csv_export.write_csv(history(*rows, {"appId": "b", "timeMs": NOW, "ingestSeq": 5}), path)
    parts = sorted(n for n in os.listdir(f"{path}/appId=app") if n.startswith("part"))
    lines = [line for n in parts for line in open(f"{path}/appId=app/{n}").read().splitlines()]
    assert lines[0] == csv_export.HEADER
    assert [int(line.split(";")[5]) for line in lines[1:]] == list(range(100))
