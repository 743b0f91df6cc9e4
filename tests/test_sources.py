import json

import pytest
from pyspark.sql import functions as F

from fleetpulse.schemas import SAMPLES
from fleetpulse.sources import events, snapshots
from fleetpulse.sources.shared import work_dir


def test_samples_survive_the_json_form(spark, derived, tmp_path):
    path = str(tmp_path / "snapshots")
    snapshots.write_snapshots(derived, path)
    back = snapshots.read_snapshots(spark, path)
    assert back.schema == SAMPLES
    assert back.exceptAll(derived).count() == 0 and derived.exceptAll(back).count() == 0


def test_dead_executors_are_read_too(spark, tmp_path):
    (tmp_path / "a.json").write_text(
        '{"id": "1", "hostPort": "h:1", "isActive": false, "addTime": "x", "peakMemoryMetrics": {"JVMHeapMemory": 7}}\n'
        '{"id": "driver", "isActive": true}\n'
    )
    rows = {r.executor_id: r for r in snapshots.read_snapshots(spark, str(tmp_path)).collect()}
    assert (rows["1"].is_active, rows["1"].peak_jvm_heap, rows["1"].rss) == (False, 7, None)
    assert rows["driver"].host_port is None and rows["driver"].cur_jvm_heap is None


def test_array_payload(spark):
    payload = json.dumps([{"id": "1", "isActive": True, "maxTasks": 4}, {"id": "2", "memoryMetrics": {"usedOnHeapStorageMemory": 3}}])
    df = spark.createDataFrame([(payload,), ("oops",), ("[]",)], "value string")
    found = {r.executor_id: (r.max_tasks, r.used_on_heap_storage) for r in snapshots.parse_payloads(df).collect()}
    assert found == {"1": (4, None), "2": (None, 3)}


def test_enriched_json_omits_what_is_absent(samples):
    table = samples({"poll_seq": 3, "host_port": "h:1", "rss": 9}, {"poll_seq": 3, "executor_id": "2", "os_cpu_pct": 12.5, "cpu_time_ms": 8})
    found = {r.executor_id: json.loads(r.value) for r in snapshots.enriched_json(table).collect()}
    assert found["1"]["id"] == "1" and found["1"]["hostPort"] == "h:1" and found["1"]["cpuTimeMs"] == 0
    assert found["1"]["peakMemoryMetrics"] == {"ProcessTreeJVMRSSMemory": 9}
    assert not {"osCpuLoadPct", "executorMetrics", "memoryMetrics", "host"} & set(found["1"])
    assert (found["2"]["osCpuLoadPct"], found["2"]["cpuTimeMs"]) == (12.5, 8)


LOG = [
    '{"Event":"SparkListenerTaskEnd","Task Info":{"Task ID":1,"Executor ID":"7","Finish Time":5},"Task Metrics":{"Executor CPU Time":12}}',
    '{"Event":"SparkListenerTaskEnd","Task Info":{"Task ID":2,"Executor ID":"7"}}',
    '{"Event":"SparkListenerTaskEnd","Task Metrics":{"Executor CPU Time":3}}',
    '{"Event":"SparkListenerTaskStart","Task Info":{"Task ID":3,"Executor ID":"7"}}',
    "broken",
]


def test_event_log(spark, tmp_path):
    (tmp_path / "application_1").write_text("\n".join(LOG))
    found = events.read_event_log(spark, str(tmp_path)).collect()
    expected = {("application_1", "7", 1, 5, 12), ("application_1", "7", 2, None, None), ("application_1", None, None, None, 3)}
    assert {tuple(r) for r in found} == expected
    lines = spark.createDataFrame([("a", line) for line in LOG], "app_id string, value string")
    assert {tuple(r)[1:] for r in events.parse_event_log(lines).collect()} == {e[1:] for e in expected}


@pytest.mark.parametrize(
    "path, app",
    [
        ("app-20240101-0001", "app-20240101-0001"),
        ("app-20240101-0001_2.zstd.inprogress", "app-20240101-0001"),
        ("application_17_0003_1.lz4", "application_17_0003"),
        ("eventlog_v2_app-1/events_1_app-1", "app-1"),
        ("eventlog_v2_app-1_2/events_2_app-1_2.compact", "app-1"),
        ("local-1700.snappy", "local-1700"),
    ],
)
def test_application_of_a_log(spark, path, app):
    df = spark.createDataFrame([(f"s3a://logs/x/{path}",)], "p string")
    assert df.select(events.app_of_log(F.col("p"))).first()[0] == app


def test_rolled_log_is_one_application(spark, tmp_path):
    folder = tmp_path / "eventlog_v2_app-7"
    folder.mkdir()
    for i in (1, 2):
        (folder / f"events_{i}_app-7").write_text(LOG[0])
    assert {r.app_id for r in events.read_event_log(spark, str(folder)).collect()} == {"app-7"}


def test_process_samples_ignore_other_messages(spark, tmp_path):
    lines = ['{"appId":"a","executorId":"1","sampleSeq":4,"cpuPct":2.5}', '{"kind":"other"}', "x", '{"appId":"a","executorId":"1","cpuPct":"high"}']
    (tmp_path / "m.json").write_text("\n".join(lines))
    assert [tuple(r) for r in events.read_process_samples(spark, str(tmp_path)).collect()] == [("a", "1", 4, 2.5)]
    df = spark.createDataFrame([(line,) for line in lines], "value string")
    assert [tuple(r) for r in events.parse_process_samples(df).collect()] == [("a", "1", 4, 2.5)]


class FakeSession:
    """A session with the given master and settings, as far as `work_dir` looks at it."""

    def __init__(self, master, settings):
        self.conf, self.sparkContext, self.master, self.settings = self, self, master, settings

    def get(self, key, default=None):
        return self.settings.get(key, default)

    def getConf(self):
        return self


def test_work_dir_follows_the_session(spark):
    assert work_dir(spark, "x") != work_dir(spark, "x")
    shared = FakeSession("spark://host:7077", {"spark.checkpoint.dir": "hdfs:///shared/"})
    assert work_dir(shared, "x").startswith("hdfs:///shared/x-")
    with pytest.raises(ValueError):
        work_dir(FakeSession("yarn", {}), "x")
