import sys
from pathlib import Path

import pytest
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from fleetpulse.operators.ordered import SPLIT, Split  # noqa: E402
from fleetpulse.schemas import SAMPLES  # noqa: E402

# Plain windows, every key cut into single rows, only larger keys cut, and the default.
SPLITS = [None, Split(0, 1), Split(3, 2), SPLIT]

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("fleetpulse-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        # Results must not depend on the session's time zone.
        .config("spark.sql.session.timeZone", "America/New_York")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def evaluate(spark):
    """Value of a column expression over literal inputs: evaluate(lambda a, b: ..., (1, 2), types='a int, b int')."""

    def run(build, rows, types):
        df = spark.createDataFrame(rows, types)
        names = df.columns
        return [r[0] for r in df.select(build(*[F.col(n) for n in names]).alias("v")).collect()]

    return run


@pytest.fixture(scope="session")
def samples(spark):
    """Sample table from dicts; what is not given is null, except for a live executor of `app` with four slots."""
    defaults = {
        "app_id": "app",
        "executor_id": "1",
        "is_active": True,
        "max_tasks": 4,
        "total_cores": 4,
        "active_tasks": 0,
        "failed_tasks": 0,
    }

    def build(*rows):
        complete = []
        for row in rows:
            row = {**defaults, **row}
            row.setdefault("wall_ms", row["poll_seq"] * 5000)
            complete.append(Row(*[row.get(f.name) for f in SAMPLES.fields]))
        return spark.createDataFrame(complete, SAMPLES)

    return build


@pytest.fixture(scope="session")
def derived(spark):
    """Samples derived from the small events table, written once."""
    from fleetpulse.plans import derive

    return derive.executor_samples(derive.read_events(spark, SMALL)).select(*SAMPLES.fieldNames()).persist()
