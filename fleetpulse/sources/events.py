"""Task-end events and published process-CPU samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.schemas import PROCESS_SAMPLE_JSON, TASK_END_JSON

TASK_END = "SparkListenerTaskEnd"


# Directory of a rolled log, endings of log names, and ids whose last number is no attempt.
ROLLED = r"/eventlog_v2_([^/]+)/[^/]+$"
ENDINGS = r"(\.(inprogress|compact|lz4|lzf|snappy|zstd|zst|gz|bz2))+$"
ATTEMPT = r"^(application_[0-9]+(?:_[0-9]+)?|.+?)(_[0-9]+)?$"


def app_of_log(path: Column) -> Column:
    """Application of an event-log file: a rolled log's directory or else the file's name, without attempt and endings."""
    rolled = F.regexp_extract(path, ROLLED, 1)
    own = F.regexp_replace(F.element_at(F.split(path, "/"), -1), ENDINGS, "")
    return F.regexp_extract(F.when(rolled != "", rolled).otherwise(own), ATTEMPT, 1)


def read_event_log(spark: SparkSession, path: str, app_id: Column | None = None) -> DataFrame:
    """Task ends from event-log files, single or rolled. The application is taken from the log's place unless given."""
    app = app_of_log(F.input_file_name()) if app_id is None else app_id
    return task_ends(spark.read.schema(TASK_END_JSON).json(path), app)


def parse_event_log(lines: DataFrame, column: str = "value", app_id: str = "app_id") -> DataFrame:
    """Task ends from rows that each hold one event-log line."""
    parsed = lines.select(app_id, F.from_json(F.col(column), TASK_END_JSON).alias("e")).select(app_id, "e.*")
    return task_ends(parsed, F.col(app_id))


def task_ends(events: DataFrame, app_id: Column) -> DataFrame:
    """Finished tasks; an event without task info or metrics keeps null in their place."""
    return events.filter(F.col("Event") == TASK_END).select(
        app_id.alias("app_id"),
        F.col("`Task Info`.`Executor ID`").alias("executor_id"),
        F.col("`Task Info`.`Task ID`").alias("task_id"),
        F.col("`Task Info`.`Finish Time`").alias("finish_ms"),
        F.col("`Task Metrics`.`Executor CPU Time`").alias("cpu_ns"),
    )


def read_process_samples(spark: SparkSession, path: str) -> DataFrame:
    return known_samples(spark.read.schema(PROCESS_SAMPLE_JSON).json(path))


def stream_process_samples(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(PROCESS_SAMPLE_JSON)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return known_samples(reader.json(path))


def parse_process_samples(lines: DataFrame, column: str = "value") -> DataFrame:
    """Published samples from message texts; messages of any other shape are ignored."""
    return known_samples(lines.select(F.from_json(F.col(column), PROCESS_SAMPLE_JSON).alias("m")).select("m.*"))


def known_samples(messages: DataFrame) -> DataFrame:
    complete = F.col("appId").isNotNull() & F.col("executorId").isNotNull() & F.col("cpuPct").isNotNull()
    return messages.filter(complete).select(
        F.col("appId").alias("app_id"),
        F.col("executorId").alias("executor_id"),
        F.col("sampleSeq").alias("sample_seq"),
        F.col("cpuPct").alias("cpu_pct"),
    )
