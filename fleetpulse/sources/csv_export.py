"""CSV export of history: 32 columns, `;` between fields, minimal quoting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.functions.numbers import place_digits
from fleetpulse.functions.text import csv_field
from fleetpulse.operators.history import bounded
from fleetpulse.schemas import HISTORY, HISTORY_CSV_COLUMNS

SEPARATOR = ";"
HEADER = SEPARATOR.join(HISTORY_CSV_COLUMNS)


def csv_lines(history: DataFrame) -> DataFrame:
    """One text line per recorded row: (appId, ingestSeq, executor, line).

    The doubles go through one array, so that the digit placement is planned once and not once per column.
    """
    kinds = {name: HISTORY[name].dataType.typeName() for name in HISTORY_CSV_COLUMNS}
    doubles = [name for name in HISTORY_CSV_COLUMNS if kinds[name] == "double"]
    numbers = F.transform(F.array(*[F.col(name).cast("string") for name in doubles]), place_digits)

    def field(name: str):
        if kinds[name] == "string":
            return csv_field(F.col(name))
        # The text of a number never needs quotes.
        text = F.col("_numbers")[doubles.index(name)] if kinds[name] == "double" else F.col(name).cast("string")
        return F.coalesce(text, F.lit(""))

    line = F.concat_ws(SEPARATOR, *[field(name) for name in HISTORY_CSV_COLUMNS])
    return history.withColumn("_numbers", numbers).select("appId", "ingestSeq", "executor", line.alias("line"))


def write_csv(history: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One directory per application; its part files, read in name order, are the header and the rows in order.

    Rows are range-partitioned by (application, insertion order), so a large application is spread over many files
    and tasks. Unlike `csv_documents` the last line ends with a newline.
    """
    lines = csv_lines(history)
    header = history.select("appId").distinct().select(
        "appId", F.lit(-1).cast("bigint").alias("ingestSeq"), F.lit("").alias("executor"), F.lit(HEADER).alias("line")
    )
    order = ["appId", "ingestSeq", "executor"]
    (
        lines.unionByName(header)
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("appId", "line")
        .write.mode(mode)
        .partitionBy("appId")
        .text(path)
    )


def csv_documents(
    history: DataFrame, now_ms: int, max_rows: int | None = None, max_age_ms: int | None = None
) -> DataFrame:
    """Whole export text per application, byte for byte: header first, no newline at the end.

    One text per application must fit a task: for applications of any size use `write_csv`, or give bounds.
    """
    lines = csv_lines(bounded(history, now_ms, max_rows, max_age_ms))
    ordered = F.array_sort(F.collect_list(F.struct("ingestSeq", "executor", "line")))
    body = F.array_join(F.transform(ordered, lambda row: row["line"]), "\n")
    return lines.groupBy("appId").agg(F.concat(F.lit(HEADER + "\n"), body).alias("document"))
