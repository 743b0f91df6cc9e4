"""Reading the given tables and cutting lineage with tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetpulse.sources.shared import work_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Writes a table to the cluster's shared folder and reads it back, so that lost executors cost no recomputation."""
    path = work_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own that `df` does not have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
