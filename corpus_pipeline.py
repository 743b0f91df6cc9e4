"""A corpus pipeline of five stages: each reads what the one before it kept, and is written before the next begins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.llm import jaccard, mixing, packing, secrets, toxicity
from fleetpulse.llm.tables import materialize, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

PARTITION_ROWS = 4096
RUN_FILES = mixing.CYCLE * mixing.BLOCK_ROWS // PARTITION_ROWS  # about a cycle of the schedule, which holds every source by its weight


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated chance of being toxic is under one half."""
    scored = toxicity.score(docs, table(spark, sf_dir, "labels"), keep=tuple(docs.columns))
    return scored.where("predicted = 0").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8): that of the smallest id."""
    return jaccard.first_of_groups(docs, k=5, percent=80)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in their texts replaced and n_chars counted anew where that changed it."""
    found = secrets.scan(docs)
    text, changed = secrets.redacted(), F.size("all_spans") > 0
    new = found.withColumn("n_chars", F.when(changed, F.length(text).cast("long")).otherwise(F.col("n_chars"))).withColumn("text", text)
    return new.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, laid out in the order of the slots that interleave their sources by target weight."""
    # Other columns may have the names of those that mixing adds.
    given = [f"_{i}" for i in range(len(docs.columns))]
    renamed = docs.select(*(F.col(f"`{c}`").alias(g) for c, g in zip(docs.columns, given)), F.col("source").alias("source"), F.col("doc_id").alias("doc_id"))
    parts = max(1, -(-docs.count() // PARTITION_ROWS))
    ordered = mixing.mix(renamed).repartitionByRange(parts, "slot", "source_row").sortWithinPartitions("slot", "source_row")
    return ordered.select(*(F.col(g).alias(c) for c, g in zip(docs.columns, given)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of at most 2048 tokens that follow the order of the table's files."""
    columns = ["doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"]
    return packing.pack(packing.schedule_runs(docs, RUN_FILES), run="run").select(*columns)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack),
]

# Trees, Markov models and retrieval have no SQL form; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
