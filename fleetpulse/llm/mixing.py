"""Mixing sources to target weights by Pfair scheduling.

A source's rows are cut into blocks. Of every `cycle` slots a source owns its integer share c; its block k (from 0) is released
at slot floor(k * cycle / c) and due before slot ceil((k + 1) * cycle / c), and each slot takes the released block with
the earliest deadline. So at any slot every source is less than one block away from its target. The schedule repeats
after `cycle` slots, so one cycle places the blocks of a corpus of any size. When a source has no blocks left its
slots stay empty, and the others keep their ratios. Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetpulse.llm.tables import fresh, materialize

BLOCK_ROWS = 64
CYCLE = 1024
BUCKET_ROWS = 1024
MAX_SOURCES = 2048


def tempered_shares(counts: DataFrame, cycle: int = CYCLE) -> DataFrame:
    """(source, share): integer weights in proportion to the square root of the rows, at least 1, about `cycle` in all."""
    root = F.floor(F.sqrt("n"))
    roots = counts.agg(F.sum(root)).first()[0] or 1
    share = F.expr(f"({cycle} * CAST(floor(sqrt(n)) AS BIGINT)) DIV {roots}")
    return counts.select("source", F.greatest(F.lit(1).cast("long"), share).alias("share"))


def cycle_slots(shares: DataFrame) -> DataFrame:
    """(source, turn, share, cycle, slot): when each block of a cycle runs. One row of arrays holds the whole state."""
    if shares.limit(MAX_SOURCES + 1).count() > MAX_SOURCES:
        raise ValueError(f"at most {MAX_SOURCES} sources can be mixed; group small ones first")
    ranked = F.array_sort(F.collect_list(F.struct("source", "share")))
    one = shares.agg(ranked.alias("all")).select("all", F.expr("aggregate(all, 0L, (a, x) -> a + x.share)").alias("cycle"))
    # Of the sources with a released block, the earliest deadline; ties by name. Then that source has had one more.
    pick = """array_min(filter(transform(all, (x, i) -> IF(s.had[i] < x.share AND s.had[i] * cycle DIV x.share <= t,
        struct(((s.had[i] + 1) * cycle + x.share - 1) DIV x.share AS due, i AS i), NULL)), x -> x IS NOT NULL))"""
    plan = f"""aggregate(sequence(0L, cycle - 1),
        struct(transform(all, x -> 0L) AS had, CAST(array() AS array<struct<i:int,turn:bigint>>) AS runs),
        (s, t) -> transform(array({pick}), p -> struct(
            transform(s.had, (h, i) -> IF(i = p.i, h + 1, h)) AS had,
            concat(s.runs, array(struct(p.i AS i, s.had[p.i] AS turn))) AS runs))[0]).runs"""
    runs = one.where("size(all) > 0").select("all", "cycle", F.posexplode(F.expr(plan)).alias("slot", "run"))
    return runs.selectExpr("all[run.i].source AS source", "run.turn AS turn", "all[run.i].share AS share", "cycle", "CAST(slot AS BIGINT) AS slot")


def numbered(rows: DataFrame, source: str, digest: str, ties: list[str], bucket_rows: int, into: str) -> DataFrame:
    """Adds `into`, each row's number within its source by digest and then `ties`, without sorting a source in one task.

    Rows fall into buckets by ranges of a hash; counts of buckets give where each bucket's numbers begin.
    """
    bucket, size, start, within = fresh(rows, "bucket", "size", "start", "within")
    most = rows.groupBy(source).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    buckets = max(1, most // bucket_rows)
    # md5 is even over its range, and its first 8 digits order like the digest they begin.
    share = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") * buckets
    placed = rows.withColumn(bucket, F.shiftright(share, 32))
    counts = placed.groupBy(source, bucket).agg(F.count(F.lit(1)).alias(size))
    before = F.sum(size).over(Window.partitionBy(source).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(source, bucket, F.coalesce(before, F.lit(0)).alias(start))
    number = F.row_number().over(Window.partitionBy(source, bucket).orderBy(digest, *(F.col(f"`{c}`") for c in ties)))
    joined = placed.withColumn(within, number).join(starts, [source, bucket])
    return joined.withColumn(into, F.col(start) + F.col(within) - 1).drop(bucket, start, within)


def checked_shares(shares: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, share) of the sources at hand; every one needs a positive share, and just one."""
    given = shares.select("source", F.col("share").cast("long").alias("share"))
    found = sources.join(given, "source", "left")
    lacking = found.groupBy("source").agg(F.count("share").alias("n"), F.min("share").alias("least")).where("n <> 1 OR least < 1").limit(5).collect()
    if lacking:
        raise ValueError(f"sources need one positive share each: {sorted(r.source for r in lacking)}")
    return given


def mix(docs: DataFrame, shares: DataFrame | None = None, key: str = "doc_id", block_rows: int = BLOCK_ROWS, cycle: int = CYCLE) -> DataFrame:
    """Adds source_row, block, release, deadline and slot to every row of `docs` (which has `source` and `key`).

    `shares` has (source, share), a positive integer for every source of `docs`, else an error is raised; by default the square
    roots of their rows. Rows are numbered within a source by the md5 of `key`, so blocks are random samples of it. No row is
    dropped or repeated. A null source is a source of its own, named "null"; null keys come first; repeated rows take places
    one after the other; columns with the name of an added one are replaced; an empty table stays empty.
    """
    added = ["source_row", "block", "release", "deadline", "slot"]
    docs = docs.drop(*added)
    source, digest, own_share, own_cycle, turn, own_slot = fresh(docs, "mixed", "digest", "share", "cycle", "turn", "slot_")
    keyed = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))
    rows = docs.withColumns({source: F.coalesce(F.col("source").cast("string"), F.lit("null")), digest: keyed})
    counts = rows.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    shares = tempered_shares(counts, cycle) if shares is None else checked_shares(shares, counts.select("source"))
    slots = materialize(cycle_slots(shares), "slots").toDF(source, turn, own_share, own_cycle, own_slot)
    shares = slots.groupBy(source).agg(F.first(own_share).alias(own_share), F.first(own_cycle).alias(own_cycle))
    out = numbered(rows, source, digest, docs.columns, BUCKET_ROWS, "source_row").withColumn("block", F.expr(f"source_row DIV {block_rows}"))
    # Both tables have at most one row for each slot of a cycle: `cycle` and one for each of at most MAX_SOURCES sources.
    out = out.join(F.broadcast(shares), source).withColumn(turn, F.col("block") % F.col(own_share))
    out = out.join(F.broadcast(slots.select(source, turn, own_slot)), [source, turn])
    return out.select(
        *(F.col(f"`{c}`") for c in docs.columns),
        "source_row",
        "block",
        F.expr(f"block * {own_cycle} DIV {own_share}").alias("release"),
        F.expr(f"((block + 1) * {own_cycle} + {own_share} - 1) DIV {own_share}").alias("deadline"),
        F.expr(f"(block DIV {own_share}) * {own_cycle} + {own_slot}").alias("slot"),
    )
