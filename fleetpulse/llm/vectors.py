"""Exact top-k search with a vector-approximation file.

Vectors are written twice: exactly, and as one-byte cells of borders that hold for the whole table. Only cells are dealt to the
queries. They bound every inner product, and what cannot reach the kth best lower bound of its block is left out. The
rest is numbered per query in the order of its bounds. Exact vectors are then fetched by an equi-join in that order: first
the k best by bound, whose kth exact score makes the result certain but for those whose upper bound reaches it, then these.

Blocks of queries meet blocks of cells by their numbers, one pair a group, so tasks hold bounded data and work spreads for few queries too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetpulse.llm.tables import materialize

SCALE = 64
K = 20
CELLS = 256  # as many as a byte holds
BLOCK_CELLS = 2**21
BLOCK_QUERIES = 1024
CHUNK_QUERIES = 128

CELL_BLOCK = "block long, rows binary, singles binary, cells binary"
QUERY_BLOCK = "lane long, ids binary, exact binary"
BOUNDS = "query_id long, row long, lower double, upper double"
NO_SINGLE = np.iinfo(np.int64).min


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component; vectors that are null or hold nulls or non-finite numbers are left out."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    whole = F.transform(x, lambda e: F.floor(F.lit(scale) * e).cast("long"))
    return vectors.where("embedding IS NOT NULL AND vec_id IS NOT NULL").where(finite).select(F.col("vec_id").cast("long"), whole.alias("v"))


def distinct_vectors(whole: DataFrame, k: int) -> DataFrame:
    """(row, v, ids): every different vector once, with its k + 1 smallest ids and up to k copies of each.

    Equal vectors have equal scores and ties go to the smaller id, so no further ids can be among the k best of a query, its own
    left out. The limit also works before the exchange, which keeps a very common vector from making a large group.
    """
    counted = whole.groupBy("v", "vec_id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("copies"))
    smallest = counted.withColumn("place", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("place") <= k + 1)
    listed = smallest.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("vec_id", "copies"))).alias("ids"))
    return materialize(listed.select(F.monotonically_increasing_id().alias("row"), "v", "ids"), "vectors-exact")


def borders(exact: DataFrame, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """(low, width) of each dimension: cell c spans low + c * width and the width - 1 integers after it. One number pair a dimension."""
    spans = exact.select(F.posexplode("v").alias("at", "x")).groupBy("at").agg(F.min("x").alias("low"), F.max("x").alias("high")).collect()
    low, width = np.zeros(max(1, len(spans)), np.int64), np.ones(max(1, len(spans)), np.uint64)
    for s in spans:  # shorter vectors are filled up with zeros, which the cells must hold too
        low[s["at"]] = min(s["low"], 0)
        width[s["at"]] = -(-(max(s["high"], 0) - min(s["low"], 0) + 1) // cells)
    return low, width


def matrix(lists: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Rows of `dims` integers; shorter ones are filled up with zeros, longer ones cut, as they would meet zeros."""
    lists = lists.combine_chunks()
    sizes = np.asarray(pc.list_value_length(lists), np.int64)
    full = np.zeros((len(sizes), max(dims, int(sizes.max(initial=0)))), np.int64)
    full[np.arange(full.shape[1]) < sizes[:, None]] = np.asarray(lists.flatten(), np.int64)
    return full[:, :dims]


def cell_blocks(exact: DataFrame, low: np.ndarray, width: np.ndarray, blocks: int) -> DataFrame:
    """CELL_BLOCK rows: the approximation file, with about BLOCK_CELLS cells in each block."""

    def build(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        # Differences of two longs fit unsigned ones, which wrap around to them.
        apart = matrix(part["v"], low.size).astype(np.uint64) - low.astype(np.uint64)
        rows, singles = np.asarray(part["row"], np.int64), np.asarray(part["single"].fill_null(int(NO_SINGLE)), np.int64)
        block = {"block": [key[0].as_py()], "rows": [rows.tobytes()], "singles": [singles.tobytes()], "cells": [(apart // width).astype(np.uint8).tobytes()]}
        return pa.table(block)

    single = F.when(F.size("ids") == 1, F.col("ids")[0]["vec_id"]).alias("single")
    dealt = exact.select(F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block"), "row", "v", single)
    return materialize(dealt.groupBy("block").applyInArrow(build, CELL_BLOCK), "vectors-cells")


def query_blocks(asked: DataFrame, dims: int, lanes: int) -> DataFrame:
    def build(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        ids = np.asarray(part["vec_id"], np.int64)
        return pa.table({"lane": [key[0].as_py()], "ids": [ids.tobytes()], "exact": [matrix(part["v"], dims).tobytes()]})

    return asked.withColumn("lane", F.pmod(F.xxhash64("vec_id"), F.lit(lanes))).groupBy("lane").applyInArrow(build, QUERY_BLOCK)


def bounds(queries: np.ndarray, low: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per query: its product with the low borders, and what is to be added for the lower and the upper bound of any vector.

    Doubles are exact up to 2^53; sums that may pass that get room for their rounding.
    """
    q, at, wide = queries.astype(np.float64), low.astype(np.float64), width.astype(np.float64)
    gap = wide - 1
    most = np.abs(q) @ (np.abs(at) + wide * 256)
    slack = np.where(most < 2**52, 0, most * (q.shape[1] + 8) * 2.0**-51)
    # A positive weight is greatest at a cell's upper end, a negative one at its lower end.
    return q @ at, np.minimum(q, 0) @ gap - slack, np.maximum(q, 0) @ gap + slack


def near(query_ids: np.ndarray, queries: np.ndarray, rows: np.ndarray, singles: np.ndarray, cells: np.ndarray, low: np.ndarray, width: np.ndarray, k: int) -> pa.Table:
    """BOUNDS of the vectors of a block that may be among the k best of each query. Only cells are read."""
    codes = cells.astype(np.float64).T
    found = []
    for at in range(0, len(query_ids), CHUNK_QUERIES):
        ids, q = query_ids[at : at + CHUNK_QUERIES], queries[at : at + CHUNK_QUERIES]
        base, below, above = bounds(q, low, width)
        middle = (q.astype(np.float64) * width.astype(np.float64)) @ codes + base[:, None]
        # A vector that only the query's own id has is no candidate.
        own = np.flatnonzero((singles != NO_SINGLE) & np.isin(singles, ids))
        place = {int(i): n for n, i in enumerate(ids)}
        middle[[place[int(s)] for s in singles[own]], own] = -np.inf
        n = middle.shape[1]
        kth = np.partition(middle, n - k, axis=1)[:, n - k] if n > k else np.full(len(ids), -np.inf)
        reach = (middle + above[:, None] >= (kth + below)[:, None]) & (middle > -np.inf)
        i, j = np.nonzero(reach)
        found.append((ids[i], rows[j], middle[i, j] + below[i], middle[i, j] + above[i]))
    return pa.table([np.concatenate(c) for c in zip(*found)], names=["query_id", "row", "lower", "upper"])


def candidates(exact: DataFrame, asked: DataFrame, k: int, cells: int, block_queries: int) -> DataFrame:
    """(query_id, row, lower, upper, place): vectors that may be among the k best, by place in the order of their bounds from 1."""
    low, width = borders(exact, cells)
    blocks, lanes = max(1, -(-exact.count() * low.size // BLOCK_CELLS)), max(1, -(-asked.count() // block_queries))
    # Tasks of some 32 pairs for large tables, single pairs for small ones.
    tasks = min(blocks * lanes, max(int(exact.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks * lanes // 32))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    wide = cell_blocks(exact, low, width, blocks).withColumn("lane", each(lanes)).repartition(tasks, "block", "lane")
    narrow = query_blocks(asked, low.size, lanes).withColumn("block", each(blocks)).repartition(tasks, "block", "lane")

    def search(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        if not (vectors.num_rows and queries.num_rows):
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())], names=["query_id", "row", "lower", "upper"])
        read = lambda t, name, kind: np.frombuffer(t[name][0].as_py(), kind)
        codes, q = read(vectors, "cells", np.uint8).reshape(-1, low.size), read(queries, "exact", np.int64).reshape(-1, low.size)
        return near(read(queries, "ids", np.int64), q, read(vectors, "rows", np.int64), read(vectors, "singles", np.int64), codes, low, width, k)

    found = wide.groupBy("block", "lane").cogroup(narrow.groupBy("block", "lane")).applyInArrow(search, BOUNDS)
    order = Window.partitionBy("query_id").orderBy(F.desc("lower"), "row")
    return materialize(found.withColumn("place", F.row_number().over(order)), "vectors-bounds")


def exact_scores(ordered: DataFrame, exact: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, row, ids, score), one row for each vector that was read exactly: the k best by bound, and those whose upper bound
    reaches the kth score of these."""
    queries = asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    product = F.aggregate(F.zip_with("q", "v", lambda a, b: F.coalesce(a * b, F.lit(0))), F.lit(0).cast("long"), lambda s, x: s + x)

    def read(chosen: DataFrame) -> DataFrame:
        return chosen.join(exact, "row").join(queries, "query_id").select("query_id", "row", "ids", product.alias("score"))

    first = materialize(read(ordered.where(F.col("place") <= k)), "vectors-first")
    sure = first.groupBy("query_id").agg(F.min("score").alias("sure"))
    rest = ordered.where(F.col("place") > k).join(sure, "query_id").where("upper >= sure").select("query_id", "row")
    return first.unionByName(read(rest))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE, cells: int = CELLS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query with every row but its own id.

    Both tables have vec_id and embedding. Ties go to the smaller vec_id. Vectors that are null or hold null or non-finite
    components take no part, nor do null ids; a shorter vector counts as filled up with zeros. Of repeated query ids the
    smallest vector is asked; repeated candidates are all answered. An empty table, or no queries, gives no rows. Scores beyond
    64 bits raise an error, and so do more than 256 cells, the most a byte can tell apart.
    """
    if not 1 <= cells <= 256:
        raise ValueError("cells must be 1 to 256")
    exact = distinct_vectors(integer_vectors(vectors, scale), k)
    asked = materialize(integer_vectors(queries, scale).groupBy("vec_id").agg(F.min("v").alias("v")), "vectors-asked")
    scored = exact_scores(candidates(exact, asked, k, cells, block_queries), exact, asked, k)
    answers = scored.select("query_id", F.explode("ids").alias("id"), "score").where("id.vec_id <> query_id")
    copies = answers.select("query_id", F.col("id.vec_id").alias("vec_id"), "score", F.explode(F.array_repeat(F.lit(0), F.col("id.copies"))))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = copies.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
