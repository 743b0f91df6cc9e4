"""An order of id runs in which lexically near ones lie together, at any number of them.

Ids weigh by their inverse document frequency over all runs. The weights of a run, added up by signed hashes of its ids,
make a short vector; a tree of spherical clusters, learned from a hash sample, gives each vector a leaf, and near leaves
have near numbers. Within a leaf a weighted minhash over pairs of neighbouring ids puts texts that share passages side by
side; it tells as many runs apart as there are rare pairs. The sample only shapes the order: every run gets a place.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm import words as W

DIMENSIONS = 128
SAMPLE_ROWS = 16_384
BRANCHES = 16
PER_PARTITION = 64
LEAF_ROWS = 8  # of the sample
ROUNDS = 6
BATCH_ROWS = 256  # runs are looked at in groups of so many, which bounds memory


@dataclass
class Weights:
    """Of all runs: how many there are, their mean length, and the inverse document frequency of each id, 0 at least."""

    rows: int
    mean: float
    idf: np.ndarray


def weights(runs: DataFrame) -> Weights:
    """Counted over every row of `runs` (length, ids); at most one row for each id of the vocabulary is collected."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(0, np.int64)
        for batch in batches:
            for ids in id_arrays(batch.column("ids")):
                last = int(ids.max(initial=0))
                if last >= df.size:
                    df = np.concatenate([df, np.zeros(2 * last + 1 - df.size, np.int64)])
                df[ids] += 1  # once for each distinct id, as numpy does not add up repeated places
            release()
        known = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(known), pa.array(df[known])], ["id", "n"])

    rows, mean = runs.agg(F.count(F.lit(1)), F.avg("length")).first()
    found = runs.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    ids, n = found.column("id").to_numpy(), found.column("n").to_numpy()
    idf = np.zeros(ids.max(initial=-1) + 1)
    idf[ids] = np.maximum(np.log((rows - n + 0.5) / (n + 0.5)), 0)
    return Weights(rows, mean or 1.0, idf)


def distinct_ids(ids: np.ndarray) -> np.ndarray:
    """The distinct ids of a run, sorted; `np.unique` costs several times as much on short arrays."""
    ids = np.sort(ids)
    new = np.ones(ids.size, bool)
    np.not_equal(ids[1:], ids[:-1], out=new[1:])
    return ids[new]


def id_arrays(column: pa.Array) -> list[np.ndarray]:
    """The ids of each row of a binary column, as views of its buffer."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return [np.zeros(0, "<u4")] * len(column)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    ids, places = np.frombuffer(data, "<u4", data.size // 4), (offsets // 4).tolist()
    return [ids[a:b] for a, b in zip(places, places[1:])]


def release() -> None:
    """Gives the memory of earlier batches, which a worker would keep for its next tasks, back to the system."""
    pa.default_memory_pool().release_unused()


def sketches(runs: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    """A unit vector for each run, or zeros where no id has weight."""
    code = W.mix(np.arange(idf.size, dtype=np.uint64) + np.uint64(5))
    bucket = (code % np.uint64(DIMENSIONS)).astype(np.int64)
    signed = np.where(code >> np.uint64(63), idf, -idf)
    ids = np.concatenate(runs)
    at = np.repeat(np.arange(len(runs)) * DIMENSIONS, [r.size for r in runs]) + bucket[ids]
    out = np.bincount(at, signed[ids], len(runs) * DIMENSIONS).reshape(-1, DIMENSIONS).astype(np.float32)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def minhashes(runs: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    """The pair of neighbouring ids that comes first when pairs are drawn by the lesser weight of their two, as a hash."""
    ids = np.concatenate(runs).astype(np.int64)
    ends = np.cumsum([r.size for r in runs])
    after = np.append(ids[1:], 0)
    after[ends - 1] = ids[ends - 1]
    weight = np.minimum(idf[ids], idf[after])
    hashes = W.mix((ids.astype(np.uint64) << np.uint64(32)) + after.astype(np.uint64) + np.uint64(7))
    drawn = -np.log(((hashes >> np.uint64(11)).astype(np.float64) + 1) / 2**53)
    drawn = np.divide(drawn, weight, out=np.full(ids.size, np.inf), where=weight > 0)
    first = np.minimum.reduceat(drawn, np.append(0, ends[:-1]))
    return (W.mix(first.view(np.uint64)) >> np.uint64(1)).astype(np.int64)


class Tree:
    """Clusters within clusters; leaves are numbered so that neighbouring ones are alike."""

    def __init__(self, points: np.ndarray, rng: np.random.Generator | None = None):
        rng = rng or np.random.default_rng(2024)
        self.centres, self.below, self.leaves = None, [], 1
        k = min(BRANCHES, len(points) // LEAF_ROWS)
        if k < 2:
            return
        centres = points[rng.choice(len(points), k, replace=False)]
        for _ in range(ROUNDS):
            of = (points @ centres.T).argmax(1)
            sums = np.stack([points[of == j].sum(0) for j in range(k)])
            norm = np.linalg.norm(sums, axis=1, keepdims=True)
            centres = np.where(norm > 0, sums / np.maximum(norm, 1e-9), centres)
        spread = centres - centres.mean(0)
        centres = centres[np.argsort(spread @ np.linalg.svd(spread, full_matrices=False)[2][0])]
        of = (points @ centres.T).argmax(1)
        if np.bincount(of).max() == len(points):
            return  # all alike
        self.centres = centres
        self.below = [Tree(points[of == j], rng) for j in range(k)]
        self.leaves = sum(t.leaves for t in self.below)

    def leaf(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int64)
        if self.centres is not None:
            of, first = (points @ self.centres.T).argmax(1), 0
            for j, tree in enumerate(self.below):
                mine = np.flatnonzero(of == j)
                if mine.size:
                    out[mine] = first + tree.leaf(points[mine])
                first += tree.leaves
        return out


def learn(runs: DataFrame, known: Weights) -> Tree:
    """The tree of about SAMPLE_ROWS rows of `runs` (ids, salt), or of all if there are fewer."""

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                found = sketches(id_arrays(batch.column("ids").slice(at, BATCH_ROWS)), known.idf)
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in found], pa.binary())], ["vector"])

    sample = sampled(runs, known, SAMPLE_ROWS).select("ids")
    found = sorted(sample.mapInArrow(vectors, "vector binary").toArrow().column("vector").to_pylist())
    return Tree(np.frombuffer(b"".join(found), np.float32).reshape(-1, DIMENSIONS))


def sampled(runs: DataFrame, known: Weights, rows: int) -> DataFrame:
    """About so many rows of `runs` (salt), or all if there are fewer."""
    most = int(min(1, rows / max(1, known.rows)) * (1 << 30))
    return runs.where(F.col("salt").bitwiseAND(F.lit((1 << 30) - 1)) < most)


def placed(runs: DataFrame, known: Weights, tree: Tree) -> DataFrame:
    """Adds `leaf` and `alike` to every row of `runs` (ids, any others): rows that are near in their order are alike."""
    return runs.mapInArrow(_placing(known, tree, None), _schema(runs, "leaf long", "alike long"))


def dealt(runs: DataFrame, known: Weights, tree: Tree, partitions: int) -> DataFrame:
    """`placed`, with rows (run, salt, ids, any others) dealt over partitions by ranges of run, leaf, alike and salt.

    Borders come from the keys of about PER_PARTITION sampled rows for each partition, so the keys of all are computed once.
    """
    keys = ["run", "leaf", "alike", "salt"]
    borders: list[tuple] = []
    if partitions > 1:
        found = placed(sampled(runs, known, max(SAMPLE_ROWS, PER_PARTITION * partitions)).select("run", "salt", "ids"), known, tree)
        rows = sorted(map(tuple, found.select(*keys).collect()))
        borders = [rows[len(rows) * i // partitions] for i in range(1, partitions)] if rows else []
    out = runs.mapInArrow(_placing(known, tree, borders), _schema(runs, "leaf long", "alike long", "part int"))
    return out.repartitionById(partitions, "part").drop("part")


def _schema(runs: DataFrame, *added: str) -> str:
    return ", ".join([*(f"{name} {kind}" for name, kind in runs.dtypes), *added])


def _placing(known: Weights, tree: Tree, borders: list[tuple] | None):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            # Only the vectors of a batch are held at once; the tree is walked once for all of them.
            vectors, alike = [], []
            for at in range(0, batch.num_rows, BATCH_ROWS):
                ids = id_arrays(batch.column("ids").slice(at, BATCH_ROWS))
                vectors.append(sketches(ids, known.idf))
                alike.append(minhashes(ids, known.idf))
            keys = {"leaf": pa.array(tree.leaf(np.concatenate(vectors))), "alike": pa.array(np.concatenate(alike))}
            if borders is not None:
                rows = zip(batch.column("run").to_pylist(), *(k.to_pylist() for k in keys.values()), batch.column("salt").to_pylist())
                keys["part"] = pa.array([bisect_right(borders, row) for row in rows], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, *keys.values()], [*batch.schema.names, *keys])
            release()

    return place
