"""Merkle manifest of a table as a persistent tree: one tree per group of rows (16 children a node), and one over their roots.

* Rows are numbered by a range sort and counts per partition; no window holds a group's rows.
* Trees are built in aligned blocks of 16^3 leaves. A block is one group of at most 4,096 digests and yields one node, so each
  round shrinks the table by that factor; the next round works on the nodes of the last.
* Going down again, every block gets the path of its node: the siblings at each level from the block up to the root. A leaf's
  path is that of its place inside the block followed by that of the block.
* A changed leaf makes a version of the tree. It shares every node but its ancestors; those are copied inside the leaf's block
  and then along the block's path, by the same task. Versions are never exchanged.

A digest is lowercase hex SHA-256. The digest of a node is that of its children's digests joined; runs are 16 consecutive nodes,
the last may be shorter, even one. A tree of one leaf is that leaf. Rows order by their key columns (nulls first, text by
bytes), then by digest; rows alike in all of these are interchangeable. Null values hash as "-", so they differ from empty texts.
An empty table gives empty results. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetpulse.llm.tables import materialize

FANOUT = 16
BLOCK_LEVELS = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Changed = Callable[[dict[str, Column]], tuple[Column, dict[str, Column]]]


def digest(values: list[Column]) -> Column:
    """Digest of a row: each value as its UTF-8 byte count, a colon and itself, or as a dash where it is null."""
    parts = []
    for value in values:
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def lowered(fields: dict[str, Column], every: int = 5) -> tuple[Column, dict[str, Column]]:
    """Tampering that lower-cases A-Z of the text of rows whose id's CRC-32 is divisible by `every`."""
    hit = F.coalesce(F.crc32(fields["doc_id"].cast("string")) % every == 0, F.lit(False))
    return hit, {**fields, "text": F.translate(fields["text"], UPPER, LOWER)}


def node(children: list[str]) -> str:
    return sha256("".join(children).encode()).hexdigest()


def levels_of(leaves: list[str], height: int) -> list[list[str]]:
    """The levels of one block from its leaves up; the last holds one node."""
    levels = [leaves]
    for _ in range(height):
        below = levels[-1]
        levels.append([node(below[i : i + FANOUT]) for i in range(0, len(below), FANOUT)])
    return levels


def siblings(levels: list[list[str]], index: int) -> list[tuple[str, str]]:
    """Joined digests left and right of a leaf's ancestors within their runs, level by level."""
    out = []
    for level in levels[:-1]:
        first = index - index % FANOUT
        out.append(("".join(level[first:index]), "".join(level[index + 1 : first + FANOUT])))
        index //= FANOUT
    return out


def fold(leaf: str, path: list[tuple[str, str]]) -> list[str]:
    """The copied ancestors of a changed leaf, up to the root."""
    copies = []
    for left, right in path:
        leaf = sha256((left + leaf + right).encode()).hexdigest()
        copies.append(leaf)
    return copies


def height_of(rows: Column) -> Column:
    """Levels above the leaves of a tree of so many."""
    steps = [F.when(rows > FANOUT**i, 1).otherwise(0) for i in range(15)]
    return sum(steps[1:], steps[0])


def numbered(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """Adds `index` (from 0 within a tree) and `height` to rows, counted over range-sorted partitions."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # Equal rows are dealt apart by their place in the table, so that repeats of one row do not make one partition.
    rows = rows.select("*", F.xxhash64(F.col("_metadata.file_path"), F.col("_metadata.row_index")).alias("place"))
    keys = [F.col(c).asc_nulls_first() for c in [tree, *order, "place"]]
    ranged = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    ranged = materialize(ranged.drop("place").withColumn("at", F.monotonically_increasing_id()), "merkle-rows")
    part = F.shiftright("at", 33).alias("part")
    counts = ranged.groupBy(tree, part).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    # One row for each partition a tree lies in, at most partitions + trees.
    before = Window.partitionBy(tree).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col(tree).alias("_tree"),
        F.col("part").alias("_part"),
        (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        height_of(F.sum("n").over(Window.partitionBy(tree))).alias("height"),
    )
    joined = ranged.join(starts, (F.col(tree) == F.col("_tree")) & (F.shiftright("at", 33) == F.col("_part")))
    return joined.withColumn("index", F.col("at") + F.col("shift")).drop("_tree", "_part", "at", "shift")


def block_node(levels: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("index")
        height = int(rows["height"].iloc[0])
        top = levels_of(rows["digest"].tolist(), min(height, levels))[-1][0]
        head = rows.iloc[:1]
        index = head["index"] // FANOUT**levels
        return pd.DataFrame({"tree": head["tree"], "index": index, "digest": [top], "height": [max(0, height - levels)]})

    return work


def block_paths(levels: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Path of each node of a block: inside the block, then that of the block's own node."""

    def work(rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("index").reset_index(drop=True)
        built = levels_of(rows["digest"].tolist(), min(int(rows["height"].iloc[0]), levels))
        head = next(above.itertuples(index=False))
        paths = [siblings(built, i) for i in range(len(rows))]
        left = [[p[0] for p in path] + list(head.left) for path in paths]
        right = [[p[1] for p in path] + list(head.right) for path in paths]
        return pd.DataFrame({"tree": rows["tree"], "index": rows["index"], "root": head.root, "left": left, "right": right})

    return work


NODE = "tree string, index long, digest string, height int"
PATH = "tree string, index long, root string, left array<string>, right array<string>"


def block_of(df: DataFrame, levels: int) -> DataFrame:
    return df.withColumn("block", F.expr(f"index div {FANOUT**levels}"))


def rise(leaves: DataFrame, levels: int) -> list[DataFrame]:
    """Tables of the nodes at the top of each round's blocks, written; the last holds each tree's root."""
    tables, nodes = [], leaves.select("tree", "index", "digest", "height")
    while True:
        nodes = block_of(nodes, levels).groupBy("tree", "block").applyInPandas(block_node(levels), NODE)
        tables.append(nodes := materialize(nodes, "merkle-nodes"))
        if nodes.where("index > 0").isEmpty():
            return tables


def descend(tables: list[DataFrame], roots: DataFrame, levels: int) -> DataFrame:
    """Path of every node of the lowest table up to the root of all trees, given the paths of the trees' roots."""
    paths = roots
    for nodes in reversed(tables[:-1]):
        above = paths.withColumnRenamed("index", "block")
        blocks = block_of(nodes, levels).groupBy("tree", "block").cogroup(above.groupBy("tree", "block"))
        paths = materialize(blocks.applyInPandas(block_paths(levels), PATH), "merkle-paths")
    return paths


@dataclass
class Manifest:
    """A built tree. `leaves`: carried columns, tree, index, height, digest, changed; `paths`: path of each block of leaves."""

    leaves: DataFrame
    subroots: DataFrame
    paths: DataFrame
    levels: int = BLOCK_LEVELS

    def _over_leaves(self, work, schema: str) -> DataFrame:
        above = self.paths.withColumnRenamed("index", "block").join(
            self.subroots.select("tree", F.col("digest").alias("subroot")), "tree"
        )
        blocks = block_of(self.leaves, self.levels).groupBy("tree", "block")
        return blocks.cogroup(above.groupBy("tree", "block")).applyInPandas(work, schema)

    def proofs(self) -> DataFrame:
        """Each leaf with its subroot, root, hash of siblings, and the root that its present content folds to."""

        levels = self.levels

        def work(rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
            out = []
            for doc_id, leaf, changed, path, head in leaf_paths(rows, above, levels):
                proof = sha256("".join(left + right for left, right in path).encode()).hexdigest()
                present = leaf if changed is None else changed
                folded = (fold(present, path) or [present])[-1]
                out.append((doc_id, leaf, head.subroot, head.root, proof, folded, folded == head.root))
            return pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

        schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
        names = [c.split()[0] for c in schema.split(", ")]
        return self._over_leaves(work, schema)

    def versions(self) -> DataFrame:
        """The nodes that each changed leaf's version copies: level 0 is the leaf; all other nodes are those of the tree."""

        levels = self.levels

        def work(rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
            out = []
            for doc_id, _, changed, path, head in leaf_paths(rows, above, levels):
                if changed is not None:
                    out += [(doc_id, head.tree, level, copy) for level, copy in enumerate([changed, *fold(changed, path)])]
            return pd.DataFrame(out, columns=["doc_id", "tree", "level", "digest"]).astype({"doc_id": "Int64"})

        return self._over_leaves(work, "doc_id long, tree string, level int, digest string")


def leaf_paths(rows: pd.DataFrame, above: pd.DataFrame, levels: int) -> Iterator[tuple]:
    """(doc_id, leaf, changed or None, path up to the root of all, the block's row) of every leaf of a block."""
    rows = rows.sort_values("index")
    leaves = rows["digest"].tolist()
    built = levels_of(leaves, min(int(rows["height"].iloc[0]), levels))
    head = next(above.itertuples(index=False))
    upper = list(zip(head.left, head.right))
    for i, (doc_id, leaf, changed) in enumerate(zip(rows["doc_id"].tolist(), leaves, rows["changed"].tolist())):
        known = None if pd.isna(doc_id) else int(doc_id)
        yield known, leaf, changed if isinstance(changed, str) else None, siblings(built, i) + upper, head


def manifest(docs: DataFrame, tamper: Changed = lowered, levels: int = BLOCK_LEVELS) -> Manifest:
    """Builds the tree of a documents table: a tree for each source, and one over the sources.

    `tamper` gives a condition and changed columns; rows that meet it carry the digest of their changed content as well.
    """
    fields = {c: F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")}
    hit, changed = tamper(fields)
    # Null sources sort before all texts, as "-" does before "s".
    tree = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("-"))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        tree.alias("tree"),
        digest(list(fields.values())).alias("digest"),
        F.when(hit, digest(list(changed.values()))).alias("changed"),
    )
    leaves = materialize(numbered(materialize(rows, "merkle-leaves"), "tree", ["doc_id", "digest"]), "merkle-leaves")
    tables = rise(leaves, levels)
    subroots = tables[-1]
    # The tree over the sources is built like the others, with the sources' roots as its leaves.
    tops = subroots.select(F.lit("").alias("all"), F.col("tree").alias("name"), "digest")
    tops = numbered(materialize(tops, "merkle-sources"), "all", ["name"]).withColumnRenamed("all", "tree")
    tops = materialize(tops, "merkle-sources")
    over = rise(tops, levels)
    none = F.array().cast("array<string>")
    top = over[-1].select("tree", "index", F.col("digest").alias("root"), none.alias("left"), none.alias("right"))
    above = descend([tops, *over], top, levels).join(tops.select("index", "name"), "index")
    roots = above.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("index"), "root", "left", "right")
    return Manifest(leaves, subroots, descend(tables, roots, levels), levels)
