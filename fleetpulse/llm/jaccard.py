"""Exact Jaccard join of documents on word shingles in a metric space of regions around pivots.

The Jaccard distance of shingle sets is a metric. Texts that share little are all about 1 apart, so pivots that are documents
tell most of them nothing; the first regions therefore lie around single shingles, and documents become pivots where many
are close together:

1. Equal sets are one class. Every class enters the regions of its shingles below a fixed hash, the windows in which a linked
   set must meet it: a link leaves out at most 15 % of a set. A region with at most `REGION` classes is joined at once;
   a class with enough such regions to be sure (over 15 % of its size) is settled.
2. Classes that are not settled are small or lie in crowded regions. They are joined among themselves, in the regions of as
   many of their rarest shingles as a link can leave out, and one more. The most central class of a region leads it; leaders
   follow more central leaders near them, and the last is the home pivot whose cell takes the region. Near copies thus share one
   cell, and a class enters a further one only where its regions lead there.
3. Exact distances split a cell: classes within the threshold hang on the pivot and need no pairs with one another. The others
   are open. By the triangle inequality linked classes lie in the same or neighbouring rings around the pivot (a ring is as wide
   as the threshold), so only rings beside open classes stay. There two classes can be linked only if their distances to the
   pivot add up to no more than a link allows, or if they differ from the pivot in the same places; so the places of a cell
   are joined in turn as sets were.

All candidates are checked with whole sets. Results are components; no cap drops a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetpulse.llm import words as W
from fleetpulse.llm.components import components
from fleetpulse.llm.tables import fresh, materialize

SHINGLE = 4
PERCENT = 85
REGION = 32

SIGNATURE = "doc_id long, rid long, n long, cls long, low binary"
POSTING = "k long, kind int, cls long, n long"
MARKER, MEMBER, CROWDED = 0, 1, 2


def class_of(shingles: np.ndarray) -> int | None:
    """64-bit identity of a set of shingle hashes; None for the empty set."""
    if not shingles.size:
        return None
    parts = np.array([shingles.size, W.mix(shingles).sum(dtype=np.uint64), np.bitwise_xor.reduce(shingles)], np.uint64)
    return int(W.mix(parts * W._STEPS[0] + np.arange(3, dtype=np.uint64)).sum(dtype=np.uint64).view(np.int64))


def signatures(docs: DataFrame, k: int, share: float) -> DataFrame:
    """SIGNATURE of every row of (doc_id, rid, text): set size, class, and the shingles below `share` of the hash range."""
    limit = np.uint64(int(share * 2**64))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(W.shingle_sets(batch.column("text"), k))
            columns = [
                batch.column("doc_id"),
                batch.column("rid"),
                pa.array([s.size for s in sets], pa.int64()),
                pa.array([class_of(s) for s in sets], pa.int64()),
                pa.array([s[: np.searchsorted(s, limit)].tobytes() for s in sets], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in SIGNATURE.split(", ")])

    return docs.select("doc_id", "rid", "text").mapInArrow(sign, SIGNATURE)


def whole_sets(docs: DataFrame, k: int) -> DataFrame:
    """(cls, n, shingles) of every row of (text) that has words."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s for s in W.shingle_sets(batch.column("text"), k) if s.size]
            columns = [[class_of(s) for s in sets], [s.size for s in sets], [s.tobytes() for s in sets]]
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays(arrays, ["cls", "n", "shingles"])

    return docs.select("text").mapInArrow(build, "cls long, n long, shingles binary")


def _frame(k, kind, cls, n) -> pa.RecordBatch:
    arrays = [pa.array(k, pa.int64()), pa.array(kind, pa.int32()), pa.array(cls, pa.int64()), pa.array(n, pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, ["k", "kind", "cls", "n"])


def postings(classes: DataFrame, region: int) -> DataFrame:
    """POSTING rows of (cls, n, low). A shingle that over `region` classes of one batch share is crowded for sure: it sends one
    marker instead of its members, and each of these a count of such shingles."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = [np.frombuffer(x.as_py(), np.int64) for x in batch.column("low")]
            if not low:
                continue
            sizes = np.array([x.size for x in low])
            cls, n = (np.asarray(batch.column(c), np.int64).repeat(sizes) for c in ("cls", "n"))
            k = np.concatenate(low)
            keys, which, count = np.unique(k, return_inverse=True, return_counts=True)
            crowded = count[which] > region
            yield _frame(k[~crowded], np.full((~crowded).sum(), MEMBER), cls[~crowded], n[~crowded])
            if crowded.any():
                marked = keys[count > region]
                owner, times = np.unique(cls[crowded], return_counts=True)
                yield _frame(
                    np.concatenate([marked, owner]),
                    np.repeat([MARKER, CROWDED], [marked.size, owner.size]),
                    np.concatenate([np.zeros(marked.size, np.int64), owner]),
                    np.concatenate([np.zeros(marked.size, np.int64), times]),
                )

    return classes.select("cls", "n", "low").mapInArrow(post, POSTING)


def region_pairs(posted: DataFrame, region: int, percent: int) -> DataFrame:
    """(a, b, common): pairs of classes and in how many uncrowded regions they meet; with b null, a class's crowded regions.

    A task reads its regions one after the other and holds one region of at most `region` classes.
    """

    def emit(k, cls, n) -> pa.RecordBatch:
        """Pairs and crowded counts of whole regions."""
        begin = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        size = np.diff(np.append(begin, k.size))
        left, right = [], []
        for g in np.unique(size[(size > 1) & (size <= region)]):
            rows = begin[size == g][:, None] + np.arange(g)
            i, j = np.triu_indices(g, 1)
            left.append(rows[:, i].ravel())
            right.append(rows[:, j].ravel())
        x, y = (np.concatenate(s) if s else np.zeros(0, np.int64) for s in (left, right))
        fits = 100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])
        x, y = x[fits], y[fits]
        owner, times = np.unique(cls[np.repeat(size > region, size)], return_counts=True)
        a, b = np.minimum(cls[x], cls[y]), np.maximum(cls[x], cls[y])
        return batch_of(np.concatenate([a, owner]), b, np.concatenate([np.ones(a.size, np.int64), times]))

    def batch_of(a, b, common) -> pa.RecordBatch:
        """`b` may be shorter: the rest are nulls."""
        b = pa.concat_arrays([pa.array(b, pa.int64()), pa.nulls(a.size - b.size, pa.int64())])
        return pa.RecordBatch.from_arrays([pa.array(a), b, pa.array(common)], ["a", "b", "common"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        held = [none] * 3  # the last region so far, unless it is known to be crowded
        open_crowded = None
        for batch in batches:
            if not batch.num_rows:
                continue
            k, kind, cls, n = (np.asarray(batch.column(c), np.int64) for c in ("k", "kind", "cls", "n"))
            last = k[-1]
            yield batch_of(cls[kind == CROWDED], none, n[kind == CROWDED])
            marked = k[kind == MARKER] if open_crowded is None else np.append(k[kind == MARKER], open_crowded)
            k, cls, n = (np.concatenate([h, x[kind == MEMBER]]) for h, x in zip(held, (k, cls, n)))
            crowded = np.isin(k, marked)
            owner, times = np.unique(cls[crowded], return_counts=True)
            yield batch_of(owner, none, times)
            k, cls, n = k[~crowded], cls[~crowded], n[~crowded]
            open_crowded = last if last in marked else None
            tail = int(np.searchsorted(k, last)) if k.size else 0
            if k.size - tail > region:  # too many already: the region need not be held
                open_crowded, tail = last, k.size
            if tail:
                yield emit(k[:tail], cls[:tail], n[:tail])
            held = [k[tail:], cls[tail:], n[tail:]]
        if held[0].size:
            yield emit(*held)

    dealt = posted.repartition("k").sortWithinPartitions("k", "kind")
    return dealt.mapInArrow(join, "a long, b long, common long").groupBy("a", "b").agg(F.sum("common").alias("common"))


def least_common(n: Column, m: Column, percent: int) -> Column:
    """The fewest shingles that linked sets of n and m have in common."""
    return F.ceil((percent * (n + m)) / F.lit(100 + percent)).cast("long")


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, common, n, m): exact intersection sizes of the pairs (a, b); each set travels to its pairs once a side."""
    left = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("right"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x, y in zip(batch.column("left"), batch.column("right")):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                at = np.minimum(np.searchsorted(x, y), x.size - 1)
                rows.append((int(np.count_nonzero(x[at] == y)), x.size, y.size))
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *columns], ["a", "b", "common", "n", "m"])

    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "left", "right")
    return both.mapInArrow(count, "a long, b long, common long, n long, m long")


def is_link(percent: int) -> Column:
    return 100 * F.col("common") >= percent * (F.col("n") + F.col("m") - F.col("common"))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among the pairs, as many as connect what the pairs connect.

    First every class is checked against its smallest partner. Pairs whose classes hang on the same one by then
    need no check; all others are checked.
    """
    pairs = materialize(pairs.select("a", "b").distinct(), "pairs")
    first = pairs.groupBy("b").agg(F.min("a").alias("a"))
    stars = materialize(overlaps(first, sets).where(is_link(percent)).select("a", "b"), "stars")
    up = stars.select(F.col("b").alias("_node"), F.col("a").alias("_up"))

    def rooted(df: DataFrame, c: str) -> DataFrame:
        return df.join(up, F.col(c) == F.col("_node"), "left").withColumn(f"{c}_root", F.coalesce("_up", c)).drop("_node", "_up")

    tried = pairs.join(first.withColumnRenamed("a", "first"), "b").where("a <> first").drop("first")
    rest = rooted(rooted(tried, "a"), "b").where("a_root <> b_root").select("a", "b")
    return stars.unionByName(overlaps(rest, sets).where(is_link(percent)).select("a", "b"))


def crowded_pairs(sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Among classes that no uncrowded region settles: links to pivots, and the pairs that pivots cannot decide."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("shingles")]
            sizes = [x.size for x in found]
            for at in range(0, len(found), 256):
                part = slice(at, at + 256)
                cls, n = (np.asarray(batch.column(c), np.int64)[part].repeat(sizes[part]) for c in ("cls", "n"))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found[part])), pa.array(cls), pa.array(n)], ["k", "cls", "n"])

    members = materialize(sets.select("cls", "n", "shingles").mapInArrow(explode, "k long, cls long, n long"), "members")
    sizes = members.groupBy("k").agg(F.count(F.lit(1)).alias("df"))
    sized = members.join(sizes, "k")
    # How central a class is: the mean logarithm of how many classes share its shingles.
    central = sized.groupBy("cls").agg(F.avg(F.ln("df")).alias("c"), F.count_if(F.col("df") == 1).alias("alone"))
    # A shingle of one class only can be in no common set, but it takes its place among those a link may leave out.
    window = F.col("n") - F.ceil(percent * F.col("n") / 100) + 1 - F.col("alone")
    rank = F.row_number().over(Window.partitionBy("cls").orderBy("df", "k"))
    kept = sized.where("df > 1").withColumn("rank", rank).join(central, "cls").where(F.col("rank") <= window)
    regions = materialize(kept.select("k", "cls", "n", "c"), "regions")

    # The most central class of a region leads it, and the region's members all go to that leader's home pivot, so linked classes
    # still meet. Near copies name many leaders but few homes.
    leads = regions.groupBy("k").agg(F.max(F.struct("c", "cls")).alias("p"), F.count(F.lit(1)).alias("size")).where("size > 1")
    met = materialize(regions.join(leads.select("k", "p"), "k").select("p", "cls", "n", "c").distinct(), "met")
    homes = home_pivots(met, sets)
    placed = met.select(F.col("p.cls").alias("lead"), F.col("cls").alias("b"), F.col("c").alias("bc")).join(homes, "lead")
    cells = materialize(differences(placed.select("a", "b", "ac", "bc").distinct(), sets), "cells")
    links = cells.where("a <> b").where(is_link(percent)).select("a", "b", "ac", "bc")

    # A class hangs on the most central pivot it is linked with, and that one likewise: two steps upwards.
    up = links.groupBy("b").agg(F.max(F.struct(F.col("ac").alias("c"), F.col("a").alias("cls"))).alias("u")).select("b", F.col("u.cls").alias("up"))
    above = up.select(F.col("b").alias("up"), F.col("up").alias("top"))
    roots = materialize(up.join(above, "up", "left").select("b", F.coalesce("top", "up").alias("root")), "roots")
    far = F.col("n") + F.col("m") - 2 * F.col("common")
    ring = F.floor(100 * far / ((100 - percent) * (F.col("n") + F.col("m") - F.col("common")))).alias("ring")
    named = cells.select(F.col("a").alias("pivot"), F.col("b").alias("cls"), F.col("m").alias("n"), far.alias("far"), ring, "apart")
    named = named.join(roots.withColumnRenamed("b", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    named = named.join(roots.toDF("pivot", "top"), "pivot", "left").withColumn("open", F.col("root") != F.coalesce("top", "pivot"))
    # Cells without open classes are decided. Linked classes differ by no more than a ring's width in their distances to the
    # pivot (triangle inequality), so only the rings of open classes and their neighbours stay; a cell has 100 / (100 - percent).
    rings = named.where("open").groupBy("pivot").agg(F.collect_set("ring").alias("rings"))
    window = F.exists("rings", lambda r: F.abs(r - F.col("ring")) <= 1)
    named = materialize(named.join(rings, "pivot").where(window).drop("rings", "ring"), "open-cells")

    # x and y differ from one another where just one of them differs from the pivot: in far_x + far_y - 2 * shared places. A link
    # allows `most` places, so by the triangle inequality it needs far_x + far_y <= most or shared differences.
    def sides(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
        x, y = (d.select(*on, F.struct(*(c for c in d.columns if c not in on)).alias(n)) for d, n in ((df, "x"), (other, "y")))
        most = F.col("x.n") + F.col("y.n") - 2 * least_common(F.col("x.n"), F.col("y.n"), percent)
        both = x.join(y, on).withColumn("over", F.col("x.far") + F.col("y.far") - most)
        return both.where((F.col("x.root") != F.col("y.root")) & (~F.col("y.open") | (F.col("x.cls") < F.col("y.cls"))))

    def pairs_of(df: DataFrame) -> DataFrame:
        return df.select(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b"))

    plain = named.drop("apart").where(F.col("far") * percent <= F.col("n") * (100 - percent))
    close = pairs_of(sides(plain.where("open"), plain, ["pivot"]).where("over <= 0"))
    places = named.mapInArrow(spread, "pivot long, cls long, n long, far long, root long, open boolean, e long")
    shared = places.groupBy("pivot", "e").agg(F.count(F.lit(1)).alias("df"))
    order = Window.partitionBy("pivot", "cls").orderBy("df", "e")
    ranked = places.join(shared, ["pivot", "e"]).withColumn("rank", F.row_number().over(order)).where("df > 1").drop("df")
    ranked = materialize(ranked, "places")
    need = F.ceil(F.col("over") / 2)
    early = (F.col("x.rank") <= F.col("x.far") - need + 1) & (F.col("y.rank") <= F.col("y.far") - need + 1)
    meets = pairs_of(sides(ranked.where("open"), ranked, ["pivot", "e"]).where((F.col("over") > 0) & early))
    return links.select("a", "b"), close.unionByName(meets).distinct()


def home_pivots(met: DataFrame, sets: DataFrame) -> DataFrame:
    """(lead, a, ac): the pivot to whose cell each leader's regions go, and how central that is.

    A leader's candidates are the most central leader of its own regions, and that one's in turn; it goes to the last of
    them that shares half of the union with it, or stays a pivot itself. `met` has the leaders (p: c, cls) of each class's regions.
    """
    leaders = met.select(F.col("p.cls").alias("cls"), F.col("p.c").alias("own_c")).distinct()
    best = met.groupBy("cls").agg(F.max("p").alias("best")).join(leaders, "cls").select(F.col("cls").alias("lead"), "own_c", "best")
    ups = materialize(best, "leaders")
    for _ in range(2):
        above = ups.select(F.col("lead").alias("_at"), F.col("best").alias("_next"))
        ups = ups.join(above, F.col("best.cls") == F.col("_at"), "left").withColumn("best", F.coalesce("_next", "best")).drop("_at", "_next")
    steps = best.select("lead", "best").unionByName(ups.select("lead", "best")).where("lead <> best.cls").distinct()
    steps = materialize(steps, "leader-steps")
    near = overlaps(steps.select(F.col("best.cls").alias("a"), F.col("lead").alias("b")), sets)
    near = near.where(2 * F.col("common") >= F.col("n") + F.col("m") - F.col("common")).select(F.col("a").alias("_up"), F.col("b").alias("lead"))
    kept = steps.join(near, "lead").where("best.cls = _up").groupBy("lead").agg(F.max("best").alias("home"))
    chosen = leaders.withColumnRenamed("cls", "lead").join(kept, "lead", "left")
    homes = chosen.select("lead", F.coalesce("home.cls", "lead").alias("a"), F.coalesce("home.c", "own_c").alias("ac"))
    return materialize(homes, "homes")


def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each place in which a class differs from its pivot."""
    for batch in batches:
        apart = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("apart")]
        for at in range(0, len(apart), 512):
            part = apart[at : at + 512]
            rows = pa.array(np.repeat(np.arange(at, at + len(part)), [x.size for x in part]))
            kept = [batch.column(c).take(rows) for c in ("pivot", "cls", "n", "far", "root", "open")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(np.concatenate(part))], ["pivot", "cls", "n", "far", "root", "open", "e"])


def differences(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b, ac, bc) with their intersection and set sizes, and `apart`, the shingles that only one of them has."""
    left = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("right"))
    names = ["a", "b", "ac", "bc"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x, y in zip(batch.column("left"), batch.column("right")):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                apart = np.setxor1d(x, y, assume_unique=True)
                rows.append(((x.size + y.size - apart.size) // 2, x.size, y.size, apart.tobytes()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *columns], [*names, "common", "n", "m", "apart"])

    both = pairs.join(left, "a").join(right, "b").select(*names, "left", "right")
    return both.mapInArrow(compare, "a long, b long, ac double, bc double, common long, n long, m long, apart binary")


def row_id() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))


def near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, region: int = REGION) -> DataFrame:
    """(doc_id, n_shingles, component_id, rid, first_rid) of every row of `docs` (doc_id, text, any others).

    Words are runs of characters other than ASCII white space, A-Z folded. Sets link when their Jaccard similarity is at
    least `percent` %. component_id is the smallest doc_id that can be reached by links. A null text counts as empty; texts
    without words have no shingles and no links, and their own id as component. Repeated rows are in one component; rows with
    a null id link like others but never name a component. An empty table gives no rows. `rid` is a hash of id and text, and
    `first_rid` that of the row that stands for the group.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("rid", row_id())
    # Of the shingles below this share of the hash range, most sets have well over as many as a link may leave out.
    low_share = (100 - percent) / 60
    signed = materialize(signatures(docs, k, low_share), "signatures")
    classes = signed.where("cls IS NOT NULL").select("cls", "n", "rid", "low").dropDuplicates(["cls"])
    counted = materialize(region_pairs(postings(classes, region), region, percent), "regions")

    crowded = counted.where("b IS NULL").select(F.col("a").alias("_cls"), F.col("common").alias("crowded"))
    sizes = signed.where("cls IS NOT NULL").select("cls", "n", (F.length("low") / 8).cast("long").alias("low")).groupBy("cls").agg(F.first("n").alias("n"), F.first("low").alias("low"))
    open_low = F.col("low") - F.coalesce("crowded", F.lit(0))
    state = sizes.join(crowded, F.col("cls") == F.col("_cls"), "left").select("cls", "n", open_low.alias("low"))
    settled = F.col("low") > F.col("n") - F.ceil(percent * F.col("n") / 100)
    state = materialize(state.withColumn("settled", settled), "classes")

    def side(c: str) -> DataFrame:
        return state.select(F.col("cls").alias(c), *(F.col(x).alias(f"{c}_{x}") for x in ("n", "low", "settled")))

    # A link leaves out so few shingles that enough uncrowded regions must be common.
    both = counted.where("b IS NOT NULL").join(side("a"), "a").join(side("b"), "b").where("a_settled OR b_settled")
    least = least_common(F.col("a_n"), F.col("b_n"), percent)
    enough = F.greatest(F.col("a_low") - (F.col("a_n") - least), F.col("b_low") - (F.col("b_n") - least))
    candidates = materialize(both.where(F.col("common") >= enough).select("a", "b"), "candidates")

    open_classes = state.where("NOT settled").select("cls")
    needed = candidates.select(F.col("a").alias("cls")).unionByName(candidates.select(F.col("b").alias("cls"))).unionByName(open_classes).distinct()
    rows = signed.where("cls IS NOT NULL").groupBy("cls").agg(F.min("rid").alias("rid")).join(needed, "cls").select("rid").distinct()
    sets = materialize(whole_sets(docs.join(rows, "rid", "left_semi"), k).dropDuplicates(["cls"]), "sets")

    links = verified(candidates, sets, percent)
    pivot_links, pairs = crowded_pairs(sets.join(open_classes, "cls", "left_semi"), percent)
    links = links.unionByName(pivot_links).unionByName(verified(pairs, sets, percent))
    roots = components(links)

    # The row that stands for a group: the smallest id, nulls last, then the row's hash.
    place = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "rid")).alias("first")
    firsts = signed.where("cls IS NOT NULL").groupBy("cls").agg(place)
    named = firsts.join(roots, F.col("cls") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cls"))
    best = named.groupBy("root").agg(F.min("first").alias("best"))
    of_class = named.join(best, "root").select(F.col("cls").alias("_cls"), "best")
    out = signed.select("doc_id", "rid", F.col("n").alias("n_shingles"), "cls").join(of_class, F.col("cls") == F.col("_cls"), "left")
    alone = F.col("cls").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("component_id")
    first = F.when(alone, F.col("rid")).otherwise(F.col("best.rid")).alias("first_rid")
    return out.select("doc_id", "n_shingles", component, "rid", first)


def first_of_groups(docs: DataFrame, **parameters) -> DataFrame:
    """One row of each group of `near_duplicates`, whole: that of the smallest doc_id. Texts without words all stay; rows that
    repeat both id and text are one."""
    (own,) = fresh(docs, "rid")
    kept = near_duplicates(docs, **parameters).where("rid = first_rid").select(F.col("rid").alias(own))
    keyed = docs.withColumn(own, row_id())
    return keyed.join(kept.distinct(), own, "left_semi").dropDuplicates([own]).select(*(F.col(f"`{c}`") for c in docs.columns))
