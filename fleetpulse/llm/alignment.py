"""Alignment of two tokenisations of the same texts, and how often ids of the two vocabularies meet.

Both tokenisers cut the bytes of a space and the text. The ends of their tokens are two ascending lists; the shorter list of a
text drives an exponential and then binary search into the longer. Ends in both lists cut the tokens into groups; tokens of a
group are linked, each of one side with each of the other.

Links are counted over the corpus as distinct id pairs per document. Pairs held by more than one part in 2^18 of all
(document, pair) rows are at most 2^18, so they are broadcast; no other pair has more rows than that part, so the rest is
joined by key without a hot one. The highest count of each id of the first vocabulary is at most one row per id.

Texts that are null, empty, or hold U+2581 (which the second vocabulary turns into a space) have no tokens: their figures
are 0 and their digest is ''. Null ids and repeated rows are rows of their own. Other columns are ignored. A text's distinct
links are held in memory at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm import tokens
from fleetpulse.llm import words as W
from fleetpulse.llm.tables import materialize

FREQUENT = 1 << 18  # at most so many pairs are broadcast
B_BITS = 15  # ids of the second vocabulary
SMALL_GROUP = 256  # links of larger groups are counted by distinct ids


def gallop(keys: np.ndarray, ends: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Index of the first end that is not below each key; no key exceeds the last end.

    From a first guess the step doubles until key and end have changed sides, then the bracket is halved.
    """
    low, high = start.copy(), start.copy()
    below = ends[start] < keys
    step, active = 1, np.flatnonzero(below)
    while active.size:
        low[active] = high[active]
        high[active] = np.minimum(high[active] + step, ends.size - 1)
        active = active[ends[high[active]] < keys[active]]
        step *= 2
    step, active = 1, np.flatnonzero(~below)
    while active.size:
        high[active] = low[active]
        low[active] = np.maximum(low[active] - step, -1)
        active = active[(low[active] >= 0) & (ends[low[active]] >= keys[active])]
        step *= 2
    active = np.flatnonzero(high - low > 1)
    while active.size:
        middle = (low[active] + high[active]) >> 1
        small = ends[middle] < keys[active]
        low[active[small]] = middle[small]
        high[active[~small]] = middle[~small]
        active = active[high[active] - low[active] > 1]
    return high


@dataclass
class Aligned:
    """A run of texts: ids of both sides, where each text's tokens begin, and the last token of each group on both sides."""

    a: np.ndarray
    b: np.ndarray
    a_bounds: np.ndarray
    b_bounds: np.ndarray
    a_last: np.ndarray
    b_last: np.ndarray

    def __post_init__(self):
        self.n_a, self.n_b = np.diff(self.a_last, prepend=-1), np.diff(self.b_last, prepend=-1)
        self.bounds = np.searchsorted(self.a_last, self.a_bounds)  # groups by text

    def per_text(self, values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values)])
        return np.diff(total[self.bounds])

    def rendered(self) -> Iterator[bytes]:
        """Each text's groups as decimal ids: sides joined by a bar, groups by semicolons."""
        group_a, group_b = (np.repeat(np.arange(n.size), n) for n in (self.n_a, self.n_b))
        at_a = np.arange(self.a.size) + (self.b_last - self.n_b + 1)[group_a]
        at_b = np.arange(self.b.size) + (self.a_last + 1)[group_b]
        cells = np.zeros((self.a.size + self.b.size, 6), np.uint8)
        for ids, at, last, end in ((self.a, at_a, self.a_last, b"|"), (self.b, at_b, self.b_last, b";")):
            mark = np.full(ids.size, ord(","), np.uint8)
            mark[last] = end[0]
            cells[at, :5] = _digits()[ids]
            cells[at, 5] = mark
        used = cells != 0
        stops = np.concatenate([[0], np.cumsum(used.sum(axis=1))])[self.a_bounds + self.b_bounds]
        text = cells[used].tobytes()
        for first, end in zip(stops[:-1].tolist(), stops[1:].tolist()):
            yield text[first : max(first, end - 1)]

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct id pairs of each text (as a << 15 | b), how often each is linked, and their bounds by text."""
        text = np.repeat(np.arange(self.bounds.size - 1), np.diff(self.bounds))
        first_a, first_b = self.a_last - self.n_a + 1, self.b_last - self.n_b + 1
        size = self.n_a * self.n_b
        small = np.flatnonzero(size <= SMALL_GROUP)
        of = np.repeat(small, size[small])
        k = np.arange(of.size) - np.repeat(np.cumsum(size[small]) - size[small], size[small])
        own = self.a[first_a[of] + k // self.n_b[of]].astype(np.int64) << B_BITS | self.b[first_b[of] + k % self.n_b[of]]
        keys, times = [text[of] << 32 | own], [np.ones(of.size, np.int64)]
        for g in np.flatnonzero(size > SMALL_GROUP).tolist():
            a, in_a = np.unique(self.a[first_a[g] : self.a_last[g] + 1], return_counts=True)
            b, in_b = np.unique(self.b[first_b[g] : self.b_last[g] + 1], return_counts=True)
            keys.append((text[g] << 32 | a.astype(np.int64)[:, None] << B_BITS | b).ravel())
            times.append((in_a[:, None] * in_b).ravel())
        unique, which = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(unique.size, np.int64)
        np.add.at(total, which, np.concatenate(times))
        bounds = np.searchsorted(unique, np.arange(self.bounds.size) << 32)
        return (unique & 0xFFFFFFFF).astype(np.int32), total, bounds


def _digits(known: dict = {}) -> np.ndarray:  # noqa: B006
    """Decimal digits of numbers under 2^16, filled up with zero bytes."""
    if not known:
        text = np.array([str(i) for i in range(1 << 16)], "S5")
        known["table"] = text.view(np.uint8).reshape(-1, 5)
    return known["table"]


def align(texts: pa.Array, directory: str | None = None) -> Iterator[Aligned]:
    """Aligned tokens of runs of texts, in order; a text without tokens has no groups."""
    a_encoder, b_encoder = tokens.encoder(directory, 1), tokens.piece_encoder(directory)
    texts = texts.cast(pa.large_string()).fill_null("")
    usable = pc.and_(pc.greater(pc.binary_length(texts), 0), pc.invert(pc.match_substring(texts, tokens.MARK)))
    space, empty = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
    spaced = pc.if_else(usable, pc.binary_join_element_wise(space, texts, empty), empty)
    for first, end, data, offsets in W.chunks(spaced):
        rows = [ids[:-1] for ids in a_encoder.encode(spaced.slice(first, end - first), specials=False)]
        a = np.concatenate(rows).astype(np.int64)
        a_bounds = np.concatenate([[0], np.cumsum([r.size for r in rows])])
        b, b_bounds = b_encoder.encode(data, offsets)
        b = b.astype(np.int64)
        # Both sides cover the same bytes, so ends over the whole run compare, and each text's end is in both lists.
        a_ends, b_ends = np.cumsum(a_encoder.n_bytes[a]), np.cumsum(b_encoder.n_bytes[b])
        sides = (a_ends, a_bounds), (b_ends, b_bounds)
        a_shorter = np.diff(a_bounds) <= np.diff(b_bounds)
        common = []
        for drives, (short, short_bounds), (long, long_bounds) in ((a_shorter, *sides), (~a_shorter, *sides[::-1])):
            n_short, n_long = np.diff(short_bounds), np.diff(long_bounds)
            index = np.flatnonzero(np.repeat(drives, n_short))
            text = np.repeat(np.arange(n_short.size), n_short)[index]
            guess = long_bounds[text] + (index - short_bounds[text]) * n_long[text] // np.maximum(n_short[text], 1)
            found = gallop(short[index], long, guess) if index.size else index
            met = long[found] == short[index] if index.size else np.zeros(0, bool)
            common.append((index[met], found[met]))
        (a1, b1), (b2, a2) = common
        yield Aligned(a, b, a_bounds, b_bounds, np.sort(np.concatenate([a1, a2])), np.sort(np.concatenate([b1, b2])))


def groups(docs: DataFrame, directory: str | None = None) -> DataFrame:
    """One row for each group of each text: doc_id, group (from 0), the ids of both sides."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for run in align(batch.column("text"), directory):
                n = run.bounds.size - 1
                per_text = np.diff(run.bounds)
                ids = batch.column("doc_id").slice(at, n).take(pa.array(np.repeat(np.arange(n), per_text)))
                number = np.arange(run.a_last.size) - np.repeat(run.bounds[:-1], per_text)
                sides = []
                for values, last in ((run.a, run.a_last), (run.b, run.b_last)):
                    cuts = np.concatenate([[0], last + 1]).astype(np.int32)
                    sides.append(pa.ListArray.from_arrays(pa.array(cuts), pa.array(values.astype(np.int32))))
                yield pa.RecordBatch.from_arrays([ids, pa.array(number), *sides], ["doc_id", "group", "a", "b"])
                at += n

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, `group` long, a array<int>, b array<int>")


HELD = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, times array<long>"


def held_links(docs: DataFrame, directory: str | None = None) -> DataFrame:
    """Each text's counts, the digest of its groups, and its distinct linked pairs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for run in align(batch.column("text"), directory):
                n = run.bounds.size - 1
                counts = [np.diff(run.a_bounds), np.diff(run.b_bounds), np.diff(run.bounds), run.per_text(run.n_a * run.n_b)]
                digests = [sha256(r).hexdigest() if r else "" for r in run.rendered()]
                pairs, times, bounds = run.links()
                cuts = pa.array(bounds.astype(np.int32))
                lists = [pa.ListArray.from_arrays(cuts, pa.array(v)) for v in (pairs, times)]
                own = [batch.column(c).slice(at, n) for c in ("row", "doc_id")]
                columns = [*own, *(pa.array(c.astype(np.int64)) for c in counts), pa.array(digests, pa.string()), *lists]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in HELD.split(", ")])
                at += n

    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
    )
    return rows.mapInArrow(work, HELD)


def pair_counts(held: DataFrame) -> DataFrame:
    """Number of documents that hold each linked pair, and whether no pair of the same first id has more."""
    counts = materialize(held.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "link-counts")
    counts = counts.withColumn("a", F.shiftright("pair", B_BITS))
    best = counts.groupBy("a").agg(F.max("n").alias("most"))  # at most one row per id of the vocabulary
    return counts.join(F.broadcast(best), "a").select("pair", "a", F.col("pair").bitwiseAND((1 << B_BITS) - 1).alias("b"), "n", (F.col("n") == F.col("most")).alias("top"))


def align_counts(docs: DataFrame, directory: str | None = None, frequent: int = FREQUENT) -> DataFrame:
    """Per text: tokens, groups, links, the digest of its groups, links that are their first id's most usual, and summed counts."""
    held = materialize(held_links(docs, directory), "links")
    known = pair_counts(held).select("pair", "n", "top")
    rows = held.agg(F.sum(F.size("pairs"))).first()[0] or 0
    least = rows // frequent
    common, rare = known.where(F.col("n") > least), known.where(F.col("n") <= least)
    each = held.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link"))
    each = each.select("row", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times"))
    sums = [F.sum(F.when(F.col("top"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")]
    near = each.join(F.broadcast(common), "pair").groupBy("row").agg(*sums)
    far = each.join(F.broadcast(common.select("pair")), "pair", "left_anti").join(rare, "pair").groupBy("row").agg(*sums)
    base = held.drop("pairs", "times").withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")})
    parts = base.unionByName(near, allowMissingColumns=True).unionByName(far, allowMissingColumns=True)
    carried = [F.max(c).alias(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
    digest = F.max("groups_sha256").alias("groups_sha256")
    return parts.groupBy("row").agg(*carried, F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"), digest).drop("row")
