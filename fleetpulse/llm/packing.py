"""Packing by lexical retrieval: BM25 neighbours of a seed document fill its window.

Every text is tokenised and cut. Its full windows are sequences of their own. The rest of each text, ordered so that
lexically near texts of the whole table lie together (`likeness`), is dealt over shards; a shard builds a BM25 inverted
index of its pieces with the document frequencies and mean length of all, and each seed takes its best unused neighbours
until its window is full. The last neighbour is cut where the window ends, and what is
left of it seeds the next window, so that only a task's last window can stay open.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm import likeness
from fleetpulse.llm import words as W
from fleetpulse.llm.tables import materialize
from fleetpulse.llm.tokens import encoder, forget

WINDOW = 2048
END_ID = 1
SHARD_PIECES = 512
PARTITION_TOKENS = 4 << 20
TEXT_BYTES = 1 << 18  # encoded at once: what a worker keeps of freed memory goes by its largest arrays
BATCH_ROWS = 1024  # of packed rows that a task holds before it passes them on
K1, B = 1.2, 0.75

PIECES = "run long, doc_id long, start long, length long, doc_tokens long, ids binary"
PACKED = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def cut_texts(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, tokenizer_dir: str | None = None) -> DataFrame:
    """PIECES of every row of (run, doc_id, text): full windows, and a rest if there is one.

    `ids` are unsigned 32-bit integers, little-endian.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_dir, end_id).encode
        for batch in batches:
            runs, doc_ids = batch.column("run").to_pylist(), batch.column("doc_id").to_pylist()
            for at, end, _, _ in W.chunks(batch.column("text"), TEXT_BYTES):
                rows = []
                for run, doc_id, ids in zip(runs[at:end], doc_ids[at:end], encode(batch.column("text").slice(at, end - at))):
                    for start in range(0, ids.size, window):
                        piece = ids[start : start + window]
                        rows.append((run, doc_id, start, piece.size, ids.size, piece.astype("<u4").tobytes()))
                if rows:
                    kinds = [pa.int64()] * 5 + [pa.binary()]
                    columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                    yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in PIECES.split(", ")])
            likeness.release()

    return docs.select("run", F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def schedule_runs(docs: DataFrame, files: int) -> DataFrame:
    """Adds `run` to a table read from files: rows of `files` consecutive files have the same number (a column of that name is replaced).

    Writers number files by partition, and that number is read as such, not as text. Files without one are run 0.
    """
    part = F.regexp_extract(F.col("_metadata.file_path"), r"part-(\d+)[^/]*$", 1)
    return docs.drop("run").select("*", F.floor(F.coalesce(F.nullif(part, F.lit("")).cast("long"), F.lit(0)) / files).alias("run"))


RUN_BITS, TASK_BITS, NUMBER_BITS = 22, 20, 20
LOCAL_BITS = 1 + TASK_BITS + NUMBER_BITS  # the first bit tells rests from full windows


def in_run(run: int, task: int, number: int) -> int:
    """An id whose order goes by run; within it reversed bits spread any stretch of numbers evenly."""
    if run >> RUN_BITS or task >> TASK_BITS or number >> NUMBER_BITS:
        raise ValueError(f"no sequence id for run {run}, task {task}, number {number}")
    return run << LOCAL_BITS | int(f"{task << NUMBER_BITS | number:0{LOCAL_BITS}b}"[::-1], 2)


def full_in_run(run: Column, row: Column) -> Column:
    """`in_run` of full windows, for rows numbered by `monotonically_increasing_id`."""
    task, number = F.shiftright(row, 33), row.bitwiseAND(F.lit((1 << 33) - 1))
    fits = (run < 1 << RUN_BITS) & (task < 1 << TASK_BITS) & (number < 1 << NUMBER_BITS)
    local = F.shiftleft(task, NUMBER_BITS) + number + F.lit(1 << (LOCAL_BITS - 1))
    spread = F.conv(F.reverse(F.lpad(F.bin(local), LOCAL_BITS, "0")), 2, 10).cast("long")
    return F.when(fits, F.shiftleft(run, LOCAL_BITS).bitwiseOR(spread)).otherwise(F.raise_error(F.lit("no sequence id is left")).cast("long"))


class Shard:
    """A BM25 inverted index over pieces of ids, and which of them are still unused.

    `known` has the weights of a larger table that the pieces are from; without it they are counted here.
    """

    def __init__(self, pieces: list[tuple], known: likeness.Weights | None = None):
        self.pieces = pieces
        self.length = np.array([p[-1].size for p in pieces])
        self.free = np.ones(len(pieces), bool)
        # One sort by id, then piece, gives the postings and how often each piece holds the id.
        ids = np.concatenate([p[-1] for p in pieces]).astype(np.int64)
        places = np.sort(ids << 32 | np.repeat(np.arange(len(pieces)), self.length))
        first = np.flatnonzero(np.diff(places, prepend=-1))
        tf = np.diff(first, append=places.size)
        term, owner = places[first] >> 32, places[first] & 0xFFFFFFFF
        begin = np.flatnonzero(np.diff(term, prepend=-1))
        found, df = term[begin], np.diff(begin, append=term.size)
        which = np.repeat(np.arange(found.size), df)
        idf = known.idf[found] if known else np.log((len(pieces) - df + 0.5) / (df + 0.5))
        mean = known.mean if known else self.length.mean()
        # Ids that most pieces hold have no positive weight and are left out.
        use = idf[which] > 0
        owner, which, tf = owner[use], which[use], tf[use]
        norm = K1 * (1 - B + B * self.length / mean)
        self.known, self.owner, self.weight = found, owner, idf[which] * tf * (K1 + 1) / (tf + norm[owner])
        self.first = np.searchsorted(which, np.arange(found.size + 1))

    def ranked(self, ids: np.ndarray) -> np.ndarray:
        """Unused pieces, best match with `ids` first; ties in the shard's order."""
        query = likeness.distinct_ids(ids)
        at = np.minimum(np.searchsorted(self.known, query), self.known.size - 1)
        at = at[self.known[at] == query]
        begin, size = self.first[at], self.first[at + 1] - self.first[at]
        total = np.concatenate([[0], np.cumsum(size)])
        hits = np.arange(total[-1]) + np.repeat(begin - total[:-1], size)
        scores = np.bincount(self.owner[hits], self.weight[hits], self.free.size)
        order = np.argsort(-scores, kind="stable")
        return order[self.free[order]]


def fill_windows(
    pieces: Iterator[tuple], window: int, shard_pieces: int, first_id: int, known: likeness.Weights | None = None
) -> Iterator[tuple]:
    """PACKED rows for a stream of (doc_id, start, doc_tokens, ids). At most one shard is held at a time."""
    sequence, room, seed = first_id, window, None

    def placed(piece: tuple, size: int) -> tuple:
        doc_id, start, doc_tokens, ids = piece
        return doc_id, start, size, doc_tokens, sequence, window - room, ids[:size].astype("<u4").tobytes()

    while True:
        batch = [p for _, p in zip(range(shard_pieces), pieces)]
        if not batch:
            return
        shard, next_seed, rest = Shard(batch, known), 0, None
        while True:
            if room == window:  # a new window: what the last one cut off, or the next unused piece, is its seed
                if rest is None:
                    while next_seed < len(batch) and not shard.free[next_seed]:
                        next_seed += 1
                    if next_seed == len(batch):
                        break
                    shard.free[next_seed] = False
                    rest = batch[next_seed]
                seed = rest[-1]
                yield placed(rest, seed.size)
                room, rest = room - seed.size, None
            order = shard.ranked(seed)
            while room and order.size:
                fits = np.flatnonzero(shard.length[order] <= room)
                take = order[fits[0] if fits.size else 0]
                shard.free[take] = False
                doc_id, start, doc_tokens, ids = batch[take]
                size = min(room, ids.size)
                yield placed(batch[take], size)
                room -= size
                if size < ids.size:
                    rest = (doc_id, start + size, doc_tokens, ids[size:])
                order = order[order != take]
            if room:
                break  # no piece is left: the next shard goes on with this window
            sequence, room = sequence + 1, window


def pack(
    docs: DataFrame,
    window: int = WINDOW,
    end_id: int = END_ID,
    tokenizer_dir: str | None = None,
    shard_pieces: int = SHARD_PIECES,
    partition_tokens: int = PARTITION_TOKENS,
    run: str | None = None,
) -> DataFrame:
    """PACKED pieces of every row of `docs` (doc_id, text, any others): each id lies in exactly one.

    A text's ids are followed by `end_id`, so null and empty texts have that one id. Repeated rows and rows with a null id
    are packed like others. An empty table gives no rows. `sequence_id` numbers windows within a task, and `offset` has no
    gaps within a sequence. One window for each `partition_tokens` ids may stay open.

    `run` names a column of numbers from 0 that each stand for a stretch of a schedule. A sequence then holds pieces of one
    run only, sequences are numbered in the order of runs, and within a run in an even mix; likeness decides inside a run
    only. Each run may leave one more window open.
    """
    pieces = materialize(cut_texts(docs.withColumn("run", F.lit(0).cast("long") if run is None else F.col(run)), window, end_id, tokenizer_dir), "pieces")
    # Hashes spread many like rests over several partitions; the order of rows is the same whenever a task runs again.
    salt = F.xxhash64("doc_id", "start", F.crc32("ids"))
    rests = pieces.where(F.col("length") < window).withColumn("salt", salt)
    known = likeness.weights(rests)
    partitions = max(1, -(-round(known.rows * known.mean) // partition_tokens))
    keyed = likeness.dealt(rests.drop("length"), known, likeness.learn(rests, known), partitions)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()  # all texts are encoded by now, and the worker lives on for other work

        def stream():
            for batch in batches:
                own = (batch.column(c).to_pylist() for c in ("run", "doc_id", "start", "doc_tokens"))
                # Copies, as a piece may be held for longer than its batch.
                yield from zip(*own, (x.copy() for x in likeness.id_arrays(batch.column("ids"))))
                likeness.release()

        names, rows = [f.split()[0] for f in PACKED.split(", ")], []
        task, next_id = TaskContext.get().partitionId(), 0
        for of, pieces in groupby(stream(), itemgetter(0)):
            last = next_id
            for row in fill_windows((p[1:] for p in pieces), window, shard_pieces, next_id, known):
                last = row[4]
                number = last | task << 40 if run is None else in_run(int(of), task, last)
                rows.append((*row[:4], number, *row[5:]))
                if len(rows) == BATCH_ROWS:
                    yield frame(rows, names)
                    rows = []
            next_id = last + 1
        yield frame(rows, names)

    def frame(rows, names):
        kinds = [pa.int64()] * 6 + [pa.binary()]
        columns = zip(*rows) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    ordered = keyed.sortWithinPartitions("run", "leaf", "alike", "salt", "doc_id", "start", "ids")
    packed = ordered.select("run", "doc_id", "start", "doc_tokens", "ids").mapInArrow(fill, PACKED)
    number = F.monotonically_increasing_id()
    alone = pieces.where(F.col("length") == window).select(
        "doc_id",
        "start",
        "length",
        "doc_tokens",
        (F.lit(1 << 62) + number if run is None else full_in_run(F.col("run"), number)).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        "ids",
    )
    return packed.unionByName(alone)
