"""Quality rules: text statistics, and a log-likelihood ratio of hashed n-grams between trusted and raw text.

Two multinomials over hashed byte n-grams are counted: one over the trusted texts, one over all texts. The score of a text
is the mean over its n-grams of log(p_trusted / p_raw); texts under `threshold` are dropped. Scores are sums of
integers, so equal texts get equal scores on every cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm import words as W

BUCKETS = 1 << 16
N = 4
THRESHOLD = -0.75
SCALE = 1 << 20

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True

STATS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, llr double"


def byte_grams(data: np.ndarray, offsets: np.ndarray, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all byte n-grams within a text, and their bounds by text. A shorter text has none."""
    counts = np.maximum(np.diff(offsets) - n + 1, 0)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    first = np.arange(bounds[-1]) + np.repeat(offsets[:-1] - bounds[:-1], counts)
    h = np.zeros(first.size, np.uint64)
    for j in range(n):
        h = (h << np.uint64(8)) | data[first + j]
    return (W.mix(h) % np.uint64(buckets)).astype(np.int64), bounds


def gram_counts(docs: DataFrame, n: int = N, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all rows of (text); a task reports each bucket once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, offsets in W.chunks(batch.column("text")):
                total += np.bincount(byte_grams(data, offsets, n, buckets)[0], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    return docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def log_ratios(raw: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """log(p_trusted / p_raw) of every bucket times SCALE, with half a count added to each; zeros without trusted text.

    The tables (bucket, n) have at most `buckets` rows each, whatever the size of the corpus.
    """

    def counts(table: DataFrame) -> np.ndarray:
        out = np.full(buckets, 0.5)
        for row in table.collect():
            out[row.bucket] += row.n
        return out

    all_, good = counts(raw), counts(trusted)
    if good.sum() == 0.5 * buckets:
        return np.zeros(buckets, np.int64)
    return np.rint(np.log(good / good.sum() / (all_ / all_.sum())) * SCALE).astype(np.int64)


def repeated_words(s: W.Scan, k: int = 5) -> np.ndarray:
    """Words of each text that lie in a window of k words which the text has twice or more."""
    grams, bounds = s.n_grams(k)
    out = np.zeros(s.bounds.size - 1, np.int64)
    for t in np.flatnonzero(np.diff(bounds) > 1):
        own = grams[bounds[t] : bounds[t + 1]]
        ranked = np.sort(own)
        twice = ranked[1:][ranked[1:] == ranked[:-1]]
        if twice.size:
            hit = np.flatnonzero(np.isin(own, twice))
            covered = np.zeros(own.size + k, np.int64)
            np.add.at(covered, hit, 1)
            np.add.at(covered, hit + k, -1)
            out[t] = np.count_nonzero(np.cumsum(covered))
    return out


def repeated_lines(s: W.Scan) -> np.ndarray:
    """Lines of each text that hold a word and equal an earlier line."""
    breaks = np.flatnonzero(s.data == 10)
    begins = np.sort(np.concatenate([s.offsets[:-1], breaks + 1]))
    ends = np.sort(np.concatenate([breaks, s.offsets[1:]]))
    with_word = np.searchsorted(s.start, ends) > np.searchsorted(s.start, begins)
    begins, ends = begins[with_word], ends[with_word]
    hashes = s.runs.of(begins, ends)
    bounds = np.searchsorted(begins, s.offsets)
    out = np.zeros(s.bounds.size - 1, np.int64)
    for t in np.flatnonzero(np.diff(bounds) > 1):
        own = hashes[bounds[t] : bounds[t + 1]]
        out[t] = own.size - np.unique(own).size
    return out


def text_statistics(docs: DataFrame, ratios: np.ndarray, n: int = N) -> DataFrame:
    """STATS of every row of (doc_id, text)."""
    buckets = ratios.size

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for _, _, s in W.scans(batch.column("text"), lower=False):
                letters = ~W._SPACE[s.data] & ((s.data & 0xC0) != 0x80)
                grams, bounds = byte_grams(s.data, s.offsets, n, buckets)
                total = np.concatenate([[0], np.cumsum(ratios[grams])])
                sums = total[bounds[1:]] - total[bounds[:-1]]
                llr = sums / np.maximum(np.diff(bounds), 1) / SCALE
                parts.append((s.n_words, s.per_text(letters), s.per_text(_SYMBOLS[s.data]), repeated_lines(s), repeated_words(s), llr))
            if parts:
                columns = [batch.column("doc_id"), *(pa.array(np.concatenate(c)) for c in zip(*parts))]
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in STATS.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, STATS)


def quality_rules(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Statistics and verdict of every row of `docs` (doc_id, text, any others); `trusted` has the doc_id of good texts.

    The trusted multinomial is counted over the rows of all trusted ids, the raw one over all rows. `base_failed`: under
    10 words, or over 20 % of the words in repeated 5-word windows. `kept`: not base_failed and a mean ratio of at least
    `threshold`. Null and empty texts have no words and fail; repeated rows are judged alike; without trusted texts every
    ratio is 0 and only the base rules count; null ids are carried along.
    """
    ids = trusted.select(F.col("doc_id").alias("_id")).where("_id IS NOT NULL").distinct()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Trusted ids grow with the corpus: their parts meet the texts in a shuffle, and nothing is broadcast.
    good = docs.join(ids.hint("shuffle_hash"), F.col("doc_id") == F.col("_id"), "left_semi")
    ratios = log_ratios(gram_counts(docs), gram_counts(good))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (
        text_statistics(docs, ratios)
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("llr") >= F.lit(threshold)))
    )
