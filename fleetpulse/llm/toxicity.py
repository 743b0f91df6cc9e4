"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration.

A lexicon of word beginnings is learned from some of the labelled rows; densities of its hits, their closeness to
second-person pronouns, capitals, punctuation and obfuscation make the features. Trees are fitted on more labelled rows
and calibrated on others. The features of all rows come from one numpy pass; trees and calibration run in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm import words as W
from fleetpulse.llm.tables import materialize

TRAINING_ROWS = 20_000
LEXICON_SIZE = 4096
STEM_LENGTHS = (4, 5, 6)
MIN_SUPPORT = 5
MIN_SHARE = 0.7
NEAR = 6
RUN = 64

# Second-person words of English, German, French and Spanish.
SECOND_PERSON = (
    "you your yours yourself u ur du dich dir dein deine deinen euch euer ihr tu te toi ton ta tes vous votre vos "
    "usted ustedes tú ti tus vosotros vuestro"
).split()

FEATURES = (
    "n_words hit_rate hits distinct_hits densest_run near_second second_rate capital_rate shouted_rate exclamations "
    "questions punctuation symbols mixed_words repeated_letters"
).split()
INPUTS = [f"_f_{name}" for name in FEATURES]

_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True
_ODD = np.zeros(256, bool)
_ODD[[*range(ord("0"), ord("9") + 1), *(ord(c) for c in "@$*")]] = True
_INSIDE = _LETTER | _ODD


def _mask(characters: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in characters]] = True
    return out


_CAPITAL, _EXCLAMATION, _QUESTION = _mask("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _mask("!"), _mask("?")
_PUNCTUATION, _SYMBOL = _mask(".,;:'\"()-"), _mask("#%&|<>*$@")


def stems(s: W.Scan) -> list[np.ndarray]:
    """Hashes of the first 4, 5 and 6 characters of every word; 0 where a word is shorter."""
    head = np.concatenate([(s.data & 0xC0) != 0x80, [True]])
    heads = np.flatnonzero(head)
    first = np.searchsorted(heads, s.start)
    out = []
    for k in STEM_LENGTHS:
        stop = heads[np.minimum(first + k, heads.size - 1)] if s.start.size else s.end
        stop = np.minimum(stop, s.end)
        last = np.searchsorted(heads, stop) if s.start.size else stop
        out.append(np.where(last - first == k, s.runs.of(s.start, stop), np.uint64(0)))
    return out


def stem_counts(rows: DataFrame) -> DataFrame:
    """(stem, n, toxic): in how many texts of (text, label) a word begins so."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = np.array(batch.column("label").to_pylist(), np.int64)
            for at, end, s in W.scans(batch.column("text"), lower=True, inside=_INSIDE):
                doc, texts = s.doc, []
                for hashes in stems(s):
                    texts.append(np.unique(np.stack([doc[hashes > 0].astype(np.uint64), hashes[hashes > 0]]), axis=1))
                doc, stem = np.concatenate(texts, axis=1)
                stem, which = np.unique(stem, return_inverse=True)
                n = np.bincount(which, minlength=stem.size)
                toxic = np.bincount(which, labels[at:end][doc.astype(np.int64)], stem.size).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(stem.view(np.int64)), pa.array(n), pa.array(toxic)], ["stem", "n", "toxic"])

    parts = rows.select("text", "label").mapInArrow(count, "stem long, n long, toxic long")
    return parts.groupBy("stem").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))


def learn_lexicon(rows: DataFrame, size: int = LEXICON_SIZE) -> np.ndarray:
    """Sorted hashes of at most `size` word beginnings that toxic rows have far more often than others."""
    strong = (F.col("toxic") >= MIN_SUPPORT) & (F.col("toxic") >= MIN_SHARE * F.col("n"))
    top = stem_counts(rows).where(strong).orderBy(F.desc("toxic"), "stem").limit(size)
    return np.sort(np.array([r.stem for r in top.collect()], np.int64).view(np.uint64))


def features(docs: DataFrame, lexicon: np.ndarray, keep: tuple[str, ...] = ()) -> DataFrame:
    """FEATURES of every row of `docs`, computed from `text` alone, and its columns `keep`."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keep] + [f"{f} double" for f in INPUTS])
    one = [W.scan(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]), True).hashes[0] for w in SECOND_PERSON]
    second = np.array(sorted(one), np.uint64)

    def known(hashes: np.ndarray, table: np.ndarray) -> np.ndarray:
        if not table.size:
            return np.zeros(hashes.size, bool)
        return table[np.minimum(np.searchsorted(table, hashes), table.size - 1)] == hashes

    def of(raw: np.ndarray, s: W.Scan) -> list[np.ndarray]:
        found = stems(s)
        hits = [known(h, lexicon) for h in found]
        hit, is_second = np.logical_or.reduce(hits), known(s.hashes, second)
        doc, n = s.doc, s.n_words.size
        words = np.maximum(s.n_words, 1)

        def count(mask):
            return np.bincount(doc[mask], minlength=n)

        distinct, densest, near = np.zeros(n), np.zeros(n), np.zeros(n)
        at = np.flatnonzero(hit)
        if at.size:
            name = np.where(hits[0], found[0], np.where(hits[1], found[1], found[2]))[at]
            pairs = np.unique(np.stack([doc[at].astype(np.uint64), name]), axis=1)
            distinct = np.bincount(pairs[0].astype(np.int64), minlength=n)
            # Hits in the RUN words that begin with a hit, and hits with a pronoun NEAR words away, all in one text.
            reach = np.minimum(np.searchsorted(at, at + RUN), np.searchsorted(at, s.bounds[doc[at] + 1]))
            np.maximum.at(densest, doc[at], reach - np.arange(at.size))
            pronouns = np.concatenate([[0], np.cumsum(is_second)])
            low, high = np.maximum(at - NEAR, s.bounds[doc[at]]), np.minimum(at + NEAR + 1, s.bounds[doc[at] + 1])
            near = np.bincount(doc[at][pronouns[high] > pronouns[low]], minlength=n)
        size = np.maximum(np.diff(s.offsets), 1)
        letters = _LETTER[raw]
        odd = np.concatenate([[0], np.cumsum(_ODD[raw])])
        plain = np.concatenate([[0], np.cumsum(letters)])
        capital = np.concatenate([[0], np.cumsum(_CAPITAL[raw])])
        span = s.end - s.start
        mixed = (odd[s.end] > odd[s.start]) & (plain[s.end] > plain[s.start])
        shouted = (span > 2) & (capital[s.end] - capital[s.start] == span)
        same = np.zeros(raw.size, bool)
        same[2:] = letters[2:] & (raw[2:] == raw[1:-1]) & (raw[2:] == raw[:-2])
        return [
            np.log1p(s.n_words),
            count(hit) / words,
            np.log1p(count(hit)),
            distinct,
            densest,
            near / words,
            count(is_second) / words,
            s.per_text(_CAPITAL[raw]) / size,
            count(shouted) / words,
            s.per_text(_EXCLAMATION[raw]) / size,
            s.per_text(_QUESTION[raw]) / size,
            s.per_text(_PUNCTUATION[raw]) / size,
            s.per_text(_SYMBOL[raw]) / size,
            count(mixed) / words,
            s.per_text(same) / size,
        ]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for _, _, data, offsets in W.chunks(batch.column("text")):
                parts.append(of(data, W.scan(data, offsets, lower=True, inside=_INSIDE)))
            if parts:
                columns = [batch.column(k) for k in keep] + [pa.array(np.concatenate(c).astype(float)) for c in zip(*parts)]
                yield pa.RecordBatch.from_arrays(columns, [*keep, *INPUTS])

    return docs.select(*dict.fromkeys(("text", *keep))).mapInArrow(measure, schema)


def fold(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def score(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",), training_rows: int = TRAINING_ROWS) -> DataFrame:
    """The columns `keep` of every row of `docs` (doc_id, text, any others), and held_out, score (0 to 1) and predicted.

    `labels` has doc_id and toxic (0, 1; others are ignored). At most `training_rows` labelled ids outside fold 0 are used,
    chosen by hash: folds 1 and 2 teach the lexicon, 1 to 3 the trees, 4 the calibration. Ids only choose folds; a
    score depends on the text alone, so equal texts get equal scores. Null and empty texts are scored as texts of no words.
    Without labelled rows of both kinds every score is the share of toxic labels (0 without labels). A null id is not held out.
    Kept columns with the name of an added one are replaced.
    """
    spark = docs.sparkSession
    keep = tuple(k for k in keep if k not in ("held_out", "score", "predicted"))
    held_out = F.coalesce(fold() == 0, F.lit(False))
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("_label"))
    known = known.withColumn("_fold", fold("_id")).where("_fold <> 0").orderBy(F.xxhash64("_id"), "_id").limit(training_rows)
    chosen = known.collect()  # at most training_rows pairs of numbers
    share = sum(r._label for r in chosen) / max(len(chosen), 1)
    alike = docs.select(*keep, held_out.alias("held_out"), F.lit(float(share)).alias("score"))
    alike = alike.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    if share in (0, 1):
        return alike
    sample = spark.createDataFrame([(r._id, int(r._label), int(r._fold)) for r in chosen], "_id long, label long, fold long")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(sample), F.col("doc_id") == F.col("_id"))
    lexicon = learn_lexicon(rows.where("fold <= 2"))
    assembler = VectorAssembler(inputCols=INPUTS, outputCol="_features")
    # At most training_rows rows of a few numbers: many small jobs read them, so they are kept in few partitions.
    measured = materialize(features(rows, lexicon, ("label", "fold")), "toxicity").coalesce(4)
    training = assembler.transform(measured).select("label", "fold", "_features").cache()
    trees = GBTClassifier(
        labelCol="label", featuresCol="_features", predictionCol="_class", maxIter=20, maxDepth=4, maxBins=64, minInstancesPerNode=5, stepSize=0.2, seed=11
    )
    trees = trees.setRawPredictionCol("_raw").setProbabilityCol("_chances")
    kinds = {(r.label, r.fold <= 3) for r in training.select("label", "fold").distinct().collect()}
    if len({label for label, _ in kinds}) < 2:
        return alike
    both = {(0, True), (1, True)} <= kinds
    model = trees.fit(training.where("fold <= 3") if both else training)
    margin = vector_to_array("_raw")[1]
    calibration = model.transform(training.where("fold = 4") if both else training).select("label", margin.alias("_margin"))
    steps = IsotonicRegression(labelCol="label", featuresCol="_margin", predictionCol="_chance")
    calibrated = steps.fit(calibration) if calibration.head(1) else None
    training.unpersist()
    marked = docs.withColumn("held_out", held_out).withColumn("text", F.col("text").cast("string"))
    scored = model.transform(assembler.transform(features(marked, lexicon, (*keep, "held_out"))))
    scored = scored.select(*keep, "held_out", margin.alias("_margin"))
    order = 1 / (1 + F.exp(-2 * F.col("_margin")))
    scored = calibrated.transform(scored) if calibrated is not None else scored.withColumn("_chance", order)
    chance = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("_chance")))
    # Among texts that calibration puts on one step, the margin keeps its order.
    value = 0.98 * chance + 0.02 * order
    value = F.when(chance >= 0.5, F.greatest(F.lit(0.5), value)).otherwise(F.least(F.lit(0.4999), value))
    return scored.select(*keep, "held_out", value.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
