"""Secret scans: fixed rules, and character Markov models of random strings against ordinary identifiers.

Everything is a column expression; no Python runs in tasks. Spans count code points, the end is exclusive.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.llm.tables import fresh

# Kind, pattern, group that is the secret, and its least length.
RULES = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),  # a shorter run fails, and no match can begin inside a longer one
)
KINDS = [kind for kind, *_ in RULES] + ["markov"]

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ORDINARY = r"(?<![A-Za-z0-9+/_=-])[A-Za-z+/_=-]{12,}(?![A-Za-z0-9+/_=-])"
JOINTS = "/_=-"  # what joins a key to words
LEAST = 20
WINDOW = 256  # characters of a candidate that are judged at once
CHUNK = 4096  # characters of a text that substrings are taken from
BLOCK = 256
RANDOM_SAMPLES = 4096
SMOOTHING = 0.5
THRESHOLD = 0.4
SCALE = 1_000_000

SPAN = "array<struct<start:int,kind:int,end:int>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Running totals of an array of integers from 0 on, kept in blocks so that long arrays are not copied for each element."""
    last = lambda out: F.coalesce(F.try_element_at(out, F.lit(-1)), F.lit(0))
    grow = lambda all_, last_of: F.aggregate(
        all_, F.array().cast("array<int>"), lambda out, v: F.concat(out, F.array(combine(last(out), last_of(v)))))

    def blocks(all_: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(all_), F.lit(1)), F.lit(BLOCK))
        return F.transform(starts, lambda at: grow(F.slice(all_, at, F.lit(BLOCK)), lambda v: v))

    def joined(inner: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), grow(inner, last))
        return F.flatten(F.zip_with(inner, F.slice(before, F.lit(1), F.size(inner)), lambda b, o: F.transform(b, lambda v: combine(o, v))))

    return let(let(values, blocks), joined)


def matches(text: Column, kind: int, pattern: str, group: int, least: int) -> Column:
    """SPAN of the leftmost non-overlapping matches whose `group`, which ends the match, has `least` characters."""
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    secrets = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length)
    # Ends of matches: running sums of the gap before a match and its own size.
    steps = let(found, lambda sizes: F.zip_with(F.slice(gaps, F.lit(1), F.size(sizes)), sizes, lambda gap, size: gap + size))
    ends = let(steps, lambda s: running(s, lambda a, b: a + b))
    spans = F.zip_with(ends, secrets, lambda end, size: F.struct((end - size).alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
    return F.when(text.rlike(pattern), F.filter(spans, lambda x: x["end"] - x["start"] >= least)).otherwise(F.array().cast(SPAN))


def replaced(text: Column, spans: Column, fill: Callable[[Column, Column, Column], Column]) -> Column:
    """A text with `fill(is the first of those that touch, start, end)` instead of its spans, which are sorted by start.

    The text is read in chunks, since each substring counts characters from the front.
    """

    def cut(chunks: Column, start: Column, end: Column) -> Column:
        first = F.floor(start / CHUNK).cast("int")
        joined = F.array_join(F.slice(chunks, first + 1, F.floor((end - 1) / CHUNK).cast("int") - first + 1), "")
        return F.when(end > start, F.substring(joined, start - first * CHUNK + 1, end - start)).otherwise("")

    def build(x: Column) -> Column:
        def piece(at: Column) -> Column:
            start, end = F.get(spans, at)["start"], F.get(spans, at)["end"]
            before = F.when(at > 0, F.get(x["tops"], at - 1)).otherwise(F.lit(0))
            return F.concat(cut(x["chunks"], before, start), fill((at == 0) | (start > before), F.greatest(start, before), end))

        pieces = F.transform(F.sequence(F.lit(0), F.size(spans) - 1), piece)
        return F.array_join(F.concat(pieces, F.array(cut(x["chunks"], F.element_at(x["tops"], -1), F.length(text)))), "")

    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    tops = running(F.transform(spans, lambda s: s["end"]), F.greatest)
    parts = let(F.struct(chunks.alias("chunks"), tops.alias("tops")), build)
    return F.when(F.size(spans) == 0, text).otherwise(parts)


def random_strings(spark: SparkSession, n: int) -> DataFrame:
    """`n` labelled random strings of each kind that keys come in: hex, base64 and capitals with digits."""
    digest = F.sha2(F.col("id").cast("string"), 256)
    base64 = F.base64(F.unhex(digest))
    return spark.range(n).select(F.explode(F.array(digest, base64, F.upper(F.regexp_replace(base64, "[^A-Za-z0-9]", "")))).alias("word"))


def neighbours(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Each value of an array of two or more combined with the next."""
    return let(values, lambda v: F.zip_with(F.slice(v, F.lit(1), F.size(v) - 1), F.slice(v, F.lit(2), F.size(v) - 1), combine))


def pair_counts(words: DataFrame) -> DataFrame:
    """(pair, n): how often each character follows another; at most len(ALPHABET) ** 2 rows."""
    letters = F.split("word", "")
    pairs = words.where(F.length("word") > 1).select(F.explode(neighbours(letters, lambda a, b: F.concat(a, b))).alias("pair"))
    return pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("n"))


def ratios(random: dict[str, int], ordinary: dict[str, int]) -> list[int]:
    """log P(next | char) of random strings minus that of ordinary ones, times SCALE, for every pair of ALPHABET."""

    def logs(counts: dict[str, int]) -> list[float]:
        out = []
        for a in ALPHABET:
            row = [counts.get(a + b, 0) + SMOOTHING for b in ALPHABET]
            out += [math.log(x / sum(row)) for x in row]
        return out

    return [round((r - o) * SCALE) for r, o in zip(logs(random), logs(ordinary))]


def train(docs: DataFrame, random_samples: int = RANDOM_SAMPLES) -> list[int]:
    """Ratios learned from random strings and from the distinct long words without digits of all documents."""
    spark = docs.sparkSession
    words = docs.select(F.explode(F.regexp_extract_all(F.col("text"), F.lit(ORDINARY), F.lit(0))).alias("word")).distinct()
    counts = [{r.pair: r.n for r in pair_counts(w).collect()} for w in (random_strings(spark, random_samples), words)]
    return ratios(*counts)


def pair_ratios(word: Column, model: list[int]) -> Column:
    """Log-likelihood ratio, times SCALE, of each transition of a word over ALPHABET; above 0 the random model is likelier."""
    table = F.from_json(F.lit(json.dumps(model)), "array<bigint>")
    codes = F.transform(F.split(word, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    return neighbours(codes, lambda a, b: F.element_at(table, (a - 1) * len(ALPHABET) + b))


def stretches(ratios: Column, threshold: float) -> Column:
    """(start, end) of characters over which the ratios stay at `threshold` or more on the mean, each from where their running
    surplus leaves 0 to where it is largest before it falls below 0 again."""
    limit = round(threshold * SCALE)
    state = lambda total, start, best, end, i, out: F.struct(
        total.cast("long").alias("total"), start.alias("start"), best.cast("long").alias("best"), end.alias("end"), i.alias("i"), out.alias("out")
    )
    closed = lambda s: F.when(s["best"] > 0, F.concat(s["out"], F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))).otherwise(s["out"])

    def step(s, ratio):
        total, i = s["total"] + ratio - limit, s["i"] + 1
        higher = total > s["best"]
        on = state(total, s["start"], F.greatest(s["best"], total), F.when(higher, i + 1).otherwise(s["end"]), i, s["out"])
        return F.when(total < 0, state(F.lit(0), i, F.lit(0), i, i, closed(s))).otherwise(on)

    zero = F.lit(0)
    return F.aggregate(ratios, state(zero, zero, zero, zero, zero, F.array().cast("array<struct<start:int,end:int>>")), step, closed)


def random_parts(word: Column, model: list[int], threshold: float) -> Column:
    """(start, end) of the random parts of a word over ALPHABET: the whole word where its mean ratio reaches `threshold`, and
    else every stretch that does, widened to the joints around it if the mean allows it; of LEAST characters each."""
    mean = lambda values: F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x) / F.size(values) / SCALE
    span = lambda start, end: F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))
    joints = lambda start, end, pattern: F.length(F.regexp_extract(F.substring(word, start + 1, end - start), pattern, 0))

    def fitted(s):
        # A joint at either end is no part of a key.
        start, end = s["start"] + joints(s["start"], s["end"], f"^[{JOINTS}]*"), s["end"] - joints(s["start"], s["end"], f"[{JOINTS}]*$")
        outer = span(start - joints(F.lit(0), start, f"(?<![^{JOINTS}])[^{JOINTS}]*$"), end + joints(end, F.length(word), f"^[^{JOINTS}]*"))
        inner = span(start + joints(start, end, f"^[^{JOINTS}]*[{JOINTS}]+"), end - joints(start, end, f"[{JOINTS}]+[^{JOINTS}]*$"))
        return F.struct(s.alias("own"), outer.alias("outer"), inner.alias("inner"))

    def kept(x, ratios):
        pick = lambda a, b: span(x[a]["start"], x[b]["end"])
        # Whole parts between joints first, then without a part that the stretch only touches.
        tried = F.array(*(pick(a, b) for a in ("outer", "inner") for b in ("outer", "inner")), x["own"])
        long = F.filter(tried, lambda c: c["end"] - c["start"] >= LEAST)
        return F.filter(long, lambda c: mean(F.slice(ratios, c["start"] + 1, c["end"] - c["start"] - 1)) >= threshold)

    def parts(ratios):
        found = F.transform(stretches(ratios, threshold), fitted)
        first = F.transform(found, lambda x: F.try_element_at(kept(x, ratios), F.lit(1)))
        some = F.array_distinct(F.filter(first, lambda s: s.isNotNull()))
        return F.when(mean(ratios) >= threshold, F.array(span(F.lit(0), F.length(word)))).otherwise(some)

    return let(pair_ratios(word, model), parts)


def scan(docs: DataFrame, model: list[int] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Adds `base_spans` and `all_spans` (SPAN, by start, then kind) to every row of `docs`.

    `all_spans` has every base span, and of candidate strings of 20 characters or more what no base span covers: the whole
    where its mean ratio reaches `threshold`, and else the stretches of 20 characters or more that do. Candidates over WINDOW
    characters are judged in windows of that many, so work grows with a text's length. Null text counts as empty and has no
    spans; repeated rows get the same spans; an empty table gives an empty table. Columns of `docs` with the name of an added one
    are replaced.
    """
    docs = docs.drop("base_spans", "all_spans")
    names = fresh(docs, "text_", "rest", "base")
    text, rest, base = map(F.col, names)
    given = F.coalesce(F.col("text").cast("string"), F.lit(""))
    model = train(docs.select(given.alias("text"))) if model is None else model
    docs = docs.withColumn(names[0], given)
    found = F.concat(*(matches(text, kind, p, g, n) for kind, (_, p, g, n) in enumerate(RULES)))
    docs = docs.withColumn(names[2], F.array_sort(found))
    # Base spans are blanked out, so that candidates are what they leave.
    docs = docs.withColumn(names[1], replaced(text, base, lambda new, start, end: F.repeat(F.lit(" "), F.greatest(end - start, F.lit(0)))))
    words = F.regexp_extract_all(rest, F.lit(CANDIDATE), F.lit(0))
    windows = lambda word: F.regexp_extract_all(word, F.lit(f".{{1,{WINDOW}}}(?:.{{0,{LEAST - 1}}}$)?"), F.lit(0))
    shifted = lambda at, p: F.struct((at + p["start"]).alias("start"), F.lit(len(RULES)).alias("kind"), (at + p["end"]).alias("end"))

    def judged(run: Column, word: Column) -> Column:
        parts = lambda part, i: F.transform(random_parts(part, model, threshold), lambda p: shifted(run["start"] + i * WINDOW, p))
        return F.flatten(F.transform(windows(word), parts))

    odd = F.flatten(F.zip_with(matches(rest, len(RULES), CANDIDATE, 0, LEAST), words, judged))
    return docs.withColumn("all_spans", F.array_sort(F.concat(base, odd))).withColumnRenamed(names[2], "base_spans").drop(*names[:2])


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind)))


def span_text(spans: str) -> Column:
    """`kind:start:end`, comma-joined."""
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"], s["end"])), ",")


def redacted(mark: str = "<secret>") -> Column:
    """`text` with every run of overlapping or touching `all_spans` replaced by `mark`; a null text stays null."""
    fill = lambda new, start, end: F.when(new, F.lit(mark)).otherwise("")
    return replaced(F.col("text").cast("string"), F.col("all_spans"), fill)
