"""Each operator against a plain version, on ordinary rows and on nulls, empty and long texts, ties, repeats and odd columns."""

import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from plain import SMALL
from fleetpulse.llm import jaccard, likeness, mixing, packing, preferences, quality, secrets, sharding, toxicity, url_filter, vectors
from fleetpulse.llm.components import components
from fleetpulse.llm.queries import ORACLE_SQL, QUERIES
from oracle_check import compare, connect

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ", held_out string, score string, n_words string, slot string, shard string, _text string, base_spans string"


def texts():
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma", "délta", "漢字", "x", "omega,", "😀", "zeta"]
    long = " ".join(rng.choice(words) + str(rng.randint(0, 9)) for _ in range(30_000))
    base = " ".join(rng.choice(words) + str(rng.randint(0, 99)) for _ in range(120))
    near = [base.replace("alpha", "alphb", i) for i in range(5)]
    return [None, "", " \t\n", "one", "One two", "one two three", long, base, base, base.upper(), *near, base + " tail", "a b c d e " * 20]


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(i, t, "en", "s" if i % 3 else None, None) for i, t in enumerate(texts())]
    rows += [(None, "no id", None, None, None), rows[7], (99, rows[7][1], None, "t", 3)]
    return spark.createDataFrame([r + ("?",) * 7 for r in rows], DOCS + EXTRA)


@pytest.fixture(scope="module")
def nothing(documents):
    return documents.where("false")


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# Secret scans

KEYS = ["AKIAABCDEFGHIJKL", "AKIASHORT", "deadbeef" * 5, "password: hunter22x", "Api_Key=\"abcd/efgh+12\"", "token = short", "SECRET:'12345678'"]


def check_spans(rows, scanned):
    for text, row in zip(rows, scanned):
        expected = plain.base_spans(text)
        assert [tuple(s) for s in row.base_spans] == expected
        assert set(expected) <= {tuple(s) for s in row.all_spans}


def test_secret_spans_equal_plain_ones(spark):
    rng = random.Random(1)
    parts = KEYS + ["password=key:abcdefgh12", "漢😀", "x" * 5, "\n", " ", "=", "api_key", "0123456789abcdef", "Tokentoken:tokenvalue", "kſecret=longenough1"]
    rows = [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    rows += ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(300)] + [None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string").coalesce(1)
    check_spans(rows, secrets.scan(df).orderBy("doc_id").collect())


def test_returned_columns_equal_plain_ones(spark, given):
    """n_*, base_sha256 and spans of the query, the model's spans included."""
    model = secrets.train(given)
    texts = {r.doc_id: r.text or "" for r in given.collect()}
    found = QUERIES["op1_secret_scan"](spark, SMALL).collect()
    assert len(found) == len(texts)
    for r in found:
        base = plain.base_spans(texts[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for _, k, _ in base) for kind in range(3))
        assert r.base_sha256 == plain.sha256(plain.span_text(base))
        assert r.spans == plain.span_text(plain.all_spans(texts[r.doc_id], model))


def test_model_spans_of_odd_runs_equal_plain_ones(spark, given):
    rng = random.Random(11)
    word = lambda n, letters=secrets.ALPHABET: "".join(rng.choice(letters) for _ in range(n))
    parts = ["customers", "documents", "international", "download", "v2", "="]
    texts = [word(n) for n in (19, 20, 21, 255, 256, 257, 275, 276, 277, 600, 1500)]
    for _ in range(60):
        pieces = [rng.choice(parts) if rng.random() < 0.7 else word(rng.randint(8, 40)) for _ in range(rng.randint(1, 60))]
        texts.append(rng.choice(["/", "_", "-", "="]).join(pieces) + rng.choice(["", " password: " + word(30), " é token=" + "a" * 40]))
    texts.append("😀 " * 3000 + "password=hunter2222 " + word(64) + " AKIA" + "B" * 20 + "/" + word(40))
    model = secrets.train(given)
    out = secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    for r in out:
        assert [tuple(s) for s in r.all_spans] == plain.all_spans(texts[r.doc_id], model), texts[r.doc_id][:200]


def test_long_runs_and_many_spans_are_scanned_in_linear_time(spark, given):
    rng = random.Random(4)
    blob = "".join(rng.choices(secrets.ALPHABET[:62], k=1_000_000))
    texts = [blob, " ".join(f"password={rng.getrandbits(60):016x}" for _ in range(100_000)), "é" + "x" * 1_000_000]
    begin = time.monotonic()
    model = secrets.train(given)
    scanned = secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), model)
    out = {r.doc_id: r for r in scanned.select("doc_id", F.size("base_spans").alias("n"), "all_spans", secrets.redacted().alias("text")).collect()}
    assert time.monotonic() - begin < 120
    assert [tuple(s) for s in out[0].all_spans] == plain.all_spans(blob, model)
    kept, at = "", 0
    for i, (start, _, end) in enumerate(plain.all_spans(blob, model)):
        kept += blob[at:start] + ("<secret>" if start > at or not i else "")
        at = max(at, end)
    assert out[0].text == kept + blob[at:]
    assert out[1].n == 100_000 and out[1].text == " ".join(["password=<secret>"] * 100_000)
    assert out[2].text == texts[2]


def test_secret_edge_rows(documents, nothing):
    scanned = secrets.scan(documents)
    rows = scanned.select("text", "base_spans", "all_spans").collect()
    check_spans([r.text for r in rows], rows)
    assert secrets.scan(nothing).count() == 0


def test_markov_finds_random_strings_only(spark):
    model = secrets.train(spark.read.parquet(SMALL.replace("0.001", "0.01") + "/documents.parquet"))
    keys = ["wJalrXUtnFEMI/K7MDENG+bPxRfiCYzzQ8s9Tq", "Zk3x9QwLm2Vb7Rt5Yp1Hs8Jd4Gf6", "ghp_a8Kd02LsmQ93jfXz71PqWeRt55Yu"]
    plain_words = ["internationalisierungen_der_dinge", "the-quick-brown-fox-jumps-over", "getElementsByTagNameAndClass", "=" * 40]
    df = spark.createDataFrame([(f"see {w} there",) for w in keys + plain_words], "text string").coalesce(1)
    spans = [r.all_spans for r in secrets.scan(df, model).collect()]
    assert [len(s) for s in spans] == [1, 1, 1, 0, 0, 0, 0]
    assert tuple(spans[0][0]) == (4, 3, 4 + len(keys[0]))


def test_markov_finds_keys_joined_to_words(spark):
    rng = random.Random(4)
    model = secrets.train(spark.read.parquet(SMALL.replace("0.001", "0.1") + "/documents.parquet"))
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    words = ["/customers/international/documents/download/", "https_client_configuration_production_environment=", "shipping-information-for-international-customers/downloads/"]
    rows = []
    for head in words:
        for size in (20, 24, 32):
            rows += [(head, "".join(rng.choices(letters, k=size)), tail) for tail in ("", "/international-documents") for _ in range(20)]
    base = "AKIA" + "Q7" * 8
    rows += [(f"{base}/", "".join(rng.choices(letters, k=32)), "") for _ in range(20)]
    df = spark.createDataFrame([(i, f"see {a}{k}{b} there") for i, (a, k, b) in enumerate(rows)], "doc_id long, text string").coalesce(1)
    spans = [r.all_spans for r in secrets.scan(df, model).orderBy("doc_id").collect()]
    covers = lambda i: sum(min(s.end, 4 + len(rows[i][0]) + len(rows[i][1])) - max(s.start, 4 + len(rows[i][0])) for s in spans[i] if s.kind == 3)
    assert sum(covers(i) >= len(rows[i][1]) - 2 for i in range(len(rows))) > 0.95 * len(rows)
    plain_words = spark.createDataFrame([(f"see {w}index there",) for w in words], "text string").coalesce(1)
    assert [len(r.all_spans) for r in secrets.scan(plain_words, model).collect()] == [0, 0, 0]


def test_redaction_replaces_overlapping_runs_once(spark):
    df = spark.createDataFrame([("é password=" + "ab" * 20 + " end",), (None,), ("clean",)], "text string").coalesce(1)
    out = [r[0] for r in secrets.scan(df, [0] * len(secrets.ALPHABET) ** 2).select(secrets.redacted()).collect()]
    assert out == ["é password=<secret> end", None, "clean"]


# Toxicity


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(3)
    words = [f"word{i}" for i in range(200)]
    rows = []
    for i in range(1000):
        text = [rng.choice(words) for _ in range(40)]
        toxic = int(i % 4 == 0)
        if toxic:
            for _ in range(3):
                text[rng.randrange(40)] = rng.choice(["snarkle", "grumphs", "blightyx"])
        rows.append((i, " ".join(text), toxic))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3)


def test_toxicity_held_out_accuracy(labelled):
    out = toxicity.score(labelled.drop("toxic"), labelled.drop("text")).join(labelled, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.predicted == r.toxic for r in held) / len(held) >= 0.97


def test_toxicity_edge_rows(labelled, documents, nothing):
    labels = labelled.drop("text")
    rows = documents.unionByName(labelled.select("doc_id", "text"), allowMissingColumns=True)
    out = toxicity.score(rows, labels)
    assert out.count() == rows.count() and out.where("score IS NULL").count() == 0
    twice = out.where("doc_id = 7").select("score").distinct()
    assert twice.count() <= 2  # the odd row and the labelled one of that id
    assert toxicity.score(nothing, labels).count() == 0
    assert {r.score for r in toxicity.score(documents, labels.where("false")).collect()} == {0.0}
    kept = toxicity.score(documents, labels.where("toxic = 1"), keep=tuple(documents.columns))
    assert set(documents.columns) <= set(kept.columns) and {r.score for r in kept.collect()} == {1.0}


# Preferences, URL filters, mixing and vectors against SQL


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert compare(QUERIES[name](spark, SMALL), connect(SMALL).sql(ORACLE_SQL[name])) is None


def test_preference_edge_rows(spark):
    schema = "pair_id long, turn long, role string, text string, part string"
    chosen = [(1, 0, "user", "hi", "?"), (1, 1, "assistant", "yo", "?"), (2, 0, None, None, "?"), (3, 0, "user", "a", "?"), (3, 0, "user", "a", "?"), (None, None, "assistant", "x", "?")]
    rejected = [(1, 0, "user", "hi", "?"), (1, 1, "assistant", "no", "?"), (1, 2, "user", "?", "?"), (2, 0, None, "", "?"), (3, 0, "user", "a", "?"), (4, 0, "assistant", "z", "?")]
    out = preferences.format_preferences(spark.createDataFrame(chosen, schema), spark.createDataFrame(rejected, schema)).collect()
    found = Counter((r.pair_id, r.part, r.turn) for r in out)
    assert found == Counter(
        [(1, "prompt", 0), (1, "chosen", 1), (1, "rejected", 1), (1, "rejected", 2), (2, "chosen", 0), (2, "rejected", 0)]
        + [(3, "chosen", 0)] * 2 + [(3, "rejected", 0), (4, "rejected", 0), (None, "chosen", None)]
    )
    trained = {(r.pair_id, r.part, r.turn): r.rendered[r.loss_start : r.loss_end] for r in out if r.loss_end}
    assert trained == {(1, "chosen", 1): "yo<|end|>", (1, "rejected", 1): "no<|end|>", (4, "rejected", 0): "z<|end|>", (None, "chosen", None): "x<|end|>"}
    empty = spark.createDataFrame([], schema)
    assert preferences.format_preferences(empty, empty).count() == 0
    assert {r.part for r in preferences.format_preferences(spark.createDataFrame(chosen, schema), spark.createDataFrame(chosen, schema)).collect()} == {"prompt"}


def test_url_filter_edge_rows(spark):
    day = lambda d: f"2024-01-{d:02d}"
    captures = [("http://A.b.example.org/x", day(5)), ("http://A.b.example.org/x", day(5)), ("https://u@b.example.org:80", day(9)), ("https://b.example.org", day(2)), (None, day(3)), ("no url", day(3)), ("http://example.org", None)]
    entries = [("b.example.org", day(3), "block"), ("B.example.org", day(8), "allow"), ("example.org", day(9), "block"), ("example.org", day(1), "allow"), ("b.example.org", day(3), "allow"), (None, day(1), "block"), ("x.y", None, "block"), ("b.example.org", day(4), "??")]
    cast = F.col("fetched_on").cast("date")
    df = spark.createDataFrame([c + ("?",) for c in captures], "url string, fetched_on string, host string").withColumn("fetched_on", cast).coalesce(1)
    listed = spark.createDataFrame(entries, "domain string, listed_on string, action string").withColumn("listed_on", F.col("listed_on").cast("date"))
    out = sorted(map(str, url_filter.filter_urls(df, listed).select("url", "domain", "blocked").collect()))
    assert out == sorted(
        ["Row(url='http://A.b.example.org/x', domain='b.example.org', blocked=True)"] * 2
        + ["Row(url='https://u@b.example.org:80', domain='b.example.org', blocked=False)", "Row(url='https://b.example.org', domain='example.org', blocked=False)"]
        + ["Row(url=None, domain=None, blocked=False)", "Row(url='no url', domain=None, blocked=False)", "Row(url='http://example.org', domain=None, blocked=False)"]
    )
    assert url_filter.filter_urls(df, listed.where("false")).where("blocked").count() == 0
    assert url_filter.filter_urls(df.where("false"), listed).count() == 0


# Near duplicates


def found_groups(df, **parameters):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df, **parameters).collect())


@pytest.mark.parametrize("region", [1, 3, 32])
def test_near_duplicates_equal_all_pairs(spark, region):
    rng = random.Random(region)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, common = [], [rng.choice(vocabulary) for _ in range(60)]
    for family in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 12, 40, 150]))] + (common if family % 3 == 0 else [])
        for _ in range(rng.choice([1, 2, 9])):
            text = list(base)
            for _ in range(rng.choice([0, 1, 2, 4])):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((len(rows) * 7 % 101, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found_groups(df, region=region) == Counter(plain.near_duplicates(rows))


def test_near_duplicates_edge_rows(documents, nothing):
    rows = pairs(documents)
    assert found_groups(documents) == Counter(plain.near_duplicates(rows))
    assert found_groups(nothing) == Counter()
    first = jaccard.first_of_groups(documents)
    groups = {c for _, n, c in plain.near_duplicates(rows) if n and c is not None}
    assert first.columns == documents.columns
    assert Counter(r.doc_id for r in first.where("doc_id IS NOT NULL").collect()) == Counter(groups | {0, 1, 2})


def test_components_are_reachable_sets(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 7), (200, 201), (300, 300)]
    out = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {out[i] for i in [*range(1, 41), 100]} == {1} and out[201] == 200


# Sharding


def test_lookup_table_is_even_and_stable():
    shards = [f"s{i}" for i in range(20)]
    before, after = sharding.lookup_table(shards, 5003), sharding.lookup_table(shards[:-1], 5003)
    sizes = Counter(before)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    moved = sum(a != b for a, b in zip(before, after) if a != 19)
    assert moved / 5003 < 0.2
    for bad in (dict(shards=[]), dict(shards=["a", "a"]), dict(shards=["a"], slots=4), dict(shards=["a"], weights={"a": 0})):
        with pytest.raises(ValueError):
            sharding.lookup_table(**bad)


def test_lookup_table_follows_turns():
    """A plain fill: whole permutations, and turns one slot at a time."""
    shards, slots = ["a", "b", "c"], 13
    order = {s: [(zlib.crc32(b"at:" + s.encode()) % slots + j * (zlib.crc32(b"by:" + s.encode()) % (slots - 1) + 1)) % slots for j in range(slots)] for s in shards}
    owner = {}
    while len(owner) < slots:
        for i, s in enumerate(shards):
            free = [x for x in order[s] if x not in owner]
            if free:
                owner[free[0]] = i
    assert sharding.lookup_table(shards, slots) == [owner[i] for i in range(slots)]


def test_sharding_edge_rows(documents, nothing):
    out = sharding.place(documents, F.col("doc_id"), ["a", "b"], slots=101)
    assert out.count() == documents.count() and out.where("shard IS NULL").count() == 0
    assert out.groupBy("doc_id").agg(F.count_distinct("slot").alias("n")).where("n > 1").count() == 0
    assert sharding.place(nothing, F.col("doc_id"), ["a"]).count() == 0


# Mixing


def test_mixing_follows_the_schedule_and_stays_within_a_block(spark):
    counts, shares = {"a": 300, "b": 40, "c": 7}, {"a": 5, "b": 2, "c": 1}
    rows = [(i, s) for s, n in counts.items() for i in range(n)]
    table = spark.createDataFrame(list(shares.items()), "source string, share long")
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), table, block_rows=4).collect()
    order = plain.schedule(shares)
    cycle = len(order)
    for r in out:
        turn, lap = r.block % shares[r.source], r.block // shares[r.source]
        assert r.slot == lap * cycle + order.index((r.source, turn)) and r.release <= r.slot < r.deadline
    assert Counter((r.source, r.source_row) for r in out) == Counter((s, i) for s, n in counts.items() for i in range(n))
    for slot in range(cycle):
        for s, c in shares.items():
            had = sum(x == s for x, _ in order[: slot + 1])
            assert abs(had - (slot + 1) * c / cycle) < 1


def test_mixing_edge_rows(documents, nothing):
    out = mixing.mix(documents)
    assert out.count() == documents.count()
    assert out.where("source IS NULL").select("slot").count() == documents.where("source IS NULL").count()
    assert mixing.mix(nothing).count() == 0


def test_numbering_is_whole_over_buckets(spark):
    rows = spark.range(500).withColumns({"s": F.lit("s"), "d": F.md5(F.col("id").cast("string"))})
    out = mixing.numbered(rows, "s", "d", ["id"], 16, "n").orderBy("n").collect()
    assert [r.n for r in out] == list(range(500))
    import hashlib

    assert [r.id for r in out] == sorted(range(500), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())


def test_given_shares_must_fit(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(20)], "doc_id long, source string")
    shares = lambda *given: spark.createDataFrame(given, "source string, share int")
    assert mixing.mix(rows, shares(("a", 1), ("b", 2), ("unused", 1))).count() == 20
    for wrong in ([("a", 1)], [("a", 1), ("b", 0)], [("a", 1), ("b", 1), ("b", 2)]):
        with pytest.raises(ValueError, match="'b'"):
            mixing.mix(rows, shares(*wrong))


OWN_NAMES = "_bucket _digest _i _turn _slot _share _name _source _at _shard _host _day _text _runs _rid on_host on_day mixed bucket digest within size share cycle turn start base rest text_ rid".split()


def test_columns_with_names_of_our_own_are_carried(spark):
    row = (1, "password: hunter22x", "s", "http://a.example.org/x", None)
    frame = spark.createDataFrame([(*row, *OWN_NAMES)], "doc_id long, text string, source string, url string, fetched_on date, " + ", ".join(f"`{c}` string" for c in OWN_NAMES))
    entries = spark.createDataFrame([], "domain string, listed_on date, action string")
    outs = {
        "secrets": secrets.scan(frame, [0] * len(secrets.ALPHABET) ** 2),
        "filter": url_filter.filter_urls(frame, entries),
        "shard": sharding.place(frame, F.col("doc_id"), ["x", "y"]),
        "mix": mixing.mix(frame),
        "first": jaccard.first_of_groups(frame),
    }
    for name, out in outs.items():
        assert out.columns[: len(frame.columns)] == frame.columns, name
        (found,) = out.collect()
        assert tuple(found)[: len(frame.columns)] == (*row, *OWN_NAMES), name


# Vectors


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_CELLS", 500)  # several blocks
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=8) / (1 + i % 5)).astype(np.float32).tolist()) for i in range(300)]
    rows += [(300 + i, rows[i][1]) for i in range(20)]  # ties
    rows += [(401, None), (402, [None] * 8), (403, [float("nan")] * 8), (404, [float("inf")] + [0.0] * 7), (None, rows[0][1]), (405, [])]
    df = spark.createDataFrame([r + (1,) for r in rows], "vec_id long, embedding array<float>, rank int").repartition(3)
    out = vectors.top_k(df, df.where("vec_id % 7 = 0 OR vec_id > 400"), k=5, cells=4, block_queries=16)
    found = [tuple(r) for r in out.collect()]
    padded = [(i, v if v != [] else [0.0] * 8) for i, v in rows]
    expected = plain.top_k(padded, [r for r in padded if r[0] is not None and (r[0] % 7 == 0 or r[0] > 400)], 5)
    assert len(found) == len(set(found)) and set(found) == expected
    few = vectors.top_k(df.where("vec_id < 3"), df.where("vec_id = 1"), k=5)
    assert few.count() == 2
    assert vectors.top_k(df.where("false"), df.where("false")).count() == 0
    with pytest.raises(ValueError):
        vectors.top_k(df, df, cells=257)
    every = vectors.top_k(df, df.where("vec_id < 3"), k=500).groupBy("query_id").count().collect()
    assert [r["count"] for r in every] == [len([1 for i, v in padded if i is not None and plain.floor_vector(v) is not None]) - 1] * 3


def test_top_k_of_repeated_rows_and_large_numbers(spark):
    rng = random.Random(3)
    rows = [(1, [1.0, 2.0])] * 8 + [(2, [1.0, 2.0]), (3, [1.0, 2.0]), (3, [5.0, -1.0]), (4, [0.5, 0.25, 3.0])]
    rows += [(i, [rng.uniform(-1, 1) * 10.0**6 for _ in range(3)]) for i in range(10, 60)]
    for scaled in (1.0, 10.0**1.2):  # the larger products pass 2^53
        given = [(i, [x * scaled for x in v]) for i, v in rows]
        df = spark.createDataFrame(given, "vec_id long, embedding array<double>").repartition(3)
        asked = {}
        for i, v in given:
            asked[i] = min(asked.get(i, v), v)
        for k in (1, 3):
            found = Counter(tuple(r) for r in vectors.top_k(df, df, k=k, cells=7, block_queries=16).collect())
            assert found == Counter(plain.top_k(given, list(asked.items()), k))


def test_few_vectors_are_read_exactly(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_CELLS", 50_000)
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(i, rng.normal(size=16).tolist()) for i in range(6000)], "vec_id long, embedding array<double>")
    exact = vectors.distinct_vectors(vectors.integer_vectors(df), 5)
    asked = vectors.integer_vectors(df.where("vec_id % 100 = 0"))
    ordered = vectors.candidates(exact, asked, 5, 32, 16)
    read = vectors.exact_scores(ordered, exact, asked, 5).groupBy("query_id").count().collect()
    assert len(read) == 60 and min(r["count"] for r in read) >= 5 and sum(r["count"] for r in read) < 60 * 6000 // 100


# Quality rules


def test_statistics_equal_plain_ones(documents, given):
    rng = random.Random(4)
    words = ["a", "b", "#x", "漢<", "é|", "\n", "\n", "\t", "\x0b"]
    rows = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    df = documents.sparkSession.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    everything = df.unionByName(documents.select("doc_id", "text")).unionByName(given.select("doc_id", "text"))
    out = quality.quality_rules(everything, given.select("doc_id").limit(50)).collect()
    expected = Counter((d, *plain.statistics(t)) for d, t in pairs(everything))
    assert Counter(tuple(r)[:6] for r in out) == expected
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) for r in out)


def test_ratio_equals_plain_one(spark):
    import math

    rows = [(1, "good words go here and here"), (2, "BAD!! SHOUTED!! WORDS!!"), (3, "good words go there"), (4, None), (5, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.llr for r in quality.quality_rules(df, df.where("doc_id IN (1, 3)").select("doc_id")).collect()}
    grams = lambda t: [t.encode()[i : i + 4] for i in range(len(t.encode()) - 3)]
    raw = Counter(g for _, t in rows for g in grams(t or ""))
    good = Counter(g for d, t in rows if d in (1, 3) for g in grams(t))
    smooth = quality.BUCKETS / 2
    ratio = lambda g: math.log((good[g] + 0.5) / (sum(good.values()) + smooth) / ((raw[g] + 0.5) / (sum(raw.values()) + smooth)))
    for d, t in rows:
        own = grams(t or "")
        assert out[d] == pytest.approx(sum(map(ratio, own)) / max(len(own), 1), abs=1e-5)


def test_ratio_counts_every_trusted_row(spark):
    import math

    n, smooth = 24_000, quality.BUCKETS / 2
    df = spark.range(n).selectExpr("id AS doc_id", "'good' AS text").union(spark.createDataFrame([(n, "poor")], "doc_id long, text string"))
    out = {r.text: r.llr for r in quality.quality_rules(df, df.where(f"doc_id < {n}")).join(df, "doc_id").select("text", "llr").distinct().collect()}
    raw = n + 1 + smooth
    assert out["good"] == pytest.approx(math.log((n + 0.5) / (n + smooth) / ((n + 0.5) / raw)), abs=1e-5)
    assert out["poor"] == pytest.approx(math.log(0.5 / (n + smooth) / (1.5 / raw)), abs=1e-5)


def test_quality_keeps_clean_and_drops_junk(spark, given):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    out = quality.quality_rules(given, labels.where("quality = 1")).join(labels, "doc_id").collect()
    assert all(r.kept for r in out if r.quality == 1 and not r.base_failed)
    junk = [r for r in out if r.quality == 0]
    assert sum(not r.kept for r in junk) / len(junk) > 0.9
    alone = quality.quality_rules(given, labels.where("false").select("doc_id"))
    assert alone.where("kept = base_failed").count() == 0
    assert quality.quality_rules(given.where("false"), labels).count() == 0


# Packing


def check_packing(rows, out, window=2048):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path("byte_bpe_50k.json"))
    whole, sequences, pieces = Counter(), defaultdict(list), defaultdict(list)
    for doc_id, text in rows:
        whole[doc_id, tuple(tokenizer.encode(text or "", add_special_tokens=False).ids + [1])] += 1
    for r in out:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.start, ids, r.doc_tokens))
    for found in sequences.values():
        end = 0
        for offset, length in sorted(found):
            assert offset == end
            end += length
        assert end <= window
    single = {d for d, n in Counter(d for d, _ in rows).items() if n == 1}
    for (doc_id, ids), n in whole.items():
        if doc_id in single:
            assert [x for _, part, _ in sorted(pieces[doc_id]) for x in part] == list(ids)
            assert {t for _, _, t in pieces[doc_id]} == {len(ids)}
    assert sum(len(i) * n for (_, i), n in whole.items()) == sum(r.length for r in out)
    return sequences


def test_distinct_values_and_postings_equal_sorted_ones():
    from fleetpulse.llm import tokens

    rng = np.random.default_rng(3)
    for size in (0, 1, 500):
        values = rng.integers(0, 200, size).astype(np.uint64) << np.uint64(55)
        unique, sample, which = tokens.distinct(values)
        assert sorted(unique.tolist()) == np.unique(values).tolist()
        assert (unique[which] == values).all() and (values[sample] == unique).all()
        assert likeness.distinct_ids(values).tolist() == np.unique(values).tolist()
    pieces = [(i, rng.integers(0, 90, n).astype("<u4")) for i, n in enumerate((1, 7, 40, 300, 2))]
    shard = packing.Shard(pieces)
    for at, term in enumerate(shard.known):
        held = [i for i, ids in pieces if term in ids]
        own = slice(shard.first[at], shard.first[at + 1])
        idf = np.log((len(pieces) - len(held) + 0.5) / (len(held) + 0.5))
        assert shard.owner[own].tolist() == (held if idf > 0 else [])
        for i, weight in zip(shard.owner[own], shard.weight[own]):
            tf = (pieces[i][1] == term).sum()
            norm = packing.K1 * (1 - packing.B + packing.B * shard.length[i] / shard.length.mean())
            assert weight == pytest.approx(idf * tf * (packing.K1 + 1) / (tf + norm))


def test_known_runs_keep_their_ids():
    """Hashes that meet in one place of the table, runs that repeat in a call, growth and clearing."""
    from fleetpulse.llm import tokens

    calls = []
    cache = tokens.IdCache(lambda run: calls.append(run) or list(range(len(run))), [7])
    # Equal low bits, the last place of the table, and 0.
    hashes = np.array([5, 5 + (1 << 40), 5 + (2 << 40), 65535, 65535 + (1 << 40), 0, 5, 0, 5 + (2 << 40)], np.uint64)
    size = np.array([1, 2, 3, 4, 5, 6, 1, 6, 3])
    for _ in range(2):
        ids, position = cache.ids(np.append(cache.slots_of(hashes, "x" * 9, np.zeros(9, np.int64), size), 0))
        assert np.diff(position).tolist() == [*size.tolist(), 1] and ids[-1] == 7
        assert ids[:-1].tolist() == [i for n in size for i in range(n)]
    assert len(calls) == 6

    n, step = tokens.MAX_CACHED + 100_000, 50_000
    cache = tokens.IdCache(lambda run: [1, 2, len(run)], [7])
    hashes = np.random.default_rng(1).permutation(n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    begin, end, known = np.zeros(step, np.int64), np.arange(step) % 90, []
    for at in [*range(0, n, step), 0]:
        for _ in range(2):
            ids, position = cache.ids(cache.slots_of(hashes[at : at + step], "x" * 90, begin, end))
            assert (np.diff(position) == 3).all() and (ids[2::3] == end).all()
        known.append(cache._known)
        assert 2 * cache._known <= cache._hash.size <= 8 * max(cache._known, 1 << 15)
    assert max(known) <= tokens.MAX_CACHED + step and sorted(known) != known


def test_a_worker_keeps_the_whole_vocabulary_only_for_texts_with_special_tokens():
    import pyarrow as pa

    from fleetpulse.llm import tokens

    encoder = tokens.Encoder(tokens._path_of(None), 1)
    plain = encoder.encode(pa.array(["it's", "é'", "'", "we'l", "x''ll", None]))
    assert "_whole" not in vars(encoder)
    assert [len(encoder._whole.encode(t, add_special_tokens=False).ids) + 1 for t in ("it's", "é'", "'", "we'l", "x''ll", "")] == [r.size for r in plain]
    assert encoder.encode(pa.array(["a<|endoftext|>"]))[0].tolist() == [*encoder._whole.encode("a<|endoftext|>").ids, 1]


def test_forgotten_encoders_are_made_anew():
    import pyarrow as pa

    from fleetpulse.llm import tokens

    texts = pa.array(["some words, some more", None])
    before = tokens.encoder(None, 1)
    ids = [r.tolist() for r in before.encode(texts)]
    tokens.forget()
    assert tokens.encoder(None, 1) is not before and [r.tolist() for r in tokens.encoder(None, 1).encode(texts)] == ids


def test_id_arrays_equal_the_rows_of_slices():
    import pyarrow as pa

    runs = [np.arange(n, dtype="<u4") + n for n in (3, 0, 1, 5, 0, 2)]
    for kind in (pa.binary(), pa.large_binary()):
        column = pa.array([r.tobytes() for r in runs], kind)
        for at, size in ((0, 6), (1, 4), (2, 0), (4, 1), (6, 0)):
            assert [r.tolist() for r in likeness.id_arrays(column.slice(at, size))] == [r.tolist() for r in runs[at : at + size]]
    assert likeness.id_arrays(pa.array([], pa.binary())) == []


def test_packing_is_an_exact_partition(documents, nothing, given):
    odd = documents.sparkSession.createDataFrame([(500, "a <|endoftext|> b"), (501, "it's  we'll\n'sx 12²é́ 　 x")], "doc_id long, text string")
    docs = documents.unionByName(odd, allowMissingColumns=True)
    check_packing(pairs(docs), packing.pack(docs).collect())
    assert packing.pack(nothing).count() == 0
    sequences = check_packing(pairs(given), packing.pack(given, shard_pieces=16).collect())
    tokens = sum(n for s in sequences.values() for _, n in s)
    assert len(sequences) * 2048 <= tokens + 2048


def test_seed_takes_lexical_neighbours():
    ids = lambda *x: np.array(x * 20, np.uint32)
    pieces = [(1, 0, 40, ids(1, 2)), (2, 0, 40, ids(3, 4)), (3, 0, 40, ids(1, 2)), (4, 0, 40, ids(5, 6)), (5, 0, 40, ids(7, 8)), (6, 0, 40, ids(9, 3))]
    rows = list(packing.fill_windows(iter(pieces), 80, 16, 0))
    together = defaultdict(list)
    for doc_id, *_, sequence, _, _ in rows:
        together[sequence].append(doc_id)
    assert together[0] == [1, 3] and together[1] == [2, 6]


def test_texts_that_share_rare_words_meet_across_the_whole_table(spark):
    """Families of four among many texts of the same frequent words: shards of 16 must hold a seed's siblings."""
    rng = random.Random(8)
    common = [f"common{i}" for i in range(40)]
    rows = []
    for family in range(150):
        rare = " ".join("".join(rng.choice("bcdfgaeiou") for _ in range(7)) for _ in range(15))
        rows += [(4 * family + i, " ".join(rng.choices(common, k=60)) + " " + rare + " " + " ".join(rng.choices(common, k=10))) for i in range(4)]
    rng.shuffle(rows)
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), shard_pieces=16).collect()
    members = defaultdict(set)
    for r in out:
        members[r.sequence_id].add(r.doc_id)
    met = {d for docs in members.values() for d in docs if any(e != d and e // 4 == d // 4 for e in docs)}
    assert len(met) > 0.8 * len(rows)


def test_weights_are_those_of_the_whole_table(spark):
    runs = [[1, 2, 2], [2, 3], [2], [9]]
    rows = [(len(r), np.array(r, "<u4").tobytes()) for r in runs]
    known = likeness.weights(spark.createDataFrame(rows, "length long, ids binary").repartition(3))
    assert (known.rows, known.mean) == (4, 7 / 4)
    assert np.allclose(known.idf[[1, 2, 3, 9]], [np.log(3.5 / 1.5), 0, np.log(3.5 / 1.5), np.log(3.5 / 1.5)])
