"""The manifest against trees built by a plain loop."""

import plain
import pytest
from plain import SMALL

from fleetpulse.llm import merkle
from fleetpulse.llm.queries import QUERIES

ROW = "doc_id long, source string, lang string, n_chars long, text string"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def check(spark, rows):
    docs = spark.createDataFrame([(*r, "?", 7) for r in rows], ROW + ", index string, digest int")
    assert rows_of(merkle.manifest(docs).proofs()) == plain.merkle(rows)


def test_query(spark):
    given = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [tuple(r) for r in given.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert rows_of(QUERIES["op11_merkle_manifest"](spark, SMALL)) == plain.merkle(rows)


@pytest.mark.parametrize("count", [1, 2, 16, 17, 257])
def test_heights(spark, count):
    check(spark, [(i, "one", "en", i, f"Text {i}") for i in range(count)])


def test_many_sources_and_odd_rows(spark):
    rows = [(i, None if i % 19 == 0 else f"s{i % 40}é", None if i % 7 else "en", None if i % 5 else i, f"T{i}") for i in range(700)]
    rows += [(None, "s1é", None, None, None), (None, None, None, None, ""), (5, "", "en", 1, "A"), (-3, "", "en", 1, None)]
    rows += [(5, "s5é", "en", 1, "Same")] * 30 + [(10, "long", "en", 1, "Ab " * 400_000)]
    check(spark, rows)


def test_blocks_and_versions(spark):
    """Small blocks, so that trees span several rounds."""
    rows = [(i, "big" if i % 3 else "small", "en", i, f"Text {i}") for i in range(1200)]
    docs = spark.createDataFrame(rows, ROW)
    built = merkle.manifest(docs, levels=1)
    proofs = built.proofs().collect()
    assert sorted((tuple(r) for r in proofs), key=str) == plain.merkle(rows)
    copies = built.versions().collect()
    folded = {r.doc_id: r.folded_root for r in proofs if not r.verified}
    tops = {}
    for c in copies:
        tops[c.doc_id] = max(tops.get(c.doc_id, (-1, "")), (c.level, c.digest))
    # A version's last copy is its root, and no version copies more than its ancestors.
    assert {d: t[1] for d, t in tops.items()} == folded
    assert {t[0] for t in tops.values()} == {4}


def test_nothing(spark):
    assert merkle.manifest(spark.createDataFrame([], ROW)).proofs().collect() == []
