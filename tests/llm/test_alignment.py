"""Alignment of two tokenisations against a merge of both lists, one token at a time."""

import random

import numpy as np
import plain
import public_tokenizers
import pytest
import sentencepiece
from plain import SMALL
from tokenizers import Tokenizer

from fleetpulse.llm import alignment
from fleetpulse.llm.queries import QUERIES

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def vocabularies():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    # The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    a_bytes = {i: bytes(byte_of[c] for c in t) for t, i in a.get_vocab().items() if t != "<|endoftext|>"}
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    names = [b.id_to_piece(i) for i in range(b.vocab_size())]
    b_bytes = [bytes([int(n[3:5], 16)]) if b.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
    return a, a_bytes, b, b_bytes


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def odd_texts():
    rng = random.Random(3)
    words = ["alpha", "Beta's", "日本語", "x", "😀", "  ", "\n\n", "1234567", "<|endoftext|>", "<s>", "\t", "naïve", "====", " ", "\x00"]
    mixed = ["".join(rng.choice(words) + rng.choice(["", " ", "  "]) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    blob = "".join(rng.choice("ABCDEFabcdef0123456789+/") for _ in range(30_000))
    return [None, "", " ", "   ", "a", " lead", "tail  ", "▁", "has ▁ mark", "<unk> <0x41>", "=" * 700, "aaaa" * 500, blob, *mixed, mixed[0]]


def test_query(spark, vocabularies):
    given = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    expected = plain.alignment([tuple(r) for r in given], *vocabularies)
    assert rows_of(QUERIES["op13_token_alignment"](spark, SMALL)) == sorted(expected, key=str)


@pytest.mark.parametrize("frequent", [1 << 18, 64, 1])
def test_odd_texts(spark, vocabularies, frequent):
    rows = [(i if i != 9 else None, t) for i, t in enumerate(odd_texts())]
    docs = spark.createDataFrame([(*r, "?", 1) for r in rows], "doc_id long, text string, pair string, `row` int")
    expected = sorted(plain.alignment(rows, *vocabularies), key=str)
    assert rows_of(alignment.align_counts(docs, frequent=frequent)) == expected


def test_groups(spark, vocabularies):
    rows = list(enumerate(odd_texts()))
    found = alignment.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    expected = [(i, k, *g) for i, t in rows for k, g in enumerate(plain.token_groups(t, *vocabularies))]
    assert sorted(map(tuple, found)) == expected


def test_large_groups_count_alike(spark, vocabularies, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(odd_texts())), "doc_id long, text string")
    texts = docs.toArrow().column("text").combine_chunks()
    whole = [run.links() for run in alignment.align(texts)]
    monkeypatch.setattr(alignment, "SMALL_GROUP", 1)
    for before, after in zip(whole, [run.links() for run in alignment.align(texts)], strict=True):
        assert all(np.array_equal(x, y) for x, y in zip(before, after))


def test_gallop():
    rng = np.random.default_rng(1)
    for size in (1, 2, 50, 1000):
        ends = np.unique(rng.integers(0, 5000, size))
        keys = rng.integers(-5, ends[-1] + 1, 300)
        for start in (np.zeros(300, int), np.full(300, ends.size - 1), rng.integers(0, ends.size, 300)):
            assert np.array_equal(alignment.gallop(keys, ends, start), np.searchsorted(ends, keys))


def test_nothing(spark):
    assert alignment.align_counts(spark.createDataFrame([], "doc_id long, text string")).collect() == []
