import numpy as np

import corpus_pipeline
import plain
from plain import SMALL


def test_stages(spark):
    """Every stage works on what the one before it kept; its own decisions are checked against plain versions."""
    docs = corpus_pipeline.table(spark, SMALL, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.materialize(stage(spark, docs, SMALL), name)
        kept[name] = docs
        if name != "packing":
            assert docs.schema.simpleString() == before.schema.simpleString()
    rows = lambda n: {r.doc_id: r for r in kept[n].collect()}
    toxic, single, clean, mixed = map(rows, ("toxicity", "near_duplicates", "secrets", "mixing"))
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    assert sum(labels.get(d) == 1 for d in toxic) < sum(v == 1 for v in labels.values())
    groups = five_word_groups([(d, r.text) for d, r in toxic.items()])
    assert set(single) == groups
    for d, r in clean.items():
        assert r.n_chars == (len(r.text) if plain.base_spans(single[d].text) else r.n_chars)
        assert not plain.base_spans(single[d].text) or "<secret>" in r.text
    assert mixed == clean
    assert {r.doc_id for r in kept["packing"].collect()} == set(mixed)


def five_word_groups(rows):
    """Ids that stand for a group at five words and 80 %."""
    sets = {d: plain.shingles(t, 5) for d, t in rows}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {find(d) for d in ids}


def test_sequences_follow_the_schedule(spark, monkeypatch):
    """Prefixes of the sequences have the shares of sources that the schedule gives, and no text is lost."""
    monkeypatch.setattr(corpus_pipeline, "RUN_FILES", 2)
    monkeypatch.setattr(corpus_pipeline, "PARTITION_ROWS", 300)
    # A large source and a small one, of unlike words and unlike ids: neither likeness nor ids keep the schedule.
    rows = [(i, ("alpha beta gamma " if i < 2560 else "delta omega zeta ") * 40 + str(i), "a" if i < 2560 else "b") for i in range(3200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = corpus_pipeline.materialize(corpus_pipeline.mix_sources(spark, docs, SMALL), "mixing")
    order = {r.doc_id: (r.slot, r.source_row) for r in corpus_pipeline.mixing.mix(docs).collect()}
    scheduled = sorted(order, key=order.get)
    out = sorted(corpus_pipeline.pack(spark, mixed, SMALL).collect(), key=lambda r: (r.sequence_id, r.offset))
    assert {r.doc_id for r in out} == set(order)
    runs = {}
    for r in out:
        runs.setdefault(r.sequence_id >> corpus_pipeline.packing.LOCAL_BITS, set()).add(r.doc_id)
    # Runs are consecutive stretches of the schedule, of two files each.
    cuts = np.cumsum([0, *(len(runs[k]) for k in sorted(runs))])
    stretches = [scheduled[i:j] for i, j in zip(cuts, cuts[1:])]
    assert [runs[k] for k in sorted(runs)] == [set(s) for s in stretches] and len(runs) == 6
    share = lambda ids: sum(d >= 2560 for d in ids) / len(ids)
    seen = list(dict.fromkeys(r.doc_id for r in out))
    for n in cuts[1:].tolist():
        assert set(seen[:n]) == set(scheduled[:n])
    # Within a run too: half of the first one.
    assert abs(share(seen[:256]) - share(stretches[0])) < 0.15


def test_files_follow_by_number(spark, tmp_path):
    """Part numbers of six digits come after those of five."""
    for part in (99_998, 99_999, 100_000, 100_001):
        spark.createDataFrame([(part, "text")], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "one" / str(part)))
        (written,) = (tmp_path / "one" / str(part)).glob("part-*.parquet")
        (tmp_path / "all").mkdir(exist_ok=True)
        written.rename(tmp_path / "all" / f"part-{part}-x.parquet")
    docs = spark.read.parquet(str(tmp_path / "all"))
    runs = {r.doc_id: r.run for r in corpus_pipeline.packing.schedule_runs(docs, 2).collect()}
    assert runs == {99_998: 49_999, 99_999: 49_999, 100_000: 50_000, 100_001: 50_000}


def test_odd_tables(spark):
    """Null ids, empty texts, repeated rows and columns named like those of operators go through every stage; so does no row."""
    extra = ["slot", "block", "base_spans", "score", "_0", "_bucket", "rid", "run", "leaf", "file"]
    texts = [None, "", "one", "password=hunter2222 " * 3, "word " * 50, "word " * 50]
    rows = [(i if i else None, t, "en", None if i % 2 else "s", 1, *["?"] * len(extra)) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in extra)
    for data in (rows + rows[3:4], []):
        docs = corpus_pipeline.materialize(spark.createDataFrame(data, schema), "documents")
        for name, stage in corpus_pipeline.STAGES:
            columns = docs.columns
            docs = corpus_pipeline.materialize(stage(spark, docs, SMALL), name)
            assert name == "packing" or docs.columns == columns
        assert {r.doc_id for r in docs.collect()} == ({None, 1, 2, 3, 4} if data else set())
