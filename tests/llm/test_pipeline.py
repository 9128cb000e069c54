"""The pipeline's stages on the smallest tables, and on rows with nulls and clashing columns."""

import random

import corpus_pipeline
import numpy as np

from reelgrid.llm import common


def test_stages_follow_each_other(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    columns, before = docs.columns, docs.count()
    texts = {r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = common.written(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
        assert 0 < docs.count() <= before
        before = docs.count()
    assert 0.9 * len(texts) <= before <= len(texts)  # what goes are copies
    mixed = common.written(corpus_pipeline.mixed_sources(spark, docs, sf_dir), "mixed")
    words = lambda d: sum(len(r.text.encode().split()) for r in d.collect())
    assert abs(words(mixed) - 1.5 * words(docs)) <= docs.select("source").distinct().count()
    packed = corpus_pipeline.packed(spark, mixed, sf_dir).collect()
    assert sum(r.length for r in packed if r.start == 0) <= sum(r.length for r in packed)
    assert all(len(r.ids) == 4 * r.length for r in packed)
    assert np.mean([r.length for r in packed]) > 100


def test_run_and_clashing_columns(spark, odd_docs, sf_dir):
    before = common.made()
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    assert common.made() == (before[0] + 1, before[1])  # its result alone is left
    docs = odd_docs
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = common.written(stage(spark, docs, sf_dir), "odd")
        assert docs.columns == odd_docs.columns
    assert corpus_pipeline.packed(spark, docs, sf_dir).count() > 0


def test_empty_documents(spark, no_docs, sf_dir):
    docs = no_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, sf_dir), "none")
        assert docs.count() == 0


def test_near_copies_are_found_from_four_fifths(spark, sf_dir):
    """Copies with words replaced go at similarities of 0.8 or more, and stay below."""
    r = random.Random(21)
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    rows, gone, pairs = [], set(), {0.75: 0, 0.8: 0, 0.85: 0, 0.9: 0, 0.95: 0}
    for least in pairs:
        for _ in range(60):
            words = [f"w{r.randrange(30000)}" for _ in range(400)]
            copy = list(words)
            while True:
                edited = list(copy)
                edited[r.randrange(400)] = f"e{r.randrange(30000)}"
                a, b = shingles(words), shingles(edited)
                if len(a & b) / len(a | b) < least:
                    break
                copy = edited
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(copy))]
            if least >= 0.8:
                gone.add(len(rows) - 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    left = {x.doc_id for x in corpus_pipeline.STAGES[2][1](spark, docs, sf_dir).collect()}
    assert left == {d for d, _ in rows} - gone


def test_crowded_buckets_lose_no_near_copy(spark, sf_dir):
    """Pages of one template (about 0.6 alike), each with a near copy, and a large group of near copies."""
    r = random.Random(22)
    page = [f"p{i}" for i in range(600)]
    rows, gone = [], set()
    for _ in range(150):
        words = page[:450] + [f"w{r.randrange(10**6)}" for _ in range(150)]
        copy = list(words)
        copy[r.randrange(460, 590)] = "edit"
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(copy))]
        gone.add(len(rows) - 1)
    base, at = [f"b{i}" for i in range(400)], len(rows)
    for i in range(200):
        rows.append((at + i, " ".join([*base[: 2 * i], f"x{i}", *base[2 * i + 1 :]])))
    gone |= set(range(at + 1, at + 200))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    left = {x.doc_id for x in corpus_pipeline.STAGES[2][1](spark, docs, sf_dir).collect()}
    assert left == {d for d, _ in rows} - gone


def test_the_near_duplicate_stage_links_by_simhash(spark, monkeypatch):
    """Near copies within 4 bits are dropped without any MinHash candidate; what SimHash links and texts don't bear out stays."""
    from reelgrid.llm import minhash, simhash

    base = [f"w{i}" for i in range(400)]
    rows = [(0, " ".join(base)), (1, " ".join([*base[:399], "other"])), (2, " ".join(f"v{i}" for i in range(400)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in simhash.report(docs).collect()} == {0, 2}
    monkeypatch.setattr(minhash, "candidates", lambda r: spark.createDataFrame([], "a long, b long"))
    assert corpus_pipeline.STAGES[2][0] == "simhash_dedup"
    assert {x.doc_id for x in corpus_pipeline.STAGES[2][1](spark, docs, "").collect()} == {0, 2}
    apart = spark.createDataFrame([(0, "a b c d"), (1, "e f g h")], "doc_id long, text string")
    monkeypatch.setattr(simhash, "fingerprint", lambda raw, width: 7)
    assert corpus_pipeline.STAGES[2][1](spark, apart, "").count() == 2


def test_crowded_buckets_compare_all_that_is_apart(spark, monkeypatch):
    """Two near copies that share one crowded bucket, whose smallest text is like neither, and nothing else."""
    from reelgrid.llm import minhash

    def bands(found):
        return np.r_[np.uint64(7), found.sum() * np.arange(3, 2 * minhash.BANDS + 1, 2, np.uint64)[: minhash.BANDS - 1]]

    monkeypatch.setattr(minhash, "bands", bands)
    rows = [(i, " ".join(f"{i}w{k}" for k in range(100))) for i in range(12)]
    rows += [(20, " ".join(["first", *rows[5][1].split()[1:]])), (21, " ".join(["other", *rows[9][1].split()[2:]]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {x.doc_id for x in minhash.deduplicated(docs, 5, 0.8).collect()} == set(range(12))
    monkeypatch.setattr(minhash, "MEET", 3)  # many blocks
    assert {x.doc_id for x in minhash.deduplicated(docs, 5, 0.8).collect()} == set(range(12))


def test_simhash_stars_compare_all_that_is_apart(spark, monkeypatch):
    """Copies of one fingerprint, two of them near copies that are unlike its first row."""
    from reelgrid.llm import minhash, simhash

    monkeypatch.setattr(minhash, "candidates", lambda r: spark.createDataFrame([], "a long, b long"))
    monkeypatch.setattr(simhash, "fingerprint", lambda raw, width: 7)
    rows = [(i, " ".join(f"{i}w{k}" for k in range(100))) for i in range(3)]
    rows.append((3, " ".join([*rows[2][1].split()[:-1], "other"])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert {x.doc_id for x in minhash.deduplicated(docs, 5, 0.8, 4).collect()} == {0, 1, 2}


def test_blocks_of_one_component_meet_others_only(spark):
    """Shared shingles by matrix products, and a large component whose blocks pass each other over."""
    from reelgrid.llm import minhash

    r = np.random.default_rng(5)
    sets = [np.unique(r.integers(0, 9000, r.integers(1, 6000), np.uint64)) for _ in range(7)]
    want = [[len(np.intersect1d(x, y)) for y in sets[4:]] for x in sets[:4]]
    assert minhash.shared(sets[:4], sets[4:]).tolist() == want
    base = [f"b{i}" for i in range(200)]
    texts = [(i, " ".join([*base, f"x{i}"])) for i in range(600)] + [(600, " ".join([*base[:180], *[f"y{i}" for i in range(8)]]))]
    met = spark.createDataFrame([(1, i) for i, _ in texts], "key long, _row long")
    found = spark.createDataFrame([(i, 0) for i in range(600)], "node long, component long")
    got = minhash.late_links(met, spark.createDataFrame(texts, "_row long, text string"), found, 5, 0.8).collect()
    assert got and all(x.b == 600 and x.a < 600 for x in got)
