"""Resampling, hard negatives and decontamination against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from reelgrid.llm import common, decontamination, negatives, resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def grams(text, n):
    w = words(text)
    return [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def bucket(feature, buckets):
    return zlib.crc32(feature.encode()) % buckets


def resampled(rows, target, n, buckets, least, percent, seed):
    """(doc_id, n_features, weight, score, rank) of rows (doc_id, text)."""
    count = lambda texts: np.bincount([bucket(f, buckets) for t in texts for f in grams(t, n)], minlength=buckets)
    s, t = count([x[1] for x in rows]), count(target)
    gain = [math.floor(1000 * math.log((float(t[b]) + 1) * (float(s.sum()) + buckets) / ((float(s[b]) + 1) * (float(t.sum()) + buckets)))) for b in range(buckets)]
    out = []
    for doc_id, text in rows:
        found = [gain[bucket(f, buckets)] for f in grams(text, n)]
        weight = sum(found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    may = sorted([r for r in out if r[5] >= least], key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for place, r in enumerate(may[: len(may) * percent // 100], 1):
        r[4] = place
    return sorted((tuple(r[:5]) for r in out), key=repr)


TARGET = ["the ab ñandú 日本", None, "", "The don't ab ab x"]


@pytest.mark.parametrize(("n", "percent"), [(1, 10), (3, 50), (1, 100), (1, 0)])
def test_resampling(spark, odd_docs, odd_rows, n, percent):
    target = spark.createDataFrame([(1, t) for t in TARGET], "item_id long, text string")
    got = resampling.report(odd_docs, target, n=n, buckets=97, least=5, percent=percent, seed=7)
    assert sorted(map(tuple, got.collect()), key=repr) == resampled([(r[0], r[1]) for r in odd_rows], TARGET, n, 97, 5, percent, 7)


def test_resampling_keeps_columns_and_order(spark, odd_docs):
    target = spark.createDataFrame([(1, t) for t in TARGET], "item_id long, text string")
    ranks = resampling.report(odd_docs, target, percent=50).filter("rank is not null").orderBy("rank").collect()
    got = resampling.resampled(odd_docs, target, percent=50)
    assert got.columns == odd_docs.columns
    assert [r["doc_id"] for r in got.collect()] == [r["doc_id"] for r in ranks]


def test_resampling_of_nothing(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert resampling.report(no_docs, none).count() == 0
    assert resampling.resampled(no_docs, none).count() == 0
    got = resampling.report(odd_docs, none).collect()
    assert len(got) == odd_docs.count() and all(r["weight"] == 0 for r in got if r["n_features"] == 0)


def test_bytes_that_are_no_text(spark):
    docs = spark.sql("SELECT 1L AS doc_id, cast(unhex('6162FF20636420') AS string) AS text UNION ALL SELECT 2L, 'ab cd ef'")
    bench = spark.createDataFrame([(1, "cd")], "item_id long, text string")
    assert sorted(r["n_features"] for r in resampling.report(docs, bench).collect()) == [2, 3]
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"]) for r in decontamination.report(docs, bench).collect()) == [(1, 2, 1), (2, 3, 1)]


def hit(rows, items, span):
    """The report of rows (doc_id, text) against items (item_id, text)."""
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(span, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add("" if item is None else str(item))
    out = []
    for doc_id, text in rows:
        w, at, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (key := tuple(w[i : i + n])) in windows:
                    at |= set(range(i, i + n))
                    found |= windows[key]
        out.append((doc_id, len(w), len(at), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(at)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def leaks():
    """Documents and items with shared passages of many lengths, few words (so that grams repeat), short items and ties."""
    r = random.Random(5)
    text = lambda n, k=30: " ".join(f"{r.choice(['w', 'É', 'W'])}{r.randrange(k)}" for _ in range(n))
    items = [(i, text(r.randrange(8, 60))) for i in range(25)]
    items += [(40, "Only three words"), (41, "one"), (42, "a b c d e f g h i"), (43, "a a a a a a a a a a a a"), (None, items[3][1]), (40, items[2][1]), (44, None), (45, " .. "), (46, items[0][1])]
    docs = [(i, text(r.randrange(0, 80))) for i in range(40)]
    for i in range(60):
        _, item = r.choice(items[:25])
        w = item.split()
        n = r.randrange(3, 1 + len(w))
        at = r.randrange(0, len(w) - n + 1)
        docs.append((100 + i, f"{text(r.randrange(0, 30))} {' '.join(w[at : at + n])}. {text(r.randrange(0, 30))}"))
    docs += [(200, "x only three,WORDS y one"), (201, "a " * 3000), (202, None), (203, ""), (None, items[0][1]), (204, items[0][1]), (204, items[0][1]), (205, "b a b c d e f g h i")]
    docs += [(300 + i, f"{items[5][1]} {i}") for i in range(50)]
    return docs, items


@pytest.mark.parametrize(("span", "k"), [(10, 4), (10, 10), (6, 1), (3, 2), (1, 1)])
def test_decontamination(spark, leaks, span, k):
    docs, items = leaks
    found = decontamination.report(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), span=span, k=k)
    assert sorted(map(tuple, found.collect()), key=repr) == hit(docs, items, span)


def test_decontamination_keeps_columns(spark, odd_docs, odd_rows, no_docs):
    items = spark.createDataFrame([(1, odd_rows[-1][1]), (2, "long words and more of them long words and more")], "item_id long, text string")
    clean = decontamination.decontaminated(odd_docs, items)
    assert clean.columns == odd_docs.columns
    left = {r[0] for r in hit([(r[0], r[1]) for r in odd_rows], [(1, odd_rows[-1][1]), (2, "long words and more of them long words and more")], 10) if not r[5]}
    assert {r["doc_id"] for r in clean.collect()} == left
    assert decontamination.report(no_docs, items).count() == 0
    none = items.limit(0)
    assert not any(r["contaminated"] for r in decontamination.report(odd_docs, none).collect())
    assert decontamination.decontaminated(odd_docs, none).count() == odd_docs.count()


def mined(rows):
    """Hard negatives of rows (vec_id, embedding, label), as a sorted list."""
    sound = [(i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [math.floor(256 * x) for x in v]) for i, v, label in rows if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    first = lambda found: sorted(found, key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:5]
    out = []
    for n, (i, label, v) in enumerate(sound):
        if i is None or i % 100:
            continue
        scores = [(dot(v, w), j, m == label) for k, (j, m, w) in enumerate(sound) if k != n]
        for p, j, _ in first(s for s in scores if s[2]):
            window = [s for s in scores if not s[2] and 80 * p <= 100 * s[0] <= 100 * p]
            out += [(i, j, rank, m, p, s) for rank, (s, m, _) in enumerate(first(window), 1)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def space():
    """Vectors round a few centres, with ties, copies, odd lengths and rows that take no part."""
    g = np.random.default_rng(9)
    centres = g.normal(size=(6, 12))
    rows = [(i, [float(x) for x in (centres[i % 6] + 0.4 * g.normal(size=12)).astype(np.float32)], int(g.integers(0, 10))) for i in range(900)]
    rows += [(1000 + i, rows[100][1], i % 3) for i in range(60)]
    rows += [(2000, None, 1), (2001, rows[1][1], None), (2002, [1.0, None], 1), (2003, [float("nan")] * 12, 1), (2004, [float("inf")] * 12, 2), (None, rows[5][1], 3)]
    rows += [(2100, [], 1), (2101, [0.5, 0.5], 2), (2200, [0.0] * 12, 3), (2300, [x * 3000 for x in rows[0][1]], 4), (300, rows[7][1], 5)]
    return rows


EMBEDDING = "vec_id long, embedding array<float>, label int, list int, v string, id string"


def test_hard_negatives(spark, space, monkeypatch):
    monkeypatch.setattr(negatives, "PIECE", 100)  # a list is several pieces
    monkeypatch.setattr(negatives, "BLOCK", 3)
    rows = [(*r, 1, "a", "b") for r in space]
    found = negatives.report(spark.createDataFrame(rows, EMBEDDING).repartition(3))
    assert sorted(map(tuple, found.collect()), key=repr) == mined(space)


def test_hard_negatives_beyond_exact_doubles(spark, space):
    rows = [(i, None if v is None else [None if x is None else x * 100_000 for x in v], label, 1, "a", "b") for i, v, label in space if i != 2300]
    found = negatives.report(spark.createDataFrame(rows, EMBEDDING))
    assert sorted(map(tuple, found.collect()), key=repr) == mined([r[:3] for r in spark.createDataFrame(rows, EMBEDDING).collect()])


def test_hard_negatives_of_nothing(spark):
    assert negatives.report(spark.createDataFrame([], EMBEDDING)).collect() == []
    assert negatives.report(spark.createDataFrame([(100, [1.0], 1, 1, "a", "b")], EMBEDDING)).collect() == []
    assert negatives.report(spark.createDataFrame([(100, None, 1, 1, "a", "b")], EMBEDDING)).collect() == []


def test_best_of_a_piece():
    q, members = np.array([[3.0, 4.0]]), np.array([[3.0, 4.0], [-3.0, -4.0], [3.0, 4.0]])
    at, m, score = negatives.best(q, members, np.ones((1, 3), bool), np.array([-100]), np.array([100]), 2)
    assert (at.tolist(), sorted(m.tolist()), score.tolist()) == ([0, 0], [0, 2], [25, 25])
    at, m, _ = negatives.best(q, members, np.ones((1, 3), bool), np.array([-100]), np.array([0]), 2)
    assert m.tolist() == [1]


def test_pieces_of_lists_are_read_a_few_at_once(spark):
    """A reader holds a row group at once: a few pieces, which are up to half a megabyte each."""
    rows = [(i, [float(i % 97), float(i % 89), float(i % 83)], i % 3, 1, "a", "b") for i in range(3000)]
    index = negatives.indexed(negatives.vectors(spark.createDataFrame(rows, EMBEDDING).selectExpr("vec_id", "embedding", "cast(label AS long) AS label")))
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in index.pieces.inputFiles()]
    assert sum(m.num_rows for m in files) > 40
    assert max(m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)) <= common.WIDE_ROWS
