"""Bytes that are no UTF-8, repeated rows and clashing columns in the near-duplicate operators."""

import pytest

from reelgrid.llm import minhash, simhash, suffix_dedup

PASSAGE = " ".join(f"w{i}" for i in range(70))


@pytest.fixture(scope="module")
def docs(spark):
    """A passage with a byte that is no UTF-8 in two rows (one of them twice), with another byte in a third, and other texts."""
    odd = lambda byte: " ".join([PASSAGE[:200], "%", PASSAGE[200:]]).encode().replace(b"%", byte)
    rows = [(1, odd(b"\xff")), (2, odd(b"\xff")), (2, odd(b"\xff")), (3, odd(b"\xfe")), (4, b"\xff\xfe"), (5, b""), (6, None), (7, b"quite another text")]
    made = spark.createDataFrame(rows, "doc_id long, raw binary")
    return made.selectExpr("doc_id", "cast(raw AS string) AS text", "'x' AS keys", "1 AS component", "2 AS key", "3L AS node")


def test_simhash_of_odd_bytes(docs):
    got = sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.report(docs, width=4, radius=0).collect())
    assert len(got) == 8
    of = {d: (f, c) for d, f, c in got}
    assert of[1][0] == of[2][0] and of[2][1] == 1
    assert of[5] == ("0" * 16, 5) and of[6] == ("0" * 16, 5)
    assert of[4][1] == 4 and of[7][1] == 7


def test_minhash_of_odd_bytes(docs):
    kept = minhash.deduplicated(docs, width=5, least=0.8)
    assert kept.columns == docs.columns
    # the third passage differs in one word of 71, that is in 5 of 67 shingles on either side
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 4, 5, 7]


def test_suffixes_of_odd_bytes(docs):
    got = sorted(map(tuple, suffix_dedup.passages(docs).collect()))
    whole = [g for g in got if g[0] in (1, 2)]
    assert whole == [(1, 0, len(PASSAGE.split()) + 1 + (PASSAGE[199] != " " and PASSAGE[200] != " "))] + whole[1:]
    assert len(whole) == 3 and all(g[1:] == whole[0][1:] for g in whole)


def test_no_rows(docs):
    none = docs.limit(0)
    assert simhash.report(none, width=4, radius=4).count() == 0
    assert minhash.deduplicated(none, width=5, least=0.8).count() == 0
    assert suffix_dedup.passages(none).count() == 0
