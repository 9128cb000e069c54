"""Exact neighbours, by blocks."""

import random

import pytest

from reelgrid.operators import vectors


def test_nearest_in_blocks(spark):
    """Against a plain loop: ties across blocks, copies, nulls, vectors that take no part, ids that are strings."""
    r = random.Random(5)
    some = [[r.gauss(0, 1) for _ in range(6)] for _ in range(60)]
    items = [(f"i{k:03}", some[k % 60]) for k in range(300)] + [("z0", None), ("z1", [0.0] * 6), ("z2", [1.0, None, 0.0, 0.0, 0.0, 0.0]), ("z3", [float("nan")] * 6), (None, some[0])]
    asked = [(1, some[0]), (2, some[7]), (2, some[8]), (3, [0.0] * 6), (4, None)]
    df, q = spark.createDataFrame(items, "item_id string, vector array<double>").repartition(3), spark.createDataFrame(asked, "query_id long, vector array<double>")
    got = {}
    for x in vectors.nearest(q, df, 12, block=16).collect():
        got.setdefault(x.query_id, []).append((x.lane_rank, x.item_id, x.score))

    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5

    for k in (1, 2):
        sound = [(i, v) for i, v in items if i is None or i < "z"]
        best = sorted((-round(max(0.0, cosine(a, v)), 6), i or "", i) for n, a in asked if n == k for i, v in sound)[:12]
        assert sorted(got[k]) == [(n + 1, i, -s) for n, (s, _, i) in enumerate(best)]
    assert set(got) == {1, 2}
    none = spark.createDataFrame([], "item_id string, vector array<double>")
    assert vectors.nearest(q, none, 5).count() == 0
    with pytest.raises(Exception, match="components"):
        vectors.nearest(q, spark.createDataFrame([("a", [1.0])], "item_id string, vector array<double>"), 5).collect()
