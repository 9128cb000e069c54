"""The pairwise ranker and NDCG over ties against plain Python."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from reelgrid.operators import lambdarank, metrics


def disc(p, k):
    return 1 / math.log2(p + 1) if p <= k else 0.0


def pulls(rows, k):
    """g and h of rows (group, row, gain, score, place), by all pairs."""
    out = {r[1]: [0.0, 0.0] for r in rows}
    for group in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == group]
        ideal = sum(g * disc(p, k) for p, g in enumerate(sorted((r[2] for r in own), reverse=True), 1))
        for a, b in itertools.combinations(own, 2):
            if a[2] != b[2] and ideal:
                better, worse = (a, b) if a[2] > b[2] else (b, a)
                wrong = 1 / (1 + math.exp(better[3] - worse[3]))
                change = abs((a[2] - b[2]) * (disc(a[4], k) - disc(b[4], k))) / ideal
                for x, sign in ((better, 1), (worse, -1)):
                    out[x[1]][0] += sign * wrong * change
                    out[x[1]][1] += wrong * (1 - wrong) * change
    return out


def test_gradients(spark):
    r = random.Random(2)
    rows = [(g, 100 * g + i, float(r.randrange(4)), r.random()) for g in range(5) for i in range(r.choice([1, 3, 12]))]
    places = {}
    for group in range(5):
        for p, x in enumerate(sorted((x for x in rows if x[0] == group), key=lambda x: -x[3]), 1):
            places[x[1]] = p
    ideal = {g: sum(v * disc(p, 4) for p, v in enumerate(sorted((x[2] for x in rows if x[0] == g), reverse=True), 1)) for g in range(5)}
    df = spark.createDataFrame([(*x, ideal[x[0]]) for x in rows], "_group int, _row long, _gain double, _score double, _ideal double")
    got = {x["_row"]: (x["_g"], x["_h"]) for x in lambdarank.gradients(df, 4).collect()}
    want = pulls([(*x, places[x[1]]) for x in rows], 4)
    assert got.keys() == want.keys()
    for row, (g, h) in want.items():
        assert got[row] == pytest.approx((g, h), abs=1e-9)


@pytest.fixture(scope="module")
def pools(spark):
    """Users whose labels follow a step and a product of two features, with noise that a regression on labels follows too: each user's own level."""
    r = random.Random(8)
    rows = []
    for user in range(120):
        level = r.choice([0, 1, 2])
        for i in range(15):
            a, b, c = r.random(), r.random(), r.random()
            rows.append((user, user * 100 + i, int((a > 0.6) + (a * b > 0.3)) + level, a, b, c, None))
    return spark.createDataFrame(rows, "user_id long, movie_id long, label int, a double, b double, c double, d double").repartition(3).cache()


@pytest.fixture(scope="module")
def model(pools):
    return lambdarank.train(pools.filter("user_id >= 40"), ["a", "b", "c", "d"], trees=8, depth=2, rate=0.3)


def mean(df, score):
    return metrics.ndcg_tied(df.select("user_id", F.col(score).alias("score"), (F.pow(F.lit(2.0), F.col("label")) - 1).alias("gain"))).agg(F.avg("ndcg")).first()[0]


def test_ranker_learns_order(pools, model):
    test = pools.filter("user_id < 40")
    ranked = mean(model.transform(test), "prediction")
    assert ranked > mean(test, "b") + 0.05
    assert ranked > 0.93
    shares = model.importances()
    assert sum(shares.values()) == pytest.approx(1.0) and shares["a"] > shares["b"] > shares["c"] and shares["d"] == 0


def test_ranker_is_a_column_and_comes_back(spark, pools, model, tmp_path):
    model.save(spark, f"file://{tmp_path}/model")
    again = lambdarank.Ranker.load(spark, f"file://{tmp_path}/model")
    assert again == model
    plan = again.transform(pools)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan.split("InMemory")[0]


def test_no_rows_and_one_label(spark, pools):
    assert mean(lambdarank.train(pools.filter("user_id < 0"), ["a"], trees=2).transform(pools), "prediction") > 0
    flat = lambdarank.train(pools.withColumn("label", F.lit(1)), ["a", "b"], trees=3)
    assert len(flat.trees) == 1 and flat.trees[0] == {"value": 0.0}


def test_ndcg_over_ties(spark):
    """The mean over all orders of equal scores."""
    r = random.Random(6)
    rows = [(u, r.choice([None, 0.1, 0.2]), float(r.randrange(3))) for u in range(12) for _ in range(r.choice([1, 4, 6]))] + [(99, 1.0, 0.0)]
    got = dict(map(tuple, metrics.ndcg_tied(spark.createDataFrame(rows, "user_id long, score double, gain double"), 3).collect()))
    want = {}
    for u in {x[0] for x in rows}:
        own = [(s, g) for v, s, g in rows if v == u]
        ideal = sum(g * disc(p, 3) for p, g in enumerate(sorted((g for _, g in own), reverse=True), 1))
        if not ideal:
            continue
        value = lambda x: float("-inf") if x[0] is None else x[0]
        orders = [o for o in itertools.permutations(own) if all(value(a) >= value(b) for a, b in itertools.pairwise(o))]
        want[u] = sum(sum(g * disc(p, 3) for p, (_, g) in enumerate(o, 1)) for o in orders) / len(orders) / ideal
    assert got == {u: pytest.approx(v, abs=1e-6) for u, v in want.items()}



def test_trees_grow_from_pools_alone(spark, pools, monkeypatch):
    """Nothing is written or shuffled for a tree but histograms: rows are written before the first tree, and scores every so many trees, which changes no tree."""
    names, written = [], lambdarank.written
    monkeypatch.setattr(lambdarank, "written", lambda df, name: names.append(name) or written(df, name))
    few = pools.filter("user_id < 30")
    found = lambdarank.train(few, ["a", "b"], trees=4, depth=2)
    assert names == ["binned", "pools"]
    monkeypatch.setattr(lambdarank, "KEPT", 2)
    again = lambdarank.train(few, ["a", "b"], trees=4, depth=2)
    assert names == ["binned", "pools"] * 2 + ["pools"]
    shape = lambda t: (t["feature"], t["most"], shape(t["low"]), shape(t["high"])) if "feature" in t else round(t["value"], 9)
    assert [shape(t) for t in found.trees] == [shape(t) for t in again.trees] and len(found.trees) == 4
