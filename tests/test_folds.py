"""Clamped sums in pieces against a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from reelgrid.operators import folds, profile

SCHEMA = "user_id long, key string, ts long, place string, weight double, value string"


def loop(rows, low, high, start):
    """(user_id, key) to its states, one for each row in order."""
    out = {}
    for user, key, _, _, weight, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "", r[2] is not None, r[2] or 0, r[3] is not None, r[3] or "", r[4] is not None, r[4] or 0)):
        states = out.setdefault((user, key), [])
        states.append(max(low, min(high, (states[-1] if states else start) + (weight or 0.0))))
    return out


@pytest.fixture(scope="module")
def history():
    """A third of all rows belong to one key; nulls, repeated rows and ties of time."""
    r = random.Random(4)
    rows = [(r.choice([1, 2, 3, None]), r.choice(["a", "b", None]), r.choice([None, *range(40)]), f"p{i}", r.choice([0.5, -0.5, 1.0, -1.0, 0.25, None]), "x") for i in range(600)]
    rows += [(9, "hot", r.randrange(60), f"h{i:04}", r.choice([1.5, 0.75, -1.0, -0.5]), "y") for i in range(400)]
    return rows + rows[:3]


@pytest.fixture
def small_pieces(monkeypatch):
    monkeypatch.setattr(folds, "PIECE", 7)
    monkeypatch.setattr(folds, "RUN", 3)


@pytest.mark.parametrize(("low", "high", "start", "most"), [(-3.0, 3.0, 0.0, 20), (-3.0, 3.0, 0.0, None), (0.0, 1.0, 0.5, 1)])
def test_clamped_sum(spark, history, small_pieces, low, high, start, most):
    df = spark.createDataFrame(history, SCHEMA).repartition(4)
    found = folds.clamped_sum(df, ["user_id", "key"], ["ts", "place", "weight"], "weight", low, high, start, most)
    got = {(r["user_id"], r["key"]): (round(r["value"], 6), r["n"]) for r in found.collect()}
    assert got == {k: (round(v[-1], 6), len(v)) for k, v in loop(history, low, high, start).items()}
    assert found.count() == len(got)


def test_running_clamped(spark, history, small_pieces):
    df = spark.createDataFrame(history, SCHEMA).repartition(4)
    found = folds.running_clamped(df, ["user_id", "key"], ["ts", "place", "weight"], "weight", -3.0, 3.0, "value_after")
    assert found.columns == [*df.columns, "value_after"]
    got = {}
    for r in found.collect():
        got.setdefault((r["user_id"], r["key"]), []).append((r["ts"] is not None, r["ts"] or 0, r["place"], round(r["value_after"], 6)))
    want = loop(history, -3.0, 3.0, 0.0)
    assert {k: sorted(x[3] for x in v) for k, v in got.items()} == {k: sorted(round(x, 6) for x in v) for k, v in want.items()}
    hot = [x[3] for x in sorted(got[9, "hot"])]
    assert hot == [round(x, 6) for x in want[9, "hot"]]


def test_folds_run_without_python(spark, history):
    df = spark.createDataFrame(history, SCHEMA)
    for found in (folds.running_clamped(df, ["user_id", "key"], ["ts", "place", "weight"], "weight", -3.0, 3.0, "v"), folds.clamped_sum(df, ["user_id", "key"], ["ts", "place"], "weight", -3.0, 3.0, 0.0, 20)):
        assert "Python" not in found._jdf.queryExecution().executedPlan().toString()


def test_folds_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert folds.running_clamped(none, ["user_id", "key"], ["ts"], "weight", -3.0, 3.0, "v").count() == 0
    assert folds.clamped_sum(none, ["user_id", "key"], ["ts"], "weight", -3.0, 3.0).count() == 0


def test_long_histories_of_profiles(spark):
    """Cut histories give the affinities of whole ones."""
    r = random.Random(1)
    events = [(1, t, 0, f"m{t}", "genre", r.choice(["war", "war", "war", "art"]), r.choice([1.0, -0.5, 0.25])) for t in range(200)]
    df = spark.createDataFrame(events, "user_id long, ts long, kind int, place string, dimension string, key string, weight double")
    assert sorted(map(tuple, profile.affinities(df, most=10).collect())) == sorted(map(tuple, profile.affinities(df).collect()))


@pytest.mark.parametrize("most", [None, 30])
def test_rated_affinities_are_those_of_events(spark, most):
    """Lists of terms folded for each user: nulls, ties of time, terms twice, tags, and users whose history is too long for a row."""
    r = random.Random(7)
    ratings = spark.createDataFrame([(r.choice([1, 2, 3, None]), m % 25, r.choice([None, 1.0, 2.0, 4.5, 5.0]), r.choice([None, *range(9)])) for m in range(90)] + [(9, m % 25, 5.0, m) for m in range(60)], "user_id long, movie_id long, rating double, rated_at long")
    terms = spark.createDataFrame([(m, d, k) for m in range(20) for d, k in (("genre", f"g{m % 3}"), ("tag", f"t{m % 4}"), ("tag", f"t{m % 2}"), ("theme", "x"))], "movie_id long, dimension string, key string")
    tags = spark.createDataFrame([(r.choice([1, 4, None]), i % 5, r.choice(["t1", "g1", None]), r.choice([None, 2, 3])) for i in range(40)], "user_id long, movie_id long, tag string, tagged_at long")
    for t in (None, tags):
        events = profile.rating_events(ratings, terms)
        want = profile.affinities(events if t is None else events.unionByName(profile.tag_events(t)))
        got = profile.rated_affinities(ratings, terms, t, most=most)
        assert got.dtypes == want.dtypes
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert profile.rated_affinities(ratings.limit(0), terms).count() == 0


def test_shared_boosts_are_those_of_pairs(spark):
    r = random.Random(3)
    users = spark.createDataFrame([(u,) for u in [*range(6), None]], "user_id long")
    lists = spark.createDataFrame([(q, m) for q in range(2) for m in range(q, 8, q + 1)], "list_id long, movie_id long")
    terms = spark.createDataFrame([(m, d, k) for m in range(9) for d, k in (("genre", f"g{m % 3}"), ("director", f"d{m % 2}"), ("tag", f"t{m % 4}"), ("tag", f"t{m % 2}"))], "movie_id long, dimension string, key string")
    affinity = spark.createDataFrame([(u, d, k, r.choice([-1.5, 0.25, 2.0]), r.choice([1, 3])) for u in range(7) for d, k in (("genre", "g0"), ("director", "d1"), ("tag", "t1"), ("era", "x")) if r.random() < 0.8], "user_id long, dimension string, key string, affinity double, confidence long")
    watched = spark.createDataFrame([(1, 1), (2, 0), (3, 8), (7, 1)], "user_id long, movie_id long")
    list_of = F.pmod("user_id", F.lit(2)).cast("long")
    pairs = users.withColumn("list_id", list_of).join(lists, "list_id").select("user_id", "movie_id")
    want, got = profile.profile_boost(pairs, terms, affinity, watched), profile.shared_boosts(users, lists, list_of, terms, affinity, watched)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 30


@pytest.mark.parametrize("most", [4096, 30])
def test_rated_running_is_that_of_events(spark, most):
    """States in a user's row: nulls, ties of time, terms twice, no ratings, and users whose history is too long for a row; no event is shuffled by itself."""
    r = random.Random(7)
    ratings = spark.createDataFrame([(r.choice([1, 2, 3, None]), m % 25, r.choice([None, 1.0, 2.0, 4.5, 5.0]), r.choice([None, *range(9)])) for m in range(90)] + [(9, m % 25, 5.0, m) for m in range(60)], "user_id long, movie_id long, rating double, rated_at long")
    terms = spark.createDataFrame([(m, d, k) for m in range(20) for d, k in (("genre", f"g{m % 3}"), ("tag", f"t{m % 4}"), ("tag", f"t{m % 2}"), ("theme", "x"))], "movie_id long, dimension string, key string")
    got = profile.rated_running(ratings, terms, most)
    want = profile.running_affinities(profile.rating_events(ratings, terms)).select(got.columns)
    assert got.dtypes == want.dtypes
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 200
    assert profile.rated_running(ratings.limit(0), terms).count() == 0


def test_running_profile_sorts_no_ranges_of_events(spark, sf_dir):
    from reelgrid.plans import queries

    plan = queries.running_profile(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan and "pieces" not in plan and plan.index("Generate") < plan.index("Exchange")


@pytest.mark.parametrize("most", [4096, 2, 0])
def test_boosts_that_are_looked_up_are_those_of_joins(spark, most):
    """Candidates twice, terms twice, nulls, dimensions without a weight, users without affinities or with too many for a row; a candidate isn't joined once a term."""
    r = random.Random(5)
    pairs = spark.createDataFrame([(r.choice([*range(6), None]), r.choice([*range(10), None])) for _ in range(120)], "user_id long, movie_id long")
    terms = spark.createDataFrame([(m, d, k) for m in range(9) for d, k in (("genre", f"g{m % 3}"), ("director", f"d{m % 2}"), ("tag", f"t{m % 4}"), ("tag", f"t{m % 2}"))], "movie_id long, dimension string, key string")
    affinity = spark.createDataFrame([(u, d, k, r.choice([-1.5, 0.25, 2.0]), r.choice([1, 3])) for u in range(1, 7) for d, k in (("genre", "g0"), ("director", "d1"), ("tag", "t1"), ("era", "x")) if r.random() < 0.8], "user_id long, dimension string, key string, affinity double, confidence long")
    want = profile.weighted_terms(pairs, terms, affinity).groupBy("user_id", "movie_id", "dimension").agg(F.sum("boost").alias("boost"))
    got = profile.term_boosts(pairs, terms, affinity, most=most)
    assert got.dtypes == want.dtypes
    near = [sorted(map(str, df.withColumn("boost", F.round("boost", 9)).collect())) for df in (got, want)]  # sums in any order
    assert near[0] == near[1] and len(near[0]) > 30
    by_term = [x for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x and "dimension" in x]
    assert bool(by_term) == (most < 4096)
