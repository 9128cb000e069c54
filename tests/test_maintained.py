"""Statistics and rules that follow batches, against those computed anew."""

import random

import pytest
from pyspark.sql import functions as F

from reelgrid.operators import ratings as R
from reelgrid.operators import rules
from reelgrid.operators.maintained import Maintained
from reelgrid.sources.sinks import States

SCHEMA = "user_id long, movie_id long, rating double, at long"


def rows(df):
    return sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())


def some(spark, *found):
    return spark.createDataFrame(list(found), SCHEMA)


def drawn(seed, n, users=25):
    draw = random.Random(seed)
    return [(draw.randrange(users), draw.randrange(12), draw.randrange(1, 11) / 2, draw.randrange(50)) for _ in range(n)]


def agrees(spark, store, arrived):
    best = {}
    for u, m, r, at in arrived:
        best[u, m] = max(best.get((u, m), (at, r)), (at, r))
    anew = some(spark, *[(u, m, r, at) for (u, m), (at, r) in best.items()])
    assert rows(store.ratings()) == rows(anew)
    assert rows(store.movie_stats()) == rows(R.movie_stats(anew))
    want = rules.association_rules(rules.likes(anew, "movie_id"), per_user=store.per_user, min_support=2, min_lift=0.5)
    assert rows(store.association_rules(2, 0.5)) == rows(want)


def test_batches_in_any_order_give_what_all_ratings_give(spark, tmp_path):
    store = Maintained(spark, str(tmp_path / "m"), per_user=4, shards=8)
    assert store.movie_stats() is None and store.association_rules() is None
    arrived = []
    for seed, n, users in ((1, 150, 25), (2, 40, 25), (3, 6, 2)):
        batch = drawn(seed, n, users)
        store.update(some(spark, *batch))
        arrived += batch
    agrees(spark, store, arrived)
    assert store.compact() and len(store.states.last()[1]) == 1
    agrees(spark, store, arrived)
    store.update(some(spark, *drawn(4, 20)))
    agrees(spark, store, arrived + drawn(4, 20))


def test_what_is_old_or_known_or_null_changes_nothing(spark, tmp_path):
    store = Maintained(spark, str(tmp_path / "m"), shards=4)
    store.update(some(spark))
    assert store.states.last() == (0, [])
    store.update(some(spark, (1, 1, 4.0, 10), (1, 1, 4.0, 10), (1, 2, 5.0, 10)))
    for batch in ([(1, 1, 4.0, 10)], [(1, 1, 1.0, 9)], [(None, 1, 1.0, 20), (1, None, 1.0, 20), (1, 1, None, 20)], []):
        store.update(some(spark, *batch))
        assert store.states.last()[0] == 1
    store.update(some(spark, (1, 1, 4.5, 10)))  # of the same moment the highest
    assert rows(store.movie_stats()) == [(4.5, 1, 1, 100.0), (5.0, 2, 1, 100.0)]


def test_a_batch_that_was_overtaken_sees_what_came_between(spark, tmp_path):
    store, late = (Maintained(spark, str(tmp_path / "m"), shards=4) for _ in range(2))
    store.update(some(spark, (1, 1, 2.0, 1)))

    class Overtaken(States):
        met = False

        def append(self, *found):
            if not self.met:
                self.met = True
                store.update(some(spark, (1, 1, 5.0, 2), (2, 1, 4.0, 2)))
            return super().append(*found)

    late.states = Overtaken(spark, store.states.path)
    late.update(some(spark, (1, 1, 3.0, 3)))
    agrees(spark, store, [(1, 1, 2.0, 1), (1, 1, 5.0, 2), (2, 1, 4.0, 2), (1, 1, 3.0, 3)])


def test_only_shards_of_touched_users_are_read(spark, tmp_path):
    store = Maintained(spark, str(tmp_path / "m"), shards=16)
    store.update(some(spark, *drawn(1, 200, 100)))
    seen = store._ratings(store.states.last()[1]).filter(F.col("shard").isin([3]))
    assert 0 < len(seen.inputFiles()) and "PartitionFilters: [isnotnull(shard" in seen._jdf.queryExecution().executedPlan().toString().replace("`", "")
    assert seen.filter(F.pmod(F.xxhash64("user_id"), F.lit(16)) != 3).count() == 0 < seen.count()


def test_another_number_of_shards_is_an_error(spark, tmp_path):
    store = Maintained(spark, str(tmp_path / "m"), shards=4)
    store.update(some(spark, (1, 1, 2.0, 1)))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        Maintained(spark, store.states.path, shards=8).ratings()
