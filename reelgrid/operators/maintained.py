"""Rating statistics and association rules that follow changes, instead of being computed anew.

A table of ratings, the sums behind movie_stats and the supports behind
association_rules are kept as folders of States: a batch adds its ratings, and to each sum what it
changes there, which is negative for a rating that is replaced. What is asked for is the sum
over the folders. A batch reads the earlier ratings of the users that it touches, by shards of users, and no
others; sums that it changes aren't read at all.

Defined results: the rating of a user and a movie is the one with the last `at`, then the
highest; an older one that arrives later changes nothing, nor does one that arrives again. Null users
or movies are left out, and a null rating is none; ratings are multiples of a
power of two, such as halves, so that their sums are exact. A batch that changes nothing leaves no folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrid.functions.ordering import latest
from reelgrid.sources.shared import written
from reelgrid.sources.sinks import States

from . import rules
from .ratings import LIKED

RATED = ["user_id", "movie_id", "rating", "at"]


def pairs(capped: DataFrame) -> DataFrame:
    """item_a < item_b of what the same users like, once for each user."""
    return capped.alias("a").join(capped.alias("b"), "user_id").filter("a.item < b.item").select(F.col("a.item").alias("item_a"), F.col("b.item").alias("item_b"))


class Maintained:
    """Statistics and rules over ratings (user_id, movie_id, rating, at: anything with an order) that arrive in batches.

    A user has at most per_user liked movies in the rules, so at most per_user squared over two pairs are kept for each.
    Users are dealt to shards, and a batch reads those that its users are in; their number is part of the
    table's name, so that a store opened with another number is an error.
    """

    def __init__(self, spark: SparkSession, path: str, per_user: int = 50, shards: int = 256) -> None:
        self.spark, self.states, self.per_user, self.shards = spark, States(spark, path), per_user, shards
        self._rated = f"table=ratings{shards}"

    def _shard(self) -> Column:
        return F.pmod(F.xxhash64("user_id"), F.lit(self.shards)).cast("int")

    def _sums(self, name: str, keys: list[str], folders: list[str] | None = None) -> DataFrame | None:
        """The sums of a table's other columns by keys, without those that are zero everywhere; None if there is no folder."""
        found = self.states.paths(self.states.last()[1] if folders is None else folders)
        if not found:
            return None
        rows = self.spark.read.parquet(*[f"{p}/table={name}" for p in found])
        numbers = [c for c in rows.columns if c not in keys]
        sums = rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in numbers])
        return sums.filter(" OR ".join(f"{c} <> 0" for c in numbers))

    def _ratings(self, folders: list[str]) -> DataFrame:
        # from the root on, shard is a partition of all folders
        return self.spark.read.option("basePath", f"{self.states.path}/rows").parquet(*[f"{p}/{self._rated}" for p in self.states.paths(folders)])

    def ratings(self) -> DataFrame:
        """The current ratings."""
        return last(self._ratings(self.states.last()[1])).select(*RATED)

    def update(self, batch: DataFrame) -> None:
        """Take in a batch of ratings: new ones, and ones in place of earlier ones."""
        rows = batch.select(*RATED).filter("user_id is not null and movie_id is not null and rating is not null")
        new = written(last(rows).withColumn("shard", self._shard()), "batch")
        while not self._add(new):
            pass  # another batch came first: what it changed has to be seen

    def _add(self, new: DataFrame) -> bool:
        n, folders = self.states.last()
        if folders:
            shards = [r[0] for r in new.select("shard").distinct().collect()]  # self.shards rows at most
            mine = self._ratings(folders).filter(F.col("shard").isin(shards)).join(new.select("user_id").distinct(), "user_id", "left_semi")
            old = written(last(mine.select(*RATED)), "touched")
        else:
            old = new.select(*RATED).limit(0)
        before = old.select("user_id", "movie_id", F.col("rating").alias("_rating"), F.col("at").alias("_at"))
        met = new.join(before, ["user_id", "movie_id"], "left")
        is_newer = F.col("_rating").isNull() | (F.struct("at", "rating") > F.struct(F.col("_at").alias("at"), F.col("_rating").alias("rating")))
        changed = written(met.filter(is_newer), "changed")
        if changed.isEmpty():
            return True
        after = last(old.unionByName(changed.select(*RATED)))
        likes = lambda r: rules.best_liked(rules.likes(r, "movie_id", LIKED), self.per_user)
        was, now = (written(likes(x), "likes") for x in (old, after))

        def difference(make, keys: list[str]) -> DataFrame:
            both = make(was).withColumn("n", F.lit(-1)).unionByName(make(now).withColumn("n", F.lit(1)))
            return both.groupBy(*keys).agg(F.sum("n").alias("n")).filter("n <> 0")

        def write(path: str) -> None:
            # a shard's rows in one file of each batch
            changed.select(*RATED, "shard").repartition("shard").write.partitionBy("shard").parquet(f"{path}/{self._rated}")
            counts(changed).write.parquet(f"{path}/table=movies")
            difference(lambda x: x.select("item"), ["item"]).write.parquet(f"{path}/table=items")
            difference(pairs, ["item_a", "item_b"]).write.parquet(f"{path}/table=pairs")
            difference(lambda x: x.select("user_id").distinct().select(F.lit(True).alias("all")), ["all"]).write.parquet(f"{path}/table=users")

        return self.states.append(write, n, folders)

    def movie_stats(self, digits: int = 6) -> DataFrame | None:
        """The rows of ratings.movie_stats; None before the first batch."""
        sums = self._sums("movies", ["movie_id"])
        if sums is None:
            return None
        return sums.select("movie_id", F.round(F.col("total") / F.col("n"), digits).alias("avg_rating"), F.col("n").alias("num_ratings"), F.round(F.col("liked") * 100.0 / F.col("n"), digits).alias("pct_positive"))

    def association_rules(self, min_support: int = 200, min_lift: float = 1.0, per_item: int = 15) -> DataFrame | None:
        """The rows of rules.association_rules; None before the first batch."""
        half = self._sums("pairs", ["item_a", "item_b"])
        if half is None:
            return None
        half = half.filter(F.col("n") >= min_support).withColumnRenamed("n", "support")
        whole = half.unionByName(half.select(F.col("item_a").alias("item_b"), F.col("item_b").alias("item_a"), "support"))
        users = self._sums("users", ["all"]).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("_users"))
        items = self._sums("items", ["item"]).filter(F.col("n") >= min_support)
        return rules.scored_rules(whole, items, users, min_lift, per_item)

    def compact(self) -> bool:
        """Put all batches together into one folder; False if a batch came between. Folders that were read stay for who still reads them."""
        n, folders = self.states.last()
        if len(folders) < 2:
            return True

        def write(path: str) -> None:
            last(self._ratings(folders).select(*RATED)).withColumn("shard", self._shard()).repartition("shard").write.partitionBy("shard").parquet(f"{path}/{self._rated}")
            for name, keys in (("movies", ["movie_id"]), ("items", ["item"]), ("pairs", ["item_a", "item_b"]), ("users", ["all"])):
                self._sums(name, keys, folders).write.parquet(f"{path}/table={name}")

        return self.states.append(write, n, [])


def last(rows: DataFrame) -> DataFrame:
    return latest(rows, ["user_id", "movie_id"], ["at", "rating"])


def counts(changed: DataFrame) -> DataFrame:
    """movie_id and what changed ratings (rating, _rating: the one that is replaced, or null) add to its n, total and liked."""
    liked = lambda c: F.when(F.col(c) >= LIKED, 1).otherwise(0)
    return changed.groupBy("movie_id").agg(
        F.sum(F.when(F.col("_rating").isNull(), 1).otherwise(0)).alias("n"), F.sum(F.col("rating") - F.coalesce("_rating", F.lit(0.0))).alias("total"), F.sum(liked("rating") - liked("_rating")).alias("liked")
    )
