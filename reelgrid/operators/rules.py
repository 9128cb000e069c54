"""Association rules over what users like."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def likes(ratings: DataFrame, item: str, least: float = 4.0) -> DataFrame:
    """user_id, item and rating of what is liked; of an item that a user rated several times the best."""
    return ratings.filter(F.col("rating") >= least).groupBy("user_id", F.col(item).alias("item")).agg(F.max("rating").alias("rating"))


def best_liked(liked: DataFrame, per_user: int = 50) -> DataFrame:
    """user_id and item of the items that each user likes best."""
    mine = W.partitionBy("user_id").orderBy(F.desc("rating"), "item")
    return liked.withColumn("_n", F.row_number().over(mine)).filter(F.col("_n") <= per_user).select("user_id", "item")


def association_rules(liked: DataFrame, per_user: int = 50, min_support: int = 200, min_lift: float = 1.0, per_item: int = 15, only: DataFrame | None = None) -> DataFrame:
    """item_a, item_b, support (users of both), confidence and lift of the best rules of each item, or of those in only (item).

    Before items are paired, each user has at most per_user of them and each item at least
    min_support users, so that a user makes at most per_user squared pairs and the pairs
    are of frequent items only.
    """
    users = liked.agg(F.countDistinct("user_id").cast("double").alias("_users"))
    capped = best_liked(liked, per_user)
    frequent = capped.groupBy("item").agg(F.countDistinct("user_id").alias("n")).filter(F.col("n") >= min_support)
    kept = capped.join(frequent.select("item"), "item", "left_semi")
    left = kept if only is None else kept.join(only.select("item").distinct(), "item", "left_semi")
    both = left.alias("a").join(kept.alias("b"), "user_id").filter("a.item <> b.item")
    pairs = both.groupBy(F.col("a.item").alias("item_a"), F.col("b.item").alias("item_b")).agg(F.count(F.lit(1)).alias("support")).filter(F.col("support") >= min_support)
    return scored_rules(pairs, frequent, users, min_lift, per_item)


def scored_rules(pairs: DataFrame, counts: DataFrame, users: DataFrame, min_lift: float = 1.0, per_item: int = 15) -> DataFrame:
    """The best rules of each item from pairs (item_a, item_b, support), counts (item, n) and the number of users (one row, _users)."""
    counted = pairs.join(counts.withColumnsRenamed({"item": "item_a", "n": "_na"}), "item_a").join(counts.withColumnsRenamed({"item": "item_b", "n": "_nb"}), "item_b")
    scored = counted.crossJoin(F.broadcast(users)).select(  # one row
        "item_a", "item_b", "support", F.round(F.col("support") / F.col("_na"), 6).alias("confidence"),
        F.round(F.col("support") * F.col("_users") / (F.col("_na") * F.col("_nb")), 6).alias("lift"),
    )
    best = W.partitionBy("item_a").orderBy(F.desc("lift"), F.desc("confidence"), "item_b")
    return scored.filter(F.col("lift") > min_lift).withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= per_item).drop("_n")


def associated(source: DataFrame, rules: DataFrame, movies: DataFrame, n: int = 10, comedy: str = "Comedy") -> DataFrame:
    """Movies that rules lead to from source (one row of movies): with a genre in common, and no comedy unless the source is one.

    rules: item_a and item_b as movie ids.
    """
    s = source.select(F.col("movie_id").alias("item_a"), F.col("genres").alias("_genres"))
    funny = F.array_contains("_genres", comedy)
    rows = rules.join(F.broadcast(s), "item_a").join(movies, F.col("item_b") == F.col("movie_id"))  # source has one row
    rows = rows.filter(F.arrays_overlap("genres", "_genres") & (funny | ~F.array_contains("genres", comedy)))
    return rows.orderBy(F.desc("lift"), F.desc("confidence"), "movie_id").limit(n).drop("item_a", "item_b", "_genres")
