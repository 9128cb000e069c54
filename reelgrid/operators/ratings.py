"""Rating statistics and the lists made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrid.functions import maths
from reelgrid.functions.ordering import rank_descending

LIKED = 4.0


def movie_stats(ratings: DataFrame, digits: int = 6) -> DataFrame:
    """movie_id, avg_rating, num_ratings and pct_positive (per cent of ratings that are 4 or more)."""
    liked = F.sum(F.when(F.col("rating") >= LIKED, 1).otherwise(0))
    return ratings.groupBy("movie_id").agg(
        F.round(F.avg("rating"), digits).alias("avg_rating"), F.count("rating").alias("num_ratings"), F.round(liked * 100.0 / F.count("rating"), digits).alias("pct_positive")
    )


def with_popularity(stats: DataFrame) -> DataFrame:
    return rank_descending(stats, "num_ratings", "avg_rating", "popularity_rank")


def backfilled(stats: DataFrame, movies: DataFrame) -> DataFrame:
    """stats with a row of zeros for each movie without ratings, ranked behind the rated ones."""
    rest = movies.select("movie_id").join(stats.select("movie_id"), "movie_id", "left_anti")
    n = stats.agg((F.count(F.lit(1)) + 1).alias("popularity_rank"))
    zeros = rest.select("movie_id", F.lit(0.0).alias("avg_rating"), F.lit(0).cast("long").alias("num_ratings"), F.lit(0.0).alias("pct_positive")).crossJoin(F.broadcast(n))  # one row
    return stats.unionByName(zeros)


def has_genre(genre: str) -> Column:
    return F.exists("genres", lambda g: F.lower(g) == genre.lower())


def top_by_genre(movies: DataFrame, stats: DataFrame, genre: str, n: int, by: str = "rating") -> DataFrame:
    rows = movies.filter(has_genre(genre)).join(stats, "movie_id").filter(F.col("num_ratings") > 0)
    return rows.orderBy(*order(by)).limit(n)


def top_overall(movies: DataFrame, stats: DataFrame, n: int, by: str = "rating", least: int = 100) -> DataFrame:
    return movies.join(stats.filter(F.col("num_ratings") >= least), "movie_id").orderBy(*order(by)).limit(n)


def order(by: str) -> list[Column]:
    return [F.desc("avg_rating") if by == "rating" else F.asc("popularity_rank"), F.asc("movie_id")]


def default_recommendations(movies: DataFrame, stats: DataFrame, n: int = 100, least: int = 1000, prior_n: float = 500, prior_mean: float = 3.5, without: str = "documentary") -> DataFrame:
    """The movies with the best damped rating among those with enough ratings, a year, and another genre than `without`."""
    rows = movies.filter(F.col("year").isNotNull() & ~has_genre(without)).join(stats.filter(F.col("num_ratings") >= least), "movie_id")
    score = F.round(maths.bayes(F.col("avg_rating"), F.col("num_ratings"), prior_n, prior_mean), 6)
    return rows.withColumn("bayes", score).orderBy(F.desc("bayes"), "movie_id").limit(n)


def best_title(movies: DataFrame, stats: DataFrame, title: str) -> DataFrame:
    """The most rated movie whose title is the given one (or that without `the `), else the most rated that contains it."""
    wanted = title.lower()
    short = wanted.replace("the ", "")
    low = F.lower("title")
    hit = F.when(low.isin(wanted, short), 0).when(low.contains(wanted), 1)
    rows = movies.withColumn("_hit", hit).filter(F.col("_hit").isNotNull()).join(stats.select("movie_id", "num_ratings"), "movie_id", "left")
    return rows.orderBy("_hit", F.desc_nulls_last("num_ratings"), "movie_id").limit(1).drop("_hit", "num_ratings")
