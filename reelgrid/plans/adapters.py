"""The driver's tables as the catalogue's: ratings, movies and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrid.functions.ordering import latest
from reelgrid.functions.text import unix_seconds
from reelgrid.operators import profile
from reelgrid.operators import ratings as R
from reelgrid.sources.shared import once


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, movie_id, rating, rated_at: of the lines in which a customer took a part, the last. Written once, because a query reads them several times."""
    return once(spark, "ratings", [f"{sf_dir}/{name}.parquet" for name in ("orders", "lineitem")], lambda: last_ratings(spark, sf_dir))


def last_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    rows = table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.select(
        F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("movie_id"), (F.ceil(F.col("l_quantity") / 5) * F.lit(0.5)).alias("rating"),
        "l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice",
    )
    last = latest(rows, ["user_id", "movie_id"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"])
    return last.select("user_id", "movie_id", "rating", unix_seconds(F.col("l_shipdate")).alias("rated_at"))


def movies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts as movies; joined by merging, because their compressed files look small enough for a broadcast long after the rows aren't."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("movie_id"), F.col("p_name").alias("title"), (F.lit(1970) + F.col("p_size")).cast("int").alias("year"), F.array("p_type").alias("genres"),
        F.array("p_brand").alias("directors"), F.split("p_name", " ").alias("top_tags"), F.col("p_brand").alias("collection"),
    ).hint("merge")


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.with_popularity(R.movie_stats(ratings(spark, sf_dir)))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.rating_events(ratings(spark, sf_dir), profile.movie_terms(movies(spark, sf_dir)))


def vectors(spark: SparkSession, sf_dir: str, name: str = "item_id") -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias(name), F.col("embedding").alias("vector"))
