"""Ranking metrics and hold-out splits."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelgrid.functions import maths


def time_split(ratings: DataFrame, n_test: int = 5) -> DataFrame:
    """ratings with is_test: the last n_test of each user (all, if a user has no more)."""
    newest = W.partitionBy("user_id").orderBy(F.desc("rated_at"), F.desc("movie_id"))
    return ratings.withColumn("is_test", F.row_number().over(newest) <= n_test)


def half_split(ratings: DataFrame, least: int = 15) -> DataFrame:
    """ratings with place (from 1, in time) and is_profile (first half), of users whose first half has `least`.

    Halves go by place, not by time, so that no target of the same second is in the profile.
    """
    mine = W.partitionBy("user_id")
    rows = ratings.withColumn("place", F.row_number().over(mine.orderBy("rated_at", "movie_id")).cast("long")).withColumn("_n", F.count(F.lit(1)).over(mine))
    half = F.expr("_n div 2")
    return rows.filter(half >= least).withColumn("is_profile", F.col("place") <= half).drop("_n")


def halved_users(ratings: DataFrame, least: int = 15) -> DataFrame:
    """user_id of those that half_split() keeps."""
    return ratings.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.expr("_n div 2") >= least).select("user_id")


def relevant(test: DataFrame, least: float = 4.0) -> DataFrame:
    return test.filter(F.col("rating") >= least).select("user_id", F.col("movie_id").alias("item_id")).distinct()


def recall_at_k(ranked: DataFrame, truth: DataFrame, k: int = 100) -> DataFrame:
    """user_id and recall for each user in truth (user_id, item_id). ranked: user_id, item_id, rank from 1."""
    hits = truth.join(ranked.filter(F.col("rank") <= k).select("user_id", "item_id", F.lit(1).alias("_hit")), ["user_id", "item_id"], "left")
    return hits.groupBy("user_id").agg(F.round(F.count("_hit") / F.count(F.lit(1)), 6).alias("recall"))


def ndcg_at_k(ranked: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    """user_id and binary NDCG for each user in truth."""
    hits = truth.join(ranked.filter(F.col("rank") <= k).select("user_id", "item_id", "rank"), ["user_id", "item_id"], "left")
    gains = hits.groupBy("user_id").agg(F.sum(1 / F.log2(F.col("rank") + 1)).alias("_dcg"), F.count(F.lit(1)).alias("_n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("_n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return gains.select("user_id", F.round(F.coalesce("_dcg", F.lit(0.0)) / ideal, 6).alias("ndcg"))


def discounted(rows: DataFrame, score: str, k: int) -> DataFrame:
    """user_id and _dcg: the expected discounted gain of rows (user_id, gain and score) if rows of one score come in any order.

    Rows of a score share their places, so each has the mean discount of those, from
    prefix sums of discounts; nothing is permuted, and a tie is one row once it is summed.
    """
    sums = [0.0]
    for i in range(1, k + 1):
        sums.append(sums[-1] + 1 / math.log2(i + 1))
    upto = lambda n: F.get(F.array(*map(F.lit, sums)), F.least(n, F.lit(k)).cast("int"))
    ties = rows.groupBy("user_id", F.col(score).alias("_s")).agg(F.count(F.lit(1)).alias("_n"), F.sum("gain").alias("_gain"))
    last = F.sum("_n").over(W.partitionBy("user_id").orderBy(F.desc_nulls_last("_s")).rowsBetween(W.unboundedPreceding, W.currentRow))
    placed = ties.withColumn("_last", last)
    share = (upto(F.col("_last")) - upto(F.col("_last") - F.col("_n"))) / F.col("_n")
    return placed.groupBy("user_id").agg(F.sum(F.col("_gain") * share).alias("_dcg"))


def ndcg_tied(scored: DataFrame, k: int = 10) -> DataFrame:
    """user_id and NDCG of scored (user_id, score, gain), averaged over all orders of equal scores; a null score comes last, and users without any gain are left out."""
    best = discounted(scored, "gain", k).withColumnRenamed("_dcg", "_ideal").filter("_ideal > 0")
    return discounted(scored, "score", k).join(best, "user_id").select("user_id", F.round(F.col("_dcg") / F.col("_ideal"), 6).alias("ndcg"))


def intra_list_distance(lists: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """list_id and the mean of 1 - cosine over pairs of its first k items; items without a vector are left out, 0 below two.

    lists: list_id, item_id, rank; vectors: item_id, vector.
    """
    unit = vectors.select("item_id", maths.unit(F.col("vector")).alias("_u")).filter(F.col("_u").isNotNull())
    rows = lists.filter(F.col("rank") <= k).join(unit, "item_id").select("list_id", "rank", "_u")
    a, b = rows.alias("a"), rows.alias("b")
    pairs = a.join(b, (F.col("a.list_id") == F.col("b.list_id")) & (F.col("a.rank") < F.col("b.rank")))  # at most k squared of a list
    apart = pairs.groupBy(F.col("a.list_id").alias("list_id")).agg(F.avg(1 - maths.clamp(maths.dot(F.col("a._u"), F.col("b._u")), -1.0, 1.0)).alias("_d"))
    return lists.select("list_id").distinct().join(apart, "list_id", "left").select("list_id", F.round(F.coalesce("_d", F.lit(0.0)), 6).alias("ild"))


def evaluate(ranked: DataFrame, retrieved: DataFrame, test: DataFrame, vectors: DataFrame | None = None, k_recall: int = 100, k_ndcg: int = 10, k_ild: int = 10) -> DataFrame:
    """user_id, n_test, n_relevant, recall, ndcg and, with vectors, ild of each user in test."""
    users = test.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_test"), F.count(F.when(F.col("rating") >= 4.0, 1)).alias("n_relevant"))
    truth = relevant(test)
    out = users.join(recall_at_k(retrieved, truth, k_recall), "user_id", "left").join(ndcg_at_k(ranked, truth, k_ndcg), "user_id", "left")
    out = out.withColumns({"recall": F.coalesce("recall", F.lit(0.0)), "ndcg": F.coalesce("ndcg", F.lit(0.0))})
    if vectors is not None:
        lists = ranked.select(F.col("user_id").alias("list_id"), "item_id", "rank")
        out = out.join(intra_list_distance(lists, vectors, k_ild).withColumnRenamed("list_id", "user_id"), "user_id", "left")
    return out
