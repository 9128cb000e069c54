"""Joining ranked lanes, and filling what a reranker left out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def reciprocal_rank(lanes: dict[str, DataFrame], top: int = 20, k: int = 60, digits: int = 5) -> DataFrame:
    """query_id, item_id, rrf_score, lanes, lane_ranks and rrf_rank of lanes (query_id, item_id, lane_rank from 1).

    Equal scores go to the item of the earlier lane, then to its better rank there.
    """
    tagged = [df.select("query_id", "item_id", "lane_rank", F.lit(name).alias("lane"), F.lit(i).alias("lane_no")) for i, (name, df) in enumerate(lanes.items())]
    rows = reduce(DataFrame.unionByName, tagged)
    seen = F.sort_array(F.collect_list(F.struct("lane_no", "lane", "lane_rank")))
    fused = rows.groupBy("query_id", "item_id").agg(F.sum(F.lit(1.0) / (F.col("lane_rank") + k)).alias("_s"), seen.alias("_l"))
    best = W.partitionBy("query_id").orderBy(F.desc(F.round("_s", 12)), F.col("_l")[0]["lane_no"], F.col("_l")[0]["lane_rank"], "item_id")
    ranked = fused.withColumn("rrf_rank", F.row_number().over(best)).filter(F.col("rrf_rank") <= top)
    return ranked.select(
        "query_id", "item_id", F.col("rrf_rank").cast("long").alias("rrf_rank"), F.round("_s", digits).alias("rrf_score"),
        F.transform("_l", lambda x: x["lane"]).alias("lanes"), F.map_from_entries(F.transform("_l", lambda x: F.struct(x["lane"], x["lane_rank"]))).alias("lane_ranks"),
    )


def with_rerank(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """candidates with rerank_score; those that scores lacks get half of the lowest one of their query."""
    rows = candidates.join(scores.select("query_id", "item_id", F.col("score").alias("_s")), ["query_id", "item_id"], "left")
    least = F.min("_s").over(W.partitionBy("query_id"))
    return rows.withColumn("rerank_score", F.coalesce("_s", least * 0.5)).drop("_s")


def lexical_rerank(pairs: DataFrame) -> DataFrame:
    """A stand-in for a cross-encoder: the share of the query's words that the passage has.

    pairs: query_id, item_id, query, passage.
    """
    from reelgrid.functions import text

    q, p = F.array_distinct(text.tokens(F.col("query"))), text.tokens(F.col("passage"))
    share = F.size(F.array_intersect(q, p)) / F.greatest(F.size(q), F.lit(1))
    return pairs.select("query_id", "item_id", share.alias("score"))


def model_rerank(pairs: DataFrame, load, batch: int = 32) -> DataFrame:
    """Scores by any model: load() is called once a task and returns a function of two lists of strings."""

    def run(batches):
        import pyarrow as pa

        score = load()
        for b in batches:
            q, p = b.column("query").to_pylist(), b.column("passage").to_pylist()
            found = [float(s) for at in range(0, len(q), batch) for s in score(q[at : at + batch], p[at : at + batch])]
            yield pa.RecordBatch.from_arrays([b.column("query_id"), b.column("item_id"), pa.array(found, pa.float64())], names=["query_id", "item_id", "score"])

    kinds = dict(pairs.dtypes)
    rows = pairs.select("query_id", "item_id", "query", "passage")
    return rows.mapInArrow(run, f"query_id {kinds['query_id']}, item_id {kinds['item_id']}, score double")


def yes_no_logit(logits: DataFrame) -> DataFrame:
    """query_id, item_id and score = max(yes, Yes) - max(no, No) from a map of token logits."""
    best = lambda *names: F.greatest(*[F.try_element_at("logits", F.lit(n)) for n in names])
    return logits.select("query_id", "item_id", (best("yes", "Yes") - best("no", "No")).alias("score"))
