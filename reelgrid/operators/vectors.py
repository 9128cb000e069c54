"""Vectors: pivots, nearest neighbours, tag queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelgrid.functions import maths, text
from reelgrid.sources.shared import written

#: Vectors of a block: a matrix of scores has the square of that.
BLOCK = 1024


def pivoted(scores: DataFrame, size: int) -> DataFrame:
    """movie_id and its vector of `size` relevances from rows of movie_id, tag_id (from 1) and relevance; zero where there is none."""
    known = scores.groupBy("movie_id").agg(F.map_from_entries(F.collect_list(F.struct("tag_id", "relevance"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)).cast("float"))
    return known.select("movie_id", dense.alias("vector"))


def sound(vector: Column) -> Column:
    """The vector as doubles; null where it holds a null or a value that is not finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(finite & (F.size(vector) > 0), vector.cast("array<double>"))


def blocks(rows: DataFrame, name: str, size: int) -> DataFrame:
    """rows (an id called name, vector) as rows of up to size of them: their ids, unit vectors (binary, doubles) and n; the order in a partition stays.

    Vectors that are null, hold a null or a value that is not finite, or have (nearly) no length are left out.
    """
    schema = T.StructType([T.StructField("ids", T.ArrayType(rows.schema[name].dataType)), T.StructField("values", T.BinaryType()), T.StructField("n", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0

        def made(table: pa.Table) -> pa.RecordBatch:
            ids, v = table.column(name).combine_chunks(), table.column("vector").combine_chunks()
            dim = len(v[0])
            if pc.any(pc.not_equal(pc.list_value_length(v), dim)).as_py():
                raise ValueError(f"vectors of {dim} components and others")
            x = v.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            length = np.sqrt(np.einsum("ij,ij->i", x, x))
            flat, ids = x[length >= 1e-10] / length[length >= 1e-10, None], ids.filter(pa.array(length >= 1e-10))
            of = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            return pa.RecordBatch.from_arrays([of, pa.array([flat.tobytes()], pa.binary()), pa.array([len(ids)], pa.int32())], names=["ids", "values", "n"])

        for b in batches:
            for at in range(0, b.num_rows, size):
                some = b.slice(at, size)
                if n and n + some.num_rows > size:
                    yield made(pa.Table.from_batches(waiting))
                    waiting, n = [], 0
                waiting.append(some)
                n += some.num_rows
        if n:
            yield made(pa.Table.from_batches(waiting))

    whole = rows.select(name, sound(F.col("vector")).alias("vector")).filter(F.col("vector").isNotNull())
    return whole.mapInArrow(run, schema).filter("n > 0")


def best_of(scores: np.ndarray, top: int) -> np.ndarray:
    """Places of the top largest of each row, by six digits; of equal ones those that come first. Largest first."""
    s = np.round(scores, 6)
    top = min(top, s.shape[1])
    least = -np.partition(-s, top - 1, axis=1)[:, top - 1 : top]
    more, same = s > least, s == least
    same &= np.cumsum(same, axis=1) <= top - more.sum(1, keepdims=True)
    return np.nonzero(more | same)[1].reshape(len(s), top)


def best_pairs(pairs: DataFrame, ids: tuple[T.DataType, T.DataType], top: int) -> DataFrame:
    """query_id, item_id and score of the best items of each query in a task, for pairs of blocks (q_ids, q_values, q_n and i_ids, i_values, i_n).

    A block of queries meets one block of items after the other and keeps its best. Items come in the order of
    their ids, so that of equal scores the earlier one is kept.
    """
    schema = T.StructType([T.StructField("query_id", ids[0]), T.StructField("item_id", ids[1]), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: bytes | None = None
        asked, scores, found, held = None, None, None, None

        def given() -> Iterator[pa.RecordBatch]:
            if held is not None:
                n, k = scores.shape
                yield pa.RecordBatch.from_arrays([asked.take(pa.array(np.repeat(np.arange(n), k))), held.take(pa.array(found.reshape(-1))), pa.array(scores.reshape(-1))], names=["query_id", "item_id", "score"])

        for x in batches:
            for r in range(x.num_rows):
                raw, n, m = x.column("q_values")[r].as_buffer(), x.column("q_n")[r].as_py(), x.column("i_n")[r].as_py()
                if of != raw.to_pybytes() or not x.column("q_ids")[r].values.equals(asked):
                    yield from given()
                    of, asked, held = raw.to_pybytes(), x.column("q_ids")[r].values, None
                    q = np.frombuffer(of).reshape(n, -1)
                v = np.frombuffer(x.column("i_values")[r].as_buffer()).reshape(m, -1)
                if v.shape[1] != q.shape[1]:
                    raise ValueError(f"vectors of {v.shape[1]} components meet queries of {q.shape[1]} components")
                new = np.clip(q @ v.T, 0.0, 1.0)
                at = best_of(new, top)
                new, item = np.take_along_axis(new, at, 1), x.column("i_ids")[r].values
                if held is None:
                    scores, found, held = new, at, item
                    continue
                both, place = np.concatenate([scores, new], axis=1), np.concatenate([found, at + len(held)], axis=1)
                keep = best_of(both, top)
                scores, place = np.take_along_axis(both, keep, 1), np.take_along_axis(place, keep, 1)
                used, found = np.unique(place, return_inverse=True)  # ids of what is held, and no others
                found = found.reshape(place.shape)
                held = pa.concat_arrays([held, item]).take(pa.array(used))
        yield from given()

    return pairs.mapInArrow(run, schema)


def nearest(queries: DataFrame, items: DataFrame, top: int = 100, block: int = BLOCK) -> DataFrame:
    """query_id, item_id, score = max(0, cosine) and lane_rank of the nearest items to each query.

    queries: query_id, vector; items: item_id, vector. All pairs are scored, a block of queries by a block of
    items at once, as a matrix product; nothing is broadcast, a task holds its share of the items as blocks and shuffles
    only the best of it. Vectors that are null, hold a null or a value that is not finite, or have (nearly) no
    length take no part; vectors of different lengths are an error.
    """
    parts = max(1, int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    left = written(blocks(queries, "query_id", block), "asked").select(F.col("ids").alias("q_ids"), F.col("values").alias("q_values"), F.col("n").alias("q_n"))
    right = blocks(items.select("item_id", "vector").repartition(parts, F.xxhash64("item_id")).sortWithinPartitions("item_id"), "item_id", block)
    right = right.select(F.col("ids").alias("i_ids"), F.col("values").alias("i_values"), F.col("n").alias("i_n"))
    pairs = left.hint("shuffle_replicate_nl").crossJoin(right)  # the stated queries against all rows
    scored = best_pairs(pairs, (queries.schema["query_id"].dataType, items.schema["item_id"].dataType), top).withColumn("score", F.round("score", 6))
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return scored.withColumn("lane_rank", F.row_number().over(best)).filter(F.col("lane_rank") <= top).withColumn("lane_rank", F.col("lane_rank").cast("long"))


def tag_query(queries: DataFrame, tags: DataFrame) -> DataFrame:
    """query_id and the vector of tag weights that its text asks for, as rows of tag_id and weight (unit length).

    A tag that is the whole query weighs 3 more, one that stands in it as words 2; any
    other half of the number of words that it shares with the query.
    """
    q = queries.select("query_id", F.lower(F.trim("text")).alias("_q"))
    t = tags.select("tag_id", F.lower("tag").alias("_t"))
    # whatever weighs something shares a word of letters and digits, or else (a tag without any) is looked for as it is
    word = lambda c: F.explode(F.array_distinct(text.tokens(F.col(c))))
    met = q.withColumn("_w", word("_q")).join(t.withColumn("_w", word("_t")), "_w").select("query_id", "_q", "tag_id", "_t").distinct()
    odd = t.filter(F.size(text.tokens(F.col("_t"))) == 0)
    both = met.unionByName(q.join(odd, F.col("_q").contains(F.col("_t"))))
    shared = F.size(F.array_intersect(text.tokens(F.col("_q")), text.tokens(F.col("_t"))))
    found = text.has_word(F.col("_q"), F.col("_t"))
    weight = F.when(F.col("_q") == F.col("_t"), 3.0).otherwise(0.0) + F.when(found, 2.0).otherwise(0.5 * shared)
    rows = both.select("query_id", "tag_id", weight.alias("weight")).filter("weight > 0")
    length = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(W.partitionBy("query_id")))
    return rows.withColumn("weight", F.col("weight") / length)


def nearest_to_tags(asked: DataFrame, scores: DataFrame, top: int = 100) -> DataFrame:
    """query_id, item_id, score and lane_rank for tag weights against rows of movie_id, tag_id and relevance."""
    length = scores.groupBy("movie_id").agg(F.sqrt(F.sum(F.col("relevance") * F.col("relevance"))).alias("_l"))
    dots = scores.join(asked, "tag_id").groupBy("query_id", "movie_id").agg(F.sum(F.col("relevance") * F.col("weight")).alias("_d"))
    rows = dots.join(length, "movie_id").filter("_l > 0")
    scored = rows.select("query_id", F.col("movie_id").alias("item_id"), F.round(F.greatest(F.lit(0.0), F.col("_d") / F.col("_l")), 6).alias("score"))
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return scored.withColumn("lane_rank", F.row_number().over(best).cast("long")).filter(F.col("lane_rank") <= top)
