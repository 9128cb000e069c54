"""Approximate nearest neighbours: inverted lists of unit vectors, stored, open to additions.

Every vector lies in the list of the centroid that it is most alike to. Centroids are
fitted once, on a bounded sample; every vector is indexed, then and later. A query probes
the lists of its nearest centroids and scores their vectors exactly, by the formula of
vectors.nearest, so that probing all lists gives that operator's rows.

The lists are a table bucketed by list and piece: a search shuffles its queries, never a
stored vector, and a list that holds a third of all vectors is read by as many tasks as
there are pieces. Additions append to the buckets and need no rebuild; centroids that no
longer fit cost recall, not results, and call for a new index.

Defined results: vectors that are null, hold a null or a value that is not finite, or have
(nearly) no length, as item or as query, take no part; an item that is added twice is
there twice; ties go by item_id; an index of nothing finds nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelgrid.functions import maths
from reelgrid.sources import shared

from . import vectors

#: Vectors that centroids are fitted on, about, rounds of that, and centroids at most.
SAMPLE = 20_000
FITS = 10
LISTS = 4096
#: Tasks over which a list is dealt, and lists that a query probes.
PIECES = 8
PROBES = 16
ITEMS = "list int, piece int, item_id {id}, vector array<double>"


def unit(vector: Column) -> Column:
    """The vector's direction; null where it takes no part."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(sound, maths.unit(vector))


def rows_of(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != len(column) * dim:
        raise ValueError(f"the index holds vectors of {dim} components")
    return flat.reshape(-1, dim)


def centroids_of(x: np.ndarray, lists: int, seed: int) -> np.ndarray:
    """Unit centroids of unit vectors by rounds of reassignment; one that no vector is nearest to stays."""
    found = np.unique(x, axis=0)
    c = found[np.random.default_rng(seed).permutation(len(found))[:lists]]
    for _ in range(FITS):
        at, sums = np.argmax(x @ c.T, axis=1), np.zeros_like(c)
        np.add.at(sums, at, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 1e-10, sums / np.maximum(size, 1e-10), c)
    return c


class VectorIndex:
    """The index in a folder that all executors reach: centroids, facts (one row) and lists, a bucketed table of the catalogue."""

    def __init__(self, spark: SparkSession, path: str, name: str) -> None:
        self.spark, self.path, self.name = spark, path, name

    @classmethod
    def create(cls, items: DataFrame, path: str, name: str, lists: int | None = None, sample: int = SAMPLE, pieces: int = PIECES, seed: int = 42) -> VectorIndex:
        """A new index of items (item_id, vector); lists: the root of the number of items, if not given."""
        spark = items.sparkSession
        self = cls(spark, path, name)
        units = items.select("item_id", unit(F.col("vector")).alias("vector")).filter("vector is not null")
        n, dim = units.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
        part = F.pmod(F.xxhash64("item_id", F.lit(seed)), F.lit(1 << 40)) < math.ceil(min(1.0, sample / max(1, n)) * (1 << 40))
        drawn = units.filter(part).select("vector").toArrow().column("vector").combine_chunks()
        c = centroids_of(rows_of(drawn, dim), lists or min(LISTS, max(1, math.isqrt(n))), seed) if len(drawn) else np.zeros((0, dim or 0))
        spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "list int, vector array<double>").write.parquet(f"{path}/centroids")
        buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        spark.createDataFrame([(int(dim or 0), pieces, buckets, items.schema["item_id"].dataType.simpleString())], "dim int, pieces int, buckets int, id string").write.parquet(f"{path}/facts")
        self._append(self._placed(units))
        return self

    @cached_property
    def facts(self) -> T.Row:
        return self.spark.read.parquet(f"{self.path}/facts").first()

    @cached_property
    def centroids(self) -> Broadcast:
        """At most LISTS vectors, in the order of their lists."""
        rows = self.spark.read.parquet(f"{self.path}/centroids").orderBy("list").collect()
        return self.spark.sparkContext.broadcast(np.array([r["vector"] for r in rows], float).reshape(len(rows), self.facts["dim"]))

    def _nearest(self, rows: DataFrame, n: int) -> DataFrame:
        """rows (with vector, of unit length) for each of the n lists nearest to them; with list and its place, from 0."""
        shared_, dim = self.centroids, self.facts["dim"]
        n = min(n, len(shared_.value))
        schema = T.StructType([*rows.schema.fields, T.StructField("list", T.IntegerType()), T.StructField("place", T.IntegerType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if n and b.num_rows:
                    alike = rows_of(b.column("vector"), dim) @ shared_.value.T
                    best = np.argsort(-alike, axis=1, kind="stable")[:, :n]
                    whole = b.take(pa.array(np.repeat(np.arange(b.num_rows), n)))
                    place = np.tile(np.arange(n, dtype=np.int32), b.num_rows)
                    yield pa.RecordBatch.from_arrays([*whole.columns, pa.array(best.reshape(-1).astype(np.int32)), pa.array(place)], names=[*b.schema.names, "list", "place"])

        return rows.mapInArrow(run, schema)

    def _placed(self, units: DataFrame) -> DataFrame:
        piece = F.pmod(F.xxhash64("item_id"), F.lit(self.facts["pieces"])).cast("int").alias("piece")
        return self._nearest(units, 1).select("list", piece, "item_id", "vector")

    def _append(self, rows: DataFrame) -> None:
        dealt = rows.repartition(self.facts["buckets"], "list", "piece")
        dealt.write.mode("append").bucketBy(self.facts["buckets"], "list", "piece").sortBy("list", "piece").option("path", f"{self.path}/lists").saveAsTable(self.name)
        self.spark.catalog.refreshTable(self.name)

    def add(self, items: DataFrame) -> None:
        """Index more items; centroids stay."""
        self.table()
        self._append(self._placed(items.select("item_id", unit(F.col("vector")).alias("vector")).filter("vector is not null")))

    def table(self) -> DataFrame:
        """The lists; a session whose catalogue doesn't know them finds them in their folder."""
        if not self.spark.catalog.tableExists(self.name):
            columns = ITEMS.format(id=self.facts["id"])
            self.spark.sql(f"CREATE TABLE {self.name} ({columns}) USING parquet CLUSTERED BY (list, piece) SORTED BY (list, piece) INTO {self.facts['buckets']} BUCKETS LOCATION '{self.path}/lists'")
        return self.spark.table(self.name)

    def _probed(self, queries: DataFrame, probes: int) -> DataFrame:
        asked = queries.select("query_id", unit(F.col("vector")).alias("vector")).filter("vector is not null")
        pieces = F.explode(F.sequence(F.lit(0), F.lit(self.facts["pieces"] - 1))).alias("piece")
        return self._nearest(asked, probes).select("query_id", F.col("vector").alias("_q"), "list", pieces)

    def search(self, queries: DataFrame, top: int = 100, probes: int = PROBES) -> DataFrame:
        """query_id, item_id, score and lane_rank as vectors.nearest, of the items in the probed lists.

        Where all lists are probed, no list is told from another: blocks of the stored vectors meet blocks of queries in matrix products.
        """
        if probes >= len(self.centroids.value):
            return vectors.nearest(queries, self.table().select("item_id", "vector"), top)
        pairs = self._probed(queries, probes).join(self.table().hint("merge"), ["list", "piece"])
        score = F.round(F.greatest(F.lit(0.0), maths.clamp(maths.dot(F.col("vector"), F.col("_q")), -1.0, 1.0)), 6)
        scored = pairs.select("query_id", "item_id", score.alias("score"))
        best = W.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
        return scored.withColumn("lane_rank", F.row_number().over(best)).filter(F.col("lane_rank") <= top).withColumn("lane_rank", F.col("lane_rank").cast("long"))

    def visited(self, queries: DataFrame, probes: int = PROBES) -> DataFrame:
        """query_id and how many rows a search with so many probes scores for it."""
        sizes = self.table().groupBy("list", "piece").agg(F.count(F.lit(1)).alias("n"))
        return self._probed(queries, probes).drop("_q").join(sizes, ["list", "piece"]).groupBy("query_id").agg(F.sum("n").alias("n_scored"))

    def probes_for(self, queries: DataFrame, exact: DataFrame, least: float = 0.95) -> int:
        """The fewest probes that find a share of at least least of exact (query_id, item_id, as vectors.nearest gives them for a sample of queries).

        One pass: an item is found by as many probes as the place of its list among the
        query's lists says, so the counts of places, a row for each, decide.
        """
        asked = queries.select("query_id", unit(F.col("vector")).alias("vector")).filter("vector is not null")
        lists = self._nearest(asked, len(self.centroids.value)).select("query_id", "list", "place")
        held = exact.select("query_id", "item_id").join(self.table().select("item_id", "list"), "item_id")
        places = held.join(lists, ["query_id", "list"]).groupBy("place").agg(F.count(F.lit(1)).alias("n")).orderBy("place").collect()
        wanted, found = least * sum(r["n"] for r in places), 0
        for r in places:
            found += r["n"]
            if found >= wanted:
                return r["place"] + 1
        return 1

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        shared.remove(self.spark, self.path)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """query_id and the share of exact's items that found has."""
    met = found.select("query_id", "item_id", F.lit(1).alias("_met"))
    rows = exact.select("query_id", "item_id").join(met, ["query_id", "item_id"], "left")
    return rows.groupBy("query_id").agg((F.count("_met") / F.count(F.lit(1))).alias("recall"))
