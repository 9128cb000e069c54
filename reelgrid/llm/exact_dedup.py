"""Exact deduplication against a persistent index of digests.

The index is a table bucketed and sorted by digest. A batch of new documents is
reduced to one keeper for each digest (map-side first), sort-merge anti-joined
with the index on its bucketing, and what is new is appended. Every text is read and
hashed once; after that only digests, ids and row numbers are shuffled, never texts.

Defined results: a null text counts as the empty text; of equal texts in one
batch the row with the largest doc_id stays (null ids come last), and of repeated rows
with that id one; a text that an earlier batch brought in stays with that batch's row.
Ids have the type that the index was made for. An empty table gives no rows; a text's
length doesn't matter; other columns pass untouched, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


def digests(docs: DataFrame, *kept: str) -> DataFrame:
    """_row, doc_id, _digest and the columns in kept of docs' rows; written, so that row numbers stay."""
    digest = F.unhex(F.sha2(common.utf8(F.col("text")), 256)).alias("_digest")
    return common.written(docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", digest, *kept), "digests")


class DigestIndex:
    """digest, keep_id, keep_row (its number in its batch), group_size and batch, bucketed and sorted by digest in the shared folder.

    An index without a name is its maker's alone: common.clear() drops it.
    """

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int = 0, id_type: str = "long") -> None:
        self.spark = spark
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        self.buckets = buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.schema = f"digest binary, keep_id {id_type}, keep_row long, group_size long, batch int"
        self.path = f"{common.shared_dir(spark)}/{self.name}"
        if not name:
            common._tables.append(self.name)
            common._made.append(self.path)

    def table(self) -> DataFrame:
        """The index; an empty one is made where there is none yet."""
        if not self.spark.catalog.tableExists(self.name):
            self._append(common.empty(self.spark, self.schema))
        return self.spark.table(self.name)

    def _append(self, rows: DataFrame) -> None:
        rows.write.mode("append").bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.path).saveAsTable(self.name)

    def add(self, rows: DataFrame, batch: int = 0) -> DataFrame:
        """Append those of digests(docs) that the index doesn't have; return the index.

        The batch is reduced to its digests first, in a table of its own: otherwise the
        optimiser moves the anti-join below the aggregation, and every copy of a hot text is
        shuffled. The index itself is not shuffled again.
        """
        known = self.table()
        first = F.max(F.struct("doc_id", "_row"))
        new = rows.groupBy("_digest").agg(first.alias("_keeper"), F.count(F.lit(1)).alias("group_size"))
        keep_id = F.col("_keeper.doc_id").cast(known.schema["keep_id"].dataType).alias("keep_id")
        new = new.select(F.col("_digest").alias("digest"), keep_id, F.col("_keeper._row").alias("keep_row"), "group_size", F.lit(batch).alias("batch"))
        new = common.written(new, "batch")
        fresh = new.join(known.select("digest").hint("merge"), "digest", "left_anti")
        self._append(fresh.repartition(self.buckets, "digest"))
        self.spark.catalog.refreshTable(self.name)
        return self.table()


def decide(rows: DataFrame, index: DigestIndex, batch: int = 0) -> DataFrame:
    """digests(docs) with keep_id, group_size and kept, by the index, which has them. Hot digests are dealt over tasks."""
    facts = index.table().select(F.col("digest").alias("_digest"), "keep_id", "group_size", F.col("batch").alias("_batch"), F.col("keep_row").alias("_keep_row"))
    joined = common.spread_join(rows, facts, "_digest", "group_size", "doc_id")
    return joined.withColumn("kept", (F.col("_batch") == batch) & (F.col("_row") == F.col("_keep_row"))).drop("_batch", "_keep_row")


def index_for(docs: DataFrame) -> DigestIndex:
    return DigestIndex(docs.sparkSession, id_type=docs.schema["doc_id"].dataType.simpleString())


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with their own columns, through a fresh index."""
    inner, index = common.numbered(docs), index_for(docs)
    rows = digests(inner.select(F.col("_row").alias("_place"), "_doc.doc_id", "_doc.text"), "_place")
    index.add(rows)
    gone = common.written(decide(rows, index).filter("not kept").select(F.col("_place").alias("_row")), "gone")
    return common.without(inner, gone).select("_doc.*")


def report(docs: DataFrame) -> DataFrame:
    """One row for each document, dropped ones too."""
    rows, index = digests(docs), index_for(docs)
    index.add(rows)
    return decide(rows, index).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("_digest")).alias("text_sha256"))
