"""Resampling documents by importance for a target distribution, with hashed n-grams.

Every run of 1 to n words is a feature, and its crc32 modulo the number of buckets its
bucket. Buckets are counted over all documents and over the target texts; a bucket's
gain is the logarithm of the ratio of its smoothed shares. A document's weight is the
mean gain of its features, and the documents of the highest weight plus Gumbel noise are
a sample without replacement that follows the target. The noise is a hash of the id, so
that reruns draw the same documents.

Features are counted before they are shuffled, so no bucket is hot: at most one row for
each bucket and task. The gains, one row for each bucket, are what is broadcast. Only
ids and numbers are sorted, by ranges.

Defined results: a null text, or one without a word, has no feature and weight 0; a null
id draws its noise as an empty one and comes last among ties; repeated rows are documents
of their own, equal ones in any order; a text of any length is read whole, and bytes that
are no UTF-8 count as U+FFFD; an empty table gives no rows, and without target texts all
counts of the target are 0. Other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BUCKETS = 10_000
#: Words of a document that may be drawn, at least, and the drawn share of such documents in per cent.
LEAST = 20
PERCENT = 10
SEED = 2024


def features(words: str, n: int) -> Column:
    """All runs of 1 to n consecutive words of an array column, joined by a space."""

    def runs(k: int) -> Column:
        run = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - (k - 1), F.lit(1))), lambda i: F.array_join(F.slice(words, i, k), " "))
        return F.when(F.size(words) >= k, run).otherwise(F.array().cast("array<string>"))

    return F.col(words) if n == 1 else F.concat(F.col(words), *[runs(k) for k in range(2, n + 1)])


def bucket(feature: Column, buckets: int) -> Column:
    return (F.crc32(feature.cast("binary")) % buckets).cast("int")


def counts(texts: DataFrame, n: int, buckets: int) -> DataFrame:
    """bucket and n: how many features of all texts it holds."""
    # outer: else the optimiser makes the words of a text once more, to filter out those without
    some = texts.select(common.words(F.col("text")).alias("_words")).select(F.explode_outer(features("_words", n)).alias("_feature"))
    return some.groupBy(bucket(F.col("_feature"), buckets).alias("bucket")).agg(F.count(F.lit(1)).alias("n")).filter("bucket is not null")


def gains(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain: floor(1000 ln) of the target's smoothed share over the documents', for each bucket that documents hold; at most buckets rows."""
    here = common.written(counts(docs, n, buckets).withColumnRenamed("n", "s"), "buckets")
    there = common.written(counts(target, n, buckets).withColumnRenamed("n", "t"), "buckets")
    s, t = (float(x.agg(F.sum(c)).first()[0] or 0) for x, c in ((here, "s"), (there, "t")))
    ratio = (F.coalesce("t", F.lit(0)).cast("double") + 1) * F.lit(s + buckets) / ((F.col("s").cast("double") + 1) * F.lit(t + buckets))
    return here.join(F.broadcast(there), "bucket", "left").select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain"))


def noise(doc_id: Column, seed: int) -> Column:
    """A thousand times a Gumbel variable from a hash of the id, floored."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def scored(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """_row, doc_id, n_words, n_features, weight and score of docs (_row, doc_id, text)."""
    gain = F.broadcast(gains(docs, target, n, buckets))
    rows = docs.select("_row", "doc_id", common.words(F.col("text")).alias("_words"))
    each = rows.select("_row", "doc_id", F.size("_words").alias("n_words"), F.explode_outer(features("_words", n)).alias("_feature"))
    each = each.withColumn("bucket", bucket(F.col("_feature"), buckets)).join(gain, "bucket", "left")
    sums = each.groupBy("_row", "doc_id", "n_words").agg(F.count("_feature").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("_sum"))
    mean = sums.withColumn("weight", F.expr("(_sum - pmod(_sum, greatest(n_features, 1L))) div greatest(n_features, 1L)"))
    return mean.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).drop("_sum")


def drawn(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = BUCKETS, least: int = LEAST, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """scored(docs) with rank: 1, 2, 3... of the documents that are drawn, null of the others."""
    rows = common.written(scored(docs, target, n, buckets, seed), "scores")
    may = rows.filter(F.col("n_words") >= least)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight"), F.asc("_row")]
    placed = common.ranked(may, order, "rank")
    most = may.count() * percent // 100
    placed = placed.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    rest = rows.filter(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long"))
    return placed.unionByName(rest.select(*placed.columns))


def resampled(docs: DataFrame, target: DataFrame, **parameters) -> DataFrame:
    """The documents that are drawn, with their own columns, in the order of their ranks."""
    inner = common.numbered(docs)
    found = drawn(inner.select("_row", "_doc.doc_id", "_doc.text"), target, **parameters).filter("rank is not null")
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return inner.join(found.select("_row", "rank"), "_row").repartitionByRange(parts, "rank").sortWithinPartitions("rank").select("_doc.*")


def report(docs: DataFrame, target: DataFrame, **parameters) -> DataFrame:
    """One row for each document, drawn or not."""
    rows = common.numbered(docs).select("_row", "_doc.doc_id", "_doc.text")
    return drawn(rows, target, **parameters).select("doc_id", "n_features", "weight", "score", "rank")
