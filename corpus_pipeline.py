"""The corpus pipeline: documents to packed training sequences.

Language ID takes out texts in no known language, exact and near duplicates keep one
document each, sources are mixed to their target weights, and the mix is packed into
windows. Each stage is written as Parquet and read again as the next one's documents;
then the tables that it worked with and the stage before it are deleted.

Defined results: a text that is null or has no letter goes in the first stage, so that
later ones meet none; without any label every text with a letter stays. Of equal texts
the row with the largest doc_id stays, of near copies the one with the smallest, null
ids last and one of repeated rows. A null source is a source of its own. Ties are broken
as each operator says. Texts of any length go through whole; the mix and the packing cut
them at words and tokens. An empty table stays empty. All columns of documents, and others
whatever their names, reach the mix; packing returns its own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from reelgrid.llm import common, exact_dedup, language_id, minhash, mixing, packing
from reelgrid.llm.queries import vocabulary


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.recognised(docs)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(docs)


def distinct_by_simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash links (op10's fingerprints and balls) and MinHash ones, for what lies outside a ball, verified on both texts."""
    return minhash.deduplicated(docs, width=5, least=0.8, radius=4)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), end=2)


STAGES = [
    ("language_id", known_languages),
    ("exact_dedup", distinct_texts),
    ("simhash_dedup", distinct_by_simhash),
    ("mixing", mixed_sources),
    ("packing", packed),
]

#: The models and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    folder = f"{common.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        before = common.made()
        made = stage(spark, docs, sf_dir)
        made.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(made.schema).parquet(f"{folder}/{name}")
        common.clear(spark, before)
        common.remove(spark, *[f"{folder}/{n}" for n, _ in STAGES if n != name])
    common._made.append(folder)
    return docs
