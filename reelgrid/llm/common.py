"""Helpers that the corpus operators share."""

from __future__ import annotations

import contextlib
import ctypes
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import ArrowUDFType

from reelgrid.sources.shared import remove, shared_dir

#: Documents in an Arrow batch and bytes in one, so that a Python worker holds a bounded piece of a partition.
BATCH_ROWS = 256
BATCH_BYTES = 8 << 20
#: Rows of a row group, where rows are up to a megabyte each.
WIDE_ROWS = 16
#: Rows of one key up to which it is not dealt over tasks.
SPREAD_ROWS = 4096
#: Bits of the filter that says which rows need to meet others at all.
FILTER = 1 << 25
#: Capitals, and the ASCII characters that part words.
_CAPITALS = "".join(map(chr, range(65, 91)))
_GAPS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, wide: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, and a lost executor loses none of it.

    wide: its rows are large, so that a reader, which holds thousands of rows of a row group at once, gets groups of a few.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    to = df.write.options(**{"parquet.block.row.count.limit": WIDE_ROWS, "parquet.page.size.row.check.min": WIDE_ROWS}) if wide else df.write
    to.parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame) -> DataFrame:
    """docs as _doc, a struct of its columns, with _row, which tells rows apart and is the same whenever the result is read.

    Rows of files have their place there; any other docs is written first.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation" and "_metadata" not in docs.columns:
        with contextlib.suppress(AnalysisException):  # not a relation of files
            found = docs.select(F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")).alias("_row"), whole)
            found.schema  # noqa: B018
            return found
    return written(docs.select(F.monotonically_increasing_id().alias("_row"), whole), "rows")


def spread_join(rows: DataFrame, facts: DataFrame, key: str, n: str, by: str, how: str = "inner") -> DataFrame:
    """rows with the columns of facts, which has one row for each key, with n: how many rows have it.

    A key with more rows than a partition has on average is dealt over salts, by the
    column by and the split, on both sides; there are at most as many such keys as
    partitions, which bounds what is broadcast. facts is read three times.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    most = max(SPREAD_ROWS, -(-int(facts.agg(F.sum(n)).first()[0] or 0) // parts))
    pieces = F.ceil(F.col(n) / most).cast("int")
    hot = facts.filter(F.col(n) > most).select(key, pieces.alias("_pieces"))
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("_salt", F.pmod(F.xxhash64(by, F.spark_partition_id()), F.coalesce("_pieces", F.lit(1))).cast("int")).drop("_pieces")
    copies = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(pieces, F.lit(1)) - 1)))
    return dealt.join(copies, [key, "_salt"], how).drop("_salt")


def among(ids: DataFrame) -> Callable[[Column], Column]:
    """A column function: whether a value may be one of those in ids (_row); false only if it is none.

    The hashed bits of ids are a table of at most FILTER / 64 words, whatever ids holds.
    """
    bit = lambda x: F.pmod(F.xxhash64(x), F.lit(FILTER))
    word = ids.select(bit(F.col("_row")).alias("bit")).groupBy(F.expr("bit div 64").cast("int").alias("word"))
    words = np.zeros(FILTER // 64, np.uint64)
    set_ = word.agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("bits")).toArrow()
    words[set_.column("word").to_numpy()] = set_.column("bits").to_numpy().view(np.uint64)
    shared = ids.sparkSession.sparkContext.broadcast(words)

    def run(bits: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for some in bits:
            at = some.to_numpy().astype(np.uint64)
            yield pa.array((shared.value[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)) == 1)

    udf = F.arrow_udf(run, "boolean", ArrowUDFType.SCALAR_ITER)
    return lambda row: udf(bit(row))


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows whose _row is none of those in gone, a written table. Rows that the filter passes over aren't shuffled."""
    split = rows.withColumn("_met", among(gone)(F.col("_row")))
    kept = split.filter("_met").join(gone, "_row", "left_anti")
    return split.filter("not _met").unionByName(kept.select(*split.columns)).drop("_met")


_made: list[str] = []
_tables: list[str] = []


def made() -> tuple[int, int]:
    """A mark for clear(): what has been written until now."""
    return len(_made), len(_tables)


def clear(spark: SparkSession, since: tuple[int, int] = (0, 0)) -> None:
    """Delete the tables that written() has made (since a mark) and the indexes without a name of their own: for when the results that read them have been stored."""
    while len(_tables) > since[1]:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop()}")
    remove(spark, *_made[since[0] :])
    del _made[since[0] :]


def bounded_batches(spark: SparkSession) -> None:
    """Few documents in an Arrow batch: whole texts may be long.

    The session keeps these two options, because a plan reads them when it runs and not when it is made.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def chunks(batches: Iterator[pa.RecordBatch], size: int, column: str = "text") -> Iterator[pa.Array]:
    """The column of some batches in pieces of size bytes or somewhat more."""
    for t in tables(batches, size):
        yield t.column(column).combine_chunks()


def tables(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """The batches, united to size bytes or somewhat more."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.nbytes for x in held) >= size:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def gathered_splits(docs: DataFrame, part: int) -> DataFrame:
    """docs in at most so many splits that one has part bytes of text on average."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return docs.coalesce(max(1, int(size // part)))


def utf8(text) -> F.Column:
    """The text's bytes; null counts as the empty text."""
    return F.coalesce(text.cast("string"), F.lit("")).cast("binary")


def words(text: Column) -> Column:
    """The text's runs of letters and digits, A-Z in lower case; every character beyond ASCII belongs to a word. Null has none."""
    plain = F.translate(text.cast("string"), _CAPITALS + _GAPS, _CAPITALS.lower() + " " * len(_GAPS))
    return F.array_remove(F.split(F.coalesce(plain, F.lit("")), " "), "")


def ranked(rows: DataFrame, order: list[Column], out: str) -> DataFrame:
    """rows, written, with out: 1, 2, 3... in an order that knows no ties.

    Ranges of the order are sorted each by itself; a row's rank is its place in its
    range and the sizes of the ranges before, one number for each partition.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = written(placed.select("*", F.spark_partition_id().alias("_part"), at.alias("_at")), "ranges")
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_base", F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).drop("_n")
    return placed.join(F.broadcast(before), "_part").withColumn(out, F.col("_base") + F.col("_at") + 1).drop("_part", "_at", "_base")


def single_thread() -> None:
    """A task has one core: libraries with thread pools of their own keep to it."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("OMP_NUM_THREADS", "1")


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], T._parse_datatype_string(schema))


def give_back() -> None:
    """Return freed memory to the system: a worker that keeps the peak of one task takes it from the next."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def running_sum(df: DataFrame, key: list[str], bucket: str, order: list, value: str, out: str, more: DataFrame | None = None) -> DataFrame:
    """df with out: the sum of value over a key's rows before this one, by bucket and then by order.

    Two levels keep a hot key from one task: sums of (key, bucket) first, running over the few
    buckets of a key; then a running sum inside each (key, bucket). more: a row for each key,
    whose columns come along with the buckets' sums.
    """
    sums = df.groupBy(*key, bucket).agg(F.sum(value).alias("_sum"))
    before = W.partitionBy(*key).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    if more is not None:
        sums = sums.join(more, key)
    inside = W.partitionBy(*key, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = df.withColumn("_inside", F.sum(value).over(inside) - F.col(value))
    return rows.join(sums, [*key, bucket]).withColumn(out, F.col("_inside") + F.col("_base")).drop("_inside", "_base")
