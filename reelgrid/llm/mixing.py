"""Mixing sources to target weights by a low-discrepancy schedule of equal blocks.

Each source's documents are shuffled (by a seeded hash) onto a tape, which repeats
and is cut into blocks of equally many words. Slot i of the schedule takes the point
frac(i * golden ratio) through the cumulative shares of the sources' blocks; the rank
of a slot among its source's slots names the block it plays. After any number of
slots every source is within a few blocks of its share, and at the end each source
has given its target to the word, the last block being cut there. The mix itself is
written in the order of its slots, so that any piece of it holds the sources in their
shares.

Nothing is collected but one row for each source. Prefix sums on the tapes and slot
ranks are taken in two levels, so that no source meets in one task.

Defined results: a null or empty text has size 0 and is never taken; null is a source
of its own, after all others; repeated rows are separate documents; with no words or
no rows at all every target is 0; a text longer than a block plays in several slots,
one after the other on its tape. Equal hashes are ordered by doc_id, size and a hash of
the text. Other columns may have any name: `mixed` carries them inside a struct.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
#: Buckets of a tape at least, by the leading bits of the hash (as many as rows in a bucket), and slots of which ranks are counted together.
TAPE_BITS = 12
SLOTS = 1 << 16
GOLDEN = (math.sqrt(5) - 1) / 2


def targets(sizes: list[int], weights: tuple[int, ...], share: Fraction, most: int) -> list[Fraction]:
    """Shares of share * all sizes by weight; none above most times its size, the excess going to the others by weight."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    left, out = share * sum(sizes), [Fraction(0)] * len(sizes)
    free = set(range(len(sizes)))
    while free:
        whole = sum(w[i] for i in free)
        full = {i for i in free if left * w[i] / whole > most * sizes[i]}
        if not full:
            for i in free:
                out[i] = left * w[i] / whole
            break
        for i in full:
            out[i] = Fraction(most * sizes[i])
        left -= sum(out[i] for i in full)
        free -= full
    return out


def schedule(spark, needs: list[int], keys: list[str]) -> DataFrame:
    """_key, rank, slot: the block of its source that each slot plays. needs: blocks of each source."""
    m = sum(needs)
    bounds = np.cumsum(np.array(needs, float)) / max(1, m)
    last = max((i for i, n in enumerate(needs) if n), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.column("id").to_numpy()
            high, low = i >> 24, i & ((1 << 24) - 1)  # exact to 2 ** -28 at any slot
            u = (high * ((1 << 24) * GOLDEN % 1.0) + low * GOLDEN) % 1.0
            s = np.minimum(np.searchsorted(bounds, u, side="right"), last)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(s.astype(np.int64))], names=["slot", "_ordinal"])

    points = spark.range(m).mapInArrow(run, "slot long, _ordinal long")
    points = points.withColumn("_chunk", F.expr(f"slot div {SLOTS}")).withColumn("_one", F.lit(1).cast("long"))
    ranked = common.running_sum(points, ["_ordinal"], "_chunk", ["slot"], "_one", "rank")
    plan = spark.createDataFrame(list(zip(range(len(needs)), keys, needs, strict=True)), "_ordinal long, _key string, _need long")
    # what the points have not reached when the slots end plays after them
    short = points.groupBy("_ordinal").count().join(plan, "_ordinal", "right").select("_ordinal", F.coalesce("count", F.lit(0)).alias("n"), "_need")
    late = short.filter("n < _need").select("_ordinal", F.explode(F.sequence("n", F.col("_need") - 1)).alias("rank"))
    late = late.withColumn("slot", F.lit(m) + F.col("rank") * len(needs) + F.col("_ordinal"))
    both = ranked.select("_ordinal", "rank", "slot").unionByName(late)
    return both.join(plan, "_ordinal").filter("rank < _need").select("_key", "rank", "slot")


def pieces(docs: DataFrame, block: int = 8192, weights: tuple[int, ...] = WEIGHTS, share: Fraction = Fraction(3, 2), most: int = 2, seed: int = 42) -> DataFrame:
    """_row, doc_id, size, source_size, target, and for each piece that the mix takes slot, epoch, first and taken words.

    docs: doc_id, source, text and _row, which tells rows apart. A row that is never
    taken has one piece of no words. Play the mix in the order of slot, epoch, doc_id.
    """
    spark = docs.sparkSession
    key = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source").cast("string")))
    rows = docs.select("_row", "doc_id", key.alias("_key"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("_same"))
    rows = common.written(rows.withColumns({"_hash": F.xxhash64("doc_id", F.lit(seed))}), "tape")
    found = sorted(rows.groupBy("_key").agg(F.sum("size"), F.count(F.lit(1))).collect(), key=lambda r: (r[0] == "n", r[0]))  # a row for each source
    bits = max(TAPE_BITS, math.ceil(math.log2(max(2, *[r[2] for r in found], 2)) / 2))
    wanted = targets([r[1] for r in found], weights, share, most)
    whole = [round(t) for t in wanted]
    facts = spark.createDataFrame([(r[0], r[1], float(t), n) for r, t, n in zip(found, wanted, whole, strict=True)], "_key string, source_size long, target double, _words long")
    slots = schedule(spark, [-(-n // block) for n in whole], [r[0] for r in found])

    rows = rows.withColumn("_bucket", F.shiftrightunsigned("_hash", 64 - bits))
    tape = common.running_sum(rows, ["_key"], "_bucket", ["_hash", "doc_id", "size", "_same"], "size", "_start", facts)
    played = tape.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(most - 1).cast("long"))))
    played = played.withColumn("_from", F.col("_start") + F.col("epoch") * F.col("source_size"))
    played = played.withColumn("_to", F.least(F.col("_from") + F.col("size"), F.col("_words")))
    taken = F.when(F.col("_from") < F.col("_to"), F.sequence(F.expr(f"_from div {block}"), F.expr(f"(_to - 1) div {block}")))
    played = played.withColumn("rank", F.explode_outer(taken)).join(slots, ["_key", "rank"], "left")
    start = F.greatest(F.col("_from"), F.col("rank") * block)
    end = F.least(F.col("_to"), (F.col("rank") + 1) * block)
    is_taken = F.col("slot").isNotNull()
    return played.select(
        "_row", "doc_id", "size", "source_size", "target", "slot", "epoch",
        F.when(is_taken, start - F.col("_from")).alias("first"),
        F.when(is_taken, end - start).otherwise(F.lit(0)).alias("taken"),
    )


def report(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row of docs, its first slot in the mix (null if it is never taken) and its pieces there."""
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "source", "text")
    found = pieces(rows, **parameters)
    same = [F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target")]
    return found.groupBy("_row").agg(*same, F.sum("taken").alias("taken"), F.min("slot").alias("first_slot"), F.count("slot").alias("pieces")).drop("_row")


def mixed(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of docs as often as the mix takes them, with their own columns; a row that the mix takes in part has those words, joined by spaces.

    Rows come in the order of their first slots: each partition holds one stretch of the
    schedule, and the partitions follow each other.
    """
    inner = common.numbered(docs)
    found = pieces(inner.select("_row", "_doc.doc_id", "_doc.source", "_doc.text"), **parameters).filter("taken > 0")
    spans = found.groupBy("_row", "epoch").agg(F.min("first").alias("_first"), F.sum("taken").alias("_taken"), F.first("size").alias("_size"), F.min("slot").alias("_slot"))
    spans = common.written(spans, "spans")
    slots = (spans.agg(F.max("_slot")).first()[0] or 0) + 1
    parts = min(max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), slots)
    part = F.array_join(F.slice(F.regexp_extract_all("_doc.text", F.lit(WORD), 0), (F.col("_first") + 1).cast("int"), F.col("_taken").cast("int")), " ")
    text = F.when(F.col("_taken") < F.col("_size"), part).otherwise(F.col("_doc.text"))
    rows = inner.join(spans, "_row").withColumn("_text", text)
    played = rows.repartitionById(parts, F.expr(f"cast(_slot * {parts} div {slots} as int)")).sortWithinPartitions("_slot", "epoch", "_doc.doc_id", "_row")
    return played.select(*[F.col("_text").alias(c) if c == "text" else F.col("_doc").getField(c).alias(c) for c in docs.columns])
