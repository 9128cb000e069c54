"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A pair of fingerprints within radius 2r has a value in its middle that is within r
of both, so every distinct fingerprint emits all values within r (half the radius)
and fingerprints meet on common values. Values are dealt over 2^h buckets by h
parities, each over a disjoint set of bits: a flipped bit flips one parity, so a
fingerprint is sent once to each of the 1 + h + h(h-1)/2 buckets that hold values of
its ball, and the bucket expands its own share of the ball there. That shuffles a few
dozen longs for a fingerprint instead of its 2,081 variants, and deals even a dense
cluster evenly. All fingerprints that meet on one value are within the radius of each
other, so a star to the smallest of them, verified, keeps every connection with a
linear number of edges. Components come from alternating star contractions.

Defined results: null and empty texts have fingerprint zero; a text with fewer words
than a shingle has its whole word sequence as its only shingle; equal fingerprints
are linked; a null doc_id is ignored in the smallest id of its component (which is
null if it has no other). Texts of any length are read
whole, and bytes that are no UTF-8 as they are; repeated rows are rows of their own; an empty
table gives no rows; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType

from . import common

BITS = 64
#: Values that a bucket holds on average, and those that a pass in a bucket sorts at once.
BUCKET_VALUES = 1 << 19
#: Shingles whose bits are counted at once.
BLOCK = 1 << 12


def fingerprint(raw: bytes, width: int) -> int:
    """64-bit SimHash of a UTF-8 text's word shingles, repeats included."""
    import xxhash

    words = raw.lower().split()  # bytes: A-Z and ASCII white space only
    n = max(1, len(words) - width + 1)
    if not words:
        return 0
    total = np.zeros(BITS, np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for at in range(0, n, BLOCK):
        h = np.fromiter((digest(join(words[i : i + width]), 42) for i in range(at, min(n, at + BLOCK))), np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * total > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(spark: SparkSession, width: int) -> Callable[[Column], Column]:
    """A column function: the bits of a text's fingerprint as a long."""
    common.bounded_batches(spark)

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for some in texts:
            yield pa.array(np.array([fingerprint(x, width) for x in some.to_pylist()], np.uint64).view(np.int64))

    udf = F.arrow_udf(run, "long", ArrowUDFType.SCALAR_ITER)
    return lambda text: udf(common.utf8(text))


def ball(radius: int) -> np.ndarray:
    """XOR masks of all sets of at most radius bits."""
    return np.array([sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(BITS), r)], np.uint64)


def parities(values: np.ndarray, h: int) -> np.ndarray:
    """The bucket of each value: parity j covers the bits that are j modulo h."""
    out = np.zeros(values.shape, np.int64)
    for j in range(h):
        x = values & np.uint64(sum(1 << i for i in range(j, BITS, h)))
        out |= (np.bitwise_count(x).astype(np.int64) & 1) << j
    return out


def stars(fps: np.ndarray, bucket: int, masks: np.ndarray, mask_bucket: np.ndarray, h: int, radius: int) -> np.ndarray:
    """Edges (fingerprint, smallest fingerprint it meets on a value of this bucket).

    Of two that meet one has the value in its ball of half the radius, rounded down; that one can be a star's centre.
    """
    far = np.bitwise_count(masks) > radius // 2
    fps = np.unique(fps)
    wanted = parities(fps, h) ^ bucket  # the masks' bucket that leads here
    order = np.argsort(mask_bucket, kind="stable")
    low, high = (np.searchsorted(mask_bucket[order], wanted, side=s) for s in ("left", "right"))
    made = high - low
    passes = int(-(-int(made.sum()) // (4 * BUCKET_VALUES)))
    edges = []
    for k in range(max(1, passes)):  # a crowded bucket sorts one residue of its values at a time
        values, owners, outer = [], [], []
        for at in range(0, len(fps), 1 << 15):
            some = slice(at, at + (1 << 15))
            n = made[some]
            rows = np.repeat(np.arange(at, at + len(n)), n)
            nth = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[some], n)
            v, o = fps[rows] ^ masks[order[nth]], far[order[nth]]
            if passes > 1:
                own = (v * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(passes) == np.uint64(k)
                v, rows, o = v[own], rows[own], o[own]
            values.append(v)
            owners.append(rows.astype(np.int32))
            outer.append(o)
        v, rows, o = np.concatenate(values), np.concatenate(owners), np.concatenate(outer)
        # owners ascend, so the first of a value is its smallest fingerprint, of those near it if there are others
        by = np.lexsort((o, v)) if radius % 2 else np.argsort(v, kind="stable")
        v, rows, o = v[by], rows[by], o[by]
        first = np.ones(len(v), bool)
        first[1:] = v[1:] != v[:-1]
        centre = np.maximum.accumulate(np.where(first, np.arange(len(v)), 0))
        hub = rows[centre]
        met = (hub != rows) & ~o[centre]
        edges.append(np.unique(rows[met].astype(np.int64) * len(fps) + hub[met]))
    e = np.unique(np.concatenate(edges)) if edges else np.zeros(0, np.int64)
    a, b = fps[e // max(1, len(fps))], fps[e % max(1, len(fps))]
    near = np.bitwise_count(a ^ b) <= radius
    return np.stack([a[near], b[near]])


def edges(fps: DataFrame, radius: int) -> DataFrame:
    """Distinct edges a, b (a star for each meeting value) between the distinct fingerprints in fps."""
    spark = fps.sparkSession
    masks = ball((radius + 1) // 2)
    n = fps.count()
    h = int(np.clip(np.ceil(np.log2(max(1, n * len(masks) / BUCKET_VALUES))), 5, 32))
    mask_bucket = parities(masks, h)
    reached = np.unique(mask_bucket)
    own = F.lit(0).cast("long")
    for j in range(h):
        bits = sum(1 << i for i in range(j, BITS, h))
        own = own.bitwiseOR(F.shiftleft(F.bit_count(F.col("fp").bitwiseAND(F.lit(bits - (1 << BITS) if bits >> 63 else bits))).cast("long").bitwiseAND(F.lit(1)), j))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    sent = fps.repartition(parts).select(F.explode(F.transform(F.array(*[F.lit(int(x)) for x in reached]), lambda m: own.bitwiseXOR(m))).alias("bucket"), "fp")

    def run(key, rows):
        a, b = stars(rows.column("fp").to_numpy().view(np.uint64), key[0].as_py(), masks, mask_bucket, h, radius)
        common.give_back()
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return sent.repartition(max(parts, min(1 << h, 4 * parts)), "bucket").groupBy("bucket").applyInArrow(run, "a long, b long").distinct()


def settled(e: DataFrame) -> bool:
    """Whether the edges (u above v) are stars: no u has two v, and no v is a u."""
    heads = e.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
    return not heads.filter("n > 1").take(1) and not e.join(heads.select(F.col("u").alias("v")), "v", "left_semi").take(1)


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (smallest node reachable) of every node in links (a, b), by alternating large and small stars."""
    e = common.written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    for _ in range(rounds):
        if settled(e):
            break
        # large star: each neighbour above a node is linked to the node's smallest neighbour
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: a node and its smaller neighbours are linked to the smallest of them
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        e = common.written(small.unionByName(lower.select("u", F.col("m").alias("v"))).distinct(), "links")
    else:
        raise RuntimeError(f"components have not settled in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def near_duplicates(docs: DataFrame, width: int, radius: int) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable over links) of each row."""
    rows = common.written(docs.select("doc_id", fingerprints(docs.sparkSession, width)(F.col("text")).alias("fp")), "fingerprints")
    return common.spread_join(rows, labels(rows, radius), "fp", "n", "doc_id").select("doc_id", "fp", "component_id")


def labels(rows: DataFrame, radius: int) -> DataFrame:
    """fp, n (its rows), component_id (smallest doc_id in its component) and component of the distinct fingerprints in rows (doc_id, fp); written."""
    ids = common.written(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "ids")
    linked = components(edges(ids.select("fp"), radius))
    label = common.written(ids.join(linked, ids.fp == linked.node, "left").select("fp", "least", "n", F.coalesce("component", "fp").alias("component")), "label")
    least = common.written(label.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("_fps")), "least")
    found = common.spread_join(label, least, "component", "_fps", "fp")
    return common.written(found.select("fp", "n", "component_id", "component"), "labels")


def deduplicated(docs: DataFrame, width: int, radius: int) -> DataFrame:
    """Of each component the row of docs with the smallest doc_id (null last; one of repeated rows), with its own columns."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", fingerprints(docs.sparkSession, width)(F.col("text")).alias("fp"), whole.alias("_doc"))
    rows = common.written(rows, "near")
    light = rows.select("_row", "doc_id", "fp")
    placed = common.spread_join(light, labels(light, radius), "fp", "n", "_row")
    first = placed.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))["_row"].alias("_row"))
    return rows.join(first.select("_row"), "_row", "left_semi").select("_doc.*")


def stars_of(rows: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
    """Pairs a < b of _row in rows (_row, fp) that hold every component of linked fingerprints together, and key and _row of the stars that those come from.

    The pairs: copies of a fingerprint to its smallest row, and the smallest rows along its links. Any two rows with
    linked fingerprints share a star: that of the smallest fingerprint which they meet on a value.
    """
    ids = common.written(rows.groupBy("fp").agg(F.min("_row").alias("first"), F.count(F.lit(1)).alias("n")), "ids")
    placed = common.written(common.spread_join(rows, ids, "fp", "n", "_row").select("_row", "fp", "first"), "placed")
    copies = placed.filter("_row > first").select(F.col("first").alias("a"), F.col("_row").alias("b"))
    found = common.written(edges(ids.select("fp"), radius), "edges")
    of = lambda c: ids.select(F.col("fp").alias(c), F.col("first").alias(f"row_{c}"))
    met = found.join(of("a"), "a").join(of("b"), "b")
    pairs = copies.unionByName(met.select(F.least("row_a", "row_b").alias("a"), F.greatest("row_a", "row_b").alias("b")))
    hubs = found.select(F.col("b").alias("key")).unionByName(ids.filter("n > 1").select(F.col("fp").alias("key"))).distinct()
    reach = hubs.select("key", F.col("key").alias("fp")).unionByName(found.select(F.col("b").alias("key"), F.col("a").alias("fp")))
    around = common.written(reach.join(ids.select("fp", "n"), "fp").select("key", "fp", "n"), "around")
    return pairs, around.join(placed, "fp").select("key", "_row")


def report(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    found = near_duplicates(docs, width, radius)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
