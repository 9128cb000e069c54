"""Hard negatives of embeddings: exact search over k-means inverted lists.

Every vector lies in the list of its nearest centroid; a list keeps its centroid c and
its radius r, the largest distance of a member from c. For a query q no member x of the
list scores more than q.c + |q| r nor less than q.c - |q| r (Cauchy-Schwarz). A search
leaves out lists whose bounds lie outside the window of scores it asks for, and visits
the others by falling upper bound, in rounds of more and more lists, until the bound is
strictly below its k-th score. So results are exact, whatever the centroids.

Centroids are fitted on a bounded sample (SAMPLE rows, those with the smallest hashes),
at most LISTS of them; they and their radii are what tasks get as a whole. Lists are
stored in pieces of about PIECE vectors, dealt by hashes, so that a list with a third of
all vectors is many pieces. Queries travel in blocks of those that lie near each other:
a block meets a piece in one matrix product, and only the best k of a query leave it.

Defined results: rows with a null label, a null vector, or a component that is null or
not finite take no part; components are floored after scaling and beyond +-2^28 count as
that bound, so that a score of vectors of up to 127 components is a long; of vectors of
different lengths the shorter one is filled with zeros; a null id is no anchor and comes
last among ties; rows with equal ids are different rows, in any order among ties; an
empty table gives no rows. Other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Rows that centroids are fitted on, rounds of that, and centroids at most.
SAMPLE = 20_000
FITS = 8
LISTS = 1024
#: Vectors in a piece of a list (stored together), and queries in a block.
PIECE = 2048
BLOCK = 512
#: Lists that the first round visits, and how many times as many each round has seen than the one before.
FIRST, MORE = 4, 8
#: Components are whole numbers of at most so much.
MOST = 1 << 28
#: Sums below this are exact in doubles, and hold a place in a piece beside the score.
EXACT = 1 << 50
#: What the order of places multiplies; a piece has fewer rows.
PLACES = 1 << 12
NONE = np.iinfo(np.int64).min
FOUND = "qid long, id long, row long, score long"


@dataclass
class Index:
    """pieces: list, piece, n, dim and the packed rows, ids (with has_id), labels and vectors; facts: a list's number of pieces."""

    pieces: DataFrame
    facts: DataFrame
    centroids: Broadcast
    dim: int


def vectors(rows: DataFrame, scale: float = 256.0) -> DataFrame:
    """_row, id, label and v (whole numbers) of the rows of embeddings that take part; written."""
    x = F.col("embedding")
    sound = F.col("label").isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(x, lambda c: F.floor(F.greatest(F.least(F.lit(scale) * c.cast("double"), F.lit(float(MOST))), F.lit(-float(MOST)))).cast("int"))
    return common.written(rows.filter(sound).select(F.monotonically_increasing_id().alias("_row"), F.col("vec_id").alias("id"), "label", whole.alias("v")), "vectors")


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The rows of a list column as float64, filled with zeros to dim."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(sizes) and (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(sizes), dim))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x its nearest centroid and the distance from it."""
    at = np.argmin((centroids * centroids).sum(1) - 2 * (x @ centroids.T), axis=1)
    return at, np.sqrt(((x - centroids[at]) ** 2).sum(1))


def fitted(x: np.ndarray, lists: int, seed: int) -> np.ndarray:
    """Centroids of some rows by Lloyd's rounds from random rows; one that no row is nearest to stays where it was."""
    unlike = np.unique(x, axis=0)
    c = unlike[np.random.default_rng(seed).permutation(len(unlike))[:lists]]
    for _ in range(FITS):
        at, _ = nearest(x, c)
        n = np.bincount(at, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def indexed(rows: DataFrame, lists: int = LISTS, sample: int = SAMPLE, seed: int = 42) -> Index | None:
    """The inverted lists of vectors(rows); None of no rows."""
    spark = rows.sparkSession
    n, dim = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not n:
        return None
    dim = max(1, dim)
    share = min(1.0, sample / n)
    some = rows.filter(F.pmod(F.xxhash64("_row", F.lit(seed)), F.lit(1 << 40)) < int(share * (1 << 40))).select("v").toArrow()
    drawn = matrix(some.column("v").combine_chunks(), dim) if len(some) else np.zeros((1, dim))
    shared = spark.sparkContext.broadcast(fitted(drawn, min(lists, max(1, math.isqrt(n))), seed))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, far = nearest(matrix(b.column("v"), dim), shared.value)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at.astype(np.int32)), pa.array(far)], names=[*b.schema.names, "list", "far"])

    placed = common.written(rows.mapInArrow(assign, "_row long, id long, label long, v array<int>, list int, far double"), "assigned")
    facts = placed.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius"))  # a row for each list
    facts = common.written(facts.withColumn("pieces", F.ceil(F.col("n") / PIECE).cast("int")), "lists")
    radius = np.full(len(shared.value), -np.inf)  # a list without members is never visited
    for r in facts.collect():
        radius[r["list"]] = r["radius"]
    piece = F.pmod(F.xxhash64("_row"), F.col("pieces")).cast("int").alias("piece")
    dealt = placed.join(F.broadcast(facts.select("list", "pieces")), "list").select("list", piece, "_row", "id", "label", "v")
    dealt = dealt.repartition("list", "piece").sortWithinPartitions("list", "piece", F.asc_nulls_last("id"), "_row")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(common.BATCH_BYTES))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def emit() -> Iterator[pa.RecordBatch]:
            t = pa.concat_tables(held).combine_chunks()
            for at in range(0, len(t), PLACES - 1):  # once, unless hashes were unlucky
                yield pack(t.slice(at, PLACES - 1))

        def pack(t: pa.Table) -> pa.RecordBatch:
            ids = t.column("id").combine_chunks()
            x = matrix(t.column("v").combine_chunks(), dim).astype(np.int32)
            raw = [t.column("_row").to_numpy(), ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), t.column("label").to_numpy(), x]
            row = [[t.column("list")[0].as_py()], [t.column("piece")[0].as_py()], [len(t)], *[[r.tobytes()] for r in raw]]
            kinds = [pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(row, kinds, strict=True)], names=["list", "piece", "n", "rows", "ids", "known", "labels", "vectors"])

        for b in batches:
            key = np.stack([b.column("list").to_numpy(), b.column("piece").to_numpy()])
            cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1), b.num_rows]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if j > i:
                    part = pa.Table.from_batches([b.slice(i, j - i)])
                    if held and (held[0].column("list")[0], held[0].column("piece")[0]) != (part.column("list")[0], part.column("piece")[0]):
                        yield from emit()
                        held = []
                    held.append(part)
        if held:
            yield from emit()

    made = dealt.mapInArrow(packed, "list int, piece int, n int, rows binary, ids binary, known binary, labels binary, vectors binary")
    return Index(common.written(made, "pieces", wide=True), facts.select("list", "pieces"), spark.sparkContext.broadcast((shared.value, radius)), dim)


def best(q: np.ndarray, members: np.ndarray, may: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best members of each query in its window among those it may have, earlier ones first of equals: query, member, score."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(members).max(initial=0)) * q.shape[1]
    s = (q @ members.T).astype(np.int64) if top < EXACT else q.astype(np.int64) @ members.astype(np.int64).T
    may = may & (s >= low[:, None]) & (s <= high[:, None])
    if top < EXACT:
        key = np.where(may, s * PLACES + (PLACES - 1 - np.arange(len(members))), NONE)
        if len(members) > k:
            key = -np.partition(-np.where(key == NONE, NONE + 1, key), k - 1, axis=1)[:, :k]
            key = np.where(key == NONE + 1, NONE, key)
        at, _ = np.nonzero(key != NONE)
        found = key[key != NONE]
        return at, PLACES - 1 - found % PLACES, found // PLACES
    each = [w[np.argsort(-x[w], kind="stable")][:k] for x, w in zip(s, map(np.flatnonzero, may), strict=True)]
    at, m = np.repeat(np.arange(len(q)), [len(w) for w in each]), np.concatenate([np.empty(0, np.int64), *each])
    return at, m, s[at, m]


def search(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """qid, place (from 1), id, row and score of the k best members of each query, by falling score, then by id.

    queries: qid, row (its own, which it never finds), label, same (members of its label
    or of others), low and high (bounds of scores), home (its list) and v.
    """
    spark, dim, shared, most = queries.sparkSession, index.dim, index.centroids, len(index.centroids.value[0])
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(common.BATCH_BYTES))
    near = common.written(queries.repartitionByRange("home", "qid").sortWithinPartitions("home", "qid"), "queries")
    state = common.empty(spark, FOUND)
    names = ["qid", "row", "label", "same", "low", "high", "v"]

    def visits(first: int, last: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centroids, radius = shared.value
            for b in (whole.slice(at, BLOCK) for whole in batches for at in range(0, whole.num_rows, BLOCK)):
                q = matrix(b.column("v"), dim)
                dots, reach = q @ centroids.T, np.sqrt((q * q).sum(1))[:, None] * np.where(np.isfinite(radius), radius, 0)
                slack = 1e-9 * (1 + np.abs(dots) + reach)  # of the doubles themselves
                up, down = dots + reach + slack, dots - reach - slack
                low, high = (b.column(c).to_numpy()[:, None] for c in ("low", "high"))
                up = np.where(np.isfinite(radius) & (up >= low) & (down <= high), up, -np.inf)
                place = np.argsort(np.argsort(-up, axis=1, kind="stable"), axis=1)
                least = b.column("least").fill_null(NONE).to_numpy()[:, None]
                wanted = (place >= first) & (place < last) & (up >= least) & (up > -np.inf)
                fixed = [b.column(c).to_numpy(zero_copy_only=False) for c in names[:-1]]
                for at in np.flatnonzero(wanted.any(0)):
                    who = np.flatnonzero(wanted[:, at])
                    raw = [*[x[who].tobytes() for x in fixed], q[who].astype(np.int32).tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), *[pa.array([r], pa.binary()) for r in raw]], names=["list", *names])

        return run

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.to_pylist():
                qid, row, label, low, high = (np.frombuffer(x[c], np.int64) for c in ("qid", "row", "label", "low", "high"))
                same, q = np.frombuffer(x["same"], bool), np.frombuffer(x["v"], np.int32).reshape(-1, dim).astype(np.float64)
                rows, ids, labels = (np.frombuffer(x[c], np.int64) for c in ("rows", "ids", "labels"))
                known = np.frombuffer(x["known"], bool)
                members = np.frombuffer(x["vectors"], np.int32).reshape(-1, dim).astype(np.float64)
                may = ((labels == label[:, None]) == same[:, None]) & (rows != row[:, None])
                at, m, score = best(q, members, may, low, high, k)
                yield pa.RecordBatch.from_arrays([pa.array(qid[at]), pa.array(ids[m], mask=~known[m]), pa.array(rows[m]), pa.array(score)], names=["qid", "id", "row", "score"])

    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("row")]
    place = F.row_number().over(common.W.partitionBy("qid").orderBy(*order)).alias("place")
    first, last = 0, FIRST
    while first < most:
        kth = state.groupBy("qid").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k).select("qid", "least")
        # a query keeps its place beside those near it: no shuffle of vectors
        asked = near.join(kth, "qid", "left") if first else near.withColumn("least", F.lit(None).cast("long"))
        blocks = asked.mapInArrow(visits(first, last), "list int, " + ", ".join(f"{c} binary" for c in names))
        blocks = common.written(blocks, "visits", wide=True)
        if blocks.isEmpty():
            break
        sent = blocks.join(F.broadcast(index.facts), "list").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces")
        met = sent.join(index.pieces.hint("merge"), ["list", "piece"])
        found = met.drop("list", "piece", "n").mapInArrow(scan, FOUND)
        both = found if not first else state.unionByName(found)
        state = common.written(both.select("*", place).filter(F.col("place") <= k).drop("place"), "found")
        first, last = last, last * MORE
    return state.select("*", place)


def mined(rows: DataFrame, anchors: DataFrame, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """Hard negatives of anchors (of vectors() rows) among all rows, as report() says."""
    spark, index = rows.sparkSession, indexed(rows)
    if index is None:
        return common.empty(spark, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    dim, shared = index.dim, index.centroids

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, _ = nearest(matrix(b.column("v"), dim), shared.value[0])
            yield b.append_column("home", pa.array(at.astype(np.int32)))

    asked = anchors.select(F.col("_row").alias("row"), F.col("id").alias("anchor_id"), F.col("label").cast("long").alias("label"), "v")
    asked = common.written(asked.mapInArrow(home, "row long, anchor_id long, label long, v array<int>, home int"), "anchors")
    whole = [F.lit(NONE + 1).alias("low"), F.lit(-(NONE + 1)).alias("high")]
    like = search(index, asked.select(F.col("row").alias("qid"), "row", "label", F.lit(True).alias("same"), *whole, "home", "v"), positives)
    like = common.written(like.select(F.col("qid").alias("row"), F.col("place").alias("nth"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # whole scores within per cent of the positive's: the lower bound rounded up, the upper one down
    rest = F.pmod("positive_score", F.lit(100))  # per cents are taken of hundreds and of the rest, so that none overflows
    hundreds = F.expr("(positive_score - pmod(positive_score, 100L)) div 100L")
    least, most = hundreds * low + F.ceil(rest * low / 100), hundreds * high + F.floor(rest * high / 100)
    windows = like.withColumns({"low": least, "high": most}).filter("low <= high").join(asked, "row")
    windows = windows.withColumn("qid", F.col("row") * positives + F.col("nth") - 1)
    unlike = search(index, windows.select("qid", "row", "label", F.lit(False).alias("same"), "low", "high", "home", "v"), negatives)
    pairs = windows.select("qid", "anchor_id", "positive_id", "positive_score")
    return unlike.join(pairs, "qid").select("anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def report(embeddings: DataFrame, every: int = 100, noisy: int = 7, labels: int = 10, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """The first rows of other labels that score from low to high per cent of each positive of each anchor.

    Where the id is divisible by noisy, the label is first moved on by one, modulo labels.
    Anchors are the rows whose id is divisible by every; their positives are the first
    rows of the same label.
    """
    moved = F.when(F.col("vec_id") % noisy == 0, (F.col("label").cast("long") + 1) % labels).otherwise(F.col("label").cast("long"))
    rows = vectors(embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), moved.alias("label"), "embedding"))
    return mined(rows, rows.filter(F.col("id") % every == 0), positives, negatives, low, high)
