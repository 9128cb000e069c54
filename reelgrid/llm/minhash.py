"""Near-duplicates by Jaccard similarity of word shingles: MinHash bands find pairs, whole shingle sets verify them.

A text's signature is the smallest of its shingles' hashes under BANDS * ROWS
permutations; ROWS of them make a band, and texts that agree on a whole band meet in
its bucket. A pair of similarity s agrees on at least one of 20 bands of 5 with
probability 1 - (1 - s^5)^20: 0.9996 at 0.8. In a bucket of at most SMALL texts all
pairs are candidates. In a crowded one each text is paired with the smallest, and
because that one needn't be similar to it, the texts meet again on two and on four
bands at once, where only closer texts are left. That links most of a large group with pairs
linear in its rows. What is still apart, in a crowded bucket or in a SimHash star, is then
compared whole: its texts are dealt into blocks, and each block meets each other one in
a task, but for two blocks of one component. So every two texts that share a bucket or a
star are compared, unless they hang together already. Every candidate's similarity is computed
from both texts; no estimate decides. Components come from simhash.components.

Defined results: null and empty texts are equal; a text with fewer words than a
shingle has its whole word sequence as its only shingle; repeats of a shingle count once. Texts of any length are read whole,
and bytes that are no UTF-8 as they are; repeated rows are rows of their own; an empty
table gives no rows; other columns may have any name,
and all of them pass untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType

from . import common, simhash

BANDS, ROWS = 20, 5
#: Bands that texts of a crowded bucket have to share when they meet again.
LEVELS = (1, 2, 4)
#: Texts of a bucket up to which all its pairs are candidates.
SMALL = 8
#: Shingles that are permuted at once, and texts whose shingles a worker keeps while it verifies.
BLOCK = 1 << 10
KEPT = 64
#: Texts of a block, bytes of shingles in one, and shingles that two blocks compare at once.
MEET, MEET_BYTES = 256, 4 << 20
COLUMNS = 1 << 12
_random = np.random.default_rng(42)
_PERMUTE = _random.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _random.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(raw: bytes, width: int) -> np.ndarray:
    """The distinct 64-bit hashes of a UTF-8 text's word shingles, ascending."""
    import xxhash

    words = raw.lower().split()  # bytes: A-Z and ASCII white space only
    n = len(words) - width + 1
    if n < 2:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    of = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total += of[k : k + n] * _PLACE[k]
    return np.unique(mixed(total))


def bands(found: np.ndarray) -> np.ndarray:
    """A 64-bit value for each band of the signature of some shingles."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), BLOCK):
        least = np.minimum(least, (found[at : at + BLOCK, None] * _PERMUTE).min(0))
    total = (mixed(least).reshape(BANDS, ROWS) * _PLACE[:ROWS]).sum(1, dtype=np.uint64)
    return mixed(total + np.arange(BANDS, dtype=np.uint64))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def candidates(rows: DataFrame) -> DataFrame:
    """Distinct pairs a < b of _row in rows (_row, keys) that meet in a bucket, as the module says."""
    found, texts = [], rows
    for n in LEVELS:
        key = F.array(*[F.xxhash64(*[F.get("keys", F.lit((i + k) % BANDS)) for k in range(n)], F.lit(n)) for i in range(BANDS)]) if n > 1 else F.col("keys")
        placed = texts.select("_row", F.explode(key).alias("key"))
        buckets = placed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("_row").alias("hub")).filter("n > 1")
        members = common.written(placed.join(buckets, "key"), "buckets")
        few = members.filter(F.col("n") <= SMALL).groupBy("key").agg(F.array_sort(F.collect_list("_row")).alias("m"))
        one = few.select("m", F.posexplode("m").alias("at", "a"))
        found.append(one.select("a", F.explode(F.slice("m", F.col("at") + 2, SMALL)).alias("b")))
        crowded = members.filter(F.col("n") > SMALL)
        found.append(crowded.filter("_row > hub").select(F.col("hub").alias("a"), F.col("_row").alias("b")))
        texts = rows.join(crowded.select("_row").distinct(), "_row", "left_semi")
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return pairs.distinct()


def crowded(rows: DataFrame) -> DataFrame:
    """key and _row of the texts in rows (_row, keys) that lie in a bucket of more than SMALL."""
    placed = rows.select("_row", F.explode("keys").alias("key"))
    many = placed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > SMALL)
    return common.spread_join(placed, common.written(many, "crowded"), "key", "n", "_row").select("key", "_row")


def shared(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many shingles each of a has in common with each of b."""
    both = np.intersect1d(np.concatenate(a), np.concatenate(b))
    out = np.zeros((len(a), len(b)), np.int64)
    if not len(both):
        return out

    def places(of: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        flat, row = np.concatenate(of), np.repeat(np.arange(len(of)), list(map(len, of)))
        at = np.minimum(np.searchsorted(both, flat), len(both) - 1)
        known = both[at] == flat
        return row[known], at[known]

    def held(n: int, row: np.ndarray, at: np.ndarray, start: int) -> np.ndarray:
        some = (at >= start) & (at < start + COLUMNS)
        m = np.zeros((n, min(COLUMNS, len(both) - start)), np.float32)
        m[row[some], at[some] - start] = 1
        return m

    left, right = places(a), places(b)
    for start in range(0, len(both), COLUMNS):  # so few at once, and exact in floats
        out += (held(len(a), *left, start) @ held(len(b), *right, start).T).astype(np.int64)
    return out


def late_links(met: DataFrame, texts: DataFrame, found: DataFrame, width: int, least: float) -> DataFrame:
    """Links a, b between texts that share a key in met (key, _row) and hang together by none of found (node, component) yet: one of each two components in a block at least.

    texts: _row and text.
    """
    placed = met.join(found.withColumnRenamed("node", "_row"), "_row", "left").select("key", "_row", F.coalesce("component", "_row").alias("component"))
    apart = placed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("low"), F.max("component").alias("high"))
    apart = common.written(apart.filter((F.col("n") > 2) & (F.col("low") < F.col("high"))).select("key", "n"), "apart")
    if apart.isEmpty():
        return common.empty(met.sparkSession, "a long, b long")
    open_ = common.written(common.spread_join(placed, apart, "key", "n", "_row").select("key", "_row", "component"), "open")
    wanted = common.written(open_.select("_row").distinct(), "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            raw = [shingles(t, width).tobytes() for t in x.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([x.column("_row"), pa.array(raw, pa.binary())], names=["_row", "shingles"])
        common.give_back()

    some = texts.filter(common.among(wanted)(F.col("_row"))).select("_row", common.utf8(F.col("text")).alias("text")).join(wanted, "_row", "left_semi")
    some = common.written(some, "texts")  # a task with one Python worker here, and one below
    held = common.written(some.mapInArrow(run, "_row long, shingles binary"), "shingles")
    sized = open_.join(held.select("_row", F.octet_length("shingles").cast("long").alias("bytes")), "_row")
    blocks_of = F.greatest(F.ceil(F.count(F.lit(1)) / MEET), F.ceil(F.sum("bytes") / MEET_BYTES)).cast("int").alias("blocks")
    # a component that fills blocks of its own needn't meet itself; the others of a key share blocks
    parts = sized.groupBy("key", "component").agg(blocks_of)
    alone = common.written(parts.filter("blocks > 1"), "alone")
    marked = sized.join(alone, ["key", "component"], "left").withColumn("own", F.when(F.col("blocks").isNotNull(), F.col("component")))
    rest = marked.filter("own IS NULL").groupBy("key").agg(blocks_of.alias("mixed"))
    dealt = marked.join(rest, "key", "left").select("key", "_row", "component", "own", F.pmod(F.xxhash64("_row"), F.coalesce("blocks", "mixed")).cast("int").alias("nth"))
    dealt = common.written(dealt.withColumn("block", F.xxhash64("own", "nth")), "dealt")
    blocks = dealt.select("key", "block", "own").distinct()
    other = blocks.select("key", F.col("block").alias("other"), F.col("own").alias("others_own"))
    meets = blocks.join(other, "key").filter("block <= other AND (own IS NULL OR others_own IS NULL OR own <> others_own)").select("key", "block", "other")
    meets = common.written(meets, "meets")
    first = dealt.join(meets, ["key", "block"]).select("key", "block", "other", F.lit(True).alias("first"), "_row", "component")
    second = dealt.withColumnRenamed("block", "other").join(meets.filter("block < other"), ["key", "other"]).select("key", "block", "other", F.lit(False).alias("first"), "_row", "component")
    sent = first.unionByName(second).join(held, "_row").select("key", "block", "other", "first", "_row", "component", "shingles")

    def compare(t: pa.Table) -> pa.Table:
        row, component = (t.column(c).to_numpy() for c in ("_row", "component"))
        sets = [np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()]
        a = np.flatnonzero(t.column("first").to_numpy())
        b = a if len(a) == len(row) else np.flatnonzero(~t.column("first").to_numpy())
        size = np.array(list(map(len, sets)))
        both = shared([sets[i] for i in a], [sets[i] for i in b])
        near = (both / (size[a][:, None] + size[b] - both) >= least) & (component[a][:, None] != component[b])
        i, j = np.nonzero(near)
        i, j = a[i], b[j]
        low, high = np.minimum(component[i], component[j]), np.maximum(component[i], component[j])
        _, one = np.unique(np.stack([low, high]), axis=1, return_index=True)
        common.give_back()
        return pa.table({"a": np.minimum(row[i], row[j])[one], "b": np.maximum(row[i], row[j])[one]})

    return sent.groupBy("key", "block", "other").applyInArrow(compare, "a long, b long")


def linked(rows: DataFrame, width: int, least: float, radius: int | None = None) -> DataFrame:
    """node and component of the texts in rows (_row, keys, text; fp for a radius) that are similar to another one; written."""
    stars = None if radius is None else simhash.stars_of(rows.select("_row", "fp"), radius)
    pairs = links(rows, width, least, None if stars is None else stars[0])
    pairs = common.written(pairs, "links")
    found = common.written(simhash.components(pairs), "components")
    met = crowded(rows.select("_row", "keys"))
    if stars is not None:
        met = met.unionByName(stars[1])
    late = common.written(late_links(met, rows.select("_row", "text"), found, width, least), "late")
    if late.isEmpty():
        return found
    return common.written(simhash.components(pairs.unionByName(late)), "components")


def links(rows: DataFrame, width: int, least: float, more: DataFrame | None = None) -> DataFrame:
    """Pairs a, b of _row in rows (_row, keys, text) that are candidates, or in more, and have a similarity of at least least."""
    pairs = candidates(rows.select("_row", "keys"))
    if more is not None:
        pairs = more.unionByName(pairs).distinct()
    pairs = common.written(pairs, "pairs")
    met = pairs.select(F.col("a").alias("_row")).unionByName(pairs.select(F.col("b").alias("_row"))).distinct()
    met = common.written(met, "met")
    texts = rows.filter(common.among(met)(F.col("_row"))).select("_row", common.utf8(F.col("text")).alias("text"))
    texts = common.written(texts.join(met, "_row", "left_semi"), "texts")
    whole = pairs.join(texts.select(F.col("_row").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("_row").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}

        def of(row: int, raw: pa.Scalar) -> np.ndarray:
            if row not in kept:
                if len(kept) >= KEPT:
                    del kept[next(iter(kept))]
                kept[row] = shingles(raw.as_py(), width)
            return kept[row]

        for x in batches:
            ids = [x.column(c).to_pylist() for c in ("a", "b")]
            near = [jaccard(of(a, s), of(b, t)) >= least for a, b, s, t in zip(*ids, x.column("text_a"), x.column("text_b"), strict=True)]
            yield x.select(["a", "b"]).filter(pa.array(near, pa.bool_()))
        common.give_back()

    return whole.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def deduplicated(docs: DataFrame, width: int, least: float, radius: int | None = None) -> DataFrame:
    """Of each component of similar rows the one with the smallest doc_id (null last; one of repeated rows), with its own columns.

    With a radius, rows whose SimHash fingerprints (of 4-word shingles, as op10 makes them) link within it are
    candidates too, and are verified like all.
    """
    common.bounded_batches(docs.sparkSession)

    mark = simhash.fingerprint  # one function makes both, so that a task has one worker

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for some in texts:
            raw = some.to_pylist()
            keys = pa.array([bands(shingles(x, width)).view(np.int64) for x in raw], pa.list_(pa.int64()))
            fps = np.array([mark(x, 4) if radius is not None else 0 for x in raw], np.uint64).view(np.int64)
            yield pa.StructArray.from_arrays([keys, pa.array(fps)], ["keys", "fp"])
        common.give_back()

    udf = F.arrow_udf(run, "keys array<long>, fp long", ArrowUDFType.SCALAR_ITER)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), udf(common.utf8(F.col("text"))).alias("_met"), whole.alias("_doc"))
    rows = common.written(rows.select("_row", "_met.keys", "_met.fp", "_doc"), "near")
    found = linked(rows.select("_row", "keys", "fp", "_doc.text"), width, least, radius)
    placed = rows.select("_row", "_doc.doc_id").join(found.withColumnRenamed("node", "_row"), "_row")
    first = placed.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))["_row"].alias("_row"))
    gone = common.written(found.select(F.col("node").alias("_row")).join(first, "_row", "left_anti"), "gone")
    return common.without(rows.select("_row", "keys", "_doc"), gone).select("_doc.*")
