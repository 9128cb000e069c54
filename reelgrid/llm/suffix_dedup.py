"""Repeated passages by sparse suffix arrays.

A passage is LENGTH or more words in a row that at least two documents have. Every
window of LENGTH words holds LENGTH - SEED + 1 runs of SEED words; the one with the
smallest hash (the leftmost of equals) is its minimiser, and only suffixes that start
at a minimiser are retained, about one in fifteen words. They are sorted by their seed
and the words that follow; neighbours in that order have the longest common
continuation, which says how far a suffix can match to the right at all. What can
still fill a window is then extended to the left: of the windows whose right part is
matched, those whose left part also agrees in another document are repeated. Each
window belongs to one minimiser, so together they are found without exception, and
neighbouring windows join into passages.

A seed that more than HOT suffixes share, and more than a partition has on average, is
not sorted in one task: its windows are hashed and counted with map-side aggregation
instead, and hot windows are dealt over tasks. There are at most as many such seeds as
partitions.

Continuations and left parts travel as 24 bits for each word (seeds and the windows of
hot ones as 64 bits), so a passage's end may reach one word too far with probability
2 ** -24.

Defined results: no rows give no passage; a text of any length is cut into its own
suffixes; other columns are not read, whatever their names; words are runs of other than ASCII white space, compared as they
are; null, empty and shorter texts have no passage; rows are documents, so repeated
rows with one id count as two; a passage that only one row repeats is none; bytes that
are no UTF-8 are parts of words as they are. Of equal minimisers in a window the leftmost
counts, so ties change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

LENGTH, SEED = 50, 20
#: Suffixes of one seed up to which it is never hot, and suffixes that it holds before it compares them.
HOT = 50_000
CHUNK = 1 << 15
#: Bytes of a word's hash that travel with a suffix.
BYTES = 3
PRIME = np.uint64(0x100000001B3)


def word_hashes(raw: bytes) -> np.ndarray:
    import xxhash

    words = raw.split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def rolled(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n values, by doubling."""
    out, done, step, size = None, 0, h, 1
    factor = PRIME
    with np.errstate(over="ignore"):
        while True:
            if n & size:
                # the runs so far lie before the next size values
                out = step if out is None else out[: len(step) - done] * factor + step[done:]
                done += size
            if done == n:
                break
            step = step[:-size] * factor + step[size:]
            size *= 2
            factor = factor * factor
        out = out ^ (out >> np.uint64(29))
        out = out * np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(32))


def minimisers(seeds: np.ndarray, width: int) -> np.ndarray:
    """For each window of width seeds the place of its smallest, the leftmost of equals."""
    at = np.arange(len(seeds), dtype=np.int64)
    size = 1
    while size < width:
        step = min(size, width - size)
        left, right = at[:-step], at[step:]
        at = np.where(seeds[left] <= seeds[right], left, right)
        size += step
    return at


def anchors(h: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Seeds' hashes at the retained places, those places, and the first and last window start that chose each."""
    if len(h) < length:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    runs = rolled(h, seed)
    chosen = minimisers(runs, length - seed + 1)
    first = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]])
    last = np.r_[first[1:], len(chosen)] - 1
    place = chosen[first]
    return runs[place], place, first, last


def retained(docs: DataFrame, hot: np.ndarray, length: int, seed: int, only: str) -> DataFrame:
    """From each row of docs (_row, doc_id, text): the seeds (only = "seeds"), the suffixes of seeds that aren't hot, or the windows of hot ones."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    common.bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seeds, at, lows, highs, owner, lefts, rights = [], [], [], [], [], [], []
            keys, starts, key_owner = [], [], []
            for i, raw in enumerate(b.column("text").to_pylist()):
                h = word_hashes(raw)
                s, p, low, high = anchors(h, length, seed)
                if only == "seeds":
                    seeds.append(s)
                    continue
                crowded = np.isin(s, hot) if len(hot) else np.zeros(len(s), bool)
                if only == "windows":
                    if crowded.any():
                        whole = rolled(h, length)
                        of = np.concatenate([np.arange(x, y + 1) for x, y in zip(low[crowded], high[crowded], strict=True)])
                        keys.append(whole[of])
                        starts.append(of)
                        key_owner.append(np.full(len(of), i))
                    continue
                short = np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - BYTES :])
                back = np.ascontiguousarray(short[::-1])
                n = len(h)
                for x, pp, lo, hi in zip(s[~crowded].tolist(), p[~crowded].tolist(), low[~crowded].tolist(), high[~crowded].tolist(), strict=True):
                    seeds.append(x)
                    at.append(pp)
                    lows.append(lo)
                    highs.append(hi)
                    owner.append(i)
                    lefts.append(back[n - pp : n - lo].tobytes())
                    rights.append(short[pp + seed : hi + length].tobytes())
            if only == "seeds":
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*seeds, np.zeros(0, np.uint64)]).view(np.int64))], names=["seed"])
            elif only == "windows":
                of = np.concatenate([*key_owner, np.zeros(0, int)]).astype(np.int64)
                columns = [pa.array(np.concatenate([*keys, np.zeros(0, np.uint64)]).view(np.int64)), b.column("_row").take(pa.array(of)), b.column("doc_id").take(pa.array(of)), pa.array(np.concatenate([*starts, np.zeros(0, int)]).astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "_row", "doc_id", "start"])
            else:
                of = pa.array(owner, pa.int64())
                columns = [pa.array(np.array(seeds, np.uint64).view(np.int64)), b.column("_row").take(of), b.column("doc_id").take(of), *(pa.array(x, pa.int64()) for x in (at, lows, highs)), pa.array(lefts, pa.binary()), pa.array(rights, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["seed", "_row", "doc_id", "at", "low", "high", "left", "right"])

    schemas = {
        "seeds": "seed long",
        "windows": f"key long, _row long, doc_id {kind}, start long",
        "suffixes": f"seed long, _row long, doc_id {kind}, at long, low long, high long, left binary, right binary",
    }
    rows = docs.select("_row", "doc_id", common.utf8(F.col("text")).alias("text"))
    return rows.mapInArrow(run, schemas[only])


def padded(parts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the words' bits, zero behind their lengths."""
    n = np.array([len(x) // BYTES for x in parts], np.int64)
    flat = np.frombuffer(b"".join(x.ljust(BYTES * width, b"\0") for x in parts), np.uint8).reshape(len(parts), width, BYTES)
    return sum(flat[:, :, k].astype(np.uint32) << np.uint32(8 * k) for k in range(BYTES)), n


def repeated(seeds: np.ndarray, rows: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, lefts: list[bytes], rights: list[bytes], length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From suffixes sorted by seed and continuation: the suffix, first and last start of runs of repeated windows."""
    rest = length - seed
    right, n_right = padded(rights, rest)
    left, _ = padded(lefts, rest)
    # the common continuation with the neighbours, if those have the same seed
    same = seeds[1:] == seeds[:-1]
    agree = np.logical_and.accumulate(right[1:] == right[:-1], axis=1).sum(1)
    agree = np.where(same, np.minimum(agree, np.minimum(n_right[1:], n_right[:-1])), -1)
    reach = np.maximum(np.r_[-1, agree], np.r_[agree, -1])
    # windows that start l words before the seed need length - seed - l words behind it
    first_l, last_l = np.maximum(at - high, rest - reach), at - low
    keep = np.flatnonzero((reach >= 0) & (first_l <= last_l))
    if not len(keep):
        none = np.zeros(0, np.int64)
        return none, none, none
    n = (last_l - first_l + 1)[keep]
    of = np.repeat(keep, n)
    steps = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    l = np.repeat(first_l[keep], n) + steps  # noqa: E741
    # hashes of the first 0, 1, ... words of either side
    with np.errstate(over="ignore"):
        sides = []
        for side in (left, right):
            x = np.zeros((len(side), rest + 1), np.uint64)
            for k in range(rest):
                x[:, k + 1] = (x[:, k] + side[:, k] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
                x[:, k + 1] ^= x[:, k + 1] >> np.uint64(31)
            sides.append(x)
        key = sides[0][of, l] * np.uint64(0xD6E8FEB86659FD93) ^ sides[1][of, rest - l] ^ (seeds[of].view(np.uint64) * PRIME) ^ (l.astype(np.uint64) << np.uint64(57))
    order = np.lexsort((rows[of], key))
    k, r = key[order], rows[of][order]
    starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    ends = np.r_[starts[1:], len(k)] - 1
    found = np.zeros(len(of), bool)
    found[order] = np.repeat(r[starts] != r[ends], ends - starts + 1)
    of, start = of[found], (at[of] - l)[found]
    order = np.lexsort((start, of))
    of, start = of[order], start[order]
    if not len(of):
        return of, start, start
    opens = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (start[1:] != start[:-1] + 1)])
    return of[opens], start[opens], start[np.r_[opens[1:], len(of)] - 1]


def spans_of_suffixes(suffixes: DataFrame, length: int, seed: int) -> DataFrame:
    """_row, doc_id, start, end of runs of repeated windows, from suffixes dealt by seed and sorted."""
    spark = suffixes.sparkSession
    kind = suffixes.schema["doc_id"].dataType.simpleString()

    def compare(t: pa.Table) -> list[pa.RecordBatch]:
        seeds = t.column("seed").to_numpy()
        near = seeds[1:] == seeds[:-1]
        t = t.filter(pa.array(np.r_[False, near] | np.r_[near, False]))
        columns = [t.column(c).to_numpy() for c in ("seed", "_row", "at", "low", "high")]
        if t.num_rows:
            of, first, last = repeated(*columns, t.column("left").to_pylist(), t.column("right").to_pylist(), length, seed)
        else:
            of = first = last = np.zeros(0, np.int64)
        some = t.take(pa.array(of))
        made = pa.table({"_row": some.column("_row"), "doc_id": some.column("doc_id"), "start": first.astype(np.int64), "end": (last + length).astype(np.int64)})
        return made.combine_chunks().to_batches() or [pa.RecordBatch.from_pylist([], schema=made.schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= CHUNK:
                t = pa.Table.from_batches(held)
                seeds = t.column("seed").to_numpy()
                cut = int(np.searchsorted(seeds, seeds[-1]))  # the last seed may go on
                if cut:
                    yield from compare(t.slice(0, cut))
                held = t.slice(cut).combine_chunks().to_batches()
                n = t.num_rows - cut
        if n:
            yield from compare(pa.Table.from_batches(held))

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = suffixes.repartition(parts, "seed").sortWithinPartitions("seed", "right")
    return dealt.mapInArrow(run, f"_row long, doc_id {kind}, start long, end long")


def passages(docs: DataFrame, length: int = LENGTH, seed: int = SEED, hot: int = HOT) -> DataFrame:
    """doc_id, start and length in words of each maximal stretch of docs' rows that other rows share in windows of `length` words."""
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "text")
    none = np.zeros(0, np.uint64)
    counts = common.written(retained(rows, none, length, seed, "seeds").groupBy("seed").count().filter("count > 1"), "seeds")
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    most = max(hot, int(counts.agg(F.sum("count")).first()[0] or 0) // parts)
    crowded = counts.filter(F.col("count") > most).select("seed").collect()  # parts at most
    known = np.array(sorted(r[0] for r in crowded), np.int64).view(np.uint64)
    spans = spans_of_suffixes(retained(rows, known, length, seed, "suffixes"), length, seed)
    if len(known):
        windows = common.written(retained(rows, known, length, seed, "windows"), "windows")
        shared = windows.groupBy("key").agg(F.min("_row").alias("a"), F.max("_row").alias("b"), F.count(F.lit(1)).alias("n")).filter("a < b").select("key", "n")
        shared = common.written(shared, "shared")
        spans = spans.unionByName(common.spread_join(windows, shared, "key", "n", "_row").select("_row", "doc_id", "start", (F.col("start") + length).alias("end")))
    in_row = W.partitionBy("_row").orderBy("start", "end")
    reached = F.max("end").over(in_row.rowsBetween(W.unboundedPreceding, -1))
    opened = spans.withColumn("_new", F.when(F.col("start") <= reached, 0).otherwise(1))
    island = opened.withColumn("_island", F.sum("_new").over(in_row.rowsBetween(W.unboundedPreceding, W.currentRow)))
    merged = island.groupBy("_row", "_island").agg(F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.max("end").alias("_end"))
    return merged.select("doc_id", "start", (F.col("_end") - F.col("start")).alias("length"))
