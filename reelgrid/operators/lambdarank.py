"""A ranker that learns order: boosted trees on pairwise gradients weighted by the change of NDCG.

Rows of one group (a user's pool) are ranked by the scores so far. A pair of different
labels pulls its rows apart by how wrong their order is, times what swapping them would
change of NDCG at k; that is nothing unless one of them is among the first k, so each row
meets the first k of its group and no other: pairs grow with the rows, not with the
square of a group, and none that counts is left out.

A group is one row that holds its labels and bins, shuffled once; whatever trees there
are so far, its scores and gradients follow from that in the task that reads it, so nothing
but histograms leaves a task while trees grow. Trees grow level by level: each task sums
gradients for each node, feature and bin, Spark adds these up, and the driver sees nodes x
features x bins sums, whatever the number of rows. Bins are quantiles of the features. A
tree is a column expression, so that scoring is part of any plan.

Defined results: a null feature lies in the lowest bin; groups of one label pull nothing;
ties of score are ranked by a hash of the row, never by its label; no rows give no trees,
and a model without trees scores 0.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelgrid.sources.shared import written

#: Quantile bins of a feature at most.
BINS = 32
#: Trees after which scores are written, so that tasks don't grow old trees anew.
KEPT = 16
POOLS = "ideal double, n int, gains binary, bins binary, scores binary"


@dataclass(frozen=True)
class Ranker:
    """features, and trees: {"value": v} or {"feature": i, "most": x, "gain": g, "low": tree, "high": tree}; a row goes low if its feature is null or at most x."""

    features: list[str]
    trees: list[dict]

    def column(self) -> Column:
        return reduce(lambda a, t: a + expression(t, [F.col(f) for f in self.features]), self.trees, F.lit(0.0))

    def transform(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("prediction", self.column())

    def importances(self) -> dict[str, float]:
        """The gain of all splits by a feature, as a share of all."""
        sums = dict.fromkeys(self.features, 0.0)

        def walk(t: dict) -> None:
            if "feature" in t:
                sums[self.features[t["feature"]]] += t["gain"]
                walk(t["low"])
                walk(t["high"])

        for t in self.trees:
            walk(t)
        whole = sum(sums.values())
        return {f: v / whole if whole else 0.0 for f, v in sums.items()}

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps({"features": self.features, "trees": self.trees}),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Ranker:
        return cls(**json.loads(spark.read.text(path).first()[0]))


def expression(tree: dict, features: list[Column]) -> Column:
    if "value" in tree:
        return F.lit(tree["value"])
    x = features[tree["feature"]]
    return F.when(x > tree["most"], expression(tree["high"], features)).otherwise(expression(tree["low"], features))


def cut_points(rows: DataFrame, features: list[str], bins: int = BINS) -> list[list[float]]:
    """The distinct quantiles between a feature's bins; a value up to the i-th lies in bin i at most."""
    shares = [i / bins for i in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(F.col(f).cast("double"), shares, 10_000).alias(f) for f in features]).first()
    return [sorted(set(found[f] or [])) for f in features]


def binned(rows: DataFrame, features: list[str], cuts: list[list[float]]) -> DataFrame:
    """rows (_group, _gain and features) with _bins, a byte for each feature, in place of features."""
    schema = T.StructType([*rows.select("_group", "_gain").schema.fields, T.StructField("_bins", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.zeros((b.num_rows, len(cuts)), np.uint8)
            for i, c in enumerate(cuts):  # a null is in the lowest bin, what is no number in the highest
                x = b.column(f"_f{i}")
                out[:, i] = np.where(x.is_valid().to_numpy(zero_copy_only=False), np.searchsorted(c, x.fill_null(0.0).to_numpy()), 0) if c else 0
            raw = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(np.arange(b.num_rows + 1, dtype=np.int32) * len(cuts)), pa.py_buffer(out.tobytes())])
            yield pa.RecordBatch.from_arrays([b.column("_group"), b.column("_gain"), raw], names=["_group", "_gain", "_bins"])

    return rows.select("_group", "_gain", *[F.col(f).cast("double").alias(f"_f{i}") for i, f in enumerate(features)]).mapInArrow(run, schema)


def flat(column: pa.Array, kind: type) -> np.ndarray:
    """The numbers in a column of bytes, one row after the other."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    return np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]].view(kind) if held is not None and len(column) else np.zeros(0, kind)


def binaries(values: np.ndarray, n: np.ndarray) -> pa.Array:
    """values as bytes, n of them in a row."""
    stops = np.concatenate([[0], np.cumsum(n) * values.itemsize]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(stops), pa.py_buffer(values.tobytes())])


def pools(rows: DataFrame, k: int) -> DataFrame:
    """A row for each _group of rows (_group, _row, _gain, _bins, _score): POOLS, and rows, the _row of each; in the order of equal scores."""
    one = F.struct(F.xxhash64("_row").alias("by"), F.col("_row").alias("row"), F.col("_gain").alias("gain"), F.col("_score").alias("score"), F.col("_bins").alias("bins"))
    lists = rows.groupBy("_group").agg(F.sort_array(F.collect_list(one)).alias("x"))
    lists = lists.select(*[F.col(f"x.{c}").alias(c) for c in ("row", "gain", "score", "bins")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.diff(b.column("row").offsets.to_numpy())
            gain, score, row = (b.column(c).flatten().to_numpy(zero_copy_only=False).astype(t) for c, t in (("gain", float), ("score", float), ("row", np.int64)))
            of, start = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
            best = np.lexsort((-gain, of))
            place = np.arange(len(of)) - start[of] + 1
            ideal = np.bincount(of, np.where(place <= k, gain[best] / np.log2(place + 1), 0.0), len(n))
            bins = b.column("bins").flatten()
            wide = len(flat(bins, np.uint8)) // max(1, len(of))
            parts = [pa.array(ideal), pa.array(n.astype(np.int32)), binaries(gain, n), binaries(flat(bins, np.uint8), n * wide), binaries(score, n), binaries(row, n)]
            yield pa.RecordBatch.from_arrays(parts, names=["ideal", "n", "gains", "bins", "scores", "rows"])

    return lists.mapInArrow(run, f"{POOLS}, rows binary")


def pulls(n: np.ndarray, gain: np.ndarray, score: np.ndarray, ideal: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """What pulls each score up, and its curvature, for groups of n rows, one after the other."""
    of, start = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
    order = np.lexsort((-score, of))  # stable, and groups stay together
    place = np.empty(len(of), np.int64)
    place[order] = np.arange(len(of)) - start[of] + 1
    weight = lambda p: np.where(p <= k, 1 / np.log2(p + 1), 0.0)
    g, h = np.zeros(len(of)), np.zeros(len(of))
    for first in range(1, k + 1):
        top = np.full(len(n), -1)
        top[n >= first] = order[start[n >= first] + first - 1]
        x = np.flatnonzero((place > first) & (ideal[of] > 0))
        t = top[of[x]]
        differ = gain[t] != gain[x]
        x, t = x[differ], t[differ]
        change = np.abs((gain[t] - gain[x]) * (weight(first) - weight(place[x]))) / ideal[of[x]]
        better = np.sign(gain[t] - gain[x])  # 1 if the upper one is the better one
        with np.errstate(over="ignore"):
            wrong = 1 / (1 + np.exp(better * (score[t] - score[x])))
        pull, curve = better * wrong * change, wrong * (1 - wrong) * change
        g[x] -= pull
        h[x] += curve
        g += np.bincount(t, pull, len(of))
        h += np.bincount(t, curve, len(of))
    return g, h


def gradients(rows: DataFrame, k: int) -> DataFrame:
    """_row of rows (_group, _row, _gain, _score) with _g, what pulls the score up, and _h, its curvature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g, h = pulls(b.column("n").to_numpy(), flat(b.column("gains"), float), flat(b.column("scores"), float), b.column("ideal").to_numpy(), k)
            yield pa.RecordBatch.from_arrays([pa.array(flat(b.column("rows"), np.int64)), pa.array(g), pa.array(h)], names=["_row", "_g", "_h"])

    return pools(rows.withColumn("_bins", F.lit(b"")), k).mapInArrow(run, "_row long, _g double, _h double")


def split(sums: np.ndarray, rest: float, least: float) -> tuple[float, int, int] | None:
    """Gain, feature and last low bin of the best split of a node; sums: features x bins x (g, h, n)."""
    low = sums.cumsum(1)
    whole = low[0, -1]
    high = whole - low
    worth = lambda s: s[..., 0] ** 2 / (s[..., 1] + rest)
    gain = worth(low) + worth(high) - worth(whole)
    gain[(low[..., 2] < least) | (high[..., 2] < least)] = -np.inf
    f, b = np.unravel_index(np.argmax(gain), gain.shape)
    return (float(gain[f, b]), int(f), int(b)) if gain[f, b] > 1e-12 else None


def reached(tree: dict, bins: np.ndarray, cuts: list[list[float]]) -> np.ndarray:
    """What a tree gives rows of bins."""
    if "value" in tree:
        return np.full(len(bins), tree["value"])
    up = bins[:, tree["feature"]] > cuts[tree["feature"]].index(tree["most"])
    out = np.empty(len(bins))
    out[up], out[~up] = reached(tree["high"], bins[up], cuts), reached(tree["low"], bins[~up], cuts)
    return out


def scored(state: DataFrame, trees: list[dict], cuts: list[list[float]]) -> DataFrame:
    """state (POOLS) with the scores that trees add."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, bins = b.column("n").to_numpy(), flat(b.column("bins"), np.uint8).reshape(-1, len(cuts))
            score = sum((reached(t, bins, cuts) for t in trees), flat(b.column("scores"), float))
            yield b.set_column(b.schema.get_field_index("scores"), "scores", binaries(score, n))

    return state.mapInArrow(run, POOLS)


def histograms(state: DataFrame, trees: list[dict], moves: list[list[tuple[int, int, int]]], cuts: list[list[float]], k: int) -> DataFrame:
    """node, f, bin and the sums g, h and n of rows of state in each node of a tree to be: moves has, for each level, the nodes that part and where."""
    wide = BINS + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes = 2 ** (len(moves) + 1) - 1
        sums = np.zeros((3, nodes * len(cuts) * wide))
        for b in batches:
            n, bins = b.column("n").to_numpy(), flat(b.column("bins"), np.uint8).reshape(-1, len(cuts))
            score = sum((reached(t, bins, cuts) for t in trees), flat(b.column("scores"), float))
            g, h = pulls(n, flat(b.column("gains"), float), score, b.column("ideal").to_numpy(), k)
            at = np.zeros(len(bins), np.int64)
            for level in moves:
                to = np.full(len(bins), -1)
                for node, f, most in level:
                    own = at == node
                    to[own] = np.where(bins[own, f] > most, 2 * node + 2, 2 * node + 1)
                at = to
            on = at >= 0
            for f in range(len(cuts)):
                place = (at[on] * len(cuts) + f) * wide + bins[on, f]
                for i, x in enumerate((g[on], h[on], None)):
                    sums[i] += np.bincount(place, x, sums.shape[1])
        found = np.flatnonzero(sums[2])
        keys = [found // wide // len(cuts), found // wide % len(cuts), found % wide]
        yield pa.RecordBatch.from_arrays([*[pa.array(x.astype(np.int32)) for x in keys], *[pa.array(s[found]) for s in sums]], names=["node", "f", "bin", "g", "h", "n"])

    each = state.mapInArrow(run, "node int, f int, bin int, g double, h double, n double")
    return each.groupBy("node", "f", "bin").agg(F.sum("g"), F.sum("h"), F.sum("n"))


def grown(state: DataFrame, trees: list[dict], cuts: list[list[float]], k: int, depth: int, rate: float, rest: float, least: int) -> dict:
    """The next tree for state (POOLS), whose scores trees add to."""
    leaf = lambda s: {"value": float(rate * s[0] / (s[1] + rest)) if s[2] else 0.0}
    root: dict = {}
    open_, moves = {0: root}, []
    for level in range(max(1, depth)):
        tables = {node: np.zeros((len(cuts), BINS + 1, 3)) for node in open_}
        for node, f, b, *x in histograms(state, trees, moves, cuts, k).collect():
            tables[node][f, b] = x
        next_, parted = {}, []
        for node, tree in open_.items():
            found = split(tables[node], rest, least) if level < depth else None
            if found is None or found[2] >= len(cuts[found[1]]):
                tree.update(leaf(tables[node][0].sum(0)))
                continue
            gain, f, b = found
            tree.update(feature=f, most=cuts[f][b], gain=gain, low={}, high={})
            if level + 1 == depth:
                tree["low"].update(leaf(tables[node][f, : b + 1].sum(0)))
                tree["high"].update(leaf(tables[node][f, b + 1 :].sum(0)))
                continue
            next_ |= {2 * node + 1: tree["low"], 2 * node + 2: tree["high"]}
            parted.append((node, f, b))
        if not next_:
            break
        moves.append(parted)
        open_ = next_
    return root


def train(rows: DataFrame, features: list[str], group: str = "user_id", label: str = "label", trees: int = 30, depth: int = 4, rate: float = 0.1, k: int = 10, rest: float = 1.0, least: int = 5) -> Ranker:
    """A ranker of the rows of each group; a label's gain is 2^label - 1. k: the places whose order counts. rows are read twice."""
    base = rows.select(F.struct(group).alias("_group"), (F.pow(F.lit(2.0), F.col(label)) - 1).alias("_gain"), *features)
    cuts = cut_points(base, features)
    base = written(binned(base, features, cuts).withColumns({"_row": F.monotonically_increasing_id(), "_score": F.lit(0.0)}), "binned")
    state = written(pools(base, k).drop("rows"), "pools")
    made: list[dict] = []
    for n in range(trees):
        if n and n % KEPT == 0:
            state = written(scored(state, made[-KEPT:], cuts), "pools")
        tree = grown(state, made[n // KEPT * KEPT :], cuts, k, depth, rate, rest, least)
        made.append(tree)
        if "value" in tree and not tree["value"]:
            break
    return Ranker(list(features), made)
