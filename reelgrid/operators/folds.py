"""Clamped sums in order, without one task that sees a whole history.

A clamped addition x -> min(high, max(low, x + shift)) is closed under composition: two of
them, one after the other, are a third one. So pieces of a history are folded apart, to
a triple (shift, low, high) each, and the triples put together in order, in as many
levels as it takes; no row holds more than PIECE changes or triples but the last two of a
sum, which hold a triple for each piece of a partition and one for each partition.

Defined results: changes are in the order of the given columns, nulls first, and equal
ones in any order, which can show only in a column beside the order; a null weight changes
nothing; null keys are keys; no rows give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelgrid.functions.maths import clamp
from reelgrid.sources.shared import written

#: Changes or triples of one key that are folded in one row when a history is cut.
PIECE = 1024
#: Rows of a piece whose running states are asked for.
RUN = 32
#: A history is cut when it has more rows than this, and than a share of an average partition.
WHOLE, SHARE = 4096, 8

INFINITE = float("inf")


def change(weight: Column, low: float, high: float) -> Column:
    """One clamped addition."""
    return F.struct(F.coalesce(weight.cast("double"), F.lit(0.0)).alias("shift"), F.lit(low).alias("low"), F.lit(high).alias("high"))


def nothing() -> Column:
    return change(F.lit(0.0), -INFINITE, INFINITE)


def composed(f: Column, g: Column) -> Column:
    """g after f."""
    inside = lambda y: F.least(F.greatest(y + g["shift"], g["low"]), g["high"])
    return F.struct((f["shift"] + g["shift"]).alias("shift"), inside(f["low"]).alias("low"), inside(f["high"]).alias("high"))


def applied(f: Column, x: Column) -> Column:
    return F.least(F.greatest(x + f["shift"], f["low"]), f["high"])


def all_composed(steps: Column) -> Column:
    """An array of (place, f), put together by place."""
    return F.aggregate(F.sort_array(steps), nothing(), lambda a, x: composed(a, x["f"]))


def ordered(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """rows, written, with _key (a struct, so that nulls are equal), _part (a range of keys and order) and _at (the place in it)."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(parts, *key, *order).sortWithinPartitions(*key, *order)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")
    return written(dealt.select("*", F.struct(*key).alias("_key"), F.spark_partition_id().alias("_part"), at), "ordered")


def numbered(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """ordered(), with _at counted on through all partitions, from 0."""
    cut = ordered(rows, key, order)
    sizes = cut.groupBy("_part").agg(F.max("_at").alias("_last"))  # a row for each partition
    base = sizes.select("_part", (F.sum(F.col("_last") + 1).over(W.orderBy("_part")) - F.col("_last") - 1).alias("_base"))
    return cut.join(F.broadcast(base), "_part").withColumn("_at", F.col("_base") + F.col("_at")).drop("_base")


def most_whole(rows: DataFrame, total: int | None) -> int:
    """The most changes that are folded in one row, out of so many in all."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return max(WHOLE, -(-(total or 0) // (SHARE * parts)))


def gathered(rows: DataFrame, key: list[str], within: str, order: list[str], weight: str) -> DataFrame:
    """key with _all, the changes of all entries of its lists (fields of within, order and _w, sorted), and _from, the places (from 1) where another entry begins."""
    fields = rows.schema[within].dataType.elementType.names
    step = F.struct(*order, F.col(weight).alias("_w"), F.col(within).alias("_of"))
    met = rows.filter(F.size(within) > 0).groupBy(*key).agg(F.collect_list(step).alias("_steps"))
    entry = lambda s: F.transform(s["_of"], lambda x: F.struct(*[x[f].alias(f) for f in fields], *[s[o].alias(o) for o in order], s["_w"].alias("_w")))
    placed = met.select(*key, F.sort_array(F.flatten(F.transform("_steps", entry))).alias("_all"))
    at = lambda i: F.get("_all", i - 1)
    begins = lambda i: (i == 1) | ~reduce(Column.__and__, [at(i)[f].eqNullSafe(at(i - 1)[f]) for f in fields])
    return placed.select(*key, "_all", F.filter(F.sequence(F.lit(1), F.size("_all")), begins).alias("_from"))


def until_next(first: Column, place: Column) -> Column:
    """How many changes an entry has that begins at first, place (from 0) in _from."""
    return F.coalesce(F.get("_from", place + 1), F.size("_all") + 1) - first


def clamped_lists(rows: DataFrame, key: list[str], within: str, order: list[str], weight: str, low: float, high: float) -> DataFrame:
    """key, the fields of within, value and n, where each change counts for every entry of its list within (structs).

    All changes of a key meet in one row and are spread to their entries only there: what is shuffled is a row
    for each change. Keys with long histories have to be left to clamped_sum().
    """
    fields = rows.schema[within].dataType.elementType.names
    add = lambda a, x: clamp(a + F.coalesce(x["_w"].cast("double"), F.lit(0.0)), low, high)

    def folded(first: Column, place: Column) -> Column:
        n = until_next(first, place)
        value = F.aggregate(F.slice("_all", first, n), F.lit(0.0), add)
        return F.struct(*[F.get("_all", first - 1)[f].alias(f) for f in fields], value.alias("value"), n.cast("long").alias("n"))

    return gathered(rows, key, within, order, weight).select(*key, F.inline(F.transform("_from", folded)))


def running_lists(rows: DataFrame, key: list[str], within: str, order: list[str], weight: str, low: float, high: float, out: str) -> DataFrame:
    """key, the fields of within, order and out: clamped_lists() with the value after each change. Changes equal in order go by weight."""
    fields = rows.schema[within].dataType.elementType.names
    add = lambda a, x: clamp(a + F.coalesce(x["_w"].cast("double"), F.lit(0.0)), low, high)

    def states(first: Column, place: Column) -> Column:
        part = F.slice("_all", first, until_next(first, place))
        so_far = F.aggregate(part, F.array().cast("array<double>"), lambda a, x: F.concat(a, F.array(add(F.coalesce(F.get(a, F.size(a) - 1), F.lit(0.0)), x))))
        return F.zip_with(part, so_far, lambda x, v: F.struct(*[x[c].alias(c) for c in (*fields, *order)], v.alias(out)))

    return gathered(rows, key, within, order, weight).select(*key, F.inline(F.flatten(F.transform("_from", states))))


def clamped_sum(rows: DataFrame, key: list[str], order: list[str], weight: str, low: float, high: float, start: float = 0.0, most: int | None = None) -> DataFrame:
    """key, value and n (changes): weights added in order from start, clamped each time.

    A history of up to most changes is folded in one row, after one shuffle. Longer
    ones, of which there are at most SHARE for each partition, are cut: their changes are sorted
    by ranges, so that a history lies in many partitions.
    """
    add = lambda a, x: clamp(a + F.coalesce(x["_w"].cast("double"), F.lit(0.0)), low, high)
    each = F.sort_array(F.collect_list(F.struct(*order, F.col(weight).alias("_w"))))
    whole = lambda df: df.groupBy(*key).agg(F.aggregate(each, F.lit(float(start)), add).alias("value"), F.count(F.lit(1)).alias("n"))
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    total, largest = sizes.agg(F.sum("n"), F.max("n")).first()
    most = most or most_whole(rows, total)
    if (largest or 0) <= most:
        return whole(rows)
    hot = F.broadcast(sizes.filter(F.col("n") > most).select(F.struct(*key).alias("_hot")))
    met = F.struct(*key) == F.col("_hot")
    cut = ordered(rows.join(hot, met, "left_semi"), key, order)
    step = F.struct(F.col("_at").alias("place"), change(F.col(weight), low, high).alias("f"))
    pieces = cut.groupBy("_key", "_part", F.expr(f"_at div {PIECE}").alias("place")).agg(all_composed(F.collect_list(step)).alias("f"), F.count(F.lit(1)).alias("n"))
    of_parts = pieces.groupBy("_key", F.col("_part").alias("place")).agg(all_composed(F.collect_list(F.struct("place", "f"))).alias("f"), F.sum("n").alias("n"))
    sums = of_parts.groupBy("_key").agg(applied(all_composed(F.collect_list(F.struct("place", "f"))), F.lit(float(start))).alias("value"), F.sum("n").alias("n"))
    return whole(rows.join(hot, met, "left_anti")).unionByName(sums.select("_key.*", "value", "n"))


def before(pieces: DataFrame) -> DataFrame:
    """_key, place and before: all earlier f of the key put together, for keys of pieces (_key, place, f) that have several.

    RUN places at a time are one place of the next level, whose own earlier ones are found
    in the same way; a key leaves once it has one place.
    """
    several = pieces.groupBy("_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("_key")
    many = written(pieces.join(several, "_key", "left_semi").groupBy("_key", F.expr(f"place div {RUN}").alias("up")).agg(F.sort_array(F.collect_list(F.struct("place", "f"))).alias("steps")), "levels")
    if many.isEmpty():
        return many.select("_key", "up", nothing().alias("before")).withColumnRenamed("up", "place")
    above = before(many.select("_key", F.col("up").alias("place"), all_composed(F.col("steps")).alias("f")))
    rows = many.join(above.withColumnRenamed("place", "up"), ["_key", "up"], "left").withColumn("first", F.coalesce("before", nothing()))
    each = rows.select("_key", "steps", "first", F.posexplode("steps").alias("i", "step"))
    so_far = F.aggregate(F.slice("steps", F.lit(1), F.col("i")), F.col("first"), lambda a, x: composed(a, x["f"]))
    return each.select("_key", F.col("step.place").alias("place"), so_far.alias("before"))


def running_clamped(rows: DataFrame, key: list[str], order: list[str], weight: str, low: float, high: float, out: str, start: float = 0.0) -> DataFrame:
    """rows with out: the clamped sum of their key's weights up to and with their own."""
    placed = numbered(rows, key, order)
    step = F.struct(F.col("_at").alias("place"), change(F.col(weight), low, high).alias("f"), F.struct(*rows.columns).alias("row"))
    pieces = placed.groupBy("_key", F.expr(f"_at div {RUN}").alias("place")).agg(F.sort_array(F.collect_list(step)).alias("steps"))
    pieces = written(pieces.withColumn("f", F.aggregate("steps", nothing(), lambda a, x: composed(a, x["f"]))), "pieces")
    met = pieces.join(before(pieces.select("_key", "place", "f")), ["_key", "place"], "left")
    each = met.select("steps", applied(F.coalesce("before", nothing()), F.lit(float(start))).alias("_first"), F.posexplode("steps").alias("_i", "_step"))
    state = F.aggregate(F.slice("steps", F.lit(1), F.col("_i") + 1), F.col("_first"), lambda a, x: applied(x["f"], a))
    return each.select("_step.row.*", state.alias(out))
