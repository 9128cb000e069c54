"""Ranks and latest rows without a window over everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """Of each key the row that is last by order; combined before the shuffle, so a hot key costs one row a task.

    A column of df that is named in order travels once, not beside itself.
    """
    named = {o: f"_o{i}" for i, o in enumerate(order) if isinstance(o, str)}
    kept = [c for c in df.columns if c not in keys and c not in named]
    by = [(F.col(f"`{o}`") if isinstance(o, str) else o).alias(f"_o{i}") for i, o in enumerate(order)]
    best = F.max(F.struct(*by, *[F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_kept")] * bool(kept)))
    found = df.groupBy(*keys).agg(best.alias("_best"))
    whence = {c: f"_best.{named[c]}" if c in named else f"_best._kept.`{c}`" for c in df.columns if c not in keys}
    return found.select(*[F.col(whence[c]).alias(c) if c in whence else F.col(f"`{c}`") for c in df.columns])


def rank_descending(df: DataFrame, first: str, second: str, out: str) -> DataFrame:
    """SQL's rank() by two numbers, both descending, from counts of their values.

    The counts of the first number's values are few; the second is ranked inside each
    of those, so only value pairs, never rows, are sorted together.
    """
    pairs = df.groupBy(first, second).agg(F.count(F.lit(1)).alias("_n"))
    inside = pairs.withColumn("_ahead", F.coalesce(F.sum("_n").over(W.partitionBy(first).orderBy(F.desc(second)).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    levels = pairs.groupBy(first).agg(F.sum("_n").alias("_all"))
    above = levels.withColumn("_above", F.coalesce(F.sum("_all").over(W.orderBy(F.desc(first)).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_all")
    ranks = inside.join(above, first).select(first, second, (F.col("_ahead") + F.col("_above") + 1).cast("long").alias(out))
    return df.join(ranks, [first, second]).select(*df.columns, out)
