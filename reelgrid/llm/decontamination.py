"""Benchmark passages in documents, found by winnowing.

A window is span consecutive words of a benchmark item. Of the k-grams in each window of
a text the one with the smallest hash is kept (the last of equal ones); that choice
depends on the window alone, so whatever window a document shares with an item has the
same fingerprint in both, and no shared span of span words or more is missed. Documents'
fingerprints meet those of the benchmark, and each hit is extended to the windows that
chose it, which are compared word by word. Items of fewer words than a window are one
window of their own; documents look for those of each such length.

Documents' fingerprints first meet a filter of bits, a table of at most FILTER / 64 rows
whatever the benchmark's size: so only windows that may occur are shuffled. Windows that
many documents share are dealt over tasks by salts, and windows that occur in the same
items are one class, so that a passage of many items is no pair of each document and item.

Defined results: a null text, or one without a word, has no window and is never hit; a
null item_id counts as an empty one, and rows of one item_id are one item; repeated rows
are documents of their own; texts of any length are read whole, and bytes that are no
UTF-8 count as U+FFFD; an empty table of documents gives no rows, an empty benchmark no
hit. A document's hits, at most one for each of its words, meet in one row, as do the ids
of its items, because their digest is sequential. Other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Words of a window, and of the grams whose hashes are compared.
SPAN, GRAM = 10, 4


def gram(j: Column, k: int) -> Column:
    """The hash of the k words of _words from place j."""
    return F.xxhash64(*[F.get("_words", j + i) for i in range(k)])


def kept(texts: DataFrame, span: int, k: int) -> DataFrame:
    """The columns of texts (with _words) and, for each k-gram that a window keeps, _fp and the first and last start of such windows, _low and _high."""
    wide = span - k + 1
    grams = F.when(F.size("_words") >= span, F.transform(F.sequence(F.lit(0), F.greatest(F.size("_words") - k, F.lit(0))), lambda j: gram(j, k)))
    # outer: else the optimiser computes all grams of a text once more, to filter out those without
    rows = texts.withColumn("_grams", grams).select("*", F.posexplode_outer("_grams").alias("_j", "_fp")).filter("_fp is not null")

    def free(side: int, ends) -> Column:
        """How many grams on one side, up to the next that a window would rather keep, or the text's end."""
        out = None
        for o in range(1, wide):
            other = F.get("_grams", F.col("_j") + side * o)
            stop = other.isNull() | ends(other)
            out = F.when(stop, o - 1) if out is None else out.when(stop, o - 1)
        return F.lit(0) if out is None else out.otherwise(wide - 1)

    rows = rows.withColumn("_low", F.col("_j") - free(-1, lambda x: x < F.col("_fp")))
    rows = rows.withColumn("_high", F.col("_j") + free(1, lambda x: x <= F.col("_fp")) - (wide - 1))
    return rows.filter("_low <= _high").drop("_grams", "_j")


def short(texts: DataFrame, lengths: list[int]) -> DataFrame:
    """The columns of texts (with _words), and _fp, _low, _high and _span of every run of so many words."""
    rows = texts.select("*", F.explode_outer(F.sequence(F.lit(0), F.greatest(F.size("_words") - min(lengths), F.lit(0)))).alias("_low"))
    each = F.array(*[F.struct(F.lit(n).alias("_span"), F.when(F.col("_low") + n <= F.size("_words"), gram(F.col("_low"), n)).alias("_fp")) for n in lengths])
    return rows.select("*", F.inline(each)).filter("_fp is not null").withColumn("_high", F.col("_low"))


def fingerprints(texts: DataFrame, span: int, k: int, lengths: list[int]) -> DataFrame:
    """kept() of texts and, for lengths of short items, short(): with _span, the words of the window."""
    full = kept(texts, span, k).withColumn("_span", F.lit(span))
    if not lengths:
        return full
    return full.unionByName(short(texts, lengths).select(*full.columns))


def windows_of(items: DataFrame, span: int) -> DataFrame:
    """Distinct key (the words of a window, joined by a space) and item of items (item, _words)."""
    n = F.least(F.lit(span), F.size("_words"))
    start = F.explode(F.sequence(F.lit(1), F.size("_words") - n + 1)).alias("_start")
    return items.select("item", "_words", n.alias("_n"), start).select(F.array_join(F.slice("_words", F.col("_start"), F.col("_n")), " ").alias("key"), "item").distinct()


def bits(fp: DataFrame) -> DataFrame:
    """word, bits: the filter of _fp."""
    bit = F.pmod("_fp", F.lit(common.FILTER)).alias("bit")
    return fp.select(bit).groupBy(F.expr("cast(bit div 64 as int)").alias("_word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("_bits"))


def hits(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, k: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """_row, start, length and set of every window of docs (_row, text) that occurs in the benchmark; and set, item: the items in which the windows of a set occur."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), common.words(F.col("text")).alias("_words")).filter("size(_words) > 0")
    items = common.written(items, "items")
    lengths = sorted(r[0] for r in items.select(F.size("_words").alias("n")).filter(F.col("n") < span).distinct().collect())  # fewer than span rows
    where = common.written(windows_of(items, span), "windows")
    both = [F.bit_xor(F.xxhash64("item", F.lit(seed))).alias(f"x{seed}") for seed in (1, 2)]
    sets = where.groupBy("key").agg(F.struct(F.count(F.lit(1)).alias("n"), *both).alias("set"))
    sets = common.written(sets, "sets")
    one = sets.groupBy("set").agg(F.min("key").alias("key"))
    members = one.join(where, "key").select("set", "item")

    known = bits(fingerprints(items.select("_words"), span, k, lengths))
    rows = docs.select("_row", common.words(F.col("text")).alias("_words"))
    bit = F.pmod("_fp", F.lit(common.FILTER))
    found = fingerprints(rows, span, k, lengths).withColumn("_word", F.expr(f"cast(pmod(_fp, {common.FILTER}L) div 64 as int)")).join(F.broadcast(known), "_word")
    found = found.filter(F.getbit("_bits", (bit % 64).cast("int")) == 1)
    found = found.select("_row", "_words", F.col("_span").alias("length"), F.explode_outer(F.sequence("_low", "_high")).alias("start"))
    found = common.written(found.select("_row", "start", "length", F.array_join(F.slice("_words", F.col("start") + 1, F.col("length")), " ").alias("key")), "candidates")
    facts = common.written(found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).join(sets, "key"), "facts")
    return common.spread_join(found, facts, "key", "n", "_row").select("_row", "start", "length", "set"), members


def contaminated(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, k: int = GRAM) -> DataFrame:
    """_row, n_hit (words in windows), n_items and items_sha256 of docs (_row, text) that are hit."""
    found, members = hits(docs, benchmark, span, k)
    rows = found.groupBy("_row").agg(F.array_sort(F.collect_set(F.struct("start", "length"))).alias("spans"), F.array_sort(F.collect_set("set")).alias("sets"))
    end = lambda x: x["start"] + x["length"]
    none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    more = lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), end(x) - F.greatest(x["start"], a["upto"]))).alias("n"), F.greatest(a["upto"], end(x)).alias("upto"))
    rows = common.written(rows.select("_row", "sets", F.aggregate("spans", none, more, lambda a: a["n"].cast("long")).alias("n_hit")), "hits")
    alike = rows.groupBy("sets").agg(F.count(F.lit(1)).alias("n"))
    each = alike.select("sets", "n", F.explode("sets").alias("set")).join(members, "set")
    names = each.groupBy("sets", "n").agg(F.array_sort(F.collect_set("item")).alias("items"))
    facts = names.select("sets", "n", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return common.spread_join(rows, common.written(facts, "facts"), "sets", "n", "_row").drop("sets", "n")


def decontaminated(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, k: int = GRAM) -> DataFrame:
    """The rows of docs that no window of the benchmark occurs in, with their own columns."""
    inner = common.numbered(docs)
    return inner.join(contaminated(inner.select("_row", "_doc.text"), benchmark, span, k).select("_row"), "_row", "left_anti").select("_doc.*")


def report(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, k: int = GRAM) -> DataFrame:
    """One row for each document, hit or not."""
    inner = common.numbered(docs)
    found = contaminated(inner.select("_row", "_doc.text"), benchmark, span, k)
    rows = inner.select("_row", "_doc.doc_id", F.size(common.words(F.col("_doc.text"))).cast("long").alias("n_words")).join(found, "_row", "left")
    number = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_hit", "n_items")]
    digest = F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256")
    return rows.select("doc_id", "n_words", *number, digest, (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))
