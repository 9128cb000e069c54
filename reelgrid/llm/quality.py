"""Quality rules: learned decision lists over text statistics, as Spark expressions.

Statistics are computed inside each row by DataFrame functions; nothing is shuffled,
and a text of n words takes n log n steps. Rules are learned on the driver from the
statistics of at most SAMPLE labelled rows (those with the smallest hash of their id):
sequential covering grows a conjunction of thresholds by information gain on two
thirds of the rows, prunes its last conditions on the other third, keeps it if it is
right there often enough, takes out what it covers, and goes on. The rules come out
in order, as one conditional expression.

Defined results: a null or empty text has no words, zero statistics and fails the
base rule; rows of labels with a null id or another quality than 0 and 1 are ignored;
with one quality only, or without labels, there is no rule and the verdict is to keep.
Of repeated ids or labels the least quality and statistics are learned from, each row
gets its own verdict; an empty table gives no rows; a text of any length is read whole.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = r"[\x20\x09-\x0D]+"
WINDOW = 5
#: Labelled rows to learn from, thresholds tried for a statistic, and rules in a list.
SAMPLE = 20_000
THRESHOLDS = 48
RULES = 8
CONDITIONS = 4
#: A rule is kept if it is right so often, on so many rows, where it is pruned.
PRECISION = 0.9
COVERED = 5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once: a column used twice may be inlined, and so computed again, wherever a filter moves."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated(words: Column) -> Column:
    """Words in windows of WINDOW that are found twice or more."""

    def windows(hashes: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(hashes) - WINDOW)
        return F.when(F.size(hashes) >= WINDOW, F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))

    def places(pairs: Column) -> Column:
        # in hash order equal windows are neighbours
        near = lambda x, j: (F.get(pairs, j - 1)["h"] == x["h"]) | (F.get(pairs, j + 1)["h"] == x["h"])
        found = F.transform(pairs, lambda x, j: F.when(F.coalesce(near(x, j), F.lit(False)), x["i"]))
        return F.sort_array(F.filter(found, lambda i: i.isNotNull()))

    def covered_words(at: Column) -> Column:
        # each repeated window covers its words up to the next one
        parts = F.transform(at, lambda i, j: F.least(F.lit(WINDOW), F.coalesce(F.get(at, j + 1) - i, F.lit(WINDOW))))
        return F.aggregate(parts, F.lit(0).cast("long"), lambda s, x: s + x)

    def count(found: Column) -> Column:
        pairs = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        some = let(pairs, lambda p: let(places(p), covered_words))
        return F.when(F.size(F.array_distinct(found)) < F.size(found), some).otherwise(F.lit(0).cast("long"))

    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(windows(h), count))


def statistics(docs: DataFrame) -> DataFrame:
    """docs (own columns of these names and _w, _l are replaced) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_digits and n_marks."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    without = lambda pattern: (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")
    words = let(F.array_remove(F.split(text, BLANK), ""), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("chars"), repeated(w).alias("repeat")))
    lines = let(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    d = docs.withColumns({"_w": words, "_l": lines})
    return d.withColumns({
        "n_words": F.col("_w.n"), "word_chars": F.col("_w.chars"), "n_repeat_words": F.coalesce("_w.repeat", F.lit(0).cast("long")),
        "n_lines": F.col("_l.n"), "n_dup_lines": F.col("_l.dup"), "n_symbols": without("[#*$%&|<>]+"),
        "n_upper": without(r"\p{Lu}+"), "n_digits": without(r"\p{Nd}+"), "n_marks": without("[!?]+"),
    }).drop("_w", "_l")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def ratios() -> dict[str, Column]:
    """The statistics that rules are about."""
    part = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "n_words": F.col("n_words").cast("double"),
        "chars_per_word": part("word_chars", "n_words"),
        "symbols_per_word": part("n_symbols", "n_words"),
        "marks_per_word": part("n_marks", "n_words"),
        "dup_lines": part("n_dup_lines", "n_lines"),
        "repeat_words": part("n_repeat_words", "n_words"),
        "upper_chars": part("n_upper", "word_chars"),
        "digit_chars": part("n_digits", "word_chars"),
        "words_per_line": part("n_words", "n_lines"),
    }


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.name] > self.threshold if self.above else x[self.name] <= self.threshold

    def column(self) -> Column:
        value = ratios()[self.name]
        return value > self.threshold if self.above else value <= self.threshold


Rule = tuple[Condition, ...]


def covered(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(x)
    return out


def centred(c: Condition, values: np.ndarray) -> Condition:
    """The same condition on these values, with its threshold half way between those that it tells apart."""
    above = values > c.threshold
    if above.all() or not above.any():
        return c
    low, high = float(values[~above].max()), float(values[above].min())
    middle = float(f"{(low + high) / 2:.4g}")
    return Condition(c.name, c.above, middle) if low <= middle < high else c


def grow(x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Conditions, each with the largest information gain among the rows that the ones before it leave."""
    inside = np.ones(len(bad), bool)
    rule: list[Condition] = []
    while len(rule) < CONDITIONS:
        p, n = int((inside & bad).sum()), int((inside & ~bad).sum())
        if not p or not n:
            break
        best, gain = None, 1e-9
        for name, values in x.items():
            own, own_bad = values[inside], bad[inside]
            cuts = np.unique(np.quantile(own[own_bad], np.linspace(0, 1, THRESHOLDS)))
            for cut in {float(f"{c:.4g}") for c in cuts}:
                for above in (True, False):
                    chosen = own > cut if above else own <= cut
                    q = int((chosen & own_bad).sum())
                    m = int(chosen.sum()) - q
                    if q and (g := q * (np.log2(q / (q + m)) - np.log2(p / (p + n)))) > gain:
                        best, gain = Condition(name, above, cut), g
        if best is None:
            break
        best = centred(best, x[best.name][inside])
        rule.append(best)
        inside &= best.holds(x)
    return tuple(rule)


def prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The leading conditions with the best balance of covered bad and good rows; the fewest of equals."""

    def worth(k: int) -> float:
        c = covered(rule[:k], x, len(bad))
        p, n = int((c & bad).sum()), int((c & ~bad).sum())
        return (p - n) / (p + n) if p + n else -1.0

    return rule[: max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))] if rule else rule


def learn(x: dict[str, np.ndarray], bad: np.ndarray) -> list[Rule]:
    """An ordered list of conjunctions that say bad."""
    third = np.arange(len(bad)) % 3 == 2
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    while len(rules) < RULES:
        a, b = left & ~third, left & third
        if not bad[a].any() or bad[a].all():
            break
        rule = prune(grow({k: v[a] for k, v in x.items()}, bad[a]), {k: v[b] for k, v in x.items()}, bad[b])
        if not rule:
            break
        inside = covered(rule, x, len(bad)) & left
        p, n = int((inside & b & bad).sum()), int((inside & b & ~bad).sum())
        if p + n < COVERED or p < PRECISION * (p + n):
            break
        rules.append(rule)
        left &= ~inside
    return rules


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """Rules from the labelled rows of docs."""
    known = labels.select(F.col("doc_id").alias("_id"), "quality").filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    chosen = known.orderBy(F.xxhash64("_id"), "_id", "quality").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    # of rows or labels with one id, the least
    found = statistics(rows).groupBy("_id").agg(F.min(F.struct("quality", *[v.alias(f"_{k}") for k, v in ratios().items()])).alias("_x")).select("_id", "_x.*")
    got = sorted(found.collect())  # sample rows at most
    names = list(ratios())
    x = {k: np.array([r[i + 2] for r in got], float) for i, k in enumerate(names)}
    return learn(x, np.array([r[1] == 0 for r in got], bool))


def verdict(rules: list[Rule]) -> Column:
    """False where the first rule that holds says bad; true where none holds."""
    out = None
    for rule in rules:
        holds = F.lit(True)
        for c in rule:
            holds = holds & c.column()
        out = F.when(holds, False) if out is None else out.when(holds, False)
    return F.lit(True) if out is None else out.otherwise(True)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rules = fit(docs, labels)
    rows = statistics(docs.select("doc_id", "text")).withColumn("base_failed", base_failed())
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & verdict(rules)).alias("kept")
    )
