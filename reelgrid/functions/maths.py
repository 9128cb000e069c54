"""Scoring arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and levels of the personalisation slider.
LAMBDA_LEVELS = {"off": 0.0, "subtle": 0.25, "balanced": 0.5, "strong": 0.7, "maximum": 1.0}
#: Affinities stay in [-AFFINITY_LIMIT, AFFINITY_LIMIT].
AFFINITY_LIMIT = 3.0
#: The newest year of the catalogue, from which ages count.
NEWEST_YEAR = 2019


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def logistic(x: Column) -> Column:
    """1 / (1 + exp(-x)) without overflow on either side."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def boost_to_unit(boost: Column) -> Column:
    """A profile boost as a number in (0, 1): the logistic of half of it."""
    return logistic(boost / 2)


def rerank_to_unit(score: Column) -> Column:
    """A reranker's score: kept inside [0, 1], else squashed; 0.01 where there is none."""
    return F.when(score.isNull(), F.lit(0.01)).when((score >= 0) & (score <= 1), score).otherwise(logistic(score))


def bayes(mean: Column, n: Column, prior_n: float, prior_mean: float) -> Column:
    """A mean of n values drawn towards a prior worth prior_n values."""
    return (n * mean + F.lit(prior_n * prior_mean)) / (n + F.lit(prior_n))


def log_volume(n: Column, decades: float) -> Column:
    return F.least(F.lit(1.0), F.log10(n + 1) / decades)


def quality(bayes_mean: Column, volume: Column) -> Column:
    """Seventy parts rating, thirty parts volume."""
    return 0.70 * clamp((bayes_mean - 1) / 4, 0.0, 1.0) + 0.30 * volume


def rating_weight(mean: Column, obscure: Column) -> Column:
    """How much of its score an item with this mean rating keeps."""
    low = F.greatest(F.lit(0.0), (mean - 0.5) / 1.5)
    return F.when(obscure | (mean >= 3.5), F.lit(1.0)).when(mean >= 2.0, 0.75 + 0.25 * ((mean - 2.0) / 1.5)).otherwise(0.20 + 0.55 * F.pow(low, F.lit(1.5)))


def recency(year: Column, likes_era: Column, bayes_mean: Column) -> Column:
    """Newer items keep more; a liked era at least 0.95, the best rated at least 0.92."""
    age = F.greatest(F.lit(0), F.lit(NEWEST_YEAR) - year)
    base = 0.75 + 0.25 / (1 + F.pow(age / 25.0, F.lit(1.5)))
    base = F.when(likes_era, F.greatest(base, F.lit(0.95))).otherwise(base)
    return F.when(bayes_mean >= 4.2, F.greatest(base, F.lit(0.92))).otherwise(base)


def era(year: Column) -> Column:
    """The decade of a year as NNNNs."""
    return F.concat((F.floor(year / 10) * 10).cast("string"), F.lit("s"))


def grade(rating: Column) -> Column:
    """A star rating as a label from 1 to 10, halves rounded to even."""
    return F.greatest(F.lit(1), F.least(F.lit(10), F.bround(rating * 2).cast("int")))


def lambda_label(value: Column) -> Column:
    """The name of the nearest slider level, the lower one of two at the same distance."""
    ordered = F.array(*[F.struct(F.abs(value - v).alias("d"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, (k, v) in enumerate(LAMBDA_LEVELS.items())])
    return F.array_min(ordered)["k"]


def safe_double(text: Column) -> Column:
    return text.try_cast("double")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column, least: float = 1e-10) -> Column:
    """The vector divided by its length; null where that is below `least`."""
    # the length stands in an array of one, so that it is computed once and not for each component
    return F.element_at(F.transform(F.array(norm(a)), lambda n: F.when(n >= least, F.transform(a, lambda x: x.cast("double") / n))), 1)


def cosine(a: Column, b: Column) -> Column:
    return clamp(dot(unit(a), unit(b)), -1.0, 1.0)


def two_digits(x: Column) -> Column:
    """A value from 2^-7 to some millions with two digits behind the point, by the double's exact value, halves to the even digit."""
    whole = F.floor(x)
    part = ((x - whole) * float(1 << 60)).cast("long").cast("decimal(20,0)") * 100  # exact: a double's digits moved by a power of two
    one = F.lit(1 << 60).cast("decimal(20,0)")
    rest = part % one
    down = ((part - rest) / one).cast("long")
    up = (rest * 2 > one) | ((rest * 2 == one) & (down % 2 == 1))
    n = whole * 100 + down + up.cast("long")
    return F.concat(F.floor(n / 100).cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"))
