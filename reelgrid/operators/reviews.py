"""What reviews say about taste, without a language model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrid.functions import text

# Patterns of sarcasm and words of praise and blame.
SARCASM_PATTERNS = [
    r"\b(oh wow|oh great|oh sure|yeah right|just what i needed|real genius|brilliant strategy)\b",
    r"\b(nobody|everyone) (asked for|needed|wanted) this\b",
    r"\b(real|truly|absolutely) (masterpiece|genius|brilliant)\b",
]
POSITIVE_WORDS = ["incredible", "amazing", "great", "masterpiece", "genius", "stunning", "loved", "brilliant", "excellent", "good"]
NEGATIVE_WORDS = ["terrible", "awful", "boring", "slow", "horrible", "waste", "trash", "bad", "disappointing", "predictable"]
#: Weights of aspects in a review's overall stars, in the order they are asked.
ASPECT_WEIGHTS = (1.0, 0.8, 0.6)


def hits(low: Column, words: list[str]) -> Column:
    return sum((low.contains(w).cast("int") for w in words[1:]), low.contains(words[0]).cast("int"))


def sarcasm_risk(body: Column, stars: Column) -> Column:
    """From 0 to 1: how far the words contradict the stars, and known phrases; 0 for no text."""
    low = F.lower(F.coalesce(body, F.lit("")))
    good, bad = hits(low, POSITIVE_WORDS), hits(low, NEGATIVE_WORDS)
    tone = F.when(good + bad > 0, (good - bad) / (good + bad)).otherwise(0.0)
    phrases = sum((low.rlike(p).cast("int") for p in SARCASM_PATTERNS[1:]), low.rlike(SARCASM_PATTERNS[0]).cast("int"))
    risk = F.least(F.lit(1.0), 0.7 * F.abs((tone + 1) / 2 - (stars - 1) / 4) + 0.3 * phrases)
    return F.when(low == "", 0.0).otherwise(risk)


def with_confidence(reviews: DataFrame) -> DataFrame:
    """reviews (review_text, stars) with sarcasm_risk and confidence = max(0.1, 1 - risk)."""
    risk = F.round(sarcasm_risk(F.col("review_text"), F.col("stars")), 6)
    return reviews.withColumn("sarcasm_risk", risk).withColumn("confidence", F.round(F.greatest(F.lit(0.1), 1 - F.col("sarcasm_risk")), 6))


def grams(low: Column, n: int) -> Column:
    """The distinct runs of n characters."""
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - (n - 1), F.lit(1))), lambda i: low.substr(i, F.lit(n)))
    return F.when(F.length(low) >= n, F.array_distinct(runs))


def found_tags(reviews: DataFrame, tags: DataFrame) -> DataFrame:
    """review_id, tag of vocabulary tags that a review names: as a word, or anywhere if longer than four characters.

    Tags join on the review's words; a long one on that of its runs of five characters
    which the fewest tags have, and only what shares it is compared. So no review meets
    a tag of which it has nothing, and texts are sent once for each candidate at most.
    """
    least = 5
    low = F.lower(F.coalesce("review_text", F.lit("")))
    words = reviews.select("review_id", F.explode(text.letter_words(low)).alias("_w"))
    t = tags.select("tag", F.lower("tag").alias("_t"))
    exact = words.join(t, F.col("_w") == F.col("_t")).select("review_id", "tag")
    runs = t.select("tag", "_t", F.explode(grams(F.col("_t"), least)).alias("_g")).distinct()
    rare = runs.join(runs.groupBy("_g").agg(F.count(F.lit(1)).alias("_n")), "_g").groupBy("tag", "_t").agg(F.min(F.struct("_n", "_g"))["_g"].alias("_g"))
    met = reviews.select("review_id", F.explode(grams(low, least)).alias("_g")).join(rare, "_g").select("review_id", "tag", "_t").distinct()
    long = met.join(reviews.select("review_id", low.alias("_low")), "review_id").filter(F.col("_low").contains(F.col("_t"))).select("review_id", "tag")
    return exact.unionByName(long).distinct()


def aspect_score(answer: Column) -> tuple[Column, Column]:
    """Label and score of an answer of the form label:score."""
    return F.lower(F.trim(F.substring_index(answer, ":", 1))), F.substring_index(answer, ":", -1).try_cast("double")


def tag_changes(reviews: DataFrame, found: DataFrame, aspects: DataFrame) -> DataFrame:
    """review_id, user_id, tag and delta: 0.4 of the stars' weight for aspects that the user chose, else 0.3 times confidence for tags in the text."""
    r = with_confidence(reviews).select("review_id", "user_id", ((F.col("stars") - 3) / 2).alias("_w"), "confidence")
    chosen = aspects.select("review_id", F.lower(F.trim("aspect")).alias("tag")).filter("tag <> ''").distinct()
    named = found.select("review_id", F.lower(F.trim("tag")).alias("tag")).distinct().join(chosen, ["review_id", "tag"], "left_anti")
    a = chosen.join(r, "review_id").select("review_id", "user_id", "tag", F.round(F.col("_w") * 0.4, 6).alias("delta"))
    b = named.join(r, "review_id").select("review_id", "user_id", "tag", F.round(F.col("_w") * F.col("confidence") * 0.3, 6).alias("delta"))
    return a.unionByName(b)


def weighted_stars(answers: DataFrame) -> DataFrame:
    """review_id and its stars from answers (review_id, place from 0, score): a weighted mean to two digits, 3 without a score."""
    table = F.create_map(*[x for i, w in enumerate(ASPECT_WEIGHTS) for x in (F.lit(i), F.lit(w))])
    weight = F.coalesce(F.try_element_at(table, F.col("place").cast("int")), F.lit(0.0))
    known = F.when(F.col("score").isNotNull(), weight)
    return answers.groupBy("review_id").agg(F.round(F.coalesce(F.try_divide(F.sum(F.col("score") * known), F.sum(known)), F.lit(3.0)), 6).alias("stars"))
