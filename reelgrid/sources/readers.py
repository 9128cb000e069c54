"""Scans of the raw files into the catalogue's tables. Schemas are given, never inferred."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelgrid.functions import documents, maths, text
from reelgrid.operators import catalog

from . import schemas

# Concepts and the terms that widen a query about them, for want of a file.
CONCEPTS = {
    "dark magic": ["demons", "supernatural", "occult", "dark fantasy", "magic", "exorcism", "hell"],
    "magic": ["supernatural", "fantasy", "wizards", "sorcery", "magic"],
    "comic book": ["comic", "graphic novel", "superhero", "dc comics", "vertigo"],
    "comic": ["comic", "graphic novel", "superhero"],
    "dc": ["dc comics", "superhero", "constantine", "batman"],
    "marvel": ["marvel comics", "superhero"],
}


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file with a header; columns that aren't used are never parsed."""
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)


def jsonl(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """One object a line; blank and malformed lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def evolved(df: DataFrame, added: str) -> DataFrame:
    """df with the columns of `added` that it lacks, null."""
    have = {c.lower() for c in df.columns}
    more = {f.name: F.lit(None).cast(f.dataType) for f in T._parse_datatype_string(added) if f.name.lower() not in have}
    return df.withColumns(more) if more else df


def movies(spark: SparkSession, path: str) -> DataFrame:
    raw = csv(spark, path, schemas.MOVIES_CSV)
    return raw.select(F.col("movieId").alias("movie_id"), text.bare_title(F.col("title")).alias("title"), text.title_year(F.col("title")).alias("year"), text.genre_list(F.col("genres")).alias("genres"))


def links(spark: SparkSession, path: str) -> DataFrame:
    raw = csv(spark, path, schemas.LINKS_CSV)
    return raw.select(F.col("movieId").alias("movie_id"), text.imdb_id(F.col("imdbId")).alias("imdb_id"), F.col("tmdbId").alias("tmdb_id"))


def ratings(spark: SparkSession, path: str) -> DataFrame:
    raw = csv(spark, path, schemas.RATINGS_CSV)
    return raw.select(F.col("userId").cast("string").alias("user_id"), F.col("movieId").alias("movie_id"), "rating", F.col("timestamp").alias("rated_at"))


def user_tags(spark: SparkSession, path: str) -> DataFrame:
    raw = csv(spark, path, schemas.TAGS_CSV).filter(F.col("tag").isNotNull())
    return raw.select(F.col("userId").cast("string").alias("user_id"), F.col("movieId").alias("movie_id"), "tag", F.col("timestamp").alias("tagged_at"))


def genome(spark: SparkSession, tags: str, scores: str) -> tuple[DataFrame, DataFrame]:
    t = csv(spark, tags, schemas.GENOME_TAGS_CSV).select(F.col("tagId").alias("tag_id"), "tag")
    s = csv(spark, scores, schemas.GENOME_SCORES_CSV).select(F.col("movieId").alias("movie_id"), F.col("tagId").alias("tag_id"), "relevance")
    return t, s


def critic_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Title, year and scores of a critic site's list, with the variants of each title."""
    raw = csv(spark, path, schemas.CRITIC_CSV)
    return raw.select(
        F.col("movie_title").alias("title"), text.year_in(F.col("original_release_date")).alias("year"),
        maths.safe_double(F.col("tomatometer_rating")).alias("critic_score"), maths.safe_double(F.col("audience_rating")).alias("audience_score"),
        *[documents.list_field(F.col(c)).alias(n) for c, n in (("directors", "directors"), ("authors", "writers"), ("actors", "actors"))], "content_rating",
        text.title_variants(F.col("movie_title")).alias("variants"),
    )


def top_list(spark: SparkSession, path: str) -> DataFrame:
    raw = csv(spark, path, schemas.TOP_LIST_CSV)
    return raw.select("movie_id", "title", F.col("year").try_cast("int").alias("year"))


def wiki_texts(spark: SparkSession, path: str) -> DataFrame:
    raw = jsonl(spark, path, schemas.WIKI_JSON)
    return raw.select("movie_id", text.unescape_html(F.col("intro")).alias("wiki_intro"), text.unescape_html(F.col("plot")).alias("wiki_plot"))


def critic_reviews(spark: SparkSession, path: str, source: str) -> DataFrame:
    raw = jsonl(spark, path, schemas.CRITIC_REVIEWS_JSON)
    body = text.unescape_html(F.trim("review_text"))
    return review_rows(raw.select("movie_id", body.alias("review_text"), maths.safe_double(F.col("rating")).alias("score"), F.col("date_published").alias("review_date")), source, "critic")


def audience_reviews(spark: SparkSession, path: str, source: str) -> DataFrame:
    """The nested reviews of each item as rows."""
    raw = jsonl(spark, path, schemas.AUDIENCE_REVIEWS_JSON).select("movie_id", F.explode("reviews").alias("r"))
    body = text.review_text(text.unescape_html(F.col("r.summary")), text.unescape_html(F.col("r.text")))
    return review_rows(raw.select("movie_id", body.alias("review_text"), maths.safe_double(F.col("r.rating")).alias("score"), F.col("r.date").alias("review_date")), source, "audience")


def review_rows(rows: DataFrame, source: str, domain: str) -> DataFrame:
    kept = rows.filter(F.coalesce("review_text", F.lit("")) != "")
    return kept.select("movie_id", F.lit(None).cast("string").alias("user_id"), F.lit(source).alias("source"), F.lit(domain).alias("domain"), "review_text", "score", "review_date")


def scraped_credits(spark: SparkSession, path: str) -> DataFrame:
    return jsonl(spark, path, schemas.CREDITS_JSON)


def cards(spark: SparkSession, tiers: dict[str, str]) -> DataFrame:
    """Profile cards of several files (tier to path); of an item that several have, the last file's."""
    found = None
    for order, (tier, path) in enumerate(tiers.items()):
        some = jsonl(spark, path, schemas.CARD_JSON).filter(F.col("movie_id").isNotNull()).withColumn("_default", F.lit(tier)).withColumn("_order", F.lit(order))
        found = some if found is None else found.unionByName(some)
    return catalog.cards_with_tier(catalog.last_card(found, "_order")).drop("_order", "_default")


def card_ids(spark: SparkSession, path: str) -> DataFrame:
    return jsonl(spark, path, "movie_id long").filter(F.col("movie_id").isNotNull()).distinct()


def concept_map(path: str | None = None) -> dict[str, list[str]]:
    """Concepts of a JSON file, without keys that start with an underscore; the built-in ones if there is none."""
    try:
        raw = json.loads(Path(path).read_text(encoding="utf-8")) if path else CONCEPTS
    except (FileNotFoundError, json.JSONDecodeError):
        raw = CONCEPTS
    return {k: v for k, v in raw.items() if not k.startswith("_")}
