"""A catalogue on disk: built from raw files in one batch, then searched and asked about users."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrid.functions.ordering import latest
from reelgrid.operators import account, lexical, profile, rules
from reelgrid.operators import ratings as R
from reelgrid.sources import readers, sinks

from . import recommend, understanding

TABLES = ["movies", "ratings", "user_tags", "movie_stats", "association_rules", "postings", "corpus_facts", "idf", "cards"]


def build(spark: SparkSession, root: str, movies: str, ratings: str, tags: str | None = None, cards: dict[str, str] | None = None, support: int = 200) -> None:
    """Write all tables under root from CSV files (and cards by tier), each published as a whole.

    Ratings and tags are ordered by user, so that a user's rows are read from few row groups.
    """

    def publish(df: DataFrame, name: str) -> DataFrame:
        sinks.publish(df, f"{root}/{name}")
        return spark.read.parquet(f"{root}/{name}")

    def by_user(df: DataFrame) -> DataFrame:
        return df.repartitionByRange("user_id").sortWithinPartitions("user_id")

    m = publish(readers.movies(spark, movies), "movies")
    r = publish(by_user(latest(readers.ratings(spark, ratings), ["user_id", "movie_id"], [F.col("rated_at"), F.col("rating")])), "ratings")
    none = spark.createDataFrame([], "user_id string, movie_id long, tag string, tagged_at long")
    t = publish(by_user(readers.user_tags(spark, tags)) if tags else none, "user_tags")
    publish(R.backfilled(R.with_popularity(R.movie_stats(r)), m), "movie_stats")
    publish(rules.association_rules(rules.likes(r, "movie_id"), min_support=support), "association_rules")
    c = publish(readers.cards(spark, cards), "cards") if cards else None
    index = publish(lexical.postings(texts(m, t, c)), "postings")
    facts = publish(lexical.corpus_facts(texts(m, t, c)), "corpus_facts")
    publish(lexical.inverse_frequencies(lexical.document_frequencies(index), facts), "idf")


def texts(movies: DataFrame, tags: DataFrame, cards: DataFrame | None) -> DataFrame:
    """doc_id and text of each movie: title, genres, the tags that users gave, and what its card says."""
    given = tags.groupBy("movie_id").agg(F.array_join(F.array_sort(F.collect_set("tag")), " ").alias("_tags"))
    rows = movies.join(given, "movie_id", "left")
    parts = ["title", F.array_join("genres", " "), "_tags"]
    if cards is not None:
        rows = rows.join(cards.select("movie_id", "overview", "wiki_intro", "directors", "actors", "keywords", "themes"), "movie_id", "left")
        parts += ["overview", "wiki_intro", *[F.array_join(c, " ") for c in ("directors", "actors", "keywords", "themes")]]
    return rows.select(F.col("movie_id").alias("doc_id"), F.concat_ws(" ", *parts).alias("text"))


class Library:
    """The tables under a root, and what can be asked of them."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root
        self.tables = {name: self._read(name) for name in TABLES}

    def _read(self, name: str) -> DataFrame | None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        there = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.parquet(f"{self.root}/{name}") if there else None

    def movies(self) -> DataFrame:
        """Movies with what their cards add."""
        cards = self.tables["cards"]
        if cards is None:
            return self.tables["movies"]
        more = [c for c in ("directors", "actors", "top_tags", "tone", "themes", "pacing", "original_language", "production_countries", "content_rating", "collection") if c in cards.columns]
        return self.tables["movies"].join(cards.select("movie_id", *more), "movie_id", "left")

    def catalogue(self) -> recommend.Catalogue:
        t = self.tables
        return recommend.Catalogue(self.movies(), t["movie_stats"], t["postings"], t["corpus_facts"], t["idf"], t["association_rules"], t["cards"])

    def affinity(self, user: str | None = None) -> DataFrame:
        rated, tagged = self.tables["ratings"], self.tables["user_tags"]
        if user is not None:
            rated, tagged = (x.filter(F.col("user_id") == user) for x in (rated, tagged))
        return profile.rated_affinities(rated, profile.movie_terms(self.movies()), tagged)

    def person(self, user: str, slider: float = 0.7, dealbreakers: list[str] | None = None) -> recommend.Person:
        seen = profile.watched(*(self.tables[n].filter(F.col("user_id") == user) for n in ("ratings", "user_tags")))
        bad = self.spark.createDataFrame([(user, d) for d in dealbreakers], "user_id string, dealbreaker string") if dealbreakers else None
        return recommend.Person(self.affinity(user), seen, bad, slider=slider)

    def search(self, query: str, user: str, top: int = 10, slider: float = 0.7, dealbreakers: list[str] | None = None, **limits) -> DataFrame:
        titles = understanding.titles_of(self.tables["movies"], self.tables["movie_stats"])
        rules_of = understanding.Understanding(titles, cards=self.tables["cards"])
        return recommend.search(query, self.catalogue(), user, self.person(user, slider, dealbreakers), rules_of, top, **limits)

    def summary(self, user: str) -> DataFrame:
        return account.summary(self.affinity(user), self.tables["ratings"].filter(F.col("user_id") == user))

    def health(self) -> DataFrame:
        return account.health(self.tables)
