"""The whole way of a query: route, or retrieve, fuse, hydrate, rerank, score and diversify.

Queries come in batches as rows, and a single query is a batch of one. What the lanes find, and what
it scores, is written, a few hundred rows a query: later steps read either several times, and a plan that
repeated all before it would outgrow the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelgrid.functions import maths, text
from reelgrid.operators import catalog, diversity, fusion, lexical, profile, scoring, vectors
from reelgrid.sources.shared import written

from .router import answer, route
from .understanding import Understanding, Understood


@dataclass
class Catalogue:
    """The tables that queries read. postings, facts and idf are lexical.* of the corpus; written once, as an index."""

    movies: DataFrame
    stats: DataFrame
    postings: DataFrame
    facts: DataFrame
    idf: DataFrame
    rules: DataFrame | None = None
    cards: DataFrame | None = None
    genome_tags: DataFrame | None = None
    genome_scores: DataFrame | None = None
    dense: DataFrame | None = None


@dataclass
class Person:
    """One user's events, as tables with user_id."""

    affinity: DataFrame
    watched: DataFrame
    dealbreakers: DataFrame | None = None
    weights: dict[str, float] | None = None
    slider: float = 0.7


def retrieve(queries: DataFrame, c: Catalogue, lane: int = 100, top: int = 300, dense_queries: DataFrame | None = None) -> DataFrame:
    """query_id, movie_id with rrf_rank, rrf_score, lanes, lane_ranks. queries: query_id, text (and bm25 for the lexical lane alone)."""
    words = queries.select("query_id", F.col("bm25").alias("text")) if "bm25" in queries.columns else queries
    lanes = {"bm25": lexical.bm25(words, c.postings, c.facts, c.idf, lane).withColumnRenamed("doc_id", "item_id")}
    if c.genome_tags is not None and c.genome_scores is not None:
        lanes["genome"] = vectors.nearest_to_tags(vectors.tag_query(queries, c.genome_tags), c.genome_scores, lane)
    if dense_queries is not None and c.dense is not None:
        lanes["dense"] = vectors.nearest(dense_queries, c.dense, lane)
    return fusion.reciprocal_rank(lanes, top).withColumnRenamed("item_id", "movie_id")


def passages(candidates: DataFrame) -> DataFrame:
    have = set(candidates.columns)
    some = lambda c: F.col(c) if c in have else F.array().cast("array<string>")
    overview = F.col("overview") if "overview" in have else F.lit(None).cast("string")
    body = text.passage(F.col("title"), F.col("year"), some("directors"), some("actors"), F.col("genres"), some("themes"), some("top_tags"), overview)
    return candidates.select("query_id", F.col("movie_id").alias("item_id"), "query", body.alias("passage"))


def personalised(candidates: DataFrame, user: str, person: Person, terms: DataFrame) -> DataFrame:
    """candidates with profile_boost, is_watched and likes_era of the user."""
    rows = candidates.withColumn("user_id", F.lit(user).cast(dict(person.affinity.dtypes)["user_id"]))
    # all joins below ask for the user; tables of many users aren't shuffled for one
    mine = lambda df: None if df is None else df.filter(F.col("user_id") == F.lit(user))
    affinity = mine(person.affinity)
    boosts = profile.profile_boost(rows.select("user_id", "movie_id").distinct(), terms, affinity, mine(person.watched), mine(person.dealbreakers), person.weights)
    eras = affinity.filter((F.col("dimension") == "era") & (F.col("affinity") > 0)).select("user_id", F.col("key").alias("_era"), F.lit(True).alias("likes_era"))
    rows = rows.join(boosts, ["user_id", "movie_id"], "left").withColumn("_era", maths.era(F.col("year")))
    rows = rows.join(eras, ["user_id", "_era"], "left")
    return rows.withColumn("likes_era", F.coalesce("likes_era", F.lit(False))).drop("_era", "user_id")


def semantic(query: Understood, c: Catalogue, user: str, person: Person, top: int = 10, include_watched: bool = False, reranked=None) -> DataFrame:
    """query_id, movie_id, final_score and final_rank, with title. reranked: a function of passages; the lexical stand-in by default."""
    spark = c.movies.sparkSession
    asked = spark.createDataFrame([(0, query.expanded_query)], "query_id long, text string")
    hits = retrieve(asked, c)
    found = catalog.hydrate(hits, c.movies, c.stats, c.cards).withColumn("query", F.lit(query.raw_query))
    if "directors" in c.movies.columns and "directors" not in found.columns:
        found = found.join(c.movies.select("movie_id", *[x for x in ("directors", "top_tags", "collection") if x in c.movies.columns and x not in found.columns]), "movie_id", "left")
    found = written(found, "candidates")
    scores = (reranked or fusion.lexical_rerank)(passages(found))
    ready = fusion.with_rerank(found.withColumnRenamed("movie_id", "item_id"), scores).withColumnRenamed("item_id", "movie_id")
    terms = profile.movie_terms(ready.dropDuplicates(["movie_id"]))
    name, lang, country = query.nation or (None, None, None)
    mine = personalised(ready, user, person, terms).withColumns({
        "matched_genres": F.array(*[F.lit(g) for g in query.genres]).cast("array<string>"), "genre_strictness": F.lit(query.genre_strictness), "is_obscure": F.lit(query.is_obscure),
        "demonym_lang": F.lit(lang).cast("string"), "demonym_country": F.lit(country).cast("string"),
    })
    return chosen(written(scoring.semantic(mine, person.slider, include_watched), "scored"), top)


def chosen(scored: DataFrame, top: int) -> DataFrame:
    rows = scored if "collection" in scored.columns else scored.withColumn("collection", F.lit(None).cast("string"))
    best = diversity.diversified(rows, top)
    return best.join(rows.select("query_id", "movie_id", "title", "year", "profile_boost"), ["query_id", "movie_id"]).orderBy("query_id", "final_rank")


def direct(rows: DataFrame, user: str, person: Person, top: int) -> DataFrame:
    """A routed list with personal scores, diversified."""
    found = rows.withColumn("query_id", F.lit(0).cast("long"))
    order = [F.desc("lift"), F.desc("confidence")] if "lift" in found.columns else [F.desc("bayes")] if "bayes" in found.columns else [F.desc("avg_rating")]
    place = F.row_number().over(W.partitionBy("query_id").orderBy(*order, "movie_id"))  # a list of the router's limit
    found = found.withColumn("place", place).withColumns({c: F.lit(None).cast("double") for c in ("lift", "confidence") if c not in found.columns})
    mine = personalised(found, user, person, profile.movie_terms(found)).withColumn("user_id", F.lit(user))
    return chosen(written(scoring.fast_path(mine, person.slider), "scored"), top)


def search(query: str, c: Catalogue, user: str, person: Person, understanding: Understanding, top: int = 10, **limits) -> DataFrame:
    """Recommendations for a query: from a direct list if its wording asks for one, else through the semantic pipeline."""
    for r in route(c.movies.sparkSession, query):
        rows = answer(r, c.movies, c.stats, c.rules, **limits)
        if rows is not None:
            return direct(rows, user, person, top)
    return semantic(understanding.parse(query), c, user, person, top)
