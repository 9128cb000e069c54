"""User profiles as folds over events; nothing is mutated.

An event is (user_id, ts, kind, place, dimension, key, weight): one affinity change.
kind orders changes of the same second (ratings before tags), place breaks ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelgrid.functions import maths, text

from . import folds

# How much each dimension counts in a boost.
WEIGHTS = {"actor": 0.50, "director": 0.80, "genre": 0.60, "tone": 0.40, "tag": 0.90, "pacing": 0.75, "era": 0.30, "language": 0.50, "country": 0.40, "content_rating": 0.30}
#: Dimensions whose weight is halved until a user has met a key so often.
GATED, SURE = ("actor", "director"), 3
TAG_EVENT = 0.3
VETO = -10.0

#: Dimension to the column of a movie that has its keys, a list or a single value.
LISTS = {"genre": "genres", "tone": "tone", "theme": "themes", "tag": "top_tags", "country": "production_countries", "actor": "actors", "director": "directors"}
#: Dimensions that can break a deal but are no taste.
CONTENT_ONLY = ("theme",)
SINGLE = {"pacing": "pacing", "language": "original_language", "content_rating": "content_rating"}


def labelled(keys: Column, dimension: str) -> Column:
    return F.transform(keys, lambda x: F.struct(F.lit(dimension).alias("dimension"), x.alias("key")))


def movie_terms(movies: DataFrame) -> DataFrame:
    """movie_id, dimension and key of all that a profile can like or refuse about a movie; a key that a movie lists twice counts twice.

    Joined by merging: a size estimated from movies' files leaves out what lists are exploded to, and a
    broadcast chosen by it would go whole through the driver.
    """
    parts = []
    for dimension, column in LISTS.items():
        if column in movies.columns:
            keys = F.filter(F.col(column), lambda x: x.isNotNull() & (x != ""))
            parts.append(labelled(F.array_distinct(keys) if dimension == "actor" else keys, dimension))
    for dimension, column in SINGLE.items():
        if column in movies.columns:
            parts.append(F.array(F.struct(F.lit(dimension).alias("dimension"), F.nullif(F.col(column), F.lit("")).alias("key"))))
    if "year" in movies.columns:
        parts.append(F.array(F.struct(F.lit("era").alias("dimension"), maths.era(F.nullif(F.col("year"), F.lit(0))).alias("key"))))
    rows = movies.select("movie_id", F.explode(F.flatten(F.array(*[F.coalesce(p, F.array().cast("array<struct<dimension:string,key:string>>")) for p in parts]))).alias("t"))
    return rows.select("movie_id", "t.dimension", "t.key").filter(F.col("key").isNotNull()).hint("merge")


def rating_changes(ratings: DataFrame) -> DataFrame:
    """user_id, movie_id, ts and the weight of ratings (user_id, movie_id, rating, rated_at; confidence if there is such a column)."""
    sure = F.col("confidence") if "confidence" in ratings.columns else F.lit(1.0)
    return ratings.select("user_id", "movie_id", F.col("rated_at").alias("ts"), ((F.col("rating") - 3.0) / 2.0 * sure).alias("weight"))


def liked_terms(terms: DataFrame) -> DataFrame:
    return terms.filter(~F.col("dimension").isin(*CONTENT_ONLY))


def rating_events(ratings: DataFrame, terms: DataFrame) -> DataFrame:
    """Affinity changes of ratings (user_id, movie_id, rating, rated_at; confidence if there is such a column)."""
    rows = rating_changes(ratings).join(liked_terms(terms), "movie_id")
    return rows.select("user_id", "ts", F.lit(0).alias("kind"), F.col("movie_id").cast("string").alias("place"), "dimension", "key", "weight")


def rated_lists(ratings: DataFrame, terms: DataFrame) -> DataFrame:
    """rating_events(), one row for each rating with its movie's terms as a list."""
    lists = liked_terms(terms).groupBy("movie_id").agg(F.collect_list(F.struct("dimension", "key")).alias("terms")).hint("merge")
    return rating_changes(ratings).join(lists, "movie_id").select("user_id", "ts", F.lit(0).alias("kind"), F.col("movie_id").cast("string").alias("place"), "weight", "terms")


def tag_events(tags: DataFrame) -> DataFrame:
    """Affinity changes of tags that users gave (user_id, movie_id, tag, tagged_at)."""
    place = F.concat_ws("\0", F.col("movie_id").cast("string"), "tag")
    return tags.select("user_id", F.col("tagged_at").alias("ts"), F.lit(1).alias("kind"), place.alias("place"), F.lit("tag").alias("dimension"), F.col("tag").alias("key"), F.lit(TAG_EVENT).alias("weight"))


def seed_events(seeds: DataFrame) -> DataFrame:
    """Changes of a first questionnaire (user_id, genres, eras, languages): 0.8 each, before everything else; only NNNNs are eras.

    A genre counts as met three times, so two changes of nothing come with it.
    """
    lists = [("genre", F.col("genres")), ("era", F.filter("eras", lambda x: x.rlike(r"^\d{4}s$"))), ("language", F.col("languages"))]
    each = [labelled(F.coalesce(c, F.array().cast("array<string>")), d) for d, c in lists]
    rows = seeds.select("user_id", F.explode(F.concat(*each)).alias("t"))
    weights = F.when(F.col("t.dimension") == "genre", F.array(F.lit(0.8), F.lit(0.0), F.lit(0.0))).otherwise(F.array(F.lit(0.8)))
    return rows.select("user_id", F.lit(0).cast("long").alias("ts"), F.lit(-1).alias("kind"), F.lit("").alias("place"), "t.dimension", "t.key", F.explode(weights).alias("weight"))


def until(events: DataFrame, cutoffs: DataFrame, ts: str = "ts") -> DataFrame:
    """Events no later than their user's cutoff_ts."""
    return events.join(cutoffs, "user_id").filter(F.col(ts) <= F.col("cutoff_ts")).drop("cutoff_ts")


def affinities(events: DataFrame, most: int | None = None) -> DataFrame:
    """user_id, dimension, key, affinity and confidence (number of changes). A long history of one user with one key is folded in pieces."""
    limit = maths.AFFINITY_LIMIT
    sums = folds.clamped_sum(events, ["user_id", "dimension", "key"], ["ts", "kind", "place"], "weight", -limit, limit, most=most)
    return sums.select("user_id", "dimension", "key", F.round("value", 6).alias("affinity"), F.col("n").alias("confidence"))


def rated_affinities(ratings: DataFrame, terms: DataFrame, tags: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """affinities() of rating_events(ratings, terms), and of tag_events(tags) if there are any.

    A rating is shuffled once with its movie's terms as a list, not once for each of them. Users with more than
    most changes go through the events.
    """
    limit = maths.AFFINITY_LIMIT
    who = ratings.select("user_id") if tags is None else ratings.select("user_id").unionByName(tags.select("user_id"))
    sizes = who.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    total, largest = sizes.agg(F.sum("n"), F.max("n")).first()
    most = most or folds.most_whole(ratings, total)

    def listed(r: DataFrame, t: DataFrame | None) -> DataFrame:
        rows = rated_lists(r, terms)
        if t is not None:
            rows = rows.unionByName(tag_events(t).select("user_id", "ts", "kind", "place", "weight", F.array(F.struct("dimension", "key")).alias("terms")))
        sums = folds.clamped_lists(rows, ["user_id"], "terms", ["ts", "kind", "place"], "weight", -limit, limit)
        return sums.select("user_id", "dimension", "key", F.round("value", 6).alias("affinity"), F.col("n").alias("confidence"))

    if (largest or 0) <= most:
        return listed(ratings, tags)
    hot = F.broadcast(sizes.filter(F.col("n") > most).select(F.col("user_id").alias("_hot")))  # a share of a partition each, so few
    part = lambda df, how: None if df is None else df.join(hot, F.col("user_id").eqNullSafe(F.col("_hot")), how)
    events = rating_events(part(ratings, "left_semi"), terms)
    if tags is not None:
        events = events.unionByName(tag_events(part(tags, "left_semi")))
    return listed(part(ratings, "left_anti"), part(tags, "left_anti")).unionByName(affinities(events))


def running_affinities(events: DataFrame) -> DataFrame:
    """events with the affinity after each of them; a history of any length is dealt over tasks."""
    limit = maths.AFFINITY_LIMIT
    rows = folds.running_clamped(events, ["user_id", "dimension", "key"], ["ts", "kind", "place", "weight"], "weight", -limit, limit, "affinity")
    return rows.withColumn("affinity", F.round("affinity", 6))


def rated_running(ratings: DataFrame, terms: DataFrame, most: int = folds.WHOLE) -> DataFrame:
    """running_affinities() of rating_events(ratings, terms), without kind and weight.

    As in rated_affinities(), a rating travels with its movie's terms as a list. Users with more than most ratings go through the events.
    """
    limit = maths.AFFINITY_LIMIT
    order = ["ts", "kind", "place"]

    def listed(r: DataFrame) -> DataFrame:
        sums = folds.running_lists(rated_lists(r, terms), ["user_id"], "terms", order, "weight", -limit, limit, "affinity")
        return sums.withColumn("affinity", F.round("affinity", 6)).select(*kept)

    kept = ["user_id", "ts", "place", "dimension", "key", "affinity"]
    sizes = ratings.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    if (sizes.agg(F.max("n")).first()[0] or 0) <= most:
        return listed(ratings)
    long = sizes.filter(F.col("n") > most).select(F.col("user_id").alias("_long"))
    part = lambda how: ratings.join(long, F.col("user_id").eqNullSafe(F.col("_long")), how)
    return listed(part("left_anti")).unionByName(running_affinities(rating_events(part("left_semi"), terms)).select(*kept))


def rating_sets(ratings: DataFrame) -> DataFrame:
    """user_id with what they watched, liked (4 or more) and disliked (2 or less), sorted."""
    return ratings.groupBy("user_id").agg(
        F.array_sort(F.collect_set("movie_id")).alias("watched"),
        F.array_sort(F.collect_set(F.when(F.col("rating") >= 4.0, F.col("movie_id")))).alias("highly_rated"),
        F.array_sort(F.collect_set(F.when(F.col("rating") <= 2.0, F.col("movie_id")))).alias("poorly_rated"),
    )


def taste(ratings: DataFrame, affinity: DataFrame) -> DataFrame:
    """user_id, n_watched, confidence = min(1, watched / 50) and exploration = min(1, genres / max(1, 0.3 watched)) from 5 watched on."""
    watched = ratings.groupBy("user_id").agg(F.countDistinct("movie_id").alias("n_watched"))
    genres = affinity.filter("dimension = 'genre'").groupBy("user_id").agg(F.count(F.lit(1)).alias("_g"))
    n, g = F.col("n_watched"), F.coalesce("_g", F.lit(0))
    explored = F.when(n >= 5, F.least(F.lit(1.0), g / F.greatest(F.lit(1.0), 0.3 * n))).otherwise(0.0)
    return watched.join(genres, "user_id", "left").select("user_id", "n_watched", F.round(F.least(F.lit(1.0), n / 50), 6).alias("confidence"), F.round(explored, 6).alias("exploration"))


def franchise_tolerance(rated: DataFrame, start: float = 0.5, step: float = 0.03) -> DataFrame:
    """user_id and tolerance after ratings of movies with a collection, in order, within [0, 1]."""
    move = F.when(F.col("rating") >= 4.0, step).when(F.col("rating") <= 2.0, -step).otherwise(0.0)
    rows = rated.filter(F.coalesce("collection", F.lit("")) != "").select("user_id", "rated_at", "movie_id", move.alias("w"))
    sums = folds.clamped_sum(rows, ["user_id"], ["rated_at", "movie_id"], "w", 0.0, 1.0, start)
    return sums.select("user_id", F.round("value", 6).alias("franchise_tolerance"))


def clamped_weights(weights: dict[str, float]) -> dict[str, float]:
    """Weights that a user has set, each inside 0 and 1."""
    return {k: min(1.0, max(0.0, v)) for k, v in weights.items()}


def boost_of(weights: dict[str, float] | None = None) -> Column:
    """affinity times its dimension's weight, halved for a key that is not sure yet."""
    w = WEIGHTS | (weights or {})
    if weights and "language" in weights and "country" not in weights:
        w["country"] = 0.8 * w["language"]
    table = F.create_map(*[x for k, v in w.items() for x in (F.lit(k), F.lit(v))])
    gate = F.when(F.col("dimension").isin(*GATED) & (F.col("confidence") < SURE), 0.5).otherwise(1.0)
    return F.col("affinity") * F.element_at(table, F.col("dimension")) * gate


def weighted_terms(candidates: DataFrame, terms: DataFrame, affinity: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """user_id, movie_id, dimension and boost of each key of a candidate that the user has an affinity to: that times weight, halved for a key that is not sure yet."""
    pairs = candidates.select("user_id", "movie_id").join(terms, "movie_id").join(affinity, ["user_id", "dimension", "key"])
    return pairs.select("user_id", "movie_id", "dimension", boost_of(weights).alias("boost"))


def term_boosts(candidates: DataFrame, terms: DataFrame, affinity: DataFrame, weights: dict[str, float] | None = None, most: int = folds.WHOLE) -> DataFrame:
    """user_id, movie_id, dimension and the sum of its keys' boosts.

    affinity: one row for each user, dimension and key, to be read twice. A candidate is shuffled once with its movie's
    terms as a list, not once for each of them, and looks them up in its user's affinities. Users with
    more than most of those are joined term by term.
    """
    sizes = affinity.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    if (sizes.agg(F.max("n")).first()[0] or 0) <= most:
        found = looked_up(candidates, terms, affinity, weights)
    else:
        long = sizes.filter(F.col("n") > most).select("user_id")
        apart = lambda how: (candidates.join(long, "user_id", how), affinity.join(long, "user_id", how))
        (few, short), (many, rest) = apart("left_anti"), apart("left_semi")
        found = looked_up(few, terms, short, weights).unionByName(weighted_terms(many, terms, rest, weights))
    return found.groupBy("user_id", "movie_id", "dimension").agg(F.sum("boost").alias("boost"))


def looked_up(candidates: DataFrame, terms: DataFrame, affinity: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """user_id, movie_id, dimension and boost, a row for each dimension in which the user has an affinity to a key of the candidate: the sum over such keys. A user's affinities meet in one row."""
    keys = terms.groupBy("movie_id", "dimension").agg(F.collect_list("key").alias("keys"))
    lists = keys.groupBy("movie_id").agg(F.collect_list(F.struct("dimension", "keys")).alias("terms")).hint("merge")
    liked = affinity.select("user_id", "dimension", "key", boost_of(weights).alias("boost")).filter(F.col("boost").isNotNull())
    whole = liked.groupBy("user_id").agg(F.collect_list(F.struct("dimension", "key", "boost")).alias("all"))
    entries = lambda d: F.transform(F.filter("all", lambda x: x["dimension"] == d), lambda x: F.struct(x["key"], x["boost"]))
    dimensions = F.array_distinct(F.transform("all", lambda x: x["dimension"]))
    known = whole.select("user_id", F.map_from_entries(F.transform(dimensions, lambda d: F.struct(d, F.map_from_entries(entries(d))))).alias("known")).hint("merge")
    met = candidates.select("user_id", "movie_id").join(lists, "movie_id").join(known, "user_id")

    def values(t: Column) -> Column:
        of = F.try_element_at("known", t["dimension"])
        return F.struct(t["dimension"].alias("dimension"), F.filter(F.transform(t["keys"], lambda k: F.try_element_at(of, k)), lambda x: x.isNotNull()).alias("found"))

    sums = F.transform(F.filter(F.transform("terms", values), lambda x: F.size(x["found"]) > 0), lambda x: F.struct(x["dimension"].alias("dimension"), F.aggregate(x["found"], F.lit(0.0), lambda a, b: a + b).alias("boost")))
    return met.select("user_id", "movie_id", F.inline(sums))


def profile_boost(candidates: DataFrame, terms: DataFrame, affinity: DataFrame, watched: DataFrame, dealbreakers: DataFrame | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """candidates (user_id, movie_id) with profile_boost: -10 for what is watched or holds a dealbreaker, else the sum over dimensions; and is_watched.

    watched: user_id, movie_id. dealbreakers: user_id, dealbreaker. Candidates, boosts and
    vetoes meet in one aggregation.
    """
    broken = None if dealbreakers is None else dealbroken(candidates, terms, dealbreakers)
    found = met_boosts(candidates, weighted_terms(candidates, terms, affinity, weights), watched, broken)
    more = [c for c in candidates.columns if c not in ("user_id", "movie_id")]
    return candidates.join(found, ["user_id", "movie_id"]) if more else found


def shared_boosts(users: DataFrame, lists: DataFrame, list_of: Column, terms: DataFrame, affinity: DataFrame, watched: DataFrame) -> DataFrame:
    """profile_boost() of users (user_id) who share few lists of candidates, lists (list_id, movie_id), small enough to be broadcast.

    list_of: a user's list_id, by columns of user_id. An affinity meets the candidates that it concerns where it
    is; no pair of user and candidate is shuffled once a term.
    """
    listed = F.broadcast(lists.join(terms, "movie_id").select("list_id", "movie_id", "dimension", "key"))
    boosts = affinity.withColumn("list_id", list_of).join(listed, ["list_id", "dimension", "key"]).select("user_id", "movie_id", boost_of().alias("boost"))
    candidates = users.select("user_id", list_of.alias("list_id")).join(F.broadcast(lists), "list_id").select("user_id", "movie_id")
    seen = watched.withColumn("list_id", list_of).join(F.broadcast(lists), ["list_id", "movie_id"], "left_semi")
    return met_boosts(candidates, boosts, seen)


def met_boosts(candidates: DataFrame, boosts: DataFrame, watched: DataFrame, broken: DataFrame | None = None) -> DataFrame:
    """candidates with profile_boost and is_watched: boosts (user_id, movie_id, boost) summed, and vetoes."""
    zero, no, yes = F.lit(0.0), F.lit(False), F.lit(True)

    def part(df: DataFrame, boost: Column, seen: Column, broken: Column, asked: Column) -> DataFrame:
        return df.select("user_id", "movie_id", boost.alias("_boost"), seen.alias("_seen"), broken.alias("_broken"), asked.alias("_asked"))

    rows = part(candidates, zero, no, no, yes).unionByName(part(boosts, F.col("boost"), no, no, no)).unionByName(part(watched, zero, yes, no, no))
    if broken is not None:
        rows = rows.unionByName(part(broken, zero, no, yes, no))
    met = rows.groupBy("user_id", "movie_id").agg(F.sum("_boost").alias("_boost"), F.max("_seen").alias("is_watched"), F.max("_broken").alias("_broken"), F.max("_asked").alias("_asked")).filter("_asked")
    score = F.when(F.col("is_watched") | F.col("_broken"), F.lit(VETO)).otherwise(F.round("_boost", 6))
    return met.select("user_id", "movie_id", score.alias("profile_boost"), "is_watched")


def dealbroken(candidates: DataFrame, terms: DataFrame, dealbreakers: DataFrame) -> DataFrame:
    """user_id, movie_id of candidates with a genre, tone, theme, tag or pacing that is or holds (as words) a dealbreaker of the user."""
    content = terms.filter(F.col("dimension").isin("genre", "tone", "theme", "tag", "pacing")).select("movie_id", F.lower(F.trim("key")).alias("_term"))
    terms_of = dealbreakers.select("user_id", F.lower(F.trim("dealbreaker")).alias("_bad")).filter("_bad <> ''")
    rows = candidates.select("user_id", "movie_id").join(terms_of, "user_id").join(content, "movie_id")
    return rows.filter((F.col("_term") == F.col("_bad")) | text.has_word(F.col("_term"), F.col("_bad"))).select("user_id", "movie_id").distinct()


def top_affinities(affinity: DataFrame, dimension: str, n: int = 5) -> DataFrame:
    best = W.partitionBy("user_id").orderBy(F.desc("affinity"), "key")
    rows = affinity.filter(F.col("dimension") == dimension).withColumn("rank", F.row_number().over(best).cast("long"))
    return rows.filter(F.col("rank") <= n).select("user_id", "rank", "key", "affinity")


def watchlist(added: DataFrame, ratings: DataFrame) -> DataFrame:
    """user_id, movie_id of additions (added_at) that no later rating has taken off."""
    rated = ratings.groupBy("user_id", "movie_id").agg(F.max("rated_at").alias("_at"))
    rows = added.groupBy("user_id", "movie_id").agg(F.max("added_at").alias("added_at")).join(rated, ["user_id", "movie_id"], "left")
    return rows.filter(F.col("_at").isNull() | (F.col("_at") < F.col("added_at"))).select("user_id", "movie_id")


def watched(ratings: DataFrame, tags: DataFrame | None = None, abandoned: DataFrame | None = None, cleared: DataFrame | None = None) -> DataFrame:
    """user_id, movie_id of all that was rated, tagged or given up after the user last cleared (cleared_at) their history."""
    parts = [ratings.select("user_id", "movie_id", F.col("rated_at").alias("ts"))]
    if tags is not None:
        parts.append(tags.select("user_id", "movie_id", F.col("tagged_at").alias("ts")))
    if abandoned is not None:
        parts.append(abandoned.select("user_id", "movie_id", F.col("abandoned_at").alias("ts")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    if cleared is not None:
        last = cleared.groupBy("user_id").agg(F.max("cleared_at").alias("_c"))
        rows = rows.join(last, "user_id", "left").filter(F.col("_c").isNull() | (F.col("ts") > F.col("_c")))
    return rows.select("user_id", "movie_id").distinct()


def recent_queries(queries: DataFrame, cleared: DataFrame | None = None, disabled: DataFrame | None = None, n: int = 50) -> DataFrame:
    """user_id, query, asked_at and place of the last n queries since the history was cleared; none of users who turned recording off."""
    rows = queries
    if cleared is not None:
        last = cleared.groupBy("user_id").agg(F.max("cleared_at").alias("_c"))
        rows = rows.join(last, "user_id", "left").filter(F.col("_c").isNull() | (F.col("asked_at") > F.col("_c"))).drop("_c")
    if disabled is not None:
        rows = rows.join(disabled.select("user_id").distinct(), "user_id", "left_anti")
    last = W.partitionBy("user_id").orderBy(F.desc("asked_at"), F.desc("query"))
    return rows.withColumn("place", F.row_number().over(last)).filter(F.col("place") <= n)
