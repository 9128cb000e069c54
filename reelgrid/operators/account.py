"""What belongs to an account besides taste: first steps, notes, switches, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelgrid.functions import maths, text

MATCHES = 3
ANCHOR_TAGS = 5
# Levels that a signal can have.
SIGNAL_LEVELS = ["off", "light", "balanced", "strong"]


def anchors(wanted: DataFrame, movies: DataFrame) -> DataFrame:
    """user_id, token, movie_id and n_matches (3 at most) of comma-separated favourites (user_id, raw).

    A token of digits is an id; another is sought in titles, and the smallest id of the
    matches counts. movie_id is null, and n_matches 0, where nothing matches.
    """
    tokens = wanted.select("user_id", F.explode(F.transform(F.split("raw", ","), lambda x: F.trim(x))).alias("token")).filter("token <> ''").distinct()
    ids = tokens.filter(F.col("token").rlike(r"^\d+$")).select("user_id", "token", F.col("token").cast("long").alias("movie_id"), F.lit(1).cast("long").alias("n_matches"))
    names = tokens.filter(~F.col("token").rlike(r"^\d+$"))
    asked = names.select(F.lower("token").alias("_low")).distinct()
    # a questionnaire's titles against all movies
    found = movies.join(asked, F.lower("title").contains(F.col("_low"))).groupBy("_low").agg(F.min("movie_id").alias("movie_id"), F.least(F.count(F.lit(1)), F.lit(MATCHES)).alias("n_matches"))
    named = names.join(found, F.lower("token") == F.col("_low"), "left").select("user_id", "token", "movie_id", F.coalesce("n_matches", F.lit(0)).alias("n_matches"))
    return ids.unionByName(named)


def anchor_events(resolved: DataFrame, movies: DataFrame, at: int) -> tuple[DataFrame, DataFrame]:
    """Ratings of five stars and tags (five at most of each movie) that a user's favourites stand for, at one moment."""
    known = resolved.filter(F.col("movie_id").isNotNull()).select("user_id", "movie_id").distinct()
    ratings = known.select("user_id", "movie_id", F.lit(5.0).alias("rating"), F.lit(at).cast("long").alias("rated_at"))
    tags = known.join(movies.select("movie_id", F.explode(F.slice("top_tags", 1, ANCHOR_TAGS)).alias("tag")), "movie_id").filter(F.trim("tag") != "")
    return ratings, tags.select("user_id", "movie_id", F.trim("tag").alias("tag"), F.lit(at).cast("long").alias("tagged_at"))


def merged_dealbreakers(own: DataFrame, said: DataFrame) -> DataFrame:
    """user_id, dealbreaker of both, without a leading `no`, once each. said: user_id, raw (comma-separated)."""
    more = said.select("user_id", F.explode(text.dealbreakers(F.lower("raw"))).alias("dealbreaker"))
    return own.select("user_id", "dealbreaker").unionByName(more).distinct()


def memory_entries(log: DataFrame) -> DataFrame:
    """user_id, entry that stand after a log of (user_id, at, action, entry): add, delete, or clear."""
    cleared = log.filter("action = 'clear'").groupBy("user_id").agg(F.max("at").alias("_c"))
    rows = log.filter("action <> 'clear'").join(cleared, "user_id", "left").filter(F.col("_c").isNull() | (F.col("at") > F.col("_c")))
    last = rows.groupBy("user_id", "entry").agg(F.max_by("action", "at").alias("action"))
    return last.filter("action = 'add'").select("user_id", "entry")


def signals(log: DataFrame) -> DataFrame:
    """user_id, signal, level: the last known level of each signal in a log of (user_id, at, signal, level)."""
    known = log.filter(F.col("level").isin(SIGNAL_LEVELS))
    return known.groupBy("user_id", "signal").agg(F.max_by("level", "at").alias("level"))


def corrections(log: DataFrame, new: DataFrame) -> DataFrame:
    """An append-only log of (user_id, movie_id, title, reason, at)."""
    return log.unionByName(new)


def service_changes(answers: DataFrame, movies: DataFrame) -> DataFrame:
    """Affinity changes from a review service's answers, as events of profile.affinities.

    answers: user_id, movie_id, ts, stars, sarcasm, sentiment, liked, disliked, tags,
    chosen (lists), director_sentiment, actors. Of several words on one aspect the first
    kind counts: chosen, liked, disliked, tags. A sarcastic review has a fifth of the weight.
    """
    weight, sure = (F.col("stars") - 3) / 2, F.when(F.col("sarcasm"), 0.2).otherwise(1.0)
    d = answers.withColumns({"_sure": sure, "_feel": F.coalesce("sentiment", weight)})
    kinds = [("chosen", weight * 0.5 * F.col("_sure")), ("liked", F.col("_sure") * 0.4), ("disliked", F.col("_sure") * -0.4), ("tags", F.col("_feel") * 0.3 * F.col("_sure"))]
    none = F.array().cast("array<string>")

    def entries(name: str, place: int, delta):
        return F.transform(F.coalesce(name, none), lambda x: F.struct(F.lit(place).alias("p"), F.lower(F.trim(x)).alias("key"), delta.alias("weight")))

    # an answer's later words on an aspect are dropped in its row, before they are sorted with all others
    said = d.select("user_id", "movie_id", "ts", F.filter(F.concat(*[entries(n, i, w) for i, (n, w) in enumerate(kinds)]), lambda x: x["key"] != "").alias("said"))
    once = F.filter("said", lambda x, i: F.array_position(F.transform("said", lambda y: y["key"]), x["key"]) == i + 1)
    words = said.select("user_id", "movie_id", "ts", F.explode(once).alias("e")).select("user_id", "movie_id", "ts", "e.*")
    first = words.groupBy("user_id", "movie_id", "ts", "key").agg(F.min_by("weight", "p").alias("weight")).withColumn("dimension", F.lit("tag"))
    people = d.filter(F.col("director_sentiment").isNotNull()).join(movies.select("movie_id", F.explode(F.array_distinct("directors")).alias("key")), "movie_id")
    directors = people.select("user_id", "movie_id", "ts", "key", (F.col("director_sentiment") * 0.8 * F.col("_sure")).alias("weight"), F.lit("director").alias("dimension"))
    actors = d.select("user_id", "movie_id", "ts", F.explode(F.array_distinct(F.coalesce("actors", none))).alias("key"), (F.col("_feel") * 0.5 * F.col("_sure")).alias("weight"), F.lit("actor").alias("dimension"))
    rows = first.unionByName(directors).unionByName(actors)
    return rows.select("user_id", "ts", F.lit(2).alias("kind"), F.col("movie_id").cast("string").alias("place"), "dimension", "key", "weight")


def summary(affinity: DataFrame, ratings: DataFrame, n: int = 5) -> DataFrame:
    """user_id, n_rated and its first genres and directors, for showing."""
    best = W.partitionBy("user_id", "dimension").orderBy(F.desc("affinity"), "key")
    top = affinity.filter(F.col("dimension").isin("genre", "director")).withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= n)
    lists = top.groupBy("user_id").pivot("dimension", ["genre", "director"]).agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", "key"))), lambda x: x["key"]))
    return ratings.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_rated")).join(lists, "user_id", "left").withColumnsRenamed({"genre": "genres", "director": "directors"})


def health(tables: dict[str, DataFrame | None]) -> DataFrame:
    """name and n_rows of each table; null for one that is missing."""
    found = None
    spark = next(t for t in tables.values() if t is not None).sparkSession
    for name, t in tables.items():
        row = spark.range(1).select(F.lit(name).alias("name"), F.lit(None).cast("long").alias("n_rows")) if t is None else t.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("name"), "n_rows")
        found = row if found is None else found.unionByName(row)
    return found


# Labels of a card's lines, the column each shows, and how many entries at most.
CARD_LISTS = [("Genres", "genres", None), ("Directors", "directors", None), ("Starring", "actors", 6)]
CARD_MORE = [("Themes", "themes", None), ("Tone", "tone", None), ("Pacing", "pacing", None), ("Similar Titles", "comparable_films", 5)]


def inspector(cards: DataFrame) -> Column:
    """A card as lines of marked-up text; what the catalogue doesn't know is N/A, and later lines are left out."""
    kinds = dict(cards.dtypes)

    def shown(name: str, most: int | None) -> Column:
        if name not in kinds:
            return F.lit(None).cast("string")
        x = F.col(name)
        if kinds[name].startswith("array"):
            x = F.array_join(F.slice(x, 1, most) if most else x, ", ")
        return F.nullif(x.cast("string"), F.lit(""))

    unknown = lambda name: F.coalesce(shown(name, None), F.lit("N/A"))
    rated = F.coalesce(F.col("avg_rating"), F.lit(0.0)) > 0
    stars = F.when(rated, F.concat(F.lit("★ "), maths.two_digits(F.col("avg_rating")))).otherwise("★ Unrated")
    counted = F.when(F.coalesce("num_ratings", F.lit(0)) > 0, F.concat(F.lit("("), F.format_number("num_ratings", 0), F.lit(" ratings)"))).otherwise("")
    tier = F.coalesce(shown("tier", None), F.lit("Tier C"))
    title = F.coalesce(shown("title", None), F.lit("Unknown Title"))
    head = [F.concat(F.lit("# "), title, F.lit(" ("), unknown("year"), F.lit(")")), F.concat(F.lit("**Rating**: "), stars, F.lit(" "), counted, F.lit(" | **Tier**: `"), tier, F.lit("`"))]
    lists = [F.concat(F.lit(f"**{label}**: "), F.coalesce(shown(name, most), F.lit("N/A"))) for label, name, most in CARD_LISTS]
    plot = F.concat(F.lit("### Plot Overview\n"), shown("overview", None), F.lit("\n"))
    more = [F.concat(F.lit(f"**{label}**: "), shown(name, most)) for label, name, most in CARD_MORE]
    return F.concat_ws("\n", *head, *lists, F.lit("---"), plot, *more)
