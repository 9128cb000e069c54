"""Queries that a list answers directly, told by their wording.

A wording is a phrase with slots behind it. All are looked for in a batch of queries at
once, as columns; a single query is a batch of one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrid.operators import ratings as R
from reelgrid.operators import rules as A

# The wordings that ask for a list, what may stand before one about a title, and words behind it that ask for more than a list.
PATTERNS = {
    "associated": r"(?:movies like|similar to|recommendations for|if i liked)\s+([a-zA-Z0-9\s:'-]+)",
    "rating": r"(?:top|best|highest rated)\s+(\d+)?\s*([a-zA-Z]+)?\s*movies?",
    "popularity": r"(?:most popular|trending)\s+([a-zA-Z]+)?\s*movies?",
}
LEAD = r"^(?:show|find|give|get|recommend|search|i want|can you find|please)?\s*(?:me|us)?\s*"
TURN = r"\b(but|with|and|except|without|not|less|more)\b"
ANY_GENRE = ("all", "any")


@dataclass(frozen=True)
class Route:
    kind: str  # default, associated, top_by_genre, top_overall
    limit: int = 10
    genre: str | None = None
    by: str = "rating"
    title: str | None = None


FIELDS = "kind string, limit int, genre string, by string, title string"


def slot(query: Column, wording: str, n: int) -> Column:
    """What stands in the n-th slot of a wording, null if nothing does."""
    return F.nullif(F.regexp_extract(query, PATTERNS[wording], n), F.lit(""))


def listed(query: Column, wording: str, genre: Column, limit: Column) -> Column:
    kind = F.when(genre.isNotNull(), "top_by_genre").otherwise("top_overall")
    return F.struct(kind.alias("kind"), limit.alias("limit"), genre.alias("genre"), F.lit(wording).alias("by"), F.lit(None).cast("string").alias("title"))


def routed(queries: DataFrame) -> DataFrame:
    """queries (query_id, text) with routes: an array of routes to try in order; empty for what the semantic pipeline answers."""
    q = F.lower(F.trim(F.coalesce("text", F.lit(""))))
    said = {name: q.rlike(p) for name, p in PATTERNS.items()}
    # a title is asked for alone: only a lead before the phrase, and no turn behind what was taken for the title
    place, taken = F.regexp_instr(q, F.lit(PATTERNS["associated"])), F.regexp_substr(q, F.lit(PATTERNS["associated"]))
    before, behind = F.substr(q, F.lit(1), place - 1), F.substr(q, place + F.length(taken))
    alone = said["associated"] & (F.trim(F.regexp_replace(F.trim(before), LEAD, "")) == "") & ~behind.rlike(TURN)
    none = F.lit(None).cast("string")
    liked = F.struct(F.lit("associated").alias("kind"), F.lit(10).alias("limit"), none.alias("genre"), F.lit("rating").alias("by"), F.trim(slot(q, "associated", 1)).alias("title"))
    named = slot(q, "rating", 2)
    top = listed(q, "rating", F.when(~named.isin(*ANY_GENRE), named), F.coalesce(slot(q, "rating", 1).try_cast("int"), F.lit(10)))
    popular = listed(q, "popularity", slot(q, "popularity", 1), F.lit(10))
    default = F.struct(F.lit("default").alias("kind"), F.lit(100).alias("limit"), none.alias("genre"), F.lit("rating").alias("by"), none.alias("title"))
    found = F.array(F.when(q == "", default), F.when(alone, liked), F.when(said["rating"], top).when(said["popularity"], popular))
    return queries.withColumn("routes", F.filter(found, lambda r: r.isNotNull()))


def route(spark: SparkSession, query: str) -> list[Route]:
    """Routes of one query."""
    row = routed(spark.createDataFrame([(query,)], "text string")).first()
    return [Route(**r.asDict()) for r in row.routes]


def answer(r: Route, movies: DataFrame, stats: DataFrame, rules: DataFrame | None = None, **limits) -> DataFrame | None:
    """The rows of a route, or None if it leads nowhere (an unknown title, or one without rules)."""
    lists = {
        "default": lambda: R.default_recommendations(movies, stats, r.limit, **limits),
        "top_by_genre": lambda: R.top_by_genre(movies, stats, r.genre, r.limit, r.by),
        "top_overall": lambda: R.top_overall(movies, stats, r.limit, r.by, **{k: v for k, v in limits.items() if k == "least"}),
    }
    if r.kind in lists:
        return lists[r.kind]()
    source = R.best_title(movies, stats, r.title)
    if rules is None or not source.take(1):
        return None
    found = A.associated(source, rules, movies, r.limit).join(stats, "movie_id", "left")
    return found if found.take(1) else None
