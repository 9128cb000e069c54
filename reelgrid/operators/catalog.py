"""Merging, matching and completing catalogue rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelgrid.functions import documents, text
from reelgrid.functions.ordering import latest


def insert_ignore(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """existing and those rows of new whose key it lacks, one for each key (the smallest)."""
    kept = [c for c in new.columns if c not in keys]
    one = new.groupBy(*keys).agg(F.min(F.struct(*kept)).alias("_row")).select(*keys, "_row.*") if kept else new.select(*keys).distinct()
    return existing.unionByName(one.join(existing.select(*keys), keys, "left_anti").select(*existing.columns))


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of each key the last row by order, over both."""
    return latest(existing.unionByName(new), keys, order)


def updated(rows: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """rows with the columns of changes where those aren't null."""
    c = changes.select(key, *[F.col(x).alias(f"_new_{x}") for x in columns])
    return rows.join(c, key, "left").select(*[F.coalesce(f"_new_{x}", x).alias(x) if x in columns else F.col(x) for x in rows.columns])


def patched(rows: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """rows with each field of patch that says something: texts and lists that aren't empty, numbers that aren't null."""
    fields = {f.name: f.dataType.simpleString() for f in patch.schema if f.name != key}
    p = patch.select(key, *[F.col(x).alias(f"_new_{x}") for x in fields])

    def pick(name: str) -> Column:
        new, old = F.col(f"_new_{name}"), F.col(name)
        if fields[name] == "string":
            return documents.non_empty(new, old)
        return documents.non_empty_list(new, old) if fields[name].startswith("array") else F.coalesce(new, old)

    return rows.join(p, key, "left").select(*[pick(x).alias(x) if x in fields else F.col(x) for x in rows.columns])


def unique_update(rows: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """Set a column that must stay unique: of several claims to a value the smallest key's counts, none if a row has the value already."""
    claims = changes.filter(F.col(column).isNotNull()).groupBy(column).agg(F.min(key).alias(key))
    free = claims.join(rows.select(column).filter(F.col(column).isNotNull()), column, "left_anti")
    return updated(rows, free.groupBy(key).agg(F.min(column).alias(column)), key, [column])


def genre_bridge(movies: DataFrame) -> DataFrame:
    return movies.select("movie_id", F.explode("genres").alias("genre")).distinct()


def last_card(cards: DataFrame, order: str) -> DataFrame:
    """Of the cards of an item the one that was loaded last."""
    return latest(cards, ["movie_id"], [F.col(order)])


def cards_with_tier(cards: DataFrame) -> DataFrame:
    """The card's own tier, or A if it has themes, B with a genome vector, else the file's (C)."""
    given = F.nullif(F.col("tier"), F.lit(""))
    derived = F.when(F.col("themes").isNotNull(), F.lit("A")).when(F.col("genome_vector").isNotNull(), F.lit("B")).otherwise(F.coalesce("_default", F.lit("C")) if "_default" in cards.columns else F.lit("C"))
    return cards.withColumn("tier", F.coalesce(given, derived))


def banded_match(rows: DataFrame, candidates: DataFrame, offsets: tuple[int, ...] = (0, -1, 1)) -> DataFrame:
    """rows (id, title, year) with the candidate_id of the first hit among title variants and years, offsets in order.

    candidates: candidate_id, title, year. Variants and offsets are spread into equi-join
    keys; the best hit of a row is a minimum, combined before the shuffle.
    """
    spread = F.explode(F.transform(F.array(*[F.lit(o) for o in offsets]), lambda o, i: F.struct(o.alias("offset"), i.alias("place"))))
    left = rows.select("id", "year", F.posexplode(text.title_variants(F.col("title"))).alias("variant_place", "variant"))
    left = left.select("id", "variant", "variant_place", "year", spread.alias("o")).select("id", "variant", "variant_place", (F.col("year") + F.col("o.offset")).alias("_year"), F.col("o.place").alias("place"))
    right = candidates.select("candidate_id", F.col("year").alias("_year"), F.explode(text.title_variants(F.col("title"))).alias("variant"))
    hits = left.join(right, ["variant", "_year"]).groupBy("id").agg(F.min(F.struct("variant_place", "place", "candidate_id"))["candidate_id"].alias("candidate_id"))
    return rows.join(hits, "id", "left")


def strict_else_relaxed(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """rows (id, title, year) with the candidate_id that agrees in title and year, else in title alone; the smallest id of several.

    A row meets at most one candidate of its title and year and one of its title, whatever number a title has.
    """
    keyed = rows.withColumns({"_t": text.normalised_title(F.col("title")), "_y": F.col("year")})
    strict = candidates.select("candidate_id", text.normalised_title(F.col("title")).alias("_st"), F.col("year").alias("_sy")).groupBy("_st", "_sy").agg(F.min("candidate_id").alias("_strict"))
    loose = strict.groupBy(F.col("_st").alias("_lt")).agg(F.min("_strict").alias("_loose"))
    met = keyed.join(strict, (F.col("_t") == F.col("_st")) & F.col("_y").eqNullSafe(F.col("_sy")), "left").join(loose, F.col("_t") == F.col("_lt"), "left")
    relaxed = F.when(F.col("_strict").isNotNull(), False).when(F.col("_loose").isNotNull(), True)
    return met.select(*rows.columns, F.coalesce("_strict", "_loose").alias("candidate_id"), relaxed.alias("relaxed"))


def without_credits(movies: DataFrame) -> DataFrame:
    """Rows with neither actors nor directors."""
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    return movies.filter(none("actors") & none("directors"))


def hydrate(hits: DataFrame, movies: DataFrame, stats: DataFrame, cards: DataFrame | None = None) -> DataFrame:
    """hits (with movie_id) as candidates: card fields first, then the catalogue's; counts and ranks never null."""
    base = movies.select("movie_id", F.col("title").alias("_title"), F.col("year").alias("_year"), F.array_sort("genres").alias("_genres"))
    out = hits.join(base, "movie_id", "left").join(stats, "movie_id", "left")
    if cards is not None:
        out = out.join(cards.select("movie_id", *[F.col(c).alias(f"_card_{c}") for c in cards.columns if c != "movie_id"]), "movie_id", "left")
    card = lambda c: F.col(f"_card_{c}") if f"_card_{c}" in out.columns else F.lit(None)
    own_title = F.coalesce(F.nullif(card("title").cast("string"), F.lit("")), F.nullif(F.col("_title"), F.lit("")))
    year = F.coalesce(F.nullif(card("year").cast("int"), F.lit(0)), F.col("_year").cast("int"))
    title = F.coalesce(text.without_year_suffix(own_title, year), own_title, F.concat(F.lit("Movie #"), F.col("movie_id").cast("string")))
    rated = F.coalesce("num_ratings", F.lit(0))
    kept = {
        "title": title, "year": year,
        "genres": F.coalesce(documents.non_empty_list(F.col("_genres"), card("genres").cast("array<string>")), F.array().cast("array<string>")),
        "avg_rating": F.when(rated > 0, F.col("avg_rating")), "num_ratings": rated,
        "pct_positive": F.coalesce("pct_positive", F.lit(0.0)), "popularity_rank": F.coalesce("popularity_rank", F.lit(999_999)),
    }
    if cards is not None:
        kept["tier"] = card("tier")
        kept["top_tags"] = F.slice(documents.non_empty_list(card("top_tags").cast("array<string>"), card("user_tags").cast("array<string>")), 1, 10)
        kept["keywords"] = F.slice(card("keywords").cast("array<string>"), 1, 20)
        kept |= {c: card(c) for c in cards.columns if c not in (*kept, "movie_id", "user_tags", "genome_vector")}
    return out.withColumns(kept).drop(*[c for c in out.columns if c.startswith("_")])


def first_titles(movies: DataFrame, stats: DataFrame) -> DataFrame:
    """key (lower-case title) and the movie_id with most ratings that has it."""
    named = movies.join(stats.select("movie_id", "num_ratings"), "movie_id", "left").filter(F.coalesce("title", F.lit("")) != "")
    best = F.max_by("movie_id", F.struct(F.coalesce("num_ratings", F.lit(0)), -F.col("movie_id")))
    return named.groupBy(F.lower(F.trim("title")).alias("key")).agg(best.alias("movie_id"))


def vocabulary(movies: DataFrame, column: str) -> DataFrame:
    """Distinct lower-case entries of a list column."""
    return movies.select(F.explode(column).alias("term")).select(F.lower(F.trim("term")).alias("term")).filter("term <> ''").distinct()


def enrichment_targets(movies: DataFrame, wanted: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows of movies that are in wanted (movie_id) and have an outside id to ask by, the first `limit` of them if there is one."""
    found = movies.filter(F.col("tmdb_id").isNotNull()).join(wanted.select("movie_id").distinct(), "movie_id", "left_semi")
    return found if limit is None else found.orderBy("movie_id").limit(limit)


def attached(rows: DataFrame, links: DataFrame, key: str, column: str) -> DataFrame:
    """rows with the column's value from links where they have none; the smallest of several."""
    found = links.filter(F.col(column).isNotNull()).groupBy(key).agg(F.min(column).alias("_new"))
    return rows.join(found, key, "left").withColumn(column, F.coalesce(column, "_new")).select(*rows.columns)
