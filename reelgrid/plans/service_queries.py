"""Questions about queries, lanes, accounts and texts as queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrid.functions import documents, maths, text
from reelgrid.operators import account, catalog, folds, fusion, learning, metrics, profile, reviews, vectors

from . import router, understanding
from .adapters import movies, ratings, stats, table
from .queries import D, EVALUATED, FOLD, MOVIES_RATED, PROFILES, T, WEIGHTED, affinity, brand_likes, query, tables, test_pool


def part(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part")


def joined(column: str) -> F.Column:
    return F.array_join(F.coalesce(column, F.array().cast("array<string>")), "|").alias(column)


# Routes and understanding

ASKED = """asked AS (SELECT p_partkey AS query_id, lower(p_type) AS kind, lower(p_name) AS name, p_size AS n, p_partkey % 12 AS c, CASE p_partkey % 12 WHEN 0 THEN '' WHEN 1 THEN 'movies like ' || p_name WHEN 2 THEN 'Show me movies like ' || p_name || ', but funny'
    WHEN 3 THEN 'sad movies like ' || p_name WHEN 4 THEN 'top ' || p_size || ' ' || p_type || ' movies' WHEN 5 THEN 'best all movies' WHEN 6 THEN 'most popular ' || p_type || ' movies' WHEN 7 THEN 'trending movies'
    WHEN 8 THEN 'if i liked ' || p_name WHEN 9 THEN 'highest rated movie' WHEN 10 THEN p_name || ' without ' || p_type WHEN 11 THEN 'an obscure Korean ' || p_name || ' war' END AS text FROM part)"""


def asked(spark: SparkSession, d: str) -> DataFrame:
    """Twelve ways to ask, about the names, kinds and sizes of parts."""
    forms = [
        "''", "concat('movies like ', p_name)", "concat('Show me movies like ', p_name, ', but funny')", "concat('sad movies like ', p_name)", "concat('top ', p_size, ' ', p_type, ' movies')", "'best all movies'",
        "concat('most popular ', p_type, ' movies')", "'trending movies'", "concat('if i liked ', p_name)", "'highest rated movie'", "concat(p_name, ' without ', p_type)", "concat('an obscure Korean ', p_name, ' war')",
    ]
    cases = " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(forms))
    return part(spark, d).select(F.col("p_partkey").alias("query_id"), F.expr(f"CASE p_partkey % 12 {cases} END").alias("text"))


@query(f"""WITH {ASKED} SELECT query_id, CASE WHEN c = 0 THEN 'default' WHEN c IN (1, 8) THEN 'associated' WHEN c IN (4, 6) THEN 'top_by_genre' WHEN c IN (5, 7, 9) THEN 'top_overall' ELSE '' END AS kinds,
    CASE WHEN c = 0 THEN 100 WHEN c = 4 THEN n WHEN c IN (1, 5, 6, 7, 8, 9) THEN 10 END AS n, CASE WHEN c IN (4, 6) THEN kind END AS genre, CASE WHEN c IN (6, 7) THEN 'popularity' WHEN c IN (0, 1, 4, 5, 8, 9) THEN 'rating' END AS listed_by,
    CASE WHEN c IN (1, 8) THEN name END AS title FROM asked""")
def route_queries(spark: SparkSession, d: str) -> DataFrame:
    found = router.routed(asked(spark, d))
    first = F.try_element_at("routes", F.lit(1))
    kinds = F.array_join(F.transform("routes", lambda r: r["kind"]), "|")
    return found.select("query_id", kinds.alias("kinds"), first["limit"].alias("n"), first["genre"].alias("genre"), first["by"].alias("listed_by"), first["title"].alias("title"))


@query(tables(*MOVIES_RATED) + f""", {ASKED}, keys AS (SELECT lower(title) AS key, arg_max(movie_id, (coalesce(num_ratings, 0), -movie_id)) AS movie_id FROM movies LEFT JOIN stats USING (movie_id) GROUP BY 1)
    SELECT query_id, m.movie_id AS matched_movie_id, CASE WHEN c IN (1, 2, 3, 8) THEN 'title_reference' ELSE 'general_search' END AS intent_type, c = 11 AS is_obscure, CASE WHEN c = 11 THEN 'War' ELSE '' END AS genres, CASE WHEN c = 11 THEN 'ko' END AS lang,
    CASE WHEN c = 10 THEN kind ELSE '' END AS negations, CASE WHEN c = 11 AND contains(name, 'hot') THEN 'hot' ELSE '' END AS tags,
    CASE c WHEN 10 THEN CASE WHEN starts_with(name, kind || ' ') THEN substr(name, length(kind) + 2) ELSE name END || ' without' WHEN 11 THEN 'an obscure korean ' || name || ' war south korea korean' ELSE lower(text) END AS expanded
    FROM asked LEFT JOIN keys m ON c IN (1, 3, 8) AND m.key = name""")
def parsed_queries(spark: SparkSession, d: str) -> DataFrame:
    """Titles named by likeness, nations, genres, negations and tags of the same ways to ask."""
    tags = spark.createDataFrame([("hot",), ("ho",), ("rings",)], "tag string")
    some = asked(spark, d)
    hot = F.col("query_id") % 12 == 11
    got = understanding.parse_many(some, understanding.titles_of(movies(spark, d), stats(spark, d)), tags)
    return got.select(
        "query_id", "matched_movie_id", "intent_type", "is_obscure", joined("genres"), F.col("nation.lang").alias("lang"), joined("negations"),
        F.when(hot, F.array_join("tags", "|")).otherwise("").alias("tags"), F.lower("expanded_query").alias("expanded"),
    )


@query(r"""WITH a AS (SELECT item_id, text || ' but not too slow, without ' || item_id AS text FROM benchmark), n AS (SELECT item_id, text, list_transform(regexp_extract_all(lower(text), '\b(not|no|less|without|non|except)\s+([a-zA-Z0-9\s-]+)', 2), lambda x: trim(x)) AS ns FROM a)
    SELECT item_id, array_to_string(ns, '|') AS negations, length(text) AS n_chars FROM n""")
def negated_phrases(spark: SparkSession, d: str) -> DataFrame:
    some = table(spark, d, "benchmark").select("item_id", F.concat("text", F.lit(" but not too slow, without "), F.col("item_id").cast("string")).alias("text"))
    return some.select("item_id", F.array_join(text.negations(F.col("text")), "|").alias("negations"), F.length("text").cast("long").alias("n_chars"))


@query("""SELECT p_partkey AS id, CASE WHEN starts_with(p_name, lower(p_type) || ' ') THEN substr(p_name, length(p_type) + 2) ELSE p_name END || ' for' AS rest, lower(p_name) AS target FROM part""")
def phrases_taken_out(spark: SparkSession, d: str) -> DataFrame:
    """A phrase removed wherever it stands as words, blanks collapsed; and the title that a wording names."""
    p = part(spark, d)
    said = F.concat("p_type", F.lit("  "), "p_name", F.lit(" for "), F.lower("p_type"))
    liked = F.concat(F.lit("movies like similar to "), "p_name", F.lit(" but with "), "p_type")
    return p.select(F.col("p_partkey").alias("id"), text.without_phrases(said, F.array(F.lower("p_type"))).alias("rest"), text.title_target(F.substring(liked, 13, 200)).alias("target"))


# Lanes


TAGGED = """tags AS (SELECT row_number() OVER (ORDER BY tag) AS tag_id, tag FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS tag FROM part)), relevances AS (SELECT p_partkey AS movie_id, tag_id, (1 + p_size % (tag_id + 1)) / 20.0::DOUBLE AS relevance FROM part JOIN tags ON list_contains(string_split(p_name, ' '), tag)),
    q AS (SELECT * FROM (VALUES (0, 'red ring'), (1, 'an old widget'), (2, 'gear')) v(query_id, t)),
    w0 AS (SELECT query_id, tag_id, CASE WHEN t = tag THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN contains(' ' || t || ' ', ' ' || tag || ' ') THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END AS weight FROM q, tags), w AS (SELECT query_id, tag_id, weight / sqrt(sum(weight * weight) OVER (PARTITION BY query_id)) AS weight FROM w0 WHERE weight > 0),
    len AS (SELECT movie_id, sqrt(sum(relevance * relevance)) AS l FROM relevances GROUP BY 1), gscore AS (SELECT query_id, movie_id AS item_id, round(sum(relevance * weight) / any_value(l), 6) AS score FROM relevances JOIN w USING (tag_id) JOIN len USING (movie_id) GROUP BY 1, 2),
    genome AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS lane_rank FROM gscore QUALIFY lane_rank <= 100)"""


def tagged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The queries, the tags of the parts' names and how relevant each is to a part."""
    p = part(spark, d)
    names = p.select(F.explode(F.split("p_name", " ")).alias("tag")).distinct()
    tags = folds.numbered(names, ["tag"], []).select((F.col("_at") + 1).alias("tag_id"), "tag")
    scores = p.select(F.col("p_partkey").alias("movie_id"), "p_size", F.explode(F.split("p_name", " ")).alias("tag")).join(tags, "tag").select("movie_id", "tag_id", ((1 + F.col("p_size") % (F.col("tag_id") + 1)) / 20.0).alias("relevance"))
    said = spark.createDataFrame([(0, "red ring"), (1, "an old widget"), (2, "gear")], "query_id long, text string")
    return said, tags, scores


def genome(spark: SparkSession, d: str) -> DataFrame:
    said, tags, scores = tagged(spark, d)
    return vectors.nearest_to_tags(vectors.tag_query(said, tags), scores, 100)


@query(f"WITH {TAGGED} SELECT query_id, item_id, score, lane_rank FROM genome")
def genome_lane(spark: SparkSession, d: str) -> DataFrame:
    return genome(spark, d)


LANES = """dense AS (SELECT query_id, p_partkey AS item_id, row_number() OVER (PARTITION BY query_id ORDER BY p_retailprice DESC, p_partkey) AS lane_rank FROM part, q WHERE p_size % 3 = query_id QUALIFY lane_rank <= 100),
    words AS (SELECT query_id, p_partkey AS item_id, row_number() OVER (PARTITION BY query_id ORDER BY p_partkey) AS lane_rank FROM part, q WHERE contains(t, string_split(p_name, ' ')[2]) QUALIFY lane_rank <= 100),
    lanes AS (SELECT query_id, item_id, lane_rank, 0 AS lane FROM words UNION ALL SELECT query_id, item_id, lane_rank, 1 FROM genome UNION ALL SELECT query_id, item_id, lane_rank, 2 FROM dense),
    fused AS (SELECT query_id, item_id, sum(1.0::DOUBLE / (60 + lane_rank)) AS s, min(lane) AS first_lane, arg_min(lane_rank, lane) AS first_rank, count(*) AS n_lanes FROM lanes GROUP BY 1, 2),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, first_lane, first_rank, item_id) AS rrf_rank FROM fused QUALIFY rrf_rank <= 300)"""


def fused_lanes(spark: SparkSession, d: str) -> DataFrame:
    """Three lanes of a hundred fused into three hundred: words, tags, and prices in place of a dense lane."""
    from pyspark.sql import Window as W

    said, _, _ = tagged(spark, d)
    p = part(spark, d).select(F.col("p_partkey").alias("item_id"), "p_name", "p_size", "p_retailprice")
    pairs = p.crossJoin(F.broadcast(said))  # the three stated queries
    lane = lambda rows, *order: rows.withColumn("lane_rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).filter("lane_rank <= 100")
    words = lane(pairs.filter(F.col("text").contains(F.split("p_name", " ")[1])), "item_id")
    dense = lane(pairs.filter(F.col("p_size") % 3 == F.col("query_id")), F.desc("p_retailprice"), "item_id")
    return fusion.reciprocal_rank({"bm25": words, "genome": genome(spark, d), "dense": dense}, 300)


@query(f"WITH {TAGGED}, {LANES} SELECT query_id, item_id, rrf_rank, round(s, 5) AS rrf_score, n_lanes FROM ranked")
def lane_fusion(spark: SparkSession, d: str) -> DataFrame:
    return fused_lanes(spark, d).select("query_id", "item_id", "rrf_rank", "rrf_score", F.size("lanes").cast("long").alias("n_lanes"))


@query(f"""WITH {TAGGED}, {LANES}, scored AS (SELECT query_id, item_id, rrf_rank, CASE WHEN rrf_rank <= 20 THEN 0.1::DOUBLE + item_id % 9 END AS s FROM ranked), filled AS (SELECT query_id, item_id, coalesce(s, min(s) OVER (PARTITION BY query_id) * 0.5::DOUBLE) AS rerank_score FROM scored)
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, item_id) AS place FROM filled QUALIFY place <= 30""")
def rerank_overflow(spark: SparkSession, d: str) -> DataFrame:
    """A model scores the first twenty; the others get half of its lowest score; the best thirty are listed."""
    from pyspark.sql import Window as W

    candidates = fused_lanes(spark, d).select("query_id", "item_id", "rrf_rank")
    scores = candidates.filter("rrf_rank <= 20").select("query_id", "item_id", (0.1 + F.col("item_id") % 9).alias("score"))
    best = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("rerank_score"), "item_id"))
    return fusion.with_rerank(candidates, scores).withColumn("place", best).filter("place <= 30").select("query_id", "item_id", "rerank_score", "place")


def passage_pairs(spark: SparkSession, d: str) -> DataFrame:
    m = movies(spark, d)
    body = text.passage(F.col("title"), F.col("year"), F.col("directors"), F.array().cast("array<string>"), F.col("genres"), F.array().cast("array<string>"), F.col("top_tags"), F.lit("in short"))
    return m.select((F.col("movie_id") % 3).alias("query_id"), F.col("movie_id").alias("item_id"), F.when(F.col("movie_id") % 2 == 0, "Red ring, red").otherwise("promo short 1990").alias("query"), body.alias("passage"))


PASSAGE = "passages AS (SELECT p_partkey AS item_id, p_partkey % 3 AS query_id, p_name || ' (' || (1970 + p_size) || ') | ' || p_brand || ' | ' || p_type || ' | ' || replace(p_name, ' ', ', ') || ' | in short' AS passage FROM part)"


@query(f"WITH {PASSAGE} SELECT query_id, item_id, passage FROM passages")
def passages(spark: SparkSession, d: str) -> DataFrame:
    return passage_pairs(spark, d).select("query_id", "item_id", "passage")


@query(f"""WITH {PASSAGE}, w AS (SELECT *, CASE WHEN item_id % 2 = 0 THEN ['red', 'ring'] ELSE ['promo', 'short', '1990'] END AS q, list_filter(regexp_split_to_array(lower(passage), '[^a-z0-9]+'), lambda x: x <> '') AS p FROM passages)
    SELECT query_id, item_id, round(len(list_filter(q, lambda x: list_contains(p, x))) / len(q), 6) AS score FROM w""")
def rerank_lexical(spark: SparkSession, d: str) -> DataFrame:
    return fusion.lexical_rerank(passage_pairs(spark, d)).withColumn("score", F.round("score", 6))


def length_model():
    return lambda queries, passages: [len(p) - len(q) for q, p in zip(queries, passages, strict=True)]


@query(f"WITH {PASSAGE} SELECT query_id, item_id, CAST(length(passage) - CASE WHEN item_id % 2 = 0 THEN 13 ELSE 16 END AS DOUBLE) AS score FROM passages")
def rerank_model(spark: SparkSession, d: str) -> DataFrame:
    """Scores of a model that tasks load: here one of lengths."""
    return fusion.model_rerank(passage_pairs(spark, d), length_model)


@query("""SELECT p_partkey % 7 AS query_id, p_partkey AS item_id, greatest(p_size / 10.0::DOUBLE, 2.5::DOUBLE) - p_size / 7.0::DOUBLE AS score FROM part""")
def yes_no_logit(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_size")
    logits = F.create_map(F.lit("yes"), n / 10.0, F.lit("Yes"), F.lit(2.5), F.lit("No"), n / 7.0, F.lit("maybe"), F.lit(99.0))
    return fusion.yes_no_logit(part(spark, d).select((F.col("p_partkey") % 7).alias("query_id"), F.col("p_partkey").alias("item_id"), logits.alias("logits")))


# The catalogue


@query("SELECT p_partkey AS movie_id FROM part WHERE p_size % 2 = 0 AND p_size % 3 = 0")
def missing_credits(spark: SparkSession, d: str) -> DataFrame:
    none = F.array().cast("array<string>")
    rows = part(spark, d).select(F.col("p_partkey").alias("movie_id"), F.when(F.col("p_size") % 2 == 0, none).otherwise(F.array("p_name")).alias("actors"), F.when(F.col("p_size") % 3 != 0, F.array("p_brand")).alias("directors"))
    return catalog.without_credits(rows).select("movie_id")


@query("""SELECT p_partkey AS movie_id, CASE WHEN p_size % 4 = 0 THEN 'Z' WHEN p_size % 4 = 1 THEN 'A' WHEN p_size % 4 = 2 THEN 'B' ELSE 'C' END AS tier FROM part""")
def card_tiers(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("p_size") % 4
    rows = part(spark, d).select(
        F.col("p_partkey").alias("movie_id"), F.when(kind == 0, "Z").otherwise("").alias("tier"), F.when(kind == 1, F.array("p_type")).alias("themes"), F.when(kind <= 2, F.array(F.lit(0.5))).alias("genome_vector")
    )
    return catalog.cards_with_tier(rows).select("movie_id", "tier")


@query("""SELECT p_partkey AS movie_id, p_partkey * 10 AS tmdb_id FROM part WHERE p_size % 2 = 0 AND p_size % 3 = 0 ORDER BY p_partkey LIMIT 25""")
def enrichment_targets(spark: SparkSession, d: str) -> DataFrame:
    """Movies with an outside id that are wanted, the first of them."""
    rows = part(spark, d).select(F.col("p_partkey").alias("movie_id"), F.when(F.col("p_size") % 2 == 0, F.col("p_partkey") * 10).alias("tmdb_id"))
    wanted = part(spark, d).filter("p_size % 3 = 0").select(F.col("p_partkey").alias("movie_id"))
    return catalog.enrichment_targets(rows, wanted, 25)


@query("""SELECT p_partkey AS movie_id, CASE WHEN p_size % 2 = 0 THEN 'own' WHEN p_size % 3 = 0 THEN 'tt' || p_size END AS imdb_id FROM part""")
def attached_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of a link table for the rows that have none."""
    rows = part(spark, d).select(F.col("p_partkey").alias("movie_id"), F.when(F.col("p_size") % 2 == 0, "own").alias("imdb_id"))
    links = part(spark, d).filter("p_size % 3 = 0").select(F.col("p_partkey").alias("movie_id"), F.concat(F.lit("tt"), F.col("p_size").cast("string")).alias("imdb_id"))
    return catalog.attached(rows, links, "movie_id", "imdb_id")


@query(tables(*MOVIES_RATED) + """ SELECT lower(title) AS key, arg_max(movie_id, (coalesce(num_ratings, 0), -movie_id)) AS movie_id FROM movies LEFT JOIN stats USING (movie_id) GROUP BY 1""")
def first_titles(spark: SparkSession, d: str) -> DataFrame:
    return catalog.first_titles(movies(spark, d), stats(spark, d))


@query("SELECT DISTINCT lower(unnest([p_brand, p_type])) AS term FROM part")
def vocabulary_terms(spark: SparkSession, d: str) -> DataFrame:
    return catalog.vocabulary(part(spark, d).select(F.array(F.concat("p_brand", F.lit(" ")), "p_type", F.lit(" ")).alias("terms")), "terms")


@query("""SELECT p_partkey AS movie_id, p_brand AS directors, 'a|' || p_name AS leads, CASE WHEN p_size % 2 = 0 THEN 'R' END AS certification, p_type || '|x' AS countries FROM part""")
def service_answers(spark: SparkSession, d: str) -> DataFrame:
    """A catalogue service's nested answers, flattened."""
    null = F.lit(None).cast("string")
    person = lambda job, name: F.struct(F.lit(job).alias("job"), name.alias("name"))
    named = lambda *names: F.array(*[F.struct(n.alias("name")) for n in names])
    block = lambda country, *marks: F.struct(F.lit(country).alias("iso_3166_1"), F.array(*[F.struct(m.alias("certification")) for m in marks]).alias("release_dates"))
    p = part(spark, d)
    crew = F.array(person("Writer", F.col("p_type")), person("Director", F.col("p_brand")), person("Director", null))
    cast = named(F.lit("a"), F.lit(""), F.col("p_name"), null, null, F.lit("late"))
    last = F.when(F.col("p_size") % 2 == 0, "R").otherwise("")
    dates = F.array(block("US", F.lit(""), null), block("DE", F.lit("16")), block("US", F.lit(""), last))
    return p.select(
        F.col("p_partkey").alias("movie_id"), F.array_join(documents.directors_of(crew), "|").alias("directors"), F.array_join(documents.leading_cast(cast), "|").alias("leads"),
        documents.us_certification(dates).alias("certification"), F.array_join(documents.names_of(named(F.col("p_type"), null, F.lit("x"))), "|").alias("countries"),
    )


@query("""SELECT p_partkey AS movie_id, 'actor' AS dimension, unnest(list_distinct([p_brand, p_type])) AS key FROM part UNION ALL SELECT p_partkey, 'theme', p_type FROM part UNION ALL SELECT p_partkey, 'language', p_brand FROM part UNION ALL SELECT p_partkey, 'pacing', 'slow' FROM part WHERE p_size > 25""")
def movie_terms(spark: SparkSession, d: str) -> DataFrame:
    """Terms of all kinds; an actor that a card lists twice counts once."""
    rows = part(spark, d).select(
        F.col("p_partkey").alias("movie_id"), F.array("p_brand", "p_type", "p_brand").alias("actors"), F.array("p_type", F.lit("")).alias("themes"), F.when(F.col("p_size") > 25, "slow").otherwise("").alias("pacing"), F.col("p_brand").alias("original_language")
    )
    return profile.movie_terms(rows)


@query(tables("ratings") + " SELECT user_id, movie_id FROM ratings JOIN part ON p_partkey = movie_id WHERE CASE WHEN user_id % 2 = 0 THEN p_type = 'PROMO' ELSE contains(' ' || p_name || ' ', ' old ') END")
def dealbreaker_themes(spark: SparkSession, d: str) -> DataFrame:
    """What users rated and their themes rule out, and words in tags; a theme is no taste."""
    rows = part(spark, d).select(F.col("p_partkey").alias("movie_id"), F.array("p_type").alias("themes"), F.array("p_name").alias("top_tags"))
    rated = ratings(spark, d).select("user_id", "movie_id")
    bad = rated.select("user_id").distinct().select("user_id", F.when(F.col("user_id") % 2 == 0, " Promo").otherwise("old").alias("dealbreaker"))
    return profile.dealbroken(rated, profile.movie_terms(rows), bad)


@query(tables(*MOVIES_RATED) + """ SELECT movie_id, '# ' || title || ' (' || year || ')' AS head, '**Rating**: ★ ' || printf('%.2f', avg_rating) || ' (' || num_ratings || ' ratings) | **Tier**: `A`' AS rating, '**Directors**: ' || director AS directors, 6 + CASE WHEN movie_id % 2 = 0 THEN 1 ELSE 0 END AS n_lines
    FROM movies JOIN stats USING (movie_id)""")
def inspector_text(spark: SparkSession, d: str) -> DataFrame:
    """A card as text for showing, cut into its lines."""
    rows = movies(spark, d).join(stats(spark, d), "movie_id").withColumns({"tier": F.lit("A"), "pacing": F.when(F.col("movie_id") % 2 == 0, "slow")})
    lines = F.split(account.inspector(rows), "\n")
    return rows.select("movie_id", lines[0].alias("head"), lines[1].alias("rating"), lines[3].alias("directors"), F.size(lines).alias("n_lines"))


# Profiles and accounts

T["user_tags"] = "user_tags AS (SELECT user_id, event_id % 100 AS movie_id, event_type AS tag, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS tagged_at FROM events)"


def user_tags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("user_id", (F.col("event_id") % 100).alias("movie_id"), F.col("event_type").alias("tag"), text.unix_seconds(F.col("ts")).alias("tagged_at"))


@query(tables("ratings", "movies", "terms", "events", "user_tags") + f""", mingled AS (SELECT user_id, ts, 0 AS kind, place, dimension, key, CAST(weight AS DOUBLE) AS weight FROM ev UNION ALL SELECT user_id, tagged_at, 1, CAST(movie_id AS VARCHAR) || chr(0) || tag, 'tag', tag, 0.3::DOUBLE FROM user_tags)
    SELECT user_id, dimension, key, {FOLD.replace("ORDER BY ts, place, weight", "ORDER BY ts, kind, place, weight")} AS affinity, count(*) AS confidence FROM mingled GROUP BY ALL""")
def tagged_profile(spark: SparkSession, d: str) -> DataFrame:
    """Affinities after ratings and tags in their order; of the same second ratings come first."""
    return profile.rated_affinities(ratings(spark, d), profile.movie_terms(movies(spark, d)), user_tags(spark, d))


@query("""SELECT c_custkey AS user_id, 'genre' AS dimension, c_mktsegment AS key, 0.8::DOUBLE AS affinity, 3 AS confidence FROM customer UNION ALL SELECT c_custkey, 'era', '1990s', 0.8::DOUBLE, 1 FROM customer UNION ALL SELECT c_custkey, 'language', 'ko', 0.8::DOUBLE, 1 FROM customer WHERE c_nationkey > 10""")
def cold_start(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    seeds = c.select(F.col("c_custkey").alias("user_id"), F.array("c_mktsegment").alias("genres"), F.array(F.lit("1990s"), F.lit("old")).alias("eras"), F.when(F.col("c_nationkey") > 10, F.array(F.lit("ko"))).alias("languages"))
    return profile.affinities(profile.seed_events(seeds))


ANCHORED = """wanted AS (SELECT c_custkey AS user_id, c_nationkey AS n, unnest([CAST(c_nationkey AS VARCHAR), CASE WHEN c_nationkey % 2 = 0 THEN 'red ring' ELSE 'no such' END]) AS token FROM customer),
    resolved AS (SELECT user_id, token, CASE WHEN token = 'red ring' THEN (SELECT min(p_partkey) FROM part WHERE contains(p_name, 'red ring')) WHEN token <> 'no such' THEN CAST(n AS BIGINT) END AS movie_id,
        CASE WHEN token = 'red ring' THEN (SELECT least(count(*), 3) FROM part WHERE contains(p_name, 'red ring')) WHEN token <> 'no such' THEN 1 ELSE 0 END AS n_matches FROM wanted)"""


def anchored(spark: SparkSession, d: str) -> DataFrame:
    title = F.when(F.col("c_nationkey") % 2 == 0, "Red ring").otherwise("No such")
    wanted = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.concat(F.col("c_nationkey").cast("string"), F.lit(" , "), title, F.lit(",")).alias("raw"))
    return account.anchors(wanted, movies(spark, d))


@query(f"WITH {ANCHORED} SELECT user_id, token, movie_id, n_matches FROM resolved")
def anchors(spark: SparkSession, d: str) -> DataFrame:
    return anchored(spark, d).withColumn("token", F.lower("token"))


@query(f"""WITH {ANCHORED}, known AS (SELECT DISTINCT user_id, movie_id FROM resolved WHERE movie_id IS NOT NULL), tags AS (SELECT user_id, unnest(string_split(p_name, ' ')) AS tag FROM known JOIN part ON p_partkey = movie_id)
    SELECT user_id, 'rating' AS what, count(*) AS n FROM known GROUP BY 1 UNION ALL SELECT user_id, 'tag', count(*) FROM tags GROUP BY 1""")
def anchor_events(spark: SparkSession, d: str) -> DataFrame:
    rated, tags = account.anchor_events(anchored(spark, d), movies(spark, d), 100)
    counted = lambda df, what: df.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.lit(what).alias("what"), "n")
    return counted(rated, "rating").unionByName(counted(tags, "tag"))


LOG = "e AS (SELECT user_id, event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS moment, event_type FROM events)"


def log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("user_id", "event_id", F.from_json("props", "k bigint")["k"].alias("k"), text.unix_seconds(F.col("ts")).alias("at"), "event_type")


@query(f"""WITH {LOG}, cleared AS (SELECT user_id, max(moment) AS c FROM e WHERE event_id % 50 = 0 GROUP BY 1), seen AS (SELECT user_id, k AS movie_id, moment FROM e WHERE event_id % 50 <> 0)
    SELECT DISTINCT user_id, movie_id FROM seen LEFT JOIN cleared USING (user_id) WHERE c IS NULL OR moment > c""")
def watched_since_cleared(spark: SparkSession, d: str) -> DataFrame:
    """What users rated, tagged or gave up since they last cleared their history."""
    e = log(spark, d).withColumnRenamed("k", "movie_id")
    kinds = {"rated_at": 0, "tagged_at": 1, "abandoned_at": 2}
    rated, tags, given_up = (e.filter((F.col("event_id") % 50 != 0) & (F.col("event_id") % 3 == i)).select("user_id", "movie_id", F.col("at").alias(name)) for name, i in kinds.items())
    return profile.watched(rated, tags, given_up, e.filter("event_id % 50 = 0").select("user_id", F.col("at").alias("cleared_at")))


@query(f"""WITH {LOG}, cleared AS (SELECT user_id, max(moment) AS c FROM e WHERE event_id % 400 = 0 GROUP BY 1), kept AS (SELECT user_id, event_type || event_id AS query, moment AS asked_at FROM e LEFT JOIN cleared USING (user_id) WHERE (c IS NULL OR moment > c) AND user_id % 7 <> 0)
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY asked_at DESC, query DESC) AS place FROM kept QUALIFY place <= 50""")
def recent_queries(spark: SparkSession, d: str) -> DataFrame:
    e = log(spark, d)
    asked_ = e.select("user_id", F.concat("event_type", F.col("event_id").cast("string")).alias("query"), F.col("at").alias("asked_at"))
    found = profile.recent_queries(asked_, e.filter("event_id % 400 = 0").select("user_id", F.col("at").alias("cleared_at")), e.filter("user_id % 7 = 0").select("user_id"))
    return found.select("user_id", "query", "asked_at", "place")


@query(f"""WITH {LOG}, log AS (SELECT user_id, moment * 1000000 + event_id AS moment, CASE event_id % 10 WHEN 0 THEN 'delete' ELSE 'add' END AS action, 'note ' || k AS entry, event_id FROM e), cleared AS (SELECT user_id, max(moment) AS c FROM log WHERE event_id % 97 = 0 GROUP BY 1),
    last AS (SELECT user_id, entry, arg_max(action, moment) AS action FROM log LEFT JOIN cleared USING (user_id) WHERE event_id % 97 <> 0 AND (c IS NULL OR moment > c) GROUP BY 1, 2) SELECT user_id, entry FROM last WHERE action = 'add'""")
def memory_entries(spark: SparkSession, d: str) -> DataFrame:
    action = F.when(F.col("event_id") % 97 == 0, "clear").when(F.col("event_id") % 10 == 0, "delete").otherwise("add")
    return account.memory_entries(log(spark, d).select("user_id", (F.col("at") * 1000000 + F.col("event_id")).alias("at"), action.alias("action"), F.concat(F.lit("note "), F.col("k").cast("string")).alias("entry")))


@query(f"""WITH {LOG} SELECT user_id, event_type AS signal, arg_max(['off', 'light', 'balanced', 'strong'][1 + event_id % 5], moment * 1000000 + event_id) AS level FROM e WHERE event_id % 5 <> 4 GROUP BY 1, 2""")
def signal_levels(spark: SparkSession, d: str) -> DataFrame:
    level = F.get(F.array(*map(F.lit, [*account.SIGNAL_LEVELS, "loud"])), (F.col("event_id") % 5).cast("int"))
    return account.signals(log(spark, d).select("user_id", (F.col("at") * 1000000 + F.col("event_id")).alias("at"), F.col("event_type").alias("signal"), level.alias("level")))


@query("""SELECT DISTINCT c_custkey AS user_id, unnest(['gore', lower(c_mktsegment), 'no']) AS dealbreaker FROM customer""")
def dealbreakers_said(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    own = c.select(F.col("c_custkey").alias("user_id"), F.lit("gore").alias("dealbreaker"))
    return account.merged_dealbreakers(own, c.select(F.col("c_custkey").alias("user_id"), F.concat(F.lit("No Gore, no "), "c_mktsegment", F.lit(", , No")).alias("raw")))


@query(f"""WITH {LOG} SELECT user_id, k AS movie_id, CASE WHEN event_id % 2 = 0 THEN 'old' ELSE 'new' END AS reason, count(*) AS n FROM e GROUP BY ALL""")
def corrections(spark: SparkSession, d: str) -> DataFrame:
    rows = log(spark, d).select("user_id", F.col("k").alias("movie_id"), F.lit("t").alias("title"), F.when(F.col("event_id") % 2 == 0, "old").otherwise("new").alias("reason"), "at")
    return account.corrections(rows.filter("reason = 'old'"), rows.filter("reason = 'new'")).groupBy("user_id", "movie_id", "reason").agg(F.count(F.lit(1)).alias("n"))


@query(tables(*PROFILES) + """, best AS (SELECT user_id, dimension, key, row_number() OVER (PARTITION BY user_id, dimension ORDER BY affinity DESC, key) AS n FROM affinity WHERE dimension IN ('genre', 'director') QUALIFY n <= 5), n AS (SELECT user_id, count(*) AS n_rated FROM ratings GROUP BY 1)
    SELECT user_id, any_value(n_rated) AS n_rated, string_agg(key, '|' ORDER BY n) FILTER (dimension = 'genre') AS genres, string_agg(key, '|' ORDER BY n) FILTER (dimension = 'director') AS directors FROM n JOIN best USING (user_id) GROUP BY 1""")
def account_summary(spark: SparkSession, d: str) -> DataFrame:
    s = account.summary(affinity(spark, d), ratings(spark, d))
    return s.select("user_id", "n_rated", F.array_join("genres", "|").alias("genres"), F.array_join("directors", "|").alias("directors"))


@query("SELECT 'part' AS name, (SELECT count(*) FROM part) AS n_rows UNION ALL SELECT 'events', (SELECT count(*) FROM events) UNION ALL SELECT 'gone', NULL")
def table_health(spark: SparkSession, d: str) -> DataFrame:
    return account.health({"part": part(spark, d), "events": table(spark, d, "events"), "gone": None})


ANSWERS = """a AS (SELECT l_orderkey AS user_id, l_partkey AS movie_id, l_linenumber AS ts, ceil(l_quantity / 10) AS stars, l_linenumber % 2 = 0 AS sarcasm, l_linestatus, l_returnflag FROM (SELECT l_orderkey, l_partkey, l_linenumber, max(l_quantity) AS l_quantity, max(l_linestatus) AS l_linestatus, max(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2, 3)), s AS (SELECT *, (stars - 3) / 2 AS w, CASE WHEN sarcasm THEN 0.2::DOUBLE ELSE 1.0::DOUBLE END AS sure FROM a)"""


@query(f"""WITH {ANSWERS}, ev AS (SELECT user_id, ts, movie_id, 'tag' AS dimension, 'pace' AS key, w * 0.5::DOUBLE * sure AS weight FROM s UNION ALL SELECT user_id, ts, movie_id, 'tag', lower(l_linestatus) || ' look', sure * 0.4::DOUBLE FROM s UNION ALL SELECT user_id, ts, movie_id, 'tag', 'cast', sure * -0.4::DOUBLE FROM s
    UNION ALL SELECT user_id, ts, movie_id, 'director', p_brand, 0.5::DOUBLE * 0.8::DOUBLE * sure FROM s JOIN part ON p_partkey = movie_id WHERE NOT sarcasm UNION ALL SELECT user_id, ts, movie_id, 'actor', l_returnflag, w * 0.5::DOUBLE * sure FROM s)
    SELECT user_id, ts, CAST(movie_id AS VARCHAR) AS place, dimension, key, round(sum(weight), 6) AS weight, count(*) AS n FROM ev GROUP BY ALL""")
def service_changes(spark: SparkSession, d: str) -> DataFrame:
    """What a review service's answers change: of one aspect in several lists the first kind counts."""
    a = table(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey", "l_linenumber").agg(*[F.max(c).alias(c) for c in ("l_quantity", "l_linestatus", "l_returnflag")])
    answers = a.select(
        F.col("l_orderkey").alias("user_id"), F.col("l_partkey").alias("movie_id"), F.col("l_linenumber").alias("ts"), F.ceil(F.col("l_quantity") / 10).cast("double").alias("stars"), (F.col("l_linenumber") % 2 == 0).alias("sarcasm"),
        F.lit(None).cast("double").alias("sentiment"), F.array(F.concat("l_linestatus", F.lit(" Look ")), F.lit("pace")).alias("liked"), F.array(F.lit("cast")).alias("disliked"), F.array(F.lit("Cast"), F.lit(" ")).alias("tags"), F.array(F.lit("Pace")).alias("chosen"),
        F.when(F.col("l_linenumber") % 2 == 1, F.lit(0.5)).alias("director_sentiment"), F.array("l_returnflag", "l_returnflag").alias("actors"),
    )
    found = account.service_changes(answers, movies(spark, d))
    return found.groupBy("user_id", "ts", "place", "dimension", "key").agg(F.round(F.sum("weight"), 6).alias("weight"), F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT conv_id * 1000 + turn AS review_id, conv_id AS user_id, CAST(1 + length(text) % 5 AS DOUBLE) AS stars FROM conversations WHERE role = 'user'), x AS (SELECT review_id, user_id, (stars - 3) / 2 AS w FROM r)
    SELECT review_id, user_id, 'pace' AS tag, round(w * 0.4::DOUBLE, 6) AS delta FROM x""")
def review_aspects(spark: SparkSession, d: str) -> DataFrame:
    """Changes by aspects that users chose; a tag of the same name in the text changes nothing more."""
    r = table(spark, d, "conversations").filter("role = 'user'")
    said = r.select((F.col("conv_id") * 1000 + F.col("turn")).alias("review_id"), F.col("conv_id").alias("user_id"), F.col("text").alias("review_text"), (1 + F.length("text") % 5).cast("double").alias("stars"))
    aspects = said.select("review_id", F.lit(" Pace").alias("aspect")).unionByName(said.select("review_id", F.lit(" ").alias("aspect")))
    return reviews.tag_changes(said, said.select("review_id", F.lit("pace ").alias("tag")), aspects)


@query(tables(*PROFILES) + f""", pairs AS (SELECT user_id, movie_id FROM ratings) SELECT user_id, movie_id, round(sum({WEIGHTED.replace("WHEN 'genre' THEN 0.6", "WHEN 'genre' THEN 1.0").replace("WHEN 'tag' THEN 0.9", "WHEN 'tag' THEN 0.0")}), 6) AS boost FROM pairs JOIN terms USING (movie_id) JOIN affinity USING (user_id, dimension, key) GROUP BY 1, 2""")
def weighted_boosts(spark: SparkSession, d: str) -> DataFrame:
    """Boosts under weights that users set, each kept inside 0 and 1."""
    pairs = ratings(spark, d).select("user_id", "movie_id")
    found = profile.term_boosts(pairs, profile.movie_terms(movies(spark, d)), affinity(spark, d), profile.clamped_weights({"genre": 3.0, "tag": -1.0}))
    return found.groupBy("user_id", "movie_id").agg(F.round(F.sum("boost"), 6).alias("boost"))


# Evaluation


@query(tables(*EVALUATED) + """, g AS (SELECT user_id, sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg, count(*) AS n FROM truth JOIN ranked USING (user_id, movie_id) GROUP BY 1)
    SELECT 'popularity' AS model, round(avg(round(dcg / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))), 6)), 6) AS ndcg FROM g""")
def mean_ndcg(spark: SparkSession, d: str) -> DataFrame:
    test, ranked = test_pool(spark, d)
    scored = ranked.select("user_id", F.col("item_id").alias("movie_id"), (-F.col("rank")).alias("score"))
    return learning.closed_pool(scored, metrics.relevant(test), "score").select(F.lit("popularity").alias("model"), "ndcg")


@query()
def user_sample(spark: SparkSession, d: str) -> DataFrame:
    """The users of a sample of stated size, and their parts."""
    return learning.sampled_users(ratings(spark, d).select("user_id").distinct(), 60, 20)


# Texts


@query("""SELECT p_partkey AS id, p_name AS sought, p_name || ' (x)' AS unsuffixed, upper(substr(p_brand, 1, 1)) || lower(substr(p_brand, 2)) AS shown FROM part""")
def title_cleaning(spark: SparkSession, d: str) -> DataFrame:
    year = F.lit(1970) + F.col("p_size")
    raw = F.concat("p_name", F.when(F.col("p_size") % 2 == 0, " (a.k.a. Other) (1990)").otherwise(" (1985)"))
    suffixed = F.concat("p_name", F.lit(" (x) ("), year.cast("string"), F.lit(")"))
    return part(spark, d).select(F.col("p_partkey").alias("id"), text.search_title(raw).alias("sought"), text.without_year_suffix(suffixed, year).alias("unsuffixed"), F.initcap("p_brand").alias("shown"))


@query("""SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 'A one. B two! C three?' ELSE 'Only ' || p_name END AS opening, CASE WHEN p_size % 3 = 0 THEN p_name || chr(10) || chr(10) || p_type WHEN p_size % 3 = 1 THEN p_type END AS review FROM part""")
def text_parts(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("p_size") % 3
    whole = F.when(kind == 0, "A one. B two! C three? D four.").otherwise(F.concat(F.lit("Only "), "p_name"))
    summary, body = F.when(kind == 0, F.col("p_name")).otherwise(""), F.when(kind <= 1, F.col("p_type")).otherwise(" \n ")
    return part(spark, d).select(F.col("p_partkey").alias("id"), F.array_join(text.first_sentences(whole), " ").alias("opening"), text.review_text(summary, body).alias("review"))


@query("""SELECT p_partkey AS id, p_size % 4 < 2 AS valid, CASE WHEN p_size % 2 = 0 THEN p_size / 4.0::DOUBLE END AS number, md5(p_name) AS cache_key FROM part""")
def small_fields(spark: SparkSession, d: str) -> DataFrame:
    """User ids that are allowed, numbers that are none, and the key of a cached file."""
    kind = F.col("p_size") % 4
    name = F.when(kind == 0, "a-B_9").when(kind == 1, F.concat(F.lit("u"), F.col("p_partkey").cast("string"))).when(kind == 2, "no blank").otherwise(F.repeat(F.lit("x"), F.lit(65)))
    number = F.when(F.col("p_size") % 2 == 0, (F.col("p_size") / 4.0).cast("string")).otherwise("one")
    return part(spark, d).select(F.col("p_partkey").alias("id"), text.valid_user_id(name).alias("valid"), maths.safe_double(number).alias("number"), documents.cache_key(F.col("p_name")).alias("cache_key"))


@query("""SELECT p_partkey AS id, CASE WHEN p_size <= 6 THEN 'off' WHEN p_size <= 18 THEN 'subtle' WHEN p_size <= 30 THEN 'balanced' WHEN p_size <= 42 THEN 'strong' ELSE 'maximum' END AS label, 1990 + p_size % 10 AS year, repeat('█', p_size // 5) AS bar FROM part""")
def labels_shown(spark: SparkSession, d: str) -> DataFrame:
    """The nearest level of the slider, a year in free text, and a bar."""
    n = F.col("p_size")
    return part(spark, d).select(
        F.col("p_partkey").alias("id"), maths.lambda_label(n / 50.0).alias("label"), text.year_in(F.concat(F.lit("aired Dec 5, "), (1990 + n % 10).cast("string"), F.lit(", again 2001"))).alias("year"),
        text.bar(n / 50.0, 10).alias("bar"),
    )


@query("""SELECT p_partkey AS id, p_name || ' & <b> "' || p_type || '" ©' AS text FROM part""")
def html_entities(spark: SparkSession, d: str) -> DataFrame:
    return part(spark, d).select(F.col("p_partkey").alias("id"), text.unescape_html(F.concat("p_name", F.lit(" &amp; &lt;b&gt; &quot;"), "p_type", F.lit("&#34; &copy;"))).alias("text"))


@query(tables("ratings", "movies") + """, liked AS (SELECT DISTINCT user_id, collection FROM ratings JOIN movies USING (movie_id) WHERE rating >= 4) SELECT user_id, count(*) AS n FROM liked GROUP BY 1""")
def liked_brands(spark: SparkSession, d: str) -> DataFrame:
    return brand_likes(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
