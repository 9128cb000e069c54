"""Sources and sinks as queries: the driver's tables are written as raw files, read and written again by the engine's own readers and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrid.functions import documents
from reelgrid.operators import catalog
from reelgrid.sources import readers, sinks
from reelgrid.sources.shared import fresh

from .adapters import table
from .queries import query


def as_csv(df: DataFrame, name: str) -> str:
    """The path of df as CSV with a header; texts in quotes, quotes doubled."""
    path = fresh(df.sparkSession, name)
    df.write.option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", "").option("nullValue", "").csv(path)
    return path


def as_lines(df: DataFrame, name: str, broken: Column | None = None) -> str:
    """The path of df as JSON lines; where broken holds, half of the line is missing, and a blank line follows."""
    line = F.to_json(F.struct("*"))
    if broken is not None:
        line = F.when(broken, F.concat(F.substring(line, 1, 9), F.lit("\n"))).otherwise(line)
    path = fresh(df.sparkSession, name)
    df.select(line.alias("value")).write.text(path)
    return path


def part(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part")


# CSV


@query("""SELECT p_partkey AS movie_id, p_name AS title, CASE WHEN p_size % 5 <> 0 THEN 1970 + p_size END AS year, CASE WHEN p_size % 7 = 0 THEN '' ELSE p_type || '|' || p_brand END AS genres FROM part""")
def read_movies(spark: SparkSession, d: str) -> DataFrame:
    title = F.when(F.col("p_size") % 5 != 0, F.format_string("%s (%d) ", "p_name", F.lit(1970) + F.col("p_size"))).otherwise(F.col("p_name"))
    genres = F.when(F.col("p_size") % 7 == 0, "(no genres listed)").otherwise(F.concat_ws("|", "p_type", "p_brand"))
    raw = part(spark, d).select(F.col("p_partkey").alias("movieId"), F.trim(title).alias("title"), genres.alias("genres"))
    return readers.movies(spark, as_csv(raw, "movies")).withColumn("genres", F.array_join("genres", "|"))


@query("""SELECT p_partkey AS movie_id, 'tt' || lpad(CAST(p_partkey * 7 AS VARCHAR), 7, '0') AS imdb_id, CASE WHEN p_size > 9 THEN CAST(p_size AS BIGINT) END AS tmdb_id FROM part""")
def read_links(spark: SparkSession, d: str) -> DataFrame:
    raw = part(spark, d).select(F.col("p_partkey").alias("movieId"), (F.col("p_partkey") * 7).alias("imdbId"), F.when(F.col("p_size") > 9, F.col("p_size")).alias("tmdbId"))
    return readers.links(spark, as_csv(raw, "links"))


@query("""SELECT CAST(o_custkey AS VARCHAR) AS user_id, o_orderkey AS movie_id, (o_orderkey % 10 + 1) * 0.5::DOUBLE AS rating, CAST(epoch(o_orderdate) AS BIGINT) AS rated_at FROM orders""")
def read_ratings(spark: SparkSession, d: str) -> DataFrame:
    at = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("o_orderdate"))
    raw = table(spark, d, "orders").select(F.col("o_custkey").alias("userId"), F.col("o_orderkey").alias("movieId"), ((F.col("o_orderkey") % 10 + 1) * 0.5).alias("rating"), at.alias("timestamp"))
    return readers.ratings(spark, as_csv(raw, "ratings"))


@query("""SELECT CAST(user_id AS VARCHAR) AS user_id, event_id AS movie_id, event_type || ', "odd"' AS tag, event_id * 3 AS tagged_at FROM events WHERE event_id % 3 <> 0""")
def read_user_tags(spark: SparkSession, d: str) -> DataFrame:
    tag = F.when(F.col("event_id") % 3 != 0, F.concat("event_type", F.lit(', "odd"')))
    raw = table(spark, d, "events").select(F.col("user_id").alias("userId"), F.col("event_id").alias("movieId"), tag.alias("tag"), (F.col("event_id") * 3).alias("timestamp"))
    return readers.user_tags(spark, as_csv(raw, "tags"))


@query("""SELECT p_partkey AS movie_id, p_type AS tag, round(p_size / 50.0::DOUBLE, 6) AS relevance FROM part""")
def read_genome(spark: SparkSession, d: str) -> DataFrame:
    kinds = part(spark, d).select("p_type").distinct()
    tags = kinds.select(F.length("p_type").alias("tagId"), F.col("p_type").alias("tag"))
    tags = tags.withColumn("tagId", F.col("tagId") * 100 + F.ascii("tag"))
    scores = part(spark, d).select(F.col("p_partkey").alias("movieId"), (F.length("p_type") * 100 + F.ascii("p_type")).alias("tagId"), (F.col("p_size") / 50.0).alias("relevance"))
    t, s = readers.genome(spark, as_csv(tags, "genome-tags"), as_csv(scores, "genome-scores"))
    return s.join(F.broadcast(t), "tag_id").select("movie_id", "tag", F.round("relevance", 6).alias("relevance"))  # some thousand tags


@query("""SELECT 'The ' || p_name || ' ' || p_partkey AS title, 1970 + p_size AS year, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS DOUBLE) END AS critic_score, 50.5::DOUBLE AS audience_score,
    p_brand || '|' || p_type AS directors, CASE WHEN p_size > 25 THEN p_type ELSE '' END AS writers, regexp_replace(lower(p_name || p_partkey), '[^a-z0-9]', '', 'g') AS variant FROM part""")
def read_critic_metadata(spark: SparkSession, d: str) -> DataFrame:
    raw = part(spark, d).select(
        F.concat(F.lit("The "), "p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("movie_title"), F.concat(F.lit("Dec 5, "), (F.lit(1970) + F.col("p_size")).cast("string")).alias("original_release_date"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise("n/a").alias("tomatometer_rating"), F.lit("50.5").alias("audience_rating"),
        F.when(F.col("p_size") > 25, F.to_json(F.array("p_brand", "p_type"))).otherwise(F.concat("p_brand", F.lit(" , "), "p_type")).alias("directors"),
        F.when(F.col("p_size") > 25, F.col("p_type")).alias("authors"), F.lit("x").alias("actors"), F.lit("PG").alias("content_rating"),
    )
    read = readers.critic_metadata(spark, as_csv(raw, "critics"))
    return read.select("title", "year", "critic_score", "audience_score", F.array_join("directors", "|").alias("directors"), F.array_join("writers", "|").alias("writers"), F.col("variants")[0].alias("variant"))


@query("SELECT p_partkey AS movie_id, p_name AS title, CASE WHEN p_size > 10 THEN 1970 + p_size END AS year FROM part")
def read_top_list(spark: SparkSession, d: str) -> DataFrame:
    raw = part(spark, d).select(F.col("p_partkey").alias("movie_id"), F.col("p_name").alias("title"), F.when(F.col("p_size") > 10, (F.lit(1970) + F.col("p_size")).cast("string")).otherwise("soon").alias("year"))
    return readers.top_list(spark, as_csv(raw, "top"))


# JSON lines, some of them broken


@query("SELECT p_partkey AS movie_id, p_name || ' & <' || p_brand || '>' AS wiki_intro, p_type AS wiki_plot FROM part WHERE p_partkey % 10 <> 0")
def read_wiki(spark: SparkSession, d: str) -> DataFrame:
    raw = part(spark, d).select(F.col("p_partkey").alias("movie_id"), F.concat("p_name", F.lit(" &amp; &lt;"), "p_brand", F.lit("&gt;")).alias("intro"), F.col("p_type").alias("plot"))
    return readers.wiki_texts(spark, as_lines(raw, "wiki", F.col("movie_id") % 10 == 0))


@query("""SELECT p_partkey AS movie_id, 'critics' AS source, 'critic' AS domain, p_name AS review_text, CASE WHEN p_size % 2 = 0 THEN p_size / 10.0::DOUBLE END AS score, '2020-01-02' AS review_date FROM part WHERE p_size % 3 <> 0""")
def read_critic_reviews(spark: SparkSession, d: str) -> DataFrame:
    raw = part(spark, d).select(
        F.col("p_partkey").alias("movie_id"), F.when(F.col("p_size") % 3 != 0, F.concat(F.lit("  "), "p_name", F.lit(" "))).otherwise("  ").alias("review_text"),
        F.when(F.col("p_size") % 2 == 0, (F.col("p_size") / 10).cast("string")).otherwise("-").alias("rating"), F.lit("2020-01-02").alias("date_published"),
    )
    return readers.critic_reviews(spark, as_lines(raw, "critic-reviews"), "critics").drop("user_id")


@query("""SELECT p_partkey AS movie_id, 'fans' AS source, 'audience' AS domain, CASE WHEN k = 1 THEN p_brand || chr(10) || chr(10) || p_name ELSE p_type END AS review_text, CAST(k AS DOUBLE) AS score FROM part, (SELECT unnest([1, 2]) AS k)""")
def read_audience_reviews(spark: SparkSession, d: str) -> DataFrame:
    review = lambda summary, body, n: F.struct(summary.alias("summary"), body.alias("text"), F.lit(n).alias("rating"), F.lit(None).cast("string").alias("date"))
    raw = part(spark, d).select(F.col("p_partkey").alias("movie_id"), F.array(review(F.col("p_brand"), F.col("p_name"), "1"), review(F.lit(""), F.col("p_type"), "2"), review(F.lit(""), F.lit(" "), "3")).alias("reviews"))
    return readers.audience_reviews(spark, as_lines(raw, "audience-reviews"), "fans").drop("user_id", "review_date")


@query("SELECT p_partkey AS movie_id, 'PG' AS content_rating, p_brand AS directors, p_name || '|' || p_type AS actors FROM part")
def read_credits(spark: SparkSession, d: str) -> DataFrame:
    raw = part(spark, d).select(F.col("p_partkey").alias("movie_id"), F.lit("PG").alias("content_rating"), F.array("p_brand").alias("directors"), F.array("p_name", "p_type").alias("actors"))
    found = readers.scraped_credits(spark, as_lines(raw, "credits"))
    return found.select("movie_id", "content_rating", F.array_join("directors", "|").alias("directors"), F.array_join("actors", "|").alias("actors"))


def card_files(spark: SparkSession, d: str) -> dict[str, str]:
    """Cards of three tiers, of which the later ones have some items again."""
    p = part(spark, d)
    a = p.filter("p_size % 3 = 0").select(F.col("p_partkey").alias("movie_id"), F.col("p_name").alias("title"), F.array("p_type").alias("themes"), F.split("p_name", " ").alias("top_tags"))
    b = p.filter("p_size % 5 = 0").select(F.col("p_partkey").alias("movie_id"), F.upper("p_name").alias("title"), F.array(F.lit(0.5), F.lit(1.0)).alias("genome_vector"), F.array("p_brand").alias("user_tags"))
    c = p.filter("p_size % 7 = 0").select(F.col("p_partkey").alias("movie_id"), F.col("p_brand").alias("title"), F.when(F.col("p_size") > 30, "B").otherwise("").alias("tier"))
    return {"A": as_lines(a, "cards-a", F.col("movie_id") % 11 == 0), "B": as_lines(b, "cards-b"), "C": as_lines(c, "cards-c")}


CARDS = """cards AS (SELECT p_partkey AS movie_id, CASE WHEN p_size % 7 = 0 THEN p_brand WHEN p_size % 5 = 0 THEN upper(p_name) ELSE p_name END AS title,
    CASE WHEN p_size % 7 = 0 THEN CASE WHEN p_size > 30 THEN 'B' ELSE 'C' END WHEN p_size % 5 = 0 THEN 'B' ELSE 'A' END AS tier,
    CASE WHEN p_size % 7 = 0 THEN NULL WHEN p_size % 5 = 0 THEN p_brand ELSE replace(p_name, ' ', '|') END AS tags
    FROM part WHERE p_size % 7 = 0 OR p_size % 5 = 0 OR (p_size % 3 = 0 AND p_partkey % 11 <> 0))"""


@query(f"WITH {CARDS} SELECT movie_id, title, tier FROM cards")
def read_cards(spark: SparkSession, d: str) -> DataFrame:
    return readers.cards(spark, card_files(spark, d)).select("movie_id", "title", "tier")


@query("SELECT p_partkey AS movie_id FROM part WHERE p_size % 3 = 0 AND p_partkey % 11 <> 0")
def read_card_ids(spark: SparkSession, d: str) -> DataFrame:
    return readers.card_ids(spark, card_files(spark, d)["A"])


@query(f"""WITH {CARDS} SELECT p_partkey AS movie_id, coalesce(c.title, p_name) AS title, 1970 + p_size AS year, p_type AS genres, c.tier, coalesce(c.tags, '') AS tags FROM part LEFT JOIN cards c ON c.movie_id = p_partkey""")
def hydrate_cards(spark: SparkSession, d: str) -> DataFrame:
    """Candidates with their cards' fields first, then the catalogue's."""
    from .adapters import movies, stats

    hits = part(spark, d).select(F.col("p_partkey").alias("movie_id"))
    found = catalog.hydrate(hits, movies(spark, d), stats(spark, d), readers.cards(spark, card_files(spark, d)))
    tags = F.array_join(F.coalesce("top_tags", F.array().cast("array<string>")), "|")
    return found.select("movie_id", "title", "year", F.array_join("genres", "|").alias("genres"), "tier", tags.alias("tags"))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{'|'.join(v)}')" for k, v in readers.CONCEPTS.items()) + ") t(concept, terms)")
def concept_map(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(k, "|".join(v)) for k, v in readers.concept_map().items()], "concept string, terms string")


@query("SELECT p_partkey, p_name, CAST(NULL AS INTEGER) AS runtime, CAST(NULL AS VARCHAR) AS overview FROM part")
def evolved_schema(spark: SparkSession, d: str) -> DataFrame:
    return readers.evolved(part(spark, d).select("p_partkey", "p_name"), "runtime int, P_NAME string, overview string")


# Sinks


def reviews_of(spark: SparkSession, d: str, source: str, size: str) -> DataFrame:
    return part(spark, d).filter(size).select(F.col("p_partkey").alias("movie_id"), "p_name", F.lit(source).alias("source"))


@query("SELECT p_partkey AS movie_id, p_name, 'a' AS source FROM part WHERE p_size > 40 UNION ALL SELECT p_partkey, p_name, 'b' FROM part WHERE p_size <= 10")
def replace_sources(spark: SparkSession, d: str) -> DataFrame:
    """Two sources appended, one of them loaded anew: its rows take the place of the old ones."""
    path = fresh(spark, "reviews")
    sinks.append(reviews_of(spark, d, "a", "p_size <= 10"), path, ["source"])
    sinks.append(reviews_of(spark, d, "b", "p_size <= 10"), path, ["source"])
    sinks.replace_sources(reviews_of(spark, d, "a", "p_size > 40"), path)
    return spark.read.parquet(path).select("movie_id", "p_name", "source")


@query("SELECT p_partkey AS movie_id, p_brand AS title FROM part")
def publish_table(spark: SparkSession, d: str) -> DataFrame:
    """A table that is published twice: the second takes the first's place as a whole."""
    path = fresh(spark, "published")
    for column in ("p_name", "p_brand"):
        sinks.publish(part(spark, d).select(F.col("p_partkey").alias("movie_id"), F.col(column).alias("title")), path)
    return spark.read.parquet(path)


@query("SELECT p_partkey AS movie_id, p_name AS title FROM part WHERE p_size % 4 <> 0")
def unmatched_rows(spark: SparkSession, d: str) -> DataFrame:
    """What another source doesn't have, as the JSON file that was left for a third."""
    path = fresh(spark, "unmatched")
    rows = part(spark, d).select(F.col("p_partkey").alias("movie_id"), F.col("p_name").alias("title"))
    sinks.unmatched(rows, part(spark, d).filter("p_size % 4 = 0").select(F.col("p_partkey").alias("movie_id")), "movie_id", path)
    return readers.jsonl(spark, path, "movie_id long, title string")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS user_id, CASE WHEN c_custkey % 2 = 0 THEN 'second' ELSE 'first' END AS lived, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS version, c_custkey % 3 = 0 AS refused FROM customer""")
def profile_versions(spark: SparkSession, d: str) -> DataFrame:
    """Profiles of all users saved, those of every second one again, and those of every third with a version that has never been: refused."""
    path = fresh(spark, "profiles")
    store = sinks.ProfileStore(spark, path)
    users = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("user_id"), "c_custkey")
    document = lambda name, version: (F.to_json(F.struct(F.col("user_id"), F.lit(name).alias("name"))).alias("profile_json"), F.lit(version).cast("long").alias("version"))
    store.save(users.select("user_id", *document("first", None)))
    store.save(users.filter("c_custkey % 2 = 0").select("user_id", *document("second", 1)))
    refused = store.save(users.filter("c_custkey % 3 = 0").select("user_id", *document("late", 7)))
    now = store.current().select("user_id", F.get_json_object("profile_json", "$.name").alias("lived"), "version")
    return now.join(refused.select("user_id", F.lit(True).alias("refused")), "user_id", "left").withColumn("refused", F.coalesce("refused", F.lit(False)))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS user_id, CASE WHEN c_custkey % 2 = 0 THEN 0.25::DOUBLE ELSE 0.7::DOUBLE END AS slider, CAST(c_nationkey % 4 AS INTEGER) AS n_watched, 0 AS n_wanted FROM customer WHERE c_custkey % 5 <> 0""")
def profile_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents that lack most fields, read with their defaults; those that are no documents are set aside."""
    store = sinks.ProfileStore(spark, fresh(spark, "profiles"))
    history = F.slice(F.array(*[F.lit(i) for i in range(4)]), 1, (F.col("c_nationkey") % 4).cast("int"))
    some = F.when(F.col("c_custkey") % 2 == 0, F.to_json(F.struct(F.lit(0.25).alias("lambda"), history.alias("watch_history")))).otherwise(F.to_json(F.struct(history.alias("watch_history"))))
    text_ = F.when(F.col("c_custkey") % 5 == 0, F.when(F.col("c_custkey") % 2 == 0, "[1]").otherwise("{broken")).otherwise(some)
    store.save(table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("user_id"), text_.alias("profile_json"), F.lit(None).cast("long").alias("version")))
    good, _ = store.readable()
    return good.select("user_id", F.col("profile.lambda").alias("slider"), F.size("profile.watch_history").alias("n_watched"), F.size("profile.watchlist").alias("n_wanted"))


@query("""SELECT c_custkey AS user_id, list_sort(list_distinct([1, c_nationkey, 2]))[1]::BIGINT AS least_watched, len(list_distinct([1, c_nationkey, 2])) AS n_watched, CASE WHEN c_nationkey = 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS first_affinity,
    50 AS n_queries, 'q' || (c_nationkey + 59) AS last_query FROM customer""")
def profile_merge(spark: SparkSession, d: str) -> DataFrame:
    """Two versions of a profile joined: maps with the own value first, sets united, the last fifty queries."""
    queries = lambda start, n: F.transform(F.sequence(start, start + n - 1), lambda i: F.concat(F.lit("q"), i.cast("string")))
    n = F.col("c_nationkey")

    def version(watched: Column, genre: Column, value: float, asked: Column) -> Column:
        fields = {"watch_history": watched, "genre_affinity": F.create_map(genre, F.lit(value)), "query_history": asked}
        return documents.parsed_profile(F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()])))

    # a small file is one task, whatever is done to its rows
    users = table(spark, d, "customer").select("c_custkey", "c_nationkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    c = users.select(
        F.col("c_custkey").alias("user_id"), version(F.array(F.lit(1), n), F.lit("1"), 1.0, queries(n, 40)).alias("fresh"), version(F.array(F.lit(2), n), n.cast("string"), 2.0, queries(n + 30, 30)).alias("local")
    )
    merged = sinks.merged_profile(F.col("fresh"), F.col("local"))
    m = c.select("user_id", *[v.alias(k) for k, v in merged.items() if k != "user_id"])
    return m.select(
        "user_id", F.array_min("watch_history").alias("least_watched"), F.size("watch_history").cast("long").alias("n_watched"), F.element_at("genre_affinity", "1").alias("first_affinity"),
        F.size("query_history").alias("n_queries"), F.element_at("query_history", -1).alias("last_query"),
    )


@query("""SELECT CAST(c_custkey AS VARCHAR) AS user_id, CASE WHEN c_custkey % 3 = 0 THEN 'quiet' WHEN c_custkey % 3 = 1 THEN 'loud' END AS active, CASE WHEN c_custkey % 3 = 0 THEN 0.9::DOUBLE WHEN c_custkey % 3 = 1 THEN 0.5::DOUBLE ELSE 0.7::DOUBLE END AS slider,
    CASE WHEN c_custkey % 2 = 0 THEN 'quiet|loud' ELSE 'quiet|loud|odd' END AS names FROM customer""")
def presets(spark: SparkSession, d: str) -> DataFrame:
    """Settings that users made, changed, turned on and off, and deleted; the slider is the active one's, else the default."""
    users = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("user_id"), F.col("c_custkey").alias("k"))
    made = users.select("user_id", "k", F.posexplode(F.array(F.lit("quiet"), F.lit("loud"), F.lit("odd"))).alias("at", "name"))
    rows = made.select("user_id", "name", (F.col("at") * 0.5).alias("lambda_val"), F.lit(None).cast("string").alias("settings"), F.lit(False).alias("is_active"), F.timestamp_seconds(F.col("at") + 5).alias("created_at"))
    rows = sinks.updated_presets(rows, users.select("user_id", F.lit("quiet").alias("name"), F.lit(0.9).alias("lambda_val"), F.lit('{"ratings": false}').alias("settings")))
    rows = sinks.activated_presets(rows, users.select("user_id", F.lit("odd").alias("name")))
    rows = sinks.activated_presets(rows, users.select("user_id", F.when(F.col("k") % 3 == 0, "quiet").when(F.col("k") % 3 == 1, "loud").alias("name")))
    rows = sinks.without_presets(rows, users.filter("k % 2 = 0").select("user_id", F.lit("odd").alias("name")))
    listed = sinks.listed_presets(rows).select("user_id", F.array_join(F.transform("presets", lambda x: x["name"]), "|").alias("names"))
    active = sinks.active_presets(rows)
    return users.select("user_id").join(active.select("user_id", F.col("name").alias("active"), "lambda_val"), "user_id", "left").join(listed, "user_id").select("user_id", "active", F.coalesce("lambda_val", F.lit(0.7)).alias("slider"), "names")


@query("SELECT vec_id, len(embedding) AS size, 4 * len(embedding) AS n_bytes, 0 AS n_different FROM embeddings")
def packed_vectors(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").withColumn("packed", documents.packed_vector(F.col("embedding")))
    back = e.withColumn("back", documents.unpacked_vector(F.col("packed")))
    different = F.size(F.filter(F.zip_with("embedding", "back", lambda a, b: ~a.cast("float").eqNullSafe(b)), lambda x: x))
    return back.select("vec_id", F.size("embedding").cast("long").alias("size"), F.octet_length("packed").cast("long").alias("n_bytes"), different.alias("n_different"))


@query("SELECT user_id, count(*) AS n_rows, 1::BIGINT AS n_files FROM events GROUP BY 1")
def kept_results(spark: SparkSession, d: str) -> DataFrame:
    """Results under a key of who asked what, made once and read the second time."""
    cache = sinks.Results(spark, fresh(spark, "results"))
    made = []

    def make() -> DataFrame:
        made.append(1)
        return table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_rows"))

    for asked in ("Events ", "events"):
        found = cache.get(make, user="1", query=asked, top=10)
    return found.withColumn("n_files", F.lit(len(made)).cast("long"))
