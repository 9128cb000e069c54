"""Schemas of the raw files and of the catalogue's tables."""

MOVIES_CSV = "movieId long, title string, genres string"
LINKS_CSV = "movieId long, imdbId string, tmdbId long"
RATINGS_CSV = "userId long, movieId long, rating double, timestamp long"
TAGS_CSV = "userId long, movieId long, tag string, timestamp long"
GENOME_TAGS_CSV = "tagId int, tag string"
GENOME_SCORES_CSV = "movieId long, tagId int, relevance double"
TOP_LIST_CSV = "movie_id long, title string, year string"
CRITIC_CSV = (
    "movie_title string, original_release_date string, tomatometer_rating string, audience_rating string, directors string, authors string, actors string, content_rating string"
)

WIKI_JSON = "movie_id long, intro string, plot string"
CRITIC_REVIEWS_JSON = "movie_id long, review_text string, rating string, date_published string"
AUDIENCE_REVIEWS_JSON = "movie_id long, reviews array<struct<summary string, text string, rating string, date string>>"
CREDITS_JSON = "movie_id long, content_rating string, directors array<string>, actors array<string>, writers array<string>"
CARD_JSON = (
    "movie_id long, title string, year int, tier string, actors array<string>, directors array<string>, genres array<string>, content_rating string, "
    "original_language string, production_countries array<string>, collection string, poster_path string, backdrop_path string, tagline string, overview string, "
    "wiki_intro string, wiki_plot string, themes array<string>, tone array<string>, pacing string, directorial_style_notes string, comparable_films array<string>, "
    "standout_performances array<string>, notable_criticisms array<string>, top_tags array<string>, user_tags array<string>, keywords array<string>, genome_vector array<float>"
)

MOVIES = "movie_id long, title string, year int, runtime int, tmdb_id long, imdb_id string, budget long, overview string"
RATINGS = "user_id string, movie_id long, rating double, rated_at long"
USER_TAGS = "user_id string, movie_id long, tag string, tagged_at long"
REVIEWS = "movie_id long, user_id string, source string, domain string, review_text string, score double, review_date string"
MOVIE_STATS = "movie_id long, avg_rating double, num_ratings long, pct_positive double, popularity_rank long"
RULES = "item_a string, item_b string, support long, confidence double, lift double"
PROFILES = "user_id string, profile_json string, version long, updated_at timestamp"
PRESETS = "user_id string, name string, lambda_val double, settings string, is_active boolean, created_at timestamp"

#: Columns that later loaders add to tables: additive evolution.
MOVIES_ADDED = "content_rating string, directors string, actors string, writers string, rt_critic_score double, rt_audience_score double, wiki_intro string, wiki_plot string"
