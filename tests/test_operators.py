"""Operators on small hand-made frames, for what SQL comparison doesn't reach."""

import random
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from reelgrid.functions import documents, maths, ordering, text
from reelgrid.functions.ordering import rank_descending
from reelgrid.operators import account, catalog, diversity, fusion, learning, lexical, metrics, profile, ratings, reviews, rules, scoring, vectors
from reelgrid.plans import adapters, recommend, router, understanding
from reelgrid.sources import readers, sinks
from reelgrid.streaming import events as streams

from . import plain_mmr


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


# routes


@pytest.mark.parametrize(
    ("query", "kinds"),
    [
        ("", ["default"]),
        ("movies like Heat", ["associated"]),
        ("show me movies like Heat", ["associated"]),
        ("slow movies like heat", []),
        ("top 5 drama movies", ["top_by_genre"]),
        ("best movies", ["top_overall"]),
        ("top 10 all movies", ["top_overall"]),
        ("most popular comedy movies", ["top_by_genre"]),
        ("trending movies", ["top_overall"]),
        ("a film about trains", []),
    ],
)
def test_routes(spark, query, kinds):
    assert [r.kind for r in router.route(spark, query)] == kinds


def test_a_rated_word_is_taken_for_a_genre(spark):
    r = router.route(spark, "top 10 rated movies")[0]
    assert (r.kind, r.genre, r.limit) == ("top_by_genre", "rated", 10)


def test_associated_needs_an_unmodified_title(spark):
    assert router.route(spark, "similar to alien with less gore")[0].title == "alien with less gore"
    assert router.route(spark, "movies like heat, but funny") == []
    assert [(r.limit, r.genre, r.by) for r in router.route(spark, "trending horror movies")] == [(10, "horror", "popularity")]
    assert [(r.kind, r.limit) for r in router.route(spark, "top all movies")] == [("top_overall", 10)]
    assert router.route(spark, "find me movies like Heat")[0].title == "heat"
    assert router.route(spark, "sad movies like heat") == []


# understanding


@pytest.fixture
def titles(spark):
    return spark.createDataFrame([("heat", 1, 500), ("the heat", 2, 100), ("alien", 3, 900)], "key string, movie_id long, num_ratings long")


def test_understanding(spark, titles):
    cards = spark.createDataFrame([(3, ["Horror"], ["space"], ["tense"], ["a", "b"], ["Scott"])], "movie_id long, genres array<string>, themes array<string>, tone array<string>, top_tags array<string>, directors array<string>")
    u = understanding.Understanding(titles, tags=["noir", "ai"], cards=cards)
    got = u.parse("Movies like Alien but not slow")
    assert (got.intent_type, got.detected_title, got.matched_movie_id, got.pace, got.negations) == ("title_reference", "Alien", 3, "slow", ["slow"])
    assert got.expanded_query == "Movies like Alien but not Horror space tense a b Scott"
    got = u.parse("obscure korean horror noir")
    assert (got.genres, got.nation, got.tags, got.is_obscure) == (["Horror"], ("korean", "ko", "south korea"), ["noir"], True)
    assert got.expanded_query == "obscure korean horror noir south korea korean"
    assert u.parse("heat").matched_movie_id == 1
    assert "demons" in u.parse("dark magic").expanded_query


def test_understanding_of_batches(spark, titles):
    """The rules by hand, for a batch with titles that are named in part, tags of several words and cards."""
    asked = ["if i liked the heat", "similar to lien", "movies like it", "neo-noir with neo noir", "no ghosts, no war", "dark magic heat", None]
    df = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    tags = spark.createDataFrame([("Neo-Noir",), ("noir with",), ("it",), ("noi",)], "tag string")
    cards = spark.createDataFrame([(2, ["Crime"], ["a"] * 9)], "movie_id long, genres array<string>, top_tags array<string>")
    got = {r.query_id: r for r in understanding.parse_many(df, titles, tags, cards).collect()}
    assert len(got) == len(asked)
    assert (got[0].matched_movie_id, got[0].detected_title, got[0].expanded_query) == (2, "The Heat", "if i liked the heat Crime" + " a" * 8)
    assert (got[1].matched_movie_id, got[1].intent_type) == (3, "title_reference")
    assert (got[2].matched_movie_id, got[2].intent_type, got[2].tags) == (None, "title_reference", [])
    assert got[3].tags == ["Neo-Noir", "noir with"]
    assert got[4].negations == ["ghosts", "war"]
    assert (got[5].matched_movie_id, got[5].expanded_query) == (None, "dark magic heat demons supernatural occult dark fantasy magic exorcism hell supernatural fantasy wizards sorcery magic")
    assert (got[6].intent_type, got[6].matched_movie_id) == ("general_search", None)


# diversity


def item(key, *genres):
    return plain_mmr.item(key, genres)


def test_likeness():
    assert plain_mmr.similarity(item("coll:x"), item("coll:x")) == 0.97
    assert plain_mmr.similarity(item("stem:alien"), item("stem:aliens")) == 0.90
    assert plain_mmr.similarity(item("stem:toy story"), item("coll:toy stories")) == 0.0
    assert plain_mmr.similarity(item("stem:evil dead"), item("stem:return evil dead")) == 0.90
    assert abs(plain_mmr.similarity(item("stem:a", "x", "y"), item("stem:b", "y", "z")) - 0.1) < 1e-12
    assert plain_mmr.similarity(item("stem:a"), item("stem:b", "y")) == 0.0


def test_franchises_are_capped_until_only_they_are_left():
    items = [item("coll:x"), item("coll:x"), item("coll:x"), item("stem:b", "g")]
    assert plain_mmr.select([0.9, 0.8, 0.7, 0.1], items, 4, 0.75, 2) == [0, 1, 3, 2]


def test_equal_scores_keep_their_order():
    assert plain_mmr.select([1.0, 1.0, 1.0], [item(f"stem:{c}") for c in "abc"], 3, 0.75, 2) == [0, 1, 2]


def test_diversified_lists(spark):
    df = spark.createDataFrame([(1, 10, 0.9, "Alien", None, ["Horror"]), (1, 11, 0.72, "Aliens", None, ["Horror"]), (1, 12, 0.7, "Heat", None, ["Crime"]), (2, 10, 0.5, None, "A Collection", None)], "query_id long, movie_id long, final_score double, title string, collection string, genres array<string>")
    got = rows(diversity.diversified(df, 2), "query_id", "final_rank", "movie_id")
    assert got == [(1, 1, 10), (1, 2, 12), (2, 1, 10)]


def test_diversified_lists_are_those_of_the_plain_version(spark):
    draw = random.Random(3)
    titles = ["Alien", "Aliens", "Alien: Covenant", "The Heat", "Heat 2", "Return of Evil Dead", "Evil Dead", "S", "ss", "The", "", "A b", "B a b", None, "Toy  Story"]
    data = []
    for q in range(60):
        for i in range(draw.randrange(1, 40)):
            genres = draw.choice([None, [], ["x"], ["x", "y", "x"], ["y", None], ["z"]])
            data.append((q, i, draw.choice([None, 0.5, draw.random()]), draw.choice(titles), draw.choice([None, "", "Alien Collection", "Toys"]), genres))
    df = spark.createDataFrame(data, "query_id long, movie_id long, final_score double, title string, collection string, genres array<string>")
    keys = {(r.query_id, r.movie_id): r.k for r in df.select("query_id", "movie_id", text.franchise_key(F.col("collection"), F.col("title")).alias("k")).collect()}
    for n, weight, cap in ((10, 0.75, 2), (5, 0.3, 1), (50, 1.0, 3)):
        want = []
        for q in range(60):
            group = sorted((r for r in data if r[0] == q), key=lambda r: (-(r[2] or 0.0), r[1]))
            places = plain_mmr.select([r[2] or 0.0 for r in group], [plain_mmr.item(keys[q, r[1]], r[5] or []) for r in group], n, weight, cap)
            want += [(q, k + 1, group[p][1]) for k, p in enumerate(places)]
        assert rows(diversity.diversified(df, n, weight, cap), "query_id", "final_rank", "movie_id") == want


def test_diversifying_needs_no_python_worker(spark):
    df = spark.createDataFrame([], "query_id long, movie_id long, final_score double, title string, collection string, genres array<string>")
    plan = diversity.diversified(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan


# scores


def scored(spark, **changes):
    base = {"query": "space", "movie_id": 1, "rerank_score": 0.5, "profile_boost": 0.0, "is_watched": False, "avg_rating": 4.0, "num_ratings": 300, "year": 2019, "genres": ["Drama"]}
    base |= changes
    df = spark.createDataFrame([base], "query string, movie_id long, rerank_score double, profile_boost double, is_watched boolean, avg_rating double, num_ratings long, year int, genres array<string>" + "".join(f", {k} array<string>" if isinstance(v, list) else f", {k} string" for k, v in changes.items() if k in ("tone", "top_tags", "themes", "matched_genres", "genre_strictness", "demonym_lang", "demonym_country", "original_language", "production_countries")))
    return scoring.semantic(df, digits=9).first().final_score


def test_scoring_rules(spark):
    plain = scored(spark)
    assert abs(scored(spark, matched_genres=["Horror"]) / plain - 0.3) < 1e-6
    assert abs(scored(spark, matched_genres=["Horror"], genre_strictness="soft_preference") / plain - 0.75) < 1e-6
    assert abs(scored(spark, matched_genres=["drama"]) - plain) < 1e-9
    assert abs(scored(spark, query="grim space", tone=["Slapstick humor"]) - (plain - 0.5)) < 1e-6
    assert abs(scored(spark, query="grim space", genres=["Comedy"]) - (plain - 0.3)) < 1e-6
    assert abs(scored(spark, query="grim space", genres=["Comedy", "Crime"]) - plain) < 1e-9
    assert abs(scored(spark, query="zombies") / plain - 0.3) < 1e-6
    assert abs(scored(spark, query="zombies", themes=["a zombie outbreak"]) - plain) < 1e-9
    assert abs(scored(spark, query="zombies", genres=["Horror"]) - plain) < 1e-9
    assert abs(scored(spark, demonym_lang="ko", original_language="KO") / plain - 1.85) < 1e-6
    assert abs(scored(spark, demonym_country="korea", production_countries=["South Korea"]) / plain - 1.85) < 1e-6
    assert scored(spark, year=1960) < plain
    assert abs(scored(spark, year=1960, query="classic space") - plain) < 1e-9
    assert scored(spark, is_watched=True) == -10.0
    assert scored(spark, rerank_score=None) < plain


def test_direct_lists_use_lift_then_confidence_then_place(spark):
    df = spark.createDataFrame([("u", 1, 3.0, 0.5, 0.0, False), ("u", 2, None, 1.0, 0.0, False), ("u", 3, None, None, 0.0, True)], "user_id string, place int, lift double, confidence double, profile_boost double, is_watched boolean")
    got = {r.place: r.final_score for r in scoring.fast_path(df).collect()}
    assert got[1] == 0.85 and got[3] == -10.0
    assert abs(got[2] - round(0.7 * (1 - 1 / 3) / (3 - 1 / 3) + 0.15, 6)) < 1e-6


# profiles


def test_clamped_sum_is_ordered(spark):
    terms = spark.createDataFrame([(i, "genre", "g") for i in range(12)], "movie_id long, dimension string, key string")
    marks = [5.0] * 5 + [1.0] * 2
    r = spark.createDataFrame([("u", i, s, i) for i, s in enumerate(marks)], "user_id string, movie_id long, rating double, rated_at long")
    got = profile.affinities(profile.rating_events(r, terms)).first()
    assert (got.affinity, got.confidence) == (1.0, 7)  # 3 at most, then two steps down


def test_tags_come_after_ratings_of_the_same_second(spark):
    terms = spark.createDataFrame([(1, "tag", "noir")], "movie_id long, dimension string, key string")
    r = spark.createDataFrame([("u", 1, 5.0, 10)], "user_id string, movie_id long, rating double, rated_at long")
    t = spark.createDataFrame([("u", 1, "noir", 10)], "user_id string, movie_id long, tag string, tagged_at long")
    both = profile.rating_events(r, terms).unionByName(profile.tag_events(t))
    assert rows(profile.running_affinities(both), "kind", "affinity") == [(0, 1.0), (1, 1.3)]


def test_boosts(spark):
    movies = spark.createDataFrame([(1, ["Drama"], ["D"], ["A", "A"], 1994, "R"), (2, ["Gore Fest"], [], [], None, None)], "movie_id long, genres array<string>, directors array<string>, actors array<string>, year int, content_rating string")
    terms = profile.movie_terms(movies)
    affinity = spark.createDataFrame(
        [("u", "genre", "Drama", 1.0, 9), ("u", "director", "D", 1.0, 2), ("u", "actor", "A", 2.0, 3), ("u", "era", "1990s", 1.0, 1), ("u", "content_rating", "R", 1.0, 1)],
        "user_id string, dimension string, key string, affinity double, confidence long",
    )
    pairs = spark.createDataFrame([("u", 1), ("u", 2), ("v", 1)], "user_id string, movie_id long")
    seen = spark.createDataFrame([("v", 1)], "user_id string, movie_id long")
    bad = spark.createDataFrame([("u", "GORE"), ("v", "")], "user_id string, dealbreaker string")
    got = {(r.user_id, r.movie_id): r.profile_boost for r in profile.profile_boost(pairs, terms, affinity, seen, bad).collect()}
    assert got == {("u", 1): 2.6, ("u", 2): -10.0, ("v", 1): -10.0}


def test_seeds_watchlist_history(spark):
    seeds = spark.createDataFrame([("u", ["Drama"], ["1990s", "nineties"], None)], "user_id string, genres array<string>, eras array<string>, languages array<string>")
    assert rows(profile.affinities(profile.seed_events(seeds)), "dimension", "key", "affinity", "confidence") == [("era", "1990s", 0.8, 1), ("genre", "Drama", 0.8, 3)]
    r = spark.createDataFrame([("u", 1, 4.0, 10), ("u", 2, 4.0, 30)], "user_id string, movie_id long, rating double, rated_at long")
    added = spark.createDataFrame([("u", 1, 20), ("u", 2, 20), ("u", 3, 5)], "user_id string, movie_id long, added_at long")
    assert rows(profile.watchlist(added, r), "movie_id") == [(1,), (3,)]
    cleared = spark.createDataFrame([("u", 15)], "user_id string, cleared_at long")
    left = spark.createDataFrame([("u", 9, 40)], "user_id string, movie_id long, abandoned_at long")
    assert rows(profile.watched(r, abandoned=left, cleared=cleared), "movie_id") == [(2,), (9,)]
    q = spark.createDataFrame([("u", f"q{i}", i) for i in range(60)] + [("w", "x", 1)], "user_id string, query string, asked_at long")
    off = spark.createDataFrame([("w",)], "user_id string")
    assert profile.recent_queries(q, disabled=off).count() == 50
    assert profile.recent_queries(q, cleared=spark.createDataFrame([("u", 57)], "user_id string, cleared_at long")).filter("user_id = 'u'").count() == 2


# ratings, rules, catalogue


def test_ranks_with_ties(spark):
    df = spark.createDataFrame([(1, 5, 4.0), (2, 5, 4.0), (3, 5, 3.0), (4, 9, 1.0)], "id long, n long, a double")
    assert rows(rank_descending(df, "n", "a", "rank"), "id", "rank") == [(1, 2), (2, 2), (3, 4), (4, 1)]


def test_associated_leaves_comedies_out(spark):
    movies = spark.createDataFrame([(1, "A", ["Drama"]), (2, "B", ["Drama", "Comedy"]), (3, "C", ["Drama"]), (4, "D", ["War"])], "movie_id long, title string, genres array<string>")
    found = spark.createDataFrame([(1, 2, 9.0, 0.5), (1, 3, 2.0, 0.5), (1, 4, 5.0, 0.5), (2, 3, 1.5, 0.1)], "item_a long, item_b long, lift double, confidence double")
    assert rows(rules.associated(movies.filter("movie_id = 1"), found, movies), "movie_id") == [(3,)]
    assert rows(rules.associated(movies.filter("movie_id = 2"), found, movies), "movie_id") == [(3,)]


def test_rules_cap_users_and_need_support(spark):
    liked = spark.createDataFrame([(u, i, 5.0) for u in range(4) for i in "ab"] + [(9, "a", 5.0), (9, "c", 4.0)], "user_id long, item string, rating double")
    got = rules.association_rules(liked, min_support=2, min_lift=0.0)
    assert rows(got, "item_a", "item_b", "support", "confidence", "lift") == [("a", "b", 4, 0.8, 1.0), ("b", "a", 4, 1.0, 1.0)]


def test_best_title_prefers_exact(spark):
    m = spark.createDataFrame([(1, "Heat"), (2, "The Heat"), (3, "Heatwave")], "movie_id long, title string")
    s = spark.createDataFrame([(1, 5), (2, 50), (3, 500)], "movie_id long, num_ratings long")
    assert ratings.best_title(m, s, "The Heat").first().movie_id == 2
    assert ratings.best_title(m, s, "wave").first().movie_id == 3


def test_cards_and_hydration(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"movie_id": 1, "title": "Heat (1995)", "year": 1995, "themes": ["x"], "genres": ["Card"]}\n{broken\n\n{"movie_id": 2, "title": ""}\n')
    (tmp_path / "b.jsonl").write_text('{"movie_id": 2, "title": "Two", "genome_vector": [0.5], "top_tags": [], "user_tags": ["u"]}\n{"movie_id": 5}\n')
    cards = readers.cards(spark, {"A": str(tmp_path / "a.jsonl"), "C": str(tmp_path / "b.jsonl")})
    assert rows(cards, "movie_id", "tier") == [(1, "A"), (2, "B"), (5, "C")]
    m = spark.createDataFrame([(1, "DB", 1990, ["Crime", "Action"]), (2, "DB2", 1991, [])], "movie_id long, title string, year int, genres array<string>")
    s = spark.createDataFrame([(1, 4.0, 10, 50.0, 7), (2, 0.0, 0, 0.0, 9)], "movie_id long, avg_rating double, num_ratings long, pct_positive double, popularity_rank long")
    hits = spark.createDataFrame([(1,), (2,), (7,)], "movie_id long")
    got = {r.movie_id: r for r in catalog.hydrate(hits, m, s, cards).collect()}
    assert (got[1].title, got[1].genres, got[1].avg_rating, got[1].tier) == ("Heat", ["Action", "Crime"], 4.0, "A")
    assert (got[2].title, got[2].avg_rating, got[2].top_tags) == ("Two", None, ["u"])
    assert (got[7].title, got[7].popularity_rank, got[7].num_ratings) == ("Movie #7", 999_999, 0)


def test_csv_readers(spark, tmp_path):
    (tmp_path / "m.csv").write_text('movieId,title,genres\n1,"Heat, The (1995)",Action|Crime\n2,Odd,(no genres listed)\n')
    assert rows(readers.movies(spark, str(tmp_path / "m.csv")), "movie_id", "title", "year", "genres") == [(1, "Heat, The", 1995, ["Action", "Crime"]), (2, "Odd", None, [])]
    (tmp_path / "t.csv").write_text("userId,movieId,tag,timestamp\n1,1,noir,5\n1,2,,6\n")
    assert readers.user_tags(spark, str(tmp_path / "t.csv")).count() == 1
    (tmp_path / "r.jsonl").write_text('{"movie_id": 1, "reviews": [{"summary": "S &amp; T", "text": "body", "rating": "8", "date": "2001-01-01"}, {"summary": "", "text": null, "rating": "x"}]}\n')
    got = readers.audience_reviews(spark, str(tmp_path / "r.jsonl"), "site").collect()
    assert [(r.review_text, r.score, r.domain) for r in got] == [("S & T\n\nbody", 8.0, "audience")]
    assert "dark magic" in readers.concept_map(str(tmp_path / "none.json"))


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "table")
    sinks.publish(spark.range(3), path)
    sinks.publish(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5
    assert len(list(tmp_path.iterdir())) == 1
    by_source = str(tmp_path / "reviews")
    sinks.replace_sources(spark.createDataFrame([(1, "a"), (2, "b")], "id long, source string"), by_source)
    sinks.replace_sources(spark.createDataFrame([(3, "a")], "id long, source string"), by_source)
    assert rows(spark.read.parquet(by_source), "id") == [(2,), (3,)]


def test_profile_versions(spark, tmp_path):
    store = sinks.ProfileStore(spark, str(tmp_path / "profiles"))
    first = spark.createDataFrame([("u", '{"user_id": "u", "watch_history": [1]}', None), ("v", "broken", None)], "user_id string, profile_json string, version long")
    assert store.save(first).count() == 0
    change = spark.createDataFrame([("u", '{"user_id": "u"}', 1), ("v", "{}", 0)], "user_id string, profile_json string, version long")
    refused = store.save(change)
    assert rows(refused, "user_id") == [("v",)]
    assert rows(store.current(), "user_id", "version") == [("u", 2), ("v", 1)]
    good, bad = store.readable()
    assert (rows(good, "user_id"), rows(bad, "user_id")) == ([("u",)], [("v",)])


def test_one_of_two_savers_of_a_version_is_refused(spark, tmp_path):
    """Another saver comes in after the comparison and before the claim: the first compares again."""
    row = lambda name, version: spark.createDataFrame([("u", name, version)], "user_id string, profile_json string, version long")
    store = sinks.ProfileStore(spark, str(tmp_path / "profiles"))
    store.save(row("first", None))

    class Slow(sinks.ProfileStore):
        met = False

        def current(self):
            found = super().current()
            if not self.met:
                self.met = True
                found = spark.createDataFrame(found.collect(), found.schema)
                assert store.save(row("other", 1)).count() == 0
            return found

    assert rows(Slow(spark, store.path).save(row("late", 1)), "profile_json") == [("late",)]
    assert rows(store.current(), "profile_json", "version") == [("other", 2)]


def saving(profile, version):
    return [("u", profile, version)], "user_id string, profile_json string, version long"


def test_a_saver_that_stalls_before_its_commit_is_refused_later(spark, tmp_path):
    store = sinks.ProfileStore(spark, str(tmp_path / "profiles"))
    store.save(spark.createDataFrame(*saving("first", None)))

    class Stalled(sinks.States):
        woken = False

        def append(self, *found):
            if not self.woken:
                self.woken = True
                for version in (1, 2):  # nobody waits for the stalled saver
                    assert store.save(spark.createDataFrame(*saving(f"other {version}", version))).count() == 0
            return super().append(*found)

    late = sinks.ProfileStore(spark, store.path)
    late.states = Stalled(spark, store.path)
    assert rows(late.save(spark.createDataFrame(*saving("stalled", 1))), "profile_json") == [("stalled",)]
    assert rows(store.current(), "profile_json", "version") == [("other 2", 3)]
    assert rows(store.log(), "version") == [(1,), (2,), (3,)]


def test_rows_of_a_saver_that_was_lost_are_not_read(spark, tmp_path):
    store = sinks.ProfileStore(spark, str(tmp_path / "profiles"))
    store.save(spark.createDataFrame(*saving("first", None)))
    spark.createDataFrame([("u", "lost", 2)], "user_id string, profile_json string, version long").write.parquet(f"{store.path}/rows/lost")
    assert rows(store.current(), "profile_json") == [("first",)]


def test_of_many_savers_at_once_one_commits_each_state(spark, tmp_path):
    path = str(tmp_path / "state")
    with ThreadPoolExecutor(16) as pool:
        made = list(pool.map(lambda i: sinks.created(spark, path, [str(i)] * 50), range(64)))
    assert made.count(True) == 1
    assert (tmp_path / "state").read_text().split() == [str(made.index(True))] * 50
    assert [p.name for p in tmp_path.iterdir()] == ["state"]


def test_a_log_put_together_keeps_all_versions(spark, tmp_path):
    store = sinks.ProfileStore(spark, str(tmp_path / "profiles"))
    for version in (None, 1, 2):
        store.save(spark.createDataFrame(*saving(f"after {version}", version)))
    before = rows(store.log(), *store.log().columns)
    assert store.compact() and len(store.states.last()[1]) == 1
    assert rows(store.log(), *store.log().columns) == before
    assert store.save(spark.createDataFrame(*saving("more", 3))).count() == 0
    assert rows(store.current(), "profile_json", "version") == [("more", 4)]


def test_users_are_listed_newest_first(spark, tmp_path):
    store = sinks.ProfileStore(spark, str(tmp_path / "profiles"))
    for name, seen in (("u", "[1]"), ("v", "[1, 2]"), ("w", "[]")):
        store.save(spark.createDataFrame([(name, f'{{"user_id": "{name}", "watch_history": {seen}}}', None)], "user_id string, profile_json string, version long"))
    assert [(r.user_id, r.num_watched) for r in store.summaries().collect()] == [("w", 0), ("v", 2), ("u", 1)]


def test_presets(spark):
    p = spark.createDataFrame([("u", "a", True), ("u", "b", False), ("w", "a", True)], "user_id string, name string, is_active boolean")
    chosen = lambda *x: spark.createDataFrame(x, "user_id string, name string")
    assert rows(sinks.activated_presets(p, chosen(("u", "b"))), "user_id", "name", "is_active") == [("u", "a", False), ("u", "b", True), ("w", "a", True)]
    assert rows(sinks.activated_presets(p, chosen(("u", None))).filter("is_active"), "user_id") == [("w",)]
    assert sinks.without_presets(p, chosen(("u", "a"))).count() == 2


# retrieval


def test_fusion_ties_go_to_the_earlier_lane(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, item_id long, lane_rank long")
    b = spark.createDataFrame([(1, 12, 1), (1, 11, 2)], "query_id long, item_id long, lane_rank long")
    got = fusion.reciprocal_rank({"bm25": a, "dense": b}).orderBy("rrf_rank").collect()
    assert [r.item_id for r in got] == [11, 10, 12]
    assert got[0].lane_ranks == {"bm25": 2, "dense": 2}
    assert got[0].rrf_score == round(2 / 62, 5)


def test_rerank_overflow_and_models(spark):
    c = spark.createDataFrame([(1, 1), (1, 2)], "query_id long, item_id long")
    s = spark.createDataFrame([(1, 1, 0.8)], "query_id long, item_id long, score double")
    assert rows(fusion.with_rerank(c, s), "item_id", "rerank_score") == [(1, 0.8), (2, 0.4)]
    pairs = spark.createDataFrame([(1, 1, "a b", "x a"), (1, 2, "a b", "z")], "query_id long, item_id long, query string, passage string")
    assert rows(fusion.lexical_rerank(pairs), "item_id", "score") == [(1, 0.5), (2, 0.0)]
    assert rows(fusion.model_rerank(pairs, lambda: lambda q, p: [float(len(x)) for x in p]), "item_id", "score") == [(1, 3.0), (2, 1.0)]


def test_pivot_and_tag_lane(spark):
    scores = spark.createDataFrame([(1, 1, 0.6), (1, 3, 0.8), (2, 2, 1.0)], "movie_id long, tag_id int, relevance double")
    assert [round(x, 3) for x in vectors.pivoted(scores, 3).filter("movie_id = 1").first().vector] == [0.6, 0.0, 0.8]
    tags = spark.createDataFrame([(1, "space"), (2, "dark comedy"), (3, "noir")], "tag_id int, tag string")
    q = spark.createDataFrame([(7, "space comedy")], "query_id long, text string")
    asked = vectors.tag_query(q, tags)
    assert [(t, round(w, 4)) for t, w in rows(asked, "tag_id", "weight")] == [(1, 0.9701), (2, 0.2425)]
    assert rows(vectors.nearest_to_tags(asked, scores), "item_id", "lane_rank") == [(1, 1), (2, 2)]


# evaluation


def test_ndcg_agrees_with_sparks(spark):
    from pyspark.mllib.evaluation import RankingMetrics

    ranked = spark.createDataFrame([("u", i, i) for i in range(1, 9)], "user_id string, item_id long, rank int")
    truth = spark.createDataFrame([("u", 1), ("u", 3), ("u", 99)], "user_id string, item_id long")
    ours = metrics.ndcg_at_k(ranked, truth, 5).first().ndcg
    theirs = RankingMetrics(spark.sparkContext.parallelize([([float(i) for i in range(1, 9)], [1.0, 3.0, 99.0])])).ndcgAt(5)
    assert abs(ours - theirs) < 1e-5


def test_distance_of_lists_without_vectors(spark):
    lists = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 1, 1), ("a", 3, 3)], "list_id string, item_id long, rank int")
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [0.0, 0.0])], "item_id long, vector array<float>")
    assert rows(metrics.intra_list_distance(lists, v), "list_id", "ild") == [("a", 1.0), ("b", 0.0)]


def test_splits(spark):
    r = spark.createDataFrame([("u", i, 3.0, i // 2) for i in range(7)] + [("v", 1, 3.0, 1)], "user_id string, movie_id long, rating double, rated_at long")
    assert metrics.time_split(r, 2).filter("is_test").count() == 3
    got = metrics.half_split(r, 3)
    assert rows(got.filter("is_profile"), "movie_id") == [(0,), (1,), (2,)]
    assert got.filter("not is_profile").count() == 4


def test_a_model_can_be_kept(spark, tmp_path):
    df = spark.createDataFrame([(*[float(i % 7 + k) for k in range(12)], float(i % 7)) for i in range(60)], ", ".join(f"{f} double" for f in learning.FEATURES) + ", label double")
    model = learning.train(df, trees=3, depth=2)
    learning.save(model, str(tmp_path / "model"))
    again = learning.load(str(tmp_path / "model"))
    assert rows(again.transform(df), "prediction") == rows(model.transform(df), "prediction")
    assert abs(sum(learning.importances(model).values()) - 1) < 1e-6


# reviews


def test_reviews(spark):
    r = spark.createDataFrame([(1, "u", "Oh great, a boring waste", 5.0), (2, "u", None, 1.0), (3, "u", "An amazing NOIR", 5.0)], "review_id long, user_id string, review_text string, stars double")
    got = {x.review_id: x for x in reviews.with_confidence(r).collect()}
    assert got[1].sarcasm_risk == round(0.7 * (1 - 1 / 3) + 0.3, 6)
    assert (got[2].sarcasm_risk, got[2].confidence, got[3].sarcasm_risk) == (0.0, 1.0, 0.0)
    found = reviews.found_tags(r, spark.createDataFrame([("noir",), ("Amazing N",), ("oir",)], "tag string"))
    assert rows(found, "review_id", "tag") == [(3, "Amazing N"), (3, "noir")]
    assert "Cartesian" not in (plan := found._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in plan
    aspects = spark.createDataFrame([(3, " Noir ")], "review_id long, aspect string")
    assert rows(reviews.tag_changes(r, found, aspects), "tag", "delta") == [("amazing n", 0.3), ("noir", 0.4)]
    answers = spark.createDataFrame([(1, 0, 5.0), (1, 1, 2.0), (2, 0, None)], "review_id long, place int, score double")
    assert rows(reviews.weighted_stars(answers), "review_id", "stars") == [(1, round(6.6 / 1.8, 6)), (2, 3.0)]


# whole way


def test_search_routes_and_pipeline(spark, sf_dir):
    from reelgrid.operators import lexical
    from reelgrid.plans import adapters, queries

    m, s = adapters.movies(spark, sf_dir).cache(), adapters.stats(spark, sf_dir).cache()
    docs = m.select(F.col("movie_id").alias("doc_id"), F.col("title").alias("text"))
    index, facts = lexical.postings(docs), lexical.corpus_facts(docs)
    found = rules.association_rules(rules.likes(adapters.ratings(spark, sf_dir), "movie_id"), min_support=1)
    c = recommend.Catalogue(m, s, index, facts, lexical.inverse_frequencies(lexical.document_frequencies(index), facts), rules=found)
    person = recommend.Person(queries.affinity(spark, sf_dir), adapters.ratings(spark, sf_dir).select("user_id", "movie_id"))
    u = understanding.Understanding(understanding.titles_of(m, s))
    direct = recommend.search("top 8 economy movies", c, "1", person, u, top=5).collect()
    assert len(direct) == 5 and [r.final_rank for r in direct] == [1, 2, 3, 4, 5]
    default = recommend.search("", c, "1", person, u, least=5).collect()
    assert len(default) == 10
    words = recommend.search("a red ring", c, "1", person, u).collect()
    assert words and all("red" in r.title or "ring" in r.title for r in words[:3])


# streams


LIVE = "user_id string, ts timestamp, kind int, place string, dimension string, key string, weight double"


def lived(spark, folder, feeds, late="10 seconds"):
    """What live_affinities settles of feeds, each a list of arrivals (lists of user, second, place, key, weight)."""
    parts = []
    for n, arrivals in enumerate(feeds):
        for arrival in arrivals:
            found = [(u, datetime.fromtimestamp(s, timezone.utc), 0, p, "genre", k, w) for u, s, p, k, w in arrival]
            spark.createDataFrame(found, LIVE).coalesce(1).write.mode("append").parquet(str(folder / f"in{n}"))
        parts.append(spark.readStream.schema(LIVE).option("maxFilesPerTrigger", 1).parquet(str(folder / f"in{n}")))
    with streams.stores_of_state(spark):
        return streams.drained(streams.live_affinities(parts, late), str(folder / "out"), str(folder / "checkpoint"))


def test_live_affinities_agree_with_the_batch_in_any_order_of_arrival(spark, tmp_path):
    draw = random.Random(5)
    happened = [(draw.choice("uv"), s, str(i), draw.choice("gh"), draw.choice([2.0, -2.0, 0.5, None])) for i, s in enumerate(sorted(draw.randrange(100, 160) for _ in range(120)))]
    arrived = sorted(happened, key=lambda r: r[1] + draw.random() * 9)
    arrived.append(("u", 200, "end", "g", 1.0))
    feeds = [[arrived[i : i + 30 + j] for i in range(0, len(arrived), 30 + j)] for j in (0, 7)]
    feeds[1] = [[(u, s, p + "b", k, w) for u, s, p, k, w in a] for a in feeds[1]]
    settled = lived(spark, tmp_path, feeds)
    past = [(u, s, 0, p, "genre", k, w) for f in feeds for a in f for u, s, p, k, w in a if s <= 190]
    batch = profile.affinities(spark.createDataFrame(past, LIVE.replace("timestamp", "long")))
    assert settled.count() > 4
    assert rows(streams.current(settled), "user_id", "key", "affinity", "confidence") == rows(batch, "user_id", "key", "affinity", "confidence")


def test_live_affinities_leave_out_what_comes_behind_the_watermark(spark, tmp_path):
    got = lived(spark, tmp_path, [[[("u", 100, "a", "g", 1.0)], [("u", 150, "b", "g", 1.0)], [("u", 151, "c", "g", 0.0)], [("u", 101, "d", "g", -3.0), ("u", 200, "e", "g", 9.0)]]])
    assert rows(streams.current(got), "affinity", "confidence") == [(2.0, 3)]


def test_live_affinities_count_equal_changes_and_keep_state_in_spark(spark, tmp_path):
    got = lived(spark, tmp_path, [[[("u", 100, "a", "g", 0.5), ("u", 100, "a", "g", 0.5), ("u", 100, "b", "g", None)], [("u", 200, "z", "g", 1.0)]]])
    assert rows(streams.current(got), "user_id", "key", "affinity", "confidence") == [("u", "g", 1.0, 3)]
    stream = streams.live_affinities([spark.readStream.schema(LIVE).parquet(str(tmp_path / "in0"))], "10 seconds")
    plan = stream._jdf.queryExecution().analyzed().toString()
    assert "Aggregate" in plan and "TransformWithState" not in plan  # no call between Python and the JVM for a key


# lexical index


DOCS = [(1, "a b a, c a"), (2, None), (3, ""), (4, "B"), (5, "c " * 50)]


def test_postings_are_counted_in_rows_unless_an_id_has_several(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    found = lexical.postings(docs)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert rows(found, "doc_id", "term", "tf", "doc_len") == [(1, "a", 3, 5), (1, "b", 1, 5), (1, "c", 1, 5), (4, "b", 1, 1), (5, "c", 50, 50)]
    twice = lexical.postings(docs.unionByName(spark.createDataFrame([(4, "b b")], docs.schema)))
    assert (4, "b", 3) in rows(twice, "doc_id", "term", "tf")


def test_bm25_sums_pairs_without_a_shuffle_of_them(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"red w{i % 7} ring w{i % 3}") for i in range(200)], "doc_id long, text string")
    asked = spark.createDataFrame([(q, f"w{q} ring red red") for q in range(5)] + [(9, None)], "query_id long, text string")
    index = lexical.index(docs)
    found = lexical.bm25(asked, *index, top=10)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id" in plan and ", doc_id" not in "".join(x for x in plan.splitlines() if "Exchange hashpartitioning(query_id" in x)
    assert found.schema["lane_rank"].dataType.simpleString() == "bigint"
    columns = ("query_id", "doc_id", "score", "lane_rank")
    monkeypatch.setattr(lexical, "WORDS", 0)
    assert rows(found, *columns) == rows(lexical.bm25(asked, *index, top=10), *columns)
    assert found.count() == 50


# accounts


def test_anchors(spark):
    m = spark.createDataFrame([(1, "Heat", ["a", " ", "c"]), (2, "The Heat", []), (3, "Ran", None)], "movie_id long, title string, top_tags array<string>")
    got = account.anchors(spark.createDataFrame([("u", "heat, 42,, zzz ,RAN")], "user_id string, raw string"), m)
    assert rows(got.filter("movie_id is not null"), "token", "movie_id", "n_matches") == [("42", 42, 1), ("RAN", 3, 1), ("heat", 1, 2)]
    assert rows(got.filter("movie_id is null"), "token", "n_matches") == [("zzz", 0)]
    five, tags = account.anchor_events(got, m, 7)
    assert (five.count(), rows(tags, "tag")) == (3, [("a",), ("c",)])


def test_notes_and_switches(spark):
    log = spark.createDataFrame([("u", 1, "add", "x"), ("u", 2, "clear", None), ("u", 3, "add", "y"), ("u", 4, "add", "z"), ("u", 5, "delete", "y")], "user_id string, at long, action string, entry string")
    assert rows(account.memory_entries(log), "entry") == [("z",)]
    s = spark.createDataFrame([("u", 1, "era", "light"), ("u", 2, "era", "strong"), ("u", 3, "era", "huge")], "user_id string, at long, signal string, level string")
    assert rows(account.signals(s), "signal", "level") == [("era", "strong")]
    own = spark.createDataFrame([("u", "gore")], "user_id string, dealbreaker string")
    said = spark.createDataFrame([("u", "No Gore, clowns")], "user_id string, raw string")
    assert rows(account.merged_dealbreakers(own, said), "dealbreaker") == [("clowns",), ("gore",)]


def test_service_answers_become_changes(spark):
    m = spark.createDataFrame([(1, ["D"])], "movie_id long, directors array<string>")
    a = spark.createDataFrame(
        [("u", 1, 5, 5.0, False, 0.5, ["Plot"], ["plot", "ending"], ["noir"], ["Plot"], 1.0, ["A", "A"]), ("v", 1, 5, 1.0, True, None, None, None, ["x"], None, None, None)],
        "user_id string, movie_id long, ts long, stars double, sarcasm boolean, sentiment double, liked array<string>, disliked array<string>, tags array<string>, chosen array<string>, director_sentiment double, actors array<string>",
    )
    got = [(u, d, k, round(w, 6)) for u, d, k, w in rows(account.service_changes(a, m), "user_id", "dimension", "key", "weight")]
    assert got == [("u", "actor", "A", 0.25), ("u", "director", "D", 0.8), ("u", "tag", "ending", -0.4), ("u", "tag", "noir", 0.15), ("u", "tag", "plot", 0.5), ("v", "tag", "x", -0.06)]


def test_summaries_and_health(spark):
    a = spark.createDataFrame([("u", "genre", "G", 1.0), ("u", "genre", "H", 2.0), ("u", "director", "D", 0.5)], "user_id string, dimension string, key string, affinity double")
    r = spark.createDataFrame([("u", 1), ("u", 2), ("w", 1)], "user_id string, movie_id long")
    assert rows(account.summary(a, r).filter("user_id = 'u'"), "n_rated", "genres", "directors") == [(2, ["H", "G"], ["D"])]
    assert sorted((x.name, x.n_rows) for x in account.health({"ratings": r, "rules": None}).collect()) == [("ratings", 3), ("rules", None)]


def test_profiles_merge(spark):
    raw = [('{"genre_affinity": {"a": 1.0, "b": 1.0}, "watch_history": [1], "query_history": ["x"]}', '{"genre_affinity": {"b": 2.0}, "watch_history": [2], "query_history": ["x", "y"]}')]
    df = spark.createDataFrame(raw, "f string, l string").select(documents.parsed_profile(F.col("f")).alias("f"), documents.parsed_profile(F.col("l")).alias("l"))
    got = df.select(*[c.alias(k) for k, c in sinks.merged_profile(F.col("f"), F.col("l")).items()]).first()
    assert (got.genre_affinity, sorted(got.watch_history), got.query_history) == ({"a": 1.0, "b": 2.0}, [1, 2], ["x", "y"])


def test_two_digits_as_the_double_says(spark):
    r = random.Random(2)
    values = [r.uniform(0.5, 5) for _ in range(300)] + [i / 8 for i in range(4, 41)] + [i / 200 for i in range(100, 1001)] + [0.005, 0.015, 3.0, 4.995, 4.999999]
    found = spark.createDataFrame([(v,) for v in values], "v double").select(maths.two_digits(F.col("v")).alias("s")).collect()
    assert [x["s"] for x in found] == [f"{v:.2f}" for v in values]


def test_sample_of_users(spark):
    """Users by a seeded hash: those of the smallest, in parts of the stated sizes, whatever the order of rows."""
    users = spark.range(500).select(F.col("id").alias("user_id"))
    got = {r["user_id"]: r["part"] for r in learning.sampled_users(users, 60, 20).collect()}
    assert got == {r["user_id"]: r["part"] for r in learning.sampled_users(users.orderBy(F.desc("user_id")).repartition(5), 60, 20).collect()}
    order = [r[0] for r in users.orderBy(F.xxhash64(F.col("user_id").cast("string"), F.lit(42)), "user_id").collect()]
    assert got == {u: "train" if i < 60 else "eval" for i, u in enumerate(order[:80])}


def test_exploded_terms_are_not_broadcast(spark, sf_dir):
    """A part's file looks small whatever it is exploded to; no join may take it whole through the driver."""
    rows = adapters.events(spark, sf_dir)
    terms = profile.movie_terms(adapters.movies(spark, sf_dir))
    pairs = adapters.ratings(spark, sf_dir).select("user_id", "movie_id")
    boosts = profile.term_boosts(pairs, terms, profile.affinities(rows))
    for df in (rows, boosts, pairs.join(adapters.movies(spark, sf_dir), "movie_id")):
        joins = [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x]
        assert joins and not any("Broadcast" in x and "movie_id" in x for x in joins)


def test_a_title_of_many_years_meets_each_row_once(spark):
    """Rows are matched one by one, also those of one id, and no row is paired with all years of its title."""
    c = spark.createDataFrame([(y, "The Red Ring", 1900 + y) for y in range(50)] + [(70, "Red Ring", None), (80, "Blue Bolt", 1950)], "candidate_id long, title string, year int")
    r = spark.createDataFrame([(1, "red ring", 1907), (1, "blue bolt", 1999), (2, "red ring", 1800), (None, "red ring", 1949), (4, "red ring", None), (5, "gone", 1907), (6, None, 1907)], "id long, title string, year int")
    got = sorted(((x.id, x.title, x.year, x.candidate_id, x.relaxed) for x in catalog.strict_else_relaxed(r, c).collect()), key=str)
    assert got == sorted([(1, "red ring", 1907, 7, False), (1, "blue bolt", 1999, 80, True), (2, "red ring", 1800, 0, True), (None, "red ring", 1949, 49, False), (4, "red ring", None, 70, False), (5, "gone", 1907, None, None), (6, None, 1907, None, None)], key=str)


def test_latest_carries_named_columns_once(spark):
    """A column that the order names isn't kept beside itself, in results the same."""
    df = spark.createDataFrame([(1, 2, "a", 5), (1, 3, "b", 4), (1, 3, "c", 4), (2, None, "d", 1), (None, 1, "e", 2)], "k long, at long, x string, n long")
    named, free = ordering.latest(df, ["k"], ["at", "n"]), ordering.latest(df, ["k"], [F.col("at"), F.col("n")])
    assert named.columns == df.columns
    assert sorted(map(str, named.collect())) == sorted(map(str, free.collect())) == sorted(map(str, [Row(k=1, at=3, x="c", n=4), Row(k=2, at=None, x="d", n=1), Row(k=None, at=1, x="e", n=2)]))
    assert ordering.latest(df.select("k", "at"), ["k"], ["at"]).count() == 3


def test_candidates_that_cannot_be_chosen_leave_the_list(spark):
    """With 100 candidates whose scores spread evenly, most go; what is chosen stays that of the plain version, ties and full franchises included."""
    r = random.Random(31)
    groups = [[(q, i, 1 - i / 100 if q < 3 else r.choice([0.0, 0.5, 0.6, 1.0]), f"Title {r.randrange(30 if q < 5 else 3)}", f"The C{r.randrange(20 if q < 5 else 2)} Collection", [r.choice("ab")]) for i in range(100)] for q in range(8)]
    df = spark.createDataFrame([x for g in groups for x in g], "query_id long, movie_id long, final_score double, title string, collection string, genres array<string>")
    keys = {tuple(x[:2]): x[2] for x in df.select("query_id", "movie_id", text.franchise_key(F.col("collection"), F.col("title"))).collect()}
    want = set()
    for g in groups:
        g = sorted(g, key=lambda x: (-x[2], x[1]))
        want |= {(x[0], k + 1, g[p][1]) for x in g[:1] for k, p in enumerate(plain_mmr.select([x[2] for x in g], [plain_mmr.item(keys[x[0], x[1]], x[5]) for x in g], 10, 0.75, 2))}
    assert set(map(tuple, diversity.diversified(df, 10).select("query_id", "final_rank", "movie_id").collect())) == want
    listed = F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.struct(i.alias("place"), F.concat(F.lit("f"), i % 20).alias("franchise"), (1 - i / 99).alias("relevance")))
    full = F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.struct(i.alias("place"), F.lit("f").alias("franchise"), (1 - i / 99).alias("relevance")))
    got = spark.range(1).select(F.size(diversity.contenders(listed, 10, 0.75, 2)), F.size(diversity.contenders(full, 10, 0.75, 2))).first()
    assert (got[0], got[1]) == (42, 100)
