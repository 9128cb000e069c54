"""Column functions on single values."""

import pytest
from pyspark.sql import functions as F

from reelgrid.functions import documents, maths, text


@pytest.fixture
def value(spark):
    def get(column, **columns):
        df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()]) if columns else spark.range(1)
        return df.select(column).first()[0]

    return get


def test_years_and_titles(value):
    t = F.col("t")
    assert value(text.title_year(t), t="Heat (1995)") == 1995
    assert value(text.title_year(t), t="Heat (1995) ") is None  # the year must end the title
    assert value(text.bare_title(t), t="Heat (1995) ") == "Heat"
    assert value(text.title_year(t), t="1984") is None
    assert value(text.normalised_title(t), t="The Lord, The") == "lord"
    assert value(text.normalised_title(t), t="A Bug's Life") == "bugslife"
    assert value(text.normalised_title(t), t="Matrix, A") == "matrix"
    assert value(text.title_variants(t), t="City of Lost Children, The (a.k.a. La Cité)") == ["cityoflostchildrentheakalacit", "cityoflostchildren", "lacit"]
    assert value(text.title_variants(t), t="Seven (Se7en)") == ["sevense7en", "seven", "se7en"]
    assert value(text.title_variants(t), t="X (a.k.a. Other One)")[1:] == ["x", "otherone"]
    assert value(text.search_title(t), t="Ran (a.k.a. Chaos) (1985)") == "Ran"
    assert value(text.search_title(t), t="Ran (1985)") == "Ran"
    assert value(text.without_year_suffix(t, F.lit(1995)), t="Heat (1995)") == "Heat"
    assert value(text.imdb_id(t), t="114709") == "tt0114709"
    assert value(text.imdb_id(t), t="12345678") == "tt12345678"


def test_franchises(value):
    t = F.col("t")
    none = F.lit(None).cast("string")
    assert value(text.franchise_key(F.lit("The Conjuring Collection"), t), t="Annabelle") == "coll:conjuring"
    assert value(text.franchise_key(none, t), t="The Matrix: Reloaded") == "stem:matrix"
    assert value(text.franchise_key(none, t), t="Rocky 2") == "stem:rocky"
    assert value(text.franchise_key(none, t), t="The A") == "stem:the a"
    assert value(text.franchise_key(F.lit("Collection"), t), t="x") == "coll:"


def test_words_in_queries(value):
    q = F.col("q")
    assert value(text.negations(q), q="Horror but NOT slow, without ghosts") == ["slow", "ghosts"]
    assert value(text.without_phrases(q, F.array(F.lit("too slow"), F.lit("a.b"))), q="nothing Too Slow  a.b axb") == "nothing axb"
    assert value(text.title_target(q), q="Movies like Heat but funny") == "heat"
    assert value(text.has_word(q, F.lit("war")), q="star wars") is False
    assert value(text.has_word(q, F.lit("a+b")), q="x a+b y") is True
    assert value(text.dealbreakers(q), q="no gore, Horror , ,NO  clowns") == ["gore", "Horror", "clowns"]
    assert value(text.tokens(q), q="It's 2-fast!") == ["it", "s", "2", "fast"]
    assert value(text.letter_words(q), q="To the the End9 end") == ["the", "end"]
    assert value(text.first_sentences(q), q="One. Two! Three? Four.") == ["One.", "Two!", "Three?"]
    assert value(text.valid_user_id(q), q="ab-C_9") is True
    assert value(text.valid_user_id(q), q="a b") is False


def test_dates(value):
    t = F.col("t")
    assert value(text.review_time(t), t="1970-01-02") == 86400
    assert value(text.review_time(t), t="1970-01-01T00:01:00") == 60
    assert value(text.review_time(t), t=" 1970-01-01 01:00:00 ") == 3600
    assert value(text.review_time(t), t="02/03/2001") is None
    assert value(text.review_time(t), t="2001-13-40") is None
    assert value(text.year_in(t), t="around 1999-2000") == 1999


def test_html(value):
    assert value(text.unescape_html(F.col("t")), t="a &amp; b &eacute; &#39; &hellip;") == "a & b é ' …"
    assert value(text.unescape_html(F.lit(None).cast("string"))) is None


def test_scores(value):
    x = F.col("x")
    assert value(maths.rerank_to_unit(x), x=0.4) == 0.4
    assert value(maths.rerank_to_unit(x), x=-800.0) == 0.0
    assert value(maths.rerank_to_unit(x), x=800.0) == 1.0
    assert value(maths.rerank_to_unit(F.lit(None).cast("double"))) == 0.01
    assert value(maths.boost_to_unit(x), x=0.0) == 0.5
    assert abs(value(maths.boost_to_unit(x), x=-10.0) - 0.0066928509) < 1e-9
    assert value(maths.rating_weight(x, F.lit(False)), x=2.0) == 0.75
    assert abs(value(maths.rating_weight(x, F.lit(False)), x=0.5) - 0.2) < 1e-12
    assert value(maths.rating_weight(x, F.lit(True)), x=0.5) == 1.0
    assert value(maths.recency(F.lit(2019), F.lit(False), x), x=3.0) == 1.0
    assert abs(value(maths.recency(F.lit(1994), F.lit(False), x), x=3.0) - 0.875) < 1e-12
    assert value(maths.recency(F.lit(1919), F.lit(True), x), x=3.0) == 0.95
    assert value(maths.recency(F.lit(1919), F.lit(False), x), x=4.2) == 0.92
    assert value(maths.era(F.lit(1987))) == "1980s"
    assert [value(maths.grade(x), x=r) for r in (0.5, 1.25, 5.0)] == [1, 2, 10]
    assert value(maths.lambda_label(x), x=0.61) == "strong"
    assert value(maths.lambda_label(x), x=0.125) == "off"
    assert value(maths.safe_double(x), x="4.5") == 4.5
    assert value(maths.safe_double(x), x="n/a") is None


def test_lists_and_documents(value):
    t = F.col("t")
    assert value(documents.list_field(t), t='["A, B", "C"]') == ["A, B", "C"]
    assert value(documents.list_field(t), t="A, B ,,C") == ["A", "B", "C"]
    assert value(documents.list_field(F.lit(None).cast("string"))) == []
    assert value(documents.non_empty(F.lit("  "), t), t="old") == "old"
    p = value(documents.parsed_profile(t), t='{"user_id": "u", "genre_affinity": {"Drama": 1.5}}')
    assert (p["user_id"], p["lambda"], p["watch_history"], p["genre_affinity"]) == ("u", 0.7, [], {"Drama": 1.5})
    assert value(documents.parsed_profile(t), t="{broken") is None


def test_service_answers(spark, value):
    crew = F.from_json(F.lit('[{"job":"Director","name":"D"},{"job":"Writer","name":"W"},{"job":"Director","name":null}]'), "array<struct<job:string,name:string>>")
    assert value(documents.directors_of(crew)) == ["D"]
    cast = F.from_json(F.lit('[{"name":"a"},{"name":null},{"name":"c"}]'), "array<struct<name:string>>")
    assert value(documents.leading_cast(cast, 2)) == ["a"]
    raw = '[{"iso_3166_1":"US","release_dates":[{"certification":""},{"certification":"PG"},{"certification":"R"}]},{"iso_3166_1":"DE","release_dates":[{"certification":"12"}]},{"iso_3166_1":"US","release_dates":[{"certification":"R"}]}]'
    results = F.from_json(F.lit(raw), "array<struct<iso_3166_1:string,release_dates:array<struct<certification:string>>>>")
    assert value(documents.us_certification(results)) == "R"
    packed = spark.createDataFrame([([1.0, -2.5],), (None,)], "v array<float>").select(documents.packed_vector(F.col("v")).alias("b"))
    assert [r[0] for r in packed.select(documents.unpacked_vector(F.col("b"))).collect()] == [[1.0, -2.5], None]


def test_profile_is_parsed_once(spark, sf_dir):
    """Each field of a profile would parse the whole text again; and the rows of a small file are dealt over tasks."""
    from reelgrid.plans import file_queries

    df = spark.createDataFrame([('{"watch_history": [1], "genre_affinity": {"1": 2.0}}',), ("[1]",), (None,)], "t string").select(documents.parsed_profile(F.col("t")).alias("p"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    assert [r.p and (r.p.watch_history, r.p.genre_affinity, r.p.watchlist, r.p["lambda"], r.p.user_id) for r in df.collect()] == [([1], {"1": 2.0}, [], 0.7, None), None, None]
    assert "RoundRobinPartitioning" in file_queries.profile_merge(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
