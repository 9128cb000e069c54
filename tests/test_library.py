"""A catalogue built from raw files, searched, and asked about a user."""

import json

import pytest

from reelgrid.plans.library import Library, build


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    raw = tmp_path_factory.mktemp("raw")
    genres = ["Drama", "Comedy", "Horror|Sci-Fi", "Drama|Crime"]
    names = ["Quiet River", "Loud Party", "Night Station", "Cold Harbor"]
    movies = [(i, f"{names[i % 4]} {i} ({1980 + i})", genres[i % 4]) for i in range(1, 25)]
    (raw / "movies.csv").write_text("movieId,title,genres\n" + "".join(f'{i},"{t}",{g}\n' for i, t, g in movies))
    ratings = [(u, i, 5.0 if (i % 4 == 2) == (u % 2 == 0) else 2.0, 100 * u + i) for u in range(1, 21) for i in range(1, 25) if (u * i) % 3]
    (raw / "ratings.csv").write_text("userId,movieId,rating,timestamp\n" + "".join(",".join(map(str, r)) + "\n" for r in [*ratings, (1, 1, 3.5, 1)]))
    (raw / "tags.csv").write_text("userId,movieId,tag,timestamp\n1,3,harbor,5\n2,4,,6\n")
    cards = [{"movie_id": i, "directors": [f"Director {i % 3}"], "overview": f"station story {i}", "collection": f"Set {i % 5} Collection", "top_tags": ["night"]} for i in range(1, 25)]
    (raw / "cards.jsonl").write_text("\n".join(map(json.dumps, cards)) + "\n")
    root = str(tmp_path_factory.mktemp("root"))
    build(spark, root, *(str(raw / f) for f in ("movies.csv", "ratings.csv", "tags.csv")), cards={"A": str(raw / "cards.jsonl")}, support=3)
    return Library(spark, root)


def test_tables_are_there(library):
    rows = {r.name: r.n_rows for r in library.health().collect()}
    assert rows["movies"] == rows["movie_stats"] == rows["cards"] == 24
    assert rows["user_tags"] == 1 and rows["association_rules"] > 0 and rows["postings"] > 0
    latest = library.tables["ratings"].filter("user_id = '1' and movie_id = 1").collect()
    assert [r.rating for r in latest] == [5.0]  # the later of two


def test_search(library):
    top = library.search("top 5 horror movies", "2", 5).collect()
    assert len(top) == 4 and all("Night Station" in r.title for r in top)
    words = library.search("a harbor at night", "99", 4).collect()
    assert [r.final_rank for r in words] == [1, 2, 3, 4]
    liked = library.search("movies like Night Station 2", "99", 3)
    assert liked.count() > 0
    assert library.search("", "99", 3, least=1).count() == 3
    vetoed = library.search("a harbor at night", "99", 4, dealbreakers=["horror"]).collect()
    assert {r.title for r in vetoed if r.profile_boost == -10.0} == {r.title for r in vetoed if "Night Station" in r.title}


def test_profiles(library):
    got = library.summary("2").first()
    assert got.n_rated == library.tables["ratings"].filter("user_id = '2'").count()
    assert got.genres[0] in ("Horror", "Sci-Fi") and len(got.directors) > 0


def test_tables_written_once_follow_their_sources(spark, tmp_path):
    from reelgrid.sources import shared

    source = str(tmp_path / "numbers")
    spark.range(3).write.parquet(source)
    made = []

    def make():
        made.append(1)
        return spark.read.parquet(source)

    before = len(shared._made)
    assert [shared.once(spark, "numbers", [source], make).count() for _ in range(2)] == [3, 3]
    assert len(made) == 1
    shared.clear(spark, before)
    assert shared.once(spark, "numbers", [source], make).count() == 3
    assert len(made) == 2
    shared.clear(spark, before)
