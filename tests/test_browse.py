import datetime as dt

import pytest

from titleflow import schemas
from titleflow.operators import browse, deep_pages, joins
from titleflow.plans import documents

NOW = dt.datetime(2026, 8, 10, 12)


@pytest.fixture(scope="module")
def tables(spark):
    day = dt.timedelta(days=1)
    rows = [
        ("tmdb_1", 1, None, "Superman", NOW - 30 * day, None, None, 5.0, 7.0, None, NOW),
        ("tmdb_2", 2, None, "superb", dt.datetime(2026, 8, 10), None, None, 9.0, None, 80, NOW - day),
        ("tmdb_3", 3, None, "Other", None, None, None, 7.0, 8.0, 90, NOW - 2 * day),
        ("tmdb_4", 4, None, "Future", NOW + 30 * day, None, None, None, 8.0, 0, NOW - 3 * day),
        ("tmdb_5", 5, None, "Old", dt.datetime(1990, 1, 1), None, None, 1.0, 1.0, None, NOW - 4 * day),
    ]
    return {
        "movies": spark.createDataFrame(rows, schemas.MOVIES),
        "movie_genres": spark.createDataFrame([("tmdb_1", "Action"), ("tmdb_1", "Drama"), ("tmdb_2", "Action")], schemas.MOVIE_GENRES),
        "movie_summaries": spark.createDataFrame(
            [("tmdb_1", 40, "c", "", 4, NOW), ("tmdb_3", 90, "", None, 2, NOW), ("tmdb_5", None, "", "", 7, NOW)], schemas.MOVIE_SUMMARIES),
        "movie_points": spark.createDataFrame([("tmdb_1", "pro", 1, "p")], schemas.MOVIE_POINTS),
        "movie_themes": spark.createDataFrame([("tmdb_1", 1, "t")], schemas.MOVIE_THEMES),
    }


def ids(frame):
    return [int(r.id[5:]) for r in frame.collect()]


def order(tables, **options):
    page = documents.browse(tables, NOW, **options)
    return sorted(ids(page.results)), page.total.first().total


def sorted_ids(tables, sort, direction):
    column = browse.sort_column(sort)
    found = browse.matching(tables["movies"], tables["movie_genres"], None, column, NOW)
    return ids(browse.sorted_page(found, column, direction, 100, 0))


def test_nulls_count_as_lowest(tables):
    assert sorted_ids(tables, "imdb_score", "asc") == [2, 5, 1, 3, 4]
    assert sorted_ids(tables, "imdb_score", "DESC") == [3, 4, 1, 5, 2]
    assert sorted_ids(tables, "popularity", "ASC") == [4, 5, 1, 3, 2]


def test_unknown_sorts_and_orders(tables):
    assert sorted_ids(tables, "title", None) == [1, 2, 3, 4, 5]
    assert sorted_ids(tables, "overall_sentiment", "sideways") == [1, 2, 3, 4, 5]
    assert browse.sort_column("overall_sentiment", sentiment=True) == "overall_sentiment"


def test_release_sort_leaves_out_what_is_not_out(tables):
    assert sorted_ids(tables, "release_date", "desc") == [1, 5]
    assert order(tables, sort="release_date") == ([1, 5], 2)


def test_genre_filter(tables):
    assert order(tables, genre="Action") == ([1, 2], 2)
    assert order(tables, genre="action") == ([], 0)
    assert order(tables, genre="All")[1] == 5
    assert order(tables, genre="Action", limit=1)[1] == 2


def test_sentiment_sort(tables):
    top = documents.browse(tables, NOW, sort="overall_sentiment", limit=2).results
    assert sorted(ids(top)) == [1, 3]
    plain = documents.browse(tables, NOW, sort="overall_sentiment", limit=2, sentiment_sort=False).results
    assert sorted(ids(plain)) == [1, 2]


def test_page_bounds():
    assert browse.page_bounds(None, None) == (20, 0)
    assert browse.page_bounds(0, -5) == (20, 0)
    assert browse.page_bounds(-3, 7) == (1, 7)
    assert browse.page_bounds(500, 0) == (100, 0)
    assert [browse.search_bound(n) for n in (None, 0, -1, 7, 99)] == [10, 10, 10, 7, 50]


def test_search(tables):
    assert sorted(ids(documents.search(tables, "  SUPER "))) == [1, 2]
    assert ids(documents.search(tables, "super", 1)) == [1]
    with pytest.raises(ValueError):
        documents.search(tables, "   ")


def test_documents_and_cards(spark, tables):
    asked = spark.createDataFrame([(0, "tmdb_1"), (1, "tmdb_5"), (2, "tmdb_1"), (3, " "), (4, "nobody")], "pos int, movie_id string")
    docs = documents.documents(tables, asked)
    got = {r.id: r for r in docs.collect()}
    assert set(got) == {"tmdb_1", "tmdb_5"}
    one, five = got["tmdb_1"], got["tmdb_5"]
    assert (one.genres, one.summary.pros, one.summary.cons, one.summary.recommendation, one.review_count_analyzed) == (
        ["Action", "Drama"], ["p"], [], None, 4)
    assert (one.scores.imdb, one.scores.rotten_tomatoes) == ("7", None)
    assert (five.summary, five.genres, five.review_count_analyzed) == (None, None, 7)
    cards = {r.id: r for r in browse.cards(docs).collect()}
    assert (cards["tmdb_1"].sentiment_text, cards["tmdb_1"].card_genres, cards["tmdb_1"].has_deep_summary) == ("40%", "Action • Drama", True)
    assert (cards["tmdb_5"].sentiment_text, cards["tmdb_5"].release_year, cards["tmdb_5"].card_genres, cards["tmdb_5"].has_deep_summary) == (
        "Unrated", "1990", "Movie", False)


def test_missing_summary_table(tables):
    docs = documents.search({k: v for k, v in tables.items() if not k.startswith(("movie_s", "movie_p", "movie_t"))}, "super")
    assert {(r.summary, r.review_count_analyzed) for r in docs.collect()} == {(None, 0)}


def test_summaries_cut_to_a_hundred_before_blanks_go(spark, tables):
    rows = [(i, " ") for i in range(98)] + [(98, "tmdb_1"), (99, "tmdb_1"), (100, "tmdb_3")]
    asked = spark.createDataFrame(rows, "pos int, movie_id string")
    assert [r.movie_id for r in documents.summaries(tables, asked).collect()] == ["tmdb_1"]


def test_page_plan_is_a_top_k(tables, capsys):
    browse.sorted_page(tables["movies"], "popularity", "desc", 24, 48).explain()
    plan = capsys.readouterr().out
    assert "TakeOrderedAndProject(limit=72, offset=48" in plan and "Exchange" not in plan


def test_a_page_too_large_is_refused(spark, tables):
    many = spark.range(101).selectExpr("concat('m', id) AS id")
    with pytest.raises(ValueError):
        browse.documents(many, tables["movie_genres"], None, None, None)


def test_summaries_have_one_row_each(spark, tables):
    points = spark.createDataFrame([("tmdb_1", "pro", i * 100_000, f"p{i}") for i in range(25)], schemas.MOVIE_POINTS)
    rows = joins.summaries_with_lists(tables["movie_summaries"], points, tables["movie_themes"]).collect()
    assert sorted(r.movie_id for r in rows) == ["tmdb_1", "tmdb_3", "tmdb_5"]
    assert [r.pros for r in rows if r.movie_id == "tmdb_1"] == [[f"p{i}" for i in range(25)]]


@pytest.mark.parametrize("sort", ["popularity", "last_updated", "rotten_tomatoes"])
@pytest.mark.parametrize("order", ["asc", "desc"])
def test_deep_pages_equal_a_full_sort(spark, sort, order):
    """Nulls, ties, and a value that most rows share."""
    rows = [(f"m{i}", None if i % 7 == 0 else float(i * 7919 % 500), NOW if i % 3 else None, 50 if i % 10 else i) for i in range(3000)]
    movies = spark.createDataFrame(rows, "id string, popularity double, last_updated timestamp, rotten_tomatoes int").repartition(4)
    whole = [r.id for r in movies.orderBy(*browse.sort_order(sort, order)).collect()]
    for offset in (0, 1, 777, 1500, 2990, 5000):
        got = [r.id for r in browse.page_keys(movies, sort, order, 20, offset, deep=100).collect()]
        assert got == whole[offset:offset + 20]


def test_a_deep_page_sorts_few_rows(spark):
    movies = spark.range(20_000).selectExpr("concat('m', id) AS id", "id * 7919 % 20000 AS popularity")
    left, offset = deep_pages.narrowed(movies, "popularity", True, 15_000, 10, few=300)
    assert left.count() <= 300 and offset < 300
    assert [r.popularity for r in browse.sorted_page(left, "popularity", "asc", 10, offset).collect()] == list(range(15_000, 15_010))
