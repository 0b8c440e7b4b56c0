import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from titleflow import schemas
from titleflow.operators import browse, joins
from titleflow.plans import migrate
from titleflow.sinks import constraints, merge
from titleflow.sinks.export import json_documents, write_documents
from titleflow.session import work_path
from titleflow.sinks.store import TableStore

NOW = dt.datetime(2026, 8, 9, 10)
LATER = dt.datetime(2026, 8, 10, 10)
BATCH = ("id string, tmdb_id long, imdb_id string, title string, release_date timestamp, poster_url string, "
         "overview string, popularity double, imdb_score double, rotten_tomatoes int, genres array<string>, n int")


def batch(spark, *rows):
    full = [(f"tmdb_{i}", i, None, title, dt.datetime(2025, 7, 11), None, None, pop, score, None, genres, n)
            for n, (i, title, pop, score, genres) in enumerate(rows)]
    return spark.createDataFrame(full, BATCH)


def titles(store):
    return {r.id: r for r in store.read("movies").collect()}


def genres(store):
    return sorted((r.movie_id, r.genre) for r in store.read("movie_genres").collect())


def test_save_replaces_the_whole_row(spark, store):
    store.save_movies(batch(spark, (1, "A", 45.5, 8.2, ["Action", "", "Sci-Fi", "Action"])), NOW)
    assert genres(store) == [("tmdb_1", "Action"), ("tmdb_1", "Sci-Fi")]
    store.save_movies(batch(spark, (1, "B", None, None, [])), LATER)
    row = titles(store)["tmdb_1"]
    assert (row.title, row.popularity, row.imdb_score, row.last_updated) == ("B", None, None, LATER)
    assert genres(store) == []


def test_batches_keep_other_titles_and_the_last_duplicate_wins(spark, store):
    store.save_movies(batch(spark, (200, "Old", 1.0, None, ["Drama"]), (201, "Keep", 1.0, None, ["Comedy", "Romance"])), NOW)
    store.save_movies(batch(spark, (200, "First", 2.0, None, ["X"]), (202, "New", 3.0, None, None), (200, "Last", 4.0, None, ["Y"])), LATER, order="n")
    assert {i: r.title for i, r in titles(store).items()} == {"tmdb_200": "Last", "tmdb_201": "Keep", "tmdb_202": "New"}
    assert genres(store) == [("tmdb_200", "Y"), ("tmdb_201", "Comedy"), ("tmdb_201", "Romance")]
    store.save_movies(batch(spark), LATER)
    assert len(titles(store)) == 3


def test_saving_twice_changes_nothing(spark, store):
    for _ in range(2):
        store.save_movies(batch(spark, (1, "A", 1.0, None, ["G"]), (2, "B", 1.0, None, ["G"])), NOW)
    assert (len(titles(store)), len(genres(store))) == (2, 2)


def test_keep_non_null(spark):
    old = batch(spark, (1, "A", 1.0, 7.5, None), (2, "B", 2.0, None, None)).drop("genres")
    new = batch(spark, (1, "A2", None, None, None), (3, "C", 3.0, None, None)).drop("genres")
    got = {r.id: (r.title, r.popularity, r.imdb_score) for r in merge.upsert(old, new, "id", keep_non_null=True).collect()}
    assert got == {"tmdb_1": ("A2", 1.0, 7.5), "tmdb_2": ("B", 2.0, None), "tmdb_3": ("C", 3.0, None)}


SAVED = ("movie_id string, overall_sentiment int, audience_consensus string, recommendation string, review_count int, "
         "pros array<string>, cons array<string>, themes array<string>")


def test_save_summary(spark, store):
    rows = [("m", 92, "good", "see it", 24, ["p", "", "p"], ["c"], ["t"]), ("n", None, "", "", 0, [], None, [])]
    store.save_summaries(spark.createDataFrame(rows, SAVED), NOW)
    points = [(r.movie_id, r.type, r.content) for r in store.read("movie_points").orderBy("ordinal").collect()]
    assert points == [("m", "pro", "p"), ("m", "pro", "p"), ("m", "con", "c")]
    assert store.read("movie_summaries").count() == 2
    state = {r.movie_id: r.has_summary for r in joins.summary_state(
        store.read("movie_summaries"), store.read("movie_points"), store.read("movie_themes")).collect()}
    assert state == {"m": True, "n": False}
    store.save_summaries(spark.createDataFrame([("m", 50, "", "", 1, [], ["only con"], [])], SAVED), LATER)
    docs = {r.movie_id: r for r in browse.summary_documents(joins.summaries_with_lists(
        store.read("movie_summaries"), store.read("movie_points"), store.read("movie_themes"))).collect()}
    assert (docs["m"].pros, docs["m"].cons, docs["m"].themes, docs["m"].audience_consensus) == (None, ["only con"], None, None)
    assert (docs["n"].overall_sentiment, docs["n"].review_count) == (None, 0)


def test_requests_keep_the_latest(spark, store):
    rows = [("m", NOW), ("m", LATER), ("n", NOW)]
    store.save_requests(spark.createDataFrame(rows, schemas.REVIEW_REQUESTS))
    assert {r.movie_id: r.requested_at for r in store.read("review_requests").collect()} == {"m": LATER, "n": NOW}


def test_unwritten_tables_are_empty(store):
    assert all(store.read(t).count() == 0 for t in schemas.TABLES)


def test_merges_touch_only_their_buckets(spark, store):
    import glob

    store.buckets = 8
    store.save_movies(batch(spark, *[(i, f"T{i}", 1.0, None, ["G"]) for i in range(100)]), NOW)
    before = set(glob.glob(store.path("movies") + "/data/version=*/bucket=*"))
    store.save_movies(batch(spark, (7, "changed", 1.0, None, [])), LATER)
    after = set(glob.glob(store.path("movies") + "/data/version=*/bucket=*"))
    assert before < after and len(after - before) == 1
    assert len(titles(store)) == 100 and titles(store)["tmdb_7"].title == "changed"
    assert len(genres(store)) == 99


def test_another_number_of_buckets_is_refused(spark, store):
    store.save_movies(batch(spark, (1, "T", 1.0, None, [])), NOW)
    other = TableStore(spark, store.root, buckets=64)
    with pytest.raises(ValueError, match="2 buckets"):
        other.read("movies")
    with pytest.raises(ValueError, match="2 buckets"):
        other.save_movies(batch(spark, (2, "U", 1.0, None, [])), LATER)
    assert set(titles(store)) == {"tmdb_1"}


def test_a_failed_write_leaves_the_table_whole(spark, store):
    store.save_movies(batch(spark, *[(i, f"T{i}", 1.0, None, []) for i in range(10)]), NOW)
    broken = store.read("movies").withColumn("title", F.expr("IF(id = 'tmdb_3', raise_error('broken'), 'new')"))
    with pytest.raises(Exception, match="broken"):
        store._overwrite("movies", broken, [0, 1])
    assert sorted(r.title for r in titles(store).values()) == sorted(f"T{i}" for i in range(10))
    store.save_movies(batch(spark, (3, "after", 1.0, None, [])), LATER)
    assert titles(store)["tmdb_3"].title == "after" and len(titles(store)) == 10


def test_a_bucket_can_lose_its_last_row(spark, store):
    store.create("movie_points", spark.createDataFrame([("m", "pro", 1, "x")], schemas.MOVIE_POINTS))
    none = store.read("movie_points").where("false")
    store.replace_children("movie_points", spark.createDataFrame([("m",)], "movie_id string"), none)
    assert store.read("movie_points").count() == 0


def test_constraints(spark):
    movies = spark.createDataFrame([("a", 1, "t"), ("a", 2, None), ("b", 2, "t")], "id string, tmdb_id long, title string")
    summaries = spark.createDataFrame([("a",), ("b",), ("b",)], "movie_id string")
    points = spark.createDataFrame([("a", "pro", "x"), ("a", "meh", "x"), ("z", "con", None)], "movie_id string, type string, content string")
    found = constraints.violations({"movies": movies, "movie_summaries": summaries, "movie_points": points})
    assert sorted(tuple(r) for r in found.collect()) == sorted([
        ("movies", "unique(id)", "a", 2), ("movies", "unique(tmdb_id)", "2", 2), ("movies", "not_null(title)", "a", 1),
        ("movie_summaries", "unique(movie_id)", "b", 2), ("movie_points", "in_list(type)", "a", 1),
        ("movie_points", "not_null(content)", "z", 1), ("movie_points", "references(movie_summaries)", "z", 1)])


def test_migration(spark, store):
    wide = spark.createDataFrame(
        [("a", None, "", None, 3), ("b", None, None, None, 4), ("", 5, None, None, 1), (None, 5, None, None, 1), ("c", 80, "x", "y", None)],
        "id string, overall_sentiment int, audience_consensus string, recommendation string, review_count int")
    points = spark.createDataFrame(
        [("a", "pro", 1, "p"), ("a", "meh", 2, "q"), ("b", "pro", 1, "p"), ("c", "con", 1, ""), ("c", "con", 2, "r")],
        "movie_id string, type string, ordinal long, content string")
    themes = spark.createDataFrame([("c", 1, "t"), ("c", 2, None)], "movie_id string, ordinal long, theme string")
    for _ in range(2):
        counts = migrate.migrate_summaries(store, wide, points, themes, NOW).first()
        assert (counts.migrated, counts.errors) == (2, 0)
    assert sorted((r.movie_id, r.review_count) for r in store.read("movie_summaries").collect()) == [("a", 3), ("c", 0)]
    assert sorted((r.movie_id, r.content) for r in store.read("movie_points").collect()) == [("a", "p"), ("c", "r")]
    assert [r.theme for r in store.read("movie_themes").collect()] == ["t"]


def test_json_documents_leave_absent_fields_out(spark, store):
    row = batch(spark, (12345, "Superman", 45.5, 8.0, ["Sci-Fi", "Action"])).withColumn("last_updated", F.lit(NOW))
    movies = row.select(*schemas.MOVIES.fieldNames()).withColumn("overview", F.lit(""))
    genre = merge.genre_rows(row)
    saved = spark.createDataFrame([("tmdb_12345", 82, "", "Go", 24, ["fx"], [], ["hero"])], SAVED)
    summaries = merge.summary_rows(saved, NOW)
    docs = browse.documents(movies, genre, summaries, merge.point_rows(saved), merge.theme_rows(saved))
    expected = {
        "id": "tmdb_12345", "tmdb_id": 12345, "title": "Superman", "release_date": "2025-07-11T00:00:00Z",
        "genres": ["Action", "Sci-Fi"], "scores": {"imdb": "8"}, "popularity": 45.5, "review_count_analyzed": 24,
        "summary": {"overall_sentiment": 82, "pros": ["fx"], "cons": [], "common_themes": ["hero"], "recommendation": "Go"},
        "last_updated": "2026-08-09T10:00:00Z",
    }
    assert json.loads(json_documents(docs, "id").first().json) == expected
    path = work_path(spark, "export")
    write_documents(docs, path)
    assert json.loads(spark.read.text(path).first().value) == expected


def test_only_folders_without_a_pointer_may_go(spark, store):
    """A bucket that no write touches stays in its old folder."""
    import os
    import shutil

    store.buckets = 8
    store.save_movies(batch(spark, *[(i, f"T{i}", 1.0, None, []) for i in range(60)]), NOW)
    for n in range(3):
        store.save_movies(batch(spark, (7, f"changed {n}", 1.0, None, [])), LATER)
    live, folder = store.live_versions("movies"), store.path("movies") + "/data"
    assert len(live) == 2
    for name in os.listdir(folder):
        if name.startswith("version=") and name.removeprefix("version=") not in live:
            shutil.rmtree(f"{folder}/{name}")
    assert len(titles(store)) == 60 and titles(store)["tmdb_7"].title == "changed 2"


def test_of_two_writers_one_fails(spark, store):
    store.save_movies(batch(spark, (1, "T", 1.0, None, [])), NOW)
    number, versions = store._pointer("movies")
    store._point("movies", number + 1, versions)
    with pytest.raises(Exception, match="exist"):
        store._point("movies", number + 1, {})
    assert set(titles(store)) == {"tmdb_1"}


def test_a_broken_pointer_is_passed_over(spark, store):
    store.save_movies(batch(spark, (1, "T", 1.0, None, [])), NOW)
    number = store._pointer("movies")[0]
    with open(f"{store.path('movies')}/pointer/{number + 1}.json", "w") as out:
        out.write('{"buckets": 2, "ver')
    assert set(titles(store)) == {"tmdb_1"}
    store.save_movies(batch(spark, (2, "U", 1.0, None, [])), NOW)
    assert set(titles(store)) == {"tmdb_1", "tmdb_2"}


def test_a_batch_carries_what_is_stored_and_no_more(spark, store, monkeypatch):
    """Rows are sorted and shuffled to find the last of each id: without other columns, blank or repeated genres."""
    rows = batch(spark, (1, "First", 3.0, None, ["X"]), (1, "Last", 4.0, None, ["Y", "", "Y", None, "Z"]), (2, "None", 1.0, None, None))
    seen, last_wins = [], merge.last_wins
    monkeypatch.setattr(merge, "last_wins", lambda b, key, order: seen.append(b) or last_wins(b, key, order))
    # the order may be a stored column
    store.save_movies(rows.withColumn("more", F.lit("x")), NOW, order="popularity")
    assert {i: (r.title, r.popularity) for i, r in titles(store).items()} == {"tmdb_1": ("Last", 4.0), "tmdb_2": ("None", 1.0)}
    assert genres(store) == [("tmdb_1", "Y"), ("tmdb_1", "Z")]
    assert not {"more", "n"} & set(seen[0].columns)
    assert sorted(len(r.genres or []) for r in seen[0].collect()) == [0, 1, 2]
    plan = merge.genre_rows(rows, unique=True)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Exchange" in merge.genre_rows(rows)._jdf.queryExecution().executedPlan().toString()
