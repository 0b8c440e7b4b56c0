import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from titleflow import schemas
from titleflow.operators import coverage, joins
from titleflow.plans.catalog_sync import catalog_sync
from titleflow.session import work_path
from titleflow.sources import listings
from titleflow.streaming import ingest

NOW = dt.datetime(2026, 8, 9)
GENRES = {"genres": [{"id": 28, "name": "Action"}, {"id": 35, "name": "Comedy"}, {"id": 0, "name": ""}]}


def page(number, ids, year=2026, total=3):
    results = [{"id": i, "title": f"T{i}", "genre_ids": [28, 35, 0, 999] if i == 103 else []} for i in ids]
    return {"year": year, "page": number, "total_pages": total, "results": results}


def frame(spark, payloads, schema=schemas.LISTING_PAGE):
    texts = [p if isinstance(p, str) else json.dumps(p) for p in payloads]
    lines = spark.createDataFrame([(t,) for t in texts], "value string")
    return listings.parse_payloads(lines, schema)


def genres(spark):
    return frame(spark, [GENRES], schemas.GENRE_LIST)


def known(spark, store, *ids):
    rows = spark.createDataFrame([(f"tmdb_{i}", i, "known") for i in ids], "id string, tmdb_id long, title string")
    missing = [f for f in schemas.MOVIES.fields if f.name not in rows.columns]
    store.create("movies", rows.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing]))


def test_pages_with_a_known_title_and_genres(spark, store):
    known(spark, store, 102)
    pages = frame(spark, [page(1, [101, 102]), page(2, [103]), page(3, [104]), '{"page": "x"}'])
    counters = catalog_sync(store, pages, genres(spark), NOW).first()
    assert counters.asDict() == {"pages": 3, "discovered": 4, "saved": 3, "skipped": 1, "errors": 1}
    titles = {r.id: r.title for r in store.read("movies").collect()}
    assert titles == {"tmdb_101": "T101", "tmdb_102": "known", "tmdb_103": "T103", "tmdb_104": "T104"}
    assert sorted((r.movie_id, r.genre) for r in store.read("movie_genres").collect()) == [
        ("tmdb_103", "Action"), ("tmdb_103", "Comedy")]
    again = catalog_sync(store, pages, genres(spark), NOW).first()
    assert (again.saved, again.skipped) == (0, 4)


def test_duplicates_in_a_batch_count_once_and_the_last_wins(spark, store):
    first, second = page(1, [1]), page(2, [1])
    second["results"][0]["title"] = "later"
    counters = catalog_sync(store, frame(spark, [first, second]), genres(spark), NOW).first()
    assert (counters.discovered, counters.saved) == (2, 1)
    assert store.read("movies").first().title == "later"


@pytest.mark.parametrize("small", [1000, 1])
def test_genre_names_by_map_and_by_join(spark, small):
    titles = spark.createDataFrame([("a", [35, 28, 999, 0, 28]), ("b", []), ("c", None)], "id string, genre_ids array<int>")
    dictionary = listings.genre_dictionary(genres(spark))
    got = {r.id: r.genres for r in joins.name_genres(titles, dictionary, small).collect()}
    assert got == {"a": ["Comedy", "Action", "Action"], "b": [], "c": []}


def test_empty_genre_dictionary(spark):
    titles = spark.createDataFrame([("a", [1])], "id string, genre_ids array<int>")
    nothing = spark.createDataFrame([], "genre_id int, name string")
    assert joins.name_genres(titles, nothing).first().genres == []


def totals(spark, **years):
    return spark.createDataFrame([(int(y[1:]), n) for y, n in years.items()], "year int, total_pages int")


def plan(spark, year_totals, year, page, limit, landed=None):
    pages = coverage.missing_pages(year_totals, landed, year, page, limit)
    cursor = coverage.next_cursor(pages, 2026).first()
    return [(r.year, r.page) for r in pages.orderBy("lap", F.col("year").desc(), "page").collect()], cursor


def test_missing_pages(spark):
    pages, cursor = plan(spark, totals(spark, y2024=1, y2023=2), 2024, 0, 2)
    assert (pages, cursor.current_year, cursor.last_page) == ([(2024, 1), (2023, 1)], 2023, 1)
    pages, cursor = plan(spark, totals(spark, y2026=10), 2026, 0, 2)
    assert (pages, cursor.last_page, cursor.total_pages) == ([(2026, 1), (2026, 2)], 2, 10)
    pages, cursor = plan(spark, totals(spark, y2024=48000, y2023=5), 2024, 499, 1)
    assert (pages, cursor.current_year, cursor.last_page) == ([(2024, 500)], 2023, 0)
    pages, _ = plan(spark, totals(spark, y2024=2, y2023=0, y2022=1), 2024, 1, 9)
    assert pages == [(2024, 2), (2022, 1), (2024, 1)]
    pages, cursor = plan(spark, totals(spark, y1890=1, y2026=1, y1889=4), 1890, 0, 1)
    assert (pages, cursor.current_year, cursor.completed) == ([(1890, 1)], 2026, True)
    landed = spark.createDataFrame([(2024, 1), (2024, 2)], "year int, page int")
    pages, _ = plan(spark, totals(spark, y2024=4), 2024, 0, 9, landed)
    assert pages == [(2024, 3), (2024, 4)]


def cursor_file(spark, text):
    path = work_path(spark, "cursor")
    os.makedirs(path)
    with open(f"{path}/cursor.json", "w") as out:
        out.write(text)
    return f"{path}/cursor.json"


def test_cursor_is_ready_to_resume(spark):
    def resumed(**stored):
        return coverage.read_cursor(spark, cursor_file(spark, json.dumps(stored, indent=1)), 2026).first()

    same = resumed(last_page=52, total_pages=500, sort_by="popularity.asc", current_year=2020, movies_cataloged_this_cycle=240)
    assert (same.last_page, same.current_year, same.sort_by, same.movies_cataloged_this_cycle) == (52, 2020, "popularity.asc", 240)
    legacy = resumed(last_page=45, total_pages=100)
    assert (legacy.last_page, legacy.current_year, legacy.sort_by) == (0, 2026, "popularity.desc")
    done = resumed(last_page=3, current_year=1900, completed=True, movies_cataloged_this_cycle=9)
    assert (done.last_page, done.current_year, done.completed, done.movies_cataloged_this_cycle) == (0, 2026, False, 0)
    full = resumed(last_page=500, current_year=2020)
    assert (full.last_page, full.current_year) == (0, 2019)
    assert resumed(last_page=500, current_year=1890).current_year == 2026
    with pytest.raises(Exception):
        coverage.read_cursor(spark, cursor_file(spark, "{bad"), 2026).collect()
    start = coverage.default_cursor(spark, 2026).first()
    assert (start.current_year, start.last_page, start.sort_by) == (2026, 0, "popularity.desc")


def test_ingest_resumes_after_the_last_page(spark, store):
    path, checkpoint = work_path(spark, "landed"), work_path(spark, "checkpoint")
    os.makedirs(path)
    for n in range(1, 6):
        with open(f"{path}/page{n}.json", "w") as out:
            out.write(json.dumps(page(n, [n * 10, n * 10 + 1])))
        os.utime(f"{path}/page{n}.json", (1_700_000_000 + n, 1_700_000_000 + n))

    def run():
        return ingest.ingest_pages(store, ingest.page_stream(spark, path, 1), genres(spark), checkpoint, NOW, max_batches=2)

    def ids():
        return sorted(r.tmdb_id for r in store.read("movies").collect())

    assert run() == 2
    assert ids() == [10, 11, 20, 21]
    assert (run(), run(), run()) == (2, 1, 0)
    assert ids() == [n * 10 + k for n in range(1, 6) for k in (0, 1)]


def land(path, name, numbers, age):
    with open(f"{path}/{name}", "w") as out:
        out.write("\n\n".join(json.dumps(page(n, [n * 10])) for n in numbers) + "\n")
    os.utime(f"{path}/{name}", (1_700_000_000 + age, 1_700_000_000 + age))


@pytest.mark.parametrize("per_batch", [1, 2, 100])
def test_a_run_takes_exactly_its_pages(spark, store, per_batch):
    """Files hold several pages, blank lines or none; the limit falls inside files; one lands late with an old date."""
    path, progress = work_path(spark, "landed"), work_path(spark, "progress")
    os.makedirs(path)
    land(path, "a b.json", [1, 2, 3], 1)
    land(path, "empty.json", [], 2)
    land(path, "c.json", [4, 5, 6, 7], 3)

    def run(most=2):
        return ingest.ingest_landed(store, path, genres(spark), progress, NOW, max_pages=most, pages_per_batch=per_batch)

    def ids():
        return sorted(r.tmdb_id for r in store.read("movies").collect())

    assert run() == 2 and ids() == [10, 20]
    assert run() == 2 and ids() == [10, 20, 30, 40]
    land(path, "old.json", [8], 0)
    assert run(1) == 1 and ids() == [10, 20, 30, 40, 80]
    assert run(0) == 3 and ids() == [10 * n for n in range(1, 9)]
    assert run() == 0


def test_pages_of_a_failed_batch_are_taken_again(spark, store, monkeypatch):
    path, progress = work_path(spark, "landed"), work_path(spark, "progress")
    os.makedirs(path)
    land(path, "a.json", [1, 2, 3], 1)

    def run():
        return ingest.ingest_landed(store, path, genres(spark), progress, NOW, pages_per_batch=2)

    save, calls = store.upsert, []

    def lost(*args, **named):
        calls.append(1)
        if len(calls) == 2:
            raise OSError("lost")
        return save(*args, **named)

    monkeypatch.setattr(store, "upsert", lost)
    with pytest.raises(OSError):
        run()
    monkeypatch.setattr(store, "upsert", save)
    assert run() == 1
    assert sorted(r.tmdb_id for r in store.read("movies").collect()) == [10, 20, 30] and run() == 0


def test_failed_batch_is_run_again(spark, store, monkeypatch):
    path, checkpoint = work_path(spark, "landed"), work_path(spark, "checkpoint")
    os.makedirs(path)
    with open(f"{path}/page.json", "w") as out:
        out.write(json.dumps(page(1, [1, 2])))
    save = store.upsert
    monkeypatch.setattr(store, "upsert", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(Exception):
        ingest.ingest_pages(store, ingest.page_stream(spark, path, 1), genres(spark), checkpoint, NOW)
    monkeypatch.setattr(store, "upsert", save)
    assert ingest.ingest_pages(store, ingest.page_stream(spark, path, 1), genres(spark), checkpoint, NOW) == 1
    assert store.read("movies").count() == 2
