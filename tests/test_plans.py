"""The physical plans that large inputs depend on."""

import datetime as dt
import re

import pytest

from titleflow import schemas
from titleflow.operators import browse, candidates, gate, lists, reviews
from titleflow.plans import documents
from titleflow.session import rows_up_to, work_path

NOW = dt.datetime(2026, 8, 9)


@pytest.fixture
def plan(spark, capsys):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")

    def text(frame):
        capsys.readouterr()
        frame.explain()
        return capsys.readouterr().out

    return text


@pytest.fixture(scope="module")
def movies(spark):
    path = work_path(spark, "typed")
    spark.createDataFrame([("tmdb_1", 1, None, "T", NOW, None, "o", 50.0, None, None, NOW)], schemas.MOVIES).write.parquet(path)
    return spark.read.schema(schemas.MOVIES).parquet(path)


REVIEW = "movie_id string, source string, content string, score int, source_rank int, ordinal long"


def test_copies_and_top_reviews_are_limited_before_their_exchanges(spark, plan):
    text = plan(reviews.winners(spark.createDataFrame([("m", "s", "a b c", 1, 0, 0)], REVIEW)))
    assert text.count("Exchange hashpartitioning") == 2
    assert text.count("row_number(), 1, Partial") == 1 and text.count("row_number(), 30, Partial") == 1
    assert text.count("https?://") == 1  # every text is cleaned once


def exchanged(frame, capsys):
    """The input columns of every exchange in a plan."""
    capsys.readouterr()
    frame.explain("formatted")
    parts = capsys.readouterr().out.split("\n\n")
    return [p.split("Input", 1)[1].splitlines()[0] for p in parts if re.match(r"\(\d+\) Exchange", p.strip())]


@pytest.mark.parametrize("few", [True, False])
def test_no_exchange_carries_a_text_before_the_winners_are_known(spark, plan, capsys, monkeypatch, few):
    """Few winners are broadcast; the texts of more meet them behind the filter of winners."""
    if not few:
        monkeypatch.setattr(reviews, "BROADCAST_WINNERS", 0)
    rows = spark.createDataFrame([("m", "s", "a b c", 1, 0, 0)], REVIEW)
    assert len(exchanged(reviews.winners(rows), capsys)) == 2
    assert not any("content" in columns for columns in exchanged(reviews.winners(rows), capsys))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(reviews.prepare_reviews(rows))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    # one exchange drops repeated arrivals of winners, two join what passed the filter with the winners
    assert text.count("Exchange hashpartitioning") == (1 if few else 3)
    assert few or text.count("__bitmap") and text.index("__bitmap") > text.index("SortMergeJoin")


def test_bounds_of_the_candidate_feed_reach_the_scan(movies, plan):
    text = plan(candidates.candidate_pool(candidates.popular_recent(movies, NOW).select("id", "popularity"), 10))
    assert "GreaterThanOrEqual(popularity,20.0)" in text and "GreaterThanOrEqual(release_date" in text
    assert "TakeOrderedAndProject(limit=50" in text
    assert "ReadSchema: struct<id:string,release_date:timestamp,popularity:double>" in text


def test_a_year_is_a_range_on_the_scan(movies, plan):
    text = plan(candidates.of_year(movies, 2026).select("id"))
    assert "GreaterThanOrEqual(release_date" in text and "LessThan(release_date" in text


def test_lists_need_one_exchange(spark, plan):
    rows = spark.createDataFrame([("m", "pro", 1, "x")], schemas.MOVIE_POINTS)
    themes = spark.createDataFrame([("m", 1, "x")], schemas.MOVIE_THEMES)
    text = plan(lists.entry_lists(rows, themes))
    assert text.count("Exchange") == 1 and "Join" not in text


def test_merges_read_only_touched_buckets(spark, store, plan):
    rows = spark.createDataFrame([(f"m{i}", "pro", 1, "x") for i in range(50)], schemas.MOVIE_POINTS)
    store.create("movie_points", rows)
    places = store._buckets("movie_points", [1]).inputFiles()
    assert places and all("/bucket=1/" in place for place in places)


def test_a_page_is_cut_on_narrow_rows(spark, store, plan):
    rows = [(f"m{i}", i, None, f"T{i}", NOW, None, "long", 1.0 * i, None, None, NOW) for i in range(30)]
    store.create("movies", spark.createDataFrame(rows, schemas.MOVIES))
    for keys in (browse.page_keys(store.read("movies"), "popularity", "desc", 24, 0), browse.titles_like(store.read("movies"), "T")):
        text = plan(keys)
        assert "TakeOrderedAndProject" in text and "overview" not in text.split("ReadSchema")[1]


def test_rows_are_only_fetched_up_to_a_bound(spark):
    assert len(rows_up_to(spark.range(5), 5)) == 5
    assert rows_up_to(spark.range(6), 5) is None


def test_requests_join_their_window_by_equality(spark, plan):
    asked = spark.createDataFrame([(1, "m", NOW)], "request_id long, movie_id string, requested_at timestamp")
    text = plan(gate.gate_requests(asked, None, None))
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_reads_of_a_page_open_its_buckets_only(spark, store):
    """Also of asked documents and summaries, whatever is stored besides."""
    store.buckets = 16
    rows = [(f"m{i}", i, None, f"T{i}", NOW, None, "long", 1.0 * i, None, None, NOW) for i in range(200)]
    store.create("movies", spark.createDataFrame(rows, schemas.MOVIES))
    store.create("movie_genres", spark.createDataFrame([(f"m{i}", "G") for i in range(200)], schemas.MOVIE_GENRES))
    store.create("movie_summaries", spark.createDataFrame([(f"m{i}", 40, "c", "", 4, NOW) for i in range(200)], schemas.MOVIE_SUMMARIES))
    asked = spark.createDataFrame([("m7", 0), ("m11", 1)], "movie_id string, pos int")
    own = {f"bucket={b}" for b in store.touched(asked, "movie_id")}
    page = documents.browse(store, NOW, sort="popularity", limit=2).results
    top = {f"bucket={b}" for b in store.touched(spark.createDataFrame([("m199",), ("m198",)], "id string"), "id")}
    for frame, buckets in ((page, top), (documents.documents(store, asked), own), (documents.summaries(store, asked), own)):
        opened = {part for place in frame.inputFiles() for part in place.split("/") if part.startswith("bucket=")}
        assert opened and opened <= buckets
    assert {r.id for r in page.collect()} == {"m199", "m198"}
    assert {r.id for r in documents.documents(store, asked).collect()} == {"m7", "m11"}
    assert {r.id for r in documents.search(store, "T15", 50).collect()} == {"m15", *(f"m{i}" for i in range(150, 160))}
