import json
import os

import pytest

from titleflow import schemas
from titleflow.session import work_path
from titleflow.sources import listings, ratings, registry, replies, reviews, stored


def landed(spark, payloads, name="payloads"):
    path = work_path(spark, name)
    os.makedirs(path)
    with open(f"{path}/part.json", "w") as out:
        for payload in payloads:
            out.write((payload if isinstance(payload, str) else json.dumps(payload)) + "\n")
    return path


def page(number, ids, total=3, year=2026, **extra):
    results = [{"id": i, "title": f"T{i}", "release_date": "2026-02-20", **extra} for i in ids]
    return {"year": year, "page": number, "total_pages": total, "results": results}


def test_listing_pages(spark):
    payload = page(1, [1, 2])
    payload["results"][0] |= {"poster_path": "/a.jpg", "overview": "o", "popularity": 9.5, "genre_ids": [28, 12]}
    payload["results"][1] |= {"poster_path": "", "release_date": ""}
    path = landed(spark, [payload, "{broken"])
    pages = listings.read_listing(spark, path)
    assert listings.malformed(pages, "listing").count() == 1
    first, second = listings.listing_titles(listings.well_formed(pages)).orderBy("pos").collect()
    assert (first.id, first.poster_url, first.popularity, first.genre_ids) == (
        "tmdb_1", "https://image.tmdb.org/t/p/w500/a.jpg", 9.5, [28, 12])
    assert (second.poster_url, second.release_date, second.popularity) == (None, None, 0.0)


def test_now_playing_stops_at_first_empty_page(spark):
    pages = [page(1, range(0, 20)), page(2, range(20, 40)), page(3, []), page(4, range(60, 80))]
    frame = listings.well_formed(listings.read_listing(spark, landed(spark, pages)))
    assert listings.now_playing(frame, 100).count() == 40
    assert [r.tmdb_id for r in listings.now_playing(frame, 25).collect()] == list(range(25))
    assert listings.now_playing(frame, 0).count() == 20


def test_search_results(spark):
    frame = listings.well_formed(listings.read_listing(spark, landed(spark, [page(1, [1, 2, 3]), page(2, [4])])))
    assert listings.search_results(frame, "q").count() == 3
    assert listings.search_results(frame, "q", 2).count() == 2
    with pytest.raises(ValueError):
        listings.search_results(frame, "")


def test_genres_and_details(spark):
    genres = landed(spark, [{"genres": [{"id": 28, "name": "Action"}, {"id": 12, "name": "Adventure"}, {"id": 28, "name": "Later"}]}])
    found = listings.genre_dictionary(listings.well_formed(listings.read_payloads(spark, genres, schemas.GENRE_LIST)))
    assert dict(found.collect()) == {28: "Later", 12: "Adventure"}
    details = landed(spark, [{"id": 1, "imdb_id": "tt1", "genres": [{"name": "B"}, {"name": "A"}]}])
    row = listings.title_details(listings.read_payloads(spark, details, schemas.TITLE_DETAILS)).first()
    assert (row.tmdb_id, row.imdb_id, row.genres) == (1, "tt1", ["B", "A"])


def test_ratings(spark):
    tomato = [{"Source": "Rotten Tomatoes", "Value": "1%"}, {"Source": "x", "Value": "2"}, {"Source": "Rotten Tomatoes", "Value": "84%"}]
    path = landed(spark, [
        {"imdb_id": "a", "Response": "True", "imdbRating": "7.8", "Ratings": tomato},
        {"imdb_id": "b", "Response": "False", "imdbRating": "7.8", "Ratings": tomato},
        {"imdb_id": "c", "imdbRating": "N/A"},
    ])
    rows = ratings.rating_scores(listings.read_payloads(spark, path, schemas.RATINGS)).orderBy("imdb_id").collect()
    assert [(r.imdb, r.rotten_tomatoes) for r in rows] == [("7.8", "84%"), (None, None), (None, None)]


def test_forum_posts(spark):
    posts = [{"data": {"id": str(i), "title": f"t{i}", "selftext": "s" if i else "[removed]", "author": "u", "score": i,
                       "permalink": f"/r/{i}", "created_utc": 1700000000.9, "over_18": i == 2}} for i in range(20)]
    path = landed(spark, [{"movie_id": "tmdb_1", "data": {"children": posts}}])
    found = reviews.forum_reviews(listings.read_payloads(spark, path, schemas.FORUM_SEARCH)).orderBy("ordinal").collect()
    assert [r.ordinal for r in found] == [0, 1, *range(3, 15)]
    assert (found[0].id, found[0].content, found[0].url) == ("reddit_0", "t0", "https://reddit.com/r/0")
    assert found[1].content == "t1\n\ns"
    assert found[1].created_at.timestamp() == 1700000000


def test_feed_files(spark):
    items = "".join(
        f"<item><title>t{i}</title><link>http://l/{i}</link><description>&lt;p&gt;d{i}&lt;/p&gt;</description>"
        f"<pubDate>Mon, 02 Jan 2006 15:04:05 GMT</pubDate>{'<dc:creator>me</dc:creator>' if i else ''}</item>" for i in range(12))
    path = work_path(spark, "feeds")
    for movie in ("tmdb_1", "tmdb_2"):
        os.makedirs(f"{path}/movie_id={movie}")
        with open(f"{path}/movie_id={movie}/feed.xml", "w") as out:
            out.write(f'<?xml version="1.0"?>\n<rss xmlns:dc="http://d/">\n<channel><title>c</title>\n{items}</channel></rss>')
    found = reviews.feed_reviews(reviews.read_feeds(spark, path)).orderBy("movie_id", "ordinal").collect()
    assert len(found) == 20
    first = found[0]
    assert (first.movie_id, first.id, first.content, first.author, first.score) == ("tmdb_1", "letterboxd_1", "d0", "Letterboxd User", 0)
    assert (found[1].author, found[9].id, found[10].id) == ("me", "letterboxd_10", "letterboxd_1")
    assert first.created_at is not None


GOOD = ('{"overall_sentiment": 85, "pros": ["a", "b"], "cons": ["c"], "common_themes": ["x", "y"], '
        '"audience_consensus": "ok", "recommendation": "go"}')


def test_replies_are_all_or_nothing(spark):
    texts = [GOOD, "{}", "null", '{"overall_sentiment": null, "pros": null, "extra": [1]}', '{"pros": ["a", null]}',
             "", "```json\n{}\n```", "[]", '"x"', "{} {}", "{} x", '{"overall_sentiment": 85.5}', '{"overall_sentiment": 85.0}',
             '{"overall_sentiment": "85"}', '{"pros": [1]}', '{"pros": "a"}', '{"recommendation": 5}', "{", '{},{}', None]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, reply string")
    rows = replies.parse_replies(frame).orderBy("n").collect()
    accepted = [r.n for r in rows if r.reply_error is None]
    assert accepted == [0, 1, 2, 3, 4]
    assert all((r.summary is None) == (r.reply_error is not None) for r in rows)
    assert (rows[0].summary.overall_sentiment, rows[0].summary.pros, rows[0].summary.cons) == (85, ["a", "b"], ["c"])
    empty = rows[1].summary
    assert (empty.overall_sentiment, empty.pros, empty.audience_consensus) == (0, [], "")
    assert rows[4].summary.pros == ["a", ""]


def test_stored_rows(spark):
    rows = [json.dumps({"id": "tmdb_100", "tmdb_id": 100, "imdb_id": 5, "title": "T", "release_date": "2025-07-11",
                        "popularity": 45.5, "imdb_score": 8.2, "rotten_tomatoes": 88.9, "last_updated": "2026-01-01T00:00:00Z"}),
            json.dumps({"id": 7, "tmdb_id": "x", "popularity": "45.5", "rotten_tomatoes": -3.7, "release_date": "soon"})]
    good, bad = stored.decode_movies(spark.createDataFrame([(r,) for r in rows], "row string")).collect()
    assert (good.id, good.tmdb_id, good.imdb_id, good.popularity, good.rotten_tomatoes) == ("tmdb_100", 100, None, 45.5, 88)
    assert (good.release_date.year, good.last_updated.year) == (2025, 2026)
    assert (bad.id, bad.tmdb_id, bad.popularity, bad.rotten_tomatoes, bad.release_date) == (None, None, None, -3, None)
    summary = stored.decode_summaries(spark.createDataFrame([('{"movie_id": "m", "overall_sentiment": 92, "review_count": 24}',)], "row string")).first()
    assert (summary.overall_sentiment, summary.review_count, summary.audience_consensus) == (92, 24, None)


def test_a_source_that_breaks_while_it_is_read(spark, tmp_path):
    (tmp_path / "part-0.parquet").write_text("not parquet")
    good = spark.createDataFrame([("m", "1", "s", "a", "text", 1, "u", None, 0)], schemas.REVIEWS)

    def silent(_):
        raise OSError()

    sources = registry.Sources().add_reviews("torn", lambda s: s.read.schema(schemas.REVIEWS).parquet(str(tmp_path)))
    found, errors = sources.add_reviews("silent", silent).add_reviews("good", lambda s: good).collect(spark)
    assert [(r.movie_id, r.source_rank) for r in found.collect()] == [("m", 2)]
    assert [(r.source, bool(r.error)) for r in errors.collect()] == [("torn", True), ("silent", True)]


def test_failing_source_contributes_nothing(spark):
    good = spark.createDataFrame([("m", "1", "s", "a", "text", 1, "u", None, 0)], schemas.REVIEWS)
    sources = (
        registry.Sources()
        .add_reviews("missing", lambda s: s.read.parquet("/no/such/place"))
        .add_reviews("good", lambda s: good)
    )
    found, errors = sources.collect(spark)
    assert [(r.movie_id, r.source_rank) for r in found.collect()] == [("m", 1)]
    assert [r.source for r in errors.collect()] == ["missing"]
    with pytest.raises(KeyError):
        sources.candidates(spark, "unknown")
    nothing, _ = registry.Sources().collect(spark)
    assert nothing.count() == 0


def own_source():
    """A source as a user would write it; defined here so that it travels by value."""
    from titleflow.sources.per_title import TitleSource

    class Archive(TitleSource):
        @classmethod
        def name(cls):
            return "archive"

        def fetch(self, movie_id):
            if movie_id == self.options.get("breaks"):
                raise OSError("archive is down")
            for k in range(2):
                yield (movie_id, f"archive_{movie_id}_{k}", "archive", "a", f"text {k}", k, None, None, k)

    return Archive


def test_a_title_source_is_asked_for_the_pool_only(spark):
    asked = spark.createDataFrame([(f"m{i}",) for i in range(20)] + [("m1",)], "movie_id string")
    found, errors = registry.Sources().add_title_source(own_source()).collect(spark, asked)
    assert sorted({r.movie_id for r in found.collect()}) == sorted(f"m{i}" for i in range(20))
    assert found.count() == 40 and errors.count() == 0
    whole = registry.Sources().add_title_source(own_source())
    assert "filter on movie_id" in whole.collect(spark)[1].first().error


def test_a_title_source_that_breaks_is_one_error(spark):
    good = spark.createDataFrame([("m1", "1", "s", "a", "text", 1, "u", None, 0), ("other", "1", "s", "a", "text", 1, "u", None, 0)], schemas.REVIEWS)
    asked = spark.createDataFrame([("m1",), ("m2",)], "movie_id string")
    sources = registry.Sources().add_title_source(own_source(), breaks="m2").add_reviews("good", lambda s: good)
    found, errors = sources.collect(spark, asked)
    assert [(r.movie_id, r.source_rank) for r in found.collect()] == [("m1", 1)]
    (error,) = errors.collect()
    assert error.source == "archive" and "archive is down" in error.error


def test_of_a_stored_source_only_the_asked_titles_are_written(spark, monkeypatch, tmp_path):
    rows = spark.createDataFrame([(f"m{i % 50}", str(i), "s", "a", "text", 1, "u", None, i) for i in range(500)], schemas.REVIEWS)
    rows.write.parquet(f"{tmp_path}/reviews")
    sizes = []
    write = registry.written
    monkeypatch.setattr(registry, "written", lambda frame, label: sizes.append(frame.count()) or write(frame, label))
    sources = registry.Sources().add_reviews("stored", lambda s: s.read.schema(schemas.REVIEWS).parquet(f"{tmp_path}/reviews"))
    asked = spark.createDataFrame([("m3",), ("m4",)], "movie_id string")
    assert sources.collect(spark, asked)[0].count() == 20
    monkeypatch.setattr(registry, "ASKED", 1)
    assert sources.collect(spark, asked)[0].count() == 20
    assert sizes == [20, 20]
