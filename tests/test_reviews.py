import pytest

from titleflow.operators import lists, reviews
from titleflow.operators.reviews import INSTRUCTIONS, NO_REVIEWS_NOTE

COLUMNS = "movie_id string, id string, source string, content string, score int, source_rank int, ordinal long"


def frame(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


def test_clean_dedupe_rank_cap(spark):
    rows = [
        ("m", "1", "s", "short", 10, 0, 0),
        ("m", "2", "s", "This movie was absolutely fantastic and great https://a.b/c", 50, 0, 1),
        ("m", "3", "s", "This movie was absolutely fantastic and great", 40, 0, 2),
        ("m", "4", "s", "A completely different review with other words", 100, 0, 3),
    ]
    got = reviews.prepare_reviews(frame(spark, rows), 5, 2).orderBy("rank").collect()
    assert [(r.id, r.rank) for r in got] == [("4", 1), ("2", 2)]


def test_first_arrival_wins_even_with_a_lower_score(spark):
    rows = [("m", "late", "b", "same words here", 99, 1, 0), ("m", "early", "a", "Same  words\nhere", 1, 0, 7),
            ("other", "o", "a", "same words here", 5, 0, 8)]
    got = reviews.prepare_reviews(frame(spark, rows)).collect()
    assert sorted(r.id for r in got) == ["early", "o"]


def test_ties_go_by_arrival_and_defaults_apply(spark):
    rows = [("m", str(i), "s", f"review number {i}", 5, 0, i) for i in range(40)]
    got = reviews.prepare_reviews(frame(spark, rows), 0, -1).orderBy("rank").collect()
    assert [r.id for r in got] == [str(i) for i in range(30)]


def test_words_after_the_fifteenth_do_not_count(spark):
    start = " ".join(f"w{i}" for i in range(15))
    rows = [("m", "1", "s", start + " one", 1, 0, 0), ("m", "2", "s", start + " two", 2, 0, 1)]
    assert [r.id for r in reviews.prepare_reviews(frame(spark, rows)).collect()] == ["1"]


@pytest.mark.parametrize("few", [reviews.BROADCAST_WINNERS, 0])
def test_texts_are_fetched_for_winners_alone(spark, monkeypatch, few):
    """By broadcast or through the filter of winners: nulls, a hot title and repeated arrivals included."""
    monkeypatch.setattr(reviews, "BROADCAST_WINNERS", few)
    rows = [("hot", f"h{i}", "s", f"review number {i % 700} of many", i % 97, 0, i) for i in range(3000)]
    rows += [(f"m{i}", f"c{i}", "s", f"one review of {i}", i, 0, 0) for i in range(400)]
    rows += [(None, "n", "s", "words of no title", None, None, None), ("e", "x", None, None, 1, 0, 0)]
    rows += [("twice", "t1", "s", "the same arrival once", 5, 0, 0), ("twice", "t2", "s", "the same arrival again", 5, 0, 0)]
    rows += [("again", "a", "s", "a row that repeats", 5, 0, 0)] * 2
    got = reviews.prepare_reviews(frame(spark, rows), 3, 30).collect()
    hot = {}
    for r in rows[:3000]:
        hot.setdefault(r[3], r)
    best = sorted(hot.values(), key=lambda r: (-r[4], r[6]))[:30]
    assert [(r.id, r.content) for r in sorted((r for r in got if r.movie_id == "hot"), key=lambda r: r.rank)] == [(r[1], r[3]) for r in best]
    assert sorted(r.id for r in got if r.movie_id != "hot") == sorted([f"c{i}" for i in range(400)] + ["n", "t1", "t2", "a"])


def test_the_filter_of_winners_passes_few_others(spark):
    rows = frame(spark, [("m", str(i), "s", "c", 1, 0, i) for i in range(20_000)])
    kept = rows.where("ordinal % 20 = 0")
    passed = {r.ordinal for r in reviews._maybe(rows, kept, 1000).collect()}
    assert {i for i in range(0, 20_000, 20)} <= passed and len(passed) < 1000 + 19_000 / 16 * 1.2


def test_counts_show_zero(spark):
    prepared = reviews.prepare_reviews(frame(spark, [("m", "1", "s", "a b c", 1, 0, 0)]))
    titles = spark.createDataFrame([("m",), ("n",)], "movie_id string")
    assert dict(reviews.review_counts(titles, prepared).collect()) == {"m": 1, "n": 0}


def test_prompt_texts(spark):
    rows = [("m", "1", "forum", "good film indeed", 3, 0, 0), ("m", "2", "feed", "bad film indeed", 9, 1, 0)]
    titles = spark.createDataFrame([("m", "T", "O"), ("n", "N", ""), ("p", "P", None)], "movie_id string, title string, overview string")
    got = {r.movie_id: r for r in reviews.prompt_texts(titles, reviews.prepare_reviews(frame(spark, rows))).collect()}
    assert got["m"].prompt == (
        "Movie Title: T\nOverview: O\n\nCollected Audience Reviews:\n"
        "\n--- Review #1 (Source: feed, Score: 9) ---\nbad film indeed\n"
        "\n--- Review #2 (Source: forum, Score: 3) ---\ngood film indeed\n" + INSTRUCTIONS)
    assert got["n"].prompt == "Movie Title: N\n" + NO_REVIEWS_NOTE + INSTRUCTIONS
    assert got["p"].prompt == "Movie Title: P\n" + NO_REVIEWS_NOTE + INSTRUCTIONS
    assert (got["m"].review_count, got["n"].review_count) == (2, 0)


def points(spark, rows):
    return spark.createDataFrame(rows, "movie_id string, type string, ordinal long, content string")


def test_point_lists_follow_the_ordinal(spark):
    rows = [("m", "con", 3, "c"), ("m", "pro", 2, "b"), ("m", "pro", 1, "z"), ("m", "note", 0, "n"), ("n", "note", 0, "x")]
    got = {r.movie_id: (r.pros, r.cons) for r in lists.point_lists(points(spark, rows)).collect()}
    assert got == {"m": (["z", "b"], ["c"]), "n": ([], [])}


def test_a_title_has_one_row_whatever_its_ordinals(spark):
    rows = [("far", "pro", 0, "a"), ("far", "con", 100_000, "b"), ("far", "pro", 5_000_000_000, "c")]
    rows += [("hot", "pro", i % 2, f"p{i:04d}") for i in range(2000)] + [("cold", "pro", 1, "q")]
    themes = spark.createDataFrame([("far", 300_000, "y"), ("far", 7, "x"), ("new", 0, "z")], "movie_id string, ordinal long, theme string")
    found = lists.entry_lists(points(spark, rows), themes).collect()
    assert len(found) == len({r.movie_id for r in found}) == 4
    got = {r.movie_id: r for r in found}
    assert (got["far"].pros, got["far"].cons, got["far"].themes) == (["a", "c"], ["b"], ["x", "y"])
    assert got["hot"].pros == [f"p{i:04d}" for i in range(0, 2000, 2)] + [f"p{i:04d}" for i in range(1, 2000, 2)]
    assert (got["new"].pros, got["new"].themes) == ([], ["z"])


def test_genres_are_alphabetical_and_distinct(spark):
    rows = spark.createDataFrame([("m", "b"), ("m", "a"), ("m", "b")], "movie_id string, genre string")
    assert lists.genre_lists(rows).first().genres == ["a", "b"]
