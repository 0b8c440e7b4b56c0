import datetime as dt
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from titleflow.functions import dates, movies, scores, text

WS = set("\t\n\v\f\r \x85\xa0     　") | {chr(c) for c in range(0x2000, 0x200B)}
ALPHABET = "abÉ<>/:.hHtps " + "".join(sorted(WS))


def words(s):
    return "".join(" " if c in WS else c for c in s).split(" ")


def trimmed(s):
    return s.strip("".join(WS))


def cleaned(s):
    lines = [trimmed(line) for line in re.sub(r"https?://[^\t\n\f\r ]+", "", s).split("\n")]
    return "\n".join(line for line in lines if line)


def without_tags(s):
    out, inside = [], False
    for c in s:
        if c == "<":
            inside = True
        elif c == ">":
            inside = False
        elif not inside:
            out.append(c)
    return trimmed("".join(out))


TEXTS = st.lists(
    st.lists(st.sampled_from([*ALPHABET, "http://x.y/", "https://", "word", "<b>"]), max_size=30).map("".join),
    min_size=30, max_size=60,
)


def test_text_functions_against_plain_python(column):
    @settings(max_examples=8, deadline=None)
    @given(TEXTS)
    def check(values):
        clean = [cleaned(v) for v in values]
        assert column(text.clean_text, "string", values) == clean
        assert column(text.strip_tags, "string", values) == [without_tags(v) for v in values]
        split = [[w for w in words(c) if w] for c in clean]
        assert column(text.word_count, "string", clean) == [len(w) for w in split]
        assert column(text.prefix_key, "string", clean) == [" ".join(w[:15]).lower() for w in split]
        assert column(lambda c: text.has_words(c, 3), "string", clean) == [len(w) >= 3 for w in split]

    check()


def test_clean_text_keeps_inner_blanks_and_drops_blank_lines(column):
    got = column(text.clean_text, "string", ["  a  b \r\n\n 　\n see http://x.y/z?q=1 now\tc \n", "https://only.url", ""])
    assert got == ["a  b\nsee  now\tc", "", ""]


def test_strip_tags_edges(column):
    got = column(text.strip_tags, "string", ["<p>Hi &amp; <b>there</b></p>", "1 > 0", "cut <here", "a<b<c>d"])
    assert got == ["Hi &amp; there", "1  0", "cut", "ad"]


def test_title_search_wildcards_and_case(column):
    def like(query):
        return column(lambda c: text.contains_like(c, query), "string", ["Superman", "ÉTÉ", r"a\b%c", "x_y"])

    assert like("SUPER") == [True, False, False, False]
    assert like("été") == [False, False, False, False]
    assert like("ÉtÉ") == [False, True, False, False]
    assert like("r_an") == [True, False, False, False]
    assert like("_erm") == [True, False, False, False]
    assert like("\\b%") == [False, False, True, False]


def test_post_and_feed_content(spark):
    rows = [("t", None), ("t", ""), ("t", "[deleted]"), ("t", "[removed]"), ("t", "body")]
    frame = spark.createDataFrame(rows, "title string, body string")
    posts = [r.c for r in frame.select(text.post_content(F.col("title"), F.col("body")).alias("c")).collect()]
    assert posts == ["t", "t", "t", "t", "t\n\nbody"]
    feed = spark.createDataFrame([("t", "<p> </p>"), ("t", None), ("t", "<i>x</i>")], "title string, d string")
    items = [r.c for r in feed.select(text.feed_content(F.col("title"), F.col("d")).alias("c")).collect()]
    assert items == ["t", "t", "x"]


def test_imdb_scores(column):
    raw = ["7.8", "7.8/10", " 8.5 ", "N/A", "", "invalid", "7.8 /10", "7.8d", "inf", "1e1", ".5", "1e999", "　7.1　", None]
    expected = [7.8, 7.8, 8.5, None, None, None, None, None, None, 10.0, 0.5, None, 7.1, None]
    assert column(scores.imdb_score, "string", raw) == expected


def test_tomato_scores(column):
    raw = ["84%", "84", " 95% ", "N/A", "", "bad", "84/100", "+84", "84%/100", "84.0", "8 %", None]
    assert column(scores.tomato_score, "string", raw) == [84, 84, 95, None, None, None, 84, 84, None, None, None, None]


def test_score_texts(column):
    assert column(scores.score_text, "double", [8.0, 7.8, None]) == ["8", "7.8", None]
    assert column(scores.sentiment_text, "int", [90, 0, None]) == ["90%", "0%", "Unrated"]
    assert column(scores.sentiment_class, "int", [70, 69, 40, 39, None]) == ["high", "mid", "mid", "low", "none"]
    assert column(scores.sentiment_label, "int", [80, 65, 45, 30, 29, None]) == [
        "Overwhelmingly Positive", "Generally Favorable", "Mixed or Average", "Leaning Negative", "Unfavorable",
        "Awaiting Analysis",
    ]


def test_days_and_stamps(column):
    got = column(lambda c: dates.rfc3339(dates.parse_stored_date(c)), "string", [
        "2025-07-11", "2025-07-11T10:20:30Z", "2025-07-11T10:20:30+02:00", "2025-7-1", "2025-02-30", "soon", "", None,
    ])
    assert got == [
        "2025-07-11T00:00:00Z", "2025-07-11T10:20:30Z", "2025-07-11T08:20:30Z", None, None, None, None, None,
    ]


def test_feed_dates(column):
    got = column(lambda c: dates.rfc3339(dates.parse_feed_date(c)), "string", [
        "Mon, 02 Jan 2006 15:04:05 MST", "Mon, 02 Jan 2006 15:04:05 GMT", "Mon, 02 Jan 2006 15:04:05 -0700",
        "02 Jan 2006 15:04:05 GMT", "Mon, 32 Jan 2006 15:04:05 GMT", "", None,
    ])
    assert got == [
        "2006-01-02T15:04:05Z", "2006-01-02T15:04:05Z", "2006-01-02T22:04:05Z", None, None, None, None,
    ]


def test_months_run_over_the_end_of_the_month(spark):
    def back(day, months):
        return spark.range(1).select(dates.months_before(day, months).cast("string")).first()[0]

    assert back(dt.datetime(2026, 8, 31), 6) == "2026-03-03"
    assert back(dt.datetime(2026, 8, 10), 6) == "2026-02-10"


def test_released_today_is_not_released(column):
    now = dt.datetime(2026, 8, 10, 23, 0)
    got = column(
        lambda c: dates.released_before(c.cast("timestamp"), now), "string",
        ["2026-08-10 00:00:00", "2026-08-09 23:59:59", "2026-08-11 00:00:00", None],
    )
    assert got == [False, True, False, False]


def test_cooldown_hours_round_half_up(column):
    now = dt.datetime(2026, 1, 1, 12, 0)
    got = column(
        lambda c: dates.cooldown_remaining(c.cast("timestamp"), now), "string",
        ["2026-01-01 12:00:00", "2026-01-01 09:03:00", "2026-01-01 06:57:00"],
    )
    assert got == [6.0, 3.1, 1.0]


def test_zoned_now_is_converted(spark):
    east = dt.timezone(dt.timedelta(hours=2))
    got = spark.range(1).select(dates.rfc3339(dates.moment(dt.datetime(2026, 1, 1, 1, 0, tzinfo=east)))).first()[0]
    assert got == "2025-12-31T23:00:00Z"


def test_ids_posters_and_cards(column):
    assert column(movies.movie_id, "bigint", [12345]) == ["tmdb_12345"]
    assert column(movies.poster_url, "string", ["/p.jpg", "", None]) == ["https://image.tmdb.org/t/p/w500/p.jpg", None, None]
    assert column(movies.card_genres, "array<string>", [["a", "b", "c"], [], None]) == ["a • b", "Movie", "Movie"]


def test_content_and_migration_predicates_differ(spark):
    rows = [(None, "", None), (None, None, None), (5, None, None), (None, "x", None)]
    frame = spark.createDataFrame(rows, "s int, a string, r string")
    none = F.lit(None).cast("array<string>")
    got = frame.select(
        movies.has_content(F.col("s"), F.col("a"), F.col("r"), none, none, none),
        movies.to_migrate(F.col("s"), F.col("a"), F.col("r")),
    ).collect()
    assert [tuple(r) for r in got] == [(False, True), (False, False), (True, True), (True, True)]
