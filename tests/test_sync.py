import datetime as dt
import json


from titleflow import schemas
from titleflow.operators import candidates
from titleflow.plans import review_sync as rs
from titleflow.plans import seam

NOW = dt.datetime(2026, 8, 9, 12)
REVIEW = "movie_id string, id string, source string, content string, score int, source_rank int, ordinal long"


def calls(reply=None):
    """A summariser that gives one reply, and fails for titles named Broken."""
    def summarise(prompt):
        if "Broken" in prompt:
            raise RuntimeError("no answer")
        return reply or json.dumps({"overall_sentiment": 85, "pros": ["p"], "audience_consensus": "new"})

    return summarise


def candidate(i, popularity, title=None, overview=""):
    return (f"tmdb_{i}", i, None, title or f"T{i}", NOW - dt.timedelta(days=5), None, overview, popularity, ["Drama"], None)


def inputs(spark, titles, reviewed=(), summarise=calls(), **more):
    reviews = [(m, f"{m}_r", "s", "a fine film indeed", 1, 0, 0) for m in reviewed]
    return rs.Inputs(
        spark.createDataFrame(titles, schemas.CANDIDATES).drop("genre_ids"), spark.createDataFrame(reviews, REVIEW),
        summarise=summarise, **more)


def stored(spark, store, *rows):
    """Rows of (number, hours since the update, sentiment or None)."""
    movies = [(f"tmdb_{i}", i, None, f"Old{i}", None, None, "kept", 1.0, 5.0, 50, NOW - dt.timedelta(hours=h)) for i, h, _ in rows]
    store.create("movies", spark.createDataFrame(movies, schemas.MOVIES))
    summaries = [(f"tmdb_{i}", s, "old", "", 3, NOW - dt.timedelta(hours=h)) for i, h, s in rows if s is not None]
    store.create("movie_summaries", spark.createDataFrame(summaries, schemas.MOVIE_SUMMARIES))


def counters(outcome):
    return outcome.counters.first().asDict()


def movies(store):
    return {r.tmdb_id: r for r in store.read("movies").collect()}


def summaries(store):
    return {r.movie_id: r for r in store.read("movie_summaries").collect()}


def replying():
    """Fails for Broken, answers badly for Fenced, must not be asked for Silent or Stale."""
    def replies(prompt):
        import json

        assert "Silent" not in prompt and "Stale" not in prompt
        if "Broken" in prompt:
            raise RuntimeError("no answer")
        if "Fenced" in prompt:
            return "```json {}```"
        return json.dumps({"overall_sentiment": 85, "pros": ["p"], "audience_consensus": "new"})

    return replies


def test_one_run_over_titles_in_every_state(spark, store):
    stored(spark, store, (1, 25, 90), (2, 1, 90), (8, 1, None))
    names = {1: "Stale", 2: "Fresh", 3: "New", 4: "Broken", 5: "Silent", 6: "Fenced", 7: "Told", 8: "Unsummarised"}
    titles = [candidate(i, 99.0 - i, name, "a plot" if i == 7 else "") for i, name in names.items()]
    old = list(candidate(20, 99.0)); old[4] = dt.datetime(2026, 2, 8)
    titles += [candidate(21, 19.99), tuple(old)]
    details = spark.createDataFrame([(3, "tt3", ["A", "B"]), (1, "tt1", None)], "tmdb_id long, imdb_id string, genres array<string>")
    ratings = spark.createDataFrame(
        [("tt3", "x", "7.8", "84%"), (None, "Told", None, "50/100")], "imdb_id string, title string, imdb string, rotten_tomatoes string")
    run = inputs(spark, titles, [f"tmdb_{i}" for i in (1, 2, 3, 4, 6, 8)], replying(), details=details, ratings=ratings)
    outcome = rs.review_sync(store, run, NOW, 10)

    assert counters(outcome) == {"discovered": 8, "processed": 5, "skipped": 1, "failed": 2}
    assert {r.id: r.error.split(":")[0] for r in outcome.errors.collect()} == {
        "tmdb_4": "LLM error for 'Broken'", "tmdb_6": "LLM error for 'Fenced'"}
    found = {i: (r.title, r.imdb_id, r.imdb_score, r.rotten_tomatoes) for i, r in movies(store).items()}
    assert found == {
        1: ("Stale", "tt1", None, None), 2: ("Old2", None, 5.0, 50), 3: ("New", "tt3", 7.8, 84), 5: ("Silent", None, None, None),
        7: ("Told", None, None, 50), 8: ("Unsummarised", None, None, None)}
    texts = {i: (r.overall_sentiment, r.audience_consensus, r.review_count) for i, r in summaries(store).items()}
    assert texts == {
        "tmdb_1": (90, "old", 3), "tmdb_2": (90, "old", 3), "tmdb_3": (85, "new", 1), "tmdb_5": (None, "", 0),
        "tmdb_7": (85, "new", 0), "tmdb_8": (85, "new", 1)}
    assert sorted((r.movie_id, r.genre) for r in store.read("movie_genres").collect()) == [("tmdb_3", "A"), ("tmdb_3", "B")]
    assert {r.movie_id for r in store.read("movie_points").collect()} == {"tmdb_3", "tmdb_7", "tmdb_8"}

    again = rs.review_sync(store, inputs(spark, [candidate(5, 99.0, "Silent")], summarise=None), NOW, 10)
    assert counters(again)["processed"] == 1  # an empty summary is no reason to skip


def test_pool_fill_walks_past_fresh_titles(spark, store):
    stored(spark, store, (1, 1, 90), (2, 2, 80), (4, 1, 70))
    titles = [candidate(1, 99.0), candidate(2, 98.0), candidate(3, 97.0), candidate(4, 96.0)]
    outcome = rs.review_sync(store, inputs(spark, titles, ["tmdb_3"]), NOW, 1)
    assert counters(outcome) == {"discovered": 4, "processed": 1, "skipped": 2, "failed": 0}


def test_target_comes_first_whatever_its_state(spark, store):
    stored(spark, store, (555, 1, 90))
    outcome = rs.targeted_sync(store, inputs(spark, [candidate(666, 99.0), candidate(555, 98.0)], ["tmdb_555"]), NOW, "tmdb_555", 2)
    assert counters(outcome) == {"discovered": 2, "processed": 2, "skipped": 0, "failed": 0}
    assert summaries(store)["tmdb_555"].audience_consensus == "new"
    assert (movies(store)[555].popularity, movies(store)[555].overview, movies(store)[555].rotten_tomatoes) == (0.0, "kept", None)


def test_unknown_target_is_one_error_and_the_fill_still_runs(spark, store):
    titles = [candidate(1, 99.0), candidate(2, 98.0), candidate(3, 97.0)]
    outcome = rs.targeted_sync(store, inputs(spark, titles), NOW, "tmdb_0", 2)
    assert counters(outcome)["processed"] == 2
    assert [r.error for r in outcome.errors.collect()] == ["Target movie 'tmdb_0' not found in catalog"]
    alone = rs.targeted_sync(store, inputs(spark, titles), NOW, "tmdb_0", 1)
    assert counters(alone) == {"discovered": 0, "processed": 0, "skipped": 0, "failed": 0}


def test_unwritten_summaries_are_a_warning(spark, store, monkeypatch):
    def lost(*args):
        raise OSError("lost")

    monkeypatch.setattr(store, "save_summaries", lost)
    outcome = rs.review_sync(store, inputs(spark, [candidate(1, 99.0)], ["tmdb_1"]), NOW, 10)
    assert (outcome.warnings, counters(outcome)["processed"]) == (["Failed to save summaries: lost"], 1)
    assert set(movies(store)) == {1}


def test_pool_sizes():
    assert [candidates.pool_size(n) for n in (0, 1, 8, 10, 15, 20, 50)] == [50, 40, 40, 50, 75, 100, 100]
    assert [candidates.pool_size(500, most) for most in (100, 300, None)] == [100, 300, 2500]


def test_a_call_happens_once_per_title(spark, tmp_path):
    log = str(tmp_path / "calls")

    def summarise(prompt):
        with open(log, "a") as out:
            out.write(prompt + "\n")
        return "{}"

    prompts = spark.createDataFrame([(f"m{i}", 1, "t", f"p{i}") for i in range(20)], "movie_id string, review_count long, title string, prompt string")
    replies = seam.call_summariser(prompts, summarise)
    assert replies.count() == 20 and replies.filter("reply = '{}'").count() == 20
    assert sorted(open(log).read().split()) == sorted(f"p{i}" for i in range(20))


def test_stub_is_deterministic():
    reply = seam.stub_reply()
    assert reply("a\n--- Review #1 ...") == reply("a\n--- Review #1 ...")
    assert json.loads(reply("nothing"))["overall_sentiment"] == 50


def test_summariser_calls_are_spread_over_tasks(spark):
    from titleflow.plans import seam

    prompts = spark.range(40).selectExpr("concat('m', id) AS movie_id", "id AS review_count", "'t' AS title", "'p' AS prompt").coalesce(1)

    def where(prompt):
        from pyspark import TaskContext

        return str(TaskContext.get().partitionId())

    replies = [r.reply for r in seam.call_summariser(prompts, where).collect()]
    assert len(replies) == 40 and len(set(replies)) > 2
