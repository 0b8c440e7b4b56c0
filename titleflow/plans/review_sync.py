"""Review sync: discover, plan, enrich, prepare, summarise, save."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from titleflow.functions.dates import Moment
from titleflow.operators import candidates as c
from titleflow.operators import counts, joins, reviews
from titleflow.plans import seam
from titleflow.plans.state import plan_stored
from titleflow.session import written
from titleflow.sinks.store import TableStore
from titleflow.sources.registry import Sources


@dataclass
class Inputs:
    """What a run reads besides the stored tables.

    ``titles`` is the candidate feed, ``reviews`` the review sources, of which a run reads its own titles only, or the union
    of what they hold with its ``source_rank``.
    ``details`` and ``ratings`` may be None: titles then stay as they come.
    """

    titles: DataFrame
    reviews: Sources | DataFrame
    details: DataFrame | None = None
    ratings: DataFrame | None = None
    summarise: seam.Summarise | None = None


@dataclass
class Settings:
    min_popularity: float = c.MIN_POPULARITY
    months: int = c.RECENT_MONTHS
    min_words: int = reviews.MIN_WORDS
    max_reviews: int = reviews.MAX_REVIEWS
    # titles that a run looks at, at most; a run that is to work on more titles needs more
    max_pool: int = c.POOL_MOST
    # summariser calls at the same time
    parallel_calls: int = seam.PARALLEL_CALLS


@dataclass
class Outcome:
    """Counters in one row, the error messages per title, and warnings of the run."""

    counters: DataFrame
    errors: DataFrame
    warnings: list[str]


ERRORS = "id string, error string"


def discover(inputs: Inputs, now: Moment, limit: int, settings: Settings) -> DataFrame:
    """The ranked candidate pool, with details.

    The pool is a top-k of at most ``settings.max_pool`` rows, so it is numbered as it arrives.
    """
    feed = c.popular_recent(inputs.titles, now, settings.min_popularity, settings.months)
    top = c.candidate_pool(feed, limit, settings.max_pool)
    rows = [(*row, rank) for rank, row in enumerate(top.collect())]
    schema = T.StructType([*top.schema.fields, T.StructField("rank", T.IntegerType())])
    pool = top.sparkSession.createDataFrame(rows, schema)
    if inputs.details is not None:
        pool = joins.with_details(pool, inputs.details, few=True)
    return pool


def _as_candidates(movies: DataFrame, genres: DataFrame) -> DataFrame:
    """A stored title as a candidate: it carries no popularity and no scores."""
    return joins.with_genres(movies, genres).select(
        "id", "tmdb_id", "imdb_id", "title", "release_date", "poster_url", "overview",
        F.lit(0.0).alias("popularity"), "genres",
    )


def _work_columns(frame: DataFrame) -> DataFrame:
    empty = F.array().cast("array<string>")
    return frame.select(
        "id", "tmdb_id",
        (F.col("imdb_id") if "imdb_id" in frame.columns else F.lit(None).cast("string")).alias("imdb_id"),
        "title", "release_date", "poster_url", "overview",
        F.coalesce("popularity", F.lit(0.0)).alias("popularity"),
        (F.coalesce("genres", empty) if "genres" in frame.columns else empty).alias("genres"),
        "action",
    )


def process(
    store: TableStore, work: DataFrame, inputs: Inputs, now: Moment, settings: Settings,
    warnings: list[str],
) -> tuple[DataFrame, Observation]:
    """Work on planned titles and save them; returns ``(id, title, error)`` per title, and how many went well and did not.

    A title whose summariser call fails is not saved at all. One that has neither reviews
    nor an overview gets an empty summary and comes up again in the next run. Where the
    summaries cannot be written, that is a warning and the titles are saved all the same.
    The work comes out of the candidate pool, so it is never more than that.
    """
    if inputs.ratings is not None:
        work = joins.with_ratings(work, inputs.ratings, few=True)
    else:
        work = work.withColumns({
            "imdb_score": F.lit(None).cast("double"), "rotten_tomatoes": F.lit(None).cast("int"),
        })
    work = written(work, "review-work")

    full = work.filter(F.col("action") == c.FULL).withColumnRenamed("id", "movie_id")
    if isinstance(inputs.reviews, Sources):
        asked, failed = inputs.reviews.collect(store.spark, full)
        warnings += [f"Failed to fetch from {row.source}: {row.error}" for row in failed.collect()]
    else:
        asked = inputs.reviews.join(full.select("movie_id"), "movie_id", "left_semi")
    prepared = reviews.prepare_reviews(asked, settings.min_words, settings.max_reviews)
    prompts = reviews.prompt_texts(full, prepared).join(
        full.select("movie_id", "title", "overview"), "movie_id"
    )
    speaks = (F.col("review_count") > 0) | (F.coalesce("overview", F.lit("")) != "")
    prompts = written(prompts.withColumn("asks", speaks), "prompts")

    empty = F.array().cast("array<string>")
    silent = prompts if inputs.summarise is None else prompts.filter(~F.col("asks"))
    summaries = silent.select(
        "movie_id", "review_count",
        F.lit(None).cast("int").alias("overall_sentiment"),
        F.lit("").alias("audience_consensus"), F.lit("").alias("recommendation"),
        empty.alias("pros"), empty.alias("cons"), empty.alias("themes"),
        F.lit(None).cast("string").alias("error"),
    )
    if inputs.summarise is not None:
        replies = seam.call_summariser(prompts.filter("asks"), inputs.summarise, settings.parallel_calls)
        summaries = summaries.unionByName(seam.summaries_of(replies))

    outcomes = work.join(
        summaries.select(F.col("movie_id").alias("id"), "error"), "id", "left"
    )
    outcomes, seen = counts.observed_outcomes(outcomes)
    outcomes = written(outcomes, "outcomes")
    try:
        store.save_summaries(summaries.filter(F.col("error").isNull()).drop("error"), now)
    except (PySparkException, OSError) as error:
        warnings.append(f"Failed to save summaries: {error}")
    store.save_movies(outcomes.filter(F.col("error").isNull()), now)
    return outcomes.select("id", "title", "error"), seen


def _failures(outcomes: DataFrame) -> DataFrame:
    return outcomes.filter(F.col("error").isNotNull()).select("id", "error")


def review_sync(
    store: TableStore, inputs: Inputs, now: Moment, limit: int, settings: Settings = Settings()
) -> Outcome:
    """Work on the next ``limit`` titles of the pool that need it."""
    warnings: list[str] = []
    planned = written(plan_stored(store, discover(inputs, now, limit, settings), now), "plan")
    batch = c.fill_batch(planned, limit)
    outcomes, seen = process(store, _work_columns(batch.work), inputs, now, settings, warnings)
    first = batch.counts.first()
    return Outcome(counts.counters_row(store.spark, first.discovered, first.skipped, seen), _failures(outcomes), warnings)


def targeted_sync(
    store: TableStore, inputs: Inputs, now: Moment, target: str, limit: int,
    settings: Settings = Settings(),
) -> Outcome:
    """Work on one stored title first, whatever its state, then fill the batch.

    An unknown target is one error; the other slots are filled all the same.
    """
    spark, warnings = store.spark, []
    asked = spark.createDataFrame([(target,)], "id string")
    stored = store.rows_of("movies", asked, "id")
    known = not stored.isEmpty()
    errors = spark.createDataFrame([], ERRORS)
    discovered = skipped = 0
    seen: list[Observation] = []
    outcomes = spark.createDataFrame([], "id string, title string, error string")
    if known:
        genres = store.rows_of("movie_genres", asked, "id")
        forced = _as_candidates(stored, genres).withColumn("action", F.lit(c.FULL))
        outcomes, done = process(store, _work_columns(forced), inputs, now, settings, warnings)
        seen.append(done)
    else:
        message = f"Target movie '{target}' not found in catalog"
        errors = spark.createDataFrame([(target, message)], ERRORS)
    if limit - 1 > 0:
        pool = discover(inputs, now, limit - 1, settings)
        planned = written(plan_stored(store, pool, now), "plan")
        others = planned.filter(F.col("id") != target)
        batch = c.fill_batch(others, limit - 1 if known else limit)
        filled, done = process(store, _work_columns(batch.work), inputs, now, settings, warnings)
        seen.append(done)
        outcomes = outcomes.unionByName(filled)
        discovered, skipped = planned.count(), batch.counts.first().skipped
    return Outcome(
        counts.counters_row(spark, discovered, skipped, *seen), errors.unionByName(_failures(outcomes)), warnings
    )
