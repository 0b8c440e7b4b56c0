"""Which titles to look at: filters on the catalogue feed, pools, actions, batch fill."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titleflow.functions import dates
from titleflow.functions.dates import Moment

# fixed values
MIN_POPULARITY = 20.0
RECENT_MONTHS = 6
DEFAULT_FEED_ORDER = "popularity.desc"
POOL_DEFAULT_LIMIT, POOL_FACTOR, POOL_LEAST, POOL_MOST = 10, 5, 40, 100

SKIP, METADATA_ONLY, FULL = "skip", "metadata_only", "full"


def popular_recent(
    titles: DataFrame, now: Moment,
    min_popularity: float = MIN_POPULARITY, months: int = RECENT_MONTHS,
) -> DataFrame:
    """Popular titles of the last months; both bounds reach the scan."""
    since = dates.months_before(now, months).cast("timestamp")
    return titles.filter(
        (F.col("popularity") >= round(min_popularity, 2)) & (F.col("release_date") >= since)
    )


def of_year(titles: DataFrame, year: int = 0) -> DataFrame:
    """Titles released in ``year``, or all of them for 0.

    A range on the column, so row groups of other years are skipped.
    """
    if year <= 0:
        return titles
    day = F.col("release_date")
    return titles.filter(
        (day >= F.lit(f"{year:04d}-01-01").cast("timestamp"))
        & (day < F.lit(f"{year + 1:04d}-01-01").cast("timestamp"))
    )


def feed_order(sort_by: str | None) -> list[Column]:
    """``column.desc`` or ``column.asc`` as sort columns; ties go by id."""
    column, _, direction = (sort_by or DEFAULT_FEED_ORDER).partition(".")
    return [F.col(column).asc() if direction == "asc" else F.col(column).desc(), F.col("id")]


def pool_size(limit: int, most: int | None = POOL_MOST) -> int:
    """Several times ``limit``, ``most`` at most; None has no bound."""
    limit = limit if limit > 0 else POOL_DEFAULT_LIMIT
    wanted = max(limit * POOL_FACTOR, POOL_LEAST)
    return wanted if most is None else min(wanted, most)


def candidate_pool(titles: DataFrame, limit: int, most: int | None = POOL_MOST) -> DataFrame:
    """The most popular titles, several times the number that will be worked on."""
    return titles.orderBy(*feed_order(DEFAULT_FEED_ORDER)).limit(pool_size(limit, most))


def candidate_state(
    candidates: DataFrame, movies: DataFrame, summary_state: DataFrame, now: Moment
) -> DataFrame:
    """Adds ``known``, ``fresh`` (stored less than a day ago) and ``has_summary``."""
    stored = movies.select("id", F.col("last_updated").alias("__stored")).withColumn(
        "known", F.lit(True)
    )
    says = summary_state.withColumnRenamed("movie_id", "id")
    fresh = dates.younger_than(F.col("__stored"), now, dates.FRESH_HOURS)
    return (
        candidates.join(stored, "id", "left")
        .join(says, "id", "left")
        .withColumns({
            "known": F.coalesce("known", F.lit(False)),
            "fresh": fresh,
            "has_summary": F.coalesce("has_summary", F.lit(False)),
        })
        .drop("__stored")
    )


def plan_actions(
    candidates: DataFrame, movies: DataFrame, summary_state: DataFrame, now: Moment,
    forced: bool = False,
) -> DataFrame:
    """Adds ``action``: ``skip``, ``metadata_only`` or ``full``."""
    state = candidate_state(candidates, movies, summary_state, now)
    if forced:
        return state.withColumn("action", F.lit(FULL))
    return state.withColumn(
        "action",
        F.when(F.col("fresh") & F.col("has_summary"), SKIP)
        .when(F.col("has_summary"), METADATA_ONLY)
        .otherwise(FULL),
    )


@dataclass
class Batch:
    """Titles to work on, and ``(discovered, skipped)`` in one row."""

    work: DataFrame
    counts: DataFrame


def fill_batch(planned: DataFrame, limit: int, rank: str = "rank") -> Batch:
    """Walk candidates in rank order; skips are free; stop once ``limit`` are found.

    Skips behind the stop were never looked at and do not count.
    """
    todo = planned.filter(F.col("action") != SKIP)
    skipped = F.col("action") == SKIP
    work = todo
    if limit > 0:
        work = todo.orderBy(rank).limit(limit)
        found = work.agg(F.count(F.lit(1)).alias("n"), F.max(rank).alias("last"))
        stop = found.select(F.when(F.col("n") >= limit, F.col("last")).alias("stop")).scalar()
        skipped = skipped & (F.col(rank) < F.coalesce(stop, F.lit(2**62)))
    counts = planned.agg(
        F.count(F.lit(1)).alias("discovered"), F.count_if(skipped).alias("skipped")
    )
    return Batch(work, counts)
