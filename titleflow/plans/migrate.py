"""Moves summaries out of wide title rows into the summary tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from titleflow.functions.dates import Moment, moment
from titleflow.operators import lists
from titleflow.session import written
from titleflow.sinks import merge
from titleflow.sinks.store import TableStore
from titleflow.sources.stored import legacy_summaries


@dataclass
class Migrated:
    summaries: DataFrame
    points: DataFrame
    themes: DataFrame


def migrated_rows(
    wide_movies: DataFrame, points: DataFrame, themes: DataFrame, now: Moment
) -> Migrated:
    """Summary, point and theme rows of the titles that have a summary.

    Children are moved row by row with a semi-join, never gathered per title; blank
    ones and points of another type are dropped.
    """
    kept = legacy_summaries(wide_movies)
    typed = points.filter(F.col("type").isin("pro", "con"))
    return Migrated(
        merge.summary_rows(kept, now),
        lists.nonblank(typed, "content").join(kept, "movie_id", "left_semi"),
        lists.nonblank(themes, "theme").join(kept, "movie_id", "left_semi"),
    )


def migrate_summaries(
    store: TableStore, wide_movies: DataFrame, points: DataFrame, themes: DataFrame, now: Moment
) -> DataFrame:
    """Writes the migrated rows; returns ``(migrated, errors)``."""
    rows = migrated_rows(wide_movies, points, themes, now)
    seen = Observation()
    summaries = written(rows.summaries.observe(seen, F.count(F.lit(1)).alias("moved")), "migrated")
    touched = store.touched(summaries, "movie_id")
    store.replace_children("movie_points", summaries, rows.points, touched)
    store.replace_children("movie_themes", summaries, rows.themes, touched)
    store.upsert("movie_summaries", summaries, touched=touched)
    # of the table only the buckets that were written are read
    arrived = store.rows_of("movie_summaries", summaries, "movie_id", touched).filter(F.col("last_updated") == moment(now)).count()
    return store.spark.createDataFrame([(arrived, seen.get["moved"] - arrived)], "migrated bigint, errors bigint")
