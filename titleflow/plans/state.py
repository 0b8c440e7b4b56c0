"""Actions of candidates, judged by what is stored of them."""

from __future__ import annotations

from pyspark.sql import DataFrame

from titleflow.functions.dates import Moment
from titleflow.operators import candidates, joins
from titleflow.sinks.store import TableStore


def plan_stored(store: TableStore, titles: DataFrame, now: Moment) -> DataFrame:
    """``titles`` with their actions; of the tables only the titles' buckets and rows are read."""

    touched = store.touched(titles, "id")

    def of(table: str) -> DataFrame:
        return store.rows_of(table, titles, "id", touched)

    state = joins.summary_state(of("movie_summaries"), of("movie_points"), of("movie_themes"))
    return candidates.plan_actions(titles, of("movies"), state, now)
