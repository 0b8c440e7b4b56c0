"""Review requests: who may queue a title again, and the request table afterwards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titleflow.operators import gate
from titleflow.session import written
from titleflow.sinks.store import TableStore


def gate_requests(store: TableStore, requests: DataFrame) -> DataFrame:
    """Decide every request against catalogue and cooldown, and record the accepted ones.

    Of both tables only the buckets of the asked titles are read.
    """
    touched = store.touched(requests, "movie_id")
    movies, stored = (store.rows_of(table, requests, "movie_id", touched) for table in ("movies", "review_requests"))
    decisions = written(gate.gate_requests(requests, movies, stored), "decisions")
    store.save_requests(
        decisions.filter(F.col("status") == gate.QUEUED).select("movie_id", "requested_at")
    )
    return decisions
