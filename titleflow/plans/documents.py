"""Browse, search and document views over the stored tables.

``tables`` is a store, of which reads of a page or of asked titles open no buckets but theirs, or frames by table name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titleflow.functions.dates import Moment
from titleflow.operators import browse as b
from titleflow.operators import joins, lists
from titleflow.sinks.store import TableStore


Tables = TableStore | dict[str, DataFrame]
CHILDREN = ("movie_genres", "movie_summaries", "movie_points", "movie_themes")


def browse(
    tables: Tables, now: Moment, genre: str | None = None, sort: str | None = None,
    order: str | None = None, limit: int | None = None, offset: int | None = None,
    sentiment_sort: bool = True,
) -> b.Page:
    """One page of movie documents with the number of matches.

    ``sentiment_sort`` allows ``overall_sentiment`` as a sort; switched off it sorts like
    any unknown column.
    """
    column = b.sort_column(sort, sentiment_sort)
    limit, offset = b.page_bounds(limit, offset)
    matches = b.matching(_whole(tables, "movies"), _whole(tables, "movie_genres"), genre, column, now)
    total = matches.agg(F.count(F.lit(1)).alias("total"))
    sortable = matches
    if column == b.SENTIMENT_SORT:
        scored = _whole(tables, "movie_summaries").select(F.col("movie_id").alias("id"), column)
        sortable = matches.select("id").join(scored, "id", "left")
    keys = b.page_keys(sortable, column, order, limit, offset)
    return b.Page(total, _documents(tables, keys), limit, offset)


def search(tables: Tables, query: str, limit: int | None = None) -> DataFrame:
    return _documents(tables, b.titles_like(_whole(tables, "movies"), query, limit))


def documents(tables: Tables, ids: DataFrame) -> DataFrame:
    """Documents of the asked ids (``movie_id``), as many as are asked for; unknown ids are absent."""
    return export(_of(tables, b.requested_ids(ids)))


def summaries(
    tables: Tables, ids: DataFrame, most: int | None = b.MAX_SUMMARY_IDS
) -> DataFrame:
    """Summary documents of the asked ids (``movie_id``, ``pos``); unknown ids are absent.

    A batch looks at the first ``most`` ids; None looks at all.
    """
    return export_summaries(_of(tables, b.requested_ids(ids, most=most)))


def export(tables: dict[str, DataFrame]) -> DataFrame:
    """Documents of all movies, one row each; without a summary table none has a summary."""
    found = None
    if tables.get("movie_summaries") is not None:
        found = joins.summaries_with_lists(
            tables["movie_summaries"], tables["movie_points"], tables["movie_themes"])
    movies = joins.with_genres(tables["movies"], tables["movie_genres"])
    return b.documents_of(joins.with_summaries(movies, found))


def export_summaries(tables: dict[str, DataFrame]) -> DataFrame:
    """Summary documents of all summaries, one row each."""
    return b.summary_documents(joins.summaries_with_lists(
        tables["movie_summaries"], tables["movie_points"], tables["movie_themes"]))


def export_entries(tables: dict[str, DataFrame]) -> DataFrame:
    """Points and themes as rows ``(movie_id, type, position, content)``, for lists too long for a document."""
    return lists.entries(tables["movie_points"], tables["movie_themes"]).withColumnRenamed("ordinal", "position")


def _whole(tables: Tables, name: str) -> DataFrame:
    return tables.read(name) if isinstance(tables, TableStore) else tables[name]


def _of(tables: Tables, ids: DataFrame) -> dict[str, DataFrame]:
    """The rows of the asked titles in every table."""
    if isinstance(tables, TableStore):
        touched = tables.touched(ids, "movie_id")
        return {name: tables.rows_of(name, ids, "movie_id", touched) for name in ("movies", *CHILDREN)}

    def kept(name: str, frame: DataFrame) -> DataFrame:
        key = "id" if name == "movies" else "movie_id"
        return frame.join(ids.select(F.col("movie_id").alias(key)), key, "left_semi")

    return {name: kept(name, frame) for name, frame in tables.items() if frame is not None}


def _documents(tables: Tables, keys: DataFrame) -> DataFrame:
    """Documents of a page. Its ids come to the driver once; every table is then read by them."""
    ids = b.ids_of_page(keys)

    def named(name: str) -> DataFrame | None:
        if isinstance(tables, TableStore):
            return tables.rows_by_id(name, ids)
        key = "id" if name == "movies" else "movie_id"
        return None if tables.get(name) is None else tables[name].filter(F.col(key).isin(ids))

    return b.documents_with(named("movies"), *map(named, CHILDREN))
