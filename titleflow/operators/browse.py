"""Browse, search, sort and page over the movie table, and the documents of a page."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titleflow.functions import dates, movies as m, scores, text
from titleflow.functions.dates import Moment
from titleflow.operators import deep_pages, joins
from titleflow.session import rows_up_to

# fixed values: sortable columns and page sizes
SORT_COLUMNS = ("popularity", "release_date", "imdb_score", "rotten_tomatoes", "last_updated")
DEFAULT_SORT = "last_updated"
SENTIMENT_SORT = "overall_sentiment"
DEFAULT_LIMIT, MAX_LIMIT = 20, 100
SEARCH_LIMIT, MAX_SEARCH = 10, 50
UI_PAGE = 24
# ids that one call for summaries looks at
MAX_SUMMARY_IDS = 100


@dataclass
class Page:
    """A page of documents and the number of matches it was cut from."""

    total: DataFrame
    results: DataFrame
    limit: int
    offset: int


def sort_column(sort: str | None, sentiment: bool = False) -> str:
    """An allowed sort column; anything else sorts by the time of the last update."""
    if sentiment and sort == SENTIMENT_SORT:
        return SENTIMENT_SORT
    return sort if sort in SORT_COLUMNS else DEFAULT_SORT


def sort_order(sort: str, order: str | None) -> list[Column]:
    """NULLs count as lowest, which is Spark's default; ties go by id."""
    column = F.col(sort)
    return [column.asc() if (order or "desc").lower() == "asc" else column.desc(), F.col("id")]


def page_bounds(limit: int | None, offset: int | None) -> tuple[int, int]:
    return min(max(limit or DEFAULT_LIMIT, 1), MAX_LIMIT), max(offset or 0, 0)


def search_bound(limit: int | None) -> int:
    return SEARCH_LIMIT if limit is None or limit <= 0 else min(limit, MAX_SEARCH)


def page_count(total: Column, size: int = UI_PAGE) -> Column:
    return F.greatest(F.ceil(total / F.lit(size)), F.lit(1)).cast("bigint")


def matching(
    movies: DataFrame, genres: DataFrame, genre: str | None, sort: str, now: Moment
) -> DataFrame:
    """Movies under the active filters. A sort by release date leaves out what is not out yet."""
    found = joins.titles_of_genre(movies, genres, genre)
    if sort == "release_date":
        found = found.filter(dates.released_before(F.col("release_date"), now))
    return found


def sorted_page(matches: DataFrame, sort: str, order: str | None, limit: int, offset: int) -> DataFrame:
    """One page in order, as a top-k: no full sort."""
    return matches.orderBy(*sort_order(sort, order)).offset(offset).limit(limit)


def page_keys(
    matches: DataFrame, sort: str, order: str | None, limit: int, offset: int, deep: int = deep_pages.FEW
) -> DataFrame:
    """Ids of one page: the top-k reads and keeps nothing but ids and the sort column.

    A page more than ``deep`` rows behind the start is first narrowed down to a range of the sort column; the ids are the same.
    """
    rows = matches.select("id", sort)
    if offset + limit > deep:
        rows, offset = deep_pages.narrowed(rows, sort, (order or "desc").lower() == "asc", offset, limit, deep)
    return sorted_page(rows, sort, order, limit, offset).select("id")


def ids_of_page(keys: DataFrame) -> list[str]:
    """The ids of a page; it has at most :data:`MAX_LIMIT`."""
    rows = rows_up_to(keys, MAX_LIMIT)
    if rows is None:
        raise ValueError(f"a page has at most {MAX_LIMIT} movies")
    return [row["id"] for row in rows]


def titles_like(movies: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """Ids of movies whose title contains the query, most recently updated first."""
    query = query.strip()
    if not query:
        raise ValueError("query parameter is required")
    return (
        movies.filter(text.contains_like(F.col("title"), query)).select("id", "last_updated")
        .orderBy(F.col("last_updated").desc(), "id")
        .limit(search_bound(limit)).select("id")
    )


def documents(
    page: DataFrame, genres: DataFrame,
    summaries: DataFrame | None, points: DataFrame | None, themes: DataFrame | None,
) -> DataFrame:
    """Full documents of a page of at most :data:`MAX_LIMIT` movies.

    The page is cut first and once; the child tables are then read with its ids as a
    filter on the scan, so nothing but the page's own children is grouped or joined.
    """
    ids = ids_of_page(page.select("id"))

    def of_page(rows: DataFrame | None, key: str = "movie_id") -> DataFrame | None:
        return None if rows is None else rows.filter(F.col(key).isin(ids))

    return documents_with(of_page(page, "id"), *map(of_page, (genres, summaries, points, themes)))


def documents_with(
    page: DataFrame, genres: DataFrame,
    summaries: DataFrame | None, points: DataFrame | None, themes: DataFrame | None,
) -> DataFrame:
    """Documents of movies and of their own child rows."""
    found = None if summaries is None else joins.summaries_with_lists(summaries, points, themes)
    return documents_of(joins.with_summaries(joins.with_genres(page, genres), found))


def documents_of(movies: DataFrame) -> DataFrame:
    """Movie documents: blank optional fields missing, scores as texts."""
    columns = [
        "id", "tmdb_id", "title",
        dates.rfc3339(F.col("release_date")).alias("release_date"),
        "review_count_analyzed",
        dates.rfc3339(F.col("last_updated")).alias("last_updated"),
        F.struct(
            scores.score_text(F.col("imdb_score")).alias("imdb"),
            scores.percent_text(F.col("rotten_tomatoes")).alias("rotten_tomatoes"),
        ).alias("scores"),
        *[text.blank_to_null(F.col(c)).alias(c) for c in ("imdb_id", "poster_url", "overview")],
        "popularity",
        F.when(F.size("genres") > 0, F.col("genres")).alias("genres"),
        "summary",
    ]
    return movies.select(*columns)


def summary_documents(summary_lists: DataFrame) -> DataFrame:
    """Summary documents as stored: blank texts and empty lists missing."""
    def filled(column: str) -> Column:
        return F.when(F.size(column) > 0, F.col(column)).alias(column)

    return summary_lists.select(
        "movie_id",
        F.col("overall_sentiment").cast("int").alias("overall_sentiment"),
        text.blank_to_null(F.col("audience_consensus")).alias("audience_consensus"),
        text.blank_to_null(F.col("recommendation")).alias("recommendation"),
        filled("pros"), filled("cons"), filled("themes"),
        F.coalesce("review_count", F.lit(0)).alias("review_count"),
        dates.rfc3339(F.col("last_updated")).alias("last_updated"),
    )


def requested_ids(
    ids: DataFrame, order: str = "pos", column: str = "movie_id", most: int | None = None
) -> DataFrame:
    """The ids asked for, without blank ones, each once; with ``most`` only the first so many are looked at."""
    asked = ids if most is None else ids.orderBy(order).limit(most)
    return asked.select(column).filter(text.trim_ws(F.col(column)) != "").distinct()


def cards(docs: DataFrame) -> DataFrame:
    """What a catalogue card shows of a document."""
    sentiment = F.col("summary.overall_sentiment")
    return docs.select(
        "id",
        "title",
        scores.sentiment_text(sentiment).alias("sentiment_text"),
        scores.sentiment_class(sentiment).alias("sentiment_class"),
        scores.sentiment_label(sentiment).alias("sentiment_label"),
        m.card_year(dates.parse_rfc3339(F.col("release_date"))).alias("release_year"),
        m.card_genres(F.col("genres")).alias("card_genres"),
        m.has_deep_summary(
            F.col("summary.audience_consensus"), F.col("summary.pros"), F.col("summary.cons")
        ).alias("has_deep_summary"),
    )
