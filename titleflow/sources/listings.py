"""Landed listing, dictionary and detail payloads as title rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from titleflow import schemas
from titleflow.functions import dates, movies

PAGE_SIZE = 20
MAX_LISTING_PAGES = 5


def read_payloads(
    spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False
) -> DataFrame:
    """JSON payloads, one per line, or one per file with ``multi_line``."""
    return parse_payloads(spark.read.text(path, wholetext=multi_line), schema)


def parse_payloads(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """Payloads of a ``value`` column.

    A payload that does not parse keeps its text in ``_corrupt_record``, whichever
    columns a query needs: the whole schema decides, not the columns read.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    parsed = F.from_json("value", schema, options)
    return lines.filter(F.trim("value") != "").select(parsed.alias("payload")).select("payload.*")


def well_formed(payloads: DataFrame) -> DataFrame:
    return payloads.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def malformed(payloads: DataFrame, source: str) -> DataFrame:
    """One error row per payload that did not parse."""
    return payloads.filter(F.col("_corrupt_record").isNotNull()).select(
        F.lit(source).alias("source"),
        F.concat(F.lit("malformed payload: "), "_corrupt_record").alias("error"),
    )


def read_listing(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return read_payloads(spark, path, schemas.LISTING_PAGE, multi_line)


def title_columns(item: Column) -> list[Column]:
    """Title columns of one listing entry."""
    return [
        movies.movie_id(item["id"]).alias("id"),
        item["id"].alias("tmdb_id"),
        item["title"].alias("title"),
        dates.parse_day(item["release_date"]).alias("release_date"),
        movies.poster_url(item["poster_path"]).alias("poster_url"),
        item["overview"].alias("overview"),
        F.coalesce(item["popularity"], F.lit(0.0)).alias("popularity"),
        item["genre_ids"].alias("genre_ids"),
    ]


def listing_titles(pages: DataFrame) -> DataFrame:
    """Title rows of listing pages, with the page and the position on it.

    Entries of one page stay in its task: no shuffle.
    """
    return (
        pages.select("year", "page", "total_pages", F.posexplode("results").alias("pos", "item"))
        .select("year", "page", "total_pages", "pos", *title_columns(F.col("item")))
    )


def now_playing(pages: DataFrame, limit: int = 20) -> DataFrame:
    """First ``limit`` titles of at most five pages, up to the first empty page."""
    limit = limit if limit > 0 else PAGE_SIZE
    last_page = min(MAX_LISTING_PAGES, -(-limit // PAGE_SIZE))
    wanted = pages.filter(F.col("page").between(1, last_page))
    empty = F.coalesce(F.size("results"), F.lit(0)) <= 0
    first_empty = wanted.filter(empty).agg(F.min("page").alias("page")).scalar()
    return (
        listing_titles(wanted.filter(F.col("page") < F.coalesce(first_empty, F.lit(last_page + 1))))
        .orderBy("page", "pos")
        .limit(limit)
    )


def search_results(pages: DataFrame, query: str, limit: int = 0) -> DataFrame:
    """Titles of the first result page; ``limit`` <= 0 keeps all of them."""
    if not query:
        raise ValueError("query string cannot be empty")
    titles = listing_titles(pages.filter(F.col("page") == 1))
    return titles.filter(F.col("pos") < limit) if limit > 0 else titles


def genre_dictionary(payloads: DataFrame) -> DataFrame:
    """``(genre_id, name)``; the later of two entries with one id wins."""
    return (
        payloads.select(F.posexplode("genres").alias("pos", "genre"))
        .groupBy(F.col("genre.id").alias("genre_id"))
        .agg(F.max_by("genre.name", "pos").alias("name"))
    )


def title_details(payloads: DataFrame) -> DataFrame:
    """``(tmdb_id, imdb_id, genres)`` with the genres in payload order."""
    return payloads.select(
        F.col("id").alias("tmdb_id"),
        "imdb_id",
        F.transform("genres", lambda g: g["name"]).alias("genres"),
    )
