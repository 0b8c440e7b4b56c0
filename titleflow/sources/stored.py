"""Rows that come back from storage untyped, and typed table reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from titleflow import schemas
from titleflow.functions import dates, movies

_NUMBER = r"\A(BIGINT|DOUBLE|FLOAT|DECIMAL\(.*\))\z"


def _text(row: Column, name: str) -> Column:
    value = row[name]
    return F.when(F.schema_of_variant(value) == "STRING", value.cast("string"))


def _number(row: Column, name: str) -> Column:
    value = row[name]
    return F.when(F.schema_of_variant(value).rlike(_NUMBER), F.try_variant_get(value, "$", "double"))


def _decoded(rows: DataFrame, column: str, names: list[str]) -> DataFrame:
    """``__row``: the named fields of stored JSON objects as variants; one parse, and one pass over what it gives."""
    fields = ", ".join(f"{name}: variant" for name in names)
    return rows.select(F.try_variant_get(F.try_parse_json(column), "$", f"struct<{fields}>").alias("__row"))


def _whole(row: Column, name: str, ddl: str = "int") -> Column:
    """A number cut to an integer."""
    value = _number(row, name)
    cut = F.when(value < 0, F.ceil(value)).otherwise(F.floor(value))
    return cut.try_cast(ddl)


def decode_movies(rows: DataFrame, column: str = "row") -> DataFrame:
    """Movie rows of stored JSON objects; a field of a wrong type is missing."""
    row = F.col("__row")
    return _decoded(rows, column, schemas.MOVIES.fieldNames()).select(
        _text(row, "id").alias("id"),
        _whole(row, "tmdb_id", "bigint").alias("tmdb_id"),
        _text(row, "imdb_id").alias("imdb_id"),
        _text(row, "title").alias("title"),
        dates.parse_stored_date(_text(row, "release_date")).alias("release_date"),
        _text(row, "poster_url").alias("poster_url"),
        _text(row, "overview").alias("overview"),
        _number(row, "popularity").alias("popularity"),
        _number(row, "imdb_score").alias("imdb_score"),
        _whole(row, "rotten_tomatoes").alias("rotten_tomatoes"),
        dates.parse_rfc3339(_text(row, "last_updated")).alias("last_updated"),
    )


def decode_summaries(rows: DataFrame, column: str = "row") -> DataFrame:
    row = F.col("__row")
    return _decoded(rows, column, schemas.MOVIE_SUMMARIES.fieldNames()).select(
        _text(row, "movie_id").alias("movie_id"),
        _whole(row, "overall_sentiment").alias("overall_sentiment"),
        _text(row, "audience_consensus").alias("audience_consensus"),
        _text(row, "recommendation").alias("recommendation"),
        F.coalesce(_whole(row, "review_count"), F.lit(0)).alias("review_count"),
        dates.parse_rfc3339(_text(row, "last_updated")).alias("last_updated"),
    )


def legacy_summaries(wide_movies: DataFrame) -> DataFrame:
    """Summary columns of wide title rows that have any of them set and an id."""
    return wide_movies.filter(
        movies.to_migrate(
            F.col("overall_sentiment"), F.col("audience_consensus"), F.col("recommendation")
        )
        & F.coalesce(F.col("id") != "", F.lit(False))
    ).select(
        F.col("id").alias("movie_id"),
        "overall_sentiment",
        "audience_consensus",
        "recommendation",
        F.coalesce("review_count", F.lit(0)).alias("review_count"),
    )


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A typed read of one of the six tables from plain Parquet."""
    return spark.read.schema(schemas.TABLES[table]).parquet(path)


def empty_table(spark: SparkSession, table: str) -> DataFrame:
    """Stands in for a table that cannot be reached."""
    return spark.createDataFrame([], schemas.TABLES[table])
