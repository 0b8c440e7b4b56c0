"""The driver's tables in the roles of the engine's tables.

Expressions are written so that Spark SQL and DuckDB read them alike; every binding
gives a DataFrame for the engine and a common table expression for the check.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from titleflow import schemas
from titleflow.session import configure

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query, and the SQL that checks it where there is one."""

    def register(function: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(configure(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql.strip()
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass(frozen=True)
class Binding:
    name: str
    source: str
    columns: dict[str, str]
    schema: T.StructType
    distinct: bool = False

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, self.source).select(*[
            F.expr(expression).cast(self.schema[column].dataType).alias(column)
            for column, expression in self.columns.items()
        ])
        return rows.distinct() if self.distinct else rows

    @property
    def cte(self) -> str:
        columns = ", ".join(f"{e} AS {c}" for c, e in self.columns.items())
        return f"{self.name} AS (SELECT {'DISTINCT ' if self.distinct else ''}{columns} FROM {self.source})"


def ctes(*bindings: Binding) -> str:
    return "WITH " + ",\n".join(b.cte for b in bindings)


MOVIES = Binding("movies", "orders", {
    "id": "'tmdb_' || o_orderkey",
    "tmdb_id": "o_orderkey",
    "imdb_id": "CASE WHEN o_custkey % 5 = 0 THEN '' ELSE 'tt' || o_orderkey END",
    "title": "o_orderpriority || ' ' || o_custkey",
    "release_date": "CASE WHEN o_custkey % 17 = 0 THEN NULL ELSE o_orderdate END",
    "poster_url": "CASE WHEN o_custkey % 3 = 0 THEN '' ELSE 'https://image.tmdb.org/t/p/w500/' || o_orderkey END",
    "overview": "CASE WHEN o_custkey % 4 = 0 THEN '' ELSE 'Placed by ' || o_custkey END",
    "popularity": "o_totalprice",
    "imdb_score": "CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(o_custkey % 101 AS DOUBLE) / CAST(10 AS DOUBLE) END",
    "rotten_tomatoes": "CASE WHEN o_orderstatus = 'F' THEN NULL ELSE CAST(o_custkey % 101 AS INT) END",
    "last_updated": "o_orderdate + INTERVAL '1' HOUR * CAST(o_custkey % 24 AS INT)",
}, schemas.MOVIES)

GENRES = Binding("movie_genres", "lineitem", {
    "movie_id": "'tmdb_' || l_orderkey", "genre": "l_returnflag",
}, schemas.MOVIE_GENRES, distinct=True)

POINTS = Binding("movie_points", "lineitem", {
    "movie_id": "'tmdb_' || l_orderkey",
    "type": "CASE WHEN l_returnflag = 'N' THEN 'note' WHEN l_linestatus = 'O' THEN 'pro' ELSE 'con' END",
    "ordinal": "l_linenumber",
    "content": "'Part ' || l_partkey",
}, schemas.MOVIE_POINTS)

THEMES = Binding("movie_themes", "lineitem", {
    "movie_id": "'tmdb_' || l_orderkey",
    "ordinal": "l_linenumber",
    "theme": "'Supplier ' || l_suppkey",
}, schemas.MOVIE_THEMES)

SUMMARIES = Binding("movie_summaries", "labels", {
    "movie_id": "'tmdb_' || doc_id",
    "overall_sentiment": "CASE WHEN toxic = 1 THEN NULL ELSE quality * 100 END",
    "audience_consensus": "CASE WHEN quality = 1 AND doc_id % 3 = 0 THEN 'Liked' ELSE '' END",
    "recommendation": "CASE WHEN doc_id % 5 = 0 THEN 'Watch' WHEN doc_id % 5 = 1 THEN '' ELSE NULL END",
    "review_count": "CAST(doc_id % 31 AS INT)",
    "last_updated": "TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' MINUTE * CAST(doc_id AS INT)",
}, schemas.MOVIE_SUMMARIES)

REQUESTS = Binding("requests", "events", {
    "request_id": "event_id", "movie_id": "'tmdb_' || user_id", "requested_at": "ts",
}, T.StructType([
    T.StructField("request_id", T.LongType()),
    T.StructField("movie_id", T.StringType()),
    T.StructField("requested_at", T.TimestampType()),
]))

# documents as reviews: the language stands for the title
REVIEWS = Binding("reviews", "documents", {
    "movie_id": "lang", "id": "CAST(doc_id AS STRING)", "source": "source",
    "author": "CAST(NULL AS STRING)", "content": "text", "score": "CAST(n_chars AS INT)",
    "url": "CAST(NULL AS STRING)", "created_at": "CAST(NULL AS TIMESTAMP)", "ordinal": "doc_id",
}, schemas.REVIEWS)

# turns of a conversation as reviews of one title
TURNS = Binding("turns", "conversations", {
    "movie_id": "'tmdb_' || conv_id", "id": "conv_id || '_' || turn", "source": "role",
    "author": "CAST(NULL AS STRING)", "content": "text",
    "score": "CAST(turn * 7 % 5 AS INT)", "url": "CAST(NULL AS STRING)",
    "created_at": "CAST(NULL AS TIMESTAMP)", "ordinal": "turn",
}, schemas.REVIEWS)

# documents as catalogue candidates, labels as what is stored of them
DOC_TITLES = Binding("titles", "documents", {
    "id": "'tmdb_' || doc_id", "tmdb_id": "doc_id", "title": "lang || ' ' || source",
    "release_date": "TIMESTAMP '2023-09-01 00:00:00' + INTERVAL '1' DAY * CAST(doc_id % 200 AS INT)",
    "overview": "CASE WHEN doc_id % 2 = 0 THEN '' ELSE source END",
    "popularity": "CAST(n_chars AS DOUBLE)", "poster_url": "CAST(NULL AS STRING)",
}, schemas.CANDIDATES)

STORED_EVENTS = Binding("stored_events", "events", {
    "event_id": "event_id", "last_updated": "ts",
}, T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("last_updated", T.TimestampType()),
]))

NOW = dt.datetime(1998, 8, 1, 12, 0)
NOW_SQL = "TIMESTAMP '1998-08-01 12:00:00'"
EVENTS_NOW = dt.datetime(2024, 1, 3)
EVENTS_NOW_SQL = "TIMESTAMP '2024-01-03 00:00:00'"

STORED_MOVIES_CTE = (
    "stored AS (SELECT 'tmdb_' || l.doc_id AS id, e.ts AS last_updated "
    "FROM labels l JOIN events e ON e.event_id = l.doc_id)"
)


def stored_movies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as stored movies, updated when the event of the same number came."""
    events = STORED_EVENTS.frame(spark, sf_dir)
    labels = table(spark, sf_dir, "labels")
    return labels.join(events, labels.doc_id == events.event_id).select(
        F.expr("'tmdb_' || doc_id").alias("id"), "last_updated"
    )


def all_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {b.name: b.frame(spark, sf_dir) for b in (MOVIES, GENRES, SUMMARIES, POINTS, THEMES)}


# Unicode White_Space, for RE2
WS = (r"[\t\n\v\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")


def sql_trim(text: str) -> str:
    return f"regexp_replace({text}, '^{WS}+|{WS}+$', '', 'g')"


def sql_clean(text: str) -> str:
    lines = f"string_split(regexp_replace({text}, 'https?://[^\\t\\n\\f\\r ]+', '', 'g'), chr(10))"
    trimmed = f"list_transform({lines}, lambda line: {sql_trim('line')})"
    return f"array_to_string(list_filter({trimmed}, lambda line: line <> ''), chr(10))"


def sql_words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{WS}+'), lambda w: w <> '')"


def sql_key(text: str) -> str:
    return f"array_to_string({sql_words(f'lower({text})')}[1:15], ' ')"


def sql_strip_tags(text: str) -> str:
    return sql_trim(f"regexp_replace({text}, '<[^>]*>?|>', '', 'g')")


def sql_time(stamp: str) -> str:
    return f"strftime({stamp}, '%Y-%m-%dT%H:%M:%SZ')"


def sql_score(score: str) -> str:
    return f"regexp_replace(CAST({score} AS VARCHAR), '\\.0$', '')"


def joined(column: str):
    """An array column as one text, the same way as ``list`` in the check SQL."""
    return F.array_join(column, " | ")


def sql_joined(values: str) -> str:
    return f"coalesce(array_to_string({values}, ' | '), '')"
