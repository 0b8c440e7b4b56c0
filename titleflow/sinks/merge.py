"""Keyed merges as frames: what a table holds after a write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titleflow.functions import dates
from titleflow.functions.dates import Moment


def last_wins(batch: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key in batch order.

    One row per key and task crosses the exchange, so a key that is repeated without
    end stays cheap.
    """
    latest = Window.partitionBy(key).orderBy(F.col(order).desc())
    return (
        batch.withColumn("__n", F.row_number().over(latest))
        .filter(F.col("__n") == 1)
        .drop("__n")
    )


def upsert(old: DataFrame, new: DataFrame, key: str, keep_non_null: bool = False) -> DataFrame:
    """``old`` with the rows of ``new``, which must be unique per key.

    A new row replaces the old one whole, NULLs included. With ``keep_non_null`` a NULL
    keeps the old value.
    """
    if not keep_non_null:
        return old.join(new.select(key), key, "left_anti").unionByName(new.select(*old.columns))
    pairs = old.alias("o").join(new.alias("n"), key, "full")
    return pairs.select(
        key,
        *[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in old.columns if c != key],
    ).select(*old.columns)


_MOVIE = [
    "id", "tmdb_id", "imdb_id", "title", "release_date", "poster_url", "overview", "popularity", "imdb_score", "rotten_tomatoes",
]


def movie_batch(batch: DataFrame, order: str | None = None) -> DataFrame:
    """What is stored of titles, with their place as ``__order``: blank and repeated genres dropped from each row's list."""
    named = F.array_distinct(F.filter("genres", lambda genre: genre != ""))
    return batch.select(*_MOVIE, named.alias("genres"), *([F.col(order).alias("__order")] if order is not None else []))


def movie_rows(batch: DataFrame, now: Moment) -> DataFrame:
    """Movie rows as stored: the write time is the last update."""
    return batch.select(*_MOVIE).withColumn("last_updated", dates.moment(now))


def genre_rows(batch: DataFrame, unique: bool = False) -> DataFrame:
    """Genre rows of titles: blank names dropped, each pair once. ``unique``: no id comes twice, so pairs do not meet
    across rows and are not shuffled."""
    genres = F.array_distinct("genres") if unique else F.col("genres")
    rows = (
        batch.select(F.col("id").alias("movie_id"), F.explode(genres).alias("genre"))
        .filter(F.col("genre") != "")
    )
    return rows if unique else rows.dropDuplicates(["movie_id", "genre"])


def replace_children(old: DataFrame, touched: DataFrame, new: DataFrame) -> DataFrame:
    """``old`` without any row of the touched parents, plus the new rows.

    ``touched`` holds the parents' ``movie_id``; a parent without new rows loses all.
    """
    kept = old.join(touched.select("movie_id"), "movie_id", "left_anti")
    return kept.unionByName(new.select(*old.columns))


def summary_rows(saved: DataFrame, now: Moment) -> DataFrame:
    return saved.select(
        "movie_id",
        F.col("overall_sentiment").cast("int").alias("overall_sentiment"),
        "audience_consensus",
        "recommendation",
        F.coalesce("review_count", F.lit(0)).cast("int").alias("review_count"),
    ).withColumn("last_updated", dates.moment(now))


def _entries(saved: DataFrame, array: str, value: str, *constants: Column) -> DataFrame:
    return saved.select(
        "movie_id", *constants, F.posexplode(array).alias("ordinal", value)
    ).filter(F.col(value) != "")


def point_rows(saved: DataFrame) -> DataFrame:
    """Point rows of saved summaries: blanks dropped, duplicates kept, pros before cons."""
    pros = _entries(saved, "pros", "content", F.lit("pro").alias("type"))
    first_con = F.coalesce(F.greatest(F.size("pros"), F.lit(0)), F.lit(0))
    cons = saved.select(
        "movie_id", F.lit("con").alias("type"), first_con.alias("__from"),
        F.posexplode("cons").alias("pos", "content"),
    ).filter(F.col("content") != "").select(
        "movie_id", "type", (F.col("__from") + F.col("pos")).alias("ordinal"), "content"
    )
    return pros.unionByName(cons).withColumn("ordinal", F.col("ordinal").cast("bigint"))


def theme_rows(saved: DataFrame) -> DataFrame:
    return _entries(saved, "themes", "theme").withColumn("ordinal", F.col("ordinal").cast("bigint"))


def latest_requests(requests: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """One row per title with its latest request; the write always replaces the stored one."""
    newest = requests.groupBy("movie_id").agg(F.max("requested_at").alias("requested_at"))
    return newest if stored is None else upsert(stored, newest, "movie_id")
