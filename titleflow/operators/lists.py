"""Child rows of a title as lists.

A title has one row, however many child rows it has and whatever their ordinals are. An array of a title is as long
as its list, as the document is that holds it; where lists may outgrow a document, take the child rows themselves
(:func:`entries`), which no title gathers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRO, CON, THEME = "pro", "con", "theme"


def genre_lists(genres: DataFrame) -> DataFrame:
    """Genres of each title in alphabetical order.

    Genres are distinct per title, so partial sets merge to a list that is as short as
    the dictionary of genres.
    """
    return genres.groupBy("movie_id").agg(F.sort_array(F.collect_set("genre")).alias("genres"))


def entries(points: DataFrame, themes: DataFrame) -> DataFrame:
    """Points and themes as one table ``(movie_id, type, ordinal, content)``; other types are left out."""
    shown = points.filter(F.col("type").isin(PRO, CON)).select("movie_id", "type", "ordinal", "content")
    return shown.unionByName(
        themes.select("movie_id", F.lit(THEME).alias("type"), "ordinal", F.col("theme").alias("content")))


def _ordered(value: str, condition: Column | None = None) -> Column:
    entry = F.struct("ordinal", F.col(value).alias("value"))
    entry = F.when(condition, entry) if condition is not None else entry
    return F.transform(F.sort_array(F.collect_list(entry)), lambda row: row["value"])


def point_lists(points: DataFrame) -> DataFrame:
    """``(movie_id, pros, cons)`` in ordinal order; other types are ignored."""
    return points.groupBy("movie_id").agg(
        _ordered("content", F.col("type") == PRO).alias("pros"),
        _ordered("content", F.col("type") == CON).alias("cons"),
    )


def theme_lists(themes: DataFrame) -> DataFrame:
    """``(movie_id, themes)`` in ordinal order."""
    return themes.groupBy("movie_id").agg(_ordered("theme").alias("themes"))


def entry_lists(points: DataFrame, themes: DataFrame) -> DataFrame:
    """``(movie_id, pros, cons, themes)`` from one aggregation over both child tables."""
    return entries(points, themes).groupBy("movie_id").agg(
        *(_ordered("content", F.col("type") == kind).alias(name) for kind, name in ((PRO, "pros"), (CON, "cons"), (THEME, "themes"))))


def nonblank(children: DataFrame, column: str) -> DataFrame:
    """Child rows whose ``column`` holds some text."""
    return children.filter(F.col(column) != "")
