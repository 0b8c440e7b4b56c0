"""Joins between titles, their children, summaries and enrichments: all on ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titleflow.functions import movies as m
from titleflow.functions import scores
from titleflow.operators import lists
from titleflow.session import rows_up_to

SMALL_DICTIONARY = 1_000


def name_genres(titles: DataFrame, dictionary: DataFrame, small: int = SMALL_DICTIONARY) -> DataFrame:
    """Replaces ``genre_ids`` by ``genres``: names in id order, unknown and blank ones dropped.

    A dictionary of at most ``small`` entries becomes a literal map, so titles are not
    shuffled. A larger one is joined once per distinct id list, not per title.
    """
    known = dictionary.filter(F.col("name") != "").select("genre_id", "name")
    none = F.array().cast("array<string>")
    entries = rows_up_to(known, small)
    if entries == []:
        return titles.withColumn("genres", none).drop("genre_ids")
    if entries is not None:
        names = F.create_map(*[F.lit(x) for row in entries for x in (row.genre_id, row.name)])
        named = F.filter(
            F.transform("genre_ids", lambda g: F.try_element_at(names, g)),
            lambda name: name.isNotNull(),
        )
        return titles.withColumn("genres", F.coalesce(named, none)).drop("genre_ids")
    resolved = (
        titles.select("genre_ids").distinct()
        .select("genre_ids", F.posexplode("genre_ids").alias("pos", "genre_id"))
        .join(known, "genre_id")
        .groupBy("genre_ids")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "name"))).alias("found"))
        .select("genre_ids", F.transform("found", lambda f: f["name"]).alias("genres"))
    )
    return (
        titles.join(resolved, "genre_ids", "left")
        .withColumn("genres", F.coalesce("genres", none))
        .drop("genre_ids")
    )


def new_titles(titles: DataFrame, movies: DataFrame) -> DataFrame:
    """Titles that are not in the catalogue yet."""
    return titles.join(movies.select("id"), "id", "left_anti")


def known_titles(titles: DataFrame, movies: DataFrame) -> DataFrame:
    """Titles that are in the catalogue."""
    return titles.join(movies.select("id"), "id", "left_semi")


def titles_of_genre(movies: DataFrame, genres: DataFrame, genre: str | None) -> DataFrame:
    """Movies of one genre, each once; no genre or ``All`` keeps every movie."""
    if not genre or genre == "All":
        return movies
    tagged = genres.filter(F.col("genre") == genre).select(F.col("movie_id").alias("id"))
    return movies.join(tagged, "id", "left_semi")


def with_genres(movies: DataFrame, genres: DataFrame) -> DataFrame:
    """Adds the genre list; a title without genres gets an empty one."""
    found = lists.genre_lists(genres).withColumnRenamed("movie_id", "id")
    empty = F.array().cast("array<string>")
    return movies.join(found, "id", "left").withColumn("genres", F.coalesce("genres", empty))


def summaries_with_lists(summaries: DataFrame, points: DataFrame, themes: DataFrame) -> DataFrame:
    """Summary rows with ``pros``, ``cons`` and ``themes``: one row per summary.

    Both child tables are grouped in one pass before the join, so they do not multiply.
    """
    empty = F.array().cast("array<string>")
    return summaries.join(lists.entry_lists(points, themes), "movie_id", "left").withColumns(
        {c: F.coalesce(c, empty) for c in ("pros", "cons", "themes")})


def summary_state(summaries: DataFrame, points: DataFrame, themes: DataFrame) -> DataFrame:
    """``(movie_id, has_summary)``: whether a stored summary says anything.

    Children only need to exist, so they are reduced to distinct ids, never collected.
    """
    children = (
        points.filter(F.col("type").isin("pro", "con")).select("movie_id")
        .unionByName(themes.select("movie_id"))
        .distinct()
        .withColumn("__children", F.lit(True))
    )
    texts = m.summary_text_present(
        F.col("overall_sentiment"), F.col("audience_consensus"), F.col("recommendation")
    )
    return summaries.join(children, "movie_id", "left").select(
        "movie_id", (texts | F.coalesce("__children", F.lit(False))).alias("has_summary")
    )


def with_summaries(movies: DataFrame, summary_lists: DataFrame | None) -> DataFrame:
    """Adds the ``summary`` struct and ``review_count_analyzed``.

    ``summary_lists`` are rows of :func:`summaries_with_lists`, or None where the
    summary table is unavailable: then no movie has a summary and every count is 0.
    """
    if summary_lists is None:
        none = F.lit(None).cast(SUMMARY_STRUCT)
        return movies.withColumns({"summary": none, "review_count_analyzed": F.lit(0)})
    says = m.has_content(*[F.col(c) for c in (
        "overall_sentiment", "audience_consensus", "recommendation", "pros", "cons", "themes")])
    found = summary_lists.select(
        F.col("movie_id").alias("id"),
        F.coalesce("review_count", F.lit(0)).alias("__count"),
        F.when(says, _summary_struct()).alias("summary"),
    )
    return (
        movies.join(found, "id", "left")
        .withColumn("review_count_analyzed", F.coalesce("__count", F.lit(0)))
        .drop("__count")
    )


SUMMARY_STRUCT = (
    "struct<overall_sentiment: int, pros: array<string>, cons: array<string>, "
    "common_themes: array<string>, audience_consensus: string, recommendation: string>"
)


def _summary_struct() -> Column:
    return F.struct(
        F.col("overall_sentiment").cast("int").alias("overall_sentiment"),
        "pros",
        "cons",
        F.col("themes").alias("common_themes"),
        F.nullif("audience_consensus", F.lit("")).alias("audience_consensus"),
        F.nullif("recommendation", F.lit("")).alias("recommendation"),
    )


def with_details(titles: DataFrame, details: DataFrame, few: bool = False) -> DataFrame:
    """Adds imdb id and genre names from the detail payloads; both stay missing without one.

    With ``few`` titles only their payloads are grouped, not all of them.
    """
    if few:
        details = details.join(titles.select("tmdb_id"), "tmdb_id", "left_semi")
    found = details.groupBy("tmdb_id").agg(
        F.max(F.struct("imdb_id", "genres")).alias("__d")
    )
    return (
        titles.drop("imdb_id", "genres")
        .join(found, "tmdb_id", "left")
        .withColumns({"imdb_id": F.col("__d.imdb_id"), "genres": F.col("__d.genres")})
        .drop("__d")
    )


def with_ratings(titles: DataFrame, ratings: DataFrame, few: bool = False) -> DataFrame:
    """Adds the two scores, by imdb id where there is one, else by title.

    Only ratings that say something overwrite a score the title came with. With ``few``
    titles only their payloads are grouped, not all of them.
    """
    def keyed(prefix: str, column: str) -> Column:
        return F.concat(F.lit(prefix), F.nullif(F.col(column), F.lit("")))

    def by(prefix: str, column: str) -> DataFrame:
        return ratings.select(
            keyed(prefix, column).alias("__key"), F.struct("imdb", "rotten_tomatoes").alias("__s")
        )

    asked = titles.withColumn(
        "__key", F.coalesce(keyed("imdb:", "imdb_id"), keyed("title:", "title"))
    )
    rated = by("imdb:", "imdb_id").unionByName(by("title:", "title"))
    rated = rated.filter(F.col("__key").isNotNull())
    if few:
        rated = rated.join(asked.select("__key"), "__key", "left_semi")
    found = rated.groupBy("__key").agg(F.max("__s").alias("__s"))

    def kept(column: str, ddl: str) -> Column:
        return F.col(column) if column in titles.columns else F.lit(None).cast(ddl)

    return (
        asked.join(found, "__key", "left")
        .withColumns({
            "imdb_score": F.coalesce(
                scores.imdb_score(F.col("__s.imdb")), kept("imdb_score", "double")
            ),
            "rotten_tomatoes": F.coalesce(
                scores.tomato_score(F.col("__s.rotten_tomatoes")), kept("rotten_tomatoes", "int")
            ),
        })
        .drop("__key", "__s")
    )
