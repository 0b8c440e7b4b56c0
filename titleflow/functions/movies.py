"""Expressions over title and summary rows."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: id prefix and poster address
ID_PREFIX = "tmdb_"
POSTER_BASE = "https://image.tmdb.org/t/p/w500"


def movie_id(tmdb_id: Column) -> Column:
    return F.concat(F.lit(ID_PREFIX), tmdb_id.cast("string"))


def poster_url(path: Column) -> Column:
    return F.when(path != "", F.concat(F.lit(POSTER_BASE), path))


def _filled(text: Column) -> Column:
    return F.coalesce(text != "", F.lit(False))


def _any(array: Column) -> Column:
    return F.coalesce(F.size(array) > 0, F.lit(False))


def summary_text_present(sentiment: Column, consensus: Column, recommendation: Column) -> Column:
    return sentiment.isNotNull() | _filled(consensus) | _filled(recommendation)


def has_content(
    sentiment: Column, consensus: Column, recommendation: Column,
    pros: Column, cons: Column, themes: Column,
) -> Column:
    """A summary with a sentiment, a non-blank text or at least one list entry."""
    return (
        summary_text_present(sentiment, consensus, recommendation)
        | _any(pros) | _any(cons) | _any(themes)
    )


def has_deep_summary(consensus: Column, pros: Column, cons: Column) -> Column:
    return _filled(consensus) | _any(pros) | _any(cons)


def to_migrate(sentiment: Column, consensus: Column, recommendation: Column) -> Column:
    """Any summary column set at all; a blank text counts here."""
    return sentiment.isNotNull() | consensus.isNotNull() | recommendation.isNotNull()


def card_genres(genres: Column) -> Column:
    """First two genres, or the word ``Movie`` where there is none."""
    joined = F.array_join(F.slice(F.coalesce(genres, F.array().cast("array<string>")), 1, 2), " • ")
    return F.when(joined == "", "Movie").otherwise(joined)


def card_year(release_date: Column) -> Column:
    return F.coalesce(F.year(release_date).cast("string"), F.lit("N/A"))
