"""Landed rating payloads."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed value: the rating source that carries the percentage
PERCENT_SOURCE = "Rotten Tomatoes"


def rating_scores(payloads: DataFrame) -> DataFrame:
    """``(imdb_id, title, imdb, rotten_tomatoes)`` as texts, missing where not rated.

    Of several entries of the percentage source the last one counts.
    """
    found = F.coalesce(F.col("Response") != "False", F.lit(True))
    rated = ~F.coalesce(F.col("imdbRating"), F.lit("")).isin("", "N/A")
    percents = F.filter("Ratings", lambda r: r["Source"] == PERCENT_SOURCE)
    return payloads.select(
        "imdb_id",
        "title",
        F.when(found & rated, F.col("imdbRating")).alias("imdb"),
        F.when(found, F.try_element_at(percents, F.lit(-1))["Value"]).alias("rotten_tomatoes"),
    )
