"""Rating texts to numbers and back."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from titleflow.functions.text import trim_ws

_DECIMAL = r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
_INTEGER = r"\A[+-]?[0-9]+\z"

# fixed values: lowest sentiment of each class and label
CLASSES = ((70, "high"), (40, "mid"))
LOWEST_CLASS, NO_CLASS = "low", "none"
LABELS = (
    (80, "Overwhelmingly Positive"),
    (65, "Generally Favorable"),
    (45, "Mixed or Average"),
    (30, "Leaning Negative"),
)
LOWEST_LABEL, NO_LABEL = "Unfavorable", "Awaiting Analysis"
UNRATED = "Unrated"


def imdb_score(raw: Column) -> Column:
    """``7.8`` or ``7.8/10`` as a number; anything else is missing."""
    trimmed = trim_ws(raw)
    number = F.substring_index(trimmed, "/", 1)
    value = number.try_cast("double")
    finite = F.abs(value) < F.lit(float("inf"))
    return F.when(number.rlike(_DECIMAL) & finite, value)


def tomato_score(raw: Column) -> Column:
    """``84%``, ``84`` or ``84/100`` as an integer; anything else is missing."""
    number = F.substring_index(F.regexp_replace(trim_ws(raw), r"%\z", ""), "/", 1)
    return F.when(number.rlike(_INTEGER), number.try_cast("int"))


def score_text(score: Column) -> Column:
    """A score as documents print it: ``7.8``, but ``8`` for a whole number."""
    return F.regexp_replace(score.cast("string"), r"\.0\z", "")


def percent_text(score: Column) -> Column:
    return F.concat(score.cast("string"), F.lit("%"))


def _banded(score: Column, bands, lowest: str, missing: str) -> Column:
    column = F.when(score.isNull(), missing)
    for least, name in bands:
        column = column.when(score >= least, name)
    return column.otherwise(lowest)


def sentiment_class(score: Column) -> Column:
    return _banded(score, CLASSES, LOWEST_CLASS, NO_CLASS)


def sentiment_label(score: Column) -> Column:
    return _banded(score, LABELS, LOWEST_LABEL, NO_LABEL)


def sentiment_text(score: Column) -> Column:
    return F.coalesce(percent_text(score), F.lit(UNRATED))
