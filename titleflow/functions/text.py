"""Text expressions. All of them are JVM expressions; none needs a UDF.

"Whitespace" is the Unicode White_Space property, not only the blank that Spark's
``trim`` knows by itself.
"""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"\p{IsWhite_Space}"
NOT_WS = r"\P{IsWhite_Space}"
URL_PATTERN = r"https?://[^\t\n\f\r ]+"

# fixed values: the characters with the White_Space property
WHITESPACE = (
    "\t\n\v\f\r \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
    "\u200a\u2028\u2029\u202f\u205f\u3000"
)


def trim_ws(text: Column) -> Column:
    return F.trim(text, F.lit(WHITESPACE))


def clean_text(text: Column) -> Column:
    """Drop web addresses, trim every line, drop blank lines.

    Works on lines, not on a pattern over the whole text: trimming looks at the ends of
    a line only, which is several times faster and linear on any input.
    """
    without_urls = F.when(
        text.contains("://"), F.regexp_replace(text, URL_PATTERN, "")
    ).otherwise(text)
    lines = F.transform(F.split(without_urls, "\n"), trim_ws)
    return F.array_join(F.filter(lines, lambda line: line != ""), "\n")


def words(text: Column, limit: int = -1) -> Column:
    """Words of a trimmed text; with ``limit`` the last entry holds the unsplit rest."""
    return F.split(text, rf"{WS}+", limit)


def word_count(text: Column) -> Column:
    """Number of words of a cleaned text."""
    return F.when(text == "", 0).otherwise(F.size(words(text)))


def has_words(text: Column, least: int) -> Column:
    """``word_count(text) >= least`` of a cleaned text, reading its first words only."""
    return text.rlike(rf"\A{NOT_WS}++(?:{WS}++{NOT_WS}++){{{least - 1}}}")


def prefix_key(text: Column, n_words: int = 15) -> Column:
    """Lower-cased first words of a cleaned text: the key that finds copies."""
    return F.lower(F.array_join(F.slice(words(text, n_words + 1), 1, n_words), " "))


def strip_tags(text: Column) -> Column:
    """Text outside ``<...>``; a stray ``>`` goes, as does all after an unclosed ``<``."""
    return trim_ws(F.regexp_replace(text, r"<[^>]*+>?|>", ""))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def contains_like(text: Column, query: str) -> Column:
    """``LIKE '%query%'`` folding ASCII letters only.

    ``%`` and ``_`` inside the query stay wildcards and there is no escape character.
    """
    folded = query.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    return ascii_lower(text).like("%" + folded.replace("\\", "\\\\") + "%")


def post_content(title: Column, body: Column) -> Column:
    """Title, then a blank line and the body unless that is missing or was taken down."""
    gone = body.isNull() | body.isin("", "[deleted]", "[removed]")
    return F.when(gone, title).otherwise(F.concat(title, F.lit("\n\n"), body))


def feed_content(title: Column, description: Column) -> Column:
    """Description without markup, or the title where nothing is left."""
    plain = strip_tags(F.coalesce(description, F.lit("")))
    return F.when(plain == "", title).otherwise(plain)


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))
