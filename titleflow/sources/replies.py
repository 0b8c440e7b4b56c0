"""Replies of the summariser: JSON text to typed summaries, all or nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TEXTS = ("audience_consensus", "recommendation")
_LISTS = ("pros", "cons", "common_themes")

# types a key may have in a reply that counts; an absent key gets the zero value
_ALLOWED = {
    "overall_sentiment": ("BIGINT", "VOID"),
    **{key: ("STRING", "VOID") for key in _TEXTS},
    **{key: ("ARRAY<STRING>", "ARRAY<VOID>", "VOID") for key in _LISTS},
}


def _parsed(reply: Column) -> Column:
    """The reply as a variant, NULL unless the text is exactly one JSON value.

    The enclosing object makes text after the value a parse error.
    """
    wrapped = F.try_parse_json(F.concat(F.lit('{"reply":['), reply, F.lit('],"end":1}')))
    single = F.schema_of_variant(wrapped).rlike(r"\AOBJECT<end: BIGINT, reply: ARRAY<.*>>\z")
    alone = F.try_variant_get(wrapped, "$.reply[1]", "variant").isNull()
    return F.when(single & alone, F.try_variant_get(wrapped, "$.reply[0]", "variant"))


def parse_replies(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Adds ``summary`` and ``reply_error`` to a frame with a reply text.

    A reply that is no JSON object, or has one key of a wrong type, is rejected as a
    whole: ``summary`` is NULL and ``reply_error`` says why. Absent and null keys
    become 0, '' and [].
    """
    value = F.col("__reply")
    kind = F.schema_of_variant(value)

    def key_type(key: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(value, f"$.{key}", "variant"))

    def get(key: str, ddl: str, default: Column) -> Column:
        return F.coalesce(F.try_variant_get(value, f"$.{key}", ddl), default)

    object_like = kind.startswith("OBJECT<") | (kind == "VOID")
    typed = [
        F.coalesce(key_type(key).isin(*allowed), F.lit(True)) for key, allowed in _ALLOWED.items()
    ]
    fits = F.try_variant_get(value, "$.overall_sentiment", "bigint").between(-(2**31), 2**31 - 1)
    accepted = object_like & F.coalesce(fits, F.lit(True))
    for ok in typed:
        accepted = accepted & ok
    accepted = F.coalesce(accepted, F.lit(False))

    empty = F.array().cast("array<string>")
    summary = F.struct(
        get("overall_sentiment", "bigint", F.lit(0)).cast("int").alias("overall_sentiment"),
        *[
            F.transform(get(key, "array<string>", empty), lambda x: F.coalesce(x, F.lit(""))).alias(key)
            for key in _LISTS
        ],
        *[get(key, "string", F.lit("")).alias(key) for key in _TEXTS],
    )
    return (
        replies.withColumn("__reply", _parsed(F.col(reply)))
        .withColumn("__ok", accepted)
        .withColumn("summary", F.when(F.col("__ok"), summary))
        .withColumn(
            "reply_error",
            F.when(~F.col("__ok"), F.concat(F.lit("parsing reply: "), F.coalesce(reply, F.lit("")))),
        )
        .drop("__reply", "__ok")
    )
