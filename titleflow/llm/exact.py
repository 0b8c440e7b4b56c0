"""Exact dedup: group by a 128-bit content hash, compare bytes inside the groups, keep one id.

The first pass groups by ``(hash, text)``. Spark compares the whole text there, so texts that merely share a
hash stay apart, and every task collapses its own copies before the shuffle: a group that holds a third of
all rows sends one row per task. The second pass gives each row its class over narrow rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titleflow.llm.common import ascii_lower, fresh, id_and_text, written


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per row of ``df``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal if identical after lower-casing A-Z; a null text counts as an empty one. ``keep``: whether the
    smallest or the largest id of a group stays. Null ids never win over others; a group of null ids alone has a
    null ``keep_id`` and all its rows are kept, as nothing tells them apart. Rows repeating id and text are
    marked alike. An empty table gives an empty one; other columns are not read.
    """
    best = {"smallest": F.min, "largest": F.max}[keep]
    plain = id_and_text(df, id_col, text_col).select("doc_id", ascii_lower(F.col("text")).alias("text"))
    hashed = plain.select(
        "doc_id", "text", F.unhex(F.md5(F.col("text").cast("binary"))).alias("hash"),
        F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha"),
    )
    same = hashed.groupBy("hash", "text").agg(best("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    same = same.select("hash", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha"), "keep_id", "group_size")
    # texts of one hash are told apart by their SHA-256; two texts that agree in both stop the job
    named = same.groupBy("hash", "sha").agg(
        F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.count("*").alias("texts")
    ).select(
        "hash", "sha", "keep_id",
        F.when(F.col("texts") > 1, F.raise_error(F.lit("different texts with equal MD5 and SHA-256")).cast("bigint"))
        .otherwise(F.col("group_size")).alias("group_size"),
    )
    return hashed.select("doc_id", "hash", "sha").join(named, ["hash", "sha"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns.

    Rows repeating id and text are one document: one of them stays, with the columns of any of them. Rows of a
    null id are kept, once, if no other row has their text.
    """
    own, name, sha, rows = fresh(df, "own", "id", "sha", "rows")
    kept = classes(df, id_col, text_col, keep).where("kept")
    decided = written(kept.groupBy(F.col("doc_id").alias(name), F.col("text_sha256").alias(sha)).agg(F.count("*").alias(rows)), "exact")
    lowered = ascii_lower(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    marked = df.withColumn(own, F.sha2(lowered.cast("binary"), 256))
    stay = marked.join(decided, F.col(f"`{id_col}`").eqNullSafe(F.col(name)) & (F.col(own) == F.col(sha)), "left_semi")
    if not decided.where(F.col(rows) > 1).isEmpty():
        stay = stay.dropDuplicates([id_col, own])
    return stay.drop(own)
