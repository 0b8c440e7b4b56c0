"""Rows that break a table's keys, required columns, value lists or references."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titleflow import schemas

# columns that identify a row, and columns that must be unique on their own
KEYS = {
    "movies": [["id"], ["tmdb_id"]],
    "movie_genres": [["movie_id", "genre"]],
    "review_requests": [["movie_id"]],
    "movie_summaries": [["movie_id"]],
}
VALUES = {"movie_points": {"type": ["pro", "con"]}}
PARENTS = {
    "movie_genres": ("movies", "id"),
    "movie_points": ("movie_summaries", "movie_id"),
    "movie_themes": ("movie_summaries", "movie_id"),
}


def violations(tables: dict[str, DataFrame]) -> DataFrame:
    """``(table_name, rule, row_key, row_count)``.

    A table is scanned once: every row gives the keys that must be unique, the reference it makes and the rules it breaks, all
    counted in one aggregation before anything is shuffled. Keys of more than one column are counted as arrays, so no separator can
    make two of them look alike. References meet their parents after that, one row per key, by the aggregation's own
    partitioning; Spark puts a Bloom filter of the parents before that exchange where they are much smaller.
    """
    return reduce(DataFrame.unionByName, [_of_table(table, frame, tables) for table, frame in tables.items()])


def _of_table(table: str, frame: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    key = schemas.TABLE_KEYS[table]

    def found(rule: str, *columns: str):
        return F.struct(F.lit(rule).alias("rule"), F.array(*(F.col(c).cast("string") for c in columns)).alias("key"))

    unique = {f"unique({','.join(columns)})": columns for columns in KEYS.get(table, [])}
    broken = {
        f"not_null({f.name})": F.col(f.name).isNull()
        for f in schemas.TABLES[table].fields if not f.nullable and f.name in frame.columns
    }
    broken |= {f"in_list({column})": ~F.col(column).isin(allowed) for column, allowed in VALUES.get(table, {}).items()}
    parent = PARENTS.get(table)
    reference = f"references({parent[0]})" if parent and parent[0] in tables else None
    marks = [found(rule, *columns) for rule, columns in unique.items()]
    marks += [F.when(condition, found(rule, key)) for rule, condition in broken.items()]
    if reference:
        marks.append(found(reference, key))
    rows = frame.select(F.explode(F.filter(F.array(*marks), lambda mark: mark.isNotNull())).alias("mark"))
    counts = rows.groupBy("mark.rule", "mark.key").agg(F.count(F.lit(1)).alias("n"))
    fine = F.col("rule").isin(list(unique)) & (F.col("n") == 1)
    if reference:
        parents = tables[parent[0]].select(
            F.lit(reference).alias("rule"), F.array(F.col(parent[1]).cast("string")).alias("key"), F.lit(True).alias("known"))
        # a parent may be there more than once, where its own table is broken
        counts = counts.join(parents.dropDuplicates(["rule", "key"]), ["rule", "key"], "left")
        fine = fine | F.coalesce("known", F.lit(False))
    label = F.when(F.col("rule").isin(list(unique)), F.concat_ws("|", "key")).otherwise(F.element_at("key", 1))
    return counts.filter(~fine).select(
        F.lit(table).alias("table_name"), "rule", label.alias("row_key"), F.col("n").cast("bigint").alias("row_count"))
