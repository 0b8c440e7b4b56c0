"""Landed pages taken in runs of an exact number of pages, whatever the number of pages in a file.

The place of a page is its file and its number among the pages of that file. Progress is a table of such places, a folder per
batch: ``(file, taken, whole)``, the pages taken of a file so far and whether none is left. A file that lands late or
with an old date is found all the same, as what counts is not its date but that it is not in the table.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from titleflow.session import written

PROGRESS = "batch long, file string, taken long, whole boolean"

# files that one batch looks at
FILES = 20_000


def progress_table(spark: SparkSession, folder: str) -> DataFrame:
    """The places that finished batches have reached; none for a folder that is not there yet."""
    try:
        return spark.read.schema(PROGRESS).parquet(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], PROGRESS)


def pending_files(spark: SparkSession, path: str, progress: DataFrame, most: int) -> list:
    """The first ``most`` files by age with pages left, as ``(file, age, taken)``. Only the listing is read, no file."""
    files = spark.read.format("binaryFile").load(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("age"))
    reached = progress.groupBy("file").agg(F.max("taken").alias("taken"), F.bool_or("whole").alias("whole"))
    left = files.join(reached, "file", "left").where("whole IS NULL OR NOT whole")
    return left.select("file", "age", F.coalesce("taken", F.lit(0)).alias("taken")).orderBy("age", "file").limit(most).collect()


def _lines(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """The lines of these files that are pages, as blank ones are not: ``file, split, value``."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value"
    ).where(F.col("file").isin(names) & (F.trim("value") != ""))


def counted(spark: SparkSession, path: str, names: list[str]) -> dict[str, int]:
    """The number of pages of each file."""
    rows = _lines(spark, path, names).groupBy("file").agg(F.count(F.lit(1)).alias("n")).collect() if names else []
    return dict.fromkeys(names, 0) | {r.file: r.n for r in rows}


def reached(totals: dict[str, int], files: list, most: int) -> list[tuple]:
    """``(file, taken, whole)`` after the next ``most`` pages of the files in order: one row per file looked at."""
    places = []
    for f in files:
        if not most:
            break
        to = min(f.taken + most, max(totals[f.file], f.taken))
        places.append((f.file, to, to >= totals[f.file]))
        most -= to - f.taken
    return places


def numbered(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """The pages of these files, written once: ``file, n, value``, ``n`` from 1 in the file.

    Files are read in splits. Row ids rise by one inside a split, so a page's number is its place there and the pages of the
    file's splits before; only counts per split meet.
    """
    lines = written(_lines(spark, path, names).withColumn("at", F.monotonically_increasing_id()), "landed-pages")
    splits = lines.groupBy("file", "split").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("pages"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("pages").over(earlier), F.lit(0)) + 1 - F.col("first")
    splits = written(splits.select("file", "split", before.alias("before")), "landed-splits")
    return lines.join(splits, ["file", "split"]).select("file", (F.col("at") + F.col("before")).alias("n"), "value")


def between(pages: DataFrame, files: list, places: list[tuple]) -> DataFrame:
    """The pages from where the files stood up to the new places."""
    # a row per file of the batch, FILES at most
    bounds = pages.sparkSession.createDataFrame(
        [(f.file, f.taken, to) for f, (_, to, _) in zip(files, places)], "file string, taken long, to long")
    return pages.join(F.broadcast(bounds), "file").where("n > taken AND n <= to").select("value")


def commit(spark: SparkSession, folder: str, batch: int, places: list[tuple]) -> None:
    """Written after the batch has been saved: a batch lost before comes again."""
    rows = spark.createDataFrame([place for place in places], "file string, taken long, whole boolean")
    rows.coalesce(1).write.mode("overwrite").parquet(f"{folder}/batch={batch}")
