"""Reports over tables and runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``(table_name, row_count)`` over all tables in one job."""
    counts = [
        frame.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count"
        )
        for name, frame in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def points_by_type(points: DataFrame) -> DataFrame:
    return points.groupBy("type").agg(F.count(F.lit(1)).alias("points"))


def observed_outcomes(outcomes: DataFrame) -> tuple[DataFrame, Observation]:
    """The outcomes, and an observation of ``processed`` and ``failed`` that their one write fills.

    Observe in the stage that writes: a stage behind it may run again after a lost executor and would count twice.
    """
    seen = Observation()
    error = F.col("error")
    return outcomes.observe(seen, F.count_if(error.isNull()).alias("processed"), F.count_if(error.isNotNull()).alias("failed")), seen


def observed_payloads(payloads: DataFrame) -> tuple[DataFrame, Observation]:
    """Payloads, and an observation of ``errors``, the malformed ones, that their one pass into a write fills."""
    seen = Observation()
    return payloads.observe(seen, F.count_if(F.col("_corrupt_record").isNotNull()).alias("errors")), seen


def counters_row(spark: SparkSession, discovered: int, skipped: int, *seen: Observation) -> DataFrame:
    """One row: discovered, processed, skipped, failed, from observations of finished writes."""
    processed, failed = (sum(one.get[name] for one in seen) for name in ("processed", "failed"))
    return spark.createDataFrame(
        [(discovered, processed, skipped, failed)], "discovered bigint, processed bigint, skipped bigint, failed bigint")


def catalogue_counters(titles: DataFrame, movies: DataFrame) -> DataFrame:
    """One row over listing titles: pages, discovered, saved, skipped.

    Saved counts ids, so a title listed twice is one saved title.
    """
    known = movies.select("id").withColumn("known", F.lit(True))
    state = titles.join(known, "id", "left")
    return state.agg(
        F.countDistinct(F.coalesce("year", F.lit(0)), "page").alias("pages"),
        F.count(F.lit(1)).alias("discovered"),
        F.countDistinct(F.when(F.col("known").isNull(), F.col("id"))).alias("saved"),
        F.count_if(F.col("known")).alias("skipped"),
    )
