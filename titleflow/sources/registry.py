"""Pluggable review and candidate sources, and the union over review sources."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titleflow import schemas
from titleflow.session import rows_up_to, written
from titleflow.sources.per_title import TitleSource

#: Titles that are named to a source one by one.
ASKED = 1_000

Fetch = Callable[[SparkSession], DataFrame]

ERRORS = "source STRING, error STRING"


@dataclass
class Sources:
    """Sources by name; the order of registration is their rank."""

    review: dict[str, Fetch] = field(default_factory=dict)
    candidate: dict[str, Fetch] = field(default_factory=dict)

    def add_reviews(self, name: str, fetch: Fetch) -> "Sources":
        self.review[name] = fetch
        return self

    def add_title_source(self, source: type[TitleSource], **options: str) -> "Sources":
        """A source that is asked title by title."""
        def fetch(spark: SparkSession) -> DataFrame:
            spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
            spark.dataSource.register(source)
            return spark.read.format(source.name()).options(**options).load()

        return self.add_reviews(source.name(), fetch)

    def add_candidates(self, name: str, fetch: Fetch) -> "Sources":
        self.candidate[name] = fetch
        return self

    def candidates(self, spark: SparkSession, name: str) -> DataFrame:
        if name not in self.candidate:
            raise KeyError(f"no candidate source named {name!r}")
        return self.candidate[name](spark)

    def collect(self, spark: SparkSession, asked: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """Reviews of all sources with their rank, and one error row per failing source.

        ``asked``: titles (``movie_id``) whose reviews are wanted, None for all. Up to ``ASKED`` of them filter the
        sources' own reads; more are joined. Each source is written once as it is read, the asked titles only, so one that
        breaks on the way contributes nothing and stops no other one.
        """
        titles = None if asked is None else rows_up_to(asked.select("movie_id").distinct(), ASKED)

        def wanted(frame: DataFrame) -> DataFrame:
            if asked is None:
                return frame
            if titles is None:
                return frame.join(asked.select("movie_id").distinct(), "movie_id", "left_semi")
            return frame.filter(F.col("movie_id").isin([row["movie_id"] for row in titles]))

        names = schemas.REVIEWS.fieldNames()
        frames, failed = [], []
        for rank, (name, fetch) in enumerate(self.review.items()):
            try:
                frame = written(wanted(fetch(spark)).select(*names), "source").withColumn("source_rank", F.lit(rank))
            except Exception as error:  # whatever a source's reader raises belongs to that source
                failed.append((name, str(error) or type(error).__name__))
                continue
            frames.append(frame)
        if not frames:
            empty = spark.createDataFrame([], schemas.REVIEWS)
            frames.append(empty.withColumn("source_rank", F.lit(0)))
        return reduce(DataFrame.unionByName, frames), spark.createDataFrame(failed, ERRORS)
