"""What several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from titleflow.session import work_path, written

__all__ = ["ascii_lower", "documents", "id_and_text", "small_batches", "work_path", "written"]

#: The separators of words; every other character belongs to a word.
SPACE = r"\x20\x09-\x0D"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` alone, a null text as an empty one; other columns cannot clash."""
    return df.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only.

    ``lower`` does the same, faster, for a text without other characters that have a lower case.
    """
    other = text.rlike(r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]")
    return F.when(other, F.translate(text, _UPPER, _UPPER.lower())).otherwise(F.lower(text))


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches that tasks exchange with Python, in rows and in bytes, as one text may be very long.

    Every operator sets the same bounds, so none changes a frame of another that has not run yet.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def per_batch(make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]]):
    """A ``mapInArrow`` function from a factory, which is called once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            out = step(batch)
            if out is not None and out.num_rows:
                yield out

    return run


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where ``df`` has such a column already."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
