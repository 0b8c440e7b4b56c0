"""Pages far behind the start, without a sort of all that comes before them.

A top-k of offset + limit rows holds as many in every task. Instead a sample of the rows gives boundaries of ranges, one
pass counts the rows of each range, and only the ranges that hold the page go on. That is repeated until few rows are
left, which are sorted. Boundaries only decide how evenly ranges are filled: any give the same page.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranges of one pass, rows of the sample that bounds them, and rows that are sorted in the end.
RANGES, SAMPLE = 48, 2_000
FEW = 100_000


def _before(column: str, ascending: bool, value: Column, name: Column) -> Column:
    """The row comes before the place ``(value, name)``; a null value is the lowest."""
    own, at = F.col(column), F.col("id")
    lower = (own < value) | (own.isNull() & value.isNotNull())
    higher = (own > value) | (own.isNotNull() & value.isNull())
    first = lower if ascending else higher
    return F.coalesce(first, F.lit(False)) | (own.eqNullSafe(value) & (at < name))


def narrowed(
    rows: DataFrame, column: str, ascending: bool, offset: int, limit: int, few: int = FEW, ranges: int = RANGES, sample: int = SAMPLE
) -> tuple[DataFrame, int]:
    """The rows among which the page is, and its offset among them. ``rows``: ``id`` and the sort column.

    Each pass brings ``ranges`` counts and ``sample`` narrow rows to the driver, whatever the table's size.
    """
    kind = rows.schema[column].dataType
    order = [F.col(column).asc() if ascending else F.col(column).desc(), F.col("id")]
    left = None
    while left is None or left > few:
        # the rows with the least hashes are a uniform sample, and the same in every run
        drawn = rows.orderBy(F.xxhash64("id"), "id").limit(sample).collect()
        drawn = rows.sparkSession.createDataFrame(drawn, rows.schema).orderBy(*order).collect()
        places = [drawn[k * len(drawn) // ranges] for k in range(1, ranges)] if len(drawn) >= ranges else []
        if not places:
            return rows, offset
        bounds = [(F.lit(row[column]).cast(kind), F.lit(row["id"])) for row in places]
        # places are in order, so the number of those that a row does not come before is its range
        number = reduce(lambda a, b: a + b, [(~_before(column, ascending, *bound)).cast("int") for bound in bounds])
        counts = {row["range"]: row["count"] for row in rows.groupBy(number.alias("range")).count().collect()}
        total = sum(counts.values())
        first, skipped = 0, 0
        while first < ranges - 1 and skipped + counts.get(first, 0) <= offset:
            skipped += counts.get(first, 0)
            first += 1
        last, held = first, counts.get(first, 0)
        while last < ranges - 1 and skipped + held < offset + limit:
            last += 1
            held += counts.get(last, 0)
        if held >= total:
            return rows, offset
        if first > 0:
            rows = rows.filter(~_before(column, ascending, *bounds[first - 1]))
        if last < ranges - 1:
            rows = rows.filter(_before(column, ascending, *bounds[last]))
        offset, left = offset - skipped, held
    return rows, offset
