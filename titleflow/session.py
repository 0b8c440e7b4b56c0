"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

# Settings the engine relies on or profits from. Partition counts are left to the
# cluster; AQE coalesces and splits them at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a join on a hot title is split even where the next step could reuse its partitioning
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # a page far behind the start falls back from the driver's heap to a sort on the cluster
    "spark.sql.execution.topKSortFallbackThreshold": "100000",
    # columns on disk grow many times as rows: a task sorts the rows of its split in memory, without a spill
    "spark.sql.files.maxPartitionBytes": "16m",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


@cache
def _local_root(application: str) -> str:
    return tempfile.mkdtemp(prefix="titleflow-")


def work_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: the cluster's own ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return _local_root(context.applicationId)


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder; nothing else writes there."""
    return f"{work_root(spark).rstrip('/')}/titleflow/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return the written table.

    Cuts the lineage, so neither a lost executor nor a second reader runs the plan
    (or an external call inside it) again.
    """
    spark = df.sparkSession
    path = work_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def rows_up_to(df: DataFrame, most: int) -> list | None:
    """The rows of a frame of at most ``most`` rows, None for a larger one.

    The check before anything is broadcast: at most ``most + 1`` rows reach the driver.
    """
    rows = df.limit(most + 1).collect()
    return rows if len(rows) <= most else None
