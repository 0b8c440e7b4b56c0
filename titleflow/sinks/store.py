"""The six tables as Parquet, hash-bucketed by key.

A write goes to a version folder of its own and holds the buckets that it touches. A pointer then names the version of every
bucket; it is one small file, created last, and the newest one is the table. So a merge reads and rewrites only the
buckets that its batch touches, readers see a table before or after a write and never between, and a failed write leaves
the table as it was. A pointer is created only where none of its number exists, so of two writers that start from the
same one the second fails. The number of buckets is part of the pointer, and a store with another number is refused.

Cost of a merge: random keys touch all buckets once a batch has several times as many titles as there are
buckets. Choose their number so that a bucket holds one or a few files of a usual size.

Rows are rebalanced by bucket before the write: small buckets share a task and a bucket that one title fills is
split over several. A bucket that no write touches stays in the folder of its last write, however old, so age tells nothing
about a folder: only folders that the newest pointer does not name (``live_versions``) may be removed, once nobody reads
an older table.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from titleflow import schemas
from titleflow.functions.dates import Moment
from titleflow.session import written
from titleflow.sinks import merge

BUCKETS = 64


class TableStore:
    """Tables below one root folder. ``buckets`` is fixed once a table exists."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark = spark
        self.root = root.rstrip("/")
        self.buckets = buckets

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def read(self, table: str) -> DataFrame:
        """The table; one that was never written is empty."""
        return self._buckets(table, None).drop("bucket")

    def _stored_schema(self, table: str) -> T.StructType:
        fields = [T.StructField(f.name, f.dataType, True) for f in schemas.TABLES[table].fields]
        return T.StructType([*fields, T.StructField("bucket", T.IntegerType())])

    def _folder(self, path: str) -> tuple:
        """The file system of a folder and its path there."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _names(self, path: str) -> list[str]:
        system, place = self._folder(path)
        return [entry.getPath().getName() for entry in system.listStatus(place)] if system.exists(place) else []

    def _pointer(self, table: str) -> tuple[int, dict[int, str]]:
        """The number of the newest pointer, 0 for none, and the version of each bucket that holds rows.

        One listing and one small file, however many writes there were. A pointer whose writer died on the way is passed over.
        """
        folder = f"{self.path(table)}/pointer"
        numbers = sorted((int(name[:-5]) for name in self._names(folder) if name.endswith(".json")), reverse=True)
        for number in numbers:
            system, place = self._folder(f"{folder}/{number}.json")
            stream = system.open(place)
            try:
                text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            try:
                content = json.loads(text)
            except ValueError:
                continue
            if content["buckets"] != self.buckets:
                raise ValueError(f"{table} has {content['buckets']} buckets, not {self.buckets}")
            return numbers[0], {int(bucket): version for bucket, version in content["versions"].items()}
        return (numbers[0] if numbers else 0), {}

    def _point(self, table: str, number: int, versions: dict[int, str]) -> None:
        """Make the versions the table; fails where another writer has taken the number."""
        system, place = self._folder(f"{self.path(table)}/pointer/{number}.json")
        stream = system.create(place, False)
        stream.write(bytearray(json.dumps({"buckets": self.buckets, "versions": versions}).encode()))
        stream.close()

    def live_versions(self, table: str) -> set[str]:
        """The version folders that the table consists of."""
        return set(self._pointer(table)[1].values())

    def _buckets(self, table: str, touched: list[int] | None) -> DataFrame:
        schema = self._stored_schema(table)
        versions = self._pointer(table)[1]
        wanted = versions if touched is None else {b: versions[b] for b in touched if b in versions}
        if not wanted:
            return self.spark.createDataFrame([], schema)
        places = [f"{self.path(table)}/data/version={version}/bucket={bucket}" for bucket, version in sorted(wanted.items())]
        stored = T.StructType([*schema.fields, T.StructField("version", T.StringType())])
        return self.spark.read.schema(stored).option("basePath", f"{self.path(table)}/data").parquet(*places).drop("version")

    def bucket_of(self, key: str | Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def touched(self, keys: DataFrame, key: str) -> list[int]:
        """Buckets a batch touches: never more than ``buckets`` numbers."""
        rows = keys.select(self.bucket_of(key).alias("bucket")).distinct().collect()
        return sorted(row.bucket for row in rows)

    def _overwrite(self, table: str, rows: DataFrame, touched: list[int]) -> None:
        """Put ``rows`` in the place of the touched buckets."""
        key = schemas.TABLE_KEYS[table]
        number, versions = self._pointer(table)
        version = uuid.uuid4().hex
        data = f"{self.path(table)}/data/version={version}"
        (
            rows.select(
                *[F.col(f.name).cast(f.dataType) for f in schemas.TABLES[table].fields],
                self.bucket_of(key).alias("bucket"),
            )
            .hint("rebalance", "bucket")
            .sortWithinPartitions("bucket", key)
            .write.partitionBy("bucket")
            .parquet(data)
        )
        filled = [int(name.removeprefix("bucket=")) for name in self._names(data) if name.startswith("bucket=")]
        kept = {bucket: old for bucket, old in versions.items() if bucket not in set(touched)}
        self._point(table, number + 1, kept | dict.fromkeys(filled, version))

    def create(self, table: str, rows: DataFrame) -> None:
        """Write a whole table."""
        self._overwrite(table, rows, list(range(self.buckets)))

    def rows_of(self, table: str, keys: DataFrame, column: str, touched: list[int] | None = None) -> DataFrame:
        """The table's rows of some titles, named by ``column`` of ``keys``; only their buckets are read. ``touched``: these
        buckets, where known."""
        key = "id" if table == "movies" else "movie_id"
        touched = self.touched(keys, column) if touched is None else touched
        wanted = keys.select(F.col(column).alias(key)).distinct()
        return self._buckets(table, touched).drop("bucket").join(wanted, key, "left_semi")

    def rows_by_id(self, table: str, ids: list[str]) -> DataFrame:
        """The table's rows of a few titles: the ids choose the buckets, and filter the scan inside them."""
        key = "id" if table == "movies" else "movie_id"
        asked = self.spark.createDataFrame([(i,) for i in ids], "id string")
        return self._buckets(table, self.touched(asked, "id")).drop("bucket").filter(F.col(key).isin(ids))

    def upsert(
        self, table: str, new: DataFrame, keep_non_null: bool = False,
        touched: list[int] | None = None,
    ) -> None:
        """Merge rows that are unique per key. ``touched``: their buckets, where known."""
        key = schemas.TABLE_KEYS[table]
        touched = self.touched(new, key) if touched is None else touched
        if touched:
            old = self._buckets(table, touched).drop("bucket")
            merged = merge.upsert(old, new.select(*old.columns), key, keep_non_null)
            self._overwrite(table, merged, touched)

    def replace_children(
        self, table: str, parents: DataFrame, new: DataFrame, touched: list[int] | None = None
    ) -> None:
        """Replace all child rows of the parents (``movie_id``) by the new ones."""
        touched = self.touched(parents, "movie_id") if touched is None else touched
        if touched:
            old = self._buckets(table, touched).drop("bucket")
            self._overwrite(table, merge.replace_children(old, parents, new), touched)

    def save_movies(self, batch: DataFrame, now: Moment, order: str | None = None) -> None:
        """Upsert titles with their ``genres``; with ``order`` the last row of an id wins."""
        # only stored columns and distinct genres are sorted, shuffled and written
        narrow = merge.movie_batch(batch, order)
        if order is not None:
            narrow = merge.last_wins(narrow, "id", "__order").drop("__order")
        batch = written(narrow, "movie-batch")
        parents = batch.select(F.col("id").alias("movie_id"))
        touched = self.touched(batch, "id")
        self.replace_children("movie_genres", parents, merge.genre_rows(batch, unique=order is not None), touched)
        self.upsert("movies", merge.movie_rows(batch, now), touched=touched)

    def save_summaries(self, saved: DataFrame, now: Moment) -> None:
        """Upsert summaries with ``pros``, ``cons`` and ``themes``; children first."""
        saved = written(saved, "summary-batch")
        touched = self.touched(saved, "movie_id")
        self.replace_children("movie_points", saved, merge.point_rows(saved), touched)
        self.replace_children("movie_themes", saved, merge.theme_rows(saved), touched)
        self.upsert("movie_summaries", merge.summary_rows(saved, now), touched=touched)

    def save_requests(self, requests: DataFrame) -> None:
        self.upsert("review_requests", written(merge.latest_requests(requests), "requests"))
