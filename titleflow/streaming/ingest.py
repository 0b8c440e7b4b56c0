"""Resumable ingest of landed listing pages, and freshness of a candidate stream."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titleflow import schemas
from titleflow.functions.dates import Moment
from titleflow.plans.catalog_sync import catalog_sync
from titleflow.plans.state import plan_stored
from titleflow.sinks.store import TableStore
from titleflow.sources.listings import parse_payloads
from titleflow.streaming import landed

_STOP = "page limit of this run reached"


def page_stream(spark: SparkSession, path: str, pages_per_batch: int) -> DataFrame:
    """Landed pages, one per line, a file after the other by age."""
    lines = spark.readStream.option("maxFilesPerTrigger", pages_per_batch).text(path)
    return parse_payloads(lines, schemas.LISTING_PAGE)


def run_available(
    stream: DataFrame, checkpoint: str, each_batch: Callable[[DataFrame, int], None],
    max_batches: int = 0,
) -> int:
    """Process what has arrived, at most ``max_batches`` (0: all); returns how many ran.

    The run stops before the batch that would be one too many. That batch is not
    committed, so the next run with the same checkpoint starts with it.
    """
    done = 0

    def step(batch: DataFrame, batch_id: int) -> None:
        nonlocal done
        if max_batches and done >= max_batches:
            raise InterruptedError(_STOP)
        each_batch(batch, batch_id)
        done += 1

    query = (
        stream.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    try:
        query.awaitTermination()
    except StreamingQueryException as error:
        if _STOP not in str(error):
            raise
    return done


def ingest_pages(
    store: TableStore, pages: DataFrame, genre_payloads: DataFrame, checkpoint: str, now: Moment,
    max_batches: int = 0,
) -> int:
    """Catalogue sync per batch of landed pages.

    Titles that are stored already are skipped and the merge can be repeated, so a batch
    that runs twice after a failure leaves the same tables.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        catalog_sync(store, batch, genre_payloads, now)

    return run_available(pages, checkpoint, save, max_batches)


def ingest_landed(
    store: TableStore, path: str, genre_payloads: DataFrame, progress: str, now: Moment, max_pages: int = 0,
    pages_per_batch: int = 100,
) -> int:
    """Catalogue sync of landed pages, exactly ``max_pages`` of them (0: all) where as many are left; returns how many.

    Each batch is saved, then its places are added to the folder ``progress``, so the next run goes on after the last
    saved page and a batch that fails comes again. One run at a time works on a progress folder.

    The first batch takes ``pages_per_batch`` pages, each later one as many as the run has saved before it. A merge
    rewrites the buckets that it touches, so with batches of one size the cost would grow with the square of the pages.
    """
    spark, done = store.spark, 0
    places = landed.progress_table(spark, progress)
    batch = (places.agg(F.max("batch")).first()[0] or 0) + 1
    totals, held = {}, {}
    while not max_pages or done < max_pages:
        most = max(pages_per_batch, done)
        most = min(most, max_pages - done) if max_pages else most
        files = landed.pending_files(spark, path, landed.progress_table(spark, progress), min(most, landed.FILES))
        if not files:
            break
        totals |= landed.counted(spark, path, [f.file for f in files if f.file not in totals])
        saved = landed.reached(totals, files, most)
        unread = [file for file, _, _ in saved if totals[file] and file not in held]
        if unread:
            held |= dict.fromkeys(unread, landed.numbered(spark, path, unread))
        taken = sum(to - f.taken for f, (_, to, _) in zip(files, saved))
        if taken:
            frames = {id(held[file]): held[file] for file, _, _ in saved if file in held}.values()
            pages = landed.between(reduce(DataFrame.unionByName, frames), files, saved)
            catalog_sync(store, parse_payloads(pages, schemas.LISTING_PAGE), genre_payloads, now)
        landed.commit(spark, progress, batch, saved)
        done, batch = done + taken, batch + 1
        # of the files that were read only those with pages left are needed again
        for file in [file for file, _, whole in saved if whole]:
            held.pop(file, None)
    return done


def plan_stream(
    store: TableStore, arriving: DataFrame, checkpoint: str, now: Moment, output: str
) -> int:
    """Writes the action of each arriving candidate, judged by the tables of that moment.

    Each batch has its own folder, which a repeated batch overwrites.
    """

    def plan(batch: DataFrame, batch_id: int) -> None:
        plan_stored(store, batch, now).write.mode("overwrite").parquet(f"{output}/batch={batch_id}")

    return run_available(arriving, checkpoint, plan)
