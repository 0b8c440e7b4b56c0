"""Catalogue sync: listing pages to new titles with genre names, saved in one batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titleflow.functions.dates import Moment
from titleflow.operators import counts, joins
from titleflow.session import written
from titleflow.sinks import merge
from titleflow.sinks.store import TableStore
from titleflow.sources import listings


def catalogue_batch(pages: DataFrame, genre_payloads: DataFrame) -> DataFrame:
    """Titles of well-formed pages with genre names and their place in the batch.

    ``batch_order`` rises with year, page and position; the later of two rows of one
    title wins.
    """
    titles = listings.listing_titles(listings.well_formed(pages))
    dictionary = listings.genre_dictionary(listings.well_formed(genre_payloads))
    return joins.name_genres(titles, dictionary).withColumns({
        "batch_order": F.struct(-F.coalesce("year", F.lit(0)), "page", "pos"),
        "imdb_id": F.lit(None).cast("string"),
        "imdb_score": F.lit(None).cast("double"),
        "rotten_tomatoes": F.lit(None).cast("int"),
    })


def catalog_sync(
    store: TableStore, pages: DataFrame, genre_payloads: DataFrame, now: Moment
) -> DataFrame:
    """Save the titles that are new; returns one row of counters, with malformed pages as errors.

    Known titles are left alone, so a page that is delivered twice changes nothing. Pages are parsed once, on the way
    into the batch; that pass also counts the malformed ones.
    """
    pages, seen = counts.observed_payloads(pages)
    batch = written(catalogue_batch(pages, genre_payloads), "catalogue-batch")
    touched = store.touched(batch, "id")
    before = store.rows_of("movies", batch, "id", touched).select("id")
    counted = counts.catalogue_counters(batch, before).withColumn("errors", F.lit(seen.get["errors"]).cast("bigint")).collect()
    fresh = merge.last_wins(joins.new_titles(batch, before), "id", "batch_order")
    store.save_movies(fresh, now)
    return store.spark.createDataFrame(counted, "pages bigint, discovered bigint, saved bigint, skipped bigint, errors bigint")
