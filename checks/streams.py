"""Structured Streaming runs over files that Spark derives from the driver's tables."""

from pyspark.sql import functions as F

from checks.bindings import DOC_TITLES, EVENTS_NOW, ORACLE, REQUESTS, query
from checks.inputs import genre_payload, pack_pages
from checks.planning import PLANNED
from checks.writes import GATE_SQL, WRITTEN, accepted, catalogue_rows, catalogue_store, sync_store
from titleflow.session import work_path
from titleflow.streaming import gate as gate_streaming
from titleflow.streaming import ingest


def landed_pages(spark, d, files=6):
    """Listing pages spread over several landed files."""
    path = work_path(spark, "landed")
    spark.read.text(pack_pages(spark, d)).repartition(files).write.text(path)
    return path


@query("str1_resumed_ingest", ORACLE["job5_catalog_sync"])
def str1(spark, d):
    """Three runs of at most two batches each, all with one checkpoint."""
    store = catalogue_store(spark, d)
    path, checkpoint = landed_pages(spark, d), work_path(spark, "checkpoint")
    genres = genre_payload(spark, d).withColumn("_corrupt_record", F.lit(None).cast("string"))
    ran = 2
    while ran:
        ran = ingest.ingest_pages(
            store, ingest.page_stream(spark, path, 2), genres, checkpoint, WRITTEN, max_batches=2
        )
    return catalogue_rows(store)


@query("str1_page_limit", ORACLE["job5_catalog_sync"])
def str1_pages(spark, d):
    """Runs of an exact number of pages over files with several pages each."""
    store = catalogue_store(spark, d)
    path, progress = landed_pages(spark, d, 3), work_path(spark, "progress")
    genres = genre_payload(spark, d).withColumn("_corrupt_record", F.lit(None).cast("string"))
    most = spark.read.text(path).count() // 2 + 1
    while ingest.ingest_landed(store, path, genres, progress, WRITTEN, max_pages=most) == most:
        pass
    return catalogue_rows(store)


@query("str5_redelivered_pages", ORACLE["job5_catalog_sync"])
def str5(spark, d):
    """Every page arrives twice; the tables are those of a single delivery."""
    store = catalogue_store(spark, d)
    pages = spark.read.text(pack_pages(spark, d))
    path = work_path(spark, "landed")
    pages.union(pages).repartition(4).write.text(path)
    genres = genre_payload(spark, d).withColumn("_corrupt_record", F.lit(None).cast("string"))
    ingest.ingest_pages(
        store, ingest.page_stream(spark, path, 2), genres, work_path(spark, "checkpoint"), WRITTEN
    )
    return catalogue_rows(store)


@query("str4_candidate_stream", f"{PLANNED} SELECT id, action FROM planned")
def str4(spark, d):
    store = sync_store(spark, d)
    path, output = work_path(spark, "candidates"), work_path(spark, "plans")
    DOC_TITLES.frame(spark, d).select("id", "tmdb_id").repartition(3).write.parquet(path)
    arriving = (
        spark.readStream.schema("id string, tmdb_id bigint").option("maxFilesPerTrigger", 1).parquet(path)
    )
    ingest.plan_stream(store, arriving, work_path(spark, "checkpoint"), EVENTS_NOW, output)
    return spark.read.parquet(output).select("id", "action")


@query("str3_gate_stream", GATE_SQL)
def str3_stream(spark, d):
    """Four batches that follow each other in time."""
    path, folder = work_path(spark, "requests"), work_path(spark, "gate")
    rows = REQUESTS.frame(spark, d)
    for start, end in ((1, 8), (8, 15), (15, 23), (23, 40)):
        day = F.datediff("requested_at", F.lit("2023-12-31"))
        rows.filter((day >= start) & (day < end)).coalesce(1).write.mode("append").parquet(path)
    arriving = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    gate_streaming.gate_stream(arriving, folder)
    return accepted(gate_streaming.decisions(spark, folder))
