"""Landed pages in runs: how many batches a run needs, and files that are read in splits."""

import os
from types import SimpleNamespace

import pytest

from titleflow.session import work_path
from titleflow.streaming import ingest, landed


def land(path, name, lines):
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/{name}", "w") as out:
        out.write("\n".join(lines) + "\n")


@pytest.fixture
def batches(monkeypatch):
    """The pages of each batch, in place of the catalogue sync; a page has its number as year."""
    taken = []
    monkeypatch.setattr(ingest, "catalog_sync", lambda store, pages, genres, now: taken.append(
        [r.year for r in pages.select("year").collect()]))
    return taken


def test_batches_of_a_run_grow_with_what_is_saved(spark, batches):
    """Every merge rewrites the tables, so their number must not rise with the number of pages."""
    path, progress = work_path(spark, "landed"), work_path(spark, "progress")
    land(path, "a.json", [f'{{"year": {n}}}' for n in range(70)])
    land(path, "b.json", [f'{{"year": {n}}}' for n in range(70, 100)])
    store = SimpleNamespace(spark=spark)
    assert ingest.ingest_landed(store, path, None, progress, None, max_pages=64, pages_per_batch=1) == 64
    assert [len(b) for b in batches] == [1, 1, 2, 4, 8, 16, 32]
    assert ingest.ingest_landed(store, path, None, progress, None, pages_per_batch=20) == 36
    assert [len(b) for b in batches[7:]] == [20, 16]
    assert sorted(sum(batches, [])) == list(range(100))


def test_pages_of_a_file_in_splits_are_numbered_in_order(spark):
    path = work_path(spark, "landed")
    land(path, "a.json", [line for n in range(500) for line in (f"page {n}", " ")])
    land(path, "b.json", ["one"])
    land(path, "none.json", [""])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        names = [r.file for r in landed.pending_files(spark, path, landed.progress_table(spark, path + "-none"), 9)]
        pages = landed.numbered(spark, path, names)
        assert sorted(landed.counted(spark, path, names).values()) == [0, 1, 500]
        found = sorted((r.n, r.value) for r in pages.collect() if r.value != "one")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found == [(n + 1, f"page {n}") for n in range(500)]
