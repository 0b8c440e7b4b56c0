import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from titleflow.operators import gate
from titleflow.session import work_path
from titleflow.streaming import gate as stream

SIX = dt.timedelta(hours=6)
START = dt.datetime(2024, 1, 1)


def by_hand(requests, prior=None):
    """Statuses by walking all requests of each title in time order."""
    last, out = dict(prior or {}), {}
    for number, title, at in sorted(requests, key=lambda r: (r[2], r[0])):
        if title not in last or at >= last[title] + SIX:
            last[title] = at
            out[number] = "queued"
        else:
            out[number] = "cooldown"
    return out


def frame(spark, requests):
    rows = [(n, t, at.strftime("%Y-%m-%d %H:%M:%S.%f")) for n, t, at in requests]
    raw = spark.createDataFrame(rows, "request_id long, movie_id string, at string")
    return raw.select("request_id", "movie_id", F.col("at").cast("timestamp").alias("requested_at"))


def statuses(decisions):
    return {r.request_id: r.status for r in decisions.collect()}


def random_requests(seed, titles, count, days, step=dt.timedelta(seconds=1)):
    rng = random.Random(seed)
    span = int(dt.timedelta(days=days) / step)
    return [(i, f"m{rng.randrange(titles)}", START + step * rng.randrange(span)) for i in range(count)]


@pytest.mark.parametrize("seed, titles, count, days, columns", [
    (1, 2, 1500, 9, 25), (3, 5, 400, 30, 44), (4, 1, 2500, 2, 2),
])
def test_split_chains_equal_the_walk(spark, seed, titles, count, days, columns):
    requests = random_requests(seed, titles, count, days, dt.timedelta(seconds=61, microseconds=7))
    expected = by_hand(requests)
    asked = frame(spark, requests)
    assert statuses(gate.gate_requests(asked, None, None, hot_requests=0, column=count // columns)) == expected
    assert statuses(gate.gate_requests(asked, None, None)) == expected


def test_a_burst_is_split(spark):
    """Half of the requests of a title come within a fifth of a second."""
    rng = random.Random(8)
    burst = [(i, "m", START + dt.timedelta(hours=7, microseconds=rng.randrange(200_000))) for i in range(2000)]
    requests = burst + [(5000 + n, t, at) for n, t, at in random_requests(9, 1, 800, 5)]
    asked = frame(spark, [(n, "m", at) for n, _, at in requests])
    assert statuses(gate.gate_requests(asked, None, None, hot_requests=0, column=70)) == by_hand([(n, "m", at) for n, _, at in requests])
    times = asked.select("movie_id", F.unix_micros("requested_at").alias("micros")).distinct()
    sizes = []
    split = gate._split_chain
    try:
        gate._split_chain = lambda placed, cooldown: sizes.extend(
            r["count"] for r in placed.select(F.size(F.filter("edges", lambda e: e <= F.pmod("micros", F.lit(cooldown)))).alias("c")).groupBy("c").count().collect()
        ) or split(placed, cooldown)
        gate.accepted_times(times, hot_requests=0, column=70)
    finally:
        gate._split_chain = split
    assert len(sizes) >= 38 and max(sizes) <= 2 * 70


def test_only_hot_titles_are_split(spark):
    requests = random_requests(6, 1, 500, 4) + [(1000 + i, "cold", START + dt.timedelta(hours=2 * i)) for i in range(20)]
    assert statuses(gate.gate_requests(frame(spark, requests), None, None, hot_requests=100)) == by_hand(requests)


def test_bounds_ties_and_times_before_the_epoch(spark):
    old = dt.datetime(1969, 12, 31, 20)
    requests = [(1, "m", START), (2, "m", START), (3, "m", START + SIX - dt.timedelta(microseconds=1)), (4, "m", START + SIX),
                (5, "n", old), (6, "n", old + dt.timedelta(hours=5)), (7, "n", old + SIX)]
    expected = {1: "queued", 2: "cooldown", 3: "cooldown", 4: "queued", 5: "queued", 6: "cooldown", 7: "queued"}
    assert statuses(gate.gate_requests(frame(spark, requests), None, None)) == expected
    assert statuses(gate.gate_requests(frame(spark, requests), None, None, hot_requests=0)) == expected


def test_catalogue_stored_requests_and_waiting_time(spark):
    movies = spark.createDataFrame([("m",), ("n",)], "id string")
    last = frame(spark, [(0, "m", START)]).select("movie_id", "requested_at")
    requests = [(1, "m", START - dt.timedelta(hours=1)), (2, "m", START + dt.timedelta(hours=2, minutes=57)),
                (3, "m", START + SIX), (4, "unknown", START), (5, "n", START)]
    decisions = gate.gate_requests(frame(spark, requests), movies, last)
    rows = {r.request_id: (r.status, r.retry_after_hours) for r in decisions.collect()}
    assert rows == {1: ("cooldown", 7.0), 2: ("cooldown", 3.1), 3: ("queued", None), 4: ("not_found", None), 5: ("queued", None)}
    table = {r.movie_id: r.requested_at for r in gate.request_table(decisions, last).collect()}
    assert table == {"m": START + SIX, "n": START}


def arriving(spark, requests, batches):
    """A stream of the requests, a file per micro-batch."""
    path = work_path(spark, "requests")
    size = -(-len(requests) // batches)
    for i in range(batches):
        frame(spark, requests[i * size:(i + 1) * size]).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema("request_id long, movie_id string, requested_at timestamp").option("maxFilesPerTrigger", 1).parquet(path)


@pytest.mark.parametrize("batches", [1, 4])
def test_stream_equals_batch(spark, batches):
    requests = sorted(random_requests(7, 4, 600, 8), key=lambda r: r[2])
    folder, source = work_path(spark, "gate"), arriving(spark, requests, batches)
    assert stream.gate_stream(source, folder) == batches
    got = stream.decisions(spark, folder)
    assert statuses(got) == by_hand(requests)
    columns = ["request_id", "movie_id", "requested_at", "status", "retry_after_hours", "accepted_at"]
    assert sorted(got.select(columns).collect()) == sorted(gate.gate_requests(frame(spark, requests), None, None).select(columns).collect())
    # nothing new has arrived: a further run decides nothing
    assert stream.gate_stream(source, folder) == 0


def test_state_is_given_up_after_the_cooldown(spark):
    """A hundred titles a day for a week: only those of the last hours are still held."""
    requests = [(100 * d + k, f"m{100 * d + k}", START + dt.timedelta(days=d, minutes=k)) for d in range(7) for k in range(100)]
    folder = work_path(spark, "gate")
    stream.gate_stream(arriving(spark, requests, 7), folder)
    assert stream.decisions(spark, folder).filter("status = 'queued'").count() == 700
    held = {r.movie_id for r in stream.open_state(spark, folder).collect()}
    assert held == {f"m{600 + k}" for k in range(100)}


def test_stream_of_odd_requests(spark):
    """Late ones, ties, unknown titles, and a request table from before the stream: nothing is dropped."""
    movies = spark.createDataFrame([("m",), ("n",), ("o",)], "id string")
    before = frame(spark, [(0, "n", START - dt.timedelta(hours=1))]).select("movie_id", "requested_at")
    hour = dt.timedelta(hours=1)
    requests = [(2, "m", START), (1, "m", START), (3, "n", START), (4, "x", START),
                (5, "m", START + 5 * hour), (6, "n", START + 5 * hour), (7, "m", START - 2 * hour), (8, None, START),
                (9, "o", START + 30 * hour), (10, "m", START + 31 * hour), (11, "o", START - 10000 * hour), (12, "n", START + 10 * hour)]
    folder = work_path(spark, "gate")
    stream.gate_stream(arriving(spark, requests, 3), folder, movies, before)
    got = {r.request_id: (r.status, r.retry_after_hours) for r in stream.decisions(spark, folder).collect()}
    assert got == {1: ("queued", None), 2: ("cooldown", 6.0), 3: ("cooldown", 5.0), 4: ("not_found", None), 5: ("cooldown", 1.0), 6: ("queued", None),
                   7: ("cooldown", 8.0), 8: ("not_found", None), 9: ("queued", None), 10: ("queued", None), 11: ("queued", None), 12: ("cooldown", 1.0)}


def test_titles_of_a_stream_share_state_rows(spark, monkeypatch):
    """Calls and state rows do not rise with the titles; titles of a shard, one of them null, stay apart and expire on their own."""
    monkeypatch.setattr(stream, "SHARDS", 3)
    requests = random_requests(11, 40, 900, 8) + [(10_000 + k, None, START + dt.timedelta(hours=k)) for k in range(20)]
    requests.sort(key=lambda r: r[2])
    folder = work_path(spark, "gate")
    stream.gate_stream(arriving(spark, requests, 5), folder)
    got = stream.decisions(spark, folder)
    columns = ["request_id", "movie_id", "requested_at", "status", "retry_after_hours", "accepted_at"]
    whole = gate.gate_requests(frame(spark, [r for r in requests if r[1]]), None, None)
    assert sorted(got.filter("movie_id IS NOT NULL").select(columns).collect()) == sorted(whole.select(columns).collect())
    nameless = {r.request_id for r in got.filter("movie_id IS NULL AND status = 'queued'").collect()}
    assert nameless == {10_000, 10_006, 10_012, 10_018}
    assert spark.read.format("statestore").load(f"{folder}/checkpoint").count() <= 3
    last = {}
    for _, title, at in requests:
        if title not in last or at - last[title] >= SIX:
            last[title] = at
    newest = max(r[2] for r in requests)
    held = {r.movie_id: r.requested_at for r in stream.open_state(spark, folder).collect()}
    assert held == {m: at for m, at in last.items() if at + SIX + dt.timedelta(hours=stream.LATENESS_HOURS) >= newest}
