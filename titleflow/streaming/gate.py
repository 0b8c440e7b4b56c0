"""Cooldown gate over a stream of requests, with keyed state.

The state store holds the last accepted request of each title and gives it up once the cooldown, and a time that
requests may be late, has passed in event time. So it holds the titles of the last hours, however long the stream runs. Titles
are dealt into a fixed number of shards by hash: a shard is a row of state, which a micro-batch with one of its titles
rewrites. Decisions go to a file sink, which commits a micro-batch once.

Spark drops rows behind the watermark of a stateful operator. No request may be dropped, so the watermark is taken on a
clock that runs a hundred years ahead of the requests, with a delay of as much: it stands at the newest request, and no
request is behind it.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from titleflow.functions import dates
from titleflow.operators.gate import COOLDOWN, NOT_FOUND, ON_COOLDOWN, QUEUED

#: How far ahead the clock of the watermark runs.
AHEAD = "36500 days"
#: Hours by which a request may come after newer ones and still find its title's last request.
LATENESS_HOURS = 1.0


#: Groups of titles with one state row and one call a micro-batch each. A call has a fixed cost of milliseconds, so calls must not
#: rise with the titles. Part of the state's key: a stream keeps the number it was started with.
SHARDS = 4096
#: Stands for no stored request: a column of whole numbers without nulls stays exact.
NEVER = -(2**63)

STATE = "titles array<string>, lasts array<bigint>"


def _decider(lateness: int, cooldown: int = COOLDOWN):
    """Decides the requests of one shard's titles in a micro-batch, each title's in time order."""

    def kept(held: dict, state: GroupState) -> None:
        """Keep the titles that may still be on cooldown, until the first of them is free."""
        now = state.getCurrentWatermarkMs()
        ends = {title: (last + cooldown + lateness) // 1000 + 1 for title, last in held.items()}
        titles = [title for title, end in ends.items() if end > now]
        if titles:
            state.update((titles, [held[title] for title in titles]))
            state.setTimeoutTimestamp(min(ends[title] for title in titles))
        elif state.exists:
            state.remove()

    def decide(key: tuple, frames: Iterator, state: GroupState) -> Iterator:
        from bisect import bisect_left

        import numpy as np
        import pandas as pd

        held = dict(zip(*state.get)) if state.exists else {}
        if state.hasTimedOut:
            kept(held, state)
            return
        # narrow columns of one shard, of one micro-batch
        rows = pd.concat(list(frames), ignore_index=True)
        if rows.empty:
            return
        code, _ = pd.factorize(rows["movie_id"], use_na_sentinel=False)
        order = np.lexsort((rows["request_id"].to_numpy(), rows["micros"].to_numpy(), code))
        rows, code = rows.iloc[order], code[order]
        t, known, prior = rows["micros"].to_numpy(), rows["known"].to_numpy(), rows["prior"].to_numpy()
        first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        names = [None if pd.isna(name) else name for name in rows["movie_id"].iloc[first]]
        times, accepted, before = t.tolist(), [], np.full(len(first), NEVER)
        for k, (name, start, end) in enumerate(zip(names, first.tolist(), [*first[1:].tolist(), len(times)])):
            if not known[start]:
                continue
            last = max(held.get(name, NEVER), int(prior[start]))
            before[k] = last
            at = start if last == NEVER else bisect_left(times, last + cooldown, start, end)
            while at < end:
                accepted.append(at)
                last = times[at]
                at = bisect_left(times, last + cooldown, at, end)
            held[name] = last
        queued = np.zeros(len(t), dtype=bool)
        queued[accepted] = True
        # the last accepted request up to each row, of its own title
        group = np.cumsum(np.r_[False, code[1:] != code[:-1]])
        governing = np.maximum.accumulate(np.where(queued, np.arange(len(t)), -1))
        last = np.where(governing >= first[group], t[governing], before[group])
        out = pd.DataFrame({"request_id": rows["request_id"].to_numpy(), "movie_id": rows["movie_id"].to_numpy(), "micros": t})
        out["status"] = np.where(known, np.where(queued, QUEUED, ON_COOLDOWN), NOT_FOUND)
        out["last"] = pd.arrays.IntegerArray(last, last == NEVER)
        kept(held, state)
        yield out

    return decide


def gated(
    requests: DataFrame, movies: DataFrame | None = None, stored: DataFrame | None = None, lateness_hours: float = LATENESS_HOURS
) -> DataFrame:
    """A stream of decisions: ``request_id, movie_id, requested_at, status, retry_after_hours, accepted_at``.

    ``requests``: a stream of ``request_id, movie_id, requested_at``, in micro-batches that follow each other in time, but for
    requests that are late by ``lateness_hours`` at most. ``movies``: the catalogue (None: every title exists);
    ``stored``: the request table before the stream. Within a micro-batch requests go by time, then by id; one older than its
    title's last accepted request is on cooldown. A request that is later than that is decided too, but may find its title
    free again. A task holds the times and ids of one shard of titles of one micro-batch; the source's ``maxFilesPerTrigger`` or
    ``maxBytesPerTrigger`` bounds them.
    """
    rows = requests.select("request_id", "movie_id", F.unix_micros("requested_at").alias("micros"),
                           (F.col("requested_at") + F.expr(f"interval {AHEAD}")).alias("clock")).withWatermark("clock", AHEAD)
    if movies is None:
        rows = rows.withColumn("known", F.lit(True))
    else:
        ids = movies.select(F.col("id").alias("movie_id"), F.lit(True).alias("known"))
        rows = rows.join(ids, "movie_id", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    if stored is None:
        rows = rows.withColumn("prior", F.lit(NEVER))
    else:
        before = stored.select("movie_id", F.unix_micros("requested_at").alias("prior"))
        rows = rows.join(before, "movie_id", "left").withColumn("prior", F.coalesce("prior", F.lit(NEVER)))
    id_type = dict(requests.dtypes)["request_id"]
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("movie_id"), F.lit(SHARDS)))
    decided = rows.groupBy("shard").applyInPandasWithState(
        _decider(int(lateness_hours * 3_600_000_000)),
        f"request_id {id_type}, movie_id string, micros bigint, status string, last bigint", STATE,
        "append", GroupStateTimeout.EventTimeTimeout)
    at, last = F.timestamp_micros("micros"), F.timestamp_micros("last")
    return decided.select(
        "request_id", "movie_id", at.alias("requested_at"), "status",
        F.when(F.col("status") == ON_COOLDOWN, dates.cooldown_remaining(last, at)).alias("retry_after_hours"), last.alias("accepted_at"))


def gate_stream(
    requests: DataFrame, folder: str, movies: DataFrame | None = None, stored: DataFrame | None = None,
    lateness_hours: float = LATENESS_HOURS,
) -> int:
    """Gate what has arrived; decisions land in ``folder/decisions``. Returns how many micro-batches had requests, of the last
    ones that Spark reports on (100 by default)."""
    query = (
        gated(requests, movies, stored, lateness_hours).writeStream.format("parquet")
        .option("path", f"{folder}/decisions").option("checkpointLocation", f"{folder}/checkpoint")
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return sum(progress.numInputRows > 0 for progress in query.recentProgress)


def decisions(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/decisions")


def open_state(spark: SparkSession, folder: str) -> DataFrame:
    """``movie_id, requested_at``: what the state store holds, the titles that may still be on cooldown."""
    rows = spark.read.format("statestore").load(f"{folder}/checkpoint")
    held = rows.select(F.inline(F.arrays_zip("value.groupState.titles", "value.groupState.lasts")))
    return held.select(F.col("titles").alias("movie_id"), F.timestamp_micros("lasts").alias("requested_at"))
