"""Request cooldown: a request is accepted when it comes at least the cooldown after
the last accepted request for the same title.

Acceptance depends on the last accepted request, so one title is a chain in time. Titles
with a bounded number of distinct request times are folded as one sorted array each.
A title with more of them is split:

* Cut time into windows as long as the cooldown, and every window into cells, the same way in all windows. Cells at
  the same place form a column. Cells are cut at quantiles of the requests' places in their windows, so a
  burst is cut as finely as requests that are spread, and a column holds about the same part of a title.
* After an accepted request the next one comes from the same column of the next window,
  or it is the first request of some later cell. So a chain can enter a column only at
  the first request of a cell, and every column can be followed on its own task from
  each of these entries until the chain leaves the column.
* What is left per title is one row per cell, whose number is bounded by the covered time
  and not by the number of requests. The walk over these rows finds the entries that the
  real chain uses, and a second pass over the columns lists the accepted requests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titleflow.functions import dates
from titleflow.functions.dates import Moment
from titleflow.session import written

HOUR = 3_600_000_000
COOLDOWN = dates.COOLDOWN_HOURS * HOUR
# distinct times above which a title is split, the times a column is meant for, and the finest cut into columns
HOT_REQUESTS = 100_000
COLUMN = 25_000
FINEST = 4096

QUEUED, ON_COOLDOWN, NOT_FOUND = "queued", "cooldown", "not_found"

ACCEPTED = "movie_id string, micros bigint"


def _window(micros: Column, length: int = COOLDOWN) -> Column:
    """Number of the time window; exact, also for times before 1970."""
    return ((micros - F.pmod(micros, F.lit(length))) / length).cast("bigint")


def accepted_times(
    distinct_times: DataFrame, cooldown: int = COOLDOWN, hot_requests: int = HOT_REQUESTS, column: int = COLUMN
) -> DataFrame:
    """``(movie_id, micros)`` of the accepted ones among distinct request times.

    A large title has a column per ``column`` times, by its own count, up to ``FINEST`` columns.
    """
    sizes = distinct_times.groupBy("movie_id").agg(F.count(F.lit(1)).alias("n"))
    hot = sizes.filter(F.col("n") > hot_requests)
    if hot.isEmpty():
        return _fold(distinct_times, cooldown)
    folded = _fold(distinct_times.join(hot.select("movie_id"), "movie_id", "left_anti"), cooldown)
    large = distinct_times.join(hot, "movie_id")
    # every title is cut as finely as the largest one needs, and takes as many of the cuts as it needs itself
    finest = min(FINEST, -(-hot.agg(F.max("n")).first()[0] // column))
    shares = [k / finest for k in range(1, finest)] or [1.0]
    cuts = large.groupBy("movie_id").agg(
        F.percentile_approx(F.pmod("micros", F.lit(cooldown)), shares, 10 * finest).alias("all"), F.first("n").alias("n"))
    wanted = F.least(F.lit(finest), F.ceil(F.col("n") / column)).cast("int")
    nth = F.transform(F.sequence(F.lit(1), wanted - 1), lambda k: F.element_at("all", F.floor(k * finest / wanted).cast("int")))
    cuts = cuts.withColumn("cuts", F.when(wanted > 1, nth).otherwise(F.array().cast("array<bigint>")))
    edges = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0).cast("bigint")), "cuts", F.array(F.lit(cooldown).cast("bigint")))))
    return folded.unionByName(_split_chain(large.join(cuts.select("movie_id", edges.alias("edges")), "movie_id"), cooldown))


def _fold(times: DataFrame, cooldown: int) -> DataFrame:
    """Accepted times per title by one pass over its sorted times."""
    nothing = F.array().cast("array<bigint>")
    start = F.struct(F.lit(None).cast("bigint").alias("last"), nothing.alias("kept"))

    def step(state: Column, t: Column) -> Column:
        due = state["last"].isNull() | (t >= state["last"] + cooldown)
        return F.when(
            due, F.struct(t.alias("last"), F.concat(state["kept"], F.array(t)).alias("kept"))
        ).otherwise(state)

    return (
        times.groupBy("movie_id")
        .agg(F.sort_array(F.collect_list("micros")).alias("times"))
        .select("movie_id", F.explode(F.aggregate("times", start, step, lambda s: s["kept"])).alias("micros"))
    )


def _split_chain(times: DataFrame, cooldown: int) -> DataFrame:
    """Accepted times of titles that are too large for one group."""
    offset = F.pmod("micros", F.lit(cooldown))
    column = F.size(F.filter("edges", lambda edge: edge <= offset))
    placed = times.select("movie_id", "micros", column.alias("column"), F.element_at("edges", column + 1).alias("ends"))
    follow, walk, trace = _column_functions(cooldown)
    groups = ["movie_id", "column"]
    entries = placed.groupBy(*groups).applyInPandas(
        follow, "movie_id string, entry bigint, leaves bigint, ends bigint"
    )
    used = entries.groupBy("movie_id").applyInPandas(walk, ACCEPTED)
    marked = placed.join(used.withColumn("used", F.lit(True)), ["movie_id", "micros"], "left")
    return marked.groupBy(*groups).applyInPandas(trace, ACCEPTED)


def _column_functions(cooldown: int):
    """Functions over sorted request times; numpy arrays of one column or of one title."""

    def chain_links(pdf):
        """Sorted times, their windows, and for each time the next one in its column, or their number."""
        import numpy as np

        t = np.sort(pdf["micros"].to_numpy())
        window = t // cooldown
        following = np.searchsorted(t, t + cooldown)
        inside = following < len(t)
        stays = np.zeros(len(t), dtype=bool)
        stays[inside] = window[following[inside]] == window[inside] + 1
        return t, window, np.where(stays, following, len(t))

    def reached(link, starts):
        """All places that links lead to from the starts; the reach doubles with every round."""
        import numpy as np

        seen = np.zeros(len(link) + 1, dtype=bool)
        seen[starts] = True
        jump = np.append(link, len(link))
        while (jump[:-1] < len(link)).any():
            seen[jump[seen]] = True
            jump = jump[jump]
        return np.flatnonzero(seen[:-1])

    def follow(pdf):
        """For the first request of every cell, the last request before the chain leaves, and the cell's end."""
        import numpy as np
        import pandas as pd

        t, window, link = chain_links(pdf)
        end = np.where(link < len(t), link, np.arange(len(t)))
        while (end[end] != end).any():
            end = end[end]
        first = np.flatnonzero(np.r_[True, window[1:] != window[:-1]])
        return pd.DataFrame({
            "movie_id": pdf["movie_id"].iloc[0], "entry": t[first], "leaves": t[end[first]], "ends": pdf["ends"].iloc[0],
        })

    def walk(pdf):
        """The entries that the chain from the title's first request really uses.

        Leaving a column at ``leaves`` means that its cell one window later holds nothing
        late enough, so the next entry is the first one behind that cell.
        """
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("entry")
        entry = pdf["entry"].to_numpy()
        following = np.searchsorted(entry, (pdf["leaves"].to_numpy() // cooldown + 1) * cooldown + pdf["ends"].to_numpy())
        used = entry[reached(following, [0])]
        return pd.DataFrame({"movie_id": pdf["movie_id"].iloc[0], "micros": used})

    def trace(pdf):
        """All accepted times of a column, from the entries that are used."""
        import numpy as np
        import pandas as pd

        t, _, link = chain_links(pdf)
        starts = np.searchsorted(t, pdf.loc[pdf["used"].notna(), "micros"].to_numpy())
        return pd.DataFrame({"movie_id": pdf["movie_id"].iloc[0], "micros": t[reached(link, starts)].astype("int64")})

    return follow, walk, trace


def gate_requests(
    requests: DataFrame, movies: DataFrame | None, last_requests: DataFrame | None,
    hot_requests: int = HOT_REQUESTS, column: int = COLUMN,
) -> DataFrame:
    """Adds ``status``, ``retry_after_hours`` and ``accepted_at`` to every request.

    ``requests``: ``request_id``, ``movie_id``, ``requested_at``. ``movies`` is the
    catalogue (None: every title exists), ``last_requests`` the stored request table.
    Requests at one time go by ``request_id``; one older than the stored request of its
    title is on cooldown.
    """
    asked = requests.withColumn("micros", F.unix_micros("requested_at"))
    if movies is None:
        asked = asked.withColumn("known", F.lit(True))
    else:
        ids = movies.select(F.col("id").alias("movie_id")).withColumn("known", F.lit(True))
        asked = asked.join(ids, "movie_id", "left")
    if last_requests is None:
        asked = asked.withColumn("prior", F.lit(None).cast("bigint"))
    else:
        stored = last_requests.select("movie_id", F.unix_micros("requested_at").alias("prior"))
        asked = asked.join(stored, "movie_id", "left")

    # copies of one time and what the stored request rules out never reach a fold
    open_times = written(
        asked.filter(
            F.col("known") & (F.col("prior").isNull() | (F.col("micros") >= F.col("prior") + COOLDOWN))
        )
        .groupBy("movie_id", "micros")
        .agg(F.min("request_id").alias("accepted_id")),
        "gate-times",
    )
    accepted = accepted_times(
        open_times.select("movie_id", "micros"), COOLDOWN, hot_requests, column
    )
    return _decisions(asked, accepted.join(open_times, ["movie_id", "micros"]))


def _decisions(asked: DataFrame, accepted: DataFrame) -> DataFrame:
    """Joins every request with the accepted one that governs it.

    A window as long as the cooldown holds at most one accepted request of a title, so
    the governing one is in the request's window or in the window before: an equi-join
    with one match, on a key that splits large titles by time.
    """
    window = _window(F.col("micros"))
    hit = F.struct("micros", F.col("accepted_id").alias("id"))
    none = F.lit(None)
    placed = F.array(
        F.struct(window.alias("window"), hit.alias("here"), none.alias("before")),
        F.struct((window + 1).alias("window"), none.alias("here"), hit.alias("before")),
    )
    governing = (
        accepted.select("movie_id", F.inline(placed))
        .groupBy("movie_id", "window")
        .agg(*[
            F.max(f"{which}.{field}").alias(f"{which}_{field}")
            for which in ("here", "before") for field in ("micros", "id")
        ])
    )
    covered = F.col("here_micros") <= F.col("micros")
    at = F.struct(*[
        F.when(covered, F.col(f"here_{field}")).otherwise(F.col(f"before_{field}")).alias(field)
        for field in ("micros", "id")
    ])
    last = F.coalesce(F.col("__at.micros"), F.col("prior"))
    is_accepted = (F.col("__at.micros") == F.col("micros")) & (
        F.col("__at.id") == F.col("request_id")
    )
    status = (
        F.when(F.col("known").isNull(), NOT_FOUND)
        .when(F.coalesce(is_accepted, F.lit(False)), QUEUED)
        .otherwise(ON_COOLDOWN)
    )
    waits = F.col("status") == ON_COOLDOWN
    return (
        asked.withColumn("window", window)
        .join(governing, ["movie_id", "window"], "left")
        .withColumn("__at", at)
        .withColumn("__last", last)
        .withColumn("status", status)
        .withColumn(
            "retry_after_hours",
            F.when(waits, dates.cooldown_remaining(F.timestamp_micros("__last"), F.col("requested_at"))),
        )
        .withColumn("accepted_at", F.when(~F.col("known").isNull(), F.timestamp_micros("__last")))
        .select(*[c for c in asked.columns if c not in ("micros", "known", "prior")],
                "status", "retry_after_hours", "accepted_at")
    )


def request_table(decisions: DataFrame, last_requests: DataFrame | None) -> DataFrame:
    """The request table after the batch: the latest accepted request of each title."""
    queued = decisions.filter(F.col("status") == QUEUED).select("movie_id", "requested_at")
    if last_requests is not None:
        queued = queued.unionByName(last_requests.select("movie_id", "requested_at"))
    return queued.groupBy("movie_id").agg(F.max("requested_at").alias("requested_at"))


def cooldown_active(requested_at: Column, now: Moment) -> Column:
    """The last request came less than the cooldown ago."""
    return dates.younger_than(requested_at, now, dates.COOLDOWN_HOURS)


def request_eligibility(
    requests: DataFrame, movies: DataFrame, last_requests: DataFrame, now: Moment
) -> DataFrame:
    """Status of each asked title as of ``now``: one lookup per title, nothing recorded."""
    known = movies.select(F.col("id").alias("movie_id")).withColumn("known", F.lit(True))
    stored = last_requests.select("movie_id", F.col("requested_at").alias("last_request"))
    active = cooldown_active(F.col("last_request"), now)
    status = F.when(F.col("known").isNull(), NOT_FOUND).when(active, ON_COOLDOWN).otherwise(QUEUED)
    return (
        requests.join(known, "movie_id", "left")
        .join(stored, "movie_id", "left")
        .withColumn("status", status)
        .withColumn(
            "retry_after_hours",
            F.when(
                F.col("status") == ON_COOLDOWN,
                dates.cooldown_remaining(F.col("last_request"), now),
            ),
        )
        .drop("known", "last_request")
    )
