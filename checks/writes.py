"""Table maintenance, migration and the composed jobs, through stored tables."""

import datetime as dt

from pyspark.sql import functions as F

from checks.bindings import (
    DOC_TITLES, GENRES, MOVIES, POINTS, REQUESTS, SUMMARIES, THEMES, TURNS,
    ctes, joined, query, sql_time, stored_movies, table,
)
from checks.inputs import GENRE_SQL, LEGACY_SQL, genre_payload, pack_pages, wide_movies
from checks.planning import PLANNED, STORED_REQUESTS, stored_movies_all, stored_requests
from checks.reviews import PREPARED
from titleflow.functions import dates
from titleflow.operators import gate, joins, lists
from titleflow.plans import catalog_sync, migrate, requests, review_sync, seam
from titleflow.session import work_path
from titleflow.sinks import constraints, merge
from titleflow.sinks.store import TableStore
from titleflow.sources import listings, registry

WRITTEN = dt.datetime(2024, 5, 1)
WRITTEN_SQL = "'2024-05-01T00:00:00Z'"


def new_store(spark):
    return TableStore(spark, work_path(spark, "store"), buckets=4)


def movie_columns(movies):
    return movies.select(
        "id", "tmdb_id", "title", "popularity", "imdb_score", "overview",
        dates.rfc3339(F.col("release_date")).alias("release_date"),
        dates.rfc3339(F.col("last_updated")).alias("last_updated"),
    )


MOVIE_SQL = f"""id, tmdb_id, title, popularity, imdb_score, overview,
    {sql_time('release_date')} AS release_date, {sql_time('last_updated')} AS last_updated"""
BATCH_SQL = """batch AS (SELECT 'tmdb_' || o_orderkey * 2 AS id, o_orderkey * 2 AS tmdb_id, 'Again ' || o_custkey AS title,
    NULL AS popularity, 5.5::DOUBLE AS imdb_score, NULL AS overview, o_orderdate AS release_date FROM orders WHERE o_orderstatus = 'P')"""


def batch_movies(spark, d):
    """New versions of some movies and some new movies: ids are unique."""
    return table(spark, d, "orders").filter("o_orderstatus = 'P'").select(
        F.expr("'tmdb_' || o_orderkey * 2").alias("id"), F.expr("o_orderkey * 2").alias("tmdb_id"),
        F.lit(None).cast("string").alias("imdb_id"), F.expr("'Again ' || o_custkey").alias("title"),
        F.col("o_orderdate").cast("timestamp").alias("release_date"), F.lit(None).cast("string").alias("poster_url"),
        F.lit(None).cast("string").alias("overview"), F.lit(None).cast("double").alias("popularity"),
        F.lit(5.5).alias("imdb_score"), F.lit(None).cast("int").alias("rotten_tomatoes"),
    )


@query("snk1_upsert", f"""
{ctes(MOVIES)}, {BATCH_SQL}
SELECT {MOVIE_SQL} FROM movies ANTI JOIN batch USING (id)
UNION ALL SELECT id, tmdb_id, title, popularity, imdb_score, overview, {sql_time('release_date')}, {WRITTEN_SQL} FROM batch""")
def snk1(spark, d):
    store = new_store(spark)
    store.create("movies", MOVIES.frame(spark, d))
    store.upsert("movies", merge.movie_rows(batch_movies(spark, d), WRITTEN))
    return movie_columns(store.read("movies"))


@query("snk1_keep_non_null", f"""
{ctes(MOVIES)}, {BATCH_SQL}
SELECT id, coalesce(b.tmdb_id, m.tmdb_id) AS tmdb_id, coalesce(b.title, m.title) AS title,
    coalesce(b.popularity, m.popularity) AS popularity, coalesce(b.imdb_score, m.imdb_score) AS imdb_score,
    coalesce(b.overview, m.overview) AS overview, {sql_time('coalesce(b.release_date, m.release_date)')} AS release_date,
    CASE WHEN b.id IS NULL THEN {sql_time('m.last_updated')} ELSE {WRITTEN_SQL} END AS last_updated
FROM movies m FULL JOIN batch b USING (id)""")
def snk1_keep(spark, d):
    new = merge.movie_rows(batch_movies(spark, d), WRITTEN)
    return movie_columns(merge.upsert(MOVIES.frame(spark, d), new, "id", keep_non_null=True))


LAST_LINE = """last AS (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC,
    l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_quantity DESC, l_tax DESC, l_discount DESC) = 1)"""


def line_batch(spark, d):
    """A batch with many rows per title: one for each order line."""
    return table(spark, d, "lineitem").select(
        F.expr("'tmdb_' || l_orderkey * 2").alias("id"), F.expr("l_orderkey * 2").alias("tmdb_id"),
        F.lit("").alias("imdb_id"), F.expr("'Line ' || l_linenumber").alias("title"),
        F.col("l_shipdate").cast("timestamp").alias("release_date"), F.lit("").alias("poster_url"),
        F.lit("").alias("overview"), F.col("l_extendedprice").alias("popularity"),
        F.lit(None).cast("double").alias("imdb_score"), F.lit(None).cast("int").alias("rotten_tomatoes"),
        F.array("l_returnflag", F.lit(""), "l_linestatus", "l_returnflag").alias("genres"),
        F.struct(
            "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_tax", "l_discount"
        ).alias("batch_order"),
    )


def batch_store(spark, d):
    store = new_store(spark)
    store.create("movies", MOVIES.frame(spark, d))
    store.create("movie_genres", GENRES.frame(spark, d))
    store.save_movies(line_batch(spark, d), WRITTEN, order="batch_order")
    return store


@query("snk2_batch_upsert", f"""
{ctes(MOVIES)}, {LAST_LINE}, batch AS (SELECT 'tmdb_' || l_orderkey * 2 AS id, * FROM last)
SELECT id, title, popularity, {sql_time('last_updated')} AS last_updated FROM movies ANTI JOIN batch USING (id)
UNION ALL SELECT id, 'Line ' || l_linenumber, l_extendedprice, {WRITTEN_SQL} FROM batch""")
def snk2(spark, d):
    return batch_store(spark, d).read("movies").select(
        "id", "title", "popularity", dates.rfc3339(F.col("last_updated")).alias("last_updated")
    )


@query("snk2_batch_genres", f"""
{ctes(GENRES)}, {LAST_LINE}, batch AS (SELECT 'tmdb_' || l_orderkey * 2 AS movie_id, * FROM last)
SELECT movie_id, genre FROM movie_genres ANTI JOIN batch USING (movie_id)
UNION ALL SELECT movie_id, l_returnflag FROM batch UNION ALL SELECT movie_id, l_linestatus FROM batch""")
def snk2_genres(spark, d):
    return batch_store(spark, d).read("movie_genres")


@query("snk3_replace_children", f"""
{ctes(POINTS)}, touched AS (SELECT 'tmdb_' || o_orderkey AS movie_id, o_custkey FROM orders WHERE o_orderstatus = 'P'),
after AS (SELECT movie_id, type, ordinal, content FROM movie_points ANTI JOIN touched USING (movie_id)
    UNION ALL SELECT movie_id, 'pro', 0, 'new ' || o_custkey FROM touched WHERE o_custkey % 2 = 0)
SELECT movie_id, type, ordinal, content, count(*) AS n FROM after GROUP BY ALL""")
def snk3(spark, d):
    store = new_store(spark)
    store.create("movie_points", POINTS.frame(spark, d))
    touched = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(
        F.expr("'tmdb_' || o_orderkey").alias("movie_id"), "o_custkey"
    )
    new = touched.filter("o_custkey % 2 = 0").select(
        "movie_id", F.lit("pro").alias("type"), F.lit(0).cast("bigint").alias("ordinal"),
        F.expr("'new ' || o_custkey").alias("content"),
    )
    store.replace_children("movie_points", touched, new)
    return store.read("movie_points").groupBy("movie_id", "type", "ordinal", "content").agg(
        F.count(F.lit(1)).alias("n")
    )


@query("snk4_genre_rows", """
SELECT DISTINCT 'tmdb_' || l_orderkey * 2 AS movie_id, genre FROM
    (SELECT l_orderkey, l_returnflag AS genre FROM lineitem UNION ALL SELECT l_orderkey, l_linestatus FROM lineitem)""")
def snk4(spark, d):
    return merge.genre_rows(line_batch(spark, d))


@query("snk5_save_summaries", """
WITH s AS (SELECT 'tmdb_' || p_partkey AS movie_id, string_split(p_name, ' ') AS pros, p_type, p_brand FROM part),
rows AS (SELECT movie_id, 'pro' AS kind, unnest(range(0, len(pros))) AS ordinal, unnest(pros) AS content FROM s
    UNION ALL SELECT movie_id, 'con', len(pros) + 1, p_type FROM s
    UNION ALL SELECT movie_id, 'theme', unnest([0, 1]), p_brand FROM s
    UNION ALL SELECT movie_id, 'summary', 90, 'ok' FROM s)
SELECT * FROM rows""")
def snk5(spark, d):
    store = new_store(spark)
    saved = table(spark, d, "part").select(
        F.expr("'tmdb_' || p_partkey").alias("movie_id"), F.lit(90).alias("overall_sentiment"),
        F.lit("ok").alias("audience_consensus"), F.lit("").alias("recommendation"), F.lit(3).alias("review_count"),
        F.split("p_name", " ").alias("pros"), F.array(F.lit(""), "p_type").alias("cons"),
        F.array("p_brand", "p_brand", F.lit("")).alias("themes"),
    )
    store.save_summaries(saved, WRITTEN)
    points = store.read("movie_points").select("movie_id", F.col("type").alias("kind"), "ordinal", "content")
    themes = store.read("movie_themes").select("movie_id", F.lit("theme").alias("kind"), "ordinal", F.col("theme").alias("content"))
    rows = store.read("movie_summaries").select(
        "movie_id", F.lit("summary").alias("kind"), F.col("overall_sentiment").cast("bigint").alias("ordinal"),
        F.col("audience_consensus").alias("content"),
    )
    return points.unionByName(themes).unionByName(rows)


@query("snk6_latest_requests", f"""
{ctes(REQUESTS)}, {STORED_REQUESTS}, newest AS (SELECT movie_id, max(requested_at) AS requested_at FROM requests GROUP BY 1)
SELECT movie_id, strftime(requested_at, '%Y-%m-%d %H:%M:%S') AS requested_at FROM
    (SELECT * FROM last ANTI JOIN newest USING (movie_id) UNION ALL SELECT * FROM newest)""")
def snk6(spark, d):
    store = new_store(spark)
    store.create("review_requests", stored_requests(spark, d))
    store.save_requests(REQUESTS.frame(spark, d))
    return store.read("review_requests").select(
        "movie_id", F.date_format("requested_at", "yyyy-MM-dd HH:mm:ss").alias("requested_at")
    )


@query("snk7_migration", f"""
{LEGACY_SQL}, {POINTS.cte}, {THEMES.cte},
p AS (SELECT movie_id, string_agg(type || ' ' || content, ' | ' ORDER BY ordinal, type || ' ' || content) AS points
    FROM movie_points WHERE type IN ('pro', 'con') GROUP BY 1),
t AS (SELECT movie_id, string_agg(theme, ' | ' ORDER BY ordinal, theme) AS themes FROM movie_themes GROUP BY 1)
SELECT movie_id, overall_sentiment, review_count, coalesce(points, '') AS points, coalesce(themes, '') AS themes,
    (SELECT count(*) FROM kept) AS migrated FROM kept LEFT JOIN p USING (movie_id) LEFT JOIN t USING (movie_id)""")
def snk7(spark, d):
    store = new_store(spark)
    counted = migrate.migrate_summaries(
        store, wide_movies(spark, d), POINTS.frame(spark, d), THEMES.frame(spark, d), WRITTEN
    )
    points = store.read("movie_points").select(
        "movie_id", "ordinal", F.concat_ws(" ", "type", "content").alias("theme")
    )
    found = store.read("movie_summaries").select("movie_id", "overall_sentiment", "review_count")
    for name, rows in (("points", points), ("themes", store.read("movie_themes"))):
        listed = lists.theme_lists(rows).select("movie_id", joined("themes").alias(name))
        found = found.join(listed, "movie_id", "left").withColumn(name, F.coalesce(name, F.lit("")))
    return found.withColumn("migrated", counted.select("migrated").scalar())


@query("snk8_violations", f"""
{ctes(MOVIES, SUMMARIES, POINTS)}, lines AS (SELECT 'tmdb_' || l_orderkey AS movie_id, l_returnflag AS genre FROM lineitem)
SELECT 'movie_genres' AS table_name, 'unique(movie_id,genre)' AS rule, movie_id || '|' || genre AS row_key, count(*) AS row_count
    FROM lines GROUP BY movie_id, genre HAVING count(*) > 1
UNION ALL SELECT 'movie_points', 'in_list(type)', movie_id, count(*) FROM movie_points WHERE type = 'note' GROUP BY movie_id
UNION ALL SELECT 'movie_points', 'references(movie_summaries)', movie_id, count(*)
    FROM movie_points ANTI JOIN movie_summaries USING (movie_id) GROUP BY movie_id
UNION ALL SELECT 'movies', 'not_null(last_updated)', id, count(*) FROM movies WHERE release_date IS NULL GROUP BY id""")
def snk8(spark, d):
    movies = MOVIES.frame(spark, d)
    lines = table(spark, d, "lineitem").select(
        F.expr("'tmdb_' || l_orderkey").alias("movie_id"), F.col("l_returnflag").alias("genre")
    )
    return constraints.violations({
        "movies": movies.withColumn("last_updated", F.when(F.col("release_date").isNotNull(), F.col("last_updated"))),
        "movie_genres": lines, "movie_summaries": SUMMARIES.frame(spark, d), "movie_points": POINTS.frame(spark, d),
    })


# --- composed jobs ------------------------------------------------------------


@query("job5_catalog_sync", f"""
WITH n AS (SELECT n_nationkey AS k, {GENRE_SQL} AS name FROM nation)
SELECT 'tmdb_' || p_partkey AS id, p_name AS title, p_retailprice AS popularity,
    CASE WHEN b.name IS NULL OR b.name = a.name THEN a.name ELSE least(a.name, b.name) || ' | ' || greatest(a.name, b.name) END AS genres,
    '2024-05-01T00:00:00Z' AS last_updated
FROM part JOIN n a ON a.k = p_size % 25 LEFT JOIN n b ON b.k = p_partkey % 30
WHERE p_partkey NOT IN (SELECT s_suppkey FROM supplier)
UNION ALL SELECT 'tmdb_' || s_suppkey, s_name, s_acctbal, '', '2020-01-01T00:00:00Z' FROM supplier""")
def job5(spark, d):
    store = catalogue_store(spark, d)
    run_catalogue(spark, d, store)
    return catalogue_rows(store)


def catalogue_store(spark, d):
    """Suppliers as the titles that are known already."""
    store = new_store(spark)
    known = table(spark, d, "supplier").select(
        F.expr("'tmdb_' || s_suppkey").alias("id"), F.col("s_suppkey").alias("tmdb_id"),
        F.col("s_name").alias("title"), F.col("s_acctbal").alias("popularity"),
        F.lit("2020-01-01").cast("timestamp").alias("last_updated"),
        *[F.lit(None).alias(c) for c in (
            "imdb_id", "release_date", "poster_url", "overview", "imdb_score", "rotten_tomatoes")],
    )
    store.create("movies", known)
    return store


def run_catalogue(spark, d, store):
    pages = listings.read_listing(spark, pack_pages(spark, d))
    genres = genre_payload(spark, d).withColumn("_corrupt_record", F.lit(None).cast("string"))
    return catalog_sync.catalog_sync(store, pages, genres, WRITTEN)


def catalogue_rows(store):
    found = joins.with_genres(store.read("movies"), store.read("movie_genres"))
    return found.select(
        "id", "title", "popularity", joined("genres").alias("genres"),
        dates.rfc3339(F.col("last_updated")).alias("last_updated"),
    )


def sync_store(spark, d):
    """Labelled documents are stored, with their summaries and children."""
    store = new_store(spark)
    titles = DOC_TITLES.frame(spark, d).select("id", "tmdb_id", "title", "overview", "release_date")
    nothing = [F.lit(None).alias(c) for c in ("imdb_id", "poster_url", "popularity", "imdb_score", "rotten_tomatoes")]
    store.create("movies", stored_movies(spark, d).join(titles, "id").select("*", *nothing))
    store.create("movie_summaries", SUMMARIES.frame(spark, d))
    store.create("movie_points", POINTS.frame(spark, d))
    store.create("movie_themes", THEMES.frame(spark, d))
    return store


SYNC_NOW = dt.datetime(2024, 1, 3)
SYNC_POOL = f"""{PLANNED},
pool AS (SELECT * FROM planned WHERE n_chars >= 20
    AND TIMESTAMP '2023-09-01 00:00:00' + INTERVAL 1 DAY * (doc_id % 200)::INT >= TIMESTAMP '2023-10-03 00:00:00'
    ORDER BY n_chars DESC, id LIMIT 100),
ranked AS (SELECT *, row_number() OVER (ORDER BY n_chars DESC, id) AS rank FROM pool)"""


def sync_batch(limit: int, where: str = "TRUE") -> str:
    return f"""walk AS (SELECT * FROM ranked WHERE {where}),
work AS (SELECT * FROM walk WHERE action <> 'skip' ORDER BY rank LIMIT {limit}),
skips AS (SELECT count(*) AS n FROM walk WHERE action = 'skip'
    AND (rank < (SELECT max(rank) FROM work) OR (SELECT count(*) FROM work) < {limit}))"""


def sync_inputs(spark, d, summarise):
    turns = registry.Sources().add_reviews("turns", lambda s: TURNS.frame(s, d))
    return review_sync.Inputs(DOC_TITLES.frame(spark, d), turns, summarise=summarise)


@query("job3_review_sync", f"""
{SYNC_POOL}, {sync_batch(40)}
SELECT (SELECT count(*) FROM pool) AS discovered, (SELECT count(*) FROM work) AS processed,
    (SELECT n FROM skips) AS skipped, 0 AS failed""")
def job3(spark, d):
    return run_sync(spark, d)[1].counters


def run_sync(spark, d):
    store = sync_store(spark, d)
    outcome = review_sync.review_sync(
        store, sync_inputs(spark, d, seam.stub_reply()), SYNC_NOW, 40, review_sync.Settings(months=3)
    )
    return store, outcome


@query("job3_saved_movies", f"""
{SYNC_POOL}, {sync_batch(40)}
SELECT id, NULL AS popularity, {sql_time('last_updated')} AS last_updated FROM stored ANTI JOIN work USING (id)
UNION ALL SELECT id, n_chars::DOUBLE, '2024-01-03T00:00:00Z' FROM work""")
def job3_movies(spark, d):
    return run_sync(spark, d)[0].read("movies").select(
        "id", "popularity", dates.rfc3339(F.col("last_updated")).alias("last_updated")
    )


@query("job3_saved_summaries", f"""
{SYNC_POOL}, {sync_batch(40)}, {TURNS.cte},
arrived AS (SELECT movie_id, id, source, content, score, ordinal, 0 AS source_rank FROM turns), {PREPARED},
found AS (SELECT movie_id, count(*) AS n FROM best GROUP BY 1),
redone AS (SELECT work.id AS movie_id, doc_id, coalesce(n, 0) AS n FROM work LEFT JOIN found ON movie_id = work.id WHERE action = 'full')
SELECT movie_id, overall_sentiment, review_count FROM ({ctes(SUMMARIES)} SELECT * FROM movie_summaries) ANTI JOIN redone USING (movie_id)
UNION ALL SELECT movie_id, CASE WHEN n > 0 OR doc_id % 2 = 1 THEN least(50 + n, 100) END, n FROM redone""")
def job3_summaries(spark, d):
    return run_sync(spark, d)[0].read("movie_summaries").select(
        "movie_id", "overall_sentiment", "review_count"
    )


TARGET = "(SELECT min(id) FROM stored)"


@query("job4_targeted_sync", f"""
{SYNC_POOL}, {sync_batch(24, f"id <> {TARGET}")}
SELECT (SELECT count(*) FROM pool) AS discovered, 1 + (SELECT count(*) FROM work) AS processed,
    (SELECT n FROM skips) AS skipped, 0 AS failed""")
def job4(spark, d):
    store = sync_store(spark, d)
    target = store.read("movies").agg(F.min("id")).first()[0]
    outcome = review_sync.targeted_sync(
        store, sync_inputs(spark, d, seam.stub_reply()), SYNC_NOW, target, 25, review_sync.Settings(months=3)
    )
    return outcome.counters


@query("udf1_summariser", f"""
SELECT 'tmdb_' || doc_id AS movie_id, CASE WHEN doc_id % 10 = 3 THEN NULL ELSE 50 + doc_id % 7 END AS overall_sentiment,
    CASE WHEN doc_id % 10 = 3 THEN 'LLM error for ''' || lang || ''': busy' END AS error FROM documents""")
def udf1(spark, d):
    def summarise(prompt):
        number = int(prompt)
        if number % 10 == 3:
            raise RuntimeError("busy")
        return '{"overall_sentiment": %d}' % (50 + number % 7)

    prompts = table(spark, d, "documents").select(
        F.expr("'tmdb_' || doc_id").alias("movie_id"), F.lit(1).cast("bigint").alias("review_count"),
        F.col("lang").alias("title"), F.col("doc_id").cast("string").alias("prompt"),
    )
    return seam.summaries_of(seam.call_summariser(prompts, summarise)).select(
        "movie_id", "overall_sentiment", "error"
    )


@query("job10_migrate", f"{LEGACY_SQL} SELECT count(*) AS migrated, 0 AS errors FROM kept")
def job10(spark, d):
    return migrate.migrate_summaries(
        new_store(spark), wide_movies(spark, d), POINTS.frame(spark, d), THEMES.frame(spark, d), WRITTEN
    )


# --- request gate ---------------------------------------------------------------


def chain(times: str, start: str, before: str = "") -> str:
    """Recursive SQL that accepts requests at least six hours after the last accepted one."""
    return f"""WITH RECURSIVE {before} t AS ({times}),
acc AS ({start} UNION ALL
    SELECT a.movie_id, min(t.ts) FROM acc a JOIN t ON t.movie_id = a.movie_id AND t.ts >= a.ts + INTERVAL 6 HOURS GROUP BY a.movie_id)"""


EVENT_TIMES = "SELECT 'tmdb_' || user_id AS movie_id, ts, min(event_id) AS id FROM events GROUP BY ALL"
FREE_START = "SELECT movie_id, min(ts) AS ts FROM t GROUP BY 1"
GATE_SQL = f"""{chain(EVENT_TIMES, FREE_START)}
SELECT t.movie_id, t.id AS request_id FROM acc JOIN t USING (movie_id, ts)"""


def accepted(decisions):
    return decisions.filter(F.col("status") == gate.QUEUED).select("movie_id", "request_id")


@query("str3_cooldown_gate", GATE_SQL)
def str3(spark, d):
    return accepted(gate.gate_requests(REQUESTS.frame(spark, d), None, None))


@query("str3_cooldown_gate_split", GATE_SQL)
def str3_split(spark, d):
    """Every title on the path for titles with too many requests for one group."""
    return accepted(gate.gate_requests(REQUESTS.frame(spark, d), None, None, hot_requests=10, column=20))


# the events of a day within a second, seven hours after those of the day before
BURST_TIMES = """SELECT 'tmdb_' || user_id AS movie_id, min(event_id) AS id,
    make_timestamp(1704067200000000 + (s // 86400 - 19723) * 25200000000 + s % 86400 * 11) AS ts
FROM (SELECT user_id % 20 AS user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events) GROUP BY ALL"""


@query("str3_cooldown_gate_burst", f"""{chain(BURST_TIMES, FREE_START)}
SELECT t.movie_id, t.id AS request_id FROM acc JOIN t USING (movie_id, ts)""")
def str3_burst(spark, d):
    """Few titles, whose requests come in bursts, on the path for titles with too many requests for one group."""
    seconds = "CAST(floor(unix_micros(CAST(ts AS TIMESTAMP)) / 1000000) AS BIGINT)"
    micros = f"1704067200000000 + ({seconds} DIV 86400 - 19723) * 25200000000 + {seconds} % 86400 * 11"
    squeezed = table(spark, d, "events").select(
        F.col("event_id").alias("request_id"), F.expr("'tmdb_' || user_id % 20").alias("movie_id"),
        F.expr(f"timestamp_micros({micros})").alias("requested_at"))
    return accepted(gate.gate_requests(squeezed, None, None, hot_requests=10))


PRIOR = STORED_REQUESTS.replace("2024-01-02 17:00:00", "2024-01-05 00:00:00")
KNOWN_TIMES = f"""SELECT movie_id, ts, id FROM ({EVENT_TIMES}) LEFT JOIN last USING (movie_id)
    WHERE movie_id IN (SELECT 'tmdb_' || doc_id FROM labels)
    AND (requested_at IS NULL OR ts >= requested_at + INTERVAL 6 HOURS)"""


@query("job11_gate_requests", f"""
{chain(KNOWN_TIMES, FREE_START, PRIOR + ',')},
asked AS (SELECT event_id AS request_id, 'tmdb_' || user_id AS movie_id, ts FROM events),
governed AS (SELECT request_id, a.movie_id, a.ts, max(acc.ts) AS hit FROM asked a
    LEFT JOIN acc ON acc.movie_id = a.movie_id AND acc.ts <= a.ts GROUP BY ALL),
s AS (SELECT g.*, coalesce(hit, requested_at) AS governing,
    CASE WHEN g.movie_id NOT IN (SELECT 'tmdb_' || doc_id FROM labels) THEN 'not_found'
    WHEN hit = g.ts AND request_id = t.id THEN 'queued' ELSE 'cooldown' END AS status
    FROM governed g LEFT JOIN last USING (movie_id) LEFT JOIN t ON t.movie_id = g.movie_id AND t.ts = g.ts)
SELECT request_id, movie_id, status, CASE WHEN status = 'cooldown' THEN
    floor((6.0::DOUBLE - (epoch_ms(ts) - epoch_ms(governing)) / 3600000.0::DOUBLE) * 10 + 0.5) / 10.0::DOUBLE END AS retry_after_hours
FROM s""")
def job11(spark, d):
    store = new_store(spark)
    nothing = [F.lit(None).alias(c) for c in (
        "imdb_id", "release_date", "poster_url", "overview", "popularity", "imdb_score", "rotten_tomatoes")]
    store.create("movies", stored_movies_all(spark, d).select(
        "id", F.lit(1).alias("tmdb_id"), F.lit("t").alias("title"), F.lit("2020-01-01").cast("timestamp").alias("last_updated"), *nothing
    ))
    store.create("review_requests", stored_requests(spark, d, "2024-01-05 00:00:00"))
    return requests.gate_requests(store, REQUESTS.frame(spark, d)).select(
        "request_id", "movie_id", "status", "retry_after_hours"
    )
