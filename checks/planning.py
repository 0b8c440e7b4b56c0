"""Candidates, actions, batch fill, counters, coverage."""

from pyspark.sql import functions as F

from checks.bindings import (
    DOC_TITLES, EVENTS_NOW, EVENTS_NOW_SQL, MOVIES, NOW, NOW_SQL, POINTS, REQUESTS, STORED_MOVIES_CTE,
    SUMMARIES, THEMES, ctes, joined, query, stored_movies, table,
)
from checks.functions import CONTENT_SQL
from checks.inputs import GENRE_SQL, genre_payload, read_pages
from titleflow.operators import browse, candidates, counts, coverage, gate, joins
from titleflow.session import written
from titleflow.sources import listings, registry


@query("flt3_popular_recent", f"""
{ctes(MOVIES)} SELECT id FROM movies WHERE popularity >= 250000.5 AND release_date >= {NOW_SQL}::DATE - INTERVAL 6 MONTHS""")
def flt3(spark, d):
    return candidates.popular_recent(MOVIES.frame(spark, d), NOW, 250000.499, 6).select("id")


@query("flt4_release_year", f"""
{ctes(MOVIES)} SELECT id FROM movies WHERE year(release_date) = 1997""")
def flt4(spark, d):
    return candidates.of_year(MOVIES.frame(spark, d), 1997).select("id")


@query("srt5_feed_order", """
SELECT 'tmdb_' || p_partkey AS id FROM part ORDER BY p_retailprice ASC, id LIMIT 100""")
def srt5(spark, d):
    titles = listings.listing_titles(read_pages(spark, d))
    return titles.orderBy(*candidates.feed_order("popularity.asc")).limit(100).select("id")


@query("win5_candidate_pool", """
SELECT 'tmdb_' || p_partkey AS id, p_retailprice AS popularity FROM part ORDER BY p_retailprice DESC, id LIMIT 60""")
def win5(spark, d):
    pools = registry.Sources().add_candidates("listing", lambda s: listings.listing_titles(read_pages(s, d)))
    return candidates.candidate_pool(pools.candidates(spark, "listing"), 12).select("id", "popularity")


@query("jn1_genre_names", f"""
WITH n AS (SELECT n_nationkey AS k, {GENRE_SQL} AS name FROM nation)
SELECT c_custkey AS id, CASE WHEN b.name IS NULL THEN a.name ELSE a.name || ' | ' || b.name END AS genres
FROM customer JOIN n a ON a.k = c_nationkey LEFT JOIN n b ON b.k = c_custkey % 40""")
def jn1(spark, d):
    titles = table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"),
        F.expr("array(c_nationkey, CAST(c_custkey % 40 AS INT), -1)").alias("genre_ids"),
    )
    named = joins.name_genres(titles, listings.genre_dictionary(genre_payload(spark, d)))
    return named.withColumn("genres", joined("genres"))


@query("jn2_new_titles", """
SELECT 'tmdb_' || doc_id AS id FROM documents ANTI JOIN labels USING (doc_id)""")
def jn2(spark, d):
    return joins.new_titles(DOC_TITLES.frame(spark, d), stored_movies_all(spark, d)).select("id")


def stored_movies_all(spark, d):
    return table(spark, d, "labels").select(F.expr("'tmdb_' || doc_id").alias("id"))


@query("jn3_known_titles", """
SELECT 'tmdb_' || doc_id AS id FROM documents SEMI JOIN labels USING (doc_id)""")
def jn3(spark, d):
    return joins.known_titles(DOC_TITLES.frame(spark, d), stored_movies_all(spark, d)).select("id")


STATE = f"""content AS ({CONTENT_SQL}),
titles AS (SELECT 'tmdb_' || doc_id AS id, n_chars, doc_id FROM documents),
state AS (SELECT id, doc_id, n_chars, s.id IS NOT NULL AS known,
    coalesce(s.last_updated > {EVENTS_NOW_SQL} - INTERVAL 24 HOURS, FALSE) AS fresh,
    coalesce(has_summary, FALSE) AS has_summary
    FROM titles LEFT JOIN stored s USING (id) LEFT JOIN content c ON c.movie_id = titles.id),
planned AS (SELECT *, CASE WHEN fresh AND has_summary THEN 'skip' WHEN has_summary THEN 'metadata_only' ELSE 'full' END AS action
    FROM state)"""
PLANNED = f"WITH {STORED_MOVIES_CTE}, {STATE}"


def content_state(spark, d):
    return joins.summary_state(SUMMARIES.frame(spark, d), POINTS.frame(spark, d), THEMES.frame(spark, d))


@query("summary_state", CONTENT_SQL)
def summary_state(spark, d):
    return content_state(spark, d)


@query("jn10_candidate_state", f"{PLANNED} SELECT id, known, fresh, has_summary FROM state")
def jn10(spark, d):
    state = candidates.candidate_state(
        DOC_TITLES.frame(spark, d), stored_movies(spark, d), content_state(spark, d), EVENTS_NOW
    )
    return state.select("id", "known", "fresh", "has_summary")


def planned(spark, d):
    return candidates.plan_actions(
        DOC_TITLES.frame(spark, d), stored_movies(spark, d), content_state(spark, d), EVENTS_NOW
    ).withColumn("rank", F.struct(-F.col("popularity"), "tmdb_id"))


@query("job2_plan_actions", f"{PLANNED} SELECT id, action FROM planned")
def job2(spark, d):
    return planned(spark, d).select("id", "action")


@query("jn11_without_target", f"{PLANNED} SELECT id, action FROM planned WHERE id <> 'tmdb_7'")
def jn11(spark, d):
    return planned(spark, d).filter(F.col("id") != "tmdb_7").select("id", "action")


FILL = f"""{PLANNED},
walk AS (SELECT *, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM planned),
work AS (SELECT id, rank FROM walk WHERE action <> 'skip' ORDER BY rank LIMIT 250),
skips AS (SELECT count(*) AS n FROM walk WHERE action = 'skip'
    AND (rank < (SELECT max(rank) FROM work) OR (SELECT count(*) FROM work) < 250))"""


def ranked(spark, d):
    """Planned candidates with one number as rank: popularity first, then id."""
    return planned(spark, d).withColumn(
        "rank", F.lit(10**15) - F.col("popularity").cast("bigint") * 10**9 + F.col("tmdb_id")
    )


@query("win6_batch_work", f"{FILL} SELECT id FROM work")
def win6(spark, d):
    return candidates.fill_batch(ranked(spark, d), 250).work.select("id")


@query("win6_batch_counts", f"""
{FILL} SELECT (SELECT count(*) FROM walk) AS discovered,
    (SELECT n FROM skips) AS skipped""")
def win6_counts(spark, d):
    return candidates.fill_batch(ranked(spark, d), 250).counts


@query("agg8_run_counters", f"""
{FILL} SELECT (SELECT count(*) FROM walk) AS discovered, count(*) FILTER (WHERE rank % 2 = 0) AS processed,
    (SELECT n FROM skips) AS skipped,
    count(*) FILTER (WHERE rank % 2 = 1) AS failed
FROM (SELECT id, CAST(substring(id, 6) AS BIGINT) AS rank FROM work)""")
def agg8(spark, d):
    batch = candidates.fill_batch(ranked(spark, d), 250)
    outcomes = batch.work.select(
        "id", F.when(F.col("tmdb_id") % 2 == 1, "summariser failed").alias("error")
    )
    outcomes, seen = counts.observed_outcomes(outcomes)
    written(outcomes, "outcomes")
    first = batch.counts.first()
    return counts.counters_row(spark, first.discovered, first.skipped, seen)


@query("agg9_catalogue_counters", """
SELECT count(DISTINCT p_partkey // 20) AS pages, count(*) AS discovered,
    count(*) FILTER (WHERE s.s_suppkey IS NULL) AS saved, count(s.s_suppkey) AS skipped
FROM part LEFT JOIN supplier s ON s.s_suppkey = p_partkey""")
def agg9(spark, d):
    movies = table(spark, d, "supplier").select(F.expr("'tmdb_' || s_suppkey").alias("id"))
    return counts.catalogue_counters(listings.listing_titles(read_pages(spark, d)), movies)


TABLE_NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@query("agg2_table_counts", " UNION ALL ".join(
    f"SELECT '{name}' AS table_name, count(*) AS row_count FROM {name}" for name in TABLE_NAMES))
def agg2(spark, d):
    return counts.table_counts({name: table(spark, d, name) for name in TABLE_NAMES})


@query("agg10_page_count", """
SELECT o_orderpriority AS genre, greatest(ceil(count(*) / 24.0), 1)::BIGINT AS pages FROM orders GROUP BY 1""")
def agg10(spark, d):
    return (
        table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("genre"))
        .agg(F.count(F.lit(1)).alias("n")).select("genre", browse.page_count(F.col("n")).alias("pages"))
    )


YEARS = "years AS (SELECT year(o_orderdate) AS year, count(*) // 3 AS total_pages FROM orders GROUP BY 1)"
LANDED = "landed AS (SELECT DISTINCT year(o_orderdate) AS year, o_custkey % 600 + 1 AS page FROM orders WHERE o_orderstatus = 'F')"
MISSING = f"""WITH {YEARS}, {LANDED},
grid AS (SELECT year, least(total_pages, 500) AS pages, unnest(range(1, least(total_pages, 500) + 1)) AS page FROM years),
missing AS (SELECT *, CASE WHEN year < 1998 OR (year = 1998 AND page > 120) THEN 0 ELSE 1 END AS lap
    FROM grid ANTI JOIN landed USING (year, page)),
next AS (SELECT * FROM missing ORDER BY lap, year DESC, page LIMIT 300)"""


def missing(spark, d):
    orders = table(spark, d, "orders").withColumn("year", F.year("o_orderdate"))
    totals = orders.groupBy("year").agg(F.floor(F.count(F.lit(1)) / 3).cast("int").alias("total_pages"))
    landed = orders.filter("o_orderstatus = 'F'").select(
        "year", (F.col("o_custkey") % 600 + 1).cast("int").alias("page")
    )
    return coverage.missing_pages(totals, landed, 1998, 120, 300)


@query("str2_missing_pages", f"{MISSING} SELECT year, page FROM next")
def str2(spark, d):
    return missing(spark, d).select("year", "page")


@query("str2_next_cursor", f"""
{MISSING}, last AS (SELECT * FROM next ORDER BY lap DESC, year, page DESC LIMIT 1)
SELECT CASE WHEN page >= pages THEN year - 1 ELSE year END AS current_year,
    CASE WHEN page >= pages THEN 0 ELSE page END AS last_page,
    CASE WHEN page >= pages THEN 0 ELSE pages END AS total_pages, FALSE AS completed FROM last""")
def str2_cursor(spark, d):
    return coverage.next_cursor(missing(spark, d), 2001)


STORED_REQUESTS = """last AS (SELECT 'tmdb_' || conv_id AS movie_id, TIMESTAMP '2024-01-02 17:00:00'
    + INTERVAL 1 MINUTE * max(conv_id * 7)::INT AS requested_at FROM conversations GROUP BY conv_id)"""


def stored_requests(spark, d, start="2024-01-02 17:00:00"):
    return table(spark, d, "conversations").select(
        F.expr("'tmdb_' || conv_id").alias("movie_id"),
        F.expr(f"TIMESTAMP '{start}' + INTERVAL '1' MINUTE * CAST(conv_id * 7 AS INT)").alias("requested_at"),
    ).distinct()


@query("jn12_request_eligibility", f"""
{ctes(REQUESTS)}, {STORED_REQUESTS},
known AS (SELECT 'tmdb_' || doc_id AS movie_id FROM labels),
s AS (SELECT r.request_id, r.movie_id, CASE WHEN k.movie_id IS NULL THEN 'not_found'
    WHEN l.requested_at > {EVENTS_NOW_SQL} - INTERVAL 6 HOURS THEN 'cooldown' ELSE 'queued' END AS status,
    floor((6.0::DOUBLE - (epoch_ms({EVENTS_NOW_SQL}) - epoch_ms(l.requested_at)) / 3600000.0::DOUBLE) * 10 + 0.5) / 10.0::DOUBLE AS h
    FROM requests r LEFT JOIN known k USING (movie_id) LEFT JOIN last l USING (movie_id))
SELECT request_id, movie_id, status, CASE WHEN status = 'cooldown' THEN h END AS retry_after_hours FROM s""")
def jn12(spark, d):
    return gate.request_eligibility(
        REQUESTS.frame(spark, d).drop("requested_at"), stored_movies_all(spark, d),
        stored_requests(spark, d), EVENTS_NOW,
    )
