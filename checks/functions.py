"""Scalar functions: text, scores, dates, flags."""

from pyspark.sql import functions as F

from checks.bindings import (
    EVENTS_NOW, EVENTS_NOW_SQL, MOVIES, NOW, NOW_SQL, POINTS, REQUESTS, SUMMARIES, THEMES,
    ctes, query, sql_clean, sql_key, sql_score, sql_strip_tags, sql_time, sql_words, table,
)
from titleflow.functions import dates, movies, scores, text
from titleflow.operators import gate

LINKED = "'see https://example.org/' || doc_id || ' now' || chr(10) || '  ' || text"


@query("prj1_movie_id", "SELECT p_partkey, 'tmdb_' || p_partkey AS id FROM part")
def prj1(spark, d):
    return table(spark, d, "part").select("p_partkey", movies.movie_id(F.col("p_partkey")).alias("id"))


@query("prj2_poster_url", """
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL
    ELSE 'https://image.tmdb.org/t/p/w500/' || p_brand || '.jpg' END AS poster_url
FROM part""")
def prj2(spark, d):
    path = F.expr("CASE WHEN p_size % 3 = 0 THEN '' ELSE '/' || p_brand || '.jpg' END")
    return table(spark, d, "part").select("p_partkey", movies.poster_url(path).alias("poster_url"))


@query("prj3_dates", f"""
WITH t AS (SELECT o_orderkey, CASE WHEN o_custkey % 7 = 0 THEN 'junk' WHEN o_custkey % 7 = 1 THEN ''
    WHEN o_custkey % 7 = 2 THEN strftime(o_orderdate, '%Y-%m-32')
    ELSE strftime(o_orderdate, '%Y-%m-%d') END AS raw FROM orders)
SELECT o_orderkey, raw, {sql_time("try_cast(nullif(raw, '') AS TIMESTAMP)")} AS stored FROM t""")
def prj3(spark, d):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    kind = F.col("o_custkey") % 7
    raw = (
        F.when(kind == 0, "junk").when(kind == 1, "")
        .when(kind == 2, F.concat(F.substring(day, 1, 8), F.lit("32"))).otherwise(day)
    )
    return table(spark, d, "orders").select("o_orderkey", raw.alias("raw")).select(
        "o_orderkey", "raw", dates.rfc3339(dates.parse_day(F.col("raw"))).alias("stored")
    )


SCORES = """CASE o_custkey % 8
    WHEN 0 THEN tenth WHEN 1 THEN tenth || '/10' WHEN 2 THEN chr(9) || tenth || '  ' WHEN 3 THEN 'N/A'
    WHEN 4 THEN '' WHEN 5 THEN 'invalid' WHEN 6 THEN tenth || ' /10' ELSE tenth || 'd' END"""
TENTH = "CAST(CAST(o_custkey % 100 AS DOUBLE) / CAST(10 AS DOUBLE) AS STRING)"


@query("prj4_imdb_score", f"""
WITH t AS (SELECT o_orderkey, o_custkey, {TENTH} AS tenth FROM orders),
r AS (SELECT o_orderkey, {SCORES} AS raw, CASE WHEN o_custkey % 8 IN (0, 1, 2) THEN tenth END AS expected FROM t)
SELECT o_orderkey, raw, CAST(expected AS DOUBLE) AS imdb_score FROM r""")
def prj4(spark, d):
    raw = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.expr(TENTH).alias("tenth"))
    return raw.select("o_orderkey", F.expr(SCORES).alias("raw")).select(
        "o_orderkey", "raw", scores.imdb_score(F.col("raw")).alias("imdb_score")
    )


PERCENTS = """CASE p_partkey % 7 WHEN 0 THEN p_size || '%' WHEN 1 THEN CAST(p_size AS STRING)
    WHEN 2 THEN ' ' || p_size || '% ' WHEN 3 THEN p_size || '/100' WHEN 4 THEN 'bad'
    WHEN 5 THEN p_size || '%/100' ELSE 'N/A' END"""


@query("prj5_tomato_score", f"""
SELECT p_partkey, {PERCENTS} AS raw,
    CASE WHEN p_partkey % 7 IN (0, 1, 2, 3) THEN p_size END AS rotten_tomatoes FROM part""")
def prj5(spark, d):
    return table(spark, d, "part").select("p_partkey", F.expr(PERCENTS).alias("raw")).select(
        "p_partkey", "raw", scores.tomato_score(F.col("raw")).alias("rotten_tomatoes")
    )


@query("prj6_clean_text", f"""
WITH t AS (SELECT doc_id, {sql_clean(LINKED)} AS c FROM documents)
SELECT doc_id, md5(c) AS digest, length(c) AS n FROM t""")
def prj6(spark, d):
    cleaned = table(spark, d, "documents").select(
        "doc_id", text.clean_text(F.expr(LINKED)).alias("c")
    )
    return cleaned.select("doc_id", F.md5("c").alias("digest"), F.length("c").alias("n"))


@query("prj7_word_count", f"SELECT doc_id, len({sql_words(sql_clean('text'))}) AS words FROM documents")
def prj7(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", text.word_count(text.clean_text(F.col("text"))).alias("words")
    )


@query("prj8_prefix_key", f"SELECT doc_id, {sql_key(sql_clean('text'))} AS prefix_key FROM documents")
def prj8(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", text.prefix_key(text.clean_text(F.col("text"))).alias("prefix_key")
    )


@query("prj9_strip_tags", f"""
WITH t AS (SELECT page_id, {sql_strip_tags('html')} AS plain FROM pages)
SELECT page_id, md5(plain) AS digest, length(plain) AS n FROM t""")
def prj9(spark, d):
    plain = table(spark, d, "pages").select("page_id", text.strip_tags(F.col("html")).alias("plain"))
    return plain.select("page_id", F.md5("plain").alias("digest"), F.length("plain").alias("n"))


BODY = """CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN '[deleted]' WHEN 2 THEN '[removed]'
    WHEN 3 THEN NULL ELSE text END"""


@query("prj10_content", f"""
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN source || chr(10) || chr(10) || text
    ELSE source END AS post FROM documents),
p AS (SELECT page_id, {sql_strip_tags("CASE WHEN page_id % 2 = 0 THEN html ELSE '<p> </p>' END")} AS plain, url FROM pages)
SELECT 'post' AS kind, doc_id AS id, md5(post) AS digest FROM d
UNION ALL SELECT 'feed', page_id, md5(CASE WHEN plain = '' THEN url ELSE plain END) FROM p""")
def prj10(spark, d):
    posts = table(spark, d, "documents").select(
        F.lit("post").alias("kind"), F.col("doc_id").alias("id"),
        F.md5(text.post_content(F.col("source"), F.expr(BODY))).alias("digest"),
    )
    html = F.expr("CASE WHEN page_id % 2 = 0 THEN html ELSE '<p> </p>' END")
    items = table(spark, d, "pages").select(
        F.lit("feed").alias("kind"), F.col("page_id").alias("id"),
        F.md5(text.feed_content(F.col("url"), html)).alias("digest"),
    )
    return posts.unionByName(items)


ZONE = "CASE event_id % 5 WHEN 0 THEN 'GMT' WHEN 1 THEN 'PST' WHEN 2 THEN '+0200' WHEN 3 THEN '-0730' ELSE '' END"


@query("prj11_feed_date", f"""
SELECT event_id, {sql_time('''CASE event_id % 5 WHEN 2 THEN ts - INTERVAL 2 HOURS
    WHEN 3 THEN ts + INTERVAL 450 MINUTES WHEN 4 THEN NULL ELSE ts END''')} AS created_at FROM events""")
def prj11(spark, d):
    days = F.array(*[F.lit(x) for x in ("Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat")])
    raw = F.concat(
        F.element_at(days, F.dayofweek("ts")), F.lit(", "),
        F.date_format("ts", "dd MMM yyyy HH:mm:ss"), F.lit(" "), F.expr(ZONE),
    )
    return table(spark, d, "events").select(
        "event_id", dates.rfc3339(dates.parse_feed_date(raw)).alias("created_at")
    )


CONTENT_SQL = f"""
{ctes(SUMMARIES, POINTS, THEMES)},
children AS (SELECT movie_id FROM movie_points WHERE type IN ('pro', 'con') UNION SELECT movie_id FROM movie_themes)
SELECT movie_id, overall_sentiment IS NOT NULL OR coalesce(audience_consensus, '') <> ''
    OR coalesce(recommendation, '') <> '' OR c.movie_id IS NOT NULL AS has_summary
FROM movie_summaries LEFT JOIN children c USING (movie_id)"""


@query("prj12_has_content", """
SELECT doc_id, (toxic = 0 OR (doc_id % 3 = 0 AND quality = 1) OR doc_id % 5 = 0 OR doc_id % 7 = 0)
    AS has_content FROM labels""")
def prj12(spark, d):
    listed = F.expr("CASE WHEN doc_id % 7 = 0 THEN array('x') WHEN doc_id % 7 = 1 THEN array() END").cast("array<string>")
    nothing = F.lit(None).cast("array<string>")
    return SUMMARIES.frame(spark, d).select(
        F.expr("CAST(substring(movie_id, 6) AS BIGINT)").alias("doc_id"), "*"
    ).select("doc_id", movies.has_content(
        F.col("overall_sentiment"), F.col("audience_consensus"), F.col("recommendation"),
        listed, nothing, nothing,
    ).alias("has_content"))


@query("prj15_sentiment", """
SELECT p_partkey, s AS score,
  CASE WHEN s IS NULL THEN 'none' WHEN s >= 70 THEN 'high' WHEN s >= 40 THEN 'mid' ELSE 'low' END AS class,
  CASE WHEN s IS NULL THEN 'Awaiting Analysis' WHEN s >= 80 THEN 'Overwhelmingly Positive'
       WHEN s >= 65 THEN 'Generally Favorable' WHEN s >= 45 THEN 'Mixed or Average'
       WHEN s >= 30 THEN 'Leaning Negative' ELSE 'Unfavorable' END AS label
FROM (SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_size * 2 END AS s FROM part)""")
def prj15(spark, d):
    score = F.expr("CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_size * 2 END")
    return table(spark, d, "part").select(
        "p_partkey", score.alias("score"),
        scores.sentiment_class(score).alias("class"), scores.sentiment_label(score).alias("label"),
    )


@query("prj17_cooldown_hours", f"""
SELECT event_id, floor((6.0::DOUBLE - (epoch_ms({EVENTS_NOW_SQL}) - epoch_ms(ts)) / 3600000.0::DOUBLE) * 10 + 0.5)
    / 10.0::DOUBLE AS hours FROM events""")
def prj17(spark, d):
    return table(spark, d, "events").select(
        "event_id",
        dates.cooldown_remaining(F.col("ts").cast("timestamp"), EVENTS_NOW).alias("hours"),
    )


@query("flt8_fresh", f"SELECT event_id, ts > {EVENTS_NOW_SQL} - INTERVAL 24 HOURS AS fresh FROM events")
def flt8(spark, d):
    return table(spark, d, "events").select(
        "event_id", dates.younger_than(F.col("ts").cast("timestamp"), EVENTS_NOW, 24).alias("fresh")
    )


@query("flt9_cooldown_active", f"""
{ctes(REQUESTS)} SELECT request_id, movie_id FROM requests
WHERE requested_at > {EVENTS_NOW_SQL} - INTERVAL 6 HOURS""")
def flt9(spark, d):
    return REQUESTS.frame(spark, d).filter(
        gate.cooldown_active(F.col("requested_at"), EVENTS_NOW)
    ).select("request_id", "movie_id")


@query("months_overflow", f"""
SELECT o_orderkey, strftime(date_trunc('month', o_orderdate) - INTERVAL 6 MONTHS
    + to_days(CAST(day(o_orderdate) - 1 AS INTEGER)), '%Y-%m-%d') AS since FROM orders""")
def months(spark, d):
    since = dates.months_before(F.col("o_orderdate"), 6)
    return table(spark, d, "orders").select("o_orderkey", since.cast("string").alias("since"))


@query("flt7_released", f"""
{ctes(MOVIES)} SELECT id FROM movies
WHERE release_date IS NOT NULL AND release_date::DATE < {NOW_SQL}::DATE""")
def flt7(spark, d):
    return MOVIES.frame(spark, d).filter(
        dates.released_before(F.col("release_date"), NOW)
    ).select("id")


@query("score_text", f"""
{ctes(MOVIES)} SELECT id, {sql_score('imdb_score')} AS imdb, rotten_tomatoes || '%' AS tomatoes FROM movies""")
def score_text(spark, d):
    return MOVIES.frame(spark, d).select(
        "id", scores.score_text(F.col("imdb_score")).alias("imdb"),
        scores.percent_text(F.col("rotten_tomatoes")).alias("tomatoes"),
    )
