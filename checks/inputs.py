"""Payload readers: the driver's tables are packed into payload files and read back."""

from pyspark.sql import functions as F

from checks.bindings import (
    MOVIES, REVIEWS, SUMMARIES, TURNS, ctes, joined, query, sql_strip_tags, sql_time, table,
)
from titleflow import schemas
from titleflow.functions import dates
from titleflow.operators import joins
from titleflow.session import work_path
from titleflow.sources import listings, ratings, registry, replies, reviews, stored

ENTRY = {
    "id": "p_partkey", "title": "p_name",
    "release_date": "CASE WHEN p_size % 10 = 0 THEN '' ELSE '2020-01-' || substring(CAST(100 + p_size % 28 + 1 AS STRING), 2) END",
    "poster_path": "CASE WHEN p_size % 4 = 0 THEN '' ELSE '/' || p_type END",
    "overview": "p_brand", "popularity": "p_retailprice",
    "genre_ids": "array(CAST(p_size % 25 AS INT), CAST(p_partkey % 30 AS INT))",
}
LISTED = f"""listed AS (SELECT p_partkey // 20 + 1 AS page, p_partkey % 20 AS pos, 'tmdb_' || p_partkey AS id,
    p_partkey AS tmdb_id, p_name AS title, {ENTRY['release_date']} AS day, p_type, p_size, p_brand AS overview,
    p_retailprice AS popularity FROM part)"""
LISTED_COLUMNS = f"""page, pos, id, tmdb_id, title,
    {sql_time("try_cast(nullif(day, '') AS TIMESTAMP)")} AS release_date,
    CASE WHEN p_size % 4 = 0 THEN NULL ELSE 'https://image.tmdb.org/t/p/w500/' || p_type END AS poster_url,
    overview, popularity"""


def pack_pages(spark, d, label="pages"):
    """Listing payloads of twenty parts each, in part order, as one JSON text per line."""
    parts = table(spark, d, "part")
    total = parts.agg(F.ceil((F.max("p_partkey") + 1) / 20).cast("int")).scalar()
    entry = F.struct(*[F.expr(e).alias(c) for c, e in ENTRY.items()])
    pages = (
        parts.select(F.expr("p_partkey div 20").alias("n"), (F.col("p_partkey") % 20).alias("pos"), entry.alias("entry"))
        .groupBy("n")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "entry"))).alias("entries"))
        .select(
            (F.lit(2020) - F.col("n") % 7).cast("int").alias("year"),
            (F.col("n") + 1).cast("int").alias("page"), total.alias("total_pages"),
            F.transform("entries", lambda e: e["entry"]).alias("results"),
        )
    )
    path = work_path(spark, label)
    pages.select(F.to_json(F.struct(*pages.columns))).write.text(path)
    return path


def read_pages(spark, d):
    return listings.well_formed(listings.read_listing(spark, pack_pages(spark, d)))


def shown(titles):
    return titles.select(
        "page", "pos", "id", "tmdb_id", "title", dates.rfc3339(F.col("release_date")).alias("release_date"),
        "poster_url", "overview", "popularity",
    )


@query("src1_listing_pages", f"WITH {LISTED} SELECT {LISTED_COLUMNS} FROM listed")
def src1(spark, d):
    return shown(listings.listing_titles(read_pages(spark, d)))


@query("src2_now_playing", f"""
WITH {LISTED} SELECT {LISTED_COLUMNS} FROM listed WHERE page < 4 ORDER BY page, pos LIMIT 90""")
def src2(spark, d):
    pages = read_pages(spark, d).withColumn(
        "results", F.when(F.col("page") == 4, F.array().cast(schemas.LISTING_PAGE["results"].dataType))
        .otherwise(F.col("results"))
    )
    return shown(listings.now_playing(pages, 90))


@query("src3_search_results", f"WITH {LISTED} SELECT {LISTED_COLUMNS} FROM listed WHERE page = 1 AND pos < 7")
def src3(spark, d):
    return shown(listings.search_results(read_pages(spark, d), "ring", 7))


def genre_payload(spark, d):
    """One dictionary payload of all nations; nations of region 1 come twice."""
    nations = table(spark, d, "nation")
    again = nations.filter("n_regionkey = 1").select(
        F.col("n_nationkey") + 100, "n_nationkey", F.concat(F.lit("Later "), "n_name")
    )
    entries = nations.select("n_nationkey", "n_nationkey", "n_name").union(again).toDF("pos", "id", "name")
    return entries.agg(F.sort_array(F.collect_list(F.struct("pos", "id", "name"))).alias("e")).select(
        F.transform("e", lambda e: F.struct(e["id"].alias("id"), e["name"].alias("name"))).alias("genres")
    )


GENRE_SQL = "CASE WHEN n_regionkey = 1 THEN 'Later ' || n_name ELSE n_name END"


@query("src4_genre_dictionary", f"SELECT n_nationkey AS genre_id, {GENRE_SQL} AS name FROM nation")
def src4(spark, d):
    path = work_path(spark, "genres")
    genre_payload(spark, d).select(F.to_json(F.struct("genres"))).write.text(path)
    payloads = listings.read_payloads(spark, path, schemas.GENRE_LIST)
    return listings.genre_dictionary(listings.well_formed(payloads))


def details_payloads(spark, d):
    genre = [F.struct(F.col(c).alias("name")) for c in ("p_type", "p_brand")]
    path = work_path(spark, "details")
    table(spark, d, "part").select(F.to_json(F.struct(
        F.col("p_partkey").alias("id"), F.expr("'tt' || p_partkey").alias("imdb_id"), F.array(*genre).alias("genres"),
    ))).write.text(path)
    return listings.well_formed(listings.read_payloads(spark, path, schemas.TITLE_DETAILS))


@query("src5_title_details", """
SELECT p_partkey AS tmdb_id, 'tt' || p_partkey AS imdb_id, p_type || ' | ' || p_brand AS genres FROM part""")
def src5(spark, d):
    return listings.title_details(details_payloads(spark, d)).withColumn("genres", joined("genres"))


RATING = "CASE p_size % 10 WHEN 0 THEN 'N/A' WHEN 1 THEN '' ELSE CAST(CAST(p_size AS DOUBLE) / CAST(5 AS DOUBLE) AS STRING) END"


def ratings_payloads(spark, d):
    entry = "named_struct('Source', '{}', 'Value', {})"
    tomato = entry.format("Rotten Tomatoes", "{}")
    listed = F.expr(
        "CASE WHEN p_size % 2 = 0 THEN array("
        + ", ".join([
            tomato.format("'1%'"), entry.format("Internet Movie Database", "'7/10'"),
            tomato.format("p_size || '%'"),
        ])
        + f") ELSE array({entry.format('Metacritic', chr(39) + '50/100' + chr(39))}) END"
    )
    path = work_path(spark, "ratings")
    table(spark, d, "part").select(F.to_json(F.struct(
        F.expr("'tt' || p_partkey").alias("imdb_id"), F.expr("p_name || ' ' || p_partkey").alias("title"),
        F.expr("CASE WHEN p_size % 13 = 0 THEN 'False' ELSE 'True' END").alias("Response"),
        F.expr(RATING).alias("imdbRating"), listed.alias("Ratings"),
    ))).write.text(path)
    return listings.well_formed(listings.read_payloads(spark, path, schemas.RATINGS))


@query("src6_ratings", f"""
SELECT 'tt' || p_partkey AS imdb_id, p_name || ' ' || p_partkey AS title,
    CASE WHEN p_size % 13 = 0 OR p_size % 10 IN (0, 1) THEN NULL ELSE {RATING} END AS imdb,
    CASE WHEN p_size % 13 = 0 OR p_size % 2 = 1 THEN NULL ELSE p_size || '%' END AS rotten_tomatoes
FROM part""")
def src6(spark, d):
    return ratings.rating_scores(ratings_payloads(spark, d))


SELFTEXT = "CASE doc_id % 7 WHEN 0 THEN '' WHEN 1 THEN '[deleted]' WHEN 2 THEN '[removed]' ELSE text END"


def forum_payloads(spark, d):
    """Forum searches of twenty documents each; the toxic ones are adult posts."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    post = F.struct(
        F.col("doc_id").cast("string").alias("id"), F.expr("lang || ' ' || doc_id").alias("title"),
        F.expr(SELFTEXT).alias("selftext"), F.col("source").alias("author"),
        F.col("n_chars").cast("int").alias("score"), F.expr("'/r/' || doc_id").alias("permalink"),
        F.expr("CAST(1700000000.5D + doc_id AS DOUBLE)").alias("created_utc"),
        F.expr("coalesce(toxic, 0) = 1").alias("over_18"),
    )
    searches = (
        docs.select(F.expr("doc_id div 20").alias("n"), "doc_id", F.struct(post.alias("data")).alias("child"))
        .groupBy("n").agg(F.sort_array(F.collect_list(F.struct("doc_id", "child"))).alias("c"))
        .select(
            F.expr("'tmdb_' || n").alias("movie_id"),
            F.struct(F.transform("c", lambda c: c["child"]).alias("children")).alias("data"),
        )
    )
    path = work_path(spark, "forum")
    searches.select(F.to_json(F.struct("movie_id", "data"))).write.text(path)
    return listings.well_formed(listings.read_payloads(spark, path, schemas.FORUM_SEARCH))


@query("src7_forum_posts", f"""
SELECT 'tmdb_' || doc_id // 20 AS movie_id, 'reddit_' || doc_id AS id, 'reddit' AS source, d.source AS author,
    md5(CASE WHEN doc_id % 7 IN (0, 1, 2) THEN lang || ' ' || doc_id
        ELSE lang || ' ' || doc_id || chr(10) || chr(10) || text END) AS digest,
    n_chars AS score, 'https://reddit.com/r/' || doc_id AS url,
    {sql_time("make_timestamp((1700000000 + doc_id) * 1000000)")} AS created_at, doc_id % 20 AS ordinal
FROM documents d LEFT JOIN labels USING (doc_id)
WHERE doc_id % 20 < 15 AND coalesce(toxic, 0) = 0""")
def src7(spark, d):
    found = reviews.forum_reviews(forum_payloads(spark, d))
    return found.withColumn("digest", F.md5("content")).withColumn(
        "created_at", dates.rfc3339(F.col("created_at"))
    ).drop("content")


def feeds(spark, d):
    """RSS feeds of twenty pages each; the markup of a page is an item's description."""
    def escaped(column):
        for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            column = F.replace(column, F.lit(plain), F.lit(entity))
        return column

    item = F.concat(
        F.lit("<item><title>"), escaped(F.col("url")), F.lit("</title><link>"), escaped(F.col("url")),
        F.lit("</link><description>"), escaped(F.expr("CASE WHEN page_id % 6 = 0 THEN '<p/>' ELSE html END")),
        F.lit("</description><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate>"),
        F.expr("CASE WHEN page_id % 2 = 0 THEN '<dc:creator>writer ' || page_id || '</dc:creator>' ELSE '' END"),
        F.lit("</item>"),
    )
    head = '<?xml version="1.0"?><rss xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>t</title>'
    return (
        table(spark, d, "pages").select(F.expr("page_id div 20").alias("n"), "page_id", item.alias("item"))
        .groupBy("n").agg(F.sort_array(F.collect_list(F.struct("page_id", "item"))).alias("items"))
        .select(
            F.expr("'tmdb_' || n").alias("movie_id"),
            F.concat(
                F.lit(head), F.array_join(F.transform("items", lambda i: i["item"]), ""),
                F.lit("</channel></rss>"),
            ).alias("xml"),
        )
    )


FEED_SQL = f"""
WITH p AS (SELECT *, {sql_strip_tags("CASE WHEN page_id % 6 = 0 THEN '<p/>' ELSE html END")} AS plain FROM pages)
SELECT 'tmdb_' || page_id // 20 AS movie_id, 'letterboxd_' || (page_id % 20 + 1) AS id, 'letterboxd' AS source,
    CASE WHEN page_id % 2 = 0 THEN 'writer ' || page_id ELSE 'Letterboxd User' END AS author,
    md5(CASE WHEN plain = '' THEN url ELSE plain END) AS digest, 0 AS score, url,
    '2024-01-01T10:00:00Z' AS created_at, page_id % 20 AS ordinal
FROM p WHERE page_id % 20 < 10"""


@query("src8_feed_items", FEED_SQL)
def src8(spark, d):
    return reviews.feed_reviews(feeds(spark, d)).withColumn("digest", F.md5("content")).withColumn(
        "created_at", dates.rfc3339(F.col("created_at"))
    ).drop("content")


@query("src8_feed_files", FEED_SQL)
def src8_files(spark, d):
    """The same feeds as landed files, a folder per title."""
    path = work_path(spark, "feeds")
    feeds(spark, d).repartition("movie_id").write.partitionBy("movie_id").text(path)
    return reviews.feed_reviews(reviews.read_feeds(spark, path)).withColumn("digest", F.md5("content")).withColumn(
        "created_at", dates.rfc3339(F.col("created_at"))
    ).drop("content")


REPLY = """CASE event_type
    WHEN 'click' THEN '{"overall_sentiment": ' || event_id % 101 || ', "pros": ["p' || user_id || '", "q"], "cons": [], "common_themes": ["t"], "audience_consensus": "c", "recommendation": null, "extra": ' || props || '}'
    WHEN 'view' THEN '{"overall_sentiment": ' || event_id % 101 || '.5, "pros": ["x"]}'
    WHEN 'error' THEN '```json' || props || '```'
    WHEN 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN '{"pros": [1]}' ELSE props || ' and more' END
    ELSE props END"""


@query("src9_replies", """
SELECT event_id, event_type NOT IN ('click', 'signup') AS rejected,
    CASE event_type WHEN 'click' THEN event_id % 101 WHEN 'signup' THEN 0 END AS overall_sentiment,
    CASE event_type WHEN 'click' THEN 'p' || user_id || ' | q' WHEN 'signup' THEN '' END AS pros,
    CASE event_type WHEN 'click' THEN 't' WHEN 'signup' THEN '' END AS common_themes,
    CASE event_type WHEN 'click' THEN 'c' WHEN 'signup' THEN '' END AS audience_consensus,
    CASE event_type WHEN 'click' THEN '' WHEN 'signup' THEN '' END AS recommendation
FROM events""")
def src9(spark, d):
    raw = table(spark, d, "events").select("event_id", F.expr(REPLY).alias("reply"))
    parsed = replies.parse_replies(raw)
    return parsed.select(
        "event_id", F.col("reply_error").isNotNull().alias("rejected"), "summary.overall_sentiment",
        joined("summary.pros").alias("pros"), joined("summary.common_themes").alias("common_themes"),
        "summary.audience_consensus", "summary.recommendation",
    )


@query("src10_stored_rows", f"""
SELECT 'tmdb_' || o_orderkey AS id, o_orderkey AS tmdb_id, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE 'title' END AS title,
    CASE o_custkey % 3 WHEN 2 THEN NULL ELSE {sql_time('o_orderdate')} END AS release_date,
    CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE o_totalprice END AS popularity,
    CASE WHEN o_custkey % 6 = 0 THEN NULL ELSE CAST(o_custkey % 101 AS INT) END AS rotten_tomatoes,
    CASE o_custkey % 3 WHEN 0 THEN {sql_time('o_orderdate')} END AS last_updated
FROM orders""")
def src10(spark, d):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    kind = F.col("o_custkey") % 3
    stamp = F.when(kind == 0, dates.rfc3339(F.col("o_orderdate"))).when(kind == 1, day).otherwise("soon")
    row = F.concat(
        F.lit('{"id": "tmdb_'), "o_orderkey", F.lit('", "tmdb_id": '), "o_orderkey",
        F.lit('.0, "title": '), F.expr("CASE WHEN o_custkey % 5 = 0 THEN '12' ELSE '\"title\"' END"),
        F.lit(', "release_date": "'), stamp, F.lit('", "last_updated": "'), stamp,
        F.lit('", "popularity": '),
        F.expr("CASE WHEN o_custkey % 4 = 0 THEN '\"' || o_totalprice || '\"' ELSE CAST(o_totalprice AS STRING) END"),
        F.lit(', "rotten_tomatoes": '),
        F.expr("CASE WHEN o_custkey % 6 = 0 THEN 'null' ELSE (o_custkey % 101) || '.75' END"), F.lit("}"),
    )
    rows = stored.decode_movies(table(spark, d, "orders").select(row.alias("row")))
    return rows.select(
        "id", "tmdb_id", "title", dates.rfc3339(F.col("release_date")).alias("release_date"),
        "popularity", "rotten_tomatoes", dates.rfc3339(F.col("last_updated")).alias("last_updated"),
    )


def wide_movies(spark, d):
    """Documents as wide title rows; labelled ones carry summary columns."""
    summaries = SUMMARIES.frame(spark, d).drop("last_updated").withColumnRenamed("movie_id", "id")
    return table(spark, d, "documents").select(
        F.expr("'tmdb_' || doc_id").alias("id"), F.col("lang").alias("title")
    ).join(summaries, "id", "left")


LEGACY_SQL = f"""{ctes(SUMMARIES)},
wide AS (SELECT 'tmdb_' || doc_id AS movie_id FROM documents),
kept AS (SELECT movie_id, overall_sentiment, audience_consensus, recommendation, review_count
    FROM wide JOIN movie_summaries USING (movie_id)
    WHERE overall_sentiment IS NOT NULL OR audience_consensus IS NOT NULL OR recommendation IS NOT NULL)"""


@query("src11_legacy_summaries", f"{LEGACY_SQL} SELECT * FROM kept")
def src11(spark, d):
    return stored.legacy_summaries(wide_movies(spark, d))


@query("src12_table_reads", f"""
{ctes(MOVIES)} SELECT id, tmdb_id, title, {sql_time('release_date')} AS release_date, popularity, imdb_score,
    rotten_tomatoes, {sql_time('last_updated')} AS last_updated FROM movies""")
def src12(spark, d):
    path = work_path(spark, "movies")
    MOVIES.frame(spark, d).write.parquet(path)
    return stored.read_table(spark, path, "movies").select(
        "id", "tmdb_id", "title", dates.rfc3339(F.col("release_date")).alias("release_date"), "popularity",
        "imdb_score", "rotten_tomatoes", dates.rfc3339(F.col("last_updated")).alias("last_updated"),
    )


def sources_of(d):
    """Documents and turns as registered review sources; the one between cannot be read."""
    return (
        registry.Sources()
        .add_reviews("documents", lambda spark: REVIEWS.frame(spark, d))
        .add_reviews("broken", lambda spark: spark.read.parquet(f"{d}/no_such_source.parquet"))
        .add_reviews("turns", lambda spark: TURNS.frame(spark, d))
    )


@query("set1_union_sources", f"""
{ctes(REVIEWS, TURNS)}
SELECT 0 AS source_rank, movie_id, id, source, score, ordinal, md5(content) AS digest FROM reviews
UNION ALL SELECT 2, movie_id, id, source, score, ordinal, md5(content) FROM turns
""".replace("AS STRING", "AS VARCHAR"))
def set1(spark, d):
    found, _ = sources_of(d).collect(spark)
    return found.select(
        "source_rank", "movie_id", "id", "source", "score", "ordinal", F.md5("content").alias("digest")
    )


@query("set1_asked_titles", f"""
{ctes(REVIEWS, TURNS)}, every AS (SELECT 0 AS source_rank, movie_id, id, ordinal, md5(content) AS digest FROM reviews
    UNION ALL SELECT 2, movie_id, id, ordinal, md5(content) FROM turns)
SELECT every.* FROM every SEMI JOIN (SELECT 'tmdb_' || doc_id AS movie_id FROM labels WHERE quality = 0) USING (movie_id)
""".replace("AS STRING", "AS VARCHAR"))
def set1_asked(spark, d):
    """The reviews of some titles, of which alone the sources are asked."""
    asked = table(spark, d, "labels").filter("quality = 0").select(F.expr("'tmdb_' || doc_id").alias("movie_id"))
    found, _ = sources_of(d).collect(spark, asked)
    return found.select("source_rank", "movie_id", "id", "ordinal", F.md5("content").alias("digest"))


@query("win3_feed_positions", """
SELECT 'tmdb_' || page_id // 20 AS movie_id, count(*) AS items, max(page_id % 20) AS last_ordinal
FROM pages WHERE page_id % 20 < 10 GROUP BY ALL""")
def win3(spark, d):
    return reviews.feed_reviews(feeds(spark, d)).groupBy("movie_id").agg(
        F.count(F.lit(1)).alias("items"), F.max("ordinal").alias("last_ordinal")
    )


@query("win4_forum_positions", """
SELECT 'tmdb_' || conv_id || '_' || turn // 20 AS movie_id, 'reddit_' || turn AS id, turn % 20 AS ordinal
FROM conversations WHERE turn % 20 < 15""")
def win4(spark, d):
    """Searches of at most twenty turns of one conversation each."""
    post = F.struct(
        F.col("turn").cast("string").alias("id"), F.col("role").alias("title"), F.col("text").alias("selftext"),
        F.col("role").alias("author"), F.lit(0).alias("score"), F.lit("/").alias("permalink"),
        F.lit(0.0).alias("created_utc"), F.lit(False).alias("over_18"),
    )
    path = work_path(spark, "threads")
    (
        table(spark, d, "conversations")
        .select("conv_id", F.expr("turn div 20").alias("n"), "turn", F.struct(post.alias("data")).alias("child"))
        .groupBy("conv_id", "n").agg(F.sort_array(F.collect_list(F.struct("turn", "child"))).alias("c"))
        .select(F.to_json(F.struct(
            F.expr("'tmdb_' || conv_id || '_' || n").alias("movie_id"),
            F.struct(F.transform("c", lambda c: c["child"]).alias("children")).alias("data"),
        )))
        .write.text(path)
    )
    payloads = listings.well_formed(listings.read_payloads(spark, path, schemas.FORUM_SEARCH))
    return reviews.forum_reviews(payloads).select("movie_id", "id", "ordinal")


@query("jn8_details", """
SELECT p_partkey AS tmdb_id, p_name AS title,
    CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'tt' || p_partkey END AS imdb_id,
    CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_type || ' | ' || p_brand END AS genres FROM part""")
def jn8(spark, d):
    details = listings.title_details(details_payloads(spark, d)).filter("tmdb_id % 3 <> 0")
    titles = table(spark, d, "part").select(F.col("p_partkey").alias("tmdb_id"), F.col("p_name").alias("title"))
    return joins.with_details(titles, details).withColumn("genres", joined("genres"))


@query("jn9_ratings", """
WITH p AS (SELECT *, p_partkey % 3 AS k, p_size % 13 = 0 OR p_size % 10 IN (0, 1) AS no_imdb,
    p_size % 13 = 0 OR p_size % 2 = 1 AS no_tomato FROM part)
SELECT p_partkey AS tmdb_id,
    CASE WHEN k = 2 OR no_imdb THEN 1.5::DOUBLE ELSE p_size / 5.0::DOUBLE END AS imdb_score,
    CASE WHEN k = 2 OR no_tomato THEN 7 ELSE p_size END AS rotten_tomatoes FROM p""")
def jn9(spark, d):
    titles = table(spark, d, "part").select(
        F.col("p_partkey").alias("tmdb_id"),
        F.expr("CASE p_partkey % 3 WHEN 0 THEN 'tt' || p_partkey WHEN 1 THEN '' ELSE 'tt?' END").alias("imdb_id"),
        F.expr("p_name || ' ' || p_partkey").alias("title"),
        F.lit(1.5).alias("imdb_score"), F.lit(7).alias("rotten_tomatoes"),
    )
    rated = ratings.rating_scores(ratings_payloads(spark, d))
    return joins.with_ratings(titles, rated).select("tmdb_id", "imdb_score", "rotten_tomatoes")
