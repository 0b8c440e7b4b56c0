"""Review preparation, counts, prompts and child lists."""

from pyspark.sql import functions as F

from checks.bindings import (
    DOC_TITLES, GENRES, POINTS, REVIEWS, THEMES, TURNS, ctes, joined, query, sql_clean, sql_joined, sql_key,
    sql_words, table,
)
from titleflow.operators import lists, reviews
from titleflow.sources import reviews as payloads

PREPARED = f"""
cleaned AS (SELECT movie_id, id, source, score, source_rank, ordinal, {sql_clean('content')} AS c FROM arrived),
long AS (SELECT *, {sql_key('c')} AS key FROM cleaned WHERE len({sql_words('c')}) >= 3),
firsts AS (SELECT * FROM long
    QUALIFY row_number() OVER (PARTITION BY movie_id, key ORDER BY source_rank, ordinal) = 1),
best AS (SELECT *, row_number() OVER (PARTITION BY movie_id ORDER BY score DESC, source_rank, ordinal) AS rank
    FROM firsts QUALIFY rank <= 30)"""


def with_reviews(*bindings) -> str:
    arrived = " UNION ALL ".join(
        f"SELECT movie_id, id, source, content, score, ordinal, {rank} AS source_rank FROM {b.name}"
        for rank, b in enumerate(bindings)
    )
    return f"{ctes(*bindings)}, arrived AS ({arrived})".replace("AS STRING", "AS VARCHAR")


def arrived(spark, d, *bindings):
    frames = [b.frame(spark, d).withColumn("source_rank", F.lit(i)) for i, b in enumerate(bindings)]
    found = frames[0]
    for frame in frames[1:]:
        found = found.unionByName(frame)
    return found


@query("job1_prepare_reviews", f"""
{with_reviews(REVIEWS)}, {PREPARED}
SELECT movie_id, id, source, score, rank, md5(c) AS digest FROM best""")
def job1(spark, d):
    prepared = reviews.prepare_reviews(arrived(spark, d, REVIEWS))
    return prepared.select("movie_id", "id", "source", "score", "rank", F.md5("content").alias("digest"))


@query("flt1_min_words", f"""
{with_reviews(REVIEWS)}, cleaned AS (SELECT id, {sql_clean('content')} AS c FROM arrived)
SELECT id FROM cleaned WHERE len({sql_words('c')}) >= 40""")
def flt1(spark, d):
    return reviews.clean_reviews(arrived(spark, d, REVIEWS), 40).select("id")


@query("flt2_adult_posts", """
SELECT 'reddit_' || doc_id AS id FROM labels WHERE toxic = 0""")
def flt2(spark, d):
    post = F.struct(
        F.col("doc_id").cast("string").alias("id"), F.lit("t").alias("title"), F.lit("").alias("selftext"),
        F.lit("a").alias("author"), F.lit(0).alias("score"), F.lit("/").alias("permalink"),
        F.lit(0.0).alias("created_utc"), (F.col("toxic") == 1).alias("over_18"),
    )
    searches = table(spark, d, "labels").select(
        F.lit("m").alias("movie_id"), F.struct(F.array(F.struct(post.alias("data"))).alias("children")).alias("data")
    )
    return payloads.forum_reviews(searches).select("id")


@query("win1_first_copies", f"""
{with_reviews(REVIEWS)}, {PREPARED} SELECT movie_id, id, key AS prefix_key FROM firsts""")
def win1(spark, d):
    from titleflow.functions.text import prefix_key

    firsts = reviews.first_copies(reviews.clean_reviews(arrived(spark, d, REVIEWS)))
    return firsts.select("movie_id", "id", prefix_key(F.col("content")).alias("prefix_key"))


@query("win2_top_reviews", f"""
{with_reviews(REVIEWS)}
SELECT movie_id, id, row_number() OVER (PARTITION BY movie_id ORDER BY score DESC, ordinal) AS rank
FROM arrived QUALIFY rank <= 12""")
def win2(spark, d):
    return reviews.top_reviews(arrived(spark, d, REVIEWS), 12).select("movie_id", "id", "rank")


@query("agg7_review_counts", f"""
{with_reviews(TURNS)}, {PREPARED}
SELECT t.id AS movie_id, count(best.movie_id) AS review_count
FROM (SELECT 'tmdb_' || doc_id AS id FROM documents) t LEFT JOIN best ON best.movie_id = t.id GROUP BY t.id""")
def agg7(spark, d):
    titles = DOC_TITLES.frame(spark, d).select(F.col("id").alias("movie_id"))
    return reviews.review_counts(titles, reviews.prepare_reviews(arrived(spark, d, TURNS)))


PROMPT_HEAD = "'Movie Title: ' || t.title || chr(10) || CASE WHEN t.overview = '' THEN '' ELSE 'Overview: ' || t.overview || chr(10) END"
PROMPT_ENTRY = """chr(10) || '--- Review #' || rank || ' (Source: ' || source || ', Score: ' || score || ') ---'
    || chr(10) || c || chr(10)"""


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


@query("agg11_prompts", f"""
{with_reviews(TURNS)}, {PREPARED},
t AS (SELECT 'tmdb_' || doc_id AS id, lang || ' ' || source AS title,
    CASE WHEN doc_id % 2 = 0 THEN '' ELSE source END AS overview FROM documents),
blocks AS (SELECT movie_id, count(*) AS n, string_agg({PROMPT_ENTRY}, '' ORDER BY rank) AS body FROM best GROUP BY 1),
prompts AS (SELECT t.id AS movie_id, coalesce(n, 0) AS review_count, {PROMPT_HEAD}
    || CASE WHEN body IS NULL THEN {sql_text(reviews.NO_REVIEWS_NOTE)} ELSE {sql_text(reviews.REVIEWS_HEADING)} || body END
    || {sql_text(reviews.INSTRUCTIONS)} AS prompt
    FROM t LEFT JOIN blocks ON blocks.movie_id = t.id)
SELECT movie_id, review_count, md5(prompt) AS digest, length(prompt) AS n FROM prompts""")
def agg11(spark, d):
    titles = DOC_TITLES.frame(spark, d).withColumnRenamed("id", "movie_id")
    prompts = reviews.prompt_texts(titles, reviews.prepare_reviews(arrived(spark, d, TURNS)))
    return prompts.select(
        "movie_id", "review_count", F.md5("prompt").alias("digest"), F.length("prompt").alias("n")
    )


@query("agg3_points_by_type", f"{ctes(POINTS)} SELECT type, count(*) AS points FROM movie_points GROUP BY type")
def agg3(spark, d):
    from titleflow.operators.counts import points_by_type

    return points_by_type(POINTS.frame(spark, d))


@query("agg4_genre_lists", f"""
{ctes(GENRES)} SELECT movie_id, {sql_joined('list(genre ORDER BY genre)')} AS genres FROM movie_genres GROUP BY 1""")
def agg4(spark, d):
    return lists.genre_lists(GENRES.frame(spark, d)).withColumn("genres", joined("genres"))


LISTS = "list({value} ORDER BY ordinal, {value}) FILTER (WHERE type = '{kind}')"


@query("agg5_point_lists", f"""
{ctes(POINTS)} SELECT movie_id, {sql_joined(LISTS.format(value='content', kind='pro'))} AS pros,
    {sql_joined(LISTS.format(value='content', kind='con'))} AS cons FROM movie_points GROUP BY movie_id""")
def agg5(spark, d):
    found = lists.point_lists(POINTS.frame(spark, d))
    return found.select("movie_id", joined("pros").alias("pros"), joined("cons").alias("cons"))


@query("agg6_theme_lists", f"""
{ctes(THEMES)} SELECT movie_id, {sql_joined('list(theme ORDER BY ordinal, theme)')} AS themes
FROM movie_themes GROUP BY movie_id""")
def agg6(spark, d):
    return lists.theme_lists(THEMES.frame(spark, d)).select("movie_id", joined("themes").alias("themes"))


@query("flt12_blank_children", """
SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_quantity >= 25 GROUP BY ALL""")
def flt12(spark, d):
    children = table(spark, d, "lineitem").withColumn(
        "content", F.expr("CASE WHEN l_quantity < 10 THEN NULL WHEN l_quantity < 25 THEN '' ELSE l_returnflag END")
    )
    return lists.nonblank(children, "content").groupBy("l_orderkey", "l_linenumber").agg(
        F.count(F.lit(1)).alias("n")
    )


@query("set2_distinct_ids", "SELECT DISTINCT 'tmdb_' || l_orderkey AS movie_id FROM lineitem")
def set2(spark, d):
    return POINTS.frame(spark, d).select("movie_id").distinct()
