"""Browse, search, sort, page and document views."""

from dataclasses import replace

from pyspark.sql import functions as F

from checks.bindings import (
    GENRES, MOVIES, NOW, NOW_SQL, POINTS, SUMMARIES, THEMES, all_tables, ctes, joined, query,
    sql_joined, sql_score, sql_time, table,
)
from titleflow.functions import dates
from titleflow.operators import browse, joins
from titleflow.plans import documents
from titleflow.sinks.export import json_documents

LISTS = f"""
pts AS (SELECT movie_id, list(content ORDER BY ordinal, content) FILTER (WHERE type = 'pro') AS pros,
    list(content ORDER BY ordinal, content) FILTER (WHERE type = 'con') AS cons FROM movie_points GROUP BY 1),
thm AS (SELECT movie_id, list(theme ORDER BY ordinal, theme) AS themes FROM movie_themes GROUP BY 1),
gen AS (SELECT movie_id, list(genre ORDER BY genre) AS genres FROM movie_genres GROUP BY 1),
sums AS (SELECT s.movie_id, overall_sentiment, nullif(audience_consensus, '') AS audience_consensus,
    nullif(recommendation, '') AS recommendation, review_count, s.last_updated, pros, cons, themes,
    overall_sentiment IS NOT NULL OR coalesce(audience_consensus, '') <> '' OR coalesce(recommendation, '') <> ''
    OR len(pros) > 0 OR len(cons) > 0 OR len(themes) > 0 AS says
    FROM movie_summaries s LEFT JOIN pts USING (movie_id) LEFT JOIN thm USING (movie_id))"""
ALL = f"{ctes(MOVIES, GENRES, SUMMARIES, POINTS, THEMES)}, {LISTS}"

DOCUMENT_SQL = f"""SELECT m.id, m.tmdb_id, m.title, {sql_time('m.release_date')} AS release_date,
    {sql_time('m.last_updated')} AS last_updated, nullif(m.imdb_id, '') AS imdb_id,
    nullif(m.poster_url, '') AS poster_url, nullif(m.overview, '') AS overview, m.popularity,
    {sql_score('m.imdb_score')} AS imdb, m.rotten_tomatoes || '%' AS rotten_tomatoes,
    {sql_joined('genres')} AS genres, coalesce(s.review_count, 0) AS review_count_analyzed,
    CASE WHEN s.says THEN s.overall_sentiment END AS overall_sentiment,
    CASE WHEN s.says THEN s.audience_consensus END AS audience_consensus,
    CASE WHEN s.says THEN s.recommendation END AS recommendation,
    CASE WHEN s.says THEN {sql_joined('s.pros')} END AS pros, CASE WHEN s.says THEN {sql_joined('s.cons')} END AS cons,
    CASE WHEN s.says THEN {sql_joined('s.themes')} END AS common_themes
FROM {{page}} m LEFT JOIN gen ON gen.movie_id = m.id LEFT JOIN sums s ON s.movie_id = m.id"""


def flat(docs):
    """Documents with lists as texts and structs as columns."""
    return docs.select(
        "id", "tmdb_id", "title", "release_date", "last_updated", "imdb_id", "poster_url", "overview", "popularity",
        "scores.imdb", "scores.rotten_tomatoes",
        F.coalesce(joined("genres"), F.lit("")).alias("genres"), "review_count_analyzed",
        "summary.overall_sentiment", "summary.audience_consensus", "summary.recommendation",
        *[joined(f"summary.{c}").alias(c) for c in ("pros", "cons", "common_themes")],
    )


def whole_documents(spark, d):
    """Documents of every movie, as an export makes them."""
    t = all_tables(spark, d)
    return documents.export(t)


@query("prj13_movie_documents", f"{ALL} {DOCUMENT_SQL.format(page='movies')}")
def prj13(spark, d):
    return flat(whole_documents(spark, d))


SUMMARY_SQL = f"""SELECT movie_id, overall_sentiment, audience_consensus, recommendation, review_count,
    {sql_time('last_updated')} AS last_updated, array_to_string(pros, ' | ') AS pros,
    array_to_string(cons, ' | ') AS cons, array_to_string(themes, ' | ') AS themes FROM sums"""


def flat_summaries(docs):
    return docs.select(
        "movie_id", "overall_sentiment", "audience_consensus", "recommendation", "review_count", "last_updated",
        *[joined(c).alias(c) for c in ("pros", "cons", "themes")],
    )


@query("prj14_summary_documents", f"{ALL} {SUMMARY_SQL}")
def prj14(spark, d):
    t = all_tables(spark, d)
    return flat_summaries(browse.summary_documents(
        joins.summaries_with_lists(t["movie_summaries"], t["movie_points"], t["movie_themes"])
    ))


@query("prj16_cards", f"""
{ALL}, docs AS ({DOCUMENT_SQL.format(page='movies')})
SELECT id, title, coalesce(overall_sentiment || '%', 'Unrated') AS sentiment_text,
    CASE WHEN overall_sentiment IS NULL THEN 'none' WHEN overall_sentiment >= 70 THEN 'high'
        WHEN overall_sentiment >= 40 THEN 'mid' ELSE 'low' END AS sentiment_class,
    CASE WHEN overall_sentiment IS NULL THEN 'Awaiting Analysis' WHEN overall_sentiment >= 80 THEN 'Overwhelmingly Positive'
        WHEN overall_sentiment >= 65 THEN 'Generally Favorable' WHEN overall_sentiment >= 45 THEN 'Mixed or Average'
        WHEN overall_sentiment >= 30 THEN 'Leaning Negative' ELSE 'Unfavorable' END AS sentiment_label,
    coalesce(substring(release_date, 1, 4), 'N/A') AS release_year,
    CASE WHEN genres = '' THEN 'Movie' ELSE array_to_string(string_split(genres, ' | ')[1:2], ' • ') END AS card_genres,
    coalesce(audience_consensus, '') <> '' OR coalesce(pros, '') <> '' OR coalesce(cons, '') <> '' AS has_deep_summary
FROM docs""")
def prj16(spark, d):
    return browse.cards(whole_documents(spark, d))


@query("flt5_title_contains", f"""
{ctes(MOVIES)} SELECT id FROM movies WHERE lower(title) LIKE '%ur_ent%9%'""")
def flt5(spark, d):
    from titleflow.functions.text import contains_like

    return MOVIES.frame(spark, d).filter(contains_like(F.col("title"), "Ur_Ent%9")).select("id")


@query("flt6_genre", """
SELECT 'tmdb_' || o_orderkey AS id FROM orders WHERE o_orderpriority = '5-LOW'""")
def flt6(spark, d):
    genres = table(spark, d, "orders").select(
        F.expr("'tmdb_' || o_orderkey").alias("movie_id"), F.col("o_orderpriority").alias("genre")
    )
    return joins.titles_of_genre(MOVIES.frame(spark, d), genres, "5-LOW").select("id")


@query("flt6_all_genres", f"{ctes(MOVIES)} SELECT id FROM movies")
def flt6_all(spark, d):
    return joins.titles_of_genre(MOVIES.frame(spark, d), GENRES.frame(spark, d), "All").select("id")


@query("flt11_requested_ids", """
WITH asked AS (SELECT doc_id AS pos, CASE WHEN doc_id % 4 = 0 THEN '  ' ELSE lang || doc_id % 37 END AS movie_id FROM documents)
SELECT DISTINCT movie_id FROM (SELECT * FROM asked ORDER BY pos LIMIT 100) WHERE trim(movie_id) <> ''""")
def flt11(spark, d):
    asked = table(spark, d, "documents").select(
        F.col("doc_id").alias("pos"),
        F.expr("CASE WHEN doc_id % 4 = 0 THEN '  ' ELSE lang || doc_id % 37 END").alias("movie_id"),
    )
    return browse.requested_ids(asked, most=100)


@query("jn4_titles_of_genre", f"""
{ctes(MOVIES, GENRES)} SELECT DISTINCT m.id, m.title FROM movies m JOIN movie_genres g ON g.movie_id = m.id WHERE g.genre = 'R'""")
def jn4(spark, d):
    return joins.titles_of_genre(MOVIES.frame(spark, d), GENRES.frame(spark, d), "R").select("id", "title")


@query("jn5_with_genres", f"""
{ctes(MOVIES, GENRES)} SELECT id, coalesce(string_agg(genre, ' | ' ORDER BY genre), '') AS genres
FROM movies LEFT JOIN movie_genres ON movie_id = id GROUP BY id""")
def jn5(spark, d):
    found = joins.with_genres(MOVIES.frame(spark, d), GENRES.frame(spark, d))
    return found.select("id", joined("genres").alias("genres"))


@query("jn6_with_summaries", f"""
{ctes(SUMMARIES)} SELECT 'tmdb_' || doc_id AS id, overall_sentiment, coalesce(review_count, 0) AS review_count_analyzed
FROM documents LEFT JOIN movie_summaries ON movie_id = 'tmdb_' || doc_id""")
def jn6(spark, d):
    titles = table(spark, d, "documents").select(F.expr("'tmdb_' || doc_id").alias("id"))
    t = all_tables(spark, d)
    found = joins.summaries_with_lists(t["movie_summaries"], t["movie_points"], t["movie_themes"])
    return joins.with_summaries(titles, found).select(
        "id", "summary.overall_sentiment", "review_count_analyzed"
    )


@query("jn6_without_table", "SELECT 'tmdb_' || doc_id AS id, 0 AS review_count_analyzed FROM documents")
def jn6_none(spark, d):
    titles = table(spark, d, "documents").select(F.expr("'tmdb_' || doc_id").alias("id"))
    return joins.with_summaries(titles, None).select("id", "review_count_analyzed")


@query("jn7_summary_lists", f"""
{ctes(MOVIES, POINTS, THEMES)}, movie_genres AS (SELECT '' AS movie_id, '' AS genre),
movie_summaries AS (SELECT id AS movie_id, 1 AS overall_sentiment, '' AS audience_consensus, '' AS recommendation,
    0 AS review_count, last_updated FROM movies), {LISTS}
SELECT movie_id, {sql_joined('pros')} AS pros, {sql_joined('cons')} AS cons, {sql_joined('themes')} AS themes FROM sums""")
def jn7(spark, d):
    parents = MOVIES.frame(spark, d).select(F.col("id").alias("movie_id"))
    found = joins.summaries_with_lists(parents, POINTS.frame(spark, d), THEMES.frame(spark, d))
    return found.select("movie_id", *[joined(c).alias(c) for c in ("pros", "cons", "themes")])


def sparse(binding):
    """The child rows with ordinals far apart."""
    return replace(binding, columns={**binding.columns, "ordinal": "CAST(l_linenumber AS BIGINT) * 100000"})


SPARSE = f"""{ctes(MOVIES, sparse(POINTS), sparse(THEMES), GENRES, SUMMARIES)}, {LISTS}"""


@query("jn7_sparse_ordinals", f"""{SPARSE.replace(SUMMARIES.cte, """movie_summaries AS (SELECT id AS movie_id, 1 AS overall_sentiment,
    '' AS audience_consensus, '' AS recommendation, 0 AS review_count, last_updated FROM movies)""")}
SELECT movie_id, {sql_joined('pros')} AS pros, {sql_joined('cons')} AS cons, {sql_joined('themes')} AS themes FROM sums""")
def jn7_sparse(spark, d):
    parents = MOVIES.frame(spark, d).select(F.col("id").alias("movie_id"))
    found = joins.summaries_with_lists(parents, sparse(POINTS).frame(spark, d), sparse(THEMES).frame(spark, d))
    return found.select("movie_id", *[joined(c).alias(c) for c in ("pros", "cons", "themes")])


@query("snk9_sparse_documents", f"""{SPARSE} SELECT id, coalesce(len(s.pros), 0)::INT AS pros, coalesce(len(s.cons), 0)::INT AS cons,
    coalesce(len(s.themes), 0)::INT AS themes FROM movies m LEFT JOIN sums s ON s.movie_id = m.id AND s.says""")
def snk9_sparse(spark, d):
    """One JSON document per movie, read back, whatever the ordinals of its lists."""
    tables = {**all_tables(spark, d), "movie_points": sparse(POINTS).frame(spark, d), "movie_themes": sparse(THEMES).frame(spark, d)}
    kept = "id string, summary struct<pros: array<string>, cons: array<string>, common_themes: array<string>>"
    docs = json_documents(documents.export(tables), "id").select(F.from_json("json", kept).alias("doc"))

    def length(column):
        return F.coalesce(F.array_size(f"doc.summary.{column}"), F.lit(0))

    return docs.select("doc.id", length("pros").alias("pros"), length("cons").alias("cons"), length("common_themes").alias("themes"))


@query("agg1_count_matches", f"""
{ctes(MOVIES, GENRES)} SELECT count(DISTINCT m.id) AS total FROM movies m JOIN movie_genres g ON g.movie_id = m.id
WHERE g.genre = 'A' AND release_date IS NOT NULL AND release_date::DATE < {NOW_SQL}::DATE""")
def agg1(spark, d):
    found = documents.browse(all_tables(spark, d), NOW, genre="A", sort="release_date")
    return found.total


def _page(sort, order, limit, offset):
    return f"""page AS (SELECT *, row_number() OVER (ORDER BY {sort} {order} NULLS
        {'FIRST' if order == 'ASC' else 'LAST'}, id) AS rn FROM movies QUALIFY rn > {offset} AND rn <= {offset + limit})"""


@query("srt1_sorted_page", f"""
{ctes(MOVIES)}, {_page('imdb_score', 'ASC', 100, 4990)} SELECT id, imdb_score FROM page""")
def srt1(spark, d):
    column = browse.sort_column("imdb_score")
    return browse.sorted_page(MOVIES.frame(spark, d), column, "ASC", 100, 4990).select("id", "imdb_score")


@query("srt1_unknown_sort", f"""
{ctes(MOVIES)}, {_page('last_updated', 'DESC', 50, 0)} SELECT id, {sql_time('last_updated')} AS last_updated FROM page""")
def srt1_unknown(spark, d):
    column = browse.sort_column("overall_sentiment")
    page = browse.sorted_page(MOVIES.frame(spark, d), column, None, 50, 0)
    return page.select("id", dates.rfc3339(F.col("last_updated")).alias("last_updated"))


@query("srt2_sentiment_sort", f"""
{ctes(MOVIES, SUMMARIES)} SELECT id, overall_sentiment FROM movies LEFT JOIN movie_summaries ON movie_id = id
ORDER BY overall_sentiment DESC NULLS LAST, id LIMIT 100""")
def srt2(spark, d):
    found = documents.browse(all_tables(spark, d), NOW, sort="overall_sentiment", limit=100)
    return found.results.select("id", "summary.overall_sentiment")


@query("srt3_page_bounds", f"""
{ctes(MOVIES)}, {_page('popularity', 'DESC', 24, 48)} SELECT id FROM page""")
def srt3(spark, d):
    limit, offset = browse.page_bounds(24, 2 * browse.UI_PAGE)
    return browse.sorted_page(MOVIES.frame(spark, d), "popularity", "desc", limit, offset).select("id")


@query("srt3_deep_page", f"""
{ctes(MOVIES)}, {_page('popularity', 'DESC', 100, 9000)} SELECT id FROM page""")
def srt3_deep(spark, d):
    """A page in the last third, of which no task sorts what comes before it."""
    return browse.page_keys(MOVIES.frame(spark, d), "popularity", "desc", 100, 9000, deep=1000)


@query("srt4_search_order", f"""
{ctes(MOVIES)} SELECT id FROM movies WHERE title LIKE '%LOW%' ORDER BY last_updated DESC, id LIMIT 50""")
def srt4(spark, d):
    return browse.titles_like(MOVIES.frame(spark, d), " low ", 400).select("id")


@query("job6_browse", f"""
{ALL}, {_page('rotten_tomatoes', 'DESC', 100, 20)}, {'{}'}
""".replace("{}", "shown AS (SELECT * FROM page)") + DOCUMENT_SQL.format(page="shown"))
def job6(spark, d):
    found = documents.browse(
        all_tables(spark, d), NOW, genre="All", sort="rotten_tomatoes", order="desc", limit=500, offset=20
    )
    return flat(found.results)


@query("job6_browse_genre", f"""
{ALL}, matching AS (SELECT * FROM movies SEMI JOIN (SELECT movie_id AS id FROM movie_genres WHERE genre = 'N') USING (id)
    WHERE release_date IS NOT NULL AND release_date::DATE < {NOW_SQL}::DATE),
shown AS (SELECT * FROM matching ORDER BY release_date ASC, id LIMIT 24 OFFSET 24)
{DOCUMENT_SQL.format(page='shown')}""")
def job6_genre(spark, d):
    found = documents.browse(
        all_tables(spark, d), NOW, genre="N", sort="release_date", order="asc", limit=24, offset=24
    )
    return flat(found.results)


@query("job7_search", f"""
{ALL}, shown AS (SELECT * FROM movies WHERE lower(title) LIKE '%medium%1%' ORDER BY last_updated DESC, id LIMIT 40)
{DOCUMENT_SQL.format(page='shown')}""")
def job7(spark, d):
    return flat(documents.search(all_tables(spark, d), "Medium%1", 40))


ASKED = "asked AS (SELECT DISTINCT 'tmdb_' || doc_id * 3 AS id FROM (SELECT * FROM labels ORDER BY doc_id LIMIT 100))"


def asked_ids(spark, d):
    return table(spark, d, "labels").select(
        F.col("doc_id").alias("pos"), F.expr("'tmdb_' || doc_id * 3").alias("movie_id")
    )


@query("job8_documents", f"""
{ALL}, asked AS (SELECT DISTINCT 'tmdb_' || doc_id * 3 AS id FROM labels), shown AS (SELECT * FROM movies SEMI JOIN asked USING (id)) {DOCUMENT_SQL.format(page='shown')}""")
def job8(spark, d):
    return flat(documents.documents(all_tables(spark, d), asked_ids(spark, d)))


@query("job9_summaries", f"{ALL}, {ASKED} {SUMMARY_SQL} SEMI JOIN asked ON asked.id = movie_id")
def job9(spark, d):
    return flat_summaries(documents.summaries(all_tables(spark, d), asked_ids(spark, d)))


def _member(name, value, quoted=True):
    shown = f"'\"' || {value} || '\"'" if quoted else value
    return f"CASE WHEN {value} IS NULL THEN '' ELSE ',\"{name}\":' || {shown} END"


JSON_SQL = f"""
{ctes(MOVIES, GENRES)}, gen AS (SELECT movie_id, list(genre ORDER BY genre) AS genres FROM movie_genres GROUP BY 1),
docs AS (SELECT *, {sql_score('imdb_score')} AS imdb, rotten_tomatoes || '%' AS tomatoes, nullif(imdb_id, '') AS i,
    nullif(poster_url, '') AS p, nullif(overview, '') AS o, CAST(popularity AS VARCHAR) AS pop,
    '["' || array_to_string(genres, '","') || '"]' AS g FROM movies LEFT JOIN gen ON movie_id = id)
SELECT id, '{{"id":"' || id || '","tmdb_id":' || tmdb_id || ',"title":"' || title || '"'
    || {_member('release_date', sql_time('release_date'))} || ',"review_count_analyzed":0'
    || {_member('last_updated', sql_time('last_updated'))} || ',"scores":{{'
    || substring({_member('imdb', 'imdb')} || {_member('rotten_tomatoes', 'tomatoes')}, 2) || '}}'
    || {_member('imdb_id', 'i')} || {_member('poster_url', 'p')} || {_member('overview', 'o')}
    || {_member('popularity', 'pop', False)} || {_member('genres', 'g', False)} || '}}' AS json FROM docs"""


@query("snk9_json_documents", JSON_SQL)
def snk9(spark, d):
    movies = joins.with_summaries(joins.with_genres(MOVIES.frame(spark, d), GENRES.frame(spark, d)), None)
    return json_documents(browse.documents_of(movies), "id")
