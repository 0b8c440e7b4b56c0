"""Table and payload schemas."""

from pyspark.sql import types as T

TEXT, WHOLE, LONG, REAL = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()
TIME, FLAG = T.TimestampType(), T.BooleanType()
TEXTS, WHOLES = T.ArrayType(TEXT), T.ArrayType(WHOLE)


def _struct(required: tuple[str, ...] = (), **fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, n not in required) for n, t in fields.items()])


def _payload(**fields: T.DataType) -> T.StructType:
    """A landed JSON payload; its text is kept where it does not parse."""
    return _struct(**fields, _corrupt_record=TEXT)


# --- stored tables -----------------------------------------------------------

MOVIES = _struct(
    ("id", "tmdb_id", "title", "last_updated"),
    id=TEXT, tmdb_id=LONG, imdb_id=TEXT, title=TEXT, release_date=TIME, poster_url=TEXT,
    overview=TEXT, popularity=REAL, imdb_score=REAL, rotten_tomatoes=WHOLE, last_updated=TIME,
)
MOVIE_GENRES = _struct(("movie_id", "genre"), movie_id=TEXT, genre=TEXT)
REVIEW_REQUESTS = _struct(("movie_id", "requested_at"), movie_id=TEXT, requested_at=TIME)
MOVIE_SUMMARIES = _struct(
    ("movie_id", "last_updated"),
    movie_id=TEXT, overall_sentiment=WHOLE, audience_consensus=TEXT, recommendation=TEXT,
    review_count=WHOLE, last_updated=TIME,
)
MOVIE_POINTS = _struct(
    ("movie_id", "type", "content"), movie_id=TEXT, type=TEXT, ordinal=LONG, content=TEXT
)
MOVIE_THEMES = _struct(("movie_id", "theme"), movie_id=TEXT, ordinal=LONG, theme=TEXT)

TABLES = {
    "movies": MOVIES,
    "movie_genres": MOVIE_GENRES,
    "review_requests": REVIEW_REQUESTS,
    "movie_summaries": MOVIE_SUMMARIES,
    "movie_points": MOVIE_POINTS,
    "movie_themes": MOVIE_THEMES,
}

# key that every merge and every hash bucket of a table uses
TABLE_KEYS = {table: "id" if table == "movies" else "movie_id" for table in TABLES}

CURSOR = _struct(
    last_page=WHOLE, total_pages=WHOLE, sort_by=TEXT, current_year=WHOLE,
    movies_cataloged_this_cycle=WHOLE, completed=FLAG, last_run=TIME,
)

# --- transient frames --------------------------------------------------------

CANDIDATES = _struct(
    id=TEXT, tmdb_id=LONG, imdb_id=TEXT, title=TEXT, release_date=TIME, poster_url=TEXT,
    overview=TEXT, popularity=REAL, genres=TEXTS, genre_ids=WHOLES,
)
REVIEWS = _struct(
    movie_id=TEXT, id=TEXT, source=TEXT, author=TEXT, content=TEXT, score=WHOLE, url=TEXT,
    created_at=TIME, ordinal=LONG,
)

# --- landed payloads ---------------------------------------------------------

LISTING_ENTRY = _struct(
    id=LONG, title=TEXT, release_date=TEXT, poster_path=TEXT, overview=TEXT, popularity=REAL,
    genre_ids=WHOLES,
)
LISTING_PAGE = _payload(
    year=WHOLE, page=WHOLE, total_pages=WHOLE, total_results=WHOLE,
    results=T.ArrayType(LISTING_ENTRY),
)
GENRE_LIST = _payload(genres=T.ArrayType(_struct(id=WHOLE, name=TEXT)))
TITLE_DETAILS = _payload(id=LONG, imdb_id=TEXT, genres=T.ArrayType(_struct(name=TEXT)))
RATINGS = _payload(
    imdb_id=TEXT, title=TEXT, Response=TEXT, imdbRating=TEXT,
    Ratings=T.ArrayType(_struct(Source=TEXT, Value=TEXT)),
)
POST = _struct(
    id=TEXT, title=TEXT, selftext=TEXT, author=TEXT, score=WHOLE, permalink=TEXT,
    created_utc=REAL, over_18=FLAG,
)
FORUM_SEARCH = _payload(
    movie_id=TEXT, data=_struct(children=T.ArrayType(_struct(data=POST)))
)
FEED_ITEM = _struct(title=TEXT, link=TEXT, description=TEXT, pubDate=TEXT, creator=TEXT)
FEED = _struct(channel=_struct(item=T.ArrayType(FEED_ITEM)))
