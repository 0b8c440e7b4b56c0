"""Review preparation, review counts and prompt texts.

Reviews carry ``movie_id``, ``source``, ``content``, ``score``, ``source_rank`` and
``ordinal``; the last two give the arrival order within a title.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titleflow.functions import text
from titleflow.session import written

MIN_WORDS = 3
MAX_REVIEWS = 30
#: Words at the start of a text by which copies are told.
KEY_WORDS = 15
#: Winners up to which their arrival keys are broadcast: some megabytes of short rows.
BROADCAST_WINNERS = 100_000
#: Bits of the filter of more winners: 16 per winner as a power of two, 256 MB at most.
FILTER_BITS = 1 << 31

# fixed values: the prompt that the summariser gets
NO_REVIEWS_NOTE = (
    "\nNote: No audience reviews collected yet (unreleased or newly announced movie). "
    "Please generate a summary based on the overview/synopsis.\n"
)
REVIEWS_HEADING = "\nCollected Audience Reviews:\n"
INSTRUCTIONS = """
Please summarize the audience consensus into a single JSON object with the following exact keys:
{
  "overall_sentiment": <integer between 0 and 100 representing overall positive percentage>,
  "pros": [<string list of 2-4 major praised aspects>],
  "cons": [<string list of 2-4 major criticized aspects>],
  "common_themes": [<string list of 2-4 recurring topics/themes discussed>],
  "audience_consensus": "<short 2-3 sentence summary of how audiences feel>",
  "recommendation": "<short 1-2 sentence recommendation on who should watch this>"
}
Ensure the output is ONLY valid raw JSON with no Markdown markdown codeblock wrapping if possible.
"""


def clean_reviews(reviews: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Cleaned contents; reviews with fewer than ``min_words`` words left are dropped.

    The cleaned text comes out of a generator: the optimizer does not push the filter
    below it, so every text is cleaned once and not again for the filter.
    """
    min_words = min_words if min_words > 0 else MIN_WORDS
    once = F.array(text.clean_text(F.coalesce("content", F.lit(""))))
    columns = [F.explode(once).alias(c) if c == "content" else F.col(c) for c in reviews.columns]
    cleaned = reviews.select(*columns)
    return cleaned.filter(text.has_words(F.col("content"), min_words))


def copy_key(content: Column, words: int = KEY_WORDS) -> Column:
    """SHA-256 of what copies have in common, as short as the windows over it need."""
    return F.unhex(F.sha2(text.prefix_key(content, words), 256))


def _first_of_key(reviews: DataFrame, key: str) -> DataFrame:
    arrival = Window.partitionBy("movie_id", key).orderBy("source_rank", "ordinal")
    return reviews.withColumn("__n", F.row_number().over(arrival)).filter(F.col("__n") == 1).drop("__n")


def first_copies(reviews: DataFrame, words: int = KEY_WORDS) -> DataFrame:
    """The first arrival of every copy within a title, whatever its score.

    Spark limits each copy group to one row per task before the exchange, so a text
    that fills a third of the input shuffles one row per task.
    """
    return _first_of_key(reviews.withColumn("__key", copy_key(F.col("content"), words)), "__key").drop("__key")


def top_reviews(reviews: DataFrame, max_reviews: int = MAX_REVIEWS) -> DataFrame:
    """The best scored reviews of each title with their ``rank``; ties by arrival.

    The same limit before the exchange bounds what a large title sends to its task.
    """
    max_reviews = max_reviews if max_reviews > 0 else MAX_REVIEWS
    best = Window.partitionBy("movie_id").orderBy(
        F.coalesce("score", F.lit(0)).desc(), "source_rank", "ordinal"
    )
    return reviews.withColumn("rank", F.row_number().over(best)).filter(
        F.col("rank") <= max_reviews
    )


def winners(reviews: DataFrame, min_words: int = MIN_WORDS, max_reviews: int = MAX_REVIEWS) -> DataFrame:
    """``movie_id, source_rank, ordinal, score, key, rank`` of the reviews that are kept.

    Texts are cleaned where they are read and give a key of 32 bytes; no exchange carries a text.
    """
    narrow = clean_reviews(reviews, min_words).select(
        "movie_id", "source_rank", "ordinal", "score", copy_key(F.col("content")).alias("key"))
    return top_reviews(_first_of_key(narrow, "key"), max_reviews)


def _at(rows: DataFrame, bits: int) -> tuple[Column, Column]:
    """Bucket and position in a bitmap of ``bits`` bits, by arrival."""
    place = F.pmod(F.xxhash64("movie_id", "source_rank", "ordinal"), F.lit(bits)) + 1
    return F.bitmap_bucket_number(place), F.bitmap_bit_position(place)


def _maybe(reviews: DataFrame, kept: DataFrame, count: int) -> DataFrame:
    """The reviews whose arrival may be a winner's: all winners and at most one in sixteen of the others.

    The filter is bitmaps of 4 KB. Their number is bounded by ``FILTER_BITS``, beyond which more others pass.
    """
    bits = min(FILTER_BITS, 1 << (16 * count).bit_length())
    bucket, position = _at(kept, bits)
    maps = kept.select(bucket.alias("__bucket"), position.alias("__position")).groupBy("__bucket").agg(
        F.bitmap_construct_agg("__position").alias("__bitmap"))
    maps = written(maps, "winner-bitmaps")
    bucket, position = _at(reviews, bits)
    found = reviews.withColumn("__bucket", bucket).withColumn("__position", position).join(F.broadcast(maps), "__bucket")
    byte = F.conv(F.hex(F.expr("substring(__bitmap, cast(__position div 8 as int) + 1, 1)")), 16, 10).cast("int")
    bit = F.floor(byte / F.pow(F.lit(2), F.col("__position") % 8)).cast("int") % 2
    return found.filter(bit == 1).drop("__bucket", "__position", "__bitmap")


def prepare_reviews(
    reviews: DataFrame, min_words: int = MIN_WORDS, max_reviews: int = MAX_REVIEWS
) -> DataFrame:
    """Clean, drop short ones, keep first copies, keep the best: in this order.

    The winners are found and written as narrow rows first, then their texts are fetched by arrival key: by a broadcast
    of few winners, or else by a join of what passes a filter of bounded size. A title's arrivals are distinct; of
    repeated ones one row is kept. Reads ``reviews`` twice.
    """
    kept = written(winners(reviews, min_words, max_reviews), "winners")
    count = kept.count()
    known = ("movie_id", "source_rank", "ordinal", "score")
    own = kept.select("rank", F.col("key").alias("__key"), *(F.col(c).alias(f"__{c}") for c in known))
    few = count <= BROADCAST_WINNERS
    asked = reviews if few else _maybe(reviews, kept, count)
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in known))
    fetched = asked.join(F.broadcast(own) if few else own, same)
    # the key tells repeated arrivals with different texts apart
    found = clean_reviews(fetched, min_words).filter(copy_key(F.col("content")) == F.col("__key"))
    return found.dropDuplicates(["movie_id", "rank"]).select(*reviews.columns, "rank")


def review_counts(titles: DataFrame, prepared: DataFrame) -> DataFrame:
    """Reviews left per title; a title without any shows zero."""
    counts = prepared.groupBy("movie_id").agg(F.count(F.lit(1)).alias("review_count"))
    return titles.select("movie_id").join(counts, "movie_id", "left").select(
        "movie_id", F.coalesce("review_count", F.lit(0)).alias("review_count")
    )


def prompt_texts(titles: DataFrame, prepared: DataFrame) -> DataFrame:
    """``(movie_id, review_count, prompt)`` per title.

    Takes prepared reviews: at most ``max_reviews`` of them per title meet in one group.
    """
    entry = F.concat(
        F.lit("\n--- Review #"), F.col("rank").cast("string"),
        F.lit(" (Source: "), F.coalesce("source", F.lit("")),
        F.lit(", Score: "), F.coalesce("score", F.lit(0)).cast("string"),
        F.lit(") ---\n"), F.col("content"), F.lit("\n"),
    )
    blocks = prepared.groupBy("movie_id").agg(
        F.count(F.lit(1)).alias("review_count"),
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.struct("rank", entry.alias("entry")))),
                lambda row: row["entry"],
            ),
            "",
        ).alias("reviews"),
    )
    overview = F.when(
        F.coalesce("overview", F.lit("")) != "",
        F.concat(F.lit("Overview: "), "overview", F.lit("\n")),
    ).otherwise("")
    body = F.when(F.col("reviews").isNull(), NO_REVIEWS_NOTE).otherwise(
        F.concat(F.lit(REVIEWS_HEADING), "reviews")
    )
    return (
        titles.select("movie_id", "title", "overview")
        .join(blocks, "movie_id", "left")
        .select(
            "movie_id",
            F.coalesce("review_count", F.lit(0)).alias("review_count"),
            F.concat(
                F.lit("Movie Title: "), "title", F.lit("\n"), overview, body, F.lit(INSTRUCTIONS)
            ).alias("prompt"),
        )
    )
