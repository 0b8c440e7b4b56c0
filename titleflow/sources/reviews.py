"""Landed review payloads: forum searches and RSS feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titleflow import schemas
from titleflow.functions import dates, text

# fixed values of the two review sources
FORUM = "reddit"
FORUM_BASE = "https://reddit.com"
FORUM_POSTS = 15
FEED = "letterboxd"
FEED_AUTHOR = "Letterboxd User"
FEED_ITEMS = 10

FEED_OPTIONS = {"ignoreNamespace": "true", "ignoreSurroundingSpaces": "false"}


def forum_reviews(payloads: DataFrame, max_posts: int = FORUM_POSTS) -> DataFrame:
    """Reviews of forum search payloads: the first posts of each search, adult ones dropped."""
    post = F.col("child.data")
    return (
        payloads.select("movie_id", F.posexplode("data.children").alias("pos", "child"))
        .filter(F.col("pos") < max_posts)
        .filter(~F.coalesce(post["over_18"], F.lit(False)))
        .select(
            "movie_id",
            F.concat(F.lit(FORUM + "_"), F.coalesce(post["id"], F.lit(""))).alias("id"),
            F.lit(FORUM).alias("source"),
            post["author"].alias("author"),
            text.post_content(F.coalesce(post["title"], F.lit("")), post["selftext"]).alias("content"),
            F.coalesce(post["score"], F.lit(0)).alias("score"),
            F.concat(F.lit(FORUM_BASE), F.coalesce(post["permalink"], F.lit(""))).alias("url"),
            dates.epoch_time(F.coalesce(post["created_utc"], F.lit(0.0))).alias("created_at"),
            F.col("pos").cast("bigint").alias("ordinal"),
        )
    )


def read_feeds(spark: SparkSession, path: str) -> DataFrame:
    """``(movie_id, xml)``: one landed file per feed below ``movie_id=...`` folders."""
    return (
        spark.read.text(path, wholetext=True)
        .select(F.col("movie_id").cast("string").alias("movie_id"), F.col("value").alias("xml"))
    )


def feed_reviews(feeds: DataFrame, max_items: int = FEED_ITEMS) -> DataFrame:
    """Reviews of RSS feeds: the first items, numbered by position."""
    channel = F.from_xml("xml", schemas.FEED.simpleString(), FEED_OPTIONS)["channel"]
    item = F.col("item")
    return (
        feeds.select("movie_id", F.posexplode(channel["item"]).alias("pos", "item"))
        .filter(F.col("pos") < max_items)
        .select(
            "movie_id",
            F.concat(F.lit(FEED + "_"), (F.col("pos") + 1).cast("string")).alias("id"),
            F.lit(FEED).alias("source"),
            F.coalesce(text.blank_to_null(item["creator"]), F.lit(FEED_AUTHOR)).alias("author"),
            text.feed_content(F.coalesce(item["title"], F.lit("")), item["description"]).alias("content"),
            F.lit(0).alias("score"),
            item["link"].alias("url"),
            dates.parse_feed_date(item["pubDate"]).alias("created_at"),
            F.col("pos").cast("bigint").alias("ordinal"),
        )
    )
