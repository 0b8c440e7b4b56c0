"""The summariser seam: prompts go out, replies come back."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titleflow.session import written
from titleflow.sources.replies import parse_replies

Summarise = Callable[[str], str]

REPLIES = "movie_id string, review_count bigint, title string, reply string, call_error string"

# tasks that call the summariser side by side
PARALLEL_CALLS = 8


def stub_reply() -> Summarise:
    """A summariser without a model: the same reply for the same prompt."""

    def reply(prompt: str) -> str:
        reviews = prompt.count("\n--- Review #")
        return json.dumps({
            "overall_sentiment": min(50 + reviews, 100),
            "pros": ["Read by %d viewers" % reviews] if reviews else [],
            "cons": [],
            "common_themes": ["audience"],
            "audience_consensus": "Based on %d reviews." % reviews,
            "recommendation": "",
        }, sort_keys=True)

    return reply


def call_summariser(
    prompts: DataFrame, summarise: Summarise, parallel: int = PARALLEL_CALLS
) -> DataFrame:
    """One call per prompt, in ``parallel`` tasks; an error stays with its title.

    The result is written once: retries of later steps must not call again.
    """

    def call(batches):
        for batch in batches:
            replies, errors = [], []
            for prompt in batch["prompt"]:
                try:
                    replies.append(summarise(prompt))
                    errors.append(None)
                except Exception as error:  # any failure belongs to this title only
                    replies.append(None)
                    errors.append(str(error) or type(error).__name__)
            batch = batch[["movie_id", "review_count", "title"]]
            yield batch.assign(reply=replies, call_error=errors)

    columns = prompts.select("movie_id", "review_count", "title", "prompt")
    return written(columns.repartition(parallel, "movie_id").mapInPandas(call, REPLIES), "replies")


def summaries_of(replies: DataFrame) -> DataFrame:
    """``(movie_id, review_count, summary fields..., error)``; a bad reply is an error."""
    message = F.coalesce("call_error", "reply_error")
    return parse_replies(replies).select(
        "movie_id",
        "review_count",
        F.col("summary.overall_sentiment").alias("overall_sentiment"),
        F.col("summary.audience_consensus").alias("audience_consensus"),
        F.col("summary.recommendation").alias("recommendation"),
        F.col("summary.pros").alias("pros"),
        F.col("summary.cons").alias("cons"),
        F.col("summary.common_themes").alias("themes"),
        F.when(message.isNotNull(), F.concat(F.lit("LLM error for '"), "title", F.lit("': "), message))
        .alias("error"),
    )
