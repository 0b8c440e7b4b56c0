"""Mixing sources to target weights.

Token shares are raised to an exponent between 0 (all sources alike) and 1 (as they are) and normalised. The
exponent is bisected until the mix meets a target: an entropy to reach, or a limit on how often a source may be
repeated. The weights times a token budget are the quotas of the sources. A source fills its quota by epochs, each
a permutation of its blocks and of the rows inside a block; the last epoch ends where the quota is full.

A source has about as many blocks as a block has rows, the root of its rows each, so no window holds more than
that. Only sources, not rows, meet in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titleflow.llm.common import SPACE, fresh

#: Halvings of the exponent's range.
STEPS = 50


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[^{SPACE}]+")).cast("bigint")


def _powers(shares: Column, exponent: Column) -> Column:
    return F.transform(shares, lambda p: F.pow(p, exponent))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _entropy(shares: Column, exponent: Column) -> Column:
    """In nats, of the normalised powers."""
    powers = _powers(shares, exponent)
    total = _total(powers)
    return -F.aggregate(powers, F.lit(0.0), lambda a, x: a + x / total * F.ln(x / total))


def _epochs(shares: Column, exponent: Column, budget: Column) -> Column:
    """The most epochs of any source, if the quotas add up to ``budget`` (in shares of all tokens)."""
    powers = _powers(shares, exponent)
    most = F.array_max(F.zip_with(powers, shares, lambda x, p: x / p))
    return most * budget / _total(powers)


def _whole_budget(shares: Column, exponent: Column) -> Column:
    """The least budget that gives every source one epoch at least."""
    powers = _powers(shares, exponent)
    least = F.array_min(F.zip_with(powers, shares, lambda x, p: x / p))
    return _total(powers) / least


def source_weights(
    tokens: DataFrame, max_epochs: float | None = None, target_entropy: float | None = None, budget: int | None = None
) -> DataFrame:
    """``source, n_rows, n_tokens, exponent, weight, quota`` from rows of ``source, tokens``.

    Give one target: ``max_epochs`` takes the smallest exponent at which no source is passed more often than
    that, ``target_entropy`` (nats) the largest one that reaches it. If even exponent 1 repeats too
    much, or exponent 0 has too little entropy, that end of the range is taken, and quotas stop at ``max_epochs``.
    ``budget``: tokens of the mix; by default the least number that passes every source once at least. Sources
    without tokens have weight 0, and a quota of 0. An empty table has no sources.
    """
    if (max_epochs is None) == (target_entropy is None):
        raise ValueError("give either max_epochs or target_entropy")
    sums = tokens.groupBy("source").agg(F.count("*").alias("n_rows"), F.sum("tokens").alias("n_tokens"))
    # one row holds all sources, in a fixed order so that sums of doubles repeat
    listed = sums.agg(F.sort_array(F.collect_list(F.struct("source", "n_rows", "n_tokens"))).alias("of"),
                      F.sum("n_tokens").cast("double").alias("total"))
    listed = listed.withColumn("shares", F.transform(
        F.filter("of", lambda s: s.n_tokens > 0), lambda s: s.n_tokens / F.col("total")))
    shares = F.col("shares")
    part = (lambda a: F.lit(float(budget)) / F.col("total")) if budget is not None else (lambda a: _whole_budget(shares, a))

    def halve(range_: Column, _: Column) -> Column:
        middle = (range_.low + range_.high) / 2
        if max_epochs is not None:
            up = _epochs(shares, middle, part(middle)) > max_epochs
        else:
            up = _entropy(shares, middle) >= target_entropy
        return F.struct(F.when(up, middle).otherwise(range_.low).alias("low"), F.when(up, range_.high).otherwise(middle).alias("high"))

    met = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high")), halve)
    listed = listed.withColumn("range", met)
    listed = listed.withColumn("exponent", F.col("range.high") if max_epochs is not None else F.col("range.low"))
    listed = listed.withColumn("sum", _total(_powers(shares, F.col("exponent"))))
    listed = listed.withColumn("budget", part(F.col("exponent")) * F.col("total"))
    each = listed.select(F.explode("of").alias("s"), "exponent", "sum", "budget", "total")
    weight = F.when(F.col("s.n_tokens") > 0, F.pow(F.col("s.n_tokens") / F.col("total"), F.col("exponent")) / F.col("sum")).otherwise(0.0)
    quota = F.round(weight * F.col("budget"))
    if max_epochs is not None:
        quota = F.least(quota, F.floor(F.lit(float(max_epochs)) * F.col("s.n_tokens")))
    return each.select("s.source", "s.n_rows", "s.n_tokens", "exponent", weight.alias("weight"), quota.cast("bigint").alias("quota"))


def _order(seed: str, *parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), *(p.cast("string") for p in parts)).cast("binary"))


def mix(
    rows: DataFrame, max_epochs: float | None = None, target_entropy: float | None = None, budget: int | None = None, seed: str = "mix"
) -> DataFrame:
    """The rows of the mix, from rows of ``doc_id, source, tokens``.

    Returns ``doc_id, source, tokens, epoch, block, block_rank, rank``: an epoch of a source is read by ``block_rank``,
    then ``rank``. A row whose quota has room for it when its turn comes is taken whole, so a source overruns its
    quota by less than one row. Rows of sources without tokens are taken once, in epoch 0. Null sources count as
    ''. Null ids are drawn like others; rows that repeat an id are rows of their own. Null tokens count as 0.
    """
    rows = rows.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens"))
    sources = source_weights(rows, max_epochs, target_entropy, budget).select(
        "source",
        F.ceil(F.sqrt("n_rows")).cast("bigint").alias("blocks"),
        F.when(F.col("n_tokens") > 0, F.floor(F.col("quota") / F.col("n_tokens"))).otherwise(1).cast("bigint").alias("whole"),
        F.when(F.col("n_tokens") > 0, F.col("quota") % F.col("n_tokens")).otherwise(0).alias("rest"),
    )
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    place = F.conv(F.substring(_order(seed + "-block", name), 1, 15), 16, 10).cast("bigint")
    dealt = rows.join(sources.select("source", "blocks"), "source").select("doc_id", "source", "tokens", (place % F.col("blocks")).alias("block"))
    # blocks, in the order of each epoch
    last = F.col("whole") - F.when(F.col("rest") > 0, 0).otherwise(1)
    epochs = F.when(last >= 0, F.sequence(F.lit(0).cast("bigint"), last))
    by_block = Window.partitionBy("source", "epoch").orderBy("__order", "block")
    blocks = (
        dealt.groupBy("source", "block").agg(F.sum("tokens").alias("in_block")).join(sources, "source")
        .withColumn("epoch", F.explode(epochs))
        .withColumn("__order", _order(seed, F.col("epoch"), F.col("block")))
        .withColumn("block_rank", F.row_number().over(by_block).cast("bigint"))
        .withColumn("before", F.sum("in_block").over(by_block) - F.col("in_block"))
        .where((F.col("epoch") < F.col("whole")) | (F.col("before") < F.col("rest")))
        .select("source", "block", "epoch", "block_rank", "before", F.when(F.col("epoch") == F.col("whole"), F.col("rest")).alias("room"))
    )
    in_block = Window.partitionBy("source", "block", "epoch").orderBy("__order", "doc_id", "tokens")
    return (
        dealt.join(blocks, ["source", "block"])
        .withColumn("__order", _order(seed, F.col("epoch"), name))
        .withColumn("rank", F.row_number().over(in_block).cast("bigint"))
        .withColumn("__before", F.col("before") + F.sum("tokens").over(in_block.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens"))
        .where(F.col("room").isNull() | (F.col("__before") < F.col("room")))
        .select("doc_id", "source", "tokens", "epoch", "block", "block_rank", "rank")
    )


def repeat(
    df: DataFrame, max_epochs: float | None = None, target_entropy: float | None = None, budget: int | None = None, seed: str = "mix",
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """The rows of ``df``, with all their columns, as often as the mix takes them; tokens are words.

    Rows repeating an id, null ones too, are drawn together, for the smallest of their sources.
    """
    units = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), word_count(F.col(f"`{text_col}`")).alias("tokens"))
    units = units.groupBy("doc_id").agg(F.min(F.coalesce("source", F.lit(""))).alias("source"), F.sum("tokens").alias("tokens"))
    name, times, n = fresh(df, "id", "times", "n")
    taken = mix(units, max_epochs, target_entropy, budget, seed).groupBy(F.col("doc_id").alias(name)).agg(F.count("*").cast("int").alias(times))
    rows = df.join(taken, F.col(f"`{id_col}`").eqNullSafe(F.col(name)))
    return rows.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*(F.col(f"`{c}`") for c in df.columns))
