"""Connected components of large graphs by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titleflow.llm.common import written


def _state(edges: DataFrame) -> tuple:
    """Tells two sets of edges apart."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 40)))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the edges ``a, b``: the smallest node that it is connected with.

    Every round links the larger neighbours of a node, then the smaller ones, to its smallest neighbour; rounds
    grow with the logarithm of the nodes. A node's neighbours are never gathered: their minimum is a sum by key,
    and the join that hands it out splits hot nodes. Rounds are written to the shared folder, so a lost executor
    costs one round. Nulls and self-loops are left out; no edges give no rows.
    """
    linked = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = written(linked, "components")
    before, after = None, _state(now)
    while before != after:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "components")
        before, after = after, _state(now)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
