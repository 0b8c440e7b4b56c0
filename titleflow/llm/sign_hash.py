"""Near-dedup of embeddings: random-hyperplane sign hashing in several tables.

The side of a random hyperplane on which a vector lies is one bit; two vectors agree in it with probability 1 - angle / pi.
``BITS`` of them name a bucket of one table. Vectors that meet in a bucket of any table are compared by their exact
cosine: with 20 tables of 16 bits a pair at cosine 0.98 is missed with probability 2e-4, one at 0.99 with 2e-6.

Equal vectors are one vector with a weight. Buckets are counted on narrow keys first, and only vectors that share a bucket
travel. A crowded bucket is dealt into blocks, and every two blocks meet in a group of bounded size, so nothing is capped.
A pair counts in the first table it shares only; a group returns how many links each of its vectors has and a spanning
forest of these links, never its pairs. The forests are joined into connected components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titleflow.llm.common import fresh, per_batch, small_batches, written
from titleflow.llm.components import components

#: Tables, bits of a table's bucket, seed of the hyperplanes, least cosine of a link.
TABLES, BITS, SEED, COSINE = 20, 16, 42, 0.98
#: Vectors of a block; a group compares two blocks at most.
BLOCK = 1024

_LINKS = "a bigint, b bigint, n bigint"


def planes(dimensions: int, tables: int = TABLES, bits: int = BITS, seed: int = SEED) -> np.ndarray:
    """Normals of the hyperplanes, the same in every task."""
    return np.random.default_rng([seed, dimensions]).standard_normal((dimensions, tables * bits))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that squares neither overflow nor vanish; cosines stay the same."""
    _, exponent = np.frexp(np.abs(vectors).max(axis=1, initial=0))
    return np.ldexp(vectors, -exponent[:, None])


def buckets(vectors: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """The bucket of every row in every table."""
    signs = scaled(vectors) @ planes(vectors.shape[1], tables, bits) >= 0
    return signs.reshape(len(vectors), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))


def _usable(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per length of vectors, the rows that hold finite components that are not all zero, and these vectors."""
    lists = column.to_numpy(zero_copy_only=False)
    by_length: dict[int, list[int]] = {}
    for k, vector in enumerate(lists):
        if vector is not None and len(vector):
            by_length.setdefault(len(vector), []).append(k)
    for rows in by_length.values():
        matrix = np.stack([lists[k].astype(np.float64) for k in rows])  # a null component is NaN here
        fine = np.isfinite(matrix).all(axis=1) & (matrix != 0).any(axis=1)
        yield np.asarray(rows)[fine], matrix[fine] + 0.0  # makes -0.0 equal to 0.0


def signed(df: DataFrame, id_col: str, vector_col: str, label_col: str, tables: int, bits: int) -> DataFrame:
    """``vec_id, label, digest, vector, buckets`` of all rows with an id; the last three are null where a vector takes no part."""
    small_batches(df.sparkSession)
    kind = "array<float>" if dict(df.select(F.col(f"`{vector_col}`").alias("v")).dtypes)["v"] == "array<float>" else "array<double>"
    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), F.col(f"`{label_col}`").alias("label"),
                     F.col(f"`{vector_col}`").cast(kind).alias("vector")).where("vec_id IS NOT NULL")

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n = batch.num_rows
            digests: list = [None] * n
            found: list = [None] * n
            for at, matrix in _usable(batch["vector"]):
                if len(at):
                    for k, row, own in zip(at, matrix, buckets(matrix, tables, bits)):
                        digests[k], found[k] = hashlib.sha256(row.tobytes()).digest(), own
            return pa.RecordBatch.from_arrays(
                [batch["vec_id"], batch["label"], pa.array(digests, pa.binary()), batch["vector"], pa.array(found, pa.list_(pa.int32()))],
                ["vec_id", "label", "digest", "vector", "buckets"])

        return step

    return rows.mapInArrow(
        per_batch(make), f"vec_id bigint, label {dict(rows.dtypes)['label']}, digest binary, vector {kind}, buckets array<int>")


def _forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of positions that connect what the links connect."""
    left, out = near.any(axis=1), []
    for first in range(len(near)):
        if not left[first]:
            continue
        left[first] = False
        reached = [first]
        while reached:
            one = reached.pop()
            new = np.flatnonzero(near[one] & left)
            left[new] = False
            out += [(one, int(k)) for k in new]
            reached += new.tolist()
    return out


def _linked(cosine: float):
    """A ``mapInArrow`` function from rows sorted by group, ``g, i, j, table, v, weight, block, vector, buckets``."""

    def matrix(column: pa.Array, dtype) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(column), -1)

    def compare(groups: np.ndarray, c: dict) -> Iterator[pa.RecordBatch]:
        """``groups``: positions of the rows of groups of one size, a row each."""
        own = c["vector"][groups]
        dots = own @ own.transpose(0, 2, 1)
        length = np.sqrt(np.einsum("gij,gij->gi", own, own))
        near = dots / (length[:, :, None] * length[:, None, :]) >= cosine
        near &= ~np.eye(groups.shape[1], dtype=bool)
        two = c["i"][groups[:, 0]] != c["j"][groups[:, 0]]
        block = c["block"][groups]
        near &= ~two[:, None, None] | (block[:, :, None] != block[:, None, :])
        g, a, b = np.nonzero(near)
        for at in range(0, len(g), 1 << 20):  # a pair counts in the first table that it shares
            s = slice(at, at + (1 << 20))
            same = c["buckets"][groups[g[s], a[s]]] == c["buckets"][groups[g[s], b[s]]]
            later = same.argmax(axis=1) != c["table"][groups[g[s], 0]]
            near[g[s][later], a[s][later], b[s][later]] = False
        counts = np.einsum("gij,gj->gi", near, c["weight"][groups])
        g, a = np.nonzero(counts)
        rows, n = groups[g, a], counts[g, a]
        if len(rows):
            none = pa.nulls(len(rows), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c["v"][rows]), none, pa.array(n.astype(np.int64))], ["a", "b", "n"])
            pairs = np.array([(groups[k, x], groups[k, y]) for k in np.unique(g) for x, y in _forest(near[k])], dtype=np.int64).reshape(-1, 2)
            none = pa.nulls(len(pairs), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c["v"][pairs[:, 0]]), pa.array(c["v"][pairs[:, 1]]), none], ["a", "b", "n"])

    def complete(rows: pa.RecordBatch, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        sizes = np.diff(np.r_[starts, rows.num_rows])
        c = {name: rows[name].to_numpy(zero_copy_only=False) for name in ("i", "j", "table", "v", "weight", "block")}
        dimensions = rows["vector"].value_lengths().to_numpy()
        for d in np.unique(dimensions):  # no group mixes lengths, as their buckets are counted apart
            mine = np.flatnonzero(dimensions == d)
            place = np.full(rows.num_rows, -1)
            place[mine] = np.arange(len(mine))
            own = {k: x[mine] for k, x in c.items()}
            own["vector"] = scaled(matrix(rows["vector"].take(pa.array(mine)), np.float64))
            own["buckets"] = matrix(rows["buckets"].take(pa.array(mine)), np.int32)
            here = (dimensions[starts] == d) & (sizes > 1)
            for size in np.unique(sizes[here]):
                groups = place[starts[here & (sizes == size)]][:, None] + np.arange(size)
                many = max(1, (1 << 22) // int(size * max(size, d)))
                for at in range(0, len(groups), many):
                    yield from compare(groups[at:at + many], own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the group that the last batch ended in
        last = None
        for batch in batches:
            keys = [batch[name].to_numpy(zero_copy_only=False) for name in ("g", "i", "j")]
            new = np.zeros(batch.num_rows, dtype=bool)
            new[0] = last is None or last != tuple(k[0] for k in keys)
            for k in keys:
                new[1:] |= k[1:] != k[:-1]
            starts = np.flatnonzero(new)
            last = tuple(k[-1] for k in keys)
            if not len(starts):
                held.append(batch)
                continue
            rows = pa.Table.from_batches([*held, batch.slice(0, starts[-1])]).combine_chunks().to_batches()
            before = sum(b.num_rows for b in held)
            if rows:
                at = starts[:-1] + before
                yield from complete(rows[0], at if before == 0 else np.r_[0, at])
            held = [batch.slice(starts[-1])]
        if held:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            yield from complete(rows, np.zeros(1, dtype=np.int64))

    return run


def links(distinct: DataFrame, tables: int = TABLES, bits: int = BITS, cosine: float = COSINE) -> DataFrame:
    """From ``v, label, weight, vector, buckets`` of different vectors: ``a, n`` (a part of the links of ``a``, summed over
    weights) and ``a, b`` (a link), of which the latter connect all that links connect."""
    each = distinct.where("label IS NOT NULL").select("v", "label", F.size("vector").alias("d"), F.posexplode("buckets").alias("table", "bucket"))
    shared = each.groupBy("label", "d", "table", "bucket").agg(F.count("*").alias("n")).where("n > 1").select(
        "label", "d", "table", "bucket", F.monotonically_increasing_id().alias("g"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    shared = written(shared, "sign-buckets")  # fixes the numbers of groups
    met = each.join(shared, ["label", "d", "table", "bucket"]).groupBy("v").agg(F.collect_list(F.struct("g", "table", "blocks")).alias("met"))
    fat = distinct.join(met, "v").select("v", "weight", "vector", "buckets", F.explode("met").alias("m"))
    block = F.pmod(F.xxhash64("v", F.col("m.g")), F.col("m.blocks")).cast("int")
    rows = fat.select("v", "weight", "vector", "buckets", "m.g", "m.table", block.alias("block"), F.col("m.blocks").alias("blocks"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = rows.select("g", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "table", "v", "weight", "block", "vector", "buckets")
    dealt = dealt.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j")
    return dealt.mapInArrow(_linked(cosine), _LINKS)


def classes(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    cosine: float = COSINE, tables: int = TABLES, bits: int = BITS,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row with an id.

    ``n_links``: other rows of the same label that are linked directly; ``component_id``: the smallest id that links lead to,
    itself included; ``kept``: whether that is the own one. A link has a cosine of ``cosine`` or more in double precision,
    computed on the vectors themselves. Vectors that are null, zero or hold null or non-finite components, those of a null
    label, and those that are alone with their length link with nothing. Rows repeating an id, vectors alike or not, are rows of
    their own. Rows with a null id cannot be named and are left out. An empty table gives an empty one; other columns are not read.
    """
    rows = written(signed(df, id_col, vector_col, label_col, tables, bits), "sign-rows")
    usable = rows.where("digest IS NOT NULL AND label IS NOT NULL")
    # copies collapse in every task before they travel
    distinct = usable.groupBy("label", "digest").agg(
        F.count("*").alias("weight"), F.min("vec_id").alias("first"), F.first("vector").alias("vector"), F.first("buckets").alias("buckets"))
    distinct = written(distinct.withColumn("v", F.monotonically_increasing_id()), "sign-vectors")
    found = written(links(distinct, tables, bits, cosine), "sign-links")
    counts = found.where("n IS NOT NULL").groupBy(F.col("a").alias("v")).agg(F.sum("n").alias("n"))
    roots = components(found.where("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "v")
    named = distinct.select("v", "label", "digest", "weight", "first").join(counts, "v", "left").join(roots, "v", "left")
    named = written(named.withColumn("root", F.coalesce("root", "v")), "sign-named")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    found_of = named.join(least, "root").select(
        "label", "digest", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    own = rows.select("vec_id", "label", "digest").join(found_of, ["label", "digest"], "left")
    component = F.coalesce("component_id", "vec_id")
    return own.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
                      (F.col("vec_id") == component).alias("kept"))


def dedup(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", **settings) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns: of each component those with its smallest id. Rows repeating an id
    stay or go together; they stay if one of them leads its component. Rows with a null id stay."""
    (name,) = fresh(df, "kept_id")
    kept = classes(df, id_col, vector_col, label_col, **settings).where("kept").select(F.col("vec_id").alias(name)).distinct()
    own = F.col(f"`{id_col}`")
    return df.join(kept, own == F.col(name), "left_semi").unionByName(df.where(own.isNull()))
