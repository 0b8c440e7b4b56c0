"""SimHash near-dedup with deletion-variant signatures.

Fingerprints that differ in at most three of 64 bits differ in at most one bit of one of their two halves. So each half is
indexed under its 32 variants with one bit left open; two fingerprints that are to be linked share such a
variant, and an equality join on variants, verified on the whole fingerprint, finds every link.

A bucket of fingerprints that share a variant yields a spanning forest of its links, not all pairs. A crowded bucket is cut
again by the same rule: the other half differs in three bits at most, so one of its quarters differs in one at most.
After a third cut only eleven bits are open, which bounds any bucket, so none is ever capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titleflow.llm.common import fresh, id_and_text, per_batch, small_batches, written
from titleflow.llm.components import components

#: Words of a shingle, seed of its hash, and bits in which linked fingerprints differ at most.
WORDS, SEED, BITS = 3, 42, 3
#: Fingerprints of a bucket that are compared at once; no less than 2 ** 11, see above.
CROWD = 2048


def fingerprint(text: str, words: int = WORDS) -> int:
    """Unsigned; a bit is 1 if set in over half of the hashes of all shingles, repeats included."""
    from xxhash import xxh64_intdigest

    own = text.encode().lower().split()  # of bytes: A-Z, and the six separators, only
    if not own:
        return 0
    shingles = zip(*(own[k:] for k in range(words))) if len(own) >= words else [own]
    hashes = np.array([xxh64_intdigest(b" ".join(s), SEED) for s in shingles], dtype=">u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """``doc_id, fingerprint`` (a signed 64-bit integer) of every row; a null or wordless text has 0."""
    small_batches(df.sparkSession)

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = np.array([fingerprint(t, words) for t in batch["text"].to_pylist()], dtype=np.uint64)
            return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found.view(np.int64))], ["doc_id", "fingerprint"])

        return step

    rows = id_and_text(df, id_col, text_col)
    return rows.mapInArrow(per_batch(make), f"doc_id {dict(rows.dtypes)['doc_id']}, fingerprint bigint")


def _variants(part: Column, name: Column, width: int) -> Column:
    """Keys of the two halves of ``part``, which has ``2 * width`` bits, each with one bit left open:
    ``name``, the half, the open bit, and the half's other bits."""
    low = F.lit((1 << width) - 1)

    def key(n: Column) -> Column:
        half, bit = n / F.lit(width), n % F.lit(width)
        half = F.floor(half).cast("int")
        value = F.when(half == 0, part.bitwiseAND(low)).otherwise(F.shiftrightunsigned(part, width).bitwiseAND(low))
        masked = value.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit.cast("int"))))
        return (name * F.lit(2 * width) + n) * F.lit(1 << width) + masked

    return F.transform(F.sequence(F.lit(0), F.lit(2 * width - 1)), key)


def _forest(found: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what the links among these fingerprints connect."""
    near = np.bitwise_count(found[:, None] ^ found[None, :]) <= BITS
    left = np.ones(len(found), dtype=bool)
    out = []
    for first in range(len(found)):
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


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by ``key, more``: links ``a, b``, or the members ``a`` of crowded buckets with their keys."""

    def out(key, more, a, b, crowded: bool) -> pa.RecordBatch:
        key, more, a, b = (np.asarray(x, dtype=np.int64) for x in (key, more, a, b))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (key, more, a, b, np.full(len(a), crowded))], ["key", "more", "a", "b", "crowded"])

    def links(found: np.ndarray) -> pa.RecordBatch:
        pairs = np.array(_forest(found.view(np.uint64)), dtype=np.int64).reshape(-1, 2)
        zero = np.zeros(len(pairs), dtype=np.int64)
        return out(zero, zero, found[pairs[:, 0]], found[pairs[:, 1]], False)

    last, held, crowded = None, np.empty(0, dtype=np.int64), False  # the bucket that a batch ends in
    for batch in batches:
        key, more, found = (batch[c].to_numpy(zero_copy_only=False) for c in ("key", "more", "fingerprint"))
        starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (more[1:] != more[:-1])])
        ends = np.r_[starts[1:], len(key)]
        first = 0
        if last == (key[0], more[0]):
            first = 1
            own = found[: ends[0]]
            if crowded:
                yield out(key[: ends[0]], more[: ends[0]], own, own, True)
            else:
                held = np.concatenate([held, own])
        if len(starts) > first:  # the held bucket is complete
            if not crowded and len(held) > 1:
                yield links(held)
            held, crowded = np.empty(0, dtype=np.int64), False
            done = slice(first, len(starts) - 1)
            sizes = ends[done] - starts[done]
            two = starts[done][sizes == 2]
            near = np.bitwise_count(found[two].view(np.uint64) ^ found[two + 1].view(np.uint64)) <= BITS
            zero = np.zeros(int(near.sum()), dtype=np.int64)
            yield out(zero, zero, found[two][near], found[two + 1][near], False)
            for a, b in zip(starts[done][sizes > 2], ends[done][sizes > 2]):
                if b - a > CROWD:
                    yield out(key[a:b], more[a:b], found[a:b], found[a:b], True)
                else:
                    yield links(found[a:b])
            held = found[starts[-1]:].copy()
        last = (key[-1], more[-1])
        if not crowded and len(held) > CROWD:
            crowded = True
            n = len(held)
            yield out(np.full(n, last[0]), np.full(n, last[1]), held, held, True)
            held = np.empty(0, dtype=np.int64)
    if not crowded and len(held) > 1:
        yield links(held)


def links(distinct: DataFrame) -> DataFrame:
    """``a, b``: links that connect all of the distinct ``fingerprint`` values that links connect."""
    long, zero = F.lit(0).cast("bigint"), F.lit(0).cast("bigint")
    mine = F.col("fingerprint")
    rows = distinct.select("fingerprint", F.explode(_variants_64(mine)).alias("key"), zero.alias("more"))
    found = []
    for level in range(3):
        dealt = rows.repartition("key", "more").sortWithinPartitions("key", "more")
        made = written(dealt.select("key", "more", "fingerprint").mapInArrow(_linked, "key bigint, more bigint, a bigint, b bigint, crowded boolean"), "simhash-links")
        found.append(made.where("NOT crowded").select("a", "b"))
        crowd = made.where("crowded").select("key", "more", F.col("a").alias("fingerprint"))
        if level == 2 or crowd.isEmpty():
            break
        if level == 0:
            # the half that the key does not hold
            half = F.shiftrightunsigned("key", 32).cast("bigint")
            other = F.when(half < 32, F.shiftrightunsigned("fingerprint", 32)).otherwise(mine.bitwiseAND(F.lit(0xFFFFFFFF)))
            rows = crowd.select("fingerprint", F.explode(_variants(other, F.col("key"), 16)).alias("key"), long.alias("more"))
        else:
            # the quarter that the two cuts do not hold
            quarter = F.shiftrightunsigned("key", 16) % 32
            half = F.shiftrightunsigned("key", 16 + 5 + 32)
            other = F.when(half < 32, F.shiftrightunsigned("fingerprint", 32)).otherwise(mine.bitwiseAND(F.lit(0xFFFFFFFF)))
            rest = F.when(quarter < 16, F.shiftrightunsigned(other, 16)).otherwise(other.bitwiseAND(F.lit(0xFFFF)))
            rows = crowd.select("fingerprint", "key", F.explode(_variants(rest, F.lit(0).cast("bigint"), 8)).alias("more"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def _variants_64(value: Column) -> Column:
    return _variants(value, F.lit(0).cast("bigint"), 32)


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row with an id.

    ``fingerprint``: 16 lower-case hex digits. ``component_id``: the smallest id that links lead to. Null texts
    are empty ones, and wordless texts are linked by their fingerprint 0 like others. Rows with a null id cannot
    be named and are left out; rows repeating an id have the fingerprints of their own texts. An empty table gives an
    empty one; other columns are not read.
    """
    own = written(fingerprints(df, id_col, text_col, words).where("doc_id IS NOT NULL"), "simhash")
    distinct = own.groupBy("fingerprint").agg(F.min("doc_id").alias("first"))
    roots = components(links(distinct))
    named = distinct.join(roots, distinct.fingerprint == roots.node, "left").select("fingerprint", "first", F.coalesce("root", "fingerprint").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    lead = named.join(least, "root").select("fingerprint", "component_id")
    return own.join(lead, "fingerprint").select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """The rows of ``df`` that stay: of each class those with the smallest id, with all their columns. Rows with a
    null id stay, as they belong to no class."""
    (name,) = fresh(df, "id")
    lead = classes(df, id_col, text_col, words).where("doc_id = component_id").select(F.col("doc_id").alias(name)).distinct()
    own = F.col(f"`{id_col}`")
    return df.join(lead, own == F.col(name), "left_semi").unionByName(df.where(own.isNull()))
