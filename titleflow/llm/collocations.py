"""Collocation mining with counting quotient filters.

Words get ids; a phrase of two or three words is their packed ids, permuted by a Feistel network, which can be undone. The first
bits of the permuted number name a shard, the next ones (the quotient) a run inside the shard's filter, and the rest (the
remainder) is stored whole in its run, with a counter. So a filter is a compact sorted list of counts that loses nothing,
whatever words it holds. Every task counts its own phrases in filters of bounded size; the filters of a shard are merged.

Texts are cut into blocks of a bounded number of words, each with a dictionary of its own. Only these dictionaries, not the texts,
are joined with the vocabulary, and each block gets back the ids of its words. Words rarer than the least count
cannot be part of a candidate and get no id. No vocabulary is ever gathered in one place.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from itertools import count as counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from titleflow.llm.common import small_batches, written

#: Words of a block, bytes of text that are split at once, phrases that a filter is meant for.
BLOCK, SLICE, SHARD = 1 << 20, 1 << 22, 1 << 20
#: Parts that a language's report is first made of.
PARTS = 32
#: Bits of a word's id at most.
WIDEST = 31
#: Phrases of a report, least count of a candidate, share in percent of a phrase's count that a longer one must reach to replace it.
REPORT, LEAST, COVERED = 2000, 10, 50

_BREAK = b"\xff"  # no UTF-8 text holds this byte
_BOUNDARY = re.compile(rb"[ \t.,;:!?\n\v\f\r]")
_TABLE = bytes(0xFF if c in b".,;:!?\n\v\f\r" else 0x20 if c == 9 else c for c in range(256))


# -- filters ---------------------------------------------------------------------------------------------------------

_HEADER = "<BBBIBQQ"  # bits of an id, more ids, bits of the shard, shard, bits of the quotient, entries, large counters


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def permuted(ids: list[np.ndarray], bits: int, back: bool = False) -> list[np.ndarray]:
    """A permutation of all tuples of numbers below ``2 ** bits``; ``back`` undoes it."""
    ids = [x.astype(np.uint64) for x in ids]
    mask = np.uint64((1 << bits) - 1)
    rounds = range(3 * len(ids))
    for r in reversed(rounds) if back else rounds:
        at = r % len(ids)
        mixed = np.full(len(ids[0]), r + 1, dtype=np.uint64)
        for k, x in enumerate(ids):
            if k != at:
                mixed = _mixed(mixed * np.uint64(0x9E3779B97F4A7C15) + x)
        ids[at] = ids[at] ^ (mixed >> np.uint64(7)) & mask
    return ids


def _joined(first: np.ndarray, rest: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted different keys and the sums of their counts."""
    if not len(first):
        return first, rest, n
    order = np.lexsort((rest, first))
    first, rest, n = first[order], rest[order], n[order]
    starts = np.flatnonzero(np.r_[True, (first[1:] != first[:-1]) | (rest[1:] != rest[:-1])])
    return first[starts], rest[starts], np.add.reduceat(n, starts)


def _bytes_of(values: np.ndarray, bits: int) -> bytes:
    width = -(-bits // 8)
    return np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _values_of(data: memoryview, n: int, bits: int) -> np.ndarray:
    width = -(-bits // 8)
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(data, dtype=np.uint8, count=n * width).reshape(n, width)
    return out.reshape(-1).view("<u8")


def pack(first: np.ndarray, rest: np.ndarray, n: np.ndarray, bits: int, more: int, shard_bits: int, shard: int) -> bytes:
    """The filter of one shard from its sorted different keys ``(first, rest)``, of ``bits`` and ``more * bits``, and their counts."""
    left = bits - shard_bits
    quotient_bits = min(left, max(0, int(len(n)).bit_length() - 1))
    low = left - quotient_bits
    quotient = (first >> np.uint64(low)) & np.uint64((1 << quotient_bits) - 1)
    # runs in unary: a one per entry, after a zero for every quotient that is passed
    runs = np.zeros((1 << quotient_bits) + len(n), dtype=np.uint8)
    runs[quotient.astype(np.int64) + np.arange(len(n))] = 1
    large = n >= 255
    return b"".join((
        struct.pack(_HEADER, bits, more, shard_bits, shard, quotient_bits, len(n), int(large.sum())), np.packbits(runs).tobytes(),
        _bytes_of(first & np.uint64((1 << low) - 1), low), _bytes_of(rest, more * bits),
        np.where(large, 255, n).astype(np.uint8).tobytes(), n[large].astype("<u8").tobytes()))


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys and counts of a filter, sorted."""
    bits, more, shard_bits, shard, quotient_bits, size, large = struct.unpack_from(_HEADER, data)
    view, at = memoryview(data), struct.calcsize(_HEADER)

    def taken(length: int) -> memoryview:
        nonlocal at
        at += length
        return view[at - length:at]

    low = bits - shard_bits - quotient_bits
    length = (1 << quotient_bits) + size
    runs = np.unpackbits(np.frombuffer(taken(-(-length // 8)), dtype=np.uint8), count=length)
    quotient = (np.flatnonzero(runs) - np.arange(size)).astype(np.uint64)
    first = _values_of(taken(size * -(-low // 8)), size, low) | (quotient << np.uint64(low)) | np.uint64(shard << (bits - shard_bits))
    rest = _values_of(taken(size * -(-more * bits // 8)), size, more * bits)
    n = np.frombuffer(taken(size), dtype=np.uint8).astype(np.int64)
    n[n == 255] = np.frombuffer(taken(8 * large), dtype="<u8").astype(np.int64)
    return first, rest, n


def merged(filters: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys and summed counts of several filters of one shard."""
    parts = [unpack(f) for f in filters]
    return _joined(*(np.concatenate(x) for x in zip(*parts)))


def filters(ids: list[np.ndarray], bits: int, shard_bits: int) -> Iterator[tuple[int, bytes]]:
    """Shards and their filters of the phrases that are given by the ids of their first, second and further words."""
    more = len(ids) - 1
    keys = permuted(ids, bits)
    rest = keys[1] if more == 1 else keys[1] | (keys[2] << np.uint64(bits))
    first, rest, n = _joined(keys[0], rest, np.ones(len(rest), dtype=np.int64))
    shards = (first >> np.uint64(bits - shard_bits)).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, shards[1:] != shards[:-1]]) if len(shards) else []
    for a, b in zip(starts, [*starts[1:], len(shards)]):
        yield int(shards[a]), pack(first[a:b], rest[a:b], n[a:b], bits, more, shard_bits, int(shards[a]))


# -- blocks of words -------------------------------------------------------------------------------------------------


class _Codes(dict):
    """Numbers words as they come."""

    def __init__(self, numbers: Iterator[int], words: list[bytes]) -> None:
        super().__init__({_BREAK: 0})
        self.numbers, self.words = numbers, words

    def __missing__(self, word: bytes) -> int:
        self.words.append(word)
        self[word] = out = next(self.numbers)
        return out


class _Block:
    """Words of a bounded number as codes: 0 is the end of a piece, a negative code a word that an earlier block has counted."""

    def __init__(self) -> None:
        self.numbers, self.words, self.langs = counter(1), [], []
        self.codes: dict[str, _Codes] = {}
        self.taken: list[np.ndarray] = []
        self.size = 0

    def add(self, lang: str, words: list[bytes], before: list[bytes] = ()) -> None:
        codes = self.codes.get(lang)
        if codes is None:
            codes = self.codes[lang] = _Codes(self.numbers, self.words)
        old = [-codes[w] for w in before]
        self.taken.append(np.array([*old, *map(codes.__getitem__, words)], dtype=np.int32))
        self.size += len(words)
        self.langs += [lang] * (len(self.words) - len(self.langs))

    def end(self) -> None:
        self.taken.append(np.zeros(1, dtype=np.int32))

    def row(self) -> tuple:
        codes = np.concatenate(self.taken)
        n = np.bincount(codes[codes > 0], minlength=len(self.words) + 1)[1:]
        return self.langs, self.words, n, codes.astype("<i4").tobytes()


def _slices(text: bytes) -> Iterator[list[bytes]]:
    """Words and breaks of a text, lower-cased, some at a time."""
    at = 0
    while at < len(text):
        found = _BOUNDARY.search(text, at + SLICE)
        end = found.start() if found else len(text)
        yield text[at:end].lower().translate(_TABLE).replace(_BREAK, b" \xff ").split()
        at = end


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(block: _Block) -> pa.RecordBatch:
        langs, words, n, codes = block.row()
        arrays = [pa.array([langs], pa.list_(pa.string())), pa.array([words], pa.list_(pa.binary())).cast(pa.list_(pa.string())),
                  pa.array([n], pa.list_(pa.int64())), pa.array([codes], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, ["langs", "words", "n", "codes"])

    block = _Block()
    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
            last: list[bytes] = []
            for words in _slices(text):
                if block.size >= BLOCK:
                    yield out(block)
                    block = _Block()
                    block.add(lang, words, last)
                else:
                    block.add(lang, words)
                last = [*last, *words][-2:]
            block.end()
            if block.size >= BLOCK:
                yield out(block)
                block = _Block()
    if block.size:
        yield out(block)


# -- counts ----------------------------------------------------------------------------------------------------------


def word_ids(words: DataFrame) -> DataFrame:
    """The rows of ``words`` with an ``id`` from 1 on, without gaps."""
    numbered = written(words.withColumn("__at", F.monotonically_increasing_id()), "word-ids")
    part, place = F.shiftrightunsigned("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    # one row per task of the write
    parts = numbered.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = parts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    rows = numbered.withColumn("__part", part).join(before, "__part")
    return rows.withColumn("id", F.col("__before") + place + 1).drop("__at", "__part", "__before")


def counts(
    df: DataFrame, least: int = LEAST, text_col: str = "text", lang_col: str = "lang"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Exact counts per language: ``lang, n`` of all words; ``id, lang, word, f`` of the words, and ``n_words, w1, w2, w3, f`` of the
    phrases (of ids), that occur ``least`` times or more.

    A null language is ``und``, a null text an empty one. A-Z are lower-cased; phrases end at ``.,;:!?`` and line breaks, words
    at spaces and tabs. An empty table gives empty ones; other columns are not read.
    """
    spark = df.sparkSession
    small_batches(spark)
    rows = df.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"),
                     F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"))
    blocks = rows.mapInArrow(_blocks, "langs array<string>, words array<string>, n array<bigint>, codes binary")
    blocks = written(blocks.withColumn("block", F.monotonically_increasing_id()), "word-blocks")
    own = blocks.select("block", F.posexplode(F.arrays_zip("langs", "words", "n")).alias("at", "w")).select(
        "block", (F.col("at") + 1).alias("code"), F.col("w.langs").alias("lang"), F.col("w.words").alias("word"), F.col("w.n").alias("n"))
    totals = written(own.groupBy("lang", "word").agg(F.sum("n").alias("f")), "word-counts")
    langs = totals.groupBy("lang").agg(F.sum("f").alias("n"))
    vocabulary = written(word_ids(totals.where(F.col("f") >= least)), "vocabulary")
    size, occurrences = vocabulary.agg(F.count("*"), F.coalesce(F.sum("f"), F.lit(0))).first()
    bits = max(1, int(size).bit_length())
    if bits > WIDEST:
        raise ValueError(f"{size} words of {least} occurrences or more: ids have {WIDEST} bits at most")
    shard_bits = min(bits, max(0, int(2 * occurrences // SHARD)).bit_length())
    ids = own.join(vocabulary.select("lang", "word", "id"), ["lang", "word"]).groupBy("block").agg(
        F.collect_list(F.struct("code", "id")).alias("ids"))
    coded = blocks.select("block", "codes").join(ids, "block").select(
        "codes", F.col("ids.code").cast("array<int>").alias("code"), F.col("ids.id").alias("id"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[list[np.ndarray]]] = {2: [], 3: []}

        def out(words: int) -> pa.RecordBatch:
            found = list(filters([np.concatenate(x) for x in zip(*held[words])], bits, shard_bits))
            held[words] = []
            arrays = [pa.array([words] * len(found), pa.int32()), pa.array([s for s, _ in found], pa.int32()), pa.array([f for _, f in found], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, ["n_words", "shard", "filter"])

        for batch in batches:
            for codes, code, id_ in zip(batch["codes"], batch["code"], batch["id"]):
                codes = np.frombuffer(codes.as_buffer(), dtype="<i4")
                table = np.zeros(max(int(np.abs(codes).max(initial=0)), 0) + 1, dtype=np.int64)
                table[code.values.to_numpy()] = id_.values.to_numpy()
                x = table[np.abs(codes)]
                ends = (codes > 0) & (x > 0)
                two = np.flatnonzero(ends[1:] & (x[:-1] > 0)) + 1
                three = two[(two > 1) & (x[two - 2] > 0)]
                held[2].append([x[two - 1], x[two]])
                held[3].append([x[three - 2], x[three - 1], x[three]])
                for words in (2, 3):
                    if sum(len(k[0]) for k in held[words]) >= SHARD:
                        yield out(words)
        for words in (2, 3):
            if held[words]:
                yield out(words)

    packed = coded.mapInArrow(counted, "n_words int, shard int, filter binary")

    def summed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        words = int(key[0])
        first, rest, n = merged(rows["filter"].tolist())
        often = n >= least
        first, rest, n = first[often], rest[often], n[often]
        keys = [first, rest] if words == 2 else [first, rest & np.uint64((1 << bits) - 1), rest >> np.uint64(bits)]
        back = [x.astype(np.int64) for x in permuted(keys, bits, back=True)]
        return pd.DataFrame({"n_words": words, "w1": back[0], "w2": back[1], "w3": back[2] if words == 3 else 0, "f": n})

    phrases = packed.groupBy("n_words", "shard").applyInPandas(summed, "n_words int, w1 bigint, w2 bigint, w3 bigint, f bigint")
    return langs, vocabulary, written(phrases, "phrases")


def mine(
    df: DataFrame, least: int = LEAST, covered: int = COVERED, report: int | None = REPORT, text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: per language the first ``report`` collocations of two or three words (None: all).

    ``a``: occurrences of the phrase, ``least`` or more; ``l`` and ``r``: those of its first words and of the rest, at the cut
    that scores lowest, the first of equal ones; ``n``: words of the language; ``score``: floor of 1,000,000 a a / (l r), exact for
    counts below 10 ** 13 (beyond, the job fails). A phrase inside a longer candidate with ``covered`` percent of its occurrences or
    more is left out. Ranks go by score, then ``a``, both from the highest, then the bytes of the phrase. ``counts`` says
    how texts are read.
    """
    langs, vocabulary, phrases = counts(df, least, text_col, lang_col)
    pairs = phrases.where("n_words = 2").select("w1", "w2", F.col("f").alias("a"))
    triples = phrases.where("n_words = 3").select("w1", "w2", "w3", F.col("f").alias("a"))

    def word(k: int) -> DataFrame:
        lang = ["lang"] if k == 1 else []
        return vocabulary.select(F.col("id").alias(f"w{k}"), *lang, F.col("word").alias(f"t{k}"), F.col("f").alias(f"f{k}"))

    def scored(left: str, right: str):
        exact = {x: f"CAST({x} AS DECIMAL(13, 0))" for x in ("a", left, right)}
        return F.expr(f"{exact['a']} * {exact['a']} * CAST(1000000 AS DECIMAL(7, 0)) div ({exact[left]} * {exact[right]})")

    longer = triples.select("w1", "w2", "a").unionByName(triples.select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))
    longer = longer.groupBy("w1", "w2").agg(F.max("a").alias("most"))
    two = pairs.join(longer, ["w1", "w2"], "left").where(F.col("most").isNull() | (100 * F.col("most") < covered * F.col("a")))
    two = two.join(word(1), "w1").join(word(2), "w2").select(
        "lang", F.concat_ws(" ", "t1", "t2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), scored("f1", "f2").alias("score"))
    three = (
        triples.join(pairs.withColumnRenamed("a", "f12"), ["w1", "w2"])
        .join(pairs.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("f23")), ["w2", "w3"])
        .join(word(1), "w1").join(word(2), "w2").join(word(3), "w3")
        .withColumn("s1", scored("f1", "f23")).withColumn("s2", scored("f12", "f3"))
    )
    second = F.col("s2") < F.col("s1")
    three = three.select("lang", F.concat_ws(" ", "t1", "t2", "t3").alias("phrase"), "a", F.when(second, F.col("f12")).otherwise(F.col("f1")).alias("l"),
                         F.when(second, F.col("f3")).otherwise(F.col("f23")).alias("r"), F.least("s1", "s2").alias("score"))
    order = (F.desc("score"), F.desc("a"), "phrase")
    ranked = two.unionByName(three)
    if report is not None:
        # the first ones of every part of a language hold those of the whole, and are few, however many tasks there are
        ranked = ranked.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
        part = Window.partitionBy("lang", "part").orderBy(*order)
        ranked = ranked.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= report).drop("part")
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    if report is not None:
        ranked = ranked.where(F.col("rank") <= report)
    return ranked.join(langs, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("bigint").alias("score"))
