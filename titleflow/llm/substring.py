"""Substring dedup with an FM-index per shard.

A word goes if a window of ``WINDOW`` words that covers it occurs earlier as well. Windows that are equal share their
minimizer, the k-gram with the least hash, so the runs of windows around one minimizer are dealt by it, under a hash of
their words: a task sees all that could equal its windows, and no text moves yet. A run that is not the first of its
equals goes as a whole, mostly before the shuffle. A run whose minimizer has no other run shares no window.

Only runs that differ under one minimizer meet as text, in shards. A crowded minimizer is cut: its runs are dealt again,
by the least of longer grams, until what shares one fits a shard. A shard builds an FM-index: the Burrows-Wheeler
transform in a wavelet matrix of packed bits, two bit vectors over its rows, and the earliest place of each window found
more than once; the suffix array is not kept. The runs are streamed against it by backward search. Each step adds the
word to the left and falls back to the last ``WINDOW`` words, as matching statistics cut off at that length do; the
interval then holds every place of the window, and the earliest of them decides.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titleflow.llm.common import SPACE, id_and_text, per_batch, small_batches, written

WINDOW = 20
#: Words of a k-gram; a window holds ``WINDOW - GRAM + 1`` of them.
GRAM = 8
#: Words that a shard indexes, about.
SHARD_WORDS = 200_000
#: A minimizer whose runs have more words is cut by longer grams, as it would fill a shard by itself.
CROWD_WORDS = 20_000
#: Words by which grams grow from one cut to the next.
GRAM_STEP = 4
#: Runs whose first place a task remembers, to tell later ones before the shuffle.
REMEMBERED = 300_000

_POSITION = np.uint64((1 << 30) - 1)


def words_of(text: str) -> list[bytes]:
    return text.encode().split()  # of bytes: at the six separators only


def _minimizers(words: list[bytes], window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of the gram at each word, and for each window the place of its least; of equal ones the leftmost."""
    codes = np.fromiter(map(zlib.crc32, words), dtype=np.uint64, count=len(words))
    grams = np.zeros(len(words) - gram + 1, dtype=np.uint64)
    for k in range(gram):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + codes[k:k + len(grams)] + np.uint64(1)
    grams ^= grams >> np.uint64(29)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    grams ^= grams >> np.uint64(32)
    least = (grams & ~_POSITION) | np.arange(len(grams), dtype=np.uint64)
    wide, width = window - gram + 1, 1
    while width < wide:
        step = min(width, wide - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    return grams, (least & _POSITION).astype(np.int64)


def runs(words: list[bytes], window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``minimizer, first, windows`` of the runs of consecutive windows that have their minimizer at one place.

    A run has ``window - gram + 1`` windows at most.
    """
    n = len(words) - window + 1
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    grams, place = _minimizers(words, window, gram)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    return grams[place[first]].view(np.int64), first, np.diff(np.r_[first, n])


def _packed_bits(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A bit vector in words of 64, with the number of ones before each word."""
    packed = np.packbits(np.r_[bits, np.zeros(-len(bits) % 64 + 64, bool)], bitorder="little").view(np.uint64)
    return packed, np.r_[0, np.cumsum(np.bitwise_count(packed[:-1]), dtype=np.int64)]


def _ones(packed: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many ones a bit vector has before each place."""
    word = at >> 6
    return before[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))


class WaveletMatrix:
    """Ranks of symbols in a sequence, from one vector of packed bits per bit of a symbol."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.levels = []
        for level in reversed(range(max(1, int(symbols - 1).bit_length()))):
            bits = (sequence >> level & 1).astype(bool)
            self.levels.append((level, *_packed_bits(bits), int(len(bits) - bits.sum())))
            sequence = np.concatenate([sequence[~bits], sequence[bits]])
        self.first = self._down(np.arange(symbols), np.zeros(symbols, dtype=np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, packed, before, zeros in self.levels:
            ones = _ones(packed, before, at)
            at = np.where(symbol >> level & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        return self._down(symbol, at) - self.first[symbol]


class Index:
    """FM-index of texts of words numbered from 1, each ended by a separator 0; ``place`` orders their words.

    Beside the wavelet matrix it holds, of the rows of windows that occur more than once, two bits a row and one
    entry a window.
    """

    def __init__(self, sequence: np.ndarray, place: np.ndarray, window: int):
        n = len(sequence)
        ends = sequence == 0
        # separators differ from one another, so no comparison of suffixes passes one
        rank = np.where(ends, np.cumsum(ends) - 1, sequence + ends.sum())
        longest = int(np.diff(np.r_[-1, np.flatnonzero(ends)]).max()) if n else 0
        length, at_window = 1, None
        order = np.argsort(rank, kind="stable")
        while True:
            if 2 * length > window and at_window is None:
                at_window = rank, length
            if length >= longest:
                break
            shifted = np.zeros(n, dtype=np.int64)
            shifted[:n - length] = rank[length:] + 1
            key = rank * (int(rank.max()) + 2) + shifted
            order = np.argsort(key, kind="stable")
            ranked = key[order]
            rank = np.empty(n, dtype=np.int64)
            rank[order] = np.cumsum(np.r_[0, ranked[1:] != ranked[:-1]])
            length *= 2
        symbols = int(sequence.max()) + 1 if n else 1
        self.wavelet = WaveletMatrix(sequence[order - 1], symbols)
        self.before = np.r_[0, np.cumsum(np.bincount(sequence, minlength=symbols))][:symbols]
        # suffixes that agree in a window stand side by side
        part, length = at_window if at_window is not None else (rank, window)
        rest = np.full(n, -1, dtype=np.int64)
        rest[:n - (window - length)] = part[window - length:]
        a, b = part[order], rest[order]
        starts = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        stops = np.r_[starts[1:], n]
        several = stops - starts > 1
        earliest = np.minimum.reduceat(place[order], starts)
        self.starts, self.stops, self.earliest = starts[several].astype(np.int32), stops[several].astype(np.int32), earliest[several]
        self.repeated = _packed_bits(np.repeat(several, stops - starts))
        heads = np.zeros(n, dtype=bool)
        heads[self.starts] = True
        self.heads = _packed_bits(heads)

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals with a symbol added to the left."""
        return self.before[symbol] + self.wavelet.rank(symbol, low), self.before[symbol] + self.wavelet.rank(symbol, high)

    def _repeats(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether the windows at these rows occur more than once, and the numbers of those that do."""
        several = self.repeated[0][low >> 6] >> (low & 63).astype(np.uint64) & np.uint64(1) > 0
        return several, _ones(*self.heads, low[several] + 1) - 1

    def shorten(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the first ``window`` words of matches that are longer by some."""
        several, own = self._repeats(low)
        low, high = low.copy(), low + 1
        low[several], high[several] = self.starts[own], self.stops[own]
        return low, high

    def known_before(self, low: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether the windows at these rows occur at a place before the given one."""
        several, own = self._repeats(low)
        several[several] = self.earliest[own] < place[several]
        return several


def earlier_windows(texts: list[list[bytes]], documents: np.ndarray, starts: np.ndarray, window: int = WINDOW) -> list[np.ndarray]:
    """For each text, at its place ``(document, start)``: its windows that also occur at an earlier place.

    Texts are the runs of one shard. A place is earlier by a smaller document, or a smaller start in the same one.
    """
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    _, numbered = np.unique(np.array([w for t in texts for w in t], dtype=object), return_inverse=True)
    ends = np.cumsum(lengths + 1) - 1
    sequence = np.zeros(int((lengths + 1).sum()), dtype=np.int64)
    inside = np.ones(len(sequence), dtype=bool)
    inside[ends] = False
    sequence[inside] = numbered + 1
    first = ends - lengths
    _, document = np.unique(documents, return_inverse=True)
    place = np.repeat(document.astype(np.int64) << 32 | starts, lengths + 1)
    place += np.arange(len(sequence)) - np.repeat(first, lengths + 1)
    index = Index(sequence, place, window)
    low, high = np.zeros(len(texts), dtype=np.int64), np.full(len(texts), len(sequence), dtype=np.int64)
    found: list[list[int]] = [[] for _ in texts]
    own = np.arange(len(texts))
    for step in range(int(lengths.max())):
        own = own[lengths[own] > step]
        at = ends[own] - 1 - step
        low_, high_ = index.extend(sequence[at], low[own], high[own])
        if step >= window:
            low_, high_ = index.shorten(low_)
        low[own], high[own] = low_, high_
        if step >= window - 1:
            hit = index.known_before(low_, place[at])
            for k, a in zip(own[hit], (at - first[own])[hit]):
                found[k].append(int(a))
    return [np.array(f[::-1], dtype=np.int64) for f in found]


def _places(texts: DataFrame, window: int) -> DataFrame:
    """``minimizer, name, doc_id, start, n, later`` of all runs of ``n`` words; ``name`` is a hash of the words.

    ``later``: an equal run at an earlier place has been seen. Such a run has no group to go to, so its ``minimizer``
    is a number that spreads.
    """

    def make():
        from xxhash import xxh64_intdigest

        first_places: dict[tuple[int, int], tuple[int, int]] = {}

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: tuple[list, list, list, list, list, list] = ([], [], [], [], [], [])
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                words = words_of(text)
                minimizers, firsts, windows = runs(words, window)
                lengths = windows + (window - 1)
                names, later = [], []
                for key, a, n in zip(minimizers.tolist(), firsts.tolist(), lengths.tolist()):
                    name = xxh64_intdigest(b" ".join(words[a:a + n]))
                    names.append(name)
                    known = first_places.get((key, name))
                    is_later = known is not None and known < (doc, a)
                    later.append(is_later)
                    if not is_later:
                        if len(first_places) >= REMEMBERED:
                            first_places.clear()
                        first_places[key, name] = (doc, a)
                named = np.array(names, dtype=np.uint64).view(np.int64)
                gone = np.array(later, dtype=bool)
                for column, values in zip(out, (
                        np.where(gone, named ^ firsts ^ doc, minimizers), named, np.full(len(names), doc, dtype=np.int64), firsts, lengths, gone)):
                    column.append(values)
            arrays = [np.concatenate(x) if x else np.empty(0, np.int64) for x in out]
            return pa.RecordBatch.from_arrays([
                *(pa.array(x.astype(np.int64)) for x in arrays[:3]), *(pa.array(x.astype(np.int32)) for x in arrays[3:5]),
                pa.array(arrays[5].astype(bool))], ["minimizer", "name", "doc_id", "start", "n", "later"])

        return step

    return texts.mapInArrow(per_batch(make), "minimizer bigint, name bigint, doc_id bigint, start int, n int, later boolean")


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From places sorted by ``minimizer, name, doc_id, start``: runs that are not the first of their equals, and with
    ``mixed`` the first ones of every minimizer that has several names. One row is held at a time."""
    columns = ["minimizer", "doc_id", "start", "n"]

    def out(rows: list[np.ndarray], mixed: bool) -> pa.RecordBatch:
        types = (np.int64, np.int64, np.int32, np.int32)
        return pa.RecordBatch.from_arrays(
            [*(pa.array(x.astype(t)) for x, t in zip(rows, types)), pa.array(np.full(len(rows[0]), mixed))], [*columns, "mixed"])

    last = None  # minimizer and name of the row before
    held: list[np.ndarray] | None = None  # the one first place of the minimizer so far
    many = False  # the minimizer has several names
    for batch in batches:
        later = batch["later"].to_numpy(zero_copy_only=False)
        rows = [batch[c].to_numpy(zero_copy_only=False) for c in columns]
        if later.any():
            yield out([x[later] for x in rows], False)
        rows, name = [x[~later] for x in rows], batch["name"].to_numpy(zero_copy_only=False)[~later]
        key = rows[0]
        if not len(key):
            continue
        new = np.r_[last != (key[0], name[0]), (key[1:] != key[:-1]) | (name[1:] != name[:-1])]
        if not new.all():
            yield out([x[~new] for x in rows], False)
        if last is not None and last[0] != key[0]:
            held, many = None, False
        last = (key[-1], name[-1])
        first = [x[new] for x in rows]
        if held is not None:
            first = [np.concatenate([h, x]) for h, x in zip(held, first)]
            held = None
        if not len(first[0]):
            continue
        starts = np.flatnonzero(np.r_[True, first[0][1:] != first[0][:-1]])
        sizes = np.diff(np.r_[starts, len(first[0])])
        several = sizes > 1
        if many and first[0][0] == key[0]:
            several[0] = True
        keep = np.repeat(several, sizes)
        if keep.any():
            yield out([x[keep] for x in first], True)
        many = bool(several[-1]) and first[0][-1] == key[-1]
        if not several[-1]:
            held = [x[-1:] for x in first]


def _packed(texts: DataFrame) -> DataFrame:
    """``doc_id, packed``: texts as they are shuffled."""

    def make():
        from zstandard import ZstdCompressor

        pack = ZstdCompressor(level=1).compress

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([pack(t.encode()) for t in batch["text"].to_pylist()], pa.binary())], ["doc_id", "packed"])

        return step

    return texts.mapInArrow(per_batch(make), "doc_id bigint, packed binary")


def _unpacked(column: pa.Array) -> list[list[bytes]]:
    """The words of packed texts."""
    from zstandard import ZstdDecompressor

    unpack = ZstdDecompressor().decompress
    return [unpack(p).split() for p in column.to_pylist()]


def _run_texts(packed: DataFrame, wanted: DataFrame) -> DataFrame:
    """``minimizer, run, doc_id, start`` of the wanted places ``minimizer, doc_id, start, n``."""
    lists = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("minimizer", "start", "n")).alias("wanted"))

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for doc, words, wanted in zip(batch["doc_id"].to_pylist(), _unpacked(batch["packed"]), batch["wanted"].to_pylist()):
                for place in wanted:
                    out[0].append(place["minimizer"])
                    out[1].append(b" ".join(words[place["start"]:place["start"] + place["n"]]).decode())
                    out[2].append(doc)
                    out[3].append(place["start"])
            return pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int32())],
                ["minimizer", "run", "doc_id", "start"])

        return step

    return packed.join(lists, "doc_id").mapInArrow(per_batch(make), "minimizer bigint, run string, doc_id bigint, start int")


def _cut(found: DataFrame, window: int, gram: int) -> DataFrame:
    """``minimizer, run, doc_id, start`` of the parts of runs whose windows have their least longer gram at one place."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            split = [run.encode().split(b" ") for run in batch["run"].to_pylist()]
            lengths = np.array([len(s) for s in split], dtype=np.int64)
            words = [w for s in split for w in s]
            row = np.repeat(np.arange(len(split)), lengths)
            grams, place = _minimizers(words, window, gram)
            at = np.flatnonzero(row[:len(place)] == row[window - 1:])
            new = np.flatnonzero(np.r_[True, (place[at[1:]] != place[at[:-1]]) | (row[at[1:]] != row[at[:-1]])])
            first, n = at[new], np.diff(np.r_[new, len(at)]) + window - 1
            own = row[first]
            start = batch["start"].to_numpy()[own] + first - (np.cumsum(lengths) - lengths)[own]
            return pa.RecordBatch.from_arrays([
                pa.array(grams[place[first]].view(np.int64)),
                pa.array([b" ".join(words[a:a + k]).decode() for a, k in zip(first.tolist(), n.tolist())], pa.string()),
                pa.array(batch["doc_id"].to_numpy()[own]), pa.array(start.astype(np.int32))], ["minimizer", "run", "doc_id", "start"])

        return step

    return found.mapInArrow(per_batch(make), "minimizer bigint, run string, doc_id bigint, start int")


def _shard(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """A shard's runs, at their first places; gives the intervals ``doc_id, a, b`` that occur earlier as well."""
    texts, documents, starts = [], [], []
    for batch in batches:
        texts += [run.encode().split(b" ") for run in batch["run"].to_pylist()]
        documents += batch["doc_id"].to_pylist()
        starts += batch["start"].to_pylist()
    if not texts:
        return
    found = earlier_windows(texts, np.array(documents, dtype=np.int64), np.array(starts, dtype=np.int64), window)
    out: tuple[list, list, list] = ([], [], [])
    for windows, doc, start in zip(found, documents, starts):
        if len(windows):
            cuts = np.flatnonzero(np.diff(windows) > window) + 1
            for part in np.split(windows, cuts):
                out[0].append(doc)
                out[1].append(start + int(part[0]))
                out[2].append(start + int(part[-1]) + window)
    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["doc_id", "a", "b"])


def repeats(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """From ``doc_id, text`` without nulls or repeated ids: the intervals ``doc_id, a, b`` of words (``b`` excluded) that
    windows with an earlier equal cover, and the ``step`` that found them: ``run`` and ``part`` by equal runs and parts of
    runs, ``index`` by search. A window has ``GRAM`` words at least."""
    if window < GRAM:
        raise ValueError(f"a window has at least {GRAM} words")
    dealt = _places(texts, window).repartition("minimizer").sortWithinPartitions("minimizer", "name", "doc_id", "start")
    places = written(dealt.mapInArrow(_decided, "minimizer bigint, doc_id bigint, start int, n int, mixed boolean"), "substring-places")

    def intervals(rows: DataFrame, step: str) -> DataFrame:
        return rows.select("doc_id", F.col("start").cast("bigint").alias("a"), (F.col("start") + F.col("n")).cast("bigint").alias("b"), F.lit(step).alias("step"))

    gone = intervals(places.where("NOT mixed"), "run")
    sizes = places.where("mixed").drop("mixed")
    found, indexed, words = _run_texts(_packed(texts), sizes), [], 0
    for gram in [*range(GRAM + GRAM_STEP, window, GRAM_STEP), window]:
        total = sizes.agg(F.sum("n")).first()[0] or 0
        crowded = written(sizes.groupBy("minimizer").agg(F.sum("n").alias("words")).where(F.col("words") > CROWD_WORDS), "substring-crowded")
        over = crowded.agg(F.sum("words")).first()[0] or 0
        words += total - over
        if not over:
            indexed.append(found)
            break
        if not indexed:
            found = written(found, "substring-runs")
        indexed.append(found.join(crowded, "minimizer", "left_anti"))
        cut = written(_cut(found.join(crowded, "minimizer", "left_semi"), window, gram), "substring-cut")
        first = written(cut.groupBy("minimizer", "run").agg(F.min(F.struct("doc_id", "start")).alias("first")), "substring-parts")
        n = F.size(F.split("run", " "))
        later = cut.join(first, ["minimizer", "run"]).where(F.struct("doc_id", "start") != F.col("first"))
        gone = gone.unionByName(intervals(later.withColumn("n", n), "part"))
        # parts by grams of a whole window are single windows, so the first of equal ones needs no index
        found = first.select("minimizer", "run", "first.doc_id", "first.start")
        sizes = found.withColumn("n", n)
    shards = max(1, -(-words // SHARD_WORDS))
    texts_of_shards = reduce(DataFrame.unionByName, indexed).repartition(int(shards), "minimizer").select("run", "doc_id", "start")
    searched = texts_of_shards.mapInArrow(lambda batches: _shard(batches, window), "doc_id bigint, a bigint, b bigint")
    return gone.unionByName(searched.withColumn("step", F.lit("index")))


def kept_words(words: list, intervals: list[tuple[int, int]]) -> list:
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    for a, b in intervals:
        gone[a] += 1
        gone[b] -= 1
    stay = np.cumsum(gone[:-1]) == 0
    return [words[k] for k in np.flatnonzero(stay)]


def dedup(
    df: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
    columns: dict[str, Callable[[Column], Column]] | None = None,
) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` of every document: what stays of its words, joined by single spaces.

    ``columns`` replaces ``kept`` by columns made from it; where a text keeps all its words these are made
    before any shuffle. Words are what the six ASCII separators part; a null text has none. Earlier is a smaller id, or an
    earlier start in the same document; all windows are judged on the input. Rows with a null id have no place in
    this order and are left out; of rows repeating an id, the one with the smallest text counts. Ids are integers. An
    empty table gives an empty one; other columns are not read.
    """
    small_batches(df.sparkSession)
    columns = columns or {"kept": lambda kept: kept}
    texts = id_and_text(df, id_col, text_col).where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    if not texts.groupBy("doc_id").count().where("count > 1").isEmpty():
        texts = written(texts.groupBy("doc_id").agg(F.min("text").alias("text")), "substring-ids")
    lists = written(repeats(texts, window).groupBy("doc_id").agg(F.collect_list(F.struct("a", "b")).alias("gone")), "substring-gone")

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, removed, kept = [], [], []
            for words, gone in zip(_unpacked(batch["packed"]), batch["gone"].to_pylist()):
                stay = kept_words(words, [(g["a"], g["b"]) for g in gone])
                n.append(len(words))
                removed.append(len(words) - len(stay))
                kept.append(b" ".join(stay).decode())
            return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                                              ["doc_id", "n_words", "n_removed", "kept"])

        return step

    def shaped(rows: DataFrame) -> DataFrame:
        return rows.select("doc_id", "n_words", "n_removed", *(make_column(F.col("kept")).alias(name) for name, make_column in columns.items()))

    changed = shaped(_packed(texts).join(lists, "doc_id").select("doc_id", "packed", "gone").mapInArrow(
        per_batch(make), "doc_id bigint, n_words bigint, n_removed bigint, kept string"))
    plain = F.trim(F.regexp_replace("text", f"[{SPACE}]+", " "))
    spaces = F.length("kept") - F.length(F.replace("kept", F.lit(" "), F.lit("")))
    same = shaped(texts.select("doc_id", plain.alias("kept"), F.lit(0).cast("bigint").alias("n_removed")).withColumn(
        "n_words", F.when(F.col("kept") == "", 0).otherwise(spaces + 1).cast("bigint")))
    # an outer join, as an anti join would be moved below the columns and shuffle the texts
    touched = lists.select(F.col("doc_id").alias("__id"))
    same = same.join(touched, F.col("doc_id") == F.col("__id"), "left").where("__id IS NULL").drop("__id")
    return changed.unionByName(same)
