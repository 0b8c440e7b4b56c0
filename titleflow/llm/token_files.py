"""Token ids in ORC files.

Documents are dealt into ranges of ascending id, encoded, and written as one ORC file a range: integer run-length
encoding for the ids, row indexes and a Bloom filter on ``doc_id``. Readers take stripes in parallel and leave out
those whose statistics or filters exclude the ids they ask for.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from titleflow.llm.common import id_and_text, per_batch, small_batches, written

#: Bytes of a stripe, and rows that share an entry of the row index and a Bloom filter.
STRIPE_BYTES = 16 << 20
INDEX_ROWS = 1_000
#: Keys that each half of an encoder's memory holds; longer ones are not remembered.
REMEMBERED, LONGEST = 400_000, 64

FILE_SCHEMA = "part int, ordinal bigint, doc_id bigint, ids array<int>"


class Remembered(dict):
    """What ``make`` gave for a key. At ``REMEMBERED`` keys these become the older half, and the last older
    half is forgotten but for what is asked for again."""

    def __init__(self, make):
        self.make, self.older = make, {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.pop(key, None)
        if value is None:
            value = self.make(key)
        if len(key) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class Encoder:
    """Ids of whole texts by the tokenizers library, remembered for words met before.

    A text of plain characters, which normalisation keeps once they are lower-case, is cut into runs of letters,
    digits and runs of signs as the vocabulary's splitter does, and these go to the library's merge model at once.
    Any other text is cut at spaces and line ends, where the splitter cuts it anyway, and its chunks that
    are not plain pass through the library's whole ``encode``.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        spelt = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        letters = [chr(c) for c in (*range(0x61, 0x7B), *range(0xDF, 0x100)) if c != 0xF7]
        capitals = [c.upper() for c in letters if len(c.upper()) == 1 and ord(c.upper()) < 0xE0]
        # an apostrophe may begin a suffix that the splitter knows, and a bracket a special token
        others = [chr(c) for c in range(0x21, 0x7F) if not chr(c).isalpha() and chr(c) not in "'<"]
        self.spelling = {ord(c): spelt.pre_tokenize_str(c)[0][0] for c in letters + others}
        alphabet = "".join(letters)
        self.odd = re.compile("[^ \n" + re.escape("".join(letters + capitals + others)) + "]").search
        self.cut = re.compile(f"[{alphabet}]+|[0-9]|[^ \n{alphabet}0-9]+").findall
        self.words = Remembered(self._word)
        self.chunks = Remembered(self._chunk)

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return array("i", ids).tobytes()

    def _word(self, word: str) -> bytes:
        return self._packed([token.id for token in self.tokenizer.model.tokenize(word.translate(self.spelling))])

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.cut(text.lower())))

    def _chunk(self, chunk: str) -> bytes:
        if self.odd(chunk):
            return self._packed(self.tokenizer.encode(chunk, add_special_tokens=False).ids)
        return self._plain(chunk)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian 32-bit integers."""
        if self.odd(text):
            return b"".join(map(self.chunks.__getitem__, text.replace("\n", " ").split(" ")))
        return self._plain(text)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process, so what it remembers outlives a task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def id_lists(packed: list[bytes]) -> pa.ListArray:
    lengths = np.fromiter((len(p) // 4 for p in packed), dtype=np.int64, count=len(packed))
    offsets = np.zeros(len(packed) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), dtype="<i4")))


def write(df: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode all texts of ``df``, end each with ``end_id``, and write ``part, ordinal, doc_id, ids`` to ``path``.

    Files, and rows within a file, follow ``doc_id`` and then the text, so that repeated ids have a fixed
    order; rows of a null id come first. A null text is an empty one: its ids are the end id alone. An empty
    table gives a folder without rows. Other columns are not read. ``tokenizer``: a file every executor can open.
    """
    small_batches(df.sparkSession)
    ordered = id_and_text(df, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    end = np.array([end_id], dtype="<i4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, done, encode_text = TaskContext.get().partitionId(), 0, encoder(tokenizer).encode
        for batch in batches:
            n = batch.num_rows
            ids = id_lists([encode_text(text) + end for text in batch["text"].to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, part, dtype=np.int32)), pa.array(np.arange(done, done + n)), batch["doc_id"].cast(pa.int64()), ids],
                ["part", "ordinal", "doc_id", "ids"])
            done += n

    ordered.mapInArrow(encode, FILE_SCHEMA).write.options(**{
        "orc.stripe.size": STRIPE_BYTES, "orc.create.index": "true", "orc.row.index.stride": INDEX_ROWS,
        "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "compression": "zstd",
    }).orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILE_SCHEMA).orc(path)


def lookup(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """The rows of some documents; stripes and row groups without them are not read."""
    return read(spark, path).where(F.col("doc_id").isin(ids))


def summary(spark: SparkSession, path: str) -> DataFrame:
    """From the files, per document: ``doc_id, start, n_tokens, ids_crc32``.

    ``start``: ids of all documents before it. Running sums stay inside a file; only one row per file
    meets in one place.
    """
    small_batches(spark)

    def checksums():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = batch["ids"]
            values = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), dtype="<i4")
            at = ids.offsets.to_numpy()
            sums = np.array([zlib.crc32(values[a:b]) for a, b in zip(at, at[1:])], dtype=np.int64)
            return pa.RecordBatch.from_arrays(
                [batch["part"], batch["ordinal"], batch["doc_id"], pc.list_value_length(ids).cast(pa.int64()), pa.array(sums)],
                ["part", "ordinal", "doc_id", "n_tokens", "ids_crc32"])

        return step

    rows = read(spark, path).mapInArrow(per_batch(checksums), "part int, ordinal bigint, doc_id bigint, n_tokens bigint, ids_crc32 bigint")
    rows = written(rows, "token-files")
    files = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    files = files.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("first"))
    in_file = Window.partitionBy("part").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(files, "part").select(
        "doc_id", (F.col("first") + F.sum("n_tokens").over(in_file) - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32")
