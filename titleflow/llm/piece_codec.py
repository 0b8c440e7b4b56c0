"""SentencePiece encoding and decoding with merge-type vocabularies.

A text starts as its characters, spaces written as a visible mark. An agenda holds the adjacent pairs of symbols
whose union is a piece, ordered by the piece's score and then by position; the best pair is merged and
its new neighbours join the agenda, until none is left. Characters without a piece fall back to bytes.

No piece of such a vocabulary continues over a mark after another character, and none holds letters beside other
characters, so a text is cut at these places into runs that are encoded on their own, and remembered. Every
new run, and the first whole text of each Arrow batch, is held against the sentencepiece library; a
difference stops the job.
"""

from __future__ import annotations

import heapq
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from titleflow.llm.common import id_and_text, per_batch, small_batches
from titleflow.llm.token_files import Remembered, id_lists

MARK = "▁"
#: A character without a piece, which keeps a run apart from the mark that the library puts before a text.
_APART = "\n"


def _runs(names) -> re.Pattern:
    """Runs that no piece crosses: marks with what follows them, letters, or other characters. A letter that some piece
    holds beside another character counts as one of those."""
    plain = re.compile(r"[^\W\d_]")
    odd = set()
    for name in names:
        for a, b in zip(name, name[1:]):
            if a != MARK and b != MARK and bool(plain.match(a)) != bool(plain.match(b)):
                odd.add(a if plain.match(a) else b)
    letter = r"[^\W\d_" + re.escape("".join(sorted(odd))) + "]"
    other = f"(?:(?!{letter})[^{MARK}])"
    return re.compile(f"{MARK}+(?:{letter}+|{other}*)|{letter}+|{other}+")


class Codec:
    def __init__(self, path: str):
        import sentencepiece

        self.library = library = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(library.get_piece_size())
        if any(library.is_unused(i) for i in every):
            raise ValueError("vocabularies with unused pieces are not supported")
        special = {i for i in every if library.is_control(i) or library.is_unknown(i) or library.is_byte(i)}
        names = [library.id_to_piece(i) for i in every]
        self.ids = {names[i]: i for i in every if i not in special}
        self.cut = _runs(self.ids).findall
        if any(len(self.cut(name)) > 1 or _APART in name for name in self.ids):
            raise ValueError("a piece holds a mark after another character, letters beside others, or a line end")
        #: By piece: what the agenda is ordered by.
        self.order = {names[i]: -library.get_score(i) for i in every if i not in special}
        self.bytes = [library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(library.is_byte(i) for i in self.bytes):
            raise ValueError("the vocabulary has no fallback to bytes")
        self.spelt = [
            bytes([self.bytes.index(i)]) if library.is_byte(i) else b"" if library.is_control(i)
            else " ⁇ ".encode() if library.is_unknown(i) else names[i].replace(MARK, " ").encode()
            for i in every
        ]
        self.silent = {i for i in every if library.is_control(i)}
        self.marked = {i for name, i in self.ids.items() if name.startswith(MARK)}
        self.known = Remembered(self._checked)

    def merge(self, run: str) -> list[int]:
        """The ids of one run by the agenda."""
        order, symbols, n = self.order.get, list(run), len(run)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(key, left, left + 1, run[left:left + 2]) for left in range(n - 1) if (key := order(run[left:left + 2])) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, left, right, joined = heapq.heappop(agenda)
            # a pair whose sides have changed since is out of date
            if after[left] != right or not symbols[left] or symbols[left] + symbols[right] != joined:
                continue
            symbols[left], symbols[right] = joined, ""
            right = after[left] = after[right]
            if right < n:
                before[right] = left
                pair = joined + symbols[right]
                if (key := order(pair)) is not None:
                    heapq.heappush(agenda, (key, left, right, pair))
            first = before[left]
            if first >= 0:
                pair = symbols[first] + joined
                if (key := order(pair)) is not None:
                    heapq.heappush(agenda, (key, first, left, pair))
        out = []
        for symbol in filter(None, symbols):
            found = self.ids.get(symbol)
            out += [found] if found is not None else [self.bytes[b] for b in symbol.encode()]
        return out

    def runs(self, text: str) -> list[str]:
        return self.cut(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, text: str) -> bytes:
        """The ids as little-endian 32-bit integers."""
        return b"".join(map(self.known.__getitem__, self.runs(text)))

    def _checked(self, run: str) -> bytes:
        ids = self.merge(run)
        if ids != self.library.encode(_APART + run.replace(MARK, " "))[2:]:  # after a mark and the line end
            raise ValueError(f"other ids than the library's for {run[:100]!r}")
        return array("i", ids).tobytes()

    def decode(self, ids: list[int]) -> str:
        spelt = self.spelt
        text = b"".join([spelt[i] for i in ids]).decode("utf-8", "replace")
        first = next((i for i in ids if i not in self.silent), None)
        return text[1:] if first in self.marked else text

    def check(self, text: str, ids: list[int], decoded: str) -> None:
        if ids != self.library.encode(text) or decoded != self.library.decode(ids):
            raise ValueError(f"other ids or text than the library's for a text that begins {text[:100]!r}")


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec per worker process, so what it remembers outlives a task."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def round_trip(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids, decoded`` of every row: the ids of its whole text, and the text those ids stand for.

    A null text is an empty one, with no ids. Null and repeated ids stay as they are, row by row; an empty table
    gives an empty one; other columns are not read. ``model``: a file that every executor can open.
    """
    small_batches(df.sparkSession)

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            own = codec(model)
            texts = batch["text"].to_pylist()
            packed = [own.encode(text) for text in texts]
            decoded = [own.decode(np.frombuffer(p, dtype="<i4").tolist()) for p in packed]
            if texts:
                own.check(texts[0], np.frombuffer(packed[0], dtype="<i4").tolist(), decoded[0])
            return pa.RecordBatch.from_arrays([batch["doc_id"], id_lists(packed), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

        return step

    rows = id_and_text(df, id_col, text_col)
    return rows.mapInArrow(per_batch(make), f"doc_id {dict(rows.dtypes)['doc_id']}, ids array<int>, decoded string")


def decode(df: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` of lists of ids. A null list is an empty one; null ids and ids that the vocabulary lacks stand for nothing."""
    from pyspark.sql import functions as F

    small_batches(df.sparkSession)
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{ids_col}`"), F.array().cast("array<int>")).alias("ids"))

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            own = codec(model)
            known = range(len(own.spelt))
            texts = [own.decode([i for i in ids if i is not None and i in known]) for ids in batch["ids"].to_pylist()]
            return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

        return step

    return rows.mapInArrow(per_batch(make), f"doc_id {dict(rows.dtypes)['doc_id']}, text string")
