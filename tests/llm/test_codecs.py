import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from titleflow.llm import piece_codec, token_files
from titleflow.session import work_path

WORDS, PIECES = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "piece_bpe_32k.model"))
TEXTS = st.text(alphabet=st.sampled_from(list("abzAZ éÉßÿ÷×Ÿ²½.,'<|>_▁\n\t　\x1c\x85́\x00日𝒳09!$")), max_size=60)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS)


def ids(packed):
    return np.frombuffer(packed, dtype="<i4").tolist()


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_encoder_equals_the_library(tokenizer, text):
    assert ids(token_files.encoder(WORDS).encode(text)) == tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_codec_equals_the_library(text):
    codec = piece_codec.codec(PIECES)
    own = ids(codec.encode(text))
    codec.check(text, own, codec.decode(own))


def test_memory_forgets_but_stays_right(tokenizer, monkeypatch):
    monkeypatch.setattr(token_files, "REMEMBERED", 5)
    own = token_files.Encoder(WORDS)
    text = " ".join(f"Word{k % 13}, été{k % 7}" for k in range(300))
    assert ids(own.encode(text)) == tokenizer.encode(text, add_special_tokens=False).ids
    assert len(own.words) <= 5 and len(own.words.older) <= 5


def test_a_difference_stops_the_job():
    codec = piece_codec.Codec(PIECES)
    codec.ids["▁the"] += 1
    with pytest.raises(ValueError):
        codec.encode("the other thing hat")


def test_files_of_odd_rows(spark, odd_with_nulls, tokenizer):
    path = work_path(spark, "ids")
    token_files.write(odd_with_nulls, path, WORDS)
    got = [tuple(r) for r in token_files.summary(spark, path).collect()]
    rows = sorted(((r.doc_id, r.text or "") for r in odd_with_nulls.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    start, expected = 0, []
    for doc, text in rows:
        own = tokenizer.encode(text, add_special_tokens=False).ids + [1]
        expected.append((doc, start, len(own), zlib.crc32(np.array(own, dtype="<u4").tobytes())))
        start += len(own)
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert {r.doc_id for r in token_files.lookup(spark, path, [100, 303]).collect()} == {100, 303}


def test_lookups_are_pushed_to_the_files(spark, odd):
    path = work_path(spark, "ids")
    token_files.write(odd, path, WORDS)
    plan = token_files.lookup(spark, path, [7])._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and "doc_id" in plan.split("PushedFilters: [")[1].split("]")[0]
    from pyarrow import orc
    import glob

    names = [f for f in glob.glob(f"{path.removeprefix('file:')}/*.orc")]
    assert names and orc.ORCFile(names[0]).nstripes >= 1


def test_round_trip_of_odd_rows(odd_with_nulls):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = sorted(((r.doc_id, list(r.ids), r.decoded) for r in piece_codec.round_trip(odd_with_nulls, PIECES).collect()), key=repr)
    texts = [(r.doc_id, r.text or "") for r in odd_with_nulls.collect()]
    assert got == sorted(((i, library.encode(t), library.decode(library.encode(t))) for i, t in texts), key=repr)


def test_decode(spark):
    df = spark.createDataFrame([(1, piece_codec.codec(PIECES).library.encode("a é 日")), (2, None), (3, [0, 1, 5])], "doc_id long, ids array<int>")
    library = piece_codec.codec(PIECES).library
    assert {r.doc_id: r.text for r in piece_codec.decode(df, PIECES).collect()} == {1: "a é 日", 2: "", 3: library.decode([0, 1, 5])}


def test_empty(spark, empty):
    path = work_path(spark, "ids")
    token_files.write(empty, path, WORDS)
    assert token_files.summary(spark, path).count() == 0 and piece_codec.round_trip(empty, PIECES).count() == 0


def test_decoding_unknown_and_null_ids(spark):
    """They stand for nothing, also a negative one."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    rows = [(1, [400, None, 500]), (2, [400, -1, 500]), (3, [400, 10**6, 500]), (4, None), (5, []), (6, [400, 500])]
    got = {r.doc_id: r.text for r in piece_codec.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"), model).collect()}
    assert got[1] == got[2] == got[3] == got[6] != "" and got[4] == got[5] == ""
