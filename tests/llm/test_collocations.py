import random
import re
from collections import Counter

import numpy as np
import pytest

from titleflow.llm import collocations

SCHEMA = "doc_id long, text string, lang string"


def plain(rows, least=10, covered=50, report=2000):
    words, phrases = Counter(), Counter()
    total = Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", text):
            own = re.findall(r"[^ \t]+", piece)
            total[lang] += len(own)
            for size in (1, 2, 3):
                for k in range(len(own) - size + 1):
                    phrases[lang, tuple(own[k:k + size])] += 1
    out = {}
    for (lang, phrase), a in phrases.items():
        if len(phrase) == 1 or a < least:
            continue
        longer = [f for (g, p), f in phrases.items() if g == lang and f >= least and len(p) == 3 and len(phrase) == 2 and phrase in (p[:2], p[1:])]
        if any(100 * f >= covered * a for f in longer):
            continue
        cuts = []
        for k in range(1, len(phrase)):
            left, right = phrases[lang, phrase[:k]], phrases[lang, phrase[k:]]
            cuts.append((1_000_000 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(phrase).encode(), left, right))
    return sorted((lang, k, p.decode(), -a, left, right, total[lang], -score) for lang, own in out.items()
                  for k, (score, a, p, left, right) in enumerate(sorted(own)[:report], start=1))


def found(df, **more):
    return sorted(tuple(r) for r in collocations.mine(df, **more).collect())


def some_rows(n=400, seed=1):
    draw = random.Random(seed)
    words = "the of new york city is a an A. big, apple\tpie É é 日本 x\x1cy 'n' the the".split(" ")
    rows = [(k, " ".join(draw.choice(words) + draw.choice(["", "", "", " ", ".", "\n", "\r\n", "!?"]) for _ in range(draw.randrange(40))), draw.choice(["en", "de", None, "und", ""])) for k in range(n)]
    return rows + [(n, None, "en"), (n + 1, "", None), (None, "new york city", "en"), (5, " \t ", "de"), rows[3], rows[3]]


@pytest.mark.parametrize("block,piece", [(1 << 20, 1 << 22), (50, 30), (1, 1)])
def test_collocations_equal_brute_force(spark, monkeypatch, block, piece):
    """Also where blocks and slices end inside texts."""
    for name, value in (("BLOCK", block), ("SLICE", piece), ("SHARD", 1 << 21 if block > 50 else 64)):
        monkeypatch.setattr(collocations, name, value)
    rows = some_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).selectExpr("*", *(f"'other' AS {c}" for c in ("word", "id", "f", "block", "codes", "rank", "a")))
    for more in ({}, {"least": 3, "report": 20, "covered": 80}):
        assert found(df, **more) == plain([r[1:] for r in rows], **more)
    assert found(df.where("false")) == []


def test_a_hot_text_and_a_long_one(spark):
    rows = [(k, "Hot words, hot words again", "en") for k in range(300)] + [(500, "very long " * 60_000, "en"), (501, "x" * 200_000, "de")]
    assert found(spark.createDataFrame(rows, SCHEMA)) == plain([r[1:] for r in rows])


def test_exact_scores_beyond_64_bits(spark):
    """Counts of billions, put in after counting."""
    from pyspark.sql import functions as F

    counts = collocations.counts

    def raised(*args, **more):
        langs, vocabulary, phrases = counts(*args, **more)
        return langs, vocabulary.withColumn("f", F.col("f") * 1_000_000_007), phrases.withColumn("f", F.col("f") * 1_000_000_007)

    df = spark.createDataFrame([(1, "a b c a b d e b " * 20, "en")], SCHEMA)
    usual = {r.phrase: (r.score, r.a * 1_000_000_007) for r in collocations.mine(df).collect()}
    collocations.counts = raised
    try:
        assert {r.phrase: (r.score, r.a) for r in collocations.mine(df).collect()} == usual
    finally:
        collocations.counts = counts


@pytest.mark.parametrize("bits,more", [(1, 1), (5, 1), (5, 2), (17, 2), (31, 2), (31, 1)])
def test_filters_lose_nothing(bits, more):
    random_ = np.random.default_rng(bits)
    ids = [random_.integers(0, 1 << bits, 5000).astype(np.uint64) for _ in range(more + 1)]
    ids = [np.r_[x, x[:700], np.repeat(x[:1], 400)] for x in ids]
    keys = collocations.permuted(ids, bits)
    assert all((a == b).all() for a, b in zip(collocations.permuted(keys, bits, back=True), ids))
    expected = Counter(zip(*(x.tolist() for x in ids)))
    shards: dict[int, list[bytes]] = {}
    for part in np.array_split(np.arange(len(ids[0])), 7):
        for shard, data in collocations.filters([x[part] for x in ids], bits, min(bits, 3)):
            shards.setdefault(shard, []).append(data)
    got = Counter()
    for own in shards.values():
        first, rest, n = collocations.merged(own)
        back = [first, rest] if more == 1 else [first, rest & np.uint64((1 << bits) - 1), rest >> np.uint64(bits)]
        got.update(dict(zip(zip(*(x.tolist() for x in collocations.permuted(back, bits, back=True))), n.tolist())))
        packed = collocations.pack(first, rest, n, bits, more, min(bits, 3), int(first[0]) >> (bits - min(bits, 3)))
        assert all((a == b).all() for a, b in zip(collocations.unpack(packed), (first, rest, n)))
    assert got == expected


def test_filters_are_compact():
    ids = [np.arange(100_000, dtype=np.uint64) % 70_000, np.arange(100_000, dtype=np.uint64) * 7 % 65_536]
    ((_, data),) = collocations.filters(ids, 17, 0)
    assert len(data) < 6 * 100_000  # 34 bits of key and 64 of counter would be 12 bytes each
