import random
import re

import numpy as np
import pytest

from titleflow.llm import substring


def plain(rows, window):
    """{id: (n_words, n_removed, kept)} over all windows."""
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    seen, gone = set(), {i: set() for i in words}
    for i in sorted(words):
        for at in range(len(words[i]) - window + 1):
            own = tuple(words[i][at:at + window])
            if own in seen:
                gone[i].update(range(at, at + window))
            seen.add(own)
    return {i: (len(w), len(gone[i]), " ".join(x for k, x in enumerate(w) if k not in gone[i])) for i, w in words.items()}


@pytest.mark.parametrize("seed", range(25))
def test_windows_of_a_shard(seed):
    random.seed(seed)
    window, kinds = random.choice([2, 3, 5, 20]), random.choice([1, 2, 3, 50])
    gram = random.choice([1, 2, min(8, window)])
    docs = [[b"w%d" % random.randrange(kinds) for _ in range(random.randrange(120))] for _ in range(6)]
    docs[3], docs[4] = docs[1][:50] + docs[3], docs[0]
    seen, expected, runs = set(), set(), []
    for d, words in enumerate(docs):
        for at in range(len(words) - window + 1):
            own = tuple(words[at:at + window])
            if own in seen:
                expected.add((d, at))
            seen.add(own)
        _, first, count = substring.runs(words, window, gram)
        assert count.sum() == max(0, len(words) - window + 1) and (count <= window - gram + 1).all()
        runs += [(d, int(a), words[a:a + n + window - 1]) for a, n in zip(first, count)]
    if runs:
        found = substring.earlier_windows([r[2] for r in runs], np.array([r[0] for r in runs]), np.array([r[1] for r in runs]), window)
        assert {(r[0], r[1] + int(a)) for r, f in zip(runs, found) for a in f} == expected


def test_wavelet_ranks():
    random.seed(4)
    sequence = np.array([random.randrange(37) for _ in range(1000)])
    matrix = substring.WaveletMatrix(sequence, 37)
    symbol, at = np.array([random.randrange(37) for _ in range(500)]), np.array([random.randrange(1001) for _ in range(500)])
    assert matrix.rank(symbol, at).tolist() == [int((sequence[:a] == s).sum()) for s, a in zip(symbol, at)]


@pytest.mark.parametrize("crowd_words", [substring.CROWD_WORDS, 60])
def test_dedup_of_odd_rows(odd_with_nulls, monkeypatch, crowd_words):
    """Also where most minimizers are crowded and runs are cut by longer grams."""
    monkeypatch.setattr(substring, "CROWD_WORDS", crowd_words)
    rows = {(r.doc_id, r.text) for r in odd_with_nulls.collect() if r.doc_id is not None}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring.dedup(odd_with_nulls).collect()}
    assert got == plain(rows, 20)
    assert got[101][1] > 60 and got[100][1] == 0


def passages(n, copies):
    """Documents with words of their own around one of ``n`` passages, each in several documents and cut at odd places."""
    random.seed(8)
    shared = [[f"s{k}x{j}" for j in range(60)] for k in range(n)]
    rows = []
    for d in range(n * copies):
        own = [f"o{d}x{j}" for j in range(random.randrange(40))]
        passage = shared[d % n][random.randrange(20):random.randrange(35, 61)]
        rows.append((d, " ".join(own[:10] + passage + own[10:])))
    return rows


@pytest.mark.parametrize("crowd_words", [substring.CROWD_WORDS, 300, 60])
def test_every_step_finds_its_share(spark, monkeypatch, crowd_words):
    """Passages cut at odd places differ as runs, so the index finds most of them; crowded minimizers still reach it."""
    monkeypatch.setattr(substring, "CROWD_WORDS", crowd_words)
    rows = passages(4, 25)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    expected = plain(rows, 20)
    gone = {}
    for r in substring.repeats(df).collect():
        gone.setdefault(r.doc_id, {}).setdefault(r.step, set()).update(range(r.a, r.b))
    assert {d: len(set().union(*steps.values())) for d, steps in gone.items()} == {d: n for d, (_, n, _) in expected.items() if n}
    total = sum(n for _, n, _ in expected.values())
    by_index = sum(len(steps.get("index", ())) for steps in gone.values())
    by_part = sum(len(steps.get("part", ())) for steps in gone.values())
    assert by_index > (0.3 if crowd_words > 60 else 0) * total
    assert (by_part > 0) == (crowd_words <= 300)


def test_one_window_in_many_texts_is_cut_down_to_itself(spark, monkeypatch):
    monkeypatch.setattr(substring, "CROWD_WORDS", 200)
    hot = [f"h{j}" for j in range(20)]
    rows = [(d, " ".join([f"a{d}x{j}" for j in range(15)] + hot + [f"b{d}x{j}" for j in range(15)])) for d in range(60)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring.dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == plain(rows, 20) and got[0][1] == 0 and got[59][1] == 20


def test_the_index_keeps_less_than_its_suffixes():
    random.seed(2)
    sequence = np.array([random.randrange(1, 500) for _ in range(20_000)] + [0])
    index = substring.Index(sequence, np.arange(len(sequence)), 20)
    kept = sum(x.nbytes for x in (index.starts, index.stops, index.earliest, *index.repeated, *index.heads, index.before))
    kept += index.wavelet.first.nbytes + sum(packed.nbytes + before.nbytes for _, packed, before, _ in index.wavelet.levels)
    assert kept < 4 * len(sequence)


def test_repeated_ids_count_once(spark):
    df = spark.createDataFrame([(1, "b c"), (1, "a b"), (1, "a b"), (2, "x")], "doc_id int, text string")
    assert sorted(map(tuple, substring.dedup(df).collect())) == [(1, 2, 0, "a b"), (2, 1, 0, "x")]


def test_empty(empty):
    assert substring.dedup(empty).count() == 0


def test_a_window_shorter_than_a_gram_is_refused(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    with pytest.raises(ValueError, match="at least 8"):
        substring.dedup(df, window=7)
